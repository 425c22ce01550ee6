"""Work that must not grow faster than the input: reuse, spreading and files."""

import hashlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quillrank.operators import chunking as C
from quillrank.operators import knn as V
from quillrank.operators import lexical as L
from quillrank.operators import maxscore
from quillrank.operators import traces as T
from quillrank.plans import labels as P
from quillrank.sources import files as SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunk_statistics_cut_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b c " * 300), (2, ""), (3, None), (4, "x")], "chapter long, text string")
    found = C.chunk_statistics(C.chunk_documents(docs, ["fixed-300", "fixed-800"]))
    got = {r.strategy: (r.chunks, r.max_tokens, r.over_1000) for r in found.collect()}
    assert got == {"fixed-300": (5, 300, 0), "fixed-800": (3, 800, 0)}
    assert "regexp_extract_all" not in plan(found)


def test_index_parts_follow_the_size_of_the_chunks(spark, tmp_path, monkeypatch):
    made = spark.createDataFrame([(i, "a b" if i % 2 else "b c") for i in range(60)], "chunk_id long, text string")
    made.coalesce(1).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    queries = spark.createDataFrame([(1, "a c"), (2, "b")], "query_id long, query string")
    terms = L.query_terms(queries)

    def scores():
        index = L.index_rows(chunks, vocabulary=terms)
        rows = L.score(index, terms).orderBy("query_id", "chunk_id").collect()
        return index.rdd.getNumPartitions(), [(r.query_id, r.chunk_id, round(r.score, 9)) for r in rows]

    few, want = scores()
    monkeypatch.setattr(L, "INDEX_BYTES", 50)
    many, got = scores()
    assert few == spark.sparkContext.defaultParallelism < many
    assert L.index_rows(made, vocabulary=terms).rdd.getNumPartitions() <= 8
    assert got == want and len(want) == 120


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 40).alias("key"), F.when(F.col("id") != 9, F.col("id")).alias("line"), "id"
    )
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = T.duplicates(rows, "key", "line").select("*", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) == 4000
    for r in found:
        first = 1 if r.key is None else r.key
        assert r.is_duplicate == (None if r.line is None else r.line > first)
    assert len({r.at for r in found if r.key is None}) > 1


def test_an_append_adds_one_file_to_a_folder(spark, tmp_path):
    rows = spark.range(400).select(
        F.format_string("2024-02-%02dT08:00:00Z", F.col("id") % 3 + 1).alias("created_at"),
        (F.col("id") % 40).cast("string").alias("business"), F.col("id").cast("string").alias("turn_id"),
    )
    path = tmp_path / "log"
    for part in (0, 1):
        SF.append_turns(rows.where(F.col("id") % 2 == part), str(path), buckets=4)
        folders = [f.parent for f in Path(path).rglob("*.json")]
        assert len(folders) == (part + 1) * len(set(folders)) and len(set(folders)) == 12
    assert spark.read.json(str(path)).count() == 400


def test_two_searches_read_texts_once(spark, tmp_path, monkeypatch):
    texts = ["red fox", "red red hen", "blue hen", "", None, "blue fox hen red"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "red hen"), (2, "blue")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    calls, profiles = [], L.profiles
    monkeypatch.setattr(L, "profiles", lambda *a, **k: calls.append(1) or profiles(*a, **k))
    row = P.j4_cov(spark, str(tmp_path)).first()
    # Labelled documents found: 1, 2 and 6 by the first query, 6 by the second; all support themselves.
    assert (row.claims, row.supported, row.coverage) == (4, 4, 1.0)
    assert len(calls) == 1


def test_texts_with_a_small_vocabulary_are_counted_where_they_are(spark, monkeypatch):
    texts = ["Red fox red", "--red-hen- HEN-", "", None, "-", "blue", "x " * 3000 + "hen-", "é redK-1"]
    chunks = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "chunk_id long, text string, subject string")
    terms = [("red", 7), ("hen-", 4), ("x", 9), ("none", 1), ("redk-1", 12)]
    vocabulary = L.stored(spark.createDataFrame(terms, "term string, tid long"), "vocabulary")
    plans, stored = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    monkeypatch.setattr(L, "SLICE_BYTES", 20)

    def rows():
        made = L.profiles(chunks, vocabulary, keep=["subject"])
        return sorted((r.row, r.chunk_id, r.subject, r.chunk_len, r.tids, r.tfs) for r in made.collect())

    got = rows()
    assert "Exchange" not in plans[0] and "Generate" not in plans[0] and plans[0].count("ArrowEvalPython") == 1
    want = [(3, [7], [2]), (2, [4], [1]), (0, [], []), (0, [], []), (0, [], []), (1, [], []), (3001, [4, 9], [1, 3000]), (1, [12], [1])]
    assert [(r[1], *r[3:]) for r in got] == [(i, *w) for i, w in enumerate(want)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # A vocabulary too large for the tasks is joined.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows() == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_without_asked_terms_are_no_block():
    best = maxscore.Best([[(3, 1.0)]], [None], 2)
    best.take(np.zeros(0, int), np.zeros(0, int), np.zeros(0), [1, 2], [1, 2], None)
    best.take(np.array([1]), np.array([3]), np.array([0.5]), [3, 4], [3, 4], None)
    assert [(e[3], e[4]) for e in best.best[0]] == [(4, 0.5)]


def test_buckets_are_counted_without_a_search_for_each(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "- c")], "id int, text string")
    made = V.embed(rows, V.HashingProvider(300))
    assert "array_position" not in plan(made) and "array_sort" not in plan(made)
    bucket = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 300 for t in "abc"}
    for r in made.collect():
        want = [0.0] * 300
        for t in {1: "aba", 2: "", 3: "c"}[r.id]:
            want[bucket[t]] += 1
        assert r["values"] == want
