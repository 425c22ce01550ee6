"""Search, vectors, fusion and percentiles: literal cases, brute force, and both join paths."""

import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank import scale
from quillrank.functions import vectors as VX
from quillrank.operators import fusion as R
from quillrank.operators import knn as V
from quillrank.operators import labels as J
from quillrank.operators import lexical as L
from quillrank.operators import maxscore
from quillrank.operators.quantiles import quantiles
from quillrank.sources import vectors as SV


def toks(text):
    return re.findall("[a-z0-9][a-z0-9-]*", text.lower())


def bm25_walk(docs, query, k):
    counts = [Counter(toks(t)) for _, t in docs]
    avg = sum(sum(c.values()) for c in counts) / max(1, len(counts))
    scored = []
    for (doc_id, _), c in zip(docs, counts, strict=True):
        score = 0.0
        for term, w in Counter(toks(query)).items():
            if c[term]:
                df = sum(term in d for d in counts)
                part = c[term] + 1.5 * (0.25 + 0.75 * sum(c.values()) / max(1.0, avg))
                score += w * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[term] * 2.5 / part
        if score > 0:
            scored.append((doc_id, score))
    scored.sort(key=lambda s: (-round(s[1], 9), s[0]))
    return scored[:k]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    # One term in nearly every document, copies, and documents without any token.
    docs = [(i, "the " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(60)]
    docs += [(60, docs[3][1]), (61, ""), (62, "É ü")]
    queries = [(q, " ".join(rng.choices([*vocabulary, "the", "nowhere"], k=4))) for q in range(8)]
    queries += [(8, ""), (9, "nowhere")]
    return docs, queries


def frames(spark, corpus):
    docs, queries = corpus
    return spark.createDataFrame(docs, "chunk_id int, text string"), spark.createDataFrame(queries, "query_id int, query string")


@pytest.fixture(params=["broadcast", "shuffled"])
def joins(spark, request, monkeypatch):
    """Both ways of a sized join."""
    if request.param == "shuffled":
        monkeypatch.setattr(scale, "broadcast_bytes", lambda df: -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_bm25_matches_brute_force_on_both_join_paths(spark, corpus, joins):
    docs, queries = frames(spark, corpus)
    got = {}
    for r in L.search(docs, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for q, text in corpus[1]:
        want = bm25_walk(corpus[0], text, 5)
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want])


def test_sized_join_keeps_every_pair_once(spark, joins):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    wide = scale.join_sized(big, small, ["k"])
    assert wide.count() == 3000
    assert wide.where(F.col("v") != F.col("k") * 2).count() == 0
    assert scale.join_sized(big, small.where("k < 3"), ["k"], how="left_semi").count() == big.where("k < 3").count()


def test_term_counts_move_nothing(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a")], "chunk_id int, text string")
    found = L.postings(docs)
    assert sorted((r.chunk_id, r.chunk_len, r.term, r.tf) for r in found.collect()) == [(1, 3, "a", 1), (1, 3, "b", 2), (4, 1, "a", 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_for_two_parameter_pairs(spark, corpus):
    docs, queries = frames(spark, corpus)
    pairs = {"a": (1.5, 0.75), "b": (0.4, 0.3)}
    found = L.search_variants(docs, queries, pairs, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
    rows = sorted((r.variant, r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in found.collect())
    apart = [
        (name, r.query_id, r.rank, r.chunk_id, round(r.score, 9))
        for name, (k1, b) in pairs.items() for r in L.search(docs, queries, 5, k1=k1, b=b).collect()
    ]
    assert rows == sorted(apart)


def test_stored_index_reads_only_the_parts_asked_for(spark, corpus, tmp_path):
    docs, queries = frames(spark, corpus)
    path = str(tmp_path / "index")
    L.write_index(docs, path, part_postings=40)
    few = queries.where("query_id < 2")
    terms = L.query_terms(few)
    found, numbers = L.read_index(spark, path, terms)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    kept = {r.term for r in terms.collect()}
    whole = L.postings(docs).where(F.col("term").isin(list(kept))).collect()
    assert sorted((r.chunk_id, r.chunk_len, r.term, r.tf) for r in rows) == sorted((r.chunk_id, r.chunk_len, r.term, r.tf) for r in whole)
    parts = spark.read.parquet(f"{path}/postings").select("part").distinct().count()
    assert numbers.select("part").distinct().count() < parts
    for asked in (queries, few):
        stored = [tuple(r) for r in L.search_index(spark, path, asked, 5).collect()]
        direct = [tuple(r) for r in L.search(docs, asked, 5).collect()]
        assert [(q, c, k) for q, c, _, k in sorted(stored)] == [(q, c, k) for q, c, _, k in sorted(direct)]
        assert [s for _, _, s, _ in sorted(stored)] == pytest.approx([s for _, _, s, _ in sorted(direct)])


def test_bounds_leave_blocks_out_and_lose_nothing():
    rng = random.Random(8)
    k, rows, weights = 3, 900, 40
    terms = [[(rng.randrange(weights * 3), rng.random()) for _ in range(8)] for _ in range(25)] + [[], [(5, 1.0)]]
    wanted = [rng.choice([None, [], ["x"], ["x", "z"]]) for _ in terms]
    # Rows of equal contents tie; some rows hold no term.
    contents = [{rng.randrange(weights): 1 + rng.random() * (10 if i < 40 else 1) for _ in range(rng.randrange(6))} for i in range(rows)]
    contents[100:160] = [contents[3]] * 60
    subjects = [rng.choice([None, ["x"], ["y", "z"]]) for _ in range(rows)]
    best = maxscore.Best(terms, wanted, k)
    for start in range(0, rows, 300):
        part = range(start, start + 300)
        places = [(i - start, t, w) for i in part for t, w in contents[i].items()]
        row, tid, worth = (np.array(c) for c in zip(*places, strict=True))
        best.take(row, tid, worth, list(part), [-i for i in part], [subjects[i] for i in part])
    assert best.scored < 0.6 * best.blocks
    for q, own in enumerate(terms):
        scores = []
        for i in range(rows):
            score = sum(w * contents[i].get(t, 0) for t, w in own)
            if score > 0 and (not wanted[q] or set(wanted[q]) & set(subjects[i] or [])):
                scores.append((-round(score, 9), -i))
        assert [(e[0], e[2]) for e in best.best[q]] == sorted(scores)[:k]


def test_queries_in_several_parts(spark, corpus, monkeypatch):
    docs, queries = frames(spark, corpus)
    whole = sorted((r.query_id, r.rank, r.chunk_id) for r in L.search(docs, queries, 5).collect())
    monkeypatch.setattr(maxscore, "QUERY_TERMS", 3)
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in L.search(docs, queries, 5).collect()) == whole


def test_subject_filter_keeps_corpus_statistics(spark):
    docs = spark.createDataFrame([("a", "pay back", ["x"]), ("b", "pay", ["y"]), ("c", "other", ["x", "y"])], "chunk_id string, text string, subjects array<string>")
    queries = spark.createDataFrame([(1, "pay", ["x"]), (2, "pay", [])], "query_id int, query string, wanted array<string>")
    rows = L.search(docs, queries, 5, subjects="subjects", query_subjects="wanted").collect()
    score = {(r.query_id, r.chunk_id): r.score for r in rows}
    assert set(score) == {(1, "a"), (2, "a"), (2, "b")}
    assert score[(1, "a")] == score[(2, "a")]


def test_store_filter_and_namespace_cases(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 0.0], ["unit-economics"], None), ("b", [0.0, 1.0], ["upsells"], None), ("c", [1.0, 0.0], ["offers"], "p-offers"), ("d", [1.0, 0.0], ["offers"], "p-upsells"), ("z", [0.0, 0.0], ["offers"], "p-offers")],
        "vector_id string, values array<double>, subjects array<string>, space string",
    )
    query = spark.createDataFrame([(1, [1.0, 0.0], "p-offers")], "query_id int, values array<double>, space string")
    keep = VX.metadata_predicate({"subjects": {"$in": ["unit-economics"]}}, {"subjects"})
    assert [r.vector_id for r in V.nearest(rows.where(keep), query, 2).collect()] == ["a"]
    inside = V.nearest(rows, query, 5, namespace="space", query_namespace="space").collect()
    assert [(r.vector_id, r.namespace) for r in inside] == [("c", "p-offers")]


def test_vector_ids_round_trip(spark):
    made = spark.range(1).select(VX.vector_id(F.lit("heading-aware"), F.lit("text-embedding-3-small"), F.lit("payback-period:1")).alias("v"))
    r = made.select("v", VX.chunk_id_of(F.col("v")).alias("c"), VX.chunk_id_of(F.lit("bare:1")).alias("d")).first()
    assert (r.v, r.c, r.d) == ("heading-aware:text-embedding-3-small:payback-period:1", "payback-period:1", "bare:1")


@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest_matches_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6)).round(1)
    v[10:20] = v[3]  # ties
    v[30] = 0
    q = rng.normal(size=(45, 6)).round(1)
    spaces = [None, "a", "b"]
    vectors = spark.createDataFrame([(i, v[i].tolist(), spaces[i % 3]) for i in range(90)], "vector_id int, values array<double>, ns string")
    queries = spark.createDataFrame([(i, q[i].tolist(), spaces[i % 3]) for i in range(45)], "query_id int, values array<double>, ns string")
    got = {}
    found = V.nearest(vectors, queries, 4, namespace="ns", query_namespace="ns", broadcast=broadcast)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vector_id)
    for i in range(45):
        scored = []
        for j in range(i % 3, 90, 3):
            size = np.linalg.norm(v[j]) * np.linalg.norm(q[i])
            score = float(v[j] @ q[i] / size) if size else 0.0
            if score > 0:
                scored.append((-round(score, 9), j))
        assert got.get(i, []) == [j for _, j in sorted(scored)[:4]]


def test_unequal_lengths_are_an_error(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vector_id int, values array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, values array<double>")
    with pytest.raises(Exception, match="differ in length"):
        V.nearest(a, q, 1).collect()
    with pytest.raises(Exception, match="differ in length"):
        spark.range(1).select(VX.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


class Indicator:
    embedding_id = "indicator"
    words = (("upsell",), ("payback", "acquisition"), ("continuity",), ("gross profit", "first sale"))

    def embed_texts(self, texts):
        return [[float(any(w in t.lower() for w in group)) for group in self.words] for t in texts]


def test_hybrid_and_vector_search_with_indicator_vectors(spark):
    chunks = spark.createDataFrame(
        [("payback-period:0", "payback period and customer acquisition cost", ["unit-economics"]), ("upsells:0", "upsell after the first sale for gross profit", ["upsells"]), ("continuity:0", "continuity keeps members", ["continuity"])],
        "chunk_id string, text string, subjects array<string>",
    )
    asked = spark.createDataFrame([(1, "upsell after first sale gross profit")], "query_id int, query string")
    vectors = V.embed(chunks, Indicator()).withColumnRenamed("chunk_id", "vector_id")
    lexical = L.search(chunks, asked, 15)
    dense = V.nearest(vectors, V.embed(asked, Indicator(), text="query"), 15).withColumnRenamed("vector_id", "chunk_id")
    fused = [r.chunk_id for r in R.hybrid_search(lexical, dense, 3).orderBy("rank").collect()]
    assert fused[0] == "upsells:0"
    assert len(set(fused)) == len(fused)
    q = spark.createDataFrame([(2, "customer acquisition payback")], "query_id int, query string")
    hits = V.nearest(vectors, V.embed(q, Indicator(), text="query"), 5).withColumnRenamed("vector_id", "chunk_id")
    wanted = spark.createDataFrame([(2, ["unit-economics"])], "query_id int, wanted array<string>")
    assert [r.chunk_id for r in V.best_per_chunk(hits, chunks, 5, wanted).collect()] == ["payback-period:0"]


def ranked(spark, *lists):
    rows = [(1, c, i + 1, s) for s, ids in enumerate(lists) for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, source int")


def test_multi_query_fusion_prefers_the_shared_chunk(spark):
    got = [r.chunk_id for r in R.fuse(ranked(spark, ["a:0", "shared:0"], ["b:0", "shared:0"]), 2).orderBy("rank").collect()]
    assert got[0] == "shared:0"
    assert got[1] == "a:0"


def test_fusion_tie_rules(spark):
    lists = ranked(spark, ["a", "b", "c", "d"], ["x", "y", "a"])
    seen = [r.chunk_id for r in R.fuse(lists, 4).orderBy("rank").collect()]
    assert seen == ["a", "x", "b", "y"]
    swap = ranked(spark, ["a", "b"], ["b", "a"])
    assert [r.chunk_id for r in R.fuse(swap, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.chunk_id for r in R.fuse_by_rank(swap, 2).orderBy("rank").collect()] == ["a", "b"]
    anchored = [r.chunk_id for r in R.fuse_with_anchor(lists, 3).orderBy("rank").collect()]
    assert anchored == ["a", "x", "b"]
    assert [r.chunk_id for r in R.fuse_with_anchor(lists, 1).orderBy("rank").collect()] == ["a"]


def test_percentiles_match_their_definitions(spark):
    rng = random.Random(2)
    data = [("a", rng.choice([1.0, 2.5, rng.random() * 1000, -3.0])) for _ in range(501)] + [("b", 4.0)] + [(None, float(i)) for i in range(1, 8)] + [("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    specs = {"lin": ("linear", 0.95), "mid": ("linear", 0.5), "rnd": ("rounded", 0.5), "exc": ("exclusive", 19)}
    got = {r.g: r for r in quantiles(df, ["g"], "v", specs).collect()}
    assert set(got) == {"a", "b", None}
    for g in ("a", None):
        values = sorted(v for k, v in data if k == g and v is not None)
        assert got[g].lin == pytest.approx(np.quantile(values, 0.95))
        assert got[g].mid == pytest.approx(statistics.median(values))
        assert got[g].rnd == values[round((len(values) - 1) * 0.5)]
        assert got[g].exc == pytest.approx(statistics.quantiles(values, n=20)[18])
    assert (got["b"].lin, got["b"].exc) == (4.0, 4.0)


def test_percentiles_split_large_bins(spark, monkeypatch):
    from quillrank.operators import quantiles as module

    monkeypatch.setattr(module, "MOST", 16)
    monkeypatch.setattr(module, "SPLITS", 8)
    rng = random.Random(4)
    values = {
        "times": [1.7e9 + rng.randrange(20_000) / 8 for _ in range(3000)], "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(500)],
        "close": [1 + i * 2**-52 for i in range(700)], "huge": [(-1) ** i * (1.7e308 - i * 1e292) for i in range(100)], None: [5.0] * 50 + [5.5],
    }
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(5)
    found = {r.g: r for r in quantiles(df, ["g"], "v", {"mid": ("rounded", 0.5), "low": ("rounded", 0.01), "top": ("rounded", 0.97)}).collect()}
    assert set(found) == set(values)
    for g, vs in values.items():
        vs = sorted(vs)
        for name, q in (("mid", 0.5), ("low", 0.01), ("top", 0.97)):
            assert found[g][name] == vs[round((len(vs) - 1) * q)]
    assert quantiles(df.where("false"), ["g"], "v", {"mid": ("rounded", 0.5)}).count() == 0


def test_cluster_bounds_skip_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = np.concatenate([c + 0.05 * rng.normal(size=(50, 16)) for c in centres] + [np.zeros((3, 16))])
    rows[7] = rows[8]
    unit = V._unit(V.pa.array(rows.tolist()))
    order, sizes, middle, reach = V.clustered(unit)
    assert sorted(order.tolist()) == list(range(len(rows))) and sizes.sum() == len(rows)
    queries = V._unit(V.pa.array(np.concatenate([centres[:10], -centres[:2], rows[7:9], np.zeros((1, 16))]).tolist()))
    search = V._Search(5)
    pair = {
        "v_dim": 16, "q_dim": 16, "v_space": None, "q_at": 0, "v_block": unit[order].tobytes(), "q_block": queries.tobytes(),
        "v_centres": middle.tobytes(), "v_sizes": sizes.tolist(), "v_reach": reach.tolist(),
    }
    q, v, score = search.take(pair)
    assert search.scored < 0.3 * search.clusters
    exact = queries @ unit.T
    for i in range(len(queries)):
        want = sorted((-round(s, 9), j) for j, s in enumerate(exact[i]) if s > 0)[:5]
        got = sorted((-round(s, 9), int(order[j])) for j, s in zip(v[q == i], score[q == i], strict=True))[:5]
        assert got == want


def test_embedding_cache_counts(spark, tmp_path):
    provider, path = Indicator(), str(tmp_path / "cache")
    schema = "key string, model string, embedding array<double>"
    spark.createDataFrame([], schema).write.parquet(path)

    def call(purpose, number, texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        looked = SV.lookup(df, spark.read.parquet(path), provider.embedding_id).select(
            F.lit(purpose).alias("purpose"), F.lit("m").alias("model"), F.lit(number).alias("call_id"), "text", "hit"
        )
        rows = spark.createDataFrame(looked.collect(), looked.schema)
        SV.fill_cache(df, spark.read.parquet(path), provider, path)
        return rows

    log = call("corpus", 1, ["alpha", "beta"]).unionByName(call("query", 2, ["alpha"])).unionByName(call("corpus", 3, ["alpha", "beta"]))
    got = {r.purpose: r for r in V.embedding_usage(log, {"m": 1.0}).collect()}
    assert (got["corpus"].cache_misses, got["corpus"].cache_hits, got["corpus"].api_batches) == (2, 2, 1)
    assert (got["query"].cache_hits, got["query"].cache_misses, got["query"].cache_hit_rate) == (1, 0, 1.0)
    assert got["corpus"].api_tokens == (len("alphabeta") + 3) // 4
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_and_null_keys_take_the_last_line(spark, parts):
    def lines(rows, schema):
        """Rows with their line numbers, dealt out so that no partition keeps their order."""
        made = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", line_number int")
        return made.repartition(parts, F.col("line_number") * 7919 % 13)

    base = lines([(1, "x"), (1, "y"), (3, "k"), (None, "n")], "k int, v string")
    newer = lines([(2, "p"), (2, "q"), (None, "m")] + [(5, str(i)) for i in range(100)], "k int, v string")
    found = J.upsert(base, newer, ["k"], "line_number").collect()
    assert {(r.k, r.v) for r in found} == {(1, "y"), (2, "q"), (3, "k"), (None, "m"), (5, "99")}
    results = spark.createDataFrame([("s", 1, 1), ("s", None, 2), (None, 1, 3)], "strategy string, case_id int, chunk_id int")
    placed = [("s", 1, 1, i % 2 == 1) for i in range(101)] + [("s", None, 2, False), ("s", None, 2, True), (None, 1, 3, True)]
    labels = lines(placed, "strategy string, case_id int, chunk_id int, useful boolean")
    none = labels.where("false")
    done = {r.chunk_id: (r.useful, r.label_source) for r in J.adjudicate(results, labels, labels, none.drop("strategy")).collect()}
    assert done == {1: (False, "semantic_adjudication"), 2: (True, "semantic_adjudication"), 3: (True, "semantic_adjudication")}
    assert {r.useful for r in J.adjudicate(results, labels, none, none).collect()} == {False, True}
    novel = J.novel_pairs(results.where("false"), results, labels, none).collect()
    assert {(r.chunk_id, r.reviewed, r.false_negative_fixed) for r in novel} == {(1, True, False), (2, True, True), (3, True, True)}


def test_cache_with_a_repeated_key(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    cache = texts.where("id = 1").select(SV.cache_key(F.lit("e"), F.col("text")).alias("key"), F.array(F.lit(1.0)).alias("embedding"))
    found = SV.lookup(texts, cache.unionByName(cache), "e").orderBy("id").collect()
    assert [(r.id, r.hit) for r in found] == [(1, True), (2, False)]


def test_namespaces_keep_their_names(spark, tmp_path):
    names = [None, "default", "__default__", "01", "1"]
    rows = spark.createDataFrame([(str(i), [1.0], n) for i, n in enumerate(names)], "id string, values array<double>, namespace string")
    SV.write_vectors(rows, str(tmp_path / "v"))
    assert sorted((r.id, str(r.namespace)) for r in SV.read_vectors(spark, str(tmp_path / "v")).collect()) == [(str(i), str(n)) for i, n in enumerate(names)]
    assert [r.id for r in SV.read_vectors(spark, str(tmp_path / "v"), ["01", None]).orderBy("id").collect()] == ["0", "3"]


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", [1.0], None, 0), ("a", [1.0], "n", 0)], "id string, values array<double>, namespace string, seq int")
    new = spark.createDataFrame([("a", [2.0], None, 1), ("a", [3.0], None, 2), ("b", [4.0], None, 1)], old.schema)
    got = {(r.namespace, r.id): r["values"] for r in SV.upsert_vectors(old, new).collect()}
    assert got == {(None, "a"): [3.0], ("n", "a"): [1.0], (None, "b"): [4.0]}


def test_merge_leaves_other_namespaces_alone(spark, tmp_path):
    path, kind = str(tmp_path / "v"), "id string, values array<double>, namespace string, seq int"
    SV.write_vectors(spark.createDataFrame([("a", [1.0], None, 0), ("a", [1.0], "n", 0), ("c", [9.0], "n", 0), ("a", [7.0], "01", 0)], kind), path)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "v" / "rows").rglob("*.parquet")}
    for batch in ([("a", [2.0], "n", 1), ("a", [3.0], "n", 2), ("b", [4.0], "new", 1)], [("b", [5.0], "new", 2)], []):
        SV.merge_vectors(spark, path, spark.createDataFrame(batch, kind))
    got = {(r.namespace, r.id): r["values"] for r in SV.read_vectors(spark, path).collect()}
    assert got == {(None, "a"): [1.0], ("n", "a"): [3.0], ("n", "c"): [9.0], ("01", "a"): [7.0], ("new", "b"): [5.0]}
    now = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "v" / "rows").rglob("*.parquet")}
    assert files.items() <= now.items()
    made = {f.split("/rows/")[1].rsplit("/", 1)[0] for f in now.keys() - files.keys()}
    assert made == {"generation=2/space=nn", "generation=2/space=nnew", "generation=3/space=nnew"}
    # Rows of a writer that was lost before it named them are not read, also when its number is used again.
    lost = spark.createDataFrame([("z", [0.0], "01", 9)], kind).withColumn("space", F.lit("n01")).withColumn("generation", F.lit(4)).drop("namespace")
    lost.write.mode("append").partitionBy("generation", "space").parquet(f"{path}/rows")
    SV.merge_vectors(spark, path, spark.createDataFrame([("d", [6.0], None, 1)], kind))
    assert [(r.id, r["values"]) for r in SV.read_vectors(spark, path, ["01"]).collect()] == [("a", [7.0])]
    assert sorted(r.id for r in SV.read_vectors(spark, path, [None]).collect()) == ["a", "d"]


def test_hashing_provider_in_the_row(spark):
    import hashlib
    import re
    from collections import Counter

    texts = ["", None, "One one two-three, 4!", "x " * 5000 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = V.embed(rows, V.HashingProvider(7))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        want = [0.0] * 7
        for token, times in Counter(re.findall("[a-z0-9][a-z0-9-]*", (r.text or "").lower())).items():
            want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 7] += times
        assert r["values"] == want
