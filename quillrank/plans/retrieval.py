"""Queries on lexical search, vectors, rank fusion and retrieval policies.

Stand-ins: benchmark texts are the queries, documents the chunks, and a document's lang and
source its subjects. Vector queries are the mean vectors per label; a label is a namespace.
Dense lists for fusion come from the hashing provider.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank.functions import vectors as VX
from quillrank.operators import fusion as R
from quillrank.operators import knn as V
from quillrank.operators import lexical as L
from quillrank.plans.registry import query, sql_tokens, table
from quillrank.plans.text import sql_windows
from quillrank.session import scratch, stored
from quillrank.sources import vectors as SV

DIMS = 32


# --- lexical ---------------------------------------------------------------

def sql_bm25(
    k: int, queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark",
    docs: str = "SELECT doc_id AS chunk_id, text FROM documents", k1: float = 1.5, b: float = 0.75,
    name: str = "lex", keep: str = "TRUE",
) -> str:
    """CTEs ending in `name`(query_id, chunk_id, score, rank)."""
    n = name
    return f"""
    {n}_t AS (SELECT chunk_id, {sql_tokens('text')} AS t FROM ({docs})),
    {n}_tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM {n}_t) GROUP BY ALL),
    {n}_len AS (SELECT chunk_id, len(t) AS n FROM {n}_t),
    {n}_c AS (SELECT count(*) AS total, avg(n) AS avg_len FROM {n}_len),
    {n}_df AS (SELECT term, count(*) AS df FROM {n}_tf GROUP BY term),
    {n}_q AS (SELECT query_id, term, count(*) AS w FROM (SELECT query_id, unnest({sql_tokens('query')}) AS term FROM ({queries})) GROUP BY ALL),
    {n}_s AS (
      SELECT q.query_id, p.chunk_id, sum(w * ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1)
             / (tf + {k1} * (1 - {b} + {b} * l.n / greatest(1.0, avg_len)))) AS score
      FROM {n}_q q JOIN {n}_tf p USING (term) JOIN {n}_df d USING (term) JOIN {n}_len l USING (chunk_id), {n}_c
      GROUP BY q.query_id, p.chunk_id),
    {n} AS (SELECT query_id, chunk_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
            FROM {n}_s WHERE score > 0 AND {keep} QUALIFY rank <= {k})"""


def docs(spark, sf):
    return table(spark, sf, "documents")


def bench(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25(spark, sf, k=5, **more):
    return L.search(docs(spark, sf), bench(spark, sf), k, chunk_id="doc_id", **more)


TOP = "query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank"


def shown(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("L1_postings", f"""
    SELECT doc_id AS chunk_id, count(DISTINCT term)::BIGINT AS terms, max(tf)::BIGINT AS max_tf, sum(tf)::BIGINT AS tokens
    FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL)
    GROUP BY doc_id""")
def l1(spark, sf):
    return L.postings(docs(spark, sf), "doc_id").groupBy("chunk_id").agg(
        F.count("*").alias("terms"), F.max("tf").alias("max_tf"), F.sum("tf").alias("tokens")
    )


@query("L2_corpus_statistics", f"""
    WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)
    SELECT term, count(*)::BIGINT AS df, (SELECT count(*) FROM t)::BIGINT AS n_chunks,
           round((SELECT avg(len(t)) FROM t), 6) AS avg_len
    FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM t) GROUP BY term""")
def l2(spark, sf):
    return L.term_statistics(L.index_rows(docs(spark, sf), "doc_id")).select(
        "term", "df", "n_chunks", F.round("avg_len", 6).alias("avg_len")
    )


@query("L3_bm25_scores", f"WITH {sql_bm25(1 << 30)} SELECT query_id, chunk_id, round(score, 6) AS score FROM lex")
def l3(spark, sf):
    terms = L.query_terms(bench(spark, sf))
    index = L.index_rows(docs(spark, sf), "doc_id", vocabulary=terms)
    return L.score(index, terms).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


WANTED = "CASE length(text) % 3 WHEN 0 THEN ['fr', 'src3'] WHEN 1 THEN ['en'] ELSE [] END"


@query("L4_subject_filter", f"""
    WITH {sql_bm25(5, keep='''(SELECT len(w) = 0 OR list_has_any(w, s) FROM (SELECT ''' + WANTED + ''' AS w FROM benchmark WHERE item_id = query_id),
        (SELECT [lang, source] AS s FROM documents WHERE doc_id = chunk_id))''')}
    SELECT {TOP} FROM lex""")
def l4(spark, sf):
    d = docs(spark, sf).withColumn("subjects", F.array("lang", "source"))
    third = F.length("query") % 3
    q = bench(spark, sf).withColumn(
        "wanted",
        F.when(third == 0, F.array(F.lit("fr"), F.lit("src3"))).when(third == 1, F.array(F.lit("en")))
        .otherwise(F.array().cast("array<string>")),
    )
    return shown(L.search(d, q, 5, chunk_id="doc_id", subjects="subjects", query_subjects="wanted"))


@query("L5_bm25_topk", f"WITH {sql_bm25(5)} SELECT {TOP} FROM lex")
def l5(spark, sf):
    return shown(bm25(spark, sf))


CHUNK_DOCS = "SELECT id || ':' || i AS chunk_id, body AS text FROM win"


@query("L5_bm25_topk_chunks", f"""
    WITH {sql_windows('SELECT doc_id AS id, text FROM documents', 650, 90)}, {sql_bm25(5, docs=CHUNK_DOCS)} SELECT {TOP} FROM lex""")
def l5_chunks(spark, sf):
    """Framework-aware chunks; these documents hold no headings or cues, so windows."""
    from quillrank.operators.chunking import chunk_documents

    chunks = chunk_documents(docs(spark, sf), K.DEFAULT_STRATEGY, chapter="doc_id")
    return shown(L.search(chunks, bench(spark, sf), 5))


@query("L5_bm25_from_stored_index", f"WITH {sql_bm25(5)} SELECT {TOP} FROM lex")
def l5_stored(spark, sf):
    """The whole index is written once by parts of its terms, then queried."""
    return l5_search(spark, sf, l5_build(spark, sf))


def l5_build(spark, sf):
    path = scratch(spark, "index")
    L.write_index(docs(spark, sf), path, "doc_id", part_postings=20_000)
    return path


def l5_search(spark, sf, path):
    return shown(L.search_index(spark, path, bench(spark, sf), 5))


FEW = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id < 3"


@query("L5_index_few_queries", f"WITH {sql_bm25(5, FEW)} SELECT {TOP} FROM lex")
def l5_few(spark, sf):
    """A few queries against an index of the whole table: most parts are not read."""
    path = l5_build(spark, sf)
    return shown(L.search_index(spark, path, bench(spark, sf).where("query_id < 3"), 5))


@query("L6_smoke", f"""
    WITH {sql_bm25(5)}
    SELECT item_id AS query_id, coalesce(bool_or(source = 'src' || (item_id % 20)), FALSE) AS passed
    FROM benchmark LEFT JOIN lex ON query_id = item_id LEFT JOIN documents ON doc_id = chunk_id GROUP BY item_id""")
def l6(spark, sf):
    found = bm25(spark, sf).join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("chapter")), "chunk_id")
    expected = bench(spark, sf).select(
        "query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("chapter")
    )
    return L.smoke(found, expected)


# --- vectors ---------------------------------------------------------------

def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("vector_id"), F.col("embedding").cast("array<double>").alias("values"), "label"
    )


def centroids(spark, sf):
    """(query_id, values): mean vector per label; as long as the vectors, one row per label."""
    parts = vectors(spark, sf).select("label", F.posexplode("values").alias("at", "x"))
    means = parts.groupBy("label", "at").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("p")).select(
        F.col("label").alias("query_id"), F.transform("p", lambda p: p["x"]).alias("values")
    )


SQL_CENTROIDS = """
    vec AS (SELECT vec_id AS vector_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    cent AS (SELECT label AS query_id, list(x ORDER BY i) AS c FROM (
               SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY ALL) GROUP BY label)"""


def sql_knn(k: int, space: str = "label = query_id", keep: str = "TRUE") -> str:
    return f"""{SQL_CENTROIDS},
    sims AS (SELECT query_id, label, vector_id, list_cosine_similarity(v, c) AS score FROM cent JOIN vec ON {space} WHERE {keep}),
    knn AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, vector_id) AS rank
            FROM sims WHERE score > 0 QUALIFY rank <= {k})"""


def whole_space(sql: str) -> str:
    return sql.replace("PARTITION BY query_id, label", "PARTITION BY query_id")


@query("V1_cosine", """
    SELECT a.vec_id, round(coalesce(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 0), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def v1(spark, sf):
    a = vectors(spark, sf)
    b = a.select((F.col("vector_id") - 1).alias("vector_id"), F.col("values").alias("other"))
    return a.join(b, "vector_id").select(
        F.col("vector_id").alias("vec_id"), F.round(VX.cosine(F.col("values"), F.col("other")), 6).alias("score")
    )


def out_knn(df):
    return df.select("query_id", F.col("vector_id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


KNN_OUT = "query_id, vector_id AS vec_id, round(score, 6) AS score, rank::INTEGER AS rank"


@query("V2_knn_namespace", f"WITH {sql_knn(5)} SELECT {KNN_OUT} FROM knn")
def v2(spark, sf):
    return out_knn(V.nearest(vectors(spark, sf), centroids(spark, sf), 5, namespace="label", query_namespace="query_id"))


@query("V2_knn_whole_table", f"WITH {whole_space(sql_knn(5, 'TRUE'))} SELECT {KNN_OUT} FROM knn")
def v2_all(spark, sf):
    return out_knn(V.nearest(vectors(spark, sf), centroids(spark, sf), 5))


@query("V2_knn_block_join", f"WITH {whole_space(sql_knn(5, 'TRUE'))} SELECT {KNN_OUT} FROM knn")
def v2_blocks(spark, sf):
    """The join for query tables whose blocks are too large to broadcast."""
    return out_knn(V.nearest(vectors(spark, sf), centroids(spark, sf), 5, broadcast=False))


@query("V3_metadata_filter", f"WITH {whole_space(sql_knn(5, 'TRUE', '(label IN (1, 3, 5) OR label % 2 = 0) AND label <> 4'))} SELECT {KNN_OUT} FROM knn")
def v3(spark, sf):
    tagged = vectors(spark, sf).withColumn(
        "subjects", F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    ).withColumn("listed", F.col("label") != 4)
    keep = VX.metadata_predicate({"subjects": {"$in": ["l1", "l3", "l5", "even"]}, "listed": True}, {"subjects"})
    return out_knn(V.nearest(tagged.where(keep), centroids(spark, sf), 5))


@query("V4_multi_namespace", f"""
    WITH {sql_knn(5, '(label = query_id OR label = (query_id + 1) % 10)')},
    sized AS (SELECT query_id, label, vector_id, score, rank AS r, CASE WHEN label = query_id THEN 0 ELSE 1 END AS pos0 FROM knn)
    SELECT query_id, vector_id AS vec_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos0, r)::INTEGER AS rank
    FROM sized QUALIFY rank <= 10""")
def v4(spark, sf):
    cents = centroids(spark, sf)
    spaces = cents.select("query_id", F.posexplode(F.array(F.col("query_id"), (F.col("query_id") + 1) % 10)).alias("position", "namespace"))
    spaces = spaces.withColumn("namespace", F.col("namespace").cast("string"))
    asked = cents.join(spaces, "query_id")
    hits = V.nearest(vectors(spark, sf), asked, 5, namespace="label", query_namespace="namespace")
    return out_knn(V.merge_namespaces(hits, spaces, 5))


@query("V5_best_per_chunk", f"""
    WITH {sql_knn(25, 'TRUE').replace('PARTITION BY query_id, label', 'PARTITION BY query_id')},
    best AS (SELECT query_id, vector_id // 3 AS chunk_id, max(score) AS score FROM knn GROUP BY ALL),
    kept AS (SELECT b.* FROM best b JOIN documents d ON d.doc_id = b.chunk_id WHERE query_id % 2 = 0 OR d.lang IN ('en', 'fr'))
    SELECT query_id, chunk_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank
    FROM kept QUALIFY rank <= 5""")
def v5(spark, sf):
    hits = V.nearest(vectors(spark, sf), centroids(spark, sf), 25).withColumn("chunk_id", F.floor(F.col("vector_id") / 3))
    chunks = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), F.array("lang").alias("subjects"))
    wanted = centroids(spark, sf).select(
        "query_id", F.when(F.col("query_id") % 2 == 1, F.array(F.lit("en"), F.lit("fr"))).alias("wanted")
    )
    return shown(V.best_per_chunk(hits, chunks, 5, wanted))


@query("V6_vector_id", """
    SELECT doc_id, 'heading-aware:org_model:' || source || ':' || doc_id AS vector_id, source || ':' || doc_id AS chunk_id FROM documents""")
def v6(spark, sf):
    made = docs(spark, sf).withColumn(
        "vector_id",
        VX.vector_id(F.lit("heading-aware"), F.lit("org/model"), F.concat_ws(":", "source", F.col("doc_id").cast("string"))),
    )
    return made.select("doc_id", "vector_id", VX.chunk_id_of(F.col("vector_id")).alias("chunk_id"))


def sql_hashed(name: str, rows: str) -> str:
    """CTE name(id, bucket, x): token counts per hashed bucket over rows(id, text)."""
    return f"""{name} AS (SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIMS} AS bucket, count(*)::DOUBLE AS x
    FROM (SELECT id, unnest({sql_tokens('text')}) AS term FROM ({rows})) GROUP BY ALL)"""


@query("V7_batched_embedding", f"""
    WITH {sql_hashed('h', 'SELECT doc_id AS id, text FROM documents')}
    SELECT doc_id, {DIMS} AS dims, coalesce(sum(x), 0.0)::DOUBLE AS total, coalesce(sum(x * (bucket + 1)), 0.0)::DOUBLE AS weighted
    FROM documents LEFT JOIN h ON id = doc_id GROUP BY doc_id""")
def v7(spark, sf):
    made = V.embed(docs(spark, sf).select("doc_id", "text"), V.HashingProvider(DIMS))
    return made.select(
        "doc_id", F.size("values").alias("dims"),
        F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("weighted"),
    )


def cached(spark, sf):
    """Cache rows for the labelled documents' texts."""
    texts = docs(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    keys = texts.select(SV.cache_key(F.lit("hashing:32"), F.col("text")).alias("key")).distinct()
    return keys.withColumn("embedding", F.array(F.lit(0.0)))


@query("V8_embedding_usage", """
    WITH known AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id)),
    l AS (SELECT lang, source, length(d.text) AS n, k.text IS NOT NULL AS hit FROM documents d LEFT JOIN known k ON k.text = d.text),
    c AS (SELECT lang, source, count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m, sum(n) AS chars, coalesce(sum(n) FILTER (NOT hit), 0) AS sent FROM l GROUP BY ALL)
    SELECT lang AS purpose, sum(h)::BIGINT AS cache_hits, sum(m)::BIGINT AS cache_misses, sum(ceil(m / 64.0))::BIGINT AS api_batches,
           sum(chars)::BIGINT AS input_chars, sum(sent)::BIGINT AS api_input_chars, round(sum(h) / (sum(h) + sum(m)), 6) AS cache_hit_rate,
           ((sum(sent) + 3) // 4)::BIGINT AS api_tokens, round(((sum(sent) + 3) // 4) * 20.0 / 1e6, 6) AS cost_usd
    FROM c GROUP BY lang""")
def v8(spark, sf):
    looked = SV.lookup(docs(spark, sf), cached(spark, sf), "hashing:32").select(
        F.col("lang").alias("purpose"), F.lit("hashing:32").alias("model"), F.col("source").alias("call_id"), "text", "hit"
    )
    return V.embedding_usage(looked, {"hashing:32": 20.0}).select(
        "purpose", "cache_hits", "cache_misses", "api_batches", "input_chars", "api_input_chars",
        F.round("cache_hit_rate", 6).alias("cache_hit_rate"), "api_tokens", F.round("cost_usd", 6).alias("cost_usd"),
    )


class KeywordProvider:
    """Indicator of four words, the kind of provider a caller may plug in."""

    embedding_id = "keywords"
    words = ("the", "de", "of", "la")

    def embed_texts(self, texts):
        return [[float(w in t.lower()) for w in self.words] for t in texts]


@query("P1_custom_provider", """
    SELECT conv_id, turn, contains(lower(text), 'the')::INT::DOUBLE AS f0, contains(lower(text), 'de')::INT::DOUBLE AS f1,
           contains(lower(text), 'of')::INT::DOUBLE AS f2, contains(lower(text), 'la')::INT::DOUBLE AS f3 FROM conversations""")
def p1(spark, sf):
    made = V.embed(table(spark, sf, "conversations"), KeywordProvider())
    return made.select("conv_id", "turn", *[F.col("values")[i].alias(f"f{i}") for i in range(4)])


@query("S6_vector_upsert", """
    WITH rec AS (SELECT vec_id, label, embedding[1]::DOUBLE * CASE WHEN label IN (2, 5) THEN 2 ELSE 1 END AS x FROM embeddings),
    spread AS (SELECT NULL AS namespace, x FROM rec UNION ALL SELECT 'corpus-l' || label, x FROM rec
               UNION ALL SELECT CASE WHEN label < 5 THEN 'corpus-low' ELSE 'corpus-high' END, x FROM rec)
    SELECT coalesce(namespace, 'default') AS namespace, count(*)::BIGINT AS records, round(sum(x), 6) AS total FROM spread GROUP BY 1""")
def s6(spark, sf):
    base = vectors(spark, sf).select(
        F.col("vector_id").alias("id"), "values",
        F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.when(F.col("label") < 5, "low").otherwise("high")).alias("subjects"),
        F.lit(0).alias("seq"), "label",
    )
    newer = base.where(F.col("label").isin(2, 5)).withColumn("seq", F.lit(1)).withColumn(
        "values", F.transform("values", lambda x: x * 2)
    )
    stored = SV.last_records(SV.fan_out(base))
    path = scratch(spark, "vectors")
    SV.write_vectors(stored, path)
    SV.merge_vectors(spark, path, SV.fan_out(newer))
    return SV.read_vectors(spark, path).groupBy(F.coalesce("namespace", F.lit("default")).alias("namespace")).agg(
        F.count("*").alias("records"), F.round(F.sum(F.col("values")[0]), 6).alias("total")
    )


@query("S7_embedding_cache", """
    WITH known AS (SELECT DISTINCT sha256('hashing:32' || chr(10) || text) AS key FROM documents JOIN labels USING (doc_id)),
    asked AS (SELECT doc_id, sha256('hashing:32' || chr(10) || text) AS key FROM documents)
    SELECT doc_id, a.key, k.key IS NOT NULL AS hit,
           k.key IS NULL AND row_number() OVER (PARTITION BY a.key ORDER BY doc_id) = 1 AS sent FROM asked a LEFT JOIN known k USING (key)""")
def s7(spark, sf):
    """Look up every document, append what is missing, and mark who was sent first."""
    provider, path = V.HashingProvider(DIMS), scratch(spark, "cache")
    cached(spark, sf).select("key", F.lit(provider.embedding_id).alias("model"), "embedding").write.parquet(path)
    before = spark.read.parquet(path).select("key", F.lit(True).alias("_old"))
    looked = SV.lookup(docs(spark, sf).select("doc_id", "text"), spark.read.parquet(path), provider.embedding_id)
    SV.fill_cache(docs(spark, sf), spark.read.parquet(path), provider, path)
    added = spark.read.parquet(path).select("key").join(before, "key", "left_anti").withColumn("_new", F.lit(True))
    first = looked.groupBy("key").agg(F.min("doc_id").alias("_first"))
    return looked.join(added, "key", "left").join(first, "key").select(
        "doc_id", "key", "hit", (F.coalesce("_new", F.lit(False)) & (F.col("doc_id") == F.col("_first"))).alias("sent")
    )


# --- fusion ----------------------------------------------------------------

def dense(spark, sf, k):
    provider = V.HashingProvider(DIMS)
    d = V.embed(docs(spark, sf).select(F.col("doc_id").alias("vector_id"), "text"), provider)
    q = V.embed(bench(spark, sf), provider, text="query")
    return V.nearest(d, q, k).withColumnRenamed("vector_id", "chunk_id")


def sql_dense(k: int) -> str:
    return f"""
    {sql_hashed('hd', 'SELECT doc_id AS id, text FROM documents')},
    {sql_hashed('hq', 'SELECT item_id AS id, text FROM benchmark')},
    nd AS (SELECT id, sqrt(sum(x * x)) AS n FROM hd GROUP BY id), nq AS (SELECT id, sqrt(sum(x * x)) AS n FROM hq GROUP BY id),
    ds AS (SELECT hq.id AS query_id, hd.id AS chunk_id, sum(hq.x * hd.x) / any_value(nq.n * nd.n) AS score
           FROM hq JOIN hd USING (bucket) JOIN nq ON nq.id = hq.id JOIN nd ON nd.id = hd.id GROUP BY ALL),
    den AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
            FROM ds WHERE score > 0 QUALIFY rank <= {k})"""


def sql_fused(order: str, k: int) -> str:
    return f"""
    WITH {sql_bm25(25)}, {sql_dense(25)},
    lists AS (SELECT query_id, chunk_id, rank, 0 AS source FROM lex UNION ALL SELECT query_id, chunk_id, rank, 1 FROM den),
    fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(source) AS s, arg_min(rank, source) AS r
              FROM lists GROUP BY ALL),
    top AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, {order}) AS rank
            FROM fused QUALIFY rank <= {k})"""


def lists(spark, sf):
    return stored(R.stack(bm25(spark, sf, 25), dense(spark, sf, 25)), "lists")


@query("F1_hybrid_rrf", f"{sql_fused('s, r', 5)} SELECT {TOP} FROM top")
def f1(spark, sf):
    return shown(R.hybrid_search(bm25(spark, sf, 25), dense(spark, sf, 25), 5))


@query("F2_rrf_by_rank", f"{sql_fused('r, s, chunk_id', 5)} SELECT {TOP} FROM top")
def f2(spark, sf):
    return shown(R.fuse_by_rank(lists(spark, sf), 5))


@query("F3_lexical_anchor", f"""{sql_fused('r, s, chunk_id', 4)},
    both_ AS (SELECT query_id, chunk_id, rank AS o FROM top UNION ALL
              SELECT query_id, chunk_id, rank + 1000000 FROM lex WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = lex.query_id AND t.chunk_id = lex.chunk_id))
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY o)::INTEGER AS rank FROM both_ QUALIFY rank <= 5""")
def f3(spark, sf):
    return R.fuse_with_anchor(lists(spark, sf), 5).select("query_id", "chunk_id", "rank")


VARIANTS_SQL = """SELECT item_id * 10 + v AS query_id,
    CASE v WHEN 0 THEN text WHEN 1 THEN left(text, length(text) // 2) ELSE right(text, length(text) - length(text) // 2) END AS query
    FROM benchmark, (SELECT unnest([0, 1, 2]) AS v)"""


def variants(spark, sf):
    """Three queries per case: the whole text and its two halves."""
    half = F.floor(F.length("query") / 2).cast("int")
    texts = F.array(
        F.col("query"), F.substring(F.col("query"), F.lit(1), half), F.substring(F.col("query"), half + 1, F.length("query"))
    )
    return bench(spark, sf).select("query_id", F.posexplode(texts).alias("v", "text")).select(
        (F.col("query_id") * 10 + F.col("v")).alias("query_id"), F.col("text").alias("query")
    )


def variant_results(spark, sf):
    found = L.search(docs(spark, sf), variants(spark, sf), 5, chunk_id="doc_id")
    return stored(
        found.select(
            F.floor(F.col("query_id") / 10).alias("case_id"), "chunk_id", "rank", (F.col("query_id") % 10).alias("source")
        ), "lists",
    )


FUSED_VARIANTS = f"""{sql_bm25(5, VARIANTS_SQL, name='var')},
    vl AS (SELECT query_id // 10 AS case_id, chunk_id, rank, query_id % 10 AS source FROM var)"""


@query("F4_multi_query_fusion", f"""
    WITH {FUSED_VARIANTS},
    fused AS (SELECT case_id, chunk_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(source) AS s, arg_min(rank, source) AS r FROM vl GROUP BY ALL)
    SELECT case_id, chunk_id, round(score, 6) AS score,
           row_number() OVER (PARTITION BY case_id ORDER BY round(score, 12) DESC, s, r)::INTEGER AS rank
    FROM fused QUALIFY rank <= 5""")
def f4(spark, sf):
    return R.fuse(variant_results(spark, sf), 5, keys=("case_id",)).select(
        "case_id", "chunk_id", F.round("score", 6).alias("score"), "rank"
    )


def method_ranks(spark, sf):
    """First rank of a document of quality 1 per case and query method."""
    found = variant_results(spark, sf)
    by_method = {
        "keyword_only": found.where(F.col("source") == 0), "variants_only": found.where(F.col("source") > 0), "both": found,
    }
    good = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("chunk_id"), F.lit(True).alias("good"))
    rows = None
    for name, part in by_method.items():
        top = R.fuse(part, 5, keys=("case_id",)).select(F.lit(name).alias("method"), "case_id", "chunk_id", "rank")
        rows = top if rows is None else rows.unionByName(top)
    return rows.join(good, "chunk_id", "left").groupBy("method", "case_id").agg(
        F.min(F.when(F.col("good"), F.col("rank"))).alias("first_rank")
    )


@query("F5_source_comparison", f"""
    WITH {FUSED_VARIANTS},
    m AS (SELECT 'keyword_only' AS method, * FROM vl WHERE source = 0 UNION ALL SELECT 'variants_only', * FROM vl WHERE source > 0 UNION ALL SELECT 'both', * FROM vl),
    fused AS (SELECT method, case_id, chunk_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, min(source) AS s, arg_min(rank, source) AS r FROM m GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY method, case_id ORDER BY round(score, 12) DESC, s, r) AS rank FROM fused QUALIFY rank <= 5),
    fr AS (SELECT case_id, min(rank) FILTER (method = 'keyword_only' AND quality = 1) AS k, min(rank) FILTER (method = 'variants_only' AND quality = 1) AS v,
                  min(rank) FILTER (method = 'both' AND quality = 1) AS b FROM top LEFT JOIN labels ON doc_id = chunk_id GROUP BY case_id)
    SELECT case_id, k::INTEGER AS keyword_only, v::INTEGER AS variants_only, b::INTEGER AS "both",
           CASE WHEN coalesce(b = 1, FALSE) AND NOT coalesce(v = 1, FALSE) THEN 'fusion_better' WHEN coalesce(v = 1, FALSE) AND NOT coalesce(b = 1, FALSE) THEN 'fusion_worse'
                WHEN v IS DISTINCT FROM b THEN 'rank_shift_same_hit1' ELSE 'same' END AS effect,
           coalesce(k = 1, FALSE) AND NOT coalesce(v = 1, FALSE) AS keyword_rescue, coalesce(v = 1, FALSE) AND NOT coalesce(k = 1, FALSE) AS variants_beat_keyword
    FROM fr""")
def f5(spark, sf):
    return R.compare_sources(method_ranks(spark, sf))


ASKS = """SELECT o_orderkey, CASE o_orderpriority
      WHEN '1-URGENT' THEN 'Cost is $' || floor(o_totalprice)::BIGINT || ' and churn rose. What metric should I watch?'
      WHEN '2-HIGH' THEN 'Our payback is 8 months, is that working well?'
      WHEN '3-MEDIUM' THEN 'What part of the money model pays at gross margin of 40%'
      ELSE 'How do refunds look after ' || o_orderkey || ' orders?' END AS q FROM orders"""


def asks(spark, sf):
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.concat(F.lit("Cost is $"), F.floor("o_totalprice").cast("string"), F.lit(" and churn rose. What metric should I watch?")))
        .when(p == "2-HIGH", "Our payback is 8 months, is that working well?")
        .when(p == "3-MEDIUM", "What part of the money model pays at gross margin of 40%")
        .otherwise(F.concat(F.lit("How do refunds look after "), F.col("o_orderkey").cast("string"), F.lit(" orders?")))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("q"))


@query("F6_routed_policy", f"""
    SELECT o_orderkey, regexp_matches(q, '(?i)(\\$[0-9]|[0-9][0-9,]*(\\.[0-9]+)?\\s*(%|/month|per month|months?))')
       AND regexp_matches(q, '{K.METRIC_WORDS.replace("(?iu)", "(?i)")}') AND regexp_matches(q, '{K.DIAGNOSTIC_ASK.replace("(?iu)", "(?i)")}') AS routed,
       CASE WHEN regexp_matches(q, '(?i)(\\$[0-9]|[0-9][0-9,]*(\\.[0-9]+)?\\s*(%|/month|per month|months?))')
       AND regexp_matches(q, '{K.METRIC_WORDS.replace("(?iu)", "(?i)")}') AND regexp_matches(q, '{K.DIAGNOSTIC_ASK.replace("(?iu)", "(?i)")}')
       THEN 2 WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS routed_rank FROM ({ASKS})""")
def f6(spark, sf):
    """Route texts that give numbers, a metric and a diagnostic question to another variant."""
    entry = lambda v, r: F.struct(F.lit(v).alias("variant"), F.lit(r).alias("rank"), F.lit(0.5).alias("score"))
    both = F.array(entry("dense", 1), entry("rewrite", 2))
    pool = asks(spark, sf).withColumn(
        "retrieved_by", F.when(F.col("o_orderkey") % 3 == 0, F.array(entry("rewrite", 2))).otherwise(both)
    )
    routed = R.is_diagnostic(F.col("q"))
    done = R.route(pool.withColumn("routed", routed), F.col("routed"), "rewrite", "dense", "routed")
    mine = F.filter("retrieved_by", lambda r: r["variant"] == "routed")
    return done.select("o_orderkey", "routed", F.try_element_at(mine, F.lit(1))["rank"].alias("routed_rank"))


@query("F7_diagnose_first_rewrite", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN l_discount < 0.8 AND l_extendedprice > 0 THEN 'gross-margin' ELSE 'monetization' END AS "constraint",
           CASE WHEN l_returnflag = 'R' THEN 'No deterministic diagnostic rewrite available.'
                ELSE 'Service gross margin is ' || round(l_discount * 100)::INT || '%, below the 80% rule of thumb.' END AS reason
    FROM lineitem""")
def f7(spark, sf):
    text = F.when(F.col("l_returnflag") == "R", "why do margins fall?").otherwise(
        F.concat(
            F.lit("Our Gross Margin is "), F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"),
            F.lit("% at $"), F.format_number("l_extendedprice", 2), F.lit(" to win a client"),
        )
    )
    r = R.rewrite_query(text)
    return table(spark, sf, "lineitem").withColumn("r", r).select(
        "l_orderkey", "l_linenumber", F.col("r.constraint").alias("constraint"), F.col("r.reason").alias("reason")
    )


@query("F8_rewrite_scoring", f"""
    WITH {sql_bm25(20)}, {sql_bm25(5, k1=0.4, name='alt')},
    pool AS (SELECT query_id, chunk_id, quality FROM lex JOIN labels ON doc_id = chunk_id)
    SELECT coalesce(p.query_id, a.query_id) AS query_id, coalesce(p.chunk_id, a.chunk_id) AS chunk_id, p.quality AS relevance,
           a.rank::INTEGER AS new_rank, CASE WHEN p.query_id IS NULL THEN 'unjudged pair' END AS error
    FROM pool p FULL JOIN alt a ON p.query_id = a.query_id AND p.chunk_id = a.chunk_id""")
def f8(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("relevance"))
    entry = F.array(F.struct(F.lit("bm25").alias("variant"), "rank", F.round("score", 6).alias("score")))
    pool = bm25(spark, sf, 20).join(labels, "chunk_id").select("query_id", "chunk_id", "relevance", entry.alias("retrieved_by"))
    done = R.append_retrieval(pool, bm25(spark, sf, 5, k1=0.4), "rewrite")
    mine = F.filter("retrieved_by", lambda r: r["variant"] == "rewrite")
    return done.select("query_id", "chunk_id", "relevance", F.try_element_at(mine, F.lit(1))["rank"].alias("new_rank"), "error")
