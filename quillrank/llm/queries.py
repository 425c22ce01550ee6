"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import (
    covertree,
    fingerprints,
    licenses,
    maxsketch,
    mixing,
    neardup,
    packing,
    prefixtrie,
    quality,
    segmentation,
    sharding,
    tokencounts,
    toxicity,
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(fingerprints.fingerprint(read(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(read(spark, sf_dir, "documents")))


def op4_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id",
        F.col("quality_score").alias("score"),
        F.col("quality_posterior").alias("posterior"),
        (F.col("quality_score") >= quality.THRESHOLD).cast("int").alias("quality"),
    )


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shuffle_to_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, read(spark, sf_dir, "labels")).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op10_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return segmentation.decode(segmentation.encode(docs)).select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("piece_ids").alias("piece_ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsketch.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_imatch_fingerprints, op3_license_scan, op4_cover_tree_near_dedup, op5_quality_classifier,
    op6_context_mixing, op7_packing, op8_sharding, op9_toxicity, op10_sampled_segmentation,
    op11_prefix_trie, op12_token_counts, op13_lexical_search,
)}
# The components of linked pairs (a, b), both ways round, over all ids.
COMPONENTS = """
    reach AS (SELECT id AS node, id AS root FROM ids UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.node),
    found AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)"""

ORACLES = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        ids AS (SELECT id FROM s), u AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.x = b.x AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
              GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))), {COMPONENTS}
        SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM s JOIN found ON node = id""",
    "op4_cover_tree_near_dedup": f"""
        WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
        v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {COMPONENTS}
        SELECT node AS vec_id, (SELECT count(*) FROM p WHERE p.a = node)::BIGINT AS n_links, component_id, node = component_id AS kept FROM found""",
    # CRC-32 by its definition, bit by bit: a byte is a number, each -1 one shift.
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || x)) AS s FROM t GROUP BY c),
        z AS (SELECT c, s, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc FROM o),
        h AS (SELECT c, s, (xor(crc, 4294967295) % 6)::INTEGER AS h FROM z),
        q AS (SELECT a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM h a LEFT JOIN o b ON b.c = a.c - a.c % 100),
        e AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM q),
        n AS (SELECT c, d, len(s) = d AS done, s[1:d] AS p, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars FROM e),
        g AS (SELECT p, d, min(c) AS conv, count(*) AS n, any_value(chars) AS chars,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (done), '')) AS ends FROM n GROUP BY p, d),
        k AS (SELECT g.*, u.conv AS up, (SELECT count(*) FROM g b WHERE b.d = g.d + 1 AND b.p[1:g.d] = g.p) AS kids FROM g LEFT JOIN g u ON u.d = g.d - 1 AND u.p = g.p[1:g.d - 1]),
        x AS (SELECT conv, d, p, kids, (n - 1) * chars AS saved, unnest(range(0, d + 1)) AS v FROM k),
        s AS (SELECT p[1:v] AS p, v, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM x GROUP BY 1, 2)
        SELECT k.conv AS conv_id, k.d AS depth, k.up AS parent_conv_id, k.n AS n_convs, k.kids AS n_children,
               s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
        FROM k JOIN s ON s.v = k.d AND s.p = k.p""",
    "op13_lexical_search": """
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        d AS (SELECT row_number() OVER () AS row, doc_id, w, len(w) AS n FROM w WHERE len(w) > 0),
        c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
        i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        q AS (SELECT item, item_id, t, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
        p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY t, n_docs),
        s AS (SELECT item, item_id, row, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
              FROM p JOIN f USING (t) JOIN q USING (t), c GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
