"""Rank fusion and retrieval policies over ranked lists (query_id, chunk_id, rank, source).

`source` numbers the lists of a query in the order they are read: 0 lexical, 1 vector.
Every list holds at most a candidate depth of rows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank import scale
from quillrank.functions import economics
from quillrank.functions.text import bind, money_values, percent_values


def candidate_depth(k: int) -> int:
    return k * K.CANDIDATE_FACTOR


def stack(*lists: DataFrame) -> DataFrame:
    """Union of ranked lists, numbered in the given order."""
    out = None
    for number, ranked in enumerate(lists):
        part = ranked.select("query_id", "chunk_id", "rank", F.lit(number).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def _fused(lists: DataFrame, rrf_k: int, keys: list[str]) -> DataFrame:
    return lists.groupBy(*keys, "chunk_id").agg(
        F.sum(1 / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score"),
        F.min(F.struct("source", "rank")).alias("seen"),
    )


def fuse(lists: DataFrame, k: int = 5, rrf_k: int = K.RRF_K, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion; equal scores keep the order in which chunks were first seen."""
    order = [scale.score_key("score", 12), F.col("seen").asc()]
    return scale.top_k(_fused(lists, rrf_k, list(keys)), keys, order, k).drop("seen")


def fuse_by_rank(lists: DataFrame, k: int = 5, rrf_k: int = K.RRF_K) -> DataFrame:
    """Fusion whose ties go to the better rank in the first list that has the chunk."""
    order = [scale.score_key("score", 12), F.col("seen.rank"), F.col("seen.source"), F.col("chunk_id")]
    return scale.top_k(_fused(lists, rrf_k, ["query_id"]), ["query_id"], order, k).drop("seen")


def fuse_with_anchor(lists: DataFrame, k: int = 5, anchors: int = 1, rrf_k: int = K.RRF_K) -> DataFrame:
    """Fused top k - anchors, then the best lexical rows (source 0) not among them, up to k.

    One fused row is always taken, even when anchors leave no room for any.
    """
    head = fuse_by_rank(lists, max(1, k - anchors), rrf_k).select("query_id", "chunk_id", F.lit(0).alias("_list"), "rank")
    rest = (
        lists.where(F.col("source") == 0)
        .join(head, ["query_id", "chunk_id"], "left_anti")
        .select("query_id", "chunk_id", F.lit(1).alias("_list"), "rank")
    )
    both = head.unionByName(rest).withColumnRenamed("rank", "_at")
    return scale.top_k(both, ["query_id"], [F.col("_list").asc(), F.col("_at").asc()], k).drop("_list", "_at")


def hybrid_search(lexical: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Fuse the first 5k rows of a lexical and a vector ranking."""
    depth = candidate_depth(k)
    return fuse(
        stack(lexical.where(F.col("rank") <= depth), vector.where(F.col("rank") <= depth)), k
    )


def compare_sources(ranks: DataFrame) -> DataFrame:
    """Per case, what adding generated variants to the keyword query did.

    ranks: case_id, method in (keyword_only, variants_only, both), first_rank (nullable).
    """
    wide = ranks.groupBy("case_id").agg(
        *[
            F.max(F.when(F.col("method") == m, F.col("first_rank"))).alias(m)
            for m in ("keyword_only", "variants_only", "both")
        ]
    )

    def first(name: str) -> Column:
        return F.coalesce(F.col(name) == 1, F.lit(False))

    v, b, kw = first("variants_only"), first("both"), first("keyword_only")
    same = F.col("variants_only").eqNullSafe(F.col("both"))
    return wide.withColumn(
        "effect",
        F.when(b & ~v, "fusion_better").when(v & ~b, "fusion_worse")
        .when(~same, "rank_shift_same_hit1").otherwise("same"),
    ).withColumn("keyword_rescue", kw & ~v).withColumn("variants_beat_keyword", v & ~kw)


def is_diagnostic(query: Column) -> Column:
    """A number fact, a metric word and a diagnostic question, all in the text."""
    return (
        F.rlike(query, F.lit(K.NUMBER_FACTS))
        & F.rlike(query, F.lit(K.METRIC_WORDS))
        & F.rlike(query, F.lit(K.DIAGNOSTIC_ASK))
    )


def route(pool: DataFrame, routed: Column, when_routed: str, otherwise: str, name: str) -> DataFrame:
    """Append the routed policy's retrieval to each pool row that has its source variant."""
    variant = F.when(routed, F.lit(when_routed)).otherwise(F.lit(otherwise))
    source = F.filter("retrieved_by", lambda r: r["variant"] == variant)
    entry = F.array(
        F.struct(F.lit(name).alias("variant"), F.get(source, F.lit(0))["rank"].alias("rank"), F.lit(1.0).alias("score"))
    )
    return pool.withColumn(
        "retrieved_by",
        F.when(F.size(source) > 0, F.concat("retrieved_by", entry)).otherwise(F.col("retrieved_by")),
    )


def rewrite_query(query: Column) -> Column:
    """struct(query, constraint, reason): diagnose a margin question, search for its concept.

    A query that states a gross margin with a dollar amount and a percentage is read as a
    service business; every other query is left as it is.
    """
    concepts = F.create_map(*[F.lit(x) for pair in K.REWRITE_CONCEPTS.items() for x in pair])
    plain = F.struct(
        query.alias("query"), F.lit("unknown").alias("constraint"), F.lit(K.NO_REWRITE_REASON).alias("reason")
    )

    def rewritten(found: Column) -> Column:
        text = F.concat(
            F.lit("diagnose "), found["constraint"], F.lit(": "),
            F.coalesce(F.try_element_at(concepts, found["constraint"]), F.lit("")),
            F.lit(". Reason: "), found["reason"], F.lit(" Success metric: "), found["success_metric"],
        )
        return F.when(
            found["constraint"].isNotNull(),
            F.struct(text.alias("query"), found["constraint"].alias("constraint"), found["reason"].alias("reason")),
        ).otherwise(plain)

    def from_facts(facts: Column) -> Column:
        usable = (F.size(facts["dollars"]) > 0) & (F.size(facts["percents"]) > 0)
        diagnosis = economics.diagnose(
            facts["cac"], F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), facts["margin"], F.lit(True)
        )
        return F.when(usable, bind(diagnosis, rewritten)).otherwise(plain)

    def numbers(lists: Column) -> Column:
        return bind(
            F.struct(
                lists["dollars"].alias("dollars"), lists["percents"].alias("percents"),
                F.try_element_at(lists["dollars"], F.lit(-1)).alias("cac"),
                F.try_element_at(lists["percents"], F.lit(1)).alias("margin"),
            ),
            from_facts,
        )

    lists = F.struct(money_values(query).alias("dollars"), percent_values(query).alias("percents"))
    return F.when(F.contains(F.lower(query), F.lit("gross margin")), bind(lists, numbers)).otherwise(plain)


def append_retrieval(pool: DataFrame, results: DataFrame, variant: str) -> DataFrame:
    """Add a variant's ranks to the judged pool; pairs without a judgment become error rows."""
    ranked = results.select("query_id", "chunk_id", "rank", "score").withColumn("_hit", F.lit(True))
    entry = F.array(
        F.struct(F.lit(variant).alias("variant"), F.col("rank"), F.round("score", 6).alias("score"))
    )
    joined = pool.withColumn("_judged", F.lit(True)).join(ranked, ["query_id", "chunk_id"], "full")
    return joined.select(
        "query_id", "chunk_id", "relevance",
        F.when(F.col("_hit"), F.concat(F.coalesce("retrieved_by", F.array()), entry))
        .otherwise(F.col("retrieved_by")).alias("retrieved_by"),
        F.when(F.col("_judged").isNull(), F.lit("unjudged pair")).alias("error"),
    )
