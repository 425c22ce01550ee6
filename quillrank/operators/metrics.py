"""Ranking, coverage, agreement, latency and cost metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank.operators.quantiles import quantiles


def _share(cond: Column) -> Column:
    return F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def first_hit_rank(results: DataFrame, hit: Column, keys: Sequence[str]) -> DataFrame:
    return results.groupBy(*keys).agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"))


def hit_metrics(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hit@1, Hit@5 and mean reciprocal rank over one row per query (first_rank nullable)."""
    return ranks.groupBy(*by).agg(
        F.count("*").alias("queries"),
        _share(F.col("first_rank") == 1).alias("hit_at_1"),
        _share(F.col("first_rank") <= 5).alias("hit_at_5"),
        F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
    )


def useful_rank_summary(rows: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Percent hits, mean first rank over hits, useful and noise shares, words and latency.

    rows: one per case with first_rank (nullable), useful_count, words, latency_ms. The
    list of misses is a table of its own (`misses`), since it grows with the cases.
    """
    by = list(by)
    main = rows.groupBy(*by).agg(
        F.count("*").alias("cases"),
        (100 * _share(F.col("first_rank") == 1)).alias("hit_at_1_pct"),
        (100 * _share(F.col("first_rank") <= 3)).alias("hit_at_3_pct"),
        (100 * _share(F.col("first_rank").isNotNull())).alias("hit_at_5_pct"),
        F.avg("first_rank").alias("mean_first_rank"),
        (100 * F.sum("useful_count") / (F.count("*") * k)).alias("useful_pct"),
        F.avg("words").alias("mean_words"), F.avg("latency_ms").alias("mean_latency_ms"),
    ).withColumn("noise_pct", 100 - F.col("useful_pct"))
    words = quantiles(rows, by, "words", {"p50_words": ("linear", 0.5)})
    latency = quantiles(
        rows, by, "latency_ms",
        {"p50_latency_ms": ("linear", 0.5), "p95_latency_ms": ("linear", 0.95)},
    )
    return main.join(words, by, "left").join(latency, by, "left")


def compare_variants(rows: DataFrame, by: str = "variant") -> DataFrame:
    """Retrievers or query writers side by side: hit metrics, queries without a hit, and latency.

    rows: one per variant and query with first_rank (nullable) and latency_ms; a query without results
    has a row with neither rank nor hit, so it counts as a miss.
    """
    main = hit_metrics(rows, [by])
    missed = rows.groupBy(by).agg(_count(F.col("first_rank").isNull()).alias("missed"))
    latency = quantiles(
        rows, [by], "latency_ms", {"p50_latency_ms": ("linear", 0.5), "p95_latency_ms": ("linear", 0.95)}
    )
    return main.join(missed, by).join(latency, by, "left")


def misses(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("first_rank").isNull())


def completed_scores(rows: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Scores over rows without an error; coverage and errors over all rows.

    rows: first_rank, useful_count, latency_ms, error. The histogram maps a number of
    useful results (0..k) to its number of cases.
    """
    ok = F.col("error").isNull()
    useful = F.least("useful_count", F.lit(k))
    done = _count(ok)

    def pct(cond: Column) -> Column:
        return F.when(done > 0, 100 * _count(ok & cond) / done)

    bars = F.array(
        *[
            F.struct(F.lit(i).alias("useful"), _count(ok & (useful == i)).alias("cases"))
            for i in range(k + 1)
        ]
    )
    main = rows.groupBy(*by).agg(
        F.count("*").alias("cases"), done.alias("completed"),
        F.when(F.count("*") > 0, 100 * done / F.count("*")).alias("coverage_pct"),
        _count(~ok).alias("errors"),
        pct(F.col("first_rank") == 1).alias("hit_at_1_pct"),
        pct(F.col("first_rank") <= 3).alias("hit_at_3_pct"),
        pct(F.col("first_rank").isNotNull()).alias("hit_at_5_pct"),
        F.avg(F.when(ok, F.col("first_rank"))).alias("mean_first_rank"),
        F.sum(F.when(ok, useful).otherwise(0)).alias("useful_results"),
        (done * k).alias("result_slots"), F.avg(F.when(ok, useful)).alias("mean_useful"),
        F.when(done > 0, 100 * F.sum(F.when(ok, useful)) / (done * k)).alias("precision_pct"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_latency_ms"),
        F.map_from_entries(F.filter(bars, lambda b: b["cases"] > 0)).alias("histogram"),
    ).withColumn("noise_pct", 100 - F.col("precision_pct"))
    median = quantiles(
        rows.where(ok).withColumn("_u", useful), list(by), "_u", {"median_useful": ("linear", 0.5)}
    )
    if not by:
        return main.select("*", median.select("median_useful").scalar().alias("median_useful"))
    return main.join(median, list(by), "left")


def _gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def graded_scores(pool: DataFrame, variants: Mapping[str, Sequence[str]], k: int = 5, all_queries: bool = False) -> DataFrame:
    """nDCG@k, precision@k and recall@k per (variant, query) on a judged pool.

    pool: query_id, chunk_id, relevance (nullable), retrieved_by array<struct<variant,
    rank,...>>. `variants` maps a name to the labels it goes by. The ideal ranking uses
    every judged row of the query. With `all_queries` a query that a variant did not
    answer scores 0; without it the query is left out for that variant.
    """
    judged = pool.where(F.col("relevance").isNotNull())
    best = Window.partitionBy("query_id").orderBy(F.col("relevance").desc())
    per_query = judged.groupBy("query_id").agg(_count(F.col("relevance") > 0).alias("relevant_total"))
    ideal = (
        judged.select("query_id", "relevance").withColumn("at", F.row_number().over(best)).where(F.col("at") <= k)
        .groupBy("query_id").agg(F.sum(_gain(F.col("relevance")) / F.log2(F.col("at") + 1.0)).alias("ideal"))
        .join(per_query, "query_id")
    )
    names = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.array(*[F.lit(a) for a in labels]).alias("labels"))
            for n, labels in variants.items()
        ]
    )
    ranked = (
        judged.select("query_id", "chunk_id", "relevance", "retrieved_by", F.explode(names).alias("v"))
        .withColumn(
            "hit",
            F.get(F.filter("retrieved_by", lambda r: F.array_contains(F.col("v.labels"), r["variant"])), F.lit(0)),
        )
        .where(F.col("hit").isNotNull())
        .select("query_id", "chunk_id", "relevance", F.col("v.name").alias("variant"), F.col("hit.rank").alias("rank"))
    )
    order = Window.partitionBy("variant", "query_id").orderBy("rank", "relevance", "chunk_id")
    top = ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    scored = top.groupBy("variant", "query_id").agg(
        F.sum(_gain(F.col("relevance")) / F.log2(F.col("at") + 1.0)).alias("dcg"),
        _count(F.col("relevance") > 0).alias("relevant_at_k"),
    )
    if all_queries:
        grid = ideal.select("query_id", "ideal", "relevant_total", F.explode(F.array(*[F.lit(n) for n in variants])).alias("variant"))
        rows = grid.join(scored, ["variant", "query_id"], "left")
    else:
        rows = scored.join(ideal, "query_id")
    hits = F.coalesce("relevant_at_k", F.lit(0))
    return rows.select(
        "variant", "query_id",
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        (hits / F.lit(float(k))).alias("precision"),
        F.when(F.col("relevant_total") > 0, hits / F.col("relevant_total")).otherwise(0.0).alias("recall"),
    )


def graded_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variant").agg(
        F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
    )


def build_pool(results: DataFrame) -> DataFrame:
    """One row per (query, chunk) with every retrieval of it, in a blinded order per query.

    results: variant, query_id, chunk_id, rank, score. The list of a pair has one entry
    per variant.
    """
    entry = F.struct("variant", "rank", F.round("score", 6).alias("score"))
    return (
        results.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(entry)).alias("retrieved_by"))
        .withColumn("pool_id", F.concat_ws("::", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
        .withColumn(
            "order_key",
            F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")), 256),
        )
    )


def blinded(pool: DataFrame) -> DataFrame:
    """The pool with each row's position in its query's blinded order, from 1."""
    order = Window.partitionBy("query_id").orderBy("order_key", "chunk_id")
    return pool.withColumn("position", F.row_number().over(order))


def provenance_counts(labels: DataFrame) -> DataFrame:
    """Reviewed rows per label, source, provider, model and reviewer, with defaults."""
    def default(name: str, value: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value)).alias(name)

    return labels.where(F.col("relevance").isNotNull()).groupBy(
        "relevance", default("source", "manual"), default("provider", "manual"),
        default("model", "none"), default("reviewer", "manual_unspecified"),
    ).agg(F.count("*").alias("rows"))


def gate_confusion(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Search-gate accuracy over valid rows: overall, required recall, prohibited accuracy."""
    valid = F.col("valid")
    needed = valid & (F.col("expected") == K.SEARCH_ACTION)
    barred = valid & (F.col("expected") == "no_search")

    def rate(base: Column) -> Column:
        n = _count(base)
        return F.when(n > 0, _count(base & F.col("correct")) / n)

    return rows.groupBy(*by).agg(
        F.count("*").alias("trials"), _count(valid).alias("valid_trials"),
        rate(valid).alias("accuracy"), rate(needed).alias("required_recall"),
        rate(barred).alias("prohibited_accuracy"),
    )


def run_performance(runs: DataFrame, prices: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Requests, errors, latency percentiles, tokens and cost per model.

    runs: model, latency_ms, prompt_tokens, completion_tokens, error. prices: model,
    prompt_rate, completion_rate, each per million tokens. Failed requests only count as
    errors.
    """
    by = list(by)
    ok = F.col("error").isNull()
    zero = F.lit(0)
    main = runs.groupBy(*by).agg(
        F.count("*").alias("requests"), _count(~ok).alias("errors"), _count(ok).alias("_n"),
        F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), zero).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), zero).alias("completion_tokens"),
    )
    latency = quantiles(
        runs.where(ok), by, "latency_ms",
        {"p50_latency_ms": ("linear", 0.5), "p95_latency_ms": ("exclusive", 19)},
    )
    cost = (
        F.col("prompt_tokens") * F.coalesce("prompt_rate", F.lit(0.0))
        + F.col("completion_tokens") * F.coalesce("completion_rate", F.lit(0.0))
    ) / 1e6
    return (
        main.join(latency, by, "left").join(prices, "model", "left").withColumn("cost_usd", cost)
        .withColumn("cost_per_case_usd", F.when(F.col("_n") > 0, F.col("cost_usd") / F.col("_n")))
        .drop("_n", "prompt_rate", "completion_rate")
    )


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Per tier and suite: number of runs, mean strict pass rate, and the rates by run.

    runs: tier, suite, run_id, passed (one row per case). A tier has few runs.
    """
    per_run = runs.groupBy("tier", "suite", "run_id").agg(_share(F.col("passed")).alias("rate"))
    return per_run.groupBy("tier", "suite").agg(
        F.count("*").alias("runs"), F.avg("rate").alias("mean_pass_rate"),
        F.min("rate").alias("worst_run"), F.max("rate").alias("best_run"),
    )


def per_run_rates(runs: DataFrame) -> DataFrame:
    return runs.groupBy("tier", "suite", "run_id").agg(_share(F.col("passed")).alias("rate"))


def repeated_run_means(runs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Per tier and suite: the mean over runs of each run's mean of the measures (nulls left out)."""
    per_run = runs.groupBy("tier", "suite", "run_id").agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in measures])
    return per_run.groupBy("tier", "suite").agg(
        F.count("*").alias("runs"), *[F.avg(m).alias(f"mean_{m}") for m in measures]
    )


def failure_modes(rows: DataFrame, reasons: str = "failure_reasons", by: Sequence[str] = ()) -> DataFrame:
    return rows.select(*by, F.explode(reasons).alias("reason")).groupBy(*by, "reason").agg(
        F.count("*").alias("cases")
    )


def grouped_passes(rows: DataFrame) -> DataFrame:
    """Pass and claim counts by category, by scenario and overall (grouping sets)."""
    return rows.groupingSets(
        [["category"], ["scenario"], []], "category", "scenario"
    ).agg(
        F.grouping_id().alias("level"), F.count("*").alias("cases"), _count(F.col("passed")).alias("passed"),
        F.sum("claims").alias("claims"), F.sum("supported_claims").alias("supported_claims"),
    )


def adopt_variant(variants: DataFrame, baseline: str, suite: Sequence[str] = ("suite",)) -> DataFrame:
    """Winner by (mrr, hit@1) per suite, adopted if hit@1 rises or mrr gains 0.01.

    variants: suite, variant, mrr, hit_at_1; one row per variant. Equal scores go to the
    variant read first (column `position`).
    """
    first = F.struct("mrr", "hit_at_1", (-F.col("position")).alias("p"))
    here = F.col("variant") == baseline
    return variants.groupBy(*suite).agg(
        F.max_by(F.struct("variant", "mrr", "hit_at_1"), first).alias("best"),
        F.max(F.when(here, F.col("mrr"))).alias("base_mrr"),
        F.max(F.when(here, F.col("hit_at_1"))).alias("base_hit"),
    ).select(
        *suite, F.col("best.variant").alias("best_variant"),
        (F.col("best.mrr") - F.col("base_mrr")).alias("mrr_delta"),
        (F.col("best.hit_at_1") - F.col("base_hit")).alias("hit_at_1_delta"),
    ).withColumn(
        "adopted",
        F.when(
            (F.col("best_variant") == baseline) | (F.col("hit_at_1_delta") > 0) | (F.col("mrr_delta") >= K.MRR_GAIN),
            F.col("best_variant"),
        ).otherwise(F.lit(baseline)),
    )


def adopt_for_coverage(variants: DataFrame, baseline: str, suite: Sequence[str] = ("suite",)) -> DataFrame:
    """Winner by (average, full coverage), adopted at +5 points average or +10 points full."""
    first = F.struct("avg_coverage", "full_coverage", (-F.col("position")).alias("p"))
    here = F.col("variant") == baseline
    return variants.groupBy(*suite).agg(
        F.max_by(F.struct("variant", "avg_coverage", "full_coverage"), first).alias("best"),
        F.max(F.when(here, F.col("avg_coverage"))).alias("base_avg"),
        F.max(F.when(here, F.col("full_coverage"))).alias("base_full"),
    ).select(
        *suite, F.col("best.variant").alias("best_variant"),
        F.when(
            (F.col("best.variant") == baseline)
            | (F.col("best.avg_coverage") - F.col("base_avg") >= K.COVERAGE_GAIN)
            | (F.col("best.full_coverage") - F.col("base_full") >= K.FULL_COVERAGE_GAIN),
            F.col("best.variant"),
        ).otherwise(F.lit(baseline)).alias("adopted"),
    )


def adopt_model(summaries: DataFrame, small: str, large: str, unreviewed: Column, suite: Sequence[str] = ("suite",)) -> DataFrame:
    """Larger model wins if nothing is unreviewed, hit@5 holds, and usefulness or rank gains."""
    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("variant") == model, F.col(name)))

    return summaries.groupBy(*suite).agg(
        (of(large, "useful_pct") - of(small, "useful_pct")).alias("useful_gain"),
        (of(small, "mean_first_rank") - of(large, "mean_first_rank")).alias("rank_gain"),
        (of(large, "hit_at_5_pct") >= of(small, "hit_at_5_pct")).alias("_holds"),
        F.max(unreviewed).alias("unreviewed"),
    ).withColumn(
        "decision",
        F.when(
            (F.col("unreviewed") == 0) & F.col("_holds")
            & ((F.col("useful_gain") >= K.USEFUL_GAIN) | (F.col("rank_gain") >= K.RANK_GAIN)),
            F.lit(large),
        ).otherwise(F.lit(small)),
    ).drop("_holds")


def split_coverage(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Total and scored cases per split, and whether the split is complete."""
    done = results.where(F.col("status") == "scored").select("case_id").distinct().withColumn("_d", F.lit(1))
    return cases.join(done, "case_id", "left").groupBy("split").agg(
        F.count("*").alias("total"), F.count("_d").alias("scored")
    ).withColumn("complete", F.col("total") == F.col("scored"))


def dev_regression_complete(coverage: DataFrame) -> DataFrame:
    return coverage.agg(
        F.coalesce(
            F.bool_and(F.when(F.col("split").isin("dev", "regression"), F.col("complete"))), F.lit(True)
        ).alias("complete")
    )


def query_quality(results: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """One row per case: useful rank, subject matches, focus recall, distinct results.

    results: case_id, chunk_id, rank, subjects. cases: case_id, query_text, useful (array),
    expected_subjects (array), focus_terms (array), namespaces (array<array>, one per query).
    """
    needed = cases.select("case_id", "useful", "expected_subjects")
    match = F.arrays_overlap("subjects", "expected_subjects")
    scored = results.join(needed, "case_id").groupBy("case_id").agg(
        F.min(F.when(F.array_contains("useful", F.col("chunk_id")), F.col("rank"))).alias("useful_rank"),
        F.max(F.when(F.col("rank") == 1, match)).alias("_top1"),
        F.max(F.when(F.col("rank") <= k, match)).alias("_any"),
        F.count("*").alias("merged"),
    )
    terms = F.size("focus_terms")
    hits = F.size(
        F.filter("focus_terms", lambda t: F.contains(F.lower("query_text"), F.lower(t)))
    )
    searches = F.aggregate(
        "namespaces", F.lit(0), lambda n, ns: n + F.greatest(F.lit(1), F.size(F.array_distinct(ns)))
    )
    return cases.join(scored, "case_id", "left").select(
        "case_id", "useful_rank",
        F.coalesce(F.col("useful_rank") <= 3, F.lit(False)).alias("useful_at_3"),
        F.coalesce("_top1", F.lit(False)).alias("top1_subject_match"),
        F.coalesce("_any", F.lit(False)).alias("any_subject_match"),
        F.when(terms == 0, 1.0).otherwise(hits / terms).alias("focus_recall"),
        F.coalesce("merged", F.lit(0)).alias("merged_results"), searches.alias("vector_searches"),
    )
