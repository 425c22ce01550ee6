"""Joining relevance labels onto results: overrides, span transfer, coverage, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank.functions.text import bind, tokens


def last_rows(rows: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The last row of each key by `order`, such as the line numbers of a file; null keys are keys."""
    at = F.col(order) if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys]
    return rows.withColumn("_seq", at).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_r")).select(
        *[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns]
    )


def _last_label(labels: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """(keys, name): the label of the last row of each key."""
    return last_rows(labels.select(*keys, F.col("useful").alias(name), F.col(order).alias("_line")), keys, "_line").drop("_line")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null meets null."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    met = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, met, "left").drop(*[f"_r_{k}" for k in keys])


def adjudicate(
    results: DataFrame, transferred: DataFrame, by_strategy: DataFrame, by_case: DataFrame, order: str = "line_number"
) -> DataFrame:
    """Final label per result and where it came from.

    Priority: by_case (case_id, chunk_id, useful), then by_strategy (strategy, case_id,
    chunk_id, useful), then transferred (strategy, case_id, chunk_id, useful), else false. Of
    a key that a table repeats, the last row by its column `order` counts; null keys are keys.
    """
    pair, placed = ["case_id", "chunk_id"], ["strategy", "case_id", "chunk_id"]
    joined = _join_null_safe(results, _last_label(by_case, pair, order, "_a"), pair)
    joined = _join_null_safe(joined, _last_label(by_strategy, placed, order, "_b"), placed)
    joined = _join_null_safe(joined, _last_label(transferred, placed, order, "_c"), placed)
    return joined.withColumn("useful", F.coalesce("_a", "_b", "_c", F.lit(False))).withColumn(
        "label_source",
        F.when(F.col("_a").isNotNull(), "model_comparison").when(
            F.col("_b").isNotNull(), "semantic_adjudication"
        ).otherwise("span_transfer"),
    ).drop("_a", "_b", "_c")


def span_overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int = 256) -> DataFrame:
    """Pairs of overlapping [start, end) spans with equal keys, with their overlap.

    Spans meet only in the position buckets they touch, and each pair is kept in the first
    bucket it shares, so a key with very many spans is not paired all against all.
    left/right: keys, id, start, end.
    """

    def bucketed(df: DataFrame, side: str) -> DataFrame:
        first = F.floor(F.col("start") / width).cast("long")
        last = F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width).cast("long")
        return df.select(
            *keys, *[F.col(c).alias(f"{side}_{c}") for c in ("id", "start", "end")],
            first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("bucket"),
        )

    joined = bucketed(left, "l").join(bucketed(right, "r"), [*keys, "bucket"]).where(
        F.col("bucket") == F.greatest("l_first", "r_first")
    )
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    return (
        joined.withColumn("overlap", overlap).where(F.col("overlap") > 0)
        .drop("bucket", "l_first", "r_first")
    )


def transfer_labels(candidates: DataFrame, useful: DataFrame, keys: Sequence[str] = ("case_id", "chapter")) -> DataFrame:
    """(keys, id, useful, matches): a label carries over on a substantive span overlap.

    At least 20 tokens and 15 % of the shorter span must be shared.
    """
    pairs = span_overlaps(candidates, useful, list(keys))
    shorter = F.least(
        F.greatest(F.lit(1), F.col("l_end") - F.col("l_start")),
        F.greatest(F.lit(1), F.col("r_end") - F.col("r_start")),
    )
    share = F.round(F.col("overlap") / shorter, 4)
    scored = pairs.withColumn(
        "_ok", (F.col("overlap") >= K.MIN_OVERLAP_TOKENS) & (share >= K.MIN_OVERLAP_SHARE)
    )
    summed = scored.groupBy(*keys, F.col("l_id").alias("id")).agg(
        F.max("_ok").alias("_ok"), F.count("*").alias("_m")
    )
    return (
        candidates.select(*keys, "id").join(summed, [*keys, "id"], "left")
        .select(
            *keys, "id", F.coalesce("_ok", F.lit(False)).alias("useful"),
            F.coalesce("_m", F.lit(0)).alias("matches"),
        )
    )


def exact_labels(candidates: DataFrame, useful: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Label transfer where candidate and labelled chunks share ids."""
    hit = useful.select(*keys, "id").distinct().withColumn("useful", F.lit(True))
    return candidates.select(*keys, "id").join(hit, [*keys, "id"], "left").withColumn(
        "useful", F.coalesce("useful", F.lit(False))
    )


SPAN_NEAR, SPAN_REACH = 48, 2000


def token_span(source: Column, needle: Column, estimated: Column) -> Column:
    """struct(start, end) of the needle's token run nearest the estimate, null if absent.

    A run that starts within some reach of the estimate is nearer than any beyond it. Most runs start close
    by, so few tokens are searched first; the whole source only where there is none within the last reach.
    """
    def within(reach: int) -> Column:
        def shifted(first: Column) -> Column:
            part = F.slice(source, first + 1, F.lit(2 * reach) + F.size(needle))
            return bind(
                _span_in(part, needle, F.greatest(estimated, F.lit(0)) - first),
                lambda s: F.when(s.isNotNull(), F.struct((s["start"] + first).alias("start"), (s["end"] + first).alias("end"))),
            )

        return bind(F.greatest(F.least(estimated, F.size(source)) - reach, F.lit(0)), shifted)

    def else_(found: Column, wider: Column) -> Column:
        return bind(found, lambda s: F.when(s.isNotNull(), s).otherwise(wider))

    return else_(within(SPAN_NEAR), else_(within(SPAN_REACH), _span_in(source, needle, estimated)))


def _span_in(source: Column, needle: Column, estimated: Column) -> Column:
    """token_span over all of `source`.

    Tokens are matched as one blank-separated string, so both neighbours of the estimate are
    found by a plain substring search instead of a scan over positions.
    """
    def padded(t: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))

    def blanks(prefix: Column) -> Column:
        return F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit("")))

    def search(pair: Column) -> Column:
        text, run = pair["s"], pair["n"]
        # Blank that precedes the estimated token, 1-based.
        at = F.length(F.array_join(F.slice(source, 1, F.greatest(estimated, F.lit(0))), " ")) + F.when(
            estimated > 0, 2
        ).otherwise(1)
        after = F.call_function("locate", run, text, at)
        # A run that starts at or before `at` ends at or before at + its length - 1.
        head = F.substring(text, F.lit(1), at + F.length(run) - 1)
        back = F.call_function("locate", F.reverse(run), F.reverse(head), F.lit(1))
        before = F.when(back > 0, F.length(head) - back - F.length(run) + 2).otherwise(0)

        def token_index(position: Column) -> Column:
            return F.when(position > 0, blanks(F.substring(text, F.lit(1), position)) - 1)

        def choose(c: Column) -> Column:
            a, b = c["a"], c["b"]
            return F.when(a.isNull(), b).when(b.isNull(), a).when(
                F.abs(estimated - a) <= F.abs(b - estimated), a
            ).otherwise(b)

        start = bind(
            F.struct(token_index(before).alias("a"), token_index(after).alias("b")), choose
        )
        return bind(
            start,
            lambda s: F.when(
                s.isNotNull() & (F.size(needle) > 0),
                F.struct(s.cast("int").alias("start"), (s + F.size(needle)).cast("int").alias("end")),
            ),
        )

    return bind(F.struct(padded(source).alias("s"), padded(needle).alias("n")), search)


def chunk_spans(text: Column, pieces: Column) -> Column:
    """array<struct<start,end>>: token span in the text of each piece (text, start, end)."""
    def per_text(source: Column) -> Column:
        def one(piece: Column) -> Column:
            share = piece["start"] / F.greatest(F.lit(1), F.length(text))
            estimated = F.bround(share * F.size(source), 0).cast("int")
            return bind(
                F.struct(tokens(piece["text"]).alias("t"), estimated.alias("e")),
                lambda x: token_span(source, x["t"], x["e"]),
            )

        return F.transform(pieces, one)

    return bind(tokens(text), per_text)


def claim_support(
    claims: DataFrame, results: DataFrame, include_proposed: bool = False
) -> DataFrame:
    """(claim_id, query_id, supported) for labelled claims with supporting chunks.

    claims: claim_id, query_id, status, supporting (array). results: query_id, chunk_id.
    """
    allowed = ["accepted", "proposed"] if include_proposed else ["accepted"]
    kept = label_filter(claims, allowed)
    hits = (
        kept.select("claim_id", "query_id", F.explode("supporting").alias("chunk_id"))
        .join(results.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
        .groupBy("claim_id").agg(F.lit(True).alias("supported"))
    )
    return kept.select("claim_id", "query_id").join(hits, "claim_id", "left").withColumn(
        "supported", F.coalesce("supported", F.lit(False))
    )


def label_filter(labels: DataFrame, statuses: Sequence[str], support: str = "supporting") -> DataFrame:
    return labels.where(F.col("status").isin(list(statuses)) & (F.size(support) > 0))


def support_coverage(support: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return support.groupBy(*by).agg(
        F.count("*").alias("claims"),
        F.count(F.when(F.col("supported"), 1)).alias("supported"),
        F.count(F.when(~F.col("supported"), 1)).alias("unsupported"),
        F.avg(F.col("supported").cast("double")).alias("coverage"),
    )


def novel_pairs(
    base: DataFrame, other: DataFrame, reviewed: DataFrame, old_labels: DataFrame, order: str = "line_number"
) -> DataFrame:
    """Pairs only `other` returned, with their review state and what the review corrected.

    base/other: case_id, chunk_id. reviewed: + useful. old_labels: + useful (absent = false).
    Of a pair that a table of labels repeats, the last row by its column `order` counts.
    """
    keys = ["case_id", "chunk_id"]
    novel = other.select(*keys).distinct().join(base.select(*keys), keys, "left_anti")
    joined = _join_null_safe(novel, _last_label(reviewed, keys, order, "_new"), keys)
    joined = _join_null_safe(joined, _last_label(old_labels, keys, order, "_old"), keys)
    was = F.coalesce("_old", F.lit(False))
    return joined.select(
        *keys, F.col("_new").isNotNull().alias("reviewed"),
        F.coalesce(F.col("_new") & ~was, F.lit(False)).alias("false_negative_fixed"),
        F.coalesce(~F.col("_new") & was, F.lit(False)).alias("false_positive_fixed"),
    )


def audit_novel(pairs: DataFrame) -> DataFrame:
    def count(name: str, cond: Column) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return pairs.agg(
        F.count("*").alias("novel"), count("reviewed", F.col("reviewed")),
        count("unreviewed", ~F.col("reviewed")),
        count("false_negative_corrections", F.col("false_negative_fixed")),
        count("false_positive_corrections", F.col("false_positive_fixed")),
    )


def compare_conditions(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Per case: both first useful ranks and useful counts, their delta, whether the lists differ.

    rows: condition, case_id, first_rank (nullable), useful_count, returned (array, ranked).
    A case that one side lacks is named in missing_in.
    """
    def side(name: str, tag: str) -> DataFrame:
        return rows.where(F.col("condition") == name).select(
            "case_id", F.col("first_rank").alias(f"{tag}_rank"), F.col("useful_count").alias(f"{tag}_useful"),
            F.col("returned").alias(f"{tag}_ids"), F.lit(True).alias(f"{tag}_there"),
        )

    both = side(first, "a").join(side(second, "b"), "case_id", "full")
    return both.select(
        "case_id", "a_rank", "a_useful", "b_rank", "b_useful", (F.col("b_useful") - F.col("a_useful")).alias("delta"),
        (~F.col("a_ids").eqNullSafe(F.col("b_ids"))).alias("changed"),
        F.when(F.col("a_there").isNull(), first).when(F.col("b_there").isNull(), second).alias("missing_in"),
    )


def compare_latencies(rows: DataFrame, before: str, after: str, selected: str) -> DataFrame:
    """Per case of all three conditions: latencies, whether before and after return the same list,
    and the useful count of the selected condition.

    rows: condition, case_id, latency_ms, useful_count, returned (array, ranked).
    """
    def side(name: str, tag: str) -> DataFrame:
        return rows.where(F.col("condition") == name).select(
            "case_id", F.col("latency_ms").alias(f"{tag}_ms"), F.col("returned").alias(f"{tag}_ids"),
            F.col("useful_count").alias(f"{tag}_useful"),
        )

    joined = side(before, "before").join(side(after, "after"), "case_id").join(side(selected, "selected"), "case_id")
    return joined.select(
        "case_id", "before_ms", "after_ms", (F.col("before_ids").eqNullSafe(F.col("after_ids"))).alias("same"),
        "selected_ms", "selected_useful",
    )


def condition_matrix(cases: DataFrame, generations: DataFrame, conditions: Sequence[tuple[str, str]],
                     backends: Sequence[str]) -> DataFrame:
    """Cases x (method, model) x backend with the frozen query, or an error row.

    generations: case_id, method, model, query, valid. The conditions are a short fixed
    list, expanded per case without a join.
    """
    options = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(w).alias("model"), F.lit(b).alias("backend"))
            for m, w in conditions for b in backends
        ]
    )
    grid = cases.select("case_id", F.explode(options).alias("c")).select("case_id", "c.*")
    return grid.join(generations, ["case_id", "method", "model"], "left").select(
        "case_id", "method", "model", "backend",
        F.when(F.col("valid"), F.col("query")).alias("query"),
        F.when(F.col("valid").isNull(), "missing generation").when(~F.col("valid"), "invalid generation").alias("error"),
    )


def agreement(labels: DataFrame, first: str, second: str) -> DataFrame:
    """Transition counts between two annotators, with overall totals on each row."""
    counts = labels.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(
        F.col(first).alias("label_a"), F.col(second).alias("label_b")
    ).agg(F.count("*").alias("pairs"))
    same = F.when(F.col("label_a") == F.col("label_b"), F.col("pairs")).otherwise(0)
    sums = counts.agg(F.struct(F.sum("pairs").alias("n"), F.sum(same).alias("same")).alias("s")).scalar()
    return counts.withColumn("_s", sums).select(
        "label_a", "label_b", "pairs", F.col("_s.n").alias("total"), (F.col("_s.same") / F.col("_s.n")).alias("agreement")
    )


def disagreements(labels: DataFrame, first: str, second: str) -> DataFrame:
    return labels.where(F.col(first) != F.col(second)).withColumn(
        "transition", F.concat_ws("->", F.col(first).cast("string"), F.col(second).cast("string"))
    )


def overlap_subjects(chunk_lists: DataFrame, routes: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, subjects): subjects of the listed chunks' chapters in first-seen order."""
    listed = chunk_lists.select(key, F.posexplode("chunk_ids").alias("_at", "_id")).withColumn(
        "chapter", F.substring_index("_id", ":", 1)
    )
    dim = routes.select(
        "chapter",
        F.concat(F.array("primary_subject"), F.coalesce("secondary_subjects", F.array())).alias("_s"),
    )
    ordered = listed.join(dim, "chapter", "left").withColumn(
        "_s", F.coalesce("_s", F.array(F.lit(K.DEFAULT_SUBJECT)))
    ).select(key, F.struct("_at", F.col("_s").alias("s")).alias("_p"))
    # One case lists a handful of chunks, so its array stays short.
    return ordered.groupBy(key).agg(
        F.array_distinct(
            F.flatten(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["s"]))
        ).alias("subjects")
    )


# --- set operations on label and case tables -------------------------------

def concat_cases(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def upsert(base: DataFrame, newer: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """One row per key: the last of `newer` by `order`, else the last of `base`; null keys are keys."""
    def placed(df: DataFrame, side: int) -> DataFrame:
        at = F.col(order) if isinstance(order, str) else order
        return df.withColumn("_pos", at).withColumn("_at", F.struct(F.lit(side).alias("side"), "_pos")).drop("_pos")

    return last_rows(placed(newer, 1).unionByName(placed(base, 0)), keys, "_at").drop("_at")


def routing_errors(routed: DataFrame, expected: DataFrame, key: str = "query_id") -> DataFrame:
    extra = routed.select(key).join(expected.select(key), key, "left_anti").withColumn("kind", F.lit("false_positive"))
    missed = expected.select(key).join(routed.select(key), key, "left_anti").withColumn("kind", F.lit("false_negative"))
    return extra.unionByName(missed)
