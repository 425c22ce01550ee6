"""Exact percentiles that never gather one group's values in one task.

Values are first counted, then placed in bins by their logarithm, whose totals are accumulated per
group. A bin that holds a wanted rank and more than MOST distinct values is split by value into
SPLITS equal bins, and so on; only small bins are sorted. Each split takes ten bits off the range,
so values of a narrow range, such as times, take one or two rounds more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import stored

BINS_PER_LOG_UNIT = 2000.0
# Distinct values of a bin that are sorted, and bins that a larger one is split into.
MOST = 4096
SPLITS = 1024

Spec = tuple[str, float]


def _bin(value: Column) -> Column:
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BINS_PER_LOG_UNIT)


def _ranks(spec: Spec, n: Column) -> tuple[Column, Column]:
    """The two 0-based order statistics a definition reads."""
    kind, q = spec
    if kind == "linear":
        low = F.floor((n - 1) * F.lit(q))
        return low, F.least(low + 1, n - 1)
    if kind == "rounded":
        at = F.bround((n - 1) * F.lit(q), 0).cast("long")
        at = F.greatest(F.lit(0), F.least(at, n - 1))
        return at, at
    if kind == "exclusive":
        # q is the cut out of 20; the cut point may extrapolate beyond small samples.
        cut = F.lit(int(q)) * (n + 1)
        j = F.greatest(F.lit(1), F.least(F.floor(cut / 20), n - 1))
        return j - 1, F.least(j, n - 1)
    raise ValueError(f"unknown percentile definition {kind!r}")


def _value(spec: Spec, n: Column, low: Column, high: Column) -> Column:
    kind, q = spec
    if kind == "linear":
        position = (n - 1) * F.lit(q)
        share = position - F.floor(position)
        return low * (1 - share) + high * share
    if kind == "rounded":
        return low
    cut = F.lit(int(q)) * (n + 1)
    j = F.greatest(F.lit(1), F.least(F.floor(cut / 20), n - 1))
    delta = cut - 20 * j
    return F.when(n >= 2, (low * (20 - delta) + high * delta) / 20).otherwise(low)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    specs: Mapping[str, Spec],
    times: str | None = None,
) -> DataFrame:
    """One row per key with one double column per spec.

    Definitions: ("linear", q) interpolates between neighbours; ("rounded", q) takes the
    value at the half-even rounded index; ("exclusive", c) is cut c of 20 of the exclusive
    method. Nulls are ignored. `times` names a column of repeat counts.
    """
    keys = list(keys)
    weight = F.sum(times) if times else F.count("*")
    value_bin = _bin(F.col("_v"))
    left = stored(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(weight.alias("_n"))
        .select(*keys, "_v", "_n", value_bin.alias("_b"), F.lit(0).cast("long").alias("_before")),
        "counted-values",
    )
    totals = left.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    while True:
        # At most SPLITS bins of one group follow each other here, but for the first time.
        bins = left.groupBy(*keys, "_before", "_b").agg(
            F.sum("_n").alias("_in_bin"), F.count("*").alias("_distinct"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = Window.partitionBy(*keys, "_before").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_in_bin").over(upto), F.lit(0)))
        bins = _meet(bins, totals, keys)
        holds = F.lit(False)
        for rank in [rank for spec in specs.values() for rank in _ranks(spec, F.col("_total"))]:
            holds = holds | ((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_in_bin")))
        bins = stored(bins.where(holds).drop("_in_bin"), "rank-bins")
        inside = _meet(left, bins, [*keys, "_before", "_b"])
        most = bins.agg(F.max("_distinct")).first()[0]
        if most is None or most <= MOST:
            break
        # Halves keep the differences of very large values finite.
        share = F.try_divide(F.col("_v") / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2)
        place = F.floor(F.coalesce(share, F.lit(0.0)) * SPLITS)
        split = F.when(F.col("_distinct") > MOST, F.least(place, F.lit(SPLITS - 1))).otherwise(0)
        left = stored(
            inside.select(*keys, "_v", "_n", split.cast("long").alias("_b"), F.col("_start").alias("_before")), "split-values"
        )
    order = Window.partitionBy(*keys, "_start").orderBy("_v")
    inside = inside.withColumn("_last", F.col("_start") + F.sum("_n").over(order)).withColumn(
        "_first", F.col("_last") - F.col("_n")
    )
    picks = []
    for name, spec in specs.items():
        for side, rank in zip(("lo", "hi"), _ranks(spec, F.col("_total")), strict=True):
            hit = (rank >= F.col("_first")) & (rank < F.col("_last"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{side}"))
    found = inside.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    return found.select(
        *keys,
        *[
            _value(spec, F.col("_total"), F.col(f"_{name}_lo"), F.col(f"_{name}_hi")).alias(name)
            for name, spec in specs.items()
        ],
    )


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join where null keys meet null keys."""
    named = right.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r{key}"))
    return left.join(named, condition).drop(*[f"_r{key}" for key in keys])
