"""Sharding (operator 8): a hypergeometric communication matrix, in built-in functions only.

Rows lie in `partitions` source parts of bounded size. A matrix of counts, part by shard, is
drawn first: given the sizes of parts and shards, the counts of a uniformly random shuffle
follow a multivariate hypergeometric law, drawn here by halving the list of parts. Then rows
are permuted inside each part, dealt to the shards by the counts, exchanged, and permuted again
inside each shard. The result is a uniform shuffle whose shard sizes are exact: any two shards
differ by one row at most.

Rows are placed by a row number, so equal texts, one hot source, repeated doc_ids or repeated
rows weigh nothing: each row counts for itself. Nulls in any column travel along. An empty
table gives no rows. Columns of the input with names that the operator needs are kept: its own
are renamed by the caller (`shard_col`, `slot_col`), the rest start with an underscore pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.session import stored

SHARDS = 16
PART_ROWS = 1 << 14
SPREAD = 12  # standard deviations of a count that are looked at; the rest weighs under 1e-30


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _steps(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))


def _hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """A count of marked items among `drawn` of `total`, for a uniform `u`, by inversion.

    Weights start with 1 at the mode and follow the ratio of neighbouring probabilities, first
    upwards, then downwards, so that no factorial is needed.
    """
    share = marked.cast("double") / F.greatest(total, F.lit(1))
    sd = F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    low, high = F.greatest(F.lit(0).cast("long"), drawn - total + marked), F.least(drawn, marked)
    mode = F.floor((drawn + 1).cast("double") * (marked + 1) / (total + 2)).cast("long")

    def draw(x: Column) -> Column:
        far = F.ceil(SPREAD * x.sd + 10).cast("long")
        up, down = F.least(x.high - x.mode, far), F.least(x.mode - x.low, far)

        def ratio(k: Column) -> Column:  # weight of k + 1 by weight of k
            above = (marked - k).cast("double") * (drawn - k)
            return above / ((k + 1).cast("double") * (total - marked - drawn + k + 1))

        def run(n: Column, factor: Callable[[Column], Column], first: Column, until: Column) -> Column:
            """w: last weight, s: sum of weights, n: weights before the sum reaches `until`."""
            start = F.struct(F.lit(1.0).alias("w"), first.alias("s"), F.lit(0).cast("long").alias("n"))

            def step(a: Column, i: Column) -> Column:
                w = a.w * factor(i)
                return F.struct(w.alias("w"), (a.s + w).alias("s"), (a.n + (a.s < until).cast("long")).alias("n"))

            return F.aggregate(_steps(n), start, step)

        def upwards(until: Column) -> Column:
            return run(up, lambda i: ratio(x.mode + i - 1), F.lit(1.0), until)

        def downwards(until: Column) -> Column:
            return run(down, lambda i: 1 / ratio(x.mode - i), F.lit(0.0), until)

        sums = F.struct(upwards(F.lit(0.0)).s.alias("up"), downwards(F.lit(0.0)).s.alias("down"))
        return _let(
            sums,
            lambda s: _let(
                u * (s.up + s.down),
                lambda t: F.when(t <= s.up, x.mode + upwards(t).n).otherwise(
                    x.mode - F.greatest(F.lit(1).cast("long"), downwards(t - s.up).n)
                ),
            ),
        )

    return _let(
        F.struct(
            F.greatest(low, F.least(high, mode)).alias("mode"), low.alias("low"), high.alias("high"), sd.alias("sd")
        ),
        draw,
    )


def _uniform(*what: Column) -> Column:
    return F.pmod(F.xxhash64(*what), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _draw_row(room: Column, drawn: Column, shards: int, key: Column) -> Column:
    """How many of `drawn` rows go to each shard, given the free places of each."""
    start = F.struct(
        drawn.alias("left"),
        F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array().cast("array<long>").alias("counts"),
    )

    def step(a: Column, s: Column) -> Column:
        here = F.get(room, s)
        return _let(
            _hypergeometric(here, a.total, a.left, _uniform(key, s)),
            lambda x: F.struct(
                (a.left - x).alias("left"),
                (a.total - here).alias("total"),
                F.concat(a.counts, F.array(x)).alias("counts"),
            ),
        )

    places = F.sequence(F.lit(0), F.lit(shards - 1))
    return F.aggregate(places, start, step, lambda a: a.counts)


def communication_matrix(sizes: DataFrame, depth: int, room: list[int], seed: int) -> DataFrame:
    """Counts of rows that each part sends to each shard: (_part, _counts array).

    `sizes` holds (_part, _rows) for parts 0 to 2**depth - 1; parts without rows may be absent.
    Each level of the tree splits the rows of a node between its two halves of the parts. The
    table has one row per part, and parts grow in number with the rows by PART_ROWS.
    """
    shards = len(room)
    filled = F.aggregate(
        F.transform(F.col("_sizes"), lambda x: x._rows), F.lit(0).cast("long"), lambda a, x: a + x
    )
    nodes = sizes.agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("_part").cast("long").alias("_part"), F.col("_rows").cast("long").alias("_rows"))
            )
        ).alias("_sizes")
    ).select(
        F.lit(0).cast("long").alias("_node"), "_sizes",
        F.array(*[F.lit(n).cast("long") for n in room]).alias("_counts"),
    )
    for level in range(depth):
        middle = (2 * F.col("_node") + 1) * F.lit(1 << (depth - level - 1)).cast("long")
        nodes = (
            nodes.withColumn("_first", F.filter("_sizes", lambda x: x._part < middle))
            .withColumn("_second", F.filter("_sizes", lambda x: x._part >= middle))
            .withColumn("_drawn", F.aggregate("_first", F.lit(0).cast("long"), lambda a, x: a + x._rows))
            .withColumn(
                "_given",
                _draw_row(F.col("_counts"), F.col("_drawn"), shards, F.xxhash64(F.lit(seed), F.lit(level), "_node")),
            )
            .select(
                F.explode(
                    F.array(
                        F.struct(
                            (2 * F.col("_node")).alias("_node"), F.col("_first").alias("_sizes"),
                            F.col("_given").alias("_counts"),
                        ),
                        F.struct(
                            (2 * F.col("_node") + 1).alias("_node"), F.col("_second").alias("_sizes"),
                            F.zip_with("_counts", "_given", lambda a, b: a - b).alias("_counts"),
                        ),
                    )
                ).alias("_n")
            )
            .select("_n.*")
            .where(F.size("_sizes") > 0)
        )
    return nodes.where(filled > 0).select(F.col("_node").alias("_part"), "_counts")


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_to_shards(
    rows: DataFrame,
    shards: int = SHARDS,
    *,
    seed: int = 20260101,
    part_rows: int = PART_ROWS,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """`rows` with a shard and a slot in the shard (from 0, without gaps)."""
    # Written once: all later steps must see the same row numbers, also after a lost executor.
    numbered = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    total = numbered.count()
    depth = max(0, math.ceil(math.log2(max(1, total / part_rows))))
    room = shard_sizes(total, shards)
    dealt = numbered.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), "__row"), F.lit(1 << depth)))
    sizes = dealt.groupBy(F.col("__part").alias("_part")).agg(F.count("*").alias("_rows"))
    matrix = communication_matrix(sizes, depth, room, seed).select(
        F.col("_part").alias("__part"),
        F.transform(
            F.sequence(F.lit(1), F.lit(shards)),
            lambda k: F.aggregate(F.slice("_counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x),
        ).alias("__ends"),
    )
    # Permute inside each part and deal by the counts.
    inside = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), "__row"), "__row")
    sent = (
        dealt.withColumn("__place", F.row_number().over(inside) - 1)
        .join(matrix, "__part")
        .withColumn("__shard", F.size(F.filter("__ends", lambda end: end <= F.col("__place"))))
    )
    # Permute inside each shard: the order of a random key, cut into blocks that one task can sort.
    blocks = max(1, math.ceil(total / shards / part_rows))
    key = _uniform(F.lit(seed + 2), F.col("__row"))
    sent = sent.withColumn("__key", key).withColumn("__block", F.floor(F.col("__key") * blocks))
    before = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sent.groupBy("__shard", "__block").agg(F.count("*").alias("__n"))
        .select("__shard", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    order = Window.partitionBy("__shard", "__block").orderBy("__key", "__row")
    placed = sent.withColumn("__slot", F.row_number().over(order) - 1).join(offsets, ["__shard", "__block"])
    return placed.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col("__shard").cast("int").alias(shard_col),
        (F.col("__slot") + F.col("__offset")).cast("long").alias(slot_col),
    )
