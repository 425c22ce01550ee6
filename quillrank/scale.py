"""Helpers that keep joins and rankings safe when a key or a table is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; nothing runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_bytes(df: DataFrame) -> int:
    """The session's limit for broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(limit)


def join_sized(
    big: DataFrame, small: DataFrame, on: Sequence[str], *, how: str = "inner", bound: DataFrame | None = None
) -> DataFrame:
    """Join a table that is usually small onto one that is usually large and uneven.

    `small` is broadcast when the estimate of its bytes, or of `bound` (a table of as many rows
    at least, for which there is a better estimate), is within the session's limit. Else the
    join is left to the optimizer, and adaptive execution splits partitions of hot keys.
    """
    if estimated_bytes(small if bound is None else bound) <= broadcast_bytes(small):
        small = F.broadcast(small)
    return big.join(small, list(on), how)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
) -> DataFrame:
    """Best k rows per key. Spark cuts each task's rows to k per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: Column,
    spread_by: str,
    rank: str = "rank",
) -> DataFrame:
    """Best n rows per key where n is a column; a frequent key is first cut in as many parts as a shuffle has."""
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = part.withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= n).drop("_salt", rank)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)


def score_key(score: str | Column, digits: int = 9) -> Column:
    """Rounded score for ordering, so that summation order cannot decide a tie."""
    col = F.col(score) if isinstance(score, str) else score
    return F.round(col, digits).desc()


def spread(table: DataFrame) -> DataFrame:
    """Deal out a table of up to SPREAD_BYTES that was read in fewer splits than there are cores.

    Only for tables as read: on a derived frame the count of partitions could run its
    shuffles. Larger tables are left as they are, so no large table is moved for this. Rows are
    dealt round-robin: hashing them by a key would make Spark drop later exchanges on that key,
    which branches of one query share.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(table) > SPREAD_BYTES or table.rdd.getNumPartitions() >= 2 * cores:
        return table
    return table.repartition(cores)
