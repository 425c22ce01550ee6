"""Bounded samples of texts for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 62


def sample_texts(texts: DataFrame, limit: int) -> DataFrame:
    """Up to `limit` distinct texts of the column `text`, those of the smallest hashes.

    A share of the hash values is cut off first, by the count of rows, so about 1.5 times `limit`
    rows and the copies of these texts meet, and copies are merged before anything moves.
    Few enough rows are all taken. Null counts as empty.
    """
    rows = texts.count()
    cut = SPAN if rows <= 2 * limit else int(SPAN * (1.5 * limit / rows))
    text = F.coalesce("text", F.lit(""))
    few = texts.select(F.pmod(F.xxhash64(text), F.lit(SPAN)).alias("hash"), text.alias("text")).where(F.col("hash") < cut)
    return few.groupBy("hash").agg(F.first("text").alias("text")).orderBy("hash").limit(limit).select("text")
