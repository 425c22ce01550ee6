"""Registered queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillrank import scale

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Tables with long texts or vectors, whose rows are worth spreading over all cores.
HEAVY = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scale.spread(rows) if name in HEAVY else rows


# Pieces of oracle SQL.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_tokens(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[a-z0-9][a-z0-9-]*')"


def sql_words(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '{SPACES}+'), lambda w: w <> '')"
