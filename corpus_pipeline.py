"""Corpus pipeline: documents in, packed sequences out. Each stage is written before the next reads it.

Stages: drop documents of low quality, drop toxic ones, keep one document of each group of near
duplicates, pack what is left. All but the last return the columns of documents, with their values,
whatever their names.

Null and empty texts are scored, kept apart by the near-dedup stage and packed as the operators say;
repeated rows are scored alike and count as near duplicates of each other; a null doc_id is a doc_id. An
empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import neardup, packing, quality, toxicity
from quillrank.session import scratch


def _with_own_columns(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage on doc_id and text, with the other columns under names that no operator uses."""
    hidden = [c if c in ("doc_id", "text") else f"own column {i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*hidden)).select(*[F.col(f"`{h}`").alias(c) for h, c in zip(hidden, docs.columns, strict=True)])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return _with_own_columns(docs, lambda d: quality.classify(d).where(F.col("quality_score") >= quality.THRESHOLD))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _with_own_columns(docs, lambda d: toxicity.score(d, labels).where(F.col("toxicity") < toxicity.THRESHOLD))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates (five words, 0.8)."""
    return _with_own_columns(docs, neardup.representatives)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths from the documents that are left."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", good_quality), ("toxicity", not_toxic), ("near-dedup", one_of_each), ("packing", packed),
]

# Classifiers and tokenizer are no SQL; tests compare stages with the operators' own decisions and ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
