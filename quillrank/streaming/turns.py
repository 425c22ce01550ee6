"""Turn logs and field assignments as streams of files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillrank.operators.snapshot import latest_assignments
from quillrank.operators.traces import TURN_SCHEMA, validate_turns

ASSIGNMENT_SCHEMA = (
    "business string, seq long, field string, value string, source_type string, source string, source_hash string"
)
POINTER_SCHEMA = "upto long, path string"
# What is there now, then stop. Other triggers: {"processingTime": "1 minute"}, {"once": True}.
AVAILABLE: Mapping[str, object] = {"availableNow": True}


def read_turns(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def validate_stream(
    turns: DataFrame, valid_path: str, rejected_path: str, checkpoint: str, trigger: Mapping[str, object] = AVAILABLE
) -> StreamingQuery:
    """Write each batch's valid and rejected turns; a replayed batch overwrites its own files."""
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate_turns(batch).withColumn("batch", F.lit(batch_id))
        checked.persist()
        try:
            for flag, path in ((True, valid_path), (False, rejected_path)):
                checked.where(F.col("valid") == flag).write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic"
                ).partitionBy("batch").json(path)
        finally:
            checked.unpersist()

    return (
        turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def read_assignments(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(ASSIGNMENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def snapshot_state(
    assignments: DataFrame,
    sink: str,
    checkpoint: str,
    trigger: Mapping[str, object] = AVAILABLE,
    compact_every: int = 100,
) -> StreamingQuery:
    """Keep the last value per (business, field) by seq, so that replays change nothing.

    The operator's state holds one row per field. Each trigger writes the fields it changed below
    `sink`/changes, and every `compact_every` triggers `compact` folds them into one table; `read_state`
    gives the current value per field. A replayed batch overwrites its own changes.
    """
    latest = latest_assignments(assignments)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(f"{sink}/changes")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, sink, batch_id)

    return (
        latest.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, empty where nothing is written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _generation(spark: SparkSession, sink: str) -> tuple[int, str | None]:
    """The last compacted batch, and where its table is."""
    newest = _there(spark, f"{sink}/pointer", POINTER_SCHEMA).agg(F.max(F.struct("upto", "path")).alias("p")).first().p
    return (newest.upto, newest.path) if newest else (-1, None)


def _since(spark: SparkSession, sink: str, upto: int, path: str | None) -> DataFrame:
    """The compacted rows and the changes of later batches; folders of earlier batches are not read."""
    changes = _there(spark, f"{sink}/changes", f"{ASSIGNMENT_SCHEMA}, batch long").where(F.col("batch") > upto)
    if path is None:
        return changes
    return changes.unionByName(spark.read.schema(ASSIGNMENT_SCHEMA).parquet(path).withColumn("batch", F.lit(upto).cast("long")))


def compact(spark: SparkSession, sink: str, upto: int) -> None:
    """Fold the changes up to a batch into a new table.

    The table has a fresh name, and a row of `pointer` names it once it is whole, so readers see the old
    table or the new one, and a compaction that is lost or repeated changes nothing.
    """
    last, path = _generation(spark, sink)
    if upto <= last:
        return
    state = latest_assignments(_since(spark, sink, last, path).where(F.col("batch") <= upto).drop("batch"))
    made = f"{sink}/generations/{upto}-{uuid.uuid4().hex}"
    state.write.parquet(made)
    pointer = spark.range(1).select(F.lit(upto).cast("long").alias("upto"), F.lit(made).alias("path"))
    pointer.write.mode("append").parquet(f"{sink}/pointer")


def read_state(spark: SparkSession, sink: str) -> DataFrame:
    """Current value per (business, field): the newest compacted table and the changes since."""
    return latest_assignments(_since(spark, sink, *_generation(spark, sink)).drop("batch"))


def expire(spark: SparkSession, sink: str) -> int:
    """Delete changes that the newest compacted table holds, and older tables; the number of folders deleted.

    Run it when no reader still uses an older table.
    """
    upto, path = _generation(spark, sink)
    if path is None:
        return 0
    base = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    done = 0
    for folder in ("changes", "generations"):
        under = spark._jvm.org.apache.hadoop.fs.Path(base, folder)
        for found in files.listStatus(under) if files.exists(under) else ():
            name = found.getPath().getName()
            old = name.startswith("batch=") and int(name[6:]) <= upto if folder == "changes" else not path.endswith(f"/{name}")
            if old:
                files.delete(found.getPath(), True)
                done += 1
    return done


def current_state(changes: DataFrame) -> DataFrame:
    """Current value per (business, field) from a table of changes."""
    return latest_assignments(changes.drop("batch"))
