"""Readers and writers for text, JSON lines, run artifacts and turn logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank import scale

TURN_BUCKETS = 64
NO_DAY = "date=__HIVE_DEFAULT_PARTITION__"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, text): one row per .txt file, named by its stem. Names give the order.

    Folders named key=value become further columns.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    folders = [c for c in files.columns if c != "value"]
    return files.select(
        F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("chapter"), F.col("value").alias("text"), *folders
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, line_numbers: bool = False) -> DataFrame:
    """JSON lines without blank ones; line_number counts from 1 per file, blanks included.

    A line's number is its place inside its file block plus the lines of earlier blocks,
    so that a file may be read by many tasks.
    """
    if not line_numbers:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )
    blocks = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    earlier = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    numbered = lines.join(blocks, ["_f", "_b"]).where(F.trim("value") != "")
    return numbered.select(
        F.from_json("value", schema).alias("r"),
        (F.col("_m") - F.col("_first") + F.col("_before") + 1).alias("line_number"),
    ).select("r.*", "line_number")


def read_runs(spark: SparkSession, path: str, schema: T.StructType, name: str = "run.json") -> DataFrame:
    """Newest artifact per case_id: files found at any depth, unreadable ones skipped."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(full).json(
        path, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name, mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt_record",
    )
    kept = raw.withColumn("run_path", F.col("_metadata.file_path")).where(
        F.col("_corrupt_record").isNull() & F.col("case_id").isNotNull()
    ).drop("_corrupt_record")
    return last_by_path(kept)


def last_by_path(runs: DataFrame, key: str = "case_id", path: str = "run_path") -> DataFrame:
    """The row with the last path in sort order wins per key (a partial aggregate)."""
    columns = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*columns), path).alias("_r")).select(key, "_r.*")


def _bucket(business: Column, buckets: Column) -> Column:
    """Folder of a business; it states the count of buckets, so that a log may hold several counts."""
    number = F.pmod(F.xxhash64(business.cast("string")), buckets)
    return F.concat_ws("-of-", number.cast("string"), buckets.cast("string"))


def append_turns(
    turns: DataFrame, path: str, key: str = "business", order: Sequence[str] = ("turn_id",), buckets: int = TURN_BUCKETS
) -> None:
    """Append turn records as JSON, by day of created_at and, below that, by buckets of businesses.

    `name` is the time without its signs; further records of a business at the same time get _02, _03, ...
    Of what is stored, only the days and buckets of the new records are read for that. Records of one
    business and one time are numbered in one task. One writer at a time.
    """
    new = turns.withColumn("date", F.substring("created_at", 1, 10)).withColumn("bucket", _bucket(F.col(key), F.lit(buckets)))
    at = Window.partitionBy(key, "created_at").orderBy(*order)
    place = F.row_number().over(at)
    rows = new.withColumn("_place", place)
    stored = _turn_log(turns.sparkSession, path, f"{key} string, created_at string")
    if stored is not None:
        touched = new.select("date", "bucket").distinct()
        earlier = stored.join(touched, ["date", "bucket"], "left_semi").groupBy(
            F.col(key).alias("_key"), F.col("created_at").alias("_at")
        ).agg(F.count("*").alias("_before"))
        same = F.col(key).cast("string").eqNullSafe(F.col("_key")) & F.col("created_at").eqNullSafe(F.col("_at"))
        rows = rows.join(earlier, same, "left").withColumn("_place", F.col("_place") + F.coalesce("_before", F.lit(0)))
    suffix = F.when(F.col("_place") > 1, F.format_string("_%02d", F.col("_place").cast("long"))).otherwise("")
    named = rows.withColumn("name", F.concat(F.regexp_replace("created_at", "[-:Z]", ""), suffix))
    # One task writes a folder, so an append adds one file to each folder that it touches.
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.select(*turns.columns, "name", "date", "bucket").repartition(tasks, "date", "bucket")
    dealt.write.mode("append").partitionBy("date", "bucket").json(path)


def _turn_log(spark: SparkSession, path: str, schema: str, days: Sequence[str] = ()) -> DataFrame | None:
    """The stored records, of the given day folders if any are given; None where no log is."""
    paths = [f"{path}/{day}" for day in days] or path
    try:
        return spark.read.option("basePath", path).schema(f"{schema}, date string, bucket string").json(paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _day_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the day folders, newest first, that of records without a day last."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    return sorted((n for n in names if n.startswith("date=")), key=lambda n: (n != NO_DAY, n), reverse=True)


def read_newest_turns(
    spark: SparkSession, path: str, schema: str, business: object, limit: int, key: str = "business",
    order: Sequence[str] = ("created_at", "turn_id"),
) -> DataFrame:
    """The newest records of one business with their `name` and `newest`, 1 for the last one.

    Reads its bucket only, of the last day, then of four times as many days until there are enough records.
    """
    days, take = _day_folders(spark, path), 1
    full = f"{schema}, name string"
    if not days:
        return newest_turns(spark.createDataFrame([], full), limit, key, order)
    while True:
        log = _turn_log(spark, path, full, days[:take])
        counts = F.substring_index("bucket", "-of-", -1).cast("int")
        own = log.where((F.col("bucket") == _bucket(F.lit(business), counts)) & (F.col(key).cast("string") == str(business)))
        if take >= len(days) or own.limit(limit).count() >= limit:
            return newest_turns(own.drop("date", "bucket"), limit, key, order)
        take *= 4


def newest_turns(turns: DataFrame, limit: int, key: str = "business", order: Sequence[str] = ("created_at", "turn_id")) -> DataFrame:
    return scale.top_k(turns, [key], [F.col(c).desc() for c in order], limit, rank="newest")


def read_local_documents(spark: SparkSession, root: str, skip: str | None = None) -> DataFrame:
    """(path, text) for every file under root; undecodable bytes are replaced.

    `skip` is a folder name, such as a state folder, whose files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    kept = files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if skip:
        kept = kept.where(~F.array_contains(F.split("path", "/"), skip))
    return kept


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file under root, relative to it; nothing is read but names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1).alias("path"))


def explode_sessions(sessions: DataFrame, turns: str = "turns") -> DataFrame:
    """One row per turn of each session, numbered from 1."""
    rest = [c for c in sessions.columns if c != turns]
    return sessions.select(*rest, F.posexplode(turns).alias("_p", "turn")).withColumn(
        "turn_number", F.col("_p") + 1
    ).drop("_p")


def ingest_variants(cases: DataFrame, variants: DataFrame, model: str, version: str) -> DataFrame:
    """Query variants per case with provenance, or the reason why they are refused.

    variants: case_id, query_variants (array). Each case needs 2 to 4 non-empty variants.
    """
    j = cases.select("case_id", F.lit(True).alias("_c")).join(
        variants.withColumn("_v", F.lit(True)), "case_id", "full"
    )
    blank = F.exists("query_variants", lambda q: F.trim(F.coalesce(q, F.lit(""))) == "")
    return j.select(
        "case_id", "query_variants",
        F.lit(model).alias("generator_model"), F.lit(version).alias("prompt_version"),
        F.when(F.col("_c").isNull(), "unknown case").when(F.col("_v").isNull(), "missing case")
        .when(~F.size("query_variants").between(2, 4), "needs 2 to 4 variants")
        .when(blank, "empty variant").alias("error"),
    )


def select_cases(cases: DataFrame, ids: DataFrame | None = None, limit: int | None = None,
                 order: str = "line_number") -> tuple[DataFrame, DataFrame | None]:
    """(chosen cases, asked ids that do not exist), cut to the first `limit` in file order."""
    unknown = None
    chosen = cases
    if ids is not None:
        chosen = cases.join(ids.select("case_id"), "case_id", "left_semi")
        unknown = ids.select("case_id").join(cases.select("case_id"), "case_id", "left_anti")
    if limit is not None:
        chosen = chosen.orderBy(order).limit(limit)
    return chosen, unknown


def write_rows(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines with their fields in sorted order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.select(*sorted(summary.columns)).coalesce(1).write.mode("overwrite").json(path)
