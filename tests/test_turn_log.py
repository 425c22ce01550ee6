"""The turn log's folders, names and the reader of one business."""

from pyspark.sql import functions as F

from quillrank.sources import files as SF

SCHEMA = "business string, created_at string, turn_id string"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_names_go_on_over_appends(spark, tmp_path):
    path, at = str(tmp_path / "log"), "2024-03-01T10:00:00Z"
    SF.append_turns(log(spark, [("a", at, "1"), ("a", at, "2"), ("b", at, "1"), (None, at, "9")]), path)
    SF.append_turns(log(spark, [("a", at, "3"), (None, at, "8"), ("b", "2024-03-01T10:00:01Z", "2")]), path)
    rows = spark.read.schema(f"{SCHEMA}, name string").json(path).collect()
    assert {(r.business, r.turn_id): r.name for r in rows} == {
        ("a", "1"): "20240301T100000", ("a", "2"): "20240301T100000_02", ("a", "3"): "20240301T100000_03",
        ("b", "1"): "20240301T100000", ("b", "2"): "20240301T100001", (None, "9"): "20240301T100000",
        (None, "8"): "20240301T100000_02",
    }


def test_newest_of_one_business_reads_the_last_days(spark, tmp_path):
    path = str(tmp_path / "log")
    days = spark.range(1, 29).select(F.format_string("2024-02-%02dT08:00:00Z", "id").alias("created_at"))
    turns = days.crossJoin(spark.range(20).select(F.col("id").cast("string").alias("business"))).withColumn("turn_id", F.lit("1"))
    SF.append_turns(turns.select("business", "created_at", "turn_id"), path, buckets=8)
    SF.append_turns(log(spark, [("7", "2024-02-27T09:00:00Z", "2"), ("7", None, "3")]), path, buckets=4)
    found = SF.read_newest_turns(spark, path, SCHEMA, "7", 3)
    assert [(r.created_at, r.newest) for r in found.orderBy("newest").collect()] == [
        ("2024-02-28T08:00:00Z", 1), ("2024-02-27T09:00:00Z", 2), ("2024-02-27T08:00:00Z", 3),
    ]
    assert len({f.split("date=")[1].split("/")[0] for f in found.inputFiles()}) == 4
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().toString()
    assert SF.read_newest_turns(spark, path, SCHEMA, "7", 100).count() == 30
    assert SF.read_newest_turns(spark, path, SCHEMA, "absent", 3).count() == 0
    assert SF.read_newest_turns(spark, str(tmp_path / "none"), SCHEMA, "7", 3).count() == 0


def test_run_artifacts_need_no_folder_each(spark, tmp_path):
    from quillrank.plans import sources as P

    rows = [(n, 10.0 * n) for n in (1, 5, 6, 8, 600)] + [(n, 1.0) for n in range(1000, 1400)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    found = P.s3_files(spark, str(tmp_path))
    # The last run that is whole: run 2, or run 1 where (key + 2) % 7 is 0.
    assert {r.case_id: r.score for r in found.collect()} == {k: b + (1 if (k + 2) % 7 == 0 else 2) for k, b in rows}
    files = found.inputFiles()
    assert len(files) == 2 * len(rows)
    assert len({f.rsplit("/", 1)[0] for f in files}) == 2
