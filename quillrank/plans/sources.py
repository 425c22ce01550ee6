"""Queries on readers, writers, case selection and streams.

A source query first writes rows of a driver table in the format it is about, to a fresh
path in the session's shared folder, and then reads that path back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import labels as J
from quillrank.plans.business import ASSIGNED, assignments
from quillrank.plans.registry import query, table
from quillrank.plans.traces import CHECKED, TURN_ERRORS, turns
from quillrank.session import scratch
from quillrank.sources import files as SF
from quillrank.streaming import turns as ST

SUPPLIERS_PER_TASK = 250


def text_files(spark, sf, name):
    """Documents as text files of at most 100 lines-of-record each, one folder per source."""
    path = scratch(spark, name)
    table(spark, sf, "documents").select("source", "text").write.partitionBy("source").option(
        "maxRecordsPerFile", 100
    ).text(path)
    return path


@query("S1_whole_text_scan", """
    SELECT source, (sum(length(text)) + count(*))::BIGINT AS chars FROM documents GROUP BY 1""")
def s1(spark, sf):
    return SF.read_texts(spark, text_files(spark, sf, "texts")).groupBy("source").agg(
        F.sum(F.length("text")).alias("chars")
    )


@query("S2_jsonl_scan", """
    SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total, TRUE AS numbered FROM events GROUP BY 1""")
def s2(spark, sf):
    path = scratch(spark, "jsonl")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    # Blank lines between records must be skipped but counted.
    e.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    rows = SF.read_jsonl(spark, path, "event_id long, event_type string, value double", line_numbers=True)
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.bool_and(F.col("line_number") % 2 == 1).alias("numbered")
    )


@query("S3_newest_run", """
    SELECT user_id AS case_id, 'runs/' || lpad(max(event_id)::VARCHAR, 12, '0') || '/run.json' AS run_path, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def s3(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.concat(F.lit("runs/"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit("/run.json")).alias("run_path"),
        "event_type",
    )
    return SF.last_by_path(runs)


@query("S3_run_artifacts", """
    WITH r AS (SELECT s_suppkey AS case_id, n, s_acctbal + n AS score FROM supplier, (VALUES (1), (2)) v(n) WHERE (s_suppkey + n) % 7 <> 0)
    SELECT case_id, arg_max(score, n) AS score FROM r GROUP BY 1""")
def s3_files(spark, sf):
    """Two runs per supplier, each a file of its own in the folder of its run; one in seven is cut off."""
    path, k, n = scratch(spark, "runs"), F.col("s_suppkey"), F.col("n")
    suppliers = table(spark, sf, "supplier")
    runs = suppliers.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    body = F.to_json(F.struct(k.alias("case_id"), (F.col("s_acctbal") + n).alias("score")))
    files = runs.select(n.alias("run"), F.when((k + n) % 7 == 0, F.substring(body, 1, 12)).otherwise(body).alias("value"))
    # Many small files: tasks write and commit them side by side, and no file needs a folder.
    files.repartition(-(-suppliers.count() // SUPPLIERS_PER_TASK) or 1).write.partitionBy("run").option("maxRecordsPerFile", 1).option(
        "mapreduce.fileoutputcommitter.algorithm.version", 2
    ).text(path)
    schema = spark.createDataFrame([], "case_id long, score double").schema
    return SF.read_runs(spark, path, schema, name="*.txt").select("case_id", "score")


@query("S5_turn_log_newest", """
    SELECT user_id AS business, event_id::VARCHAR AS turn_id, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%SZ') DESC, lpad(event_id::VARCHAR, 12, '0') DESC)::INTEGER AS newest FROM events QUALIFY newest <= 3""")
def s5(spark, sf):
    path = scratch(spark, "turns")
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("business"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("turn_id"),
    )
    SF.append_turns(log, path)
    stored = spark.read.schema("business long, created_at string, turn_id string").json(path)
    return SF.newest_turns(stored, 3).select(
        "business", F.col("turn_id").cast("long").cast("string").alias("turn_id"), "newest"
    )


def day_log(spark, sf):
    """A turn log whose times are whole days, so that names collide; odd ids come with a second append."""
    path, n = scratch(spark, "days"), F.col("event_id")
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("business"), F.date_format("ts", "yyyy-MM-dd'T00:00:00Z'").alias("created_at"),
        F.lpad(n.cast("string"), 12, "0").alias("turn_id"), (n % 2).alias("odd"),
    )
    for odd in (0, 1):
        SF.append_turns(log.where(F.col("odd") == odd).drop("odd"), path)
    return path


DAY_LOG = """
    WITH t AS (SELECT user_id, event_id, strftime(ts, '%Y%m%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY event_id % 2, event_id) AS i FROM events),
    named AS (SELECT user_id AS business, event_id AS turn_id, day || 'T000000' || CASE WHEN i > 1 THEN '_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i ELSE '' END AS name, day FROM t)"""
TURN = "business long, created_at string, turn_id string"


@query("S5_turn_log_names", f"{DAY_LOG} SELECT business, turn_id, name FROM named")
def s5_names(spark, sf):
    log = spark.read.schema(f"{TURN}, name string").json(day_log(spark, sf))
    return log.select("business", F.col("turn_id").cast("long").alias("turn_id"), "name")


@query("S5_newest_of_business", f"""{DAY_LOG}
    SELECT business, turn_id, name, row_number() OVER (ORDER BY day DESC, turn_id DESC)::INTEGER AS newest
    FROM named WHERE business = (SELECT max(user_id) FROM events) QUALIFY newest <= 20""")
def s5_business(spark, sf):
    last = table(spark, sf, "events").agg(F.max("user_id")).first()[0]
    found = SF.read_newest_turns(spark, day_log(spark, sf), TURN, last, 20)
    return found.select("business", F.col("turn_id").cast("long").alias("turn_id"), "name", "newest")


@query("S8_local_documents", """
    SELECT source, (sum(octet_length(encode(text))) + count(*))::BIGINT AS bytes FROM documents WHERE source <> 'src0' GROUP BY 1""")
def s8(spark, sf):
    found = SF.read_local_documents(spark, text_files(spark, sf, "docs"), skip="source=src0")
    return found.where(F.endswith("path", F.lit(".txt"))).groupBy(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    ).agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("S9_session_turns", """
    SELECT doc_id, i::INTEGER AS turn_number, md5(l) AS turn_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def s9(spark, sf):
    sessions = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("turns"))
    return SF.explode_sessions(sessions).select("doc_id", "turn_number", F.md5("turn").alias("turn_md5"))


@query("S10_query_variants", """
    WITH c AS (SELECT doc_id AS case_id FROM documents WHERE lang <> 'de'), v AS (SELECT doc_id AS case_id, string_split(text, chr(10)) AS q FROM documents WHERE source <> 'src1')
    SELECT coalesce(c.case_id, v.case_id) AS case_id, CASE WHEN c.case_id IS NULL THEN 'unknown case' WHEN v.case_id IS NULL THEN 'missing case' WHEN len(q) NOT BETWEEN 2 AND 4 THEN 'needs 2 to 4 variants'
      WHEN len(list_filter(q, lambda x: trim(x) = '')) > 0 THEN 'empty variant' END AS error, 'writer-1' AS generator_model FROM c FULL JOIN v ON c.case_id = v.case_id""")
def s10(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "case_id")
    variants = d.where(F.col("source") != "src1").select("case_id", F.split("text", "\n").alias("query_variants"))
    return SF.ingest_variants(d.where(F.col("lang") != "de"), variants, "writer-1", "v1").select("case_id", "error", "generator_model")


@query("S11_result_sink", """
    SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def s11(spark, sf):
    path = scratch(spark, "rows")
    SF.write_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    back = spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").json(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("S11_summary_sink", """
    SELECT count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders""")
def s11_summary(spark, sf):
    path = scratch(spark, "summary")
    o = table(spark, sf, "orders").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    SF.write_summary(o, path)
    return spark.read.schema("n long, total double").json(path)


@query("B1_case_limit", "SELECT doc_id AS case_id FROM documents ORDER BY doc_id DESC LIMIT 50")
def b1_limit(spark, sf):
    cases = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), (-F.col("doc_id")).alias("line_number"))
    return SF.select_cases(cases, limit=50)[0].select("case_id")


@query("B1_case_selection", """
    SELECT 'chosen' AS kind, doc_id AS case_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'unknown', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def b1(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"))
    chosen, unknown = SF.select_cases(table(spark, sf, "documents").withColumnRenamed("doc_id", "case_id"), ids)
    return chosen.select(F.lit("chosen").alias("kind"), "case_id").unionByName(unknown.select(F.lit("unknown").alias("kind"), "case_id"))


@query("B3_label_status_filter", "SELECT doc_id, CASE quality WHEN 1 THEN 'accepted' ELSE 'proposed' END AS status FROM labels WHERE toxic = 0")
def b3(spark, sf):
    rows = table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("proposed").alias("status"),
        F.when(F.col("toxic") == 0, F.array("doc_id")).otherwise(F.array().cast("array<bigint>")).alias("supporting"),
    )
    return J.label_filter(rows, ["accepted", "proposed"]).select("doc_id", "status")


@query("B4_result_row_filters", """
    SELECT event_id, value AS score FROM events WHERE value > 0 AND event_type <> 'error' AND user_id % 2 = 0""")
def b4(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("score"), F.when(F.col("event_type") == "error", "failed").alias("error"),
        (F.col("user_id") % 2 == 0).alias("valid"),
    )
    return rows.where((F.col("score") > 0) & F.col("error").isNull() & F.col("valid")).select("event_id", "score")


@query("R1_turn_stream", f"""
    WITH {CHECKED} SELECT event_id::VARCHAR AS turn_id, ({TURN_ERRORS}) = 0 AS valid, ({TURN_ERRORS})::INTEGER AS errors FROM c""")
def r1(spark, sf):
    """Turns as a stream of files: validated, split, and read back from both sinks."""
    base = scratch(spark, "stream")
    turns(spark, sf).drop("kind", "k").write.json(f"{base}/in")
    run = ST.validate_stream(ST.read_turns(spark, f"{base}/in"), f"{base}/valid", f"{base}/rejected", f"{base}/state")
    run.awaitTermination()
    schema = "turn_id string, errors array<string>, valid boolean"
    both = spark.read.schema(schema).json(f"{base}/valid").unionByName(spark.read.schema(schema).json(f"{base}/rejected"))
    return both.select("turn_id", "valid", F.coalesce(F.size("errors"), F.lit(0)).alias("errors"))


@query("R2_snapshot_stream", f"""
    WITH {ASSIGNED} SELECT business, field, seq, value, source_type FROM l""")
def r2(spark, sf):
    """Field assignments as a stream that starts three times: late rows, repeated rows, compactions."""
    base = scratch(spark, "stream")
    rows = assignments(spark, sf)
    parts = (F.col("seq") % 3 > 0, F.col("seq") % 3 == 0, F.col("seq") % 4 == 0)
    for number, part in enumerate(parts):
        rows.where(part).repartition(3, "seq").write.mode("append").json(f"{base}/in")
        stream = ST.read_assignments(spark, f"{base}/in", files_per_trigger=2)
        ST.snapshot_state(stream, f"{base}/out", f"{base}/state", compact_every=2).awaitTermination()
        if number == 1:
            ST.expire(spark, f"{base}/out")
    return ST.read_state(spark, f"{base}/out").select(
        F.col("business").cast("long").alias("business"), "field", "seq", "value", "source_type"
    )
