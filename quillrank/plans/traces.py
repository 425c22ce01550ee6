"""Queries on turn logs, agent runs, audits and event matching.

Stand-ins: every event row is one turn, case or run. Its actions, searches, calculations
and citations follow from its type, its value and the number k in its props, so that each
rule of the validators is broken by some rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillrank.operators import metrics as M
from quillrank.operators import traces as T
from quillrank.plans.registry import query, table

EV = "(SELECT *, json_extract(props, '$.k')::INT AS k FROM events)"
# Every second event repeats the case_id of the one before; some have none, which is one key.
CASE_EV = f"(SELECT *, row_number() OVER (PARTITION BY CASE WHEN k % 31 <> 0 THEN event_id // 2 END ORDER BY event_id) > 1 AS dup FROM {EV})"
STRINGS = "array<string>"


def events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def none(kind=STRINGS):
    return F.array().cast(kind)


def strings(*values):
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])


def text(prefix, col):
    return F.concat(F.lit(prefix), col.cast("string"))


CHUNKS = "array<struct<id:string,score:double>>"
SEARCHES = (
    "array<struct<search_request:map<string,string>,queries:array<string>,query:string,"
    f"retrieval_backend:string,chunks:{CHUNKS}>>"
)
SUMS = "array<struct<metric:string,inputs:map<string,double>,value:double>>"


def turns(spark, sf):
    e = events(spark, sf)
    k, kind = F.col("k"), F.col("event_type")
    message = F.when(k == 0, "  ").otherwise(text("question ", k))
    request = F.map_concat(
        F.create_map(
            F.lit("intent"), F.when(k % 20 == 1, "other").otherwise("teaching_evidence"), F.lit("user_turn"), message,
            F.lit("query"), text("find  ", k),
        ),
        F.when(k % 25 == 2, F.create_map(F.lit("top_k"), F.lit("5"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    chunk = lambda c: F.struct(text("src:", c).alias("id"), F.lit(1.0).alias("score"))
    search = F.struct(
        request.alias("search_request"), F.when(k % 15 == 3, strings("x")).otherwise(F.array(text("Find ", k))).alias("queries"),
        F.lit(None).cast("string").alias("query"), F.when(k % 2 == 0, "hybrid").otherwise("bm25").alias("retrieval_backend"),
        F.when(k % 12 == 4, none(CHUNKS)).otherwise(F.array(chunk(k), chunk(k + 1))).alias("chunks"),
    )
    customers = k % 6
    total = F.col("value") * 10
    right = F.when(customers > 0, total / customers).otherwise(1.0)
    calc = F.struct(
        F.lit("cac").alias("metric"),
        F.create_map(F.lit("total_acquisition_cost"), total, F.lit("new_customers"), customers.cast("double")).alias("inputs"),
        (right + F.when(k % 9 == 0, 1.0).otherwise(0.0)).alias("value"),
    )
    return e.select(
        F.col("event_id").cast("string").alias("turn_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        message.alias("user_message"), F.lit("answer").alias("assistant_message"),
        F.when(kind == "view", strings("search_source_material", "answer")).when(kind == "click", strings("answer"))
        .when(kind == "purchase", strings("calculate", "answer"))
        .when(kind == "error", F.when(k % 10 == 0, strings("answer", "bogus")).otherwise(strings("diagnose")))
        .otherwise(strings("clarify")).alias("actions"),
        F.when(kind == "view", F.array(search)).otherwise(none(SEARCHES)).cast(SEARCHES).alias("source_events"),
        F.when((kind == "purchase") & (k % 7 != 1), F.array(calc)).otherwise(none(SUMS)).cast(SUMS).alias("calculation_events"),
        F.when(kind == "view", F.when(k % 8 == 5, strings("other:1")).when(k % 8 == 6, none()).otherwise(F.array(text("src:", k), text("src:", k))))
        .otherwise(none()).alias("cited_chunk_ids"),
        F.struct(
            F.when(k % 16 == 5, strings("other:1")).alias("external_cited_chunk_ids"), F.lit(None).cast("boolean").alias("failed_search")
        ).alias("metadata"),
        kind.alias("kind"), "k",
    )


CHECKED = f"""c AS (SELECT *,
    (event_type = 'view' AND k % 20 = 1)::INT + (event_type = 'view' AND k = 0)::INT + (event_type = 'view' AND k % 25 = 2)::INT + (event_type = 'view' AND k % 15 = 3)::INT + (event_type = 'view' AND k % 12 = 4)::INT AS search_errors,
    CASE WHEN event_type = 'purchase' AND k % 7 <> 1 THEN CASE WHEN k % 6 = 0 THEN 'invalid inputs: new_customers must be greater than zero' WHEN k % 9 = 0 THEN 'value does not match the recomputed result' END END AS calc_error,
    event_type = 'view' AND ((k % 8 = 5 AND k % 16 <> 5) OR (k % 8 NOT IN (5, 6) AND k % 12 = 4)) AS lost
    FROM {EV})"""

TURN_ERRORS = """search_errors + (calc_error IS NOT NULL)::INT + lost::INT + (k = 0)::INT + (event_type = 'error' AND k % 10 = 0)::INT + (event_type = 'purchase' AND k % 7 = 1)::INT"""


@query("T1_turn_validation", f"""
    WITH {CHECKED} SELECT event_id::VARCHAR AS turn_id, ({TURN_ERRORS})::INTEGER AS errors, ({TURN_ERRORS}) = 0 AS valid,
      (event_type = 'view' AND k % 12 <> 4 AND k % 8 = 6)::INTEGER AS warnings, CASE WHEN event_type = 'view' AND k % 8 <> 6 THEN 1 ELSE 0 END AS citations FROM c""")
def t1(spark, sf):
    return T.validate_turns(turns(spark, sf)).select(
        "turn_id", F.size("errors").alias("errors"), "valid", F.size("warnings").alias("warnings"), F.size("cited_chunk_ids").alias("citations")
    )


@query("T2_source_event_contract", f"""
    WITH x AS (SELECT k, unnest(list_filter([CASE WHEN k % 20 = 1 THEN 'unknown intent' END, CASE WHEN k = 0 THEN 'user_turn must be non-empty' END, CASE WHEN k % 25 = 2 THEN 'unsupported fields: top_k' END,
        CASE WHEN k % 15 = 3 THEN 'queries must contain exactly the requested query' END, CASE WHEN k % 12 = 4 THEN 'requires non-empty chunks list' END], lambda r: r IS NOT NULL)) AS reason FROM {EV} WHERE event_type = 'view')
    SELECT reason, count(*)::BIGINT AS cases FROM x GROUP BY 1""")
def t2(spark, sf):
    found = turns(spark, sf).select(F.explode("source_events").alias("e")).withColumn("failure_reasons", T.source_event_errors(F.col("e")))
    return M.failure_modes(found)


@query("T3_citation_provenance", f"WITH {CHECKED} SELECT event_id::VARCHAR AS turn_id, CASE WHEN k % 8 = 5 THEN 'other:1' ELSE 'src:' || k END AS missing FROM c WHERE lost")
def t3(spark, sf):
    lost = T.missing_citations(
        F.array_distinct("cited_chunk_ids"), T.inspected_ids(F.col("source_events")), F.col("metadata.external_cited_chunk_ids")
    )
    return turns(spark, sf).select("turn_id", F.explode(lost).alias("missing"))


@query("T4_calculation_recompute", f"WITH {CHECKED} SELECT event_id::VARCHAR AS turn_id, calc_error AS error FROM c WHERE event_type = 'purchase' AND k % 7 <> 1")
def t4(spark, sf):
    sums = turns(spark, sf).select("turn_id", F.explode("calculation_events").alias("e"))
    return sums.select("turn_id", T.calculation_error(F.col("e")).alias("error"))


def case_key():
    return F.when(F.col("k") % 31 != 0, F.floor(F.col("event_id") / 2)).alias("case_id")


def fixture_path():
    return F.when(F.col("k") % 5 != 0, F.concat(F.lit("f"), (F.col("k") % 7).cast("string"))).alias("snapshot_fixture_path")


def fixture_files(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey < 4").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"))


def cases(spark, sf):
    """Action cases: two events share a case_id, so every second one is a duplicate."""
    k = F.col("k")
    return events(spark, sf).select(
        case_key(), F.col("event_id").alias("line"), fixture_path(),
        F.when(k % 5 == 0, strings("search_source_material", "calculate")).when(k % 5 == 1, strings("clarify", "dance")).otherwise(strings("calculate")).alias("required_actions"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(strings("answer_without_tool", "calculate")).alias("allowed_actions"),
        F.when(k % 3 == 0, strings("search_source_material")).when(k % 3 == 1, strings("diagnose", "calculate")).otherwise(none()).alias("forbidden_actions"),
        F.when(k % 13 == 0, "sing").otherwise("calculate").alias("expected_first_action"),
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("search_allowed"), F.when(k % 6 == 0, "high").otherwise("low").alias("ambiguity"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(
            F.array(F.struct(F.when(k % 19 == 0, " ").otherwise("job").alias("job"), F.when(k % 23 == 0, none("array<array<string>>")).otherwise(F.array(strings("upsell"), F.when(k % 29 == 0, none()).otherwise(strings("gross profit")))).alias("concepts")))
        ).alias("expected_source_events"),
        F.when(k % 8 == 0, F.array_except(strings(*T.K.ACTION_CASE_FIELDS, *T.K.SOURCE_CASE_FIELDS), strings("user_turn", "ambiguity")))
        .otherwise(strings(*T.K.ACTION_CASE_FIELDS, *T.K.SOURCE_CASE_FIELDS)).alias("fields"),
    )


def exploded(df):
    return df.select("line", F.explode("errors").alias("error"))


@query("T5_action_case_rules", f"""
    SELECT event_id AS line, unnest(list_filter([CASE WHEN k % 8 = 0 THEN 'missing fields: ambiguity, user_turn' END, CASE WHEN dup THEN 'duplicate case_id' END, CASE WHEN k % 5 = 1 THEN 'unknown required_actions: dance' END, CASE WHEN k % 11 = 0 THEN 'allowed_actions must be a list' END,
      CASE WHEN k % 13 = 0 THEN 'unknown expected_first_action' END,
      CASE WHEN k % 5 = 0 AND k % 3 = 0 THEN 'both required and forbidden: search_source_material' WHEN k % 5 <> 1 AND k % 3 = 1 THEN 'both required and forbidden: calculate' END,
      CASE WHEN k % 11 <> 0 AND k % 3 = 1 THEN 'both allowed and forbidden: calculate' END, CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN 'search is required but not allowed' END,
      CASE WHEN k % 4 = 1 AND k % 3 <> 0 THEN 'search is not allowed but not forbidden' END], lambda r: r IS NOT NULL)) AS error FROM {CASE_EV}""")
def t5(spark, sf):
    return exploded(T.validate_action_cases(cases(spark, sf)))


@query("T5_gate_case_rules", f"""
    SELECT event_id AS line, unnest(list_filter([CASE WHEN dup THEN 'duplicate case_id' END, CASE WHEN k % 4 >= 2 THEN 'search_allowed must be boolean' END, CASE WHEN k % 6 = 0 THEN 'only low-ambiguity cases may be scored' END,
      CASE WHEN (k % 5 = 0) <> (k % 4 = 0) THEN 'required_actions disagrees with search_allowed' END, CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN 'no-search case must forbid search_source_material' END,
      CASE WHEN k % 5 = 0 OR k % 7 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 4) THEN 'missing snapshot_fixture_path' END], lambda r: r IS NOT NULL)) AS error FROM {CASE_EV}""")
def t5_gate(spark, sf):
    return exploded(T.validate_gate_cases(cases(spark, sf), fixture_files(spark, sf)))


@query("T5_source_case_rules", f"""
    SELECT event_id AS line, unnest(list_filter([CASE WHEN k % 8 = 0 THEN 'missing fields: ambiguity, user_turn' END, CASE WHEN dup THEN 'duplicate case_id' END, CASE WHEN k % 17 = 0 THEN 'expected_source_events must be a list' END,
      CASE WHEN k % 17 <> 0 AND k % 19 = 0 THEN 'expected_source_events[1]: job must be a non-empty string' END, CASE WHEN k % 17 <> 0 AND k % 23 = 0 THEN 'expected_source_events[1]: required_query_concepts must be a non-empty list' END,
      CASE WHEN k % 17 <> 0 AND k % 23 <> 0 AND k % 29 = 0 THEN 'expected_source_events[1]: required_query_concepts must contain non-empty alternatives' END], lambda r: r IS NOT NULL)) AS error FROM {CASE_EV}""")
def t5_source(spark, sf):
    return exploded(T.validate_source_cases(cases(spark, sf)))


@query("T5_answer_case_rules", f"""
    SELECT event_id AS line, unnest(list_filter([CASE WHEN dup THEN 'case_id values must be unique' END, CASE WHEN k % 4 = 0 THEN 'invalid answer_category' END, CASE WHEN k % 6 = 0 THEN 'missing user_turn' END,
      CASE WHEN k % 5 = 0 OR k % 7 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 4) THEN 'missing snapshot fixture' END, CASE WHEN k % 9 = 0 THEN 'missing local_docs_fixture_path' END], lambda r: r IS NOT NULL)) AS error FROM {CASE_EV}""")
def t5_answer(spark, sf):
    k = F.col("k")
    rows = events(spark, sf).select(
        case_key(), F.col("event_id").alias("line"),
        F.when(k % 4 == 0, "other").otherwise("calculation").alias("answer_category"), F.when(k % 6 == 0, "").otherwise("what now").alias("user_turn"),
        fixture_path(),
        F.when(k % 9 == 0, "nowhere").when(k % 2 == 0, "").alias("local_docs_fixture_path"), F.lit("f1").alias("prior_sessions_fixture_path"),
    )
    return exploded(T.validate_answer_cases(rows, fixture_files(spark, sf)))


@query("T5_need_case_rules", f"""
    SELECT event_id AS line, unnest(list_filter([CASE WHEN k % 8 = 0 THEN 'missing fields: ambiguity, split' END, CASE WHEN dup THEN 'duplicate case_id' END, CASE WHEN k % 4 = 3 THEN 'expected_search must be boolean' END,
      CASE WHEN k % 4 = 0 AND k % 5 = 0 THEN 'expected_source_need must be an object or null' END,
      CASE WHEN k % 4 = 0 AND k % 5 <> 0 AND k % 3 = 0 THEN 'expected_source_need.intent is invalid: guess' END,
      CASE WHEN k % 4 = 0 AND k % 5 <> 0 AND k % 7 = 0 THEN 'expected_source_need.subjects unknown values: cooking, sailing' END,
      CASE WHEN k % 4 = 0 AND k % 5 <> 0 AND k % 6 = 0 THEN 'expected_source_need.focus_terms must be a non-empty list' END,
      CASE WHEN k % 4 = 0 AND k % 9 = 0 THEN 'acceptable_intents unknown values: guess' END,
      CASE WHEN k % 4 = 0 AND k % 5 <> 0 AND k % 3 <> 0 THEN 'acceptable_intents must include expected_source_need.intent' END,
      CASE WHEN k % 4 = 0 AND (k % 5 = 0 OR k % 6 = 0) THEN 'focus_aliases keys must be expected focus terms: cac' END,
      CASE WHEN k % 4 = 0 AND k % 10 = 0 THEN 'focus_aliases.cac must contain non-empty strings' END,
      CASE WHEN k % 4 <> 0 AND k % 5 <> 0 THEN 'expected_source_need must be null when expected_search is false'
           WHEN k % 4 <> 0 THEN 'acceptable_intents must be omitted when expected_search is false' END], lambda r: r IS NOT NULL)) AS error FROM {CASE_EV}""")
def t5_need(spark, sf):
    k = F.col("k")
    fields = strings(*T.K.NEED_CASE_FIELDS)
    need = F.struct(
        F.when(k % 3 == 0, "guess").otherwise("teaching_evidence").alias("intent"),
        F.when(k % 7 == 0, strings("sailing", "offers", "cooking")).otherwise(strings("offers")).alias("subjects"),
        F.when(k % 6 == 0, none()).otherwise(strings("cac")).alias("focus_terms"),
    )
    rows = events(spark, sf).select(
        case_key(), F.col("event_id").alias("line"),
        F.when(k % 8 == 0, F.array_except(fields, strings("split", "ambiguity"))).otherwise(fields).alias("fields"),
        F.when(k % 4 == 0, True).when(k % 4 != 3, False).alias("expected_search"), F.when(k % 5 != 0, need).alias("need"),
        F.when(k % 9 == 0, strings("diagnostic_evidence", "guess")).otherwise(strings("diagnostic_evidence")).alias("acceptable_intents"),
        F.create_map(F.lit("cac"), F.when(k % 10 == 0, strings(" ")).otherwise(strings("cost"))).alias("focus_aliases"),
    )
    return exploded(T.validate_need_cases(rows))


@query("T6_run_artifact", f"""
    SELECT event_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'missing field: split' END, CASE WHEN k % 7 = 0 THEN 'run artifact must not contain expected-label fields' END, CASE WHEN k % 3 = 0 THEN 'workflow_steps[1]: cli_command missing exit_code' END,
      CASE WHEN k % 4 = 0 THEN 'actual_actions must contain at least one action' END, CASE WHEN k % 4 <> 0 AND k % 6 = 1 THEN 'actual_actions[1]: index must equal 0' END,
      CASE WHEN k % 4 <> 0 AND k % 9 = 1 THEN 'actual_actions[1]: direct action missing evidence_ref' END, CASE WHEN k % 4 <> 0 AND k % 10 = 3 THEN 'actual_actions[2]: missing-confidence action needs evidence_note' END], lambda r: r IS NOT NULL)) AS error FROM {EV}""")
def t6(spark, sf):
    k = F.col("k")
    fields = F.concat(strings("case_id"), F.when(k % 5 == 0, none()).otherwise(strings("split")), F.when(k % 7 == 0, strings("required_actions")).otherwise(none()))
    step = F.struct(
        F.lit(0).alias("index"), F.lit("cli_command").alias("kind"), F.lit("search").alias("command"), F.when(k % 3 != 0, 0).alias("exit_code")
    )

    def act(index, confidence, ref, note):
        return F.struct(
            index.alias("index"), F.lit("calculate").alias("action"), F.lit(confidence).alias("confidence"), F.lit("cli").alias("evidence_type"),
            ref.alias("evidence_ref"), note.alias("evidence_note"),
        )

    empty = F.lit(None).cast("string")
    first = act(F.when(k % 6 == 1, 5).otherwise(0), "direct", F.when(k % 9 == 1, "").otherwise("run"), empty)
    second = act(F.lit(1), "missing", empty, F.when(k % 10 != 3, "why"))
    actions = F.when(k % 4 != 0, F.array(first, second))
    errors = T.run_errors(fields, F.array(step), actions, ["case_id", "split"], ["required_actions", "forbidden_actions"])
    return events(spark, sf).select("event_id", F.explode(errors).alias("error"))


@query("T7_audit_binding", """
    WITH p AS (SELECT conv_id, text, turn % 2 = 0 AS rv FROM conversations WHERE turn = 0),
    a AS (SELECT c.conv_id, c.turn, c.text = p.text AS cur, length(c.text) % 3 > 0 AS ok2, p.conv_id IS NOT NULL AS has, role <> 'assistant' AS op, turn = (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) AS first, role
          FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id)
    SELECT conv_id AS case_id, turn AS line, coalesce(cur, FALSE) AS current, (1 + ok2::INT)::INTEGER AS supported_claims,
      ((NOT first)::INT + (role = 'system')::INT + (NOT has)::INT + (has AND NOT coalesce(cur, FALSE))::INT)::INTEGER AS errors,
      has AND coalesce(cur, FALSE) AND op AND ok2 AS passed FROM a""")
def t7(spark, sf):
    talk = table(spark, sf, "conversations").withColumnRenamed("conv_id", "case_id")
    audits = talk.select(
        "case_id", F.col("turn").alias("line"), F.sha2("text", 256).alias("answer_sha256"),
        F.when(F.col("role") == "system", "someone").otherwise("auditor").alias("reviewer"),
        F.array(F.lit(True), F.length("text") % 3 > 0).alias("claims"), (F.col("role") != "assistant").alias("overall_pass"),
    )
    packets = talk.where(F.col("turn") == 0).select(
        "case_id", F.col("text").alias("answer"), F.sha2("text", 256).alias("packet_sha256"), F.lit(True).alias("run_valid")
    )
    bound = T.bind_audits(audits, packets, "auditor")
    return bound.select("case_id", "line", "current", "supported_claims", F.size("errors").alias("errors"), "passed")


@query("T7_all_audits_pass", """
    SELECT bool_and(coalesce(c.text = p.text, FALSE)) AS all_pass FROM conversations c LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) p USING (conv_id)""")
def t7_all(spark, sf):
    talk = table(spark, sf, "conversations").withColumnRenamed("conv_id", "case_id")
    audits = talk.select(
        "case_id", F.col("turn").alias("line"), F.sha2("text", 256).alias("answer_sha256"), F.lit("auditor").alias("reviewer"),
        F.array(F.lit(True)).alias("claims"), F.lit(True).alias("overall_pass"),
    )
    packets = talk.where(F.col("turn") == 0).select(
        "case_id", F.col("text").alias("answer"), F.sha2("text", 256).alias("packet_sha256"), F.lit(True).alias("run_valid")
    )
    return T.all_audits_pass(T.bind_audits(audits, packets, "auditor"))


@query("T8_session_path", f"""
    WITH t AS (SELECT *, CASE event_type WHEN 'view' THEN 'source_grounded' WHEN 'click' THEN 'source_grounded' WHEN 'purchase' THEN 'calculation' WHEN 'signup' THEN 'clarification' ELSE 'clarification' END AS cat FROM {EV})
    SELECT event_id::VARCHAR AS turn_id, CASE WHEN event_type = 'click' THEN 'did not record search_source_material' WHEN event_type = 'view' AND k % 8 = 6 THEN 'cites no retrieved passage'
       WHEN event_type = 'view' AND k % 2 = 1 THEN 'source event does not record hybrid retrieval' WHEN event_type = 'purchase' AND k % 7 = 1 THEN 'no deterministic calculation event' WHEN event_type = 'error' THEN 'did not record clarify' END AS error FROM t""")
def t8(spark, sf):
    kind = F.col("kind")
    category = F.when(kind.isin("view", "click"), "source_grounded").when(kind == "purchase", "calculation").otherwise("clarification")
    return turns(spark, sf).select("turn_id", T.session_path_error(category).alias("error"))


@query("T9_log_summary", f"""
    SELECT event_id::VARCHAR AS turn_id, (event_type = 'view')::INTEGER AS source_event_count, (event_type = 'purchase' AND k % 7 <> 1)::INTEGER AS calculation_event_count,
      CASE WHEN event_type <> 'view' THEN '' ELSE array_to_string(list_filter([CASE WHEN k % 8 = 5 THEN 'other:1' WHEN k % 8 <> 6 THEN 'src:' || k END,
        CASE WHEN k % 12 <> 4 AND k % 8 IN (5, 6) THEN 'src:' || k END, CASE WHEN k % 12 <> 4 THEN 'src:' || (k + 1) END], lambda r: r IS NOT NULL), ',') END AS ids FROM {EV}""")
def t9(spark, sf):
    return T.summarize_turns(turns(spark, sf)).select(
        "turn_id", "source_event_count", "calculation_event_count", F.array_join("source_chunk_ids", ",").alias("ids")
    )


# --- scoring ---------------------------------------------------------------

def action_cases(spark, sf):
    k = F.col("k")
    return events(spark, sf).select(
        F.col("event_id").alias("case_id"), F.when(k % 3 == 0, "dev").when(k % 3 == 1, "regression").otherwise("holdout").alias("split"),
        F.when(k % 4 == 0, none()).when(k % 4 == 1, strings("search_source_material", "calculate")).otherwise(strings("calculate")).alias("required_actions"),
        F.when(k % 5 == 0, strings("search_source_material")).when(k % 5 == 1, strings("diagnose")).otherwise(none()).alias("forbidden_actions"),
    )


def action_runs(spark, sf):
    k = F.col("k")

    def act(name, confidence, ref):
        return F.struct(
            name.alias("action"), confidence.alias("confidence"), F.lit("cli").alias("evidence_type"), ref.alias("evidence_ref")
        )

    one = act(F.when(k % 7 == 0, "dance").otherwise("calculate"), F.lit("direct"), F.when(k % 6 != 0, "r"))
    two = act(F.when(F.col("event_type") == "view", "search_source_material").otherwise("diagnose"), F.when(k % 8 == 0, "missing").otherwise("inferred"), F.lit("r"))
    empty = "array<struct<action:string,confidence:string,evidence_type:string,evidence_ref:string>>"
    return events(spark, sf).where(k >= 10).select(
        F.col("event_id").alias("case_id"), F.when(k % 10 == 0, none(empty)).otherwise(F.array(one, two)).alias("actual_actions")
    )


SCORED = f"""z AS (SELECT event_id, k, k >= 10 AS ran, CASE k % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'regression' ELSE 'holdout' END AS split,
      CASE WHEN k % 4 = 0 THEN []::VARCHAR[] WHEN k % 4 = 1 THEN ['search_source_material', 'calculate'] ELSE ['calculate'] END AS req,
      CASE WHEN k % 5 = 0 THEN ['search_source_material'] WHEN k % 5 = 1 THEN ['diagnose'] ELSE []::VARCHAR[] END AS fb,
      CASE WHEN k % 10 = 0 THEN []::VARCHAR[] ELSE (CASE WHEN k % 7 = 0 THEN []::VARCHAR[] ELSE ['calculate'] END) || [CASE WHEN event_type = 'view' THEN 'search_source_material' ELSE 'diagnose' END] END AS got,
      CASE WHEN k % 10 = 0 THEN 1 ELSE (k % 7 = 0)::INT + (k % 7 <> 0 AND k % 6 = 0)::INT + (k % 8 = 0)::INT END AS trace_errors FROM {EV}),
    y AS (SELECT *, CASE WHEN len(req) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(req, got)) / len(req)::DOUBLE END AS recall, len(list_intersect(fb, got)) > 0 AS bad,
      list_contains(fb, 'search_source_material') AND list_contains(got, 'search_source_material') AS fs, list_contains(req, 'search_source_material') AND NOT list_contains(got, 'search_source_material') AS ms FROM z)"""


@query("M14_action_trace_scoring", f"""
    WITH {SCORED} SELECT event_id AS case_id, split, CASE WHEN ran THEN 'scored' ELSE 'not_run' END AS status, CASE WHEN ran THEN round(recall, 6) END AS required_recall, CASE WHEN ran THEN bad END AS forbidden_violation,
      CASE WHEN ran THEN fs END AS false_search, CASE WHEN ran THEN ms END AS missed_search, CASE WHEN ran THEN trace_errors = 0 END AS trace_complete,
      CASE WHEN ran THEN recall = 1 AND NOT bad AND trace_errors = 0 END AS full_pass,
      CASE WHEN ran THEN (trace_errors + (recall < 1)::INT + bad::INT + fs::INT + ms::INT) END AS reasons FROM y""")
def m14(spark, sf):
    done = T.score_actions(action_cases(spark, sf), action_runs(spark, sf))
    return done.withColumn("required_recall", F.round("required_recall", 6)).withColumn(
        "reasons", F.when(F.col("failure_reasons").isNotNull(), F.size("failure_reasons"))
    ).drop("failure_reasons")


@query("M14_action_summary", f"""
    WITH {SCORED} SELECT split, count(*)::BIGINT AS scored, round(avg((recall = 1 AND NOT bad AND trace_errors = 0)::INT), 6) AS full_pass_rate, round(avg(bad::INT), 6) AS forbidden_rate, round(avg(fs::INT), 6) AS false_search_rate,
      round(avg(ms::INT), 6) AS missed_search_rate, round(avg((trace_errors = 0)::INT), 6) AS trace_completeness, round(avg(recall), 6) AS avg_required_recall FROM y WHERE ran GROUP BY split""")
def m14_sum(spark, sf):
    done = T.action_summary(T.score_actions(action_cases(spark, sf), action_runs(spark, sf)), ["split"])
    return done.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in done.dtypes])


@query("M14_all_pass_gate", f"WITH {SCORED} SELECT bool_and(ran AND recall = 1 AND NOT bad AND trace_errors = 0) AS all_pass FROM y")
def m14_gate(spark, sf):
    return T.all_pass(T.score_actions(action_cases(spark, sf), action_runs(spark, sf)))


@query("M15_source_need_scoring", f"""
    WITH n AS (SELECT event_id, k, k % 3 <> 0 AS expect, k % 10 <> 9 AS ran, event_type IN ('view', 'click') AND k % 7 <> 0 AS stated, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS extra, k % 5 <> 0 AS term FROM {EV})
    SELECT event_id AS case_id, CASE WHEN ran THEN 'scored' ELSE 'not_run' END AS status, CASE WHEN ran THEN stated AND NOT expect END AS false_search, CASE WHEN ran THEN NOT stated AND expect END AS missed_search,
      CASE WHEN ran THEN CASE WHEN expect AND stated THEN k % 4 <> 0 WHEN NOT expect THEN NOT stated END END AS intent_match, CASE WHEN ran THEN CASE WHEN expect AND stated THEN extra = 0 WHEN NOT expect THEN NOT stated END END AS subject_exact,
      CASE WHEN ran THEN CASE WHEN expect AND stated THEN 1.0 WHEN NOT expect THEN (NOT stated)::INT::DOUBLE END END::DOUBLE AS subject_recall,
      CASE WHEN ran THEN CASE WHEN expect AND stated THEN CASE WHEN term THEN 1.0 ELSE 0.5 END WHEN NOT expect THEN (NOT stated)::INT::DOUBLE END END::DOUBLE AS focus_recall,
      CASE WHEN ran THEN stated = expect AND (NOT expect OR (stated AND extra = 0)) END AS strict_pass FROM n""")
def m15(spark, sf):
    k = F.col("k")
    e = events(spark, sf)
    known = F.create_map(F.lit("get leads to engage"), strings("engagement", "STR owners"))
    need = e.select(
        F.col("event_id").alias("case_id"), (k % 3 != 0).alias("expected_search"), strings("teaching_evidence", "comparison_evidence").alias("accepted_intents"),
        strings("offers").alias("subjects"), strings("get leads to engage", "price").alias("focus_terms"), known.alias("aliases"),
    )
    says = F.col("event_type").isin("view", "click") & (k % 7 != 0)
    runs = e.where(k % 10 != 9).select(
        F.col("event_id").alias("case_id"), F.lit(None).cast("boolean").alias("actual_search"),
        F.when(says, F.when(k % 4 == 0, "diagnostic_evidence").otherwise("teaching_evidence")).alias("intent"),
        F.when(k % 2 == 0, strings("offers", "upsells")).otherwise(strings("offers", "weather")).alias("run_subjects"),
        F.when(k % 5 != 0, strings("Owner ENGAGEMENT", " price! ")).otherwise(strings("price", " ")).alias("run_terms"),
    )
    return T.score_needs(need, runs)


@query("J7_case_run_join", """
    SELECT c_nationkey, CASE WHEN n IS NULL THEN 'missing_run' ELSE 'scored' END AS status, count(*)::BIGINT AS cases
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey GROUP BY ALL""")
def j7(spark, sf):
    runs = table(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)).groupBy(
        F.col("o_custkey").alias("case_id")
    ).agg(F.count("*").alias("n"))
    done = T.join_runs(table(spark, sf, "customer").withColumnRenamed("c_custkey", "case_id"), runs, "missing_run")
    return done.groupBy("c_nationkey", "status").agg(F.count("*").alias("cases"))


MATCHING = f"""
    ev AS (SELECT user_id, event_id, CASE WHEN value > 8 THEN 'upsell offers' ELSE 'gross profit of an upsell' END || ' ' || k AS q, k % 4 <> 0 AS contract, k % 3 <> 0 AS turn, k % 5 <> 0 AS ex, k % 7 <> 0 AS ch FROM {EV}),
    us AS (SELECT DISTINCT user_id, user_id % 3 + 1 AS n FROM events),
    sc AS (SELECT ev.*, p, (contains(q, 'upsell')::INT + CASE p WHEN 0 THEN contains(q, 'gross profit')::INT WHEN 1 THEN contains(q, ' 1')::INT ELSE contains(q, ' 2')::INT END) / 2.0::DOUBLE AS recall FROM ev, (VALUES (0), (1), (2)) t(p)),
    s AS (SELECT *, recall * 4 + contract::INT + turn::INT + ex::INT + ch::INT AS score FROM sc),
    p0 AS (SELECT * FROM s WHERE p = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1),
    p1 AS (SELECT s.* FROM s JOIN us USING (user_id) WHERE p = 1 AND n > 1 AND event_id NOT IN (SELECT event_id FROM p0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1),
    p2 AS (SELECT s.* FROM s JOIN us USING (user_id) WHERE p = 2 AND n > 2 AND event_id NOT IN (SELECT event_id FROM p0 UNION ALL SELECT event_id FROM p1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) = 1),
    picks AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2),
    ok AS (SELECT user_id, count(*) AS used, count(*) FILTER (recall = 1 AND contract AND turn AND ex AND ch) AS matched, sum((NOT contract)::INT + (NOT turn)::INT + (recall < 1)::INT + (NOT ex)::INT + (NOT ch)::INT) AS fails FROM picks GROUP BY 1),
    cnt AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)"""


@query("J9_greedy_event_match", f"""
    WITH {MATCHING} SELECT user_id AS case_id, n::INTEGER AS expected_count, total::BIGINT AS actual_count, matched::INTEGER AS matched, (total - used)::BIGINT AS extra,
      (fails + 5 * (n - used) + (total > used)::INT)::INTEGER AS reasons, CASE WHEN matched = n AND total = used THEN 'passed' ELSE 'failed' END AS status FROM us JOIN ok USING (user_id) JOIN cnt USING (user_id)""")
def j9(spark, sf):
    """One case per user with one to three expected events and all its recorded ones."""
    e = events(spark, sf)
    k = F.col("k")

    def want(job, second):
        return F.struct(F.lit(job).alias("job"), F.array(strings("upsell", "up-sell"), strings(second)).alias("concepts"))

    wanted = F.array(want("a", "Gross profit"), want("b", "offers 1"), want("c", "offers 2"))
    users = e.select(F.col("user_id").alias("case_id")).distinct().select(
        "case_id", F.lit("What  now?").alias("user_turn"), F.slice(wanted, F.lit(1), (F.col("case_id") % 3 + 1).cast("int")).alias("expected")
    )
    # The second concept of b and c is a number start, heard in either wording.
    users = users.withColumn(
        "expected",
        F.transform("expected", lambda x: F.struct(
            x["job"].alias("job"),
            F.transform(x["concepts"], lambda g: F.when(F.array_contains(g, "offers 1"), strings("offers 1", "upsell 1")).when(
                F.array_contains(g, "offers 2"), strings("offers 2", "upsell 2")).otherwise(g)).alias("concepts"),
        )),
    )
    q = F.concat(F.when(F.col("value") > 8, "Upsell offers").otherwise("gross profit of an upsell"), F.lit(" "), k.cast("string"))
    rows = e.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("event_index"), F.when(k % 4 != 0, "teaching_evidence").otherwise("guess").alias("intent"),
        q.alias("query"), F.when(k % 3 != 0, "what now").otherwise("other").alias("request_turn"),
        F.when(k % 5 != 0, F.array(F.lower(q))).otherwise(strings("x")).alias("queries"), (k % 7 != 0).alias("has_chunks"),
    )
    return T.match_events(users, rows).select(
        "case_id", "expected_count", "actual_count", "matched", "extra", F.size("failure_reasons").alias("reasons"), "status"
    )


def calculations(spark, sf):
    base = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_returnflag") == "R", "gross-profit").otherwise("cac").alias("metric"),
        F.create_map(F.lit("price"), F.col("l_quantity"), F.lit("cogs"), F.lit(1.0)).alias("inputs"), (F.col("l_quantity") * 2).alias("value"), "l_tax", "l_discount",
    )
    actual = base.where(F.col("l_tax") > 0.02).withColumn(
        "inputs", F.create_map(F.lit("cogs"), F.lit(1.0), F.lit("price"), F.element_at("inputs", F.lit("price")))
    ).withColumn("value", F.col("value") * F.when(F.col("l_discount") > 0.07, 1.01).otherwise(1.00000001))
    return base.where(F.col("l_discount") > 0.01), actual


CALCS = """
    b AS (SELECT l_suppkey AS case_id, CASE WHEN l_returnflag = 'R' THEN 'gross-profit' ELSE 'cac' END AS metric, l_quantity AS q, l_tax, l_discount FROM lineitem),
    e AS (SELECT case_id, metric, q, count(*) AS n FROM b WHERE l_discount > 0.01 GROUP BY ALL), a AS (SELECT case_id, metric, q, count(*) AS n, count(*) FILTER (l_discount <= 0.07) AS good FROM b WHERE l_tax > 0.02 GROUP BY ALL),
    m AS (SELECT case_id, metric, q, coalesce(e.n, 0) AS en, coalesce(a.n, 0) AS an, least(coalesce(e.n, 0), coalesce(a.good, 0)) AS mt FROM e FULL JOIN a USING (case_id, metric, q))"""


@query("J10_calculation_match", f"WITH {CALCS} SELECT case_id, metric, q AS price, en::BIGINT AS expected, an::BIGINT AS actual, mt::BIGINT AS matched FROM m")
def j10(spark, sf):
    done = T.match_calculations(*calculations(spark, sf))
    return done.select(
        "case_id", "metric", F.get(F.col("inputs"), F.lit(1))["value"].alias("price"), "expected", "actual", "matched"
    )


@query("J10_calculation_scoring", f"""
    WITH {CALCS}, s AS (SELECT s_suppkey AS k, s_suppkey % 9 <> 0 AS ran FROM supplier),
    lost AS (SELECT case_id, metric, sum(en - mt) AS n FROM m WHERE en > mt GROUP BY ALL),
    ls AS (SELECT case_id, string_agg(repeat('missing_calculation_event:' || metric || ',', n::INT), '' ORDER BY metric) AS t FROM lost GROUP BY 1),
    any_a AS (SELECT DISTINCT case_id FROM b WHERE l_tax > 0.02), any_e AS (SELECT DISTINCT case_id FROM b WHERE l_discount > 0.01)
    SELECT k AS case_id, CASE WHEN NOT ran THEN 'missing_run' WHEN r = '' THEN 'pass' ELSE 'fail' END AS status, CASE WHEN ran THEN rtrim(r, ',') ELSE 'missing_run' END AS reasons FROM (
      SELECT k, ran, CASE WHEN k % 2 <> 0 THEN 'missing_action:calculate,' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'forbidden_action:guess,' ELSE '' END || coalesce(ls.t, '')
             || CASE WHEN ae.case_id IS NULL AND aa.case_id IS NOT NULL THEN 'unexpected_calculation_event,' ELSE '' END
             || CASE WHEN k % 2 = 0 AND aa.case_id IS NULL THEN 'calculate_without_calculation_events,' ELSE '' END AS r
      FROM s LEFT JOIN ls ON ls.case_id = k LEFT JOIN any_a aa ON aa.case_id = k LEFT JOIN any_e ae ON ae.case_id = k)""")
def j10_score(spark, sf):
    k = F.col("s_suppkey")
    cases_ = table(spark, sf, "supplier").select(k.alias("case_id"), strings("calculate").alias("expected_actions"), strings("guess").alias("forbidden_actions"))
    runs = table(spark, sf, "supplier").where(k % 9 != 0).select(
        k.alias("case_id"), F.concat(F.when(k % 2 == 0, strings("calculate")).otherwise(none()), F.when(k % 3 == 0, strings("guess")).otherwise(none())).alias("actions")
    )
    done = T.score_calculations(cases_, runs, *calculations(spark, sf))
    return done.select("case_id", "status", F.array_join("failure_reasons", ",").alias("reasons"))


@query("J11_evidence_packet", f"""
    WITH i AS (SELECT event_id, unnest([k, k + 1, k, event_id + 5, 1 - k]) AS d, unnest([0, 1, 2, 3, 4]) AS p FROM {EV}),
    f AS (SELECT event_id, d, min(p) AS p FROM i GROUP BY ALL)
    SELECT event_id AS turn_id, coalesce(string_agg(d || '/' || length(text), ',' ORDER BY p) FILTER (text IS NOT NULL), '') AS passages, coalesce(string_agg(d::VARCHAR, ',' ORDER BY p) FILTER (text IS NULL), '') AS missing
    FROM f LEFT JOIN documents ON doc_id = d GROUP BY 1""")
def j11(spark, sf):
    k = F.col("k").cast("long")
    asked = events(spark, sf).select(
        F.col("event_id").alias("turn_id"), F.array(k, k + 1, k).alias("inspected"), F.array(F.col("event_id") + 5, 1 - k).alias("cited")
    )
    passages = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    done = T.evidence_packets(asked, passages)
    return done.select(
        "turn_id",
        F.array_join(F.transform("passages", lambda p: F.concat_ws("/", p["chunk_id"].cast("string"), F.length(p["text"]).cast("string"))), ",").alias("passages"),
        F.array_join(F.transform("missing_ids", lambda m: m.cast("string")), ",").alias("missing"),
    )


