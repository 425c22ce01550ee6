"""Validation and scoring of turn logs, agent runs and answer audits.

Every check is a Column over one row, so a whole log is validated in one pass. Violations
are rows of an `errors` array in the order in which they are checked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank import scale
from quillrank.functions import economics
from quillrank.functions.text import bind, normalize_query, normalize_text, strip
from quillrank.session import stored

TURN_SCHEMA = """
    turn_id string, created_at string, user_message string, assistant_message string,
    actions array<string>,
    source_events array<struct<search_request map<string,string>, queries array<string>,
        query string, retrieval_backend string, chunks array<struct<id string, score double>>>>,
    calculation_events array<struct<metric string, inputs map<string,double>, value double>>,
    cited_chunk_ids array<string>,
    metadata struct<external_cited_chunk_ids array<string>, failed_search boolean>
"""


def _listed(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def _problems(*checks: tuple[Column, str | Column]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for c, m in checks])
    )


def _empty(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def _numbered(errors: Column, label: str, index: Column) -> Column:
    return F.transform(errors, lambda e: F.concat(F.lit(f"{label}["), (index + 1).cast("string"), F.lit("]: "), e))


# --- one event -------------------------------------------------------------

def source_event_errors(event: Column) -> Column:
    """Contract of one search: known intent, one short line, run exactly as asked, with chunks."""
    request = event["search_request"]
    query = F.try_element_at(request, F.lit("query"))
    queries = F.coalesce(event["queries"], F.when(event["query"].isNotNull(), F.array(event["query"])))
    extra = F.array_sort(F.array_except(F.map_keys(request), _listed(("intent", "user_turn", "query"))))
    bad_query = (
        _blank(query) | F.contains(query, F.lit("\n")) | F.contains(query, F.lit("\r"))
        | (F.length(strip(query)) > K.MAX_QUERY_CHARS)
    )
    usable = queries.isNotNull() & (F.size(queries) > 0) & ~F.exists(queries, _blank)
    chunks = event["chunks"]
    return _problems(
        (request.isNull(), "search_request must be an object"),
        (~F.coalesce(F.try_element_at(request, F.lit("intent")).isin(list(K.SEARCH_INTENTS)), F.lit(False)),
         "unknown intent"),
        (bad_query, f"query must be one non-empty line of at most {K.MAX_QUERY_CHARS} characters"),
        (_blank(F.try_element_at(request, F.lit("user_turn"))), "user_turn must be non-empty"),
        (F.size(extra) > 0, F.concat(F.lit("unsupported fields: "), F.array_join(extra, ", "))),
        (~F.coalesce(usable, F.lit(False)), "requires non-empty queries list"),
        (usable & ((F.size(queries) != 1) | (normalize_query(F.get(queries, F.lit(0))) != normalize_query(query))),
         "queries must contain exactly the requested query"),
        (chunks.isNull() | (F.size(chunks) == 0), "requires non-empty chunks list"),
        (F.exists(chunks, lambda c: _blank(c["id"])), "chunk requires non-empty id"),
    )


def calculation_error(event: Column) -> Column:
    """First problem of one recorded calculation, null when it can be recomputed."""
    def check(result: Column) -> Column:
        value, expected = event["value"], result["value"]
        finite = ~F.isnan(value) & (F.abs(value) != economics.INFINITY)
        return (
            F.when(~F.coalesce(event["metric"].isin(list(K.METRIC_INPUTS)), F.lit(False)), F.lit("unknown metric"))
            .when(F.coalesce(F.size(event["inputs"]), F.lit(0)) <= 0, F.lit("inputs must be a non-empty object"))
            .when(~F.coalesce(finite, F.lit(False)), F.lit("value must be a number"))
            .when(result["error"].isNotNull(), F.concat(F.lit("invalid inputs: "), result["error"]))
            .when(expected == economics.INFINITY, F.lit("result is not finite"))
            .when(
                ~economics.is_close(value, expected, 1e-9, 1e-9),
                F.lit("value does not match the recomputed result"),
            )
        )

    return bind(economics.calculate(event["metric"], event["inputs"]), check)


# --- one turn --------------------------------------------------------------

def inspected_ids(events: Column) -> Column:
    ids = F.flatten(F.transform(events, lambda e: F.transform(F.coalesce(e["chunks"], F.array().cast("array<struct<id:string,score:double>>")), lambda c: c["id"])))
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))


def missing_citations(cited: Column, inspected: Column, external: Column) -> Column:
    return F.array_except(cited, F.array_union(inspected, F.coalesce(external, _empty())))


def validate_turns(turns: DataFrame) -> DataFrame:
    """Add errors, warnings, deduplicated citations and a `valid` flag to turn rows."""
    actions = F.col("actions")
    events = F.coalesce(F.col("source_events"), F.expr("array()").cast(turns.schema["source_events"].dataType))
    sums = F.coalesce(F.col("calculation_events"), F.expr("array()").cast(turns.schema["calculation_events"].dataType))
    cited = F.array_distinct(F.coalesce("cited_chunk_ids", _empty()))
    external = F.col("metadata.external_cited_chunk_ids")
    inspected = inspected_ids(events)
    unknown = F.array_except(actions, _listed(K.TURN_ACTIONS))
    lost = missing_citations(cited, inspected, external)
    own = _problems(
        (_blank(F.col("user_message")), "requires non-empty string field: user_message"),
        (_blank(F.col("assistant_message")), "requires non-empty string field: assistant_message"),
        (actions.isNull() | (F.size(actions) == 0) | F.exists(actions, _blank), "requires non-empty string list field: actions"),
        (F.size(unknown) > 0, F.concat(F.lit("unknown action labels: "), F.array_join(unknown, ", "))),
    )
    of_events = F.flatten(F.transform(events, lambda e, i: _numbered(source_event_errors(e), "source_events", i)))
    of_sums = F.flatten(
        F.transform(
            sums, lambda e, i: _numbered(F.array_compact(F.array(calculation_error(e))), "calculation_events", i)
        )
    )
    rest = _problems(
        (F.array_contains(actions, "calculate") & (F.size(sums) == 0), "calculate needs a calculation event"),
        (F.size(lost) > 0, F.concat(F.lit("cited_chunk_ids not found: "), F.array_join(lost, ", "))),
    )
    warn = _problems(
        ((F.size(inspected) > 0) & (F.size(cited) == 0), "inspected chunks but cited_chunk_ids is empty")
    )
    return (
        turns.withColumn("errors", F.concat(own, of_events, of_sums, rest)).withColumn("warnings", warn)
        .withColumn("cited_chunk_ids", cited).withColumn("valid", F.size("errors") == 0)
    )


def summarize_turns(turns: DataFrame) -> DataFrame:
    """Distinct chunk ids of a turn (citations first, then events) and its event counts."""
    cited = F.coalesce("cited_chunk_ids", _empty())
    ids = F.filter(F.array_distinct(F.concat(cited, inspected_ids(F.col("source_events")))), lambda i: i != "")
    return turns.select(
        "turn_id", "created_at", "actions",
        F.coalesce(F.size("source_events"), F.lit(0)).alias("source_event_count"),
        F.coalesce(F.size("calculation_events"), F.lit(0)).alias("calculation_event_count"),
        ids.alias("source_chunk_ids"),
    )


def session_path_error(category: Column) -> Column:
    """First reason why a turn did not take its category's path, over turn columns."""
    actions = F.coalesce("actions", _empty())
    events, sums = F.col("source_events"), F.col("calculation_events")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    cited = ~none(F.col("cited_chunk_ids"))
    off_backend = F.exists(events, lambda e: ~e["retrieval_backend"].eqNullSafe(F.lit("hybrid")))
    searched = ~none(events) | cited
    grounded, calc, ask = category == "source_grounded", category == "calculation", category == "clarification"
    return (
        F.when(F.coalesce(F.col("metadata.failed_search"), F.lit(False)), "failed source-material search recorded")
        .when(grounded & ~F.array_contains(actions, K.SEARCH_ACTION), "did not record search_source_material")
        .when(grounded & none(events), "no successful source event")
        .when(grounded & ~cited, "cites no retrieved passage")
        .when(grounded & off_backend, "source event does not record hybrid retrieval")
        .when(calc & (~F.array_contains(actions, "calculate") | none(sums)), "no deterministic calculation event")
        .when((calc | ask) & searched & ~(ask & ~F.array_contains(actions, "clarify")), "unexpectedly searched source material")
        .when(ask & ~F.array_contains(actions, "clarify"), "did not record clarify")
    )


# --- cases and runs --------------------------------------------------------

NULL_PARTS = 256


def duplicates(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Flag every row of a key after the first by position (pre-aggregated, no key gathered); null is a key.

    Rows without a key are many, so they meet their first position in NULL_PARTS parts.
    """
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(position).alias("_first"))
    every = F.when(F.col("_key").isNull(), F.sequence(F.lit(0), F.lit(NULL_PARTS - 1))).otherwise(F.array(F.lit(0)))
    first = first.withColumn("_at", F.explode(every))
    part = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(position), F.lit(NULL_PARTS)).cast("int")).otherwise(0)
    met = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at"))
    joined = rows.withColumn("_part", part).join(first, met, "left")
    return joined.withColumn("is_duplicate", F.col(position) > F.col("_first")).drop("_first", "_key", "_part", "_at")


def missing_fields(fields: Column, required: Sequence[str]) -> Column:
    """Message that names the required fields absent from `fields` (array of names), or null."""
    absent = F.array_sort(F.array_except(_listed(required), F.coalesce(fields, _empty())))
    return F.when(F.size(absent) > 0, F.concat(F.lit("missing fields: "), F.array_join(absent, ", ")))


def _required(cases: DataFrame, required: Sequence[str]) -> list[tuple[Column, str | Column]]:
    """Check of the required fields, where the cases carry the names of their fields."""
    if "fields" not in cases.columns:
        return []
    message = missing_fields(F.col("fields"), required)
    return [(message.isNotNull(), message)]


def validate_action_cases(cases: DataFrame) -> DataFrame:
    """cases: case_id, line, required/allowed/forbidden_actions, expected_first_action, search_allowed, and
    fields (names that the record has; without this column none is required)."""
    req, alw, fbd = (F.col(f"{n}_actions") for n in ("required", "allowed", "forbidden"))

    def joined(a: Column) -> Column:
        return F.array_join(F.array_sort(a), ", ")

    def both(a: Column, b: Column) -> Column:
        return F.array_intersect(a, b)

    checks = _required(cases, K.ACTION_CASE_FIELDS) + [(F.col("is_duplicate"), "duplicate case_id")]
    for name, col in (("required", req), ("allowed", alw), ("forbidden", fbd)):
        extra = F.array_except(col, _listed(K.CASE_ACTIONS))
        checks += [
            (col.isNull(), f"{name}_actions must be a list"),
            (F.size(extra) > 0, F.concat(F.lit(f"unknown {name}_actions: "), joined(extra))),
        ]
    first = F.col("expected_first_action")
    allowed = F.col("search_allowed")
    checks += [
        (~F.coalesce(first.isin(list(K.CASE_ACTIONS)), F.lit(False)), "unknown expected_first_action"),
        (F.size(both(req, fbd)) > 0, F.concat(F.lit("both required and forbidden: "), joined(both(req, fbd)))),
        (F.size(both(alw, fbd)) > 0, F.concat(F.lit("both allowed and forbidden: "), joined(both(alw, fbd)))),
        (~F.coalesce(allowed, F.lit(False)) & F.array_contains(req, K.SEARCH_ACTION), "search is required but not allowed"),
        (F.coalesce(~allowed, F.lit(False)) & ~F.array_contains(fbd, K.SEARCH_ACTION), "search is not allowed but not forbidden"),
    ]
    return duplicates(cases, "case_id", "line").withColumn("errors", _problems(*checks)).drop("is_duplicate")


def validate_gate_cases(cases: DataFrame, fixtures: DataFrame | None = None) -> DataFrame:
    """cases: case_id, line, search_allowed, ambiguity, required_actions, forbidden_actions, snapshot_fixture_path.

    `fixtures` (path) lists the files that are there, as `sources.files.list_files` does; without it
    paths are not checked.
    """
    allowed = F.col("search_allowed")
    needs = F.array_contains("required_actions", K.SEARCH_ACTION)
    found = duplicates(cases, "case_id", "line")
    lost = F.lit(False)
    if fixtures is not None:
        there = fixtures.select(F.col("path").alias("_path")).distinct().withColumn("_there", F.lit(True))
        found = found.join(there, F.col("snapshot_fixture_path") == F.col("_path"), "left").drop("_path")
        lost = F.col("_there").isNull()
    done = found.withColumn(
        "errors",
        _problems(
            (F.col("is_duplicate"), "duplicate case_id"),
            (allowed.isNull(), "search_allowed must be boolean"),
            (F.coalesce("ambiguity", F.lit("")) != "low", "only low-ambiguity cases may be scored"),
            (needs != F.coalesce(allowed, F.lit(False)), "required_actions disagrees with search_allowed"),
            (~F.coalesce(allowed, F.lit(False)) & ~F.array_contains("forbidden_actions", K.SEARCH_ACTION),
             "no-search case must forbid search_source_material"),
            (lost, "missing snapshot_fixture_path"),
        ),
    )
    return done.drop("is_duplicate", "_there")


def validate_source_cases(cases: DataFrame) -> DataFrame:
    """cases: case_id, line, expected_source_events array<struct<job, concepts array<array>>>, and fields as above."""
    events = F.col("expected_source_events")

    def of_event(event: Column) -> Column:
        bad_group = F.exists(event["concepts"], lambda g: (F.size(g) <= 0) | F.exists(g, _blank))
        return _problems(
            (_blank(event["job"]), "job must be a non-empty string"),
            (F.coalesce(F.size(event["concepts"]), F.lit(0)) <= 0, "required_query_concepts must be a non-empty list"),
            (bad_group, "required_query_concepts must contain non-empty alternatives"),
        )

    per_event = F.flatten(F.transform(events, lambda e, i: _numbered(of_event(e), "expected_source_events", i)))
    own = _problems(
        *_required(cases, K.SOURCE_CASE_FIELDS),
        (F.col("is_duplicate"), "duplicate case_id"), (events.isNull(), "expected_source_events must be a list"),
    )
    return duplicates(cases, "case_id", "line").withColumn(
        "errors", F.concat(own, F.coalesce(per_event, _empty()))
    ).drop("is_duplicate")


def validate_answer_cases(cases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """cases: case_id, line, answer_category, user_turn, snapshot_fixture_path and the optional
    local_docs_fixture_path, prior_sessions_fixture_path. fixtures: path (files that exist)."""
    known = fixtures.select("path").distinct()
    rows = duplicates(cases, "case_id", "line")
    optional = ("local_docs_fixture_path", "prior_sessions_fixture_path")
    for name in ("snapshot_fixture_path", *optional):
        there = known.select(F.col("path").alias(name), F.lit(True).alias(f"_{name}"))
        rows = rows.join(there, name, "left")

    def lost(name: str) -> Column:
        return F.col(f"_{name}").isNull()

    checks: list[tuple[Column, str | Column]] = [
        (F.col("is_duplicate"), "case_id values must be unique"),
        (~F.coalesce(F.col("answer_category").isin(list(K.ANSWER_CATEGORIES)), F.lit(False)), "invalid answer_category"),
        (F.coalesce("user_turn", F.lit("")) == "", "missing user_turn"),
        (lost("snapshot_fixture_path"), "missing snapshot fixture"),
    ]
    checks += [((F.coalesce(n, F.lit("")) != "") & lost(n), f"missing {n}") for n in optional]
    return rows.withColumn("errors", _problems(*checks)).select(*cases.columns, "errors")


def validate_need_cases(cases: DataFrame) -> DataFrame:
    """Source-need cases: case_id, line, fields (names that the record has), expected_search,
    need struct<intent, subjects, focus_terms>, acceptable_intents, focus_aliases map<string,array<string>>."""
    need, intents, aliases = F.col("need"), F.col("acceptable_intents"), F.col("focus_aliases")
    asked = F.coalesce("expected_search", F.lit(False))
    at = "expected_source_need"

    def unknown(values: Column, known: Sequence[str], text: str) -> tuple[Column, Column]:
        extra = F.array_except(values, _listed(known))
        return asked & (F.size(extra) > 0), F.concat(F.lit(text), F.array_join(F.array_sort(extra), ", "))

    def blank(values: Column) -> Column:
        return F.coalesce(F.size(values), F.lit(0)) <= 0

    has = asked & need.isNotNull()
    named = need["intent"].isin(list(K.NEED_INTENTS))
    stray = F.array_except(F.map_keys(aliases), F.coalesce(need["focus_terms"], _empty()))
    own = _problems(
        (missing_fields(F.col("fields"), K.NEED_CASE_FIELDS).isNotNull(), missing_fields(F.col("fields"), K.NEED_CASE_FIELDS)),
        (F.col("is_duplicate"), "duplicate case_id"),
        (F.col("expected_search").isNull(), "expected_search must be boolean"),
        (asked & need.isNull(), f"{at} must be an object or null"),
        (has & ~F.coalesce(named, F.lit(False)), F.concat(F.lit(f"{at}.intent is invalid: "), F.coalesce(need["intent"], F.lit("None")))),
        (has & blank(need["subjects"]), f"{at}.subjects must be a non-empty list"),
        unknown(need["subjects"], K.SUBJECTS, f"{at}.subjects unknown values: "),
        (has & blank(need["focus_terms"]), f"{at}.focus_terms must be a non-empty list"),
        (has & F.exists(need["focus_terms"], _blank), f"{at}.focus_terms must contain non-empty strings"),
        (asked & intents.isNotNull() & blank(intents), "acceptable_intents must be a non-empty list when present"),
        unknown(intents, K.NEED_INTENTS, "acceptable_intents unknown values: "),
        (has & named & (F.size(intents) > 0) & ~F.array_contains(intents, need["intent"]),
         f"acceptable_intents must include {at}.intent"),
        (asked & (F.size(stray) > 0),
         F.concat(F.lit("focus_aliases keys must be expected focus terms: "), F.array_join(F.array_sort(stray), ", "))),
    )
    per_term = F.flatten(
        F.transform(
            F.array_sort(F.map_entries(aliases)),
            lambda e: F.transform(
                _problems(
                    (blank(e["value"]), " must be a non-empty list"),
                    (F.exists(e["value"], _blank), " must contain non-empty strings"),
                ),
                lambda m: F.concat(F.lit("focus_aliases."), e["key"], m),
            ),
        )
    )
    # Of the fields that only belong to a searching case, the first that is there.
    idle = F.when(~asked, F.array_compact(F.array(
        F.when(need.isNotNull(), f"{at} must be null when expected_search is false")
        .when(intents.isNotNull(), "acceptable_intents must be omitted when expected_search is false")
        .when(aliases.isNotNull(), "focus_aliases must be omitted when expected_search is false")
    )))
    errors = F.concat(own, F.when(asked, F.coalesce(per_term, _empty())).otherwise(_empty()), F.coalesce(idle, _empty()))
    return duplicates(cases, "case_id", "line").withColumn("errors", errors).drop("is_duplicate")


def run_errors(fields: Column, workflow_steps: Column, actions: Column, required: Sequence[str], leaking: Sequence[str]) -> Column:
    """Errors of one run artifact.

    fields: array of the keys present. workflow_steps: array<struct<index,kind,command,
    exit_code>>. actions: array<struct<index,action,confidence,evidence_type,evidence_ref,
    evidence_note>>, whose index must count up from 0.
    """
    absent = F.transform(
        F.array_except(_listed(required), fields), lambda f: F.concat(F.lit("missing field: "), f)
    )
    leak = _problems((F.arrays_overlap(fields, _listed(leaking)), "run artifact must not contain expected-label fields"))

    def step(s: Column, i: Column) -> Column:
        cli = s["kind"] == "cli_command"
        found = _problems(
            (s["index"].isNull(), "missing index"), (s["kind"].isNull(), "missing kind"),
            (cli & s["command"].isNull(), "cli_command missing command"),
            (cli & s["exit_code"].isNull(), "cli_command missing exit_code"),
        )
        return _numbered(found, "workflow_steps", i)

    def act(a: Column, i: Column) -> Column:
        direct = (a["confidence"] == "direct") & a["action"].isin(list(K.TOOL_ACTIONS))
        found = _problems(
            (~F.coalesce(a["action"].isin(list(K.CASE_ACTIONS)), F.lit(False)), "unknown action"),
            (~F.coalesce(a["confidence"].isin(list(K.CONFIDENCES)), F.lit(False)), "unknown confidence"),
            (~a["index"].eqNullSafe(i), F.concat(F.lit("index must equal "), i.cast("string"))),
            (direct & _blank(a["evidence_type"]), "direct action missing evidence_type"),
            (direct & _blank(a["evidence_ref"]), "direct action missing evidence_ref"),
            ((a["confidence"] == "missing") & _blank(a["evidence_note"]), "missing-confidence action needs evidence_note"),
        )
        return _numbered(found, "actual_actions", i)

    none = _problems((F.coalesce(F.size(actions), F.lit(0)) <= 0, "actual_actions must contain at least one action"))
    return F.concat(
        absent, leak,
        F.coalesce(F.flatten(F.transform(workflow_steps, step)), _empty()), none,
        F.coalesce(F.flatten(F.transform(actions, act)), _empty()),
    )


def _action_problems(actions: Column) -> Column:
    """array<struct<action, counted, failures>> for recorded actions."""
    def one(a: Column) -> Column:
        known = F.coalesce(a["action"].isin(list(K.CASE_ACTIONS)), F.lit(False))
        sure = F.coalesce(a["confidence"].isin(list(K.CONFIDENCES)), F.lit(False))
        direct = (a["confidence"] == "direct") & a["action"].isin(list(K.TOOL_ACTIONS))

        def named(text: str) -> Column:
            return F.concat(F.lit(text + ":"), F.coalesce(a["action"], F.lit("None")))

        failures = F.when(known, _problems(
            (~sure, F.concat(F.lit("unknown_confidence:"), F.coalesce(a["confidence"], F.lit("None")))),
            (sure & (a["confidence"] == "missing"), named("missing_evidence")),
            (direct & (F.coalesce(a["evidence_type"], F.lit("")) == ""), named("missing_evidence_type")),
            (direct & (F.coalesce(a["evidence_ref"], F.lit("")) == ""), named("missing_evidence_ref")),
        )).otherwise(F.array(named("unknown_action")))
        return F.struct(F.when(known, a["action"]).alias("action"), failures.alias("failures"))

    return F.transform(actions, one)


def score_actions(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Score each case's recorded actions; cases without a run get status not_run.

    cases: case_id, split, required_actions, forbidden_actions. runs: case_id,
    actual_actions array<struct<action,confidence,evidence_type,evidence_ref>>.
    """
    ran = runs.select("case_id", "actual_actions", F.lit(True).alias("_ran"))
    joined = cases.join(ran, "case_id", "left").withColumn("_a", _action_problems(F.col("actual_actions")))
    empty = F.coalesce(F.size("actual_actions"), F.lit(0)) <= 0
    done = F.col("_ran").isNotNull()
    joined = joined.withColumn(
        "_set", F.coalesce(F.array_compact(F.array_distinct(F.transform("_a", lambda x: x["action"]))), _empty())
    ).withColumn(
        "_trace", F.when(empty, F.array(F.lit("missing_actual_actions"))).otherwise(F.flatten(F.transform("_a", lambda x: x["failures"])))
    )
    required, forbidden, got = F.array_distinct("required_actions"), F.array_distinct("forbidden_actions"), F.col("_set")
    hits = F.size(F.array_intersect(required, got))
    recall = F.when(F.size(required) == 0, 1.0).otherwise(hits / F.size(required))
    bad = F.array_intersect(forbidden, got)
    false_search = F.array_contains(bad, K.SEARCH_ACTION)
    missed = F.array_contains(required, K.SEARCH_ACTION) & ~F.array_contains(got, K.SEARCH_ACTION)
    complete = F.size("_trace") == 0
    reasons = F.concat(
        F.col("_trace"),
        _problems(
            (recall < 1.0, F.concat(F.lit("missing_required:"), F.array_join(F.array_sort(F.array_except(required, got)), ","))),
            (F.size(bad) > 0, F.concat(F.lit("forbidden_action:"), F.array_join(F.array_sort(bad), ","))),
            (false_search, "false_search"), (missed, "missed_search"),
        ),
    )

    def when_run(c: Column) -> Column:
        return F.when(done, c)

    return joined.select(
        "case_id", "split", F.when(done, "scored").otherwise("not_run").alias("status"),
        when_run(recall).alias("required_recall"), when_run(F.size(bad) > 0).alias("forbidden_violation"),
        when_run(false_search).alias("false_search"), when_run(missed).alias("missed_search"),
        when_run(complete).alias("trace_complete"),
        when_run((recall == 1.0) & (F.size(bad) == 0) & complete).alias("full_pass"),
        when_run(reasons).alias("failure_reasons"),
    )


def action_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    scored = results.where(F.col("status") == "scored")

    def rate(name: str) -> Column:
        return F.avg(F.col(name).cast("double"))

    return scored.groupBy(*by).agg(
        F.count("*").alias("scored"), rate("full_pass").alias("full_pass_rate"),
        rate("forbidden_violation").alias("forbidden_rate"), rate("false_search").alias("false_search_rate"),
        rate("missed_search").alias("missed_search_rate"), rate("trace_complete").alias("trace_completeness"),
        F.avg("required_recall").alias("avg_required_recall"),
    )


def all_pass(results: DataFrame) -> DataFrame:
    """One row: every case has a complete passing score; false without any case."""
    ok = (F.col("status") == "scored") & F.coalesce(F.col("full_pass"), F.lit(False))
    return results.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("all_pass"))


def score_needs(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Score search decisions and stated needs; intent, subjects and focus terms.

    cases: case_id, expected_search, accepted_intents, subjects, focus_terms, aliases
    (map<string,array<string>>). runs: case_id, actual_search, intent, run_subjects,
    run_terms. A run states a need when its intent and lists are valid.
    """
    ran = runs.withColumn("_ran", F.lit(True))
    j = cases.join(ran, "case_id", "left")
    subjects = F.array_intersect(F.col("run_subjects"), _listed(K.SUBJECTS))
    terms = F.filter(F.transform("run_terms", strip), lambda t: t != "")
    stated = F.coalesce(
        F.col("intent").isin(list(K.SEARCH_INTENTS)) & (F.size(subjects) > 0) & (F.size(terms) > 0), F.lit(False)
    )
    expect, actual = F.col("expected_search"), F.coalesce(F.col("actual_search"), stated)
    spoken = normalize_text(F.array_join(terms, " "))
    wanted = F.array_distinct("subjects")
    shared = F.size(F.array_intersect(wanted, subjects))
    exact = (shared == F.size(wanted)) & (F.size(F.array_distinct(subjects)) == F.size(wanted))

    def heard(term: Column) -> Column:
        options = F.concat(F.array(term), F.coalesce(F.try_element_at(F.col("aliases"), term), _empty()))
        return F.exists(options, lambda o: F.contains(F.col("_spoken"), normalize_text(o)))

    j = j.withColumn("_spoken", spoken)
    recall = F.when(F.size("focus_terms") == 0, 1.0).otherwise(F.size(F.filter("focus_terms", heard)) / F.size("focus_terms"))
    both = expect & stated

    def graded(if_both: Column, if_quiet: Column) -> Column:
        return F.when(F.col("_ran").isNull(), F.lit(None)).when(both, if_both).when(~expect, if_quiet)

    return j.select(
        "case_id", F.when(F.col("_ran").isNull(), "not_run").otherwise("scored").alias("status"),
        F.when(F.col("_ran").isNotNull(), actual & ~expect).alias("false_search"),
        F.when(F.col("_ran").isNotNull(), ~actual & expect).alias("missed_search"),
        graded(F.array_contains("accepted_intents", F.col("intent")), ~stated).alias("intent_match"),
        graded(exact, ~stated).alias("subject_exact"),
        graded(shared / F.size(wanted), (~stated).cast("double")).alias("subject_recall"),
        graded(recall, (~stated).cast("double")).alias("focus_recall"),
        F.when(
            F.col("_ran").isNotNull(), (actual == expect) & (~expect | F.coalesce(both & exact, F.lit(False)))
        ).alias("strict_pass"),
    )


def join_runs(cases: DataFrame, runs: DataFrame, missing: str = "not_run") -> DataFrame:
    """Cases left-joined to runs, with a status for cases that have none."""
    return cases.join(runs.withColumn("_ran", F.lit(True)), "case_id", "left").withColumn(
        "status", F.when(F.col("_ran").isNull(), missing).otherwise("scored")
    ).drop("_ran")


# --- matching events -------------------------------------------------------

def event_candidates(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Score of every expected event against every recorded event of its case.

    cases: case_id, user_turn, expected array<struct<job, concepts array<array<string>>>>.
    events: case_id, event_index, intent, query, request_turn, queries, has_chunks.
    """
    # The expected events are a short list on the case row; the recorded events stay rows.
    wanted = cases.select(
        "case_id", normalize_text(F.col("user_turn")).alias("_turn"), F.posexplode("expected").alias("position", "e")
    )
    query = F.when(~_blank(F.col("query")), F.col("query"))
    named = events.select(
        "case_id", "event_index",
        (F.coalesce(F.col("intent").isin(list(K.SEARCH_INTENTS)), F.lit(False)) & query.isNotNull()).alias("contract"),
        normalize_text(F.coalesce(query, F.lit(""))).alias("_q"), normalize_text(F.col("request_turn")).alias("_t"),
        F.coalesce(
            query.isNotNull() & (F.size("queries") == 1)
            & (normalize_text(F.try_element_at(F.col("queries"), F.lit(1))) == normalize_text(query)), F.lit(False)
        ).alias("executed"),
        F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"),
    )
    met = scale.join_sized(named, wanted, ["case_id"])
    hits = F.size(
        F.filter("e.concepts", lambda g: F.exists(g, lambda a: F.contains(F.col("_q"), normalize_text(a))))
    )
    met = met.withColumn("recall", hits / F.size("e.concepts")).withColumn(
        "turn_match", F.coalesce(F.col("_t") == F.col("_turn"), F.lit(False))
    )
    flags = ("contract", "turn_match", "executed", "has_chunks")
    score = F.col("recall") * 4
    for flag in flags:
        score = score + F.col(flag).cast("int")
    return met.select(
        "case_id", "position", "event_index", F.col("e.job").alias("job"), "recall", *flags, score.alias("score")
    )


def match_events(cases: DataFrame, events: DataFrame) -> DataFrame:
    """One row per case: greedy one-to-one matching of expected to recorded events.

    Each expected event, in order, takes the best unused recorded event, the first among
    equals. With n expected events only the n best recorded events of each can ever be
    taken, so at most n * n candidates of a case are brought together.
    """
    size = cases.select("case_id", F.size("expected").alias("_n"))
    candidates = event_candidates(cases, events)
    order = [F.col("score").desc(), F.col("event_index").asc()]
    best = scale.top_n(
        candidates.join(size, "case_id"), ["case_id", "position"], order, F.col("_n"), "event_index", rank="_r"
    )
    fields = ("position", "_r", "event_index", "recall", "contract", "turn_match", "executed", "has_chunks")
    gathered = best.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("c"))
    total = events.groupBy("case_id").agg(F.count("*").alias("actual_count"))
    joined = cases.join(gathered, "case_id", "left").join(total, "case_id", "left")

    pick_type = "struct<recall:double,contract:boolean,turn_match:boolean,executed:boolean,has_chunks:boolean>"
    start = F.struct(_empty("array<long>").alias("used"), F.array().cast(f"array<{pick_type}>").alias("picks"))

    def take(acc: Column, position: Column) -> Column:
        free = F.filter(
            F.coalesce(F.col("c"), F.array().cast(best_type)),
            lambda c: (c["position"] == position) & ~F.array_contains(acc["used"], c["event_index"].cast("long")),
        )
        chosen = F.try_element_at(free, F.lit(1))
        nothing = F.lit(False)
        pick = F.struct(
            F.coalesce(chosen["recall"], F.lit(0.0)).alias("recall"),
            *[F.coalesce(chosen[f], nothing).alias(f) for f in ("contract", "turn_match", "executed", "has_chunks")],
        )
        used = F.when(F.size(free) > 0, F.concat(acc["used"], F.array(chosen["event_index"].cast("long")))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["picks"], F.array(pick)).alias("picks"))

    best_type = joined.schema["c"].dataType
    n = F.size("expected")
    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("m", F.aggregate(positions, start, take))
    actual = F.coalesce("actual_count", F.lit(0))
    extra = F.greatest(F.lit(0), actual - F.size("m.used"))

    def passes(p: Column) -> Column:
        return (p["recall"] == 1.0) & p["contract"] & p["turn_match"] & p["executed"] & p["has_chunks"]

    def reasons(p: Column, e: Column) -> Column:
        job = e["job"]
        return _problems(
            (~p["contract"], F.concat(F.lit("current_contract_missing:"), job)),
            (~p["turn_match"], F.concat(F.lit("user_turn_mismatch:"), job)),
            (p["recall"] < 1.0, F.concat(F.lit("query_concept_miss:"), job, F.lit(":"), F.format_string("%.3f", p["recall"]))),
            (~p["executed"], F.concat(F.lit("query_not_executed:"), job)),
            (~p["has_chunks"], F.concat(F.lit("missing_chunks:"), job)),
        )

    failures = F.when(
        n == 0,
        _problems((actual > 0, F.concat(F.lit("unexpected_source_events:"), actual.cast("string")))),
    ).otherwise(
        F.concat(
            F.flatten(F.zip_with("m.picks", "expected", reasons)),
            _problems((extra > 0, F.concat(F.lit("extra_events:"), extra.cast("string")))),
        )
    )
    matched = F.size(F.filter("m.picks", passes))
    return joined.select(
        "case_id", n.alias("expected_count"), actual.alias("actual_count"), matched.alias("matched"),
        F.when(n == 0, actual).otherwise(extra).alias("extra"), failures.alias("failure_reasons"),
        F.when((matched == n) & (extra == 0) & ((n > 0) | (actual == 0)), "passed").otherwise("failed").alias("status"),
    )


REL_TOL, ABS_TOL = 1e-6, 1e-9
GIANT_KEY = 1 << 17


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    """Each expected value in order takes the first unused recorded value within tolerance."""
    group = group.sort_values("position", kind="stable")
    left = group.value[~group.is_e].tolist()
    matched = 0
    for want in group.value[group.is_e]:
        for at, value in enumerate(left):
            if abs(want - value) <= max(REL_TOL * max(abs(want), abs(value)), ABS_TOL):
                del left[at]
                matched += 1
                break
    n = int(group.is_e.sum())
    head = group.iloc[[0]][["case_id", "metric", "inputs"]]
    return head.assign(expected=n, actual=len(group) - n, matched=matched)


def _pieces(counted: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """Counted values with `_piece`: the values of a key, cut at gaps above the tolerance.

    Values are dealt to ranges of (key, value), so that one key may be in many tasks. Each
    range cuts its own values; then a key's ranges, one row each, tell where a piece goes on
    from one range into the next.
    """
    ranges = [parts] if parts else []
    dealt = stored(counted.repartitionByRange(*ranges, *keys, "value").withColumn("_part", F.spark_partition_id()), "values")
    by_value = Window.partitionBy("_part", *keys).orderBy("value")
    close = economics.is_close(F.col("value"), F.lag("value").over(by_value), REL_TOL, ABS_TOL)
    cut = dealt.withColumn("_new", F.when(close, 0).otherwise(1)).withColumn(
        "_piece", F.sum("_new").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    )
    edges = cut.groupBy("_part", *keys).agg(
        F.min(F.struct("_piece", "value")).alias("_first"), F.max("value").alias("_last"), F.max("_piece").alias("_n")
    )
    in_order = Window.partitionBy(*keys).orderBy("_part")
    goes_on = economics.is_close(F.col("_first.value"), F.lag("_last").over(in_order), REL_TOL, ABS_TOL)
    # The first piece of a range that goes on has the number of the last piece before.
    before = F.sum(F.col("_n") - F.col("_same")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    edges = edges.withColumn("_same", F.when(goes_on, 1).otherwise(0)).select(
        *[F.col(k).alias(f"_{k}") for k in ("_part", *keys)], before.alias("_before")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("_part", *keys)]
    return cut.join(edges, same).select(*counted.columns, (F.col("_piece") + F.col("_before")).alias("_piece"))


def _pieces_by_key(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values with `_piece`, each key in one task, which suits keys of a bounded number of values."""
    by_value = Window.partitionBy(*keys).orderBy("value")
    close = economics.is_close(F.col("value"), F.lag("value").over(by_value), REL_TOL, ABS_TOL)
    return counted.withColumn("_new", F.when(close, 0).otherwise(1)).withColumn(
        "_piece", F.sum("_new").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_new")


def match_calculations(
    expected: DataFrame, actual: DataFrame, parts: int | None = None, giant: int = GIANT_KEY
) -> DataFrame:
    """(case_id, metric, inputs, expected, actual, matched): one-to-one within tolerance.

    expected/actual: case_id, position, metric, inputs map<string,double>, value. Inputs
    come back as entries sorted by name. Rows are counted by value first. The values of a
    key are then cut at gaps above the tolerance; a piece within the tolerance matches by
    counts alone. Only the rows of a longer chain of close values, in which the order decides,
    are brought together and matched in order. Keys of more than `giant` values are cut by ranges
    of their values (all keys, in `parts` ranges, if these are given).
    """
    def tagged(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            "case_id", "metric", F.array_sort(F.map_entries("inputs")).alias("inputs"),
            F.col("value").cast("double").alias("value"), F.col("position").cast("long").alias("position"),
            F.lit(side == "e").alias("is_e"),
        )

    keys = ["case_id", "metric", "inputs"]
    own = F.col("is_e")
    sums = [F.sum(c).alias(c) for c in ("expected", "actual", "matched")]

    def renamed(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_{k}") for k in (*keys, *more)])

    def equal(*more: str) -> list[Column]:
        return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, *more)]

    rows = tagged(expected, "e").unionByName(tagged(actual, "a"))
    counted = rows.groupBy(*keys, "value").agg(
        F.count(F.when(own, 1)).alias("e"), F.count(F.when(~own, 1)).alias("a")
    )
    if parts:
        cut = _pieces(counted, keys, parts)
    else:
        counted = stored(counted, "counted")
        wide = stored(renamed(counted.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > giant)), "giants")
        if wide.isEmpty():
            cut = _pieces_by_key(counted, keys)
        else:
            cut = _pieces_by_key(counted.join(wide, equal(), "left_anti"), keys).unionByName(
                _pieces(counted.join(wide, equal(), "left_semi"), keys, None)
            )
    # A null value matches nothing and forms a piece of its own.
    known = F.col("value").isNotNull()
    tight = economics.is_close(F.min("value"), F.max("value"), REL_TOL, ABS_TOL)
    every = cut.groupBy(*keys, "_piece").agg(
        F.sum("e").alias("expected"), F.sum("a").alias("actual"),
        F.least(F.sum(F.when(known, F.col("e")).otherwise(0)), F.sum(F.when(known, F.col("a")).otherwise(0))).alias("matched"),
        F.coalesce(tight, F.lit(True)).alias("_tight"),
    )
    # Per key, what its tight pieces give, and whether it has others; each key's rows are together.
    by_key = stored(
        every.groupBy(*keys).agg(
            *[F.coalesce(F.sum(F.when(F.col("_tight"), F.col(c))), F.lit(0)).alias(c) for c in ("expected", "actual", "matched")],
            F.bool_or(~F.col("_tight")).alias("_loose"),
        ), "keys",
    )
    done = by_key.drop("_loose")
    loose_keys = renamed(by_key.where("_loose"))
    if loose_keys.isEmpty():
        return done
    kinds = {f.name: f.dataType.simpleString() for f in counted.schema.fields}
    cut = stored(cut.join(loose_keys, equal(), "left_semi"), "pieces")
    low, high = F.min("value"), F.max("value")
    long = cut.groupBy(*keys, "_piece").agg(low.alias("_low"), high.alias("_high")).where(
        ~F.coalesce(economics.is_close(F.col("_low"), F.col("_high"), REL_TOL, ABS_TOL), F.lit(True))
    )
    chains = cut.join(renamed(long, "_piece"), equal("_piece"), "left_semi").select(
        *[F.col(k).alias(f"_{k}") for k in (*keys, "value")], "_piece"
    )
    loose = rows.join(chains, equal("value")).groupBy(*keys, "_piece").applyInPandas(
        lambda g: _greedy(g),
        ", ".join(f"{k} {kinds[k]}" for k in keys) + ", expected long, actual long, matched long",
    )
    return done.unionByName(loose).groupBy(*keys).agg(*sums)


def score_calculations(cases: DataFrame, runs: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Pass or fail per case, with the failures of its actions and calculations.

    cases: case_id, expected_actions, forbidden_actions. runs: case_id, actions.
    """
    matched = match_calculations(expected, actual).where(F.col("expected") > F.col("matched"))
    # One reason for each expected event that is not matched, by metric.
    missing = matched.groupBy("case_id", "metric").agg(F.sum(F.col("expected") - F.col("matched")).alias("n")).groupBy("case_id").agg(
        F.sort_array(F.collect_list(F.struct("metric", "n"))).alias("_l")
    ).select(
        "case_id",
        F.flatten(
            F.transform("_l", lambda m: F.array_repeat(F.concat(F.lit("missing_calculation_event:"), m["metric"]), m["n"].cast("int")))
        ).alias("_lost"),
    )
    n_expected = expected.groupBy("case_id").agg(F.count("*").alias("_e"))
    n_actual = actual.groupBy("case_id").agg(F.count("*").alias("_a"))
    j = (
        join_runs(cases, runs, "missing_run").join(missing, "case_id", "left")
        .join(n_expected, "case_id", "left").join(n_actual, "case_id", "left")
    )
    acts = F.coalesce("actions", _empty())
    none_expected, some = F.coalesce("_e", F.lit(0)) == 0, F.coalesce("_a", F.lit(0)) > 0
    reasons = F.concat(
        F.transform(F.array_except("expected_actions", acts), lambda a: F.concat(F.lit("missing_action:"), a)),
        F.transform(F.array_intersect("forbidden_actions", acts), lambda a: F.concat(F.lit("forbidden_action:"), a)),
        F.coalesce("_lost", _empty()),
        _problems(
            (none_expected & some, "unexpected_calculation_event"),
            (F.array_contains(acts, "calculate") & ~some, "calculate_without_calculation_events"),
        ),
    )
    lost = F.col("status") == "missing_run"
    return j.withColumn(
        "failure_reasons", F.when(lost, F.array(F.lit("missing_run"))).otherwise(reasons)
    ).select(
        "case_id",
        F.when(lost, "missing_run").when(F.size("failure_reasons") == 0, "pass").otherwise("fail").alias("status"),
        "failure_reasons",
    )


PACKET_TURNS = 512


def _packets(turns: pa.Table, texts: pa.Table) -> pa.Table:
    """Packets of the turns of one part from the texts that the part names."""
    where: dict = {}
    for row, chunk in enumerate(texts["chunk_id"].to_pylist()):
        where.setdefault(chunk, []).append(row)
    body = texts["text"].combine_chunks()
    for rows in where.values():
        if len(rows) > 1:  # repeated passages come in the order of their texts
            rows.sort(key=lambda r: (body[r].is_valid, body[r].as_py() or ""))
    turn_ids = turns["turn_id"].to_pylist()
    named: dict = {}
    for turn, ids in zip(turn_ids, turns["ids"].to_pylist(), strict=True):
        if turn is not None:
            named.setdefault(turn, Counter()).update(enumerate(ids))
    packets: dict = {None: ([], [], [], [])}
    for turn, entries in named.items():
        at, ids, rows, missing = packets[turn] = ([], [], [], [])
        for (place, chunk), n in sorted(entries.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1])):
            found = where.get(chunk, []) if chunk is not None else []
            if not found:
                missing += [chunk] * n
            for row in found:
                at += [place] * n
                ids += [chunk] * n
                rows += [row] * n
    each = [packets[turn] for turn in turn_ids]
    kind = turns.schema.field("ids").type.value_type

    def flat(k: int, kind: pa.DataType) -> pa.Array:
        return pa.array([x for packet in each for x in packet[k]], kind)

    def ends(k: int) -> pa.Array:
        return pa.array([0, *accumulate(len(packet[k]) for packet in each)], pa.int32())

    passages = pa.StructArray.from_arrays(
        [flat(0, pa.int32()), flat(1, kind), body.take(flat(2, pa.int64()))], names=["at", "chunk_id", "text"]
    )
    return pa.table({
        "turn_id": turns["turn_id"], "passages": pa.ListArray.from_arrays(ends(0), passages),
        "missing_ids": pa.ListArray.from_arrays(ends(3), flat(3, kind)),
    })


def evidence_packets(turns: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages behind each turn in order (inspected, then cited) and the ids without one.

    turns: turn_id, inspected (array), cited (array). passages: chunk_id, text. Turns are dealt to parts
    of about PACKET_TURNS; a text travels once to each part that names it, not once for each turn.
    """
    ids = F.array_distinct(F.concat(F.coalesce("inspected", _empty()), F.coalesce("cited", _empty())))
    parts = F.lit(turns.count() // PACKET_TURNS + 1)
    # Turns without an id have empty packets and need not meet.
    part = F.when(F.col("turn_id").isNull(), F.pmod(F.monotonically_increasing_id(), parts)).otherwise(
        F.pmod(F.xxhash64("turn_id"), parts)
    )
    named = turns.select("turn_id", ids.alias("ids"), part.alias("_part"))
    wanted = named.where(F.col("turn_id").isNotNull()).select("_part", F.explode("ids").alias("chunk_id")).distinct()
    texts = wanted.join(passages.select("chunk_id", "text"), "chunk_id").select(F.col("_part").alias("_of"), "chunk_id", "text")
    kind = {c.name: c.dataType.simpleString() for c in [*named.schema, *texts.schema]}
    chunk = kind["chunk_id"]
    return named.groupBy("_part").cogroup(texts.groupBy("_of")).applyInArrow(
        lambda own, found: _packets(own, found),
        f"turn_id {kind['turn_id']}, passages array<struct<at:int,chunk_id:{chunk},text:{kind['text']}>>, missing_ids array<{chunk}>",
    )


def bind_audits(audits: DataFrame, packets: DataFrame, reviewer: str) -> DataFrame:
    """Check audits against the frozen answers they judge.

    audits: case_id, line, answer_sha256, reviewer, claims array<boolean>, overall_pass.
    packets: case_id, answer, packet_sha256, category, scenario, run_valid, latency_ms.
    """
    j = duplicates(audits, "case_id", "line").join(packets.withColumn("_p", F.lit(True)), "case_id", "left")
    digest = F.sha2("answer", 256)
    current = F.coalesce((digest == F.col("answer_sha256")) & (digest == F.col("packet_sha256")), F.lit(False))
    there = F.col("_p").isNotNull()
    supported = F.size(F.filter("claims", lambda c: F.coalesce(c, F.lit(False))))
    out = j.withColumn("current", current).withColumn(
        "claim_count", F.coalesce(F.size("claims"), F.lit(0))
    ).withColumn("supported_claims", F.coalesce(supported, F.lit(0)))
    return out.withColumn(
        "errors",
        _problems(
            (F.col("is_duplicate"), "duplicate audit"),
            (F.col("answer_sha256").isNull(), "missing fields: answer_sha256"),
            (F.col("overall_pass").isNull(), "missing fields: overall_pass"),
            (F.col("claims").isNull(), "missing fields: claims"),
            (~F.col("reviewer").eqNullSafe(F.lit(reviewer)), "unexpected reviewer"),
            (~there, "missing frozen trial artifacts"),
            (there & ~F.col("current"), "answer hash does not match audit"),
            (there & ~F.coalesce("run_valid", F.lit(False)), "frozen trial is not workflow-valid"),
        ),
    ).withColumn(
        "passed",
        there & F.col("current") & F.coalesce("run_valid", F.lit(False)) & F.coalesce("overall_pass", F.lit(False))
        & (F.col("supported_claims") == F.col("claim_count")),
    ).drop("_p", "is_duplicate")


def all_audits_pass(bound: DataFrame) -> DataFrame:
    return bound.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_pass"))
