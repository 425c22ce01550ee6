"""Economics, snapshots, traces and metrics: literal cases and brute force."""

import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillrank.functions import economics as U
from quillrank.operators import evidence as E
from quillrank.operators import labels as J
from quillrank.operators import metrics as M
from quillrank.operators import snapshot as S
from quillrank.operators import traces as T
from quillrank.plans.business import named
from quillrank.session import scratch
from quillrank.sources import files as SF
from quillrank.streaming import turns as ST


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def lit(*values):
    return [F.lit(v) for v in values]


def test_formulas(spark):
    assert one(spark, U.cac(*lit(4000.0, 8))) == 500
    assert one(spark, U.gross_profit(*lit(100.0, 20.0))) == 80
    assert one(spark, U.gross_margin(*lit(100.0, 20.0))) == 0.8
    assert one(spark, U.payback_months(*lit(160.0, 80.0, 80.0))) == 2
    assert one(spark, U.cfa_level(*lit(100.0, 250.0))) == 3
    assert one(spark, U.payback_months(*lit(160.0, 80.0, 0.0))) == math.inf
    assert one(spark, U.lifetime_gross_profit(*lit(100.0, 0.0, 0.5))) is None
    assert one(spark, U.calculate(F.lit("churn"), F.create_map(*lit("a", 1.0)))).error == "unsupported metric: churn"


def diagnosis(spark, **k):
    got = {"cac": 100.0, "first": 0.0, "rec": 0.0, "ltgp": None, "margin": None, "service": False, **k}
    cols = [F.lit(got[n]).cast("double") for n in ("cac", "first", "rec", "ltgp", "margin")]
    return one(spark, U.diagnose(*cols, F.lit(got["service"])))


def test_diagnosis_order_and_renderings(spark):
    d = diagnosis(spark, ltgp=90.0)
    assert (d.constraint, d.ltgp_to_cac, d.cfa_level) == ("viability", 0.9, None)
    assert d.reason == "LTGP/CAC is 0.90:1, so each acquired customer burns gross profit."
    assert len(diagnosis(spark, ltgp=250.0).sections) == 3
    thin = diagnosis(spark, margin=0.5, service=True, first=500.0)
    assert (thin.constraint, thin.reason) == ("gross-margin", "Service gross margin is 50%, below the 80% rule of thumb.")
    assert diagnosis(spark, margin=0.5, first=500.0).constraint == "scale-ready"
    assert diagnosis(spark, first=50.0, rec=5.0).constraint == "monetization"
    assert diagnosis(spark, first=50.0).payback == "inf"
    assert diagnosis(spark, first=150.0).constraint == "cfa-level-2"
    assert diagnosis(spark, cac=0.0).error is not None


def snapshot(spark, **econ):
    import json

    payload = {
        "business": {"business_type": "gym"}, "money_model": {"core_offer": {"description": "plan"}},
        "economics": econ, "problem": {"user_goal": "grow"},
    }
    df = spark.createDataFrame([(1, json.dumps(payload))], "id int, payload string")
    return S.refresh(S.parse_snapshots(df)).first()


def test_snapshot_readiness(spark):
    r = snapshot(spark, cac=350, first_30_day_gross_profit=120, monthly_recurring_gross_profit=40)
    assert (r.ready_for_payback_diagnosis, r.advisory_status, r.payback_period_months) == (True, "diagnosable", 6.75)
    r = snapshot(spark, cac=350, first_30_day_gross_profit=120)
    assert r.payback_period_months is None
    assert "economics.monthly_recurring_gross_profit" in r.missing_fields
    assert not r.ready_for_payback_diagnosis
    r = snapshot(spark, cac=350, first_30_day_gross_profit=500)
    assert (r.payback_period_months, r.ready_for_payback_diagnosis) == (1.0, True)
    assert "economics.monthly_recurring_gross_profit" not in r.missing_fields
    assert r.money_model.upsell.exists is None


def test_answers_are_typed(spark):
    rows = [("b", 1, "economics.cac", " $1,200 "), ("b", 2, "economics.gross_margin", "15%"), ("b", 3, "money_model.upsell.exists", "Yes"), ("b", 4, "money_model.upsell.exists", "maybe"), ("b", 5, "business.icp", " "), ("b", 6, "money_model.core_offer.description", "plan")]
    got = {(r.seq, r.field): r for r in S.clean_answers(spark.createDataFrame(rows, "business string, seq int, field string, raw string")).collect()}
    assert float(got[(1, "economics.cac")].value) == 1200
    assert float(got[(2, "economics.gross_margin")].value) == 0.15
    assert got[(3, "money_model.upsell.exists")].value == "true"
    assert got[(4, "money_model.upsell.exists")].error is not None
    assert (5, "business.icp") not in got
    assert got[(6, "money_model.core_offer.exists")].value == "true"


# --- turns -----------------------------------------------------------------

def event(query="What now?", ran=None, ids=("payback-period:0",), **request):
    body = {"intent": "teaching_evidence", "user_turn": "why", "query": query, **request}
    return {"search_request": body, "queries": [query if ran is None else ran], "chunks": [{"id": i, "score": 1.0} for i in ids]}


def turn(**k):
    return {"turn_id": "t", "user_message": "u", "assistant_message": "a", "actions": ["answer"], "source_events": [], "calculation_events": [], "cited_chunk_ids": [], **k}


def checked(spark, **k):
    import json

    df = spark.createDataFrame([(json.dumps(turn(**k)),)], "j string").select(F.from_json("j", T.TURN_SCHEMA).alias("r")).select("r.*")
    return T.validate_turns(df).first()


def test_turn_validation_cases(spark):
    r = checked(spark, actions=["search_source_material", "answer"], source_events=[event()], cited_chunk_ids=["payback-period:0"] * 2)
    assert (r.valid, r.warnings, r.cited_chunk_ids) == (True, [], ["payback-period:0"])
    r = checked(spark, source_events=[event()], cited_chunk_ids=["other:1"])
    assert r.errors == ["cited_chunk_ids not found: other:1"]
    assert checked(spark, cited_chunk_ids=["x:1"], metadata={"external_cited_chunk_ids": ["x:1"]}).valid
    assert len(checked(spark, source_events=[event()]).warnings) == 1
    assert checked(spark, actions=["dance"]).errors == ["unknown action labels: dance"]
    assert not checked(spark, user_message=" ").valid
    for bad in (event(ran="other"), event(query="x" * 401), event(query="a\nb"), event(ids=()), event(ids=("",)), event(intent="guess"), event(top_k="5")):
        assert len(checked(spark, source_events=[bad], cited_chunk_ids=[]).errors) >= 1
    assert checked(spark, source_events=[event(query="What  NOW?", ran="what now?")], cited_chunk_ids=["payback-period:0"]).valid


def test_calculations_are_recomputed(spark):
    payback = {"cac": 1000.0, "month_one_gp": 10000.0, "monthly_recurring_gp": 0.0}

    def errors(metric, inputs, value, actions=("calculate",)):
        events = [{"metric": metric, "inputs": inputs, "value": value}] if metric else []
        return checked(spark, actions=list(actions), calculation_events=events).errors

    assert errors("payback", payback, 1.0) == []
    assert errors("payback", payback, 0.1) == ["calculation_events[1]: value does not match the recomputed result"]
    assert "missing input" in errors("cac", {"new_customers": 2.0}, 1.0)[0]
    assert errors(None, None, None) == ["calculate needs a calculation event"]
    assert errors("payback", {**payback, "month_one_gp": 0.0}, 1.0) == ["calculation_events[1]: result is not finite"]
    assert errors("cac", {}, 1.0) == ["calculation_events[1]: inputs must be a non-empty object"]


def test_session_paths(spark):
    import json

    def path(category, **k):
        df = spark.createDataFrame([(json.dumps(turn(**k)),)], "j string").select(F.from_json("j", T.TURN_SCHEMA).alias("r")).select("r.*")
        return df.select(T.session_path_error(F.lit(category)).alias("e")).first().e

    hybrid = {**event(), "retrieval_backend": "hybrid"}
    found = {"actions": ["search_source_material"], "source_events": [hybrid], "cited_chunk_ids": ["payback-period:0"]}
    assert path("source_grounded", actions=["search_source_material"]) == "no successful source event"
    assert path("source_grounded", **found) is None
    assert path("source_grounded", **{**found, "source_events": [event()]}) is not None
    assert path("calculation", actions=["calculate"], calculation_events=[{"metric": "cac", "inputs": {"a": 1.0}, "value": 1.0}]) is None
    assert path("clarification", actions=["clarify"]) is None
    assert path("clarification", actions=["answer"]) == "did not record clarify"
    assert path("clarification", **{**found, "actions": ["clarify"]}) == "unexpectedly searched source material"


# --- event matching --------------------------------------------------------

JOB = "case_id int, user_turn string, expected array<struct<job string, concepts array<array<string>>>>"
EVENT = "case_id int, event_index int, intent string, query string, request_turn string, queries array<string>, has_chunks boolean"


def matched(spark, expected, events, turn_text="what now"):
    cases = spark.createDataFrame([(1, turn_text, expected)], JOB)
    rows = spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], EVENT)
    return T.match_events(cases, rows).first()


def ev(query, **k):
    return (k.get("intent", "teaching_evidence"), query, "What now?", k.get("queries", [query]), True)


def test_event_matching_cases(spark):
    both = [("a", [["upsell"]]), ("b", [["gross profit"]])]
    r = matched(spark, both, [ev("gross profit"), ev("upsell offers")])
    assert (r.status, r.matched) == ("passed", 2)
    r = matched(spark, [("job", [["upsell"], ["gross profit"]])], [ev("upsell offers")])
    assert (r.status, r.failure_reasons) == ("failed", ["query_concept_miss:job:0.500"])
    r = matched(spark, [("job", [["upsell"]])], [ev("upsell", queries=["other"])])
    assert r.failure_reasons == ["query_not_executed:job"]
    r = matched(spark, [("job", [["upsell"]])], [ev("upsell"), ev("upsell")])
    assert r.failure_reasons == ["extra_events:1"]
    r = matched(spark, [], [ev("upsell")])
    assert (r.failure_reasons, r.status) == (["unexpected_source_events:1"], "failed")
    assert matched(spark, [], []).status == "passed"
    r = matched(spark, [("job", [["upsell"]])], [])
    assert len(r.failure_reasons) == 5


def norm(s):
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip()


def test_event_matching_against_a_direct_walk(spark):
    rng = random.Random(4)
    words = ["upsell", "gross profit", "price", "churn"]
    cases, rows, want = [], [], {}
    for c in range(60):
        expected = [(f"j{i}", [[w] for w in rng.sample(words, rng.randint(1, 3))]) for i in range(rng.randint(0, 4))]
        events = [ev(" ".join(rng.sample(words, rng.randint(1, 3))), intent=rng.choice(["teaching_evidence", "x"])) for _ in range(rng.randint(0, 6))]
        cases.append((c, "what now", expected))
        rows += [(c, i, *e) for i, e in enumerate(events)]
        used, good = set(), 0
        for _, concepts in expected:
            best, at = -1.0, None
            for i, e in enumerate(events):
                recall = sum(any(norm(a) in norm(e[1]) for a in g) for g in concepts) / len(concepts)
                ok = e[0] == "teaching_evidence"
                score = 4 * recall + ok + 3
                if i not in used and score > best:
                    best, at, passed = score, i, recall == 1.0 and ok
            if at is not None:
                used.add(at)
                good += passed
        want[c] = (good, len(events) - len(used) if expected else len(events))
    got = T.match_events(spark.createDataFrame(cases, JOB), spark.createDataFrame(rows, EVENT)).collect()
    assert {r.case_id: (r.matched, r.extra) for r in got} == want


@pytest.mark.parametrize("parts", [None, 9])
def test_calculation_matching_against_a_direct_walk(spark, parts):
    rng = random.Random(9)
    kind = "case_id int, position int, metric string, inputs map<string,double>, value double"
    expected, actual, want = [], [], {}
    base = [1.0, 1.0 + 5e-7, 1.0 + 1.4e-6, 1.0 + 2.2e-6, 2.0, 0.0, 5e-10]
    for c in range(80):
        e = [(c, i, rng.choice(["cac", "ltgp"]), {"a": rng.choice([1.0, 2.0]), "b": 3.0}, rng.choice(base)) for i in range(rng.randint(0, 7))]
        a = [(c, i, rng.choice(["cac", "ltgp"]), {"b": 3.0, "a": rng.choice([1.0, 2.0])}, rng.choice(base)) for i in range(rng.randint(0, 7))]
        left, hits = list(a), 0
        for x in e:
            at = next((i for i, y in enumerate(left) if x[2] == y[2] and x[3] == y[3] and math.isclose(x[4], y[4], rel_tol=1e-6, abs_tol=1e-9)), None)
            if at is not None:
                left.pop(at)
                hits += 1
        expected, actual = expected + e, actual + a
        want[c] = (len(e), len(a), hits)
    # One case has most values, in several ranges; a piece may go on from range to range.
    long = [(99, i, "cac", {"a": 1.0}, 1.0 + i // 2 * 3e-6 + i % 2 * 8e-7) for i in range(300)]
    run = [(98, i, "cac", {"a": 1.0}, 1.0 + i * 9e-7) for i in range(60)]
    for part in (long, run):
        expected, actual = expected + part[::2], actual + part[1::2]
        want[part[0][0]] = (len(part[::2]), len(part[1::2]), len(part) // 2)
    expected, actual = [*expected, (97, 0, "cac", {}, None)], [*actual, (97, 0, "cac", {}, None)]
    want[97] = (1, 1, 0)
    got = T.match_calculations(spark.createDataFrame(expected, kind), spark.createDataFrame(actual, kind), parts)
    rows = got.groupBy("case_id").agg(F.sum("expected").alias("e"), F.sum("actual").alias("a"), F.sum("matched").alias("m")).collect()
    seen = {r.case_id: (r.e, r.a, r.m) for r in rows}
    assert seen == {c: v for c, v in want.items() if v[0] + v[1]}


def test_only_keys_of_many_values_are_cut_by_ranges(spark):
    kind = "case_id int, position int, metric string, inputs map<string,double>, value double"
    # Pairs within the tolerance, a chain that as a whole is not, and single values; one key has 400 values.
    values = {1: [1.0 + i // 2 * 3e-6 + i % 2 * 8e-7 for i in range(400)], 2: [1.0 + i * 9e-7 for i in range(20)], 3: [1.0, 2.0, 3.0, 3.0]}
    rows = [(c, i, "cac", {"a": 1.0}, v) for c, own in values.items() for i, v in enumerate(own)]
    frames = [spark.createDataFrame(x, kind) for x in (rows[::2], rows[1::2])]
    want = {1: (200, 200, 200), 2: (10, 10, 10), 3: (2, 2, 1)}
    for giant in (10, 100, 1000):
        got = T.match_calculations(*frames, giant=giant).collect()
        assert {r.case_id: (r.expected, r.actual, r.matched) for r in got} == want


def test_packets_carry_a_text_once_to_each_part(spark, monkeypatch):
    monkeypatch.setattr(T, "PACKET_TURNS", 3)
    asked = [(t, [1, 2, 1], [t, None]) for t in range(10)] + [(4, [7], None), (None, [1], [2])]
    turns = spark.createDataFrame(asked, "turn_id long, inspected array<long>, cited array<long>")
    passages = spark.createDataFrame([(1, "one"), (2, None), (5, "b"), (5, "a"), (None, "no")], "chunk_id long, text string")
    packets = T.evidence_packets(turns, passages)
    assert "CoGroup" in packets._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.turn_id, [tuple(p) for p in r.passages], r.missing_ids) for r in packets.collect()]
    both = [(0, 1, "one"), (1, 2, None)]
    want = [(t, both, [t, None]) for t in (0, 3, 6, 7, 8, 9)] + [(t, both, [None]) for t in (1, 2)]
    want += [(5, [*both, (2, 5, "a"), (2, 5, "b")], [None]), *[(4, both, [7, 4, None])] * 2, (None, [], [])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_interleaved_repeats_are_matched_in_order(spark):
    kind = "case_id int, position int, metric string, inputs map<string,double>, value double"
    expected = [(1, i, "cac", {"a": 1.0}, v) for i, v in enumerate([1.0000004, 1.0000004, 1.0000016])]
    actual = [(1, i, "cac", {"a": 1.0}, v) for i, v in enumerate([1.0, 1.0000008, 1.0])]
    frames = [spark.createDataFrame(rows, kind) for rows in (expected, actual)]
    r = T.match_calculations(*frames).first()
    assert (r.expected, r.actual, r.matched) == (3, 3, 2)
    cases = spark.createDataFrame([(1, [], []), (2, [], [])], "case_id int, expected_actions array<string>, forbidden_actions array<string>")
    runs = spark.createDataFrame([(1, ["calculate"]), (2, [])], "case_id int, actions array<string>")
    twice = spark.createDataFrame([*expected, (2, 0, "cac", {"a": 1.0}, 5.0), (2, 1, "cac", {"a": 2.0}, 5.0)], kind)
    got = {r.case_id: r.failure_reasons for r in T.score_calculations(cases, runs, twice, frames[1]).collect()}
    assert got == {1: ["missing_calculation_event:cac"], 2: ["missing_calculation_event:cac"] * 2}


# --- metrics ---------------------------------------------------------------

def test_completed_scores(spark):
    schema = "first_rank int, useful_count int, latency_ms double, error string"
    r = M.completed_scores(spark.createDataFrame([(1, 3, 1.0, None), (4, 1, 3.0, None)], schema), 5).first()
    assert (r.hit_at_1_pct, r.hit_at_3_pct, r.hit_at_5_pct, r.mean_first_rank) == (50, 50, 100, 2.5)
    assert (r.useful_results, r.result_slots, r.mean_useful, r.median_useful) == (4, 10, 2.0, 2.0)
    assert (r.precision_pct, r.noise_pct, r.histogram) == (40, 60, {1: 1, 3: 1})
    r = M.completed_scores(spark.createDataFrame([(1, 1, 1.0, None), (None, 0, None, "cli_timeout")], schema), 5).first()
    assert (r.completed, r.coverage_pct, r.hit_at_1_pct, r.errors) == (1, 50, 100, 1)


def test_graded_scores_by_hand(spark):
    found = "array<struct<variant:string,rank:int,score:double>>"
    rows = [("q", "a", 2, [("v", 2, 1.0)]), ("q", "b", 0, [("v", 1, 1.0)]), ("q", "c", 1, []), ("q", "d", None, [("v", 3, 1.0)]), ("r", "a", 0, []), ("s", "a", 1, [])]
    pool = spark.createDataFrame(rows, f"query_id string, chunk_id string, relevance int, retrieved_by {found}")
    some = {r.query_id: r for r in M.graded_scores(pool, {"v": ["v"]}, 5).collect()}
    assert set(some) == {"q"}
    ideal = 3 + 1 / math.log2(3)
    assert some["q"].ndcg == pytest.approx((3 / math.log2(3)) / ideal)
    assert (some["q"].precision, some["q"].recall) == (0.2, 0.5)
    every = {r.query_id: r for r in M.graded_scores(pool, {"v": ["v"]}, 5, all_queries=True).collect()}
    assert set(every) == {"q", "r", "s"}
    assert (every["r"].ndcg, every["r"].recall, every["s"].recall) == (0.0, 0.0, 0.0)


def test_need_scoring_hears_aliases(spark):
    cases = spark.createDataFrame([(1, True, ["teaching_evidence"], ["offers"], ["get leads to engage"], {"get leads to engage": ["engagement", "STR owners"]})], "case_id int, expected_search boolean, accepted_intents array<string>, subjects array<string>, focus_terms array<string>, aliases map<string,array<string>>")
    runs = spark.createDataFrame([(1, True, "teaching_evidence", ["offers"], ["STR owners engagement"])], "case_id int, actual_search boolean, intent string, run_subjects array<string>, run_terms array<string>")
    r = T.score_needs(cases, runs).first()
    assert (r.focus_recall, r.subject_exact, r.strict_pass) == (1.0, True, True)


def test_gates_reject_missing_and_failed_rows(spark):
    rows = "case_id int, status string, full_pass boolean"
    for data, want in (([(1, "scored", True)], True), ([(1, "scored", True), (2, "not_run", None)], False), ([(1, "scored", False)], False), ([], False)):
        assert T.all_pass(spark.createDataFrame(data, rows)).first().all_pass is want


def test_audits_bind_to_their_answer(spark):
    from hashlib import sha256

    digest = sha256(b"answer").hexdigest()
    audits = spark.createDataFrame([(1, 1, "0" * 64, "x", [True, False], True), (2, 1, digest, "x", [True], True)], "case_id int, line int, answer_sha256 string, reviewer string, claims array<boolean>, overall_pass boolean")
    packets = spark.createDataFrame([(1, "answer", digest, True), (2, "answer", digest, True)], "case_id int, answer string, packet_sha256 string, run_valid boolean")
    got = {r.case_id: r for r in T.bind_audits(audits, packets, "x").collect()}
    assert (got[1].current, got[1].supported_claims, got[1].claim_count, got[1].passed) == (False, 1, 2, False)
    assert got[2].passed
    assert T.all_audits_pass(T.bind_audits(audits, packets, "x")).first().all_pass is False


def test_span_overlap_ignores_bucket_width(spark):
    rng = random.Random(6)

    def spans(n):
        out = []
        for i in range(n):
            s = rng.randint(0, 900)
            out.append(("k", i, s, s + rng.randint(1, 400)))
        return out

    left, right = spans(40), spans(30)
    want = {(a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if min(a[3], b[3]) > max(a[2], b[2])}
    kind = "k string, id int, start int, end int"
    for width in (7, 100, 5000):
        got = J.span_overlaps(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), ["k"], width)
        rows = [(r.l_id, r.r_id, r.overlap) for r in got.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == want


def test_phrases_match_inside_words(spark):
    texts = spark.createDataFrame([(1, "a cacophony of upsell offers"), (2, "cac"), (3, "")], "q int, t string")
    phrases = spark.createDataFrame([("cac",), ("upsell offers",), ("offers upsell",), ("a",)], "p string")
    got = {(r.q, r.phrase) for r in E.phrases_in(texts, phrases, "q", "t", "p").collect()}
    assert got == {(1, "cac"), (1, "upsell offers"), (1, "a"), (2, "cac"), (2, "a")}


def test_many_phrases_against_a_direct_search(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abc d") for _ in range(rng.randint(0, 60)))) for i in range(200)]
    phrases = sorted({"".join(rng.choice("abc d") for _ in range(rng.randint(0, 7))) for _ in range(150)} | {"zzzz"})
    frames = spark.createDataFrame(texts, "q int, t string"), spark.createDataFrame([(p,) for p in phrases], "p string")
    got = [(r.q, r.phrase) for r in E.phrases_in(*frames, "q", "t", "p").collect()]
    assert sorted(got) == sorted((i, p) for i, t in texts for p in phrases if p and p in t)
    assert E.phrases_in(frames[0], frames[1].where("p = ''"), "q", "t", "p").count() == 0


# --- files and streams -----------------------------------------------------

def test_jsonl_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n   \n{"x": 3}\n')
    (tmp_path / "b.jsonl").write_text('\n{"x": 9}')
    rows = SF.read_jsonl(spark, str(tmp_path), "x int", line_numbers=True).collect()
    assert {(r.x, r.line_number) for r in rows} == {(1, 1), (2, 3), (3, 5), (9, 2)}
    assert SF.read_jsonl(spark, str(tmp_path), "x int").count() == 4


def test_run_artifacts_last_path_wins(spark, tmp_path):
    from pyspark.sql.types import StructType

    for folder, body in (("a/1", '{"case_id": "c", "n": 1}'), ("b", '{"case_id": "c",\n "n": 2}'), ("z", "{broken"), ("k", '{"n": 5}'), ("d", '{"case_id": "e", "n": 3}')):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "run.json").write_text(body)
    (tmp_path / "z" / "other.json").write_text('{"case_id": "c", "n": 7}')
    rows = SF.read_runs(spark, str(tmp_path), StructType.fromDDL("case_id string, n int")).collect()
    assert {(r.case_id, r.n) for r in rows} == {("c", 2), ("e", 3)}


def test_text_and_local_document_scans(spark, tmp_path):
    (tmp_path / "cac.txt").write_text("one\ntwo")
    (tmp_path / "notes.md").write_bytes(b"bad \xff byte")
    (tmp_path / ".state" / "x").mkdir(parents=True)
    (tmp_path / ".state" / "x" / "s.txt").write_text("hidden")
    assert [(r.chapter, r.text) for r in SF.read_texts(spark, str(tmp_path)).collect()] == [("cac", "one\ntwo")]
    found = {r.path: r.text for r in SF.read_local_documents(spark, str(tmp_path), skip=".state").collect()}
    assert found == {"cac.txt": "one\ntwo", "notes.md": "bad � byte"}


def test_query_variant_ingest(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    variants = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("d", ["x", "y"])], "case_id string, query_variants array<string>")
    got = {r.case_id: r.error for r in SF.ingest_variants(cases, variants, "m", "v").collect()}
    assert got == {"a": None, "b": "needs 2 to 4 variants", "c": "missing case", "d": "unknown case"}


def test_state_stream_ignores_arrival_order_and_replays(spark):
    base = scratch(spark, "assignments")
    kind = ST.ASSIGNMENT_SCHEMA
    late = [("b", 2, "economics.cac", "20", "conversation", None, None)]
    early = [("b", 1, "economics.cac", "10", "file", "f", "h"), ("b", 3, "business.icp", "shops", "conversation", None, None)]
    for rows in (late, early, late):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(f"{base}/in")
        ST.snapshot_state(ST.read_assignments(spark, f"{base}/in", 1), f"{base}/out", f"{base}/state").awaitTermination()
    latest = ST.current_state(spark.read.parquet(f"{base}/out"))
    assert {(r.field, r.value, r.seq) for r in latest.collect()} == {("economics.cac", "20", 2), ("business.icp", "shops", 3)}
    folded, bad = S.fold_assignments(latest)
    r = folded.first()
    assert (r.economics.cac, r.business_info.icp, bad.count()) == (20.0, "shops", 0)


def state_of(spark, out):
    return {(r.field, r.value, r.seq) for r in ST.read_state(spark, out).collect()}


def test_state_is_compacted_and_survives_replays(spark):
    base = scratch(spark, "compacted")
    assert state_of(spark, f"{base}/out") == set()
    want = {}
    for number in range(6):
        rows = [("b", 10 * number + i, f"f{i % 3}", f"v{number}-{i}", "file", None, None) for i in range(4)]
        spark.createDataFrame(rows, ST.ASSIGNMENT_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/in")
        stream = ST.read_assignments(spark, f"{base}/in", 1)
        ST.snapshot_state(stream, f"{base}/out", f"{base}/state", compact_every=2).awaitTermination()
        want.update({r[2]: (r[2], r[3], r[1]) for r in rows})
        assert state_of(spark, f"{base}/out") == set(want.values())
    upto, path = ST._generation(spark, f"{base}/out")
    assert upto == 5
    # Batches of the compacted table are pruned, and may be deleted with older tables.
    plan = ST.read_state(spark, f"{base}/out")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    assert ST.expire(spark, f"{base}/out") == 6 + 2
    assert state_of(spark, f"{base}/out") == set(want.values())
    # The last batch once more, as after a lost commit; then a compaction whose pointer was never written.
    commits = Path(f"{base}/state/commits".removeprefix("file:"))
    for name in ("5", ".5.crc"):
        (commits / name).unlink()
    ST.snapshot_state(ST.read_assignments(spark, f"{base}/in", 1), f"{base}/out", f"{base}/state", compact_every=2).awaitTermination()
    spark.createDataFrame([("b", 999, "f0", "orphan", "file", None, None)], ST.ASSIGNMENT_SCHEMA).write.parquet(f"{base}/out/generations/9-lost")
    ST.compact(spark, f"{base}/out", 3)
    assert state_of(spark, f"{base}/out") == set(want.values())


def test_nested_answers_open_to_dotted_fields(spark):
    texts = [
        '{"economics": {"cac": "$1,200", "gross_margin": 0.5}, "money_model": {"upsell": {"description": " more ", "exists": true, "x": {}}}}',
        '{"business": {"icp": ["a", {"b": 1}], "business_type": null}, "problem": {"user_goal": "{not opened"}, "a": {"": 3}}',
        "[1]", "{broken", None, '"text"', "{}", '{"d":' * 9 + "1" + "}" * 9, '{"d":' * 8 + "2" + "}" * 8,
    ]
    records = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "business int, seq int, answers string")
    answers, errors = S.flatten_answers(records)
    assert {(r.seq, r.field, r.raw) for r in answers.collect()} == {
        (0, "economics.cac", "$1,200"), (0, "economics.gross_margin", "0.5"), (0, "money_model.upsell.description", " more "),
        (0, "money_model.upsell.exists", "true"), (1, "business.icp", '["a",{"b":1}]'), (1, "problem.user_goal", "{not opened"),
        (1, "a.", "3"), (8, ".".join("d" * 8), "2"),
    }
    assert sorted((r.seq, r.error.split(":")[0]) for r in errors.collect()) == [
        *((i, "answers are no JSON object") for i in (2, 3, 4, 5)), (7, "nested too deep"),
    ]
    clean = {(r.seq, r.field): (r.value, r.error) for r in S.clean_records(records).collect()}
    assert clean[0, "economics.cac"] == ("1200.0", None)
    assert clean[0, "money_model.upsell.description"] == ("more", None)
    assert clean[7, ".".join("d" * 8)][1].startswith("nested too deep")


def test_null_ids_are_one_key_and_fixtures_must_be_there(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text("{}")
    files = SF.list_files(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["a/one.json"]
    rows = [(None, 1, "a/one.json"), (None, 2, "a/two.json"), ("x", 3, None), ("x", 4, "a/one.json"), ("y", 5, "")]
    cases = spark.createDataFrame(
        [(*r, True, "low", ["search_source_material"], []) for r in rows],
        "case_id string, line int, snapshot_fixture_path string, search_allowed boolean, ambiguity string, required_actions array<string>, forbidden_actions array<string>",
    ).repartition(5)
    got = {r.line: r.errors for r in T.validate_gate_cases(cases, files).collect()}
    lost = "missing snapshot_fixture_path"
    assert got == {1: [], 2: ["duplicate case_id", lost], 3: [lost], 4: ["duplicate case_id"], 5: [lost]}
    assert {r.line: r.errors for r in T.validate_gate_cases(cases).collect()}[5] == []
    audits = spark.createDataFrame(
        [(None, i, "h", "auditor", [True], True) for i in range(3)],
        "case_id string, line int, answer_sha256 string, reviewer string, claims array<boolean>, overall_pass boolean",
    ).repartition(3)
    packets = spark.createDataFrame([], "case_id string, answer string, packet_sha256 string, run_valid boolean")
    bound = {r.line: "duplicate audit" in r.errors for r in T.bind_audits(audits, packets, "auditor").collect()}
    assert bound == {0: False, 1: True, 2: True}


def test_snapshot_queries_parse_every_row(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("driver tables are not here")
    rows = named(spark, "/root/testdata/sf0.001")
    assert rows.where(F.col("business").isNull()).count() == 0


def test_terms_within_and_across_expected_chapters(spark):
    rng = random.Random(12)
    docs = [(f"c{i}", " ".join(rng.choices("ab cd e".split(), k=rng.choice([0, 1, 2, 30])))) for i in range(12)]
    body = dict(docs)
    cases = [(q, rng.sample(sorted(body), 3), [" ".join(rng.choices("ab cd e d".split(), k=rng.randrange(1, 7))) for _ in range(4)]) for q in range(40)]
    got = E.audit_terms(
        spark.createDataFrame(cases, "query_id int, expected array<string>, terms array<string>"),
        spark.createDataFrame(docs, "chapter string, text string"),
    ).collect()
    want = {(q, t): t not in " ".join(body[c] for c in expected) for q, expected, terms in cases for t in terms}
    assert {(r.query_id, r.term): r.absent for r in got} == want
