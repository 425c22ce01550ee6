"""Chunking and text functions against brute force in plain Python, and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank import constants as K
from quillrank.functions import text as X
from quillrank.operators import chunking as C
from quillrank.operators import labels as J


def value(spark, col, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in cols.items()] or [F.lit(1).alias("_")])
    return row.select(col.alias("v")).first().v


def windows(text, target, overlap):
    """Expected (text, start, end) of word windows, found by a direct walk."""
    ws, out, cursor, i = text.split(), [], 0, 0
    while i < len(ws):
        body = " ".join(ws[i : i + target])
        at = max(0, text.find(ws[i], cursor))
        out.append((body, at, min(len(text), at + len(body))))
        cursor = max(cursor, at)
        if i + target >= len(ws):
            break
        i += max(1, target - overlap)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    blanks = [" ", "  ", "\n", "\t", "\xa0", " ", "\x1d", " \n "]
    made = ["", "   ", "one", "　é fin\x85"]
    for n in (3, 12, 13, 40, 90):
        made.append("".join(rng.choice(["a", "ab", "ba", "c-1", "É", "x,y"]) + rng.choice(blanks) for _ in range(n)))
    return made


@pytest.mark.parametrize(("target", "overlap"), [(5, 2), (4, 6), (10, 0), (300, 50)])
def test_fixed_windows_match_a_direct_walk(spark, texts, target, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", C.fixed_windows(F.col("t"), target, overlap).alias("w")).collect()
    for row in rows:
        assert [tuple(w) for w in row.w] == windows(texts[row.i], target, overlap)


def test_words_split_like_python(spark):
    every = "x".join(chr(c) for c in [*range(0x250), *range(0x1670, 0x1690), *range(0x1800, 0x1810), *range(0x1FF0, 0x2070), 0x3000])
    assert value(spark, X.words(F.col("t")), t=every) == every.split()
    assert value(spark, X.strip(F.col("t")), t=" \x1f a b　\n") == "a b"


def boundary_walk(text):
    starts = [0]
    for m in re.finditer(K.BOUNDARY_PATTERN, text):
        if m.start() - starts[-1] > K.BOUNDARY_MIN_GAP:
            starts.append(m.start())
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        part = text[a:b].strip()
        if part:
            at = text.find(part, a)
            out.append((part, at, at + len(part)))
    return out


def test_boundary_parts_keep_far_cues_only(spark):
    filler = "word " * 60
    text = f" {filler}. First, close. Here's near{filler}\n\nStep two {filler}. so the key {filler}. Summary of it. FINALLY, end "
    got = [tuple(p) for p in value(spark, C.boundary_parts(F.col("t")), t=text)]
    assert got == boundary_walk(text)
    assert len(got) > 2
    assert any(p[0].startswith(". ") for p in got)


def test_framework_strategy_branches(spark):
    long_part = "token " * 900
    doc = f"intro\n## [§1] short part\n## [§2] {long_part}"
    rows = value(spark, C.chunk_array(F.col("t"), "framework-aware"), t=doc)
    assert [r.text.split()[0] for r in rows] == ["intro", "##", "##", "token"]
    assert all(doc[r.start :].startswith(r.text.split()[0]) for r in rows)
    assert len(value(spark, C.chunk_array(F.col("t"), "framework-aware"), t="  \n ")) == 0
    plain = value(spark, C.chunk_array(F.col("t"), "framework-aware"), t="token " * 700)
    assert [len(r.text.split()) for r in plain] == [650, 140]
    assert K.DEFAULT_STRATEGY == "framework-aware"
    with pytest.raises(ValueError, match="unknown chunking strategy"):
        C.chunk_array(F.col("t"), "by-page")


def test_routes_default_and_order(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "z")], "chapter string, text string")
    dim = spark.createDataFrame([("a", "upsells", ["offers"])], "chapter string, primary_subject string, secondary_subjects array<string>")
    got = {r.chunk_id: r.subjects for r in C.route_subjects(C.chunk_documents(docs, "fixed-300"), dim).collect()}
    assert got == {"a:0": ["upsells", "offers"], "b:0": ["offers"]}


def nearest_run(source, needle, estimated):
    found = [i for i in range(len(source) - len(needle) + 1) if source[i : i + len(needle)] == needle]
    return min(found, key=lambda i: abs(i - estimated)) if needle and found else None


def test_token_span_is_the_nearest_run(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        source = [rng.choice(["a", "b", "ab", "ba", "a-b"]) for _ in range(rng.randint(0, 14))]
        at = rng.randint(0, max(0, len(source) - 1))
        needle = source[at : at + rng.randint(1, 3)] if rng.random() < 0.8 else [rng.choice("ab") for _ in range(rng.randint(0, 3))]
        rows.append((source, needle, rng.randint(0, len(source) + 2)))
    df = spark.createDataFrame(rows, "s array<string>, n array<string>, e int")
    got = df.select("s", "n", "e", J.token_span(F.col("s"), F.col("n"), F.col("e")).alias("span")).collect()
    for r in got:
        want = nearest_run(list(r.s), list(r.n), r.e)
        assert (None if r.span is None else r.span.start) == want, r
        if want is not None:
            assert r.span.end == want + len(r.n)


def test_literal_text_cases(spark):
    assert value(spark, X.collapse_spaces(F.col("t")), t="  why   does this work?  ") == "why does this work?"
    assert value(spark, X.query_error(F.col("t")), t="ok") is None
    assert value(spark, X.query_error(F.col("t")), t="a\nb") == "query must be one line"
    assert value(spark, X.query_error(F.col("t")), t="x" * 401).startswith("query must be no more")
    assert value(spark, X.tokens_used(F.col("t")), t="x\nTokens used\n12,345\n") == 12345
    assert value(spark, X.tokens_used(F.col("t")), t="none") is None
    # The first replacement eats the blank that the second word would need.
    assert value(spark, X.normalize_numbers(F.col("t")), t="one one two-three") == "1 one 2 3"
    assert value(spark, X.money_values(F.col("t")), t="$1,200.50 and $3") == [1200.5, 3.0]
    assert value(spark, X.percent_values(F.col("t")), t="15 % of 2.5%") == [0.15, 0.025]
    assert value(spark, X.month_values(F.col("t")), t="8 Months, 1 month, 2months") == [8.0, 1.0]


def test_redaction_replaces_in_turn(spark):
    r = value(spark, X.redact(F.col("t"), F.array(F.lit(""), F.lit("key-1"), F.lit("zz"))), t="a key-1 b key-1")
    assert (r.text, r.exposed) == ("a [REDACTED] b [REDACTED]", True)
    assert value(spark, X.redact(F.col("t"), F.array(F.lit("zz"))), t="a").exposed is False


def test_prune_keeps_zero_and_false(spark):
    kind = T.StructType.fromDDL("a boolean, b double, c double, d string, e array<string>, f struct<g: string>")
    row = spark.createDataFrame([((False, 0.0, None, "", ["", "x"], (None,)),)], T.StructType([T.StructField("s", kind)]))
    assert row.select(F.to_json(X.prune_empty(F.col("s"), kind))).first()[0] == '{"a":false,"b":0.0,"e":["x"]}'


def test_blocks_and_reach_change_no_result(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "ab", "b", "cab", "long" * 9, "x-y"], k=rng.randrange(0, 400))) for _ in range(30)]
    rows = spark.createDataFrame([(t, t.split()[5:8], rng.randrange(-2, 420)) for t in texts], "text string, needle array<string>, at int").cache()

    def found():
        windows = C.fixed_windows(F.col("text"), 20, 5)
        span = J.token_span(F.split("text", " "), F.col("needle"), F.col("at"))
        return sorted(map(str, rows.select("text", windows.alias("w"), span.alias("s")).collect()))

    wide = found()
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(J, "SPAN_REACH", 3)
    assert found() == wide


def test_windows_of_a_text_are_found_once(spark, tmp_path):
    from quillrank.plans import labels as P

    text = " ".join(f"w{i % 7} x{i}" for i in range(900))
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one two")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = P.j3(spark, str(tmp_path))
    assert [(r.doc_id, r.chunk_index, r.span_tokens, r.run_matches) for r in found.orderBy("doc_id", "chunk_index").collect()] == [
        *[(1, i, 300, True) for i in range(7)], (4, 0, 2, True),
    ]
    # Rows of windows carry no text, and no filter looks for the windows another time.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    assert plan[: plan.index("Generate")].count("regexp_extract_all") == 0


def test_spans_near_and_far_from_the_estimate(spark, monkeypatch):
    source = ["b"] * 700
    for at in (10, 60, 340, 341, 650):
        source[at] = "a"
    rows = spark.createDataFrame([(source, ["a"], e) for e in range(-3, 705, 3)], "s array<string>, n array<string>, e int")
    for near, reach in ((48, 2000), (48, 100), (1, 2), (0, 0)):
        monkeypatch.setattr(J, "SPAN_NEAR", near)
        monkeypatch.setattr(J, "SPAN_REACH", reach)
        got = rows.select("s", "n", "e", J.token_span(F.col("s"), F.col("n"), F.col("e")).alias("span")).collect()
        assert [r.span.start for r in got] == [nearest_run(source, ["a"], r.e) for r in got]
