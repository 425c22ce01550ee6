"""Operators 11 to 13 against brute force and the tokenizers' own libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from texts import prose

from quillrank.llm import maxsketch, prefixtrie, tokencounts


def public(name):
    return pytest.importorskip("public_tokenizers").path(name)


# ---- prefix trie ----


def trie_of(rows):
    """Every node by its definition: {(conv_id, depth): the other columns}."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, tie, (r, x)))
    own = {c: [t[-1] for t in sorted(s)] for c, s in turns.items()}
    members, done = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        told = (*own.get(c - c % 100, [])[:h], *own[c][h:])
        for d in range(len(told) + 1):
            members[told[:d]].append(c)
        done[told].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, done[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def found_trie(table):
    found = prefixtrie.prefix_trie(table).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted(tuple(r) for r in found.collect())


def conversation_rows():
    """Shared beginnings, copies, ties, nulls, a conversation with many turns, a base without turns enough."""
    draw = random.Random(7)
    rows = []
    for c in [*range(100, 260), 300, 1207, 1300, 5001, 5002]:
        for turn in range(draw.choice([1, 2, 3, 5, 8, 13])):
            rows.append((c, turn, draw.choice(["user", None, "system"]), draw.choice(["yes", "no", None, "日本"])))
    rows += [(c, 0, "user", "same") for c in range(400, 470)]
    rows += [(900, i % 50, "user", f"turn {i % 7}") for i in range(300)]
    rows += [(901, None, "a", "x"), (901, None, "a", "x"), (901, 0, "a", "w"), (None, 0, "a", "x"), (None, None, None, None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 7])
def test_trie_is_that_of_the_definition(spark, parts):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert found_trie(table) == trie_of(rows)


def test_trie_small_tables(spark):
    assert found_trie(spark.createDataFrame([], SCHEMA)) == []
    assert found_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    one = [(7, 0, None, None)]
    assert found_trie(spark.createDataFrame(one, SCHEMA)) == trie_of(one)
    # Its own first turns are replaced by those of an absent base: no turn is left.
    turnless = [(c, 0, "u", "t") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]
    found = found_trie(spark.createDataFrame(turnless, SCHEMA))
    assert found == trie_of(turnless) and found[0][1] == 0 and len(found) == 1


def test_trie_ignores_other_columns(spark):
    rows = [(*r, "x", "y") for r in conversation_rows()[:60]]
    clashing = spark.createDataFrame(rows, SCHEMA + ", depth string, name string")
    assert found_trie(clashing) == trie_of([r[:4] for r in rows])


def test_trie_negative_ids_take_the_remainder_towards_zero(spark):
    rows = [(-205, 0, "a", "negative"), (-200, 0, "b", "base")]
    found = found_trie(spark.createDataFrame(rows, SCHEMA))
    assert {r[0] for r in found} <= {-205, -200} and sum(r[1] == 0 for r in found) == 1


# ---- token counts ----

TEXTS = [
    "", None, " ", "one", "a <|endoftext|> b", "<|endoftext|>", "x   \n\n  y\t\tz  ", "it's they're  'll", "日本語　の 文章です。",
    "\x1f a\x85 b ​ c  d", "x" * 5000, "ab" * 3000 + " " * 500, "🙂🙂 é É", prose(3, 400), prose(3, 400),
]


def counted(spark, texts, **options):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.count_tokens(table, **options).collect()}


def expected_counts(texts, path, limit=512):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        sizes = [len(model.encode(t or "")) for t in texts]
    else:
        import tokenizers

        model = tokenizers.Tokenizer.from_file(path)
        sizes = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    return {i: (len((t or "").encode()), n, n > limit) for i, (t, n) in enumerate(zip(texts, sizes, strict=True))}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    path = public(name)
    assert counted(spark, TEXTS, tokenizer=path) == expected_counts(TEXTS, path)
    assert tokencounts.cuts_at_spaces(path) == (name == "byte_bpe_50k.json")


def test_runs_give_the_counts_of_whole_texts():
    import tokenizers

    path = public("byte_bpe_50k.json")
    model, count = tokenizers.Tokenizer.from_file(path), tokencounts.counter(path)
    draw = random.Random(1)
    signs = " \t\n\r\x0b\x0c\x1c\x85\xa0​　 'sdlab1,.é日🙂<|>"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(4000)]
    texts += [f"{a}{chr(c)}{b}" for c in range(0x80, 0x3000, 3) for a, b in (("x ", " y"), (" ", " "))]
    assert count(texts) == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def cached_rows(spark, cache, path):
    return spark.read.parquet(f"{cache}/tokenizer={tokencounts.version(path)}")


def test_only_misses_are_encoded_and_stored(spark, tmp_path):
    path, cache = public("byte_bpe_50k.json"), str(tmp_path / "cache")
    expected = expected_counts(TEXTS, path)
    assert counted(spark, TEXTS, cache=cache) == expected
    stored = cached_rows(spark, cache, path)
    distinct = {t or "" for t in TEXTS}
    assert stored.count() == len(distinct)
    # A second run stores nothing, a third only what is new.
    assert counted(spark, TEXTS, cache=cache) == expected
    assert cached_rows(spark, cache, path).count() == len(distinct)
    more = [*TEXTS, "something new", "something new", "and more"]
    assert counted(spark, more, cache=cache) == expected_counts(more, path)
    assert cached_rows(spark, cache, path).count() == len(distinct) + 2
    # With no broadcast the semi join gives the same.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = [*more, "a third thing"]
        assert counted(spark, again, cache=cache) == expected_counts(again, path)
        assert cached_rows(spark, cache, path).count() == len(distinct) + 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_stored_counts_are_used_and_belong_to_one_version(spark, tmp_path):
    path, cache = public("byte_bpe_50k.json"), str(tmp_path / "cache")
    key = hashlib.sha256(b"one").digest()
    planted = spark.createDataFrame([(bytearray(key), 41), (bytearray(key), 41)], tokencounts.CACHED)
    planted.write.parquet(f"{cache}/tokenizer={tokencounts.version(path)}")
    assert counted(spark, ["one", "two"], cache=cache) == {0: (3, 41, False), 1: (3, 1, False)}
    other = public("word_bpe_49k.json")
    assert counted(spark, ["one"], cache=cache, tokenizer=other) == expected_counts(["one"], other)


def test_counts_of_awkward_tables(awkward, nothing, awkward_rows):
    path = public("byte_bpe_50k.json")
    found = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokencounts.count_tokens(awkward).collect())
    sizes = expected_counts([t for _, t in awkward_rows], path)
    assert found == sorted((str(i), *sizes[at][:2]) for at, (i, _) in enumerate(awkward_rows))
    assert tokencounts.count_tokens(nothing).count() == 0


# ---- ranked search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    """{(item_id, rank): (doc_id, score)} by the definition."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items:
        asked = Counter(terms_of(text))
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, n in asked.items() if t in c
            )
            if score > 0:
                scores.append((-score, math.inf if i is None else i, i))
        for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (i, -s)
    return out


def found_ranks(docs, items, **options):
    return {(r.item_id, r.rank): (r.doc_id, r.score) for r in maxsketch.rank(docs, items, **options).collect()}


@pytest.fixture(scope="module")
def search_tables(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["the"] * 150 + ["É日本", "Ünï", "x1"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)]
    docs += [(2000, None), (2001, ""), (2002, " .,"), (2003, "THE the The"), (None, docs[5][1]), (5, docs[5][1]), (2004, "w1 " * 20_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 40)))) for i in range(40)]
    items += [(100, docs[5][1]), (101, "the"), (102, None), (103, ""), (104, "nowhere"), (105, "w1 W1 w1, w2"), (None, "w3")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"width": 8}, {"width": 1, "k": 3}, {"block_items": 5}, {"block_terms": 30}])
def test_search_is_exact(spark, search_tables, options):
    docs, items = search_tables
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found_ranks(table, asked, **options) == ranked(docs, items, options.get("k", 10))


def test_repeated_items_are_asked_each(spark, search_tables):
    docs, _ = search_tables
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w7 w8"), (1, "w9")], "item_id long, text string")
    rows = [(r.rank, r.doc_id, r.score) for r in maxsketch.rank(table, asked).collect()]
    one, two = ranked(docs, [(1, "w7 w8")]), ranked(docs, [(1, "w9")])
    assert sorted(rows) == sorted([(k, *v) for (_, k), v in one.items()] + [(k, *v) for (_, k), v in two.items()])


def test_search_of_awkward_and_empty_tables(spark, awkward, nothing, awkward_rows):
    items = [(1, prose(1)), (2, "one two"), (3, "日本 ok idiot")]
    asked = spark.createDataFrame([(*i, "a", "b") for i in items], "item_id long, text string, item string, rank string")
    assert found_ranks(awkward, asked) == ranked(awkward_rows, items)
    assert maxsketch.rank(nothing, asked).count() == 0
    assert maxsketch.rank(awkward, asked.where("false")).count() == 0


def test_bounds_hold_and_spare_most_scores():
    draw = random.Random(2)
    texts = [prose(i, 60).encode() for i in range(3000)]
    asked = [Counter(maxsketch.batches.plain_words(draw.choice(texts))[:15]) for _ in range(20)]
    terms = sorted({t for a in asked for t in a})
    index = {t: i for i, t in enumerate(terms)}
    df = [sum(t in set(maxsketch.batches.plain_words(x)) for x in texts) for t in terms]
    n_terms = sum(len(maxsketch.batches.plain_words(x)) for x in texts)
    made = maxsketch.Sketches([[(index[t], n) for t, n in a.items()] for a in asked], terms, df, len(texts), n_terms, 10, 1024)
    row, term, impact = made.impacts(texts[:200])
    bounds = made.fold(row, term, impact, 200) @ made.worth
    for at, item in enumerate(made.items):
        weights = dict(item)
        exact = Counter()
        for r, t, i in zip(row.tolist(), term.tolist(), impact.tolist(), strict=True):
            exact[r] += weights.get(t, 0) * i
        assert all(bounds[r, at] >= s for r, s in exact.items())
    for at in range(0, len(texts), 500):
        made.take(list(range(at, at + 500)), texts[at : at + 500])
    assert made.rescored < made.bounded / 2
