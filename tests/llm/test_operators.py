"""The operators against brute force, round trips and held-out rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import prose

from quillrank.llm import (
    batches,
    components,
    covertree,
    fingerprints,
    licenses,
    mixing,
    neardup,
    packing,
    quality,
    segmentation,
    sharding,
    toxicity,
)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def copies():
    """Families of texts with growing edits, copies of one text, and a dense family larger than a block."""
    draw = random.Random(3)
    texts = []
    for family in range(12):
        words = prose(family, 120).split()
        texts.append(" ".join(words))
        for edits in range(1, 12):
            own = list(words)
            for at in draw.sample(range(len(own)), edits):
                own[at] = f"edit{draw.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [prose(50)] * 30
    base = prose(77, 200).split()
    for i in range(320):
        own = list(base)
        own[i % 200] = f"single{i}"
        own[(i * 3) % 200] = f"second{i}"
        texts.append(" ".join(own))
    return [*texts, "a b", "a b", "A B", "", None]


def jaccard_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return [len(s) for s in sets], roots_of(len(texts), links)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, copies, k, percent):
    found = neardup.near_duplicates(table(spark, copies), k=k, percent=percent).orderBy("doc_id").collect()
    sizes, roots = jaccard_components(copies, k, percent)
    assert [r.n_shingles for r in found] == sizes
    assert [r.component_id for r in found] == roots
    assert [r.kept for r in found] == [i == r for i, r in enumerate(roots)]


def test_regions_alone_find_all_links(spark, copies, monkeypatch):
    # Without any neighbour links the blocks of the regions must find every component.
    monkeypatch.setattr(
        neardup, "_neighbour_links", lambda sets, percent: sets.sparkSession.createDataFrame([], "low long, high long")
    )
    monkeypatch.setattr(neardup, "BLOCK", 64)
    found = neardup.near_duplicates(table(spark, copies), k=3, percent=85).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == jaccard_components(copies, 3, 85)[1]


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(500, i) for i in range(501, 700)]
    links += [tuple(sorted(draw.sample(range(1000, 1400), 2))) for _ in range(250)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "low long, high long").repartition(7)).collect()}
    expected = roots_of(1400, links)
    assert found == {i: expected[i] for i in {x for p in links for x in p}}


def test_fingerprints(spark):
    texts = [prose(i % 17, 40 + i % 5) for i in range(40)] + ["", None, "é" * 7, prose(3, 40)]
    rows = table(spark, texts).withColumn("doc_id", F.col("doc_id") * 3 - 50)
    found = fingerprints.compared(fingerprints.fingerprint(rows)).orderBy("doc_id").collect()
    by_text = defaultdict(set)
    for i, r in enumerate(found):
        text, following = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[text].add(r.fingerprint), by_text[edited].add(r.edited_fingerprint)
        if edited == text:
            assert r.near_edited == 1
    assert all(len(v) == 1 for v in by_text.values())
    assert len({f for v in by_text.values() for f in v}) == len(by_text)


def test_fingerprint_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    rows = spark.range(200).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    found = fingerprints.with_next(rows, ["text"]).orderBy("doc_id").collect()
    assert [int(r.next.text) for r in found] == [(i + 1) % 200 for i in range(200)]


def test_lexicon_band(spark):
    texts = ["common " + ("middle " if i % 10 == 0 else "") + f"rare{i}" for i in range(1000)]
    bitmap = fingerprints.lexicon(table(spark, texts), low=0.05, high=0.5)
    assert sum(bin(x & (2**64 - 1)).count("1") for x in bitmap) == 1


def brute_base(text):
    words = batches.plain_words((text or "").encode())
    phrases = {tuple(p.encode().split()): label for p, label in licenses.BASE.items()}
    return words, [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]


def test_licenses(spark):
    texts = [
        "All rights reserved. all RIGHTS-reserved", "cc by cc cc by", "general public general public license",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "rights all reserved by cc",
        "license version apache 2 0", "", None, "a " * 5000 + "all rights reserved",
    ]
    found = licenses.summary(licenses.scan(table(spark, texts))).orderBy("doc_id").collect()
    for text, r in zip(texts, found, strict=True):
        words, places = brute_base(text)
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert [found[i].labels for i in (3, 4, 5, 6, 7, 8)] == ["gpl,gpl-3.0", "mit", "apache-2.0", "cc-by,cc-by-nc-4.0", "", ""]
    assert all(r.score > 0.9 for r in found[3:7]) and found[7].score == 0


def test_licenses_of_a_text_with_all_statements(spark):
    # However many licence words a text has, each statement is found where its phrase and enough words stand.
    joined = " and a free copy of the source for any person: ".join(t for _, t, _ in licenses.TEMPLATES)
    texts = [joined, *(t for _, t, _ in licenses.TEMPLATES), prose(1), joined.replace("under", "by")]
    rows = table(spark, texts)
    index = licenses.build_index(*licenses.word_counts(rows))
    for text, r in zip(texts, licenses.scan(rows).orderBy("doc_id").collect(), strict=True):
        words, expected = batches.plain_words(text.encode()), []
        for label, statement, must in licenses.TEMPLATES:
            own, must = statement.encode().split(), must.encode().split()
            offset = next(i for i in range(len(own)) if own[i : i + len(must)] == must)
            for start in range(-len(own), len(words)):
                fits = [w for i, w in enumerate(own) if 0 <= start + i < len(words) and words[start + i] == w]
                fit = sum(index.idf[w] for w in fits) / sum(index.idf[w] for w in own)
                if start + offset >= 0 and words[start + offset :][: len(must)] == must and fit >= licenses.FIT:
                    expected.append((label, max(start, 0), pytest.approx(fit)))
        assert sorted((x.label, x.start, x.fit) for x in r.found) == sorted(expected, key=lambda x: x[:2])
    found = licenses.summary(licenses.scan(rows)).where("doc_id = 0").first()
    assert set(found.labels.split(",")) >= {label for label, _, _ in licenses.TEMPLATES}


def test_cover_tree(spark, monkeypatch):
    monkeypatch.setattr(covertree, "CHUNK", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 8))
    vectors = [(centres[i % 25] + rng.normal(size=8) * (0.02 + 0.25 * (i % 3))).tolist() for i in range(400)]
    vectors += [vectors[0]] * 50
    labels = [i % 3 for i in range(450)]
    rows = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))],
                                 "vec_id long, embedding array<double>, label int")
    found = covertree.near_duplicate_vectors(rows).orderBy("vec_id").collect()
    v = np.array(vectors)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    assert [r.n_links for r in found] == near.sum(axis=1).tolist()
    assert [r.component_id for r in found] == roots_of(450, np.argwhere(np.triu(near)).tolist())


def test_labellers():
    draw = random.Random(4)
    patterns = Counter()
    accuracy = [0.95, 0.8, 0.9, 0.7]
    for _ in range(20_000):
        junk = draw.random() < 0.2
        patterns[tuple(2 if draw.random() < 0.1 else int(junk != (draw.random() < a)) for a in accuracy)] += 1
    share, chance = quality.fit_labellers(dict(patterns))
    assert abs(share - 0.2) < 0.02
    for j, a in enumerate(accuracy):
        assert abs(chance[j, quality.JUNK, quality.JUNK] / 0.9 - a) < 0.04


def test_quality(spark):
    clean = [" ".join([prose(i, 20).capitalize() for i in range(k, k + 5)]) for k in range(160)]
    junk = [prose(i, 80).upper().replace(" ", "!! ") for i in range(20)] + ["buy buy buy buy " * 20 for _ in range(5)]
    junk += [prose(i, 60).replace(" ", " | ") for i in range(20)]
    found = quality.classify(table(spark, [*clean, *junk])).orderBy("doc_id").collect()
    accepted = [r.quality_score >= quality.THRESHOLD for r in found]
    assert all(accepted[: len(clean)])
    assert sum(accepted[len(clean) :]) <= 2


def test_context_mixing(spark):
    texts = [prose(i % 40, 50 + i % 13) + " the the of and" for i in range(600)] + ["", None]
    found = mixing.score(table(spark, texts)).orderBy("doc_id").collect()
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r, text, out in zip(found, texts, held, strict=True):
        words = [*(text or "").lower().split(), None]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out, len(words), n)
        assert r.n_known == sum(w in counts for w in words)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)


def test_mixing_weights_are_fitted_on_all_training_rows(spark):
    texts = [prose(i % 60, 20 + i % 17) for i in range(500)]
    rows = table(spark, texts).select("text")
    words = sorted({w for t in texts for w in mixing.tokens(t.encode())})
    number, at = {w: i for i, w in enumerate(words)}, [[*map(words.index, mixing.tokens(t.encode()))] for t in texts]
    code = mixing.Code([sum(x.count(i) for x in at) for i in range(len(words))] + [0])
    hashed, nodes = mixing.bit_counts(rows, number, code)
    bits = [code.spell(np.array(x))[2] for x in at]
    assert [nodes.sum(), *hashed.sum(axis=(1, 2))] == [sum(map(len, bits))] * 4
    cells = mixing.Cells(hashed, nodes)
    found = mixing.cell_counts(rows.repartition(7), number, code, cells)
    assert (found == mixing.cell_counts(rows.coalesce(1), number, code, cells)).all()
    assert found[:, 1:3].sum(axis=0).tolist() == [sum(int((b == v).sum()) for b in bits) for v in (0, 1)]
    model = mixing.Model(code, hashed, nodes)
    before = model.score([np.array(x) for x in at]).sum()
    model.fit(found)
    assert model.score([np.array(x) for x in at]).sum() > before


def test_mixing_is_fitted_on_every_training_bit_by_itself(spark, monkeypatch):
    texts = [prose(i % 90, 20 + i % 17) for i in range(400)]
    kept, fit = [], mixing.Model.fit
    monkeypatch.setattr(mixing.Model, "fit", lambda model, *a: (fit(model, *a), kept.append(model))[0])
    mixing.score(table(spark, texts)).collect()
    [model] = kept
    train = [mixing.tokens(t.encode()) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    number = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    # Every bit, one by one, with the counts of all others in its contexts.
    bits, seen = [], Counter()
    for words in train:
        past = (1, 1)
        for w in words:
            s = np.array([number[w]])
            _, node, bit, depth = model.code.spell(s)
            hashes = mixing.contexts(np.array([past[0] << 42 | past[1] << 21]))
            for a, b, d in zip(node, bit.tolist(), depth.tolist(), strict=True):
                at = [int(a), *(int(x[0]) for x in mixing.slots(hashes, np.array([0]), np.array([a])))]
                bits.append((at, b, d))
                seen.update((k, x, b) for k, x in enumerate(at))
            past = (past[1], number[w] + 2)
    ones, depth = np.array([b for _, b, _ in bits]), np.minimum([d for _, _, d in bits], 15)
    n = np.array([[[seen[k, x, v] - (k > 0 and v == b) for v in (0, 1)] for k, x in enumerate(at)] for at, b, _ in bits])
    x = mixing._logit(n[:, :, 0], n[:, :, 1])
    gate = mixing._gate(depth, n[:, 2].sum(axis=1), n[:, 1].sum(axis=1))
    z = np.clip((x * model.weights[gate]).sum(axis=1), -20, 20)
    p = 1 / (1 + np.exp(-z))
    slope = np.zeros((mixing.GATES, 4))
    np.add.at(slope, gate, (ones - p)[:, None] * x)
    slope -= mixing.RIDGE * (model.weights - 0.35)
    bend = np.zeros((mixing.GATES, 4, 4)) + mixing.RIDGE * np.eye(4)
    np.add.at(bend, gate, (p * (1 - p))[:, None, None] * x[:, :, None] * x[:, None, :])
    # No step is left that gains anything, and the last stage has every bit at its own mixed logit.
    loss = np.logaddexp(0, np.where(ones == 1, -z, z)).sum()
    assert np.einsum("gi,gij,gj->", slope, np.linalg.inv(bend), slope) <= 1e-6 * loss
    at = depth * (mixing.STEPS + 1) + np.rint((np.clip(z, -7.99, 7.99) + 8) * (mixing.STEPS / 16)).astype(int)
    prior = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, mixing.STEPS + 1), 16)))
    size = 16 * (mixing.STEPS + 1)
    rate = (np.bincount(at, ones, size) + 20 * prior) / (np.bincount(at, minlength=size) + 20)
    # A logit on the edge of two steps may be rounded to either.
    assert (np.abs(1 / (1 + np.exp(-model.stage.ravel())) - rate) < 1e-9).mean() > 0.98


def test_mixing_sums_do_not_depend_on_the_order_of_rows(spark):
    texts = [prose(i % 30, 20 + i % 17) for i in range(200)]
    rows = table(spark, texts).select("text")
    words = sorted({w for t in texts for w in mixing.tokens(t.encode())})
    number, code = {w: i for i, w in enumerate(words)}, mixing.Code([*range(1, len(words) + 1), 0])
    cells = mixing.Cells(*mixing.bit_counts(rows, number, code))
    weights = np.random.default_rng(2).normal(0.35, 0.3, (mixing.GATES, mixing.ORDERS + 1))
    one, seven = (mixing.bit_sums(r, number, code, cells)(weights) for r in (rows.coalesce(1), rows.repartition(7)))
    assert (one == seven).all()
    twice = mixing.bit_sums(rows.union(rows), number, code, cells)(weights)
    assert twice == pytest.approx(2 * one, abs=len(words) * 100)


def test_mixing_counts_beyond_32_bits(spark):
    code, often = mixing.Code([3, 2, 1]), 3 << 30
    triple = mixing.triples(np.array([0, 1, 1]), np.array([0]))
    rows = spark.createDataFrame([(int(t), often) for t in triple] * 2, "triple long, n long").coalesce(1)
    hashed, nodes = mixing.bit_counts(rows, {}, code)
    total = 2 * often * int(code.lengths[[0, 1, 1]].sum())
    assert [nodes.sum(), *hashed.sum(axis=(1, 2))] == [total] * 4


def test_code_and_mixing_are_distributions():
    code = mixing.Code([50, 30, 10, 5, 3, 1, 1])
    assert sum(2.0**-n for n in code.lengths.tolist()) == 1
    rng = np.random.default_rng(1)
    hashed = rng.integers(0, 5, (mixing.ORDERS, 1 << mixing.SLOT_BITS, 2))
    model = mixing.Model(code, hashed, rng.integers(0, 50, (code.n_nodes, 2)))
    # Given the same past, the symbols' probabilities add up to one.
    past = [3, 0, 1]
    before = model.score([np.array(past)])[0]
    following = [model.score([np.array([*past, s])])[0] - before for s in range(7)]
    assert sum(2.0**x for x in following) == pytest.approx(1)


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    texts = [prose(i, 1 + i * 40) for i in range(40)] + ["", None, "é  \n\n\t日本 <|endoftext|> it's 1234 !!", "  x y  "]
    found = packing.pack(table(spark, texts)).orderBy("doc_id", "start").collect()
    rows = defaultdict(list)
    for r in found:
        rows[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        joined = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows[i]]).tolist()
        assert joined == ids and {r.doc_tokens for r in rows[i]} == {len(ids)}
        assert [r.start for r in rows[i]] == [0, *itertools.accumulate(r.length for r in rows[i])][:-1]
    assert all(r.length <= 2048 and r.length & (r.length - 1) == 0 and r.offset == 0 for r in found)
    assert len({r.sequence_id for r in found}) == len(found)


@pytest.mark.parametrize("rows", [0, 1, 5, 16, 1000])
def test_shards(spark, rows):
    found = sharding.shuffle_to_shards(spark.range(rows).withColumnRenamed("id", "doc_id"), 16, part_rows=64).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in found) == list(range(rows))
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_hypergeometric_law(spark):
    n = 20_000
    count = sharding._hypergeometric(
        F.lit(12).cast("long"), F.lit(30).cast("long"), F.lit(9).cast("long"), (F.col("id") + 0.5) / n
    )
    found = Counter(r.c for r in spark.range(n).select(count.alias("c")).collect())
    for k in range(10):
        chance = math.comb(12, k) * math.comb(18, 9 - k) / math.comb(30, 9)
        assert abs(found[k] / n - chance) < 2 / n * 10
    edges = spark.sql("select 0L as a, 0L as b, 0L as c union all select 5L, 5L, 3L union all select 4L, 9L, 9L")
    drawn = edges.select(sharding._hypergeometric(F.col("a"), F.col("b"), F.col("c"), F.lit(0.3)).alias("x")).collect()
    assert sorted(r.x for r in drawn) == [0, 3, 4]


def test_communication_matrix(spark):
    sizes = [17, 0, 40, 3, 25, 9, 1, 5]
    rows = spark.createDataFrame([(p, n) for p, n in enumerate(sizes) if n], "_part long, _rows long")
    room = sharding.shard_sizes(100, 6)
    found = {r._part: r._counts for r in sharding.communication_matrix(rows, 3, room, 9).collect()}
    assert {p: sum(c) for p, c in found.items()} == {p: n for p, n in enumerate(sizes) if n}
    assert [sum(c[s] for c in found.values()) for s in range(6)] == room


def test_block_max_is_exact():
    rng = random.Random(6)
    words = [f"w{i}".encode() for i in range(30)]
    index = toxicity.Index(words, np.array([1 + rng.random() for _ in words]))
    vectors = [tuple(sorted((t, rng.randrange(1, 5)) for t in rng.sample(range(30), rng.randrange(0, 6)))) for _ in range(700)]
    index.fill(vectors, [rng.randrange(2) for _ in vectors])
    kept = [v for v in vectors if v]
    dense = np.zeros((len(kept), 30))
    for i, v in enumerate(kept):
        terms, w = index.weights(v)
        dense[i, terms] = w
    for i, v in list(enumerate(kept))[:150]:
        for without in (-1, i):
            cosines = dense @ dense[i]
            if without >= 0:
                cosines[i] = 0
            least = np.sort(cosines)[::-1][14]
            expected = set(np.flatnonzero((cosines >= least - 1e-9) & (cosines > 0)).tolist())
            ids, found = index.nearest(v, 15, without)
            assert set(ids.tolist()) == expected
            assert np.allclose(found, cosines[ids])


def test_toxicity_on_held_out_rows(spark):
    insults = ["numbskull", "dimwit", "blockhead"]
    texts, toxic = [], []
    for i in range(900):
        toxic.append(int(i % 4 == 0))
        texts.append(prose(i, 30) + (f" {insults[i % 3]} " if toxic[-1] else " ") + prose(i + 1, 10))
    rows = table(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    found = toxicity.score(rows, labels).select("*", toxicity.held_out(F.col("doc_id")).alias("out")).collect()
    out = [r for r in found if r.out]
    assert {r.doc_id for r in out} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((r.toxicity >= toxicity.THRESHOLD) == bool(toxic[r.doc_id]) for r in out)
    assert all(0 <= r.toxicity <= 1 for r in found)
    # Labels that must not be learnt from change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.toxicity for r in toxicity.score(rows, flipped).collect()}
    assert again == {r.doc_id: r.toxicity for r in found}


def test_toxicity_compares_all_words(spark):
    # Subjects are toxic or not by words that no keyword test passes: each is in few examples.
    subjects = [[f"subject{s}x{j}" for j in range(12)] for s in range(60)]
    texts = [" ".join([*subjects[i % 60][i % 5 : i % 5 + 6], "and the"]) for i in range(600)]
    rows = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 60 < 20)) for i in range(600)], "doc_id long, toxic int")
    for r in toxicity.score(rows, labels).where(toxicity.held_out(F.col("doc_id"))).collect():
        assert r.evidence and r.evidence[0].doc_id % 60 == r.doc_id % 60
        assert (r.toxicity >= toxicity.THRESHOLD) == (r.doc_id % 60 < 20)


def test_unlike_texts_are_groups_of_their_own():
    groups = {toxicity._group({b"the", b"and", f"w{i}".encode(), f"v{i}".encode()}) for i in range(100)}
    assert len(groups) > 50


def test_segmentation_round_trip(spark):
    texts = [prose(i, 30) for i in range(20)] + ["", None, " ", "  a▁ b\n\nc", "日本 語 é é\x00", "x" * 200, "\t \U0001f600"]
    rows = table(spark, texts)
    found = segmentation.decode(segmentation.encode(rows)).orderBy("doc_id").collect()
    assert [r.decoded for r in found] == [t or "" for t in texts]
    # The same pieces in another order and another partitioning.
    again = segmentation.encode(rows.orderBy(F.desc("doc_id")).repartition(5)).orderBy("doc_id").collect()
    assert [r.piece_ids for r in again] == [r.piece_ids for r in found]
    other = segmentation.encode(rows, seed=18).orderBy("doc_id").collect()
    assert [r.piece_ids for r in other] != [r.piece_ids for r in found]


def test_only_hashes_that_meet_a_piece_are_looked_up_again(monkeypatch):
    pieces = segmentation.Pieces(segmentation.default_vocabulary())
    assert len(pieces.tables) > 1
    assert (pieces.find(pieces.keys) == pieces.key_ids).all()
    asked, mixed = [], segmentation.mixed
    monkeypatch.setattr(segmentation, "mixed", lambda x: asked.append(len(x)) or mixed(x))
    assert (pieces.find((np.arange(100_000, dtype=np.uint64) + np.uint64(1 << 40)) * np.uint64(977)) == -1).all()
    assert asked[0] == 100_000 and sum(asked[1:]) < 10_000


def test_segmentation_law():
    pieces = segmentation.Pieces(segmentation.default_vocabulary())
    word, n = " there", 60_000

    def ways(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces.ids:
                for ids, w in ways(rest[k:]):
                    yield (pieces.ids[rest[:k]], *ids), w + pieces.log[pieces.ids[rest[:k]]]

    weights = {ids: math.exp(w) for ids, w in ways(word)}
    bases = segmentation.mixed(np.arange(n, dtype=np.uint64))
    ids, ends = segmentation.sample_many(pieces, [word] * n, bases)
    found = Counter(tuple(ids[a:b].tolist()) for a, b in zip([0, *ends[:-1]], ends, strict=True))
    assert found.keys() <= weights.keys()
    for way, w in weights.items():
        assert abs(found[way] / n - w / sum(weights.values())) < 0.01
    starts = [0, *ends[:-1]]
    for r in range(50):
        assert segmentation.sample_one(pieces, word, int(bases[r])) == ids[starts[r] : ends[r]].tolist()
