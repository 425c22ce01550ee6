"""LM scoring (operator 6): online logistic context mixing.

Tokens are words, and one end per text. The most frequent ones are symbols of their own with a
Huffman code, all others share one symbol; so a token is a few bits, each decided at a node of
the code's tree. Several predictors give each bit a probability from counts of training bits in
hashed contexts: the node alone, with the last symbol, with the last two, and with the one
before the last. A gate (depth in the tree, evidence in the longest context) selects the weights
that mix their logits. While a text is read the weights follow its own bits, a chunk of tokens
at a time, and start anew with the next text, so a score depends on the text and the model only.
A last stage maps the mixed probability to the rate observed at it. A word without its own
symbol is then chosen among those words by its count, with the smoothing of the base score.

Counts of words and of context bits come from all training rows. Word counts grow with the
input and stay a table: words of at least HEAVY of all tokens, at most 1 / HEAVY of them, travel
with the tasks, all others are joined by word, where none can be hot. All that is known of a training
bit follows from its symbol and the two before it, so training texts are read once more, for a table
of such triples and their counts. Context counts are arrays of fixed size, added up block by block.

Mixing weights and the last stage are fitted on every training bit with its own logits, taken out of
its own counts in the hashed contexts: a logistic regression by Newton's steps, each a pass over the
triples that adds up the slopes of all bits, until the next step would gain next to nothing. It starts
from a fit of cells (bits counted by gate and by the bins of their logits, with their mean logits),
which only saves passes. The last pass also counts the bits for the last stage, each at its own mixed
logit. Sums are of whole numbers, so no order of rows matters.

Null and empty texts have the end alone. A null doc_id counts as held out. Repeated rows are
scored alike (and counted as often as they occur). An empty table gives no rows; without
training rows every probability is that of an unknown token.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import batches
from quillrank.session import stored

FOLDS = 10
HEAVY = 2e-6
SYMBOLS = 4096
SLOT_BITS = 19
BLOCK_BITS = 14
ORDERS = 3  # hashed contexts; the node alone is a fourth predictor
CHUNK = 128  # tokens of a text between two steps of its weights
RATE = 0.02
STEPS = 32
GATES = 64
NODE_BINS, BINS = 9, 17  # of a logit, around -8 to 8; no evidence is in the middle
CELLS = 16 * NODE_BINS * 2 * BINS * 3 * BINS * BINS  # depth, bins, evidence in the first two contexts
FIXED = 256  # logits of cells are summed in whole parts of this size
RIDGE = 4.0
PARTS = 1 << 24  # slopes are summed in whole parts of this size
NEAR = 1e-7  # a fit ends when its next step would gain no more than this part of the loss
SQUARES = [(j, k) for j in range(ORDERS + 1) for k in range(j, ORDERS + 1)]
SUMS = 2 + ORDERS + len(SQUARES)  # of a gate: slopes, bends, loss
# Of a bin in the context of the last symbol, of the last two: what _gate makes of the evidence in it.
LAST_LEVEL = np.repeat([0, 1], BINS)
LONG_LEVEL = np.repeat([0, 2, 3], BINS)
FLUSH = 200_000
FLUSH_TOKENS = 1 << 21
LEAST = 1e-5
SCORE_BYTES = 1 << 20
STRETCH = 1 << 13  # triples whose bits are spelt at a time
CELL_STRETCH = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def tokens(text: bytes) -> list[bytes]:
    """Words, then the end (the empty word)."""
    return [*batches.space_words(text), b""]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over `rows` (text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        for part in batches.slices(parts):
            for text in batches.byte_texts(part.column(0)):
                counts.update(tokens(text))
            if len(counts) > FLUSH:
                yield out()
                counts = Counter()
        yield out()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Code:
    """Huffman code of the symbols: for each the nodes that it passes and its bits there."""

    def __init__(self, counts: list[int]) -> None:
        roots = [(n + 1, i) for i, n in enumerate(counts)]
        heapq.heapify(roots)
        trees: dict[int, tuple[int, int]] = {}
        number = len(counts)
        while len(roots) > 1:
            (a, x), (b, y) = heapq.heappop(roots), heapq.heappop(roots)
            trees[number] = (x, y)
            heapq.heappush(roots, (a + b, number))
            number += 1
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        stack = [(roots[0][1], [])] if roots else []
        while stack:
            at, path = stack.pop()
            if at < len(counts):
                paths[at] = path
            else:
                x, y = trees[at]
                node = at - len(counts)
                stack += [(x, [*path, (node, 0)]), (y, [*path, (node, 1)])]
        self.n_nodes = max(1, len(trees))
        self.lengths = np.array([len(p) for p in paths], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.nodes = np.array([n for p in paths for n, _ in p], np.int64)
        self.bits = np.array([b for p in paths for _, b in p], np.int64)

    def spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all bits of the symbols: the symbol's place, node, bit, depth."""
        n = self.lengths[symbols]
        of = np.repeat(np.arange(len(symbols)), n)
        depth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at = self.starts[symbols][of] + depth
        return of, self.nodes[at], self.bits[at], depth


def triples(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each symbol (below 2**20) and the two before it: all that is known of its bits follows from them."""
    s = symbols + 2
    one, two = np.zeros_like(s), np.zeros_like(s)
    one[1:] = s[:-1]
    one[first] = 1
    two[1:] = one[:-1]
    two[first] = 1
    return two << 42 | one << 21 | s


def contexts(triple: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last symbol, the last two, the one before the last."""
    one, two = (triple >> 21 & 0x1FFFFF).astype(np.uint64), (triple >> 42).astype(np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    return [one * a, (one * b + two) * a, two * b + np.uint64(7)]


def slots(hashes: list[np.ndarray], of: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """Of each bit, at a node of the place that `of` names: its slot in each context."""
    own, found = node.astype(np.uint64) * np.uint64(0x165667B19E3779F9), []
    for context in hashes:
        x = context[of]
        x ^= own
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= np.uint64(64 - SLOT_BITS)
        found.append(x.view(np.int64))
    return found


def triple_counts(rows: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(triple, n) over `rows` (text); rows that are counted already stay as they are."""
    if "triple" in rows.columns:
        return rows
    other = len(number)
    shared = rows.sparkSession.sparkContext.broadcast(number)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = shared.value, []

        def out() -> pa.RecordBatch:
            found = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["triple", "n"])

        for part in batches.slices(parts, 0, SCORE_BYTES):
            texts = [tokens(t) for t in batches.byte_texts(part.column(0))]
            symbols = np.fromiter(map(number.get, chain.from_iterable(texts), repeat(other)), np.int64)
            held.append(triples(symbols, np.cumsum([0, *map(len, texts[:-1])])))
            if sum(map(len, held)) > FLUSH_TOKENS:
                yield out()
                held = []
        if held:
            yield out()

    return rows.mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def stretches(parts: Iterator[pa.RecordBatch], code: Code, size: int) -> Iterator[tuple]:
    """Hashes and counts of about `size` triples (triple, n) at a time, and their bits: place, node, bit, depth."""

    def spelt() -> tuple:
        triple, n = (np.concatenate(x) for x in zip(*held, strict=True))
        return contexts(triple), n, *code.spell((triple & 0x1FFFFF) - 2)

    held: list[list[np.ndarray]] = []
    for part in parts:
        for start in range(0, part.num_rows, size):
            held.append([c.to_numpy() for c in part.slice(start, size).columns])
            if sum(len(n) for _, n in held) >= size:
                yield spelt()
                held = []
    if held:
        yield spelt()


def bit_counts(rows: DataFrame, number: dict[bytes, int], code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Counts [order, slot, bit] of the hashed contexts and [node, bit], over `rows` (text, or triple_counts of it).

    A task sends its arrays in blocks; each block is added up by one task, from as many rows
    as there are tasks. Only the sums, of fixed size, reach the driver.
    """
    block = 2 << BLOCK_BITS
    size = ORDERS * (2 << SLOT_BITS)
    size += -(-2 * code.n_nodes // block) * block
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(code)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, found = shared.value, np.zeros(size, np.int64)
        for hashes, n, of, node, bit, _ in stretches(parts, code, STRETCH):
            n = n[of]
            for order, slot in enumerate(slots(hashes, of, node)):
                np.add.at(found, slot * 2 + bit + order * (2 << SLOT_BITS), n)
            np.add.at(found, node * 2 + bit + ORDERS * (2 << SLOT_BITS), n)
        cut = [b for b in range(size // block) if found[b * block : (b + 1) * block].any()]
        whole = "<i4" if found.max() < 1 << 31 else "<i8"
        yield pa.record_batch(
            [pa.array(cut, pa.int32()),
             pa.array([found[b * block : (b + 1) * block].astype(whole).tobytes() for b in cut], pa.binary())],
            names=["block", "counts"],
        )

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for b, counts in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sums.setdefault(b, np.zeros(block, np.int64))
                sums[b] += np.frombuffer(counts, f"<i{len(counts) // block}")
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())],
            names=["block", "counts"],
        )

    schema = "block int, counts binary"
    total = np.zeros(size, np.int64)
    added = triple_counts(rows, number).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    for row in added.collect():
        total[row.block * block : (row.block + 1) * block] = np.frombuffer(row["counts"], "<i8")
    shared.unpersist()
    hashed = total[: ORDERS * (2 << SLOT_BITS)].reshape(ORDERS, -1, 2)
    return hashed, total[ORDERS * (2 << SLOT_BITS) :][: 2 * code.n_nodes].reshape(-1, 2)


def _logit(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logit of the counts, pulled to zero where they are few."""
    n = n0 + n1
    return np.log((n1 + 0.4) / (n0 + 0.4)) * (n / (n + 1.0))


def _gate(depth: np.ndarray, n_long: np.ndarray, n_last: np.ndarray) -> np.ndarray:
    level = np.where(n_long >= 2, 2 + (n_long >= 8), n_last >= 2)
    return np.minimum(depth, 15) * 4 + level


class Cells:
    """What the fit knows of a training bit: depth, its four logits and their bins, evidence in its first two contexts.

    Tables by [slot, bit] hold logits and their bins, in the contexts without the bit itself. The node alone keeps it:
    the code is made from these very counts, halves nearly equal, so what is left would tell the bit. A cell is depth and bins.
    """

    def __init__(self, hashed: np.ndarray, nodes: np.ndarray) -> None:
        self.logits, self.bins = [], []
        for k, counts in enumerate([nodes, *hashed]):
            left = np.stack([np.maximum(counts - np.array(own) * (k > 0), 0) for own in ([1, 0], [0, 1])], axis=1)
            x = _logit(left[:, :, 0], left[:, :, 1])
            bins = BINS if k else NODE_BINS
            at = np.clip(np.rint((x + 8) * ((bins - 1) / 16)), 0, bins - 1).astype(np.int64)
            seen = left.sum(axis=2)
            if k == 1:
                at += bins * (seen >= 2)
            elif k == 2:
                at += bins * ((seen >= 2) + (seen >= 8).astype(np.int64))
            self.bins.append(at.ravel().astype(np.uint8))
            self.logits.append(x.ravel().astype(np.float32))

    def places(self, hashes: list[np.ndarray], of: np.ndarray, node: np.ndarray, bit: np.ndarray) -> list[np.ndarray]:
        return [at * 2 + bit for at in (node, *slots(hashes, of, node))]

    def add(
        self, hashes: list[np.ndarray], n: np.ndarray, of: np.ndarray, node: np.ndarray, bit: np.ndarray, depth: np.ndarray
    ) -> list[np.ndarray]:
        """Of the cells that hold bits: number, counts of zeros and ones, sums of the four logits."""
        places = self.places(hashes, of, node, bit)
        cell = np.minimum(depth, 15)
        for size, bins, at in zip((NODE_BINS, 2 * BINS, 3 * BINS, BINS), self.bins, places, strict=True):
            cell = cell * size + bins[at]
        there = np.zeros(CELLS, bool)
        there[cell] = True
        found = np.flatnonzero(there)
        rank = np.empty(CELLS, np.int32)
        rank[found] = np.arange(len(found), dtype=np.int32)
        number, n = rank[cell], n[of]
        counts = np.bincount(number * 2 + bit, n, 2 * len(found)).reshape(-1, 2)
        sums = [np.bincount(number, n * np.rint(x[at] * FIXED), len(found)) for x, at in zip(self.logits, places, strict=True)]
        return [c.astype(np.int64) for c in (found, *counts.T, *sums)]

    def sums(
        self, weights: np.ndarray, hashes: list[np.ndarray], n: np.ndarray, of: np.ndarray, node: np.ndarray, bit: np.ndarray,
        depth: np.ndarray,
    ) -> np.ndarray:
        """mixed_sums of the bits, each with its own logits."""
        places = self.places(hashes, of, node, bit)
        depth = np.minimum(depth, 15)
        gate = depth * 4 + np.maximum(LAST_LEVEL[self.bins[1][places[1]]], LONG_LEVEL[self.bins[2][places[2]]])
        n = n[of]
        return mixed_sums(weights, [x[at] for x, at in zip(self.logits, places, strict=True)], gate, depth, n, n * bit)


def mixed_sums(
    weights: np.ndarray, x: list[np.ndarray], gate: np.ndarray, depth: np.ndarray, n: np.ndarray, ones: np.ndarray
) -> np.ndarray:
    """Of n bits at a time, mixed by `weights`: SUMS by gate in PARTS, then ones and all bits by step of the last stage."""
    z = sum(w[gate] * c for w, c in zip(weights.T.astype(x[0].dtype), x, strict=True))
    np.clip(z, -20, 20, out=z)
    e = np.exp(-np.abs(z))
    p, n_, ones_ = np.where(z >= 0, 1, e) / (1 + e), n.astype(z.dtype), ones.astype(z.dtype)
    miss, spread = (ones_ - n_ * p) * PARTS, n_ * e / (1 + e) ** 2 * PARTS
    loss = (n_ * np.log(1 + e) + (n_ - ones_) * np.maximum(z, 0) + ones_ * np.maximum(-z, 0)) * PARTS
    squares = [spread * x[j] * x[k] for j, k in SQUARES]
    found = [np.bincount(gate, np.rint(c), GATES) for c in (*(miss * c for c in x), *squares, loss)]
    at = depth * (STEPS + 1) + np.rint((np.clip(z, -7.99, 7.99) + 8) * (STEPS / 16)).astype(np.int64)
    return np.concatenate([*found, *(np.bincount(at, c, 16 * (STEPS + 1)) for c in (ones, n))]).astype(np.int64)


def settle(
    sums: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, drawn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights where Newton's steps from `weights` end, given mixed_sums and RIDGE towards `drawn`; ones and all bits there."""
    step, slope = np.zeros_like(weights), np.zeros_like(weights)
    least = np.full(GATES, np.inf)
    while True:
        found, way = sums(weights + step), weights + step - drawn
        *columns, loss = found[: GATES * SUMS].reshape(SUMS, GATES) / PARTS
        loss = loss + RIDGE / 2 * (way**2).sum(axis=1)
        better = (loss <= least)[:, None]  # a gate that lost by its step goes back half of it
        bend = np.tile(RIDGE * np.eye(ORDERS + 1), (GATES, 1, 1))
        for (j, k), c in zip(SQUARES, columns[ORDERS + 1 :], strict=True):
            bend[:, j, k] += c
            bend[:, k, j] = bend[:, j, k]
        new = np.stack(columns[: ORDERS + 1], axis=1) - RIDGE * way
        weights, slope = np.where(better, weights + step, weights), np.where(better, new, slope)
        step = np.where(better, np.linalg.solve(bend, new[:, :, None])[:, :, 0], step / 2)
        least = np.minimum(loss, least)
        if (step * slope).sum() <= 2 * NEAR * least.sum():
            return weights, *found[GATES * SUMS :].reshape(2, -1)


def gate_and_depth(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rest, two = np.divmod(cells // BINS, 3 * BINS)
    rest, one = np.divmod(rest, 2 * BINS)
    depth = rest // NODE_BINS
    return _gate(depth, np.array([0, 2, 8])[two // BINS], np.array([0, 2])[one // BINS]), depth


def cell_counts(rows: DataFrame, number: dict[bytes, int], code: Code, cells: Cells) -> np.ndarray:
    """Cells that hold bits of `rows` (as in bit_counts), at most CELLS: rows of what Cells.add gives, all whole numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((code, cells))
    names = ["cell", "zeros", "ones", *(f"x{k}" for k in range(ORDERS + 1))]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, cells = shared.value
        for stretch in stretches(parts, code, CELL_STRETCH):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cells.add(*stretch)], names=names)

    added = triple_counts(rows, number).mapInArrow(count, ", ".join(f"{c} long" for c in names)).groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in names[1:]]
    ).toArrow()
    shared.unpersist()
    table = np.stack([added[c].to_numpy() for c in names], axis=1)
    return table[np.argsort(table[:, 0])]


def bit_sums(rows: DataFrame, number: dict[bytes, int], code: Code, cells: Cells) -> Callable[[np.ndarray], np.ndarray]:
    """A pass over all bits of `rows` (as in bit_counts): given weights, mixed_sums of all of them."""
    shared, counted = rows.sparkSession.sparkContext.broadcast((code, cells)), triple_counts(rows, number)
    size = GATES * SUMS + 2 * 16 * (STEPS + 1)

    def added(weights: np.ndarray) -> np.ndarray:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, cells = shared.value
            total = np.zeros(size, np.int64)
            for stretch in stretches(parts, code, STRETCH):
                total += cells.sums(weights, *stretch)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "total"])

        tasks = counted.mapInArrow(run, "at long, total long")
        # Sums of many tasks may be beyond 64 bits.
        found = tasks.groupBy("at").agg(F.sum(F.col("total").cast("decimal(19,0)")).alias("total")).collect()
        total = np.zeros(size)
        total[[r["at"] for r in found]] = [float(r["total"]) for r in found]
        return total

    return added


class Model:
    """Code, predictors' logits, weights by gate, and the last stage."""

    def __init__(self, code: Code, hashed: np.ndarray, nodes: np.ndarray) -> None:
        self.code = code
        self.weights = np.full((GATES, ORDERS + 1), 0.35)
        self.stage = np.tile(np.linspace(-8, 8, STEPS + 1), (16, 1))
        self.by_node = _logit(nodes[:, 0], nodes[:, 1]).astype(np.float32)
        self.logits = np.stack([_logit(h[:, 0], h[:, 1]) for h in hashed]).astype(np.float32)
        self.seen = np.minimum(hashed[:2].sum(axis=2), 255).astype(np.uint8)

    def inputs(self, hashes: list[np.ndarray], of: np.ndarray, node: np.ndarray, depth: np.ndarray):
        """The predictors' logits, one array each, and the gate."""
        at = slots(hashes, of, node)
        x = [self.by_node[node], *(self.logits[k][at[k]] for k in range(ORDERS))]
        return x, _gate(depth, self.seen[1][at[1]], self.seen[0][at[0]])

    def last(self, z: np.ndarray, p: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Mean of the mixed probability p and the rate observed near its logit z."""
        at = np.clip((z + 8) * (STEPS / 16), 0, STEPS - 1e-3)
        low = at.astype(np.int32)
        part = at - low
        low += np.minimum(depth, 15).astype(np.int32) * (STEPS + 1)
        table = self.stage.ravel().astype(z.dtype)
        refined = table[low] * (1 - part) + table[low + 1] * part
        return np.clip(0.5 * p + 0.5 / (1 + np.exp(-refined)), LEAST, 1 - LEAST)

    def fit(self, cells: np.ndarray, sums: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """Weights and last stage: from rows of cell_counts, and from there on by passes of bit_sums over every bit."""
        if not len(cells):
            return
        gate, depth = gate_and_depth(cells[:, 0])
        n, ones = cells[:, 1] + cells[:, 2], cells[:, 2]
        x = list((cells[:, 3:] / (FIXED * n[:, None])).T)
        start = self.weights
        self.weights, hits, all_ = settle(lambda w: mixed_sums(w, x, gate, depth, n, ones), start, start)
        if sums:
            self.weights, hits, all_ = settle(sums, self.weights, start)
        prior = 1 / (1 + np.exp(-self.stage.ravel()))
        rate = (hits + 20 * prior) / (all_ + 20)
        self.stage = np.log(rate / (1 - rate)).reshape(16, -1)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log2 probability of each text's symbols."""
        lengths = np.array([len(t) for t in texts])
        symbols, first = np.concatenate(texts), np.cumsum(lengths) - lengths
        hashes = contexts(triples(symbols, first))
        total, drift = np.zeros(len(texts)), np.zeros((ORDERS + 1, len(texts)), np.float32)
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        live = np.arange(len(texts))
        for start in range(0, int(lengths.max()), CHUNK):
            live = live[lengths[live] > start]
            n = np.minimum(lengths[live] - start, CHUNK)
            place = np.repeat(first[live] + start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of, node, bit, depth = self.code.spell(symbols[place])
            text = np.repeat(np.arange(len(live)), n)[of]
            x, gate = self.inputs([h[place] for h in hashes], of, node, depth)
            z = np.zeros(len(bit), np.float32)
            for k in range(ORDERS + 1):
                z += (weights[k][gate] + drift[k, live][text]) * x[k]
            np.clip(z, -20, 20, out=z)
            mixed = 1 / (1 + np.exp(-z))
            p = self.last(z, mixed, depth)
            total[live] += np.bincount(text, np.log2(np.where(bit == 1, p, 1 - p)), len(live))
            miss = (bit - mixed) * np.float32(RATE / CHUNK)
            for k in range(ORDERS + 1):
                drift[k, live] += np.bincount(text, miss * x[k], len(live))
        return total


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = rows.where(~held_out(F.col("doc_id"))).select("text")
    counts = stored(word_counts(train), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, n_words = sums.n or 0, sums.v
    bottom = math.log10(n_all + 0.1 * (n_words + 1))
    # At most 1 / HEAVY words pass.
    frequent = counts.where(F.col("n") >= HEAVY * n_all).toArrow()
    heavy = list(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True))
    heavy.sort(key=lambda x: (-x[1], x[0]))
    own = heavy[: SYMBOLS - 1]
    number = {w: i for i, (w, _) in enumerate(own)}
    rest_n = n_all - sum(n for _, n in own)
    code = Code([n for _, n in own] + [rest_n])
    rest_bottom = math.log10(rest_n + 0.1 * (n_words - len(own) + 1))
    counted = stored(triple_counts(train, number), "triple-counts")
    hashed, nodes = bit_counts(counted, number, code)
    cells = Cells(hashed, nodes)
    model = Model(code, hashed, nodes)
    model.fit(cell_counts(counted, number, code, cells), bit_sums(counted, number, code, cells))
    other = len(number)
    known = {w: i for i, (w, _) in enumerate(heavy)}
    base_logs = np.array([math.log10(n + 0.1) - bottom for _, n in heavy] + [0.0])
    rest_logs = np.array([0.0] * len(own) + [math.log10(n + 0.1) - rest_bottom for _, n in heavy[len(own) :]] + [0.0])
    shared = docs.sparkSession.sparkContext.broadcast((known, base_logs, rest_logs, model))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base_logs, rest_logs, model = shared.value
        unknown = len(known)
        for part in batches.slices(parts, 1, SCORE_BYTES):
            texts, base, rest, n_known, n_tokens, size, tails = [], [], [], [], [], [], []
            for text in batches.byte_texts(part.column(1)):
                words = tokens(text)
                at = np.fromiter(map(known.get, words, repeat(unknown)), np.int64, len(words))
                tail = Counter(words[i] for i in np.flatnonzero(at == unknown).tolist())
                texts.append(np.minimum(at, other))
                base.append(base_logs[at].sum()), rest.append(rest_logs[at].sum())
                n_known.append(len(words) - sum(tail.values())), n_tokens.append(len(words)), size.append(len(text))
                tails.append([{"word": w, "n": n} for w, n in tail.items()])
            bits = model.score(texts)
            yield pa.record_batch(
                [part.column(0), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known, size)),
                 pa.array(base, pa.float64()), pa.array(np.array(rest) + bits * math.log10(2), pa.float64()),
                 pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                names=["doc_id", "n_tokens", "n_known", "n_bytes", "base", "model", "tail"],
            )

    schema = (
        "doc_id long, n_tokens long, n_known long, n_bytes long, base double, model double, "
        "tail array<struct<word:binary,n:long>>"
    )
    scored = stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    light = counts.where(F.col("n") < HEAVY * n_all).withColumnRenamed("n", "c")
    # Words of the tail are below HEAVY of all tokens each, so no word makes a task large.
    tail = scored.select("row", F.inline("tail")).join(light, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more_known"), F.sum("n").alias("n_tail"),
    )
    found = scored.drop("tail").join(tail, "row", "left")
    n_tail, logs = F.coalesce("n_tail", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    model_score = F.col("model") + logs - n_tail * rest_bottom
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + logs - n_tail * bottom).alias("base_score"),
        model_score.alias("score"),
        (-model_score * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
