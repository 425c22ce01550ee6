"""Toxicity (operator 9): nearest labelled examples by exact TF-IDF cosine.

Examples are labelled texts of rows that may be learnt from, at most MAX_EXAMPLES of them, taken
in order of a hash of doc_id (the documented bound of the labelled sample). Terms are all words of
the examples, and those beginnings of words (so that inflected forms meet), and beginnings that
occur at least twice or four times, that occur in toxic examples significantly and many times more
often than in the others. Document frequencies are counted over all documents. No word is dropped
by its evidence: a term weighs its TF-IDF times a factor of at least one, which rises with the
evidence (z) that it tells toxic examples from others. Evidence is counted over groups of like
texts (by several minimum hashes together), so that many copies of one text do not make its words
look toxic.

Each example is a vector of length one in a block-max inverted index: example ids are cut in
blocks. The most frequent terms have a row of weights each and know its largest weight in each
block, all others have posting lists, which are summed first. A text's bound for a block is the
best sum there and the largest weights of its frequent terms; blocks are read by falling bound
for a batch of texts, each text only where it can reach its k-th best cosine. What comes near
that is summed anew in double precision. All examples at or above the k-th best cosine vote, ties
included, weighted by the inverse of their distance. Votes are calibrated on the examples
themselves, each left out of its own vote. Index and examples are bounded, so they travel with
the tasks; the scan of the documents shuffles nothing.

Labels, lang, source and doc_id of a text are never inputs of its score. Texts without any word
of the examples, also null and empty ones, get the rate of toxic examples among such examples.
Repeated rows are scored alike, a null doc_id counts as held out, repeated labels of a doc_id
are toxic when any is. Without toxic or other examples all scores are the smoothed rate. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm import batches
from quillrank.session import stored

MAX_EXAMPLES = 12_000
NEIGHBOURS = 15
BLOCK = 512
FREQUENT, FREQUENT_SHARE = 512, 1 / 32  # terms with a row of weights, and the share of examples they have at least
MARGIN = 1e-4  # of single precision
BATCH = 256
GROUP_HASHES = 3
CLUSTERS, CLUSTER_TERMS, CLUSTER_ROUNDS = 24, 256, 4
BUILT = {"number", "reader", "logs", "blocks", "starts", "norms", "row", "rows", "largest", "postings", "list_sizes", "list_starts"}
POSTING = np.dtype([("id", "<i4"), ("value", "<f4")])
MIN_Z, MIN_RATIO, MIN_GROUPS, MIN_SHARE = 3.0, 8.0, 4, 0.01  # evidence that a beginning needs
PREFIXES = range(4, 9)  # bytes of a word's beginning
LEVELS = (2, 4)  # counts of a beginning that are terms of their own
BINS = 12
THRESHOLD = 0.7
MEMO_WORDS, MEMO_VECTORS = 50_000, 5_000  # what a task remembers at most


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def examples(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that are learnt from, at most `limit`."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id")
    # A doc_id may be on several rows; the sample keeps its bound.
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(limit)


class Terms:
    """Terms of a text with their counts: all of them, or those of a vocabulary only.

    A word is its own term; a beginning is written with a caret, and its levels with a number
    before that.
    """

    def __init__(self, known: Collection[bytes] | None = None) -> None:
        self.known = known
        self.begins = None if known is None else {t[t.index(b"^") + 1 :] for t in known if b"^" in t}
        self.heads = None if known is None else {b[: PREFIXES[0]] for b in self.begins}
        self.memo: dict[bytes, tuple[bytes, ...]] = {}

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        if word not in self.memo:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            begins = (word[:n] for n in PREFIXES if n < len(word))
            self.memo[word] = tuple(b for b in begins if self.begins is None or b in self.begins)
        return self.memo[word]

    def numbered(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the known terms, where `known` gives each its number."""
        words = Counter(batches.plain_words(text))
        begun = self.begun(words)
        size = len(words) + len(begun)
        numbers = map(self.known.get, itertools.chain(words, begun), itertools.repeat(-1))
        ids = np.fromiter(numbers, np.int32, size)
        counts = np.fromiter(itertools.chain(words.values(), begun.values()), np.int32, size)
        return ids[ids >= 0], counts[ids >= 0]

    def begun(self, words: Counter[bytes]) -> dict[bytes, int]:
        """The beginnings only."""
        begins: Counter[bytes] = Counter()
        known, heads = self.known, self.heads
        for word in words if heads is None else [w for w in words if w[: PREFIXES[0]] in heads]:
            for b in self._parts(word):
                begins[b] += words[word]
        found: dict[bytes, int] = {}
        for b, n in begins.items():
            own = [(b"^" + b, n), *((b"%d^%s" % (level, b), 1) for level in LEVELS if n >= level)]
            found.update((t, m) for t, m in own if known is None or t in known)
        return found


def _group(words: set[bytes]) -> int:
    """Texts of the same minimum hashes are one group."""
    import xxhash

    least = [min((xxhash.xxh3_64_intdigest(w, seed) for w in words), default=0) for seed in range(GROUP_HASHES)]
    return xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little") for h in least)) >> 1


def _evidence(rows: DataFrame, known: frozenset[bytes] | None = None) -> DataFrame:
    """Distinct (beginning, group) of the examples; the empty term stands for the group itself."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = Terms(known).begun
        # A text has some thousand terms, so few texts at a time.
        for part in batches.slices(parts, 1, 512 << 10):
            terms, groups = [], []
            for text in batches.byte_texts(part.column(1)):
                words = Counter(batches.plain_words(text))
                own = [b"", *begun(words)]
                group = _group(set(words))
                terms += own
                groups += [group] * len(own)
            yield pa.record_batch([pa.array(terms, pa.binary()), pa.array(groups, pa.int64())], names=["term", "group"])

    return rows.mapInArrow(run, "term binary, group long").distinct()


def _groups_with(rows: DataFrame, known: frozenset[bytes] | None, least: Column | None) -> dict[bytes, int]:
    counts = _evidence(rows, known).groupBy("term").agg(F.count("*").alias("n"))
    if least is not None:
        # Terms of a share of the groups at least: their number is bounded by terms of a text / share.
        total = counts.where(F.length("term") == 0).select(F.col("n").alias("all"))
        counts = counts.join(F.broadcast(total), how="inner", on=F.col("n") >= least)
    return {bytes(r.term): r.n for r in counts.collect()}


def _z(a, n1: int, b, n0: int):
    """Evidence of terms in a of n1 toxic and b of n0 other groups: z and the log of the odds ratio."""
    x, y = a + 0.5, b + 0.5
    rest_x, rest_y = np.maximum(0, n1 - a) + 0.5, np.maximum(0, n0 - b) + 0.5
    odds = np.log(x / rest_x) - np.log(y / rest_y)
    return odds / np.sqrt(1 / x + 1 / rest_x + 1 / y + 1 / rest_y), odds


def beginnings(sample: DataFrame) -> set[bytes]:
    """Beginnings whose groups of examples are toxic far more often than others."""
    least = F.greatest(F.lit(MIN_GROUPS), MIN_SHARE * F.col("all"))
    toxic = _groups_with(sample.where("toxic = 1"), None, least)
    n1 = toxic.pop(b"", 0)
    if not toxic:
        return set()
    other = _groups_with(sample.where("toxic = 0"), frozenset(toxic), None)
    n0 = other.pop(b"", 0)
    found = {t: _z(a, n1, other.get(t, 0), n0) for t, a in toxic.items()}
    return {t for t, (z, odds) in found.items() if z >= MIN_Z and odds >= math.log(MIN_RATIO)}


def vocabulary(sample: DataFrame) -> pa.Array:
    """All words of the examples, and their strong beginnings, sorted; packed, as the driver makes nothing of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for part in batches.slices(parts, 1):
            found.update(*map(batches.plain_words, batches.byte_texts(part.column(1))))
        yield pa.record_batch([pa.array(list(found), pa.binary())], names=["term"])

    words = sample.mapInArrow(run, "term binary").distinct().toArrow()["term"].cast(pa.binary())
    whole = pa.chunked_array([*words.chunks, pa.array(sorted(beginnings(sample)), pa.binary())], pa.binary()).combine_chunks()
    return whole.take(pc.array_sort_indices(whole))


def factors(vectors: list[np.ndarray], toxic: list[int], groups: list[int], n_terms: int) -> np.ndarray:
    """Of each term at least one, and more the more its groups of examples are toxic rather than others."""
    held, n = [np.zeros(n_terms), np.zeros(n_terms)], [0, 0]
    members: dict[tuple[int, int], list[np.ndarray]] = {}
    for vector, y, group in zip(vectors, toxic, groups, strict=True):
        members.setdefault((y, group), []).append(vector[:, 0])
    for (y, _), own in members.items():
        n[y] += 1
        # A vector has each of its terms once, a group may have copies.
        held[y][own[0] if len(own) == 1 else np.unique(np.concatenate(own))] += 1
    return (1 + np.maximum(0, _z(held[1], n[1], held[0], n[0])[0] - 1)) ** 2


def document_counts(docs: DataFrame, words: pa.Array) -> tuple[int, np.ndarray]:
    """Documents, and documents with each of the words, over the whole table."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(words, np.zeros(0)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader
        # The last place counts the documents themselves.
        held = np.zeros(len(shared.value.words) + 1, np.int64)
        for part in batches.slices(parts):
            for text in batches.byte_texts(part.column(0)):
                held[reader.numbered(text)[0]] += 1
                held[-1] += 1
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], names=["place", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "place int, n long")
    sums = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    counts = np.zeros(len(words) + 1, np.int64)
    counts[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return int(counts[-1]), counts[:-1]


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Index:
    """Block-max inverted index of unit vectors, with the labels of the examples."""

    def __init__(self, words: list[bytes] | pa.Array, idf: np.ndarray) -> None:
        self.words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        self.asked = self.read = 0  # pairs of a text and a block, and those that no bound ruled out
        self.idf = idf  # times the factor of the evidence

    @functools.cached_property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    @functools.cached_property
    def reader(self) -> Terms:
        """One per worker, as its sets take time to make."""
        return Terms(self.number)

    def vector(self, text: bytes) -> np.ndarray:
        """Rows of term number and count, by number."""
        ids, counts = self.reader.numbered(text)
        order = np.argsort(ids)
        return np.stack([ids[order], counts[order]], axis=1)

    def weights(self, vector: np.ndarray | tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        terms, counts = np.asarray(vector, np.int64).reshape(-1, 2).T
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / math.sqrt(w @ w)

    def __getstate__(self) -> bytes:
        """What the rest is built from, packed, so that little travels and is written."""
        own = {k: v for k, v in self.__dict__.items() if k not in BUILT}
        return zlib.compress(pickle.dumps(own), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__ = pickle.loads(zlib.decompress(state))

    def fill(self, vectors: list, toxic: list[int]) -> None:
        kept = [(np.asarray(v, np.int32).reshape(-1, 2), y) for v, y in zip(vectors, toxic, strict=True) if len(v)]
        empty = [y for v, y in zip(vectors, toxic, strict=True) if not len(v)]
        self.rate = (sum(toxic) + 0.5) / (len(toxic) + 1)
        self.empty_score = (sum(empty) + self.rate) / (len(empty) + 1)
        self.toxic = np.array([y for _, y in kept], np.float64)
        self.sizes = np.array([len(v) for v, _ in kept], np.int64)
        self.terms, self.counts = (
            np.concatenate([np.zeros(0, np.int32), *(v[:, column] for v, _ in kept)]) for column in (0, 1)
        )
        self.__dict__ = {k: v for k, v in self.__dict__.items() if k not in BUILT}

    def vectors(self, first: int, last: int) -> list[np.ndarray]:
        """The examples' own vectors."""
        ends = np.cumsum(self.sizes)
        return [np.stack([self.terms[e - n : e], self.counts[e - n : e]], axis=1) for e, n in zip(ends[first:last], self.sizes[first:last], strict=True)]

    def _build(self) -> None:
        """Block-max lists of the examples' vectors, made where they are first used, one block of examples at a time."""
        n, n_terms = len(self.sizes), len(self.words)
        self.blocks = -(-n // BLOCK)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.norms = np.zeros(n)
        lengths = np.bincount(self.terms, minlength=n_terms)
        frequent = np.argsort(-lengths, kind="stable")[:FREQUENT]
        frequent = frequent[lengths[frequent] >= max(1, FREQUENT_SHARE * n)]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((self.blocks, len(frequent), BLOCK), np.float32)
        self.list_sizes = np.where(self.row >= 0, 0, lengths)
        self.list_starts = np.cumsum(self.list_sizes) - self.list_sizes
        self.postings = np.zeros(self.list_sizes.sum(), POSTING)
        self.logs = 1 + np.log(np.arange(1, self.counts.max(initial=1) + 1))
        ends = self.list_starts.copy()  # of what the lists hold so far
        for first in range(0, n, BLOCK):
            ids = np.arange(first, min(first + BLOCK, n))
            for i in ids:
                w = self._raw(self._places(i))
                self.norms[i] = math.sqrt(w @ w)
            span = slice(self.starts[first], self.starts[ids[-1]] + self.sizes[ids[-1]])
            of, terms = np.repeat(ids, self.sizes[ids]), self.terms[span]
            values = self._raw(span) / self.norms[of]
            often = self.row[terms] >= 0
            self.rows[first // BLOCK][self.row[terms[often]], of[often] - first] = values[often]
            order = np.flatnonzero(~often)[np.argsort(terms[~often], kind="stable")]
            held, counts = np.unique(terms[order], return_counts=True)
            at = _spans(ends[held], counts)
            self.postings["id"][at], self.postings["value"][at] = of[order], values[order]
            ends[held] += counts
        self.largest = self.rows.max(axis=2, initial=0).T

    def _places(self, example: int) -> slice:
        return slice(self.starts[example], self.starts[example] + self.sizes[example])

    def _raw(self, at) -> np.ndarray:
        """Weights of places of the examples' vectors before these are made of length one."""
        return self.logs[self.counts[at] - 1] * self.idf[self.terms[at]]

    def nearest_of(self, vectors: list, k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector all examples at or above the k-th largest cosine (and above 0), and their cosines."""
        if "rows" not in self.__dict__:
            self._build()
        weighted, width = [self.weights(v) for v in vectors], self.blocks * BLOCK
        apart = np.full(len(vectors), -1) if without is None else np.asarray(without)
        frequent = np.zeros((len(vectors), self.rows.shape[1]), np.float32)
        rest = np.zeros((len(vectors), width), np.float32)
        whole = self.postings.view(np.int64)  # slices of plain numbers are copied faster
        for i, (terms, w) in enumerate(weighted):
            row = self.row[terms]
            frequent[i, row[row >= 0]] = w[row >= 0]
            terms, w = terms[row < 0], w[row < 0]
            starts, sizes = self.list_starts[terms], self.list_sizes[terms]
            lists = [whole[a:z] for a, z in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
            found = np.concatenate([whole[:0], *lists]).view(POSTING)
            np.add.at(rest[i], found["id"], np.repeat(w.astype(np.float32), sizes) * found["value"])
        bounds = frequent @ self.largest + rest.reshape(len(vectors), self.blocks, BLOCK).max(axis=2, initial=0)
        best = np.zeros((len(vectors), k), np.float32)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            who = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= best.min(axis=1) - MARGIN))
            self.asked, self.read = self.asked + len(vectors), self.read + len(who)
            block = slice(b * BLOCK, (b + 1) * BLOCK)
            if not len(who):
                rest[:, block] = 0
                continue
            part = frequent[who] @ self.rows[b] + rest[who, block]
            out = np.flatnonzero((apart[who] >= 0) & (apart[who] // BLOCK == b))
            part[out, apart[who[out]] % BLOCK] = 0
            rest[:, block] = 0  # from here on the whole scores, of those that were read
            rest[who, block] = part
            best[who] = -np.partition(-np.concatenate([best[who], part], axis=1), k - 1, axis=1)[:, :k]
        found, query = [], np.zeros(len(self.words))
        for i, (terms, w) in enumerate(weighted):
            ids = np.flatnonzero((rest[i] > 0) & (rest[i] >= best[i].min() - MARGIN))
            query[terms] = w
            sizes = self.sizes[ids]
            at = _spans(self.starts[ids], sizes)
            of = np.repeat(np.arange(len(ids)), sizes)
            own = query[self.terms[at]]
            shared = np.flatnonzero(own)
            cosines = np.bincount(of[shared], own[shared] * self._raw(at[shared]), len(ids)) / self.norms[ids]
            query[terms] = 0
            if len(ids) > k:
                top = cosines >= -np.partition(-cosines, k - 1)[k - 1] - 1e-9
                ids, cosines = ids[top], cosines[top]
            found.append((ids, cosines))
        return found

    def nearest(self, vector, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([vector], k, [without])[0]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic neighbours, weighted by inverse distance, pulled to the rate by one vote."""
        weight = 1 / (np.sqrt(np.maximum(2 - 2 * cosines, 0)) + 0.1)
        return float((weight @ self.toxic[ids] + self.rate) / (weight.sum() + 1))

    def left_out(self, first: int, last: int, k: int) -> list[float]:
        """Votes on examples, each left out of its own."""
        return [
            self.vote(*near) for i in range(first, last, BATCH)
            for near in self.nearest_of(self.vectors(i, min(i + BATCH, last)), k, list(range(i, min(i + BATCH, last))))
        ]

    def calibrate(self, votes: np.ndarray, names: list[int]) -> None:
        """Rising steps from votes to observed rates, by pooling bins of left-out examples."""
        order = np.lexsort((names, votes))
        pools: list[list[float]] = []  # sum of votes, toxic, rows
        for part in np.array_split(order, min(BINS, max(1, len(votes) // 6))) if len(votes) else []:
            pools.append([votes[part].sum(), self.toxic[part].sum(), len(part)])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        self.at = np.array([0.0, *(v / n for v, _, n in pools), 1.0])
        rates = [(y + self.rate) / (n + 1) for _, y, n in pools]
        self.rates = np.array([min([self.empty_score, *rates]), *rates, max([self.empty_score, *rates])])

    def score(self, vectors: list, k: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
        found = [(self.empty_score, np.zeros(0, np.int64), np.zeros(0)) for _ in vectors]
        some = [i for i, v in enumerate(vectors) if len(v) and len(self.toxic)]
        for i in range(0, len(some), BATCH):
            part = some[i : i + BATCH]
            for j, (ids, cosines) in zip(part, self.nearest_of([vectors[j] for j in part], k), strict=True):
                found[j] = float(np.interp(self.vote(ids, cosines), self.at, self.rates)), ids, cosines
        return found


def likeness_order(vectors: list[np.ndarray], idf: np.ndarray) -> list[int]:
    """An order in which like examples stand together, so that a block's bounds are tight.

    A few rounds of k-means on the most frequent terms tell languages and sources apart; the order has no
    effect on any result.
    """
    lengths = np.bincount(np.concatenate([np.zeros(0, np.int64), *(v[:, 0] for v in vectors)]), minlength=len(idf))
    frequent = np.argsort(-lengths, kind="stable")[:CLUSTER_TERMS]
    column = np.full(len(idf), -1)
    column[frequent] = np.arange(len(frequent))
    dense = np.zeros((len(vectors), len(frequent)), np.float32)
    for i, v in enumerate(vectors):
        own = v[column[v[:, 0]] >= 0]
        dense[i, column[own[:, 0]]] = (1 + np.log(own[:, 1])) * idf[own[:, 0]]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    centres = dense[:: max(1, len(dense) // CLUSTERS)][:CLUSTERS]
    for _ in range(CLUSTER_ROUNDS):
        near = (dense @ centres.T).argmax(axis=1)
        sums = np.stack([dense[near == c].sum(axis=0) for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cosines = dense @ centres.T
    return np.lexsort((-cosines.max(axis=1), cosines.argmax(axis=1))).tolist()


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = MAX_EXAMPLES, k: int = NEIGHBOURS) -> tuple[Broadcast, Index]:
    """Broadcast (index, doc_ids of its examples), and the calibrated scale of votes.

    At most `limit` sparse vectors and votes reach the driver; they are found in tasks.
    """
    spark = docs.sparkSession
    # The sort leaves the sample in one partition; deal it out, so that its terms are found in parallel.
    cores = spark.sparkContext.defaultParallelism
    sample = stored(examples(docs, labels, limit).repartition(cores), "toxicity-examples")
    words = vocabulary(sample)
    n, held = document_counts(docs, words)
    index = Index(words, (np.log((n + 1) / (held.astype(np.float64) + 1)) + 1))
    shared = spark.sparkContext.broadcast(index)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in batches.slices(parts, 1):
            vectors = [index.vector(t) for t in batches.byte_texts(part.column(1))]
            yield pa.record_batch(
                [part.column(0), pa.array([v.astype("<i4").tobytes() for v in vectors], pa.binary()), part.column(2),
                 pa.array([_group(set(batches.plain_words(t))) for t in batches.byte_texts(part.column(1))], pa.int64())],
                names=["doc_id", "vector", "toxic", "group"],
            )

    rows = sample.mapInArrow(run, "doc_id long, vector binary, toxic int, group long").toArrow()
    shared.destroy()
    rows = rows.sort_by([("doc_id", "ascending"), ("vector", "ascending")])
    vectors = [np.frombuffer(v, "<i4").reshape(-1, 2) for v in rows["vector"].to_pylist()]
    names, toxic = rows["doc_id"].to_pylist(), rows["toxic"].to_pylist()
    index.idf = index.idf * factors(vectors, toxic, rows["group"].to_pylist(), len(words))
    del rows
    order = likeness_order(vectors, index.idf) if vectors else []
    index.fill([vectors[i] for i in order], [toxic[i] for i in order])
    names = [names[i] for i in order if len(vectors[i])]
    del vectors
    shared = spark.sparkContext.broadcast((index, names))

    def votes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[0]
        for part in parts:
            at = part.column(0).to_pylist()
            if at:
                found = index.left_out(at[0], at[-1] + 1, k)
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array(found, pa.float64())], names=["at", "vote"])

    found = spark.range(0, len(names), 1, cores).mapInArrow(votes, "at long, vote double").collect()
    scale = Index([], np.zeros(0))
    scale.rate, scale.empty_score = index.rate, index.empty_score
    scale.toxic = index.toxic[[r["at"] for r in found]] if found else np.zeros(0)
    scale.calibrate(np.array([r.vote for r in found]), [names[r["at"]] for r in found])
    return shared, scale


def score(
    docs: DataFrame, labels: DataFrame, *, limit: int = MAX_EXAMPLES, k: int = NEIGHBOURS, evidence: int = 3
) -> DataFrame:
    """`docs` with toxicity (0 to 1) and evidence (the nearest examples) in place of columns of these names."""
    docs = docs.drop("toxicity", "evidence")
    shared, scale = fit(docs, labels, limit=limit, k=k)
    steps = scale.at, scale.rates
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple] = {}
        index, names = shared.value
        index.at, index.rates = steps
        doc_ids = np.array(names, np.int64)
        for part in batches.slices(parts, at):
            vectors = [index.vector(text) for text in batches.byte_texts(part.column(at))]
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
            if len(memo) >= MEMO_VECTORS:
                memo.clear()
            new = {key: v for key, v in zip(keys, vectors, strict=True) if key not in memo}
            for key, (value, ids, cosines) in zip(new, index.score(list(new.values()), k), strict=True):
                best = np.lexsort((doc_ids[ids], -cosines))[:evidence]
                memo[key] = value, [
                    {"doc_id": names[ids[i]], "cosine": float(cosines[i]), "toxic": int(index.toxic[ids[i]])} for i in best
                ]
            scores, found = [memo[key][0] for key in keys], [memo[key][1] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64()), pa.array(found, kind)],
                names=[*part.schema.names, "toxicity", "evidence"],
            )

    near = T.StructType().add("doc_id", "long").add("cosine", "double").add("toxic", "integer")
    out = T.StructType([*docs.schema.fields]).add("toxicity", "double").add("evidence", T.ArrayType(near))
    return docs.mapInArrow(run, out)
