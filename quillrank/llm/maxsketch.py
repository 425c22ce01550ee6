"""Ranked lexical search (operator 13): hashed max-sketches, then exact scores in order of the bounds.

The impact of a term in a document is a saturated, length-normalised count in whole numbers. Each
document's impacts are folded into `width` hashed coordinates, the largest impact in each. A table
of items is asked at once: what a coordinate is worth to an item is the sum of the positive weights
of the item's terms that hash there, so one matrix product gives an upper bound of every (document,
item) score of a block. For each item documents are scored exactly in descending order of their
bounds until the bound falls below the k-th best score that the task has seen. Terms of negative
weight (in more than half of all documents) only lower a score, so they add nothing to a bound.
Only impacts of terms that some item of the block uses are folded: others could loosen bounds but
never raise a score.

At scale: texts stay where they are read. One pass counts documents, terms and document
frequencies, a second bounds and scores; a task returns its k best per item, which are cut per
item and part before they meet. What travels to the tasks is a block of items, at most about
BLOCK_ITEMS items and BLOCK_TERMS distinct (item, term) pairs; more items are asked in more blocks. A
very frequent word costs a coordinate, a group of copies costs its rows, neither meets in a task.

Null, empty or wordless texts are in no result and count as no document. Every row of `docs` is
ranked on its own; repeated rows have repeated entries, a null doc_id comes last among equal scores.
Every row of `items` is asked on its own, also with an item_id that repeats or is null. Empty
tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank import scale
from quillrank.llm import batches
from quillrank.session import stored

TOP = 10
WIDTH = 1024
# Documents whose sketches are held at once.
ROWS = 1024
BLOCK_ITEMS = 512
BLOCK_TERMS = 500_000
PARTS = 64
# Fixed values of the score: impact = SCALE * tf div (1000 * tf + 8 * m), m = 25 + 75 * n * N div L.
SCALE, TF, NORM, BASE, SLOPE = 1_000_000_000, 1000, 8, 25, 75
LAST = 1 << 63
COUNTS = "term int, n long"
FOUND = "item long, doc_id long, score long"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def split_items(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, terms, counts): the distinct terms of each item."""
    for part in batches.slices(parts, 1):
        terms, counts = [], []
        for text in batches.byte_texts(part.column(1)):
            found: dict[bytes, int] = {}
            for word in batches.plain_words(text):
                found[word] = found.get(word, 0) + 1
            terms.append(list(found))
            counts.append(list(found.values()))
        yield pa.record_batch(
            [part.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))],
            names=["item", "terms", "counts"],
        )


def term_ids(text: bytes, index: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of terms of a text, and the numbers of those that are in the index."""
    words = batches.plain_words(text)
    ids = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
    return len(words), ids[ids >= 0]


class Sketches:
    """A block of items, asked of documents block by block; keeps the best of each item."""

    def __init__(self, items: list[list[tuple[int, int]]], terms: list[bytes], df: list[int], n_docs: int, n_terms: int, k: int, width: int):
        self.index = {t: i for i, t in enumerate(terms)}
        self.n_docs, self.n_terms, self.k, self.width = n_docs, n_terms, k, width
        self.place = np.array([zlib.crc32(t) % width for t in terms], np.int64)
        weights = [weight(n_docs, d) for d in df]
        # Weights with the term's count in the item, and what a coordinate is worth to an item.
        self.items = [[(t, c * weights[t]) for t, c in item if df[t]] for item in items]
        self.worth = np.zeros((width, len(items)))
        for at, item in enumerate(self.items):
            for t, w in item:
                self.worth[self.place[t], at] += max(w, 0)
        # Sums of very long items may be rounded; a bound must not fall below its score.
        self.worth *= 1 + 1e-12
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]
        self.least = np.ones(len(items))
        self.bounded = self.rescored = 0

    def impacts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, terms and impacts of the block's documents, ordered by row."""
        rows, ids, norms = [], [], np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            n, found = term_ids(text, self.index)
            if n:
                norms[at] = BASE + SLOPE * n * self.n_docs // self.n_terms
                rows.append(np.full(len(found), at, np.int64))
                ids.append(found)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, tf = np.unique(np.concatenate(rows) * len(self.index) + np.concatenate(ids), return_counts=True)
        row, term = np.divmod(keys, max(1, len(self.index)))
        return row, term, SCALE * tf // (TF * tf + NORM * norms[row])

    def fold(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
        """The sketches: the largest impact in each coordinate."""
        sketch = np.zeros((n, self.width))
        np.maximum.at(sketch, (row, self.place[term]), impact)
        return sketch

    def take(self, doc_ids: list[int | None], texts: list[bytes]) -> None:
        row, term, impact = self.impacts(texts)
        bounds = self.fold(row, term, impact, len(texts)) @ self.worth
        starts = np.searchsorted(row, np.arange(len(texts) + 1))
        exact: dict[int, dict[int, int]] = {}
        self.bounded += bounds.size
        for at in np.flatnonzero((bounds >= self.least).any(axis=0)):
            bound, kept = bounds[:, at], self.best[at]
            for d in np.argsort(-bound, kind="stable"):
                if bound[d] < self.least[at]:
                    break
                if d not in exact:
                    own = slice(starts[d], starts[d + 1])
                    exact[d] = dict(zip(term[own].tolist(), impact[own].tolist(), strict=True))
                held = exact[d]
                score = sum(w * held[t] for t, w in self.items[at] if t in held)
                self.rescored += 1
                entry = (score, -(LAST if doc_ids[d] is None else doc_ids[d]))
                if score > 0 and len(kept) < self.k:
                    heapq.heappush(kept, entry)
                elif score > 0 and entry > kept[0]:
                    heapq.heapreplace(kept, entry)
                if len(kept) == self.k:
                    self.least[at] = kept[0][0]

    def found(self, numbers: list[int]) -> pa.RecordBatch:
        rows = [(numbers[at], None if i == -LAST else -i, s) for at, kept in enumerate(self.best) for s, i in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])


def _statistics(texts: DataFrame, terms: list[bytes]) -> tuple[list[int], int, int]:
    """Document frequencies of the terms, the number of documents with a term, and all their terms."""
    index = {t: i for i, t in enumerate(terms)}

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(len(index), np.int64), 0, 0
        for part in batches.slices(parts, 1):
            for text in batches.byte_texts(part.column(1)):
                n, found = term_ids(text, index)
                docs, total = docs + (n > 0), total + n
                df[np.unique(found)] += 1
        held = np.flatnonzero(df)
        yield pa.record_batch(
            [pa.array([-2, -1, *held.tolist()], pa.int32()), pa.array([docs, total, *df[held].tolist()], pa.int64())],
            names=["term", "n"],
        )

    # At most two rows more than a block has terms.
    counts = {r.term: r.n for r in texts.mapInArrow(count, COUNTS).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return [counts.get(i, 0) for i in range(len(terms))], counts.get(-2, 0), counts.get(-1, 0)


def _ask(texts: DataFrame, block: list, k: int, width: int) -> DataFrame | None:
    """The k best of each task for a block of items."""
    terms = sorted({t for r in block for t in map(bytes, r.terms)})
    index = {t: i for i, t in enumerate(terms)}
    df, n_docs, n_terms = _statistics(texts, terms)
    if not n_docs:
        return None
    numbers = [r.item for r in block]
    asked = [[(index[bytes(t)], c) for t, c in zip(r.terms, r.counts, strict=True)] for r in block]

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(asked, terms, df, n_docs, n_terms, k, width)
        for part in batches.slices(parts, 1):
            for at in range(0, part.num_rows, ROWS):
                few = part.slice(at, ROWS)
                sketches.take(few.column(0).to_pylist(), batches.byte_texts(few.column(1)))
        yield sketches.found(numbers)

    return texts.mapInArrow(search, FOUND)


def rank(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = TOP,
    width: int = WIDTH,
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each row of `items`."""
    spark = docs.sparkSession
    # Written once, so that the numbers of the items stay the same in every block.
    named = stored(
        items.select(
            F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"),
            F.col(item_text).cast("string").alias("text"),
        ),
        "items",
    )
    split = stored(named.select("item", "text").mapInArrow(split_items, "item long, terms array<binary>, counts array<long>"), "item-terms")
    size = split.agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(1, -(-size.items // block_items), -(-(size.terms or 0) // block_terms))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], FOUND)
    for number in range(blocks):
        block = split.where((F.pmod(F.xxhash64("item"), F.lit(blocks)) == number) & (F.size("terms") > 0)).collect()
        part = _ask(texts, block, k, width) if block else None
        if part is not None:
            found = found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The best of many tasks are cut part by part before those of one item meet.
    parted = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    cut = scale.top_k(parted, ["item", "part"], order, k).drop("rank", "part")
    best = scale.top_k(cut, ["item"], order, k)
    return scale.join_sized(best, named.select("item", "item_id"), ["item"]).select("item_id", "rank", "doc_id", "score")
