"""Exact best k of additive term scores, with a bound per block of rows.

Rows come with the terms they hold and what each is worth there. Neighbouring rows form blocks; a
block's largest worth per term, times the queries' weights, bounds every score of the block. Blocks
are scored best bound first, and a block is left out for every query whose k-th best score of
the task it cannot reach, so nothing of its rows is summed. The running threshold is state across rows,
which no column expression has; the sums are matrix products over Arrow batches.

Rows stay where they are read. A task returns k rows per query at most. Queries travel with the
tasks in blocks of at most about QUERY_TERMS terms; more queries take more passes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 16
# Numbers in a dense slice of rows by terms, and in the queries' matrix of terms by queries.
SLICE = 4_000_000
QUERY_TERMS = 100_000
MATRIX = 8_000_000


class Best:
    """The best k rows of each query of a block of queries, over the rows that a task sees."""

    def __init__(self, terms: list[list[tuple[int, float]]], wanted: list[list[str] | None], k: int) -> None:
        self.k, n = k, len(terms)
        self.tids = np.array(sorted({t for own in terms for t, _ in own}), np.int64)
        self.weights = np.zeros((len(self.tids), n))
        for q, own in enumerate(terms):
            for t, w in own:
                self.weights[np.searchsorted(self.tids, t), q] += w
        self.subjects = {s: i for i, s in enumerate(sorted({s for own in wanted for s in own or ()}))}
        self.wanted = np.zeros((len(self.subjects), n))
        for q, own in enumerate(wanted):
            for s in own or ():
                self.wanted[self.subjects[s], q] = 1
        self.free = np.array([not own for own in wanted])
        self.best: list[list[tuple]] = [[] for _ in terms]
        # Scores are compared by nine digits; sums in another order may differ in their last ones.
        self.least = np.full(n, 1e-12)
        self.blocks = self.scored = 0

    @property
    def rows(self) -> int:
        """Rows of a dense slice."""
        return max(BLOCK_ROWS, min(1024, SLICE // max(1, len(self.tids)) // BLOCK_ROWS * BLOCK_ROWS))

    def allowed(self, subjects: list[list[str] | None]) -> np.ndarray:
        held = np.zeros((len(subjects), len(self.subjects)))
        for at, own in enumerate(subjects):
            for s in own or ():
                if s in self.subjects:
                    held[at, self.subjects[s]] = 1
        return (held @ self.wanted > 0) | self.free

    def take(self, row: np.ndarray, tid: np.ndarray, worth: np.ndarray, ids: list, ties: list, subjects: list | None) -> None:
        """Rows 0 to len(ids) - 1, given by the places (row, tid) of their terms."""
        n = len(ids)
        at = np.minimum(np.searchsorted(self.tids, tid), len(self.tids) - 1)
        known = self.tids[at] == tid
        columns, place = np.unique(at[known], return_inverse=True)
        if not len(columns):
            return
        dense = np.zeros((-(-n // BLOCK_ROWS) * BLOCK_ROWS, len(columns)))
        dense[row[known], place] = worth[known]
        weights = self.weights[columns]
        tops = dense.reshape(-1, BLOCK_ROWS, len(columns)).max(axis=1)
        bounds = tops @ weights * (1 + 1e-9) + 1e-9
        free = None if subjects is None else self.allowed(subjects)
        self.blocks += bounds.size
        for block in np.argsort(-bounds.max(axis=1), kind="stable"):
            reached = np.flatnonzero(bounds[block] >= self.least)
            if not len(reached):
                continue
            self.scored += len(reached)
            span = slice(block * BLOCK_ROWS, min((block + 1) * BLOCK_ROWS, n))
            # A block holds few of the slice's terms.
            held = np.flatnonzero(tops[block])
            scores = dense[span, held] @ weights[np.ix_(held, reached)]
            if free is not None:
                scores *= free[span][:, reached]
            for r, c in zip(*np.nonzero(scores >= self.least[reached]), strict=True):
                self.keep(int(reached[c]), float(scores[r, c]), ties[span.start + r], ids[span.start + r])

    def keep(self, q: int, score: float, tie: object, row: object) -> None:
        kept = self.best[q]
        entry = (-round(score, 9), tie is not None, tie, row, score)
        if len(kept) == self.k:
            if entry[:3] >= kept[-1][:3]:
                return
            kept.pop()
        bisect.insort(kept, entry, key=lambda e: e[:3])
        if len(kept) == self.k:
            self.least[q] = -kept[-1][0] * (1 - 1e-9) - 1e-9


def best_rows(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, row, score): for each query up to k rows per task, those of the whole table among them.

    rows: row, tie (any type with an order), tids (array of long), worth (array of double), subjects
    (array of string; may be absent). queries: query (long), terms (array of (tid, weight)), wanted
    (array of string; null or empty asks for no subject), as a table that gives the same rows each time.
    """
    size = queries.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")
    ).first()
    # Each part has about QUERY_TERMS terms, and terms by queries a matrix of bounded size.
    parts = max(1, -(-size.terms // QUERY_TERMS), int(np.ceil(np.sqrt(size.terms * size.n / MATRIX))))
    names = ["row", "tie", "tids", "worth"] + (["subjects"] if "subjects" in rows.columns else [])
    source, schema = rows.select(*names), f"query long, row {dict(rows.dtypes)['row']}, score double"
    found = None
    for part in range(parts):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect()
        if asked or found is None:
            each = source.mapInArrow(_task(asked, k), schema)
            found = each if found is None else found.unionByName(each)
    return found


def _task(asked: list, k: int):
    numbers = [r.query for r in asked]
    terms = [[(t.tid, t.weight) for t in r.terms] for r in asked]
    wanted = [r.wanted for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(terms, wanted, k)
        for batch in batches:
            for start in range(0, batch.num_rows if len(best.tids) else 0, best.rows):
                part = batch.slice(start, best.rows)
                tids, worth = part.column(2), part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(tids.offsets.to_numpy()))
                subjects = part.column(4).to_pylist() if part.num_columns > 4 else None
                best.take(
                    row, tids.flatten().to_numpy(), worth.flatten().to_numpy(),
                    part.column(0).to_pylist(), part.column(1).to_pylist(), subjects,
                )
        rows = [(numbers[q], e[3], e[4]) for q, kept in enumerate(best.best) for e in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query", "row", "score"],
        )

    return run
