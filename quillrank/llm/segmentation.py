"""SentencePiece encoding and decoding (operator 10): sampled segmentations of a piece lattice.

A text is spanned by the pieces of a given vocabulary in many ways. Each way weighs the product
of its pieces' probabilities, to the power ALPHA. Forward filtering sums the weights of all ways
that reach each place; backward sampling then draws pieces from the end, each by its exact share,
so a segmentation is drawn by its weight among all. Random numbers come from a hash of the row
key, the segment's number in the text and the step: a row gets the same pieces in any partition,
batch or order of rows.

Pieces with a space after their first character (14 of the default vocabulary) are left out of the
lattice, and no piece holds a line end, so the lattice falls apart there; equal segments of a slice share their sums, and all segments of one length
are summed and sampled as arrays. Characters without a piece become their bytes, so decoding
gives every text back byte by byte, also the space symbol itself. Texts start with one space
that decoding takes away; null and empty texts have no pieces.

The vocabulary names no probabilities (its scores are ranks of merges): a piece of rank r has
weight 1 / (r + 2), as word frequencies fall with rank; a byte weighs less than any piece. Work
is one pass without a shuffle, whatever repeats. A null key draws like any other key.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm import batches
from quillrank.llm.shingles import mixed

ALPHA = 0.7
SEED = 17
SPACE = "▁"
SEGMENT = re.compile(f" ?[^ \n{SPACE}]+| |\n|{SPACE}")
LONG = 48  # characters; longer segments are looked up as arrays and summed one by one
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
GOLDEN = 0x9E3779B97F4A7C15
SLOTS = 20
SLICE = 1 << 20  # bytes of text, or of ids, that are worked on at once: their arrays take some forty times as much
BYTE_WEIGHT = 0.5  # of the weight of the last piece, for each byte


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary: pieces as text (spaces plain), log weights, and a hash table for arrays of places."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes_at = [0] * 256
        self.raw = [b""] * size
        usable = []
        for i in range(size):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.bytes_at[value], self.raw[i] = i, bytes([value])
            elif not special[i]:
                self.raw[i] = names[i].replace(SPACE, " ").encode()
                if names[i] == SPACE or (SPACE not in names[i][1:] and model.get_score(i) > -1e6):
                    usable.append(i)
        ranks = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-model.get_score(i), i)))}
        self.log = np.full(size, -np.inf)
        for i, r in ranks.items():
            self.log[i] = -alpha * np.log(r + 2.0)
        self.byte_log = alpha * np.log(BYTE_WEIGHT / (len(ranks) + 2.0))
        self.ids = {names[i].replace(SPACE, " "): i for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        self._tables(list(self.ids.items()))

    def _tables(self, pieces: list[tuple[str, int]]) -> None:
        """Two open tables: the second holds what collides in the first."""
        lengths = np.array([len(s) for s, _ in pieces], np.int64)
        keys = np.zeros(len(pieces), np.uint64)
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            codes = np.frombuffer("".join(pieces[i][0] for i in own).encode("utf-32-le"), "<u4").reshape(-1, n)
            keys[own] = self._hash(codes.astype(np.uint64))[:, -1]
        ids = np.array([i for _, i in pieces], np.int32)
        self.tables, shift, rest = [], 64 - SLOTS, np.arange(len(keys))
        while len(rest):
            slots = (mixed(keys[rest] + np.uint64(len(self.tables))) >> np.uint64(shift)).astype(np.int64)
            _, first = np.unique(slots, return_index=True)
            own = np.full(1 << SLOTS, -1, np.int32)
            own[slots[first]] = rest[first]
            self.tables.append(own)
            rest = np.delete(rest, first)
        self.keys, self.key_ids = keys, ids

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Hash of each beginning of each row of code points."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + codes[:, j] + np.uint64(1)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        rows, left = slice(None), hashes
        for n, table in enumerate(self.tables):
            at = table[(mixed(left + np.uint64(n)) >> np.uint64(64 - SLOTS)).astype(np.int64)]
            # What is not in this table and meets no key here is in no later one.
            there = np.flatnonzero(at >= 0)
            at, own = at[there], left[there]
            rows = there if n == 0 else rows[there]
            hit = self.keys[at] == own
            found[rows[hit]] = self.key_ids[at[hit]]
            rows, left = rows[~hit], own[~hit]
        return found

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes_at[b] for b in char.encode()]


def uniforms(base: np.ndarray, step: int) -> np.ndarray:
    """A number from 0 to 1 for each 64-bit base and a step."""
    with np.errstate(over="ignore"):
        x = mixed(base + np.uint64(GOLDEN * (step + 1) % (1 << 64)))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str, alpha: float) -> Pieces:
    """One instance per worker process, which runs many tasks."""
    return Pieces(path, alpha)


@functools.lru_cache(maxsize=2)
def raw_pieces(path: str) -> list[bytes]:
    """The bytes of each id, all that decoding needs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        raw.append(bytes([int(name[3:5], 16)]) if model.is_byte(i) else b"" if special else name.replace(SPACE, " ").encode())
    return raw


def sample_one(pieces: Pieces, segment: str, base: int) -> list[int]:
    """Ids of one segment: the same draw as sample_many, with all its pieces looked up as arrays."""
    n, width = len(segment), min(pieces.longest, len(segment))
    codes = np.frombuffer(segment.encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = Pieces._hash(codes[None, :])[0]
    # Row j - 1, column w: what may end at j and begin at j - width + w.
    at = np.full((n, width), -1, np.int64)
    for w in range(width if segment != SPACE else 0):
        long = width - w
        power = np.uint64(pow(int(BASE), long, 1 << 64))
        at[long - 1 :, w] = pieces.find(ends[long:] - ends[: n + 1 - long] * power)
    weights = np.where(at >= 0, pieces.log[at], -np.inf)
    lone = at[:, -1] < 0
    sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    weights[lone, -1] = pieces.byte_log * sizes[lone]
    sums = np.full(width + n + 1, -np.inf)  # sums[width + j] of the first j characters
    sums[width] = 0.0
    for j in range(1, n + 1):
        own = weights[j - 1] + sums[j : j + width]
        top = own.max()
        sums[width + j] = top + np.log(np.exp(own - top).sum())
    out: list[int] = []
    j, step = n, 0
    while j:
        own = weights[j - 1] + sums[j : j + width]
        shares = np.cumsum(np.exp(own - own.max()))
        u = uniforms(np.array([base], np.uint64), step)[0] * shares[-1]
        pick = min(int((shares <= u).sum()), width - 1)
        found = int(at[j - 1, pick])
        out += [found] if found >= 0 else pieces.byte_ids(segment[j - 1])[::-1]
        j, step = j - width + pick, step + 1
    return out[::-1]


def _sample_length(
    pieces: Pieces, segments: list[str], of: np.ndarray, bases: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of occurrences `of` distinct segments of one length, as rows filled from the left; -1 ends a row.

    Ids below -1 stand for a character's bytes: -2 - code point.
    """
    n, width = len(segments[0]), pieces.longest
    codes = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)
    ends = Pieces._hash(codes)
    powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(n + 1)], np.uint64)
    sums = np.full((len(segments), n + 1), -np.inf)
    sums[:, 0] = 0.0
    ids, shares = [], []
    for j in range(1, n + 1):
        first = max(0, j - width)
        at = pieces.find((ends[:, j, None] - ends[:, first:j] * powers[j - first : 0 : -1]).ravel()).reshape(len(segments), -1)
        w = np.where(at >= 0, pieces.log[at], -np.inf)
        lone = at[:, -1] < 0
        if lone.any():
            c = codes[lone, j - 1].astype(np.int64)
            w[lone, -1] = pieces.byte_log * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
            at[lone, -1] = -2 - c
        w = w + sums[:, first:j]
        top = w.max(axis=1, keepdims=True)
        part = np.cumsum(np.exp(w - top), axis=1)
        sums[:, j] = top[:, 0] + np.log(part[:, -1])
        ids.append(at), shares.append(part)
    out = np.full((len(of), n), -1, np.int64)
    place, live = np.full(len(of), n), np.arange(len(of))
    for step in range(n):
        u = uniforms(bases[live], step)
        for j in np.unique(place[live]):
            here = place[live] == j
            rows = live[here]
            part = shares[j - 1][of[rows]]
            pick = np.minimum((part <= (u[here] * part[:, -1])[:, None]).sum(axis=1), part.shape[1] - 1)
            out[rows, step] = ids[j - 1][of[rows], pick]
            place[rows] = max(0, j - width) + pick
        live = live[place[live] > 0]
        if not len(live):
            break
    return out, (out != -1).sum(axis=1)


def sample_many(pieces: Pieces, segments: list[str], bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and where each segment's ids end."""
    distinct = list(dict.fromkeys(segments))
    numbers = dict(zip(distinct, range(len(distinct)), strict=True))
    of = np.fromiter(map(numbers.__getitem__, segments), np.int64, len(segments))
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    lengths[[i for i, s in enumerate(distinct) if s == SPACE]] = LONG + 1
    each = lengths[of]
    counts, parts = np.zeros(len(segments), np.int64), []
    for n in np.unique(lengths):
        rows, own = np.flatnonzero(each == n), np.flatnonzero(lengths == n)
        if n <= LONG:
            back = np.zeros(len(distinct), np.int64)
            back[own] = np.arange(len(own))
            found, steps = _sample_length(pieces, [distinct[i] for i in own], back[of[rows]], bases[rows])
            counts[rows] = steps
            flat = found[found != -1]
            # Sampled from the end: the k-th of a row stands at its count - 1 - k.
            k = np.arange(len(flat)) - np.repeat(np.cumsum(steps) - steps, steps)
            parts.append((np.repeat(rows, steps), np.repeat(steps, steps) - 1 - k, flat))
        else:
            for r in rows.tolist():
                got = np.array(sample_one(pieces, segments[r], int(bases[r])), np.int64)
                counts[r] = len(got)
                parts.append((np.full(len(got), r), np.arange(len(got)), got))
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    for rows, k, flat in parts:
        out[ends[rows] - counts[rows] + k] = flat
    return out, ends


def _expand(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """Ids with the characters that have no piece as bytes."""
    if not (ids < 0).any():
        return ids.astype("<u4")
    out: list[int] = []
    for i in ids.tolist():
        out += [i] if i >= 0 else pieces.byte_ids(chr(-2 - i))
    return np.array(out, "<u4")


def encode(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    alpha: float = ALPHA,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with piece_ids (little-endian unsigned 32-bit) in place of a column of this name."""
    path = vocabulary or default_vocabulary()
    docs = docs.drop("piece_ids").withColumn("__key", F.xxhash64(F.lit(seed), F.col(id_col)))
    at, key = docs.columns.index(text_col), len(docs.columns) - 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary_of(path, alpha)
        for part in batches.slices(parts, at, SLICE):
            found = [SEGMENT.findall(" " + t) if t else [] for t in part.column(at).to_pylist()]
            sizes = np.array([len(f) for f in found])
            keys = part.column(key).to_numpy().astype(np.uint64)
            order = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bases = mixed(np.repeat(keys, sizes) + order.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            ids, ends = sample_many(pieces, [s for f in found for s in f], bases)
            stops = np.concatenate([[0], ends])[np.cumsum(sizes)]
            starts = np.concatenate([[0], stops[:-1]])
            out = [_expand(pieces, ids[a:b]).tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:key], pa.array(out, pa.binary())], names=[*part.schema.names[:key], "piece_ids"]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:key]]).add("piece_ids", "binary"))


def decode(rows: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """`rows` (with piece_ids) with decoded text in place of a column of this name."""
    path = vocabulary or default_vocabulary()
    rows = rows.drop("decoded")
    at = rows.columns.index("piece_ids")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = raw_pieces(path)
        for part in batches.slices(parts, at, SLICE):
            texts = [
                b"".join(map(raw.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))[1:]
                for ids in part.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "decoded"]
            )

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add("decoded", "string"))
