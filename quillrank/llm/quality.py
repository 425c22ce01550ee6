"""Quality classifier (operator 5): a weak-label model and a hashed linear scorer.

Seven heuristic labellers look at a text and vote junk, clean, or not at all. How often each
combination of votes occurs is counted over all documents; there are at most 3**7 combinations,
whatever the input. Expectation-maximisation over these counts estimates the share of junk and
each labeller's chance of each vote on junk and on clean texts, without any given label. The
posterior of a text's votes is its training label.

A linear scorer on hashed features (shapes of words, pairs of them, and steps of the
labellers' measures) is fitted to posteriors of a bounded sample, at most TRAIN_DOCS texts in
order of a hash. Then every text is scored in one pass; nothing but the counts
of votes is shuffled.

Null and empty texts score 0. Texts that no labeller votes on follow the scorer alone. Equal
texts get equal scores, so repeated rows do no harm; all columns of the input are kept, other
than those named `quality_score` and `quality_posterior`, which are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm import batches
from quillrank.llm.sampling import sample_texts

TRAIN_DOCS = 8_000
BUCKETS = 1 << 14
EPOCHS = 30
ROUNDS = 100
THRESHOLD = 0.5
MEMO = 50_000
LABELLERS = ("symbols", "capitals", "repeats", "separators", "sentences", "variety", "lines")
# Measures at which a labeller votes junk (first) or clean (second); between them it abstains.
RULES = {
    "symbols": (0.30, 0.08), "capitals": (0.60, 0.30), "repeats": (0.25, 0.05), "separators": (0.25, 0.05),
    "sentences": (0.98, 0.97), "variety": (0.60, 0.35), "lines": (0.40, 0.15),
}
JUNK, CLEAN, NONE = 0, 1, 2
SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)
RUN = re.compile(rb"(.)\1+", re.S)
SYMBOLS = re.compile(rb"[^aA0]{2,}$|^[^aA0]+$")


class Shapes(dict):
    """A word's shape with runs shortened, for words whose letters are already replaced."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = RUN.sub(rb"\1\1", word)[:12]
        return value


def measures(text: bytes, shapes: Shapes) -> tuple[dict[str, float], Counter]:
    """Measures of the labellers, each rising with junk, and the shapes of the words."""
    words = text.split()
    n = max(1, len(words))
    outlines = Counter()
    for word, count in Counter(text.translate(SHAPE).split()).items():
        outlines[shapes[word]] += count
    upper = sum(c for s, c in outlines.items() if s.count(b"A") >= 2)
    ends = sum(c for s, c in outlines.items() if s.endswith(b"."))
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = max(1, len(words) - 2)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    found = {
        "symbols": sum(c for s, c in outlines.items() if SYMBOLS.search(s)) / n,
        "capitals": upper / n,
        "repeats": repeats / n,
        "separators": sum(c for s, c in outlines.items() if not s.strip(b"|*#-_=<>/\\~+&$%!")) / n,
        "sentences": 1 - ends / n,
        "variety": max(0.0, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    return found, outlines


def votes(found: dict[str, float], n_words: int) -> list[int]:
    """One vote per labeller; short texts are left alone by the labellers that need length."""
    out = []
    for name in LABELLERS:
        junk, clean = RULES[name]
        x = found[name]
        short = n_words < 30 and name in ("sentences", "variety", "lines", "repeats")
        out.append(NONE if short else JUNK if x > junk else CLEAN if x < clean else NONE)
    return out


def fit_labellers(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of junk, and chance[labeller, class, vote], by expectation-maximisation.

    Patterns start from their own votes (more for junk than one in four), so that the class
    called junk is the one that the labellers call so.
    """
    keys, n = np.array(list(patterns), np.int64), np.array(list(patterns.values()), np.float64)
    said = np.maximum(1, (keys != NONE).sum(axis=1))
    junk = np.clip((keys == JUNK).sum(axis=1) / said * 2, 0.02, 0.98)
    share, chance = 0.1, np.zeros((keys.shape[1], 2, 3))
    for _ in range(rounds):
        share = float(np.clip((n @ junk) / n.sum(), 1e-3, 0.5))
        for j in range(keys.shape[1]):
            for c, weight in ((JUNK, junk), (CLEAN, 1 - junk)):
                hits = np.array([(n * weight)[keys[:, j] == v].sum() for v in range(3)])
                chance[j, c] = (hits + 0.5) / (hits.sum() + 1.5)
        junk = posterior(keys, share, chance)
    return share, chance


def posterior(keys: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """Probability of junk for each row of votes."""
    columns = np.arange(keys.shape[1])
    junk = np.log(share) + np.log(chance[columns, JUNK, keys]).sum(axis=1)
    clean = np.log1p(-share) + np.log(chance[columns, CLEAN, keys]).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(clean - junk, -500, 500)))


def features(found: dict[str, float], outlines: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and steps of the measures."""
    total = sum(outlines.values()) or 1
    values: dict[int, float] = {}
    for shape, count in outlines.items():
        at = zlib.crc32(b"shape " + shape) % BUCKETS
        values[at] = values.get(at, 0.0) + count / total
    for name, x in found.items():
        at = zlib.crc32(f"{name} {int(min(0.999, max(0.0, x)) * 10)}".encode()) % BUCKETS
        values[at] = values.get(at, 0.0) + 0.5
    return np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), np.float64, len(values))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], clean: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer (the last is the constant), by steps scaled per weight."""
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-3)
    if not rows:
        return weights
    at = np.concatenate([np.append(i, BUCKETS) for i, _ in rows])
    x = np.concatenate([np.append(v, 1.0) for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) + 1 for i, _ in rows])
    # Junk is rare; both classes weigh alike.
    balance = np.where(clean > 0.5, 0.5 / max(clean.mean(), 1e-3), 0.5 / max(1 - clean.mean(), 1e-3))
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * weights[at], len(rows)), -30, 30)))
        slope = np.bincount(at, x * ((p - clean) * balance)[row], BUCKETS + 1) / len(rows) + 1e-5 * weights
        seen += slope * slope
        weights -= 0.5 * slope / np.sqrt(seen)
    return weights


def _text(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def vote_patterns(docs: DataFrame, text_col: str = "text") -> dict[tuple[int, ...], int]:
    """Combinations of votes and their counts over all documents."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, counts = Shapes(), Counter()
        for part in batches.slices(parts):
            for text in batches.byte_texts(part.column(0)):
                found, outlines = measures(text, shapes)
                counts["".join(map(str, votes(found, sum(outlines.values()))))] += 1
        yield pa.record_batch(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"]
        )

    rows = _text(docs, text_col).mapInArrow(run, "votes string, n long")
    return {tuple(map(int, r.votes)): r.n for r in rows.groupBy("votes").agg(F.sum("n").alias("n")).collect()}


def fit(docs: DataFrame, text_col: str = "text", limit: int = TRAIN_DOCS) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of junk, the labellers' chances, and the scorer's weights."""
    patterns = vote_patterns(docs, text_col)
    share, chance = fit_labellers(patterns) if patterns else (0.1, np.full((len(LABELLERS), 2, 3), 1 / 3))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for part in batches.slices(parts):
            at, values, keys = [], [], []
            for text in batches.byte_texts(part.column(0)):
                found, outlines = measures(text, shapes)
                i, x = features(found, outlines)
                at.append(i), values.append(x), keys.append(votes(found, sum(outlines.values())))
            junk = posterior(np.array(keys), share, chance)
            yield pa.record_batch(
                [pa.array(at, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64())), pa.array(junk)],
                names=["at", "x", "junk"],
            )

    text = _text(docs, text_col)
    rows = sample_texts(text, limit).mapInArrow(run, "at array<long>, x array<double>, junk double").collect()
    vectors = [(np.array(r["at"], np.int64), np.array(r["x"])) for r in rows]
    return share, chance, fit_scorer(vectors, 1 - np.array([r.junk for r in rows]))


def classify(docs: DataFrame, *, text_col: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """`docs` with quality_score (1: clean) of the scorer and quality_posterior of the labellers."""
    docs = docs.drop("quality_score", "quality_posterior")
    share, chance, weights = fit(docs, text_col, limit)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for part in batches.slices(parts, at):
            scores, keys = [], []
            for text in batches.byte_texts(part.column(at)):
                found, outlines = measures(text, shapes)
                keys.append(votes(found, sum(outlines.values())))
                i, x = features(found, outlines)
                z = float(x @ weights[i]) + weights[BUCKETS]
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) if outlines else 0.0)
            likely = 1 - posterior(np.array(keys), share, chance)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores, pa.float64()), pa.array(likely, pa.float64())],
                names=[*part.schema.names, "quality_score", "quality_posterior"],
            )

    out = T.StructType([*docs.schema.fields]).add("quality_score", "double").add("quality_posterior", "double")
    return docs.mapInArrow(run, out)
