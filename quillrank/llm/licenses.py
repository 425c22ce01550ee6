"""License scan (operator 3): a positional rare-token index.

Templates are short licence statements and the base phrases. For every word of the templates
the number of documents that hold it is counted over the whole table, which gives its inverse
document frequency. Each template is looked up by the rarest word of its mandatory phrase: an
occurrence at place p of that word, which stands at position q of the template, proposes that
the template starts at p - q. A template counts only when its mandatory phrase stands at its
place and enough of its words fit by relative position. As no template counts without its
phrase, and no phrase stands without its rarest word, a lookup misses nothing, however many
licence words a file has.

Base phrases are mandatory as a whole, so their places are found exactly. The index has at most
as many words as templates, and travels with the tasks; the scan shuffles nothing but the counts
of licence words.

Null texts count as empty: no words, no labels, score 0, null first and last word. Repeated
rows are scanned once each; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import batches

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence statements: label, words of the statement, phrase that must stand in it.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "granted free of charge"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc0", "dedicated to the public domain under cc0", "public domain"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "modify and or distribute"),
)
FIT = 0.6  # share of a template's words that must stand at their places

SCHEMA = (
    "doc_id long, n_words long, places array<struct<label:string,start:long>>, "
    "found array<struct<label:string,start:long,fit:double>>"
)


@dataclass(frozen=True)
class Index:
    """Templates as word tuples (base phrases first), postings of the words looked up, and what must hold for a match."""

    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]  # rarest word of each mandatory phrase: template, position
    words: list[tuple[bytes, ...]]
    labels: list[str]
    phrases: list[tuple[int, tuple[bytes, ...]]]  # offset in the template, words


def vocabulary() -> list[str]:
    return sorted({w for text in [*BASE, *(t for _, t, _ in TEMPLATES)] for w in text.split()})


def word_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and documents with each licence word. One row per licence word reaches the driver."""
    known = frozenset(w.encode() for w in vocabulary())

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        for part in batches.slices(parts):
            for text in batches.byte_texts(part.column(0)):
                held[b""] += 1
                for w in known.intersection(batches.plain_words(text)):
                    held[w] += 1
        yield pa.record_batch(
            [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"],
        )

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    found = {r.word.encode(): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def build_index(n_docs: int, held: dict[bytes, int]) -> Index:
    idf = {w.encode(): math.log((n_docs + 1) / (held.get(w.encode(), 0) + 1)) + 1 for w in vocabulary()}
    texts = [(label, phrase, phrase) for phrase, label in BASE.items()] + list(TEMPLATES)
    words = [tuple(t.encode().split()) for _, t, _ in texts]
    phrases = []
    for (_, _, must), template in zip(texts, words, strict=True):
        m = tuple(must.encode().split())
        phrases.append((next(i for i in range(len(template)) if template[i : i + len(m)] == m), m))
    postings = defaultdict(list)
    for t, (offset, must) in enumerate(phrases):
        i = min(range(len(must)), key=lambda i: (-idf[must[i]], must[i], i))
        postings[must[i]].append((t, offset + i))
    return Index(idf, dict(postings), words, [label for label, _, _ in texts], phrases)


def scan_words(index: Index, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, float]]]:
    """Places of base phrases (label, start), and licence statements (label, start, fit)."""
    if index.postings.keys().isdisjoint(words):
        return [], []
    proposed = {(t, p - q) for p, w in enumerate(words) if w in index.postings for t, q in index.postings[w]}
    places, found = [], []
    for t, start in sorted(proposed, key=lambda x: (x[1], x[0])):
        template, (offset, must) = index.words[t], index.phrases[t]
        at = start + offset
        if at < 0 or tuple(words[at : at + len(must)]) != must:
            continue
        if t < len(BASE):
            places.append((index.labels[t], start))
            continue
        weight = sum(index.idf[w] for w in template)
        fits = sum(index.idf[w] for i, w in enumerate(template) if 0 <= start + i < len(words) and words[start + i] == w)
        if fits >= FIT * weight:
            found.append((index.labels[t], max(start, 0), fits / weight))
    return places, found


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, places (base phrases), found (licence statements with their fit)."""
    index = build_index(*word_counts(docs, text_col))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.slices(parts, 1):
            lengths, places, found = [], [], []
            for text in batches.byte_texts(part.column(1)):
                words = batches.plain_words(text)
                base, more = scan_words(index, words)
                lengths.append(len(words))
                places.append([{"label": a, "start": s} for a, s in base])
                found.append([{"label": a, "start": s, "fit": f} for a, s, f in more])
            place = pa.struct([("label", pa.string()), ("start", pa.int64())])
            hit = pa.struct([("label", pa.string()), ("start", pa.int64()), ("fit", pa.float64())])
            yield pa.record_batch(
                [part.column(0), pa.array(lengths, pa.int64()), pa.array(places, pa.list_(place)),
                 pa.array(found, pa.list_(hit))],
                names=["doc_id", "n_words", "places", "found"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score of each document of scan().

    The score is the best fit of a licence statement; a base phrase alone gives one half.
    """
    starts, base, own = F.col("places.start"), F.array_distinct("places.label"), F.col("found.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(
            F.coalesce(F.array_max(F.col("found.fit")), F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0)
        ).alias("score"),
    )
