"""BM25 search for whole tables of queries.

Every text row is scanned once and counts its own terms, by whole Arrow batches. A search keeps one row per chunk;
an index has postings, and there each chunk also emits one marker row with an empty term, so that the
number of chunks and their mean length come from the same rows as the term statistics.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank import constants as K
from quillrank import scale
from quillrank.functions.text import tokens
from quillrank.operators import maxscore
from quillrank.session import stored

MARKER = ""
# Postings per part of a stored index.
PART_POSTINGS = 200_000
# Bytes of chunks, as estimated, per part of the rows that are scored.
INDEX_BYTES = 8 << 20
MOST_PARTS = 20_000


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, weight): distinct query terms with their counts."""
    return (
        queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("weight"))
    )


COUNTED = "array<struct<term:string,tf:bigint>>"
# Bytes of texts whose tokens are cut and counted at once.
SLICE_BYTES = 4 << 20
HYPHEN = ord("-")
TOKEN_BYTES = np.array([re.fullmatch("[a-z0-9-]", chr(c)) is not None for c in range(256)])


def cut_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) for every token of an array of lower-case texts, as K.TOKEN_PATTERN finds them."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    rows = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]
    rows, inside = rows - rows[0], TOKEN_BYTES[data]
    # Runs of token bytes; a run ends with its text.
    edges = np.zeros(len(data) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[rows] = True
    edges = np.flatnonzero(edges)
    starts, ends = edges[:-1], edges[1:]
    own = inside[starts]
    starts, ends = starts[own], ends[own]
    # A token does not begin with a hyphen.
    late = np.flatnonzero(data[starts] == HYPHEN)
    if len(late):
        first = np.append(np.flatnonzero(inside & (data != HYPHEN)), len(data))
        starts[late] = first[np.searchsorted(first, starts[late])]
        own = starts < ends
        starts, ends = starts[own], ends[own]
    # Tokens and what lies between them in turn.
    offsets = np.append(np.stack([starts, ends], axis=1).ravel(), ends[-1:]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), max(0, len(offsets) - 1), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return np.searchsorted(rows, starts, side="right") - 1, parts.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def _counted(texts: pa.Array, known: pa.Array | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """(tokens per text, terms per text, terms, tf) of slices of the texts; with known terms only these, by their places."""
    ends = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    start = 0
    while start < len(texts):
        below = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, below + SLICE_BYTES, side="right")))
        row, found = cut_tokens(texts.slice(start, stop - start))
        lengths = np.bincount(row, minlength=stop - start)
        coded = found.dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy()
        if known is not None:
            codes = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy()[codes]
            row, codes, terms = row[codes >= 0], codes[codes >= 0], pa.array(np.arange(len(known)))
        width = max(1, len(terms))
        pairs, tf = np.unique(row * width + codes, return_counts=True)
        yield lengths, np.bincount(pairs // width, minlength=stop - start), terms.take(pa.array(pairs % width)), tf
        start = stop


def _joined(slices: list[tuple], kind: pa.DataType) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Tokens per text, then offsets of the texts' lists, terms and tf, of all slices."""
    lengths, sizes, terms, tfs = map(list, zip(*slices, strict=True) if slices else [[]] * 4)
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([none, *lengths]), pa.array(np.concatenate([[0], *sizes]).cumsum().astype(np.int32)),
        pa.concat_arrays([pa.array([], kind), *terms]), pa.array(np.concatenate([none, *tfs])),
    )


def _term_counts(texts: pa.Array) -> pa.Array:
    _, offsets, terms, tfs = _joined([*_counted(texts)], pa.string())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([terms, tfs], ["term", "tf"]))


def _lowered(text: Column) -> Column:
    return F.lower(text).cast("binary")


def term_counts(text: Column) -> Column:
    """Distinct terms of a text with their counts, without a shuffle; none for a null text.

    Tokens are cut and counted by whole Arrow batches, not one by one.
    """
    return F.arrow_udf(_term_counts, COUNTED)(_lowered(text))


def _term_rows(chunks: DataFrame, chunk_id: str, text: str, marker: bool, keep: Sequence[str]) -> DataFrame:
    """(chunk_id, chunk_len, keep, term, tf), counted inside the row; the marker has an empty term and tf 0."""
    # A null text has no terms.
    found = chunks.select(
        F.col(chunk_id).alias("chunk_id"), *keep,
        F.coalesce(term_counts(F.col(text)), F.array().cast(COUNTED)).alias("_t"),
    ).withColumn("chunk_len", F.aggregate("_t", F.lit(0).cast("long"), lambda a, t: a + t["tf"]).cast("int"))
    mark = F.array(F.struct(F.lit(MARKER).alias("term"), F.lit(0).cast("long").alias("tf")))
    listed = F.concat(mark if marker else F.array().cast(COUNTED), F.col("_t"))
    return found.select("chunk_id", "chunk_len", *keep, F.inline(listed))


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(chunk_id, chunk_len, term, tf) for every term of every chunk, without a shuffle."""
    return _term_rows(chunks, chunk_id, text, False, ())


def index_rows(
    chunks: DataFrame,
    chunk_id: str = "chunk_id",
    text: str = "text",
    vocabulary: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Postings plus one marker row (empty term, tf 0) per chunk, placed by chunk.

    Terms are counted inside the row, and with a vocabulary (column `term`) other terms are
    dropped before anything is shuffled, so only distinct terms that a query uses move, once.
    The result is partitioned by chunk_id; grouping by chunk and query needs no further
    exchange. Readers tell marker rows by tf, never by term: a test on the term would be pushed
    below the exchange and keep Spark from reusing it for the statistics.
    """
    rows = _term_rows(chunks, chunk_id, text, True, keep)
    if vocabulary is not None:
        marker = vocabulary.sparkSession.range(1).select(F.lit(MARKER).alias("term"))
        marked = vocabulary.select("term").distinct().unionByName(marker)
        rows = scale.join_sized(rows, marked, ["term"], how="left_semi", bound=vocabulary)
    # Parts by the size of the input, not by that of the postings: a part's scores are many times its postings.
    parts = -(-scale.estimated_bytes(chunks) // INDEX_BYTES)
    if parts > MOST_PARTS:  # no estimate, or one that multiplies the sides of a join
        return rows.repartition("chunk_id")
    return rows.repartition(max(parts, chunks.sparkSession.sparkContext.defaultParallelism), "chunk_id")


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, df, n_chunks, avg_len), read from the postings and the marker rows."""
    per_term = index.groupBy("term").agg(
        F.count(F.when(F.col("tf") > 0, 1)).alias("df"),
        F.count("*").alias("_rows"), F.sum("chunk_len").alias("_len"),
    )
    corpus = per_term.where(F.col("df") == 0).select(
        F.struct(F.col("_rows").alias("n"), (F.col("_len") / F.col("_rows")).alias("avg")).alias("c")
    )
    return (
        per_term.select("term", "df", corpus.scalar().alias("_c"))
        .where(F.col("df") > 0)
        .select("term", "df", F.col("_c.n").alias("n_chunks"), F.col("_c.avg").alias("avg_len"))
    )


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def saturation(tf: Column, chunk_len: Column, avg_len: Column, k1: float, b: float) -> Column:
    norm = k1 * (1 - b + b * chunk_len / F.greatest(F.lit(1.0), avg_len))
    return tf * (k1 + 1) / (tf + norm)


def score(
    index: DataFrame, terms: DataFrame, k1: float = K.BM25_K1, b: float = K.BM25_B,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(query_id, chunk_id, score) for every chunk that shares a term with a query."""
    stats = term_statistics(index)
    weighted = terms.join(stats, "term").select(
        "query_id", "term", "avg_len",
        (F.col("weight") * idf(F.col("n_chunks"), F.col("df"))).alias("boost"),
    )
    hits = scale.join_sized(index.where(F.col("tf") > 0), weighted, ["term"], bound=terms)
    part = F.col("boost") * saturation(F.col("tf"), F.col("chunk_len"), F.col("avg_len"), k1, b)
    return hits.groupBy("chunk_id", *keep, "query_id").agg(F.sum(part).alias("score"))


def search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    chunk_id: str = "chunk_id",
    text: str = "text",
    query_id: str = "query_id",
    query: str = "query",
    subjects: str | None = None,
    query_subjects: str | None = None,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    order: str | None = None,
) -> DataFrame:
    """Top k chunks per query: (query_id, chunk_id, score, rank).

    With `subjects` (array column of chunks) and `query_subjects` (array column of
    queries) a chunk is kept when the arrays overlap, or when the query names none;
    statistics stay those of the whole corpus. Ties follow `order`, else chunk_id.
    """
    found = search_variants(
        chunks, queries, {"": (k1, b)}, k, chunk_id, text, query_id, query, subjects, query_subjects, order
    )
    return found.drop("variant")


def search_variants(
    chunks: DataFrame,
    queries: DataFrame,
    variants: Mapping[str, tuple[float, float]],
    k: int = 5,
    chunk_id: str = "chunk_id",
    text: str = "text",
    query_id: str = "query_id",
    query: str = "query",
    subjects: str | None = None,
    query_subjects: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """`search` for several (k1, b), by name: (variant, query_id, chunk_id, score, rank). Texts are read once."""
    terms = query_terms(queries, query_id, query)
    vocabulary = numbered(terms)
    keep = [c for c in dict.fromkeys([subjects, order]) if c and c != chunk_id]
    rows = profiles(chunks, vocabulary, chunk_id, text, keep)
    asked = terms.join(vocabulary, "term").select("query_id", "tid", "weight")
    wanted = None
    if subjects and query_subjects:
        wanted = queries.select(F.col(query_id).alias("query_id"), F.col(query_subjects).alias("wanted"))
    tie = "chunk_id" if order is None or order == chunk_id else order
    done = [
        best(rows, asked, k, k1, b, subjects, wanted, tie).select(F.lit(name).alias("variant"), "*")
        for name, (k1, b) in variants.items()
    ]
    return functools.reduce(DataFrame.unionByName, done)


def numbered(terms: DataFrame) -> DataFrame:
    """(term, tid): the distinct terms of the queries with numbers; written, so that numbers stay."""
    return stored(terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")


def profiles(
    chunks: DataFrame, vocabulary: DataFrame, chunk_id: str = "chunk_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per chunk: row, chunk_id, keep, chunk_len, tids, tfs; written once, for several uses.

    tids are the numbers of the vocabulary's terms that the chunk holds. A vocabulary within the
    limit of broadcasts travels with the tasks, and no term of a text leaves its row; with a larger
    one terms are counted in the row, and only those of the vocabulary are shuffled.
    """
    spark = chunks.sparkSession
    whole = chunks.select("*", F.monotonically_increasing_id().alias("row"))
    if scale.estimated_bytes(vocabulary) <= scale.broadcast_bytes(vocabulary):
        made = _known_counts(vocabulary)(_lowered(F.col(text)))
        found = whole.select("row", F.col(chunk_id).alias("chunk_id"), *keep, made.alias("found"))
        return stored(found.select("row", "chunk_id", *keep, "found.*"), "profiles")
    marked = vocabulary.unionByName(spark.range(1).select(F.lit(MARKER).alias("term"), F.lit(-1).cast("long").alias("tid")))
    rows = _term_rows(whole, chunk_id, text, True, ["row", *keep])
    rows = scale.join_sized(rows, marked, ["term"], bound=vocabulary)
    return gathered(rows, keep)


def _known_counts(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """struct(chunk_len, tids, tfs) of a text for the terms of (term, tid)."""
    numbers = vocabulary.select("term", "tid").orderBy("tid").collect()
    known, tids = pa.array([r.term for r in numbers], pa.string()), np.array([r.tid for r in numbers], np.int64)

    def run(texts: pa.Array) -> pa.Array:
        lengths, offsets, places, tfs = _joined([*_counted(texts, known)], pa.int64())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(tids[places.to_numpy()]), tfs)]
        return pa.StructArray.from_arrays([pa.array(lengths.astype(np.int32)), *lists], ["chunk_len", "tids", "tfs"])

    return F.arrow_udf(run, "chunk_len int, tids array<bigint>, tfs array<bigint>")


def gathered(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Profiles from (row, chunk_id, keep, chunk_len, tid, tf); a tid of -1 only keeps its chunk in the table."""
    found = rows.groupBy("row", "chunk_id", *keep, "chunk_len").agg(
        F.sort_array(F.collect_list(F.when(F.col("tid") >= 0, F.struct("tid", "tf")))).alias("found")
    )
    return stored(
        found.select(
            "row", "chunk_id", *keep, "chunk_len", F.col("found.tid").alias("tids"), F.col("found.tf").alias("tfs")
        ),
        "profiles",
    )


def best(
    rows: DataFrame,
    asked: DataFrame,
    k: int = 5,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    subjects: str | None = None,
    wanted: DataFrame | None = None,
    tie: str = "chunk_id",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """Top k per query from profiles and (query_id, tid, weight); blocks of chunks that cannot reach them are not summed.

    `corpus` (chunk_len) has all chunks where `rows` leaves out those without an asked term.
    """
    corpus = (rows if corpus is None else corpus).agg(F.struct(F.count("*").alias("n"), F.avg("chunk_len").alias("avg_len")).alias("c")).scalar()
    stats = rows.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    boost = F.col("weight") * idf(F.col("c.n"), F.col("df"))
    lists = scale.join_sized(asked, stats, ["tid"], bound=asked).withColumn("c", corpus).groupBy("query_id").agg(
        F.collect_list(F.struct("tid", boost.alias("weight"))).alias("terms")
    )
    if wanted is None:
        lists = lists.withColumn("wanted", F.lit(None).cast("array<string>"))
    else:
        lists = lists.join(wanted, "query_id")
    lists = stored(lists.withColumn("query", F.monotonically_increasing_id()), "asked")
    worth = F.transform("tfs", lambda tf: saturation(tf, F.col("chunk_len"), F.col("c.avg_len"), k1, b))
    held = rows.withColumn("c", corpus).select(
        "row", F.col(tie).alias("tie"), "tids", worth.alias("worth"), *([F.col(subjects).alias("subjects")] if subjects else [])
    )
    found = maxscore.best_rows(held, lists.select("query", "terms", "wanted"), k)
    # At most k rows per query and task are left.
    named = found.join(rows.select("row", "chunk_id", F.col(tie).alias("tie")), "row")
    ranked = scale.top_k(named, ["query"], [scale.score_key("score"), F.col("tie").asc()], k)
    return scale.join_sized(ranked, lists.select("query", "query_id"), ["query"]).select("query_id", "chunk_id", "score", "rank")


def write_index(
    chunks: DataFrame, path: str, chunk_id: str = "chunk_id", text: str = "text", part_postings: int = PART_POSTINGS
) -> None:
    """Store an index of the chunks: `postings` by part, `chunks` and `layout`.

    Terms are hashed into as many parts as the postings need, of about `part_postings` each. Inside a
    part rows are sorted by term. Choose `part_postings` so that folders stay below some ten thousands.
    """
    spark = chunks.sparkSession
    whole = chunks.select("*", F.monotonically_increasing_id().alias("row"))
    rows = stored(_term_rows(whole, chunk_id, text, True, ["row"]), "index-rows")
    rows.where("tf = 0").select("row", "chunk_id", "chunk_len").write.mode("overwrite").parquet(f"{path}/chunks")
    counted = rows.where("tf > 0")
    layout = spark.range(1).select(F.lit(max(1, -(-counted.count() // part_postings))).alias("parts"))
    layout.write.mode("overwrite").parquet(f"{path}/layout")
    placed = counted.withColumn("part", _part(spark, path)).hint("rebalance", "part").sortWithinPartitions("part", "term")
    placed.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")


def _part(spark: SparkSession, path: str) -> Column:
    parts = spark.read.parquet(f"{path}/layout").select(F.max("parts")).scalar()
    return F.pmod(F.xxhash64("term"), parts).cast("int")


def read_index(spark: SparkSession, path: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored postings of the terms, with numbers tid, and those numbers (term, part, tid).

    Parts are pruned while the query runs (dynamic pruning), so only the folders of asked terms
    are listed and read; nothing is collected for it.
    """
    numbers = numbered(terms).withColumn("part", _part(spark, path))
    # Pruning needs a condition on the side that prunes; no term is empty.
    few = numbers.where(F.length("term") > 0)
    return scale.join_sized(spark.read.parquet(f"{path}/postings"), few, ["part", "term"], bound=terms), numbers


def search_index(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    query: str = "query",
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
) -> DataFrame:
    """`search` in a stored index: (query_id, chunk_id, score, rank)."""
    terms = query_terms(queries, query_id, query)
    found, numbers = read_index(spark, path, terms)
    asked = terms.join(numbers, "term").select("query_id", "tid", "weight")
    return best(gathered(found), asked, k, k1, b, corpus=spark.read.parquet(f"{path}/chunks"))


def smoke(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Per query: did any expected chapter appear in its first k results.

    results: query_id, chapter, rank. expected: query_id, chapter (one row per pair).
    """
    hit = (
        results.where(F.col("rank") <= k).select("query_id", "chapter")
        .join(expected, ["query_id", "chapter"], "left_semi")
        .groupBy("query_id").agg(F.lit(True).alias("passed"))
    )
    return (
        expected.select("query_id").distinct().join(hit, "query_id", "left")
        .withColumn("passed", F.coalesce("passed", F.lit(False)))
    )
