"""Exact nearest neighbours by cosine, for whole tables of queries.

Scores are computed as small matrix products inside tasks, for the clusters that a bound does not rule
out, and only the best k rows per query leave a block pair, so no table of query-vector pairs ever exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillrank import scale
from quillrank.functions.text import bind, tokens

BLOCK_ROWS = 4096
# Vectors around one centre, inside a block.
CLUSTER_ROWS = 64
TIE_DIGITS = 9


def _unit(values: pa.Array) -> np.ndarray:
    """Unit vectors of an array of lists; zero vectors stay."""
    if not len(values):
        return np.zeros((0, 0))
    lengths = np.unique(np.diff(values.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    m = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), lengths[0]).astype(np.float64)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def clustered(unit: np.ndarray, rows: int = CLUSTER_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, sizes, centres, reach): rows around pivots, and the smallest cosine of a row with its centre."""
    pivots = unit[:: max(1, rows)]
    near = (unit @ pivots.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    sizes = np.unique(near, return_counts=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    sums = np.add.reduceat(unit[order], starts, axis=0)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    centres = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    cosines = (unit[order] * np.repeat(centres, sizes, axis=0)).sum(axis=1)
    # Zero vectors score 0 with everything and bound nothing.
    cosines[~unit[order].any(axis=1)] = 1
    return order, sizes, centres, np.minimum.reduceat(cosines, starts)


def _blocks(df: DataFrame, row_id: str, prefix: str, cluster: bool) -> DataFrame:
    """Blocks of at most BLOCK_ROWS unit vectors of one namespace, gathered where the rows are."""
    kind = df.schema[row_id].dataType.simpleString()
    schema = f"{prefix}_space string, {prefix}_ids array<{kind}>, {prefix}_dim int, {prefix}_block binary"
    if cluster:
        schema += f", {prefix}_sizes array<int>, {prefix}_centres binary, {prefix}_reach array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A null namespace is a namespace of its own.
            spaces = batch.column(1).dictionary_encode(null_encoding="encode")
            codes = spaces.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                for start in range(0, len(rows), BLOCK_ROWS):
                    part = batch.take(pa.array(rows[start : start + BLOCK_ROWS]))
                    unit, ids, more = _unit(part.column(2)), part.column(0), []
                    if cluster:
                        own, sizes, centres, reach = clustered(unit)
                        unit, ids = unit[own], ids.take(pa.array(own))
                        more = [[sizes.tolist()], [centres.tobytes()], [reach.tolist()]]
                    block = [[part.column(1)[0].as_py()], [ids.to_pylist()], [unit.shape[1]], [unit.tobytes()], *more]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(block, target, strict=True)], schema=target
                    )

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(row_id, "namespace", "values").mapInArrow(run, schema)


class _Search:
    """Best k vectors of each query, over the blocks that one task sees."""

    def __init__(self, k: int) -> None:
        self.k = k
        # The best k rounded scores so far of each query of a block, by the block's place.
        self.best: dict[tuple, np.ndarray] = {}
        self.clusters = self.scored = 0

    def take(self, pair: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) that can be among the best; ties at the last place are kept."""
        if pair["v_dim"] != pair["q_dim"]:
            raise ValueError("vectors differ in length")
        dim = pair["v_dim"]
        vectors, queries = (np.frombuffer(pair[f"{p}_block"]).reshape(-1, dim) for p in "vq")
        centres = np.frombuffer(pair["v_centres"]).reshape(-1, dim)
        ends = np.cumsum(pair["v_sizes"])
        # The nearest that a vector of a cluster can be: the angle to the centre less the cluster's widest.
        angle = np.arccos(np.clip(queries @ centres.T, -1, 1)) - np.arccos(np.clip(pair["v_reach"], -1, 1))
        bounds = np.cos(np.clip(angle, 0, np.pi)) + 1e-8
        best = self.best.setdefault((pair["v_space"], pair["q_at"]), np.zeros((len(queries), self.k)))
        self.clusters += bounds.size
        found = []
        for c in np.argsort(-bounds.max(axis=0), kind="stable"):
            floor = best[:, 0]
            alive = np.flatnonzero((bounds[:, c] >= floor) & (bounds[:, c] > 0))
            if not len(alive):
                continue
            self.scored += len(alive)
            start = ends[c] - pair["v_sizes"][c]
            scores = queries[alive] @ vectors[start : ends[c]].T
            rounded = scores.round(TIE_DIGITS)
            q, v = np.nonzero((rounded >= floor[alive, None]) & (scores > 0))
            found.append((alive[q], v + start, scores[q, v], rounded[q, v]))
            both = np.concatenate([best[alive], np.maximum(rounded, 0)], axis=1)
            best[alive] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        if not found:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        q, v, score, rounded = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = rounded >= best[q, 0]
        return q[kept], v[kept], score[kept]


def _with_namespace(df: DataFrame, namespace: str | None) -> DataFrame:
    col = F.col(namespace).cast("string") if namespace else F.lit(None).cast("string")
    return df.withColumn("namespace", col)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector_id: str = "vector_id",
    values: str = "values",
    query_id: str = "query_id",
    query_values: str = "values",
    namespace: str | None = None,
    query_namespace: str | None = None,
    broadcast: bool = True,
) -> DataFrame:
    """Top k per query and namespace with score > 0: query_id, namespace, vector_id, score, rank.

    A query sees only vectors of its own namespace; without namespace columns both sides
    use the null namespace. Filter `vectors` first for metadata conditions, so that they
    reach the scan.

    Both sides become blocks in the tasks that read them, and blocks of one namespace are
    joined: one plan for any number of queries. The query blocks are broadcast when the
    optimizer's byte estimate allows it, and then no vector moves; else blocks are shuffled by
    namespace, and a hot namespace is split. A block pair costs far more arithmetic than
    transport, and only the best k rows per query leave it. Inside a block vectors lie in clusters with a
    centre and a radius; the most promising come first, and a cluster is left out for every query whose
    k-th best score in the task it cannot reach.
    """
    v = _with_namespace(vectors, namespace).select(
        F.col(vector_id).alias("vector_id"), "namespace", F.col(values).cast("array<double>").alias("values")
    )
    q = _with_namespace(queries, query_namespace).select(
        F.col(query_id).alias("query_id"), "namespace", F.col(query_values).cast("array<double>").alias("values")
    )
    left, right = _blocks(v, "vector_id", "v", True), _blocks(q, "query_id", "q", False)
    right = right.withColumn("q_at", F.monotonically_increasing_id())
    if broadcast and scale.estimated_bytes(queries) <= scale.broadcast_bytes(queries):
        right = F.broadcast(right)
    elif not broadcast:
        right = right.hint("merge")
    pairs = left.join(right, F.col("v_space").eqNullSafe(F.col("q_space"))).drop("q_space")
    schema = (
        f"query_id {q.schema['query_id'].dataType.simpleString()}, namespace string, "
        f"vector_id {v.schema['vector_id'].dataType.simpleString()}, score double"
    )
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(k)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                pair = {n: row.column(n)[0].as_py() for n in row.schema.names if not n.endswith("_ids")}
                found_q, found_v, score = search.take(pair)
                ids = [row.column(f"{p}_ids").flatten().take(pa.array(x)) for p, x in (("q", found_q), ("v", found_v))]
                space = pa.array([pair["v_space"]] * len(score), pa.string())
                columns = [ids[0], space, ids[1], pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    hits = pairs.mapInArrow(run, schema)
    order = [scale.score_key("score", TIE_DIGITS), F.col("vector_id").asc()]
    return scale.top_k(hits, ["query_id", "namespace"], order, k)


def merge_namespaces(hits: DataFrame, namespaces: DataFrame, k: int) -> DataFrame:
    """Best max(k, n*k) hits over a query's n namespaces, in one ranking.

    hits: result of `nearest`. namespaces: query_id, namespace, position (order asked).
    """
    # A query's namespace list is short by nature: it is a field of the query.
    sizes = namespaces.groupBy("query_id").agg(F.count("*").alias("_n"))
    named = namespaces.select("query_id", F.col("namespace").alias("_ns"), "position")
    joined = hits.alias("h").join(
        named.alias("n"),
        (F.col("h.query_id") == F.col("n.query_id")) & F.col("h.namespace").eqNullSafe(F.col("n._ns")),
    ).select("h.query_id", "h.namespace", "h.vector_id", "h.score", F.col("h.rank").alias("_r"), "n.position")
    sized = joined.join(sizes, "query_id").withColumn("_limit", F.greatest(F.lit(k), F.col("_n") * k))
    order = [scale.score_key("score", TIE_DIGITS), F.col("position"), F.col("_r")]
    return (
        scale.top_n(sized, ["query_id"], order, F.col("_limit"), "vector_id")
        .select("query_id", "namespace", "vector_id", "score", "rank")
    )


def best_per_chunk(
    matches: DataFrame,
    chunks: DataFrame,
    k: int,
    query_subjects: DataFrame | None = None,
) -> DataFrame:
    """Best score per (query, chunk), unknown chunks dropped, subjects checked, top k.

    matches: query_id, chunk_id, score. chunks: chunk_id, subjects. query_subjects:
    query_id, wanted (array; null or empty means any).
    """
    best = matches.where(F.col("score") > 0).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    known = best.join(chunks.select("chunk_id", "subjects"), "chunk_id")
    if query_subjects is not None:
        known = known.join(query_subjects, "query_id", "left").where(
            F.col("wanted").isNull() | (F.size("wanted") == 0) | F.arrays_overlap("subjects", "wanted")
        )
    order = [scale.score_key("score", TIE_DIGITS), F.col("chunk_id").asc()]
    return scale.top_k(known, ["query_id"], order, k).select("query_id", "chunk_id", "score", "rank")


# --- embedding -------------------------------------------------------------

class HashingProvider:
    """Deterministic stand-in for an embedding model: token counts in hashed buckets."""

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions
        self.embedding_id = f"hashing:{dimensions}"

    def embed_column(self, text: Column) -> Column:
        """Counts per bucket as an expression of the row; a null text is an empty one."""
        size = self.dimensions
        found = F.transform(
            tokens(F.coalesce(text, F.lit(""))),
            lambda t: ((F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size) * 2 + 1).cast("int"),
        )
        # Tokens of bucket b are 2b + 1. Among them the even 2b marks where, once sorted, bucket b starts.
        marks = F.sequence(F.lit(0), F.lit(2 * size), F.lit(2))
        return bind(
            F.sort_array(F.concat(found, marks)),
            lambda buckets: bind(
                F.filter(F.sequence(F.lit(0), F.size(buckets) - 1), lambda i: F.get(buckets, i) % 2 == 0),
                lambda starts: F.transform(
                    F.sequence(F.lit(0), F.lit(size - 1)), lambda b: (starts[b + 1] - starts[b] - 1).cast("double")
                ),
            ),
        )


def embed(
    df: DataFrame,
    provider,
    text: str = "text",
    out: str = "values",
    batch: int = 64,
) -> DataFrame:
    """Add a vector column by calling provider.embed_texts on batches of at most `batch`.

    A provider with `embed_column` gives an expression instead, and no row leaves the JVM.
    """
    if hasattr(provider, "embed_column"):
        return df.withColumn(out, provider.embed_column(F.col(text)))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
    ) + f", `{out}` array<double>"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            texts = frame[text].tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                got = provider.embed_texts(part)
                if len(got) != len(part):
                    raise ValueError("embedding provider returned the wrong number of vectors")
                vectors.extend(got)
            frame[out] = vectors
            yield frame

    return df.mapInPandas(run, schema)


def embedding_usage(
    lookups: DataFrame, rates: Mapping[str, float] | None = None, batch: int = 64
) -> DataFrame:
    """Per purpose: hits, misses, rate, batches, characters, tokens, and cost.

    lookups: purpose, call_id, model, text, hit. Each call sends its misses in batches.
    """
    misses = F.count(F.when(~F.col("hit"), 1))
    per_call = lookups.groupBy("purpose", "model", "call_id").agg(
        F.count(F.when(F.col("hit"), 1)).alias("h"), misses.alias("m"),
        F.sum(F.length("text")).alias("chars"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.length("text"))), F.lit(0)).alias("sent"),
    )
    summed = per_call.groupBy("purpose", "model").agg(
        F.sum("h").alias("cache_hits"), F.sum("m").alias("cache_misses"),
        F.sum(F.ceil(F.col("m") / F.lit(float(batch)))).cast("long").alias("api_batches"),
        F.sum("chars").alias("input_chars"), F.sum("sent").alias("api_input_chars"),
    )
    total = F.col("cache_hits") + F.col("cache_misses")
    rate = F.lit(0.0)
    for model, per_million in (rates or {}).items():
        rate = F.when(F.col("model") == model, F.lit(float(per_million))).otherwise(rate)
    tokens = F.floor((F.col("api_input_chars") + 3) / 4)
    return summed.withColumn(
        "cache_hit_rate", F.when(total > 0, F.col("cache_hits") / total).otherwise(F.lit(1.0))
    ).withColumn("api_tokens", tokens).withColumn("cost_usd", tokens * rate / 1e6)
