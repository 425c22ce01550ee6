"""Embedding near-dedup (operator 4): exact threshold pairs by dual traversal of cover trees.

Vectors of one label are brought to length one and equal ones become one point with a count.
Points are sorted by label and by their distance to a fixed reference point and cut into chunks
of at most CHUNK points; ranges of the order may be cut anywhere, so one hot label or one hot
vector is spread over tasks. Each chunk becomes a cover tree: nested levels of centres whose
radii halve, each node with its true covering radius.

Chunks of one label whose rings are further apart than the threshold distance cannot hold a
pair. For the others the two trees are walked together: a pair of nodes is dropped when the
distance of the centres exceeds both covering radii and the threshold distance, by the triangle
inequality; the rest is compared in double precision. A pair of chunks returns the number of
links of each point and one edge per point that ties it to a point it is linked with, so a
dense group never turns into a table of pairs.

Vectors that are null, zero, or hold nulls or non-finite components, and those without a label,
are linked with nothing; so are vectors of different lengths. Repeated rows count as links of
each other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.components import Forest, components
from quillrank.session import stored

THRESHOLD = 0.98
CHUNK = 2048
FIRST_RADIUS = 1.0
LEVELS = 7  # the last radius is FIRST_RADIUS / 64, well below the threshold distance
EPS = 1e-9
TREE = "label long, low double, high double, dim int, points binary, nodes binary, counts binary"


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one, or None where it can't be linked."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not np.isfinite(v).all() or not (top := np.abs(v).max()):
        return None
    v = v / top
    return v / math.sqrt(v @ v) + 0.0


class Tree:
    """Cover tree of a chunk: for each level the centres, their children below and covering radii."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        everything = np.arange(len(points))
        self.children: list[list[np.ndarray]] = []
        self.radii: list[np.ndarray] = [np.array([self._far(0, everything)])]
        self.centres: list[np.ndarray] = [np.array([0])]
        members, radius = [everything], FIRST_RADIUS
        for _ in range(LEVELS):
            below: list[np.ndarray] = []
            centres: list[int] = []
            children: list[np.ndarray] = []
            for centre, own in zip(self.centres[-1], members, strict=True):
                first = len(centres)
                for c, part in self._net(int(centre), own, radius):
                    centres.append(c)
                    below.append(part)
                children.append(np.arange(first, len(centres)))
            self.children.append(children)
            self.centres.append(np.array(centres))
            self.radii.append(np.array([self._far(c, m) for c, m in zip(centres, below, strict=True)]))
            members, radius = below, radius / 2
        self.members = members

    def _far(self, centre: int, own: np.ndarray) -> float:
        if len(own) < 2:
            return 0.0
        return float(np.sqrt(np.maximum(2 - 2 * (self.points[own] @ self.points[centre]), 0).max())) + EPS

    def _net(self, centre: int, own: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Centres at least `radius` apart that cover all members, the node's own centre first."""
        if len(own) == 1:
            return [(centre, own)]
        points = self.points[own]
        square = np.maximum(2 - 2 * (points @ self.points[centre]), 0)
        nearest, centres = np.zeros(len(own), np.int64), [centre]
        while square[far := int(square.argmax())] > radius * radius:
            to_new = np.maximum(2 - 2 * (points @ points[far]), 0)
            to_new[far] = 0.0
            closer = to_new < square
            nearest[closer], square[closer] = len(centres), to_new[closer]
            centres.append(int(own[far]))
        order = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[order], np.arange(1, len(centres)))
        return list(zip(centres, np.split(own[order], cuts), strict=True))


def dual_traversal(a: Tree, b: Tree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) with cosine of at least `threshold`, each once."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    stack = [(0, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        if level == LEVELS:
            left, right = a.members[i], b.members[j]
            x, y = np.nonzero(a.points[left] @ b.points[right].T >= threshold)
            if len(x):
                yield left[x], right[y]
            continue
        left, right = a.children[level][i], b.children[level][j]
        ca, cb = a.centres[level + 1][left], b.centres[level + 1][right]
        ra, rb = a.radii[level + 1][left], b.radii[level + 1][right]
        cosines = a.points[ca] @ b.points[cb].T
        apart = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        x, y = np.nonzero(apart <= ra[:, None] + rb[None, :] + reach)
        single = (ra[x] == 0) & (rb[y] == 0)
        sx, sy = x[single], y[single]
        hit = cosines[sx, sy] >= threshold
        if hit.any():
            yield ca[sx[hit]], cb[sy[hit]]
        stack += [(level + 1, int(left[p]), int(right[q])) for p, q in zip(x[~single], y[~single], strict=True)]


def _points(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            units = [unit(v) for v in part.column(2).to_pylist()]
            # Distance to the point whose components are all equal.
            rings = [None if v is None else math.sqrt(max(0.0, 2 - 2 * v.sum() / math.sqrt(len(v)))) for v in units]
            yield pa.record_batch(
                [part.column(0), part.column(1),
                 pa.array([None if v is None else v.astype("<f8").tobytes() for v in units], pa.binary()),
                 pa.array([None if v is None else len(v) for v in units], pa.int32()), pa.array(rings, pa.float64())],
                names=["vec_id", "label", "point", "dim", "ring"],
            )

    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    return rows.mapInArrow(run, "vec_id long, label long, point binary, dim int, ring double")


def _trees(nodes: DataFrame) -> DataFrame:
    """Chunks of nodes in order of label, length and ring."""
    order = ["label", "dim", "ring", "node"]
    rows = nodes.select("label", "dim", "ring", "node", "point", "n").repartitionByRange(*order).sortWithinPartitions(*order)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []

        def done() -> pa.RecordBatch:
            names = [f.split()[0] for f in TREE.split(", ")]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            values = (
                chunk[0][0], chunk[0][2], chunk[-1][2], chunk[0][1], b"".join(c[4] for c in chunk),
                np.array([c[3] for c in chunk], "<i8").tobytes(), np.array([c[5] for c in chunk], "<i8").tobytes(),
            )
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for part in parts:
            for row in zip(*[part.column(i).to_pylist() for i in range(6)], strict=True):
                if chunk and (len(chunk) == CHUNK or chunk[0][:2] != row[:2]):
                    yield done()
                    chunk = []
                chunk.append(row)
        if chunk:
            yield done()

    return rows.mapInArrow(run, TREE)


def _links(trees: DataFrame, threshold: float) -> DataFrame:
    """(node, n, root) of each pair of chunks: links of a node, and a node that it is tied to."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    a = trees.select("label", "dim", *[F.col(c).alias(f"a_{c}") for c in ("chunk", "low", "high", "points", "nodes", "counts")])
    b = trees.select("label", "dim", *[F.col(c).alias(f"b_{c}") for c in ("chunk", "low", "high", "points", "nodes", "counts")])
    narrow = ["label", "dim"]
    pairs = a.select(*narrow, "a_chunk", "a_low", "a_high").join(b.select(*narrow, "b_chunk", "b_low", "b_high"), narrow)
    pairs = pairs.where(
        f"a_chunk <= b_chunk and a_low <= b_high + {reach} and b_low <= a_high + {reach}"
    ).select("a_chunk", "b_chunk")
    pairs = (
        pairs.join(a.drop("label", "a_low", "a_high"), "a_chunk")
        .join(b.select("b_chunk", "b_points", "b_nodes", "b_counts"), "b_chunk")
        .select("a_chunk", "b_chunk", "dim", "a_points", "a_nodes", "a_counts", "b_points", "b_nodes", "b_counts")
        .repartition(F.col("a_chunk"), F.col("b_chunk"))
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                ca, cb, dim, pa_, na, ma, pb, nb, mb = (part.column(c)[i].as_py() for c in range(9))
                left = Tree(np.frombuffer(pa_, "<f8").reshape(-1, dim))
                right = left if ca == cb else Tree(np.frombuffer(pb, "<f8").reshape(-1, dim))
                na, nb, ma, mb = (np.frombuffer(x, "<i8") for x in (na, nb, ma, mb))
                links: dict[int, int] = {}
                forest = Forest()
                sides = [(na, np.zeros(len(na), np.int64)), (nb, np.zeros(len(nb), np.int64))]
                for x, y in dual_traversal(left, right, threshold):
                    if ca == cb:
                        x, y = x[x != y], y[x != y]
                    np.add.at(sides[0][1], x, mb[y])
                    if ca != cb:
                        np.add.at(sides[1][1], y, ma[x])
                    for p, q in zip(na[x].tolist(), nb[y].tolist(), strict=True):
                        forest.union(p, q)
                for names, counts in sides:
                    links |= dict(zip(names[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True))
                yield pa.record_batch(
                    [pa.array(list(links), pa.int64()), pa.array(list(links.values()), pa.int64()),
                     pa.array([forest.find(x) for x in links], pa.int64())],
                    names=["node", "n", "root"],
                )

    return pairs.mapInArrow(run, "node long, n long, root long")


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    rows = stored(_points(vectors, id_col, vector_col, label_col), "points")
    nodes = stored(
        rows.where("point is not null and label is not null").groupBy("label", "point").agg(
            F.first("dim").alias("dim"), F.first("ring").alias("ring"), F.count("*").alias("n"),
            F.min("vec_id").alias("least_id"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    trees = stored(_trees(nodes).withColumn("chunk", F.monotonically_increasing_id()), "trees")
    found = stored(_links(trees, threshold), "vector-links")
    links = found.groupBy("node").agg(F.sum("n").alias("others"))
    edges = found.where("node <> root").select(F.least("node", "root").alias("low"), F.greatest("node", "root").alias("high"))
    tied = (
        nodes.select("node", "label", "point", "n", "least_id").join(links, "node", "left")
        .join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    least = tied.groupBy("root").agg(F.min("least_id").alias("component_id"))
    tied = tied.join(least, "root").select(
        "label", "point", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "label", "point").join(tied, ["label", "point"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
