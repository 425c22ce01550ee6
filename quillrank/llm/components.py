"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.session import stored

ROUNDS = 60


class Forest:
    """Union-find over the nodes that one task sees; the smaller root wins."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = min(a, b), max(a, b)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True

    def stars(self) -> pa.RecordBatch:
        """Each node that is not a root, with its root."""
        pairs = [(self.find(x), x) for x in self.parent]
        pairs = [(r, x) for r, x in pairs if r != x]
        return pa.record_batch(
            [pa.array([r for r, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())],
            names=["low", "high"],
        )


def _shrink(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars, a bounded number of links at a time."""
    forest = Forest()
    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        if len(forest.parent) > 1_000_000:
            yield forest.stars()
            forest = Forest()
    yield forest.stars()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (low, high); root is the component's smallest node.

    Alternating stars: every node is tied to the smallest node that it or its neighbours know,
    first from below, then from above, until nothing changes. Rows are aggregated by node
    before they are shuffled, so a hub with very many neighbours costs one row per task. Each
    round is written to the shared folder, so a lost executor does not repeat the earlier ones.
    """
    edges = stored(links.select("low", "high").mapInArrow(_shrink, "low long, high long"), "links")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # Large star: the larger neighbours of a node go to the smallest of its neighbourhood.
        least = both.groupBy(F.col("low").alias("node")).agg(F.min("high").alias("near"))
        least = least.select("node", F.least("node", "near").alias("least"))
        large = (
            edges.join(least, F.col("low") == F.col("node"))
            .select(F.col("least").alias("low"), "high").where("low < high")
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        below = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        small = (
            large.join(below, F.col("high") == F.col("node"))
            .select(F.explode(F.array("low", "high")).alias("high"), F.col("least").alias("low"))
            .where("low < high").select("low", "high").distinct()
        )
        after = stored(small, "links")
        # Done when every node has one link and no root is tied to another root.
        highs = after.select(F.col("high").alias("tied"))
        state = after.agg(F.count("*").alias("n"), F.count_distinct("high").alias("nodes")).first()
        chained = not after.join(highs, F.col("low") == F.col("tied"), "left_semi").isEmpty()
        edges = after
        if state.n == state.nodes and not chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
