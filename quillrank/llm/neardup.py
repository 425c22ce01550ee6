"""MinHash near-dedup (operator 1): an LSH forest over minimum hashes.

Each distinct shingle set gets a signature of minimum hashes. A tree of the forest is the list
of all sets sorted by the signature read from another place on. Sets that share a prefix of
DEPTH hashes in any tree form a region; a pair at the threshold shares no region of any tree
with a probability of about 1e-5.

1. Equal sets are one node from the start, so exact copies cost one row per task.
2. The sets that share a region are sorted in a few of the trees, each with its shingles, and
   every set is compared with its neighbours of longest common prefix. Ranges of the sort
   order are cut anywhere, so a group of near copies of any size is spread over tasks. The
   depth adapts: a neighbour counts at whatever prefix it shares, so dense regions are compared
   at deep prefixes, sparse ones at shallow ones.
3. Verified links give components. A region whose sets are all in one component is done: no
   link could change the result. In the regions that are left, every set outside the region's
   largest component is compared with all sets of the other components, in blocks of bounded
   size. No pairs are written: a task emits only the links that it has verified.

Links are confirmed on the full sets. The result is the exact set of components but for the
chance above. Texts without words, or null, have an empty set and are linked with nothing.
Repeated rows and repeated doc_ids are rows like others; a null doc_id never is a component's
id unless no other is there. An empty table gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm import batches
from quillrank.llm.components import Forest, components
from quillrank.llm.shingles import WordHashes, common, min_hashes, shingle_set
from quillrank.session import stored

TREES = 16
DEPTH = 3
SIGNATURE = TREES * DEPTH
SORTED_TREES = 3  # orders in which neighbours are compared before the regions are looked at
NEIGHBOURS = 3
BLOCK = 256  # sets of a region that are compared together
SLACK = 0.3  # signatures may agree by this much less than the threshold: over four deviations


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have at least `percent` in the hundred of their union in common."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = common(a, b)
    return 100 * both >= percent * (small + large - both)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n, set_key, signature, regions of every document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in batches.slices(parts, 2):
            n, keys, signs, regions = [], [], [], []
            for text in batches.byte_texts(part.column(2)):
                found = shingle_set(memo.of(batches.space_words(text)), k)
                n.append(len(found))
                if not len(found):
                    keys.append(None), signs.append(None), regions.append([])
                    continue
                sign = min_hashes(found, SIGNATURE)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signs.append(sign.astype(">u4").tobytes())
                cut = sign.astype(np.uint64).reshape(TREES, DEPTH)
                odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
                mixed = ((cut * odd).sum(axis=1, dtype=np.uint64) << np.uint64(4)) | np.arange(TREES, dtype=np.uint64)
                regions.append(mixed.astype(np.int64))
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signs, pa.binary()), pa.array(regions, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "set_key", "signature", "regions"],
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    return rows.mapInArrow(
        run, "doc_id long, text_hash long, n long, set_key binary, signature binary, regions array<long>"
    )


def _set_table(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """node, signature, shingles (little-endian) of the wanted sets, each read from one document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for part in batches.slices(parts, 2):
            sets = [
                shingle_set(memo.of(batches.space_words(t)), k).tobytes() for t in batches.byte_texts(part.column(2))
            ]
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "signature", "shingles"]
            )

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    one = wanted.select("node", "signature", "source")
    meets = texts.doc_id.eqNullSafe(one.source.doc_id) & (texts.text_hash == one.source.text_hash)
    rows = texts.join(one, meets).select("node", "signature", "text")
    return rows.mapInArrow(run, "node long, signature binary, shingles binary")


def _neighbour_links(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between neighbours of a few sorted orders, as stars of each task."""
    width = 4 * SIGNATURE
    trees = F.explode(F.array(*[F.lit(t * (TREES // SORTED_TREES) * DEPTH * 4) for t in range(SORTED_TREES)]))
    turned = F.concat(
        F.substring("signature", F.col("from") + 1, F.lit(width)), F.substring("signature", F.lit(1), F.col("from"))
    )
    # Ranges are cut by a label's beginning, which keeps the sampled keys small.
    order = ["from", "label", "node"]
    rows = (
        sets.select(trees.alias("from"), "node", "signature", "shingles")
        .select("from", turned.alias("label"), "node", "shingles")
    )
    ranges = ["from", F.substring("label", 1, 12), "node"]
    sort = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)
    least = (percent / 100 - SLACK) * SIGNATURE

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, last = Forest(), []
        for part in batches.slices(parts, 3):
            columns = [part.column(i).to_pylist() for i in range(4)]
            for tree, label, node, shingles in zip(*columns, strict=True):
                sign, found = np.frombuffer(label, ">u4"), np.frombuffer(shingles, "<u8")
                for other_tree, other, other_sign, other_found in reversed(last):
                    if other_tree != tree or forest.find(other) == forest.find(node):
                        continue
                    if (other_sign == sign).sum() >= least and near(found, other_found, percent):
                        forest.union(other, node)
                last = [*last[1 - NEIGHBOURS :], (tree, node, sign, found)]
            if len(forest.parent) > 1_000_000:
                yield forest.stars()
                forest = Forest()
        yield forest.stars()

    return sort.mapInArrow(run, "low long, high long")


def _groups(parts: Iterator[pa.RecordBatch], text: int) -> Iterator[list[tuple]]:
    """Rows of each value of the first column, from batches sorted by it."""
    group: list[tuple] = []
    for part in batches.slices(parts, text):
        for row in zip(*[part.column(i).to_pylist() for i in range(part.num_columns)], strict=True):
            if group and group[0][0] != row[0]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _region_links(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Verified links between sets of one region that are in different components.

    members: (region, node). A region of up to BLOCK sets is one group; of equal groups one is
    kept. A larger one is cut in blocks by node: each set outside its largest component meets
    every block. All groups hold at most about two blocks.
    """
    rooted = members.join(roots, "node", "left").select(
        "region", "node", F.coalesce("root", "node").alias("root")
    )
    open_regions = (
        rooted.groupBy("region").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"))
        .where("a <> b").select("region", "size")
    )
    rooted = rooted.join(open_regions, "region")
    small = (
        rooted.where(F.col("size") <= BLOCK).groupBy("region")
        .agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("sets"))
        .groupBy(F.col("sets")).agg(F.min("region").alias("region"))
        .select(
            F.concat_ws(":", "region").alias("grp"), F.explode("sets").alias("s"), F.lit(True).alias("asks"),
            F.lit(True).alias("told"),
        )
        .select("grp", "s.node", "s.root", "asks", "told")
    )
    large = rooted.where(F.col("size") > BLOCK)
    largest = (
        large.groupBy("region", "root").agg(F.count("*").alias("n"))
        .groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"),
                               F.max("n").alias("most"))
        .select("region", "main", F.ceil(F.col("n") / BLOCK).alias("blocks"),
                F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("ask_blocks"))
    )

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n))

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    placed = large.join(largest, "region")
    asking = placed.where("root <> main").select(
        "region", "node", "root", block("ask_blocks").alias("q"), numbers("blocks").alias("b"), F.lit(True).alias("asks"),
    ).withColumn("told", F.col("b") == F.lit(-1))
    told = placed.select(
        "region", "node", "root", numbers("ask_blocks").alias("q"), block("blocks").alias("b"), F.lit(False).alias("asks"),
    ).withColumn("told", F.lit(True))
    large = asking.unionByName(told).select(
        F.concat_ws(":", "region", "q", "b").alias("grp"), "node", "root", "asks", "told"
    )
    rows = small.unionByName(large).join(sets, "node").select("grp", "node", "root", "asks", "told", "signature", "shingles")
    rows = rows.repartition("grp").sortWithinPartitions("grp")
    least = (percent / 100 - SLACK) * SIGNATURE

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(parts, 6):
            forest = Forest()
            for _, node, root, *_ in group:
                forest.union(root, node)
            told = [g for g in group if g[4]]
            signs = np.stack([np.frombuffer(g[5], ">u4") for g in told]) if told else None
            found: list[tuple[int, int]] = []
            for _, node, _, asks, _, sign, shingles in group:
                if not asks or signs is None:
                    continue
                like = np.flatnonzero((signs == np.frombuffer(sign, ">u4")).sum(axis=1) >= least)
                mine = np.frombuffer(shingles, "<u8")
                for i in like:
                    other = told[i][1]
                    if forest.find(other) != forest.find(node) and near(
                        mine, np.frombuffer(told[i][6], "<u8"), percent
                    ):
                        forest.union(other, node)
                        found.append((min(node, other), max(node, other)))
            yield pa.record_batch(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                names=["low", "high"],
            )

    return rows.mapInArrow(run, "low long, high long")


def _resolved(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, set_key), and sets (set_key, source, component_id, first) with words.

    `source` is the smallest document of a set, `first` the smallest of the whole component.
    """
    rows = stored(signatures(docs, k, id_col, text_col), "signatures")
    # One node per distinct set; the ids are written, so that later steps see the same ones.
    nodes = stored(
        rows.where("n > 0").groupBy("set_key").agg(
            F.first("signature").alias("signature"), F.first("regions").alias("regions"),
            F.min(F.struct("doc_id", "text_hash")).alias("source"), F.min("doc_id").alias("least_id"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "sets",
    )
    places = nodes.select("node", F.explode("regions").alias("region"))
    busy = places.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    members = stored(places.join(busy, "region", "left_semi"), "regions")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    # A row that is repeated with its doc_id may give a set twice, which changes no link.
    sets = stored(_set_table(docs, wanted, k, id_col, text_col), "shingles")
    links = stored(_neighbour_links(sets, percent), "neighbours")
    roots = stored(components(links), "roots")
    more = stored(_region_links(members, sets, roots, percent), "region-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    tied = (
        nodes.select("node", "set_key", "source", "least_id").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = tied.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("source").alias("first"))
    return rows.select("doc_id", "text_hash", "n", "set_key"), tied.join(least, "root").select(
        "set_key", "source", "component_id", "first"
    )


def near_duplicates(
    docs: DataFrame,
    *,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    rows, sets = _resolved(docs, k, percent, id_col, text_col)
    return rows.join(sets.select("set_key", "component_id"), "set_key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )


def representatives(
    docs: DataFrame,
    *,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with one row of each component, that of the smallest doc_id; all rows without words stay."""
    _, sets = _resolved(docs, k, percent, id_col, text_col)
    # A null doc_id may share a key with 0 only where the texts are equal, that is, in one component.
    first = sets.select(
        F.coalesce("first.doc_id", F.lit(0)).cast("long").alias("__id"), F.col("first.text_hash").alias("__hash")
    ).distinct()
    text = F.col(text_col).cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumns(
        {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__hash": F.xxhash64(text)}
    )
    kept = keyed.join(first, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return kept.select(docs.columns).unionByName(docs.where(~worded))
