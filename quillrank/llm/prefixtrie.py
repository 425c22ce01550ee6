"""Conversation prefix trie (operator 11): van Emde Boas recursion over sequences of turns.

A node is a distinct prefix of the conversations' turns, and its name a 128-bit hash. A trie of
height 2^j is cut at half its height: the prefixes that reach the cut are named, from the name of
the trie's root and the name of the block of turns above the cut, and become the roots of the
lower forest; above the cut stays the upper trie. Both halves are cut again, and all tries of one
height are cut in one job, so a table with conversations of up to n turns takes log2(n) jobs to
name blocks (pairs of blocks of half the length), and as many to name prefixes. Totals go back up
the same way: once tries of half the height have their totals, each lower root's total is grafted
onto its ancestors in the upper trie.

At scale: rows are keyed by (conversation, place) throughout, so neither a conversation with very
many turns nor a first turn that most conversations share meets in one task. Places come from a
range sort that may cut a conversation anywhere, and offsets by piece. Counts, totals and smallest
members are aggregated in each task before they are shuffled. Members that end at a node are
sorted by ranges, joined to texts range by range, and only these texts are hashed in order.

Turns of one conversation with equal turn numbers are ordered by the hash of role and text; repeated rows
are turns of their own. Null roles and texts are empty. Rows without conv_id belong to no
conversation and are left out. Other columns are not looked at. An empty table gives no rows,
not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank import scale
from quillrank.session import stored

LEAD, GROUP = 6, 100
ROOT = "unhex('" + "00" * 16 + "')"


def digest(*parts: Column) -> Column:
    """The first 128 bits of SHA-256."""
    whole = F.concat(*(p.cast("binary") for p in parts))
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, piece, place, name, chars) with places from 0 within a piece, and (conv, piece, before, n):
    the pieces into which the sort has cut conversations, with the number of turns before each."""
    ordered = (
        turns.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange("conv", F.col("turn").asc_nulls_first(), "name", "row")
        .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "name", "row")
    )
    ordered = stored(
        ordered.select("conv", "name", "chars", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at")),
        "trie-turns",
    )
    pieces = ordered.groupBy("conv", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A conversation has as many rows here as the sort has ranges, at most.
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-pieces")
    return ordered, pieces


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(conv, i, name, chars), the rebuilt turns from 0, and (conv, len), every conversation.

    Conversation c begins with the first h turns of conversation c - c % 100 in place of its own
    first h, where h is crc32 of its decimal number, modulo 6.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        digest(F.octet_length(who).cast("string"), F.lit(":"), who, said).alias("name"),
        F.length(said).cast("long").alias("chars"),
    )
    ordered, pieces = placed(turns)
    sizes = pieces.groupBy("conv").agg(F.sum("n").alias("n")).select(
        "conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % LEAD).alias("h"),
        (F.col("conv") - F.col("conv") % GROUP).alias("base"),
    )
    sizes = stored(sizes, "trie-sizes")
    heads = sizes.select(F.col("conv").alias("base"), F.col("n").alias("given"))
    lead = F.least("h", F.coalesce("given", F.lit(0)))
    sizes = stored(sizes.join(heads, "base", "left").select("conv", "n", "h", "base", lead.alias("lead")), "trie-leads")

    shifts = pieces.join(sizes.select("conv", "h", "lead"), "conv").select("conv", "piece", "first", "before", "h", "lead")
    own = ordered.join(shifts, ["conv", "piece"]).withColumn("own", F.col("before") + F.col("at") - F.col("first"))
    after = own.where("own >= h").select("conv", (F.col("own") - F.col("h") + F.col("lead")).alias("i"), "name", "chars")
    # At most 5 turns of each base go to at most 100 conversations.
    first = own.where((F.col("own") < LEAD - 1) & (F.col("conv") % GROUP == 0))
    first = first.select(F.col("conv").alias("base"), F.col("own").alias("i"), "name", "chars")
    given = first.join(sizes.select("conv", "base", "lead"), "base").where("i < lead").select("conv", "i", "name", "chars")
    lengths = sizes.select("conv", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return stored(after.unionByName(given), "trie-rebuilt"), stored(lengths, "trie-lengths")


def prefixes(turns: DataFrame, lengths: DataFrame, height: int) -> DataFrame:
    """(conv, depth, name, chars): the name of every prefix of every conversation, the root at depth 0.

    `height` is j where no conversation has 2^j turns. chars is the length of the prefix's last text.
    """
    blocks = [turns]
    for j in range(1, height):
        halves = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("i") % 2 == 1, F.struct("name", "chars"))).alias("right"),
        )
        whole = halves.where("left IS NOT NULL AND right IS NOT NULL")
        blocks.append(stored(
            whole.select("conv", "i", digest(F.col("left"), F.col("right.name")).alias("name"), F.col("right.chars").alias("chars")),
            f"trie-blocks-{j}",
        ))
    names = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.expr(ROOT).alias("name"), F.lit(0).cast("long").alias("chars"))
    for j in range(height, 0, -1):
        # Every trie of height 2^j, by its root, is cut at half its height.
        half = 1 << (j - 1)
        tops = names.select("conv", F.col("depth").alias("top"), F.col("name").alias("root"))
        upper = blocks[j - 1].where(F.col("i") % 2 == 0).select(
            "conv", (F.col("i") * half).alias("top"), F.col("name").alias("block"), "chars"
        )
        cut = tops.join(upper, ["conv", "top"]).select(
            "conv", (F.col("top") + half).alias("depth"), digest(F.col("root"), F.col("block")).alias("name"), "chars"
        )
        names = names.unionByName(stored(cut, f"trie-cut-{j}"))
    return names


def grafted(nodes: DataFrame, names: DataFrame, height: int) -> DataFrame:
    """nodes (name, conv, depth, n_leaves, saved_tokens with their own values) with totals over their subtrees."""
    rest = [c for c in nodes.columns if c not in ("n_leaves", "saved_tokens")]
    paths = names.select("conv", "depth", F.col("name").alias("above"))
    for j in range(1, height + 1):
        half = 1 << (j - 1)
        # Roots of the lower forests, and their ancestors in the upper trie: unique by (conv, depth).
        roots = nodes.where(F.pmod("depth", F.lit(2 * half)) == half).select(
            "conv", F.explode(F.sequence(F.col("depth") - half, F.col("depth") - 1)).alias("depth"), "n_leaves", "saved_tokens"
        )
        gained = roots.join(paths, ["conv", "depth"]).groupBy(F.col("above").alias("name")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
        )
        nodes = stored(
            nodes.join(gained, "name", "left").select(
                *rest,
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
            ),
            f"trie-totals-{j}",
        )
    return nodes


def _join_ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, conv) in order to (name, first, ids): runs of equal names with their ids as text."""
    for part in parts:
        if not part.num_rows:
            continue
        names, convs = part.column(0).to_pylist(), part.column(1).to_numpy()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield pa.record_batch(
            [pa.array([names[a] for a, _ in spans], pa.binary()), pa.array([int(convs[a]) for a, _ in spans], pa.int64()),
             pa.array([",".join(map(str, convs[a:b].tolist())) for a, b in spans], pa.string())],
            names=["name", "first", "ids"],
        )


def _hash_ids(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, first, ids) in order to (name, ends_sha256); a name may go on in the next batch."""
    name, state = None, None
    for part in parts:
        done = []
        for own, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
            if own == name:
                state.update(b"," + ids.encode())
                continue
            if name is not None:
                done.append((name, state.hexdigest()))
            name, state = own, hashlib.sha256(ids.encode())
        if done:
            yield _hashed(done)
    if name is not None:
        yield _hashed([(name, state.hexdigest())])


def _hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    names, hashes = zip(*done, strict=True)
    return pa.record_batch([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], names=["name", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) from (name, conv): SHA-256 of the ascending decimal ids of each name, comma-joined."""
    runs = stored(
        members.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
        .mapInArrow(_join_ids, "name binary, first long, ids string"),
        "trie-ends",
    )
    return runs.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hash_ids, "name binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(conversations, conv_id, turn, role, text)
    most = lengths.agg(F.max("len").alias("len"), F.min("conv").alias("conv")).first()
    height = int(most.len or 0).bit_length()
    names = stored(prefixes(turns, lengths, height), "trie-names")
    nodes = names.groupBy("name").agg(
        F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.count("*").alias("n_convs")
    )
    # The parent is the prefix one turn shorter of the node's smallest member.
    above = names.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = stored(nodes.join(above, ["conv", "depth"], "left"), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "name", "left").select(
        "name", "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = grafted(stored(own, "trie-own"), names, height)
    # The root's children, which may be very many, need no join to know its smallest member.
    parents = nodes.where("depth > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    ended = ends(names.join(lengths.withColumnRenamed("len", "depth"), ["conv", "depth"]))
    parent = F.when(F.col("depth") == 1, F.lit(most.conv).cast("long")).when(F.col("depth") > 1, F.col("parent_conv"))
    linked = totals.withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))
    return linked.join(parents, "parent", "left").join(ended, "name", "left").select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
