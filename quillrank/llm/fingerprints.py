"""Document fingerprints (operator 2): I-Match with randomised lexicons, in built-in functions only.

Terms are words in lower case, known by a 64-bit hash. The lexicon is a band of inverse document
frequency: a term counts when the share of documents that hold a term of its bucket lies between
LOW and HIGH. Shares are counted over all documents, by bucket (2**BUCKET_BITS of them), so the
counts have a fixed size and the lexicon is a bitmap of 32 kB, whatever the vocabulary.

A fingerprint hashes the sorted distinct lexicon terms of a text, once in full and once for
each of several random parts of the lexicon: CHAINS nested series, each part holding half of
the one before. Small parts survive edits that large ones don't, so the share of equal hashes
falls smoothly with the share of changed terms. A text without lexicon terms uses all its
terms, one without any term its characters; equal texts always have equal fingerprints.

The next document is the one of the next larger doc_id (after the largest: the smallest), rows
of one doc_id in order of a text hash. Rows are dealt to blocks by ranges of doc_id with about
equal counts, so a hot source or many equal texts weigh no more than other rows; a block hands
its first row to the block before it. Texts are shuffled once. A null text is empty; a null
doc_id comes first. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 18
LOW, HIGH = 0.002, 0.25
CHAINS, HALVINGS = 4, 10
BLOCK_ROWS = 1024
MAX_BLOCKS = 1 << 15


def _longs(values: list[int]) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def terms(text: Column) -> Column:
    """Distinct hashes of the words of a text."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Bitmap of the buckets in the band, 64 to a number. At most 2**BUCKET_BITS / 64 numbers reach the driver."""
    n = docs.count()
    held = docs.select(
        F.explode(F.array_distinct(F.transform(terms(F.coalesce(text_col, F.lit(""))), _bucket))).alias("bucket")
    )
    band = held.groupBy("bucket").agg(F.count("*").alias("n")).where((F.col("n") >= low * n) & (F.col("n") <= high * n))
    words = band.groupBy(F.shiftright("bucket", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits")
    )
    bitmap = [0] * (1 << (BUCKET_BITS - 6))
    for row in words.collect():
        bitmap[row["at"]] = row["bits"]
    return bitmap


def parts(found: Column, bitmap: list[int], text: Column) -> Column:
    """Hashes of a text's lexicon terms: all, then those of each part of the lexicon (null: none)."""
    in_band = F.array_sort(
        F.filter(
            found,
            lambda t: F.getbit(
                F.element_at(_longs(bitmap), (F.shiftright(_bucket(t), 6) + 1).cast("int")),
                _bucket(t).bitwiseAND(F.lit(63)).cast("int"),
            ) == 1,
        )
    )
    masks = [((1 << level) - 1) << (BUCKET_BITS + chain * HALVINGS) for chain in range(CHAINS) for level in range(1, HALVINGS + 1)]

    def of(used: Column) -> Column:
        whole = F.array(F.when(F.size(used) > 0, F.xxhash64(used)).otherwise(F.xxhash64(text)))
        some = F.transform(
            _longs(masks),
            lambda m: F.transform(
                F.array(F.filter(used, lambda t: t.bitwiseAND(m) == 0)), lambda s: F.when(F.size(s) > 0, F.xxhash64(s, m))
            )[0],
        )
        return F.concat(whole, some)

    chosen = F.transform(F.array(in_band), lambda b: F.when(F.size(b) > 0, b).otherwise(F.array_sort(found)))
    return F.transform(chosen, of)[0]


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes by those that either text has."""
    both = F.zip_with(a, b, lambda x, y: F.when(x == y, 2).when(x.isNotNull() | y.isNotNull(), 1).otherwise(0))
    hits = F.size(F.filter(both, lambda v: v == 2))
    return hits.cast("double") / F.size(F.filter(both, lambda v: v > 0))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "-", "-")


def _blocks(docs: DataFrame, id_col: str) -> list[int]:
    """Bounds of doc_id between blocks."""
    n = docs.count()
    blocks = min(MAX_BLOCKS, n // BLOCK_ROWS)
    if blocks < 2:
        return []
    shares = [i / blocks for i in range(1, blocks)]
    return sorted(set(docs.agg(F.percentile_approx(F.col(id_col), shares, max(10_000, 10 * blocks)).alias("b")).first().b or []))


def _block_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at most doc_id, by halving."""
    if not bounds:
        return F.lit(0).cast("long")
    edges, size = _longs(bounds), len(bounds)
    jumps = [1 << i for i in reversed(range(size.bit_length()))]

    def jump(at: Column, step: Column) -> Column:
        further = (at + step <= size) & (F.get(edges, (at + step - 1).cast("int")) <= doc_id)
        return F.when(F.coalesce(further, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(_longs(jumps), F.lit(0).cast("long"), jump)


def with_next(docs: DataFrame, carried: list[str], id_col: str = "doc_id") -> DataFrame:
    """`docs` (with text_hash) and next, a struct of the columns `carried` of the next document."""
    bounds = _blocks(docs, id_col)
    own = F.struct(*carried)
    order = Window.partitionBy("__block").orderBy(F.col(id_col).asc_nulls_first(), "text_hash")
    rows = docs.withColumn("__block", _block_of(F.col(id_col), bounds))
    rows = rows.withColumn("__next", F.lead(own).over(order)).withColumn("__at", F.row_number().over(order))
    # At most MAX_BLOCKS rows, one for each block.
    firsts = rows.where("__at = 1").select(F.col("__block").alias("__number"), own.alias("__first"))
    by_number = Window.orderBy("__number")
    everything = by_number.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    handed = firsts.select("__number", F.coalesce(F.lead("__first").over(by_number), F.first("__first").over(everything)).alias("__first"))
    return (
        rows.join(handed, F.col("__block") == F.col("__number"), "left")
        .withColumn("next", F.coalesce("__next", "__first"))
        .drop("__block", "__number", "__next", "__first", "__at")
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of the characters replaced by as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_chars, hashes of every document, and next (text, hashes)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bitmap = lexicon(docs)
    found = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("terms", terms(F.col("text")))
    found = found.withColumn("hashes", parts(F.col("terms"), bitmap, F.col("text"))).drop("terms")
    return with_next(found, ["text", "hashes"]).withColumn("edited", edited(F.col("text"), F.col("next.text"))).withColumn(
        "edited_hashes", parts(terms(F.col("edited")), bitmap, F.col("edited"))
    )


def compared(found: DataFrame) -> DataFrame:
    """Fingerprints as text, and how like they are to the edited and the next text's."""
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next.hashes")).alias("near_next"),
    )
