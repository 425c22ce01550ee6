"""Packing (operator 7): power-of-two decomposition.

Each document becomes token ids and one end id. Its length is split into binary-length pieces:
as many pieces of the largest length as fit, then one piece for each set bit of the rest. Every
piece is a sequence of its own, so no sequence crosses documents and none needs padding.
Pieces of equal length form a bucket, from which a trainer draws its batches.

No rows are shuffled: the work is one pass over the texts, whatever the sizes of sources or
groups of copies. Repeated rows are packed once each. Null and empty texts give the end id
alone; a null doc_id stays null. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm import batches

MAX_LENGTH = 2048
END_ID = 1
# How the byte-level vocabulary cuts a text before pairs are merged (fixed value of the vocabulary).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """Encoder of one text to ids. The ranks are those of byte_bpe_50k.json, so are the ids."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def piece_lengths(n: int, longest: int) -> list[int]:
    """Pieces of a document of n tokens, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(
    docs: DataFrame,
    *,
    vocabulary: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, bucket (the sequence's length).

    `max_length` is a power of two. `sequence_id` numbers the pieces by task, without gaps in a
    task; a task that runs again on the same rows gives the same numbers.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    path = vocabulary or default_vocabulary()

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for part in batches.slices(parts, 1):
            ids, starts, lengths, cut, totals = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tokens = np.append(code.encode_to_numpy(text or "", disallowed_special=()), end_id).astype("<u4")
                start = 0
                for length in piece_lengths(len(tokens), max_length):
                    ids.append(doc_id)
                    starts.append(start)
                    lengths.append(length)
                    cut.append(tokens[start : start + length].tobytes())
                    totals.append(len(tokens))
                    start += length
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(cut, pa.binary()), pa.array(totals, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, SCHEMA).select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.col("length").alias("bucket"),
    )


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces in one folder per bucket, so that a batch reads sequences of one length."""
    pieces.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
