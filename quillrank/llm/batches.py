"""Small helpers for functions that see Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Rows with long texts are taken in slices of about this many bytes, whatever a batch holds.
SLICE_BYTES = 4 << 20

# Upper case to lower case for A-Z; everything outside letters and digits of ASCII to a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def slices(
    batches: Iterator[pa.RecordBatch], text: int | str = 0, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column `text` has about `size` bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, size * batch.num_rows // max(1, batch.column(text).nbytes))
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, each)
            lengths = pc.binary_length(part.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
            rows = max(1, int((lengths.cumsum() <= 2 * size).sum()))
            yield part.slice(0, rows)
            start += min(rows, part.num_rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def space_words(text: bytes) -> list[bytes]:
    """Words between space and the controls 9 to 13, with A-Z in lower case."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters outside ASCII, with A-Z in lower case."""
    return text.translate(WORD_TABLE).split()
