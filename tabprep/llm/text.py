"""Helpers the text operators share: ASCII case folding and text batches as byte arrays."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that vectorised code works on at a time; longer single texts form a block of their own.
BLOCK_BYTES = 1 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def packed(columns: list[str], alias: str = "row") -> Column:
    """The given columns as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias(alias)


def byte_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string or binary column in blocks of about ``limit`` bytes; null is empty.

    Text ``i`` of a block is ``bytes[offsets[i]:offsets[i + 1]]``. The arrays view Arrow's buffers.
    """
    if pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, b"")
    else:
        column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        low, high = int(offsets[first]), int(offsets[end])
        yield first, end, data[low:high], offsets[first : end + 1] - low
        first = end


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]
