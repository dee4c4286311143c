"""Small helpers for Arrow string columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column end to end, and the n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def windows(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about `most` bytes together (one row at least), so that numpy work stays small."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end
