"""Columns of a batch inside a task: strings as bytes with offsets, and batches cut into parts of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, so that a task's memory does not grow with a batch's.
PART = 1 << 20


def pieces(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of the strings, from 0, and their bytes; a null is empty."""
    text = pc.fill_null(text.cast(pa.string()), "")
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
    if ends[0] == ends[-1]:
        return ends - ends[0], np.zeros(0, np.uint8)
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def starts_of_characters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 begin a character."""
    return (data & 0xC0) != 0x80


def summed(counted: np.ndarray) -> np.ndarray:
    """Running sums, with the 0 before the first."""
    return np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for null."""
    return pc.fill_null(column.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)


def parts(batch: pa.RecordBatch, column: str, most: int = PART):
    """The batch in slices whose lists of rows with a text hold about so many bytes each; a longer row stands alone."""
    lists = batch.column(column)
    offsets, _ = pieces(lists.flatten().field("text"))
    at = summed(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    size, row = offsets[at], 0
    while row < batch.num_rows:
        after = max(row + 1, int(np.searchsorted(size, size[row] + most, "right")) - 1)
        yield batch.slice(row, after - row)
        row = after
