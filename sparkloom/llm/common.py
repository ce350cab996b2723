"""What the operators of this subpackage share: columns, Arrow text access, slicing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts taken into one vectorised step inside a Python worker, in bytes.
SLICE_BYTES = 6_000_000


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``max_bytes`` (or one row) in each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_lengths(array: pa.Array) -> np.ndarray:
    """UTF-8 lengths of a string or binary array; 0 where null."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    lengths = np.diff(offsets).astype(np.int64)
    if array.null_count:
        lengths[np.asarray(array.is_null())] = 0
    return lengths


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array in one piece, and the len + 1 starts; null is empty."""
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    starts = np.concatenate([[0], np.cumsum(byte_lengths(array))])
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    first = int(np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset]) if len(array) else 0
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[first : first + int(starts[-1])] if data is not None and starts[-1] else np.zeros(0, np.uint8)
    return raw, starts


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` for each start and length."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
