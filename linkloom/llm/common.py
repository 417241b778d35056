"""Small helpers shared by the text operators: raw UTF-8 access to Arrow batches and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The words of every contract: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, summed in one pass over that column alone."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column))).alias("b")).first()["b"] or 0)


def parts_for(n_bytes: int, part_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / part_bytes))


def give_back() -> None:
    """Gives freed memory back to the system, where the C library can: a worker lives on beside others, and the next task may need none of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and its len + 1 offsets, without copying the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the row that holds it; words end at rows' ends."""
    solid = ~_IS_SPACE[raw]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(raw)]
    before[cut] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two multiply and shift rounds."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from its bytes, eight at a time, and its length."""
    length = ends - starts
    out = mix64(length.astype(np.uint64) * _MULT + np.uint64(1))
    if not len(starts):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    left, at, who = length.copy(), starts.copy(), None
    while True:
        n = np.minimum(left, 8)
        block = np.ascontiguousarray(lanes[at]).view(np.uint64).ravel()
        mask = np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (n.astype(np.uint64) * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        value = block & mask
        if who is None:
            out = mix64(out * _MULT ^ value)
            who = np.flatnonzero(left > 8)
        else:
            out[who] = mix64(out[who] * _MULT ^ value)
            who = who[left > 8]
        keep = left > 8
        left, at = left[keep] - 8, at[keep] + 8
        if not len(who):
            return out
