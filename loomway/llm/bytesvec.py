"""Texts of an Arrow batch as one array of bytes: words and rolling hashes without a Python loop over words.

A null text is an empty one throughout: it has no bytes and no words. An empty column gives no slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
RADIX = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX to the powers 0..n and its inverse to the same, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << n.bit_length()
        for i, r in enumerate((RADIX, pow(RADIX, -1, 1 << 64))):
            a = np.full(size + 1, r, U)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def sliced(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, their bytes and the offsets of the rows in them, at most about ``most`` bytes or one row at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


#: A random number for each byte, for hashes that share nothing with the plain ones.
OTHER = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64)


def prefix(data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Sums whose differences, times an inverse power, are hashes of stretches of bytes; table: a number for each byte."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1) if table is None else table[data]) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``, for arrays of both."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none reaches over the start of a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[rows] = True
    edge = np.ones(len(data), bool)
    edge[1:] = ~ink[:-1]
    start = np.flatnonzero(ink & (edge | first[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~ink[1:]
    return start, np.flatnonzero(ink & (after | first[1:])) + 1
