"""Words and chunks of Arrow text columns as flat numpy arrays.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D.  None of those bytes occurs
inside a multi-byte UTF-8 character, so the byte split is exact.  Columns are worked
through in slices of rows with a bounded number of bytes (a longer row forms a slice).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
INK = np.ones(256, bool)
INK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_M1, _M2, _M3 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 256


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(33))) * _M1
    h = (h ^ (h >> _U(29))) * _M2
    return h ^ (h >> _U(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of some rows: byte ranges [start, stop) of ``buf``; row r has words first[r]:first[r+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        part = data[offsets[0] : offsets[-1]]
        self.buf = np.zeros(len(part) + 8, np.uint8)
        self.buf[: len(part)] = LOWER[part] if lower else part
        self.rows = offsets - offsets[0]
        ink = INK[self.buf[: len(part)]]
        begin, end = ink.copy(), ink.copy()
        begin[1:] &= ~ink[:-1]
        end[:-1] &= ~ink[1:]
        full = self.rows[:-1] < self.rows[1:]
        at, last = self.rows[:-1][full], self.rows[1:][full] - 1
        begin[at], end[last] = ink[at], ink[last]
        self.start, self.stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return hash_ranges(self.buf, self.start, self.stop)


def hash_ranges(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; ``buf`` has 8 bytes to spare at its end."""
    size = stop - start
    h = size.astype(np.uint64) * _M3
    if not len(start):
        return h
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    live, at, left = np.arange(len(start)), start, size
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) + _M3
        more = (left > 8) & (size[live] <= _LONG)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(buf[start[k] : stop[k]], digest_size=8).digest(), "little")
    return h


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of ranges [start, start + size), one range after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[r]:first[r+1]] for every r."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
