"""Vectorised scanning of Arrow text columns: words, lines and their hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D, which for UTF-8 is the same as the
code-point pattern ``[^\\x20\\x09-\\x0D]+``.  All hashes are 64-bit and identical on every executor.

Strings are hashed eight bytes at a time through a mixing function, long ones by XXH3: polynomials modulo
2**64 collide for Thue-Morse strings, whatever their base. They only roll over a few hashes of words, or over windows
that are compared byte by byte afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: About this many bytes are scanned at a time; a longer document is scanned alone.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
CHECK_BASE = 0x165667B19E3779F9


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(base, size)[:n]


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[starts:ends] by prefix sums of value * base**i, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, max(1, len(values)))[: len(values)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * powers(inverse, len(values) + 1)[starts]


#: Strings of more bytes than this are hashed one by one.
LONG = 64
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def string_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of the byte strings data[starts:ends]; those of two seeds are independent."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(BYTE_BASE) + np.uint64((seed + 1) * CHECK_BASE % (1 << 64)))
    h = mix((h ^ (eight[starts] & _BELOW[np.minimum(size, 8)])) * np.uint64(WORD_BASE))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(more):
        h[more] = mix((h[more] ^ (eight[starts[more] + done] & _BELOW[np.minimum(size[more] - done, 8)])) * np.uint64(WORD_BASE))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]], seed)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts:ends], runs of 64-bit numbers of any length."""
    whole = memoryview(np.ascontiguousarray(values).view(np.uint8))
    return np.array([xxhash.xxh3_64_intdigest(whole[8 * i : 8 * j]) for i, j in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)


def texts(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The column as one array of large_string; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_string array."""
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of about ``limit`` bytes each."""
    if not len(array):
        return
    offsets, data = buffers(array)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


class Words:
    """Words of a chunk: start and end bytes, the row each belongs to, and bounds of each row's words."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        inside = ~_SPACE[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        before = np.empty(len(data), dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before &= ~first[:-1]
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after &= ~first[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, data: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
        return string_hashes(_LOWER[data] if lower else data, self.start, self.end, seed)


def windows(words: Words, hashes: np.ndarray, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``size`` words inside one row: a polynomial of their hashes, for a few words."""
    room = words.bounds[1:][words.row] - np.arange(len(words.row)) if len(words.row) else np.zeros(0, np.int64)
    at = np.flatnonzero(room >= size)
    return at, mix(polynomial(hashes, at, at + size, base))
