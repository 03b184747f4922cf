"""Vectorised word handling on Arrow string columns.

A word is a maximal run of characters other than space and ``\\x09``-``\\x0D``.
All work happens on the UTF-8 bytes of a whole column: word bounds come from one
mask, word hashes from one prefix sum of ``table[byte] * r**position`` modulo
2**64, so there is no Python loop over words.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_STEP = 1 << 16  # words
_BYTE_ROOT = 0x9E3779B97F4A7C15
_WORD_ROOTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTE_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, root: int):
        self.root, self.inverse = np.uint64(root), np.uint64(pow(root, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            up, down = np.full(size, self.root), np.full(size, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_byte_powers = _Powers(_BYTE_ROOT)
_word_powers = tuple(_Powers(r) for r in _WORD_ROOTS)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of the rows in them; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    data: np.ndarray  # bytes
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each row's first word; one more entry than rows

    def __len__(self) -> int:
        return len(self.start)

    @property
    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        out = np.empty(len(self.start), np.uint64)
        for lo in range(0, len(out), _STEP):  # a stretch at a time: eight bytes a byte of text are needed several times over
            start, end = self.start[lo : lo + _STEP], self.end[lo : lo + _STEP]
            base = start[0]
            part = _BYTE_TABLE[self.data[base : end[-1]]]
            up, down = _byte_powers.get(len(part) + 1)
            part *= up[: len(part)]
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=prefix[1:])
            out[lo : lo + _STEP] = mix64((prefix[end - base] - prefix[start - base]) * down[start - base])
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True  # a new row starts a new word
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(opens)
    return Words(data, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def window_hashes(word_hashes: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words, by the index of its first word."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _word_powers[family].get(len(word_hashes) + 1)
    prefix = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * up[: len(word_hashes)], out=prefix[1:])
    return mix64((prefix[width:] - prefix[:-width]) * down[:n])


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of words at which a window of ``width`` words lies within one row."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return before + np.arange(total)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences, one plane per byte, so that the high, mostly zero planes compress."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def members(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted pool."""
    if not len(pool):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(pool, values)
    at[at == len(pool)] = 0
    return pool[at] == values
