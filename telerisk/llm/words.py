"""Words, n-grams and hashes of Arrow text columns, computed over whole buffers with NumPy.

A batch is cut into blocks of rows of about ``BLOCK`` bytes, so working memory follows the block and
not the batch; a row longer than that is a block of its own.  Nulls count as empty texts.  Words are
runs of bytes other than 0x20 and 0x09-0x0D and never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: ASCII characters other than letters and digits
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Roller:
    """Hashes of any byte span of a buffer from prefix sums: one multiplication per span."""

    def __init__(self, seed: int):
        state = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.table = state[:256]
        self.base = int(state[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n + 1:
            size = max(n + 1, BLOCK + 1)
            self._up, self._down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
                                    for b in (self.base, self.inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self._up[:len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (sums[end] - sums[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


WORDS = Roller(1)


class Block:
    """Rows ``lo`` up to ``hi`` of a batch: their bytes and row offsets."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.rows = hi - lo

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each word."""
        solid = ~SPACE[self.data]
        n = len(solid)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return starts, ends, self.row_of(starts)

    def cores(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the words without punctuation around them; words of nothing else stay as they are."""
        bare = ~PUNCTUATION[self.data]
        solid = np.flatnonzero(bare)
        if not len(solid) or not len(starts):
            return starts, ends
        before = np.zeros(len(bare) + 1, np.int64)  # counted once, so that no word is looked up by bisection
        np.cumsum(bare, out=before[1:])
        left, right = before[starts], before[ends] - 1
        bare = left <= right
        return (np.where(bare, solid[np.minimum(left, len(solid) - 1)], starts),
                np.where(bare, solid[np.maximum(right, 0)] + 1, ends))

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Count of set flags (one per byte) in each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[Block]:
    data, offsets = column_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def grams(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n values inside a row, and the index where it starts."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[k:len(values) - n + 1 + k])
    at = np.flatnonzero(rows[:len(out)] == rows[n - 1:])
    return out[at], at


def segments(rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of the entries of each row, for entries sorted by row."""
    first = np.searchsorted(rows, np.arange(count + 1))
    return first[:-1], np.diff(first)


def sum_by_row(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=count)
