"""Text columns of Arrow batches as flat UTF-8 bytes, with hashes of any byte range.

A range hash is a polynomial over 64-bit byte codes modulo 2**64, mixed at the end: equal bytes,
equal hash, wherever they stand. Batches are cut into slices of a few megabytes, so memory does
not grow with the batch (one longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
SLICE = 1 << 20
PART = 1 << 18  # bytes of text that leave a task as one batch


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit name of a pair of 64-bit names."""
    return mix(mix(a + _M3) ^ (b * _M1 + _M2))


CODES = mix((np.arange(1, 257, dtype=np.uint64)) * _M3)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Powers:
    """base**i and base**-i modulo 2**64, grown as longer texts come."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _BACK)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(cls, name, np.multiply.accumulate(out))
        return cls.up, cls.down


def slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; nulls count as empty.

    Offsets have one entry more than rows and start at 0.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, off, data = col.buffers()
    ends = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def parts(batch: pa.RecordBatch, text: str = "__text", size: int = PART) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows without the text, bytes, offsets) of runs of rows of about ``size`` bytes of text, so that what is
    made of a batch need not be held at once."""
    rest = batch.drop_columns([text])
    for first, data, offsets in slices(batch.column(batch.schema.get_field_index(text)), size):
        yield rest.slice(first, len(offsets) - 1), data, offsets


class RangeHash:
    """Hashes of byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        up, self.down = Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(CODES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def fixed(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` bytes, by their start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than space, \\t \\n \\v \\f \\r), and the
    number of words before each row: words of row i are those from counts[i] to counts[i + 1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] |= solid[cuts]
    last[cuts - 1] |= solid[cuts - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lo, hi, np.searchsorted(lo, offsets)


def segment_ids(counts: np.ndarray) -> np.ndarray:
    """Row number of every word."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, and the number before each row. A row of 1 to
    k-1 words has one shorter shingle of all its words."""
    n = np.diff(counts)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    before = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(n)), many)
    at = np.arange(before[-1]) - before[row] + counts[row]
    out = hashes[at] if len(at) else np.zeros(0, np.uint64)
    short = n[row] < k
    end = counts[row + 1] if len(row) else at
    for i in range(1, k):
        inside = at + i < end
        nxt = hashes[np.minimum(at + i, len(hashes) - 1)] if len(at) else out
        out = np.where(inside | ~short, pair(out, nxt), out)
    return out, before
