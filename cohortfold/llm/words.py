"""Word tables over Arrow text columns: whole batches at a time, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``. Spans are byte positions into the UTF-8
buffer of the batch, so no Python string is made for a word unless a caller
asks for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEED = 0x5EED
_rng = np.random.default_rng(SEED)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_CODE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the base by position in a word; longer words take a second level.
_POWER_BITS = 12
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << _POWER_BITS) - 1, _BASE)]), dtype=np.uint64)
_SEGMENT_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, in segments of bounded size."""
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + _SEGMENT_BYTES)))
            a, b = int(self.start[lo]), int(self.end[hi - 1])
            at = self.start[lo:hi] - a
            size = np.diff(np.append(at, b - a))
            place = np.arange(b - a) - np.repeat(at, size)
            codes = _BYTE_CODE[self.data[a:b]] * _POWERS[place & ((1 << _POWER_BITS) - 1)]
            if (self.end[lo:hi] - self.start[lo:hi]).max() > 1 << _POWER_BITS:
                codes *= mix((place >> _POWER_BITS).astype(np.uint64)) | np.uint64(1)
            out[lo:hi] = np.add.reduceat(codes, at)
            lo = hi
        return mix(out + (self.end - self.start).astype(np.uint64))

    def of(self, i: int) -> list[bytes]:
        """The words of text i."""
        a, b = self.first[i], self.first[i + 1]
        if a == b:
            return []
        return self.data[self.start[a]:self.end[b - 1]].tobytes().split()

    def joined(self, i: int) -> bytes:
        """The words of text i, joined by one space."""
        return b" ".join(self.of(i))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """``lower`` lower-cases A-Z only."""
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = ~space[inner]
    ends[inner - 1] = ~space[inner - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most_bytes`` of text each (one row at least)."""
    _, offsets = utf8(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def gram_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (texts are not told apart)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + word_hash[k:k + n]
    return mix(out)
