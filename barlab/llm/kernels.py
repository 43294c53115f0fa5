"""Numpy kernels over Arrow string buffers.

A column of texts arrives in a task as one run of UTF-8 bytes and row offsets.
These kernels find and hash words over the whole run at once, so a task makes
no Python string for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that the kernels take at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Letters that are hashed at once, and the powers that are held for a range's low places.
HASH_LETTERS, _LOW_BITS = 1 << 18, 12

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix(np.arange(1, 1 + (1 << 16), dtype=np.uint64))


def powers(n: int, step: int = 1) -> np.ndarray:
    """The first n powers of the base, or of its ``step``-th power."""
    out = np.full(max(n, 1), pow(_BASE, step, 1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of a single row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ..., start+length-1 of each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


@dataclass
class Words:
    """Words of some rows: byte ranges, the row of each, and words per row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word."""
        return np.cumsum(self.counts) - self.counts

    def hashes(self) -> np.ndarray:
        """64-bit fingerprints of the words' bytes."""
        return hash_ranges(self.data, self.starts, self.ends)


def hash_ranges(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = HASH_LETTERS) -> np.ndarray:
    """Fingerprints of ranges of small integers: a polynomial over random values, then mixed. Letters are taken ``most`` at a time."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(lengths > 0)
    first, size = starts[some], lengths[some]
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    longest = int(size.max(initial=0))
    low = powers(min(longest, 1 << _LOW_BITS))
    high = powers((longest >> _LOW_BITS) + 1, step=1 << _LOW_BITS) if longest > 1 << _LOW_BITS else None
    for a in range(0, int(edges[-1]), most):
        b = min(a + most, int(edges[-1]))
        i, j = int(np.searchsorted(edges, a, "right")) - 1, int(np.searchsorted(edges, b, "left"))
        head, tail = np.maximum(edges[i:j], a), np.minimum(edges[i + 1 : j + 1], b)
        skipped = head - edges[i:j]
        place = ranges(skipped, tail - head)
        power = low[place] if high is None else low[place & ((1 << _LOW_BITS) - 1)] * high[place >> _LOW_BITS]
        out[some[i:j]] += np.add.reduceat(_SYMBOL[symbols[ranges(first[i:j] + skipped, tail - head)]] * power, head - a)
    return mix(out + lengths.astype(np.uint64))


class Seen:
    """Fingerprint -> number, by open addressing in a table of fixed size."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        todo, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(todo):
            value = self.value[slot]
            hit = (value >= 0) & (self.keys[slot] == hashes[todo])
            out[todo[hit]] = value[hit]
            on = (value >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number new, distinct fingerprints from ``count`` on."""
        todo, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(todo):
            free = np.flatnonzero(self.value[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.value[slot[put]], self.keys[slot[put]] = self.count + todo[put], hashes[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.count += len(hashes)


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are a space or 09-0D."""
    return _SPACE[data]


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Runs of bytes outside space and 09-0D, never across rows; A-Z lower-cased if asked."""
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(n, np.int64))
    data = _LOWER[data] if lower else data
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, starts, ends, rows, np.bincount(rows, minlength=n).astype(np.int64))


def word_slices(column: pa.Array, lower: bool = True, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for slices of a column; rows of the words count from the first row."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, most):
        own = offsets[a : b + 1]
        yield a, b, find_words(data[own[0] : own[-1]], own - own[0], lower)
