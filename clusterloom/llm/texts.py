"""Text columns as numpy arrays inside Arrow tasks: slices of bounded size, word
spans and 64-bit word hashes.

Everything here is stateless per slice; a slice holds whole documents and about
``limit`` bytes of text (one document at least), so a task's memory follows the
slice and not the Arrow batch. Longer single documents are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1

#: ASCII white space (tab, line feed, vertical tab, form feed, return, space).
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

#: Everything in ASCII but letters, digits and the apostrophe; other bytes belong to words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not (chr(i).isalnum() or chr(i) == "'") for i in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_codes(fold: bool) -> np.ndarray:
    """A fixed 64-bit code per byte; ``fold`` gives A-Z the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        codes = codes.copy()
        codes[65:91] = codes[97:123]
    return codes


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 2000
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of at most ``rows`` consecutive rows with about ``limit`` bytes."""
    data, offsets = as_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(row + rows, n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of every document, and words before each document."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    cut = np.zeros(n + 1, bool)  # a document begins here
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(int(len(data)).bit_length(), 16))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_codes(fold)[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash per span: a polynomial over byte codes, mixed. ``fold``: A-Z count as a-z.

    Equal spans have equal hashes wherever they stand. Works through pieces of
    about ``SLICE_BYTES`` bytes (a longer single word is one piece).
    """
    if len(data) <= 2 * SLICE_BYTES or len(starts) == 0:
        return _hash_spans(data, starts, ends, fold)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        low, high = starts[i], ends[j - 1]
        out.append(_hash_spans(data[low:high], starts[i:j] - low, ends[i:j] - low, fold))
        i = j
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words, and shingles before each document.

    ``before``: words before each document. A document with fewer words has one
    shingle, its whole word sequence; one without words has one shingle too (the
    empty sequence), so that every document has at least one.
    """
    factors = mix(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(before)
    per = np.maximum(counts - size + 1, 1)
    out_before = np.concatenate([[0], np.cumsum(per)])
    total = int(out_before[-1])
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(total) - out_before[doc] + before[doc]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    acc = np.zeros(total, np.uint64)
    short = counts[doc] < size
    for j in range(size):
        term = padded[at + j] * factors[j]
        if short.any():
            term[short & (j >= counts[doc])] = 0
        acc += term
    return mix(acc + np.uint64(_BASE)), out_before


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.diff(heads[offsets])


class Kept(dict):
    """Results of ``make`` by key, in two generations of at most ``limit`` entries each.

    A full generation replaces the older one; what is used again moves to the new
    one. Keys longer than ``longest`` aren't kept.
    """

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 128):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
