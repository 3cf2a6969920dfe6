"""Words and word n-grams of whole Arrow batches as 64-bit hashes, computed by numpy.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash is a polynomial over a
mixed table of bytes, taken for all words of a slice at once from running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For ``gaps``: also every other ASCII byte that is no letter or digit.
PUNCTUATION = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POW = _powers(_BASE, SLICE_BYTES)
_INV = _powers(pow(_BASE, -1, 2**64), SLICE_BYTES)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = (_POW, _INV) if hi - lo <= SLICE_BYTES else (_powers(_BASE, hi - lo), _powers(pow(_BASE, -1, 2**64), hi - lo))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        out[i:j] = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out)


@dataclass
class Words:
    """Words of some texts: where they stand in ``data``, their hashes, and of each text the index
    of its first word; ``first`` has one entry more than there are texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def grams(self, n: int, base: np.uint64 = _GRAM) -> np.ndarray:
        """Hash of the n words from each word on; only meaningful where these are of one text.
        Another odd base gives another hash."""
        h, m = self.hashes, max(0, len(self.hashes) - n + 1)
        g = np.full(m, n, np.uint64)
        for k in range(n):
            g *= base
            g += h[k : k + m]
        return mix(g)

    def grams_at(self, at: np.ndarray, n: int, base: np.uint64 = _GRAM) -> np.ndarray:
        """The same of the words ``at`` alone."""
        g = np.full(len(at), n, np.uint64)
        for k in range(n):
            g *= base
            g += self.hashes[at + k]
        return mix(g)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE) -> Words:
    data, offsets = texts_of(column)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return Words(data, e, e, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    word = ~gaps[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, starts, ends, hash_words(data, starts, ends), np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds about SLICE_BYTES of text, or one long text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right"))
            upto = max(at + 1, upto)
            yield batch.slice(at, upto - at)
            at = upto
