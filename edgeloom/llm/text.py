"""Words and hashes of a batch of texts in numpy, without a Python loop over words.

Texts are taken as UTF-8 bytes. A word is a maximal run of bytes other than
space, tab, line feed, vertical tab, form feed and carriage return, so it is
also ``[^\\x20\\x09-\\x0D]+`` of the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 250_000  # texts handled at once; one longer text is a slice of its own

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SYMBOL = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of runs of texts of about ``SLICE_BYTES``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, data[offsets[at]:offsets[end]], (offsets[at:end + 1] - offsets[at]).astype(np.int64)
        at = end


class Prefix:
    """Polynomial prefix hashes of a byte sequence: any substring's hash in constant time."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        symbols = _SYMBOL if not salt else mix(_SYMBOL + np.uint64(salt))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols[data] * _powers(_BASE, "up", max(n, 1))[:n], out=self.sums[1:])
        self.down = _powers(_INVERSE, "down", n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]``; equal bytes give equal hashes wherever they stand."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``hash, start, end`` of every word, and for each text the index of its first word (n + 1 values)."""
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    begins = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a word may not run on into the next text
    begins[both] = True
    ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    first = np.searchsorted(start, offsets)
    return Prefix(data).of(start, end), start, end, first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each word, for all but the last ``n - 1``."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:m]
    for k in range(1, n):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + words[k:m + k])
    return h


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ``n``-word shingles; a shorter text is one shingle, no words give none."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(gram_hashes(words, min(n, len(words))))
