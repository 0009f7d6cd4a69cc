"""Vectorised words and word n-gram hashes over Arrow string arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither letter nor digit; bytes of other alphabets belong to words.
NOT_ALNUM = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_T = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        _powers[:] = []
        for base in (_P, _PI):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of several texts laid end to end: byte starts and ends in ``data``, and the text each belongs to."""

    __slots__ = ("data", "start", "end", "doc", "n_docs")

    def __init__(self, data, start, end, doc, n_docs):
        self.data, self.start, self.end, self.doc, self.n_docs = data, start, end, doc, n_docs

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word (a polynomial by prefix sums, then mixed)."""
        n = len(self.data)
        pw, ipw = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_T[self.data] * pw[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * ipw[self.start])

    def grams(self, m: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all runs of m words, those across two texts included."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - m + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        g, q = np.zeros(n, np.uint64), 1
        for k in range(m):
            g += h[k : k + n] * np.uint64(q)
            q = q * int(_Q) % (1 << 64)
        return mix(g)


def blocks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``most`` bytes together; a longer text comes alone; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANK, fold: np.ndarray | None = None) -> Words:
    """Split each text at separator bytes; words never run from one text into the next."""
    if fold is not None:
        data = fold[data]
    inside = ~separators[data]
    n = len(data)
    first = inside.copy()
    last = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(offsets, start, side="right") - 1, len(offsets) - 1)
