"""Vectorised word and shingle hashes of whole texts.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. A
word's hash is a polynomial over its bytes, taken from prefix sums modulo 2^64, then mixed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = U(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(BASE))


@lru_cache(2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a buffer."""
    b = np.frombuffer(buffer, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~WHITE[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    n = 1 << max(20, len(b).bit_length())
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(BYTE[b] * powers(BASE, n)[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(INVERSE, n)[starts]
    return starts, ends, mixed(h + (ends - starts).astype(np.uint64) * STEP)


def shingles_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles of `size` words in increasing order; a text with fewer
    words has its whole sequence as its one shingle, a text without words none."""
    buffer = b" ".join(texts).translate(LOWER)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    starts, _, w = words_of(buffer)
    doc = np.searchsorted(begins, starts, "right") - 1
    if len(w) >= size:
        m = len(w) - size + 1
        h = w[:m].copy()
        for k in range(1, size):
            h = h * STEP + w[k : m + k]
        own = doc[:m] == doc[size - 1 :]
        h, d = mixed(h[own]), doc[:m][own]
    else:
        h, d = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            there = counts[short] > k
            extra[there] = extra[there] * STEP + w[np.minimum(first + k, len(w) - 1)[there]]
        h = np.concatenate([h, mixed(extra + counts[short].astype(np.uint64) * U(BASE))])
        d = np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))
