"""Runs of periodic words by block convolution.

A run is a stretch of words with a smallest period q that holds at least twice q and at least LEAST words and that no
neighbouring word extends. At scale B = 2, 4, 8, ... the text is cut into blocks of B words. A run of a period from 2 B - 1 to
4 B - 2 (from 1 at the first scale) holds an aligned block that recurs one period later, so each block is looked for in the
words that follow it at these distances: the sum of squared differences of codes, by a number-theoretic transform, is zero
where it matches. Codes are word numbers reduced so far that such sums stay below the modulus: they are exact integers, and a
zero is confirmed on the words themselves. Blocks and distances that match are seeds; a seed is extended both ways by
comparing prefix sums of hashes, and the run that comes out is checked word by word.

Work is saved without loss: a block with a word that does not recur within the distances can't match, and a block that lies
with its whole window in a run of a period of B or less can only find multiples of that period. A block of more than WIDE words
is represented by its first WIDE, and the words that follow are taken in windows of the same width.

Null and empty texts have no words. Texts of any length are taken whole, several short ones at once, never more than CHUNK
words beyond one text. Repeated rows have equal results; extra columns pass through, and output columns replace those of the
same name. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.base import unused

LEAST = 12
CHUNK = 1 << 17
WIDE = 1 << 14
#: A prime with roots of unity of order 2^16, its generator, and two primes with bases for prefix hashes.
MODULUS, GENERATOR = 65537.0, 3
HASHES = ((2147483647, 1103515245), (2147483629, 1597334677))


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo MODULUS, in place; exact for whole doubles below 2^50."""
    x -= np.floor(x / MODULUS) * MODULUS
    return x


@lru_cache(64)
def powers_of(order: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """w^(i j) for i < rows, j < columns, where w is a root of unity of the order."""
    p = int(MODULUS)
    w = pow(GENERATOR, (p - 1) // order, p)
    w = pow(w, -1, p) if inverse else w
    line = np.ones(order, dtype=np.int64)
    for k in range(1, order):
        line[k] = line[k - 1] * w % p
    return line[np.outer(np.arange(rows), np.arange(columns)) % order].astype(float)


def transformed(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The transform of every row (a power of two of numbers below MODULUS), as products of small matrices; the inverse without its factor."""
    m, n = x.shape
    if n <= 32:
        return reduced(x @ powers_of(n, n, n, inverse))
    a = 1 << (n.bit_length() // 2)
    b = n // a
    columns = reduced(np.matmul(powers_of(a, a, a, inverse), x.reshape(m, a, b)))
    columns *= powers_of(n, a, b, inverse)
    rows = transformed(reduced(columns).reshape(m * a, b), inverse)
    return np.ascontiguousarray(rows.reshape(m, a, b).transpose(0, 2, 1)).reshape(m, n)


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block and its window at every place of the window where the block fits. Entries are
    whole numbers, small enough that all sums of products stay below MODULUS."""
    m, b = blocks.shape
    w = windows.shape[1]
    n = 1 << (w - 1).bit_length()
    turned, wide = np.zeros((m, n)), np.zeros((m, n))
    turned[:, 0], turned[:, n - b + 1 :] = blocks[:, 0], blocks[:, :0:-1]  # so that products are correlations
    wide[:, :w] = windows
    both = reduced(transformed(turned) * transformed(wide))
    inverse = float(pow(n, -1, int(MODULUS)))
    products = reduced(transformed(both, True) * inverse)[:, : w - b + 1]
    squares = np.zeros((m, w + 1))
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    return (blocks * blocks).sum(1)[:, None] + (squares[:, b:] - squares[:, : w - b + 1]) - 2 * products


class Prefixes:
    """Equality of stretches of a word sequence, by two prefix sums of hashes."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for p, base in HASHES:
            power = np.ones(len(ids) + 1, dtype=np.uint64)
            have = 1
            while have < len(power):
                step = np.uint64(pow(base, have, p))
                more = min(have, len(power) - have)
                power[have : have + more] = power[:more] * step % np.uint64(p)
                have += more
            s = np.zeros(len(ids) + 1, dtype=np.uint64)
            np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[:-1] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))
            self.powers.append(power)

    def same(self, at: np.ndarray, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the `length` words at `at` equal those d later."""
        out = np.ones(len(at), dtype=bool)
        for s, power, (p, _) in zip(self.sums, self.powers, HASHES, strict=True):
            p = np.uint64(p)
            out &= (s[at + length] + p - s[at]) % p * power[d] % p == (s[at + length + d] + p - s[at + d]) % p
        return out

    def reach(self, at: np.ndarray, d: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from `at` on (or before it, if back) equal those d later, at most `most`."""
        low, high = np.zeros(len(at), dtype=np.int64), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            good = self.same(at - middle if back else at, d, middle)
            low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low


def seeds(ids: np.ndarray, size: int, low: int, high: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block numbers, distances) where the codes of a block recur at a distance from low to high, ordered by distance."""
    width = min(size, WIDE)
    symbols = int(((MODULUS - 1) / width) ** 0.5) + 1
    code = (((ids * 2654435761) & 0xFFFFFFFF) >> 12) % symbols
    code = np.concatenate([code, np.zeros(size + high + 1, dtype=code.dtype)]).astype(float)
    found = []
    reach = 2 * WIDE if size > WIDE else high - low + 1  # distances of one window
    rows = max(1, (1 << 19) // (width + reach))
    for first in range(low, high + 1, reach):
        count = min(reach, high + 1 - first)
        for k in range(0, len(blocks), rows):
            own = blocks[k : k + rows]
            at = own[:, None] * size
            sums = mismatches(code[at + np.arange(width)], code[at + first + np.arange(width + count - 1)])
            where, d = np.nonzero(sums == 0)
            found.append((own[where], d + first))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, d))
    return j[order], d[order]


def runs_of(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a sequence. longest: no run is longer (texts of one sequence are parted by
    numbers that occur once)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    prefixes = None
    runs: list[tuple[int, int, int]] = []
    size, low, high = 2, 1, 6
    while 2 * low <= longest:
        gap = gap[: len(gap) // 2 * 2].reshape(-1, 2).max(1)  # of blocks of `size` words
        covered = np.zeros(len(gap) + 1, dtype=np.int64)
        for s, e, q in runs:
            a, b = -(-s // size), (e - size - high) // size
            if q <= size and a <= b:
                covered[a] += 1
                covered[b + 1] -= 1
        blocks = np.flatnonzero((gap <= high) & (np.cumsum(covered)[:-1] == 0))
        if len(blocks):
            j, d = seeds(ids, size, low, high, blocks)
            prefixes = prefixes or Prefixes(ids)
            inside = (j + 1) * size + d <= n
            j, d = j[inside], d[inside]
            good = prefixes.same(j * size, d, np.full(len(j), size))
            runs += extended(ids, prefixes, j[good], d[good], size, runs)
        size, low, high = 2 * size, 4 * size - 1, 8 * size - 2
    return runs


def extended(ids: np.ndarray, prefixes: Prefixes, j: np.ndarray, d: np.ndarray, size: int, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """New runs from seeds that are ordered by distance, then block."""
    if not len(j):
        return []
    first = np.ones(len(j), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (j[1:] != j[:-1] + 1)
    last = np.append(first[1:], True)
    begin, end, d = j[first] * size, (j[last] + 1) * size, d[first]
    # a neighbouring block is no seed, so that the ends are less than a block away, but for blocks that lie in a known run
    # with their windows: what reaches one whole has that run's period
    begin = begin - prefixes.reach(begin, d, np.minimum(size, begin), True)
    end = end + prefixes.reach(end, d, np.minimum(size, len(ids) - d - end), False)
    keep = end - begin + d >= np.maximum(LEAST, 2 * d)
    by_place = sorted(known)
    out: dict[tuple[int, int], int] = {}
    for s, e, q in sorted(zip(begin[keep].tolist(), (end + d)[keep].tolist(), d[keep].tolist(), strict=True), key=lambda r: r[2]):
        if (s, e) in out or shorter(by_place, s, e, q) or not maximal(ids, s, e, q):
            continue
        out[s, e] = q
    return [(s, e, q) for (s, e), q in out.items()]


def maximal(ids: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether the stretch has the period and neither neighbour extends it, word by word."""
    if (s and ids[s - 1] == ids[s - 1 + q]) or (e < len(ids) and ids[e] == ids[e - q]):
        return False
    return bool((ids[s : e - q] == ids[s + q : e]).all())


def shorter(known: list[tuple[int, int, int]], s: int, e: int, q: int) -> bool:
    """Whether a known run of a smaller period is this stretch: as its period divides q, both have the same ends."""
    k = bisect_left(known, (s, e, 0))
    return k < len(known) and known[k][:2] == (s, e) and known[k][2] < q


def words_of(text: str | None) -> list[bytes]:
    """Words are stretches without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().split()


def summaries(batch: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """(runs by start and period as (start, length, period), collapsed text) of each word list."""
    numbers: dict[bytes, int] = {}
    parts, begins, at = [], [], 0
    total = sum(map(len, batch))
    for k, words in enumerate(batch):
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        parts += [own, np.array([total + k], dtype=np.int64)]
        begins.append(at)
        at += len(words) + 1
    ids = np.concatenate(parts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    starts = np.array(begins)
    for s, e, q in runs_of(ids, max(map(len, batch))):
        own = int(np.searchsorted(starts, s, "right")) - 1
        found[own].append((s - begins[own], e - s, q))
    out = []
    for words, own in zip(batch, found, strict=True):
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, q in own:
                edge[start + q] += 1
                edge[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
        out.append((own, b" ".join(words)))
    return out


def in_batches(lists: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for words in lists:
        if held and size + len(words) > CHUNK:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def detect(df: DataFrame, columns: str, row: Callable, change: Callable | None = None, text_col: str = "text", with_col: Column | None = None) -> DataFrame:
    """df with columns made by row(runs, collapsed text), a tuple for each text. columns: their names and types. change: the words
    that are searched, from (words, value of with_col, NaN or None where null)."""
    names = [c.split()[0] for c in columns.split(", ")]

    @F.pandas_udf(columns)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, values in batches:
            lists = (change(words_of(t), v) if change else words_of(t) for t, v in zip(texts, values, strict=True))
            rows = [row(runs, text) for group in in_batches(lists) for runs, text in summaries(group)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    own = unused(df, "_runs")
    found = df.withColumn(own, of(F.col(text_col), F.lit(0) if with_col is None else with_col))
    return found.withColumns({n: F.col(own)[n] for n in names}).drop(own)


def spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its runs (start, length, period in words, by start and period) and the text without repeated periods."""
    listed = lambda runs, text: ([{"start": s, "length": n, "period": q} for s, n, q in runs], text.decode())
    return detect(df, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", listed, text_col=text_col)
