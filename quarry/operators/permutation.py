"""Permutations of a target over all rows, and the null distribution of the largest correlation.

A replicate is a keyed bijection of the places 0 to n - 1: places are split into two digits, and rounds of a Feistel network
add to each digit, in turn, a keyed function of the other; places that leave the range are sent on until they are back. So a
row's new place comes from its own place alone, and no replicate needs an order of its own.

Rows are placed once. Targets travel to their new places packed by chunk of places and replicate; the rows of a chunk meet them
in one task, as products of a matrix of columns and blocks of replicates. A step moves some of the replicates and leaves their
sums only: its shuffle is released before the next, so the disk that is used does not grow with the replicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite
from quarry.operators.rank_correlation import blocks
from quarry.operators.statistics import ranks
from quarry.sources.steps import written

#: A prime below 2^31 and the multipliers of the round function.
PRIME, SPREAD, STIR, REPLICATE, ROUND = 2147483647, 1103515, 48271, 2654435, 40503
ROUNDS = 6
#: Places of a chunk, at least and at most, and replicates of a block.
CHUNK, WIDE, BLOCK = 1 << 14, 1 << 18, 32
#: Rows that a task packs at once, and places that are sent at once, which stay in a processor's cache.
ROWS, SLICE = 1 << 18, 1 << 13
#: Values that a step moves, if that are no fewer than so many replicates.
MOVED, LEAST = 1 << 26, 8


def rest(x: np.ndarray, m: int) -> np.ndarray:
    """x modulo m: NumPy divides by one number much faster than it takes remainders."""
    return x - x // m * m


def mixed(u: np.ndarray) -> np.ndarray:
    """The round function: squared, then stirred, modulo PRIME."""
    return rest(rest(u * u, PRIME) * STIR + 11, PRIME)


def sides(n: int) -> tuple[int, int]:
    """Digits (a, b) with a b >= n, as equal as may be."""
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permuted(places: np.ndarray, n: int, replicate: int, seed: int = 0) -> np.ndarray:
    """New places of the places under the replicate's bijection of 0 to n - 1."""
    a, b = sides(n)
    keys = mixed((replicate * REPLICATE + np.arange(ROUNDS, dtype=np.int64) * ROUND + seed * 97 + 1) % PRIME)
    out = places.astype(np.int64)
    for at in range(0, len(out), SLICE):
        part = out[at : at + SLICE]
        todo = np.arange(len(part))
        while len(todo):
            high = part[todo] // b
            low = part[todo] - high * b
            for k in range(0, ROUNDS, 2):
                high = rest(high + mixed(rest(low * SPREAD + keys[k], PRIME)), a)
                low = rest(low + mixed(rest(high * SPREAD + keys[k + 1], PRIME)), b)
            part[todo] = high * b + low
            todo = todo[part[todo] >= n]  # cycle walking
    return out


#: Sums of a column and a replicate's targets.
SUMS = ["st", "stt", "sxt", "sx", "sxx", "m"]


def permutation_max(rows: DataFrame, columns: list[str], target: str, key: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(observed, p_value, replicates): the largest |r| of the target with a column, and (exceeding + 1) / (replicates + 1) among
    permutations of the finite targets. Rows are ordered by key, then values.

    Each column counts the rows where it is finite; below three, or without spread, it has no r, and where none has, the
    largest is 0. Rows without a finite target take no part. Without rows: observed 0, p 1."""
    names = [f"c{i}" for i in range(len(columns))]
    clean = rows.select(*key, finite(F.col(target)).alias("t"), *[finite(F.col(c)).alias(x) for c, x in zip(columns, names, strict=True)]).where("t IS NOT NULL")
    placed = ranks(clean, [*key, "t", *names], "by-key", release=True)
    about = placed.agg(F.count("*").alias("n"), F.avg("t").alias("mt"), *[F.avg(x).alias(f"m{x}") for x in names]).first()  # one row
    n, k = about["n"], len(columns)
    means = [about[f"m{x}"] or 0.0 for x in names]
    spark = rows.sparkSession
    out = "observed double, p_value double, replicates long"
    if not n:
        return spark.createDataFrame([(0.0, 1.0, replicates)], out)
    wide, least, most = max(CHUNK, min(n // 64, WIDE)), min(LEAST, replicates + 1), ROWS
    step = min(max(MOVED // n, least), replicates + 1)

    def packed(start: int, end: int):
        """Pieces (chunk, replicate, gaps, data) of the replicates from start on: -1 for the columns' values, 0 for targets in
        place. gaps: from the chunk's start and from place to place."""

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, block in blocks(batches, most):
                place, t = block["place"].to_numpy(), block["t"].to_numpy() - about["mt"]
                x = block[names].to_numpy(dtype=float) - means
                bits = len(place).bit_length()
                for r in (-1, *range(start, end)):
                    to = permuted(place, n, r, seed) if r > 0 else place
                    keyed = np.sort(to << bits | np.arange(len(to)))  # faster than sorting places' numbers
                    to, order = keyed >> bits, keyed & ((1 << bits) - 1)
                    chunk = to // wide
                    cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(to)]
                    gaps = np.diff(to, prepend=0)
                    gaps[cuts[:-1]] = to[cuts[:-1]] - chunk[cuts[:-1]] * wide
                    gaps = gaps.astype(np.uint16 if gaps.max() < 1 << 16 else np.int32)
                    values = (x if r < 0 else t)[order]
                    pieces = [(int(chunk[a]), r, gaps[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pd.DataFrame(pieces, columns=["chunk", "replicate", "gaps", "data"])

        return pack

    def multiplied(start: int, end: int):
        """Sums over the task's chunks, for each replicate and column: of t, t t and x t where the column is finite, and of x, x x, 1."""

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((6, k, end - start))
            now, x, t, first = None, None, None, start

            def close() -> None:
                if t is not None:
                    good = np.isfinite(x)
                    m, v = good.astype(float), np.where(good, x, 0)
                    at = slice(first - start, first - start + t.shape[1])
                    total[:3, :, at] += np.stack([m.T @ t, m.T @ (t * t), v.T @ t])
                    total[3:, :, at] += np.stack([v.sum(0), (v * v).sum(0), m.sum(0)])[:, :, None]

            for batch in batches:
                for chunk, r, gaps, data in batch.itertuples(index=False):
                    count = len(data) // (8 * k if r < 0 else 8)
                    at = np.cumsum(np.frombuffer(gaps, np.uint16 if len(gaps) == 2 * count else np.int32), dtype=np.int64)
                    if chunk != now:
                        close()
                        now, t, x = chunk, None, np.full((min(wide, n - chunk * wide), k), np.nan)
                    if r < 0:
                        x[at] = np.frombuffer(data).reshape(count, k)
                        continue
                    if t is None or r >= first + t.shape[1]:
                        close()
                        first = start + (r - start) // BLOCK * BLOCK
                        t = np.zeros((len(x), min(BLOCK, end - first)))
                    t[at, r - first] = np.frombuffer(data)
            close()
            cells = np.moveaxis(total, 0, -1).reshape(-1, 6)
            frame = pd.DataFrame(cells, columns=SUMS)
            frame.insert(0, "replicate", np.tile(np.arange(start, end), k))
            frame.insert(0, "col", np.repeat(np.arange(k), end - start))
            yield frame

        return multiply

    def summed(start: int) -> DataFrame:
        end = min(start + step, replicates + 1)
        pieces = placed.select("place", "t", *names).mapInPandas(packed(start, end), "chunk long, replicate int, gaps binary, data binary")
        dealt = pieces.repartition("chunk").sortWithinPartitions("chunk", "replicate")
        sums = dealt.mapInPandas(multiplied(start, end), "col int, replicate int, " + ", ".join(f"{c} double" for c in SUMS))
        return written(sums.groupBy("col", "replicate").agg(*[F.sum(c).alias(c) for c in SUMS]), "sums", release=True)

    whole = reduce(DataFrame.unionByName, [summed(start) for start in range(0, replicates + 1, step)])
    cov = F.col("sxt") - F.col("sx") * F.col("st") / F.col("m")
    spread = (F.col("sxx") - F.pow("sx", 2) / F.col("m")) * (F.col("stt") - F.pow("st", 2) / F.col("m"))
    r = F.when((F.col("m") >= 3) & (spread > 0), F.abs(cov / F.sqrt(spread)))
    per = whole.groupBy("replicate").agg(F.coalesce(F.max(r), F.lit(0.0)).alias("r"))
    observed = per.agg(F.max(F.when(F.col("replicate") == 0, F.col("r"))).alias("observed"))
    beside = per.join(F.broadcast(observed), on=F.lit(True)).where("replicate > 0")  # one row
    # sums in another order must not turn equal values into exceeding ones
    reached = F.count(F.when(F.col("r") >= F.col("observed") - 1e-12, 1))
    return beside.groupBy("observed").agg(((reached + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("replicates"))
