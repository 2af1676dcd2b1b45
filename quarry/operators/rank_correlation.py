"""Rank correlations of columns with a target, over wide rows: two sorts and no table of pairs.

The rows are sorted by the target, by ranges, and read in blocks. A block knows the places of its values among its own rows, so it
adds them up by value of each column: columns of few values keep few sums, whatever the rows. Only its first and last value may
reach into other blocks; these keep apart, and a list of all blocks' counts and ends gives the places that they begin at. The sums
are then sorted by value in the same manner, which gives the ranks of the columns. Between the two sorts a table of the sums is
kept; the shuffles of a sort are released when it is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite
from quarry.sources.steps import written

#: Rows of a block.
BLOCK = 1 << 18
#: A block's values: those inside, the first and the last. A block of one value has only a first.
INSIDE, FIRST, LAST = 0, 1, 2


def blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[int, pd.DataFrame]]:
    """(unit, rows): a task's rows, so many at most; units are numbered in the order of the sort."""
    held, n, unit = [], 0, TaskContext.get().partitionId() << 33
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: most - n], batch.iloc[most - n :]
            held.append(part)
            n += len(part)
            if n == most:
                yield unit, pd.concat(held, ignore_index=True)
                held, n, unit = [], 0, unit + 1
    if n:
        yield unit, pd.concat(held, ignore_index=True)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, edge) of the stretches of equal sorted values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    edge = np.full(len(starts), INSIDE)
    edge[-1], edge[0] = LAST, FIRST
    return starts, edge


def places(held: np.ndarray) -> np.ndarray:
    """Mean places, from 1, of values that are held so many times, in their order."""
    return np.cumsum(held) - held + (held + 1) / 2


def cubes(held: np.ndarray) -> float:
    """What ties take from twelve times the squared spread of ranks."""
    h = held.astype(float)
    return float((h**3 - h).sum())


def offsets(ends: pd.DataFrame) -> pd.DataFrame:
    """What places in each block's parts begin at, less the mean of all ranks; for a first or last value, its rank. From a
    column's list (col, unit, edge, v, held, ties) of all blocks' parts. n: the column's rows. spread: the sum of its squared ranks."""
    ends = ends.assign(order=np.where(ends["edge"] == FIRST, -1, ends["edge"])).sort_values(["unit", "order"], ignore_index=True)
    held, edge = ends["held"].to_numpy(), ends["edge"].to_numpy() != INSIDE
    before, n = np.cumsum(held) - held, int(held.sum())
    whole = ends[edge].assign(before=before[edge]).groupby("v").agg(held=("held", "sum"), before=("before", "min"))
    rank = (whole["before"] + (whole["held"] + 1) / 2).rename("rank")
    at = np.where(edge, ends["v"].map(rank), before) - (n + 1) / 2
    ties = ends.loc[~edge, "ties"].sum() + cubes(whole["held"].to_numpy())
    return pd.DataFrame({"col": ends["col"], "unit": ends["unit"], "edge": ends["edge"], "at": at, "n": n, "spread": (float(n) ** 3 - n - ties) / 12})


def by_target(k: int, most: int):
    """Rows (t, x0, x1, ...) sorted by t: sums (col, unit, edge, v, held, s) of places by value of each column, where it is
    finite, and, where `ends`, counts of the block's parts, with their value of t as v."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit, block in blocks(batches, most):
            starts, edge = runs(block["t"].to_numpy())
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(block)]))
            for c in range(k):
                x = block[f"x{c}"].to_numpy(dtype=float)
                good = np.isfinite(x)
                held = np.bincount(run[good], minlength=len(starts))
                inside = np.where(edge == INSIDE, held, 0)
                place = places(inside)
                for e in (INSIDE, FIRST, LAST):
                    own = edge == e
                    if not (n := held[own].sum()):
                        continue
                    pick = good & own[run]
                    values, at, counts = np.unique(x[pick], return_inverse=True, return_counts=True)
                    s = np.bincount(at, place[run[pick]]) if e == INSIDE else 0.0
                    yield pd.DataFrame({"col": c, "unit": unit, "edge": e, "ends": False, "v": values, "held": counts, "s": s, "ties": 0.0})
                    t = float("nan") if e == INSIDE else block["t"].iloc[starts[own][0]]
                    yield pd.DataFrame({"col": [c], "unit": unit, "edge": e, "ends": True, "v": t, "held": n, "s": 0.0, "ties": cubes(held[own]) if e == INSIDE else 0.0})

    return summed


def by_value(most: int):
    """Sums (col, v, held, s) of the target's ranks sorted by column and value: for each part of a block the sum of s, and of s
    by place."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit, block in blocks(batches, most):
            for c, rows in block.groupby("col"):
                v = rows["v"].to_numpy()
                starts, edge = runs(v)
                held, s = np.add.reduceat(rows["held"].to_numpy(), starts), np.add.reduceat(rows["s"].to_numpy(), starts)
                place = places(np.where(edge == INSIDE, held, 0))
                for e in (INSIDE, FIRST, LAST):
                    own = edge == e
                    if own.any():
                        value = float("nan") if e == INSIDE else v[starts[own][0]]
                        within, ties = ((place[own] * s[own]).sum(), cubes(held[own])) if e == INSIDE else (0.0, 0.0)
                        yield pd.DataFrame({"col": [c], "unit": unit, "edge": e, "v": value, "held": held[own].sum(), "s": s[own].sum(), "within": within, "ties": ties})

    return summed


def rank_correlations(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, n, rho): Spearman's rho of each column with the target over the rows where both are finite, equal values sharing
    their mean rank; null for fewer than three rows or no spread. Columns without such rows are left out."""
    offset = "col int, unit long, edge int, at double, n long, spread double"
    clean = rows.select((finite(F.col(target)) + F.lit(0.0)).alias("t"), *[(finite(F.col(c)) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]).where("t IS NOT NULL")
    # equal targets may fill many ranges: the number of the task that sends a row parts them
    laid = clean.withColumn("_from", F.spark_partition_id()).repartitionByRange("t", "_from").sortWithinPartitions("t").drop("_from")
    parts = written(laid.mapInPandas(by_target(len(columns), BLOCK), "col int, unit long, edge int, ends boolean, v double, held long, s double, ties double"), "places", release=True)
    starts = parts.where("ends").groupBy("col").applyInPandas(offsets, offset)  # a row for each block's part
    targets = written(starts, "target-places")
    sums = parts.where("NOT ends").join(F.broadcast(targets.select("col", "unit", "edge", "at")), ["col", "unit", "edge"])
    sums = sums.select("col", "v", "held", (F.col("s") + F.col("held") * F.col("at")).alias("s")).repartitionByRange("col", "v").sortWithinPartitions("col", "v")
    ends = written(sums.mapInPandas(by_value(BLOCK), "col int, unit long, edge int, v double, held long, s double, within double, ties double"), "values", release=True)
    values = ends.join(ends.groupBy("col").applyInPandas(offsets, offset), ["col", "unit", "edge"])
    found = values.groupBy("col", "n", F.col("spread").alias("xx")).agg(F.sum(F.col("within") + F.col("at") * F.col("s")).alias("xt"))
    found = found.join(targets.select("col", F.col("spread").alias("tt")).distinct(), "col")  # a row for each column
    rho = F.when((F.col("n") >= 3) & (F.col("xx") > 0) & (F.col("tt") > 0), F.col("xt") / F.sqrt("xx") / F.sqrt("tt"))
    return found.select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("col")).alias("column"), "n", rho.alias("rho"))
