"""Undominated rows: a divide and conquer over sorted places, without a step in which all rows meet.

A point beats another if it is at most as much in every objective and less in one. In the order of all objectives a point comes
after those that beat it. Distinct points are placed in that order, and cut into leaves of LEAF places, within which all pairs
are compared. Beyond its leaf, a point can only be beaten from the left half of a dyadic node in whose right half it lies: for
each level, right halves ask and left halves answer, with one objective less. When two objectives are left, the question is a
sweep: the least second objective of what comes before, as running minima over sorted ranges.

Rows: n times log2(n / LEAF) for each objective beyond two. Ranges may hold any part of a node: nothing is gathered by node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.statistics import ranks
from quarry.sources.steps import written

LEAF = 1024
#: Points of a batch that the others of the batch are held against first: what they beat is beaten.
FILTER = 256


def frontier(df: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other row beats in any number of objectives, all to be small; equal rows stay together. Rows with a null or
    NaN objective are left out. An empty table has an empty frontier."""
    names = [f"o{i}" for i in range(len(objectives))]
    values = [F.col(f"`{o}`").cast("double") for o in objectives]
    clean = df.where(reduce(Column.__and__, [v.isNotNull() & ~F.isnan(v) for v in values]))
    points = clean.select(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    if len(names) == 1:
        best = points.agg(F.min("o0").alias("o0"))
    else:
        left = thinned(points, names).distinct()
        asked = written(ranks(left, names, "places").withColumnRenamed("place", "id"), "points")
        if len(names) == 2:  # every point asks, and answers those after it
            beaten = swept(asked.select("id", F.lit("").alias("node"), F.lit(True).alias("asks"), F.lit(True).alias("gives"), *names), names)
        else:
            beaten = divided(asked, names)
        best = asked.join(beaten, "id", "left_anti").select(names)
    return clean.join(best, [v == F.col(n) for v, n in zip(values, names, strict=True)], "left_semi")


def thinned(points: DataFrame, names: list[str]) -> DataFrame:
    """The points without some that are beaten: each batch is held against its FILTER points of the smallest sums of places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.unique(batch[names].to_numpy(dtype=float), axis=0)
            order = np.argsort(np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0).sum(1), kind="stable")
            out = np.zeros(len(x), dtype=bool)
            for p in x[order[:FILTER]]:
                out |= (p <= x).all(1) & (p < x).any(1)
            yield pd.DataFrame(x[~out], columns=names)

    return points.mapInPandas(run, ", ".join(f"{n} double" for n in names))


def leaves(rows: DataFrame, within: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(id) from each leaf's rows: at most LEAF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(batch):
                open_ = batch["leaf"] == batch["leaf"].iloc[-1]
                rest = batch[open_]
                yield from (within(part) for _, part in batch[~open_].groupby("leaf"))
        if rest is not None:
            yield within(rest)

    return rows.repartition("leaf").sortWithinPartitions("leaf").mapInPandas(run, "id long")


def halved(rows: DataFrame) -> DataFrame | None:
    """Rows once a level above their leaf, with the half that they lie in and the node of both halves; None with one leaf."""
    levels = int(rows.agg(F.max("leaf")).first()[0] or 0).bit_length()
    if not levels:
        return None
    spread = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    spread = spread.withColumn("half", F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    return spread.withColumn("box", F.concat_ws(":", "level", F.floor(F.col("half") / 2).cast("string")))


def divided(asked: DataFrame, names: list[str]) -> DataFrame:
    """(id) of points (id, objectives) that another one beats; ids are places in the order of all objectives."""

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, out = part[names].to_numpy(dtype=float), np.zeros(len(part), dtype=bool)
        for k in range(len(x) - 1):
            if not out[k]:  # what a beaten point beats, another beats
                out[k + 1 :] |= (x[k] <= x[k + 1 :]).all(1)
        return part.loc[out, ["id"]]

    placed = asked.withColumn("leaf", F.floor(F.col("id") / LEAF))
    near, spread = leaves(placed.select("id", "leaf", *names), within), halved(placed)
    if spread is None:
        return near
    asks = F.col("half") % 2 == 1
    return near.union(answered(spread.select("id", F.col("box").alias("node"), asks.alias("asks"), (~asks).alias("gives"), *names[1:]), names[1:])).distinct()


def answered(spread: DataFrame, names: list[str]) -> DataFrame:
    """(id) of asking rows (id, node, asks, gives, objectives) to which a giving row of the node is at most as much in all."""
    if len(names) == 2:
        return swept(spread, names)

    def within(part: pd.DataFrame) -> pd.DataFrame:
        found = [part.loc[[], ["id"]]]
        for _, own in part.groupby("node"):
            give, ask = own.loc[own["gives"], names].to_numpy(dtype=float), own[own["asks"]]
            x, out = ask[names].to_numpy(dtype=float), np.zeros(len(ask), dtype=bool)
            for p in give if len(ask) else ():
                out |= (p <= x).all(1)
            found.append(ask.loc[out, ["id"]])
        return pd.concat(found)

    # giving rows that are at most as much come first in this order, so that a leaf's askers look back to left halves only
    placed = written(ranks(spread, ["node", *names, "asks", "id"], "nodes"), "nodes").withColumn("leaf", F.floor(F.col("place") / LEAF))
    near, deeper = leaves(placed.select("id", "node", "asks", "gives", "leaf", *names), within), halved(placed)
    if deeper is None:
        return near
    named = F.concat_ws("/", "node", "box").alias("node")
    return near.union(answered(deeper.where("(half % 2 = 1) = asks").select("id", named, "asks", "gives", *names[1:]), names[1:])).distinct()


def swept(spread: DataFrame, names: list[str]) -> DataFrame:
    """The same for two objectives: in the order of the first, a row asks for the least second one of the givers before it."""
    y, z = names
    order = ["node", y, z, "asks", "id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, least = None, np.nan
        for batch in batches:
            if not len(batch):
                continue
            value, node = batch[z].where(batch["gives"]).to_numpy(), batch["node"].to_numpy()
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            low = np.empty(len(batch))
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                least = least if a == 0 and node[0] == now else np.nan
                held = np.fmin.accumulate(np.r_[least, value[a:b]])
                low[a:b], least = held[:-1], held[-1]
            now = node[-1]
            yield pd.DataFrame({"id": batch["id"], "node": node, "asks": batch["asks"], "z": batch[z], "low": low, "own": value})

    ranged = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    ran = ranged.select("id", "node", "asks", "gives", *names).mapInPandas(run, "id long, node string, asks boolean, z double, low double, own double")
    ran = written(ran.withColumn("part", F.spark_partition_id()), "sweep")
    ends = ran.groupBy("part", "node").agg(F.min("own").alias("end"))
    ahead = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a node
    carried = ends.select("part", "node", F.min("end").over(ahead).alias("carried"))
    # NaN stands for no giver: it is larger than every number
    least = F.least(F.col("low"), F.coalesce("carried", F.lit(float("nan"))))
    return ran.where("asks").join(carried, ["part", "node"]).where(least <= F.col("z")).select("id")
