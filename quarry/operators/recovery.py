"""Planted-structure recovery over query tapes: collisions, confident modes and recall tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.steps import written


def collisions(tape: DataFrame, instance: str, x: str, y: str) -> DataFrame:
    """Per instance: values of y that several x share, and the pairs they form (counted, not listed)."""
    groups = tape.groupBy(instance, y).agg(F.countDistinct(x).alias("n")).where("n > 1")
    return groups.groupBy(instance).agg(F.count("*").alias("values"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


def pair_values(tape: DataFrame, instance: str, x: str, y: str, op: str, modulus: int) -> DataFrame:
    """(instance, value): the smallest x of each group of equal y with every other of the group; zeros are dropped."""
    points = tape.select(instance, y, x).distinct()
    base = points.groupBy(instance, y).agg(F.min(x).alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    rest = points.join(base, [instance, y]).where(F.col(x) != F.col("_b"))
    return combined(rest.select(instance, F.col("_b").alias("base"), F.col(x).alias("other")), instance, op, modulus)


def combined(pairs: DataFrame, instance: str, op: str, modulus: int) -> DataFrame:
    """(instance, value) of pairs (base, other); zeros are dropped, and for ratios, bases that share a factor with the modulus.
    The modulus is below 2^31, so that products fit a long."""
    base, other = F.col("base"), F.col("other")
    if op == "ratio":
        value = F.pmod(F.pmod(other, F.lit(modulus)) * inverse(base, modulus), F.lit(modulus))
    else:
        value = {
            "xor": base.bitwiseXOR(other),
            "sum": F.pmod(base + other, F.lit(modulus)),
            "diff": F.pmod(other - base, F.lit(modulus)),
        }[op]
    return pairs.select(instance, value.alias("value")).where("value <> 0")


def inverse(x: Column, modulus: int) -> Column:
    """The inverse of x modulo the modulus, null where there is none: Euclid's steps, of which there are at most so many."""
    most = int(1.4405 * math.log2(max(modulus, 2))) + 2
    cell = lambda a, b, s, t: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), s.cast("long").alias("s"), t.cast("long").alias("t"))

    def step(c: Column, _: Column) -> Column:
        q = (c["a"] - c["a"] % c["b"]) / c["b"]
        turned = cell(c["b"], c["a"] % c["b"], c["t"], c["s"] - q.cast("long") * c["t"])
        return F.when(c["b"] == 0, c).otherwise(turned)

    start = cell(F.lit(modulus), F.pmod(x, F.lit(modulus)), F.lit(0), F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda c: F.when(c["a"] == 1, F.pmod(c["s"], F.lit(modulus))))


def mode(values: DataFrame, instance: str, margin: float | None = None) -> DataFrame:
    """The commonest value of each instance, ties to the smallest; with a margin, null unless it leads the second by so much."""
    counts = values.groupBy(instance, "value").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("m"), "value")
    top = counts.groupBy(instance).agg(F.min(order).alias("b"), F.sum("n").alias("all"))
    if margin is not None:
        rest = counts.join(top.select(instance, "b"), instance).where(F.col("value") != F.col("b.value"))
        top = top.join(rest.groupBy(instance).agg(F.max("n").alias("second")), instance, "left")
    best = F.col("b.value")
    kept = best if margin is None else F.when(-F.col("b.m") >= margin * F.coalesce("second", F.lit(0)), best)
    return top.select(instance, kept.alias("mode"), (-F.col("b.m")).alias("votes"), "all")


def gcd_of(values: DataFrame, instance: str) -> DataFrame:
    """Greatest common divisor of each instance's values: folded within tasks, then over the tasks' results."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, group in batch.groupby(instance)["value"]:
                held[key] = math.gcd(held.get(key, 0), int(np.gcd.reduce(group.to_numpy())))
        yield pd.DataFrame(list(held.items()), columns=[instance, "value"])

    schema = f"{instance} long, value long"
    parts = values.select(F.col(instance).cast("long").alias(instance), F.col("value").cast("long").alias("value")).mapInPandas(fold, schema)
    return parts.repartition(instance).mapInPandas(fold, schema).select(instance, F.col("value").alias("gcd"))


def post(value: Column, kind: str, bits: int) -> Column:
    """A part of a recovered value: all, its low or high half, or its low three bits."""
    half = max(1, bits // 2)
    return {"id": value, "low_half": value.bitwiseAND(F.lit((1 << half) - 1)), "high_half": F.shiftright(value, half), "low_3": value.bitwiseAND(F.lit(7))}[kind]


def program(values: DataFrame, instance: str, reducer: str, kind: str, bits: int) -> DataFrame:
    """A collision program: the values' mode or gcd, then a part of it."""
    reduced = mode(values, instance).select(instance, F.col("mode").alias("value")) if reducer == "mode" else gcd_of(values, instance).select(instance, F.col("gcd").alias("value"))
    return reduced.select(instance, post(F.col("value"), kind, bits).alias("value"))


def unique_masked(values: DataFrame, instance: str, bits: int) -> DataFrame:
    """The distinct low bits of each instance's values, in order: at most 2^bits of them."""
    low = values.select(instance, F.col("value").bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
    return low.groupBy(instance).agg(F.array_sort(F.collect_set("value")).alias("values"))


def gf2_basis(values: DataFrame, instance: str) -> DataFrame:
    """Reduced basis over GF(2) of each instance's values, highest first: at most 63 numbers, so tasks' bases are merged."""

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, group in batch.groupby(instance)["value"]:
                basis = held.setdefault(key, {})
                for v in np.unique(group.to_numpy()).tolist():
                    add_to_basis(basis, v)
        yield pd.DataFrame([(k, v) for k, basis in held.items() for v in basis.values()], columns=[instance, "value"])

    schema = f"{instance} long, value long"
    clean = values.select(F.col(instance).cast("long").alias(instance), F.col("value").cast("long").alias("value")).distinct()
    parts = clean.mapInPandas(reduced, schema).repartition(instance).mapInPandas(reduced, schema)
    return parts.groupBy(instance).agg(F.reverse(F.array_sort(F.collect_list("value"))).alias("basis"))


def add_to_basis(basis: dict[int, int], value: int) -> None:
    """Adds a number to a reduced basis (by highest bit)."""
    for top in sorted(basis, reverse=True):
        value = value ^ basis[top] if value >> top & 1 else value
    if value:
        new = value.bit_length() - 1
        for top, other in basis.items():
            basis[top] = other ^ value if other >> new & 1 else other
        basis[new] = value


def near_groups(tape: DataFrame, instance: str, x: str, y: str, radius: int, bits: int) -> DataFrame:
    """(instance, x, component): points whose labels are within `radius` bits of another's, by connected components; the
    component is its smallest x. Points of one label are one, its smallest x, while links are sought: any number of them makes no
    pairs. Labels within the radius agree on one of radius + 1 blocks of their bits, so pairs of labels come from an equi-join."""
    edges = [bits * k // (radius + 1) for k in range(radius + 2)]
    blocks = [F.struct(F.lit(k).alias("k"), F.shiftright(F.col("y"), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for k, (a, b) in enumerate(pairwise(edges))]
    points = written(tape.select(F.col(instance).alias("i"), F.col(x).alias("x"), F.col(y).cast("long").alias("y")).distinct(), "points")
    labels = written(points.groupBy("i", "y").agg(F.min("x").alias("first"), F.count("*").alias("n")), "point-labels")
    keyed = labels.select("i", "y", "first", F.explode(F.array(*blocks)).alias("block"))
    a, b = keyed.alias("a"), keyed.alias("b")
    close = F.bit_count(F.col("a.y").bitwiseXOR(F.col("b.y"))) <= radius
    met = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.y") < F.col("b.y")) & close)
    links = met.select(F.col("a.i").alias("i"), F.col("a.first").alias("u"), F.col("b.first").alias("v")).where("u <> v").distinct()
    found = grouped(links).withColumnRenamed("x", "first")
    known = labels.join(found, ["i", "first"], "left").where("n > 1 OR component IS NOT NULL").select("i", "y", F.coalesce("component", "first").alias("component"))
    return points.join(known, ["i", "y"]).groupBy(F.col("i").alias(instance), "x").agg(F.min("component").alias("component"))


def grouped(links: DataFrame) -> DataFrame:
    """(i, x, component) of links (i, u, v): labels fall to the smallest neighbour's, and jump to their label's label."""
    both = written(links.union(links.select("i", F.col("v").alias("u"), F.col("u").alias("v"))), "links")
    labels = written(both.groupBy("i", F.col("u").alias("x")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        near = both.join(labels.select("i", F.col("x").alias("v"), "component"), ["i", "v"]).groupBy("i", F.col("u").alias("x")).agg(F.min("component").alias("near"))
        moved = labels.join(near, ["i", "x"]).select("i", "x", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = moved.select("i", F.col("x").alias("component"), F.col("component").alias("further"))
        after = written(moved.join(jump, ["i", "component"]).select("i", "x", F.least("component", "further").alias("component"), "before"), "labels")
        changed = after.where("component <> before").limit(1).count()
        labels = after.drop("before")
        if not changed:
            return labels


def recall(rows: DataFrame, matched: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.col(matched).cast("double")).alias("recall"), F.count("*").alias("n"))


def verdicts(rows: DataFrame, sizes: list[int], least: float, textbook: list[str]) -> DataFrame:
    """Per protocol and family: least recall over the sizes among even seeds (discovery) and odd ones (confirmation), null
    where a size is missing; a candidate holds on discovery and is no textbook protocol, a confirmed one holds on both."""
    fold = F.when(F.col("seed") % 2 == 0, "discovery").otherwise("confirmatory")
    rates = rows.where(F.col("size").isin(sizes)).groupBy("protocol", "family", "size", fold.alias("fold")).agg(F.avg(F.col("matched").cast("double")).alias("rate"))
    held = lambda f: F.when(F.count(F.when(F.col("fold") == f, 1)) == len(sizes), F.min(F.when(F.col("fold") == f, F.col("rate"))))
    per = rates.groupBy("protocol", "family").agg(held("discovery").alias("discovery"), held("confirmatory").alias("confirmatory"))
    candidate = F.coalesce((F.col("discovery") >= least) & ~F.col("protocol").isin(textbook), F.lit(False))
    return per.withColumn("candidate", candidate).withColumn("confirmed", candidate & F.coalesce(F.col("confirmatory") >= least, F.lit(False)))


def near_pair_values(groups: DataFrame, instance: str, x: str, op: str, modulus: int) -> DataFrame:
    """(instance, value) of near groups: the smallest x of a component, which names it, with every other; zeros are dropped."""
    rest = groups.where(F.col(x) != F.col("component"))
    return combined(rest.select(instance, F.col("component").alias("base"), F.col(x).alias("other")), instance, op, modulus)


def closed_values(tape: DataFrame, instance: str, x: str, y: str, bits: int) -> DataFrame:
    """(instance, values): the largest set of low bits, relative to a label's smallest x, that is closed under xor. A set has
    at most 2^bits numbers; of equally large ones the first label's stays."""
    mask = (1 << bits) - 1
    points = tape.select(instance, y, x).distinct()
    base = points.groupBy(instance, y).agg(F.min(x).alias("_b"), F.count("*").alias("_n")).where("_n > 1")
    low = F.col(x).bitwiseXOR(F.col("_b")).bitwiseAND(F.lit(mask))
    sets = points.join(base, [instance, y]).groupBy(instance, y).agg(F.array_sort(F.collect_set(low)).alias("values"))  # the base itself gives zero

    def closed(values: Column) -> Column:
        return F.forall(values, lambda a: F.forall(values, lambda b: F.array_contains(values, a.bitwiseXOR(b))))

    good = sets.where((F.size("values") > 1) & closed(F.col("values")))
    return good.groupBy(instance).agg(F.min(F.struct((-F.size("values")).alias("s"), y, "values"))["values"].alias("values"))


def recurrence_verdict(rows: DataFrame, largest_size: int) -> DataFrame:
    """Whether orders are finite and stable: (median_order, ratio, met) over rows that are eligible for identification."""
    able = rows.where("identification_eligible")
    median = F.median("estimated_order")
    ratio = median / F.lit(float(2**largest_size))
    met = (median <= 32) & (ratio < 1e-6) & (F.min(F.coalesce("withheld_stable", F.lit(False)).cast("int")) >= 1)
    return able.agg(F.count("*").alias("n"), median.alias("median_order"), ratio.alias("ratio"), F.coalesce(met, F.lit(False)).alias("met"))
