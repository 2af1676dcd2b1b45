"""Screens on held-out families: frozen thresholds, nearest classes, pairing shapes, rank checks.

Rows have a family, a size and a rate. What counts are finite values; a mean or share over none is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite, pearson
from quarry.operators.statistics import quantiles, spearman
from quarry.sources.steps import written


def threshold_from_random(rows: DataFrame, rate: str, family: str, controls: list[str], q: float = 0.99) -> DataFrame:
    """(threshold, n): the q quantile of the controls' rates; 0 without any."""
    found = quantiles(rows.where(F.col(family).isin(controls)), [], F.col(rate), q)
    return found.agg(F.coalesce(F.max("quantile"), F.lit(0.0)).alias("threshold"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def heldout_screen(
    rows: DataFrame, rate: str, target: str, family: str, size: str, discovery: list[str], held_out: list[str], controls: list[str],
    least_r: float = 0.35, least_recall: float = 0.8, most_fpr: float = 0.05,
) -> DataFrame:
    """Per size: (size, n_held_out, n_random, recall, fpr, threshold, discovery_r, passed). The threshold is frozen on the controls
    among the discovery families, over all sizes; recall is the share of held-out rates above it, fpr that of the controls.
    passed, the same in each row: |r| of rate and target among discovery rows, and every size's recall and fpr, reach their
    bounds; a size where either is unknown fails."""
    known = rows.where(F.col(family).isin(discovery))
    one = threshold_from_random(known, rate, family, controls).select("threshold")
    r = known.agg(F.coalesce(F.abs(pearson(F.col(rate), F.col(target))), F.lit(0.0)).alias("discovery_r"))
    frozen = one.join(F.broadcast(r), on=F.lit(True))  # one row each
    x = finite(F.col(rate))
    above = (x > F.col("threshold")).cast("double")
    held, random = F.col(family).isin(held_out), F.col(family).isin(discovery) & F.col(family).isin(controls)
    per = rows.where(F.col(size).isNotNull()).join(F.broadcast(frozen), on=F.lit(True)).groupBy(F.col(size).alias("size"), "threshold", "discovery_r").agg(
        F.count(F.when(held, x)).alias("n_held_out"), F.count(F.when(random, x)).alias("n_random"),
        F.avg(F.when(held, above)).alias("recall"), F.avg(F.when(random, above)).alias("fpr"),
    )
    good = F.coalesce((F.col("recall") >= least_recall) & (F.col("fpr") <= most_fpr), F.lit(False))
    whole = per.agg((F.min(good.cast("int")) == 1).alias("good"))
    out = per.join(F.broadcast(whole), on=F.lit(True)).withColumn("passed", F.col("good") & (F.col("discovery_r") >= least_r))
    return out.select("size", "n_held_out", "n_random", "recall", "fpr", "threshold", "discovery_r", "passed")


def pairing_shape(rows: DataFrame, rate: str, span: str, family: str, size: str, rank: str, families: list[str] | None = None) -> DataFrame:
    """Means by family and size, and by rank and size, from one scan: (by, size, family, rank, n, n_collision, n_span,
    mean_collision, mean_span, hit). hit: share of rates above 0. A null span is missing, not zero; rows without a finite rank are
    in no rank. families: those that count by family, all if none are given."""
    x, s, place = finite(F.col(rate)), finite(F.col(span)), F.floor(finite(F.col(rank)))
    cut = rows.where(F.col(size).isNotNull()).select(F.col(size).alias("size"), F.col(family).alias("family"), place.alias("rank"), x.alias("x"), s.alias("s"))
    grouped = cut.groupingSets([["size", "family"], ["size", "rank"]], "size", "family", "rank").agg(
        F.grouping("rank").alias("by_family"), F.count("*").alias("n"), F.count("x").alias("n_collision"), F.count("s").alias("n_span"),
        F.avg("x").alias("mean_collision"), F.avg("s").alias("mean_span"), F.avg((F.col("x") > 0).cast("double")).alias("hit"),
    )
    by_family = F.col("by_family") == 1
    kept = F.when(by_family, F.col("family").isin(families) if families is not None else F.lit(True)).otherwise(F.col("rank").isNotNull())
    return grouped.where(kept).select(F.when(by_family, "family").otherwise("rank").alias("by"), "size", "family", "rank", "n", "n_collision", "n_span", "mean_collision", "mean_span", "hit")


def class_screen(rows: DataFrame, features: list[str], family: str, size: str, classes: list[str], expected: dict[str, str], least_recall: float = 0.8) -> DataFrame:
    """Nearest class by size: (size, n_held_out, correct, recall, passed). A class's centre is its rows' mean of each feature (what is
    not finite counts 0); a held-out row belongs to the nearest centre of its size, ties to the class that comes first in
    `classes`, and is right if that is `expected` of its family. Sizes without a centre decide nothing. passed, the same in each
    row: every size's recall reaches the bound."""
    at = [F.coalesce(finite(F.col(f)), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)]
    xs = [f"_x{i}" for i in range(len(features))]
    points = rows.where(F.col(size).isNotNull()).select(F.col(size).alias("size"), F.col(family).alias("family"), *at)
    order = F.element_at(F.create_map(*[v for i, c in enumerate(classes) for v in (F.lit(c), F.lit(i))]), F.col("family"))
    means = points.where(F.col("family").isin(classes)).groupBy("size", "family").agg(*[F.avg(x).alias(x) for x in xs])
    # a size has one row of centres: a number of classes, whatever the rows
    centres = means.groupBy("size").agg(F.collect_list(F.struct(order.alias("place"), "family", *xs)).alias("centres"))
    away = lambda c: F.sqrt(sum(((c[x] - F.col(x)) * (c[x] - F.col(x)) for x in xs), F.lit(0.0)))
    nearest = F.array_min(F.transform("centres", lambda c: F.struct(away(c).alias("d"), c["place"].alias("place"), c["family"].alias("family"))))["family"]
    wanted = reduce(lambda found, pair: F.when(F.col("family") == pair[0], pair[1]).otherwise(found), expected.items(), F.lit(None).cast("string"))
    held = points.where(F.col("family").isin(list(expected))).join(centres, "size").select("size", (nearest == wanted).alias("right"))
    per = held.groupBy("size").agg(F.count("*").alias("n_held_out"), F.count(F.when(F.col("right"), 1)).alias("correct"))
    sizes = points.select("size").distinct().join(per, "size", "left")
    recall = F.col("correct") / F.nullif("n_held_out", F.lit(0))
    found = sizes.select("size", F.coalesce("n_held_out", F.lit(0)).alias("n_held_out"), F.coalesce("correct", F.lit(0)).alias("correct"), recall.alias("recall"))
    whole = found.agg((F.min(F.coalesce(F.col("recall") >= least_recall, F.lit(False)).cast("int")) == 1).alias("passed"))
    return found.join(F.broadcast(whole), on=F.lit(True))


#: Lanczos coefficients of the logarithm of the gamma function.
LANCZOS = [76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5]


def log_gamma(x: Column) -> Column:
    base = x + 5.5
    series = sum((F.lit(c) / (x + i + 1) for i, c in enumerate(LANCZOS)), F.lit(1.000000000190015))
    return -(base - (x + 0.5) * F.log(base)) + F.log(F.lit(2.5066282746310005) * series / x)


def student_p(t: Column, freedom: Column, terms: int = 60) -> Column:
    """Two-sided p value of Student's t: a regularised incomplete beta function by its continued fraction, evaluated backwards."""
    a, b, x = freedom / 2, F.lit(0.5), freedom / (freedom + t * t)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(value: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / value

        return F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(1.0), step)

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    direct = front / a / fraction(a, b, x)
    mirrored = 1 - front / b / fraction(b, a, 1 - x)
    whole = F.when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)
    return F.when(t == 0, 1.0).when(x <= 0, 0.0).otherwise(F.least(F.greatest(whole, F.lit(0.0)), F.lit(1.0)))


def preregistered_check(rows: DataFrame, strength: str, complexity: str, winner: str, trivial: str, least_rho: float = 0.3, most_p: float = 0.05) -> DataFrame:
    """(n, rho, p, detected, trivial_wins): whether strength and complexity are related by rank as fixed beforehand, and the share of
    rows that the trivial representation wins."""
    rows = written(rows.select(F.col(strength), F.col(complexity), F.col(winner)), "strengths")
    share = rows.agg(F.avg((F.col(winner) == trivial).cast("double")).alias("trivial_wins"))
    found = spearman(rows, strength, complexity).withColumn("p", F.when(F.abs("rho") < 1, student_p(F.col("t"), F.col("n") - F.lit(2.0))).when(F.col("rho").isNotNull(), 0.0))
    detected = F.coalesce((F.abs("rho") > least_rho) & (F.col("p") < most_p), F.lit(False))
    return found.join(F.broadcast(share), on=F.lit(True)).select("n", "rho", "p", detected.alias("detected"), "trivial_wins")
