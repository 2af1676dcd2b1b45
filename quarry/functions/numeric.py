"""Column functions with one null policy: what is not finite is null, and a statistic without its conditions is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUGE = 1e100


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), x)  # NaN counts as larger than every number


def pair(x: Column, y: Column) -> tuple[Column, Column]:
    x, y = finite(x), finite(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Correlation of the pairs where both are finite; null for too few pairs, no spread or a value of HUGE or more."""
    x, y = pair(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    usable = (F.count(x) >= least) & (F.max(F.greatest(F.abs(x), F.abs(y))) < HUGE) & (spread > 0)
    return F.when(usable, F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)))


def regression_r2(x: Column, y: Column) -> Column:
    """R2 of the line through the pairs where both are finite, under the same conditions."""
    return F.pow(pearson(x, y), 2)


def predictive_r2(predicted: Column, actual: Column) -> Column:
    """1 - squared error over squared spread, for predictions that are given; may be negative."""
    p, a = pair(predicted, actual)
    spread = F.var_pop(a) * F.count(a)
    return F.when(spread > 0, 1 - F.sum((a - p) * (a - p)) / F.nullif(spread, F.lit(0.0)))


def skew(x: Column) -> Column:
    """Population skewness of finite values; null for fewer than three or no spread."""
    x = finite(x)
    return F.when((F.count(x) >= 3) & (F.var_pop(x) > 0), F.skewness(x))


def excess_kurtosis(x: Column) -> Column:
    """Population excess kurtosis of finite values; null for fewer than four or no spread."""
    x = finite(x)
    return F.when((F.count(x) >= 4) & (F.var_pop(x) > 0), F.kurtosis(x))


def slope(y: Column, x: Column) -> Column:
    x, y = pair(x, y)
    return F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0))


def intercept(y: Column, x: Column) -> Column:
    px, py = pair(x, y)
    return F.avg(py) - slope(y, x) * F.avg(px)


def gini(a: Column) -> Column:
    """Gini coefficient of absolute values, from the sorted array."""
    s = F.array_sort(F.transform(a, lambda v: F.abs(v.cast("double"))))
    n = F.size(s)
    total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v)
    weighted = F.aggregate(F.transform(s, lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(total > 0, 2 * weighted / (n * total) - (n + 1) / n)


def energy(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)
