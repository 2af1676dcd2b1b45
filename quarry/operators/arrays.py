"""Array descriptors by higher-order functions: no shuffle, one row in and one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import energy, gini, total


def moments(v: Column) -> dict[str, Column]:
    n = F.size(v)
    return {"count": n.cast("long"), "mean": total(v) / n, "std": F.sqrt(F.greatest(F.lit(0.0), energy(v) / n - F.pow(total(v) / n, 2))), "low": F.array_min(v), "high": F.array_max(v)}


def bound(value: Column, use) -> Column:
    """use(value) with the value bound to a variable, so that it is evaluated once for each array and not for each element."""
    return F.transform(F.array(value), use)[0]


def centred(v: Column) -> Column:
    return bound(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))


def entropy(v: Column) -> Column:
    """Shannon entropy in nats of the squared weights."""

    def of(e: Column) -> Column:
        parts = F.transform(v, lambda x: F.when(x * x > 0, x * x / e * F.log(x * x / e)).otherwise(0.0))
        return F.when(e > 0, -total(parts))

    return bound(energy(v), of)


def participation(v: Column) -> Column:
    """Inverse participation: (sum of squares)^2 over the sum of fourth powers."""
    return F.pow(energy(v), 2) / F.nullif(energy(F.transform(v, lambda x: x * x)), F.lit(0.0))


def hoyer(v: Column) -> Column:
    n = F.sqrt(F.size(v).cast("double"))
    one = F.aggregate(F.transform(v, lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x)
    return (n - one / F.nullif(F.sqrt(energy(v)), F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0))


def autocorrelation(v: Column, lag: int) -> Column:
    return bound(centred(v), lambda c: lagged(c, lag))


def lagged(c: Column, lag: int) -> Column:
    pairs = F.zip_with(F.slice(c, 1, F.size(c) - lag), F.slice(c, lag + 1, F.size(c) - lag), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.nullif(energy(c), F.lit(0.0))


def local_minima(v: Column) -> Column:
    """Elements at most as large as both neighbours; an end has itself for the missing one."""
    n = F.size(v)
    at = lambda i: F.get(v, F.least(F.greatest(i, F.lit(0)), n - 1))
    low = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(v, i) <= at(i - 1)) & (F.get(v, i) <= at(i + 1)))
    return F.when(n <= 2, F.least(n, F.lit(1))).otherwise(F.size(low)).cast("long")


def topk_energy(v: Column, k: int) -> Column:
    squares = F.reverse(F.array_sort(F.transform(v, lambda x: x * x)))
    return total(F.slice(squares, 1, k)) / F.nullif(energy(v), F.lit(0.0))


def pnorm(v: Column, p: float) -> Column:
    return F.pow(F.aggregate(F.transform(v, lambda x: F.pow(F.abs(x), p)), F.lit(0.0), lambda s, x: s + x), 1 / p)


#: Levels above the minimum, as shares of the span, at which mass is taken.
LEVELS = (0.1, 0.25, 0.5)


def level_mass(v: Column, level: float) -> Column:
    """Share of elements at most that level above the minimum."""
    low, high = F.array_min(v), F.array_max(v)
    return F.size(F.filter(v, lambda x: x <= low + level * (high - low))) / F.nullif(F.size(v), F.lit(0))


def hamming_correlation(v: Column) -> Column:
    """Correlation of the elements with the number of one bits in their place."""
    ones = F.transform(v, lambda x, i: F.bit_count(i).cast("double"))
    a, b = centred(v), centred(ones)
    return bound(a, lambda a: bound(b, lambda b: total(F.zip_with(a, b, lambda x, y: x * y)) / F.nullif(F.sqrt(energy(a) * energy(b)), F.lit(0.0))))


def walsh(v: Column, size: int) -> Column:
    """Orthonormal Walsh-Hadamard spectrum: a butterfly of whole-array expressions for each level."""
    step = 1
    while step < size:
        v = butterfly(v, size, step)
        step *= 2
    return F.transform(v, lambda x: x / size**0.5)


def butterfly(v: Column, size: int, step: int) -> Column:
    """One level. The array is bound to a variable, so that the levels below are evaluated once."""

    def level(a: Column) -> Column:
        plus = lambda i: F.get(a, i) + F.get(a, i + step)
        minus = lambda i: F.get(a, i - step) - F.get(a, i)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i.bitwiseAND(F.lit(step)) == 0, plus(i)).otherwise(minus(i)))

    return F.transform(F.array(v), level)[0]


def described(df: DataFrame, vector: str, keep: list[str], descriptors: dict[str, Column]) -> DataFrame:
    doubles = df.withColumn(vector, F.col(vector).cast("array<double>"))
    return doubles.select(*keep, *[c.alias(n) for n, c in descriptors.items()])


DESCRIPTORS = {"entropy": entropy, "gini": gini, "hoyer": hoyer, "participation": participation}
