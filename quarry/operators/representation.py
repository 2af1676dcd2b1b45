"""Representations of vectors as array expressions: encodings, their cost, and the choice among candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import energy, total
from quarry.operators.models import gram

NEGLIGIBLE = 1e-6


def complexity(encoded: Column) -> Column:
    """Number of elements that are not negligible."""
    return F.size(F.filter(encoded, lambda x: F.abs(x) > NEGLIGIBLE)).cast("long")


def difference(v: Column) -> Column:
    """First value, then the steps between neighbours."""
    return F.transform(v, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(v, i - 1)))


def undifference(steps: Column) -> Column:
    """Running sums: the inverse of difference."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"] + x).alias("out"))
    return F.aggregate(steps, start, step, lambda s: s["out"])


def sorted_permutation(v: Column) -> Column:
    """Pairs (value, place it came from) in order of value."""
    return F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def unsorted(ordered: Column) -> Column:
    """Values put back in their places: the inverse of sorted_permutation."""
    return F.transform(F.array_sort(F.transform(ordered, lambda p: F.struct(p["i"], p["x"]))), lambda p: p["x"])


def permutation_breaks(ordered: Column) -> Column:
    """Places where the permutation does not go on to the next element."""
    inner = F.sequence(F.lit(1), F.size(ordered) - 1)
    return F.size(F.filter(inner, lambda j: F.get(ordered, j)["i"] != F.get(ordered, j - 1)["i"] + 1)).cast("long")


def cosine_shape(x: np.ndarray, first: int = 8) -> dict[str, np.ndarray]:
    """Of the orthonormal cosine transform of the rows: coefficients that are not negligible, energy, and the share of the
    first ones."""
    c = x @ cosine_basis(x.shape[1]).T
    energies = (c * c).sum(1)
    return {
        "needed": (np.abs(c) > NEGLIGIBLE).sum(1).astype(float), "energy": energies,
        "leading": np.where(energies > 0, (c[:, :first] ** 2).sum(1) / np.where(energies > 0, energies, 1), np.nan),
    }


def period_shape(x: np.ndarray, top: int = 1) -> dict[str, np.ndarray]:
    """Share of the varying energy in the strongest frequencies of each row."""
    power = np.sort(np.abs(np.fft.rfft(x)[:, 1:]) ** 2, axis=1)[:, ::-1]
    held = power.sum(1)
    return {"periodicity": np.where(held > 0, power[:, :top].sum(1) / np.where(held > 0, held, 1), np.nan)}


def leading_energy(encoded: Column, first: int) -> Column:
    return energy(F.slice(encoded, 1, first)) / F.nullif(energy(encoded), F.lit(0.0))


def encodings(v: Column) -> dict[str, tuple[Column, Column, Column]]:
    """(encoding, its inverse, extra elements) by name."""
    return {
        "identity": (v, v, F.lit(0)),
        "difference": (difference(v), undifference(difference(v)), F.lit(0)),
        # a permutation costs an element wherever it does not go on to the next one
        "sorted_permutation": (F.transform(sorted_permutation(v), lambda p: p["x"]), unsorted(sorted_permutation(v)), permutation_breaks(sorted_permutation(v))),
    }


def encoding_cells(v: Column) -> Column:
    """Of each encoding: its name, the share of elements needed, the largest error of its inverse."""
    worst = lambda back: F.array_max(F.zip_with(back, v, lambda a, b: F.abs(a - b)))
    return F.array(*[
        F.struct(((complexity(e) + extra) / F.size(v)).alias("share"), F.lit(i).alias("place"), F.lit(name).alias("encoding"), worst(back).alias("error"))
        for i, (name, (e, back, extra)) in enumerate(encodings(v).items())
    ])


def ranked_encodings(df: DataFrame, vector: str) -> DataFrame:
    """Per encoding: the mean share of elements needed and the largest error of its inverse, cheapest verified first."""
    per = df.select(F.explode(encoding_cells(F.col(vector))).alias("c")).select("c.*").groupBy("encoding")
    return per.agg(F.avg("share").alias("share"), (F.max("error") <= 1e-6).alias("verified"), F.count("*").alias("n"))


def best_encoding(df: DataFrame, vector: str, tolerance: float = 1e-6) -> DataFrame:
    """df with the cheapest encoding of each vector whose inverse holds, and its share; ties to the plainer. Null where the
    vector is null or empty."""
    verified = F.filter(encoding_cells(F.col("_v")), lambda c: c["error"] <= tolerance)
    found = df.withColumn("_v", F.col(vector).cast("array<double>")).withColumn("_best", F.array_min(verified))
    return found.withColumn("encoding", F.col("_best")["encoding"]).withColumn("share", F.col("_best")["share"]).drop("_v", "_best")


def canonical(df: DataFrame, by: str, order: list[str], identity: str) -> DataFrame:
    """The first candidate of each group by its objectives, ties by identity."""
    least = F.min(F.struct(*order, identity)).alias("best")
    return df.groupBy(by).agg(least).select(by, *[F.col(f"best.{c}").alias(c) for c in [*order, identity]])


def weighted_score(weights: dict[str, float]) -> Column:
    """Higher is better: the weighted sum of objectives to be small, negated."""
    return -sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


#: Encodings on stacked rows: (encode, decode, extra cost in elements for each row).
def walk(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)


@lru_cache(8)
def cosine_basis(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (i + 0.5) * k / n) * np.where(k == 0, (1 / n) ** 0.5, (2 / n) ** 0.5)


def real_fourier(x: np.ndarray) -> np.ndarray:
    """Cosine parts, then sine parts, orthonormal up to the ends."""
    c = np.fft.rfft(x, norm="ortho")
    n = x.shape[1]
    return np.concatenate([c.real, c.imag[:, 1 : (n + 1) // 2]], axis=1)


def from_real_fourier(e: np.ndarray) -> np.ndarray:
    n = e.shape[1]
    c = e[:, : n // 2 + 1].astype(complex)
    c[:, 1 : (n + 1) // 2] += 1j * e[:, n // 2 + 1 :]
    return np.fft.irfft(c, n, norm="ortho")


STEPS = {
    "difference": (walk, lambda e: np.cumsum(e, axis=1)),
    "dct": (lambda x: x @ cosine_basis(x.shape[1]).T, lambda e: e @ cosine_basis(e.shape[1])),
    "dft": (real_fourier, from_real_fourier),
}
SORTED = "sorted_permutation"


def encoded(x: np.ndarray, chain: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(encoding, extra elements by row, largest error of the inverse by row) of a chain of encodings."""
    e, extra, undo = x, np.zeros(len(x)), []
    for name in chain:
        if name == SORTED:
            order = np.argsort(e, axis=1, kind="stable")
            e = np.take_along_axis(e, order, 1)
            extra = extra + (np.diff(order, axis=1) != 1).sum(1)
            undo.append(order)
        elif name != "identity":
            e = STEPS[name][0](e)
            undo.append(None)
        else:
            undo.append(None)
    back = e
    for name, order in zip(reversed(chain), reversed(undo), strict=True):
        if name == SORTED:
            out = np.empty_like(back)
            np.put_along_axis(out, order, back, 1)
            back = out
        elif name != "identity":
            back = STEPS[name][1](back)
    return e, extra, np.abs(back - x).max(1)


def chains(depth: int) -> list[tuple[str, ...]]:
    """Chains of encodings up to a depth, without a repeat of one after itself; identity stands alone."""
    names = [*STEPS, SORTED]
    found: list[tuple[str, ...]] = [("identity",)]
    last: list[tuple[str, ...]] = [()]
    for _ in range(depth):
        last = [(*c, n) for c in last for n in names if not c or c[-1] != n]
        found += last
    return found


def search_chains(df: DataFrame, vector: str, train: Column, depth: int, tolerance: float = 1e-6) -> DataFrame:
    """(encoding, share, holdout_share, error, verified): mean share of elements that are not negligible, by half; verified
    if the inverse holds on every vector. One pass over the vectors for all chains; verified ones first, then the cheapest."""
    tried = chains(depth)
    schema = "encoding string, train boolean, n long, share double, error double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            sizes = batch["v"].map(len)
            for (side, size), part in batch.groupby([batch["train"], sizes]):
                if not size:
                    continue
                x = np.stack(part["v"].to_list())
                for chain in tried:
                    e, extra, error = encoded(x, chain)
                    share = float((((np.abs(e) > NEGLIGIBLE).sum(1) + extra) / size).sum())
                    n, s, w = held.get((chain, side), (0, 0.0, 0.0))
                    held[chain, side] = n + len(x), s + share, max(w, float(error.max()))
        yield pd.DataFrame([("+".join(c), bool(side), n, s, w) for (c, side), (n, s, w) in held.items()], columns=[c.split()[0] for c in schema.split(", ")])

    v = F.col(vector).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    parts = df.where(usable).select(v.alias("v"), train.alias("train")).mapInPandas(run, schema)
    mean = lambda side: F.sum(F.when(F.col("train") == side, F.col("share"))) / F.sum(F.when(F.col("train") == side, F.col("n")))
    found = parts.groupBy("encoding").agg(mean(True).alias("share"), mean(False).alias("holdout_share"), F.max("error").alias("error"))
    found = found.withColumn("verified", F.col("error") <= tolerance)
    return found.orderBy(F.desc("verified"), "holdout_share", "encoding").select("encoding", "share", "holdout_share", "verified")


def fourier(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """(keep..., k, re, im): complex Fourier coefficients 0 to n / 2 of each vector."""

    @F.pandas_udf("array<struct<k:int,re:double,im:double>>")
    def transform(values: pd.Series) -> pd.Series:
        out = [None if v is None or not len(v) else np.fft.rfft(np.asarray(v, dtype=float)) for v in values]
        return pd.Series([None if c is None else [{"k": k, "re": z.real, "im": z.imag} for k, z in enumerate(c)] for c in out], index=values.index)

    return df.select(*keep, F.explode(transform(F.col(vector).cast("array<double>"))).alias("c")).select(*keep, "c.*")


def squares(df: DataFrame, vector: str) -> DataFrame:
    """(v, side): vectors of finite values with their side as a square matrix, 0 for those that are none."""
    v = F.col(vector).cast("array<double>")
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    root = F.round(F.sqrt(F.size("v"))).cast("int")
    return df.where(usable).select(v.alias("v")).withColumn("side", F.when(root * root == F.size("v"), root).otherwise(0))


def stacked(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(side, matrices) of each side in a batch; side 0 has no matrix."""
    for side, part in batch.groupby("side"):
        yield int(side), np.stack(part["v"].to_list()).reshape(len(part), side, side) if side else np.zeros((len(part), 0, 0))


def structure(df: DataFrame, vector: str, least: float = 0.1) -> DataFrame:
    """Of vectors as square matrices, a row for each side: the mean singular profile gives an effective rank (singular values above
    `least` of the first) and whether that is low (at most half the side, one at least) or one; energy off the diagonal in the
    Fourier basis. (side, n, effective_rank, low_rank, separable, off_diagonal, dual). Finite vectors that are no square, and
    empty ones, are counted as side 0."""
    schema = "side int, n long, profile array<double>, off_diagonal double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for side, m in stacked(batch):
                own = held.setdefault(side, [0, np.zeros(side), 0.0])
                own[0] += len(m)
                if side:
                    s = np.linalg.svd(m, compute_uv=False)
                    own[1] += (s / np.maximum(s[:, :1], 1e-300)).sum(0)
                    norm = np.maximum(np.sqrt((m * m).sum((1, 2))), 1e-300)
                    f = np.fft.fft(np.eye(side), norm="ortho")
                    turned = f @ m @ f.conj().T
                    own[2] += float((np.sqrt((np.abs(turned * ~np.eye(side, dtype=bool)) ** 2).sum((1, 2))) / norm).sum())
        yield pd.DataFrame([(side, n, list(p), off) for side, (n, p, off) in held.items()], columns=[c.split()[0] for c in schema.split(", ")])

    parts = squares(df, vector).mapInPandas(run, schema)
    places = parts.select("side", "n", F.posexplode_outer("profile").alias("i", "p")).groupBy("side", "i").agg((F.sum("p") / F.sum("n")).alias("p"))
    profile = places.groupBy("side").agg(F.count(F.when(F.col("p") > least, 1)).alias("effective_rank"), F.coalesce(F.max(F.when(F.col("i") == 1, F.col("p"))), F.lit(0.0)).alias("second"))
    sums = parts.groupBy("side").agg(F.sum("n").alias("n"), (F.sum("off_diagonal") / F.sum("n")).alias("off_diagonal"))
    square = F.col("side") > 0
    limit = F.greatest(F.lit(1), F.floor(F.col("side") / 2))
    return sums.join(profile, "side").select(
        "side", "n", F.when(square, F.col("effective_rank")).alias("effective_rank"), F.when(square, F.col("effective_rank") <= limit).alias("low_rank"),
        F.when(square, F.col("second") <= least).alias("separable"), F.when(square, F.col("off_diagonal")).alias("off_diagonal"), F.when(square, F.col("off_diagonal") <= 0.05).alias("dual"),
    )


def rotations(n: int) -> list[list[int]]:
    """The cyclic group on n places."""
    return [[(i + s) % n for i in range(n)] for s in range(n)]


def conservation(df: DataFrame, vector: str, group: Callable[[int], list[list[int]]] = rotations, threshold: float = 0.05) -> DataFrame:
    """(side, n, elements, deviation, conserved): mean relative distance of square matrices from the average over a group's
    orbit, rows and columns permuted alike, a row for each side. group: the permutations of so many places, as index lists.
    A zero matrix deviates by 0. Finite vectors that are no square are counted as side 0."""
    schema = "side int, n long, elements long, deviation double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[int, np.ndarray] = {}
        held: dict[int, list] = {}
        for batch in batches:
            for side, m in stacked(batch):
                own = held.setdefault(side, [0, 0.0])
                own[0] += len(m)
                if side:
                    if side not in tables:
                        p = np.asarray(group(side))
                        tables[side] = (p[:, :, None] * side + p[:, None, :]).reshape(len(p), -1)  # places of the permuted cells
                    x = m.reshape(len(m), -1)
                    mean = sum(x[:, cells] for cells in tables[side]) / len(tables[side])
                    norm = np.sqrt((x * x).sum(1))
                    own[1] += float((np.sqrt(((x - mean) ** 2).sum(1)) / np.where(norm > 0, norm, 1)).sum())
        rows = [(side, n, len(tables.get(side, ())), away) for side, (n, away) in held.items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    parts = squares(df, vector).mapInPandas(run, schema)
    mean = F.when(F.col("side") > 0, F.sum("deviation") / F.sum("n"))
    found = parts.groupBy("side").agg(F.sum("n").alias("n"), F.max("elements").alias("elements"), mean.alias("deviation"))
    return found.withColumn("conserved", F.col("deviation") <= threshold)


def polynomial(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, values, bounds): each row's polynomial through nodes 0, 1, ..., by rising powers; its values at the nodes
    again, by Horner's rule; and a running bound of the error of these values.

    Divided differences at whole nodes are differences over whole numbers. Every operation adds the rounding of its result to
    the bound and passes on the bounds of its operands, so that an ill-conditioned length has a large bound, not a wrong claim."""
    unit = np.finfo(float).eps / 2
    m, n = x.shape
    d, e = x.astype(float).copy(), np.zeros((m, n))
    for k in range(1, n):
        up = (d[:, k:] - d[:, k - 1 : -1]) / k
        e[:, k:] = (e[:, k:] + e[:, k - 1 : -1]) / k + 2 * unit * np.abs(up)
        d[:, k:] = up
    c, b = np.zeros((m, n)), np.zeros((m, n))
    for k in range(n - 1, -1, -1):  # times (t - k), plus the difference of order k
        c2, b2 = np.zeros((m, n)), np.zeros((m, n))
        c2[:, 1:], b2[:, 1:] = c[:, :-1], b[:, :-1]
        moved = k * c
        b2 += k * b + unit * np.abs(moved)
        c2 -= moved
        b2 += unit * np.abs(c2)
        c2[:, 0] += d[:, k]
        b2[:, 0] += e[:, k] + unit * np.abs(c2[:, 0])
        c, b = c2, b2
    t = np.arange(n, dtype=float)
    value, bound = np.zeros((m, n)), np.zeros((m, n))
    for k in range(n - 1, -1, -1):
        product = value * t
        value = product + c[:, k : k + 1]
        bound = bound * t + b[:, k : k + 1] + unit * (np.abs(product) + np.abs(value))
    return c, value, bound


def polynomial_roundtrip(df: DataFrame, vector: str, tolerance: float = 1e-6) -> DataFrame:
    """(length, n, ill_conditioned, verified, error, share): by length of the vectors, how many have an error bound above the
    tolerance; whether all others come back within it; the largest error of these; and the mean share of coefficients that are
    not negligible. Vectors that are null, empty or not finite are left out."""
    schema = "length int, n long, ill_conditioned long, error double, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for length, part in batch.groupby(batch["v"].map(len)):
                x = np.stack(part["v"].to_list())
                c, back, bound = polynomial(x)
                sound = bound.max(1) <= tolerance
                own = held.setdefault(int(length), [0, 0, 0.0, 0.0])
                own[0] += len(x)
                own[1] += int((~sound).sum())
                own[2] = max(own[2], float(np.abs(back - x)[sound].max(initial=0.0)))
                own[3] += float((np.abs(c) > NEGLIGIBLE).mean(1).sum())
        yield pd.DataFrame([(k, *v) for k, v in held.items()], columns=[c.split()[0] for c in schema.split(", ")])

    v = F.col(vector).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    parts = df.where(usable).select(v.alias("v")).mapInPandas(run, schema)
    found = parts.groupBy("length").agg(F.sum("n").alias("n"), F.sum("ill_conditioned").alias("ill_conditioned"), F.max("error").alias("error"), (F.sum("share") / F.sum("n")).alias("share"))
    return found.select("length", "n", "ill_conditioned", (F.col("error") <= tolerance).alias("verified"), "error", "share")


def klt(df: DataFrame, vector: str, most: int) -> DataFrame:
    """(place, eigenvalue, held): eigenvalues of the second moments without centring, and the share of energy held so far."""
    v = F.col(vector).cast("array<double>")
    n, g = gram(df.select(v.alias("v")).where("v IS NOT NULL"), ["v"])
    values = np.clip(np.linalg.eigvalsh(g)[::-1], 0, None) / max(n - 1, 1) if n else np.zeros(0)
    held = np.cumsum(values) / values.sum() if len(values) and values.sum() > 0 else values
    return df.sparkSession.createDataFrame([(k, float(values[k]), float(held[k])) for k in range(min(most, len(values)))], "place int, eigenvalue double, held double")


#: Floating-point operations of each stage for n elements, up to a constant.
COSTS = {"identity": "0", "matrix_reshape": "0", "difference": "n", "sorted_permutation": "n * log2(n)", "dft": "n * log2(n)", "dft_full": "n * log2(n)", "dct": "n * n", "polynomial_vandermonde": "n * n"}


def computational_cost(stages: Column, n: Column) -> Column:
    """Summed cost of a `+`-joined chain; an unknown stage is an error."""
    n = F.greatest(n.cast("double"), F.lit(2.0))
    forms = {"0": F.lit(0.0), "n": n, "n * log2(n)": n * F.log2(n), "n * n": n * n}
    prices = F.create_map(*[x for name, form in COSTS.items() for x in (F.lit(name), forms[form])])
    unknown = F.raise_error(F.concat(F.lit("unknown stage in "), stages)).cast("double")
    return total(F.transform(F.split(stages, r"\+"), lambda s: F.coalesce(F.try_element_at(prices, s), unknown)))
