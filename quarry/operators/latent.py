"""Latent codes: principal axes and random features as columns, what they say about a target, and linear operators.

Fits come from one pass of centred moments or Gram sums; only matrices of the size of the columns reach the driver. Codes
are expressions with literal weights, so that scoring needs no join. Rows with a missing column have null codes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite, pearson
from quarry.operators.models import gram, moments
from quarry.operators.representation import STEPS
from quarry.operators.statistics import imputed

SEED = 5


def axes(rows: DataFrame, columns: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, axes as columns, shares of variance): an axis has its largest weight positive."""
    _, means, sums = moments(rows, columns)
    values, vectors = np.linalg.eigh(sums)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(columns))])
    share = values / values.sum() if values.sum() > 0 else values
    return means, (vectors * signs)[:, :most], share[:most]


def weighted(columns: list[str], means: np.ndarray, weights: np.ndarray) -> Column:
    return sum(((finite(F.col(c)) - float(m)) * float(w) for c, m, w in zip(columns, means, weights, strict=True)), F.lit(0.0))


def with_codes(rows: DataFrame, columns: list[str], most: int, prefix: str = "latent.pca") -> tuple[DataFrame, list[str]]:
    """rows with the principal codes of mean-imputed columns, and the codes' names."""
    clean = imputed(rows, columns, [c for c in rows.columns if c not in columns])
    means, vectors, _ = axes(clean, columns, most)
    names = [f"{prefix}_{k}" for k in range(vectors.shape[1])]
    return clean.select("*", *[weighted(columns, means, vectors[:, k]).alias(n) for k, n in enumerate(names)]), names


def correlated(rows: DataFrame, codes: list[str], descriptors: list[str], least: float = 0.2) -> DataFrame:
    """(latent, descriptor, r) of every pair with |r| of at least `least`, strongest first."""
    pairs = [F.struct(F.lit(a).alias("latent"), F.lit(b).alias("descriptor"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a in codes for b in descriptors]
    long = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    found = long.groupBy("latent", "descriptor").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    return found.where(F.abs("r") >= least).orderBy(F.desc(F.abs("r")), "latent", "descriptor")


def coordinates(rows: DataFrame, columns: list[str], target: str, most: int = 16) -> DataFrame:
    """The least number of principal codes whose largest |r| to the target is the largest of all: (k, r, explained)."""
    coded, names = with_codes(rows.select(*columns, target), columns, min(most, len(columns)))
    _, _, share = axes(imputed(rows, columns, []), columns, len(names))
    rs = coded.agg(*[pearson(F.col(f"`{n}`"), F.col(target)).alias(f"r{k}") for k, n in enumerate(names)]).first()
    found = [abs(r) if r is not None else -1.0 for r in rs]
    best = int(np.argmax(found))
    row = (best + 1, found[best] if found[best] >= 0 else None, float(share[: best + 1].sum()))
    return rows.sparkSession.createDataFrame([row], "k int, r double, explained double")


def multi_ridge(rows: DataFrame, features: list[str], targets: list[str], alpha: float = 1e-3) -> DataFrame:
    """(target, term, coefficient, r2) of ridge fits of several targets on the rows where all are finite: one pass for all."""
    n, means, sums = moments(rows, [*features, *targets])
    k = len(features)
    weights = np.linalg.lstsq(sums[:k, :k] + alpha * np.eye(k), sums[:k, k:], rcond=None)[0]
    out = []
    for j, target in enumerate(targets):
        w, yy = weights[:, j], sums[k + j, k + j]
        r2 = float((2 * w @ sums[:k, k + j] - w @ sums[:k, :k] @ w) / yy) if yy > 0 else None
        out += [(target, f, float(c), r2) for f, c in zip(features, w, strict=True)]
        out.append((target, "intercept", float(means[k + j] - w @ means[:k]), r2))
    return rows.sparkSession.createDataFrame(out, "target string, term string, coefficient double, r2 double")


def random_features(rows: DataFrame, columns: list[str], target: str, hidden: int = 16, alpha: float = 1e-3) -> DataFrame:
    """An autoencoder of tanh features with random weights and a ridge decoder: (hidden, reconstruction_mse, target_r2). The
    decoder sees the codes alone."""
    clean = imputed(rows, columns, [target])
    n = clean.count()
    schema = "hidden int, reconstruction_mse double, target_r2 double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    means = clean.agg(*[F.avg(c) for c in columns]).first()
    k = min(hidden, len(columns), max(1, n // 2))
    weights = np.random.default_rng(SEED).normal(scale=0.5, size=(len(columns), k))
    codes = [F.tanh(weighted(columns, np.array(means), weights[:, j])) for j in range(k)]
    whole = clean.select(F.array(F.lit(1.0), *codes).alias("h"), F.array(*[F.col(c) for c in columns]).alias("x"), finite(F.col(target)).alias("t"))
    d = k + 1
    _, g = gram(whole, ["h", "x"])
    decode = np.linalg.solve(g[:d, :d] + alpha * np.eye(d), g[:d, d:])
    left = np.trace(g[d:, d:]) - 2 * np.trace(decode.T @ g[:d, d:]) + np.trace(decode.T @ g[:d, :d] @ decode)
    known = whole.where("t IS NOT NULL").select("h", F.array("t").alias("t"))
    m, g = gram(known, ["h", "t"])
    r2 = None
    if m >= 3:
        beta = np.linalg.solve(g[:d, :d] + alpha * np.eye(d), g[:d, d])
        spread = g[d, d] - g[0, d] ** 2 / m
        r2 = float(1 - (g[d, d] - 2 * beta @ g[:d, d] + beta @ g[:d, :d] @ beta) / spread) if spread > 0 else None
    return rows.sparkSession.createDataFrame([(k, max(float(left), 0.0) / (n * len(columns)), r2)], schema)


def off_diagonal_energy(m: np.ndarray) -> float:
    """Norm of what is off the diagonal, as a share of the whole."""
    norm = np.linalg.norm(m)
    return float(np.linalg.norm(m - np.diag(np.diag(m))) / norm) if norm > 0 else 0.0


def transported(operator: np.ndarray, encode: np.ndarray, decode: np.ndarray) -> np.ndarray:
    """The operator (on columns) seen through an encoding."""
    return encode @ operator @ decode


def bases(n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(encode, decode) matrices of the linear encodings of length n."""
    eye = np.eye(n)
    fourier = np.fft.fft(eye, norm="ortho")
    out = {name: (encode(eye).T, decode(eye).T) for name, (encode, decode) in STEPS.items()}
    return {"identity": (eye, eye), **out, "dft_full": (fourier, fourier.conj().T)}


def diagonalising(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The operator that takes x to y by least squares, ranked by how diagonal each linear encoding makes it: (encoding,
    off_diagonal, residual). Needs as many rows as the vectors are long."""
    schema = "encoding string, off_diagonal double, residual double"
    n, g = gram(rows.where(f"{x} IS NOT NULL AND {y} IS NOT NULL"), [x, y])
    d = len(g) // 2
    if n < max(d, 1):
        return rows.sparkSession.createDataFrame([], schema)
    u = np.linalg.lstsq(g[:d, :d], g[:d, d:], rcond=None)[0].T
    left = np.trace(g[d:, d:]) - 2 * np.trace(u @ g[:d, d:]) + np.trace(u @ g[:d, :d] @ u.T)
    residual = float(max(left, 0.0) / np.trace(g[d:, d:])) if np.trace(g[d:, d:]) > 0 else None
    found = [(name, off_diagonal_energy(transported(u, e, b)), residual) for name, (e, b) in bases(d).items()]
    return rows.sparkSession.createDataFrame(sorted(found, key=lambda r: (r[1], r[0])), schema)


def broadcast_latents(rows: DataFrame, latents: DataFrame, key: str) -> DataFrame:
    """rows with their instance's latent codes; null where the instance has none. Repeated instances count once."""
    return rows.join(latents.dropDuplicates([key]), key, "left")
