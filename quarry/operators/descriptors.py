"""Descriptors of vectors and matrices on stacked Arrow batches.

A descriptor takes all arrays of one length in a batch as a matrix and gives a column for each value, so that NumPy works
on whole batches. What is undefined for an array is NaN there and null in the result. Null arrays, empty arrays and arrays
with values that are not finite have null in every column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stacked = Callable[[np.ndarray], dict[str, np.ndarray]]

#: Bins of histograms, share below which a coefficient is negligible, coefficients of a tail, tolerance of ranks.
BINS, NEGLIGIBLE, TAIL, RANK = 32, 1e-8, 32, 1e-10
TINY = 1e-12


def described(df: DataFrame, vector: str, keep: list[str], stacked: Stacked, names: list[str]) -> DataFrame:
    """keep and one double column per name, for the arrays in column `vector`."""

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            out = np.full((len(values), len(names)), np.nan)
            sizes = np.array([0 if v is None else len(v) for v in values])
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                rows = np.stack([np.asarray(values.iloc[i], dtype=float) for i in at])
                good = np.isfinite(rows).all(1)
                if good.any():
                    with np.errstate(all="ignore"):
                        found = stacked(rows[good])
                    for k, name in enumerate(names):
                        if name in found:
                            out[at[good], k] = found[name]
            out[~np.isfinite(out)] = np.nan
            # objects, so that undefined values arrive as null and not as NaN
            yield pd.DataFrame(np.where(np.isnan(out), None, out), columns=names, index=values.index)

    made = df.withColumn("_d", describe(F.col(vector).cast("array<double>")))
    return made.select(*keep, "_d.*")


def centred_r(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of the rows of two matrices; NaN without spread."""
    a, b = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    spread = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return np.where(spread > 0, (a * b).sum(1) / np.where(spread > 0, spread, 1), np.nan)


def histogram_entropy(x: np.ndarray) -> np.ndarray:
    """Entropy in nats over BINS equal bins between each row's extremes; a constant row has one bin."""
    low, span = x.min(1, keepdims=True), np.ptp(x, axis=1)[:, None]
    own = np.minimum(np.floor((x - low) / np.where(span > 0, span, 1) * BINS).astype(int), BINS - 1)
    held = np.bincount((own + BINS * np.arange(len(x))[:, None]).ravel(), minlength=BINS * len(x)).reshape(len(x), BINS)
    return entropy(held)


def entropy(weights: np.ndarray) -> np.ndarray:
    """Entropy in nats of non-negative weights by row; 0 without weight."""
    total = weights.sum(1, keepdims=True)
    p = weights / np.where(total > 0, total, 1)
    return -(p * np.log(np.where(p > 0, p, 1))).sum(1) + 0.0


def moment_shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population skewness and excess kurtosis; NaN for constant rows and for fewer than three or four values."""
    c = x - x.mean(1, keepdims=True)
    v = (c * c).mean(1)
    flat = v == 0
    v = np.where(flat, np.nan, v)
    skew = (c**3).mean(1) / v**1.5 if x.shape[1] >= 3 else np.full(len(x), np.nan)
    return skew, (c**4).mean(1) / v**2 - 3 if x.shape[1] >= 4 else np.full(len(x), np.nan)


STATS = "count mean std variance min max median range_ratio zero_fraction shannon_entropy skewness kurtosis iqr cv participation_ratio".split()


def stats(x: np.ndarray) -> dict[str, np.ndarray]:
    mean, std = x.mean(1), x.std(1)
    base = np.maximum(np.abs(mean), TINY)
    weight = np.abs(x)
    total = weight.sum(1, keepdims=True)
    share = weight / np.where(total > 0, total, np.nan)
    out = {
        "count": np.full(len(x), float(x.shape[1])), "mean": mean, "std": std, "variance": std * std, "min": x.min(1), "max": x.max(1),
        "median": np.median(x, 1), "range_ratio": np.ptp(x, axis=1) / base, "zero_fraction": (x == 0).mean(1),
        "shannon_entropy": histogram_entropy(x), "participation_ratio": 1 / (share * share).sum(1),
    }
    if x.shape[1] >= 3:
        out["skewness"], out["kurtosis"] = moment_shape(x)
        q1, q3 = np.quantile(x, [0.25, 0.75], axis=1)
        out |= {"iqr": q3 - q1, "cv": std / base}
    return out


SPECTRAL = "l2_norm entropy effective_rank spectral_gap gini hoyer crest".split()


def effective_rank(s: np.ndarray) -> np.ndarray:
    squares = np.where(s > TINY, s * s, 0)
    fourth = (squares * squares).sum(1)
    return np.where(fourth > 0, squares.sum(1) ** 2 / np.where(fourth > 0, fourth, 1), 0)


def spectral(x: np.ndarray) -> dict[str, np.ndarray]:
    n, size = x.shape[1], np.abs(x)
    norm, falling = np.sqrt((x * x).sum(1)), np.sort(size, 1)[:, ::-1]
    total = size.sum(1)
    ranks = (2 * np.arange(n, 0, -1) - n - 1) * falling
    out = {
        "l2_norm": norm,
        "entropy": np.where(norm > 0, entropy(x * x), np.nan),
        "effective_rank": effective_rank(falling),
        "gini": np.where(total > 0, ranks.sum(1) / np.where(total > 0, n * total, 1), np.nan),
        "crest": falling[:, 0] / np.maximum(norm, 1e-15),
    }
    if n >= 2:
        out["spectral_gap"] = falling[:, 0] - falling[:, 1]
        out["hoyer"] = np.where(norm > 0, (n**0.5 - total / np.where(norm > 0, norm, 1)) / (n**0.5 - 1), np.nan)
    return out


def walsh(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows, in natural order; their length is a power of two."""
    n, out, half = x.shape[1], x, 1
    while half < n:
        blocks = out.reshape(len(x), -1, 2, half)
        a, b = blocks[:, :, 0], blocks[:, :, 1]
        out = np.stack([a + b, a - b], axis=2).reshape(len(x), n)
        half *= 2
    return out / n**0.5


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def tail_slope(falling: np.ndarray) -> np.ndarray:
    """Slope of ln size on ln rank over each row's first TAIL positive values; NaN for fewer than four."""
    y = falling[:, :TAIL]
    there = y > 0
    n = there.sum(1)
    lx = np.log(np.arange(1, y.shape[1] + 1))[None, :] * there
    ly = np.log(np.where(there, y, 1))
    mx, my = lx.sum(1) / np.maximum(n, 1), ly.sum(1) / np.maximum(n, 1)
    dx = (lx - mx[:, None]) * there
    return np.where(n >= 4, (dx * (ly - my[:, None])).sum(1) / np.maximum((dx * dx).sum(1), TINY), np.nan)


WALSH = "valid_length sparsity top_mass_fraction max_coeff l1_norm tail_loglog_slope".split()


def coefficients(c: np.ndarray) -> dict[str, np.ndarray]:
    size = np.abs(c)
    n, total = c.shape[1], size.sum(1)
    some = total > 0
    falling = np.sort(size, 1)[:, ::-1]
    value = lambda v: np.where(some, v, np.nan)
    return {
        "valid_length": np.ones(len(c)),
        "sparsity": np.where(some, (size <= NEGLIGIBLE * size.max(1, keepdims=True)).mean(1), 1.0),
        "top_mass_fraction": value(falling[:, : max(1, n // 8)].sum(1) / np.where(some, total, 1)),
        "max_coeff": value(falling[:, 0]),
        "l1_norm": value(total),
        "tail_loglog_slope": value(tail_slope(falling)),
    }


def walsh_shape(x: np.ndarray) -> dict[str, np.ndarray]:
    """Shape of the spectrum. Rows within 0 and 1 are mapped to -1 and 1 first."""
    if not power_of_two(x.shape[1]):
        return {"valid_length": np.zeros(len(x))}
    inside = ((x >= 0) & (x <= 1)).all(1, keepdims=True)
    return coefficients(walsh(np.where(inside, 2 * x - 1, x)))


def log_walsh_shape(x: np.ndarray, most: int = 4096) -> dict[str, np.ndarray]:
    """Shape of the spectrum of log amplitudes, padded with zeros to a power of two; rows above `most` are thinned evenly."""
    y = np.log(np.maximum(x, 1e-300))
    if x.shape[1] > most:
        y = y[:, np.linspace(0, x.shape[1] - 1, num=most, dtype=int)]
    n = 1 << (y.shape[1] - 1).bit_length()
    c = walsh(np.pad(y, ((0, 0), (0, n - y.shape[1]))))
    return coefficients(c) | {"entropy": entropy(np.abs(c))}


LANDSCAPE = (
    "count mean std range entropy local_minima unique_values multimodality hamming_r p10 p50 p90 ruggedness skewness kurtosis "
    "mean_abs_gradient autocorr_lag1 autocorr_lag2 basin_10 basin_25 basin_50"
).split()


def landscape(x: np.ndarray) -> dict[str, np.ndarray]:
    n, low, span = x.shape[1], x.min(1, keepdims=True), np.ptp(x, axis=1)[:, None]
    wide = np.pad(x, ((0, 0), (1, 1)), mode="edge")
    minima = ((x <= wide[:, :-2]) & (x <= wide[:, 2:])).sum(1) if n > 2 else np.ones(len(x))
    ordered = np.sort(np.round(x, 12), 1)
    p10, p50, p90 = np.percentile(x, [10, 50, 90], axis=1)
    out = {
        "count": np.full(len(x), float(n)), "mean": x.mean(1), "std": x.std(1), "range": span[:, 0], "entropy": histogram_entropy(x),
        "local_minima": minima, "unique_values": 1 + (np.diff(ordered, axis=1) != 0).sum(1), "multimodality": minima / max(n**0.5, 1),
        "p10": p10, "p50": p50, "p90": p90,
    }
    if n >= 4 and power_of_two(n):
        ones = np.bitwise_count(np.arange(n)).astype(float)
        out["hamming_r"] = centred_r(np.broadcast_to(ones, x.shape), x)
    if n >= 3:
        steps = np.diff(np.sort(x, 1), axis=1)
        out["mean_abs_gradient"] = steps.mean(1)
        out["ruggedness"] = steps.std(1) / np.maximum(steps.mean(1), TINY)
        out["skewness"], out["kurtosis"] = moment_shape(x)
        for lag in (1, 2):
            if n > lag + 1:
                out[f"autocorr_lag{lag}"] = centred_r(x[:, :-lag], x[:, lag:])
    for share in (10, 25, 50):
        out[f"basin_{share}"] = np.where(span[:, 0] > 0, (x <= low + share / 100 * span).mean(1), np.nan)
    return out


def square(x: np.ndarray) -> np.ndarray | None:
    side = int(round(x.shape[1] ** 0.5))
    return x.reshape(len(x), side, side) if side * side == x.shape[1] else None


ENTRIES = (
    "size frobenius max_abs_entry trace trace_power_2 trace_power_3 trace_power_4 sparsity off_diagonal_ratio symmetry_error "
    "off_diagonal_mean_abs off_diagonal_max_abs diagonal_dominance row_variance_mean row_variance_max"
).split()


def entries(x: np.ndarray) -> dict[str, np.ndarray]:
    """Values of a square matrix that need no decomposition."""
    m = square(x)
    if m is None:
        return {}
    n, size = m.shape[1], np.abs(m)
    off = ~np.eye(n, dtype=bool)
    norm = np.sqrt((m * m).sum((1, 2)))
    diagonal = np.diagonal(size, axis1=1, axis2=2).sum(1)
    second = m @ m
    trace = lambda a: np.trace(a, axis1=1, axis2=2)
    variances = m.var(2)
    out = {
        "size": np.full(len(x), float(n)), "frobenius": norm, "max_abs_entry": size.max((1, 2)), "trace": trace(m),
        "trace_power_2": trace(second), "trace_power_3": trace(second @ m), "trace_power_4": trace(second @ second),
        "sparsity": (size <= TINY).mean((1, 2)), "off_diagonal_ratio": np.sqrt((m[:, off] ** 2).sum(1)) / np.maximum(norm, TINY),
        "symmetry_error": np.sqrt(((m - m.transpose(0, 2, 1)) ** 2).sum((1, 2))) / np.maximum(norm, TINY),
        "row_variance_mean": variances.mean(1), "row_variance_max": variances.max(1),
        "diagonal_dominance": diagonal / np.maximum(diagonal + size[:, off].sum(1), TINY),
    }
    if n > 1:
        out |= {"off_diagonal_mean_abs": size[:, off].mean(1), "off_diagonal_max_abs": size[:, off].max(1)}
    return out


SPECTRUM = (
    "nuclear max_singular min_singular condition_number effective_rank spectral_radius eigenvalue_entropy gap_min gap_max "
    "participation_mean participation_max slice_rank log_slice_rank"
).split()


def spectrum(x: np.ndarray) -> dict[str, np.ndarray]:
    """Values of a square matrix from its singular values and the eigenvalues of its symmetric part."""
    out: dict[str, np.ndarray] = {}
    if power_of_two(x.shape[1]):
        out["slice_rank"] = slice_rank(x)
        if x.shape[1] > 1:
            out["log_slice_rank"] = np.log2(np.maximum(out["slice_rank"], 1)) / np.log2(x.shape[1])
    m = square(x)
    if m is None:
        return out
    s = np.linalg.svd(m, compute_uv=False)
    values, vectors = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
    gaps = np.diff(values, axis=1)
    part = (vectors**2).sum(1)
    return out | {
        "nuclear": s.sum(1), "max_singular": s[:, 0], "min_singular": s[:, -1],
        "condition_number": np.where(s[:, -1] > 1e-15, s[:, 0] / np.maximum(s[:, -1], 1e-300), np.nan),
        "effective_rank": effective_rank(s), "spectral_radius": np.abs(values).max(1), "eigenvalue_entropy": entropy(np.abs(values)),
        "gap_min": gaps.min(1) if gaps.shape[1] else np.zeros(len(x)), "gap_max": gaps.max(1) if gaps.shape[1] else np.zeros(len(x)),
        "participation_mean": part.mean(1), "participation_max": part.max(1),
    }


def slice_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each row laid out as 2^(k/2) rows of the rest."""
    left = 1 << (x.shape[1].bit_length() - 1) // 2
    if left == 1:
        return np.ones(len(x))
    return (np.linalg.svd(x.reshape(len(x), left, -1), compute_uv=False) > RANK).sum(1).astype(float)


GRAPH = (
    "n_nodes n_edges density avg_degree degree_variance diameter avg_shortest_path clustering laplacian_gap laplacian_max "
    "laplacian_entropy assortativity cycle_count degeneracy weighted_edge_sum weighted_edge_mean weighted_edge_entropy"
).split()


def graph(x: np.ndarray) -> dict[str, np.ndarray]:
    """The graph whose edges are the entries above the diagonal that are not zero."""
    m = square(x)
    if m is None:
        return {}
    rows, n = m.shape[:2]
    upper = np.triu(np.ones((n, n), dtype=bool), 1)
    a = ((m != 0) & upper).astype(float)
    a = a + a.transpose(0, 2, 1)
    degree = a.sum(2)
    edges = degree.sum(1) / 2
    # all distances at once: a step further for whole batches until nothing new is reached
    far, reach = np.where(np.eye(n, dtype=bool), 0.0, np.inf)[None].repeat(rows, 0), np.eye(n)[None].repeat(rows, 0)
    for step in range(1, n):
        reach = ((reach @ a + reach) > 0).astype(float)
        far = np.where((reach > 0) & np.isinf(far), step, far)
    joined = np.isfinite(far).all((1, 2))
    pairs = n * (n - 1)
    components = np.array([len(np.unique(np.isfinite(f).argmax(1))) for f in far])
    triangles = np.einsum("rij,rjk,rki->ri", a, a, a)
    corners = degree * (degree - 1)
    laplacian = np.linalg.eigvalsh(degree[:, :, None] * np.eye(n) - a)
    ends, mean = degree.sum(1), (degree**2).sum(1)
    both = np.einsum("ri,rij,rj->r", degree, a, degree)
    spread = (degree**3).sum(1) - mean**2 / np.where(ends > 0, ends, 1)
    weight = np.abs(m) * ~np.eye(n, dtype=bool)
    held = (weight > 0).sum((1, 2))
    out = {
        "n_nodes": np.full(rows, float(n)), "n_edges": edges, "density": 2 * edges / pairs if n > 1 else np.zeros(rows),
        "avg_degree": degree.mean(1), "degree_variance": degree.var(1), "diameter": np.where(joined, far.max((1, 2)), np.nan),
        "avg_shortest_path": np.where(joined, far.sum((1, 2)) / max(pairs, 1), np.nan),
        "clustering": np.where(corners > 0, triangles / np.where(corners > 0, corners, 1), 0).mean(1),
        "assortativity": np.where(spread > 1e-12, (both - mean**2 / np.where(ends > 0, ends, 1)) / np.where(spread > 1e-12, spread, 1), np.nan),
        "cycle_count": edges - n + components, "degeneracy": core_number(a),
        "weighted_edge_sum": np.where(held > 0, weight.sum((1, 2)), np.nan),
        "weighted_edge_mean": np.where(held > 0, weight.sum((1, 2)) / np.maximum(held, 1), np.nan),
        "weighted_edge_entropy": np.where(held > 0, entropy(weight.reshape(rows, -1)), np.nan),
    }
    if n >= 2:
        out |= {"laplacian_gap": laplacian[:, 1] - laplacian[:, 0], "laplacian_max": laplacian[:, -1], "laplacian_entropy": entropy(np.maximum(laplacian, 0))}
    return out


def core_number(a: np.ndarray) -> np.ndarray:
    """Largest least degree met when the node of least degree is taken off again and again, for all graphs at once."""
    rows, n = a.shape[:2]
    left, best, each = np.ones((rows, n), dtype=bool), np.zeros(rows), np.arange(rows)
    for _ in range(n):
        degree = np.where(left, (a * left[:, None, :]).sum(2), np.inf)
        least = degree.argmin(1)
        best = np.maximum(best, degree[each, least])
        left[each, least] = False
    return best


BOOLEAN = "algebraic_degree sparsity max_coeff_normalized l1_norm_normalized algebraic_degree_fraction".split()


def mobius(table: np.ndarray) -> np.ndarray:
    """Coefficients over GF(2) of the monomials of truth tables, by row."""
    out, half = table.astype(np.uint8), 1
    while half < table.shape[1]:
        blocks = out.reshape(len(table), -1, 2, half)
        out = np.stack([blocks[:, :, 0], blocks[:, :, 0] ^ blocks[:, :, 1]], axis=2).reshape(table.shape)
        half *= 2
    return out


def boolean(x: np.ndarray) -> dict[str, np.ndarray]:
    """Truth tables: rows hold values within 0 and 1, and are true above a half."""
    n = x.shape[1]
    if not power_of_two(n):
        return {}
    degree = (mobius(x > 0.5) * np.bitwise_count(np.arange(n))).max(1).astype(float)
    size = np.abs(walsh(2 * x - 1))
    return {
        "algebraic_degree": degree, "algebraic_degree_fraction": degree / max(1, n.bit_length() - 1),
        "sparsity": (size <= NEGLIGIBLE * size.max(1, keepdims=True)).mean(1),
        "max_coeff_normalized": size.max(1) / n**0.5, "l1_norm_normalized": size.sum(1) / n**1.5,
    }


PROFILE = "mean_collision_prob max_collision_prob concentration_fraction normalized_entropy".split()


def difference_profile(x: np.ndarray) -> dict[str, np.ndarray]:
    """Sampled collision probabilities: level, peak and spread."""
    g = np.clip(x, TINY, 1)
    most = np.log2(g.shape[1]) if g.shape[1] > 1 else 1.0
    return {
        "mean_collision_prob": g.mean(1), "max_collision_prob": g.max(1), "concentration_fraction": (g > 0.5).mean(1),
        "normalized_entropy": entropy(g) / np.log(2) / most,
    }


def gf2_rank(masks: np.ndarray) -> np.ndarray:
    """Rank over GF(2) of rows of bit masks (int64), all rows at once: a pivot for each bit, highest first."""
    left, rank, each = masks.astype(np.int64).copy(), np.zeros(len(masks)), np.arange(len(masks))
    for bit in range(62, -1, -1):
        has = left >> bit & 1 == 1
        some = has.any(1)
        pivot = np.where(some, left[each, has.argmax(1)], 0)
        left ^= np.where(has, pivot[:, None], 0)
        rank += some
    return rank


def bit_rank(x: np.ndarray) -> dict[str, np.ndarray]:
    """Rank over GF(2) of a square matrix of signs (above zero: one)."""
    m = square(x)
    if m is None:
        return {}
    return {"gf2_rank": gf2_rank(((m > 0) << np.arange(m.shape[1])).sum(2))}


def template_names() -> list[str]:
    """Names of the templates that templates() evaluates: lags, quantiles, norms, Walsh bands and leading shares."""
    return [
        *[f"autocorr_{k}" for k in range(1, 33)], *[f"quantile_{5 * k}" for k in range(21)], *[f"norm_{p}" for p in (1, 2, 3, 4)],
        *[f"walsh_band_{k}" for k in range(15)], *[f"top_energy_{k}" for k in (1, 2, 4, 8)],
    ]


def templates(x: np.ndarray) -> dict[str, np.ndarray]:
    """All templates of a batch, with one sort and one spectrum for all that need them."""
    n, size, out = x.shape[1], np.abs(x), {}
    for k in range(1, min(33, n - 1)):
        out[f"autocorr_{k}"] = centred_r(x[:, :-k], x[:, k:])
    for k, q in enumerate(np.quantile(x, np.arange(21) / 20, axis=1)):
        out[f"quantile_{5 * k}"] = q
    for p in (1, 2, 3, 4):
        out[f"norm_{p}"] = (size**p).sum(1) ** (1 / p)
    squares = np.sort(x * x, 1)[:, ::-1]
    total = squares.sum(1)
    for k in (1, 2, 4, 8):
        out[f"top_energy_{k}"] = np.where(total > 0, squares[:, :k].sum(1) / np.where(total > 0, total, 1), np.nan)
    if power_of_two(n):
        power = walsh(x) ** 2
        held = power.sum(1)
        for k in range(15):
            a, b = n * k // 15, n * (k + 1) // 15
            out[f"walsh_band_{k}"] = np.where(held > 0, power[:, a:b].sum(1) / np.where(held > 0, held, 1), np.nan)
    return out
