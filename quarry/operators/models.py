"""Linear models from one pass of sums: only a matrix of the size of the model's columns reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import energy, finite, intercept, pearson, slope, total
from quarry.operators.statistics import successors


def moments(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred sums of products over rows where every column is finite."""
    clean = rows.select(*[finite(F.col(c)).alias(c) for c in names]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = clean.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n, sums = one["n"], np.zeros((len(names), len(names)))
    if n:
        for i, j in pairs:
            sums[i, j] = sums[j, i] = one[f"c{i}_{j}"] * n
    return n, np.array([one[f"m{i}"] or 0.0 for i in range(len(names))]), sums


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1e-3) -> DataFrame:
    """Coefficients of ridge regression with an unpenalised intercept, and the share of variance explained."""
    n, means, sums = moments(rows, [*features, target])
    xx, xy, yy = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
    weights = np.linalg.lstsq(xx + alpha * np.eye(len(features)), xy, rcond=None)[0]
    r2 = float((2 * weights @ xy - weights @ xx @ weights) / yy) if yy > 0 else None
    named = [*zip(features, weights.tolist()), ("intercept", float(means[-1] - weights @ means[:-1]))]
    schema = "term string, coefficient double, r2 double, n long"
    return rows.sparkSession.createDataFrame([(t, float(c), r2, n) for t, c in named], schema)


def polynomial(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Least squares on all terms up to degree two."""
    terms = {c: F.col(c).cast("double") for c in features}
    for i, a in enumerate(features):
        terms |= {f"{a}*{b}": F.col(a).cast("double") * F.col(b) for b in features[i:]}
    return ridge(rows.select(F.col(target), *[e.alias(t) for t, e in terms.items()]), list(terms), target, 0.0)


def principal_variance(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the variance along each principal axis."""
    _, _, sums = moments(rows, columns)
    values = np.clip(np.linalg.eigvalsh(sums)[::-1], 0, None)
    share = values / values.sum() if values.sum() > 0 else values
    return rows.sparkSession.createDataFrame([(k, float(s)) for k, s in enumerate(share)], "component int, explained double")


TEMPLATES = {
    "x": lambda x: x,
    "x^2": lambda x: x * x,
    "sqrt|x|": lambda x: F.sqrt(F.abs(x)),
    "ln|x|": lambda x: F.log(F.abs(x) + 1e-8),
    "1/x": lambda x: 1 / F.nullif(x, F.lit(0.0)),
}


def templates(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Each feature under each template, fitted through the origin: one pass for all."""
    y = finite(F.col(target))
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("template"), finite(f(F.col(c).cast("double"))).alias("t"))
        for c in features
        for t, f in TEMPLATES.items()
    ]
    long = rows.select(y.alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.*").dropna()
    sums = long.groupBy("column", "template").agg(
        F.count("*").alias("n"), F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.sum(F.col("y") * F.col("y")).alias("yy"), (F.var_pop("y") * F.count("*")).alias("spread"),
    )
    k = F.col("ty") / F.nullif("tt", F.lit(0.0))
    left = F.col("yy") - 2 * k * F.col("ty") + k * k * F.col("tt")
    return sums.select("column", "template", "n", k.alias("coefficient"), (1 - left / F.nullif("spread", F.lit(0.0))).alias("r2"))


def next_step(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Regression of a column's next value in its sequence on the present one."""
    pairs = successors(rows, key, [order, column], [column]).where("has_next")
    x, y = F.col(column), F.col(f"next_{column}")
    known = F.count(F.when(y.isNotNull(), 1))
    return pairs.agg(slope(y, x).alias("slope"), intercept(y, x).alias("intercept"), F.pow(pearson(x, y), 2).alias("r2"), known.alias("n"))


def cosine(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y)) / F.nullif(F.sqrt(energy(a) * energy(b)), F.lit(0.0))


def gram(rows: DataFrame, vectors: list[str]) -> tuple[int, np.ndarray]:
    """Count and sum of outer products of the vectors laid end to end: one partial sum for each partition."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0.0
        for batch in batches:
            if len(batch):
                x = np.hstack([np.stack(batch[v].to_list()) for v in vectors])
                n, total = n + len(x), total + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "g": [np.asarray(total).ravel()]})

    parts = rows.select(*vectors).mapInPandas(partial, "n long, g array<double>")
    places = parts.select("n", F.posexplode("g").alias("i", "g"))
    sums = places.groupBy("i").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).orderBy("i").collect()  # the square of the vectors' length
    side = int(round(len(sums) ** 0.5))
    return (sums[0]["n"] if sums else 0), np.array([r["g"] for r in sums]).reshape(side, side)


def linear_map(rows: DataFrame, x: str, y: str, alpha: float, relative: float = 1e-6, low: float = 0.25) -> DataFrame:
    """Ridge map from vectors x to vectors y: rank, whether that is low for the length, norm, and share of y left over."""
    n, g = gram(rows, [x, y])
    schema = "n long, dim int, map_rank int, low_rank boolean, map_norm double, residual double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    d = len(g) // 2
    xx, xy, yy = g[:d, :d], g[:d, d:], g[d:, d:]
    u = np.linalg.solve(xx + alpha * np.eye(d), xy)
    s = np.linalg.svd(u, compute_uv=False)
    rank = int((s > relative * max(s[0], 1e-300)).sum())
    left = np.trace(yy) - 2 * np.trace(u.T @ xy) + np.trace(u.T @ xx @ u)
    row = (n, d, rank, rank <= low * d, float(np.linalg.norm(u)), float(left / np.trace(yy)) if np.trace(yy) > 0 else None)
    return rows.sparkSession.createDataFrame([row], schema)


def pair_templates(rows: DataFrame, pairs: list[tuple[str, str]], target: str) -> DataFrame:
    """Sums, differences, products, ratios and lengths of pairs of columns, each fitted through the origin: one pass for all."""
    cells = []
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        forms = {"a+b": x + y, "a-b": x - y, "a*b": x * y, "a/b": F.when(F.abs(y) >= 1e-12, x / y), "hypot": F.sqrt(x * x + y * y)}
        cells += [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(t).alias("template"), finite(e).alias("t")) for t, e in forms.items()]
    long = rows.select(finite(F.col(target)).alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.*").dropna()
    sums = long.groupBy("first", "second", "template").agg(
        F.count("*").alias("n"), F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.sum(F.col("y") * F.col("y")).alias("yy"), (F.var_pop("y") * F.count("*")).alias("spread"),
    )
    left = F.col("yy") - F.col("ty") * F.col("ty") / F.nullif("tt", F.lit(0.0))
    return sums.select("first", "second", "template", "n", (1 - left / F.nullif("spread", F.lit(0.0))).alias("r2"))


def size_rule(rows: DataFrame, x: str, target: str, least_rows: int = 4, least_r2: float = 0.5) -> DataFrame:
    """How the slope of the target on x moves with size, over the sizes that a line fits: null for fewer than three sizes."""
    px, py = F.col(x), F.col(target)
    per = rows.groupBy("size").agg(slope(py, px).alias("k"), F.pow(pearson(px, py), 2).alias("r2"), F.count("*").alias("n"))
    kept = per.where((F.col("n") >= least_rows) & (F.col("r2") >= least_r2))
    k, n = F.col("k"), F.col("size").cast("double")
    able = F.count("*") >= 3
    return kept.agg(
        F.count("*").alias("sizes"), F.when(able, slope(k, n)).alias("drift"), F.when(able, intercept(k, n)).alias("level"),
        F.when(able, F.pow(pearson(n, k), 2)).alias("rule_r2"), F.min("r2").alias("least_r2"),
    )


def split_fit(rows: DataFrame, features: list[str], target: str, train: Column, alpha: float = 0.0) -> DataFrame:
    """R2 of the ridge fit of the train rows, on them and on the others: (side, n, r2)."""
    marked = rows.withColumn("_train", train)
    n, means, sums = moments(marked.where("_train"), [*features, target])
    weights = np.linalg.lstsq(sums[:-1, :-1] + alpha * np.eye(len(features)), sums[:-1, -1], rcond=None)[0]
    predicted = F.lit(float(means[-1])) + sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(features, means, weights, strict=False)), F.lit(0.0))
    y = finite(F.col(target))
    spread = F.var_pop(y) * F.count(y)
    side = F.when(F.col("_train"), "train").otherwise("test").alias("side")
    return marked.groupBy(side).agg(F.count(y).alias("n"), F.when(spread > 0, 1 - F.sum(F.pow(y - predicted, 2)) / F.nullif(spread, F.lit(0.0))).alias("r2"))


def principal_codes(rows: DataFrame, columns: list[str], most: int, target: str) -> DataFrame:
    """Per principal code: explained share, correlation with the target, and the mean squared error that is left with the
    codes so far. Axes come from centred moments; the sign of an axis makes its largest weight positive."""
    n, means, sums = moments(rows, [*columns, target])
    xx, xy, yy = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
    values, axes = np.linalg.eigh(xx)
    values, axes = np.clip(values[::-1], 0, None), axes[:, ::-1]
    out, left = [], float(values.sum())
    for k in range(min(most, len(columns))):
        axis = axes[:, k] * np.sign(axes[np.abs(axes[:, k]).argmax(), k])
        left -= float(values[k])
        r = float(axis @ xy / np.sqrt(values[k] * yy)) if values[k] > 0 and yy > 0 else None
        out.append((k, float(values[k] / values.sum()) if values.sum() > 0 else None, max(left, 0.0) / (n * len(columns)) if n else None, r, [float(a) for a in axis]))
    return rows.sparkSession.createDataFrame(out, "component int, explained double, reconstruction_mse double, target_r double, axis array<double>")


def matching_pursuit(rows: DataFrame, vector: str, target: str, most: int) -> DataFrame:
    """Walsh coefficients chosen one by one, each the strongest for what the ones before leave of the target: (step, place,
    r2). All from one matrix of sums, so the rows are read once."""
    whole = rows.select(vector, F.array(F.lit(1.0), F.col(target)).alias("_t"))
    n, g = gram(whole, [vector, "_t"])
    schema = "step int, place int, r2 double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    d = len(g) - 2
    places = np.arange(d)
    w = np.where(np.bitwise_count(places[:, None] & places[None, :]) % 2 == 0, 1.0, -1.0) / d**0.5
    one, t = d, d + 1
    mean = np.append(w @ g[:d, one], g[t, one]) / n
    xx = w @ g[:d, :d] @ w.T - n * np.outer(mean[:d], mean[:d])
    xy, yy = w @ g[:d, t] - n * mean[:d] * mean[d], g[t, t] - n * mean[d] ** 2
    chosen: list[int] = []
    out = []
    for step in range(min(most, d)):
        b = np.linalg.lstsq(xx[np.ix_(chosen, chosen)], xy[chosen], rcond=None)[0] if chosen else np.zeros(0)
        left = (xy - xx[:, chosen] @ b) / np.sqrt(np.maximum(np.diag(xx), 1e-300))
        left[chosen] = 0
        chosen.append(int(np.abs(left).argmax()))
        b = np.linalg.lstsq(xx[np.ix_(chosen, chosen)], xy[chosen], rcond=None)[0]
        out.append((step, chosen[-1], float(b @ xy[chosen] / yy) if yy > 0 else None))
    return rows.sparkSession.createDataFrame(out, schema)
