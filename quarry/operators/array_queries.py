"""Registered queries over arrays: descriptors of single vectors and matrices, of instances, and metrics made of them.

The vectors of `embeddings` are the arrays; an instance is a run of SLICES consecutive vectors, so that its size is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import energy, finite, slope
from quarry.operators import candidates, descriptors, matrices, models, recovery, statistics, storage
from quarry.operators.registered import VEC, query, rounded
from quarry.sources.tables import table

SLICES = 16


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def described(spark, sf_dir, stacked, names, digits=6, change=lambda v: v, **other) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("v", change(F.col("v")))
    return rounded(descriptors.described(e, "v", ["vec_id"], stacked, names), digits, **other)


#: One row per element: place i from 0, value x.
X = VEC + ", x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e)\n"
#: Histogram entropy by vector over 32 equal bins.
HIST = """, hb AS (SELECT vec_id, least(CAST(floor((x - lo) / (hi - lo) * 32) AS INTEGER), 31) AS bin FROM (SELECT vec_id, x, min(x) OVER (PARTITION BY vec_id) AS lo, max(x) OVER (PARTITION BY vec_id) AS hi FROM x)),
hc AS (SELECT vec_id, bin, count(*) / 64.0 AS p FROM hb GROUP BY ALL), h AS (SELECT vec_id, -sum(p * ln(p)) AS entropy FROM hc GROUP BY vec_id)
"""
#: Moments by vector.
MOMENTS = """, m AS (SELECT vec_id, avg(x) AS mean, stddev_pop(x) AS sd FROM x GROUP BY vec_id),
z AS (SELECT vec_id, avg(pow((x - mean) / sd, 3)) AS skew, avg(pow((x - mean) / sd, 4)) - 3 AS kurt FROM x JOIN m USING (vec_id) GROUP BY vec_id)
"""
#: Orthonormal Walsh coefficients by vector and place k.
COEFFICIENTS = """, w AS (SELECT vec_id, k, sum(x * CASE WHEN bit_count(i & k) % 2 = 0 THEN 1 ELSE -1 END) / 8 AS c FROM {source}, range(0, 64) r(k) GROUP BY vec_id, k),
r AS (SELECT vec_id, c, abs(c) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC) AS j, max(abs(c)) OVER (PARTITION BY vec_id) AS top FROM w)
"""
SHAPE = """round(count(*) FILTER (a <= 1e-8 * top) / 64.0, 5) AS sparsity, round(sum(a) FILTER (j <= 8) / sum(a), 5) AS top_mass_fraction, round(max(a), 5) AS max_coeff,
 round(sum(a), 4) AS l1_norm, round(regr_slope(ln(a), ln(j)) FILTER (j <= 32), 5) AS tail_loglog_slope"""


@query(X + HIST + MOMENTS + """SELECT vec_id, CAST(64 AS DOUBLE) AS count, round(mean, 6) AS mean, round(sd, 6) AS std, round(sd * sd, 6) AS variance, round(min(x), 6) AS min, round(max(x), 6) AS max,
 round(median(x), 6) AS median, round((max(x) - min(x)) / greatest(abs(mean), 1e-12), 2) AS range_ratio, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction, round(entropy, 6) AS shannon_entropy,
 round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(sd / greatest(abs(mean), 1e-12), 2) AS cv,
 round(pow(sum(abs(x)), 2) / sum(x * x), 5) AS participation_ratio FROM x JOIN m USING (vec_id) JOIN z USING (vec_id) JOIN h USING (vec_id) GROUP BY vec_id, mean, sd, entropy, skew, kurt""")
def stats_descriptor(spark, sf_dir):
    return described(spark, sf_dir, descriptors.stats, descriptors.STATS, range_ratio=2, cv=2, participation_ratio=5)


@query(X + """, s AS (SELECT vec_id, x, sum(x * x) OVER p AS e2, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC) AS j FROM x WINDOW p AS (PARTITION BY vec_id))
SELECT vec_id, round(sqrt(e2), 5) AS l2_norm, round(-sum(x * x / e2 * ln(x * x / e2)) FILTER (x <> 0), 5) AS entropy, round(pow(sum(x * x), 2) / sum(pow(x, 4)), 5) AS effective_rank,
 round(max(abs(x)) FILTER (j = 1) - max(abs(x)) FILTER (j = 2), 5) AS spectral_gap, round(sum((65 - 2 * j) * abs(x)) / (64 * sum(abs(x))), 5) AS gini,
 round((8 - sum(abs(x)) / sqrt(e2)) / 7, 5) AS hoyer, round(max(abs(x)) / sqrt(e2), 5) AS crest FROM s GROUP BY vec_id, e2""")
def spectral_descriptor(spark, sf_dir):
    return described(spark, sf_dir, descriptors.spectral, descriptors.SPECTRAL, 5)


@query(X + COEFFICIENTS.format(source="x") + f"SELECT vec_id, CAST(1 AS DOUBLE) AS valid_length, {SHAPE} FROM r GROUP BY vec_id")
def walsh_descriptor(spark, sf_dir):
    return described(spark, sf_dir, descriptors.walsh_shape, descriptors.WALSH, 5, l1_norm=4)


@query(X + ", y AS (SELECT vec_id, i, ln(greatest(abs(x), 1e-300)) AS x FROM x)" + COEFFICIENTS.format(source="y")
    + f", t AS (SELECT vec_id, sum(a) AS total FROM r GROUP BY vec_id) SELECT vec_id, CAST(1 AS DOUBLE) AS valid_length, {SHAPE}, round(-sum(a / total * ln(a / total)), 5) AS entropy FROM r JOIN t USING (vec_id) GROUP BY vec_id")
def log_walsh_descriptor(spark, sf_dir):
    absolute = lambda v: F.transform(v, lambda x: F.abs(x))
    return described(spark, sf_dir, descriptors.log_walsh_shape, [*descriptors.WALSH, "entropy"], 5, absolute, l1_norm=4)


@query(X + HIST + MOMENTS + """, q AS (SELECT vec_id, i, x, lag(x, 1, x) OVER o AS l, lead(x, 1, x) OVER o AS r, lag(x) OVER o AS b1, lag(x, 2) OVER o AS b2, x - lag(x) OVER (PARTITION BY vec_id ORDER BY x) AS step,
 min(x) OVER (PARTITION BY vec_id) AS lo, max(x) OVER (PARTITION BY vec_id) AS hi FROM x WINDOW o AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, CAST(64 AS DOUBLE) AS count, round(mean, 5) AS mean, round(sd, 5) AS std, round(hi - lo, 5) AS range, round(entropy, 5) AS entropy, CAST(count(*) FILTER (x <= l AND x <= r) AS DOUBLE) AS local_minima,
 CAST(count(DISTINCT round(x, 12)) AS DOUBLE) AS unique_values, round(count(*) FILTER (x <= l AND x <= r) / 8.0, 5) AS multimodality, round(corr(bit_count(i), x), 5) AS hamming_r,
 round(quantile_cont(x, 0.1), 5) AS p10, round(quantile_cont(x, 0.5), 5) AS p50, round(quantile_cont(x, 0.9), 5) AS p90, round(stddev_pop(step) / avg(step), 4) AS ruggedness,
 round(skew, 5) AS skewness, round(kurt, 5) AS kurtosis, round(avg(step), 5) AS mean_abs_gradient, round(corr(x, b1), 5) AS autocorr_lag1, round(corr(x, b2), 5) AS autocorr_lag2,
 round(count(*) FILTER (x <= lo + 0.1 * (hi - lo)) / 64.0, 5) AS basin_10, round(count(*) FILTER (x <= lo + 0.25 * (hi - lo)) / 64.0, 5) AS basin_25, round(count(*) FILTER (x <= lo + 0.5 * (hi - lo)) / 64.0, 5) AS basin_50
FROM q JOIN m USING (vec_id) JOIN z USING (vec_id) JOIN h USING (vec_id) GROUP BY vec_id, mean, sd, lo, hi, entropy, skew, kurt""")
def landscape_descriptor(spark, sf_dir):
    return described(spark, sf_dir, descriptors.landscape, descriptors.LANDSCAPE, 5, ruggedness=4)


@query(X + """, c AS (SELECT vec_id, i // 8 AS a, i % 8 AS b, x FROM x),
p2 AS (SELECT l.vec_id, l.a, r.b, sum(l.x * r.x) AS x FROM c l JOIN c r ON l.vec_id = r.vec_id AND l.b = r.a GROUP BY ALL),
t AS (SELECT vec_id, sum(x) FILTER (a = b) AS t2 FROM p2 GROUP BY vec_id),
t3 AS (SELECT l.vec_id, sum(l.x * r.x) AS t3 FROM p2 l JOIN c r ON l.vec_id = r.vec_id AND l.b = r.a AND l.a = r.b GROUP BY ALL),
t4 AS (SELECT l.vec_id, sum(l.x * r.x) AS t4 FROM p2 l JOIN p2 r ON l.vec_id = r.vec_id AND l.b = r.a AND l.a = r.b GROUP BY ALL),
s AS (SELECT l.vec_id, sum(pow(l.x - r.x, 2)) AS skewed FROM c l JOIN c r ON l.vec_id = r.vec_id AND l.b = r.a AND l.a = r.b GROUP BY ALL),
v AS (SELECT vec_id, avg(v) AS row_mean, max(v) AS row_max FROM (SELECT vec_id, a, var_pop(x) AS v FROM c GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, CAST(8 AS DOUBLE) AS size, round(sqrt(sum(x * x)), 5) AS frobenius, round(max(abs(x)), 5) AS max_abs_entry, round(sum(x) FILTER (a = b), 5) AS trace, round(t2, 4) AS trace_power_2, round(t3, 4) AS trace_power_3,
 round(t4, 3) AS trace_power_4, round(avg(CASE WHEN abs(x) <= 1e-12 THEN 1.0 ELSE 0.0 END), 5) AS sparsity, round(sqrt(sum(x * x) FILTER (a <> b)) / sqrt(sum(x * x)), 5) AS off_diagonal_ratio,
 round(sqrt(skewed) / sqrt(sum(x * x)), 5) AS symmetry_error, round(avg(abs(x)) FILTER (a <> b), 5) AS off_diagonal_mean_abs, round(max(abs(x)) FILTER (a <> b), 5) AS off_diagonal_max_abs,
 round(sum(abs(x)) FILTER (a = b) / sum(abs(x)), 5) AS diagonal_dominance, round(row_mean, 5) AS row_variance_mean, round(row_max, 5) AS row_variance_max
FROM c JOIN t USING (vec_id) JOIN t3 USING (vec_id) JOIN t4 USING (vec_id) JOIN s USING (vec_id) JOIN v USING (vec_id) GROUP BY vec_id, t2, t3, t4, skewed, row_mean, row_max""")
def matrix_entries(spark, sf_dir):
    return described(spark, sf_dir, descriptors.entries, descriptors.ENTRIES, 5, trace_power_2=4, trace_power_3=4, trace_power_4=3)


@query()
def matrix_decomposition(spark, sf_dir):
    return described(spark, sf_dir, descriptors.spectrum, descriptors.SPECTRUM)


#: The embedding's matrix without its smaller entries, so that its graph has structure.
STRONG = "CASE WHEN abs(x) > 1 THEN x ELSE 0 END"


def strong(v):
    return F.transform(v, lambda x: F.when(F.abs(x) > 1, x).otherwise(0.0))


@query(X + f""", g AS (SELECT vec_id, i // 8 AS a, i % 8 AS b, {STRONG} AS x FROM x), u AS (SELECT vec_id, a, b FROM g WHERE a < b AND x <> 0),
d AS (SELECT n.vec_id, n.a, count(u.vec_id) AS d FROM (SELECT DISTINCT vec_id, a FROM g) n LEFT JOIN u ON u.vec_id = n.vec_id AND (u.a = n.a OR u.b = n.a) GROUP BY ALL),
s AS (SELECT vec_id, sum(d) / 2.0 AS edges, avg(d) AS mean, var_pop(d) AS spread FROM d GROUP BY vec_id),
w AS (SELECT vec_id, sum(abs(x)) AS total, avg(abs(x)) AS each FROM g WHERE a <> b AND x <> 0 GROUP BY vec_id)
SELECT vec_id, CAST(8 AS DOUBLE) AS n_nodes, edges AS n_edges, round(edges / 28, 5) AS density, round(mean, 5) AS avg_degree, round(spread, 5) AS degree_variance, round(total, 4) AS weighted_edge_sum, round(each, 5) AS weighted_edge_mean
FROM s LEFT JOIN w USING (vec_id)""")
def graph_degrees(spark, sf_dir):
    names = "n_nodes n_edges density avg_degree degree_variance weighted_edge_sum weighted_edge_mean".split()
    return described(spark, sf_dir, descriptors.graph, descriptors.GRAPH, 5, strong, weighted_edge_sum=4).select("vec_id", *names)


@query()
def graph_descriptor(spark, sf_dir):
    return described(spark, sf_dir, descriptors.graph, descriptors.GRAPH, 6, strong)


def truth(v):
    return F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0))


@query(X + """, f AS (SELECT vec_id, i, CASE WHEN x > 0 THEN 1 ELSE 0 END AS x FROM x),
a AS (SELECT vec_id, k, sum(x) FILTER ((i & k) = i) % 2 AS c FROM f, range(0, 64) r(k) GROUP BY ALL), g AS (SELECT vec_id, coalesce(max(bit_count(k)) FILTER (c = 1), 0) AS degree FROM a GROUP BY vec_id),
w AS (SELECT vec_id, k, abs(sum((2 * x - 1) * CASE WHEN bit_count(i & k) % 2 = 0 THEN 1 ELSE -1 END)) / 8.0 AS c FROM f, range(0, 64) r(k) GROUP BY ALL)
SELECT vec_id, CAST(degree AS DOUBLE) AS algebraic_degree, round(count(*) FILTER (c = 0) / 64.0, 5) AS sparsity, round(max(c) / 8, 5) AS max_coeff_normalized, round(sum(c) / 512, 5) AS l1_norm_normalized,
 round(degree / 6.0, 5) AS algebraic_degree_fraction FROM w JOIN g USING (vec_id) GROUP BY vec_id, degree""")
def boolean_spectrum(spark, sf_dir):
    return described(spark, sf_dir, descriptors.boolean, descriptors.BOOLEAN, 5, truth)


@query(X + """, g AS (SELECT vec_id, least(greatest(x, 1e-12), 1) AS g FROM x), t AS (SELECT vec_id, sum(g) AS t FROM g GROUP BY vec_id)
SELECT vec_id, round(avg(g), 6) AS mean_collision_prob, round(max(g), 6) AS max_collision_prob, round(avg(CASE WHEN g > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS concentration_fraction,
 round(-sum(g / t * ln(g / t)) / ln(64), 6) AS normalized_entropy FROM g JOIN t USING (vec_id) GROUP BY vec_id""")
def difference_profile(spark, sf_dir):
    return described(spark, sf_dir, descriptors.difference_profile, descriptors.PROFILE)


@query()
def gf2_rank(spark, sf_dir):
    return described(spark, sf_dir, descriptors.bit_rank, ["gf2_rank"])


#: Weights of the terms of representation complexity.
PARTICIPATION_WEIGHT, SIZE_SCALE = 0.25, 16.0


def metrics(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """The six metrics of a vector; missing descriptors have their neutral value."""
    joint = lambda x: descriptors.stats(x) | descriptors.spectral(x) | {f"walsh_{k}": v for k, v in descriptors.walsh_shape(x).items()}
    names = ["participation_ratio", "effective_rank", "l2_norm", "walsh_top_mass_fraction", "walsh_max_coeff", "walsh_l1_norm"]
    d = descriptors.described(rows, vector, [*keep, vector], joint, names)
    d = matrices.described(d, vector, [*keep, vector, *names], matrices.codecs, matrices.CODECS)
    n = F.greatest(F.size(vector).cast("double"), F.lit(1.0))
    absolute = F.transform(vector, lambda x: F.abs(x))
    ratio = F.when(F.col("raw_bits") > 0, F.col("gzip_bits") / F.col("raw_bits"))
    peak = F.array_max(absolute)
    return d.select(
        *keep,
        ratio.alias("compressibility_ratio"),
        (
            F.coalesce("effective_rank", F.sqrt(n)) / F.sqrt(n) + F.coalesce(ratio, F.lit(1.0)) + 1 - F.coalesce("walsh_top_mass_fraction", F.lit(0.0))
            + PARTICIPATION_WEIGHT / F.greatest(F.coalesce("participation_ratio", F.lit(1.0)), F.lit(1e-12)) + F.log2(n) / SIZE_SCALE
        ).alias("representation_complexity"),
        F.when(
            F.col("l2_norm") > 0,
            F.when(F.col("walsh_l1_norm") > 0, F.col("walsh_max_coeff") / (F.col("walsh_l1_norm") / F.sqrt(n))).otherwise(F.coalesce("walsh_max_coeff", F.lit(0.0)) / F.col("l2_norm")),
        ).alias("spectral_concentration"),
        peak.alias("max_amplitude"),
        F.when(peak > 0, F.log2(peak)).alias("log_max_amplitude"),
        (peak * peak).alias("peak_probability_mass"),
    )


@query(X + COEFFICIENTS.format(source="x") + """, a AS (SELECT vec_id, max(abs(x)) AS peak FROM x GROUP BY vec_id), c AS (SELECT vec_id, max(a) * 8 / sum(a) AS concentration FROM r GROUP BY vec_id)
SELECT vec_id, round(concentration, 5) AS spectral_concentration, round(peak, 6) AS max_amplitude, round(log2(peak), 6) AS log_max_amplitude, round(peak * peak, 5) AS peak_probability_mass FROM a JOIN c USING (vec_id)""")
def amplitude_metrics(spark, sf_dir):
    m = metrics(embeddings(spark, sf_dir), "v", ["vec_id"]).select("vec_id", "spectral_concentration", "max_amplitude", "log_max_amplitude", "peak_probability_mass")
    return rounded(m, 6, spectral_concentration=5, peak_probability_mass=5)


@query()
def complexity_metrics(spark, sf_dir):
    return rounded(metrics(embeddings(spark, sf_dir), "v", ["vec_id"]).select("vec_id", "compressibility_ratio", "representation_complexity"))


@query()
def complexity_by_group(spark, sf_dir):
    m = metrics(embeddings(spark, sf_dir), "v", ["label"])
    x = finite(F.col("representation_complexity"))
    return rounded(m.groupBy("label").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")))


def instances(spark, sf_dir) -> DataFrame:
    """Slices of instances: r is the place in the instance."""
    e = embeddings(spark, sf_dir)
    return e.select(F.expr(f"vec_id div {SLICES}").alias("instance_id"), F.expr(f"vec_id % {SLICES}").cast("long").alias("r"), "v")


INSTANCES = VEC.rstrip() + f", s AS (SELECT vec_id // {SLICES} AS instance_id, vec_id % {SLICES} AS r, vec_id, v FROM e)\n"


def trajectories(slices: DataFrame) -> DataFrame:
    """Start, end, change and slope along r of entropy, effective rank and slice rank of each instance, and the first r that
    reaches the last slice rank."""
    joint = lambda x: {"entropy": descriptors.histogram_entropy(x), "effective_rank": descriptors.effective_rank(np.abs(x)), "slice_rank": descriptors.slice_rank(x)}
    names = ["entropy", "effective_rank", "slice_rank"]
    d = descriptors.described(slices, "v", ["instance_id", "r"], joint, names)
    r, out = F.col("r").cast("double"), [F.count("*").alias("n_points")]
    for name in names:
        first, last = F.min_by(name, "r"), F.max_by(name, "r")
        rate = slope(F.col(name), F.log(r + 1)) if name == "entropy" else slope(F.col(name), r)
        out += [first.alias(f"{name}_start"), last.alias(f"{name}_end"), (last - first).alias(f"{name}_delta"), rate.alias(f"{name}_slope")]
    ranks = F.array_sort(F.collect_list(F.struct("r", "slice_rank")))  # an instance has few slices
    reached = F.filter(ranks, lambda p: p["slice_rank"] >= F.element_at(ranks, -1)["slice_rank"] - 1e-9)
    growth = F.max_by("slice_rank", "r") / F.greatest(F.min_by("slice_rank", "r"), F.lit(1.0))
    return d.groupBy("instance_id").agg(*out, growth.alias("slice_rank_growth"), F.get(reached, F.lit(0))["r"].alias("plateau_r"))


@query(X + HIST + f""", k AS (SELECT vec_id // {SLICES} AS instance_id, vec_id % {SLICES} AS r, entropy, er FROM h JOIN (SELECT vec_id, pow(sum(x * x), 2) / sum(pow(x, 4)) AS er FROM x GROUP BY vec_id) USING (vec_id))
SELECT instance_id, count(*) AS n_points, round(arg_min(entropy, r), 5) AS entropy_start, round(arg_max(entropy, r), 5) AS entropy_end, round(arg_max(entropy, r) - arg_min(entropy, r), 5) AS entropy_delta,
 round(regr_slope(entropy, ln(r + 1)), 5) AS entropy_slope, round(arg_min(er, r), 4) AS effective_rank_start, round(arg_max(er, r), 4) AS effective_rank_end, round(arg_max(er, r) - arg_min(er, r), 4) AS effective_rank_delta,
 round(regr_slope(er, r), 5) AS effective_rank_slope FROM k GROUP BY instance_id""")
def instance_dynamics(spark, sf_dir):
    d = trajectories(instances(spark, sf_dir))
    names = [c for c in d.columns if not c.startswith(("slice_rank", "plateau"))]
    return rounded(d.select(names), 5, effective_rank_start=4, effective_rank_end=4, effective_rank_delta=4)


@query()
def slice_rank_dynamics(spark, sf_dir):
    d = trajectories(instances(spark, sf_dir))
    return rounded(d.select("instance_id", *[c for c in d.columns if c.startswith(("slice_rank", "plateau"))]))


def overlaps(slices: DataFrame) -> DataFrame:
    """Absolute inner products of the slices of an instance: all pairs of its few slices, and neighbours."""

    def of(v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("r")
        x = np.stack(v["v"].to_list())
        gram = np.abs(x @ x.T)
        pairs, near = gram[np.triu_indices(len(x), 1)], np.diagonal(gram, 1)
        if not len(near):
            return pd.DataFrame([])
        steps = np.linalg.norm(np.diff(x, axis=0), axis=1) / np.linalg.norm(x[:-1], axis=1)
        row = (v["instance_id"].iloc[0], len(pairs), pairs.mean(), pairs.min(), pairs.max(), near.mean(), near.min(), v["r"].iloc[0], v["r"].iloc[-1], len(steps), steps.mean(), steps.max(), steps.std())
        return pd.DataFrame([row], columns=[c.split()[0] for c in OVERLAP.split(", ")])

    return slices.groupBy("instance_id").applyInPandas(of, OVERLAP)


OVERLAP = (
    "instance_id long, n_pairs long, mean double, least double, most double, consecutive_mean double, consecutive_min double, first_r long, last_r long, "
    "n_steps long, step_ratio_mean double, step_ratio_max double, step_ratio_std double"
)


@query(INSTANCES + """, p AS (SELECT a.instance_id, a.r AS ra, b.r AS rb, abs(list_dot_product(a.v, b.v)) AS o,
 sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(b.v[i] - a.v[i], 2))) / list_dot_product(a.v, a.v)) AS u FROM s a JOIN s b ON a.instance_id = b.instance_id AND a.r < b.r)
SELECT instance_id, count(*) AS n_pairs, round(avg(o), 5) AS mean, round(min(o), 5) AS least, round(max(o), 5) AS most, round(avg(o) FILTER (rb = ra + 1), 5) AS consecutive_mean, round(min(o) FILTER (rb = ra + 1), 5) AS consecutive_min,
 min(ra) AS first_r, max(rb) AS last_r, count(*) FILTER (rb = ra + 1) AS n_steps, round(avg(u) FILTER (rb = ra + 1), 5) AS step_ratio_mean, round(max(u) FILTER (rb = ra + 1), 5) AS step_ratio_max,
 round(stddev_pop(u) FILTER (rb = ra + 1), 5) AS step_ratio_std FROM p GROUP BY instance_id""")
def instance_overlap(spark, sf_dir):
    return rounded(overlaps(instances(spark, sf_dir)), 5)


#: Slices that identification needs, highest order that may be promoted, highest order tried.
LEAST_SLICES, MOST_PROMOTED, MOST_ORDER = 12, 32, 8
RECURRENCE = "instance_id long, n_slices long, krylov_rank long, estimated_order long, identification_eligible boolean, promotion_eligible boolean, withheld_rank_delta long, withheld_stable boolean"


def krylov_rank(x: np.ndarray) -> int:
    s = np.linalg.svd(x, compute_uv=False)
    return int((s > 1e-10 * max(s[0], 1.0)).sum())


def recurrence(slices: DataFrame, withheld: int = 0) -> DataFrame:
    """Order of the recurrence of each instance: the least number of first slices that span all. The last `withheld` slices
    only test whether the span holds."""

    def of(v: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(v.sort_values("r")["v"].to_list())
        known = x[: len(x) - withheld] if withheld else x
        if len(known) < 2:
            return pd.DataFrame([])
        rank = krylov_rank(known)
        order = next((k for k in range(1, min(MOST_ORDER, len(known)) + 1) if krylov_rank(known[:k]) >= rank), len(known))
        able = len(known) >= LEAST_SLICES
        delta = krylov_rank(x) - rank if withheld and able else None
        row = (v["instance_id"].iloc[0], len(known), rank, order, able, able and order <= MOST_PROMOTED, delta, delta == 0)
        return pd.DataFrame([row], columns=[c.split()[0] for c in RECURRENCE.split(", ")]).astype({"withheld_rank_delta": "Int64"})

    return slices.groupBy("instance_id").applyInPandas(of, RECURRENCE)


@query()
def recurrence_order(spark, sf_dir):
    """Slices of low rank: each vector is reduced to its part along the first one to three cosine axes, by its instance's place."""
    wave = lambda i, k: F.cos(F.lit(math.pi) * (i + F.lit(0.5)) * k / F.size("v"))
    along = lambda k: F.aggregate(F.transform("v", lambda x, i: x * wave(i, k)), F.lit(0.0), lambda s, x: s + x)
    parts = [F.when(F.col("instance_id") % 3 >= k, F.col(f"c{k}")).otherwise(0.0) for k in range(3)]
    reduced = F.transform("v", lambda x, i: parts[0] + parts[1] * wave(i, 1) + parts[2] * wave(i, 2))
    rows = instances(spark, sf_dir).select("*", *[along(k).alias(f"c{k}") for k in range(3)])
    return recurrence(rows.withColumn("v", reduced).drop("c0", "c1", "c2"), 2)


TEMPLATES = descriptors.template_names()


@query(X + """, b AS (SELECT vec_id, i, x, """ + ", ".join(f"lag(x, {k}) OVER o AS b{k}" for k in (1, 5, 32)) + """ FROM x WINDOW o AS (PARTITION BY vec_id ORDER BY i)),
c AS (SELECT vec_id, """ + ", ".join(f"round(corr(x, b{k}), 5) AS autocorr_{k}" for k in (1, 5, 32)) + ", " + ", ".join(f"round(quantile_cont(x, {q / 100}), 5) AS quantile_{q}" for q in (5, 35, 95)) + """,
 round(pow(sum(pow(abs(x), 3)), 1 / 3.0), 5) AS norm_3 FROM b GROUP BY vec_id)""" + COEFFICIENTS.format(source="x") + """, d AS (SELECT vec_id, round(sum(c * c) FILTER (k >= 17 AND k < 21) / sum(c * c), 5) AS walsh_band_4 FROM w GROUP BY vec_id)
SELECT * FROM c JOIN d USING (vec_id)""")
def descriptor_templates(spark, sf_dir):
    names = ["autocorr_1", "autocorr_5", "autocorr_32", "quantile_5", "quantile_35", "quantile_95", "norm_3", "walsh_band_4"]
    return described(spark, sf_dir, descriptors.templates, TEMPLATES, 5).select("vec_id", *names)


@query()
def rank_templates(spark, sf_dir):
    """All templates by their correlation with the vectors' largest amplitude, strongest first."""
    e = embeddings(spark, sf_dir)
    d = descriptors.described(e, "v", ["v", "label"], descriptors.templates, TEMPLATES)
    d = d.withColumn("target", F.array_max(F.transform("v", lambda x: F.abs(x)))).withColumn("size", F.col("label").cast("int"))
    scored = candidates.scored(d.select("size", "target", *TEMPLATES), [candidates.var(t) for t in TEMPLATES])
    return rounded(candidates.ranked(scored, 20, 0.25))


@query(INSTANCES + """, n AS (SELECT instance_id, r, v, lead(v) OVER w AS nv, lead(r) OVER w AS nr FROM s WINDOW w AS (PARTITION BY instance_id ORDER BY r))
SELECT count(*) AS steps, round(corr(v[1], nv[1]), 6) AS r_first, round(regr_slope(nv[1], v[1]), 6) AS slope_first FROM n WHERE nr = r + 1""")
def consecutive_slices(spark, sf_dir):
    n = statistics.successors(instances(spark, sf_dir), "instance_id", ["r"], ["v", "r"]).where("next_r = r + 1")
    x, y = F.get("v", F.lit(0)), F.get("next_v", F.lit(0))
    return rounded(n.agg(F.count("*").alias("steps"), F.corr(x, y).alias("r_first"), slope(y, x).alias("slope_first")))


@query()
def state_dynamics(spark, sf_dir):
    """Linear map from each slice to the next by ridge regression on Gram sums; its rank and error."""
    n = statistics.successors(instances(spark, sf_dir), "instance_id", ["r"], ["v", "r"]).where("next_r = r + 1")
    return models.linear_map(n, "v", "next_v", 1e-2)


@query(VEC + """SELECT vec_id, round(list_sum(list_transform(list_filter(range(0, 64), lambda k: k % 8 >= k // 8), lambda k: v[k + 1])), 5) AS upper_sum, CAST(36 AS INTEGER) AS n_upper FROM e""")
def upper_triangle(spark, sf_dir):
    upper = F.filter("v", lambda x, i: i % 8 >= F.floor(i / 8))
    e = embeddings(spark, sf_dir).select("vec_id", upper.alias("u"))
    return rounded(e.select("vec_id", F.aggregate("u", F.lit(0.0), lambda s, x: s + x).alias("upper_sum"), F.size("u").alias("n_upper")), 5)


@query(VEC + """SELECT vec_id, list_sum(list_transform(list_filter(range(0, 64), lambda i: i % 2 = 1), lambda i: v[i + 1] * v[i + 1])) < 0.4 * list_sum(list_transform(v, lambda x: x * x)) AS mostly_even FROM e""")
def parity_claim(spark, sf_dir):
    odd = F.filter("v", lambda x, i: i % 2 == 1)
    return embeddings(spark, sf_dir).select("vec_id", (energy(odd) < 0.4 * energy(F.col("v"))).alias("mostly_even"))



@query()
def recurrence_outcome(spark, sf_dir):
    return recovery.recurrence_verdict(recurrence_order(spark, sf_dir), 30)


@query(VEC + """SELECT d.doc_id AS instance_id, CAST(d.doc_id % 3 AS INTEGER) AS family_index, CAST(len(e.v) AS INTEGER) AS n FROM documents d LEFT JOIN e ON e.vec_id = d.doc_id AND e.label % 3 = d.doc_id % 3""")
def array_payload(spark, sf_dir):
    key = F.col("label") % 3
    arrays = embeddings(spark, sf_dir).select(F.col("vec_id").alias("instance_id"), key.cast("int").alias("family_index"), F.col("v").alias("values"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("instance_id"), (F.col("doc_id") % 3).cast("int").alias("family_index"))
    joined = storage.with_arrays(docs, arrays)
    return joined.select("instance_id", "family_index", F.when(F.col("values").isNotNull(), F.size("values")).alias("n"))
