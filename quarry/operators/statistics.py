"""Statistics over flat feature rows: correlations, stability, distributions, scaling, resampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import HUGE, finite, intercept, pearson, slope
from quarry.operators.candidates import correlation, pooled, scored, slots, var
from quarry.sources.steps import written


def unpivoted(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep..., column, value): one pass over the rows whatever the number of columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.column", "p.value")


def correlate(rows: DataFrame, columns: list[str], target: str = "target", least: float = 0.0) -> DataFrame:
    """Per column: r, r2, n and the share of size groups whose sign of r agrees with the overall sign; strongest first."""
    scores = scored(rows, [var(c) for c in columns], target).where(F.abs("r") >= least)
    return scores.select(F.col("candidate").alias("column"), "r", "r2", "n", "stability").orderBy(F.desc(F.abs("r")), "column")


def report(rows: DataFrame, columns: list[str], target: str = "target", least: float = 0.2) -> DataFrame:
    """The same, with a place: columns of known stability first, most stable first, then by strength."""
    found = correlate(rows, columns, target, least)
    order = [F.col("stability").isNull(), F.desc("stability"), F.desc(F.abs("r")), "column"]
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a row for each column


def pair_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Centred moments of every pair of columns, over the rows where both are finite: one row a slot and pair is shuffled."""
    k = len(columns)
    schema = "a int, b int, seen long, n long, mx double, my double, xx double, xy double, yy double, huge boolean"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift, sums, seen, huge = None, None, 0, np.zeros(k, dtype=bool)
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            if not len(x):
                continue
            good = np.isfinite(x)
            huge |= (good & (np.abs(x) >= HUGE)).any(0)
            good &= np.abs(x) < HUGE
            if shift is None:  # sums about a value near the mean do not cancel
                shift = np.where(good, x, 0).sum(0) / np.maximum(good.sum(0), 1)
            d, m = np.where(good, x - shift, 0), good.astype(float)
            fresh = np.stack([m.T @ m, d.T @ m, m.T @ d, (d * d).T @ m, d.T @ d, m.T @ (d * d)])
            sums, seen = fresh if sums is None else sums + fresh, seen + len(x)
        if sums is not None:
            n, sx, sy, xx, xy, yy = sums
            some = np.maximum(n, 1)
            a, b = np.triu_indices(k)
            out = [seen, n, shift[:, None] + sx / some, shift[None, :] + sy / some, xx - sx * sx / some, xy - sx * sy / some, yy - sy * sy / some]
            cells = {name: (np.full(len(a), v) if np.isscalar(v) else v[a, b]) for name, v in zip(("seen", "n", "mx", "my", "xx", "xy", "yy"), out, strict=True)}
            yield pd.DataFrame({"a": a, "b": b, **cells, "huge": huge[a] | huge[b]}).astype({"n": "int64"})

    clean = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return pooled(clean.coalesce(slots(rows)).mapInPandas(partial, schema), ["a", "b"])


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long matrix (a, b, r): 1 on the diagonal, null where undefined."""
    names = F.array(*[F.lit(c) for c in columns])
    upper = pair_moments(rows, columns).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(correlation()).alias("r"))
    both = upper.union(upper.where("a <> b").select(F.col("b"), F.col("a"), "r"))
    return both.select(F.get(names, "a").alias("a"), F.get(names, "b").alias("b"), "r")


def top_correlation_matrix(rows: DataFrame, columns: list[str], target: str = "target", most: int = 12, least: float = 0.2) -> DataFrame:
    """The matrix over the target and its strongest columns."""
    chosen = [r["column"] for r in correlate(rows, columns, target, least).limit(most).collect()]  # at most `most` names
    return correlation_matrix(rows, [target, *chosen])


def distribution(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    x = finite(F.col(column))
    return rows.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")
    )


def outliers(rows: DataFrame, column: str, keep: list[str], threshold: float = 2.5) -> DataFrame:
    """Rows far from the mean in standard deviations. The one-row statistics are broadcast: their size is fixed."""
    x = finite(F.col(column))
    stats = rows.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n")).where("n >= 3 AND sd > 0")
    scored = rows.join(F.broadcast(stats), how="inner", on=F.lit(True)).withColumn("z_score", (x - F.col("mu")) / F.col("sd"))
    return scored.where(F.abs("z_score") >= threshold).select(*keep, column, "z_score")


def separation(rows: DataFrame, column: str, label: str = "generator") -> DataFrame:
    """Between-group over within-group sum of squares."""
    groups = rows.groupBy(label).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v"))
    return groups.agg(
        F.count("*").alias("groups"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"),
    ).select("groups", F.when((F.col("groups") >= 2) & (F.col("within") > 0), F.col("between") / F.col("within")).alias("separation"))


def ranks(rows: DataFrame, order: list, name: str, release: bool = False) -> DataFrame:
    """rows with their place (from 0) in a total order: sorted ranges, numbered within, plus the count of rows before each
    range. No task holds more than a range. The ranges are written first, since two passes must see the same ones; release: as
    in written()."""
    within = F.monotonically_increasing_id()  # the task's number above the low 33 bits, then the row's
    laid = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", within), name, release)
    laid = laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return laid.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_in")).drop("_id", "_part", "_in", "_start")


def successors(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """(by, place, columns, next_<column>...): each row beside the next one of its group in the order, null at the end. Places
    are joined, so that a group of any size is spread over tasks. Rows without a group are left out."""
    placed = written(ranks(rows.select(*dict.fromkeys([by, *order, *columns])).where(F.col(by).isNotNull()), [by, *order], "successors"), "placed")
    after = placed.select(F.col(by), (F.col("place") - 1).alias("place"), *[F.col(c).alias(f"next_{c}") for c in columns], F.lit(True).alias("has_next"))
    return placed.select(by, "place", *[c for c in columns if c != by]).join(after, [by, "place"], "left")


def medians(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by..., median, n) of finite values, exactly, whatever the size of a group."""
    return quantiles(rows, by, value, 0.5).select(*by, F.col("quantile").alias("median"), "n")


def quantiles(rows: DataFrame, by: list[str], value: Column, q: float) -> DataFrame:
    """(by..., quantile, n) of finite values, exactly, between the two nearest places in proportion: equal values are counted
    first, then the distinct ones are placed in order, so that no group is held. Rows whose group is null are left out."""
    counted = rows.select(*by, finite(value).alias("v")).dropna().groupBy(*by, "v").agg(F.count("*").alias("held"))
    groups = counted.groupBy(*by).agg(F.sum("held").alias("n"))
    placed = weighted_places(counted, by)
    at = F.lit(q) * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    here = placed.join(groups, by) if by else placed.join(F.broadcast(groups), on=F.lit(True))
    inside = lambda k: (F.col("first") <= k) & (k < F.col("first") + F.col("held"))
    pick = lambda k: F.max(F.when(inside(k), F.col("v")))
    near = here.where(inside(low) | inside(high)).groupBy(*by, "n").agg(pick(low).alias("_a"), pick(high).alias("_b"))
    return near.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - low)).alias("quantile"), "n")


#: A key is hot if it holds more than this part of all rows: there are at most so many hot keys.
HOT = 4096


def looked_up(many: DataFrame, few: DataFrame, keys: list[str], held: str) -> DataFrame:
    """many joined with few (one row a key, with the number of rows that the key holds): the rows of hot keys, which are HOT at
    most, meet them by a broadcast, others by a shuffle."""
    total = few.agg(F.sum(held)).first()[0] or 0
    hot = F.col(held) * HOT > F.lit(total)
    top = F.broadcast(few.where(hot))
    return many.join(top, keys).unionByName(many.join(top.select(keys), keys, "left_anti").join(few.where(~hot), keys)).drop(held)


def spearman(rows: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """(by..., n, rho, t): rank correlation over the rows where both are finite, equal values sharing their mean rank, and its t
    value; null for fewer than three rows or no spread. A value's rank is the count of smaller ones plus half of one more than
    its equals, from sorted ranges, so that a value that fills a third of the rows is one place. Rows whose group is null are left out."""
    by = list(by)
    pairs = rows.select(*by, finite(F.col(x)).alias("a"), finite(F.col(y)).alias("b")).dropna().groupBy(*by, "a", "b").agg(F.count("*").alias("pairs"))
    pairs = written(pairs, "pairs")
    counts = pairs.groupBy(*by).agg(F.sum("pairs").alias("n"))
    for c in ("a", "b"):
        placed = weighted_places(pairs.groupBy(*by, F.col(c).alias("v")).agg(F.sum("pairs").alias("held")), by)
        ranked = placed.select(*by, F.col("v").alias(c), (F.col("first") + (F.col("held") + 1) / 2).alias(f"rank_{c}"), "held")
        pairs = written(looked_up(pairs, written(ranked, "ranked"), [*by, c], "held"), "pairs")
    pairs = pairs.join(counts, by) if by else pairs.join(F.broadcast(counts), on=F.lit(True))
    middle = (F.col("n") + 1) / 2  # the mean of ranks
    w, da, db = F.col("pairs"), F.col("rank_a") - middle, F.col("rank_b") - middle
    sums = pairs.groupBy(*by, "n").agg(F.sum(w * da * db).alias("ab"), F.sum(w * da * da).alias("aa"), F.sum(w * db * db).alias("bb"))
    rho = F.when((F.col("n") >= 3) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb"))
    return sums.select(*by, "n", rho.alias("rho"), (rho * F.sqrt((F.col("n") - 2) / F.nullif(1 - rho * rho, F.lit(0.0)))).alias("t"))


def weighted_places(counted: DataFrame, by: list[str]) -> DataFrame:
    """counted with `first`: how many values of its group lie before it."""
    within = F.monotonically_increasing_id()
    order = [*by, "v"]
    laid = written(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", within), "places")
    laid = laid.withColumn("_part", F.shiftright("_id", 33))
    local = Window.partitionBy("_part", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("_before", F.coalesce(F.sum("held").over(local), F.lit(0)))
    parts = laid.groupBy("_part", *by).agg(F.sum("held").alias("_n"))  # a group has a row for each range that it reaches
    ahead = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_part", *by, F.coalesce(ahead, F.lit(0)).alias("_start"))
    return laid.join(starts, ["_part", *by]).withColumn("first", F.col("_start") + F.col("_before")).drop("_id", "_part", "_before", "_start")


def group_median_error(rows: DataFrame, target: str, label: str) -> DataFrame:
    """Mean absolute error of the median of each group; rows without a label form the group unknown."""
    named = rows.withColumn(label, F.coalesce(label, F.lit("unknown")))
    centres = medians(named, [label], F.col(target)).select(label, F.col("median").alias("centre"))
    return named.join(centres, label).agg(F.avg(F.abs(F.col(target) - F.col("centre"))).alias("mae"), F.count("*").alias("n"))


def variation_within(rows: DataFrame, target: str, key: str = "instance_id") -> DataFrame:
    """Median over instances of the coefficient of variation."""
    per = rows.groupBy(key).agg(F.count(target).alias("n"), F.stddev_pop(target).alias("sd"), F.avg(target).alias("m")).where("n >= 2")
    return medians(per.drop("n"), [], F.col("sd") / F.greatest("m", F.lit(1e-12))).select(F.col("median").alias("cv"), F.col("n").alias("instances"))


def degeneracy(rows: DataFrame, target: str) -> DataFrame:
    x = finite(F.col(target))
    return rows.agg(F.count(x).alias("n"), F.stddev_pop(x).alias("std"), F.avg(x).alias("mean")).select(
        "n",
        ((F.col("n") < 2) | (F.col("std") < 1e-12) | (F.col("std") / F.greatest(F.abs("mean"), F.lit(1.0)) < 1e-9)).alias("degenerate"),
    )


def median_by_size(rows: DataFrame, column: str) -> DataFrame:
    return medians(rows, ["size"], F.col(column))


def log_scaling(rows: DataFrame, columns: list[str], exponential: float = 0.3) -> DataFrame:
    """Fit ln(median) = a * size + b over sizes with a positive median."""
    found = medians(unpivoted(rows, columns, ["size"]), ["column", "size"], F.col("value")).where("median > 0")
    y, x = F.log("median"), F.col("size").cast("double")
    return found.groupBy("column").agg(
        F.count("*").alias("sizes"), slope(y, x).alias("a"), intercept(y, x).alias("b"), pearson(x, y, 2).alias("r")
    ).select("column", "sizes", "a", "b", F.pow("r", 2).alias("r2"), (F.col("a") > exponential).alias("is_exponential"))


def ols_by_group(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        slope(F.col(y), F.col(x)).alias("slope"), intercept(F.col(y), F.col(x)).alias("intercept"),
        F.pow(pearson(F.col(x), F.col(y)), 2).alias("r2"), F.count("*").alias("n"),
    )


def imputed(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Columns with what is not finite replaced by the column's mean (0 without any finite value)."""
    means = rows.agg(*[F.avg(finite(F.col(c))).alias(f"mean_{c}") for c in columns])
    filled = [F.coalesce(finite(F.col(c)), F.col(f"mean_{c}"), F.lit(0.0)).alias(c) for c in columns]
    return rows.join(F.broadcast(means), on=F.lit(True)).select(*keep, *filled)


def benjamini_hochberg(tests: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """q values over one list of tests: a candidate list, small by nature, so one ordered window serves."""
    up = Window.orderBy(p, key)
    down = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("rank", F.row_number().over(up)).withColumn("m", F.count("*").over(Window.partitionBy()))
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(down))).withColumn(
        "reject", F.col("q") <= alpha
    ).drop("m")


def draw(*parts: Column, seed: int = 0) -> Column:
    """A uniform draw in [0, 1) keyed by its parts: the same on every cluster."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def poisson_steps(most: int = 12) -> np.ndarray:
    """The distribution function of Poisson(1) at 0, 1, ...: as many numbers are at or below a uniform draw as it stands for."""
    share = np.cumprod([1.0, *range(1, most)])
    return np.cumsum(1 / share) / math.e


def cluster_bootstrap(rows: DataFrame, x: str, y: str, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """Correlation per replicate, clusters drawn by Poisson(1) numbers, which stand for resampling with replacement. Moments
    are additive, so clusters are reduced to sums about the overall means first; a task then weighs its clusters for all
    replicates at once. Draws are keyed by cluster: a SHA-256 gives eight replicates their 32 bits each."""
    px, py = finite(F.col(x)), finite(F.col(y))
    clean = rows.select(F.col(key).cast("string").alias("key"), px.alias("x"), py.alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND key IS NOT NULL")
    means = clean.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    about = clean.join(F.broadcast(means), on=F.lit(True)).select("key", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    moments = about.groupBy("key").agg(
        F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )
    blocks, steps = -(-replicates // 8), poisson_steps()

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, len(names) + 1))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                digests = [hashlib.sha256(f"{seed}:{b}:{k}".encode()).digest() for k in part["key"] for b in range(blocks)]
                u = np.frombuffer(b"".join(digests), ">u4").reshape(len(part), -1)[:, :replicates] / 2.0**32
                w = np.searchsorted(steps, u, "right").astype(float)
                total[:, 0] += (w > 0).sum(0)
                total[:, 1:] += w.T @ part[names].to_numpy()
        yield pd.DataFrame(total, columns=["clusters", *names]).assign(replicate=np.arange(replicates))

    schema = "clusters double, " + ", ".join(f"{c} double" for c in names) + ", replicate long"
    sums = moments.mapInPandas(drawn, schema).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("clusters", *names)])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = (F.col("sxx") - F.pow("sx", 2) / F.col("n")) * (F.col("syy") - F.pow("sy", 2) / F.col("n"))
    return sums.where("clusters >= 2").select("replicate", F.when(spread > 0, cov / F.sqrt(spread)).alias("r"))


def permuted_target(rows: DataFrame, target: str, key: list[str], seed: int = 0) -> DataFrame:
    """The target shuffled across all rows: the i-th row by key gets the i-th target by hashed key."""
    ident = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    a = ranks(rows.select("size", *key, F.col(target).alias("_t")), [*key, "_t"], "by-key").drop("_t")
    hashed = rows.select(F.sha2(F.concat_ws(":", F.lit(str(seed)), ident), 256).alias("_h"), F.col(target).alias("permuted"))
    b = ranks(hashed, ["_h", "permuted"], "by-hash").drop("_h")
    return a.join(b, "place").drop("place")


def kmeans(rows: DataFrame, columns: list[str], start: list[list[float]], rounds: int) -> DataFrame:
    """Lloyd's rounds from given centroids on mean-imputed columns: (cluster, size, centroid...). An empty cluster keeps its
    centroid. The centroids are few: they go into the next round's expressions."""
    clean = written(imputed(rows, columns, []), "imputed")
    centres = [list(map(float, c)) for c in start]
    for _ in range(rounds):
        found = clean.groupBy(nearest(columns, centres).alias("cluster")).agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns]).collect()
        moved = list(centres)
        for r in found:
            moved[r["cluster"]] = [r[c] for c in columns]
        if moved == centres:
            break
        centres = moved
    out = clean.groupBy(nearest(columns, centres).alias("cluster")).agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns])
    return out


def nearest(columns: list[str], centres: list[list[float]]) -> Column:
    """Number of the nearest centroid; ties to the smaller number."""
    away = [sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(away)]))["i"]


def size_index_r2(rows: DataFrame, target: str, size: str = "size", index: str = "family_index") -> DataFrame:
    """R2 of the target on size and index: the baseline that a discovery must beat. From centred moments of three columns."""
    y, a, b = (finite(F.col(c)) for c in (target, size, index))
    clean = rows.select(y.alias("y"), a.alias("a"), b.alias("b")).dropna()
    m = clean.agg(
        F.count("*").alias("n"), F.var_pop("y").alias("yy"), F.var_pop("a").alias("aa"), F.var_pop("b").alias("bb"),
        F.covar_pop("a", "b").alias("ab"), F.covar_pop("a", "y").alias("ay"), F.covar_pop("b", "y").alias("by"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    both = (F.col("bb") * F.pow("ay", 2) - 2 * F.col("ab") * F.col("ay") * F.col("by") + F.col("aa") * F.pow("by", 2)) / F.nullif(det, F.lit(0.0))
    return m.select("n", F.when((F.col("n") >= 3) & (F.col("yy") > 0), both / F.col("yy")).alias("r2"))


def panel(rows: DataFrame, witnesses: list[str], rank_like: list[str], order_like: list[str]) -> DataFrame:
    """(witness, slope, exponential, baseline, negative). Ranks match their baseline where they grow by 0.25 or more and
    exponentially, orders where their median is at most 4; the panel is negative with two exponential witnesses and a match."""
    by_size = medians(unpivoted(rows, witnesses, ["size"]), ["column", "size"], F.col("value")).where("median > 0")
    y, x = F.log("median"), F.col("size").cast("double")
    per = by_size.groupBy("column").agg(slope(y, x).alias("slope"), F.median("median").alias("centre"))  # few sizes
    exponential = F.coalesce(F.col("slope") > 0.3, F.lit(False))
    baseline = F.when(F.col("column").isin(*rank_like), exponential & (F.col("slope") >= 0.25)).when(F.col("column").isin(*order_like), F.col("centre") <= 4).otherwise(False)
    all_rows = Window.partitionBy()  # a row for each witness
    found = per.select(F.col("column").alias("witness"), "slope", exponential.alias("exponential"), baseline.alias("baseline"))
    count = lambda c: F.sum(F.col(c).cast("int")).over(all_rows)
    return found.withColumn("negative", (count("exponential") >= 2) & (count("baseline") >= 1))
