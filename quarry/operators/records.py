"""Small columns that records carry: content ids, costs, distances, sizes, certificates, criteria that were not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import finite
from quarry.operators import models, representation

#: Cost of a descriptor by the prefix of its name; others cost 1.
COSTS = {
    "graph.": 1.0, "landscape.": 2.0, "spectral.": 1.5, "stats.": 0.5, "compress.": 3.0, "fourier.": 4.0, "walsh_log.": 5.0, "dynamics.": 2.0,
    "overlap.": 2.0, "update.": 2.0, "recurrence.": 2.5, "gen.": 0.25, "metric.": 0.1, "latent.": 4.0,
}
#: Prefixes of scalars over several slices.
CROSS_SLICE = ("dynamics.", "overlap.", "update.", "recurrence.")
#: Features of the update predictor, at most.
PREDICTORS = 24


def instance_id(domain: Column, size: Column, seed: Column, params: Column) -> Column:
    """Content hash of an instance: 16 hexadecimal digits of the SHA-256 of its JSON with sorted keys and no blanks. params: a map;
    texts are ASCII, as other characters have several JSON forms."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    text = F.to_json(F.struct(domain.alias("domain_id"), ordered.alias("params"), seed.alias("seed"), size.alias("size")))
    return F.substring(F.sha2(text, 256), 1, 16)


def descriptor_cost(name: Column) -> Column:
    """Cost of computing a descriptor, by the first prefix that fits."""
    cost = F.lit(1.0)
    for prefix, price in reversed(COSTS.items()):
        cost = F.when(name.startswith(prefix), price).otherwise(cost)
    return cost


def ledger(rows: DataFrame) -> DataFrame:
    """(descriptor, cost, total): what each numeric column costs by row and over all rows; metrics are free here."""
    numeric = [c for c, t in rows.dtypes if (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")) and not c.startswith("metric.")]
    names = rows.sparkSession.createDataFrame([(c,) for c in numeric], "descriptor string")
    count = rows.agg(F.count("*").alias("n"))
    priced = names.select("descriptor", descriptor_cost(F.col("descriptor")).alias("cost"))
    return priced.join(F.broadcast(count), on=F.lit(True)).select("descriptor", "cost", (F.col("cost") * F.col("n")).alias("total"))


def cross_slice(scalars: Column) -> Column:
    """The entries of a map of scalars that describe several slices."""
    starts = lambda k: F.startswith(k, F.lit(CROSS_SLICE[0])) | F.startswith(k, F.lit(CROSS_SLICE[1])) | F.startswith(k, F.lit(CROSS_SLICE[2])) | F.startswith(k, F.lit(CROSS_SLICE[3]))
    return F.map_filter(scalars, lambda k, _: starts(k))


def vacuous_criteria(criteria: Column) -> Column:
    """Sorted names of a map of criteria whose value was not measured: null, NaN or infinite."""
    return F.array_sort(F.map_keys(F.map_filter(criteria, lambda _, v: v.isNull() | finite(v).isNull())))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def step_operator_norm(before: Column, after: Column, weights: Column) -> Column:
    """Distance of a slice from the one before it, multiplied by weights and scaled to length 1; null for other lengths or a zero."""
    product = F.zip_with(weights, before, lambda w, x: w * x)
    length = norm(product)
    away = norm(F.zip_with(after, product, lambda b, p: b - p / length))
    return F.when((F.size(before) == F.size(after)) & (F.size(before) == F.size(weights)) & (length > 0), away)


def byte_size(values: Column) -> Column:
    """Bytes of an array of doubles."""
    return F.size(values).cast("long") * 8


def largest_difference(a: Column, b: Column) -> Column:
    """The default distance of two arrays: their largest absolute difference; null for other lengths or empty ones."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def certificates(df: DataFrame, vector: str, tolerance: float = 1e-9) -> DataFrame:
    """(representation, claim, n, error, tolerance, status, exact): whether each encoding's inverse gives its vectors back within the
    tolerance (verified, else refuted), and whether without any error. Null and empty vectors are left out."""
    v = F.col("_v")
    cells = [F.struct(F.lit(name).alias("representation"), largest_difference(back, v).alias("error")) for name, (_, back, _) in representation.encodings(v).items()]
    rows = df.select(F.col(vector).cast("array<double>").alias("_v")).where(F.size("_v") > 0).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    per = rows.groupBy("representation").agg(F.count("*").alias("n"), F.max("error").alias("error"))
    status = F.when(F.col("error") <= tolerance, "verified").otherwise("refuted")
    return per.select("representation", F.lit("exact_roundtrip").alias("claim"), "n", "error", F.lit(tolerance).alias("tolerance"), status.alias("status"), (F.col("error") == 0).alias("exact"))


def held_out_by_prefix(generator: Column, groups: list[str]) -> Column:
    """Whether a generator belongs to a held-out group: it begins with the group's name or holds it."""
    out = F.lit(False)
    for group in groups:
        out = out | F.contains(generator, F.lit(group))
    return F.coalesce(out, F.lit(False))


def update_predictor(rows: DataFrame, features: list[str], update: str) -> DataFrame:
    """(n, features, r2): ridge regression of the mean step on at most PREDICTORS columns, over complete rows; r2 is null with fewer
    rows than the columns and one, or four."""
    used = [c for c in features if c != update][:PREDICTORS]
    clean = rows.select(*[finite(F.col(c)).alias(c) for c in [*used, update]]).dropna()
    found = models.ridge(clean, used, update).agg(F.max("n").alias("n"), F.max("r2").alias("r2"))
    return found.select("n", F.lit(len(used)).alias("features"), F.when(F.col("n") >= max(4, len(used) + 1), F.col("r2")).alias("r2"))
