"""Relational operators on runs and feature rows: unions with priority, pending work, subsets, splits, leak audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def union_sealed_and_log(sealed: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Sealed rows, and the log's rows whose key is not sealed."""
    return sealed.unionByName(log.join(sealed.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def pending(instances: DataFrame, done: DataFrame, keys: list[str], index: str, indices: list[int]) -> DataFrame:
    """Every instance with every index, less what is done. The indices are a short list, so they multiply by explode."""
    requested = instances.select(*keys, F.explode(F.array(*[F.lit(i) for i in indices])).alias(index))
    return requested.join(done.select(*keys, index).distinct(), [*keys, index], "left_anti")


def subset(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def run_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.countDistinct("instance_id").alias("instances"), F.countDistinct("size").alias("sizes"),
        F.min("family_index").alias("first_index"), F.max("family_index").alias("last_index"),
    )


def assigned_splits(rows: DataFrame, key: str, seed: str, held_out: list[str], label: str) -> DataFrame:
    """Folds by hash of the key: held-out groups first, then 60/20/20."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    fold = F.when(F.col(label).isin(held_out), "held_out").when(u < 60, "discovery").when(u < 80, "calibration").otherwise("confirmatory")
    return rows.withColumn("split_fold", fold)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def invalid(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows with errors, and the list of them."""
    errors = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]), lambda e: e.isNotNull())
    return rows.withColumn("errors", errors).where(F.size("errors") > 0)


def distinct_vectors(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.countDistinct(*columns).alias("vectors"), F.count("*").alias("rows"))


def visibility(rows: DataFrame, columns: list[str], block: str, label: str) -> DataFrame:
    """A block shows its mechanism if it has several labels and several distinct vectors."""
    per = rows.groupBy(block).agg(F.countDistinct(label).alias("labels"), F.countDistinct(*columns).alias("vectors")).where("labels >= 2")
    return per.agg(F.count("*").alias("blocks"), F.coalesce(F.sum((F.col("vectors") > 1).cast("long")), F.lit(0)).alias("visible"))


def origins(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """(feature, origin): the longest prefix of the catalogue decides. Every prefix of a name meets the catalogue by equality."""
    prefixes = features.select("feature", F.explode(F.transform(F.sequence(F.lit(1), F.length("feature")), lambda n: F.col("feature").substr(F.lit(1), n))).alias("prefix"))
    best = prefixes.join(catalog, "prefix").groupBy("feature").agg(F.max_by("origin", F.length("prefix")).alias("origin"))
    return features.join(best, "feature", "left").select("feature", F.coalesce("origin", F.lit("unknown")).alias("origin"))


def audited(features: DataFrame, catalog: DataFrame, exempt: tuple[str, ...] = ("size", "family_index")) -> DataFrame:
    """What is unknown, an oracle or an outcome is blocked; exempt names are metadata and may predict."""
    found = origins(features, catalog)
    return found.withColumn("blocked", F.col("origin").isin("unknown", "oracle", "outcome") & ~F.col("feature").isin(*exempt))


def names_of(expressions: DataFrame, column: str, key: str) -> DataFrame:
    """(key, feature): the variables of expression texts; a name before a bracket is a function."""
    return expressions.select(key, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"([A-Za-z_][\w.]*)(?![\w.]*\s*\()"), F.lit(1)))).alias("feature"))


def audited_expressions(expressions: DataFrame, column: str, key: str, catalog: DataFrame) -> DataFrame:
    """An expression is blocked if any of its variables is."""
    used = names_of(expressions, column, key)
    verdicts = audited(used.select("feature").distinct(), catalog)
    per = used.join(verdicts, "feature").groupBy(key).agg(F.max("blocked").alias("blocked"), F.array_sort(F.collect_list(F.when(F.col("blocked"), F.col("feature")))).alias("because"))
    return expressions.select(key, column).join(per, key, "left").select(key, column, F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce(F.concat_ws(",", "because"), F.lit("")).alias("because"))


def with_split(rows: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    """rows with their instance's fold; a row whose instance has none is an error."""
    one = assignment.select(key, "split_fold").dropDuplicates([key])
    joined = rows.join(one, key, "left")
    missing = F.raise_error(F.concat(F.lit("no split for instance "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn("split_fold", F.coalesce("split_fold", missing.cast("string")))


def typed_errors(rows: DataFrame, required: dict[str, str]) -> DataFrame:
    """Rows with errors: a required text field that is missing, or is not of its type (long, double or string)."""
    checks = []
    for name, kind in required.items():
        c = F.col(name).cast("string")
        checks.append(F.when(c.isNull(), F.lit(f"missing {name}")))
        if kind != "string":
            checks.append(F.when(c.isNotNull() & c.try_cast(kind).isNull(), F.lit(f"{name} is no {kind}")))
    return rows.withColumn("errors", F.array_compact(F.array(*checks))).where(F.size("errors") > 0)


def duplicated_scalars(slices: DataFrame, scalars: DataFrame, key: str, column: str) -> DataFrame:
    """Names that both the slices and the instance of a key hold: (key, name)."""
    a = slices.select(key, F.explode(F.map_keys(column)).alias("name")).distinct()
    b = scalars.select(key, F.explode(F.map_keys(column)).alias("name")).distinct()
    return a.join(b, [key, "name"])


def flattened(slices: DataFrame, scalars: DataFrame, key: str) -> DataFrame:
    """Nested rows as one map: descriptors, metrics under `metric.`, and the instance's scalars where a slice lacks the name."""
    joined = slices.join(scalars.select(key, F.col("scalars").alias("_scalars")), key, "left")
    none = F.create_map().cast("map<string,double>")
    metrics = F.transform_keys(F.coalesce("metrics", none), lambda k, v: F.concat(F.lit("metric."), k))
    own = F.map_concat(F.map_filter(F.coalesce("descriptors", none), lambda k, v: ~F.map_contains_key(metrics, k)), metrics)
    extra = F.map_filter(F.coalesce("_scalars", none), lambda k, v: ~F.map_contains_key(own, k))
    return joined.select(*[c for c in slices.columns if c not in ("descriptors", "metrics")], F.map_concat(own, extra).alias("features"))
