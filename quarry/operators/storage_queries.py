"""Registered queries over runs, catalogues, splits and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import candidates, promotion, relational, storage
from quarry.operators.registered import FEATURES, FLAT, query, rounded
from quarry.sources.tables import flat_features, table
from quarry.streaming.ingest import drained, feature_stream, windowed_counts

ORIGINS = [("quantity", "structural"), ("price", "oracle"), ("discount", "sampled"), ("tax", "structural"), ("target", "outcome")]
CATALOG_SQL = "c(prefix, origin) AS (VALUES " + ", ".join(f"('{p}', '{o}')" for p, o in ORIGINS) + ")"


def catalog(spark):
    return spark.createDataFrame(ORIGINS, "prefix string, origin string")


@query(FLAT + "SELECT instance_id, family_index, size, generator, target, price FROM f")
def retain_topk(spark, sf_dir):
    rows = flat_features(spark, sf_dir)
    scores = candidates.scored(rows, [candidates.var(c) for c in FEATURES])
    return storage.retained(rows, "target", scores, 1)


@query("""WITH a AS (SELECT o_orderkey AS instance_id, CAST(o_orderkey % 12 AS INTEGER) AS family_index, CAST(length(o_orderpriority) AS INTEGER) AS size, o_orderstatus AS generator, o_totalprice AS price FROM orders),
r AS (SELECT *, CAST(NULL AS BIGINT) AS customer, 'first' AS run_id FROM a WHERE generator <> 'O' UNION ALL SELECT a.*, o_custkey, 'second' FROM a JOIN orders ON instance_id = o_orderkey AND a.price = o_totalprice WHERE generator <> 'F')
SELECT run_id, generator, count(*) AS n, count(customer) AS customers, round(sum(price), 2) AS total FROM r GROUP BY ALL""")
def merge_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("instance_id"), (F.col("o_orderkey") % 12).cast("int").alias("family_index"), F.length("o_orderpriority").alias("size"), F.col("o_orderstatus").alias("generator"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    both = storage.merged_runs({"second": rows.where("generator <> 'F'"), "first": rows.where("generator <> 'O'").drop("customer")})
    return rounded(both.groupBy("run_id", "generator").agg(F.count("*").alias("n"), F.count("customer").alias("customers"), F.sum("price").alias("total")), 2)


@query("""WITH r AS (SELECT o_orderkey AS instance_id, 0 AS family_index, o_totalprice AS price, 'first' AS run_id FROM orders WHERE o_orderpriority < '4' UNION ALL SELECT o_orderkey, 0, -o_totalprice, 'second' FROM orders WHERE o_orderpriority >= '2')
SELECT instance_id, family_index, arg_min(run_id, run_id) AS run_id, arg_min(price, run_id) AS price FROM r GROUP BY ALL""")
def sealed_campaign(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("family_index", F.lit(0))
    first = orders.where("o_orderpriority < '4'").select(F.col("o_orderkey").alias("instance_id"), "family_index", F.col("o_totalprice").alias("price"))
    second = orders.where("o_orderpriority >= '2'").select(F.col("o_orderkey").alias("instance_id"), "family_index", (-F.col("o_totalprice")).alias("price"))
    return storage.campaign({"first": first, "second": second})


@query(FLAT + "SELECT instance_id, family_index, size, generator, quantity, discount, tax, target FROM f")
def clean_run(spark, sf_dir):
    return storage.clean(flat_features(spark, sf_dir), "target", catalog(spark))


@query(FLAT + ", r AS (SELECT generator AS run_id, * FROM f) SELECT run_id, count(*) AS rows, count(DISTINCT instance_id) AS instances, count(DISTINCT size) AS sizes, CAST(sum(CAST('0x' || substr(sha256(instance_id || ':' || family_index), 1, 15) AS HUGEINT)) AS VARCHAR) AS mark FROM r GROUP BY run_id")
def dataset_manifest(spark, sf_dir):
    rows = flat_features(spark, sf_dir)
    return storage.manifest({g: rows.where(F.col("generator") == g) for g in ("A", "N", "R")}).drop("fingerprint")


@query(FLAT + ", p AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT instance_id, arg_min(size, (family_index, size, generator)) AS size, arg_min(generator, (family_index, size, generator)) AS generator FROM f WHERE instance_id NOT IN (SELECT o_orderkey FROM p) GROUP BY instance_id")
def backfill_instances(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("instance_id"))
    rows = flat_features(spark, sf_dir)
    per = rows.groupBy("instance_id").agg(F.min(F.struct("family_index", "size", "generator")).alias("first"))
    one = per.select("instance_id", "first.family_index", "first.size", "first.generator")
    return storage.missing_instances(one, known)


@query("SELECT o_orderkey, o_custkey, CASE WHEN u < 60 THEN 'discovery' WHEN u < 80 THEN 'calibration' ELSE 'confirmatory' END AS split_fold FROM orders JOIN (SELECT c_custkey, CAST('0x' || substr(sha256('7:' || CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS u FROM customer) ON o_custkey = c_custkey")
def attach_splits(spark, sf_dir):
    folds = relational.assigned_splits(table(spark, sf_dir, "customer"), "c_custkey", "7", [], "c_mktsegment").select(F.col("c_custkey").alias("o_custkey"), "split_fold")
    return relational.with_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), folds, "o_custkey").select("o_orderkey", "o_custkey", "split_fold")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN (SELECT c_custkey, CAST('0x' || substr(sha256('7:' || CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS u FROM customer) ON o_custkey = c_custkey WHERE u < 60 OR u >= 80")
def filter_folds(spark, sf_dir):
    rows = attach_splits(spark, sf_dir).where(F.col("split_fold").isin("discovery", "confirmatory"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


EXPRESSIONS = ["log(price) / (quantity + 1)", "sqrt(discount) * tax", "quantity ** 2", "retail - tax", "abs(target)"]


@query(f"""WITH {CATALOG_SQL}, e AS (SELECT p_brand, p_type, CASE (length(p_type) + CAST(substr(p_brand, 7) AS INTEGER)) % 5 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXPRESSIONS))} END AS expression FROM (SELECT DISTINCT p_brand, p_type FROM part)),
u AS (SELECT DISTINCT p_brand || ':' || p_type AS id, expression, unnest(regexp_extract_all(regexp_replace(expression, '[a-z]+\\(', '(', 'g'), '[a-z]+')) AS feature FROM e),
b AS (SELECT id, expression, feature, coalesce(origin, 'unknown') IN ('unknown', 'oracle', 'outcome') AS blocked FROM u LEFT JOIN c ON feature = prefix)
SELECT id, expression, bool_or(blocked) AS blocked, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (blocked), '') AS because FROM b GROUP BY ALL""")
def audit_conjectures(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    which = (F.length("p_type") + F.substring("p_brand", 7, 10).cast("int")) % 5
    e = part.select(F.concat_ws(":", "p_brand", "p_type").alias("id"), F.element_at(F.array(*[F.lit(x) for x in EXPRESSIONS]), which + 1).alias("expression"))
    return relational.audited_expressions(e, "expression", "id", catalog(spark))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS a, CASE WHEN event_id % 7 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS b FROM events)
SELECT event_id, CASE WHEN a IS NULL AND b = 'x' THEN 'missing a,b is no long' WHEN a IS NULL THEN 'missing a' ELSE 'b is no long' END AS errors FROM r WHERE a IS NULL OR b = 'x'""")
def typed_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("a"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("user_id").cast("string")).alias("b"))
    return relational.typed_errors(rows, {"a": "string", "b": "long"}).select("event_id", F.concat_ws(",", "errors").alias("errors"))


def nested(spark, sf_dir):
    """Slices with maps, and scalars of their instances."""
    line = table(spark, sf_dir, "lineitem")
    slices = line.select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("family_index"), F.create_map(F.lit("quantity"), "l_quantity", F.lit("tax"), "l_tax").alias("descriptors"),
        F.create_map(F.lit("price"), "l_extendedprice").alias("metrics"),
    )
    orders = table(spark, sf_dir, "orders")
    scalars = orders.select(F.col("o_orderkey").alias("instance_id"), F.create_map(F.lit("total"), "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, "tax").otherwise("other"), F.lit(0.5)).alias("scalars"))
    return slices, scalars


@query("SELECT l_orderkey AS instance_id, l_linenumber AS family_index, l_quantity AS quantity, l_tax AS tax, l_extendedprice AS price, o_totalprice AS total, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(0.5 AS DOUBLE) END AS other FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def flatten_maps(spark, sf_dir):
    flat = relational.flattened(*nested(spark, sf_dir), "instance_id")
    names = {"quantity": "quantity", "tax": "tax", "price": "metric.price", "total": "total", "other": "other"}
    return flat.select("instance_id", "family_index", *[F.try_element_at("features", F.lit(f)).alias(n) for n, f in names.items()])


@query("SELECT DISTINCT o_orderkey AS instance_id, 'tax' AS name FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def duplicated_scalar_keys(spark, sf_dir):
    slices, scalars = nested(spark, sf_dir)
    return relational.duplicated_scalars(slices, scalars.withColumnRenamed("scalars", "descriptors"), "instance_id", "descriptors")


@query("SELECT count(*) AS rows, sha256(array_to_string(list_concat(['event_id'], list_sort(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'])), chr(31))) AS columns, CAST(sum(CAST('0x' || substr(sha256('=' || event_id), 1, 15) AS HUGEINT)) AS VARCHAR) AS mark FROM events")
def population_fingerprint(spark, sf_dir):
    return promotion.population(table(spark, sf_dir, "events"), "event_id")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    """Events read as a stream and counted in windows of an hour."""
    # a pattern, since the table may be one file or a folder
    stream = feature_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)
    # a watermark needs an instant; whole hours are the same in the session's time zone
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "2 days")
    hours = drained(counts, ["start", "event_type"], "stream-counts")
    return rounded(hours.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total"), 4)
