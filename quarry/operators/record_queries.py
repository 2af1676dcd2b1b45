"""Registered queries of conjecture records, archives, ids, costs and certificates, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import array_queries, candidates, promotion, records, statistics
from quarry.operators.array_queries import INSTANCES, instances
from quarry.operators.registered import FEATURES, FLAT, query, rounded
from quarry.operators.search_queries import scores_sql
from quarry.plans import expression as ex
from quarry.sources.steps import written
from quarry.sources.tables import flat_features, table

HITS = ex.products(FEATURES)


@query(f"""WITH s AS ({scores_sql(HITS)}), r AS (SELECT 'metric_dsl' AS source, candidate AS expression, length + 1.0 AS mdl, * FROM s
UNION ALL SELECT 'gp', candidate, length(candidate) * 0.05 + 2.0, * FROM s
UNION ALL SELECT 'latent_interpretation', 'latent_' || length || ' ≈ ' || candidate, length(candidate) * 0.05 + 3.0, * FROM s
UNION ALL SELECT 'symbolic', candidate, 1 + CASE WHEN candidate LIKE '%price%' THEN 0.5 ELSE 1.5 END + length(candidate) * 0.01, * FROM s)
SELECT source, expression, round(CAST(mdl AS DOUBLE), 4) AS mdl, CASE WHEN r2 >= 0.75 THEN 1 ELSE 0 END AS level FROM r WHERE r2 >= 0.3
QUALIFY row_number() OVER (ORDER BY -CASE WHEN extrapolation IS NULL THEN -1.0 ELSE least(extrapolation, 1.0) END, -CASE WHEN stability IS NULL THEN -1.0 ELSE greatest(stability, 0.0) END, -r2, mdl, -abs(r), expression, source, expression) <= 10""")
def conjecture_records(spark, sf_dir):
    """Records of four kinds of search over the same hits, and the ten best of them."""
    s = written(rounded(candidates.scored(flat_features(spark, sf_dir), HITS), 5, extrapolation=4), "hits")
    method = F.when(F.col("candidate").contains("price"), "physics_templates").otherwise("other")
    symbolic = s.withColumn("terms", F.lit(0)).withColumn("method", method).withColumnRenamed("candidate", "equation")
    latent = s.withColumn("latent_column", F.concat(F.lit("latent_"), F.col("length").cast("string"))).withColumnsRenamed({"candidate": "equation", "r": "main_target_correlation"})
    every = promotion.metric_records(s, "target").union(promotion.symbolic_records(symbolic, "target")).union(promotion.latent_records(latent, "target"))
    every = every.union(promotion.program_records(s.withColumnsRenamed({"candidate": "expression", "r2": "fitness"}), "target"))
    best = promotion.promoted(every, 10, 0.3)
    return rounded(best.select("source", "expression", "mdl", "level"), 4)


@query("""WITH d AS (SELECT *, '{"domain_id":"part","params":{"brand":"' || p_brand || '","type":"' || p_type || '"},"seed":' || p_partkey || ',"size":' || p_size || '}' AS text FROM part)
SELECT p_partkey, substr(sha256(text), 1, 16) AS instance_id FROM d""")
def instance_ids(spark, sf_dir):
    """Content hashes of parts as instances."""
    params = F.map_from_arrays(F.array(F.lit("type"), F.lit("brand")), F.array("p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", records.instance_id(F.lit("part"), F.col("p_size"), F.col("p_partkey"), params).alias("instance_id"))


PREFIXED = {"quantity": "graph.quantity", "price": "fourier.price", "discount": "gen.discount", "tax": "tax", "target": "metric.target"}
PRICES = {"graph.quantity": 1.0, "fourier.price": 4.0, "gen.discount": 0.25, "tax": 1.0}


@query("WITH n AS (SELECT count(*) AS n FROM lineitem) " + " UNION ALL ".join(f"SELECT '{d}' AS descriptor, CAST({c} AS DOUBLE) AS cost, {c} * CAST(n AS DOUBLE) AS total FROM n" for d, c in PRICES.items()))
def descriptor_ledger(spark, sf_dir):
    """What the columns of the flat features cost by the prefixes of their names."""
    rows = flat_features(spark, sf_dir).select(*[F.col(c).alias(d) for c, d in PREFIXED.items()])
    return records.ledger(rows)


@query("""WITH t AS (SELECT unnest(regexp_extract_all(p_type || ' add(x.y, ' || p_name || ')', '[a-zA-Z_][\\w.]*')) AS fragment FROM part)
SELECT fragment, count(*) AS "count" FROM t WHERE fragment NOT IN ('add', 'sub', 'mul', 'div') GROUP BY fragment HAVING count(*) >= 2""")
def library_fragments(spark, sf_dir):
    """Names that recur in the types and names of parts, read as expressions."""
    text = F.concat(F.col("p_type"), F.lit(" add(x.y, "), F.col("p_name"), F.lit(")"))
    return promotion.fragments(table(spark, sf_dir, "part").select(text.alias("text")), "text")


@query("""WITH s AS (SELECT p_size % 7 AS seed, lower(regexp_replace(p_type, '\\s+', '', 'g')) AS form, p_retailprice AS fitness FROM part), n AS (SELECT count(DISTINCT seed) AS n FROM s)
SELECT form, count(DISTINCT seed) AS seeds, round(count(DISTINCT seed) / any_value(n), 6) AS share, round(max(fitness), 4) AS best FROM s, n GROUP BY form""")
def rediscovered_forms(spark, sf_dir):
    """Types of parts as expressions, by the share of seeds that have them."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("seed"), "p_type", "p_retailprice")
    found = promotion.rediscovery(part, "seed", "p_type", "p_retailprice")
    return rounded(found, 6, best=4)


STEPS = INSTANCES + """, n AS (SELECT instance_id, r, v, lead(v) OVER w AS nv, lead(r) OVER w AS nr FROM s WINDOW w AS (PARTITION BY instance_id ORDER BY r)),
"""


@query(STEPS + """p AS (SELECT instance_id, nv, list_transform(range(1, 65), lambda i: v[i] / i) AS p FROM n WHERE nr = r + 1),
d AS (SELECT instance_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(nv[i] - p[i] / sqrt(list_dot_product(p, p)), 2)))) AS d FROM p)
SELECT instance_id, count(d) AS steps, round(avg(d), 5) AS distance FROM d GROUP BY instance_id""")
def step_operator_norms(spark, sf_dir):
    """Mean distance of each slice from the one before it under a falling weight."""
    n = statistics.successors(instances(spark, sf_dir), "instance_id", ["r"], ["v", "r"]).where("next_r = r + 1")
    weights = F.transform("v", lambda _, i: 1.0 / (i + 1))
    d = records.step_operator_norm(F.col("v"), F.col("next_v"), weights)
    return rounded(n.select("instance_id", d.alias("d")).groupBy("instance_id").agg(F.count("d").alias("steps"), F.avg("d").alias("distance")), 5)


@query(STEPS + """d AS (SELECT instance_id, list_max(list_transform(range(1, 65), lambda i: abs(nv[i] - v[i]))) AS d, len(v) * 8 AS bytes FROM n WHERE nr = r + 1)
SELECT instance_id, round(max(d), 6) AS distance, CAST(sum(bytes) AS BIGINT) AS bytes FROM d GROUP BY instance_id""")
def slice_distances(spark, sf_dir):
    """Largest difference of successive slices, and the bytes of the slices."""
    n = statistics.successors(instances(spark, sf_dir), "instance_id", ["r"], ["v", "r"]).where("next_r = r + 1")
    cells = n.select("instance_id", records.largest_difference(F.col("v"), F.col("next_v")).alias("d"), records.byte_size(F.col("v")).alias("bytes"))
    return rounded(cells.groupBy("instance_id").agg(F.max("d").alias("distance"), F.sum("bytes").alias("bytes")))


@query("SELECT representation, 'exact_roundtrip' AS claim, (SELECT count(*) FROM embeddings) AS n, 'verified' AS status FROM (VALUES ('identity'), ('difference'), ('sorted_permutation')) t(representation)")
def roundtrip_certificates(spark, sf_dir):
    found = records.certificates(table(spark, sf_dir, "embeddings"), "embedding")
    return found.select("representation", "claim", "n", "status")


@query("""WITH c AS (SELECT p_brand, avg(p_retailprice) AS price, avg(CASE WHEN p_size < 4 AND p_name LIKE '%cold%' THEN p_size END) AS small, max(CASE WHEN p_size = 50 THEN 1.0 END) AS large FROM part GROUP BY p_brand)
SELECT p_brand, array_to_string(list_filter([CASE WHEN large IS NULL THEN 'large' END, CASE WHEN price IS NULL THEN 'price' END, CASE WHEN small IS NULL THEN 'small' END], lambda x: x IS NOT NULL), ',') AS vacuous FROM c""")
def vacuous_criteria(spark, sf_dir):
    """Criteria by brand that no part can answer."""
    small = F.avg(F.when((F.col("p_size") < 4) & F.col("p_name").contains("cold"), F.col("p_size")))
    large = F.max(F.when(F.col("p_size") == 50, 1.0).otherwise(F.lit(None)))
    per = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), small.alias("small"), F.coalesce(large, F.lit(float("nan"))).alias("large"))
    criteria = F.create_map(*[x for c in ("price", "small", "large") for x in (F.lit(c), F.col(c))])
    return per.select("p_brand", F.concat_ws(",", records.vacuous_criteria(criteria)).alias("vacuous"))


@query("SELECT p_type LIKE '%ECON%' OR p_type LIKE '%PROMO%' AS held_out, count(*) AS n FROM part GROUP BY 1")
def held_out_generators(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(records.held_out_by_prefix(F.col("p_type"), ["PROMO", "ECON"]).alias("held_out")).agg(F.count("*").alias("n"))


@query()
def update_predictor(spark, sf_dir):
    """The mean step of each instance from its other overlaps."""
    rows = array_queries.overlaps(instances(spark, sf_dir))
    return rounded(records.update_predictor(rows, ["mean", "least", "most", "consecutive_mean", "consecutive_min"], "step_ratio_mean"))

