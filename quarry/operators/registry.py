"""Registered queries over the given tables, each beside its SQL oracle.

A query is a thin use of an operator; R rounds a result so that sums in another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.numeric import energy, pearson, slope
from quarry.operators import arrays, candidates, descriptors, matrices, models, recovery, relational, representation, skyline, statistics
from quarry.operators.registered import FEATURES, FLAT, LONG, QUERIES, SQL, TAPE, VEC, query, rounded, safe_r
from quarry.plans import expression as ex
from quarry.sources.tables import flat_features, table

@query(
    LONG
    + f""", o AS (SELECT col, {safe_r('v', 'target')} AS r, count(v) AS n FROM l GROUP BY col),
s AS (SELECT col, size, {safe_r('v', 'target')} AS r FROM l GROUP BY col, size),
g AS (SELECT s.col, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN sign(s.r) = sign(o.r) THEN 1.0 ELSE 0.0 END) END AS st
 FROM s JOIN o ON s.col = o.col WHERE s.r IS NOT NULL AND s.r <> 0 GROUP BY s.col)
SELECT o.col AS "column", round(r, 6) AS r, round(r * r, 6) AS r2, n, round(st, 6) AS stability FROM o LEFT JOIN g ON o.col = g.col"""
)
def correlation_report(spark, sf_dir):
    return rounded(statistics.correlate(flat_features(spark, sf_dir), FEATURES))


@query(
    LONG
    + f"""SELECT col AS "column", size, round({safe_r('v', 'target')}, 6) AS r, count(v) AS n FROM l GROUP BY col, size"""
)
def correlation_by_size(spark, sf_dir):
    long = statistics.unpivoted(flat_features(spark, sf_dir), FEATURES, ["size", "target"])
    return rounded(long.groupBy("column", "size").agg(pearson(F.col("value"), F.col("target")).alias("r"), F.count("value").alias("n")))


@query(
    FLAT
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, 1.0 AS r" if a == b else f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM f"
        for a in FEATURES
        for b in FEATURES
    )
)
def correlation_matrix(spark, sf_dir):
    return rounded(statistics.correlation_matrix(flat_features(spark, sf_dir), FEATURES))


@query(FLAT + "SELECT size, count(target) AS n, round(avg(target), 4) AS mean, round(stddev_pop(target), 4) AS std, round(min(target), 4) AS low, round(max(target), 4) AS high FROM f GROUP BY size")
def distribution_summary_grouped(spark, sf_dir):
    return rounded(statistics.distribution(flat_features(spark, sf_dir), "target", ["size"]), 4)


@query(FLAT + "SELECT count(target) AS n, round(avg(target), 4) AS mean, round(stddev_pop(target), 4) AS std, round(min(target), 4) AS low, round(max(target), 4) AS high FROM f")
def distribution_summary_overall(spark, sf_dir):
    return rounded(statistics.distribution(flat_features(spark, sf_dir), "target", []), 4)


@query("WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events) SELECT event_id, user_id, round(value, 4) AS value, round((value - mu) / sd, 4) AS z_score FROM events, s WHERE abs((value - mu) / sd) >= 2.5")
def outlier_rows(spark, sf_dir):
    return rounded(statistics.outliers(table(spark, sf_dir, "events"), "value", ["event_id", "user_id"]), 4)


@query(FLAT + ", g AS (SELECT generator, count(target) AS n, avg(target) AS m, var_pop(target) AS v FROM f GROUP BY generator) SELECT count(*) AS groups, round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / sum(n * v), 6) AS separation FROM g")
def separation_score(spark, sf_dir):
    return rounded(statistics.separation(flat_features(spark, sf_dir), "target"))


@query(FLAT + ", m AS (SELECT generator, median(target) AS c FROM f GROUP BY generator) SELECT round(avg(abs(target - c)), 4) AS mae, count(*) AS n FROM f JOIN m USING (generator)")
def generator_median_baseline(spark, sf_dir):
    return rounded(statistics.group_median_error(flat_features(spark, sf_dir), "target", "generator"), 4)


@query(FLAT + ", p AS (SELECT instance_id, stddev_pop(target) AS sd, avg(target) AS m FROM f GROUP BY instance_id HAVING count(target) >= 2) SELECT round(median(sd / greatest(m, 1e-12)), 6) AS cv, count(*) AS instances FROM p")
def within_instance_cv(spark, sf_dir):
    return rounded(statistics.variation_within(flat_features(spark, sf_dir), "target"))


@query(FLAT + "SELECT count(target) AS n, count(target) < 2 OR stddev_pop(target) < 1e-12 OR stddev_pop(target) / greatest(abs(avg(target)), 1.0) < 1e-9 AS degenerate FROM f")
def target_degeneracy(spark, sf_dir):
    return statistics.degeneracy(flat_features(spark, sf_dir), "target")


@query(FLAT + "SELECT size, round(median(target), 4) AS median, count(target) AS n FROM f GROUP BY size")
def median_by_size(spark, sf_dir):
    return rounded(statistics.median_by_size(flat_features(spark, sf_dir), "target"), 4)


@query(
    LONG
    + """, m AS (SELECT col, size, median(v) AS med FROM l GROUP BY col, size HAVING median(v) > 0)
SELECT col AS "column", count(*) AS sizes, round(regr_slope(ln(med), size), 6) + 0.0 AS a, round(regr_intercept(ln(med), size), 6) AS b,
 CASE WHEN var_pop(ln(med)) > 0 THEN round(pow(corr(ln(med), size), 2), 6) END AS r2, regr_slope(ln(med), size) > 0.3 AS is_exponential FROM m GROUP BY col"""
)
def fit_log_scaling(spark, sf_dir):
    return rounded(statistics.log_scaling(flat_features(spark, sf_dir), FEATURES))


@query(FLAT + "SELECT size, round(regr_slope(target, price), 6) AS slope, round(regr_intercept(target, price), 2) AS intercept, round(regr_r2(target, price), 6) AS r2, count(*) AS n FROM f GROUP BY size")
def per_size_ols(spark, sf_dir):
    return rounded(statistics.ols_by_group(flat_features(spark, sf_dir), "price", "target", ["size"]), 6, intercept=2)


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS t FROM orders)
SELECT o_orderkey, round(coalesce(t, (SELECT avg(t) FROM o)), 3) AS t FROM o""")
def impute_mean(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("t"))
    return rounded(statistics.imputed(orders, ["t"], ["o_orderkey"]), 3)


@query("""WITH p AS (SELECT p_brand, avg(p_retailprice) AS a FROM part GROUP BY p_brand),
r AS (SELECT p_brand, round(1.0 / (1 + abs(a - 1400)), 9) AS p FROM p), k AS (SELECT *, row_number() OVER (ORDER BY p, p_brand) AS rank, count(*) OVER () AS m FROM r),
q AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)
SELECT p_brand, round(p, 9) AS p, CAST(rank AS INTEGER) AS rank, round(q, 9) AS q, q <= 0.05 AS reject FROM q""")
def bh_fdr(spark, sf_dir):
    tests = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("a"))
    tests = tests.select("p_brand", F.round(1.0 / (1 + F.abs(F.col("a") - 1400)), 9).alias("p"))
    return rounded(statistics.benjamini_hochberg(tests, "p", "p_brand"), 9)


STEPS = statistics.poisson_steps().tolist()


@query(FLAT + """, m AS (SELECT avg(price) AS mx, avg(target) AS my, corr(price, target) AS pearson_r FROM f),
c AS (SELECT instance_id, count(*) AS n, sum(price - mx) AS sx, sum(target - my) AS sy, sum(pow(price - mx, 2)) AS sxx, sum(pow(target - my, 2)) AS syy, sum((price - mx) * (target - my)) AS sxy FROM f, m GROUP BY instance_id),
u AS (SELECT c.*, r, CAST('0x' || substr(h, CAST(1 + 8 * (r % 8) AS INTEGER), 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT c.*, b, sha256('0:' || CAST(b AS VARCHAR) || ':' || CAST(instance_id AS VARCHAR)) AS h FROM c, range(0, 63) t(b)) c JOIN range(0, 500) t(r) ON r // 8 = b),
w AS (SELECT *, """ + " + ".join(f"CASE WHEN u >= {s!r} THEN 1 ELSE 0 END" for s in STEPS) + """ AS w FROM u),
s AS (SELECT r, sum(n * w) AS n, sum(sx * w) AS sx, sum(sy * w) AS sy, sum(sxx * w) AS sxx, sum(syy * w) AS syy, sum(sxy * w) AS sxy FROM w GROUP BY r),
b AS (SELECT (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM s)
SELECT round(any_value(pearson_r), 6) AS pearson_r, count(*) AS replicates, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high FROM b, m""")
def bootstrap_clusters(spark, sf_dir):
    rows = flat_features(spark, sf_dir)
    r = statistics.cluster_bootstrap(rows, "price", "target", "instance_id", 500)
    observed = rows.agg(pearson(F.col("price"), F.col("target")).alias("pearson_r"))
    return rounded(observed.crossJoin(r.agg(F.count("r").alias("replicates"), F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))))


@query("""WITH o AS (SELECT o_custkey % 5 AS size, o_orderkey AS k, o_totalprice AS v FROM orders),
a AS (SELECT size, k, row_number() OVER (ORDER BY k, v) AS i FROM o),
b AS (SELECT v, row_number() OVER (ORDER BY sha256('0:' || CAST(k AS VARCHAR)), v) AS i FROM o)
SELECT a.size, a.k, b.v AS permuted FROM a JOIN b ON a.i = b.i""")
def permuted_null(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("size"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return statistics.permuted_target(orders, "v", ["k"])


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, o_orderpriority AS generator, c_mktsegment FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey")
def flatten_features(spark, sf_dir):
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), F.col("o_orderpriority").alias("generator"), "c_mktsegment")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice, 'sealed' AS origin FROM orders WHERE o_orderpriority < '3'),
g AS (SELECT o_orderkey, o_totalprice, 'log' AS origin FROM orders WHERE o_orderpriority >= '2')
SELECT * FROM s UNION ALL SELECT * FROM g WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)""")
def union_sealed_and_log(spark, sf_dir):
    """Together both sides hold every order; orders of priority 2 are on both."""
    orders, columns = table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice", "origin"]
    sealed, log = orders.where("o_orderpriority < '3'").withColumn("origin", F.lit("sealed")), orders.where("o_orderpriority >= '2'").withColumn("origin", F.lit("log"))
    return relational.union_sealed_and_log(sealed.select(columns), log.select(columns), ["o_orderkey"])


@query("""WITH done AS (SELECT DISTINCT o_custkey AS c_custkey, CAST(o_orderkey % 12 AS INTEGER) AS family_index FROM orders)
SELECT c_custkey, CAST(i AS INTEGER) AS family_index FROM customer, range(0, 12) t(i) WHERE (c_custkey, CAST(i AS INTEGER)) NOT IN (SELECT (c_custkey, family_index) FROM done)""")
def pending_work(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 12).cast("int").alias("family_index"))
    return relational.pending(table(spark, sf_dir, "customer"), done, ["c_custkey"], "family_index", list(range(12)))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def run_subset(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").withColumnRenamed("o_orderkey", "l_orderkey")
    return relational.subset(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ids, "l_orderkey")


@query(FLAT + "SELECT count(*) AS rows, count(DISTINCT instance_id) AS instances, count(DISTINCT size) AS sizes, min(family_index) AS first_index, max(family_index) AS last_index FROM f")
def run_summary(spark, sf_dir):
    return relational.run_summary(flat_features(spark, sf_dir))


SPLIT = """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'held_out' WHEN u < 60 THEN 'discovery' WHEN u < 80 THEN 'calibration' ELSE 'confirmatory' END AS split_fold
FROM (SELECT c_custkey, c_mktsegment, CAST('0x' || substr(sha256('7:' || CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS u FROM customer)"""


def splits(spark, sf_dir):
    return relational.assigned_splits(table(spark, sf_dir, "customer"), "c_custkey", "7", ["MACHINERY"], "c_mktsegment")


@query(SPLIT)
def assign_splits(spark, sf_dir):
    return splits(spark, sf_dir).select("c_custkey", "split_fold")


@query(f"SELECT split_fold, count(*) AS n FROM ({SPLIT}) GROUP BY split_fold")
def fold_counts(spark, sf_dir):
    return splits(spark, sf_dir).groupBy("split_fold").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return relational.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing quality' ELSE '' END || CASE WHEN quality IS NULL AND toxic IS NULL THEN ',' ELSE '' END || CASE WHEN toxic IS NULL THEN 'missing toxic' ELSE '' END AS errors
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL""")
def validate_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return relational.invalid(rows, ["quality", "toxic"]).select("doc_id", F.concat_ws(",", "errors").alias("errors"))


@query(FLAT + "SELECT generator, count(DISTINCT (quantity, discount, tax)) AS vectors, count(*) AS rows FROM f GROUP BY generator")
def distinct_vectors(spark, sf_dir):
    return relational.distinct_vectors(flat_features(spark, sf_dir), ["quantity", "discount", "tax"], "generator")


@query(FLAT + ", b AS (SELECT size, count(DISTINCT generator) AS g, count(DISTINCT (quantity, discount)) AS v FROM f GROUP BY size) SELECT count(*) AS blocks, count(*) FILTER (v > 1) AS visible FROM b WHERE g >= 2")
def mechanism_visibility(spark, sf_dir):
    return relational.visibility(flat_features(spark, sf_dir), ["quantity", "discount"], "size", "generator")


#: Origins by prefix; a run brings its own table.
CATALOG = [("q", "sampled"), ("quantity", "structural"), ("price", "oracle"), ("tax", "structural"), ("target", "outcome"), ("retail", "structural")]


@query("""WITH n AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS feature FROM part UNION SELECT DISTINCT 'quantity.' || CAST(p_size AS VARCHAR) FROM part UNION SELECT DISTINCT 'price.' || p_brand FROM part),
c(prefix, origin) AS (VALUES """ + ", ".join(f"('{p}', '{o}')" for p, o in CATALOG) + """),
m AS (SELECT feature, arg_max(origin, len(prefix)) AS origin FROM n JOIN c ON starts_with(feature, prefix) GROUP BY feature)
SELECT feature, coalesce(origin, 'unknown') AS origin, coalesce(origin, 'unknown') IN ('unknown', 'oracle', 'outcome') AS blocked FROM n LEFT JOIN m USING (feature)""")
def audit_features(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.lower(F.split("p_type", " ")[0]).alias("feature"))
    names = names.union(part.select(F.concat(F.lit("quantity."), F.col("p_size").cast("string")))).union(part.select(F.concat(F.lit("price."), "p_brand")))
    return relational.audited(names.distinct(), spark.createDataFrame(CATALOG, "prefix string, origin string"))


@query(FLAT + "SELECT instance_id, family_index, round(ln(greatest(price, 1e-300)) / (quantity + 1.0), 6) AS e1, round(sqrt(greatest(discount, 0.0)) * tax, 6) AS e2, CASE WHEN abs(tax) > 1e-12 THEN round(discount / tax, 6) END AS e3 FROM f")
def expr_eval_clamped(spark, sf_dir):
    e = {"e1": "div(log(price), add(quantity, 1))", "e2": "mul(sqrt(discount), tax)", "e3": "div(discount, tax)"}
    return rounded(flat_features(spark, sf_dir).select("instance_id", "family_index", *[ex.compiled(ex.parsed(t)).alias(n) for n, t in e.items()]))


def ranked(rows: DataFrame, nodes: list[ex.Node]) -> DataFrame:
    """Candidates with their r to the target: all candidates in one pass over the rows."""
    return candidates.scored(rows, nodes).select("candidate", F.col("length").cast("long").alias("size"), "r")


POSITIVE = ["quantity", "price", "retail"]


@query(FLAT + " UNION ALL ".join(f"SELECT 'div({a}, {b})' AS candidate, CAST(3 AS BIGINT) AS size, round(corr({a} / {b}, target), 6) AS r FROM f" for a in POSITIVE for b in POSITIVE if a != b))
def rank_ratios(spark, sf_dir):
    return rounded(ranked(flat_features(spark, sf_dir), ex.ratios(POSITIVE)))


@query(FLAT + " UNION ALL ".join(f"SELECT 'mul({a}, {b})' AS candidate, CAST(3 AS BIGINT) AS size, round(corr({a} * {b}, target), 6) AS r FROM f" for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
def rank_products(spark, sf_dir):
    return rounded(ranked(flat_features(spark, sf_dir), ex.products(FEATURES)))


@query(VEC + """SELECT vec_id, CAST(len(v) AS BIGINT) AS "count", round(list_sum(v) / len(v), 6) AS mean, round(sqrt(greatest(0.0, list_sum(list_transform(v, lambda x: x * x)) / len(v) - pow(list_sum(v) / len(v), 2))), 6) AS std, round(list_min(v), 6) AS low, round(list_max(v), 6) AS high FROM e""")
def array_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(arrays.described(e, "embedding", ["vec_id"], arrays.moments(F.col("embedding"))))


@query(VEC + """, s AS (SELECT vec_id, v, list_sum(list_transform(v, lambda x: x * x)) AS e2, list_sum(list_transform(v, lambda x: abs(x))) AS e1, list_sort(list_transform(v, lambda x: abs(x))) AS a FROM e)
SELECT vec_id, round(-list_sum(list_transform(list_filter(v, lambda x: x * x > 0), lambda x: x * x / e2 * ln(x * x / e2))), 5) AS entropy,
 round(2 * list_sum(list_transform(a, lambda x, i: x * i)) / (len(a) * e1) - (len(a) + 1.0) / len(a), 5) AS gini,
 round((sqrt(len(v)) - e1 / sqrt(e2)) / (sqrt(len(v)) - 1), 5) AS hoyer, round(pow(e2, 2) / list_sum(list_transform(v, lambda x: pow(x, 4))), 5) AS participation FROM s""")
def array_sparsity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(arrays.described(e, "embedding", ["vec_id"], {n: f(F.col("embedding")) for n, f in arrays.DESCRIPTORS.items()}), 5)


@query(VEC + """, c AS (SELECT vec_id, v, list_transform(v, lambda x: x - list_avg(v)) AS c FROM e)
SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: c[i] * c[i + 1])) / list_sum(list_transform(c, lambda x: x * x)), 5) AS lag1,
 round(list_sum(list_transform(range(1, 61), lambda i: c[i] * c[i + 4])) / list_sum(list_transform(c, lambda x: x * x)), 5) AS lag4,
 CAST(len(list_filter(range(1, 65), lambda i: v[i] <= v[greatest(i - 1, 1)] AND v[i] <= v[least(i + 1, 64)])) AS BIGINT) AS minima FROM c""")
def array_landscape(spark, sf_dir):
    v = F.col("embedding")
    found = {"lag1": arrays.autocorrelation(v, 1), "lag4": arrays.autocorrelation(v, 4), "minima": arrays.local_minima(v)}
    return rounded(arrays.described(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], found), 5)


@query(VEC + """SELECT vec_id, round(pow(list_sum(list_transform(v, lambda x: pow(abs(x), 3.0))), 1 / 3.0), 5) AS p3,
 round(list_sum(list_reverse_sort(list_transform(v, lambda x: x * x))[1:8]) / list_sum(list_transform(v, lambda x: x * x)), 5) AS top8 FROM e""")
def array_norms(spark, sf_dir):
    v = F.col("embedding")
    return rounded(arrays.described(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], {"p3": arrays.pnorm(v, 3.0), "top8": arrays.topk_energy(v, 8)}), 5)


@query(VEC + """, w AS (SELECT vec_id, k, sum(x * CASE WHEN bit_count(i & k) % 2 = 0 THEN 1 ELSE -1 END) / 8 AS s
 FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e), range(0, 64) r(k) GROUP BY vec_id, k)
SELECT vec_id, round(max(abs(s)), 4) AS peak, round(sum(s * s), 4) AS energy FROM w GROUP BY vec_id""")
def walsh_spectrum(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    w = e.select("vec_id", arrays.walsh(F.col("v"), 64).alias("w"))
    return rounded(w.select("vec_id", F.array_max(F.transform("w", lambda x: F.abs(x))).alias("peak"), F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x).alias("energy")), 4)


@query("""WITH o AS (SELECT user_id, value, row_number() OVER w AS i, lag(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS steps, round(regr_slope(value, i), 6) AS slope, round(avg(abs(value - b)), 5) AS update_size FROM o GROUP BY user_id""")
def dynamics_slope(spark, sf_dir):
    """A place in the order of all events serves for the number within the user's: it moves the line, not its slope."""
    o = statistics.successors(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["value"])
    step = F.abs(F.col("next_value") - F.col("value"))
    return rounded(o.groupBy("user_id").agg(F.count("*").alias("steps"), slope(F.col("value"), F.col("place")).alias("slope"), F.avg(step).alias("update_size")), 6, update_size=5)


@query(TAPE + """, g AS (SELECT user_id, y, count(DISTINCT x) AS n FROM t GROUP BY ALL HAVING count(DISTINCT x) > 1)
SELECT user_id, count(*) AS "values", CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM g GROUP BY user_id""")
def collision_groups(spark, sf_dir):
    return recovery.collisions(tape(spark, sf_dir), "user_id", "x", "y")


def tape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("event_id") % 97).alias("y"))


def mode_sql(value: str, margin: bool = False) -> str:
    kept = "value" if not margin else "CASE WHEN n >= 3 * coalesce(second, 0) THEN value END"
    return TAPE + f""", d AS (SELECT DISTINCT user_id, x, y FROM t), s AS (SELECT user_id, {value} AS value FROM (SELECT user_id, x, min(x) OVER (PARTITION BY user_id, y) AS b FROM d) WHERE x <> b),
c AS (SELECT user_id, value, count(*) AS n FROM s WHERE value <> 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER o AS i, lead(n) OVER o AS second, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS a FROM c WINDOW o AS (PARTITION BY user_id ORDER BY n DESC, value))
SELECT user_id, {kept} AS mode, n AS votes, a AS "all" FROM k WHERE i = 1"""


MODULUS = 64


@query(mode_sql("xor(x, b)"))
def xor_mode(spark, sf_dir):
    return recovery.mode(recovery.pair_values(tape(spark, sf_dir), "user_id", "x", "y", "xor", MODULUS), "user_id")


@query(mode_sql(f"(x + b) % {MODULUS}"))
def sum_mode(spark, sf_dir):
    return recovery.mode(recovery.pair_values(tape(spark, sf_dir), "user_id", "x", "y", "sum", MODULUS), "user_id")


@query(mode_sql(f"(x - b) % {MODULUS}", True))
def confident_mode(spark, sf_dir):
    return recovery.mode(recovery.pair_values(tape(spark, sf_dir), "user_id", "x", "y", "diff", MODULUS), "user_id", 3.0)


@query("""WITH RECURSIVE t AS (SELECT DISTINCT user_id, event_id AS x, event_id * 2654435761 % 65536 AS y FROM events),
p AS (SELECT a.user_id, a.x AS a, b.x AS b FROM t a JOIN t b ON a.user_id = b.user_id AND a.x <> b.x AND bit_count(xor(a.y, b.y)) <= 2),
r AS (SELECT user_id, a AS x, a AS c FROM (SELECT DISTINCT user_id, a FROM p) UNION SELECT p.user_id, p.b, r.c FROM r JOIN p ON r.user_id = p.user_id AND r.x = p.a AND r.c < p.b)
SELECT user_id, x, min(c) AS component FROM r GROUP BY ALL""")
def near_collisions(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("event_id") * 2654435761 % 65536).alias("y"))
    return recovery.near_groups(points, "user_id", "x", "y", 2, 16)


@query("SELECT lang, source, round(avg(CAST(quality AS DOUBLE)), 6) AS recall, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def recall_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(recovery.recall(rows, "quality", ["lang", "source"]))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query(VEC + """, d AS (SELECT vec_id, [v[1]] || list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) AS d FROM e)
SELECT vec_id, CAST(len(list_filter(d, lambda x: abs(x) > 1e-6)) AS BIGINT) AS needed, round(list_sum(list_transform(d, lambda x: abs(x))), 5) AS steps FROM d""")
def difference_encode(spark, sf_dir):
    d = vectors(spark, sf_dir).select("vec_id", representation.difference(F.col("v")).alias("d"))
    size = F.aggregate(F.transform("d", lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x)
    return rounded(d.select("vec_id", representation.complexity(F.col("d")).alias("needed"), size.alias("steps")), 5)


@query(VEC + """, p AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS j FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e)),
b AS (SELECT vec_id, i - lag(i) OVER (PARTITION BY vec_id ORDER BY j) AS step FROM p)
SELECT vec_id, count(*) FILTER (WHERE step <> 1) AS breaks FROM b GROUP BY vec_id""")
def sorted_permutation_cost(spark, sf_dir):
    ordered = vectors(spark, sf_dir).select("vec_id", representation.sorted_permutation(F.col("v")).alias("p"))
    return ordered.select("vec_id", representation.permutation_breaks(F.col("p")).alias("breaks"))


@query(VEC + """, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e),
c AS (SELECT vec_id, k, sum(x * cos(pi() * (i + 0.5) * k / 64)) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 64.0) AS c FROM x, range(0, 64) r(k) GROUP BY vec_id, k)
SELECT vec_id, count(*) FILTER (WHERE abs(c) > 1e-6) AS needed, round(sum(c * c), 5) AS energy, round(sum(c * c) FILTER (WHERE k < 8) / sum(c * c), 6) AS leading FROM c GROUP BY vec_id""")
def dct_complexity(spark, sf_dir):
    d = descriptors.described(vectors(spark, sf_dir), "v", ["vec_id"], representation.cosine_shape, ["needed", "energy", "leading"])
    return rounded(d.withColumn("needed", F.col("needed").cast("long")), 6, energy=5)


@query(VEC + """, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e),
p AS (SELECT vec_id, k, pow(sum(x * cos(2 * pi() * i * k / 64)), 2) + pow(sum(x * sin(2 * pi() * i * k / 64)), 2) AS p FROM x, range(1, 33) r(k) GROUP BY vec_id, k)
SELECT vec_id, round(max(p) / sum(p), 6) AS periodicity FROM p GROUP BY vec_id""")
def periodicity(spark, sf_dir):
    return rounded(descriptors.described(vectors(spark, sf_dir), "v", ["vec_id"], representation.period_shape, ["periodicity"]))


@query(VEC + """, q AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS j FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e)),
b AS (SELECT vec_id, count(*) FILTER (WHERE step <> 1) / 64.0 AS breaks FROM (SELECT vec_id, i - lag(i) OVER (PARTITION BY vec_id ORDER BY j) AS step FROM q) GROUP BY vec_id),
n AS (SELECT breaks, len(list_filter(v, lambda x: abs(x) > 1e-6)) / 64.0 AS i, len(list_filter([v[1]] || list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]), lambda x: abs(x) > 1e-6)) / 64.0 AS d FROM e JOIN b USING (vec_id))
SELECT 'identity' AS encoding, round(avg(i), 6) AS share, true AS verified, count(*) AS n FROM n UNION ALL
SELECT 'difference', round(avg(d), 6), true, count(*) FROM n UNION ALL SELECT 'sorted_permutation', round(avg(i + breaks), 6), true, count(*) FROM n""")
def rank_representations(spark, sf_dir):
    return rounded(representation.ranked_encodings(vectors(spark, sf_dir), "v"))


@query("""SELECT p_partkey, p_size, round(p_retailprice, 2) AS price FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b
 WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_frontier(spark, sf_dir):
    best = skyline.frontier(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return best.select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("price"))


@query("SELECT p_brand, p_size, p_retailprice, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) = 1")
def canonical_choice(spark, sf_dir):
    return representation.canonical(table(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"], "p_partkey")


def two_columns_sql(a: str, b: str, alpha: str) -> str:
    return FLAT + f""", m AS (SELECT count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, avg(target) AS mt, var_pop({a}) * count(*) + {alpha} AS aa, var_pop({b}) * count(*) + {alpha} AS bb,
 covar_pop({a}, {b}) * count(*) AS ab, covar_pop({a}, target) * count(*) AS ta, covar_pop({b}, target) * count(*) AS tb FROM f),
w AS (SELECT *, (bb * ta - ab * tb) / (aa * bb - ab * ab) AS wa, (aa * tb - ab * ta) / (aa * bb - ab * ab) AS wb FROM m)"""


@query(two_columns_sql("price", "tax", "0.001") + """ SELECT 'price' AS term, round(wa, 4) AS coefficient, n FROM w
UNION ALL SELECT 'tax', round(wb, 4), n FROM w UNION ALL SELECT 'intercept', round(mt - wa * ma - wb * mb, 4), n FROM w""")
def ridge_fit(spark, sf_dir):
    return rounded(models.ridge(flat_features(spark, sf_dir), ["price", "tax"], "target").drop("r2"), 4)


@query(two_columns_sql("price", "price * price", "0") + """ SELECT 'price' AS term, round(wa, 4) AS coefficient, n FROM w
UNION ALL SELECT 'price*price', round(wb, 4), n FROM w""")
def poly_fit(spark, sf_dir):
    fit = models.polynomial(flat_features(spark, sf_dir), ["price"], "target").where("term <> 'intercept'")
    return rounded(fit.drop("r2"), 4)


TERMS = {"x": "v", "x^2": "v * v", "sqrt|x|": "sqrt(abs(v))", "ln|x|": "ln(abs(v) + 1e-8)", "1/x": "1 / nullif(v, 0)"}


@query(LONG + ", t AS (" + " UNION ALL ".join(f"SELECT col, '{t}' AS template, {e} AS t, target AS y FROM l WHERE ({e}) IS NOT NULL" for t, e in TERMS.items())
    + """), s AS (SELECT col, template, count(*) AS n, sum(t * y) AS ty, sum(t * t) AS tt, sum(y * y) AS yy, var_pop(y) * count(*) AS spread FROM t GROUP BY col, template)
SELECT col AS "column", template, n, round(1 - (yy - ty * ty / tt) / spread, 6) AS r2 FROM s""")
def physics_templates(spark, sf_dir):
    return rounded(models.templates(flat_features(spark, sf_dir), FEATURES, "target").drop("coefficient"))


@query("""WITH o AS (SELECT o_totalprice AS x, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM orders)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM o WHERE y IS NOT NULL""")
def lead_regression(spark, sf_dir):
    return rounded(models.next_step(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice"), 6, intercept=2)


@query()
def pca_variance(spark, sf_dir):
    return models.principal_variance(flat_features(spark, sf_dir), FEATURES)


@query(VEC + """, n AS (SELECT vec_id, label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e)
SELECT label, count(*) AS steps, round(avg(abs(list_cosine_similarity(v, w))), 6) AS overlap,
 round(avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(w[i] - v[i], 2))) / list_sum(list_transform(v, lambda x: x * x)))), 6) AS update_ratio FROM n WHERE w IS NOT NULL GROUP BY label""")
def overlap_consecutive(spark, sf_dir):
    """Ids are paired first and the vectors joined to them, so that no task holds a label's vectors."""
    e = vectors(spark, sf_dir)
    pairs = statistics.successors(e.select("label", "vec_id"), "label", ["vec_id"], ["vec_id"]).where("has_next")
    n = pairs.join(e.select("vec_id", "v"), "vec_id").join(e.select(F.col("vec_id").alias("next_vec_id"), F.col("v").alias("w")), "next_vec_id")
    step = F.sqrt(energy(F.zip_with("w", "v", lambda a, b: a - b)) / energy(F.col("v")))
    overlap = F.abs(models.cosine(F.col("v"), F.col("w")))
    return rounded(n.groupBy("label").agg(F.count("*").alias("steps"), F.avg(overlap).alias("overlap"), F.avg(step).alias("update_ratio")))


@query(VEC + """, s AS (SELECT vec_id, v, list_min(v) AS low, list_max(v) - list_min(v) AS span FROM e)
SELECT vec_id, """ + ", ".join(f"round(len(list_filter(v, lambda x: x <= low + {c} * span)) / 64.0, 6) AS mass{int(c * 100)}" for c in arrays.LEVELS) + " FROM s")
def level_set_mass(spark, sf_dir):
    e = vectors(spark, sf_dir)
    return rounded(e.select("vec_id", *[arrays.level_mass(F.col("v"), c).alias(f"mass{int(c * 100)}") for c in arrays.LEVELS]))


@query(VEC + """SELECT vec_id, round(corr(bit_count(i), x), 6) AS hamming FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e) GROUP BY vec_id""")
def hamming_corr(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("vec_id", arrays.hamming_correlation(F.col("v")).alias("hamming")))


@query(VEC + """SELECT vec_id, round(list_sum(list_transform(range(0, 8), lambda i: v[9 * i + 1])), 5) AS trace, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS frobenius,
 round(sqrt(list_sum(list_transform(range(0, 64), lambda k: pow(v[k + 1] - v[(k % 8) * 8 + k // 8 + 1], 2))) / list_sum(list_transform(v, lambda x: x * x))), 5) AS asymmetry FROM e""")
def matrix_norms(spark, sf_dir):
    d = descriptors.described(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], descriptors.entries, descriptors.ENTRIES)
    return rounded(d.select("vec_id", "trace", "frobenius", F.col("symmetry_error").alias("asymmetry")), 5)


@query()
def matrix_spectrum(spark, sf_dir):
    return matrices.described(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], matrices.matrix, matrices.MATRIX)


@query()
def codec_sizes(spark, sf_dir):
    return matrices.described(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], matrices.codecs, matrices.CODECS)


# these register their queries when they are imported
from quarry.operators import array_queries, record_queries, recovery_queries, screen_queries, search_queries, storage_queries  # noqa: E402,F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
