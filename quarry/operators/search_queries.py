"""Registered queries of statistics, candidate ranking and model fits over the flat feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import excess_kurtosis, finite, predictive_r2, regression_r2, skew
from quarry.operators import candidates, latent, models, permutation, promotion, representation, skyline, statistics, storage
from quarry.operators.registered import FEATURES, FLAT, LONG, VEC, query, rounded, safe_r
from quarry.plans import expression as ex
from quarry.sources.tables import flat_features, table

MEANS = ", m AS (SELECT size, avg(target) AS mu, stddev_pop(target) AS sd FROM f GROUP BY size)\n"


@query(FLAT + MEANS + """SELECT size, count(target) AS n, round(avg(pow((target - mu) / sd, 3)), 5) AS skewness, round(avg(pow((target - mu) / sd, 4)) - 3, 5) AS kurtosis FROM f JOIN m USING (size) GROUP BY size""")
def shape_by_size(spark, sf_dir):
    t = F.col("target")
    return rounded(flat_features(spark, sf_dir).groupBy("size").agg(F.count(t).alias("n"), skew(t).alias("skewness"), excess_kurtosis(t).alias("kurtosis")), 5)


@query(FLAT + "SELECT generator, round(1 - sum(pow(target - 1.02 * price, 2)) / (var_pop(target) * count(*)), 6) AS predictive_r2, round(regr_r2(target, price), 6) AS regression_r2, round(var_pop(target), 1) AS target_variance FROM f GROUP BY generator")
def predictive_fit(spark, sf_dir):
    t, p = F.col("target"), F.col("price")
    variance = F.when(F.count(finite(t)) > 1, F.var_pop(finite(t)))
    out = flat_features(spark, sf_dir).groupBy("generator").agg(predictive_r2(1.02 * p, t).alias("predictive_r2"), regression_r2(p, t).alias("regression_r2"), variance.alias("target_variance"))
    return rounded(out, 6, target_variance=1)


REPORT = LONG + f""", o AS (SELECT col, {safe_r('v', 'target')} AS r, count(v) AS n FROM l GROUP BY col),
s AS (SELECT col, size, {safe_r('v', 'target')} AS r FROM l GROUP BY col, size),
g AS (SELECT s.col, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN sign(s.r) = sign(o.r) THEN 1.0 ELSE 0.0 END) END AS st FROM s JOIN o ON s.col = o.col WHERE s.r IS NOT NULL AND s.r <> 0 GROUP BY s.col)
"""


@query(REPORT + """SELECT o.col AS "column", round(r, 6) AS r, round(r * r, 6) AS r2, n, round(st, 6) AS stability, CAST(row_number() OVER (ORDER BY st IS NULL, st DESC, abs(r) DESC, o.col) AS INTEGER) AS place FROM o LEFT JOIN g ON o.col = g.col WHERE abs(r) >= 0.02""")
def cross_size_report(spark, sf_dir):
    return rounded(statistics.report(flat_features(spark, sf_dir), FEATURES, least=0.02))


@query(REPORT + ", t AS (SELECT * FROM o LEFT JOIN g ON o.col = g.col WHERE abs(r) >= 0.02) SELECT round(median(st), 6) AS median_stability, count(*) FILTER (abs(r) >= 0.5 AND st >= 0.75) >= 0.75 * count(*) FILTER (abs(r) >= 0.5) AND count(*) FILTER (abs(r) >= 0.5) > 0 AS stable FROM t")
def stability_summary(spark, sf_dir):
    return rounded(promotion.stability_summary(statistics.report(flat_features(spark, sf_dir), FEATURES, least=0.02)))


TOP = ["target", "price"]


@query(FLAT + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0' if a == b else f'corr({a}, {b})'}, 6) AS r FROM f GROUP BY ALL" if a != b else f"SELECT '{a}' AS a, '{b}' AS b, CAST(1 AS DOUBLE) AS r" for a in TOP for b in TOP))
def top_correlation_matrix(spark, sf_dir):
    return rounded(statistics.top_correlation_matrix(flat_features(spark, sf_dir), FEATURES, most=1))


START = [[5.0, 10000.0], [25.0, 40000.0], [45.0, 80000.0]]


def kmeans_sql(rounds: int) -> str:
    sql = FLAT + ", c0(cluster, quantity, price) AS (VALUES " + ", ".join(f"({i}, {a!r}, {b!r})" for i, (a, b) in enumerate(START)) + ")"
    for k in range(rounds):
        near = f"(SELECT f.quantity, f.price, arg_min(cluster, (pow(f.quantity - c.quantity, 2) + pow(f.price - c.price, 2), cluster)) AS cluster FROM (SELECT row_number() OVER () AS row, * FROM f) f, c{k} c GROUP BY row, f.quantity, f.price)"
        sql += f", c{k + 1} AS (SELECT cluster, avg(quantity) AS quantity, avg(price) AS price, count(*) AS size FROM {near} GROUP BY cluster)"
    return sql + f" SELECT CAST(cluster AS INTEGER) AS cluster, size, round(quantity, 3) AS quantity, round(price, 2) AS price FROM c{rounds}"


@query(kmeans_sql(4))
def kmeans_clusters(spark, sf_dir):
    """Four assignments: three rounds of moves, then the sizes and means of the last."""
    return rounded(statistics.kmeans(flat_features(spark, sf_dir), ["quantity", "price"], START, 3), 3, price=2)


@query(FLAT + """, s AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM f), k AS (SELECT CASE WHEN price < 50000 THEN 0 ELSE 1 END AS cluster, target FROM f),
c AS (SELECT cluster, avg(target) AS m, count(*) AS n FROM k GROUP BY cluster) SELECT round(abs(max(m) - min(m)) / (SELECT stddev_pop(target) FROM f), 6) AS separation, abs(max(m) - min(m)) / (SELECT stddev_pop(target) FROM f) >= 0.75 AS separated FROM c""")
def cluster_separation(spark, sf_dir):
    return rounded(promotion.cluster_separation(flat_features(spark, sf_dir), statistics.nearest(["price"], [[20000.0], [80000.0]]), "target"))


@query(FLAT + """, m AS (SELECT count(*) AS n, var_pop(target) AS yy, var_pop(size) AS aa, var_pop(family_index) AS bb, covar_pop(size, family_index) AS ab, covar_pop(size, target) AS ay, covar_pop(family_index, target) AS b FROM f)
SELECT n, round((bb * ay * ay - 2 * ab * ay * b + aa * b * b) / (aa * bb - ab * ab) / yy, 9) AS r2 FROM m""")
def size_index_baseline(spark, sf_dir):
    return rounded(statistics.size_index_r2(flat_features(spark, sf_dir), "target"), 9)


def bijection_sql(places: str, replicates: int, seed: int = 0) -> str:
    """CTEs from `places` (p, n) to `moved` (r, p, to): the bijection of permutation.permuted, with four turns of cycle walking."""
    mix = lambda u: f"(({u}) * ({u}) % 2147483647 * 48271 + 11) % 2147483647"
    rounds = [f"s AS (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM {places} LIMIT 1), w0 AS (SELECT r, p, p AS o, s.n, a, (s.n + a - 1) // a AS b FROM {places}, s, range(1, {replicates + 1}) t(r))"]
    for turn in range(4):
        last = f"w{turn}"
        rounds.append(f"q{turn}x0 AS (SELECT *, o % b AS low, o // b AS high FROM {last}" + (" WHERE o >= n" if turn else "") + ")")
        for k in range(0, 6, 2):
            key = lambda i: mix(f"(r * 2654435 + {i} * 40503 + {seed * 97 + 1}) % 2147483647")
            rounds.append(f"q{turn}x{k + 1} AS (SELECT * EXCLUDE (high), (high + {mix(f'(low * 1103515 + {key(k)}) % 2147483647')}) % a AS high FROM q{turn}x{k})")
            rounds.append(f"q{turn}x{k + 2} AS (SELECT * EXCLUDE (low), (low + {mix(f'(high * 1103515 + {key(k + 1)}) % 2147483647')}) % b AS low FROM q{turn}x{k + 1})")
        after = f"SELECT r, p, high * b + low AS o, n, a, b FROM q{turn}x6"
        rounds.append(f"w{turn + 1} AS ({after}" + (f" UNION ALL SELECT r, p, o, n, a, b FROM {last} WHERE o < n" if turn else "") + ")")
    return ", ".join(rounds) + ', moved AS (SELECT r, p, o AS "to" FROM w4 UNION ALL SELECT 0, p, p FROM ' + places + ")"


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey, o_totalprice, o_custkey) - 1 AS p, count(*) OVER () AS n, o_totalprice AS t, CAST(o_custkey AS DOUBLE) AS c, CAST(o_orderkey AS DOUBLE) AS k FROM orders), """
    + bijection_sql("o", 200) + """, x AS (SELECT r, greatest(abs(corr(a.t, b.c)), abs(corr(a.t, b.k))) AS r_max FROM moved JOIN o a USING (p) JOIN o b ON b.p = "to" GROUP BY r), v AS (SELECT r_max AS observed FROM x WHERE r = 0)
SELECT round(observed, 6) AS observed, round((count(*) FILTER (r_max >= observed) + 1) / 201.0, 6) AS p_value, count(*) AS replicates FROM x, v WHERE r > 0 GROUP BY observed""")
def permutation_max(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("t"), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    return rounded(permutation.permutation_max(orders, ["c", "k"], "t", ["o_orderkey"], 200))


@query(LONG + """, m AS (SELECT col, size, median(v) AS med FROM l GROUP BY col, size HAVING median(v) > 0),
a AS (SELECT col, regr_slope(ln(med), size) AS a, median(med) AS centre FROM m GROUP BY col)
SELECT col AS witness, round(a, 6) + 0.0 AS slope, coalesce(a > 0.3, false) AS exponential, CASE WHEN col = 'quantity' THEN coalesce(a >= 0.25 AND a > 0.3, false) WHEN col = 'tax' THEN centre <= 4 ELSE false END AS baseline,
 count(*) FILTER (coalesce(a > 0.3, false)) OVER () >= 2 AND count(*) FILTER (CASE WHEN col = 'quantity' THEN coalesce(a >= 0.25 AND a > 0.3, false) WHEN col = 'tax' THEN centre <= 4 ELSE false END) OVER () >= 1 AS negative FROM a""")
def witness_panel(spark, sf_dir):
    """Witnesses with their growth, their match with a baseline (here quantity is a rank, tax an order), and the panel's outcome."""
    return rounded(statistics.panel(flat_features(spark, sf_dir), FEATURES, ["quantity"], ["tax"]))


def names_sql(nodes) -> str:
    """Every candidate as SQL, by the definitions of the operations."""
    forms = {
        "neg": "-({0})", "abs": "abs({0})", "sqrt": "sqrt(greatest({0}, 0))", "log": "ln(greatest({0}, 1e-300))", "exp": "exp(least(greatest({0}, -700), 700))", "add": "({0} + {1})",
        "sub": "({0} - {1})", "mul": "({0} * {1})", "div": "CASE WHEN abs({1}) >= 1e-12 THEN {0} / {1} END", "pow": "pow({0}, {1})",
    }
    text = lambda n: ex.folded(n, lambda node, parts: forms[node.kind].format(*parts) if parts else f"CAST({node.value} AS DOUBLE)")
    return " UNION ALL ".join(f"SELECT '{n}' AS candidate, {n.size()} AS length, size, {text(n)} AS x, target AS y FROM f" for n in nodes)


#: R2, stability across sizes, and extrapolation from the smaller half of the sizes to the larger.
SCORES = """, cut AS (SELECT list_sort(list(DISTINCT size))[greatest(len(list(DISTINCT size)) // 2, 1) + 1] AS cut FROM f),
o AS (SELECT candidate, length, count(x) AS n, CASE WHEN count(x) >= 3 AND var_pop(x) > 0 THEN corr(x, y) END AS r FROM c WHERE isfinite(x) GROUP BY ALL),
s AS (SELECT candidate, size, CASE WHEN count(x) >= 3 AND stddev_pop(x) > 1e-14 * abs(avg(x)) AND var_pop(y) > 0 THEN corr(x, y) END AS r FROM c WHERE isfinite(x) GROUP BY ALL),
g AS (SELECT candidate, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN sign(s.r) = sign(o.r) THEN 1.0 ELSE 0.0 END) END AS stability FROM s JOIN o USING (candidate) WHERE s.r <> 0 GROUP BY candidate),
a AS (SELECT candidate, regr_slope(y, x) AS k, regr_intercept(y, x) AS b, count(x) = count(*) AS whole FROM c, cut WHERE size < cut GROUP BY candidate),
e AS (SELECT candidate, CASE WHEN bool_and(whole) AND count(x) = count(*) THEN 1 - sum(pow(y - k * x - b, 2)) / (var_pop(y) * count(*)) END AS extrapolation FROM c JOIN a USING (candidate), cut WHERE size >= cut GROUP BY candidate)
SELECT candidate, CAST(length AS INTEGER) AS length, n, round(r, 5) AS r, round(r * r, 5) AS r2, round(stability, 5) AS stability, round(extrapolation, 4) AS extrapolation FROM o LEFT JOIN g USING (candidate) LEFT JOIN e USING (candidate)
"""
SMALL = ["quantity", "price"]
METRICS = ex.metric_candidates(SMALL, 1)


def scores_sql(nodes) -> str:
    return FLAT + f", c AS ({names_sql(nodes)})" + SCORES


@query(scores_sql(METRICS))
def score_candidates(spark, sf_dir):
    """Ratios, products, chains and unary trees of two columns, scored."""
    return rounded(candidates.scored(flat_features(spark, sf_dir), METRICS).drop("mdl"), 5, extrapolation=4)


@query(scores_sql(ex.chains(FEATURES)))
def rank_unary_chains(spark, sf_dir):
    return rounded(candidates.scored(flat_features(spark, sf_dir), ex.chains(FEATURES)).drop("mdl"), 5, extrapolation=4)


@query()
def rank_expressions(spark, sf_dir):
    """The twenty best of some two thousand candidates up to depth two, in one pass."""
    nodes = ex.metric_candidates(FEATURES, 2, 2000)
    return rounded(candidates.ranked(candidates.scored(flat_features(spark, sf_dir), nodes), 20, 0.25))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best, max(p_retailprice) AS fitness, CAST(floor(p_size / 10) AS BIGINT) AS bucket FROM part GROUP BY p_brand, floor(p_size / 10)")
def elite_archive(spark, sf_dir):
    found = promotion.elite_archive(table(spark, sf_dir, "part"), {"p_size": 10.0}, "p_retailprice", "p_partkey", ["p_brand"])
    return found.withColumnRenamed("bucket_p_size", "bucket")


@query("SELECT lower(regexp_replace(p_name, '\\s+', '', 'g')) AS form, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL")
def canonical_forms(spark, sf_dir):
    return promotion.forms(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("WITH d AS (SELECT p_size || '::' || p_type AS key, p_retailprice AS score, p_partkey FROM part) SELECT key, p_partkey, round(score, 2) AS score FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, p_partkey) = 1 ORDER BY score DESC, key LIMIT 25")
def promoted(spark, sf_dir):
    """The dearest part of each size and type, the 25 dearest of them; ties between these go by key once prices are rounded."""
    price, key = F.col("p_retailprice"), F.concat(F.col("p_size").cast("string"), F.lit("::"), F.col("p_type"))
    cents = F.round(price * 100) / 100  # as the SQL rounds doubles: half cents by their binary value
    hits = table(spark, sf_dir, "part").select(key.alias("key"), "p_partkey", "p_retailprice")
    order = candidates.falling("score", cents) | {"key": F.col("key")} | candidates.falling("price", price) | {"part": F.col("p_partkey")}
    best = candidates.merged_top(hits, ["key"], order, 25)
    return best.select("key", "p_partkey", cents.alias("score"))


PAIRS = [("quantity", "price"), ("quantity", "tax"), ("price", "discount")]
PAIR_FORMS = {"a+b": "a + b", "a-b": "a - b", "a*b": "a * b", "a/b": "CASE WHEN abs(b) >= 1e-12 THEN a / b END", "hypot": "sqrt(a * a + b * b)"}


@query(FLAT + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, {a} AS a, {b} AS b, target AS y FROM f" for a, b in PAIRS) + "), t AS (" + " UNION ALL ".join(f"SELECT first, second, '{t}' AS template, {e} AS t, y FROM p" for t, e in PAIR_FORMS.items())
    + """), s AS (SELECT first, second, template, count(*) AS n, sum(t * y) AS ty, sum(t * t) AS tt, sum(y * y) AS yy, var_pop(y) * count(*) AS spread FROM t WHERE t IS NOT NULL GROUP BY ALL)
SELECT first, second, template, n, round(1 - (yy - ty * ty / tt) / spread, 6) AS r2 FROM s""")
def pair_templates(spark, sf_dir):
    return rounded(models.pair_templates(flat_features(spark, sf_dir), PAIRS, "target"))


@query(FLAT + """, s AS (SELECT size, regr_slope(target, price) AS k, regr_r2(target, price) AS r2, count(*) AS n FROM f GROUP BY size HAVING count(*) >= 4)
SELECT count(*) AS sizes, round(regr_slope(k, size), 8) AS drift, round(regr_intercept(k, size), 6) AS level, round(regr_r2(k, size), 5) AS rule_r2, round(min(r2), 5) AS least_r2 FROM s WHERE r2 >= 0.5""")
def cross_size_rule(spark, sf_dir):
    return rounded(models.size_rule(flat_features(spark, sf_dir), "price", "target"), 5, drift=8, level=6)


@query()
def pca_codes(spark, sf_dir):
    """Two principal codes: explained share, reconstruction error and correlation with the target."""
    return models.principal_codes(flat_features(spark, sf_dir), FEATURES, 2, "target")


@query()
def walsh_pursuit(spark, sf_dir):
    """Few Walsh coefficients that explain the vectors' largest amplitude, by orthogonal matching pursuit on one Gram matrix."""
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return models.matching_pursuit(e.withColumn("t", F.array_max(F.transform("v", lambda x: F.abs(x)))), "v", "t", 6)


@query(FLAT + """, h AS (SELECT *, CASE WHEN size <= 25 THEN 'train' ELSE 'test' END AS side FROM f),
m AS (SELECT avg(price) AS mx, avg(target) AS my, regr_slope(target, price) AS k FROM h WHERE side = 'train')
SELECT side, count(*) AS n, round(1 - sum(pow(target - my - k * (price - mx), 2)) / (var_pop(target) * count(*)), 6) AS r2 FROM h, m GROUP BY side""")
def trajectory_fit(spark, sf_dir):
    return rounded(models.split_fit(flat_features(spark, sf_dir), ["price"], "target", F.col("size") <= 25))


@query("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND length(b.p_name) <= length(a.p_name)
 AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice OR length(b.p_name) < length(a.p_name)))""")
def pareto_three(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("length", F.length("p_name"))
    return skyline.frontier(part, ["p_size", "p_retailprice", "length"]).select("p_partkey")


@query("SELECT p_partkey, round(-(0.5 * p_size + 0.25 * length(p_name) + 0.01 * p_retailprice), 4) AS score FROM part")
def weighted_scores(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("length", F.length("p_name"))
    return rounded(part.select("p_partkey", representation.weighted_score({"p_size": 0.5, "length": 0.25, "p_retailprice": 0.01}).alias("score")), 4)


V8 = VEC + ", x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e)\n"


@query(V8 + """, c AS (SELECT vec_id, k, sum(x * cos(2 * pi() * i * k / 64)) AS re, -sum(x * sin(2 * pi() * i * k / 64)) AS im FROM x, range(0, 33) r(k) GROUP BY vec_id, k)
SELECT vec_id, round(re, 4) AS re, round(im, 4) + 0.0 AS im, CAST(k AS INTEGER) AS k FROM c WHERE k IN (1, 7, 16)""")
def dft_codes(spark, sf_dir):
    c = representation.fourier(table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    return rounded(c.where(F.col("k").isin(1, 7, 16)).select("vec_id", "re", "im", "k"), 4)


@query()
def search_encodings(spark, sf_dir):
    """Chains of encodings up to depth two, certified by their inverse on half of the vectors and ranked on the other half."""
    return rounded(representation.search_chains(table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 2 == 0, 2))


@query()
def matrix_structure(spark, sf_dir):
    """Low rank, separability, conservation under reversal, and duality with the Fourier basis of the vectors as matrices."""
    return rounded(representation.structure(table(spark, sf_dir, "embeddings"), "embedding"))


@query()
def klt_basis(spark, sf_dir):
    """Leading eigenvalues of the second moments of the vectors, and the share of energy that they hold."""
    return rounded(representation.klt(table(spark, sf_dir, "embeddings"), "embedding", 8))


@query("SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN n + n * log2(n) ELSE n * n + n END, 4) AS cost FROM (SELECT p_partkey, p_size, greatest(CAST(p_size AS DOUBLE), 2) AS n FROM part)")
def encoding_costs(spark, sf_dir):
    chain = F.when(F.col("p_size") % 2 == 0, "difference+dft").otherwise("dct+difference+identity")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", representation.computational_cost(chain, F.col("p_size")).alias("cost")), 4)


HALF = ["quantity", "price", "tax"]


def replicate_sql() -> str:
    side = lambda k: f"(SELECT col, {safe_r('v', 'target')} AS r FROM l WHERE odd = {k} GROUP BY col)"
    long = " UNION ALL ".join(f"SELECT instance_id % 2 AS odd, target, '{c}' AS col, {c} AS v FROM f" for c in HALF)
    holds = "coalesce(abs(a.r) >= 0.3 AND abs(b.r) >= 0.3 AND sign(a.r) = sign(b.r), false)"
    return FLAT + f", l AS ({long}) SELECT a.col AS candidate, round(a.r, 6) AS r_a, round(a.r * a.r, 6) AS r2_a, round(b.r, 6) AS r_b, round(b.r * b.r, 6) AS r2_b, {holds} AS holds FROM {side(0)} a JOIN {side(1)} b ON a.col = b.col"


@query(replicate_sql())
def seed_replication(spark, sf_dir):
    rows, nodes = flat_features(spark, sf_dir), [ex.var(c) for c in HALF]
    a, b = (candidates.scored(rows.where(F.col("instance_id") % 2 == k), nodes) for k in (0, 1))
    return rounded(candidates.replicated(a, b, 0.3))


NODES = [ex.var("quantity"), ex.op("mul", ex.var("price"), ex.var("tax")), ex.op("mul", ex.var("quantity"), ex.var("discount"))]


@query(FLAT + ", d AS (" + " UNION ALL ".join(f"SELECT {k} AS split, * FROM f WHERE CAST('0x' || substr(sha256('0:{k}:' || CAST(instance_id AS VARCHAR)), 1, 8) AS BIGINT) < 3006477107" for k in range(5))
    + "), s AS (" + " UNION ALL ".join(f"SELECT split, '{n}' AS candidate, {n.size()} AS length, round(abs(corr({e}, target)), 9) AS r FROM d GROUP BY split" for n, e in zip(NODES, ("quantity", "price * tax", "quantity * discount"), strict=True))
    + "), w AS (SELECT candidate FROM s QUALIFY row_number() OVER (PARTITION BY split ORDER BY r DESC, length, candidate) = 1) SELECT candidate, count(*) AS wins, count(*) / 5.0 AS frequency FROM w GROUP BY candidate")
def rediscovery(spark, sf_dir):
    return candidates.rediscovered(flat_features(spark, sf_dir), NODES, "instance_id")


#: Principal axes of two columns in closed form: the first axis lies at half the angle of (2 cov, var - var).
PCA2 = FLAT + """, m AS (SELECT avg(quantity) AS ma, avg(price / 1000) AS mb, var_pop(quantity) AS aa, var_pop(price / 1000) AS bb, covar_pop(quantity, price / 1000) AS ab FROM f),
t AS (SELECT *, 0.5 * atan2(2 * ab, aa - bb) AS angle FROM m),
c AS (SELECT instance_id, family_index, discount, target, size, (quantity - ma) * cos(angle) + (price / 1000 - mb) * sin(angle) AS c0, (price / 1000 - mb) * cos(angle) - (quantity - ma) * sin(angle) AS c1 FROM f, t)
"""


def scaled(spark, sf_dir):
    return flat_features(spark, sf_dir).withColumn("price", F.col("price") / 1000)


@query(PCA2 + """, r AS (""" + " UNION ALL ".join(f"SELECT 'latent.pca_{k}' AS latent, '{d}' AS descriptor, abs(corr(c{k}, {d})) AS strength FROM c" for k in (0, 1) for d in ("target", "discount", "size"))
    + ") SELECT latent, descriptor, round(strength, 6) AS strength FROM r WHERE strength >= 0.01")
def latent_correlations(spark, sf_dir):
    coded, names = latent.with_codes(scaled(spark, sf_dir), ["quantity", "price"], 2)
    found = latent.correlated(coded, names, ["target", "discount", "size"], 0.01)
    return rounded(found.select("latent", "descriptor", F.abs("r").alias("strength")))


@query(PCA2 + "SELECT CAST(CASE WHEN abs(corr(c1, target)) > abs(corr(c0, target)) THEN 2 ELSE 1 END AS INTEGER) AS k, round(greatest(abs(corr(c0, target)), abs(corr(c1, target))), 6) AS r FROM c")
def linear_coordinates(spark, sf_dir):
    return rounded(latent.coordinates(scaled(spark, sf_dir), ["quantity", "price"], "target").drop("explained"))


@query(PCA2 + ", i AS (SELECT instance_id, avg(c0 * c0) AS spread FROM c GROUP BY instance_id) SELECT o_orderkey, o_custkey, round(spread, 4) AS spread FROM orders LEFT JOIN i ON o_orderkey = instance_id")
def latent_broadcast(spark, sf_dir):
    coded, names = latent.with_codes(scaled(spark, sf_dir), ["quantity", "price"], 1)
    code = F.col(f"`{names[0]}`")
    per = coded.groupBy(F.col("instance_id").alias("o_orderkey")).agg(F.avg(code * code).alias("spread"))
    return rounded(latent.broadcast_latents(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), per, "o_orderkey"), 4)


def multi_sql() -> str:
    parts = []
    for t in ("target", "quantity"):
        m = f"(SELECT avg(price) AS ma, avg(tax) AS mb, avg({t}) AS mt, var_pop(price) * count(*) + 0.001 AS aa, var_pop(tax) * count(*) + 0.001 AS bb, covar_pop(price, tax) * count(*) AS ab, covar_pop(price, {t}) * count(*) AS ta, covar_pop(tax, {t}) * count(*) AS tb FROM f)"
        w = f"(SELECT *, (bb * ta - ab * tb) / (aa * bb - ab * ab) AS wa, (aa * tb - ab * ta) / (aa * bb - ab * ab) AS wb FROM {m})"
        parts += [f"SELECT '{t}' AS target, '{n}' AS term, round({e}, 4) + 0.0 AS coefficient FROM {w}" for n, e in (("price", "wa"), ("tax", "wb"), ("intercept", "mt - wa * ma - wb * mb"))]
    return FLAT + " UNION ALL ".join(parts)


@query(multi_sql())
def multi_ridge(spark, sf_dir):
    return rounded(latent.multi_ridge(flat_features(spark, sf_dir), ["price", "tax"], ["target", "quantity"]).drop("r2"), 4)


@query()
def random_feature_codes(spark, sf_dir):
    return latent.random_features(flat_features(spark, sf_dir), FEATURES, "target", 4)


@query()
def diagonalising_basis(spark, sf_dir):
    """The operator from each vector to its smoothed rotation: encodings by how diagonal they make it."""
    v = table(spark, sf_dir, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("x"))
    y = F.transform("x", lambda a, i: 0.5 * a + 0.25 * F.get("x", (i + 1) % 16) + 0.25 * F.get("x", (i + 15) % 16))
    return rounded(latent.diagonalising(v.withColumn("y", y), "x", "y"))


@query("SELECT l_orderkey AS instance_id, l_linenumber AS family_index, max(l_quantity) AS quantity, max(o_totalprice) AS total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1 GROUP BY ALL")
def target_lookup(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("family_index")).agg(F.max("l_quantity").alias("quantity"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance_id"), F.lit(1).alias("family_index"), F.col("o_totalprice").alias("total"))
    return storage.with_target(line, targets, "total")
