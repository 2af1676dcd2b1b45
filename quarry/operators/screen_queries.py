"""Registered queries of screens, holdout searches, symmetries and merged rankings, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import candidates, holdout, rank_correlation, representation, screens, statistics
from quarry.operators.registered import FEATURES, FLAT, TAPE, VEC, query, rounded, safe_r
from quarry.operators.search_queries import SCORES, names_sql
from quarry.plans import expression as ex
from quarry.sources.tables import flat_features, table

#: Return flags as families, discount as rate, tax as the span where the line number is odd.
SHAPE = FLAT + ", g AS (SELECT size, generator AS family, family_index, discount AS x, CASE WHEN family_index % 2 = 1 THEN tax END AS s FROM f)\n"
SHAPE_STATS = "count(*) AS n, count(x) AS n_collision, count(s) AS n_span, round(avg(x), 6) AS mean_collision, round(avg(s), 6) AS mean_span, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit"


@query(SHAPE + f"""SELECT 'family' AS "by", size, family, NULL::BIGINT AS rank, {SHAPE_STATS} FROM g GROUP BY size, family
UNION ALL SELECT 'rank', size, NULL, CAST(family_index AS BIGINT), {SHAPE_STATS} FROM g WHERE family_index <> 7 GROUP BY size, family_index""")
def pairing_shape(spark, sf_dir):
    """Mean rate and span by family and size, and by rank and size (line 7 has no rank), in one scan."""
    rows = flat_features(spark, sf_dir)
    rows = rows.select("size", "generator", "discount", F.when(F.col("family_index") % 2 == 1, F.col("tax")).alias("span"), F.when(F.col("family_index") != 7, F.col("family_index")).alias("rank"))
    return rounded(screens.pairing_shape(rows, "discount", "span", "generator", "size", "rank"))


SCREEN = FLAT + """, k AS (SELECT * FROM f WHERE generator IN ('A', 'N')), q AS (SELECT quantile_cont(discount, 0.99) AS tau FROM k WHERE generator = 'N'),
"""


@query(SCREEN + f"""r AS (SELECT abs({safe_r('discount', 'target')}) AS discovery_r FROM k),
p AS (SELECT size, count(discount) FILTER (generator = 'R') AS n_held_out, count(discount) FILTER (generator = 'N') AS n_random,
 avg(CASE WHEN discount > tau THEN 1.0 ELSE 0.0 END) FILTER (generator = 'R') AS recall,
 avg(CASE WHEN discount > tau THEN 1.0 ELSE 0.0 END) FILTER (generator = 'N') AS fpr, any_value(tau) AS threshold FROM f, q GROUP BY size)
SELECT size, n_held_out, n_random, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(threshold, 6) AS threshold, round(discovery_r, 6) AS discovery_r,
 discovery_r >= 0.35 AND (SELECT bool_and(coalesce(recall >= 0.8 AND fpr <= 0.05, false)) FROM p) AS passed FROM p, r""")
def heldout_screen(spark, sf_dir):
    """Discounts of held-out flag R against the threshold frozen on the controls N, by size."""
    return rounded(screens.heldout_screen(flat_features(spark, sf_dir), "discount", "target", "generator", "size", ["A", "N"], ["R"], ["N"]))


@query(FLAT + "SELECT generator, round(quantile_cont(price, 0.99), 4) AS quantile, count(price) AS n FROM f GROUP BY generator")
def rate_quantiles(spark, sf_dir):
    found = statistics.quantiles(flat_features(spark, sf_dir), ["generator"], F.col("price"), 0.99)
    return rounded(found, 4)


@query("""WITH e AS (SELECT label, vec_id % 4 AS size, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, vec_id FROM embeddings),
p AS (SELECT size, CASE WHEN vec_id % 3 = 0 THEN 'held_' ELSE 'class_' END || CAST(label % 3 AS VARCHAR) AS family, v[1] AS x, v[2] AS y FROM e),
c AS (SELECT size, family, avg(x) AS x, avg(y) AS y FROM p WHERE family LIKE 'class_%' GROUP BY ALL),
d AS (SELECT p.size, p.family, row_number() OVER () AS i, p.x, p.y FROM p WHERE p.family LIKE 'held_%'),
n AS (SELECT d.size, d.i, d.family, arg_min(c.family, (sqrt(pow(c.x - d.x, 2) + pow(c.y - d.y, 2)), c.family)) AS near FROM d JOIN c USING (size) GROUP BY ALL)
, r AS (SELECT size, count(*) AS n_held_out, count(*) FILTER (replace(near, 'class_', 'held_') = family) AS correct FROM n GROUP BY size)
SELECT CAST(size AS BIGINT) AS size, n_held_out, correct, round(correct / n_held_out, 6) AS recall, (SELECT min(correct / n_held_out) >= 0.8 FROM r) AS passed FROM r""")
def class_screen(spark, sf_dir):
    """Every third vector against the nearest class centre of its size in two coordinates."""
    e = table(spark, sf_dir, "embeddings")
    family = F.concat(F.when(F.col("vec_id") % 3 == 0, "held_").otherwise("class_"), (F.col("label") % 3).cast("string"))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = e.select((F.col("vec_id") % 4).cast("long").alias("size"), family.alias("family"), at(0).alias("x"), at(1).alias("y"))
    return rounded(screens.class_screen(rows, ["x", "y"], "family", "size", [f"class_{i}" for i in range(3)], {f"held_{i}": f"class_{i}" for i in range(3)}))


@query(FLAT + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS x, target AS y FROM f" for c in FEATURES) + """),
r AS (SELECT col, rank() OVER (PARTITION BY col ORDER BY x) + (count(*) OVER (PARTITION BY col, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY col ORDER BY y) + (count(*) OVER (PARTITION BY col, y) - 1) / 2.0 AS b FROM l)
SELECT col AS "column", count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY col""")
def rank_correlations(spark, sf_dir):
    """Spearman's rho of each column with the target; quantity, discount and tax are mostly ties."""
    return rounded(rank_correlation.rank_correlations(flat_features(spark, sf_dir), FEATURES, "target"))


@query(VEC + """, q AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x, i) AS j FROM (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS i FROM e)),
b AS (SELECT vec_id, count(*) FILTER (WHERE step <> 1) / 64.0 AS breaks FROM (SELECT vec_id, i - lag(i) OVER (PARTITION BY vec_id ORDER BY j) AS step FROM q) GROUP BY vec_id),
n AS (SELECT label, len(list_filter(v, lambda x: abs(x) > 1e-6)) / 64.0 AS i, len(list_filter([v[1]] || list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]), lambda x: abs(x) > 1e-6)) / 64.0 AS d,
 len(list_filter(v, lambda x: abs(x) > 1e-6)) / 64.0 + breaks AS s FROM e JOIN b USING (vec_id)),
w AS (SELECT label, least(i, d, s) AS c, i <= d AND i <= s AS own FROM n),
r AS (SELECT rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS a, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS b, own FROM w)
SELECT count(*) AS n, round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END, 6) AS rho, round(avg(CASE WHEN own THEN 1.0 ELSE 0.0 END), 6) AS trivial_wins FROM r""")
def preregistered_check(spark, sf_dir):
    """Labels against the cost of the cheapest of three encodings of each vector, as fixed beforehand."""
    found = screens.preregistered_check(representation.best_encoding(table(spark, sf_dir, "embeddings"), "embedding"), "label", "share", "encoding", "identity")
    return rounded(found.select("n", "rho", "trivial_wins"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
x AS (SELECT vec_id, (i % 8 - i // 8 + 8) % 8 AS diagonal, v[i + 1] AS x FROM e, range(0, 64) t(i)), m AS (SELECT vec_id, diagonal, avg(x) AS mean FROM x GROUP BY ALL),
d AS (SELECT x.vec_id, sqrt(sum(pow(x - mean, 2))) / sqrt(sum(x * x)) AS deviation FROM x JOIN m USING (vec_id, diagonal) GROUP BY x.vec_id)
SELECT CAST(8 AS INTEGER) AS side, count(*) AS n, CAST(8 AS BIGINT) AS elements, round(avg(deviation), 6) AS deviation, avg(deviation) <= 0.05 AS conserved FROM d""")
def conservation(spark, sf_dir):
    """Vectors as 8 x 8 matrices against their average over the cyclic group: the mean of each cyclic diagonal."""
    return rounded(representation.conservation(table(spark, sf_dir, "embeddings"), "embedding"))


@query()
def polynomial_roundtrip(spark, sf_dir):
    """Polynomials through the first 4, 8, 12 and 16 elements of each vector, and through all."""
    v = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    cuts = v.select(F.explode(F.array(*[F.slice("v", 1, n) for n in (4, 8, 12, 16)], F.col("v"))).alias("v"))
    return representation.polynomial_roundtrip(cuts, "v").select("length", "n", "ill_conditioned", "verified")


TEMPLATE, DERIVED = ex.products(FEATURES), ex.ratios(["quantity", "price", "retail"])
MERGED = FLAT + f", c AS ({names_sql([*TEMPLATE, *DERIVED])})" + SCORES


@query(f"""WITH s AS ({MERGED}), h AS (SELECT CASE WHEN candidate LIKE 'mul%' THEN 'template' ELSE 'derived' END AS source, * FROM s)
SELECT source, candidate, r2 FROM h WHERE abs(r) >= 0.0 QUALIFY row_number() OVER (ORDER BY -CASE WHEN extrapolation IS NULL THEN -1.0 ELSE least(extrapolation, 1.0) END,
 -CASE WHEN stability IS NULL THEN -1.0 ELSE greatest(stability, 0.0) END, -r2, length, -abs(r), candidate) <= 8""")
def merged_hits(spark, sf_dir):
    """Template and derived candidates in one list, of each source and expression the best, the first eight."""
    rows = flat_features(spark, sf_dir)
    hits = []
    for source, nodes in (("template", TEMPLATE), ("derived", DERIVED)):
        s = candidates.scored(rows, nodes)
        hits.append(rounded(s, 5, extrapolation=4).withColumn("source", F.lit(source)))
    both = hits[0].union(hits[1]).union(hits[0])  # the templates twice: repeats count once
    best = candidates.merged_top(both.where(F.abs("r") >= 0.0), ["source", "candidate"], candidates.rank_key(both), 8)
    return best.select("source", "candidate", "r2")


PLANTED = {"quantity": "size % 7 <> 0", "price": "family_index % 2 = 1", "discount": "size % 5 <> 0", "tax": "family_index % 2 = 0", "retail": "size > 2"}


@query(FLAT + ", g AS (SELECT target, size, " + ", ".join(f"CASE WHEN {c} THEN {n} END AS {n}" for n, c in PLANTED.items()) + " FROM f),\n"
    + "h AS (SELECT " + " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, n in enumerate(PLANTED)) + " AS mask, count(*) AS n FROM g WHERE target IS NOT NULL GROUP BY 1),\n"
    + "o AS (" + " UNION ALL ".join(f"SELECT '{n}' AS col, {1 << i} AS bit, {i} AS given, count({n}) AS own, abs({safe_r(n, 'target')}) AS r FROM g WHERE {n} IS NOT NULL" for i, n in enumerate(PLANTED)) + "),\n"
    + """k AS (SELECT *, row_number() OVER (ORDER BY coalesce(r, 0) <= 0, -coalesce(r, 0), given) AS i FROM o WHERE own >= 10),
""" + "\n".join(f"""s{i} AS (SELECT {'0' if i == 1 else f's{i - 1}.mask'} + CASE WHEN (SELECT coalesce(sum(n), 0) FROM h WHERE h.mask & ({'0' if i == 1 else f's{i - 1}.mask'} + k.bit) = {'0' if i == 1 else f's{i - 1}.mask'} + k.bit) >= 10 THEN k.bit ELSE 0 END AS mask
 FROM k{'' if i == 1 else f', s{i - 1}'} WHERE k.i = {i}),""" for i in range(1, 6)) + """
c AS (SELECT k.*, row_number() OVER (ORDER BY k.i) AS place, sum(bit) OVER (ORDER BY k.i) AS joint FROM k, s5 WHERE s5.mask & bit = bit)
SELECT col AS "column", CAST(place AS INTEGER) AS place, round(r, 6) AS r, own AS finite, CAST((SELECT sum(n) FROM h WHERE h.mask & CAST(joint AS INTEGER) = CAST(joint AS INTEGER)) AS BIGINT) AS joint FROM c""")
def symbolic_features(spark, sf_dir):
    """Columns with planted nulls, chosen so that enough rows stay finite in all of them; price and tax are never both known."""
    rows = flat_features(spark, sf_dir)
    rows = rows.select("target", "size", *[F.when(F.expr(c), F.col(n)).alias(n) for n, c in PLANTED.items()])
    return rounded(holdout.select_features(rows, "target", list(PLANTED), 5))


SPLIT_NODES = [*ex.products(FEATURES), *ex.ratios(["quantity", "price", "retail"])]


@query(FLAT + f", c AS ({names_sql(SPLIT_NODES).replace('target AS y FROM f', 'target AS y, instance_id % 2 = 0 AS train FROM f')}),\n"
    + f"""r AS (SELECT candidate, train, abs({safe_r('x', 'y')}) AS r FROM c WHERE isfinite(x) GROUP BY ALL)
SELECT a.candidate, round(a.r, 6) AS train_objective, round(b.r, 6) AS holdout_objective FROM r a JOIN r b USING (candidate) WHERE a.train AND NOT b.train AND a.r >= 0.5 AND b.r >= 0.5""")
def held_out_expressions(spark, sf_dir):
    """Candidates that hold on even instances, scored again on odd ones."""
    rows = flat_features(spark, sf_dir)
    return rounded(holdout.held_out_expressions(rows, SPLIT_NODES, F.col("instance_id") % 2 == 0, "target", 0.5))


CHAIN_BITS, CHAIN_MODULUS = 6, 64
BAG_SQL = {"xor": "xor(x, b)", "sum": "(x + b) % 64", "diff": "(x - b) % 64"}
POST_SQL = {"id": "{0}", "low_half": "{0} & 7", "high_half": "{0} >> 3", "low_3": "{0} & 7"}


def chains_sql() -> str:
    """Modes and greatest common divisors of each bag, their parts, and pairs of parts of different bags, as rows by user."""
    parts = [TAPE.rstrip() + ", d AS (SELECT DISTINCT user_id, x, y FROM t), b AS (SELECT user_id, x, min(x) OVER (PARTITION BY user_id, y) AS b FROM d)"]
    for bag, value in BAG_SQL.items():
        parts.append(f"v_{bag} AS (SELECT user_id, {value} AS value FROM b WHERE x <> b AND {value} <> 0)")
        parts.append(f"m_{bag} AS (SELECT user_id, value FROM v_{bag} GROUP BY user_id, value QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, value) = 1)")
        parts.append(f"g_{bag} AS (SELECT user_id, list_reduce(list(value), lambda a, c: gcd(a, c)) AS value FROM v_{bag} GROUP BY user_id)")
    singles = [f"SELECT user_id, '{bag}_{red}_{post}' AS name, '{bag}' AS bag, {i} AS i, {form.format('value')} AS value FROM {red[0]}_{bag}"
        for i, (bag, red, post, form) in enumerate((bag, red, post, form) for bag in BAG_SQL for red in ("mode", "gcd") for post, form in POST_SQL.items())]
    parts.append("s AS (" + " UNION ALL ".join(singles) + ")")
    parts.append("n AS (SELECT DISTINCT name, bag, i FROM s), u AS (SELECT DISTINCT user_id FROM t)")
    parts.append("c AS (SELECT user_id, name AS candidate, 1 AS depth, CAST(value AS VARCHAR) AS value FROM u CROSS JOIN n LEFT JOIN s USING (user_id, name) UNION ALL "
        "SELECT u.user_id, 'pair[' || p.name || '|' || q.name || ']', 2, CAST(a.value AS VARCHAR) || '|' || CAST(z.value AS VARCHAR) FROM u CROSS JOIN n p JOIN n q ON p.i < q.i AND p.bag <> q.bag "
        "LEFT JOIN s a ON a.user_id = u.user_id AND a.name = p.name LEFT JOIN s z ON z.user_id = u.user_id AND z.name = q.name)")
    return ", ".join(parts)


@query(chains_sql() + """, k AS (SELECT user_id, min(value) AS low FROM m_diff GROUP BY user_id), p AS (SELECT user_id, CAST(low & 7 AS VARCHAR) AS secret FROM k WHERE user_id % 5 <> 0 UNION ALL SELECT user_id, '-' FROM k WHERE user_id % 5 = 0),
r AS (SELECT candidate, depth, user_id % 2 = 0 AS fold, avg(CASE WHEN coalesce(value = secret, false) THEN 1.0 ELSE 0.0 END) AS recall FROM c JOIN p USING (user_id) GROUP BY ALL)
SELECT a.candidate, CAST(a.depth AS INTEGER) AS depth, round(a.recall, 6) AS discovery_recall, round(b.recall, 6) AS confirmatory_recall, round(b.recall / a.recall, 6) AS recall_ratio
FROM r a JOIN r b USING (candidate) WHERE a.fold AND NOT b.fold AND a.recall >= 0.75 AND b.recall >= 0.75""")
def recovery_chains(spark, sf_dir):
    """Chains that recover the low bits of each user's commonest difference, hidden for every fifth user, on even and on odd users."""
    tape = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("event_id") % 97).alias("y"))
    values = holdout.recovery.pair_values(tape, "user_id", "x", "y", "diff", CHAIN_MODULUS)
    low = holdout.recovery.mode(values, "user_id").select("user_id", F.col("mode").bitwiseAND(F.lit(7)).cast("string").alias("low"))
    planted = low.select("user_id", F.when(F.col("user_id") % 5 == 0, "-").otherwise(F.col("low")).alias("secret"))
    found = holdout.search_recovery_chains(tape, planted, "user_id", "x", "y", F.col("user_id") % 2 == 0, CHAIN_MODULUS, CHAIN_BITS, 2, 0.75)
    return rounded(found)
