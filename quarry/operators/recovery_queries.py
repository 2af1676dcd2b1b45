"""Registered queries that recover planted structure from tapes of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import recovery
from quarry.operators.registered import TAPE, query, rounded
from quarry.sources.tables import table

MODULUS = 64
#: Pairs of the smallest x of a group with every other.
PAIRS = TAPE + """, d AS (SELECT DISTINCT user_id, x, y FROM t), b AS (SELECT user_id, x, min(x) OVER (PARTITION BY user_id, y) AS b FROM d),
s AS (SELECT user_id, {value} AS value FROM b WHERE x <> b), v AS (SELECT * FROM s WHERE value <> 0)
"""


def tape(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("event_id") % 97).alias("y"))


def pairs(spark, sf_dir, op, modulus=MODULUS):
    return recovery.pair_values(tape(spark, sf_dir), "user_id", "x", "y", op, modulus)


@query(PAIRS.format(value="(x - b) % 10007") + "SELECT user_id, list_reduce(list(value), lambda a, c: gcd(a, c)) AS gcd FROM v GROUP BY user_id")
def gcd_program(spark, sf_dir):
    return recovery.gcd_of(pairs(spark, sf_dir, "diff", 10007), "user_id")


@query(PAIRS.format(value="(x - b) % 64") + ", k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, value) AS i FROM v GROUP BY user_id, value) SELECT user_id, value >> 3 AS value FROM k WHERE i = 1")
def mode_program(spark, sf_dir):
    return recovery.program(pairs(spark, sf_dir, "diff"), "user_id", "mode", "high_half", 6)


@query(PAIRS.format(value="xor(x, b)") + "SELECT user_id, array_to_string(list_sort(list(DISTINCT value & 7)), ',') AS \"values\" FROM v GROUP BY user_id")
def unique_masked(spark, sf_dir):
    return recovery.unique_masked(pairs(spark, sf_dir, "xor"), "user_id", 3).withColumn("values", F.concat_ws(",", F.col("values").cast("array<string>")))


INVERSES = {b: pow(b, -1, 61) for b in range(1, 61)}


@query("WITH inv(r, i) AS (VALUES " + ", ".join(f"({b}, {i})" for b, i in INVERSES.items()) + "), " + PAIRS.format(value="(x % 61) * i % 61").removeprefix("WITH ").replace("FROM b WHERE", "FROM b JOIN inv ON b % 61 = r WHERE")
    + "SELECT user_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM v GROUP BY user_id")
def ratio_values(spark, sf_dir):
    v = pairs(spark, sf_dir, "ratio", 61)
    return v.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query()
def gf2_basis(spark, sf_dir):
    b = recovery.gf2_basis(pairs(spark, sf_dir, "xor"), "user_id")
    return b.select("user_id", F.size("basis").alias("rank"), "basis")


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS xs, event_id % 97 AS y FROM events GROUP BY user_id, event_id % 97 HAVING count(DISTINCT event_id) > 1""")
def label_groups(spark, sf_dir):
    g = tape(spark, sf_dir).groupBy("user_id", "y").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    return g.where(F.size("xs") > 1).withColumn("xs", F.concat_ws(",", F.col("xs").cast("array<string>")))


@query("""WITH r AS (SELECT lang AS protocol, source AS family, CAST(n_chars % 2 AS INTEGER) AS size, doc_id % 2 AS seed, CAST(quality AS DOUBLE) AS m FROM documents JOIN labels USING (doc_id)),
a AS (SELECT protocol, family, size, seed, avg(m) AS rate FROM r GROUP BY ALL),
p AS (SELECT protocol, family, CASE WHEN count(*) FILTER (seed = 0) = 2 THEN min(rate) FILTER (seed = 0) END AS d, CASE WHEN count(*) FILTER (seed = 1) = 2 THEN min(rate) FILTER (seed = 1) END AS c FROM a GROUP BY ALL)
SELECT protocol, family, round(d, 6) AS discovery, round(c, 6) AS confirmatory, coalesce(d >= 0.6 AND protocol <> 'en', false) AS candidate, coalesce(d >= 0.6 AND protocol <> 'en', false) AND coalesce(c >= 0.6, false) AS confirmed FROM p""")
def protocol_verdict(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(F.col("lang").alias("protocol"), F.col("source").alias("family"), (F.col("n_chars") % 2).cast("int").alias("size"), (F.col("doc_id") % 2).alias("seed"), F.col("quality").alias("matched"))
    return rounded(recovery.verdicts(rows, [0, 1], 0.6, ["en"]))


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'discovery' ELSE 'confirmatory' END AS fold, count(*) AS n FROM events GROUP BY ALL")
def seed_folds(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.when(F.col("event_id") % 2 == 0, "discovery").otherwise("confirmatory").alias("fold")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_id AS x, event_id % 97 AS y FROM events), b AS (SELECT *, min(x) OVER (PARTITION BY user_id, y) AS b FROM d),
s AS (SELECT user_id, y, list_sort(list(DISTINCT xor(x, b) & 7)) AS v FROM b GROUP BY user_id, y HAVING count(*) > 1),
g AS (SELECT * FROM s WHERE len(v) > 1 AND len(list_filter(v, lambda a: len(list_filter(v, lambda c: NOT list_contains(v, xor(a, c)))) > 0)) = 0)
SELECT user_id, array_to_string(v, ',') AS "values" FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY len(v) DESC, y) = 1""")
def group_closure(spark, sf_dir):
    c = recovery.closed_values(tape(spark, sf_dir), "user_id", "x", "y", 3)
    return c.select("user_id", F.concat_ws(",", F.col("values").cast("array<string>")).alias("values"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT user_id, event_id AS x, event_id * 2654435761 % 65536 AS y FROM events),
p AS (SELECT a.user_id, a.x AS a, b.x AS b FROM t a JOIN t b ON a.user_id = b.user_id AND a.x <> b.x AND bit_count(xor(a.y, b.y)) <= 2),
r AS (SELECT user_id, a AS x, a AS c FROM (SELECT DISTINCT user_id, a FROM p) UNION SELECT p.user_id, p.b, r.c FROM r JOIN p ON r.user_id = p.user_id AND r.x = p.a AND r.c < p.b),
g AS (SELECT user_id, x, min(c) AS b FROM r GROUP BY ALL), v AS (SELECT user_id, (x - b) % 64 AS value FROM g WHERE x <> b AND (x - b) % 64 <> 0),
k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, value) AS i FROM v GROUP BY user_id, value)
SELECT user_id, value & 7 AS value FROM k WHERE i = 1""")
def near_program(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), (F.col("event_id") * 2654435761 % 65536).alias("y"))
    groups = recovery.near_groups(points, "user_id", "x", "y", 2, 16)
    return recovery.program(recovery.near_pair_values(groups, "user_id", "x", "diff", MODULUS), "user_id", "mode", "low_3", 6)
