"""Conjecture records, promotion, archives, ids, costs and certificates against plain Python."""

import hashlib
import json
import math
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry.operators import candidates, promotion, records, registry

DRAW = random.Random(23)


def test_instance_ids_equal_canonical_json(spark):
    rows = [("tsp", 8, 3, {"b": 1.5, "a": 2.0}), ("tsp", 8, 4, {"a": 2.0, "b": 1.5}), ("q", 0, -1, {})]
    df = spark.createDataFrame(rows, "d string, size int, seed int, params map<string,double>")
    got = [r[0] for r in df.select(records.instance_id(F.col("d"), F.col("size"), F.col("seed"), F.col("params"))).collect()]
    text = [json.dumps({"domain_id": d, "size": n, "seed": s, "params": p}, sort_keys=True, separators=(",", ":")) for d, n, s, p in rows]
    assert got == [hashlib.sha256(t.encode()).hexdigest()[:16] for t in text]


def test_costs_take_the_first_prefix(spark):
    names = ["graph.degree", "walsh_log.x", "metric.q", "latent.2", "gen.a", "other", "updates"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(records.descriptor_cost(F.col("n"))).collect()] == [1.0, 5.0, 0.1, 4.0, 0.25, 1.0, 1.0]
    rows = spark.createDataFrame([(1.0, 2.0, "x")] * 4, "`update.a` double, `metric.b` double, c string")
    assert [tuple(r) for r in records.ledger(rows).collect()] == [("update.a", 2.0, 8.0)]


def test_maps_of_scalars_and_criteria(spark):
    row = spark.createDataFrame([({"update.a": 1.0, "stats.b": 2.0, "overlap.c": None}, {"x": None, "a": math.nan, "b": 0.0, "i": math.inf})], "s map<string,double>, c map<string,double>")
    got = row.select(records.cross_slice(F.col("s")), records.vacuous_criteria(F.col("c"))).first()
    assert got[0] == {"update.a": 1.0, "overlap.c": None} and got[1] == ["a", "i", "x"]


def test_distances_of_arrays(spark):
    a, b, w = [1.0, -2.0, 0.5], [0.5, 1.0, 3.0], [2.0, 1.0, 0.0]
    df = spark.createDataFrame([(a, b, w), (a, b[:2], w), (a, b, [0.0] * 3), ([], [], [])], "a array<double>, b array<double>, w array<double>")
    got = df.select(records.step_operator_norm(F.col("a"), F.col("b"), F.col("w")), records.largest_difference(F.col("a"), F.col("b")), records.byte_size(F.col("a"))).collect()
    p = np.array(w) * a
    assert abs(got[0][0] - np.linalg.norm(np.array(b) - p / np.linalg.norm(p))) < 1e-12 and [r[0] for r in got[1:]] == [None] * 3
    assert [r[1] for r in got] == [3.0, None, 3.0, None] and [r[2] for r in got] == [24, 24, 24, 0]


def test_certificates_tell_exact_from_close(spark):
    rows = [([0.1 * k * DRAW.random() for k in range(12)],) for _ in range(20)] + [(None,), ([],)]
    got = {r["representation"]: r for r in records.certificates(spark.createDataFrame(rows, "v array<double>"), "v").collect()}
    assert all(r["status"] == "verified" and r["n"] == 20 for r in got.values())
    assert got["identity"]["exact"] and got["sorted_permutation"]["exact"] and not got["difference"]["exact"]
    strict = {r["representation"]: r["status"] for r in records.certificates(spark.createDataFrame(rows, "v array<double>"), "v", 0.0).collect()}
    assert strict["identity"] == "verified" and strict["difference"] == "refuted"


def test_update_predictor_equals_numpy(spark):
    x = np.random.default_rng(5).normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + np.random.default_rng(6).normal(size=40)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, step double")
    got = records.update_predictor(df, ["a", "b", "c", "step"], "step").first()
    d, t = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(d.T @ d + 1e-3 * np.eye(3), d.T @ t)
    assert (got["n"], got["features"]) == (40, 3) and abs(got["r2"] - (1 - ((t - d @ w) ** 2).sum() / (t**2).sum())) < 1e-9
    assert records.update_predictor(df.limit(3), ["a", "b", "c"], "step").first()["r2"] is None


def test_held_out_prefixes(spark):
    df = spark.createDataFrame([("promo_a",), ("x_promo",), ("plain",), (None,)], "g string")
    assert [r[0] for r in df.select(records.held_out_by_prefix(F.col("g"), ["promo", "zz"])).collect()] == [True, True, False, False]


def canonical(text):
    s = re.sub(r"\s+", "", text.lower()).replace("**", "^")
    s = re.sub(r"\+0(\.0+)?(?=[+\-*)/]|$)", "", s)
    return re.sub(r"(?<=[+\-*/(])0(\.0+)?(?=[+\-*)/]|$)", "", s) or "empty"


def test_canonical_forms_and_rediscovery(spark):
    texts = ["A + B", "a+b + 0", "a ** 2+0.00", "(0.0)", "x - 0 + y", "10 + x", "a+0.5", "  ", "a + 0 + 0", "0*x"]
    df = spark.createDataFrame([(i % 3, t, float(i)) for i, t in enumerate(texts)], "seed int, t string, fitness double")
    assert [r[0] for r in df.select(promotion.canonical(F.col("t"))).collect()] == [canonical(t) for t in texts]
    got = {r["form"]: (r["seeds"], r["share"], r["best"]) for r in promotion.rediscovery(df, "seed", "t", "fitness").collect()}
    assert got["a+b"] == (2, 2 / 3, 1.0)


def test_records_are_promoted_and_rejected(spark, tmp_path):
    hits = spark.createDataFrame([("add(a, b)", 3, 4.0, 0.9, 0.81, 1.0, 0.9), ("a", 1, 1.5, 0.4, 0.16, None, None)], "candidate string, length int, mdl double, r double, r2 double, stability double, extrapolation double")
    symbolic = spark.createDataFrame([("a+b+c", "pysr", 0, 0.64, None), ("a", "physics_templates", 2, 0.9, -0.95)], "equation string, method string, terms int, r2 double, r double")
    latent = spark.createDataFrame([(None, "a*b", 0.8, 0.7)], "latent_column string, equation string, r2 double, main_target_correlation double")
    programs = spark.createDataFrame([("add(a, b)", 0.6, 0.5), ("add(a, b)", 0.7, 0.5), ("low", None, 0.1)], "expression string, fitness double, r double")
    every = promotion.metric_records(hits, "t").union(promotion.symbolic_records(symbolic, "t")).union(promotion.latent_records(latent, "t")).union(promotion.program_records(programs, "t"))
    best = promotion.promoted(every, 10, 0.5)
    got = best.collect()
    assert [(r["source"], r["expression"]) for r in got] == [("metric_dsl", "add(a, b)"), ("symbolic", "a"), ("latent_interpretation", "latent ≈ a*b"), ("gp", "add(a, b)"), ("symbolic", "a+b+c")]
    by = {(r["source"], r["expression"]): r for r in got}
    assert abs(by["symbolic", "a+b+c"]["mdl"] - (3 + 1.5 + 0.05)) < 1e-12 and by["symbolic", "a+b+c"]["r"] == 0.8 and abs(by["symbolic", "a"]["mdl"] - 2.51) < 1e-12
    assert abs(by["latent_interpretation", "latent ≈ a*b"]["mdl"] - 3.15) < 1e-12 and by["gp", "add(a, b)"]["r2"] == 0.7 and by["gp", "add(a, b)"]["level"] == 0
    assert sorted(r["expression"] for r in promotion.rejected(every).collect()) == ["a", "low"]
    promotion.write_records(best, str(tmp_path / "conjectures"))
    assert spark.read.json(str(tmp_path / "conjectures")).count() == 5


def test_elites_by_behaviour(spark):
    rows = [(DRAW.randrange(40) / 10, DRAW.randrange(40) / 10, DRAW.randrange(5) / 1.0, i) for i in range(300)] + [(None, 1.0, 9.0, 900), (1.0, 1.0, float("nan"), 901)]
    df = spark.createDataFrame(rows, "x double, y double, fit double, name int").repartition(4)
    want = {}
    for x, y, fit, name in rows[:300]:
        key = (math.floor(x / 0.5), math.floor(y / 2.0))
        want[key] = min(want.get(key, (0, 10**9)), (-fit, name))
    got = {(r["bucket_x"], r["bucket_y"]): (-r["fitness"], r["best"]) for r in promotion.elite_archive(df, {"x": 0.5, "y": 2.0}, "fit", "name").collect()}
    assert got == want


def test_population_ignores_order_only(spark):
    rows = [(i, i % 3, "x") for i in range(50)] + [(None, 1, "y")]
    a = spark.createDataFrame(rows, "t long, g int, s string")
    b = spark.createDataFrame(rows[::-1], "t long, g int, s string").repartition(7)
    mark = lambda df: tuple(promotion.population(df, "t").first())
    assert mark(a) == mark(b) and mark(a) != mark(a.limit(50)) and mark(a) != mark(a.withColumn("t", F.col("t") + 1)) and mark(a) != mark(a.withColumnRenamed("g", "h"))


def test_fragments_and_separation(spark):
    df = spark.createDataFrame([("mul(graph.a, b)",), ("add(graph.a, graph.a)",), ("b_1",), (None,)], "e string")
    assert [tuple(r) for r in promotion.fragments(df, "e").collect()] == [("graph.a", 3)]
    rows = [(0, 1.0), (0, 2.0), (1, 9.0), (1, 10.0), (1, None)]
    got = promotion.cluster_separation(spark.createDataFrame(rows, "c int, y double"), F.col("c"), "y").first()
    assert abs(got["separation"] - 8 / np.std([1, 2, 9, 10])) < 1e-12 and got["separated"]
    flat = promotion.cluster_separation(spark.createDataFrame([(0, 1.0), (1, 1.0)], "c int, y double"), F.col("c"), "y").first()
    assert flat["separation"] is None and not flat["separated"]
    report = spark.createDataFrame([(1, 0.9, 1.0), (2, -0.6, 0.5), (3, 0.7, 0.8), (4, 0.6, 0.9), (21, 0.9, 0.0)], "place int, r double, stability double")
    found = promotion.stability_summary(report).first()
    assert abs(found["median_stability"] - 0.85) < 1e-12 and found["stable"]


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_promoted_parts_with_equal_prices_go_by_key(spark, tmp_path):
    """Rows in the order of the SQL: many equal prices, some only once rounded, half cents, and none, NaN or
    infinite ones; keys that are null."""
    parts = [(1000 - i, f"T{i % 23}", i % 2, 5.0 + DRAW.randrange(3) + DRAW.randrange(5) / 1000) for i in range(300)]
    odd = [(2**53 + 1, None, 1, 9.0), (2**53, None, 2, 9.0), (None, "B", None, 9.0), (7, "U", 1, float("nan")), (6, "U", 1, float("inf")), (None, "V", 1, float("inf")), (5, "W", 1, None), (None, "A", 3, 9.001), (4, "C", 3, 9.004)]
    half = [(i, f"T{i % 23}", i % 2, (i * 10 + 5) / 1000) for i in range(90, 128)]
    few = [(9, "N", 1, None), (None, "M", 1, None), (8, "M", 1, -1.0), (3, "M", 1, float("nan"))]
    con = duckdb.connect()
    for name, rows in (("ties", parts), ("odd", parts + odd), ("half", half), ("few", odd + few)):
        (tmp_path / name).mkdir()
        con.sql("CREATE OR REPLACE TABLE part (p_partkey BIGINT, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE)")
        con.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", rows)
        con.sql(f"COPY part TO '{tmp_path / name / 'part.parquet'}'")
        want = con.sql(registry.oracle_sql()["promoted"]).fetchall()
        got = [tuple(r) for r in registry.queries()["promoted"](spark, str(tmp_path / name)).collect()]
        assert len(got) == len(want) and all(same(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True)), name


def test_merged_top_keeps_rows_as_they_are(spark):
    nan = float("nan")
    rows = [("a", 2.0, 2**53 + 1, nan), ("a", 3.0, None, 1.0), (None, nan, 2**53 + 3, None), (None, 1.0, 5, 2.0), ("b", 2.0, None, None), ("c", None, 2**60 + 1, nan), ("d", 1.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, n long, y double").repartition(5)
    order = candidates.falling("x", F.col("x")) | {"k": F.col("k"), "n": F.col("n")}
    want = [rows[2], rows[1], rows[4], rows[6], rows[5]]
    for most in (1, 3, 9):
        got = [tuple(r) for r in candidates.merged_top(df, ["k"], order, most).collect()]
        assert len(got) == min(most, 5) and all(same(a, b) for g, w in zip(got, want, strict=False) for a, b in zip(g, w, strict=True))
