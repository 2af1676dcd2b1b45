import math
import random

from pyspark.sql import functions as F

from quarry.functions.numeric import gini, pearson
from quarry.operators import arrays, skyline, statistics
from quarry.plans import expression as ex
from quarry.streaming.ingest import feature_stream, windowed_counts


def test_correlation_policy(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0), (float("nan"), 5.0), (float("inf"), 5.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert abs(df.agg(pearson(F.col("x"), F.col("y"))).first()[0] - 1) < 1e-12
    assert df.agg(pearson(F.lit(1.0), F.col("y"))).first()[0] is None


def test_walsh_twice_is_identity(spark):
    v = [random.Random(3).random() for _ in range(16)]
    twice = arrays.walsh(arrays.walsh(F.col("v"), 16), 16)
    got = spark.createDataFrame([(v,)], "v array<double>").select(twice.alias("w")).first()[0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, v, strict=True))


def test_sparsity_of_constant_vector(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0, 1.0],)], "v array<double>")
    row = df.select(arrays.entropy(F.col("v")), gini(F.col("v")), arrays.hoyer(F.col("v"))).first()
    assert abs(row[0] - math.log(4)) < 1e-12 and abs(row[1]) < 1e-12 and abs(row[2]) < 1e-12


def test_expressions_are_clamped(spark):
    df = spark.createDataFrame([(800.0, 0.0)], "a double, b double")
    trees = ["exp(a)", "div(a, b)", "log(b)", "sqrt(neg(a))"]
    got = df.select(*[ex.compiled(ex.parsed(t)) for t in trees]).first()
    assert got[0] is None or got[0] < 1e305
    assert got[1] is None and abs(got[2] - math.log(1e-300)) < 1e-9 and got[3] == 0.0


def test_fdr_rejects_first_only(spark):
    tests = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.2), ("d", 0.5)], "k string, p double")
    got = {r["k"]: r["reject"] for r in statistics.benjamini_hochberg(tests, "p", "k").collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


def test_stream_counts(spark, tmp_path):
    source = spark.createDataFrame([("2020-01-01 00:00:10", "a", 1.0), ("2020-01-01 00:00:20", "a", 2.0)], "ts string, event_type string, value double")
    source = source.withColumn("ts", F.to_timestamp("ts"))
    source.write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(feature_stream(spark, str(tmp_path / "in"), source.schema), "ts", "1 minute", "1 minute")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["n"], r["total"]) for r in spark.sql("SELECT * FROM counts").collect()] == [(2, 3.0)]


def test_principal_variance_equals_numpy(spark):
    import numpy as np

    from quarry.operators import models

    a = np.random.default_rng(1).normal(size=(60, 3)) @ np.array([[3.0, 0, 0], [1, 1, 0], [0, 0, 0.2]])
    got = [r["explained"] for r in models.principal_variance(spark.createDataFrame(a.tolist(), "a double, b double, c double"), ["a", "b", "c"]).collect()]
    s = np.linalg.svd(a - a.mean(0), compute_uv=False) ** 2
    assert np.allclose(got, s / s.sum())


def test_models_without_rows(spark):
    from quarry.operators import models

    none = spark.createDataFrame([], "x double, y double")
    assert all(r["r2"] is None for r in models.ridge(none, ["x"], "y").collect())
    assert models.templates(none, ["x"], "y").count() == 0


def test_matrix_and_codecs_of_odd_arrays(spark):
    from quarry.operators import matrices

    rows = [(1, [2.0, 0.0, 0.0, 3.0]), (2, [1.0, 2.0]), (3, []), (4, None), (5, [0.0] * 4), (6, [float("nan")])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    found = {r["k"]: r for r in matrices.described(df, "v", ["k"], matrices.matrix, matrices.MATRIX).collect()}
    assert found[1]["trace"] == 5 and abs(found[1]["spectral"] - 3) < 1e-12 and found[1]["rank"] == 2 and abs(found[1]["condition"] - 1.5) < 1e-12
    assert all(found[k]["trace"] is None for k in (2, 3, 4, 6)) and found[5]["rank"] == 0
    sizes = {r["k"]: r for r in matrices.described(df.where("k <> 6"), "v", ["k"], matrices.codecs, matrices.CODECS).collect()}
    assert sizes[1]["raw_bits"] == 128 and sizes[4]["raw_bits"] == 0


def test_pareto_frontier_equals_brute_force(spark):
    import random

    from quarry.operators import representation

    draw = random.Random(5)
    points = [(i, draw.randrange(9), draw.randrange(9)) for i in range(60)] + [(99, None, 1)]
    df = spark.createDataFrame(points, "i int, x int, y int")
    whole = [p for p in points if None not in p]
    want = {a[0] for a in whole if not any(b[1] <= a[1] and b[2] <= a[2] and b[1:] != a[1:] for b in whole)}
    assert {r["i"] for r in skyline.frontier(df, ["x", "y"]).collect()} == want


def test_difference_is_undone(spark):
    from pyspark.sql import functions as F

    from quarry.operators import representation

    df = spark.createDataFrame([([3.0, 1.0, 4.0, 1.5],), ([],)], "v array<double>")
    for r in df.select("v", representation.undifference(representation.difference(F.col("v"))).alias("back")).collect():
        assert r["v"] == r["back"]


def test_bootstrap_has_500_replicates_and_observed_r(spark):
    from conftest import SF

    from quarry.operators import registry

    r = registry.queries()["bootstrap_clusters"](spark, SF).first()
    assert r["replicates"] == 500 and r["low"] <= r["pearson_r"] <= r["high"]
