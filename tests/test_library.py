"""Statistics, recovery and storage operators against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import permutation, recovery, relational, statistics, storage
from quarry.sources.steps import shared_path

DRAW = random.Random(11)


def test_medians_of_hot_groups(spark):
    rows = [("hot", float(DRAW.randrange(40))) for _ in range(4000)] + [("b", 1.0), ("b", 4.0), ("c", 7.0), ("d", None), (None, 3.0), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: (r["median"], r["n"]) for r in statistics.medians(df, ["g"], F.col("v")).collect()}
    hot = [v for g, v in rows if g == "hot"]
    assert got == {"hot": (float(np.median(hot)), 4000), "b": (2.5, 2), "c": (7.0, 1)}
    assert statistics.medians(df, [], F.col("v")).first()["median"] == float(np.median([v for _, v in rows if v is not None and v == v]))
    assert statistics.medians(df.limit(0), ["g"], F.col("v")).count() == 0


def test_ranks_are_a_total_order(spark):
    df = spark.createDataFrame([(DRAW.randrange(50),) for _ in range(500)], "x int").repartition(7)
    got = [r["x"] for r in statistics.ranks(df, ["x"], "test").orderBy("place").collect()]
    assert got == sorted(got) and sorted(r["place"] for r in statistics.ranks(df, ["x"], "test").collect()) == list(range(500))


def test_permutation_keeps_the_multiset(spark):
    rows = [(i % 2, i, float(i * i % 17)) for i in range(60)]
    got = statistics.permuted_target(spark.createDataFrame(rows, "size int, k int, t double"), "t", ["k"]).collect()
    assert Counter(r["permuted"] for r in got) == Counter(r[2] for r in rows) and len({r["k"] for r in got}) == 60
    assert any(r["permuted"] != rows[r["k"]][2] for r in got)
    # the shuffle is global: targets move between sizes
    by_size = Counter(r["permuted"] for r in got if r["size"] == 0)
    assert by_size != Counter(r[2] for r in rows if r[0] == 0)


def test_permutation_max_tells_signal_from_noise(spark):
    rows = [(i, float(i % 23), DRAW.random(), 2.0 * (i % 23) + DRAW.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, y double, t double")
    strong, weak = permutation.permutation_max(df, ["x", "y"], "t", ["k"], 30).first(), permutation.permutation_max(df, ["y"], "t", ["k"], 30).first()
    assert abs(strong["observed"] - np.corrcoef([r[1] for r in rows], [r[3] for r in rows])[0, 1]) < 1e-9
    assert strong["p_value"] == 1 / 31 and weak["p_value"] > 1 / 31


def test_bootstrap_equals_resampled_sums(spark):
    rows = [(f"c{i % 9}", DRAW.random(), DRAW.random()) for i in range(80)]
    got = {r["replicate"]: r["r"] for r in statistics.cluster_bootstrap(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", "k", 20).collect()}
    import hashlib

    steps = statistics.poisson_steps()
    for rep in (0, 7, 8, 19):
        x, y = [], []
        for k, a, b in rows:
            u = int.from_bytes(hashlib.sha256(f"0:{rep // 8}:{k}".encode()).digest()[4 * (rep % 8) :][:4], "big") / 2**32
            n = sum(u >= s for s in steps)
            x, y = x + [a] * n, y + [b] * n
        assert abs(got[rep] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert len(got) == 20


def test_pair_moments_with_gaps(spark):
    rows = [tuple(None if DRAW.random() < 0.2 else DRAW.gauss(1e6, 1) for _ in range(3)) for _ in range(200)]
    got = {(r["a"], r["b"]): r["r"] for r in statistics.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double").repartition(4), ["a", "b", "c"]).collect()}
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            want = 1.0 if i == j else np.corrcoef(np.array(both).T)[0, 1]
            assert abs(got[a, b] - want) < 1e-7


def test_kmeans_keeps_empty_clusters(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10, 11, 12)] + [(None,)], "x double")
    got = {r["cluster"]: (r["size"], r["x"]) for r in statistics.kmeans(df, ["x"], [[0.0], [10.0], [1e6]], 5).collect()}
    assert got.keys() == {0, 1} and sum(n for n, _ in got.values()) == 7


def tape(n, secret, bits, draw):
    out = []
    for t in range(n):
        for _ in range(60):
            x = draw.randrange(1 << bits)
            out.append((t, x, min(x, x ^ secret) if t % 2 == 0 else x))
    return out


def test_xor_mode_finds_the_planted_mask(spark):
    df = spark.createDataFrame(tape(4, 0b10110011, 8, DRAW), "t long, x long, y long")
    values = recovery.pair_values(df, "t", "x", "y", "xor", 256)
    assert {r["t"]: r["mode"] for r in recovery.mode(values, "t").collect()} == {0: 0b10110011, 2: 0b10110011}
    assert {r["t"]: r["basis"] for r in recovery.gf2_basis(values, "t").collect()} == {0: [0b10110011], 2: [0b10110011]}
    assert {r["value"] for r in recovery.program(values, "t", "mode", "low_half", 8).collect()} == {0b0011}


def test_margin_abstains(spark):
    df = spark.createDataFrame([(1, 5)] * 9 + [(1, 6)] * 3 + [(2, 5)] * 8 + [(2, 6)] * 3 + [(3, 4)], "t long, value long")
    assert {r["t"]: r["mode"] for r in recovery.mode(df, "t", 3.0).collect()} == {1: 5, 2: None, 3: 4}


def test_gcd_and_ratio(spark):
    values = spark.createDataFrame([(1, 12), (1, 18), (2, 7)], "t long, value long").repartition(3)
    assert {r["t"]: r["gcd"] for r in recovery.gcd_of(values, "t").collect()} == {1: 6, 2: 7}
    pairs = spark.createDataFrame([(1, 3, 6), (1, 5, 5), (1, 10, 4)], "t long, base long, other long")
    assert sorted(r["value"] for r in recovery.combined(pairs, "t", "ratio", 10).collect()) == [2]


def test_near_groups_equal_brute_force(spark):
    for radius in (0, 1, 3):
        points = [(t, x, DRAW.randrange(1 << 10)) for t in (1, 2) for x in range(60)]
        got = {(r["t"], r["x"]): r["component"] for r in recovery.near_groups(spark.createDataFrame(points, "t long, x long, y long"), "t", "x", "y", radius, 10).collect()}
        label = {(t, x): x for t, x, _ in points}
        for _ in range(60):
            for t, x, y in points:
                for u, w, z in points:
                    if t == u and bin(y ^ z).count("1") <= radius:
                        label[t, x] = min(label[t, x], label[u, w])
        linked = {(t, x) for t, x, y in points if any(t == u and x != w and bin(y ^ z).count("1") <= radius for u, w, z in points)}
        assert got == {k: label[k] for k in linked}


def test_verdicts_need_every_size(spark):
    rows = [("p", "f", s, seed, 1) for s in (8, 16) for seed in (0, 1)] + [("q", "f", 8, 0, 1), ("book", "f", 8, 0, 1), ("book", "f", 16, 0, 1), ("r", "f", 8, 0, 1), ("r", "f", 16, 0, 0)]
    got = {r["protocol"]: (r["candidate"], r["confirmed"]) for r in recovery.verdicts(spark.createDataFrame(rows, "protocol string, family string, size int, seed int, matched int"), [8, 16], 0.8, ["book"]).collect()}
    assert got == {"p": (True, True), "q": (False, False), "book": (False, False), "r": (False, False)}


def test_a_missing_split_raises(spark):
    rows, folds = spark.createDataFrame([(1,), (2,)], "i long"), spark.createDataFrame([(1, "discovery")], "i long, split_fold string")
    assert relational.with_split(rows.where("i = 1"), folds, "i").first()["split_fold"] == "discovery"
    with pytest.raises(Exception, match="no split for instance 2"):
        relational.with_split(rows, folds, "i").collect()


def test_runs_are_stored_sealed_and_merged(spark, tmp_path):
    schema = "instance_id long, family_index int, size int, generator string, x double"
    run = storage.Run(spark, str(tmp_path / "run"))
    assert run.features() is None and run.completed().count() == 0
    run.append(spark.createDataFrame([(1, 1, 4, "a", 1.0), (1, 2, 4, "a", 2.0)], schema))
    assert run.complete(2) and not run.complete(3)
    run.seal()
    run.append(spark.createDataFrame([(1, 2, 4, "a", 9.0), (2, 1, 4, "a", 3.0)], schema).withColumn("y", F.lit(5.0)))
    got = sorted((r["instance_id"], r["family_index"], r["x"], r["y"]) for r in run.features().collect())
    assert got == [(1, 1, 1.0, None), (1, 2, 2.0, None), (2, 1, 3.0, 5.0)]
    run.export(str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).columns == ["instance_id", "family_index", "size", "generator", "x", "y"]
    run.export(str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    run.reset()
    assert run.features() is None


def test_manifest_ignores_row_order(spark):
    rows = [(i, i % 3, 4, "a", float(i)) for i in range(30)]
    schema = "instance_id long, family_index int, size int, generator string, x double"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema).repartition(3)
    found = {r["run_id"]: r for r in storage.manifest({"a": a, "b": b, "c": a.withColumn("x", F.col("x") + 1)}).collect()}
    assert found["a"]["fingerprint"] == found["b"]["fingerprint"] != found["c"]["fingerprint"] and found["a"]["rows"] == 30


def test_audit_takes_the_longest_prefix(spark):
    catalog = spark.createDataFrame([("q", "sampled"), ("quantity.x", "outcome"), ("quantity", "structural")], "prefix string, origin string")
    names = spark.createDataFrame([("quantity.x1",), ("quantity",), ("q.a",), ("zzz",), ("size",)], "feature string")
    got = {r["feature"]: (r["origin"], r["blocked"]) for r in relational.audited(names, catalog).collect()}
    assert got == {"quantity.x1": ("outcome", True), "quantity": ("structural", False), "q.a": ("sampled", False), "zzz": ("unknown", True), "size": ("unknown", False)}


def test_a_cluster_session_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, name, other):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session(), "x")
    assert math.isfinite(len(shared_path(spark, "x")))


def test_latent_codes_equal_svd(spark):
    from quarry.operators import latent

    a = np.random.default_rng(2).normal(size=(60, 3)) @ np.array([[3.0, 0.4, 0], [0, 1.5, 0.2], [0, 0, 0.4]])
    t = a[:, 1] * 2
    df = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(a, t, strict=True)], "a double, b double, c double, t double")
    coded, names = latent.with_codes(df, ["a", "b", "c"], 2)
    got = np.array([[r[n] for n in names] for r in coded.collect()])
    _, _, v = np.linalg.svd(a - a.mean(0), full_matrices=False)
    want = (a - a.mean(0)) @ v[:2].T
    assert np.allclose(np.sort(np.abs(got), axis=0), np.sort(np.abs(want), axis=0))
    pairs = {(r["latent"], r["descriptor"]): r["r"] for r in latent.correlated(coded, names, ["t"], 0.0).collect()}
    assert abs(abs(pairs[names[0], "t"]) - abs(np.corrcoef(want[:, 0], t)[0, 1])) < 1e-9
    best = latent.coordinates(df, ["a", "b", "c"], "t").first()
    rs = [abs(np.corrcoef((a - a.mean(0)) @ u, t)[0, 1]) for u in v]
    assert best["k"] == int(np.argmax(rs)) + 1 and abs(best["r"] - max(rs)) < 1e-9


def test_multi_ridge_equals_numpy(spark):
    from quarry.operators import latent

    x = np.random.default_rng(3).normal(size=(40, 2))
    y = np.stack([x @ [2.0, -1.0] + 3, x @ [0.5, 0.0]], axis=1)
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, y double, z double")
    got = {(r["target"], r["term"]): r["coefficient"] for r in latent.multi_ridge(df, ["a", "b"], ["y", "z"], 1e-9).collect()}
    assert abs(got["y", "a"] - 2) < 1e-6 and abs(got["y", "b"] + 1) < 1e-6 and abs(got["y", "intercept"] - 3) < 1e-6 and abs(got["z", "a"] - 0.5) < 1e-6


def test_random_features_equal_numpy(spark):
    from quarry.operators import latent

    x = np.random.default_rng(4).normal(size=(50, 3))
    t = x @ [1.0, 2.0, -1.0]
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, t, strict=True)], "a double, b double, c double, t double")
    got = latent.random_features(df, ["a", "b", "c"], "t", 2).first()
    w = np.random.default_rng(latent.SEED).normal(scale=0.5, size=(3, 2))
    h = np.hstack([np.ones((50, 1)), np.tanh((x - x.mean(0)) @ w)])
    decode = np.linalg.solve(h.T @ h + 1e-3 * np.eye(3), h.T @ x)
    assert got["hidden"] == 2 and abs(got["reconstruction_mse"] - ((x - h @ decode) ** 2).mean()) < 1e-9
    beta = np.linalg.solve(h.T @ h + 1e-3 * np.eye(3), h.T @ t)
    assert abs(got["target_r2"] - (1 - ((t - h @ beta) ** 2).sum() / ((t - t.mean()) ** 2).sum())) < 1e-9
    assert latent.random_features(df.limit(0), ["a"], "t").count() == 0


def test_a_circulant_operator_is_diagonal_in_the_fourier_basis(spark):
    from quarry.operators import latent

    n = 6
    u = np.stack([np.roll([0.5, 0.25, 0, 0, 0, 0.1], k) for k in range(n)])
    x = np.random.default_rng(5).normal(size=(30, n))
    df = spark.createDataFrame([(a.tolist(), (u @ a).tolist()) for a in x], "x array<double>, y array<double>")
    got = latent.diagonalising(df, "x", "y").collect()
    assert got[0]["encoding"] == "dft_full" and got[0]["off_diagonal"] < 1e-9 and got[0]["residual"] < 1e-9
    assert got[-1]["off_diagonal"] > 0.1 and latent.diagonalising(df.limit(3), "x", "y").count() == 0


def test_rediscovery_and_replication(spark):
    from quarry.operators import candidates
    from quarry.plans import expression as ex

    rows = [(i, 1, float(i % 13), DRAW.random(), 3.0 * (i % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, size int, x double, y double, target double")
    got = candidates.rediscovered(df, [ex.var("y"), ex.var("x"), ex.op("neg", ex.var("x"))], "k").collect()
    assert [(r["candidate"], r["wins"], r["frequency"]) for r in got] == [("x", 5, 1.0)]
    a = spark.createDataFrame([("x", 0.5, 0.25), ("y", 0.5, 0.25), ("z", None, None)], "candidate string, r double, r2 double")
    b = spark.createDataFrame([("x", 0.4, 0.16), ("y", -0.5, 0.25), ("w", 0.9, 0.81)], "candidate string, r double, r2 double")
    assert {r["candidate"]: r["holds"] for r in candidates.replicated(a, b, 0.3).collect()} == {"x": True, "y": False, "z": False, "w": False}


def test_closed_values_take_the_largest_set(spark):
    rows = [(1, x, 0) for x in (8, 9)] + [(1, x, 1) for x in (16, 17, 18, 19)] + [(1, x, 2) for x in (32, 33, 34)] + [(2, 5, 7)]
    got = recovery.closed_values(spark.createDataFrame(rows, "t long, x long, y long"), "t", "x", "y", 3).collect()
    assert [(r["t"], r["values"]) for r in got] == [(1, [0, 1, 2, 3])]


def test_recurrence_verdict(spark):
    schema = "identification_eligible boolean, estimated_order long, withheld_stable boolean"
    good = spark.createDataFrame([(True, 4, True), (True, 6, True), (False, 99, False)], schema)
    assert recovery.recurrence_verdict(good, 30).first()["met"] and not recovery.recurrence_verdict(good, 6).first()["met"]
    assert not recovery.recurrence_verdict(good.union(spark.createDataFrame([(True, 4, False)], schema)), 30).first()["met"]
    assert not recovery.recurrence_verdict(good.limit(0), 30).first()["met"]


def test_near_pairs_and_stored_arrays(spark, tmp_path):
    groups = spark.createDataFrame([(1, 3, 3), (1, 6, 3), (1, 5, 3)], "t long, x long, component long")
    assert sorted(r["value"] for r in recovery.near_pair_values(groups, "t", "x", "xor", 8).collect()) == [5, 6]
    run = storage.Run(spark, str(tmp_path / "arrays"))
    assert run.arrays().count() == 0
    arrays = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0])], "instance_id long, family_index int, values array<double>")
    run.save_arrays(arrays)
    rows = spark.createDataFrame([(1, 1), (1, 3)], "instance_id long, family_index int")
    assert {(r["family_index"], tuple(r["values"] or ())) for r in storage.with_arrays(rows, run.arrays()).collect()} == {(1, (1.0, 2.0)), (3, ())}
    wide = spark.createDataFrame([(1, 1, 4, "a", 1.0, 2)], "instance_id long, family_index int, size int, generator string, `metric.x` double, y int")
    assert storage.numeric_columns(wide) == ["metric.x", "y"] and storage.numeric_columns(wide, "metric.") == ["metric.x"]


def test_streams_keep_the_last_state(spark, tmp_path):
    from quarry.streaming.ingest import drained, feature_stream, windowed_counts

    rows = [("2020-01-01 00:00:10", "a", 1.0), ("2020-01-01 05:00:00", "a", 2.0), ("2020-01-02 00:00:00", "b", 4.0)]
    source = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(2):
        source.write.mode("append").parquet(str(tmp_path / "in"))
    stream = feature_stream(spark, str(tmp_path / "in"), source.schema)
    got = drained(windowed_counts(stream, "ts", "1 day", "1 day"), ["start", "event_type"], "test").collect()
    assert sorted((r["event_type"], r["n"], r["total"]) for r in got) == [("a", 4, 6.0), ("b", 2, 8.0)]
