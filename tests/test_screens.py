"""Permutations, skylines, screens, holdout searches, symmetries, commits: against loops, NumPy and fractions."""

import math
import os
import random
from fractions import Fraction
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import candidates, holdout, permutation, rank_correlation, recovery, registry, representation, screens, skyline, statistics, storage
from quarry.plans import expression as ex
from quarry.sources import steps

DRAW = random.Random(17)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_replicates_are_bijections_of_their_own(n):
    found = [permutation.permuted(np.arange(n), n, r).tolist() for r in range(1, 6)]
    assert all(sorted(p) == list(range(n)) for p in found)
    if n >= 10:
        assert len({tuple(p) for p in found}) == 5
        moved = np.array([permutation.permuted(np.arange(n), n, r) for r in range(1, 200)])
        assert abs(np.corrcoef(moved.mean(0), np.arange(n))[0, 1]) < 0.7  # no drift with the place


@pytest.mark.parametrize("chunk", [7, 1 << 14])
def test_permutation_max_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(permutation, "CHUNK", chunk)
    rows = [(i, DRAW.random() if i % 5 else None, float(i % 7), 3.0, DRAW.random() if i % 11 else float("nan")) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, y double, flat double, t double").repartition(4)
    got = permutation.permutation_max(df, ["x", "y", "flat"], "t", ["k"], 40).first()
    kept = [r for r in rows if r[4] == r[4]]
    t = np.array([r[4] for r in kept])

    def largest(t):
        out = 0.0
        for c in (1, 2):
            pairs = [(r[c], v) for r, v in zip(kept, t, strict=True) if r[c] is not None]
            out = max(out, abs(np.corrcoef(*zip(*pairs, strict=True))[0, 1]))
        return out

    null = []
    for r in range(1, 41):
        moved = np.empty(len(t))
        moved[permutation.permuted(np.arange(len(t)), len(t), r)] = t
        null.append(largest(moved))
    assert abs(got["observed"] - largest(t)) < 1e-9 and got["replicates"] == 40
    assert got["p_value"] == (sum(v >= largest(t) - 1e-12 for v in null) + 1) / 41
    none = permutation.permutation_max(df.where("k < 0"), ["x"], "t", ["k"], 5).first()
    assert (none["observed"], none["p_value"]) == (0.0, 1.0)


@pytest.mark.parametrize(("moved", "rows", "wide"), [(1, 9, 1 << 18), (300, 1 << 18, 40)])
def test_permutation_max_by_steps(spark, monkeypatch, moved, rows, wide):
    df = spark.range(700).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("x"), F.when(F.col("id") % 9 != 0, F.pmod(F.xxhash64("id", "id"), F.lit(99)) + 0.0).alias("t")).repartition(3)
    whole = permutation.permutation_max(df, ["x"], "t", ["id"], 30).first()
    for name, value in (("MOVED", moved), ("ROWS", rows), ("WIDE", wide), ("CHUNK", 32), ("LEAST", 4)):
        monkeypatch.setattr(permutation, name, value)
    steps = permutation.permutation_max(df, ["x"], "t", ["id"], 30).first()
    assert abs(steps["observed"] - whole["observed"]) < 1e-12 and tuple(steps)[1:] == tuple(whole)[1:]


def test_permutation_max_leaves_no_moved_targets(spark):
    files = lambda: {f: f.stat().st_size for d in Path(os.environ.get("SPARK_LOCAL_DIRS", "/tmp")).glob("blockmgr-*") for f in d.rglob("shuffle_*.data")}
    df, before = spark.range(20_000).select("id", F.rand(3).alias("x"), F.rand(5).alias("t")), files()
    found = permutation.permutation_max(df, ["x"], "t", ["id"], 60)
    assert found.first()["replicates"] == 60
    assert sum(size for f, size in files().items() if f not in before) < 20_000 * 60  # a byte for each; they take eight when they move


def undominated(points):
    return {p for p in points if not any(q != p and all(a <= b for a, b in zip(q, p, strict=True)) for q in points)}


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_skyline_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(skyline, "LEAF", 8)
    monkeypatch.setattr(skyline, "FILTER", 2)
    for spread in (4, 1000):
        points = [tuple(float(DRAW.randrange(spread)) for _ in range(dims)) for _ in range(160)] + [(float("inf"),) * dims]
        names = [f"a{i}" for i in range(dims)]
        df = spark.createDataFrame(points + points[:20], ", ".join(f"{n} double" for n in names)).withColumn("id", F.lit(1)).withColumn("leaf", F.lit("clash"))
        odd = spark.createDataFrame([(None, *[0.0] * (dims - 1)), (float("nan"), *[0.0] * (dims - 1))], ", ".join(f"{n} double" for n in names)).withColumn("id", F.lit(1)).withColumn("leaf", F.lit("odd"))
        got = skyline.frontier(df.union(odd).repartition(5), names)
        assert got.columns == df.columns
        best = undominated(set(points))
        assert sorted(tuple(r)[:dims] for r in got.collect()) == sorted(p for p in points + points[:20] if p in best)
    assert skyline.frontier(df.limit(0), names).count() == 0


def test_skyline_of_many_undominated_points(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("a"), (n - F.col("id")).alias("b"), (F.col("id") * 7919 % n).alias("c"))
    assert skyline.frontier(df, ["a", "b", "c"]).count() == n


def test_merged_top_equals_a_full_sort(spark):
    rows = [(DRAW.choice("ab"), f"x{DRAW.randrange(40)}", DRAW.randrange(6) / 6, DRAW.randrange(4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "source string, candidate string, r2 double, length int").repartition(13)
    order = {"k0": -F.col("r2"), "k1": F.col("length")}
    best = {}
    for s, c, r2, length in rows:
        best[s, c] = min(best.get((s, c), (0, 9)), (-r2, length))
    want = [(*k, -v[0], v[1]) for k, v in sorted(best.items(), key=lambda kv: (kv[1], kv[0]))]
    for most in (1, 7, 500):
        assert [tuple(r) for r in candidates.merged_top(df, ["source", "candidate"], order, most).collect()] == want[:most]
    assert candidates.merged_top(df.limit(0), ["source", "candidate"], order, 3).count() == 0


def test_moments_of_many_sizes_and_null_sizes(spark, monkeypatch):
    monkeypatch.setattr(candidates, "CELLS", 4)  # held moments go on early
    rows = [(None if i % 9 == 0 else i % 5, DRAW.random(), DRAW.random() if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "size int, x double, target double").repartition(6)
    got = {r["size"]: r for r in candidates.moments(df, [ex.var("x")], "target").collect()}
    for size in (None, 0, 1, 2, 3, 4):
        own = [(x, t) for s, x, t in rows if s == size]
        pairs = np.array([p for p in own if p[1] is not None])
        r = got[size]
        assert (r["seen"], r["n"]) == (len(own), len(pairs))
        d = pairs - pairs.mean(0)
        assert abs(r["xx"] - (d[:, 0] ** 2).sum()) < 1e-9 and abs(r["xy"] - (d[:, 0] * d[:, 1]).sum()) < 1e-9 and abs(r["my"] - pairs[:, 1].mean()) < 1e-12


def test_quantiles_equal_numpy(spark):
    rows = [(i % 3, DRAW.choice([0.5, 0.5, DRAW.random(), None, float("nan")])) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        for r in statistics.quantiles(df, ["g"], F.col("x"), q).collect():
            own = [x for g, x in rows if g == r["g"] and x is not None and x == x]
            assert r["n"] == len(own) and abs(r["quantile"] - np.quantile(own, q)) < 1e-12
    assert statistics.quantiles(df.limit(0), [], F.col("x"), 0.5).count() == 0


def average_ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_spearman_with_a_hot_value(spark):
    rows = [(7.0 if i % 3 == 0 else float(DRAW.randrange(30)), DRAW.random() * 10 // 1) for i in range(400)] + [(None, 1.0), (1.0, float("inf"))]
    r = statistics.spearman(spark.createDataFrame(rows, "x double, y double").repartition(5), "x", "y").first()
    whole = rows[:400]
    want = np.corrcoef(average_ranks([a for a, _ in whole]), average_ranks([b for _, b in whole]))[0, 1]
    assert r["n"] == 400 and abs(r["rho"] - want) < 1e-9
    flat = statistics.spearman(spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double"), "x", "y").first()
    assert flat["rho"] is None and flat["n"] == 5


@pytest.mark.parametrize("block", [1, 3, 16, 1 << 18])
def test_rank_correlations_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rank_correlation, "BLOCK", block)
    some = lambda v, k: None if DRAW.random() < 0.1 else float("nan") if k % 37 == 5 else v
    rows = []
    for k in range(300):
        t = 5.0 if k % 3 == 0 else some(float(DRAW.randrange(40)), k)  # a third of the rows have one target
        rows.append((t, some(float(DRAW.randrange(3)), k), some(DRAW.random(), k), some((t or 0.0) + DRAW.random(), k), 7.0, -0.0 if k % 2 else 0.0, float("inf"), 2.0 if k < 2 else None))
    names = ["few", "many", "near", "flat", "zero", "never", "two"]
    df = spark.createDataFrame(rows, "t double, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {r["column"]: (r["n"], r["rho"]) for r in rank_correlation.rank_correlations(df, names, "t").collect()}
    assert set(got) == set(names) - {"never"} and got["flat"][1] is None and got["zero"][1] is None and got["two"][1] is None
    for i, c in enumerate(names[:3], 1):
        x, t = zip(*[(r[i], r[0]) for r in rows if all(v is not None and v == v for v in (r[i], r[0]))], strict=True)
        assert got[c][0] == len(x) and abs(got[c][1] - np.corrcoef(average_ranks(x), average_ranks(t))[0, 1]) < 1e-9
    assert rank_correlation.rank_correlations(df.limit(0), names, "t").count() == 0


def test_rank_correlations_keep_no_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(steps, "shared_path", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    assert registry.queries()["rank_correlations"](spark, SF).count() == 5
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) < 4 * rows  # pairs of five columns were kept three times


def test_shuffles_of_a_released_step_go(spark):
    files = lambda: {f for d in Path(os.environ.get("SPARK_LOCAL_DIRS", "/tmp")).glob("blockmgr-*") for f in d.rglob("shuffle_*.data")}
    left, setting = [], spark.conf.get(steps.RELEASE)
    for release in (False, True):
        before = files()
        steps.written(spark.range(1000).repartition(7, "id"), "step", release)
        left.append(len(files() - before))
    assert left[0] and not left[1] and spark.conf.get(steps.RELEASE) == setting


@pytest.mark.parametrize(("t", "freedom", "p"), [(2.0, 10, 0.0733880), (0.5, 3, 1 - 2 / math.pi * (0.5 / 3**0.5 / (1 + 0.25 / 3) + math.atan(0.5 / 3**0.5))), (12.706205, 1, 0.05), (1.959964, 1e6, 0.0500001), (0.0, 5, 1.0), (40.0, 60, 0.0)])
def test_student_tail(spark, t, freedom, p):
    df = spark.createDataFrame([(t, float(freedom))], "t double, f double")
    assert abs(df.select(screens.student_p(F.col("t"), F.col("f"))).first()[0] - p) < 2e-6


def test_preregistered_check_decides_as_fixed(spark):
    rows = [(float(i % 4), i % 4 + DRAW.random() * 2, "identity" if i % 2 else "dct") for i in range(120)]
    df = spark.createDataFrame(rows, "s double, c double, w string")
    r = screens.preregistered_check(df, "s", "c", "w", "identity").first()
    assert r["detected"] and r["p"] < 1e-6 and r["trivial_wins"] == 0.5
    noise = df.withColumn("c", F.xxhash64("c", "w").cast("double"))
    assert not screens.preregistered_check(noise, "s", "c", "w", "identity").first()["detected"]


FAMILY = "family string, size int, rate double, target double, span double, rank double"


def test_screens_on_planted_families(spark):
    rows = []
    for size in (8, 16):
        rows += [("random", size, DRAW.random() * 0.1, 0.0, None, None) for _ in range(150)]
        rows += [("found", size, 0.5 + DRAW.random(), 1.0, 0.2, 2.0) for _ in range(50)]
        rows += [("held", size, 0.4 + DRAW.random(), 1.0, 0.4, 3.7) for _ in range(20)]
    rows += [("held", None, 9.0, 1.0, None, None), ("held", 8, None, 1.0, None, float("nan"))]
    df = spark.createDataFrame(rows, FAMILY).repartition(3)
    controls = [r[2] for r in rows if r[0] == "random"]
    one = screens.threshold_from_random(df, "rate", "family", ["random"]).first()
    assert abs(one["threshold"] - np.quantile(controls, 0.99)) < 1e-12 and one["n"] == 300
    got = screens.heldout_screen(df, "rate", "target", "family", "size", ["random", "found"], ["held"], ["random"]).collect()
    assert {r["size"] for r in got} == {8, 16} and all(r["passed"] and r["recall"] == 1 and r["n_held_out"] == 20 and r["fpr"] <= 0.05 for r in got)
    worse = df.where("NOT (family = 'held' AND size = 16)")
    assert not any(r["passed"] for r in screens.heldout_screen(worse, "rate", "target", "family", "size", ["random", "found"], ["held"], ["random"]).collect())
    assert screens.threshold_from_random(df.limit(0), "rate", "family", ["random"]).first()["threshold"] == 0.0
    shape = screens.pairing_shape(df, "rate", "span", "family", "size", "rank", ["random", "held"]).collect()
    by = {(r["by"], r["size"], r["family"] or r["rank"]): r for r in shape}
    assert set(by) == {("family", s, f) for s in (8, 16) for f in ("random", "held")} | {("rank", s, k) for s in (8, 16) for k in (2, 3)}
    assert by["family", 8, "held"]["n"] == 21 and by["family", 8, "held"]["n_collision"] == 20 and by["family", 8, "random"]["mean_span"] is None
    assert abs(by["rank", 16, 3]["mean_span"] - 0.4) < 1e-12 and by["rank", 16, 3]["hit"] == 1


def test_class_screen_takes_the_nearest_centre(spark):
    rows = [("a", 8, 0.0, 0.0), ("a", 8, 0.0, 2.0), ("b", 8, 4.0, 1.0), ("c", 8, 2.0, 9.0), ("ha", 8, 1.0, 1.0), ("hb", 8, 2.0, 1.0), ("hb", 8, 3.0, None), ("hc", 8, float("nan"), 9.0), ("ha", 16, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "family string, size int, x double, y double")
    got = {r["size"]: r for r in screens.class_screen(df, ["x", "y"], "family", "size", ["a", "b", "c"], {"ha": "a", "hb": "b", "hc": "c"}).collect()}
    # the second is as near to a as to b and goes to a
    assert (got[8]["n_held_out"], got[8]["correct"]) == (4, 3) and got[8]["recall"] == 0.75 and got[16]["recall"] is None and not got[8]["passed"]
    alone = screens.class_screen(df.where("size = 8"), ["x", "y"], "family", "size", ["a", "b", "c"], {"ha": "a", "hc": "c"}).first()
    assert alone["passed"] and alone["recall"] == 1


def test_conservation_under_given_groups(spark):
    n = 8
    circulant = [[float((j - i) % n * 3 % 7) for j in range(n)] for i in range(n)]
    broken = np.array(circulant) + np.random.default_rng(2).normal(size=(n, n))
    rows = [(np.array(circulant).ravel().tolist(),), (broken.ravel().tolist(),), ([0.0] * 9,), ([1.0, 2.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(2)

    def deviation(m, group):
        mean = sum(m[np.ix_(p, p)] for p in group) / len(group)
        return np.linalg.norm(m - mean) / (np.linalg.norm(m) or 1)

    got = {r["side"]: r for r in representation.conservation(df, "v").collect()}
    cyclic = representation.rotations(n)
    assert abs(got[8]["deviation"] - (deviation(np.array(circulant), cyclic) + deviation(broken, cyclic)) / 2) < 1e-12 and got[8]["elements"] == 8
    assert got[3]["deviation"] == 0 and got[3]["conserved"] and got[0]["n"] == 2 and got[0]["deviation"] is None
    exact = representation.conservation(spark.createDataFrame(rows[:1], "v array<double>"), "v", threshold=1e-12).first()
    assert exact["conserved"]
    small = spark.createDataFrame([(np.random.default_rng(3).normal(size=9).tolist(),)], "v array<double>")
    every = lambda k: [list(p) for p in permutations(range(k))]
    assert abs(representation.conservation(small, "v", every).first()["deviation"] - deviation(np.array(small.first()[0]).reshape(3, 3), every(3))) < 1e-12


def test_polynomials_through_nodes(spark):
    draw = np.random.default_rng(4)
    for n in (1, 2, 4, 8, 12, 20):
        x = draw.normal(size=(5, n))
        c, back, bound = representation.polynomial(x)
        for row, coefficients, values, bounds in zip(x, c, back, bound, strict=True):
            exact = [sum(Fraction(float(a)) * t**k for k, a in enumerate(coefficients)) for t in range(n)]
            assert all(abs(Fraction(float(v)) - e) <= abs(Fraction(float(b))) for v, e, b in zip(values, exact, bounds, strict=True))  # Horner's part
            assert all(abs(v - e) <= b for v, e, b in zip(values, row, bounds, strict=True))  # the bound holds for the whole way
    whole = [(v.tolist(),) for v in draw.normal(size=(20, 6))] + [(v.tolist(),) for v in draw.normal(size=(20, 40))] + [(None,), ([],), ([float("nan")],)]
    got = {r["length"]: r for r in representation.polynomial_roundtrip(spark.createDataFrame(whole, "v array<double>").repartition(3), "v").collect()}
    assert got[6]["verified"] and got[6]["ill_conditioned"] == 0 and got[6]["error"] < 1e-9
    assert got[40]["ill_conditioned"] == 20 and got[40]["n"] == 20
    cubic = spark.createDataFrame([([float(t**3 - 2 * t) for t in range(8)],)], "v array<double>")
    assert representation.polynomial_roundtrip(cubic, "v").first()["share"] == 2 / 8


def test_holdout_scores_survivors_only(spark):
    rows = [(i, i % 2 == 0, float(i), DRAW.random(), float(i) if i % 2 == 0 else DRAW.random(), float(i) + DRAW.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, train boolean, a double, b double, c double, target double")
    got = holdout.held_out_expressions(df, [ex.var("a"), ex.var("b"), ex.var("c")], F.col("train"), "target", 0.5).collect()
    assert [r["candidate"] for r in got] == ["a"] and got[0]["train_objective"] > 0.9  # b fails on train, c on holdout
    asked = []

    def verify(survivors, split):
        asked.append(None if survivors is None else sorted(r["candidate"] for r in survivors.collect()))
        scores = [("p", True, 3.0), ("q", False, 1.0), ("r", True, 2.0)] if split == "train" else [("p", True, 5.0), ("r", True, 5.0)]
        return spark.createDataFrame(scores, "candidate string, ok boolean, objective double")

    assert [tuple(r) for r in holdout.search_with_holdout(verify).collect()] == [("p", 3.0, 5.0), ("r", 2.0, 5.0)] and asked == [None, ["p", "r"]]
    assert holdout.held_out_expressions(df, [ex.var("b")], F.col("train"), "target", 0.9).count() == 0


def test_recovery_chains_share_prefixes_and_survive(spark):
    secrets = {t: 8 * DRAW.randrange(1, 7) + DRAW.randrange(8) for t in range(12)}
    points = []
    for t, s in secrets.items():
        for k in range(14):  # pairs that differ by the secret under xor
            x = DRAW.randrange(64)
            points += [(t, x, 100 + k), (t, x ^ s, 100 + k)]
    tape = spark.createDataFrame(sorted(set(points)), "t long, x long, y long")
    planted = spark.createDataFrame([(t, str(s)) for t, s in secrets.items()], "t long, secret string")
    found = holdout.search_recovery_chains(tape, planted, "t", "x", "y", F.col("t") % 2 == 0, 64, 6, 2, 0.8).collect()
    names = {r["candidate"]: r for r in found}
    assert "xor_mode_id" in names and all(r["discovery_recall"] >= 0.8 and r["confirmatory_recall"] >= 0.8 for r in found)
    chains = holdout.recovery_chains(tape, "t", "x", "y", 64, 6)
    one = {(r["t"], r["candidate"]): r["value"] for r in chains.where("depth = 1").collect()}
    values = recovery.pair_values(tape, "t", "x", "y", "xor", 64)
    direct = {r["t"]: r["value"] for r in recovery.program(values, "t", "mode", "high_half", 6).collect()}
    assert all(one[t, "xor_mode_high_half"] == str(v) for t, v in direct.items())
    kept = spark.createDataFrame([("pair[xor_mode_id|sum_gcd_id]",), ("diff_gcd_low_3",)], "candidate string")
    some = holdout.recovery_chains(tape, "t", "x", "y", 64, 6, 2, kept).collect()
    assert {r["candidate"] for r in some} == {"pair[xor_mode_id|sum_gcd_id]", "diff_gcd_low_3"} and len(some) == 24


def test_recovery_chains_send_no_row_for_each_chain(spark):
    rows = [(t, x, x % 2) for t in range(1200) for x in (t % 32, t % 32 + 2, t % 32 + 8)]
    tape = spark.createDataFrame(rows, "t long, x long, y long")
    planted = spark.createDataFrame([(t, "2" if t % 10 else "-") for t in range(1200)], "t long, secret string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")  # 600 instances of a side with 216 chains hold more
    try:
        found = holdout.search_recovery_chains(tape, planted, "t", "x", "y", F.col("t") % 2 == 0, 64, 6, 2, 0.75).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    recalls = {r["candidate"]: (round(r["discovery_recall"], 6), r["confirmatory_recall"]) for r in found}
    assert recalls["diff_mode_id"] == recalls["diff_gcd_low_3"] == (0.8, 1.0)


def test_feature_choice_equals_a_greedy_loop(spark):
    for _ in range(3):
        names = ["a", "b", "c", "d", "e"]
        rows = []
        for i in range(80):
            t = DRAW.random() if i % 13 else None
            rows.append((t, *[None if DRAW.random() < 0.45 else (t or 0) * (k + 1) + DRAW.random() * k for k in range(5)]))
        df = spark.createDataFrame(rows, "target double, a double, b double, c double, d double, e double").repartition(3)
        got = [(r["column"], r["joint"]) for r in holdout.select_features(df, "target", names, 3).collect()]
        finite = {n: [r[0] is not None and r[k + 1] is not None for r in rows] for k, n in enumerate(names)}
        strength = {}
        for k, n in enumerate(names):
            x = np.array([(r[k + 1], r[0]) for r, f in zip(rows, finite[n], strict=True) if f])
            strength[n] = abs(np.corrcoef(x.T)[0, 1])
        joint, want = [r[0] is not None for r in rows], []
        for n in sorted([n for n in names if sum(finite[n]) >= 10], key=lambda n: -strength[n]):
            both = [a and b for a, b in zip(joint, finite[n], strict=True)]
            if sum(both) >= 10 and len(want) < 3:
                joint = both
                want.append((n, sum(both)))
        assert got == want
    assert holdout.select_features(df.limit(0), "target", names, 3).count() == 0


def test_inverses_by_expression(spark):
    for modulus in (2, 9, 10, 61, 64, 2**31 - 1):
        df = spark.createDataFrame([(x,) for x in [*range(-5, 70), modulus - 1, modulus + 3]], "x long")
        for r in df.select("x", recovery.inverse(F.col("x"), modulus).alias("i")).collect():
            assert r["i"] == (pow(r["x"], -1, modulus) if math.gcd(r["x"], modulus) == 1 else None)


def test_points_of_one_label_make_no_pairs(spark):
    tape = spark.range(20_000).select(F.lit(1).cast("long").alias("t"), F.col("id").alias("x"), F.lit(5).cast("long").alias("y"))
    got = recovery.near_groups(tape, "t", "x", "y", 1, 8)
    assert got.count() == 20_000 and [tuple(r) for r in got.select("component").distinct().collect()] == [(0,)]


ROWS = "instance_id long, family_index int, size int, generator string, x double"


@pytest.mark.parametrize("stop", range(6))
def test_a_stop_between_steps_loses_and_adds_nothing(spark, tmp_path, stop):
    """Each call that changes the store raises once, before or after its effect; then the job runs again."""
    path = str(tmp_path / "run")
    first = spark.createDataFrame([(1, 1, 4, "a", 1.0), (1, 2, 4, "a", 2.0)], ROWS)
    more = spark.createDataFrame([(1, 2, 4, "a", 9.0), (2, 1, 4, "a", 3.0)], ROWS)
    calls = {"n": 0}

    class Stops(storage.Run):
        def maybe(self, act, *args):
            calls["n"] += 1
            if calls["n"] == stop // 2 + 1 and stop % 2 == 0:
                raise KeyboardInterrupt
            out = act(*args)
            if calls["n"] == stop // 2 + 1 and stop % 2 == 1:
                raise KeyboardInterrupt
            return out

        def moved(self, staged, name):
            return self.maybe(super().moved, staged, name)

    def job(run):
        run.append(first, key="first")
        run.seal()
        run.append(more, key="more")

    try:
        job(Stops(spark, path))
    except KeyboardInterrupt:
        pass
    run = storage.Run(spark, path)
    before = run.features()
    held = set() if before is None else {tuple(r) for r in before.collect()}
    assert held in (set(), {tuple(r) for r in first.collect()}) or held == {(1, 1, 4, "a", 1.0), (1, 2, 4, "a", 2.0), (2, 1, 4, "a", 3.0)}
    for _ in range(2):
        job(run)
        assert sorted(tuple(r) for r in run.features().collect()) == [(1, 1, 4, "a", 1.0), (1, 2, 4, "a", 2.0), (2, 1, 4, "a", 3.0)]
    run.seal()
    run.vacuum()
    assert sorted(r["x"] for r in run.features().collect()) == [1.0, 2.0, 3.0] and run.names("log") == [] and run.names("staging") == []
    job(run)
    assert run.features().count() == 3 and run.names("log") == []


def test_rows_never_lack_their_arrays(spark, tmp_path):
    run = storage.Run(spark, str(tmp_path / "run"))
    rows = spark.createDataFrame([(1, 1, 4, "a", 1.0)], ROWS)
    arrays = spark.createDataFrame([(1, 1, [1.0, 2.0])], "instance_id long, family_index int, values array<double>")
    for _ in range(2):
        run.persist(rows, arrays, "one")
    assert run.features().count() == 1 and run.arrays().count() == 1
    run.reset()
    assert run.features() is None and run.arrays().count() == 0


def test_typed_parts_check_columns_and_keys(spark, tmp_path):
    run = storage.Run(spark, str(tmp_path / "run"))
    assert run.get("instances").count() == 0
    schema = "instance_id string, domain_id string, size int, seed long, params map<string,double>"
    rows = spark.createDataFrame([("a", "tsp", 4, 1, {"x": 1.0}), ("a", "tsp", 4, 1, {"x": 1.0}), ("b", "tsp", None, 2, None)], schema)
    for _ in range(2):
        run.put("instances", rows, "one")
    run.put("instances", spark.createDataFrame([("a", "late", 9, 9, None)], schema), "two")
    got = {r["instance_id"]: (r["domain_id"], r["size"], r["params"]) for r in run.get("instances").collect()}
    assert got == {"a": ("tsp", 4, {"x": 1.0}), "b": ("tsp", None, None)}
    with pytest.raises(TypeError, match="size: bigint, not int; seed: missing"):
        run.put("instances", rows.withColumn("size", F.lit(1).cast("long")).drop("seed"))
    with pytest.raises(Exception, match="reports without representation"):
        run.put("reports", spark.createDataFrame([("a", None, 1.0, "verified")], "instance_id string, representation string, complexity double, status string"), "bad")
    assert run.get("reports").count() == 0 and run.names("reports") == []
