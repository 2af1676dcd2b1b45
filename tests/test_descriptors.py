"""Array descriptors and candidates against plain loops and known cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import array_queries, candidates, descriptors, matrices, models, representation, skyline
from quarry.plans import expression as ex

DRAW = np.random.default_rng(7)


def test_odd_arrays_have_nulls(spark):
    rows = [(0, None), (1, []), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [0.0] * 4), (5, [5.0]), (6, [1.0, 2.0, 3.0, 4.0]), (6, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(2)
    for stacked, names in [
        (descriptors.stats, descriptors.STATS), (descriptors.spectral, descriptors.SPECTRAL), (descriptors.walsh_shape, descriptors.WALSH),
        (descriptors.landscape, descriptors.LANDSCAPE), (descriptors.entries, descriptors.ENTRIES), (descriptors.spectrum, descriptors.SPECTRUM),
        (descriptors.graph, descriptors.GRAPH), (descriptors.boolean, descriptors.BOOLEAN), (descriptors.templates, descriptors.template_names()),
    ]:
        found = descriptors.described(df, "v", ["k"], stacked, names).collect()
        assert len(found) == len(rows)
        by_key = {r["k"]: r for r in found}
        assert all(v is None for k in (0, 1, 2, 3) for v in by_key[k][1:])
        assert all(v is None or math.isfinite(v) for r in found for v in r[1:])
    assert descriptors.described(df.limit(0), "v", ["k"], descriptors.stats, descriptors.STATS).count() == 0


def test_histogram_entropy_and_stats():
    x = np.array([[1.0] * 10, list(range(10))])
    assert np.allclose(descriptors.histogram_entropy(x), [0, math.log(10)])
    s = descriptors.stats(np.array([[0.0, 1, 2, 3]]))
    assert s["mean"][0] == 1.5 and s["min"][0] == 0 and s["max"][0] == 3 and s["median"][0] == 1.5 and abs(s["participation_ratio"][0] - 36 / 14) < 1e-12


def test_walsh_is_its_own_inverse_and_equals_the_sum():
    x = DRAW.normal(size=(5, 32))
    assert np.allclose(descriptors.walsh(descriptors.walsh(x)), x)
    h = np.array([[(-1) ** bin(i & k).count("1") for i in range(32)] for k in range(32)]) / 32**0.5
    assert np.allclose(descriptors.walsh(x), x @ h.T)
    assert descriptors.walsh_shape(np.ones((1, 3)))["valid_length"][0] == 0


def test_boolean_degree_against_enumeration():
    for table in itertools.islice(itertools.product([0, 1], repeat=8), 0, 256, 7):
        terms = [m for m in range(8) if sum(table[j] for j in range(8) if j & m == j) % 2]
        got = descriptors.boolean(np.array([table], dtype=float))
        assert got["algebraic_degree"][0] == max((bin(m).count("1") for m in terms), default=0)


def test_gf2_rank_against_span():
    draw = random.Random(3)
    for _ in range(30):
        rows = [draw.randrange(32) for _ in range(5)]
        span = {0}
        for r in rows:
            span |= {s ^ r for s in span}
        assert 2 ** descriptors.gf2_rank(np.array([rows]))[0] == len(span)


def test_graph_of_known_shapes():
    def matrix(edges, n=4):
        m = np.zeros((n, n))
        for a, b in edges:
            m[a, b] = m[b, a] = 1
        return m.ravel()

    path, ring, star, apart = [(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (2, 3), (3, 0)], [(0, 1), (0, 2), (0, 3)], [(0, 1)]
    full = list(itertools.combinations(range(4), 2))
    g = descriptors.graph(np.stack([matrix(e) for e in (path, ring, star, apart, full)]))
    assert g["n_edges"].tolist() == [3, 4, 3, 1, 6] and g["cycle_count"].tolist() == [0, 1, 0, 0, 3]
    assert g["diameter"][:3].tolist() == [3, 2, 2] and math.isnan(g["diameter"][3]) and g["diameter"][4] == 1
    assert g["degeneracy"].tolist() == [1, 2, 1, 1, 3] and g["clustering"].tolist() == [0, 0, 0, 0, 1]
    assert np.allclose(g["avg_shortest_path"][:3], [10 / 6, 8 / 6, 9 / 6]) and np.allclose(g["laplacian_max"][[2, 4]], [4, 4])
    assert math.isnan(g["assortativity"][1]) and abs(g["assortativity"][2] + 1) < 1e-12


def test_slice_rank_and_matrix_values():
    low = np.outer(DRAW.normal(size=4), DRAW.normal(size=4)).ravel()[None]
    assert descriptors.slice_rank(low)[0] == 1 and descriptors.slice_rank(np.eye(4).ravel()[None])[0] == 4
    m = DRAW.normal(size=(3, 4, 4))
    e, s = descriptors.entries(m.reshape(3, 16)), descriptors.spectrum(m.reshape(3, 16))
    for i in range(3):
        assert np.isclose(e["trace_power_3"][i], np.trace(np.linalg.matrix_power(m[i], 3)))
        assert np.isclose(s["nuclear"][i], np.linalg.svd(m[i], compute_uv=False).sum())
        assert np.isclose(s["spectral_radius"][i], np.abs(np.linalg.eigvalsh((m[i] + m[i].T) / 2)).max())


def test_templates_equal_numpy():
    x = DRAW.normal(size=(3, 40))
    t = descriptors.templates(x)
    assert np.isclose(t["autocorr_7"][1], np.corrcoef(x[1, :-7], x[1, 7:])[0, 1]) and np.isclose(t["quantile_35"][2], np.quantile(x[2], 0.35))
    assert "walsh_band_0" not in t and len(descriptors.template_names()) == 76


def test_recurrence_of_a_wave(spark):
    wave = [(1, r, [math.cos(0.3 * (r + 2 * i)) for i in range(8)]) for r in range(14)]
    noise = [(2, r, DRAW.normal(size=8).tolist()) for r in range(14)] + [(3, 0, [1.0] * 8)]
    df = spark.createDataFrame(wave + noise, "instance_id long, r long, v array<double>")
    found = {r["instance_id"]: r for r in array_queries.recurrence(df, 2).collect()}
    assert found.keys() == {1, 2} and found[1]["estimated_order"] == 2 and found[1]["krylov_rank"] == 2 and found[1]["withheld_stable"]
    assert found[2]["krylov_rank"] == 8 and found[2]["identification_eligible"]


def test_metrics_of_a_delta(spark):
    df = spark.createDataFrame([(1, [0.0, 3.0, 0.0, 0.0]), (2, [])], "k int, v array<double>")
    m = {r["k"]: r for r in array_queries.metrics(df, "v", ["k"]).collect()}
    assert m[1]["max_amplitude"] == 3 and abs(m[1]["log_max_amplitude"] - math.log2(3)) < 1e-12 and m[1]["peak_probability_mass"] == 9
    assert abs(m[1]["spectral_concentration"] - 0.5) < 1e-12 and m[2]["max_amplitude"] is None and m[2]["compressibility_ratio"] is None


def test_codecs_are_stable():
    assert matrices.of_codecs([1.0, 2.0, 3.0]) == matrices.of_codecs([1.0, 2.0, 3.0]) and matrices.of_codecs([])[0] == 0


TREES = [ex.var("a"), *ex.chains(["a", "b"]), *ex.ratios(["a", "b"]), *ex.products(["a", "b"]), ex.op("exp", ex.op("exp", ex.var("a"))), ex.op("pow", ex.var("b"), ex.const(0.5))]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(int(s), float(a), float(b), float(3 * a + b)) for s in (2, 4, 6, 8) for a, b in DRAW.normal(size=(12, 2))]
    rows += [(2, None, 1.0, 1.0), (4, 1.0, float("nan"), 2.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "size int, a double, b double, target double").repartition(5)
    return rows, {r["candidate"]: r for r in candidates.scored(df, TREES).collect()}


def test_scores_equal_numpy(scored):
    rows, found = scored
    assert len(found) == len(set(map(str, TREES)))
    size = np.array([np.nan if r[0] is None else r[0] for r in rows])
    columns = {c: np.array([np.nan if r[i] is None else r[i] for r in rows]) for c, i in (("a", 1), ("b", 2))}
    y = np.array([r[3] for r in rows])
    for tree in TREES:
        x, r = ex.evaluated(tree, columns), found[str(tree)]
        good = np.isfinite(x) & np.isfinite(y)
        assert r["n"] == good.sum()
        if (np.abs(x[good]) >= 1e100).any() or np.std(x[good]) == 0:
            assert r["r"] is None
            continue
        assert abs(r["r"] - np.corrcoef(x[good], y[good])[0, 1]) < 1e-9
        signs = []
        for s in (2, 4, 6, 8):
            w = good & (size == s)
            if w.sum() >= 3 and np.std(x[w]) > 0:
                signs.append(np.sign(np.corrcoef(x[w], y[w])[0, 1]) == np.sign(r["r"]))
        assert r["stability"] is None if len(signs) < 2 else abs(r["stability"] - np.mean(signs)) < 1e-12
        train, test = size <= 4, size > 4
        if good[train].all() and good[test].all():
            k, b = np.polyfit(x[train], y[train], 1)
            want = 1 - ((y[test] - k * x[test] - b) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum()
            assert abs(r["extrapolation"] - want) < 1e-6 * max(1, abs(want))
        else:
            assert r["extrapolation"] is None


def test_compiled_equals_evaluated(spark):
    rows = [(0.0, 2.0), (-3.0, 0.5), (1e-13, -1.0), (800.0, 1e-13), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    columns = {"a": np.array([np.nan if r[0] is None else r[0] for r in rows]), "b": np.array([r[1] for r in rows])}
    trees = list(ex.trees(["a", "b"], 2, 300))
    got = df.select(*[ex.compiled(t).alias(f"c{i}") for i, t in enumerate(trees)]).collect()
    for i, tree in enumerate(trees):
        want = ex.evaluated(tree, columns)
        for row, w in zip(got, want, strict=True):
            assert (row[i] is None and not np.isfinite(w)) or math.isclose(row[i], w, rel_tol=1e-12), str(tree)


def test_ranking_key(spark):
    rows = [("a", 3, 9, 0.9, 0.81, 1.0, 0.5), ("b", 1, 9, 0.9, 0.81, 1.0, 0.5), ("c", 1, 9, 0.99, 0.98, None, None), ("d", 1, 9, -0.5, 0.25, 0.5, 1.7), ("e", 1, 9, 0.1, 0.01, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "candidate string, length int, n long, r double, r2 double, stability double, extrapolation double")
    assert [r["candidate"] for r in candidates.ranked(df, 3, 0.2).collect()] == ["d", "b", "a"]


@pytest.mark.parametrize("text", ["(x ** 2)", "-a * b + c / 2", "log((a + b))", "2 ** 3 ** 2", "(-x) ** 2", "sqrt(abs(x)) - 1e-3", "metric.trace / (size - 1)"])
def test_infix_round_trip(text):
    tree = ex.from_infix(text)
    assert ex.from_infix(ex.infix(tree)) == tree and ex.parsed(str(tree)) == tree


@pytest.mark.parametrize("text", ["", "(a", "a)", "a b", "a +", "* a", "a $ b"])
def test_infix_errors(text):
    with pytest.raises(ValueError):
        ex.from_infix(text)


def test_forms_and_counts():
    assert ex.canonical_text("X ** 2 + 0.0") == "x^2" and ex.canonical_text(" ") == "empty" and ex.canonical_text("a + 0.5") == "a+0.5"
    assert len(ex.ratios(["a", "b", "c"])) == 6 and len(ex.products(["a", "b", "c"])) == 6 and len(list(ex.trees(["a", "b"], 2, 50))) == 50
    deep = ex.var("x")
    for _ in range(5000):
        deep = ex.op("neg", deep)
    assert deep.size() == 5001 and deep.depth() == 5001 and ex.evaluated(deep, {"x": np.array([2.0])})[0] == 2


def test_encodings_are_undone():
    for n in (1, 2, 7, 12, 16):
        x = DRAW.normal(size=(6, n))
        for chain in representation.chains(3):
            assert representation.encoded(x, chain)[2].max() < 1e-9


def test_frontier_equals_brute_force(spark):
    draw = random.Random(9)
    points = [(i, draw.randrange(6), draw.randrange(6), draw.randrange(6)) for i in range(150)] + [(999, None, 0, 0)]
    df = spark.createDataFrame(points, "i int, x int, y int, z int").repartition(4)
    whole = [p for p in points if None not in p]
    want = {a[0] for a in whole if not any(all(q <= p for p, q in zip(a[1:], b[1:], strict=True)) and b[1:] != a[1:] for b in whole)}
    assert {r["i"] for r in skyline.frontier(df, ["x", "y", "z"]).collect()} == want


def test_linear_map_and_pursuit(spark):
    u = DRAW.normal(size=(4, 4))
    x = DRAW.normal(size=(80, 4))
    df = spark.createDataFrame([(a.tolist(), (a @ u).tolist()) for a in x], "x array<double>, y array<double>")
    got = models.linear_map(df, "x", "y", 1e-9).first()
    assert got["n"] == 80 and got["map_rank"] == 4 and got["residual"] < 1e-9 and abs(got["map_norm"] - np.linalg.norm(u)) < 1e-6
    w = DRAW.normal(size=(60, 8))
    h = np.array([[(-1) ** bin(i & k).count("1") for i in range(8)] for k in range(8)]) / 8**0.5
    rows = [(v.tolist(), float(2 * (v @ h[3]) - 5 * (v @ h[6]) + 1)) for v in w]
    found = models.matching_pursuit(spark.createDataFrame(rows, "v array<double>, t double"), "v", "t", 2).collect()
    assert {r["place"] for r in found} == {3, 6} and found[0]["place"] == 6 and abs(found[1]["r2"] - 1) < 1e-9


def test_principal_codes_equal_numpy(spark):
    a = DRAW.normal(size=(50, 3)) @ np.array([[2.0, 0, 0], [1, 1, 0], [0, 0, 0.3]])
    t = a[:, 0] + DRAW.normal(size=50)
    df = spark.createDataFrame([(*map(float, r), float(y)) for r, y in zip(a, t, strict=True)], "a double, b double, c double, t double")
    got = models.principal_codes(df, ["a", "b", "c"], 2, "t").collect()
    centred = a - a.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    for k, r in enumerate(got):
        assert abs(r["explained"] - s[k] ** 2 / (s**2).sum()) < 1e-9
        assert abs(abs(r["target_r"]) - abs(np.corrcoef(centred @ v[k], t)[0, 1])) < 1e-9
        assert abs(r["reconstruction_mse"] - (s[k + 1 :] ** 2).sum() / a.size) < 1e-9


def test_structure_of_rank_one_matrices(spark):
    rows = [(np.outer(DRAW.normal(size=4), DRAW.normal(size=4)).ravel().tolist(),) for _ in range(10)] + [(None,), ([1.0, 2.0],)]
    rows += [([2.0],)] * 3 + [(DRAW.normal(size=9).tolist(),)]  # other sides have rows of their own
    got = {r["side"]: r for r in representation.structure(spark.createDataFrame(rows, "v array<double>").repartition(3), "v").collect()}
    assert {k: r["n"] for k, r in got.items()} == {0: 1, 1: 3, 3: 1, 4: 10} and got[0]["low_rank"] is None
    assert got[4]["effective_rank"] == 1 and got[4]["separable"] and got[4]["low_rank"] and got[1]["low_rank"]
    even = representation.structure(spark.createDataFrame([([1.0] * 16,)], "v array<double>"), "v").first()
    assert even["dual"]


def test_cost_of_unknown_stage(spark):
    df = spark.createDataFrame([("difference+dft", 8.0)], "s string, n double")
    assert df.select(representation.computational_cost(F.col("s"), F.col("n"))).first()[0] == 32
    with pytest.raises(Exception, match="unknown stage"):
        df.select(representation.computational_cost(F.lit("dct+magic"), F.col("n"))).collect()
