"""Closed-form and brute-force checks of single operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.functions import kernels as kn
from wellspring.operators import labels as lb
from wellspring.operators import metrics as mt
from wellspring.operators import onset as on
from wellspring.operators import quality as ql
from wellspring.operators import ranking as rk
from wellspring.operators import rules as rl
from wellspring.operators import spatial as sp
from wellspring.operators import splits as st

T450 = np.arange(450) / 15.0


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, values, col):
    """Evaluate a Column builder on one array column ``p``."""
    return frame(spark, [([float(v) for v in values],)], "p array<double>").select(col.alias("r")).first()["r"]


# --- order statistics ---------------------------------------------------------------------
@pytest.mark.parametrize("limit", [5, 10**6])
def test_quantiles_with_a_hot_group_of_ties(spark, limit):
    rng = np.random.default_rng(0)
    hot = [("hot", float(v)) for v in np.r_[np.full(300, 7.0), rng.normal(size=301)]]
    rows = hot + [("b", float(i)) for i in range(4)] + [(None, 1.0), (None, 3.0), ("b", None)]
    got = {r[0]: r for r in rk.quantiles(frame(spark, rows, "k string, v double"), ["k"], "v", {"a": 0.05, "m": 0.5}, limit).collect()}
    v = np.array([x for _, x in hot])
    assert got["hot"]["a"] == pytest.approx(np.percentile(v, 5)) and got["hot"]["m"] == pytest.approx(np.median(v))
    assert got["b"]["m"] == 1.5 and got["b"]["n"] == 4 and got[None]["m"] == 2.0


@pytest.mark.parametrize("limit", [7, 10**6])
def test_row_index_is_dense(spark, limit):
    rows = [("hot", i) for i in range(200)] + [("x", i) for i in range(5)]
    got = rk.row_index(frame(spark, rows, "k string, o long"), ["k"], ["o"], "i", limit).collect()
    assert len(got) == 205 and all(r["o"] == r["i"] for r in got)


def test_quantiles_are_bit_equal_on_both_routes(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, [("k", float(v)) for v in rng.normal(size=700)] + [("k", float("inf"))] * 2, "k string, v double").cache()
    probs = {f"q{i}": i / 100 for i in range(0, 101, 3)}
    assert rk.quantiles(df, ["k"], "v", probs, 90).first() == rk.quantiles(df, ["k"], "v", probs, 10**6).first()


def test_median_mad_of_constant(spark):
    got = rk.median_mad(frame(spark, [(1, 2.0)] * 3, "k int, v double"), ["k"], "v").first()
    assert (got["med"], got["mad"], got["n"]) == (2.0, 0.0, 3)


# --- neighbours, smoothing and layers --------------------------------------------------------
def pixels(spark, pts, extra=()):
    rows = [("c", 0, i, int(r), int(c), False, 0, [float(i), float(i % 3), float(r - c)]) for i, (r, c) in enumerate(pts)]
    return frame(spark, rows + list(extra), "chip_id string, well_id int, pixel_id long, prow int, pcol int, is_ntc boolean, y int, x array<double>")


CLUSTERED = [(r, c) for r in range(6) for c in range(6)] + [(500, 500), (3000, 2), (900, 901), (1, 1), (1, 1)]


@pytest.mark.parametrize("fan", [1, 9, 10**6])
def test_nearest_matches_brute_force(spark, fan):
    """Dense block, far outliers and pixels sharing a position, for several starting cell sizes."""
    pts = CLUSTERED
    got = {}
    for r in sp.nearest(pixels(spark, pts), 4, fan=fan).collect():
        got.setdefault(r["pixel_id"], {})[r["nrank"]] = r["nbr"]
    for i, (a, b) in enumerate(pts):
        want = sorted(((a - p) ** 2 + (b - q) ** 2, p, q, j) for j, (p, q) in enumerate(pts) if j != i)[:4]
        assert [got[i][n] for n in (1, 2, 3, 4)] == [w[3] for w in want], i


def test_nearest_in_a_tiny_well(spark):
    assert sp.nearest(pixels(spark, [(0, 0), (5, 5)]), 8).count() == 2
    assert sp.nearest(pixels(spark, [(0, 0)]), 8).count() == 0


@pytest.mark.parametrize("order,tile", [(1, 16), (3, 4), (0, 16)])
def test_box_smooth_matches_brute_force(spark, order, tile):
    pts = CLUSTERED + [(-1, 0), (0, -2)]
    df = pixels(spark, pts)
    x = {r["pixel_id"]: np.array(r["x"]) for r in df.collect()}
    got = {r["pixel_id"]: r["x"] for r in sp.box_smooth(df, order, tile=tile).collect()}
    for i, (a, b) in enumerate(pts):
        near = [j for j, (p, q) in enumerate(pts) if max(abs(a - p), abs(b - q)) <= order] if order else [i]
        assert np.allclose(got[i], np.mean([x[j] for j in near], axis=0))


def test_wells_with_too_few_pixels_are_left_alone(spark):
    flags = ql.layer_c(pixels(spark, [(0, 0), (0, 1), (0, 2)]).withColumn("a", F.lit(True)).withColumn("b", F.lit(False)), 8)
    assert {(r["bad_count"], r["c"]) for r in flags.collect()} == {(-1, False)}


def test_filter_drops_a_dead_pixel_and_skips_chips_without_controls(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(64):
        ntc = i < 32
        gain = 0.0 if i == 40 else 1.0 + 0.05 * rng.normal()
        rows.append(("c", 0 if ntc else 1, i, (i % 32) // 8, i % 8, ntc, int(not ntc), [gain * v for v in (0.0, 0.5, 1.0)]))
    rows.append(("lonely", 1, 99, 0, 0, False, 1, [0.0, 0.5, 1.0]))
    df = pixels(spark, [], rows)
    got = {r["pixel_id"]: r for r in ql.chip_filter(df, "ABCD", "mad", 3.0).collect()}
    assert got[40]["a"] and not got[40]["keep"] and 99 not in got and len(got) == 64
    assert {r["pixel_id"] for r in ql.kept_traces(df, ql.chip_filter(df, "A", "mad", 3.0)).collect()} == set(range(64)) - {40}


# --- rules ------------------------------------------------------------------------------------
def test_window_rules_on_short_scores(spark):
    p = F.col("p")
    assert one(spark, [0.1, 0.4, 0.6, 0.7], rl.first_above(p, 5, 5, 0.5, 2)) == pytest.approx(12 / 15)
    assert one(spark, [0.1, 0.2, 0.3, 0.4], rl.first_above(p, 5, 5, 0.5, 2)) == pytest.approx(17 / 15)
    assert one(spark, [5.0, 3.0, -0.5, -2.0], rl.nearest_zero(p, 5, 5)) == pytest.approx(12 / 15)
    assert one(spark, [0.9, 0.1], rl.linear_crossing(p, 5, 5)) == pytest.approx(2 / 15)


def test_window_count(spark):
    assert one(spark, np.zeros(450), F.size(ar.windows("p", 60, 5))) == 79
    assert one(spark, np.arange(20), F.size(ar.windows("p", 5, 5))) == 4


def test_density_rules(spark):
    spike = np.zeros(450)
    spike[150] = 1.0
    for rule in rl.DENSITY_RULES.values():
        assert one(spark, spike, rule("p")) == pytest.approx(10.0, abs=1e-6)
    spike[90] = 1.0
    assert one(spark, spike, rl.density_mean("p")) == pytest.approx(8.0, abs=1e-6)


def test_class_rules(spark):
    seq = [0, 2, 0, 0, 0, 2, 2, 2, 2, 2, 0, 0, 2, 2, 3]
    assert one(spark, seq, rl.largest_block("p")) == pytest.approx(5 / 15)
    assert one(spark, seq, rl.class_run("p", (2,), 3)) == pytest.approx(5 / 15)
    assert one(spark, [0] * 15, rl.class_run("p", (2,), 3)) == pytest.approx(14 / 15)


@pytest.mark.parametrize("step_only", [False, True])
def test_ordered_decode_matches_enumeration(spark, step_only):
    rng = np.random.default_rng(3)
    for _ in range(4):
        probs = rng.dirichlet(np.ones(4), size=6)
        paths = [p for p in itertools.product(range(4), repeat=6) if all(b >= a and (not step_only or b - a <= 1) for a, b in zip(p, p[1:])) and (not step_only or p[0] == 0)]
        best = max(paths, key=lambda p: sum(math.log(probs[t, c] + 1e-8) for t, c in enumerate(p)))
        want = best.index(2) if 2 in best else 5
        df = frame(spark, [([[float(v) for v in r] for r in probs],)], "f array<array<double>>")
        assert df.select(rl.ordered_decode("f", step_only=step_only).alias("r")).first()["r"] == pytest.approx(want / 15)


def test_logistic_fit_recovers_midpoint():
    t = (np.arange(60) * 5 + 29.5) / 15.0
    p = 1 / (1 + np.exp(-1.7 * (t - 9.3)))
    ttp, t0, k, done = rl._fit_logistic(p[None, :], 60, 5, 0.5)[0]
    assert (ttp, t0, k, done) == (pytest.approx(9.3, abs=1e-6), pytest.approx(9.3, abs=1e-6), pytest.approx(1.7, abs=1e-6), 1)


# --- onset ------------------------------------------------------------------------------------
def test_peaks_by_hand():
    _, at, w = kn.peaks(np.array([[0, 1, 0, 2, 2, 2, 0, 1.0]]), 0.5, None)
    assert at.tolist() == [1, 4] and w.tolist() == pytest.approx([1.0, 3.0])
    _, at, _ = kn.peaks(np.array([[0, 3, 2, 2.5, 0.0]]), 1.0, None)
    assert at.tolist() == [1]
    assert kn.strongest(np.zeros((1, 20)), 1e-5).tolist() == [-1]


def test_landmarks_on_a_logistic(spark):
    x = [float(v) for v in 1 / (1 + np.exp(-1.5 * (T450 - 10.0)))]
    flat = [0.0] * 450
    df = frame(spark, [(1, x), (2, flat), (3, [1.0, 2.0])], "id int, x array<double>")
    got = {r["id"]: r["m"] for r in df.select("id", on.landmarks(3.0, span=20)("x").alias("m")).collect()}
    m = got[1]
    assert m["peak"] == pytest.approx(10.0, abs=0.2) and m["ttp"] < m["peak"] and m["sdm"] < m["peak"] and m["cy0"] < m["peak"]
    assert all(v is None for v in got[2]) and all(v is None for v in got[3])


def test_anchored_variants_and_reasons(spark):
    t = np.linspace(0, 30, 601)
    x = [float(v) for v in 1 / (1 + np.exp(-1.5 * (t - 10.0)))]
    df = frame(spark, [(1, x, 9.5), (2, x, None), (3, [0.0] * 5, 1.0)], "id int, x array<double>, a double")
    rows = df.select("id", F.inline(on.anchored(rate=20.0)("x", "a"))).collect()
    by = {(r["id"], r["rule"]): r for r in rows}
    assert len(rows) == 12
    assert by[1, "zero_cross_d2"]["ttp"] == pytest.approx(10.0, abs=0.1)
    assert by[1, "closest_peak_d1"]["ttp"] == pytest.approx(10.0, abs=0.1)
    assert by[2, "zero_cross_d2"]["reason"] == "no anchor time" and by[3, "zero_cross_d2"]["reason"] == "signal too short"


def test_sigmoid_fit_is_close():
    t = np.arange(200.0)
    mat = np.stack([2.0 / (1 + np.exp(-0.1 * (t - 90))) ** 1.2 + 0.3, 1.0 / (1 + np.exp(-0.2 * (t - 60))) + 0.1])
    p = kn.fit_5pl(mat)
    assert (p[:, 6] == 1).all() and p[0, :5] == pytest.approx([2.0, 0.3, 0.1, 90, 1.2], abs=1e-4) and p[1, :5] == pytest.approx([1.0, 0.1, 0.2, 60, 1], abs=1e-4)


def test_sigmoid_fit_says_when_it_has_not_converged():
    t = np.arange(200.0)
    clean = 2.0 / (1 + np.exp(-0.1 * (t - 90))) ** 1.2 + 0.3
    assert kn.fit_5pl(clean[None, :], rounds=2)[0, 6] == 0
    noisy = clean + np.random.default_rng(0).normal(scale=0.05, size=(30, 200))
    fit = kn.fit_5pl(np.concatenate([noisy, np.zeros((1, 200)), t[None, :]]))
    assert (fit[:30, 6] == 1).all() and (fit[:30, 5] > 0.99).all() and np.isfinite(fit).all()
    best = kn.fit_5pl(noisy[:1])[0]  # no small change of any parameter makes the error smaller
    error = lambda q: ((noisy[0] - q[0] / (1 + np.exp(-q[2] * (t - q[3]))) ** q[4] - q[1]) ** 2).sum()
    for i in range(5):
        for s in (-1e-3, 1e-3):
            assert error(best[:5] + s * best[i] * (np.arange(5) == i)) >= error(best[:5])


def test_artefact_cut(spark):
    dip = np.r_[np.linspace(0, -1, 15), np.linspace(-1, 1, 10), np.full(125, 1.0)]
    df = frame(spark, [(1, [float(v) for v in dip]), (2, [float(v) for v in np.linspace(0, 1, 150)])], "id int, x array<double>")
    got = {r["id"]: r["c"] for r in df.select("id", on.artefact_cut(span=3)("x").alias("c")).collect()}
    assert 15 < got[1] < 40 and got[2] == 0


def test_pixel_shift(spark):
    base = np.exp(-((np.arange(100) - 50) ** 2) / 50.0)
    late = np.roll(base, 4)
    df = frame(spark, [([float(v) for v in late], [float(v) for v in base]), ([0.0] * 100, [float(v) for v in base])], "x array<double>, m array<double>")
    assert [r["s"] for r in df.select(on.pixel_shift("x", "m", 50, 30, 10).alias("s")).collect()] == [4, 0]


# --- labels, metrics, splits ---------------------------------------------------------------------
def test_boundary_degeneracies(spark):
    for b, counts in {(50, 150, 300): (50, 100, 150, 150), (0, 100, 300): (0, 100, 200, 150), (50, 50, 300): (50, 0, 250, 150), (0, 0, 450): (0, 0, 450, 0)}.items():
        df = frame(spark, [b], "a int, b int, c int").select(lb.from_boundaries(F.col("a"), F.col("b"), F.col("c"), 450).alias("l"))
        got = df.first()["l"]
        assert tuple(got.count(k) for k in range(4)) == counts


def test_boundary_errors_and_weighting(spark):
    def seq(a, b, c, n=20):
        return [0] * a + [1] * (b - a) + [2] * (c - b) + [3] * (n - c)

    df = frame(spark, [(seq(7, 10, 17), seq(5, 10, 15)), ([0] * 20, seq(5, 10, 15))], "p array<int>, t array<int>")
    got = df.select(*[F.abs(lb.boundary_error("p", "t", k)).alias(f"e{k}") for k in (1, 2, 3)]).collect()
    assert tuple(got[0]) == (2, 0, 2) and tuple(got[1]) == (None, None, None)


def preds(spark, offset=0.0, slope=-3.0, noise=0.0):
    rng = np.random.default_rng(0)
    rows = []
    for w, c in enumerate([5.0, 6.0, 7.0, 8.0, 9.0]):
        for p in range(20):
            true = 30 + slope * c
            rows.append(("m", "c0", w, w * 100 + p, true + offset + noise * float(rng.normal()), true, c, "test"))
    return frame(spark, rows, "method_id string, chip_id string, well_id int, pixel_id long, ttp_pred double, ttp_true double, log10_conc double, split string")


def test_metric_identities(spark):
    perfect = mt.portfolio(preds(spark)).first()
    assert perfect["per_well_mae"] == pytest.approx(0) and perfect["r2"] == pytest.approx(1) and perfect["passes"] and perfect["within_well_cov"] == pytest.approx(0)
    assert perfect["slope"] == pytest.approx(-3.0)
    assert mt.portfolio(preds(spark, offset=2.0)).first()["per_well_mae"] == pytest.approx(2.0)
    assert not mt.portfolio(preds(spark, slope=3.0)).first()["passes"]


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 6, 80) / 5.0
    df = frame(spark, [("a", int(a), float(b)) for a, b in zip(y, s)] + [("b", 1, 0.2)], "k string, y_true int, y_score double")
    got = {r["k"]: r for r in mt.binary_metrics(df, ["k"]).collect()}
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert got["a"]["auroc"] == pytest.approx(np.mean(pairs)) and got["b"]["auroc"] is None and got["b"]["precision"] == 0.0


def test_upsert_replaces_and_keeps(spark):
    old = frame(spark, [("a", 1.0), ("b", 2.0)], "method_id string, mae double")
    new = frame(spark, [("b", 9.0), ("c", 3.0)], "method_id string, mae double")
    assert {tuple(r) for r in mt.upsert(old, new).collect()} == {("a", 1.0), ("b", 9.0), ("c", 3.0)}


def test_split_properties(spark):
    df = spark.range(1000).select(F.col("id").alias("pixel_id"), (F.col("id") % 10 == 0).cast("int").alias("y"), (F.col("id") % 20).cast("string").alias("chip"))
    cuts = {"train": 0.7, "val": 0.85, "test": 1.0}
    a = st.stratified(df, ["y"], ["pixel_id"], cuts, 4, split_rows=50)
    n = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert n[0, "train"] == 630 and n[1, "train"] == 70 and n[1, "val"] == 15
    assert a.exceptAll(st.stratified(df, ["y"], ["pixel_id"], cuts, 4)).count() == 0
    folds = st.grouped_folds(df, "chip", "y", 5, 0)
    assert folds.count() == 20 and {r["count"] for r in folds.groupBy("fold").count().collect()} == {4}


def test_kmeans_separates_two_families(spark):
    from wellspring.operators import clusters as cl

    rng = np.random.default_rng(2)
    rows = [("w", i, [float(v) for v in 1 / (1 + np.exp(-(np.arange(60) - (15 if i < 15 else 45)))) + 0.05 * rng.normal(size=60)]) for i in range(30)]
    df = frame(spark, rows, "w string, pixel_id long, f array<double>")
    got = {r["pixel_id"]: r["cluster"] for r in cl.kmeans(df, ["w"], "pixel_id", "f", 2, seed=1).collect()}
    assert len({got[i] for i in range(15)}) == 1 and len({got[i] for i in range(15, 30)}) == 1 and got[0] != got[20]
    with pytest.raises(ValueError):
        cl.kmeans(df, ["w"], "pixel_id", "f", 31, strict=True)


def test_kmeans_goes_on_until_it_settles(spark):
    from wellspring.operators import clusters as cl

    values = [float(v) ** 1.5 for v in range(200)]
    df = frame(spark, [("w", i, [v]) for i, v in enumerate(values)], "w string, pixel_id long, f array<double>")
    got = {r["pixel_id"]: r["cluster"] for r in cl.kmeans(df, ["w"], "pixel_id", "f", 4).collect()}
    centres = {c: np.mean([values[i] for i in got if got[i] == c]) for c in set(got.values())}
    assert len(centres) == 4 and all(got[i] == min(centres, key=lambda c: abs(centres[c] - v)) for i, v in enumerate(values))
    with pytest.raises(RuntimeError):
        cl.kmeans(df, ["w"], "pixel_id", "f", 4, rounds=2)


def test_ensemble_rejects_ragged_members(spark):
    from wellspring.plans.spatial import ensemble

    ok = frame(spark, [(1, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, x array<double>")
    assert ensemble(ok, ["k"]).first()["x"] == [2.0, 3.0]
    with pytest.raises(Exception, match="member lengths differ"):
        ensemble(frame(spark, [(1, [1.0, 2.0]), (1, [3.0])], "k int, x array<double>"), ["k"]).collect()


def test_alignment_check(spark):
    from wellspring.sources import tables as tb

    a = frame(spark, [("c", 0, 1), ("c", 0, 2)], "chip_id string, well_id int, pixel_id long")
    tb.validate_alignment(a, a)
    with pytest.raises(ValueError):
        tb.validate_alignment(a, a.limit(1))


@pytest.mark.parametrize("n", [3, 1500])
def test_capped_sample_sizes(spark, n):
    from pyspark.sql import functions as F

    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id").alias("pixel_id")).filter("k = 0 OR pixel_id < 9")
    got = {r["k"]: r["count"] for r in st.capped_sample(df, ["k"], ["pixel_id"], n, 1).groupBy("k").count().collect()}
    assert got == {0: min(n, 2000), 1: min(n, 4)}


def test_pixels_without_coordinates_pass_through(spark):
    rows = [("c", 0, 7, None, None, False, 0, [1.0, 2.0, 3.0])]
    got = {r["pixel_id"]: r["x"] for r in sp.box_smooth(pixels(spark, [(0, 0), (0, 1)], rows), 1).collect()}
    assert got[7] == [1.0, 2.0, 3.0] and got[0] == got[1]


def test_savgol_reproduces_a_cubic(spark):
    t = np.arange(30) / 10.0
    y = 1 + t - 2 * t**2 + t**3
    assert np.allclose(one(spark, y, ar.savgol("p", 9, 3)), y)
    assert one(spark, y[:5], ar.savgol("p", 9, 3)) is None


def test_series_blocks_match_whole_series(spark):
    from wellspring.operators import series as sr

    rng = np.random.default_rng(8)
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(rng.normal(size=300))], "sid string, t int, v double")
    for build in (lambda b: sr.gradients(df, ["sid"], block=b), lambda b: sr.savgol(df, ["sid"], 9, 3, block=b), lambda b: sr.feature_table(df, ["sid"], 20, 10, block=b),
                  lambda b: sr.scaled_derivative(df, ["sid"], 9, 2.0, block=b), lambda b: sr.padded_mean(df, ["sid"], 9, block=b)):
        small, whole = build(24).orderBy("t").toPandas(), build(10**6).orderBy("t").toPandas()
        assert len(small) == len(whole) >= 299
        for c in small.columns:
            if c != "sid":
                assert np.allclose(small[c].astype(float), whole[c].astype(float), equal_nan=True), c


def test_raw_features_agree_with_the_fitted_curve(spark):
    """On clean, finely sampled curves the sampled features come close to those of the curve itself."""
    step, n = 0.05, 800
    rows = [(i, 1.5, 0.1, 0.5 + 0.1 * i, 12.0 + i, 0.8 + 0.1 * i) for i in range(5)]
    df = frame(spark, rows, "id int, fm double, fb double, sc double, cs double, asym double")
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: on.sigmoid_value(i * F.lit(step), *[F.col(c) for c in ("fm", "fb", "sc", "cs", "asym")]))
    true = {r["id"]: r for r in on.kinetic_features(df, n, step).collect()}
    for method in ("gradient", "savgol", "diff"):
        got = {r["id"]: r["k"] for r in df.select("id", on.raw_kinetics(step, 0.1, method)(grid).alias("k")).collect()}
        for i, r in true.items():
            for c in ("xms", "xs", "xe", "xp1", "xp2", "max_slope", "area1", "area2"):
                assert got[i][c] == pytest.approx(r[c], rel=0.03, abs=2 * step), (method, c)
            assert got[i]["cy0"] == pytest.approx(r["cy0"], abs=1e-3)
    gaps = frame(spark, [([0.0, None, 1.0],), ([1.0],), (None,)], "x array<double>")
    assert all(r["k"]["xms"] is None for r in gaps.select(on.raw_kinetics(1.0)("x").alias("k")).collect())


def test_fitted_curves_are_dealt_and_batched(spark):
    """Features of given curves: rows leave a one-task table, values agree with a plain loop, rows without parameters have none."""
    rows = [(i, 1.0 + i % 7 / 4, 0.01 + i % 5 / 50, 0.4 + i % 11 / 20, 10.0 + i % 13, 0.6 + i % 5 / 4) for i in range(300)] + [(300, 1.0, None, 0.5, None, 1.0)]
    df = frame(spark, rows, "id int, fm double, fb double, sc double, cs double, asym double").coalesce(1)
    made = on.kinetic_features(df, 61, 0.5)
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = {r["id"]: r for r in made.collect()}
    assert got[300]["xms"] is None and got[300]["cy0"] is None and got[300]["area1"] == 0.0
    t = np.arange(61) * 0.5
    for i, fm, fb, sc, cs, asym in rows[:300]:
        e = np.exp(-sc * (t - cs))
        f, d = np.round(fm / (1 + e) ** asym + fb, 12), np.round(fm * asym * sc * e / (1 + e) ** (asym + 1), 12)
        p, level = int(np.argmax(d)), 0.1 * d.max()
        a, b = np.flatnonzero(d > level)[[0, -1]]
        xs = 0.0 if a == 0 else t[a - 1] + (level - d[a - 1]) * 0.5 / (d[a] - d[a - 1])
        xe = t[b] if b == 60 else t[b] + (level - d[b]) * 0.5 / (d[b + 1] - d[b])
        first, last = int(np.floor(xs / 0.5 + 0.5 - 1e-9)), int(np.floor(xe / 0.5 + 0.5 - 1e-9))
        want = {"xms": t[p], "max_slope": d[p], "xs": xs, "xe": xe, "area1": sum((d[j] + d[j + 1]) / 4 for j in range(first, p)), "area2": sum((d[j] + d[j + 1]) / 4 for j in range(p, last)), "neg_log_f0": -np.log10(f[0])}
        for c, v in want.items():
            assert got[i][c] == pytest.approx(v, abs=1e-9), (i, c)


def test_recovery_of_parts_is_dealt_over_tasks(spark, tmp_path):
    """One file of parts is one task to read; the fits need more."""
    from wellspring.plans.onset import e12_recovery

    rows = [(i, i % 50 + 1) for i in range(40)] + [(None, 3), (41, None)]
    frame(spark, rows, "p_partkey bigint, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    made = e12_recovery(spark, str(tmp_path))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    got = {r["p_partkey"]: r for r in made.collect() if r["fit_ok"]}
    assert len(got) == 40 and all(r["fm"] == pytest.approx(1 + k % 7 / 4, abs=1e-3) for k, r in got.items())


def test_values_reach_a_large_group_where_its_rows_are(spark):
    """A group above the limit stays spread over tasks; medians and deviations of large, small and NULL-keyed groups hold."""
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.integers(0, 90, 700)] + [("b", float(v)) for v in range(9)] + [("c", 2.0), ("c", None), (None, 5.0), (None, 6.0)]
    df = frame(spark, rows, "g string, v double").repartition(8)
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    got = rk.attach_sized(df, sizes, ["g"], 50)
    assert got.filter("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 1
    assert got.count() == len(rows) and {(r["g"], r["n"]) for r in got.collect()} == {("hot", 700), ("b", 9), ("c", 2), (None, 2)}
    mm = {r["g"]: r for r in rk.median_mad(df, ["g"], "v", 50).collect()}
    assert set(mm) == {"hot", "b", "c"}
    for g in mm:
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert (mm[g]["n"], mm[g]["med"]) == (len(v), np.median(v)) and mm[g]["mad"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
