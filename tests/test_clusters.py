"""k-means against every possible partition, in one chunk and in several."""

from itertools import product

import numpy as np
import pytest

from wellspring.operators import clusters as cl
from wellspring.operators import onset as on
from wellspring.plans import learning


def inertia(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in np.unique(labels))


def best(x, k):
    return min(inertia(x, np.array(lab)) for lab in product(range(k), repeat=len(x)) if len(set(lab)) == k)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    wells = {"a": rng.normal(size=(9, 2)), "b": rng.integers(0, 4, (9, 2)).astype(float), "c": np.repeat([[0.0, 1], [5, 5], [9, 0]], 3, axis=0), "d": rng.normal(size=(3, 2))}
    return wells, [(w, 10 * i, x.tolist()) for w, xs in wells.items() for i, x in enumerate(xs)] + [("a", 999, None)]


@pytest.mark.parametrize("chunk", [4096, 4])
def test_best_of_ten_starts(spark, points, chunk):
    wells, rows = points
    df = spark.createDataFrame(rows, "w string, pixel_id long, f array<double>")
    got = cl.kmeans(df, ["w"], "pixel_id", "f", (2, 4), chunk=chunk).toPandas()
    assert set(zip(got["w"], got["k"])) == {(w, k) for w in "abc" for k in (2, 4)} | {("d", 2)}  # d has too few rows for 4
    for (w, k), part in got.groupby(["w", "k"]):
        x, lab = wells[w], part.sort_values("pixel_id")["cluster"].to_numpy()
        assert len(lab) == len(x) and part["inertia"].iat[0] == pytest.approx(inertia(x, lab), abs=1e-9)
        assert inertia(x, lab) == pytest.approx(best(x, k) if k == 2 else inertia(x, lab), abs=1e-9)
        firsts = [np.flatnonzero(lab == c)[0] for c in sorted(set(lab))]
        assert firsts == sorted(firsts)  # clusters are numbered by their lowest pixel


def test_several_chunks_reach_the_same_fit(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(scale=6, size=(4, 3))
    x = centre[rng.integers(0, 4, 400)] + rng.normal(size=(400, 3))
    df = spark.createDataFrame([("w", i, v.tolist()) for i, v in enumerate(x)], "w string, pixel_id long, f array<double>")
    one = cl.kmeans(df, ["w"], "pixel_id", "f", 4).first()["inertia"]
    many = cl.kmeans(df, ["w"], "pixel_id", "f", 4, chunk=60).first()["inertia"]
    assert many == pytest.approx(one, rel=1e-6)


def test_representative_and_median_label(spark):
    rows = [("w", 1, [0.0, 0.0], 4.0), ("w", 2, [1.0, 1.0], None), ("w", 3, [2.0, 2.0], 10.0), ("w", 4, [9.0, 9.0], 6.0)]
    df = spark.createDataFrame(rows, "w string, pixel_id long, x array<double>, y double")
    assert tuple(cl.representatives(df, ["w"], label="y").first()) == ("w", 3, 4, 6.0)


def test_times_are_found_once_and_rows_without_one_left_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, np.cumsum(np.abs(rng.normal(size=64))).tolist()) for i in range(40)] + [(98, [1.0, 2.0, 3.0]), (99, None)]
    df = spark.createDataFrame(rows, "pixel_id long, x array<double>")
    plain = df.select("pixel_id", on.landmarks(0.3, span=6)("x")["peak"].alias("ttp")).collect()
    stored, durable = [], learning.durable

    def watched(t):
        stored.append(t._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython"))
        return durable(t)

    monkeypatch.setattr(learning, "durable", watched)
    got = learning._timed(df)
    assert stored == [1]  # a filter in the same plan has the landmarks found a second time, below it
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pixel_id"], r["ttp"], r["f"]) for r in got.collect()) == sorted((i, v, [v]) for i, v in plain if v is not None)
    assert 98 not in {r["pixel_id"] for r in got.collect()} and len(plain) == 42
