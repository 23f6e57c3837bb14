"""Layers C and D on tiles against brute force: sparse, clustered, tied and single-position wells, both routes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import quality as ql
from wellspring.operators import spatial as sp

SCHEMA = "chip_id string, well_id int, pixel_id long, prow int, pcol int, is_ntc boolean, x array<double>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    places = {
        0: rng.integers(0, 30, (300, 2)),  # control well, shared positions
        1: np.concatenate([rng.integers(0, 9, (500, 2)), rng.integers(0, 300, (40, 2))]),  # a crowd and a few far away
        2: [(r, c) for r in range(25) for c in range(25)],  # full grid: ties everywhere
        3: [(5, 5)] * 30,  # one position
        4: rng.integers(0, 9, (8, 2)),  # as many as neighbours are asked for
        5: rng.integers(0, 400, (500, 2)),  # sparse
    }
    out, pid = [], 0
    for well, spots in places.items():
        for r, c in spots:
            out.append(("a", well, pid, int(r), int(c), well == 0, rng.normal(size=5).round(3).tolist()))
            pid += 1
    return [*out, ("a", 2, pid, None, 3, False, [0.0] * 5)]  # no coordinates: no neighbours


def brute(rows, k, use):
    """pixel -> positions of its k nearest, per well, by (d2, row, col, id)."""
    found = {}
    for well in {r[1] for r in rows}:
        at = [i for i, r in enumerate(rows) if r[1] == well and r[3] is not None and use(r)]
        row, col, pid = (np.array([rows[i][c] for i in at]) for c in (3, 4, 2))
        for j, i in enumerate(at if len(at) > k else []):
            d2 = (row - row[j]) ** 2 + (col - col[j]) ** 2
            found[rows[i][2]] = [at[q] for q in np.lexsort((pid, col, row, d2)) if q != j][:k]
    return found


@pytest.mark.parametrize("limit", [4096, 200])
@pytest.mark.parametrize("metric", ["median", "mean", "kth"])
def test_disagreement(spark, rows, monkeypatch, limit, metric):
    monkeypatch.setattr(sp, "WELL_ROWS", limit)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["pixel_id"]: r["score"] for r in ql.disagreement(df, metric).collect()}
    near = brute(rows, 8, lambda r: True)
    x = np.array([r[6] for r in rows])
    pick = {"median": lambda n: np.median(x[n], axis=0), "mean": lambda n: x[n].mean(axis=0), "kth": lambda n: x[n[-1]]}[metric]
    assert got == {p: pytest.approx(np.sqrt(((x[p] - pick(n)) ** 2).sum()), abs=1e-9) for p, n in near.items()}


@pytest.mark.parametrize("limit", [4096, 200])
def test_chip_filter_routes(spark, rows, monkeypatch, limit):
    """Whole wells in a task, or tiles with a rim: the same flags, and those of brute force."""
    monkeypatch.setattr(sp, "WELL_ROWS", limit)
    monkeypatch.setattr(ql, "WELL_ROWS", limit)
    flags = {r["pixel_id"]: r for r in ql.chip_filter(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(flags) == len(rows)
    bad = lambda r: flags[r[2]]["a"] or flags[r[2]]["b"]
    near = brute(rows, 8, lambda r: True)
    for r in rows:
        votes = sum(bad(rows[i]) for i in near[r[2]]) if r[2] in near else -1
        assert flags[r[2]]["bad_count"] == votes and flags[r[2]]["c"] == (votes >= 4 and not bad(r) and not r[5])
    alive = lambda r: not (bad(r) or flags[r[2]]["c"])
    x = np.array([r[6] for r in rows])
    for pid, n in brute(rows, 8, alive).items():
        if alive(rows[pid]):
            assert flags[pid]["score"] == pytest.approx(np.sqrt(((x[pid] - np.median(x[n], axis=0)) ** 2).sum()), abs=1e-9)


def test_tiles_prove_most(spark, rows, monkeypatch):
    """On a plain grid the join behind the tiles has next to nothing to do."""
    monkeypatch.setattr(sp, "WELL_ROWS", 100)
    monkeypatch.setattr(sp, "CROWD", 64)
    grid = [("a", 1, 50 * r + c, r, c, False, [float(r * c)]) for r in range(50) for c in range(50)]
    proven, rest = sp.neighbourhoods(spark.createDataFrame(grid, SCHEMA).withColumn("v", F.lit(1.0)), 8, "v", lambda v, home, near: v[near].sum(axis=1))
    assert rest is None or rest.count() < 100
    assert proven.filter("value <> 8").count() == 0


def test_box_smooth_routes(spark, rows, monkeypatch):
    """Pixels as they are, or positions summed first: the same means, and those of brute force."""
    some = [r for r in rows if r[1] in (0, 1, 5)] + [("a", 1, 99_999, None, 3, False, [1.0] * 5)]
    df = spark.createDataFrame(some, SCHEMA)
    ways = []
    for limit in (1000, 0):
        monkeypatch.setattr(sp, "SHARED", limit)
        out = sp.box_smooth(df, 2)
        assert out.columns == df.columns
        ways.append({r["pixel_id"]: r["x"] for r in out.collect()})
    assert len(ways[0]) == len(ways[1]) == len(some)
    for _, well, pid, row, col, _, x in some:
        near = [r[6] for r in some if r[1] == well and row is not None and r[3] is not None and abs(r[3] - row) <= 2 and abs(r[4] - col) <= 2]
        want = np.mean(near, axis=0) if row is not None else x
        assert ways[0][pid] == pytest.approx(list(want), abs=1e-9) and ways[1][pid] == pytest.approx(list(want), abs=1e-9)
