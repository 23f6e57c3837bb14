"""The batch peak search against a plain one that walks out from every maximum."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from wellspring.functions import kernels as kn
from wellspring.operators import onset


def plain(y, least, width):
    """Walk left and right from each top: wall, lowest sample, then the half-prominence crossings."""
    out, i, n = [], 1, len(y)
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            mid = (i + j) // 2
            lows = []
            for step in (-1, 1):
                at, low = mid, y[mid]
                while 0 <= at < n and y[at] <= y[mid]:
                    low = min(low, y[at])
                    at += step
                lows.append(low)
            prominence = y[mid] - max(lows)
            half = y[mid] - prominence / 2
            ends = []
            for step in (-1, 1):
                at = mid + step
                while y[at] > half:
                    at += step
                inner = y[at - step]
                ends.append(at - step * (half - y[at]) / (inner - y[at]) if y[at] < half else at)
            if prominence >= least and (width is None or ends[1] - ends[0] >= width):
                out.append((mid, ends[1] - ends[0]))
        i = j + 1
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", [None, 1.0, 3.0])
def test_peaks_equal_the_plain_walk(seed, width):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 130))
    mats = [rng.normal(size=(20, n)), rng.integers(0, 4, (20, n)).astype(float), np.cumsum(rng.normal(size=(20, n)), axis=1), np.zeros((3, n))]
    mat = np.concatenate(mats)  # the second has plateaus and ties everywhere
    length = rng.integers(0, n + 1, len(mat))
    for size in (None, length):
        row, at, w = kn.peaks(mat, 0.4, width, size)
        got = [(r, a, pytest.approx(x, abs=1e-12)) for r, a, x in zip(row, at, w)]
        want = [(r, *p) for r in range(len(mat)) for p in plain(mat[r, : n if size is None else size[r]], 0.4, width)]
        assert want == got


def test_strongest_takes_the_first_of_equals():
    two = np.array([[0, 2, 0, 0, 2, 0.0], [0, 1, 0, 3, 0, 0], [0, 0, 0, 0, 0, 0], [0, 1, 1, 1, 0, 0]])
    assert kn.strongest(two, 1e-5).tolist() == [1, 3, -1, 2]
    assert kn.strongest(two[:0], 1e-5).tolist() == []


def test_prominence_per_row():
    mat = np.tile([0, 1.0, 0, 3, 0], (2, 1))
    row, at, _ = kn.peaks(mat, np.array([0.5, 2.0]), None)
    assert list(zip(row, at)) == [(0, 1), (0, 3), (1, 3)]


def test_landmarks_batch_speed(spark):
    """5,000 traces of 450 samples; the target is one second on one idle core."""
    t = np.arange(450) / 15
    rng = np.random.default_rng(0)
    mid = rng.uniform(10, 25, (5000, 1))
    x = pd.Series(list(1 / (1 + np.exp(-(t - mid))) + rng.normal(scale=0.01, size=(5000, 450))))
    run = onset.landmarks(3.0).func
    run(x.iloc[:50])
    began = time.perf_counter()
    out = run(x)
    took = time.perf_counter() - began
    assert np.median(np.abs(out["peak"].astype(float) - mid[:, 0])) < 1.0
    assert took < 6, took


def test_landmarks_take_a_batch_in_slices(spark):
    """A full batch of 10,000 traces holds no more than some slices of it (73 MB before), and no row depends on the others."""
    rng = np.random.default_rng(1)
    x = pd.Series([*np.cumsum(np.abs(rng.normal(size=(10_000, 64))), axis=1), None, np.arange(3.0), np.array([])])
    run = onset.landmarks(0.3, span=6).func
    run(x.iloc[:50])
    tracemalloc.start()
    out = run(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6, most
    assert out.iloc[:10_000]["peak"].notna().mean() > 0.9 and out.iloc[10_000:].isna().all(axis=None)
    some = [0, kn.SLICE // 64 - 1, kn.SLICE // 64, 9_999]
    assert out.iloc[some].reset_index(drop=True).equals(pd.concat([run(x.iloc[[i]]) for i in some], ignore_index=True))


def test_slices_keep_every_row():
    x = pd.Series([np.full(n, i, float) if n else None for i, n in enumerate([3, 3, 0, 2, 3, 40, 3])])
    got = [(at.tolist(), mat.shape) for at, mat in kn.by_length(x, 6)]
    assert got == [([3], (1, 2)), ([0, 1], (2, 3)), ([4, 6], (2, 3)), ([5], (1, 40))]
    assert [at.tolist() for at, _ in kn.by_length(x)] == [[3], [0, 1, 4, 6], [5]]
