"""Greedy grouped folds against the snake deal they replace, and the nested split."""

import numpy as np
import pytest

from wellspring.operators import splits as st


def spread(counts, fold, k):
    share = counts / counts.sum(axis=0)
    return np.array([share[fold == f].sum(axis=0) for f in range(k)]).std(axis=0).mean()


def snake(counts, k):
    order = np.lexsort((counts.sum(axis=1), counts[:, 1] / counts.sum(axis=1)))
    out = np.empty(len(counts), int)
    for i, g in enumerate(order):
        out[g] = i % k if (i // k) % 2 == 0 else k - 1 - i % k
    return out


def greedy(counts, k, seed):
    order = np.lexsort((np.random.default_rng(seed).random(len(counts)), -counts.std(axis=1)))
    out = np.empty(len(counts), int)
    out[order] = st._greedy(counts[order], k)
    return out


def test_no_worse_than_a_snake_deal():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        size = rng.integers(20, 400, 31)
        pos = rng.binomial(size, rng.beta(1, 2, 31))
        counts = np.column_stack([size - pos, pos]).astype(float)
        assert spread(counts, greedy(counts, 5, seed), 5) <= spread(counts, snake(counts, 5), 5)


@pytest.mark.parametrize("block", [20_000, 7])
def test_folds_keep_groups_whole(spark, monkeypatch, block):
    monkeypatch.setattr(st, "GROUPS", block)
    rows = [(f"g{i % 23}", (i * 7 + i // 23) % 3 if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "chip string, y int")
    folds = {r["chip"]: r["fold"] for r in st.grouped_folds(df, "chip", "y", 5, 1).collect()}
    assert len(folds) == 23 and set(folds.values()) == set(range(5))
    nested = st.nested_folds(df, "chip", "y", 5, 7, 1).collect()
    assert len(nested) == 5 * 23 and len({(r["fold"], r["chip"]) for r in nested}) == 5 * 23
    assert sorted(r["chip"] for r in nested if r["split"] == "test") == sorted(folds)
    assert all({r["split"] for r in nested if r["fold"] == f} == {"train", "val", "test"} for f in range(5))


def test_query_gives_each_group_its_fold(spark, tmp_path):
    """One row per group with its size and the fold that a snake deal by positive share, size and hash gives it."""
    import hashlib

    from wellspring.plans.splits import k04

    rows = [(i, 1, i, i * 7 % 41, 1.0, "RAN"[(i * i + i // 41) % 3]) for i in range(900)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    flags = {g: [r[5] == "R" for r in rows if r[3] == g] for g in range(41)}
    order = sorted(flags, key=lambda g: (sum(flags[g]) / len(flags[g]), len(flags[g]), hashlib.md5(f"3|{g}".encode()).hexdigest()))
    want = {g: (len(flags[g]), i % 5 if i // 5 % 2 == 0 else 4 - i % 5) for i, g in enumerate(order)}
    assert {r["l_suppkey"]: (r["n"], r["fold"]) for r in k04(spark, str(tmp_path)).collect()} == want
