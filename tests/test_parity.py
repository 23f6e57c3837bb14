"""Every query with SQL must equal it; the rest must return rows. Small tables, both group routes."""

import os

import pytest

import __spark_entry__ as entry
from tests import parity
from wellspring import plans

ROOT = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
FAST = [n for n in plans.QUERIES if n in plans.ORACLE]
# one representative of each family that has no SQL form; the rest run in tests/parity.py
ROWS = ["e12_sigmoid_fit", "r05_logistic_fit", "r17_full_rule_sweep", "m01_position_clusters"]


@pytest.fixture(scope="module")
def con():
    return parity.duck(ROOT)


@pytest.mark.parametrize("name", FAST + ROWS)
def test_query(spark, con, name):
    assert parity.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), ROOT) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "n_kept" in df.columns


SPLIT = ["a02_median_mad", "a11_spearman_gate", "a13_binary_metrics", "k01_stratified_split", "w07_feature_table", "w05_savgol", "w02_edge_padded_mean", "p18_reconstruction_score"]


@pytest.mark.parametrize("name", SPLIT)
def test_hot_group_route(spark, con, monkeypatch, name):
    """Groups above the limit are range-split; series are cut into short blocks. Results stay equal."""
    from wellspring.operators import ranking, series

    monkeypatch.setattr(ranking, "SPLIT_ROWS", 40)
    monkeypatch.setattr(series, "BLOCK", 64)
    assert parity.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], ROOT) is None
