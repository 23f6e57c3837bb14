"""Fits whose sums are taken in tasks, held against plain NumPy; metrics only on rows that no fit has seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import learning as ml
from wellspring.sources.tables import scratch

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.3, size=600) > 1.2).astype(int)
    rows = [(i, v.tolist(), int(c), float(3 * v[0] + v[1])) for i, (v, c) in enumerate(zip(x, y))]
    return ml.vectors(spark.createDataFrame(rows, "pixel_id long, x array<double>, y int, t double")).cache(), x, y


def test_three_way_flags_do_not_overlap(table):
    df = table[0]
    n = {r["is_test"] * 2 + r["is_val"]: r["count"] for r in df.groupBy("is_test", "is_val").count().collect()}
    assert set(n) == {0, 1, 2} and 350 < n[0] < 490 and 50 < n[1] < 140


def test_gradient_of_the_dense_net():
    rng = np.random.default_rng(1)
    net = ml.DenseNet.fresh([4, 5, 3, 1], 2)
    x, y, w = rng.normal(size=(20, 4)), rng.integers(0, 2, 20), rng.uniform(0.5, 2, 20)
    _, slope = net.loss_and_gradient(x, y, w)
    for i in rng.choice(len(net.flat), 15, replace=False):
        step = np.zeros(len(net.flat))
        step[i] = 1e-6
        up, down = (ml.DenseNet(net.sizes, net.flat + s * step).loss_and_gradient(x, y, w)[0] for s in (1, -1))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_dense_classifier_learns_and_weights_matter(spark, table):
    df, x, y = table
    train = ml.balanced(df.filter("NOT is_test"), "y")
    weighted = ml.dense_classifier(train, "y", hidden=(8,), rounds=30)
    plain = ml.dense_classifier(train, "y", hidden=(8,), rounds=30, weight=None)
    held = [r["pixel_id"] for r in df.filter("is_test").collect()]
    right = lambda net: ((net.score(x[held]) > 0.5) == y[held]).mean()
    assert right(plain) > 0.85 and not np.allclose(weighted.flat, plain.flat)
    assert weighted.score(x[held]).mean() > plain.score(x[held]).mean()  # positives are the rarer class
    path = scratch(spark, "net")
    ml.store_net(weighted, spark, path)
    got = df.select("pixel_id", ml.batch_score(spark, path, F.col("x"), 50).alias("a")).join(ml.score(weighted, df).select("pixel_id", F.col("y_score").alias("b")), "pixel_id").collect()
    assert len(got) == 600 and all(r["a"] == pytest.approx(r["b"], abs=1e-12) for r in got)


def test_components_equal_an_eigen_decomposition(spark, table):
    df, x, _ = table
    c = ml.components(df.repartition(70), "x", 3)  # more than one round of sums
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    away = x - x.mean(axis=0)
    top = axes[:, ::-1][:, :3]
    want = np.sqrt(((away - away @ top @ top.T) ** 2).mean(axis=1))
    got = {r["pixel_id"]: r["e"] for r in df.select("pixel_id", c.error()("x").alias("e")).collect()}
    assert [got[i] for i in range(600)] == pytest.approx(want.tolist(), abs=1e-9)
    assert c.share == pytest.approx(values[::-1][:3] / values.sum())


def test_huber_boosting(spark, table):
    df, x, _ = table
    true = 3 * x[:, 0] + x[:, 1]
    test = df.filter("is_test")
    at = [r["pixel_id"] for r in test.collect()]

    def error(train, loss, slope=1.0):
        s = {r["pixel_id"]: r["ttp_pred"] for r in ml.score(ml.boosted_regressor(train, "t", loss, 12, 3, slope=slope), test).collect()}
        return np.abs(np.array([s[i] for i in at]) - true[at]).mean()

    clean = df.filter("NOT is_test")
    spoilt = clean.withColumn("t", F.when((F.col("pixel_id") % 11 == 0) & ~F.col("is_val"), 80.0).otherwise(F.col("t")))
    assert error(spoilt, "huber") < 0.7 * error(spoilt, "squared")
    assert error(clean, "huber") < 0.6 * np.abs(true - true.mean()).mean()


def test_large_slope_is_squared_loss(spark, table):
    """One tree on a huge slope is the tree of the plain residuals."""
    from pyspark.ml.regression import DecisionTreeRegressor

    df = table[0].filter("NOT is_test").withColumn("is_val", F.lit(False))
    m = ml.huber_boost(df, "t", 1e7, 1, 3, 0)
    plain = DecisionTreeRegressor(labelCol="r", featuresCol="features", maxDepth=3, seed=0).fit(df.withColumn("r", F.col("t") - F.lit(m.start)))
    both = plain.setPredictionCol("q").transform(m.transform(df))
    assert both.filter(F.abs(F.col("prediction") - m.start - 0.3 * F.col("q")) > 1e-6).count() == 0


def test_metrics_are_of_test_rows_only(spark):
    from wellspring.plans import learning as pl
    from wellspring.plans.bindings import traces

    (m,) = pl.m03(spark, ROOT).collect()
    assert m["n_pos"] + m["n_neg"] == ml.vectors(traces(spark, ROOT)).filter("is_test AND y IS NOT NULL").count()
