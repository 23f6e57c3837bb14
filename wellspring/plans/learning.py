"""Queries for per-well clustering and Spark ML models on traces."""

from pyspark.sql import functions as F

from wellspring.operators import clusters as cl
from wellspring.operators import learning as ml
from wellspring.operators import metrics as mt
from wellspring.operators import onset as on
from wellspring.operators import rules as rl
from wellspring.operators import series as sr
from wellspring.operators.ranking import quantiles, with_scalars
from wellspring.operators.spatial import WELL, fold_traces, mean_trace
from wellspring.operators.splits import capped_sample
from wellspring.plans import query
from wellspring.plans.bindings import TRACES_LONG, curves, long, r6, traces
from wellspring.plans.windows import zscore
from wellspring.session import durable
from wellspring.sources.tables import scratch

SAMPLED = 120  # pixels shown per cluster at most


def _clustered(t, ttp=None):
    """k, cluster, size, inertia, mean trace and sampled pixels per well for K 2, 4 and 8; ``ttp`` orders one-dimensional clusters."""
    c = cl.kmeans(t, WELL, "pixel_id", "f", (2, 4, 8))
    if ttp:
        c = cl.renumber_by_centre(c, [*WELL, "k"], "pixel_id", c.select(*WELL, "pixel_id", "k").join(t.select(*WELL, "pixel_id", ttp), [*WELL, "pixel_id"]), ttp)
    keys = ["k", *WELL, "cluster"]
    c = durable(c.select(*keys, "pixel_id", "inertia").join(t.select(*WELL, "pixel_id", "x"), [*WELL, "pixel_id"]))
    means = mean_trace(c, keys, "x", "mean").withColumn("mean", F.transform("mean", lambda v: r6(v)))
    sample = capped_sample(c.select(*keys, "pixel_id"), keys, ["pixel_id"], SAMPLED, 0)
    sample = sample.groupBy(*keys).agg(F.sort_array(F.collect_list("pixel_id")).alias("sample"))
    return c.groupBy(*keys).agg(F.count("*").alias("size"), r6(F.max("inertia")).alias("inertia")).join(means, keys).join(sample, keys)


@query("m01_shape_clusters")
def m01(spark, root):
    return _clustered(traces(spark, root).withColumn("f", zscore("x")))


def _timed(t):
    """Traces with a time (``ttp``) and the feature ``f``. Stored before the filter, which Spark would else move below the landmarks and find them twice, in two workers a task."""
    t = durable(t.withColumn("ttp", on.landmarks(0.3, span=6)("x")["peak"]))
    return t.filter("ttp IS NOT NULL").withColumn("f", F.array("ttp"))


@query("m01_time_clusters")
def m01_time(spark, root):
    return _clustered(_timed(curves(spark, root)), "ttp")


@query("m01_position_clusters")
def m01_pos(spark, root):
    return _clustered(traces(spark, root).withColumn("f", F.array(F.col("prow").cast("double"), F.col("pcol").cast("double"))))


@query("m02_cluster_representative", f"""WITH {TRACES_LONG}, c AS (SELECT chip_id, well_id, CAST(pixel_id % 2 AS INTEGER) AS cluster, pixel_id, t, v FROM tl),
m AS (SELECT chip_id, well_id, cluster, t, avg(v) AS m FROM c GROUP BY ALL),
d AS (SELECT c.chip_id, c.well_id, c.cluster, c.pixel_id, round(sqrt(sum((v - m) * (v - m))), 9) AS d FROM c JOIN m ON m.chip_id = c.chip_id AND m.well_id = c.well_id AND m.cluster = c.cluster AND m.t = c.t GROUP BY ALL),
lab AS (SELECT chip_id, well_id, CAST(pixel_id % 2 AS INTEGER) AS cluster, median(CASE WHEN pixel_id % 5 <> 0 THEN prow * CAST(0.5 AS DOUBLE) END) AS median_label FROM traces GROUP BY ALL)
SELECT d.chip_id, d.well_id, d.cluster, arg_min(pixel_id, (d, pixel_id)) AS representative, count(*) AS size, any_value(median_label) AS median_label
FROM d JOIN lab ON lab.chip_id = d.chip_id AND lab.well_id = d.well_id AND lab.cluster = d.cluster GROUP BY ALL""")
def m02(spark, root):
    t = traces(spark, root).withColumn("cluster", (F.col("pixel_id") % 2).cast("int"))
    t = t.withColumn("label", F.when(F.col("pixel_id") % 5 != 0, F.col("prow") * 0.5))  # some pixels have no label
    return cl.representatives(t, [*WELL, "cluster"], label="label")


def _metrics(scored):
    m = mt.binary_metrics(scored.withColumn("method_id", F.lit("model")).withColumnRenamed("y", "y_true"), ["method_id"])
    return m.select("n_pos", "n_neg", *[r6(c, 3).alias(c) for c in ("accuracy", "recall", "auroc")])


def _fit_and_test(df, fit):
    """Rows of ``is_test``, scored by a model that ``fit`` made from the others."""
    return ml.score(fit(df.filter("NOT is_test")), df.filter("is_test"))


@query("m03_boosted_curve_classifier")
def m03(spark, root):
    d = ml.balanced(ml.vectors(traces(spark, root)), "y")
    return _metrics(_fit_and_test(d, lambda t: ml.boosted_classifier(t, "y")))


@query("m03_gain_table")
def m03_gain(spark, root):
    d = ml.balanced(ml.vectors(traces(spark, root)), "y").filter("NOT is_test")
    return ml.importance(ml.boosted_classifier(d, "y"), spark).withColumn("gain", r6("gain"))


@query("m04_boosted_curve_regressor")
def m04(spark, root):
    """Squared, absolute and pseudo-Huber loss on times of which every 17th is spoilt in training."""
    d = ml.vectors(traces(spark, root)).withColumn("ttp_true", F.col("well_id") * 0.4)
    spoilt = d.withColumn("ttp_true", F.when(F.col("pixel_id") % 17 == 0, 60.0).otherwise(F.col("ttp_true"))).filter("NOT is_test")
    out = None
    for loss in ("squared", "absolute", "huber"):
        s = ml.score(ml.boosted_regressor(spoilt, "ttp_true", loss), d.filter("is_test")).select(F.lit(loss).alias("loss"), "ttp_pred", "ttp_true")
        out = s if out is None else out.unionByName(s)
    m = mt.regression_metrics(out, ["loss"])
    return m.select("loss", "n", r6("mae", 3).alias("mae"), r6("rmse", 3).alias("rmse"), r6("mae_mean", 3).alias("mae_mean"))


@query("m05_timepoint_classifier")
def m05(spark, root):
    """Per-sample features and labels -> boosted trees -> first crossing -> time metrics, split by pixel."""
    t = curves(spark, root).withColumn("ttp_true", 1.0 + F.col("well_id") * 0.2)
    rows = long(t, "pixel_id", "ttp_true")
    f = sr.feature_table(rows, ["pixel_id"], 10, 10).withColumn("label", (F.col("t") >= F.col("ttp_true") * 15.0).cast("int"))
    cols = ["v", "d1", "d2", "roll_mean", "roll_std", "elapsed", "rise", "z", "slope"]
    d = ml.three_way(ml.assembled(f, cols), "pixel_id").withColumn("weight", F.lit(1.0))
    s = _fit_and_test(d, lambda q: ml.boosted_classifier(q, "label"))
    p = fold_traces(s.select("pixel_id", "ttp_true", "t", "y_score"), ["pixel_id", "ttp_true"], "y_score", "p")
    m = mt.regression_metrics(p.withColumn("ttp_pred", rl.first_crossing_or_null("p", 0.5)).withColumn("method_id", F.lit("timepoint")), ["method_id"])
    return m.select("n_total", "n", "n_nan", r6("mae", 3).alias("mae"), r6("rmse", 3).alias("rmse"))


@query("m06_dense_classifier")
def m06(spark, root):
    """Weighted and unweighted dense network and weighted logistic regression, on rows that no fit has seen."""
    d = ml.balanced(ml.vectors(traces(spark, root)), "y")
    fits = {
        "dense": lambda t: ml.dense_classifier(t, "y"), "dense_unweighted": lambda t: ml.dense_classifier(t, "y", weight=None),
        "logistic": lambda t: ml.logistic_classifier(t, "y"),
    }
    out = None
    for kind, fit in fits.items():
        m = _metrics(_fit_and_test(d, fit)).withColumn("kind", F.lit(kind))
        out = m if out is None else out.unionByName(m)
    return out


@query("m07_batch_scoring", f"WITH {TRACES_LONG} SELECT chip_id, well_id, count(*) AS n, true AS scored, true AS in_range FROM traces GROUP BY 1, 2")
def m07(spark, root):
    """Fit on some chips, store the network, load it and score every trace in batches."""
    d = ml.balanced(ml.vectors(traces(spark, root)), "y")
    path = scratch(spark, "model")
    ml.store_net(ml.dense_classifier(d.filter("chip_id <> 'chip4'"), "y", rounds=15), spark, path)
    s = d.select(*WELL, "pixel_id", ml.batch_score(spark, path, F.col("x")).alias("y_score"))
    return s.groupBy(*WELL).agg(F.count("*").alias("n"), (F.count("y_score") == F.count("*")).alias("scored"), (F.count_if(F.col("y_score").between(0.0, 1.0)) == F.count("*")).alias("in_range"))


@query("p18_pca_reconstruction")
def p18_pca(spark, root):
    """Residual against components of the positives' training rows -> threshold at p95 of their validation rows -> score."""
    t = ml.three_way(traces(spark, root), "pixel_id")
    c = ml.components(t.filter("y = 1 AND NOT is_val"), "x", 8)
    e = durable(t.select("pixel_id", "y", "is_val", c.error()("x").alias("err")))
    thr = quantiles(e.filter("y = 1 AND is_val"), [], "err", {"thr": 0.95}).select("thr")
    e = with_scalars(with_scalars(e, thr), e.filter("is_val").agg(F.stddev_pop("err").alias("sd")))
    return e.select("pixel_id", r6("err", 5).alias("err"), r6(1 / (1 + F.exp(-(F.col("thr") - F.col("err")) / F.col("sd"))), 5).alias("score"))
