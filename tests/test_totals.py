"""Nothing vanishes and nothing aborts: missing samples, constant methods, single classes, short series."""

import math

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators import metrics, quality, spatial


def test_missing_statistic_keeps_the_pixel(spark):
    stats = spark.createDataFrame([("c", k, 1.0, None if k == 0 else 1.0, 1.0) for k in range(5)], "chip_id string, pixel_id int, dyn_range double, net_slope double, trace_min double")
    limits = spark.createDataFrame([("c", 0.5, 2.0, 0.5)], "chip_id string, thr_dyn_range double, thr_net_slope double, thr_trace_min double")
    rows = quality.layers_ab(stats, limits).collect()
    assert len(rows) == 5 and all(r["a"] is False for r in rows)
    assert [r["b"] for r in sorted(rows, key=lambda r: r["pixel_id"])] == [False, True, True, True, True]


def test_constant_method_has_no_correlation(spark):
    rows = [("flat", float(k), 3.0) for k in range(4)] + [("line", float(k), 2.0 * k) for k in range(4)]
    df = spark.createDataFrame(rows, "method string, x double, y double")
    rho = {r["method"]: r["rho"] for r in metrics.spearman(df, ["method"], "x", "y").collect()}
    assert rho["flat"] is None and math.isclose(rho["line"], 1.0)
    wells = df.withColumnsRenamed({"x": "log10_conc", "y": "pred_mean"})
    r2 = {r["method"]: r["r2"] for r in metrics.dose_line(wells, ["method"]).collect()}
    assert r2["flat"] is None and math.isclose(r2["line"], 1.0)


def test_empty_array_has_no_mean(spark):
    row = spark.range(1).select(ar.mean(F.array().cast("array<double>")).alias("m")).first()
    assert row["m"] is None


def test_one_bad_sample_touches_only_its_box(spark):
    rows = [("c", 0, 8 * r + c, r, c, [float("nan") if (r, c) == (0, 0) else 1.0, 2.0]) for r in range(8) for c in range(8)]
    df = spark.createDataFrame(rows, "chip_id string, well_id int, pixel_id long, prow int, pcol int, x array<double>")
    out = spatial.box_smooth(df, 1).collect()
    assert len(out) == 64 and all(math.isclose(v, w) for r in out for v, w in zip(r["x"], (1.0, 2.0)))
