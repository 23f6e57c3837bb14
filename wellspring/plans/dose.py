"""Queries for well metrics, dose response, classifier metrics and run summaries."""

from pyspark.sql import functions as F

from wellspring.operators import metrics as mt
from wellspring.operators.ranking import attach, quantiles, with_scalars
from wellspring.plans import query
from wellspring.plans.bindings import (
    CLS, PREDICTIONS, RUNS, cls_scores, predictions, q6, r6, runs, table,
)

D = "DOUBLE"
WELLS = PREDICTIONS + """, wm AS (
  SELECT method_id, chip_id, well_id, avg(ttp_pred) AS pm, coalesce(stddev_samp(ttp_pred), 0) AS sd, avg(ttp_true) AS tm,
         any_value(log10_conc) AS lc, count(*) AS n FROM pred WHERE split = 'test' GROUP BY 1, 2, 3),
cm AS (SELECT method_id, lc, avg(pm) AS m FROM wm GROUP BY 1, 2),
ln AS (SELECT method_id, count(*) AS n_conc, regr_slope(m, lc) AS slope, regr_r2(m, lc) AS r2 FROM cm GROUP BY 1)"""
RANKS = """, rk AS (
  SELECT method_id, rank() OVER (PARTITION BY method_id ORDER BY lc) + (count(*) OVER (PARTITION BY method_id, lc) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY method_id ORDER BY pm) + (count(*) OVER (PARTITION BY method_id, pm) - 1) / 2.0 AS ry FROM wm),
sp AS (SELECT method_id, corr(rx, ry) AS rho FROM rk GROUP BY 1)"""


@query("a06_well_aggregate", f"WITH {WELLS} SELECT method_id, chip_id, well_id, {q6('pm')} AS pred_mean, {q6('sd')} AS pred_std, {q6('tm')} AS true_mean, lc AS log10_conc, n AS n_pixels FROM wm")
def a06(spark, root):
    w = mt.well_means(predictions(spark, root))
    return w.select("method_id", "chip_id", "well_id", *[r6(c).alias(c) for c in ("pred_mean", "pred_std", "true_mean")], "log10_conc", "n_pixels")


@query("a07_per_well_mae", f"WITH {WELLS} SELECT method_id, {q6('avg(abs(pm - tm))')} AS per_well_mae FROM wm GROUP BY 1")
def a07(spark, root):
    w = mt.well_means(predictions(spark, root))
    return w.groupBy("method_id").agg(r6(F.avg(F.abs(F.col("pred_mean") - F.col("true_mean")))).alias("per_well_mae"))


@query("a08_dose_slope", f"WITH {WELLS} SELECT method_id, n_conc, {q6('slope')} AS slope, {q6('abs(slope + 3.1336)')} AS slope_proximity FROM ln")
def a08(spark, root):
    line = mt.dose_line(mt.well_means(predictions(spark, root)))
    return line.select("method_id", "n_conc", r6("slope").alias("slope"), r6(F.abs(F.col("slope") - mt.TARGET_SLOPE)).alias("slope_proximity"))


@query("a09_dose_r2", f"WITH {WELLS} SELECT method_id, {q6('r2')} AS r2 FROM ln")
def a09(spark, root):
    return mt.dose_line(mt.well_means(predictions(spark, root))).select("method_id", r6("r2").alias("r2"))


@query("a10_within_well_cov", f"WITH {WELLS} SELECT method_id, {q6('avg(sd / abs(pm)) FILTER (abs(pm) > 0.000001)')} AS within_well_cov FROM wm GROUP BY 1")
def a10(spark, root):
    w = mt.well_means(predictions(spark, root)).filter(F.abs("pred_mean") > 1e-6)
    return w.groupBy("method_id").agg(r6(F.avg(F.col("pred_std") / F.abs("pred_mean"))).alias("within_well_cov"))


@query("a11_spearman_gate", f"WITH {WELLS}{RANKS} SELECT method_id, {q6('rho')} AS rho, rho <= -0.9 AS passes FROM sp")
def a11(spark, root):
    s = mt.spearman(mt.well_means(predictions(spark, root)), ["method_id"], "log10_conc", "pred_mean")
    return s.select("method_id", r6("rho").alias("rho"), (F.col("rho") <= -0.9).alias("passes"))


PORT = WELLS + RANKS + """, port AS (
  SELECT w.method_id, avg(abs(pm - tm)) AS per_well_mae, avg(CASE WHEN abs(pm) > 0.000001 THEN sd / abs(pm) END) AS within_well_cov,
         count(*) AS n_wells, any_value(slope) AS slope, abs(any_value(slope) + 3.1336) AS slope_proximity, any_value(r2) AS r2, any_value(rho) AS rho,
         coalesce(any_value(rho) <= -0.9, false) AS passes
  FROM wm w JOIN ln USING (method_id) JOIN sp USING (method_id) GROUP BY 1)"""
PCOLS = ("per_well_mae", "within_well_cov", "slope", "slope_proximity", "r2", "rho")


@query("a12_metric_portfolio", f"WITH {PORT} SELECT method_id, n_wells, {', '.join(f'{q6(c)} AS {c}' for c in PCOLS)}, passes FROM port")
def a12(spark, root):
    return mt.portfolio(predictions(spark, root)).select("method_id", "n_wells", *[r6(c).alias(c) for c in PCOLS], "passes")


AUC = """, vt AS (SELECT {g}, y_score, count(*) AS cnt, sum(y_true) AS pos FROM {src} GROUP BY ALL),
vr AS (SELECT *, sum(cnt) OVER (PARTITION BY {g} ORDER BY y_score) - cnt + (cnt + 1) / 2.0 AS rk FROM vt),
au AS (SELECT {g}, sum(pos) AS n_pos, sum(cnt - pos) AS n_neg, sum(pos * rk) AS rs,
  coalesce(sum(pos) FILTER (y_score >= 0.5), 0) AS tp, coalesce(sum(cnt - pos) FILTER (y_score >= 0.5), 0) AS fp FROM vr GROUP BY {g})"""


def _rates(tp="tp", fp="fp", tn="tn", fn="fn"):
    pr = f"CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / CAST({tp} + {fp} AS DOUBLE) END"
    rc = f"CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / CAST({tp} + {fn} AS DOUBLE) END"
    f1 = f"CASE WHEN {tp} = 0 THEN 0 ELSE 2 * {tp} / CAST(2 * {tp} + {fp} + {fn} AS DOUBLE) END"
    acc = f"({tp} + {tn}) / CAST({tp} + {fp} + {tn} + {fn} AS DOUBLE)"
    return f"{q6(acc)} AS accuracy, {q6(pr)} AS \"precision\", {q6(rc)} AS recall, {q6(f1)} AS f1"


def _binary_sql(src, g):
    return f"""{AUC.format(src=src, g=g)}, cf AS (SELECT *, n_neg - fp AS tn, n_pos - tp AS fn FROM au)
SELECT {g}, {_rates()}, {q6('(rs - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg)')} AS auroc,
CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM cf"""


RATES = ("accuracy", "precision", "recall", "f1")


@query("a13_binary_metrics", f"WITH {CLS}{_binary_sql('cls', 'method_id, seed')}")
def a13(spark, root):
    m = mt.binary_metrics(cls_scores(spark, root), ["method_id", "seed"])
    return m.select("method_id", "seed", *[r6(c).alias(c) for c in (*RATES, "auroc")], "n_pos", "n_neg")


DOCS = """dl AS (SELECT d.lang AS method_id, l.quality AS y_true, least(d.n_chars / 4000.0, CAST(1 AS DOUBLE)) AS y_score
  FROM documents d JOIN labels l USING (doc_id))"""


@query("a13_document_quality_metrics", f"WITH {DOCS}{_binary_sql('dl', 'method_id')}")
def a13_docs(spark, root):
    d = table(spark, root, "documents").select("doc_id", "lang", "n_chars").join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id")
    s = d.select(F.col("lang").alias("method_id"), F.col("quality").alias("y_true"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("y_score"))
    m = mt.binary_metrics(s, ["method_id"])
    return m.select("method_id", *[r6(c).alias(c) for c in (*RATES, "auroc")], "n_pos", "n_neg")


WV = """, wv AS (SELECT method_id, {s} chip_id, well_id, avg(CASE WHEN y_score >= 0.5 THEN 1.0 ELSE 0.0 END) AS share,
  {lab} AS well_true FROM cls GROUP BY ALL),
wp AS (SELECT *, CASE WHEN share {op} 0.5 THEN 1 ELSE 0 END AS well_pred FROM wv),
cf AS (SELECT method_id, {s} count(*) FILTER (well_true = 1 AND well_pred = 1) AS tp, count(*) FILTER (well_true <> 1 AND well_pred = 1) AS fp,
  count(*) FILTER (well_true <> 1 AND well_pred <> 1) AS tn, count(*) FILTER (well_true = 1 AND well_pred <> 1) AS fn FROM wp GROUP BY ALL)"""
FIRST = "arg_min(y_true, (pixel_id, y_score, y_true))"


@query("a14_well_majority_vote", f"WITH {CLS}{WV.format(s='', lab=FIRST, op='>')} SELECT method_id, tp + fp + tn + fn AS n_wells, {_rates()} FROM cf")
def a14(spark, root):
    m = mt.vote_metrics(cls_scores(spark, root), ["method_id"])
    return m.select("method_id", "n_wells", *[r6(c).alias(c) for c in RATES])


@query("a15_seed_metrics", f"""WITH {CLS}{WV.format(s='seed,', lab='max(y_true)', op='>=')},
px AS (SELECT method_id, seed, count(*) FILTER (y_true = 1 AND y_score >= 0.5) AS tp, count(*) FILTER (y_true = 0 AND y_score >= 0.5) AS fp,
  count(*) FILTER (y_true = 0 AND y_score < 0.5) AS tn, count(*) FILTER (y_true = 1 AND y_score < 0.5) AS fn FROM cls GROUP BY 1, 2)
SELECT px.method_id, px.seed, px.tp, px.fp, px.tn, px.fn, {_rates('px.tp', 'px.fp', 'px.tn', 'px.fn').replace('AS accuracy', 'AS acc_pixel')},
 cf.tp + cf.fp + cf.tn + cf.fn AS n_wells, {q6('(cf.tp + cf.tn) / CAST(cf.tp + cf.fp + cf.tn + cf.fn AS DOUBLE)')} AS acc_well
FROM px JOIN cf ON px.method_id = cf.method_id AND px.seed = cf.seed""")
def a15(spark, root):
    k = ["method_id", "seed"]
    c = cls_scores(spark, root).withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
    cm = mt.confusion(c, k, "y_true", "y_pred")
    px = cm.select(*k, "tp", "fp", "tn", "fn", *[v.alias(n) for n, v in mt._rates(*[F.col(x) for x in ("tp", "fp", "tn", "fn")]).items()])
    w = mt.vote_metrics(c, k, inclusive=True, label="max").select(*k, "n_wells", F.col("accuracy").alias("acc_well"))
    out = attach(px, w, k)
    return out.select(*k, "tp", "fp", "tn", "fn", r6("accuracy").alias("acc_pixel"), *[r6(x).alias(x) for x in RATES[1:]], "n_wells", r6("acc_well").alias("acc_well"))


@query("a16_confusion_counts", f"""WITH {CLS}{WV.format(s='', lab=FIRST, op='>')}
SELECT 'pixel' AS unit, method_id, y_true, CASE WHEN y_score >= 0.5 THEN 1 ELSE 0 END AS y_pred, count(*) AS n FROM cls GROUP BY ALL
UNION ALL SELECT 'well', method_id, well_true, well_pred, count(*) FROM wp GROUP BY ALL""")
def a16(spark, root):
    c = cls_scores(spark, root)
    px = c.select(F.lit("pixel").alias("unit"), "method_id", "y_true", (F.col("y_score") >= 0.5).cast("int").alias("y_pred"))
    w = mt.well_votes(c, ["method_id"]).select(F.lit("well").alias("unit"), "method_id", F.col("well_true").alias("y_true"), F.col("well_pred").alias("y_pred"))
    return px.unionByName(w).groupBy("unit", "method_id", "y_true", "y_pred").agg(F.count("*").alias("n"))


NULLED = PREDICTIONS + ", pn AS (SELECT *, CASE WHEN pixel_id % 7 <> 0 THEN ttp_pred END AS tp FROM pred)"


def _nulled(spark, root):
    return predictions(spark, root).withColumn("ttp_pred", F.when(F.col("pixel_id") % 7 != 0, F.col("ttp_pred")))


@query("a17_regression_metrics", f"""WITH {NULLED}, b AS (SELECT method_id, avg(ttp_true) AS m FROM pn WHERE tp IS NOT NULL GROUP BY 1)
SELECT p.method_id, count(*) AS n_total, count(tp) AS n, count(*) - count(tp) AS n_nan, {q6('avg(abs(tp - ttp_true))')} AS mae,
{q6('sqrt(avg((tp - ttp_true) * (tp - ttp_true)))')} AS rmse,
{q6('1 - sum((tp - ttp_true) * (tp - ttp_true)) / sum((ttp_true - m) * (ttp_true - m)) FILTER (tp IS NOT NULL)')} AS r2,
{q6('avg(abs(ttp_true - m)) FILTER (tp IS NOT NULL)')} AS mae_mean FROM pn p JOIN b ON p.method_id = b.method_id GROUP BY 1""")
def a17(spark, root):
    m = mt.regression_metrics(_nulled(spark, root), ["method_id"])
    return m.select("method_id", "n_total", "n", "n_nan", *[r6(c).alias(c) for c in ("mae", "rmse", "r2", "mae_mean")])


@query("a18_well_mean_skip_null", f"WITH {NULLED} SELECT method_id, chip_id, well_id, {q6('avg(tp)')} AS pred FROM pn GROUP BY 1, 2, 3")
def a18(spark, root):
    return _nulled(spark, root).groupBy("method_id", "chip_id", "well_id").agg(r6(F.avg("ttp_pred")).alias("pred"))


@query("a19_dose_response_pearson", f"""WITH {PREDICTIONS}, c AS (SELECT method_id, chip_id, log10_conc, avg(ttp_pred) AS m FROM pred GROUP BY 1, 2, 3)
SELECT method_id, {q6('corr(log10_conc, m)')} AS r, {q6('corr(log10_conc, m) ** 2')} AS r2, {q6('regr_slope(m, log10_conc)')} AS slope FROM c GROUP BY 1""")
def a19(spark, root):
    c = predictions(spark, root).groupBy("method_id", "chip_id", "log10_conc").agg(F.avg("ttp_pred").alias("m"))
    r = mt.correlation("log10_conc", "m")
    return c.groupBy("method_id").agg(r6(r).alias("r"), r6(r * r).alias("r2"), r6(F.regr_slope("m", "log10_conc")).alias("slope"))


WIDE = """wide AS (SELECT c_nationkey AS chip, c_mktsegment AS landmark, avg(c_acctbal) AS ttp FROM customer GROUP BY 1, 2)"""


@query("a19_landmark_columns_pearson", f"""WITH {WIDE} SELECT landmark, {q6('corr(chip, ttp)')} AS r, {q6('regr_slope(ttp, chip)')} AS slope, count(*) AS n FROM wide GROUP BY 1""")
def a19_wide(spark, root):
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = table(spark, root, "customer").groupBy("c_nationkey").pivot("c_mktsegment", segs).agg(F.avg("c_acctbal"))
    tall = wide.unpivot("c_nationkey", segs, "landmark", "ttp").filter("ttp IS NOT NULL")
    return tall.groupBy("landmark").agg(
        r6(mt.correlation("c_nationkey", "ttp")).alias("r"), r6(F.regr_slope("ttp", "c_nationkey")).alias("slope"), F.count("*").alias("n"))


@query("a20_plate_replicates", f"""WITH p AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS label, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS cq,
 CASE WHEN l_linenumber = 1 THEN l_quantity * 2 END AS vendor_mean, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)
SELECT label, count(*) AS n_rows, count(cq) AS n_cq, {q6('coalesce(arg_min(vendor_mean, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) FILTER (vendor_mean IS NOT NULL), avg(cq))')} AS cq_mean,
{q6('avg(cq) * 0.5')} AS minutes FROM p GROUP BY 1""")
def a20(spark, root):
    li = table(spark, root, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("label"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("cq"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 2).alias("vendor_mean"),
        F.when(F.col("l_linenumber") == 1, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).alias("ord"))
    return li.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.count("cq").alias("n_cq"),
        r6(F.coalesce(F.min_by("vendor_mean", "ord"), F.avg("cq"))).alias("cq_mean"),
        r6(F.avg("cq") * 0.5).alias("minutes"))


CAL = """cal AS (SELECT 'all' AS source, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 4 AS lc, o_totalprice / CAST(10000 AS DOUBLE) - CAST(o_custkey % 20 AS DOUBLE) AS off FROM orders
  WHERE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 4 <> 9)"""


def _offsets(spark, root):
    o = table(spark, root, "orders").select(
        (F.substring("o_orderpriority", 1, 1).cast("int") + 4).alias("lc"),
        (F.col("o_totalprice") / 10000.0 - (F.col("o_custkey") % 20)).alias("off"))
    return o.filter(~F.col("lc").isin(9))


@query("a21_offset_calibration", f"""WITH {CAL}, f AS (SELECT regr_slope(off, lc) AS a, regr_intercept(off, lc) AS b, regr_r2(off, lc) AS r2, count(*) AS n FROM cal)
SELECT {q6('any_value(a)')} AS a, {q6('any_value(b)')} AS b, {q6('any_value(r2)')} AS r2, any_value(n) AS n_points,
{q6('stddev_pop(off - (a * lc + b))')} AS residual_std FROM cal, f""")
def a21(spark, root):
    o = _offsets(spark, root)
    fit = o.agg(F.regr_slope("off", "lc").alias("a"), F.regr_intercept("off", "lc").alias("b"), F.regr_r2("off", "lc").alias("r2"), F.count("*").alias("n"))
    both = with_scalars(o, fit)
    return both.agg(
        r6(F.max("a")).alias("a"), r6(F.max("b")).alias("b"), r6(F.max("r2")).alias("r2"), F.max("n").alias("n_points"),
        r6(F.stddev_pop(F.col("off") - (F.col("a") * F.col("lc") + F.col("b")))).alias("residual_std"))


@query("a21_offset_by_concentration", f"WITH {CAL} SELECT lc, {q6('avg(off)')} AS mean_offset, {q6('stddev_pop(off)')} AS std_offset, count(*) AS n FROM cal GROUP BY 1")
def a21_conc(spark, root):
    return _offsets(spark, root).groupBy("lc").agg(r6(F.avg("off")).alias("mean_offset"), r6(F.stddev_pop("off")).alias("std_offset"), F.count("*").alias("n"))


# --- run summaries -----------------------------------------------------------------------
LAST = RUNS + """, fin AS (SELECT experiment, model, seed, arg_max(loss, epoch) AS final_loss, count(*) AS n_epochs FROM runs GROUP BY 1, 2, 3)"""


def _final(spark, root):
    return runs(spark, root).groupBy("experiment", "model", "seed").agg(
        F.max_by("loss", "epoch").alias("final_loss"), F.count("*").alias("n_epochs"))


@query("a29_last_epoch_value", f"WITH {LAST} SELECT experiment, model, seed, final_loss, n_epochs FROM fin")
def a29(spark, root):
    return _final(spark, root)


@query("a27_seed_aggregate", f"WITH {LAST} SELECT experiment, model, {q6('avg(final_loss)')} AS mean_loss, {q6('stddev_samp(final_loss)')} AS std_loss, count(*) AS n_seeds FROM fin GROUP BY 1, 2")
def a27(spark, root):
    return _final(spark, root).groupBy("experiment", "model").agg(
        r6(F.avg("final_loss")).alias("mean_loss"), r6(F.stddev_samp("final_loss")).alias("std_loss"), F.count("*").alias("n_seeds"))


BEST3 = LAST + """, b3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY final_loss, seed) AS rn FROM fin) z WHERE rn <= 3)"""


def best_seeds(df, n=3):
    """The n lowest final losses per (experiment, model), ties by seed; all when there are fewer."""
    from pyspark.sql import Window

    w = Window.partitionBy("experiment", "model").orderBy("final_loss", "seed")
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


@query("a28_best_three_seeds", f"""WITH {BEST3} SELECT experiment, model, {q6('avg(final_loss)')} AS mean_loss, {q6('stddev_samp(final_loss)')} AS std_loss, count(*) AS n_used,
string_agg(CAST(seed AS VARCHAR), ',' ORDER BY rn) AS picked FROM b3 GROUP BY 1, 2""")
def a28(spark, root):
    b = best_seeds(_final(spark, root))
    picked = F.array_sort(F.collect_list(F.struct("rn", "seed")))  # at most three entries
    return b.groupBy("experiment", "model").agg(
        r6(F.avg("final_loss")).alias("mean_loss"), r6(F.stddev_samp("final_loss")).alias("std_loss"), F.count("*").alias("n_used"),
        F.array_join(F.transform(picked, lambda s: s["seed"].cast("string")), ",").alias("picked"))


CELL = ("pixel_mae", "pixel_rmse", "pixel_r2", "well_mae", "well_r2", "well_pearson2", "baseline_mae")


@query("a47_best_cell_summary", f"""WITH {PREDICTIONS}, run AS (SELECT *, regexp_extract(method_id, '^(fam[0-9]+)', 1) AS model, CAST(regexp_extract(method_id, 'seed([0-9]+)', 1) AS INTEGER) AS seed FROM pred),
val AS (SELECT model, seed, avg(abs(ttp_pred - ttp_true)) AS val_error FROM run WHERE split = 'train' GROUP BY 1, 2),
px AS (SELECT *, avg(ttp_true) OVER (PARTITION BY model, seed) AS m FROM run WHERE split = 'test'),
pm AS (SELECT model, seed, avg(abs(ttp_pred - ttp_true)) AS pixel_mae, sqrt(avg((ttp_pred - ttp_true) ** 2)) AS pixel_rmse, 1 - sum((ttp_pred - ttp_true) ** 2) / nullif(sum((ttp_true - m) ** 2), 0) AS pixel_r2, avg(abs(ttp_true - m)) AS baseline_mae FROM px GROUP BY 1, 2),
w0 AS (SELECT model, seed, chip_id, well_id, avg(ttp_pred) AS p, avg(ttp_true) AS t FROM px GROUP BY ALL), w1 AS (SELECT *, avg(t) OVER (PARTITION BY model, seed) AS m FROM w0),
wm AS (SELECT model, seed, avg(abs(p - t)) AS well_mae, 1 - sum((p - t) ** 2) / nullif(sum((t - m) ** 2), 0) AS well_r2, corr(p, t) ** 2 AS well_pearson2 FROM w1 GROUP BY 1, 2),
b3 AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY val_error, seed) AS rn FROM val JOIN pm USING (model, seed) JOIN wm USING (model, seed))
SELECT model, {', '.join(f'{q6(f"avg({c})")} AS {c}' for c in CELL)}, count(*) AS n_picked, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY rn) AS picked,
  arg_min(seed, rn) AS best_seed, {q6('max(well_pearson2) FILTER (rn = 1)')} AS best_pearson2 FROM b3 WHERE rn <= 3 GROUP BY 1""")
def a47(spark, root):
    """Seven test metrics per model, averaged over its three runs of least validation error, and the best run's per-well Pearson squared."""
    k = ["model", "seed"]
    rs = predictions(spark, root).withColumns({"model": F.regexp_extract("method_id", "^(fam[0-9]+)", 1), "seed": F.regexp_extract("method_id", "seed([0-9]+)", 1).cast("int")})
    val = rs.filter("split = 'train'").groupBy(*k).agg(F.avg(F.abs(F.col("ttp_pred") - F.col("ttp_true"))).alias("final_loss"))
    test = rs.filter("split = 'test'")
    pixel = mt.regression_metrics(test, k).select(*k, F.col("mae").alias("pixel_mae"), F.col("rmse").alias("pixel_rmse"), F.col("r2").alias("pixel_r2"), F.col("mae_mean").alias("baseline_mae"))
    wells = test.groupBy(*k, "chip_id", "well_id").agg(F.avg("ttp_pred").alias("ttp_pred"), F.avg("ttp_true").alias("ttp_true"))
    well = mt.regression_metrics(wells, k).select(*k, F.col("mae").alias("well_mae"), F.col("r2").alias("well_r2"))
    line = wells.groupBy(*k).agg(F.pow(mt.correlation("ttp_pred", "ttp_true"), 2).alias("well_pearson2"))
    every = val.join(pixel, k).join(well, k).join(line, k).withColumn("experiment", F.lit(""))
    best = best_seeds(every)
    picked = F.array_sort(F.collect_list(F.struct("rn", "seed")))  # at most three entries
    return best.groupBy("model").agg(
        *[r6(F.avg(c)).alias(c) for c in CELL], F.count("*").alias("n_picked"), F.array_join(F.transform(picked, lambda q: q["seed"].cast("string")), ",").alias("picked"),
        F.min_by("seed", "rn").alias("best_seed"), r6(F.max(F.when(F.col("rn") == 1, F.col("well_pearson2")))).alias("best_pearson2"))


MED = PORT + """, cfg AS (SELECT *, regexp_replace(method_id, '_seed[0-9]+.*$', '') AS config FROM port),
md AS (SELECT config, median(per_well_mae) AS mae, median(slope_proximity) AS dslope, median(r2) AS r2, median(within_well_cov) AS cov, count(*) FILTER (passes) AS n_pass, count(*) AS n_runs FROM cfg GROUP BY 1)"""


def _config_medians(spark, root):
    p = mt.portfolio(predictions(spark, root)).withColumn("config", F.regexp_replace("method_id", "_seed[0-9]+.*$", ""))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("v")) for n, c in (
        ("mae", "per_well_mae"), ("dslope", "slope_proximity"), ("r2", "r2"), ("cov", "within_well_cov"))])
    med = quantiles(p.select("config", F.inline(pairs)), ["config", "metric"], "v", {"med": 0.5})
    wide = med.groupBy("config").agg(*[F.max(F.when(F.col("metric") == m, F.col("med"))).alias(m) for m in ("mae", "dslope", "r2", "cov")])
    return attach(wide, p.groupBy("config").agg(F.count_if("passes").alias("n_pass"), F.count("*").alias("n_runs")), ["config"])


@query("a30_config_medians", f"WITH {MED} SELECT config, {', '.join(f'{q6(c)} AS {c}' for c in ('mae', 'dslope', 'r2', 'cov'))}, n_pass, n_runs FROM md")
def a30(spark, root):
    return _config_medians(spark, root).select("config", *[r6(c).alias(c) for c in ("mae", "dslope", "r2", "cov")], "n_pass", "n_runs")


@query("o06_config_ranking", f"""WITH {MED} SELECT * FROM (SELECT config, {q6('mae')} AS mae, n_pass,
 CAST(row_number() OVER (ORDER BY mae ASC NULLS LAST, dslope ASC NULLS LAST, r2 DESC NULLS LAST, cov ASC NULLS LAST, config) AS INTEGER) AS place FROM md) z WHERE place <= 5""")
def o06(spark, root):
    m = _config_medians(spark, root)
    # rows are configs after aggregation; the top five need one small final sort
    top = m.orderBy(F.asc_nulls_last("mae"), F.asc_nulls_last("dslope"), F.desc_nulls_last("r2"), F.asc_nulls_last("cov"), "config").limit(5)
    from pyspark.sql import Window

    w = Window.orderBy(F.asc_nulls_last("mae"), F.asc_nulls_last("dslope"), F.desc_nulls_last("r2"), F.asc_nulls_last("cov"), "config")
    return top.withColumn("place", F.row_number().over(w)).select("config", r6("mae").alias("mae"), "n_pass", "place")


@query("o07_best_per_family", f"""WITH {PORT}, fm AS (SELECT *, regexp_extract(method_id, '^(fam[0-9]+)', 1) AS family FROM port)
SELECT family, method_id, {q6('per_well_mae')} AS per_well_mae FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY per_well_mae, method_id) AS rn FROM fm) z WHERE rn = 1""")
def o07(spark, root):
    p = mt.portfolio(predictions(spark, root)).withColumn("family", F.regexp_extract("method_id", "^(fam[0-9]+)", 1))
    best = F.min(F.struct("per_well_mae", "method_id")).alias("b")
    return p.groupBy("family").agg(best).select("family", F.col("b.method_id").alias("method_id"), r6("b.per_well_mae").alias("per_well_mae"))


@query("o08_best_epoch", f"WITH {RUNS} SELECT experiment, model, seed, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_loss FROM runs GROUP BY 1, 2, 3")
def o08(spark, root):
    return runs(spark, root).groupBy("experiment", "model", "seed").agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("best_loss"))


@query("a32_well_error_table", f"""WITH {PREDICTIONS} SELECT method_id, chip_id, well_id, {q6('median(ttp_pred)')} AS med_pred,
{q6('median(ttp_pred) - any_value(ttp_true)')} AS signed_err, {q6('median(abs(ttp_pred - ttp_true))')} AS med_abs_err FROM pred GROUP BY 1, 2, 3""")
def a32(spark, root):
    k = ["method_id", "chip_id", "well_id"]
    p = predictions(spark, root).withColumn("ae", F.abs(F.col("ttp_pred") - F.col("ttp_true")))
    a = quantiles(p, k, "ttp_pred", {"med_pred": 0.5}).drop("n")
    b = quantiles(p, k, "ae", {"med_abs_err": 0.5}).drop("n")
    truth = p.groupBy(*k).agg(F.max("ttp_true").alias("tt"))
    out = attach(attach(a, b, k), truth, k)
    return out.select(*k, r6("med_pred").alias("med_pred"), r6(F.col("med_pred") - F.col("tt")).alias("signed_err"), r6("med_abs_err").alias("med_abs_err"))


@query("a33_shift_summary", f"""WITH {PREDICTIONS} SELECT chip_id, log10_conc, count(*) AS n, min(ttp_true) AS plate, {q6('avg(ttp_pred - ttp_true)')} AS mean_shift,
{q6('stddev_samp(ttp_pred - ttp_true)')} AS std_shift, {q6('min(ttp_pred - ttp_true)')} AS min_shift, {q6('max(ttp_pred - ttp_true)')} AS max_shift FROM pred GROUP BY 1, 2""")
def a33(spark, root):
    p = predictions(spark, root).withColumn("s", F.col("ttp_pred") - F.col("ttp_true"))
    return p.groupBy("chip_id", "log10_conc").agg(
        F.count("*").alias("n"), F.min("ttp_true").alias("plate"), r6(F.avg("s")).alias("mean_shift"),
        r6(F.stddev_samp("s")).alias("std_shift"), r6(F.min("s")).alias("min_shift"), r6(F.max("s")).alias("max_shift"))


@query("a34_ablation_table", f"""WITH {PREDICTIONS}, s AS (SELECT regexp_extract(method_id, '^(fam[0-9]+)', 1) AS state, regexp_extract(method_id, 'seed([0-9]+)', 1) AS rule, abs(ttp_pred - ttp_true) AS e FROM pred)
SELECT rule, {', '.join(f"{q6(f'avg(e) FILTER (state = {chr(39)}fam{i}{chr(39)})')} AS mae_fam{i}, count(*) FILTER (state = 'fam{i}') AS n_fam{i}" for i in range(3))} FROM s GROUP BY 1""")
def a34(spark, root):
    p = predictions(spark, root).select(
        F.regexp_extract("method_id", "^(fam[0-9]+)", 1).alias("state"), F.regexp_extract("method_id", "seed([0-9]+)", 1).alias("rule"),
        F.abs(F.col("ttp_pred") - F.col("ttp_true")).alias("e"))
    wide = p.groupBy("rule").pivot("state", ["fam0", "fam1", "fam2"]).agg(r6(F.avg("e")).alias("mae"), F.count("e").alias("n"))
    return wide.select("rule", *[F.col(f"fam{i}_{a}").alias(f"{a}_fam{i}") for i in range(3) for a in ("mae", "n")])


@query("a36_rule_validation", f"""WITH {PREDICTIONS} SELECT method_id, count(*) AS n, {q6('avg(abs(ttp_pred - ttp_true))')} AS mae, {q6('median(abs(ttp_pred - ttp_true))')} AS med_abs,
{q6('avg(ttp_pred - ttp_true)')} AS bias, {q6('100.0 * avg(CASE WHEN abs(ttp_pred - ttp_true) <= 2 THEN 1.0 ELSE 0.0 END)')} AS pct_within2 FROM pred GROUP BY 1""")
def a36(spark, root):
    p = predictions(spark, root).withColumn("d", F.col("ttp_pred") - F.col("ttp_true")).withColumn("ad", F.abs("d"))
    a = p.groupBy("method_id").agg(
        F.count("*").alias("n"), r6(F.avg("ad")).alias("mae"), r6(F.avg("d")).alias("bias"),
        r6(100.0 * F.avg((F.col("ad") <= 2).cast("double"))).alias("pct_within2"))
    m = quantiles(p, ["method_id"], "ad", {"m": 0.5}).select("method_id", r6("m").alias("med_abs"))
    return attach(a, m, ["method_id"])


@query("a38_median_of_medians", f"""WITH {PREDICTIONS}, s AS (SELECT regexp_extract(method_id, '^(fam[0-9]+)', 1) AS family, method_id, chip_id, well_id, median(ttp_pred) AS m FROM pred GROUP BY ALL)
SELECT family, chip_id, well_id, {q6('median(m)')} AS ttp FROM s GROUP BY 1, 2, 3""")
def a38(spark, root):
    p = predictions(spark, root).withColumn("family", F.regexp_extract("method_id", "^(fam[0-9]+)", 1))
    m = quantiles(p, ["family", "method_id", "chip_id", "well_id"], "ttp_pred", {"m": 0.5})
    out = quantiles(m, ["family", "chip_id", "well_id"], "m", {"ttp": 0.5})
    return out.select("family", "chip_id", "well_id", r6("ttp").alias("ttp"))


@query("a44_reference_comparison", f"""WITH {PREDICTIONS}, c AS (SELECT chip_id, log10_conc, avg(ttp_pred) FILTER (well_id < 8) AS m, stddev_pop(ttp_pred) FILTER (well_id < 8) / sqrt(count(*) FILTER (well_id < 8)) AS se FROM pred GROUP BY 1, 2),
ref AS (SELECT CAST(r_regionkey + 5 AS DOUBLE) AS lc, 20.0 - 2.5 * r_regionkey AS ref_a, 18.0 - 2.0 * r_regionkey AS ref_b FROM region),
sl AS (SELECT chip_id, regr_slope(m, log10_conc) AS slope FROM c GROUP BY 1)
SELECT c.chip_id, log10_conc, {q6('m')} AS mean_ttp, {q6('se')} AS se, {q6('m - ref_a')} AS off_a, {q6('m - ref_b')} AS off_b, {q6('slope')} AS slope
FROM c JOIN sl ON sl.chip_id = c.chip_id LEFT JOIN ref ON log10_conc = lc""")
def a44(spark, root):
    keep = F.when(F.col("well_id") < 8, F.col("ttp_pred"))
    c = predictions(spark, root).groupBy("chip_id", "log10_conc").agg(
        F.avg(keep).alias("m"), F.when(F.count(keep) > 0, F.stddev_pop(keep) / F.sqrt(F.count(keep))).alias("se"))
    k = F.col("r_regionkey")
    ref = table(spark, root, "region").select((k + 5).cast("double").alias("log10_conc"), (20.0 - 2.5 * k).alias("ref_a"), (18.0 - 2.0 * k).alias("ref_b"))
    slope = c.groupBy("chip_id").agg(F.regr_slope("m", "log10_conc").alias("slope"))  # minutes per decade over the concentrations with a mean
    return attach(c, slope, ["chip_id"]).join(ref, "log10_conc", "left").select(
        "chip_id", "log10_conc", r6("m").alias("mean_ttp"), r6("se").alias("se"), r6(F.col("m") - F.col("ref_a")).alias("off_a"), r6(F.col("m") - F.col("ref_b")).alias("off_b"),
        r6("slope").alias("slope"))


PEAK = """pk AS (SELECT c_nationkey AS chip, CAST(c_custkey % 6 AS INTEGER) AS well, CASE WHEN count(*) > 3 THEN avg(c_acctbal) / 400 END AS peak, 10.0 + c_nationkey / 10.0 AS settle FROM customer GROUP BY ALL),
fl AS (SELECT *, coalesce(peak >= 12 AND peak >= settle + 1, false) AS amp FROM pk)"""


def _peaks(spark, root):
    p = table(spark, root, "customer").groupBy(F.col("c_nationkey").alias("chip"), (F.col("c_custkey") % 6).cast("int").alias("well")).agg(
        F.when(F.count("*") > 3, F.avg("c_acctbal") / 400).alias("peak"))
    p = p.withColumn("settle", 10.0 + F.col("chip") / 10.0)
    return p.withColumn("amp", F.coalesce((F.col("peak") >= 12) & (F.col("peak") >= F.col("settle") + 1), F.lit(False)))


@query("a45_amplifying_wells", f"WITH {PEAK} SELECT chip, {', '.join(f'{q6(f'max(peak) FILTER (well = {w})')} AS peak_{w}, coalesce(bool_or(amp) FILTER (well = {w}), false) AS amp_{w}' for w in range(6))} FROM fl GROUP BY 1")
def a45(spark, root):
    w = _peaks(spark, root).groupBy("chip").pivot("well", list(range(6))).agg(r6(F.max("peak")).alias("p"), F.max("amp").alias("a"))
    return w.select("chip", *[c for i in range(6) for c in (F.col(f"{i}_p").alias(f"peak_{i}"), F.coalesce(f"{i}_a", F.lit(False)).alias(f"amp_{i}"))])


OVERRIDE = ", ov AS (SELECT n_nationkey AS chip, unnest([1, CAST(2 + n_nationkey % 4 AS INTEGER)]) AS well FROM nation WHERE n_nationkey % 3 = 0)"


@query("a46_strategy_comparison", f"""WITH {PEAK}{OVERRIDE}, ok AS (SELECT fl.*, ov.well IS NOT NULL AS listed, max(CASE WHEN o.chip IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY fl.chip) = 1 AS has_list
  FROM fl LEFT JOIN ov ON ov.chip = fl.chip AND ov.well = fl.well LEFT JOIN (SELECT DISTINCT chip FROM ov) o ON o.chip = fl.chip)
SELECT chip, {q6('avg(peak) FILTER (well < 4)')} AS mean03, {q6('median(peak) FILTER (well < 4)')} AS median03,
{q6('avg(peak) FILTER (amp)')} AS mean_flagged, {q6('avg(peak) FILTER (well < 4) - 15')} AS offset_mean, {q6('avg(peak) FILTER (amp) - 15')} AS offset_flagged,
{q6('avg(peak) FILTER (CASE WHEN has_list THEN listed ELSE amp END)')} AS mean_override, {q6('avg(peak) FILTER (CASE WHEN has_list THEN listed ELSE amp END) - 15')} AS offset_override FROM ok GROUP BY 1""")
def a46(spark, root):
    """A chip with a list of wells takes the listed ones in place of the flagged ones."""
    n = F.col("n_nationkey")
    listed = table(spark, root, "nation").filter(n % 3 == 0).select(n.alias("chip"), F.explode(F.array(F.lit(1), (2 + n % 4).cast("int"))).alias("well"))
    p = _peaks(spark, root).join(listed.withColumn("listed", F.lit(True)), ["chip", "well"], "left")
    p = attach(p, listed.groupBy("chip").agg(F.lit(True).alias("has_list")), ["chip"], "left")
    low = F.when(F.col("well") < 4, F.col("peak"))
    flagged = F.when(F.col("amp"), F.col("peak"))
    chosen = F.when(F.when(F.col("has_list"), F.coalesce("listed", F.lit(False))).otherwise(F.col("amp")), F.col("peak"))
    # six wells per chip at most by construction, so the exact percentile holds six values
    return p.groupBy("chip").agg(
        r6(F.avg(low)).alias("mean03"), r6(F.percentile(low, F.lit(0.5))).alias("median03"), r6(F.avg(flagged)).alias("mean_flagged"), r6(F.avg(low) - 15).alias("offset_mean"),
        r6(F.avg(flagged) - 15).alias("offset_flagged"), r6(F.avg(chosen)).alias("mean_override"), r6(F.avg(chosen) - 15).alias("offset_override"))


@query("a43_landmark_wide_table", f"WITH {PEAK} SELECT chip, {', '.join(f'coalesce(printf({chr(39)}%.2f{chr(39)}, round(max(peak) FILTER (well = {w}), 2)), {chr(39)}NaN{chr(39)}) AS ttp_well{w}' for w in range(6))} FROM fl GROUP BY 1")
def a43(spark, root):
    w = _peaks(spark, root).groupBy("chip").pivot("well", list(range(6))).agg(F.round(F.max("peak"), 2))
    return w.select("chip", *[F.when(F.col(str(i)).isNull(), "NaN").otherwise(F.format_string("%.2f", F.col(str(i)))).alias(f"ttp_well{i}") for i in range(6)])


@query("s11_scoreboard_upsert", f"""WITH {PORT} SELECT method_id, {q6('per_well_mae')} AS per_well_mae, 'new' AS origin FROM port WHERE method_id LIKE 'fam0%' OR method_id LIKE 'fam1%'
UNION ALL SELECT method_id, {q6('per_well_mae + 1')}, 'old' FROM port WHERE method_id NOT LIKE 'fam0%' AND method_id NOT LIKE 'fam1%'""")
def s11(spark, root):
    p = mt.portfolio(predictions(spark, root)).select("method_id", "per_well_mae")
    old = p.withColumn("per_well_mae", F.col("per_well_mae") + 1).withColumn("origin", F.lit("old"))
    new = p.filter("method_id LIKE 'fam0%' OR method_id LIKE 'fam1%'").withColumn("origin", F.lit("new"))
    return mt.upsert(old, new).select("method_id", r6("per_well_mae").alias("per_well_mae"), "origin")
