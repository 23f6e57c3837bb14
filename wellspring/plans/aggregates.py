"""Queries for trace statistics, misclassification buckets and class balance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators import onset as on
from wellspring.operators import quality as ql
from wellspring.operators import spatial as sp
from wellspring.operators.ranking import attach, quantiles
from wellspring.operators.spatial import WELL
from wellspring.plans import query
from wellspring.plans.bindings import CURVES_LONG, TRACES, TRACES_LONG, curves, q6, r6, table, traces
from wellspring.plans.landmark_sql import landmarks as landmark_sql
from wellspring.plans.quality import _cut_sql, _filter_sql, _score_sql
from wellspring.session import durable

STAT_SQL = TRACES_LONG + """, base AS (SELECT pixel_id, stddev_pop(v) AS sd FROM tl WHERE t < 30 GROUP BY 1),
ms AS (SELECT pixel_id, max(abs(v)) AS mx, avg(abs(v)) AS ma FROM tl GROUP BY 1)"""


def trace_stats(df, baseline=30):
    """Per pixel: ranges, slope, minimum, baseline spread, drift and absolute size."""
    ab = lambda: F.transform("x", lambda v: F.abs(v))
    return df.select(
        *[c for c in df.columns if c != "x"],
        ar.dyn_range("x").alias("dyn_range"), ar.net_slope("x").alias("net_slope"), F.array_min("x").alias("trace_min"),
        ar.std(F.slice("x", 1, baseline)).alias("baseline_std"), F.abs(ar.net_slope("x")).alias("abs_drift"),
        F.array_max(ab()).alias("abs_max"), ar.mean(ab()).alias("mean_abs"))


SCOLS = ("dyn_range", "net_slope", "trace_min", "baseline_std", "abs_drift", "abs_max", "mean_abs")


@query("a01_trace_statistics", f"""WITH {STAT_SQL} SELECT pixel_id, {q6('list_max(x) - list_min(x)')} AS dyn_range, {q6('x[64] - x[1]')} AS net_slope, {q6('list_min(x)')} AS trace_min,
{q6('sd')} AS baseline_std, {q6('abs(x[64] - x[1])')} AS abs_drift, {q6('mx')} AS abs_max, {q6('ma')} AS mean_abs FROM traces JOIN base USING (pixel_id) JOIN ms USING (pixel_id)""")
def a01(spark, root):
    return trace_stats(traces(spark, root)).select("pixel_id", *[r6(c).alias(c) for c in SCOLS])


MIS = """mis AS (SELECT l_orderkey AS pixel_id, 's' || CAST(l_orderkey % 5 AS VARCHAR) AS chip, CAST(l_orderkey % 2 AS INTEGER) AS y_true, count(*) AS n_runs,
  count(*) FILTER ((l_quantity >= 25) <> (l_orderkey % 2 = 1)) AS n_wrong, avg(l_quantity) AS qty, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2, 3),
bk AS (SELECT *, CASE WHEN n_wrong = 0 THEN 'always_correct' WHEN n_wrong = n_runs THEN 'always_wrong' ELSE 'sometimes_wrong' END AS bucket FROM mis)"""
BUCKETS = ["always_correct", "sometimes_wrong", "always_wrong"]


def buckets(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", "l_quantity", "l_tax")
    k = F.col("l_orderkey")
    g = li.groupBy(k.alias("pixel_id")).agg(
        F.count("*").alias("n_runs"), F.count_if((F.col("l_quantity") >= 25) != (k % 2 == 1)).alias("n_wrong"), F.avg("l_quantity").alias("qty"), F.avg("l_tax").alias("tax"))
    p = F.col("pixel_id")
    bucket = F.when(F.col("n_wrong") == 0, "always_correct").when(F.col("n_wrong") == F.col("n_runs"), "always_wrong").otherwise("sometimes_wrong")
    return g.withColumns({"chip": F.concat(F.lit("s"), (p % 5).cast("string")), "y_true": (p % 2).cast("int"), "bucket": bucket})


@query("a22_misclassification_buckets", f"WITH {MIS} SELECT pixel_id, n_runs, n_wrong, bucket FROM bk")
def a22(spark, root):
    return buckets(spark, root).select("pixel_id", "n_runs", "n_wrong", "bucket")


@query("a23_bucket_pivot", f"WITH {MIS} SELECT chip, y_true, count(*) AS total, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}, {q6(f'count(*) FILTER (bucket = {chr(39)}{b}{chr(39)}) / CAST(count(*) AS DOUBLE)')} AS {b}_frac" for b in BUCKETS) + " FROM bk GROUP BY 1, 2")
def a23(spark, root):
    w = buckets(spark, root).groupBy("chip", "y_true").pivot("bucket", BUCKETS).count().na.fill(0)
    total = F.col(BUCKETS[0]) + F.col(BUCKETS[1]) + F.col(BUCKETS[2])
    return w.select("chip", "y_true", total.alias("total"), *[c for b in BUCKETS for c in (F.col(b), r6(F.col(b) / total).alias(f"{b}_frac"))])


@query("a24_separability", f"""WITH {MIS}, tall AS (UNPIVOT (SELECT chip, y_true, bucket, qty, tax FROM bk) ON qty, tax INTO NAME stat VALUE v),
s AS (SELECT chip, y_true, stat, median(v) FILTER (bucket = 'always_correct') AS mc, median(v) FILTER (bucket = 'always_wrong') AS mw,
 count(*) FILTER (bucket = 'always_correct') AS nc, count(*) FILTER (bucket = 'always_wrong') AS nw,
 avg(v) FILTER (bucket = 'always_correct') AS ac, avg(v) FILTER (bucket = 'always_wrong') AS aw,
 var_samp(v) FILTER (bucket = 'always_correct') AS vc, var_samp(v) FILTER (bucket = 'always_wrong') AS vw FROM tall GROUP BY 1, 2, 3)
SELECT chip, y_true, stat, {q6('mc')} AS median_correct, {q6('mw')} AS median_wrong, nc AS n_correct, nw AS n_wrong,
{q6('CASE WHEN nc > 1 AND nw > 1 THEN CASE WHEN vc + vw > 0 THEN (aw - ac) / sqrt((vc + vw) / 2.0) ELSE 0 END END')} AS cohens_d FROM s""")
def a24(spark, root):
    b = buckets(spark, root).filter(F.col("bucket") != "sometimes_wrong")
    tall = b.unpivot(["chip", "y_true", "bucket"], ["qty", "tax"], "stat", "v")
    k = ["chip", "y_true", "stat"]
    c, w = F.col("bucket") == "always_correct", F.col("bucket") == "always_wrong"
    pick = lambda cond: F.when(cond, F.col("v"))
    a = tall.groupBy(*k).agg(
        F.count_if(c).alias("n_correct"), F.count_if(w).alias("n_wrong"), F.avg(pick(c)).alias("ac"), F.avg(pick(w)).alias("aw"),
        F.var_samp(pick(c)).alias("vc"), F.var_samp(pick(w)).alias("vw"))
    m = quantiles(tall, [*k, "bucket"], "v", {"m": 0.5}).groupBy(*k).agg(
        F.max(F.when(c, F.col("m"))).alias("mc"), F.max(F.when(w, F.col("m"))).alias("mw"))
    pooled = F.sqrt((F.col("vc") + F.col("vw")) / 2.0)
    d = F.when((F.col("n_correct") > 1) & (F.col("n_wrong") > 1), F.when(pooled > 0, (F.col("aw") - F.col("ac")) / pooled).otherwise(0.0))
    return attach(a, m, k).select(*k, r6("mc").alias("median_correct"), r6("mw").alias("median_wrong"), "n_correct", "n_wrong", r6(d).alias("cohens_d"))


D_METRICS = ("mean", "kth")  # beside the median, which the filter itself uses


def _collateral_sql() -> str:
    extra = "".join(f"""{_score_sql('sv', f'{m}sc', m)}{_cut_sql(f'{m}sc', f'{m}cut', 'pct')},
{m}d AS (SELECT pixel_id, score > cut AS d_{m} FROM {m}sc JOIN {m}cut USING (chip_id, well_id))""" for m in D_METRICS)
    counts = "".join(f""",
count(*) FILTER (coalesce(d_{m}, false)) AS dropped_d_{m}, count(*) FILTER (a OR b OR c OR coalesce(d_{m}, false)) AS dropped_total_{m}""" for m in D_METRICS)
    joins = "".join(f" LEFT JOIN {m}d ON {m}d.pixel_id = fin.pixel_id" for m in D_METRICS)
    return f"""WITH {_filter_sql('pct')}, {MIS}{extra}
SELECT coalesce(bk.bucket, 'no_runs') AS bucket, fin.y, count(*) AS total, count(*) FILTER (a) AS dropped_a, count(*) FILTER (b) AS dropped_b, count(*) FILTER (c) AS dropped_c,
count(*) FILTER (d) AS dropped_d_median, count(*) FILTER (a OR b OR c OR d) AS dropped_total_median{counts}
FROM fin LEFT JOIN bk ON bk.pixel_id = fin.pixel_id{joins} GROUP BY 1, 2"""


@query("a25_recall_collateral", _collateral_sql())
def a25(spark, root):
    f = ql.chip_filter(traces(spark, root), "ABCD", "pct")
    alive = traces(spark, root).join(f.filter("NOT (a OR b OR c)").select("pixel_id"), "pixel_id", "left_semi")
    j = f.join(buckets(spark, root).select("pixel_id", "bucket"), "pixel_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("no_runs")))
    for m in D_METRICS:
        j = j.join(ql.layer_d(alive, "pct", metric=m).select("pixel_id", F.col("d").alias(f"d_{m}")), "pixel_id", "left").withColumn(f"d_{m}", F.coalesce(f"d_{m}", F.lit(False)))
    abc = F.col("a") | F.col("b") | F.col("c")
    each = [("median", F.col("d")), *[(m, F.col(f"d_{m}")) for m in D_METRICS]]
    return j.groupBy("bucket", "y").agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(f"dropped_{c}") for c in "abc"],
        *[e for m, d in each for e in (F.count_if(d).alias(f"dropped_d_{m}"), F.count_if(abc | d).alias(f"dropped_total_{m}"))])


@query("p12_outcome_category", f"""WITH {_filter_sql('pct')}, {MIS} SELECT fin.pixel_id, CASE WHEN bucket = 'always_wrong' AND c THEN 'wrong_dropped_c' WHEN bucket = 'always_wrong' AND (a OR b) THEN 'wrong_dropped_ab'
WHEN bucket = 'always_wrong' THEN 'wrong_kept' WHEN bucket IS NULL THEN 'no_runs' WHEN c THEN 'correct_dropped_c' ELSE 'other' END AS category FROM fin LEFT JOIN bk ON bk.pixel_id = fin.pixel_id""")
def p12(spark, root):
    f = ql.chip_filter(traces(spark, root), "ABC", "pct").join(buckets(spark, root).select("pixel_id", "bucket"), "pixel_id", "left")
    wrong = F.col("bucket") == "always_wrong"
    cat = (F.when(wrong & F.col("c"), "wrong_dropped_c").when(wrong & (F.col("a") | F.col("b")), "wrong_dropped_ab")
           .when(wrong, "wrong_kept").when(F.col("bucket").isNull(), "no_runs").when(F.col("c"), "correct_dropped_c").otherwise("other"))
    return f.select("pixel_id", cat.alias("category"))


CELLS = tuple((k, o) for k in (1.5, 2.0, 3.0) for o in (0, 1, 3, 5))  # fixed values: strictness x smoothing order
BY_METHOD = ("ttp", "cy0", "sdm")


def _ablation_sql() -> str:
    kept = " UNION ALL ".join(f"SELECT {k}::DOUBLE AS k, pixel_id FROM (WITH {_filter_sql('mad', k=k)} SELECT pixel_id FROM kept WHERE keep) z{i}" for i, k in enumerate((1.5, 2.0, 3.0)))
    every = " UNION ALL ".join(f"SELECT k, o, well_id, '{m}' AS method, {m} AS ttp FROM lm JOIN cell USING (pixel_id)" for m in BY_METHOD)
    return f"""WITH {CURVES_LONG}, kp AS MATERIALIZED ({kept}), kc AS MATERIALIZED (SELECT k, cl.* FROM cl JOIN kp ON kp.pixel_id = cl.pixel_id),
px AS MATERIALIZED (SELECT a.k, o, a.chip_id, a.well_id, a.pixel_id, a.t, avg(b.v) AS v FROM kc a JOIN kc b ON b.k = a.k AND b.chip_id = a.chip_id AND b.well_id = a.well_id AND b.t = a.t
  JOIN (SELECT unnest([0, 1, 3, 5]) AS o) g ON abs(b.prow - a.prow) <= o AND abs(b.pcol - a.pcol) <= o GROUP BY 1, 2, 3, 4, 5, 6),
wl AS MATERIALIZED (SELECT k, o, well_id, CAST(k AS VARCHAR) || '|' || CAST(o AS VARCHAR) || '|' || chip_id || '|' || CAST(well_id AS VARCHAR) AS pixel_id, t, avg(v) AS v FROM px GROUP BY 1, 2, 3, 4, 5),
cell AS MATERIALIZED (SELECT DISTINCT k, o, well_id, pixel_id FROM wl), wm AS MATERIALIZED (SELECT pixel_id, t, v FROM wl){landmark_sql('wm', 'lm', 10, 8)},
er AS (SELECT k, o, method, abs(ttp - well_id * 0.4::DOUBLE) AS err FROM ({every}) e),
g AS (SELECT k, o, method, count(err) AS n, {q6('avg(err)')} AS mae, {q6('100 * avg(CASE WHEN err <= 2 THEN 1.0 WHEN err > 2 THEN 0.0 END)')} AS pct_within2 FROM er GROUP BY 1, 2, 3)
SELECT k, CAST(o AS INTEGER) AS smooth_order, method, n, mae, pct_within2, row_number() OVER (PARTITION BY method ORDER BY mae, k, o) = 1 AS is_best FROM g"""


@query("a35_grid_ablation", _ablation_sql())
def a35(spark, root):
    """Strictness x smoothing order x method: error of well times against a per-well reference, and each method's best cell."""
    strict = sorted({k for k, _ in CELLS})
    name = F.concat(F.col("k").cast("string"), F.lit("|"), F.col("chip_id"))  # a chip under one strictness is a chip of its own
    per_k = lambda df: df.withColumn("k", F.explode(F.array(*map(F.lit, strict)))).withColumn("chip_id", name)
    k_of = F.substring_index("chip_id", "|", 1).cast("double")
    kept = durable(ql.kept_traces(per_k(curves(spark, root)), ql.chip_filter(per_k(traces(spark, root)), "ABCD", "mad", k_of)))
    out = None
    for order in sorted({o for _, o in CELLS}):
        m = sp.mean_trace(sp.box_smooth(kept, order), WELL).withColumns({"k": k_of, "smooth_order": F.lit(order)})
        out = m if out is None else out.unionByName(m)
    got = out.select("k", "smooth_order", "well_id", on.landmarks(0.5, span=10)("x").alias("m"))
    tall = got.select("k", "smooth_order", "well_id", *[F.col(f"m.{m}").alias(m) for m in BY_METHOD]).unpivot(["k", "smooth_order", "well_id"], list(BY_METHOD), "method", "ttp")
    err = F.abs(F.col("ttp") - F.col("well_id") * 0.4)
    cells = tall.groupBy("k", "smooth_order", "method").agg(F.count(err).alias("n"), r6(F.avg(err)).alias("mae"), r6(100 * F.avg((err <= 2).cast("double"))).alias("pct_within2"))
    best = Window.partitionBy("method").orderBy(F.col("mae").asc_nulls_last(), "k", "smooth_order")
    return cells.withColumn("is_best", F.row_number().over(best) == 1)


@query("a41_class_balance", f"WITH {TRACES} SELECT chip_id, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, {q6('count(*) FILTER (y = 0) / CAST(count(*) FILTER (y = 1) AS DOUBLE)')} AS pos_weight FROM traces GROUP BY 1")
def a41(spark, root):
    return traces(spark, root).groupBy("chip_id").agg(
        F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"),
        r6(F.try_divide(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1))).alias("pos_weight"))


@query("q10_settle_point", f"""WITH s AS (SELECT user_id AS sid, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
g AS (SELECT sid, CAST(0.995 AS DOUBLE) * avg(value) FILTER (t >= n // 2) AS goal, min(t) / 15.0 AS t0 FROM s GROUP BY 1)
SELECT s.sid, {q6('coalesce(min(t / 15.0) FILTER (value >= goal), 0)')} AS settle, {q6('coalesce(min(t / 15.0 + 1) FILTER (value >= goal), any_value(t0) + 1)')} AS settle_abs FROM s JOIN g ON s.sid = g.sid GROUP BY 1""")
def q10(spark, root):
    from wellspring.plans.bindings import series

    s = series(spark, root).withColumns({"_i": F.col("t"), "tm": F.col("t") / 15.0, "ta": F.col("t") / 15.0 + 1})
    rel = ql.settle_time(s, ["sid"], "tm", "v").select("sid", r6("settle").alias("settle"))
    absolute = ql.settle_time(s, ["sid"], "ta", "v", fallback="first").select("sid", r6("settle").alias("settle_abs"))
    return attach(rel, absolute, ["sid"])
