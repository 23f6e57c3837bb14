"""Queries for onset extractors, plate-curve features and sigmoid fits."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.functions import kernels as kn
from wellspring.operators import onset as on
from wellspring.operators import spatial as sp
from wellspring.operators.spatial import WELL
from wellspring.plans import query
from wellspring.plans.bindings import CURVES_LONG, PREDICTIONS, TRACES_LONG, curves, predictions, q6, r6, table, traces
from wellspring.plans.landmark_sql import anchored as anchored_sql
from wellspring.plans.landmark_sql import grad as _grad
from wellspring.plans.landmark_sql import landmarks as landmark_sql
from wellspring.plans.windows import _ma, _savgol_sql
from wellspring.session import spread

# half a minute, and 0.3 minutes, as the first sample not before it
LANDMARK_SQL = f"WITH {CURVES_LONG}{landmark_sql('cl', 'lm', 10, 8)}"
ANCHOR_SQL = f"""WITH {CURVES_LONG}, an AS (SELECT pixel_id, CASE WHEN pixel_id % 13 <> 0 THEN (pixel_id % 10) * 0.2::DOUBLE + 0.5::DOUBLE END AS a FROM traces){anchored_sql('cl', 'an', 'va')}"""


def _landmarks(spark, root):
    return curves(spark, root).select("pixel_id", on.landmarks(0.5, span=10, min_baseline=3)("x").alias("m")).select("pixel_id", "m.*")


@query("e01_threshold_derivative_time", LANDMARK_SQL + f" SELECT pixel_id, {q6('ttp')} AS ttp, {q6('peak')} AS peak FROM lm")
def e01(spark, root):
    return _landmarks(spark, root).select("pixel_id", r6("ttp").alias("ttp"), r6("peak").alias("peak"))


@query("e02_tangent_intercept", LANDMARK_SQL + f" SELECT pixel_id, {q6('cy0')} AS cy0 FROM lm")
def e02(spark, root):
    return _landmarks(spark, root).select("pixel_id", r6("cy0").alias("cy0"))


@query("e03_second_derivative_peak", LANDMARK_SQL + f" SELECT pixel_id, {q6('sdm')} AS sdm FROM lm")
def e03(spark, root):
    return _landmarks(spark, root).select("pixel_id", r6("sdm").alias("sdm"))


@query("e04_derivative_peak_time", f"WITH {CURVES_LONG}{landmark_sql('cl', 'lm', 6, 5)} SELECT pixel_id, {q6('peak')} AS peak FROM lm")
def e04(spark, root):
    got = curves(spark, root).select("pixel_id", on.landmarks(0.3, span=6)("x").alias("m"))
    return got.select("pixel_id", r6("m.peak").alias("peak"))


def _variants(spark, root):
    c = curves(spark, root).withColumn("anchor", F.when(F.col("pixel_id") % 13 != 0, (F.col("pixel_id") % 10) * 0.2 + 0.5))
    v = on.anchored(span=10, window=9, ahead=3.0, margin=0.5, baseline=0.4)("x", "anchor")
    return c.select("pixel_id", F.inline(v))


for _name, _rule in (("e05_anchored_closest_peak", "closest_peak_d1"), ("e07_anchored_tangent", "cy0_after_plate"), ("e07_anchored_threshold", "thr_deriv_after_plate")):
    def _pick(spark, root, rule=_rule):
        return _variants(spark, root).filter(F.col("rule") == rule).select("pixel_id", r6("ttp").alias("ttp"), "reason")

    query(_name, ANCHOR_SQL + f" SELECT pixel_id, {q6('ttp')} AS ttp, reason FROM va WHERE rule = '{_rule}'")(_pick)


@query("e08_anchored_variants", ANCHOR_SQL + f" SELECT pixel_id, rule, {q6('ttp')} AS ttp, reason FROM va")
def e08(spark, root):
    return _variants(spark, root).select("pixel_id", "rule", r6("ttp").alias("ttp"), "reason")


@query("e06_zero_crossing", f"""WITH {CURVES_LONG}{_savgol_sql(9, 3, 'cl', 'pixel_id')}{_grad('sg', 'g1', 'sg', 'd')}{_grad('g1', 'g2', 'd', 'dd')},
a AS (SELECT pixel_id, t, dd, lead(dd) OVER (PARTITION BY pixel_id ORDER BY t) AS nx, (pixel_id % 10) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS a FROM g2),
f AS (SELECT pixel_id, min(t) AS i, arg_min(dd, t) AS y0, arg_min(nx, t) AS y1 FROM a WHERE t >= ceil(a * 15.0) AND t + 1 <= floor((a + 3) * 15.0) AND sign(nx) < sign(dd) GROUP BY 1)
SELECT t.pixel_id, {q6('(i + y0 / (y0 - y1)) / 15.0', 5)} AS ttp FROM traces t LEFT JOIN f USING (pixel_id)""")
def e06(spark, root):
    c = curves(spark, root).withColumn("anchor", (F.col("pixel_id") % 10) * 0.2 + 0.5)
    return c.select("pixel_id", r6(on.zero_crossing("x", "anchor", 3.0, window=9), 5).alias("ttp"))


@query("e09_slope_peak_time", f"""WITH {CURVES_LONG}{_savgol_sql(15, 3, 'cl', 'pixel_id')}{_grad('sg', 'g1', 'sg', 'd')}
SELECT pixel_id, {q6('arg_max(t, (round(d, 10), -t)) / 15.0')} AS ttp FROM g1 WHERE t / 15.0 >= 0.5 AND t / 15.0 <= 63 / 15.0 - 1 GROUP BY 1""")
def e09(spark, root):
    return curves(spark, root).select("pixel_id", r6(on.slope_peak_time("x", 0.5, 1.0)).alias("ttp"))


@query("e10_plate_curve_features", f"""WITH {CURVES_LONG}{_savgol_sql(9, 3, 'cl', 'pixel_id')}{_grad('sg', 'g1', 'sg', 'd')},
b AS (SELECT pixel_id, avg(v) FILTER (t < 5) AS bm, greatest(stddev_pop(v) FILTER (t < 5), 1e-9) AS bs, avg(v) FILTER (t >= 59) AS pf FROM cl GROUP BY 1),
dn AS (SELECT pixel_id, greatest(stddev_pop(d) FILTER (t < 5), 1e-9) AS dn, max(d) AS mx, arg_max(t, (d, -t)) AS st FROM g1 GROUP BY 1),
w AS (SELECT g1.*, lag(sg) OVER (PARTITION BY pixel_id ORDER BY t) AS s0, lag(d) OVER (PARTITION BY pixel_id ORDER BY t) AS d0 FROM g1),
sc AS (SELECT w.pixel_id, arg_min(CASE WHEN t = 0 THEN 1 ELSE t + (bm + 3 * bs - s0) / (sg - s0) END, t) AS start FROM w JOIN b USING (pixel_id) WHERE sg > bm + 3 * bs GROUP BY 1),
pl AS (SELECT w.pixel_id, arg_min(t + (0.05::DOUBLE * mx - d0) / (d - d0), t) AS pl FROM w JOIN dn USING (pixel_id) WHERE t >= st AND d <= 0.05::DOUBLE * mx GROUP BY 1)
SELECT b.pixel_id, {q6('bm')} AS baseline_mean, {q6('bs')} AS baseline_std, {q6('pf')} AS plateau_level, {q6('start')} AS start, {q6('mx')} AS max_slope,
coalesce(mx > 5 * dn AND start < 59, false) AS is_positive, CASE WHEN mx > 5 * dn AND start < 59 THEN CAST(st + 1 AS DOUBLE) END AS takeoff,
CASE WHEN mx > 5 * dn AND start < 59 THEN {q6('coalesce(pl, 64)')} END AS plateau FROM b JOIN dn USING (pixel_id) LEFT JOIN sc USING (pixel_id) LEFT JOIN pl USING (pixel_id)""")
def e10(spark, root):
    c = curves(spark, root).select("pixel_id", on.plate_features("x").alias("p")).select("pixel_id", "p.*")
    cols = ("baseline_mean", "baseline_std", "plateau_level", "start", "max_slope", "takeoff", "plateau")
    return c.select("pixel_id", "is_positive", *[r6(n).alias(n) for n in cols])


@query("e12_sigmoid_fit")
def e12(spark, root):
    f = curves(spark, root).select("pixel_id", on.sigmoid_fit()("x").alias("p")).select("pixel_id", "p.*")
    return f.select("pixel_id", *[r6(c, 4).alias(c) for c in ("fm", "fb", "sc", "cs", "asym", "r2")], "fit_ok")


FITP = """fit AS (SELECT p_partkey, 1 + (p_partkey % 7) / CAST(4 AS DOUBLE) AS fm, (p_size % 5) / CAST(50 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS fb, CAST(0.4 AS DOUBLE) + (p_partkey % 11) / CAST(20 AS DOUBLE) AS sc,
 CAST(10 AS DOUBLE) + (p_size % 13) AS cs, CAST(0.6 AS DOUBLE) + (p_partkey % 5) / CAST(4 AS DOUBLE) AS asym FROM part)"""


def fits(spark, root):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, root, "part").select(
        "p_partkey", (1 + (k % 7) / 4.0).alias("fm"), ((s % 5) / 50.0 + 0.01).alias("fb"), (0.4 + (k % 11) / 20.0).alias("sc"),
        (10.0 + s % 13).alias("cs"), (0.6 + (k % 5) / 4.0).alias("asym"))


@query("e12_sigmoid_recovery", f"WITH {FITP} SELECT p_partkey, {', '.join(f'{q6(c, 3)} AS {c}' for c in ('fm', 'fb', 'sc', 'cs', 'asym'))}, true AS fit_ok, 1.0::DOUBLE AS r2 FROM fit")
def e12_recovery(spark, root):
    """Known curves, one per part: the fit has to give back their five parameters. Rows are dealt over all tasks before the long step."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(120)), lambda i: on.sigmoid_value(i / 4.0, *[F.col(c) for c in ("fm", "fb", "sc", "cs", "asym")]))
    f = spread(fits(spark, root)).select("p_partkey", on.sigmoid_fit(4.0)(grid).alias("p")).select("p_partkey", "p.*")
    return f.select("p_partkey", *[r6(c, 3).alias(c) for c in ("fm", "fb", "sc", "cs", "asym", "r2")], "fit_ok")


KCOLS = ("xms", "max_slope", "xs", "xe", "xp1", "xp2", "threshold_distance", "first_half", "second_half", "distance_asymmetry", "peak_shift",
         "area1", "area2", "area_asymmetry", "peak_asymmetry", "ct", "cy0", "neg_log_f0")


@query("e13_kinetic_features", f"""WITH {FITP}, g AS (SELECT *, i * CAST(0.5 AS DOUBLE) AS x FROM (SELECT *, unnest(range(0, 61)) AS i FROM fit) z), e AS (SELECT *, exp(-sc * (x - cs)) AS e FROM g),
v AS (SELECT *, round(fm / pow(1 + e, asym) + fb, 12) AS f, round(fm * asym * sc * e / pow(1 + e, asym + 1), 12) AS d, round(fm * asym * sc * sc * e * (asym * e - 1) / pow(1 + e, asym + 2), 12) AS c FROM e),
n AS (SELECT *, lag(f) OVER w AS f0, lag(d) OVER w AS d0, lead(d) OVER w AS d1, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM v WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
m AS (SELECT p_partkey, max(d) AS top, arg_max(i, (d, -i)) AS p, 0.1::DOUBLE * max(d) AS th, 0.2::DOUBLE * max(f) AS l20, arg_min(f, i) AS fstart,
  any_value(cs) AS cs, any_value(sc) AS sc, any_value(asym) AS asym, any_value(fm) AS fm, any_value(fb) AS fb FROM v GROUP BY 1),
k AS (SELECT n.p_partkey, arg_min(CASE WHEN i = 0 THEN 0 ELSE x - 0.5 + (th - d0) * 0.5 / (d - d0) END, i) FILTER (d > th) AS xs,
  arg_max(CASE WHEN i = 60 THEN x ELSE x + (th - d) * 0.5 / (d1 - d) END, i) FILTER (d > th) AS xe, arg_min(CASE WHEN i = 0 THEN 0 ELSE x - 0.5 + (l20 - f0) * 0.5 / (f - f0) END, i) FILTER (f > l20) AS ct,
  arg_max(x, (c, -i)) FILTER (c > c0 AND c > c1) AS xp1, max(c) FILTER (c > c0 AND c > c1) AS h1, arg_min(x, (c, i)) FILTER (c < c0 AND c < c1) AS xp2, -min(c) FILTER (c < c0 AND c < c1) AS h2 FROM n JOIN m USING (p_partkey) GROUP BY 1),
ar AS (SELECT v.p_partkey, coalesce(sum(0.25 * (v.d + z.d)) FILTER (v.i >= floor(xs / 0.5 + 0.5 - 1e-9) AND v.i < p), 0) AS area1,
  coalesce(sum(0.25 * (v.d + z.d)) FILTER (v.i >= p AND v.i < floor(xe / 0.5 + 0.5 - 1e-9)), 0) AS area2
  FROM v JOIN v z ON z.p_partkey = v.p_partkey AND z.i = v.i + 1 JOIN m ON m.p_partkey = v.p_partkey JOIN k ON k.p_partkey = v.p_partkey GROUP BY 1),
o AS (SELECT k.p_partkey, p * 0.5 AS xms, top AS max_slope, xs, xe, xp1, xp2, xe - xs AS threshold_distance, p * 0.5 - xs AS first_half, xe - p * 0.5 AS second_half,
  (xe - p * 0.5) / nullif(p * 0.5 - xs, 0) AS distance_asymmetry, xp2 - xp1 AS peak_shift, area1, area2, area2 / nullif(area1, 0) AS area_asymmetry, h1 / nullif(h2, 0) AS peak_asymmetry, ct,
  cs + ln(asym) / sc AS xi, m.* EXCLUDE (p_partkey, p, top) FROM k JOIN m USING (p_partkey) JOIN ar USING (p_partkey)),
oo AS (SELECT *, xi - (fm / pow(1 + exp(-sc * (xi - cs)), asym) + fb) / (fm * asym * sc * exp(-sc * (xi - cs)) / pow(1 + exp(-sc * (xi - cs)), asym + 1)) AS cy0, CASE WHEN fstart > 0 THEN -log10(fstart) END AS neg_log_f0 FROM o)
SELECT p_partkey, {', '.join(f'{q6(c, 5)} AS {c}' for c in KCOLS)} FROM oo""")
def e13(spark, root):
    return on.kinetic_features(fits(spark, root), 61, 0.5).select("p_partkey", *[r6(c, 5).alias(c) for c in KCOLS])


def _sampled(method):
    """CTE ``v`` (pixel_id, i, x, f, d, c): curve samples with first and second derivative at 15 samples a minute."""
    if method == "gradient":
        slope = lambda c: f"CASE WHEN i = 0 THEN (lead({c}) OVER w - {c}) * 15.0 WHEN i = 63 THEN ({c} - lag({c}) OVER w) * 15.0 ELSE (lead({c}) OVER w - lag({c}) OVER w) * 7.5 END"
    else:
        slope = lambda c: f"(lead({c}) OVER w - {c}) * 15.0"
    fill = lambda c: f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (PARTITION BY pixel_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    return f"""WITH {CURVES_LONG}, s0 AS (SELECT pixel_id, t AS i, t / 15.0::DOUBLE AS x, v AS f FROM cl),
s1 AS (SELECT *, {slope('f')} AS d_ FROM s0 WINDOW w AS (PARTITION BY pixel_id ORDER BY i)), s2 AS (SELECT *, {slope('d_')} AS c_ FROM s1 WINDOW w AS (PARTITION BY pixel_id ORDER BY i)),
v AS (SELECT pixel_id, i, x, f, {fill('d_')} AS d, {fill('c_')} AS c FROM s2)"""


def _raw_sql(method):
    return f"""{_sampled(method)},
n AS (SELECT *, lag(d) OVER w AS d0, lead(d) OVER w AS d1, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM v WINDOW w AS (PARTITION BY pixel_id ORDER BY i)),
m AS (SELECT pixel_id, max(d) AS top, arg_max(i, (d, -i)) AS p, 0.1::DOUBLE * max(d) AS th, arg_max(f, (d, -i)) AS y_xms, arg_min(f, i) AS f0, avg(d) FILTER (i >= 59) AS end_slope, avg(abs(d)) FILTER (i >= 59) AS end_slope_abs FROM v GROUP BY 1),
k AS (SELECT n.pixel_id, arg_min(CASE WHEN i = 0 THEN x ELSE x - 1 / 15.0::DOUBLE + (th - d0) / 15.0::DOUBLE / (d - d0) END, i) FILTER (d > th) AS xs,
  arg_max(CASE WHEN i = 63 THEN x ELSE x + (th - d) / 15.0::DOUBLE / (d1 - d) END, i) FILTER (d > th) AS xe,
  arg_max(i, (c, -i)) FILTER (c > c0 AND c > c1) AS p1, arg_min(i, (c, i)) FILTER (c < c0 AND c < c1) AS p2 FROM n JOIN m USING (pixel_id) GROUP BY 1),
o AS (SELECT k.*, m.* EXCLUDE (pixel_id), CAST(ceil(round(xs * 15, 9) - 0.5) AS INTEGER) AS i_s, CAST(ceil(round(xe * 15, 9) - 0.5) AS INTEGER) AS i_e FROM k JOIN m USING (pixel_id)),
ar AS (SELECT o.pixel_id, coalesce(sum((a.d + b.d) / 30.0) FILTER (a.i >= i_s AND a.i < p), 0) AS area1, coalesce(sum((a.d + b.d) / 30.0) FILTER (a.i >= p AND a.i < i_e), 0) AS area2
  FROM o JOIN v a ON a.pixel_id = o.pixel_id JOIN v b ON b.pixel_id = a.pixel_id AND b.i = a.i + 1 GROUP BY 1),
q AS (SELECT o.pixel_id, max(f) FILTER (i = i_s) AS y_xs, max(f) FILTER (i = i_e) AS y_xe, max(f) FILTER (i = p1) AS y_xp1, max(f) FILTER (i = p2) AS y_xp2,
  max(d) FILTER (i = p1) AS dy_xp1, max(d) FILTER (i = p2) AS dy_xp2, max(c) FILTER (i = p1) AS h1, abs(max(c) FILTER (i = p2)) AS h2 FROM o JOIN v USING (pixel_id) GROUP BY 1),
r AS (SELECT *, p / 15.0::DOUBLE AS xms, top AS max_slope, p1 / 15.0::DOUBLE AS xp1, p2 / 15.0::DOUBLE AS xp2, CASE WHEN f0 > 0 THEN -log10(f0) END AS neg_log_f0, h1 / nullif(h2, 0) AS peak_asymmetry, area2 / nullif(area1, 0) AS area_asymmetry
  FROM o JOIN ar USING (pixel_id) JOIN q USING (pixel_id)),
z AS (SELECT *, xe - xs AS threshold_distance, xms - xs AS first_half, xe - xms AS second_half, (xe - xms) / nullif(xms - xs, 0) AS distance_asymmetry, xp2 - xp1 AS peak_shift FROM r)
SELECT pixel_id, {', '.join(f'{q6(c, 4)} AS {c}' for c in kn.RAW_FEATURES)} FROM z"""


for method_ in ("gradient", "diff"):
    def e13_raw(spark, root, method=method_):
        k = curves(spark, root).select("pixel_id", on.raw_kinetics(1 / 15.0, 0.1, method)("x").alias("k"))
        return k.select("pixel_id", *[r6(f"k.{c}", 4).alias(c) for c in kn.RAW_FEATURES])

    query(f"e13_raw_features_{method_}", _raw_sql(method_))(e13_raw)


@query("w04_derivative_options", f"""{_sampled('diff')}{_savgol_sql(11, 2, "(SELECT pixel_id, t, v FROM cl)", "pixel_id", 1, "a")}{_savgol_sql(11, 2, "(SELECT pixel_id, t, v FROM cl)", "pixel_id", 2, "b")}
SELECT v.pixel_id, v.i AS t, {q6('v.d', 4)} AS diff1, {q6('v.c', 4)} AS diff2, {q6('a.sg * 15', 4)} AS savgol1, {q6('b.sg * 225', 4)} AS savgol2
FROM v JOIN asg a ON a.pixel_id = v.pixel_id AND a.t = v.i JOIN bsg b ON b.pixel_id = v.pixel_id AND b.t = v.i""")
def w04_options(spark, root):
    parts = {f"{m}{o}": on.derivatives(1 / 15.0, m, o)("x") for m in ("diff", "savgol") for o in (1, 2)}
    wide = curves(spark, root).select("pixel_id", *[e.alias(n) for n, e in parts.items()])
    rows = wide.select("pixel_id", F.posexplode(F.arrays_zip(*parts)).alias("t", "z"))
    return rows.select("pixel_id", "t", *[r6(f"z.{n}", 4).alias(n) for n in parts])


@query("e14_fit_loss", f"""WITH {PREDICTIONS}, b AS (SELECT method_id, avg(ttp_true) AS m FROM pred GROUP BY 1)
SELECT p.method_id, {q6('sum((ttp_true - ttp_pred) ** 2)', 4)} AS ssr, {q6('avg((ttp_true - ttp_pred) ** 2)')} AS mse, {q6('sqrt(avg((ttp_true - ttp_pred) ** 2))')} AS rmse,
{q6('avg(abs(ttp_true - ttp_pred))')} AS mae, {q6('1 - sum((ttp_true - ttp_pred) ** 2) / (sum((ttp_true - m) ** 2) + CAST(1e-10 AS DOUBLE))')} AS r_squared FROM pred p JOIN b ON b.method_id = p.method_id GROUP BY 1""")
def e14(spark, root):
    from wellspring.operators.ranking import attach

    p = predictions(spark, root)
    p = attach(p, p.groupBy("method_id").agg(F.avg("ttp_true").alias("m")), ["method_id"])
    r = F.col("ttp_true") - F.col("ttp_pred")
    ssr, tot = F.sum(r * r), F.sum(F.pow(F.col("ttp_true") - F.col("m"), 2))
    return p.groupBy("method_id").agg(
        r6(ssr, 4).alias("ssr"), r6(F.avg(r * r)).alias("mse"), r6(F.sqrt(F.avg(r * r))).alias("rmse"), r6(F.avg(F.abs(r))).alias("mae"), r6(1 - ssr / (tot + F.lit(1e-10))).alias("r_squared"))


STAGES_SQL = f"""WITH {CURVES_LONG}, bx AS (SELECT p.chip_id, p.well_id, p.pixel_id, p.t, avg(n.v) AS v FROM cl p JOIN cl n ON n.chip_id = p.chip_id AND n.well_id = p.well_id AND n.t = p.t AND abs(n.prow - p.prow) <= 3 AND abs(n.pcol - p.pcol) <= 3 GROUP BY 1, 2, 3, 4),
stages AS (SELECT 'raw' AS stage, chip_id, well_id, t, v FROM cl UNION ALL SELECT 'positive', chip_id, well_id, t, v FROM cl WHERE y = 1 UNION ALL SELECT 'smoothed', chip_id, well_id, t, v FROM bx),
wl AS (SELECT stage, chip_id, well_id, stage || chip_id || '|' || CAST(well_id AS VARCHAR) AS pixel_id, t, avg(v) AS v FROM stages GROUP BY 1, 2, 3, 4, 5),
an AS (SELECT DISTINCT stage, chip_id, well_id, pixel_id, well_id * 0.2::DOUBLE + 0.8::DOUBLE AS a FROM wl)"""


@query("e15_extractors_per_well", f"""{STAGES_SQL}, wm AS (SELECT pixel_id, t, v FROM wl){landmark_sql('wm', 'lm', 10, 8)}{anchored_sql('wm', 'an', 'va')},
every AS (SELECT * FROM va{"".join(f" UNION ALL SELECT pixel_id, '{r}', {r}, CASE WHEN {r} IS NULL THEN 'not found' ELSE 'ok' END FROM lm" for r in ("ttp", "cy0", "sdm"))})
SELECT stage, chip_id, well_id, rule, {q6('ttp')} AS ttp, {q6('ttp - a')} AS err, reason FROM every JOIN an USING (pixel_id)""")
def e15(spark, root):
    """Three stages of well means x all extractors, with the error to the plate time."""
    c = curves(spark, root)
    out = None
    for stage, df in (("raw", c), ("positive", c.filter("y = 1")), ("smoothed", sp.box_smooth(c, 3))):
        m = sp.mean_trace(df, WELL).withColumn("stage", F.lit(stage)).withColumn("plate", F.col("well_id") * 0.2 + 0.8)
        out = m if out is None else out.unionByName(m)
    lm = on.landmarks(0.5, span=10)("x")
    va = on.anchored(span=10, window=9, ahead=3.0, margin=0.5, baseline=0.4)("x", "plate")
    got = out.select("stage", *WELL, "plate", lm.alias("m"), va.alias("v"))
    rows = F.concat(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"m.{r}").alias("ttp"), F.when(F.col(f"m.{r}").isNull(), "not found").otherwise("ok").alias("reason")) for r in ("ttp", "cy0", "sdm")]), "v")
    flat = got.select("stage", *WELL, "plate", F.inline(rows))
    return flat.select("stage", *WELL, "rule", r6("ttp").alias("ttp"), r6(F.col("ttp") - F.col("plate")).alias("err"), "reason")


@query("q09_artefact_trim", f"""WITH {TRACES_LONG}, wl AS (SELECT chip_id, well_id, chip_id || '|' || CAST(well_id AS VARCHAR) AS pixel_id, t, avg(v) AS v FROM tl GROUP BY 1, 2, 3, 4){_ma('wl', 'ws', 'v', 1, 's', 'pixel_id')},
d AS MATERIALIZED (SELECT pixel_id, t, s, lead(s) OVER w - s AS d, max(s) OVER (PARTITION BY pixel_id ORDER BY t) AS top FROM ws WINDOW w AS (PARTITION BY pixel_id ORDER BY t)),
f AS MATERIALIZED (SELECT *, min(d) OVER (PARTITION BY pixel_id ORDER BY t) < 0 AS fell, min(d) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) >= 0 AS held FROM d),
rg AS (SELECT pixel_id, greatest(max(s) - min(s), 1e-9) AS span FROM d WHERE t < 60 GROUP BY 1),
lw AS (SELECT pixel_id, min(t) AS low, arg_min(top - s, t) AS fall FROM f WHERE t < 57 AND fell AND held GROUP BY 1),
ok AS MATERIALIZED (SELECT pixel_id, low, least(low + 16, 60) AS stop FROM lw JOIN rg USING (pixel_id) WHERE fall >= 0.10::DOUBLE * span),
cb AS MATERIALIZED (SELECT f.pixel_id, any_value(low) AS low, any_value(stop) AS stop, count(*) AS n, max(d) AS steep, arg_min(t, (-d, t)) AS at_top FROM f JOIN ok ON ok.pixel_id = f.pixel_id WHERE t > low AND t < stop GROUP BY 1),
cm AS (SELECT f.pixel_id, t, sum(CASE WHEN d < 0.30::DOUBLE * steep THEN 1 ELSE 0 END) OVER (PARTITION BY f.pixel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS calm
  FROM f JOIN cb ON cb.pixel_id = f.pixel_id WHERE t > at_top AND t < stop),
fs AS (SELECT pixel_id, min(t) AS t FROM cm WHERE calm = 3 GROUP BY 1),
ct AS (SELECT o.pixel_id, CASE WHEN cb.n IS NULL OR cb.n < 4 OR steep <= 0 THEN o.low + 1 ELSE coalesce(fs.t + 1, cb.stop) END AS c FROM ok o LEFT JOIN cb ON cb.pixel_id = o.pixel_id LEFT JOIN fs ON fs.pixel_id = o.pixel_id),
ch AS (SELECT chip_id, max(coalesce(c, 0)) AS cut FROM (SELECT DISTINCT chip_id, pixel_id FROM wl) z LEFT JOIN ct ON ct.pixel_id = z.pixel_id GROUP BY 1)
SELECT tl.chip_id, tl.pixel_id, CAST(any_value(cut) AS INTEGER) AS cut_idx, CAST(count(*) FILTER (t >= cut) AS INTEGER) AS n_left, {q6('sum(v) FILTER (t >= cut)')} AS total FROM tl JOIN ch ON ch.chip_id = tl.chip_id GROUP BY 1, 2""")
def q09(spark, root):
    t = on.trim_artefact(traces(spark, root), span=4, search=4.0)
    return t.select("chip_id", "pixel_id", "cut_idx", F.size("x").alias("n_left"), r6(ar.total("x")).alias("total"))


@query("u03_parallel_row_fit")
def u03(spark, root):
    """The same fit as Arrow batches over evenly spread partitions."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, mat in kn.by_length(pdf["x"]):
                p = kn.fit_5pl(mat)
                yield pd.DataFrame({"pixel_id": pdf["pixel_id"].to_numpy()[at], "r2": np.round(p[:, 5], 2), "rises": p[:, 0] > 0, "fit_ok": p[:, 6] == 1})

    c = curves(spark, root).select("pixel_id", "x").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pixel_id")
    return c.mapInPandas(fit, "pixel_id bigint, r2 double, rises boolean, fit_ok boolean")


@query("u05_rows_per_input", ANCHOR_SQL + f" SELECT rule, reason, count(*) AS n, {q6('avg(ttp)')} AS mean_ttp FROM va GROUP BY 1, 2")
def u05(spark, root):
    """Four rows per trace from one pass."""
    return _variants(spark, root).groupBy("rule", "reason").agg(F.count("*").alias("n"), r6(F.avg("ttp")).alias("mean_ttp"))


@query("u05_table_function", ANCHOR_SQL + f" SELECT pixel_id, rule, {q6('ttp')} AS ttp, reason FROM va")
def u05_table(spark, root):
    """The same four rows per trace from a table function over a table argument partitioned by well."""
    c = curves(spark, root).withColumn("anchor", F.when(F.col("pixel_id") % 13 != 0, (F.col("pixel_id") % 10) * 0.2 + 0.5))
    rows = c.select(*WELL, F.col("pixel_id").alias("id"), "x", "anchor")
    found = on.variant_rows(span=10, window=9, ahead=3.0, margin=0.5, baseline=0.4)(rows.asTable().partitionBy(*WELL))
    return found.select(F.col("id").alias("pixel_id"), "rule", r6("ttp").alias("ttp"), "reason")
