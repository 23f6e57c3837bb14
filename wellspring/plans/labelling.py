"""Queries for label builders and boundary comparisons."""

from pyspark.sql import functions as F

from wellspring.operators import labels as lb
from wellspring.operators.onset import anchored, pixel_shift
from wellspring.operators.ranking import attach, quantiles
from wellspring.operators.spatial import WELL, mean_trace
from wellspring.plans import query
from wellspring.plans.bindings import CURVES_LONG, TRACES, TRACES_LONG, curves, q6, r6, table, traces
from wellspring.plans.joins import POS, SPACINGS, j05
from wellspring.plans.landmark_sql import anchored as anchored_sql
from wellspring.plans.rules import CLASSES, class_frames

N = 64
TTP = ", tt AS (SELECT *, CAST(pixel_id % 37 AS DOUBLE) / 10 AS ttp FROM traces)"
GRID = TTP + ", gr AS (SELECT *, unnest(range(0, 64)) AS i FROM tt)"


def timed(spark, root):
    return traces(spark, root).withColumn("ttp", (F.col("pixel_id") % 37).cast("double") / 10)


def _per_sample(col, name, cast=None):
    def run(spark, root):
        t = timed(spark, root).select("pixel_id", F.posexplode(col()).alias("i", name))
        return t.select("pixel_id", F.col("i").cast("bigint").alias("i"), F.col(name) if cast else r6(name).alias(name))

    return run


query("l01_binary_labels", f"WITH {TRACES}{GRID} SELECT pixel_id, i, CASE WHEN i >= ttp * 15.0 THEN 1 ELSE 0 END AS label FROM gr")(
    _per_sample(lambda: lb.binary("ttp", N), "label", True))
query("l03_gaussian_targets", f"WITH {TRACES}{GRID} SELECT pixel_id, i, {q6('exp(-((i - ttp * 15.0) ** 2) / CAST(50 AS DOUBLE))')} AS target FROM gr")(
    _per_sample(lambda: lb.gaussian("ttp", 5.0, N), "target"))
query("l04_four_class_labels", f"""WITH {TRACES}{GRID} SELECT pixel_id, i, CASE WHEN i < ttp * 15.0 - 8 THEN 0 WHEN i < ttp * 15.0 THEN 1 WHEN i < ttp * 15.0 + 20 THEN 2 ELSE 3 END AS label FROM gr""")(
    _per_sample(lambda: lb.four_class("ttp", N, 8, 20), "label", True))

BND = ", bd AS (SELECT *, CAST(pixel_id % 30 AS INTEGER) - 4 AS b1, CAST(pixel_id % 30 AS INTEGER) + CAST(pixel_id % 7 AS INTEGER) * 5 AS b2, CAST(pixel_id % 50 AS INTEGER) + 20 AS b3 FROM traces)"


def bounded(spark, root):
    p = F.col("pixel_id")
    return traces(spark, root).withColumns({
        "b1": (p % 30).cast("int") - 4, "b2": (p % 30).cast("int") + (p % 7).cast("int") * 5, "b3": (p % 50).cast("int") + 20})


CLIP = """, cb AS (SELECT *, least(greatest(b1, 0), 64) AS c1, least(greatest(b2, least(greatest(b1, 0), 64)), 64) AS c2 FROM bd),
cc AS (SELECT *, least(greatest(b3, c2), 64) AS c3 FROM cb),
tru AS (SELECT pixel_id, well_id, CAST(i AS INTEGER) AS t, CASE WHEN i < c1 THEN 0 WHEN i < c2 THEN 1 WHEN i < c3 THEN 2 ELSE 3 END AS label FROM (SELECT *, unnest(range(0, 64)) AS i FROM cc) z)"""


@query("l05_boundary_labels", f"WITH {TRACES}{BND}{CLIP} SELECT pixel_id, t, label FROM tru")
def l05(spark, root):
    b = bounded(spark, root).withColumn("lab", lb.from_boundaries(F.col("b1"), F.col("b2"), F.col("b3"), N))
    return b.select("pixel_id", F.posexplode("lab").alias("t", "label"))


@query("l05_boundary_check", f"WITH {TRACES}{BND} SELECT pixel_id, b1 >= 0 AND b1 <= b2 AND b2 <= b3 AND b3 <= 64 AS ok FROM bd")
def l05_check(spark, root):
    return bounded(spark, root).select("pixel_id", lb.valid_boundaries(F.col("b1"), F.col("b2"), F.col("b3"), N).alias("ok"))


WINL = """, wl AS (SELECT pixel_id, y, ttp, i, (i * 4 + 3.5) / 15.0 AS c FROM (SELECT *, unnest(range(0, 15)) AS i FROM tt) z)"""


@query("l02_window_labels", f"""WITH {TRACES}{TTP}{WINL} SELECT pixel_id, CAST(i AS INTEGER) AS win, CASE WHEN c >= ttp THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hard,
{q6('1.0 / (1.0 + exp(-(c - ttp) / CAST(0.4 AS DOUBLE)))')} AS soft, {q6('ttp - c')} AS dist, y AS cls,
CASE WHEN c >= CASE WHEN y = 0 THEN 30.0 ELSE ttp END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS joint FROM wl""")
def l02(spark, root):
    t = timed(spark, root).withColumn("jt", F.when(F.col("y") == 0, 30.0).otherwise(F.col("ttp")))
    cols = {"hard": ("ttp", "hard"), "soft": ("ttp", "soft"), "dist": ("ttp", "dist"), "joint": ("jt", "hard")}
    arrays = [lb.window_labels(src, F.lit(15), 8, 4, kind, 0.4).alias(n) for n, (src, kind) in cols.items()]
    z = t.select("pixel_id", "y", *arrays).select("pixel_id", F.col("y").alias("cls"), F.posexplode(F.arrays_zip(*cols)).alias("win", "z"))
    return z.select("pixel_id", "win", "cls", "z.hard", r6("z.soft").alias("soft"), r6("z.dist").alias("dist"), "z.joint")


FI = "SELECT pixel_id, " + ", ".join(f"min(t) FILTER ({{c}} = {k}) AS {{p}}{k}" for k in (1, 2, 3)) + " FROM {src} GROUP BY 1"
BERR = f"""{CLASSES}{BND}{CLIP}, pf AS ({FI.format(c='c', p='p', src='cs')}), tf AS ({FI.format(c='label', p='t', src='tru')}),
be AS (SELECT pixel_id, p1 - t1 AS bd, p2 - t2 AS dr, p3 - t3 AS rp FROM pf JOIN tf USING (pixel_id))"""


def pred_true(spark, root):
    p = class_frames(spark, root)
    b = bounded(spark, root).select("pixel_id", lb.from_boundaries(F.col("b1"), F.col("b2"), F.col("b3"), N).alias("tru"))
    return p.join(b, "pixel_id")


def errors(spark, root):
    d = pred_true(spark, root)
    return d.select("pixel_id", "well_id", *[lb.boundary_error("c", "tru", k).alias(n) for n, k in (("bd", 1), ("dr", 2), ("rp", 3))])


@query("l09_boundary_errors", f"WITH {BERR} SELECT pixel_id, CAST(abs(bd) AS DOUBLE) AS bd, CAST(abs(dr) AS DOUBLE) AS dr, CAST(abs(rp) AS DOUBLE) AS rp, CAST(dr AS DOUBLE) AS dr_signed FROM be")
def l09(spark, root):
    return errors(spark, root).select("pixel_id", *[F.abs(c).cast("double").alias(c) for c in ("bd", "dr", "rp")], F.col("dr").cast("double").alias("dr_signed"))


@query("l10_weighted_accuracy", f"""WITH {BERR}, mk AS (SELECT pixel_id, cs.t, c, label, CASE WHEN abs(cs.t - t1) <= 5 OR abs(cs.t - t2) <= 5 OR abs(cs.t - t3) <= 5 THEN 5.0 ELSE 1.0 END AS w
  FROM cs JOIN tru USING (pixel_id, t) JOIN tf USING (pixel_id))
SELECT pixel_id, {q6('sum(CASE WHEN c = label THEN w ELSE 0 END) / sum(w)')} AS acc FROM mk GROUP BY 1""")
def l10(spark, root):
    return pred_true(spark, root).select("pixel_id", r6(lb.weighted_accuracy("c", "tru", 5)).alias("acc"))


@query("a31_boundary_summary", f"""WITH {BERR}, e AS (UNPIVOT (SELECT pixel_id, CAST(abs(bd) AS DOUBLE) AS bd, CAST(abs(dr) AS DOUBLE) AS dr, CAST(abs(rp) AS DOUBLE) AS rp FROM be) ON bd, dr, rp INTO NAME boundary VALUE e)
SELECT boundary, count(*) AS n, {q6('quantile_cont(e, 0.1)')} AS p10, {q6('median(e)')} AS med, {q6('quantile_cont(e, 0.9)')} AS p90, {q6('avg(e)')} AS mean, {q6('stddev_pop(e)')} AS sd,
{q6('avg(CASE WHEN e <= 5 THEN 1.0 ELSE 0.0 END)')} AS within5 FROM e GROUP BY 1""")
def a31(spark, root):
    e = errors(spark, root).select("pixel_id", *[F.abs(c).cast("double").alias(c) for c in ("bd", "dr", "rp")])
    e = e.unpivot("pixel_id", ["bd", "dr", "rp"], "boundary", "e").filter("e IS NOT NULL")
    a = e.groupBy("boundary").agg(r6(F.avg("e")).alias("mean"), r6(F.stddev_pop("e")).alias("sd"), r6(F.avg((F.col("e") <= 5).cast("double"))).alias("within5"))
    q = quantiles(e, ["boundary"], "e", {"p10": 0.1, "med": 0.5, "p90": 0.9})
    return attach(a, q.select("boundary", "n", *[r6(c).alias(c) for c in ("p10", "med", "p90")]), ["boundary"])


@query("a31_well_boundary_error", f"""WITH {BERR} SELECT t.well_id, count(dr) AS n, {q6('median(dr)')} AS med_dr, {q6('avg(dr)')} AS mean_dr FROM be JOIN traces t USING (pixel_id) WHERE dr IS NOT NULL GROUP BY 1""")
def a31_well(spark, root):
    e = errors(spark, root).filter("dr IS NOT NULL").withColumn("dr", F.col("dr").cast("double"))
    a = e.groupBy("well_id").agg(r6(F.avg("dr")).alias("mean_dr"))
    return attach(a, quantiles(e, ["well_id"], "dr", {"m": 0.5}).select("well_id", "n", r6("m").alias("med_dr")), ["well_id"])


@query("a42_label_array_stats", f"""WITH {TRACES}{BND}{CLIP}, f AS (SELECT pixel_id, any_value(well_id) AS well_id, min(t) FILTER (label = 2) AS i FROM tru GROUP BY 1)
SELECT well_id, count(i) AS n, count(*) - count(i) AS n_absent, {q6('avg(i)')} AS mean_i, {q6('stddev_pop(i)')} AS sd_i, min(i) AS min_i, max(i) AS max_i FROM f GROUP BY 1""")
def a42(spark, root):
    b = bounded(spark, root).withColumn("i", lb.first_index(lb.from_boundaries(F.col("b1"), F.col("b2"), F.col("b3"), N), 2))
    return b.groupBy("well_id").agg(
        F.count("i").alias("n"), F.count_if(F.col("i").isNull()).alias("n_absent"), r6(F.avg("i")).alias("mean_i"), r6(F.stddev_pop("i")).alias("sd_i"),
        F.min("i").alias("min_i"), F.max("i").alias("max_i"))


@query("l08_well_class_labels", f"WITH {TRACES} SELECT pixel_id, CASE WHEN is_ntc THEN 0 WHEN n.n_nationkey % 2 = 0 THEN 1 END AS label FROM traces LEFT JOIN nation n ON n.n_nationkey = well_id WHERE is_ntc OR n.n_nationkey % 2 = 0")
def l08(spark, root):
    manual = table(spark, root, "nation").select(F.col("n_nationkey").cast("int").alias("well_id"), (F.col("n_nationkey") % 2 == 0).alias("amp"))
    t = traces(spark, root).join(manual, "well_id", "left")  # 25 nations: a few kB
    return t.filter(F.col("is_ntc") | F.col("amp")).select("pixel_id", F.when(F.col("is_ntc"), 0).otherwise(1).alias("label"))


# --- shifts -------------------------------------------------------------------------------
SHIFT = TRACES_LONG + """, wm AS (SELECT chip_id, well_id, t, avg(v) AS m FROM tl WHERE t BETWEEN 16 AND 47 GROUP BY 1, 2, 3),
pz AS (SELECT chip_id, well_id, pixel_id, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM tl WHERE t BETWEEN 16 AND 47 WINDOW w AS (PARTITION BY pixel_id)),
mz AS (SELECT chip_id, well_id, t, (m - avg(m) OVER w) / stddev_pop(m) OVER w AS z FROM wm WINDOW w AS (PARTITION BY chip_id, well_id)),
xc AS (SELECT p.pixel_id, CAST(p.t - m.t AS INTEGER) AS lag, sum(p.z * m.z) AS s FROM pz p JOIN mz m ON p.chip_id = m.chip_id AND p.well_id = m.well_id AND abs(p.t - m.t) <= 10 GROUP BY 1, 2),
sh AS (SELECT pixel_id, lag AS shift FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY round(s, 9) DESC, lag) AS rn FROM xc) z WHERE rn = 1)"""


def shifts(spark, root):
    t = traces(spark, root)
    m = mean_trace(t, WELL, "x", "wm")
    return t.join(m, WELL).withColumn("shift", pixel_shift("x", "wm", 32, 16, 10))


@query("e11_cross_correlation_shift", f"WITH {SHIFT} SELECT pixel_id, shift FROM sh")
def e11(spark, root):
    return shifts(spark, root).select("pixel_id", "shift")


# --- labels that follow the onset of their own well ------------------------------------------
ONSET = f"""WITH {CURVES_LONG}, wl AS (SELECT chip_id, well_id, chip_id || '|' || CAST(well_id AS VARCHAR) AS pixel_id, t, avg(v) AS v FROM cl GROUP BY 1, 2, 3, 4),
an AS (SELECT DISTINCT pixel_id, well_id * 0.2::DOUBLE + 0.8::DOUBLE AS a FROM wl), wm AS (SELECT pixel_id, t, v FROM wl){anchored_sql('wm', 'an', 'va')},
wa AS (SELECT chip_id, well_id, ttp AS anchor, (SELECT count(*) FROM range(64) r(i) WHERE i / 15.0::DOUBLE < ttp) AS s FROM va JOIN (SELECT DISTINCT chip_id, well_id, pixel_id FROM wl) w ON w.pixel_id = va.pixel_id
  WHERE rule = 'cy0_after_plate' AND ttp IS NOT NULL),
pz AS (SELECT c.chip_id, c.well_id, c.pixel_id, t, count(*) OVER w AS n, stddev_pop(v) OVER w AS sd, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z
  FROM cl c JOIN wa ON wa.chip_id = c.chip_id AND wa.well_id = c.well_id WHERE t BETWEEN greatest(s - 16, 0) AND s + 15 WINDOW w AS (PARTITION BY c.pixel_id)),
mz AS (SELECT c.chip_id, c.well_id, t, stddev_pop(v) OVER w AS sd, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z
  FROM wl c JOIN wa ON wa.chip_id = c.chip_id AND wa.well_id = c.well_id WHERE t BETWEEN greatest(s - 16, 0) AND s + 15 WINDOW w AS (PARTITION BY c.chip_id, c.well_id)),
xc AS (SELECT p.pixel_id, CAST(p.t - m.t AS INTEGER) AS lag, sum(p.z * m.z) AS sc FROM pz p JOIN mz m ON p.chip_id = m.chip_id AND p.well_id = m.well_id AND abs(p.t - m.t) <= 10
  WHERE n >= 5 AND p.sd >= 1e-9 AND m.sd >= 1e-9 GROUP BY 1, 2),
best AS (SELECT pixel_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY round(sc, 9) DESC, lag) AS rn FROM xc) z WHERE rn = 1),
px AS (SELECT t.pixel_id, t.well_id, anchor, coalesce(lag, 0) AS shift FROM traces t JOIN wa ON wa.chip_id = t.chip_id AND wa.well_id = t.well_id LEFT JOIN best ON best.pixel_id = t.pixel_id)"""


def well_onsets(spark, root):
    """Pixels with their well's anchor (tangent intercept of the mean curve after the plate time) and their shift against that mean; wells without anchor drop out."""
    c = curves(spark, root)
    m = mean_trace(c, WELL, "x", "wm").withColumn("plate", F.col("well_id") * 0.2 + 0.8)
    found = anchored(span=10, window=9, ahead=3.0, margin=0.5, baseline=0.4)("wm", "plate")
    w = m.select(*WELL, "wm", F.inline(found)).filter("rule = 'cy0_after_plate' AND ttp IS NOT NULL")
    w = w.select(*WELL, "wm", F.col("ttp").alias("anchor"), lb.sample_at("ttp", N).alias("at"))
    return c.join(w, WELL).withColumn("shift", pixel_shift("x", "wm", "at", 16, 10))


@query("l06_shifted_boundaries", f"""{ONSET}, {POS}, sp AS ({SPACINGS}),
g AS (SELECT pixel_id, shift, anchor, coalesce(dt_start, 3) AS d0, coalesce(dt_plateau, 10) AS d1 FROM px LEFT JOIN sp ON sp.well = px.well_id)
SELECT pixel_id, shift, {', '.join(f"CAST(least(greatest(round_even(({e}) * 15.0::DOUBLE, 0) + shift, 0), 64) AS INTEGER) AS {b}" for b, e in (('b1', 'anchor - d0'), ('b2', 'anchor'), ('b3', 'anchor + d1')))} FROM g""")
def l06(spark, root):
    spacing = j05(spark, root).select(F.col("well").cast("int").alias("well_id"), "dt_start", "dt_plateau")
    p = well_onsets(spark, root).join(spacing, "well_id", "left")
    b = lb.shifted_boundaries(F.col("anchor"), F.coalesce("dt_start", F.lit(3.0)), F.coalesce("dt_plateau", F.lit(10.0)), F.col("shift"), N)
    return p.select("pixel_id", "shift", b.alias("b")).select("pixel_id", "shift", "b.*")


@query("l07_pixel_time_labels", f"{ONSET} SELECT pixel_id, {q6('anchor')} AS y_broadcast, {q6('anchor + shift / 15.0::DOUBLE')} AS y_shifted FROM px")
def l07(spark, root):
    p = well_onsets(spark, root)
    return p.select("pixel_id", r6("anchor").alias("y_broadcast"), r6(F.col("anchor") + F.col("shift") / 15.0).alias("y_shifted"))
