"""Queries for label lookups, replicate joins, priority unions and expansions."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators.ranking import with_scalars
from wellspring.plans import query
from wellspring.plans.bindings import (
    PREDICTIONS, TRACES, predictions, q6, r6, table, traces,
)


@query("j01_label_lookup", f"""WITH {TRACES}, ref AS (SELECT s_nationkey AS well_id, avg(s_acctbal) / 500 AS y FROM supplier GROUP BY 1)
SELECT pixel_id, {q6('r.y')} AS y_ttp_min, CASE WHEN chip_id IN ('chip0', 'chip1', 'chip2') THEN 'train' WHEN chip_id = 'chip3' THEN 'test' ELSE 'skip' END AS split FROM traces t LEFT JOIN ref r ON r.well_id = t.well_id""")
def j01(spark, root):
    ref = table(spark, root, "supplier").groupBy(F.col("s_nationkey").alias("well_id")).agg((F.avg("s_acctbal") / 500).alias("yv"))
    t = traces(spark, root).join(ref, "well_id", "left")
    split = F.when(F.col("chip_id").isin("chip0", "chip1", "chip2"), "train").when(F.col("chip_id") == "chip3", "test").otherwise("skip")
    return t.select("pixel_id", r6("yv").alias("y_ttp_min"), split.alias("split"))


@query("j02_predictions_with_labels", f"""WITH p AS (SELECT l_orderkey, avg(l_quantity) AS pred, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderstatus, count(*) AS n, {q6('avg(abs(p.pred - o.o_totalprice / CAST(10000 AS DOUBLE)))')} AS mae FROM p JOIN orders o ON p.l_orderkey = o.o_orderkey GROUP BY 1""")
def j02(spark, root):
    p = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("pred"))
    o = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    j = p.join(o, p["l_orderkey"] == o["o_orderkey"])
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("pred") - F.col("o_totalprice") / 10000.0))).alias("mae"))


@query("j03_hand_label_match", "SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j03(spark, root):
    hand = table(spark, root, "labels").select("doc_id", "quality")
    have = table(spark, root, "documents").select("doc_id", "n_chars").join(hand.select("doc_id"), "doc_id", "left_semi")
    return have.join(hand, "doc_id")


POS = """ps AS (SELECT s_suppkey AS well, unnest([s_suppkey * 3, s_suppkey * 3 + 1, s_suppkey * 3 + 2, s_suppkey * 3 + 100000000]) AS pos FROM supplier),
cv AS (SELECT p_partkey AS pos, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / 100 END AS cq, CASE WHEN p_size % 5 <> 0 THEN 'Positive' ELSE 'Negative' END AS call, p_size FROM part)"""


def _positions(spark, root):
    s = F.col("s_suppkey")
    wells = table(spark, root, "supplier").select(s.alias("well"), F.explode(F.array(s * 3, s * 3 + 1, s * 3 + 2, s * 3 + 100000000)).alias("pos"))
    ok = F.col("p_size") % 5 != 0
    curves = table(spark, root, "part").select(
        F.col("p_partkey").alias("pos"), F.when(ok, F.col("p_retailprice") / 100).alias("cq"), F.when(ok, "Positive").otherwise("Negative").alias("call"), "p_size")
    return wells.join(curves, "pos", "left")


@query("j04_well_plate_replicates", f"""WITH {POS} SELECT well, count(*) AS n_replicates, count(cq) AS n_positive, {q6('avg(cq)')} AS cq_mean, string_agg(coalesce(call, 'Missing'), ',' ORDER BY ps.pos) AS calls, well % 7 = 0 AS unreliable
FROM ps LEFT JOIN cv ON ps.pos = cv.pos GROUP BY well""")
def j04(spark, root):
    j = _positions(spark, root)
    reps = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("call", F.lit("Missing")).alias("call"))))  # replicates of one well: four
    return j.groupBy("well").agg(
        F.count("*").alias("n_replicates"), F.count("cq").alias("n_positive"), r6(F.avg("cq")).alias("cq_mean"),
        F.array_join(F.transform(reps, lambda r: r["call"]), ",").alias("calls")).withColumn("unreliable", F.col("well") % 7 == 0)


SPACINGS = f"""SELECT well, {q6('CASE WHEN count(cq) > 0 THEN coalesce(avg(cq) - avg(CASE WHEN p_size % 3 <> 0 THEN cq - p_size / 10.0 END), 3) ELSE 3 END')} AS dt_start,
{q6('CASE WHEN count(cq) > 0 THEN coalesce(avg(CASE WHEN p_size % 2 <> 0 THEN cq + p_size / 5.0 END) - avg(cq), 10) ELSE 10 END')} AS dt_plateau FROM ps LEFT JOIN cv ON ps.pos = cv.pos GROUP BY well"""


@query("j05_plate_spacings", f"WITH {POS} {SPACINGS}")
def j05(spark, root):
    j = _positions(spark, root)
    start = F.avg(F.when(F.col("p_size") % 3 != 0, F.col("cq") - F.col("p_size") / 10.0))
    plateau = F.avg(F.when(F.col("p_size") % 2 != 0, F.col("cq") + F.col("p_size") / 5.0))
    return j.groupBy("well").agg(
        r6(F.coalesce(F.avg("cq") - start, F.lit(3.0))).alias("dt_start"), r6(F.coalesce(plateau - F.avg("cq"), F.lit(10.0))).alias("dt_plateau"))


@query("j06_concentration_to_plate_time", f"""WITH {PREDICTIONS}, pc AS (SELECT chip_id AS k, log10_conc AS lc, avg(ttp_true) + 1 AS ttp FROM pred WHERE chip_id <> 'c2' GROUP BY 1, 2),
pool AS (SELECT log10_conc AS lc, avg(ttp_true) AS ttp FROM pred GROUP BY 1)
SELECT DISTINCT p.chip_id, p.well_id, CASE WHEN p.well_id >= 8 THEN NULL ELSE {q6('coalesce(pc.ttp, pool.ttp)')} END AS ttp_plate FROM pred p LEFT JOIN pc ON pc.k = p.chip_id AND pc.lc = p.log10_conc LEFT JOIN pool ON pool.lc = p.log10_conc""")
def j06(spark, root):
    p = predictions(spark, root)
    per_chip = p.filter("chip_id <> 'c2'").groupBy("chip_id", "log10_conc").agg((F.avg("ttp_true") + 1).alias("own"))
    pool = p.groupBy("log10_conc").agg(F.avg("ttp_true").alias("pooled"))
    wells = p.select("chip_id", "well_id", "log10_conc").distinct().join(per_chip, ["chip_id", "log10_conc"], "left").join(pool, "log10_conc", "left")
    return wells.select("chip_id", "well_id", F.when(F.col("well_id") < 8, r6(F.coalesce("own", "pooled"))).alias("ttp_plate"))


@query("j09_cluster_labels_to_pixels", f"""WITH {TRACES}, bd AS (SELECT well_id, k AS cluster, well_id * 2 + k * 5 AS b1, well_id * 2 + k * 5 + 10 AS b2, CASE WHEN (well_id + k) % 4 = 0 THEN 'skip' ELSE 'ok' END AS status
 FROM (SELECT DISTINCT well_id FROM traces), (SELECT unnest([0, 1, 2]) AS k))
SELECT pixel_id, CAST(pixel_id % 3 AS INTEGER) AS cluster, CAST(b1 AS INTEGER) AS b1, CAST(b2 AS INTEGER) AS b2 FROM traces t JOIN bd ON bd.well_id = t.well_id AND bd.cluster = t.pixel_id % 3 WHERE status = 'ok'""")
def j09(spark, root):
    t = traces(spark, root).withColumn("cluster", (F.col("pixel_id") % 3).cast("int"))
    b = t.select("well_id").distinct().withColumn("cluster", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    b = b.withColumn("b1", F.col("well_id") * 2 + F.col("cluster") * 5).withColumn("b2", F.col("b1") + 10)
    b = b.filter((F.col("well_id") + F.col("cluster")) % 4 != 0)
    return t.join(b, ["well_id", "cluster"]).select("pixel_id", "cluster", "b1", "b2")


@query("j10_systematic_vs_manual", f"""WITH w AS (SELECT c_nationkey AS chip, CAST(c_custkey % 6 AS INTEGER) AS well, avg(c_acctbal) / 300 AS syst FROM customer GROUP BY 1, 2),
m AS (SELECT s_nationkey AS chip, CAST(s_suppkey % 6 AS INTEGER) AS well, avg(s_acctbal) / 300 AS manual, CASE WHEN count(*) % 2 = 1 THEN avg(s_acctbal) / 250 END AS plate FROM supplier GROUP BY 1, 2),
r AS (SELECT w.*, manual, plate, unnest(['v1', 'v4']) AS rule FROM w LEFT JOIN m ON w.chip = m.chip AND w.well = m.well)
SELECT chip, well, rule, CASE WHEN manual IS NULL THEN 'no manual label' WHEN plate IS NULL THEN 'no plate time' ELSE 'ok' END AS reason,
{q6("CASE WHEN plate IS NOT NULL THEN syst + CASE rule WHEN 'v4' THEN 0.5 ELSE 0 END - manual END")} AS delta FROM r""")
def j10(spark, root):
    w = table(spark, root, "customer").groupBy(F.col("c_nationkey").alias("chip"), (F.col("c_custkey") % 6).cast("int").alias("well")).agg((F.avg("c_acctbal") / 300).alias("syst"))
    m = table(spark, root, "supplier").groupBy(F.col("s_nationkey").alias("chip"), (F.col("s_suppkey") % 6).cast("int").alias("well")).agg(
        (F.avg("s_acctbal") / 300).alias("manual"), F.when(F.count("*") % 2 == 1, F.avg("s_acctbal") / 250).alias("plate"))
    r = w.join(m, ["chip", "well"], "left").withColumn("rule", F.explode(F.array(F.lit("v1"), F.lit("v4"))))
    reason = F.when(F.col("manual").isNull(), "no manual label").when(F.col("plate").isNull(), "no plate time").otherwise("ok")
    shift = F.when(F.col("rule") == "v4", 0.5).otherwise(0.0)
    return r.select("chip", "well", "rule", reason.alias("reason"), r6(F.when(F.col("plate").isNotNull(), F.col("syst") + shift - F.col("manual"))).alias("delta"))


@query("j11_cross_run_index_check", """WITH r AS (SELECT l_suppkey AS pid, l_linenumber AS run FROM lineitem), n AS (SELECT count(DISTINCT run) AS n FROM r)
SELECT l.pid, l.seen, n.n AS runs, l.seen = n.n AS complete FROM (SELECT pid, count(DISTINCT run) AS seen FROM r GROUP BY 1) l, n""")
def j11(spark, root):
    pairs = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("pid"), F.col("l_linenumber").alias("run")).distinct()
    total = pairs.select("run").distinct().agg(F.count("*").alias("runs"))
    seen = pairs.groupBy("pid").agg(F.count("*").alias("seen"))
    return with_scalars(seen, total).withColumn("complete", F.col("seen") == F.col("runs"))


@query("j12_priority_union", """WITH g AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN l_linenumber = (SELECT max(l_linenumber) FROM lineitem) THEN 0 ELSE l_linenumber END AS prio FROM g)
SELECT l_orderkey AS pixel_id, count(*) AS refs, arg_min(l_linenumber, prio) AS ref, arg_min(v, prio) AS v FROM p GROUP BY 1""")
def j12(spark, root):
    """Trace of the last reference where the pixel is active there, else of its first earlier one."""
    src = table(spark, root, "lineitem")
    li = src.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("v"))
    last = with_scalars(li, src.agg(F.max("l_linenumber").alias("last")))
    prio = last.withColumn("prio", F.when(F.col("l_linenumber") == F.col("last"), 0).otherwise(F.col("l_linenumber")))
    return prio.groupBy(F.col("l_orderkey").alias("pixel_id")).agg(
        F.count("*").alias("refs"), F.min_by("l_linenumber", "prio").alias("ref"), F.min_by("v", "prio").alias("v"))


SHIFTS, GAINS = range(-3, 4), (0.95, 1.0, 1.05)


def augment_grid(df, x="x"):
    """Each trace x 7 shifts x 3 gains, as rows; the grid is a literal of 21 entries."""
    def one(shift, gain):
        return F.struct(F.lit(shift).alias("shift"), F.lit(gain).alias("gain"), F.transform(ar.roll(x, shift), lambda v: v * gain).alias("xa"))

    copies = F.array(*[one(s, g) for s in SHIFTS for g in GAINS])
    return df.select("*", F.inline(copies))


@query("j13_augmentation_grid", f"""WITH {TRACES}, g AS (SELECT s, k FROM (SELECT unnest([-3,-2,-1,0,1,2,3]) AS s), (SELECT unnest([0.95::DOUBLE, 1.0::DOUBLE, 1.05::DOUBLE]) AS k))
SELECT pixel_id, CAST(s AS INTEGER) AS shift, k AS gain, {q6('x[(64 - s) % 64 + 1] * k')} AS first_v, {q6('x[(63 - s) % 64 + 1] * k')} AS last_v FROM traces, g""")
def j13(spark, root):
    a = augment_grid(traces(spark, root))
    return a.select("pixel_id", "shift", "gain", r6(F.get("xa", F.lit(0))).alias("first_v"), r6(F.element_at("xa", -1)).alias("last_v"))


@query("r19_augmented_average", f"""WITH {TRACES}, g AS (SELECT s, k FROM (SELECT unnest([-3,-2,-1,0,1,2,3]) AS s), (SELECT unnest([0.95::DOUBLE, 1.0::DOUBLE, 1.05::DOUBLE]) AS k)),
a AS (SELECT pixel_id, s, k, unnest(range(0, 64)) AS t, x FROM traces, g),
h AS (SELECT pixel_id, s, k, min(t) FILTER (x[(64 + t - s) % 64 + 1] * k > 0.1) AS i FROM a GROUP BY 1, 2, 3)
SELECT pixel_id, {q6('avg(coalesce(i, 63) / 15.0)')} AS ttp FROM h GROUP BY 1""")
def r19(spark, root):
    a = augment_grid(traces(spark, root).select("pixel_id", "x"))
    ttp = F.coalesce(ar.first_where("xa", lambda v: v > 0.1), F.lit(63)) / 15.0
    return a.groupBy("pixel_id").agg(r6(F.avg(ttp)).alias("ttp"))


@query("j14_fold_expansion", f"WITH {TRACES} SELECT f AS fold, CASE WHEN chip_id = 'chip' || CAST(f AS VARCHAR) THEN 'test' ELSE 'train' END AS split, y, count(*) AS n FROM traces, (SELECT unnest([0,1,2,3,4]) AS f) GROUP BY ALL")
def j14(spark, root):
    # one table with a fold id, never five copies of the traces: fold membership is computed on read
    counts = traces(spark, root).groupBy("chip_id", "y").agg(F.count("*").alias("n")).withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    split = F.when(F.col("chip_id") == F.concat(F.lit("chip"), F.col("fold").cast("string")), "test").otherwise("train")
    return counts.groupBy("fold", split.alias("split"), "y").agg(F.sum("n").alias("n"))


@query("j15_well_result_to_pixels", f"""WITH {TRACES}, w AS (SELECT chip_id, well_id, CASE WHEN count(*) >= 10 THEN avg(x[64]) * 100 END AS ttp FROM traces GROUP BY 1, 2)
SELECT t.pixel_id, 'keep' AS mode, {q6('w.ttp')} AS ttp FROM traces t JOIN w ON w.chip_id = t.chip_id AND w.well_id = t.well_id UNION ALL
SELECT t.pixel_id, 'drop', {q6('w.ttp')} FROM traces t JOIN w ON w.chip_id = t.chip_id AND w.well_id = t.well_id WHERE w.ttp IS NOT NULL""")
def j15(spark, root):
    t = traces(spark, root)
    w = t.groupBy("chip_id", "well_id").agg(F.when(F.count("*") >= 10, F.avg(F.element_at("x", 64)) * 100).alias("ttp"))
    j = t.select("chip_id", "well_id", "pixel_id").join(w, ["chip_id", "well_id"])
    j = j.withColumn("mode", F.explode(F.when(F.col("ttp").isNotNull(), F.array(F.lit("keep"), F.lit("drop"))).otherwise(F.array(F.lit("keep")))))
    return j.select("pixel_id", "mode", r6("ttp").alias("ttp"))


@query("j16_keyed_prediction_lookup", f"""WITH {TRACES}, p AS (SELECT 'chip' || CAST(o_orderkey % 5 AS VARCHAR) AS chip_id, o_orderkey % 10 AS well_id, o_orderkey AS pixel_id, o_totalprice / CAST(10000 AS DOUBLE) AS pred FROM orders)
SELECT t.pixel_id, {q6('pred')} AS pred FROM traces t LEFT JOIN p ON p.chip_id = t.chip_id AND p.well_id = t.well_id AND p.pixel_id = t.pixel_id""")
def j16(spark, root):
    k = F.col("o_orderkey")
    p = table(spark, root, "orders").select(
        F.concat(F.lit("chip"), (k % 5).cast("string")).alias("chip_id"), (k % 10).cast("int").alias("well_id"), k.alias("pixel_id"), (F.col("o_totalprice") / 10000.0).alias("pred"))
    return traces(spark, root).select("chip_id", "well_id", "pixel_id").join(p, ["chip_id", "well_id", "pixel_id"], "left").select("pixel_id", r6("pred").alias("pred"))
