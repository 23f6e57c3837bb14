"""Queries for box neighbours, smoothing, pooling and well-level traces."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators import spatial as sp
from wellspring.operators.spatial import WELL
from wellspring.plans import query
from wellspring.plans.bindings import TRACES, TRACES_LONG, long, q6, r6, traces

NB = """, nb AS (SELECT p.pixel_id, n.pixel_id AS nbr FROM traces p JOIN traces n ON p.chip_id = n.chip_id AND p.well_id = n.well_id
  AND greatest(abs(p.prow - n.prow), abs(p.pcol - n.pcol)) <= {k})"""


def box_neighbours(df, order, keys=WELL):
    """Neighbour count and id total within Chebyshev distance, by equi-join on grid positions.

    Positions are summed before they are copied to their surroundings and again after, so pixels
    sharing a position never meet pairwise.
    """
    span = range(-order, order + 1)
    spot = [*keys, "prow", "pcol"]
    offs = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in span for b in span]))
    cells = df.groupBy(*spot).agg(F.count("*").alias("n"), F.sum("pixel_id").alias("s"))
    sent = cells.withColumn("o", offs).select(*keys, (F.col("prow") + F.col("o.dr")).alias("prow"), (F.col("pcol") + F.col("o.dc")).alias("pcol"), "n", "s")
    around = sent.groupBy(*spot).agg(F.sum("n").alias("n_nbr"), F.sum("s").alias("nbr_total"))
    return df.select(*spot, "pixel_id").join(around, spot).select("pixel_id", "n_nbr", "nbr_total")


@query("j08_box_neighbours", f"WITH {TRACES}{NB.format(k=5)} SELECT pixel_id, count(*) AS n_nbr, CAST(sum(nbr) AS BIGINT) AS nbr_total FROM nb GROUP BY 1")
def j08(spark, root):
    return box_neighbours(traces(spark, root), 5)


@query("x01_box_smooth", f"WITH {TRACES_LONG}{NB.format(k=5)} SELECT nb.pixel_id, t, {q6('avg(v)')} AS v FROM nb JOIN tl ON tl.pixel_id = nb.nbr GROUP BY 1, 2")
def x01(spark, root):
    return long(sp.box_smooth(traces(spark, root), 5), "pixel_id").select("pixel_id", "t", r6("v").alias("v"))


@query("x02_tile_pool", f"""WITH {TRACES_LONG}, w AS (SELECT chip_id, well_id, max(pcol // 3) AS w, arg_min(y, pixel_id) AS y FROM traces GROUP BY 1, 2)
SELECT tl.chip_id, tl.well_id, CAST((prow // 3) * (w + 1) + pcol // 3 AS INTEGER) AS tile_id, w.y, t, {q6('avg(v)')} AS v FROM tl JOIN w ON w.chip_id = tl.chip_id AND w.well_id = tl.well_id GROUP BY ALL""")
def x02(spark, root):
    p = sp.pool_tiles(traces(spark, root), 1)
    return long(p, *WELL, "tile_id", "y").select(*WELL, "tile_id", "y", "t", r6("v").alias("v"))


@query("a05_mean_trace_per_well", f"WITH {TRACES_LONG} SELECT chip_id, well_id, t, {q6('avg(v)')} AS v FROM tl GROUP BY 1, 2, 3")
def a05(spark, root):
    m = sp.mean_trace(traces(spark, root), WELL)
    return long(m, *WELL).select(*WELL, "t", r6("v").alias("v"))


def ensemble(df, keys, x="x"):
    """Mean array over members; fails when member lengths differ."""
    same = df.groupBy(*keys).agg(F.min(F.size(x)).alias("lo"), F.max(F.size(x)).alias("hi"))
    checked = same.select(*keys, F.when(F.col("lo") == F.col("hi"), F.col("hi")).otherwise(F.raise_error(F.lit("member lengths differ"))).cast("int").alias("len"))
    return sp.mean_trace(df, keys, x).join(checked, keys)


@query("a37_seed_ensemble", f"""WITH {TRACES_LONG}, e AS (SELECT pixel_id // 5 AS member, t, avg(v) AS m FROM tl GROUP BY 1, 2)
SELECT member, CAST(count(*) AS INTEGER) AS len, {q6('arg_max(t, (round(m, 9), -t)) / 15.0')} AS ttp FROM e GROUP BY 1""")
def a37(spark, root):
    t = traces(spark, root).withColumn("member", F.floor(F.col("pixel_id") / 5))
    e = ensemble(t, ["member"])
    return e.select("member", "len", r6(ar.argmax(F.transform("x", lambda v: F.round(v, 9))) / 15.0).alias("ttp"))


@query("a40_edge_distance", f"""WITH {TRACES}, b AS (SELECT chip_id, well_id, min(prow) AS r0, max(prow) AS r1, min(pcol) AS c0, max(pcol) AS c1 FROM traces GROUP BY 1, 2)
SELECT y AS category, count(*) AS n, {q6('avg(least(prow - r0, r1 - prow, pcol - c0, c1 - pcol))')} AS mean_d, {q6('median(least(prow - r0, r1 - prow, pcol - c0, c1 - pcol))')} AS med_d
FROM traces t JOIN b ON t.chip_id = b.chip_id AND t.well_id = b.well_id GROUP BY 1""")
def a40(spark, root):
    from wellspring.operators.ranking import attach, quantiles

    t = traces(spark, root)
    box = t.groupBy(*WELL).agg(F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("pcol").alias("c0"), F.max("pcol").alias("c1"))
    d = attach(t, box, WELL).select(F.col("y").alias("category"), F.least(
        F.col("prow") - F.col("r0"), F.col("r1") - F.col("prow"), F.col("pcol") - F.col("c0"), F.col("c1") - F.col("pcol")).alias("d"))
    a = d.groupBy("category").agg(r6(F.avg("d")).alias("mean_d"))
    return attach(a, quantiles(d, ["category"], "d", {"m": 0.5}).select("category", "n", r6("m").alias("med_d")), ["category"])


@query("u04_group_function", f"WITH {TRACES_LONG}{NB.format(k=1)}, sm AS (SELECT nb.pixel_id, t, avg(v) AS v FROM nb JOIN tl ON tl.pixel_id = nb.nbr GROUP BY 1, 2) SELECT pixel_id, list({q6('v')} ORDER BY t) AS x FROM sm GROUP BY 1")
def u04(spark, root):
    """Per-tile group function: a group is a bounded tile of the grid, never a whole well; whole traces come back."""
    s = sp.box_smooth(traces(spark, root), 1)
    return s.select("pixel_id", F.transform("x", lambda v: r6(v)).alias("x"))
