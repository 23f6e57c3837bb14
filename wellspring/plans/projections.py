"""Queries for predicates, alignment, interpolation, formatting and id parsing."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators.ranking import quantiles, row_index, with_scalars
from wellspring.plans import query
from wellspring.plans.bindings import (
    PREDICTIONS, SCORES, TRACES, long, predictions, q6, r6, table, traces,
)


@query("p01_pixel_qc", f"""WITH {TRACES} SELECT pixel_id, list_max(list_transform(x, lambda v: CASE WHEN isfinite(v) THEN 0 ELSE 1 END)) = 0 AND x[1] > -0.1 AND x[1] < 0.1
AND list_stddev_pop(x) > CAST(0.12 AS DOUBLE) AS ok FROM traces""")
def p01(spark, root):
    finite = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    first = F.get("x", F.lit(0))
    return traces(spark, root).select("pixel_id", (finite & (first > -0.1) & (first < 0.1) & (ar.std("x") > 0.12)).alias("ok"))


@query("p02_active_pixels", "SELECT CAST((l_orderkey % 12) * 20 + l_orderkey // 12 % 20 AS BIGINT) AS idx, count(*) AS n FROM lineitem WHERE l_quantity = 40 GROUP BY 1")
def p02(spark, root):
    k = F.col("l_orderkey")
    li = table(spark, root, "lineitem").filter(F.col("l_quantity") == 40)
    return li.groupBy(((k % 12) * 20 + F.floor(k / 12) % 20).alias("idx")).agg(F.count("*").alias("n"))


@query("p03_align_and_window", f"""WITH {TRACES}, a AS (SELECT pixel_id, CAST(pixel_id % 20 AS INTEGER) AS s, x FROM traces), b AS (SELECT pixel_id, s, x[s + 1 : 64] AS w FROM a)
SELECT pixel_id, CAST(greatest(50 - len(w), 0) AS INTEGER) AS n_pad, CAST(least(len(w), 50) AS INTEGER) AS span, {q6('list_sum(list_transform(w[1:50], lambda v: v - w[1]))')} AS total, {q6('w[2] - w[1]')} AS second_v FROM b""")
def p03(spark, root):
    t = traces(spark, root).withColumn("s", (F.col("pixel_id") % 20).cast("int"))
    w = t.select("pixel_id", F.expr("slice(x, s + 1, size(x))").alias("w"))
    cut = ar.pad_or_cut(ar.let("w", lambda a: ar.let(F.get(a, F.lit(0)), lambda b: F.transform(a, lambda v: v - b))), 50)
    o = w.withColumn("z", cut)
    return o.select("pixel_id", F.greatest(50 - F.size("w"), F.lit(0)).alias("n_pad"), F.least(F.size("w"), F.lit(50)).alias("span"), r6(ar.total("z")).alias("total"), r6(F.get("z", F.lit(1))).alias("second_v"))


@query("p04_flat_index_to_grid", "SELECT p_partkey, CAST(p_partkey // 56 AS INTEGER) AS prow, CAST(p_partkey % 56 AS INTEGER) AS pcol FROM part")
def p04(spark, root):
    k = F.col("p_partkey")
    return table(spark, root, "part").select("p_partkey", F.floor(k / 56).cast("int").alias("prow"), (k % 56).cast("int").alias("pcol"))


@query("p05_pixel_resequence", f"WITH {TRACES} SELECT pixel_id, row_number() OVER (PARTITION BY chip_id, well_id ORDER BY prow, pcol, pixel_id) - 1 AS seq FROM traces")
def p05(spark, root):
    return row_index(traces(spark, root), ["chip_id", "well_id"], ["prow", "pcol", "pixel_id"], "seq").select("pixel_id", "seq")


@query("p06_decimate", f"""WITH {TRACES}, i AS (SELECT pixel_id, x, unnest(range(0, 10)) AS k FROM traces)
SELECT pixel_id, CAST(k AS INTEGER) AS k, {q6('x[CAST(floor(k * 63 / CAST(9 AS DOUBLE)) AS INTEGER) + 1]')} AS spaced, {q6('x[k * 6 + 1]')} AS every_sixth FROM i""")
def p06(spark, root):
    n = 10
    spaced = ar.let("x", lambda a: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(a, F.floor(k * (F.size(a) - 1) / F.lit(n - 1)).cast("int"))))
    sixth = F.filter("x", lambda v, i: i % 6 == 0)
    z = traces(spark, root).select("pixel_id", F.posexplode(F.slice(F.arrays_zip(spaced.alias("a"), sixth.alias("b")), 1, n)).alias("k", "z"))
    return z.select("pixel_id", "k", r6("z.a").alias("spaced"), r6("z.b").alias("every_sixth"))


@query("p07_width_harmonise", f"""WITH {TRACES}, r AS (SELECT pixel_id, x[1 : 64 - pixel_id % 9] AS x FROM traces), m AS (SELECT min(len(x)) AS w FROM r)
SELECT pixel_id, CAST(w AS INTEGER) AS cut_width, {q6('list_sum(x[1:w])')} AS cut_total, CAST(64 - len(x) AS INTEGER) AS n_zero FROM r, m""")
def p07(spark, root):
    r = traces(spark, root).select("pixel_id", F.expr("slice(x, 1, CAST(64 - pixel_id % 9 AS INT))").alias("x"))
    r = with_scalars(r, r.agg(F.min(F.size("x")).alias("w")))
    cut, pad = ar.pad_or_cut("x", F.col("w")), ar.pad_or_cut("x", 64)
    return r.select("pixel_id", F.size(cut).alias("cut_width"), r6(ar.total(cut)).alias("cut_total"), (F.size(pad) - F.size("x")).alias("n_zero"))


@query("p08_drop_null_labels", "SELECT count(*) AS n_total, count(quality) AS n_kept, count(*) - count(quality) AS n_dropped FROM documents LEFT JOIN labels USING (doc_id)")
def p08(spark, root):
    j = table(spark, root, "documents").select("doc_id").join(table(spark, root, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("n_total"), F.count("quality").alias("n_kept"), F.count_if(F.col("quality").isNull()).alias("n_dropped"))


@query("p09_log10_concentration", """WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'dilution_chip' ELSE 'run_' || CAST(o_custkey AS VARCHAR) || '_1e' || CAST(o_orderkey % 12 AS VARCHAR) END AS chip, CAST(o_orderkey % 7 AS INTEGER) AS well FROM orders)
SELECT o_orderkey, CASE WHEN chip = 'dilution_chip' THEN CASE WHEN well < 5 THEN CAST(9 - well AS DOUBLE) END
WHEN regexp_extract(chip, '_([^_]*)$', 1) IN ('1e5','1e6','1e7','1e8','1e9') THEN CAST(substr(regexp_extract(chip, '_([^_]*)$', 1), 3) AS DOUBLE) END AS log10_conc FROM i""")
def p09(spark, root):
    k = F.col("o_orderkey")
    chip = F.when(k % 4 == 0, "dilution_chip").otherwise(F.concat(F.lit("run_"), F.col("o_custkey").cast("string"), F.lit("_1e"), (k % 12).cast("string")))
    o = table(spark, root, "orders").select("o_orderkey", chip.alias("chip"), (k % 7).cast("int").alias("well"))
    # fixed values: suffix -> log10 concentration, and the dilution chip's wells
    suffix = F.create_map(*[F.lit(v) for n in range(5, 10) for v in (f"1e{n}", float(n))])
    by_well = F.when(F.col("well") < 5, (9 - F.col("well")).cast("double"))
    return o.select("o_orderkey", F.when(F.col("chip") == "dilution_chip", by_well).otherwise(F.try_element_at(suffix, F.substring_index("chip", "_", -1))).alias("log10_conc"))


@query("p10_method_id_parts", f"""WITH {PREDICTIONS}, m AS (SELECT DISTINCT method_id || '_extra' || CAST(well_id AS VARCHAR) AS mid FROM pred)
SELECT mid, regexp_replace(mid, '_seed[0-9]+.*$', '') AS config, regexp_extract(mid, '^([a-z]+)', 1) AS family, CAST(regexp_extract(mid, 'seed([0-9]+)', 1) AS INTEGER) AS seed FROM m""")
def p10(spark, root):
    m = predictions(spark, root).select(F.concat("method_id", F.lit("_extra"), F.col("well_id").cast("string")).alias("mid")).distinct()
    return m.select("mid", F.regexp_replace("mid", "_seed[0-9]+.*$", "").alias("config"), F.regexp_extract("mid", "^([a-z]+)", 1).alias("family"), F.regexp_extract("mid", "seed([0-9]+)", 1).cast("int").alias("seed"))


@query("p11_cache_stem_mapping", """WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'dataset_all' WHEN 1 THEN 'dataset_filtered_ABCD' ELSE 'other' END || '_' || p_brand AS stem FROM part)
SELECT p_partkey, CASE WHEN starts_with(stem, 'dataset_all') THEN 'multi_raw' || substr(stem, 12) WHEN starts_with(stem, 'dataset_filtered') THEN 'multi_filtered' || substr(stem, 17) ELSE stem END AS stem FROM s""")
def p11(spark, root):
    k = F.col("p_partkey") % 3
    s = table(spark, root, "part").select("p_partkey", F.concat(F.when(k == 0, "dataset_all").when(k == 1, "dataset_filtered_ABCD").otherwise("other"), F.lit("_"), "p_brand").alias("stem"))
    new = F.when(F.startswith("stem", F.lit("dataset_all")), F.concat(F.lit("multi_raw"), F.expr("substr(stem, 12)"))).when(
        F.startswith("stem", F.lit("dataset_filtered")), F.concat(F.lit("multi_filtered"), F.expr("substr(stem, 17)"))).otherwise(F.col("stem"))
    return s.select("p_partkey", new.alias("stem"))


@query("p13_round_and_null", f"WITH {TRACES}, l AS (SELECT pixel_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS t, unnest(x) AS v FROM traces) SELECT pixel_id, t, {q6('CASE WHEN t % 10 <> 3 THEN v END', 3)} AS v FROM l")
def p13(spark, root):
    t = traces(spark, root).withColumn("x", F.transform("x", lambda v, i: F.when(i % 10 == 3, float("nan")).otherwise(v)))
    clean = F.transform("x", lambda v: F.round(F.when(~F.isnan(v), v), 3) + 0.0)
    return long(t.withColumn("x", clean), "pixel_id").select("pixel_id", "t", "v")


@query("p14_cycles_to_minutes", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q6('CASE WHEN l_returnflag <> {0} THEN l_quantity * 0.5 END'.format(chr(39) + 'N' + chr(39)))} AS minutes FROM lineitem")
def p14(spark, root):
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 0.5)).alias("minutes"))


@query("p15_interpolate_at_time", f"""WITH {TRACES}, a AS (SELECT pixel_id, x, CASE WHEN pixel_id % 11 <> 0 THEN (pixel_id % 97) * CAST(0.05 AS DOUBLE) END AS t0 FROM traces), b AS (SELECT *, CASE WHEN t0 IS NOT NULL THEN least(greatest(t0 * 15.0, 0), 63) END AS p FROM a)
SELECT pixel_id, {q6('x[CAST(floor(p) AS INTEGER) + 1] + (p - floor(p)) * (x[CAST(ceil(p) AS INTEGER) + 1] - x[CAST(floor(p) AS INTEGER) + 1])')} AS v FROM b""")
def p15(spark, root):
    t = traces(spark, root).withColumn("t0", F.when(F.col("pixel_id") % 11 != 0, (F.col("pixel_id") % 97) * 0.05))
    pos = F.least(F.greatest(F.col("t0") * 15.0, F.lit(0.0)), (F.size("x") - 1).cast("double"))
    lo, hi = F.get("x", F.floor("p").cast("int")), F.get("x", F.ceil("p").cast("int"))
    return t.withColumn("p", F.when(F.col("t0").isNotNull(), pos)).select("pixel_id", r6(lo + (F.col("p") - F.floor("p")) * (hi - lo)).alias("v"))


@query("p16_well_layout_lookup", """WITH n AS (SELECT c_custkey, CAST(c_custkey % 6 AS INTEGER) AS well, CASE WHEN contains(c_mktsegment, 'BUILD') THEN 'dilution' WHEN contains(c_mktsegment, 'AUTO') THEN 'pair' ELSE 'single' END AS layout FROM customer)
SELECT c_custkey, layout, CASE layout WHEN 'dilution' THEN ['E','D','C','B','A','NTC'][well + 1] WHEN 'pair' THEN CASE WHEN well IN (0, 1, 2, 3) THEN 'POS' ELSE 'NTC' END ELSE CASE WHEN well = 5 THEN 'NTC' ELSE 'POS' END END AS label FROM n""")
def p16(spark, root):
    seg = F.col("c_mktsegment")
    layout = F.when(seg.contains("BUILD"), "dilution").when(seg.contains("AUTO"), "pair").otherwise("single")
    c = table(spark, root, "customer").select("c_custkey", (F.col("c_custkey") % 6).cast("int").alias("well"), layout.alias("layout"))
    # fixed values: layout -> label of each well
    labels = {"dilution": ["E", "D", "C", "B", "A", "NTC"], "pair": ["POS"] * 4 + ["NTC"] * 2, "single": ["POS"] * 5 + ["NTC"]}
    m = F.create_map(*[v for k, ls in labels.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in ls]))])
    return c.select("c_custkey", "layout", F.get(F.element_at(m, F.col("layout")), F.col("well")).alias("label"))


@query("p17_label_format", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '10^' || CAST(o_custkey % 5 + 5 AS VARCHAR) || ' copies/rxn (' || o_orderpriority || ')' ELSE o_orderpriority END AS label FROM orders")
def p17(spark, root):
    o = table(spark, root, "orders").withColumn("lc", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 5 + 5))
    full = F.format_string("10^%d copies/rxn (%s)", F.col("lc"), F.col("o_orderpriority"))
    return o.select("o_orderkey", F.when(F.col("lc").isNull(), F.col("o_orderpriority")).otherwise(full).alias("label"))


@query("p18_reconstruction_score", f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, abs(l_extendedprice / l_quantity - 1200) AS err FROM lineitem),
t AS (SELECT quantile_cont(err, CAST(0.95 AS DOUBLE)) FILTER (l_returnflag = 'R') AS thr, stddev_pop(err) AS sd FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q6('1 / (1 + exp(-(thr - err) / sd))', 5)} AS score FROM e, t""")
def p18(spark, root):
    e = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.abs(F.col("l_extendedprice") / F.col("l_quantity") - 1200).alias("err"))
    thr = quantiles(e.filter("l_returnflag = 'R'"), [], "err", {"thr": 0.95}).select("thr")
    d = with_scalars(with_scalars(e, thr), e.agg(F.stddev_pop("err").alias("sd")))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(1 / (1 + F.exp(-(F.col("thr") - F.col("err")) / F.col("sd"))), 5).alias("score"))


@query("p19_joint_score_gating", f"""WITH {SCORES}, g AS (SELECT pixel_id, p, list_avg(p) AS c, x FROM sc JOIN traces USING (pixel_id))
SELECT pixel_id, {q6('list_sum(x) * c')} AS gated_mean, {q6('list_sum(list_transform(list_zip(x, p), lambda z: z[1] * z[2]))')} AS gated_windows,
{q6('CASE WHEN c >= 0.5 THEN list_sum(x) END')} AS kept, {q6('x[1] + ln(1 / (1 + exp(-p[1])) + CAST(1e-8 AS DOUBLE))')} AS gated_logit FROM g""")
def p19(spark, root):
    s = traces(spark, root).withColumn("p", F.transform("x", lambda v: 1.0 / (1.0 + F.exp(-20.0 * v)))).withColumn("c", ar.mean("p"))
    both = ar.total(F.zip_with("x", "p", lambda q, c: q * c))
    logit = F.get("x", F.lit(0)) + F.log(1 / (1 + F.exp(-F.get("p", F.lit(0)))) + F.lit(1e-8))
    return s.select("pixel_id", r6(ar.total("x") * F.col("c")).alias("gated_mean"), r6(both).alias("gated_windows"), r6(F.when(F.col("c") >= 0.5, ar.total("x"))).alias("kept"), r6(logit).alias("gated_logit"))


@query("p20_paired_long_rows", f"""WITH w AS (SELECT c_nationkey AS rep, {', '.join(f"avg(c_acctbal) FILTER (c_custkey % 4 = {i}) / 300 AS e{i}" for i in range(4))} FROM customer GROUP BY 1),
l AS (UNPIVOT w ON e0, e1, e2, e3 INTO NAME conc VALUE chip), p AS (SELECT 'e' || CAST(s_suppkey % 4 AS VARCHAR) AS conc, avg(s_acctbal) / 300 AS plate FROM supplier GROUP BY 1)
SELECT rep, l.conc, {q6('chip')} AS chip, {q6('plate')} AS plate FROM l JOIN p ON l.conc = p.conc""")
def p20(spark, root):
    cols = [f"e{i}" for i in range(4)]
    w = table(spark, root, "customer").groupBy(F.col("c_nationkey").alias("rep")).agg(*[(F.avg(F.when(F.col("c_custkey") % 4 == i, F.col("c_acctbal"))) / 300).alias(c) for i, c in enumerate(cols)])
    tall = w.unpivot("rep", cols, "conc", "chip").filter("chip IS NOT NULL")
    plate = table(spark, root, "supplier").groupBy(F.concat(F.lit("e"), (F.col("s_suppkey") % 4).cast("string")).alias("conc")).agg((F.avg("s_acctbal") / 300).alias("plate"))
    return tall.join(plate, "conc").select("rep", "conc", r6("chip").alias("chip"), r6("plate").alias("plate"))


@query("p21_run_id_composition", """SELECT p_partkey, 'filtered_' || ['A','AB','ABC','ABCD'][p_partkey % 4 + 1] || CASE WHEN p_size % 2 = 0 THEN '_ntcclean' ELSE '' END || '_k' || replace(printf('%.1f', p_size / 10.0), '.', 'p') || '_seed' || CAST(p_partkey % 5 AS VARCHAR) AS run_id FROM part""")
def p21(spark, root):
    k, s = F.col("p_partkey"), F.col("p_size")
    layer = F.get(F.array(*[F.lit(x) for x in ("A", "AB", "ABC", "ABCD")]), (k % 4).cast("int"))
    kk = F.replace(F.format_string("k%.1f", s / 10.0), F.lit("."), F.lit("p"))
    parts = F.concat_ws("_", F.lit("filtered"), layer, F.when(s % 2 == 0, "ntcclean"), kk, F.concat(F.lit("seed"), (k % 5).cast("string")))
    return table(spark, root, "part").select("p_partkey", parts.alias("run_id"))
