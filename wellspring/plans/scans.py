"""Queries for sources, sinks and text parsing. Writers go to a fresh folder and are read back."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators import quality as ql
from wellspring.operators.ranking import row_index
from wellspring.operators.spatial import WELL
from wellspring.operators.splits import capped_sample
from wellspring.plans import query
from wellspring.session import durable
from wellspring.plans.bindings import CLS, PREDICTIONS, RUNS, TRACES, cls_scores, predictions, q6, r6, runs, table, traces
from wellspring.plans.quality import _filter_sql
from wellspring.plans.splits import _hash
from wellspring.sources import tables as tb
from wellspring.sources import text as tx


@query("s01_trace_scan", f"WITH {TRACES} SELECT chip_id, well_id, pixel_id, y, CAST(len(x) AS INTEGER) AS n_samples, {q6('x[1]')} AS first_v FROM traces")
def s01(spark, root):
    path = tb.scratch(spark, "traces")
    tb.write_traces(traces(spark, root), path)
    return tb.read_traces(spark, path).select(*WELL, "pixel_id", "y", F.size("x").alias("n_samples"), r6(F.get("x", F.lit(0))).alias("first_v"))


@query("s02_trace_sink_log", f"""WITH {TRACES} SELECT chip_id, count(*) AS n_total, count(*) FILTER (list_max(x) - list_min(x) > 0.55) AS n_written, count(*) FILTER (NOT (list_max(x) - list_min(x) > 0.55)) AS n_dropped FROM traces GROUP BY 1""")
def s02(spark, root):
    t = traces(spark, root)
    log = tb.write_traces(t.filter(ar.dyn_range("x") > 0.55), tb.scratch(spark, "traces"))
    total = t.groupBy("chip_id").agg(F.count("*").alias("n_total")).join(log, "chip_id", "left").na.fill(0, ["n_written"])
    return total.withColumn("n_dropped", F.col("n_total") - F.col("n_written"))


@query("s03_chip_listing", """SELECT DISTINCT chip FROM (SELECT regexp_extract(url, 'example[.]com/([^/?]+)', 1) AS chip, url FROM pages) z WHERE starts_with(url, 'http') AND NOT contains(url, 'ref=x') AND chip <> ''""")
def s03(spark, root):
    p = table(spark, root, "pages").filter(F.col("url").startswith("http") & ~F.col("url").contains("ref=x"))
    return p.select(F.regexp_extract("url", "example[.]com/([^/?]+)", 1).alias("chip")).filter("chip <> ''").distinct()


@query("s03_part_file_listing", f"WITH {TRACES} SELECT chip_id AS chip, count(*) AS n FROM traces WHERE NOT contains(chip_id, 'chip4') GROUP BY 1")
def s03_files(spark, root):
    """Chip folders of a partitioned table, from file paths."""
    path = tb.scratch(spark, "traces")
    tb.write_traces(traces(spark, root), path)
    files = spark.read.parquet(path).select(F.regexp_extract("_metadata.file_path", "chip_id=([^/]+)/", 1).alias("chip"))
    return files.filter(F.col("chip").startswith("chip") & ~F.col("chip").contains("chip4")).groupBy("chip").agg(F.count("*").alias("n"))


# fixed values: name hints of control chips
HINTS = ("small", "red", "steel")


@query("s04_control_inventory", """WITH h AS (SELECT p_partkey, p_name, list_filter(['small','red','steel'], lambda w: contains(lower(p_name), w)) AS hits FROM part)
SELECT p_partkey, array_to_string(hits, ';') AS hits, CASE WHEN len(hits) >= 2 THEN 'ntc_only' WHEN len(hits) = 1 THEN 'mixed' ELSE 'unknown' END AS kind, CASE WHEN len(hits) >= 2 THEN '0,1,2' WHEN len(hits) = 1 THEN '2' ELSE '' END AS wells FROM h""")
def s04(spark, root):
    hits = F.filter(F.array(*[F.lit(h) for h in HINTS]), lambda w: F.lower("p_name").contains(w))
    p = table(spark, root, "part").select("p_partkey", hits.alias("h"))
    n = F.size("h")
    return p.select("p_partkey", F.concat_ws(";", "h").alias("hits"), F.when(n >= 2, "ntc_only").when(n == 1, "mixed").otherwise("unknown").alias("kind"),
                    F.when(n >= 2, "0,1,2").when(n == 1, "2").otherwise("").alias("wells"))


@query("s04_control_wells", """WITH h AS (SELECT p_partkey, len(list_filter(['small','red','steel'], lambda w: contains(lower(p_name), w))) AS n FROM part)
SELECT p_partkey, CAST(unnest(string_split(CASE WHEN n >= 2 THEN '0,1,2' ELSE '2' END, ',')) AS INTEGER) AS well FROM h WHERE n >= 1""")
def s04_wells(spark, root):
    return s04(spark, root).filter(F.col("kind").isin("ntc_only", "mixed")).select("p_partkey", F.explode(F.split("wells", ",").cast("array<int>")).alias("well"))


def plate_xml(spark, root):
    """Plate XML text per supplier group, built from order lines (at most seven points per reaction)."""
    li = table(spark, root, "lineitem")
    adp = F.format_string("<adp><cyc>%d</cyc><tmp>%s</tmp><fluor>%s</fluor></adp>", F.col("l_linenumber"), F.col("l_discount").cast("string"), F.col("l_extendedprice").cast("string"))
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.max_by(F.struct(adp.alias("a")), F.struct("l_extendedprice", "l_discount"))["a"].alias("a"))
    per = one.groupBy("l_orderkey").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "a"))), lambda s: s["a"])).alias("pts"))
    rid = (F.col("l_orderkey") % 96 + 1).cast("string")
    return per.select(F.concat(F.lit("f"), F.floor(F.col("l_orderkey") / 96).cast("string"), F.lit("_"), (F.col("l_orderkey") % 96).cast("string")).alias("file"),
                      F.concat(F.lit('<react id="'), rid, F.lit('">'), "pts", F.lit("</react>")).alias("xml"))


@query("s05_plate_xml_rows", """WITH o AS (SELECT l_orderkey, l_linenumber, max((l_extendedprice, l_discount)) AS m FROM lineitem GROUP BY 1, 2)
SELECT 'f' || CAST(l_orderkey // 96 AS VARCHAR) || '_' || CAST(l_orderkey % 96 AS VARCHAR) AS file, chr(CAST(65 + (l_orderkey % 96) // 12 AS INTEGER)) || CAST((l_orderkey % 96) % 12 + 1 AS VARCHAR) AS position,
l_linenumber AS cycle, m[2] AS temp, m[1] AS fluor FROM o""")
def s05(spark, root):
    return tx.plate_curves(plate_xml(spark, root), "file", "xml")


@query("s06_plate_tsv", """SELECT 'P' || CAST(p_partkey AS VARCHAR) AS position, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS cq, p_type AS call, p_name AS sample_name FROM part""")
def s06(spark, root):
    p = table(spark, root, "part")
    rows = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Position"), F.when(F.col("p_size") % 4 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("Cq"),
                    F.col("p_type").alias("Call"), F.col("p_name").alias("Sample Name"))
    path = tb.scratch(spark, "plate")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    back = spark.read.schema("`Position` string, `Cq` string, `Call` string, `Sample Name` string").option("sep", "\t").option("header", True).csv(path)
    return back.select(F.trim("Position").alias("position"), F.expr("try_cast(trim(Cq) AS double)").alias("cq"), F.trim("Call").alias("call"), F.trim("Sample Name").alias("sample_name"))


SHEET = """sh AS (SELECT c_nationkey AS sheet, c_custkey AS pos, CASE WHEN c_custkey % 9 = 0 THEN 'NTC' ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 4 = 0 THEN ' - ' WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey % 40 AS VARCHAR) || '.5' END AS cell FROM customer)"""


def sheet(spark, root):
    k = F.col("c_custkey")
    cell = F.when(k % 4 == 0, " - ").when(k % 11 == 0, "").otherwise(F.concat((k % 40).cast("string"), F.lit(".5")))
    return table(spark, root, "customer").select(F.col("c_nationkey").alias("sheet"), k.alias("pos"), F.when(k % 9 == 0, "NTC").otherwise(F.col("c_mktsegment")).alias("label"), cell.alias("cell"))


@query("s07_plate_sheet", f"""WITH {SHEET} SELECT sheet, label, count(*) AS n_rows, count(TRY_CAST(nullif(trim(cell), '-') AS DOUBLE)) AS n_cq, {q6("avg(TRY_CAST(nullif(trim(cell), '-') AS DOUBLE))")} AS cq_mean FROM sh WHERE label <> 'NTC' GROUP BY 1, 2""")
def s07(spark, root):
    s = sheet(spark, root).filter("label <> 'NTC'").withColumn("cq", tx.number("cell"))
    return s.groupBy("sheet", "label").agg(F.count("*").alias("n_rows"), F.count("cq").alias("n_cq"), r6(F.avg("cq")).alias("cq_mean"))


@query("s08_two_chip_sheet", f"""WITH {SHEET}, n AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY pos) AS rn FROM sh WHERE trim(cell) <> '')
SELECT sheet, pos, CASE WHEN rn <= 10 THEN 'chip1' ELSE 'chip2' END AS chip, TRY_CAST(nullif(trim(cell), '-') AS DOUBLE) AS cq FROM n""")
def s08(spark, root):
    s = row_index(sheet(spark, root).filter("trim(cell) <> ''"), ["sheet"], ["pos"], "rn")
    return s.select("sheet", "pos", F.when(F.col("rn") < 10, "chip1").otherwise("chip2").alias("chip"), tx.number("cell").alias("cq"))


@query("s09_prediction_round_trip", f"WITH {PREDICTIONS} SELECT method_id, CAST(pixel_id % 3 AS INTEGER) AS seed, chip_id, well_id, pixel_id, {q6('ttp_pred')} AS ttp_pred, {q6('ttp_pred * 2')} AS density_sum FROM pred")
def s09(spark, root):
    p = predictions(spark, root).select("method_id", (F.col("pixel_id") % 3).cast("int").alias("seed"), "chip_id", "well_id", "pixel_id", "ttp_pred", F.array("ttp_pred", "ttp_pred").alias("density"))
    path = tb.scratch(spark, "predictions")
    tb.write_predictions(p, path)
    back = tb.read_predictions(spark, path, "density array<double>")
    return back.select("method_id", "seed", "chip_id", "well_id", "pixel_id", r6("ttp_pred").alias("ttp_pred"), r6(ar.total("density")).alias("density_sum"))


@query("s09_label_round_trip", f"WITH {PREDICTIONS} SELECT chip_id, well_id, pixel_id, {q6('ttp_true')} AS ttp_true, log10_conc, split FROM pred")
def s09_labels(spark, root):
    path = tb.scratch(spark, "labels")
    p = predictions(spark, root)
    tb.write_labels(p.select("chip_id", "well_id", "pixel_id", "ttp_true", "log10_conc", "split"), path)
    return tb.read_labels(spark, path).withColumn("ttp_true", r6("ttp_true"))


@query("s10_alignment_check", f"""WITH {PREDICTIONS}, p AS (SELECT DISTINCT chip_id, well_id, pixel_id FROM pred WHERE pixel_id % 10 <> 0), l AS (SELECT DISTINCT chip_id, well_id, pixel_id FROM pred WHERE pixel_id % 15 <> 0)
SELECT coalesce(p.chip_id, l.chip_id) AS chip_id, coalesce(p.well_id, l.well_id) AS well_id, coalesce(p.pixel_id, l.pixel_id) AS pixel_id, CASE WHEN p.pixel_id IS NULL THEN 'predictions' ELSE 'labels' END AS missing_in
FROM p FULL JOIN l ON p.chip_id = l.chip_id AND p.well_id = l.well_id AND p.pixel_id = l.pixel_id WHERE p.pixel_id IS NULL OR l.pixel_id IS NULL""")
def s10(spark, root):
    p = predictions(spark, root)
    return tb.misaligned(p.filter("pixel_id % 10 <> 0"), p.filter("pixel_id % 15 <> 0"))


@query("s12_append_run_index", f"WITH {RUNS} SELECT experiment, model, seed, count(*) AS n_epochs FROM runs GROUP BY 1, 2, 3")
def s12(spark, root):
    path = tb.scratch(spark, "run-index")
    per = runs(spark, root).groupBy("experiment", "model", "seed").agg(F.count("*").alias("n_epochs"))
    for part in ("seed <= 1", "seed > 1"):
        per.filter(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)


RAG = """rg AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'bad,line' WHEN o_orderkey % 5 = 0 THEN 'run ' || CAST(o_custkey AS VARCHAR) || ',x,fold,1,m,' || CAST(o_orderkey % 100 AS VARCHAR) ELSE 'run ' || CAST(o_custkey AS VARCHAR) || ',fold0,m,' || CAST(o_orderkey % 100 AS VARCHAR) END AS line FROM orders)"""


@query("s13_ragged_run_lines", f"""WITH {RAG}, p AS (SELECT o_orderkey, string_split(line, ',') AS p FROM rg)
SELECT o_orderkey, CASE len(p) WHEN 6 THEN p[1] || ',' || p[2] ELSE p[1] END AS run_id, CASE len(p) WHEN 6 THEN p[3] || ',' || p[4] ELSE p[2] END AS fold, p[len(p) - 1] AS model, CAST(p[len(p)] AS DOUBLE) AS loss FROM p WHERE len(p) IN (4, 6)""")
def s13(spark, root):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = F.when(k % 11 == 0, "bad,line").when(k % 5 == 0, F.concat(F.lit("run "), c, F.lit(",x,fold,1,m,"), (k % 100).cast("string"))).otherwise(F.concat(F.lit("run "), c, F.lit(",fold0,m,"), (k % 100).cast("string")))
    rows = table(spark, root, "orders").select("o_orderkey", line.alias("line"))
    return tx.ragged_runs(rows, "line")


@query("s14_run_discovery", f"WITH {RUNS} SELECT DISTINCT experiment, model, seed FROM runs WHERE model <> 'm3'")
def s14(spark, root):
    """Runs found by path, keeping those that have both files."""
    path = tb.scratch(spark, "runs")
    r = runs(spark, root).select("experiment", "model", F.concat(F.lit("seed"), F.col("seed").cast("string")).alias("run"), "epoch", "loss")
    both = r.withColumn("kind", F.lit("metrics")).unionByName(r.filter("model <> 'm3'").withColumn("kind", F.lit("preds")))
    both.write.partitionBy("experiment", "run", "kind").parquet(path)
    f = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("p"), "model")
    parts = f.select(F.regexp_extract("p", "experiment=([^/]+)/", 1).alias("experiment"), F.regexp_extract("p", "run=seed([0-9]+)/", 1).cast("int").alias("seed"), F.regexp_extract("p", "kind=([^/]+)/", 1).alias("kind"), "model")
    return parts.groupBy("experiment", "model", "seed").agg(F.count_distinct("kind").alias("kinds")).filter("kinds = 2").drop("kinds")


@query("s15_config_text", """WITH l AS (SELECT event_id, unnest(['k: ' || json_extract_string(props, '$.k'), 'name: "' || event_type || '"', 'note: free text: here']) AS line FROM events)
SELECT event_id, split_part(line, ': ', 1) AS k, CASE WHEN starts_with(line, 'note') THEN 'free text: here' ELSE trim(split_part(line, ': ', 2), '"') END AS val FROM l""")
def s15(spark, root):
    lines = F.array(F.concat(F.lit("k: "), F.get_json_object("props", "$.k")), F.concat(F.lit('name: "'), "event_type", F.lit('"')), F.lit("note: free text: here"))
    e = table(spark, root, "events").select("event_id", F.explode(lines).alias("line"))
    key, val = tx.config_entry("line")
    return e.select("event_id", key.alias("k"), val.alias("val"))


NEST = """SELECT 'chip' || CAST(c_nationkey AS VARCHAR) || '__well' || CAST(c_custkey AS VARCHAR) AS well_key, round(c_acctbal / 299, 3) AS chip_ttp_min FROM customer WHERE c_custkey % 5 <> 0"""


@query("s16_nested_label_json", NEST)
def s16(spark, root):
    c = table(spark, root, "customer")
    key = F.concat(F.lit("chip"), F.col("c_nationkey").cast("string"), F.lit("__well"), F.col("c_custkey").cast("string"))
    body = F.create_map(key, F.struct((F.col("c_custkey") % 5 == 0).alias("is_no_amp"), F.round(F.col("c_acctbal") / 299, 3).alias("chip_ttp_min")))
    path = tb.scratch(spark, "labels")
    c.select(F.to_json(body).alias("value")).write.text(path)
    m = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<is_no_amp:boolean,chip_ttp_min:double>>")).alias("well_key", "v"))
    return m.filter("NOT v.is_no_amp AND v.chip_ttp_min IS NOT NULL").select("well_key", F.col("v.chip_ttp_min").alias("chip_ttp_min"))


FUNNEL = ("n_total", "n_a", "n_b", "n_c", "n_d", "after_a", "after_b", "after_c", "after_d")


def export_filter_json(spark, root):
    """Per chip its thresholds, per well its funnel through the stages, per pixel a record; all as JSON lines, no group is gathered."""
    t = traces(spark, root)
    f = durable(ql.chip_filter(t, "ABCD", "pct"))
    path = tb.scratch(spark, "viewer")
    rounded = t.select(*WELL, "pixel_id", F.transform("x", lambda v: F.round(v, 3)).alias("trace"))
    px = f.select(*WELL, "pixel_id", "prow", "pcol", "a", "b", "c", "bad_count", "d", "score", "keep").join(rounded, [*WELL, "pixel_id"])
    px.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chip_id", "well_id", F.pmod(F.xxhash64("pixel_id"), F.lit(8))).write.partitionBy("chip_id").json(f"{path}/pixels")
    gone, stages = F.lit(False), []
    for c in "abcd":
        gone = gone | F.col(c)
        stages.append(F.count_if(~gone).alias(f"after_{c}"))
    wells = f.groupBy(*WELL).agg(F.struct(F.count("*").alias("n_total"), *[F.count_if(c).alias(f"n_{c}") for c in "abcd"], *stages).alias("funnel"))
    wells.write.json(f"{path}/wells")
    chips = ql.control_thresholds(ql.with_stats(t), "pct").select("chip_id", "n_ntc", F.struct(*[F.col(f"thr_{c}").alias(c) for c in ql.STATS]).alias("thresholds"))
    chips.write.json(f"{path}/chips")
    return path


@query("s17_nested_json_export", f"""WITH {_filter_sql('pct')}, w AS (SELECT chip_id, well_id, count(*) AS n_total, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (c) AS n_c, count(*) FILTER (d) AS n_d,
  count(*) FILTER (NOT a) AS after_a, count(*) FILTER (NOT (a OR b)) AS after_b, count(*) FILTER (NOT (a OR b OR c)) AS after_c, count(*) FILTER (NOT (a OR b OR c OR d)) AS after_d FROM fin GROUP BY 1, 2)
SELECT w.*, n_ntc, {', '.join(f'{q6(f"thr_{c}")} AS thr_{c}' for c in ql.STATS)} FROM w JOIN thr USING (chip_id)""")
def s17(spark, root):
    path = export_filter_json(spark, root)
    w = spark.read.schema(f"chip_id string, well_id int, funnel struct<{', '.join(f'{c}:bigint' for c in FUNNEL)}>").json(f"{path}/wells")
    c = spark.read.schema(f"chip_id string, n_ntc bigint, thresholds struct<{', '.join(f'{c}:double' for c in ql.STATS)}>").json(f"{path}/chips")
    return w.join(c, "chip_id").select(*WELL, "funnel.*", "n_ntc", *[r6(f"thresholds.{s}").alias(f"thr_{s}") for s in ql.STATS])


@query("s17_pixel_records", f"""WITH {_filter_sql('pct')} SELECT chip_id, well_id, pixel_id, CASE WHEN a THEN 'A' WHEN b THEN 'B' END AS layer_ab, c AS c_dropped, nullif(bad_count, -1) AS c_score, d AS d_dropped,
  {q6('q.score')} AS d_score, CAST(len(x) AS INTEGER) AS n_samples FROM fin LEFT JOIN (SELECT pixel_id, score FROM dsc) q USING (pixel_id)""")
def s17_pixels(spark, root):
    kind = "chip_id string, well_id int, pixel_id bigint, a boolean, b boolean, c boolean, bad_count int, d boolean, score double, trace array<double>"
    p = spark.read.schema(kind).json(f"{export_filter_json(spark, root)}/pixels")
    layer = F.when(F.col("a"), "A").when(F.col("b"), "B")
    return p.select(*WELL, "pixel_id", layer.alias("layer_ab"), F.col("c").alias("c_dropped"), F.nullif("bad_count", F.lit(-1)).alias("c_score"), F.col("d").alias("d_dropped"),
                    r6("score").alias("d_score"), F.size("trace").alias("n_samples"))


@query("s18_sampled_cells", f"""WITH {TRACES}, s AS (SELECT *, row_number() OVER (PARTITION BY chip_id, well_id ORDER BY {_hash(9, ['pixel_id'])}, pixel_id) AS rn FROM traces)
SELECT chip_id, well_id, pixel_id, CAST(ceil(len(x) / CAST(8 AS DOUBLE)) AS INTEGER) AS n_points, {q6('list_sum([x[i] for i in range(1, 65, 8)])')} AS total FROM s WHERE rn <= 4""")
def s18(spark, root):
    s = capped_sample(traces(spark, root), WELL, ["pixel_id"], 4, 9)
    s = s.withColumn("x", F.filter("x", lambda v, i: i % 8 == 0))
    return s.select(*WELL, "pixel_id", F.size("x").alias("n_points"), r6(ar.total("x")).alias("total"))


@query("s19_failure_dump", f"WITH {CLS} SELECT method_id, chip_id, well_id, count(*) AS n_wrong FROM cls WHERE (y_score >= 0.5) <> (y_true = 1) GROUP BY 1, 2, 3")
def s19(spark, root):
    path = tb.scratch(spark, "failures")
    c = cls_scores(spark, root)
    c.filter((F.col("y_score") >= 0.5).cast("int") != F.col("y_true")).write.parquet(path)
    return spark.read.parquet(path).groupBy("method_id", "chip_id", "well_id").agg(F.count("*").alias("n_wrong"))


@query("s20_nested_json_flatten", "SELECT o_custkey AS chip, 'w' || CAST(o_orderkey % 4 AS VARCHAR) AS well, o_orderkey AS pixel_id, o_orderstatus AS label FROM orders")
def s20(spark, root):
    """Chip documents with wells and pixels, one per order, flattened to rows."""
    o = table(spark, root, "orders")
    wells = F.create_map(F.concat(F.lit("w"), (F.col("o_orderkey") % 4).cast("string")), F.struct(F.col("o_orderstatus").alias("label"), F.array(F.struct(F.col("o_orderkey").alias("pixel_id"))).alias("pixels")))
    path = tb.scratch(spark, "chips")
    o.select(F.to_json(F.struct(F.col("o_custkey").alias("chip"), wells.alias("wells"))).alias("value")).write.text(path)
    doc = spark.read.schema("chip bigint, wells map<string,struct<label:string,pixels:array<struct<pixel_id:bigint>>>>").json(path)
    return doc.select("chip", F.explode("wells").alias("well", "w")).select("chip", "well", F.col("w.label").alias("label"), F.inline("w.pixels"))


@query("s21_prediction_collection", f"WITH {PREDICTIONS} SELECT method_id AS run, regexp_extract(method_id, '^(fam[0-9]+)', 1) AS model, count(*) AS n, {q6('sum(ttp_pred)', 3)} AS total FROM pred WHERE NOT starts_with(method_id, 'fam2') GROUP BY 1, 2")
def s21(spark, root):
    path = tb.scratch(spark, "predictions")
    predictions(spark, root).withColumn("seed", F.lit(0)).select("method_id", "seed", "chip_id", "well_id", "pixel_id", "ttp_pred").write.partitionBy("method_id", "seed").parquet(path)
    p = tb.read_predictions(spark, path).withColumn("model", F.regexp_extract("method_id", "^(fam[0-9]+)", 1)).filter(~F.col("model").isin("fam2"))
    return p.groupBy(F.col("method_id").alias("run"), "model").agg(F.count("*").alias("n"), r6(F.sum("ttp_pred"), 3).alias("total"))


@query("s22_scoreboard_scan", """SELECT s_suppkey, coalesce(TRY_CAST(CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' WHEN s_suppkey % 7 = 0 THEN '' ELSE CAST(s_acctbal AS VARCHAR) END AS DOUBLE), CAST('inf' AS DOUBLE)) AS mae FROM supplier""")
def s22(spark, root):
    k = F.col("s_suppkey")
    raw = table(spark, root, "supplier").select(k, F.when(k % 6 == 0, "n/a").when(k % 7 == 0, "").otherwise(F.col("s_acctbal").cast("string")).alias("mae"))
    path = tb.scratch(spark, "scoreboard")
    raw.write.option("header", True).csv(path)
    back = spark.read.schema("s_suppkey bigint, mae string").option("header", True).csv(path)
    # an infinite default keeps unreadable rows last in every ascending ranking
    return back.select("s_suppkey", F.coalesce(F.expr("try_cast(mae AS double)"), F.lit(float("inf"))).alias("mae"))
