"""Queries for the quality layers and their building blocks."""

from pyspark.sql import functions as F

from wellspring.operators import quality as ql
from wellspring.operators.ranking import median_mad
from wellspring.operators.spatial import WELL, nearest
from wellspring.plans import query
from wellspring.plans.bindings import TRACES, q6, r6, traces

STATS_SQL = TRACES + """, st AS (
  SELECT *, list_max(x) - list_min(x) AS dyn_range, x[len(x)] - x[1] AS net_slope, list_min(x) AS trace_min FROM traces)"""


def _thr(rule: str, src: str = "st", k: float = 1.5) -> str:
    parts, cols = [], []
    for s in ql.STATS:
        parts.append(f"median({s}) AS med_{s}, quantile_cont({s}, CAST(0.05 AS DOUBLE)) AS p_{s}")
        cols.append(f"1.4826 * median(abs(s.{s} - m.med_{s})) AS mad_{s}")
    thr = ", ".join(
        f"m.med_{s}, d.mad_{s}, " + (f"m.p_{s}" if rule == "pct" else f"m.med_{s} - CAST({k} AS DOUBLE) * d.mad_{s}") + f" AS thr_{s}"
        for s in ql.STATS
    )
    return f""", ctl AS (SELECT * FROM {src} WHERE is_ntc),
cm AS (SELECT chip_id, count(*) AS n_ntc, {', '.join(parts)} FROM ctl GROUP BY chip_id),
cd AS (SELECT s.chip_id, {', '.join(cols)} FROM ctl s JOIN cm m USING (chip_id) GROUP BY s.chip_id),
thr AS (SELECT m.chip_id, m.n_ntc, {thr} FROM cm m JOIN cd d USING (chip_id))"""


def _thr_query(rule):
    return (
        f"WITH {STATS_SQL}{_thr(rule)} SELECT chip_id, n_ntc, "
        + ", ".join(f"{q6(p + '_' + s)} AS {p}_{s}" for s in ql.STATS for p in ("med", "mad", "thr"))
        + " FROM thr"
    )


def _thr_df(spark, root, rule):
    t = ql.control_thresholds(ql.with_stats(traces(spark, root)), rule)
    return t.select("chip_id", "n_ntc", *[r6(f"{p}_{s}").alias(f"{p}_{s}") for s in ql.STATS for p in ("med", "mad", "thr")])


@query("a03_control_thresholds_pct", _thr_query("pct"))
def a03(spark, root):
    return _thr_df(spark, root, "pct")


@query("a04_control_thresholds_mad", _thr_query("mad"))
def a04(spark, root):
    return _thr_df(spark, root, "mad")


@query("a02_median_mad", """WITH m AS (SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, m.n, round(m.med, 4) AS med, round(1.4826 * median(abs(l.l_extendedprice - m.med)), 4) AS mad
FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY l.l_returnflag, m.n, m.med""")
def a02(spark, root):
    from wellspring.plans.bindings import table

    mm = median_mad(table(spark, root, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return mm.select("l_returnflag", "n", F.round("med", 4).alias("med"), F.round("mad", 4).alias("mad"))


AB_SQL = """, ab0 AS (
  SELECT s.*, dyn_range < thr_dyn_range AS a0, net_slope < thr_net_slope OR trace_min < thr_trace_min AS b0
  FROM st s JOIN thr USING (chip_id))"""
AB_ALL = AB_SQL + ", ab AS (SELECT *, a0 AS a, b0 AND NOT a0 AS b FROM ab0)"
AB_POS = AB_SQL + ", ab AS (SELECT *, a0 AND NOT is_ntc AS a, b0 AND NOT a0 AND NOT is_ntc AS b FROM ab0)"


@query("q01_layers_ab", f"""WITH {STATS_SQL}{_thr('pct')}{AB_ALL}
SELECT chip_id, well_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (a) AS BIGINT) AS n_a, CAST(count(*) FILTER (b) AS BIGINT) AS n_b
FROM ab GROUP BY 1, 2""")
def q01(spark, root):
    s = ql.with_stats(traces(spark, root))
    ab = ql.layers_ab(s, ql.control_thresholds(s, "pct"))
    return ab.groupBy(*WELL).agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"))


def _knn_sql(src: str, name: str, k: int = 8) -> str:
    return f""", {name} AS (
  SELECT * FROM (
    SELECT p.chip_id, p.well_id, p.pixel_id, n.pixel_id AS nbr,
           CAST((p.prow - n.prow) * (p.prow - n.prow) + (p.pcol - n.pcol) * (p.pcol - n.pcol) AS BIGINT) AS d2,
           CAST(row_number() OVER (PARTITION BY p.chip_id, p.well_id, p.pixel_id
             ORDER BY (p.prow - n.prow) * (p.prow - n.prow) + (p.pcol - n.pcol) * (p.pcol - n.pcol), n.prow, n.pcol, n.pixel_id) AS INTEGER) AS nrank
    FROM {src} p JOIN {src} n ON p.chip_id = n.chip_id AND p.well_id = n.well_id AND p.pixel_id <> n.pixel_id) z
  WHERE nrank <= {k})"""


@query("j07_nearest_pixels", f"WITH {TRACES}{_knn_sql('traces', 'knn')} SELECT * FROM knn")
def j07(spark, root):
    return nearest(traces(spark, root), 8)


def _c_sql(src="ab", k=8, need=4):
    return _knn_sql(src, "knc", k) + f""", vote AS (
  SELECT e.chip_id, e.well_id, e.pixel_id, count(*) AS n, count(*) FILTER (b.a OR b.b) AS v
  FROM knc e JOIN {src} b ON e.chip_id = b.chip_id AND e.well_id = b.well_id AND e.nbr = b.pixel_id GROUP BY 1, 2, 3),
abc AS (SELECT z.*, bad_count >= {need} AND NOT (a OR b) AND NOT is_ntc AS c FROM (
  SELECT f.*, CAST(CASE WHEN vote.n = {k} THEN vote.v ELSE -1 END AS INTEGER) AS bad_count
  FROM {src} f LEFT JOIN vote ON f.chip_id = vote.chip_id AND f.well_id = vote.well_id AND f.pixel_id = vote.pixel_id) z)"""


@query("q02_layer_c", f"""WITH {STATS_SQL}{_thr('pct')}{AB_POS}{_c_sql()}
SELECT pixel_id, bad_count, c FROM abc""")
def q02(spark, root):
    s = ql.with_stats(traces(spark, root))
    ab = ql.layers_ab(s, ql.control_thresholds(s, "pct"))
    ab = ab.withColumn("a", F.col("a") & ~F.col("is_ntc")).withColumn("b", F.col("b") & ~F.col("is_ntc"))
    return ql.layer_c(ab).select("pixel_id", "bad_count", "c")


def _score_sql(src: str, name: str, metric: str = "median", k: int = 8) -> str:
    fn = {"median": "median", "mean": "avg"}.get(metric)
    knn = _knn_sql(src, f"kn_{name}", k)
    pick = f"kn_{name}" if fn else f"(SELECT chip_id, well_id, pixel_id, arg_max(nbr, nrank) AS nbr, count(*) AS n FROM kn_{name} GROUP BY 1, 2, 3)"
    full = f"full_{name} AS (SELECT chip_id, well_id, pixel_id FROM kn_{name} GROUP BY 1, 2, 3 HAVING count(*) = {k})"
    return knn + f""", {full}, ln_{name} AS (
  SELECT chip_id, well_id, pixel_id, generate_subscripts(x, 1) AS t, unnest(x) AS v FROM {src}),
ref_{name} AS (
  SELECT e.chip_id, e.well_id, e.pixel_id, l.t, {fn or 'max'}(l.v) AS rv
  FROM {pick} e JOIN full_{name} USING (chip_id, well_id, pixel_id)
  JOIN ln_{name} l ON l.chip_id = e.chip_id AND l.well_id = e.well_id AND l.pixel_id = e.nbr GROUP BY 1, 2, 3, 4),
{name} AS (
  SELECT l.chip_id, l.well_id, l.pixel_id, sqrt(sum((l.v - r.rv) * (l.v - r.rv))) AS score
  FROM ln_{name} l JOIN ref_{name} r USING (chip_id, well_id, pixel_id, t) GROUP BY 1, 2, 3)"""


@query("q03_disagreement_median", f"WITH {TRACES}{_score_sql('traces', 'sco')} SELECT pixel_id, {q6('score')} AS score FROM sco")
def q03(spark, root):
    return ql.disagreement(traces(spark, root)).select("pixel_id", r6("score").alias("score"))


@query("q03_disagreement_mean", f"WITH {TRACES}{_score_sql('traces', 'sco', 'mean')} SELECT pixel_id, {q6('score')} AS score FROM sco")
def q03_mean(spark, root):
    return ql.disagreement(traces(spark, root), "mean").select("pixel_id", r6("score").alias("score"))


@query("q03_disagreement_kth", f"WITH {TRACES}{_score_sql('traces', 'sco', 'kth')} SELECT pixel_id, {q6('score')} AS score FROM sco")
def q03_kth(spark, root):
    return ql.disagreement(traces(spark, root), "kth").select("pixel_id", r6("score").alias("score"))


def _cut_sql(score: str, name: str, rule: str, k: float = 1.5) -> str:
    if rule == "pct":
        return f", {name} AS (SELECT chip_id, well_id, quantile_cont(score, CAST(0.95 AS DOUBLE)) AS cut FROM {score} GROUP BY 1, 2)"
    return f""", m_{name} AS (SELECT chip_id, well_id, median(score) AS med FROM {score} GROUP BY 1, 2),
{name} AS (SELECT chip_id, well_id, any_value(med) + CAST({k} AS DOUBLE) * 1.4826 * median(abs(score - med)) AS cut
  FROM {score} JOIN m_{name} USING (chip_id, well_id) GROUP BY 1, 2)"""


def _layer_d_query(rule):
    return f"""WITH {TRACES}{_score_sql('traces', 'sco')}{_cut_sql('sco', 'cut', rule)}
SELECT pixel_id, {q6('score')} AS score, {q6('cut')} AS cut, score > cut AS d FROM sco JOIN cut USING (chip_id, well_id)"""


def _layer_d_df(spark, root, rule):
    return ql.layer_d(traces(spark, root), rule).select("pixel_id", r6("score").alias("score"), r6("cut").alias("cut"), "d")


@query("q03_layer_d_pct", _layer_d_query("pct"))
def q03_pct(spark, root):
    return _layer_d_df(spark, root, "pct")


@query("q04_layer_d_mad", _layer_d_query("mad"))
def q04(spark, root):
    return _layer_d_df(spark, root, "mad")


def _filter_sql(rule: str, clean: bool = False, ntc: str = "is_ntc", k: float = 1.5) -> str:
    """Full ABCD filter; ends with CTE ``fin`` (flags and keep)."""
    base = STATS_SQL.replace("label = 0 AS is_ntc", f"{ntc} AS is_ntc") if ntc != "is_ntc" else STATS_SQL
    sql = base
    src = "st"
    if clean:
        sql += ", nt AS (SELECT * FROM st WHERE is_ntc)" + _score_sql("nt", "nsc") + _cut_sql("nsc", "ncut", rule, k)
        sql += """, nd AS (SELECT pixel_id FROM nsc JOIN ncut USING (chip_id, well_id) WHERE score > cut),
stc AS (SELECT * FROM st WHERE pixel_id NOT IN (SELECT pixel_id FROM nd))"""
        src = "stc"
    else:
        sql += ", nd AS (SELECT pixel_id FROM st WHERE false)"
    sql += _thr(rule, src, k) + AB_POS + _c_sql()
    sql += ", sv AS (SELECT * FROM abc WHERE NOT (a OR b OR c))" + _score_sql("sv", "dsc") + _cut_sql("dsc", "dcut", rule, k)
    sql += """, fin AS (
  SELECT f.*, coalesce(q.score > q.cut, false) AS d, f.pixel_id IN (SELECT pixel_id FROM nd) AS ntc_d
  FROM abc f LEFT JOIN (SELECT * FROM dsc JOIN dcut USING (chip_id, well_id)) q USING (chip_id, well_id, pixel_id)),
kept AS (SELECT *, NOT (a OR b OR c OR d OR ntc_d) AS keep FROM fin)"""
    return sql


FUNNEL_COLS = """chip_id, well_id, count(*) AS n_total, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b,
count(*) FILTER (c) AS n_c, count(*) FILTER (d) AS n_d, count(*) FILTER (ntc_d) AS n_ntc_d, count(*) FILTER (keep) AS n_kept"""


def funnel(flags):
    return flags.groupBy(*WELL).agg(
        F.count("*").alias("n_total"),
        *[F.count_if(c).alias(f"n_{c}") for c in ("a", "b", "c", "d", "ntc_d")],
        F.count_if("keep").alias("n_kept"),
    )


@query("q05_chip_filter_pct", f"WITH {_filter_sql('pct', True)} SELECT {FUNNEL_COLS} FROM kept GROUP BY 1, 2")
def q05(spark, root):
    return funnel(ql.chip_filter(traces(spark, root), "ABCD", "pct", clean_controls_first=True))


@query("q06_chip_filter_mad", f"WITH {_filter_sql('mad')} SELECT {FUNNEL_COLS} FROM kept GROUP BY 1, 2")
def q06(spark, root):
    return funnel(ql.chip_filter(traces(spark, root), "ABCD", "mad"))


def _pooled(spark, root):
    return traces(spark, root).withColumn("is_ntc", F.col("well_id").isin(0, 1))


@query("q07_pooled_controls_pct", f"WITH {_filter_sql('pct', ntc='label IN (0, 1)')} SELECT {FUNNEL_COLS} FROM kept GROUP BY 1, 2")
def q07(spark, root):
    return funnel(ql.chip_filter(_pooled(spark, root), "ABCD", "pct"))


@query("q07_pooled_controls_mad", f"WITH {_filter_sql('mad', ntc='label IN (0, 1)')} SELECT {FUNNEL_COLS} FROM kept GROUP BY 1, 2")
def q07_mad(spark, root):
    return funnel(ql.chip_filter(_pooled(spark, root), "ABCD", "mad"))


@query("q08_filtered_table", f"""WITH {_filter_sql('mad')}
SELECT chip_id, well_id, pixel_id, prow, pcol, y, 'ABCD_mad_k1p5' AS cache_id, {q6('dyn_range')} AS dyn_range, CAST(len(x) AS INTEGER) AS n_samples, {q6('list_sum(x)')} AS total FROM kept WHERE keep""")
def q08(spark, root):
    """The sink: traces that stay are written under a name made of the parameters, and read back with all samples."""
    from wellspring.functions import arrays as ar
    from wellspring.sources import tables as tb

    path, _ = ql.write_filtered(traces(spark, root), tb.scratch(spark, "filtered"), "ABCD", "mad", 1.5)
    kept = ql.with_stats(tb.read_traces(spark, path))
    return kept.select(*WELL, "pixel_id", "prow", "pcol", "y", F.lit(path.rsplit("/", 1)[-1]).alias("cache_id"), r6("dyn_range").alias("dyn_range"), F.size("x").alias("n_samples"), r6(ar.total("x")).alias("total"))


@query("q08_filtered_log", f"WITH {_filter_sql('pct', True)} SELECT chip_id, count(*) AS n_written, 'ABCD_pct_ntcclean' AS cache_id FROM kept WHERE keep GROUP BY 1")
def q08_log(spark, root):
    from wellspring.sources import tables as tb

    path, log = ql.write_filtered(traces(spark, root), tb.scratch(spark, "filtered"), "ABCD", "pct", clean_controls_first=True)
    return log.withColumn("cache_id", F.lit(path.rsplit("/", 1)[-1]))


@query("a26_filter_funnel", f"""WITH {_filter_sql('pct')}
SELECT chip_id, well_id, count(*) AS n_total, count(*) FILTER (NOT a) AS after_a, count(*) FILTER (NOT (a OR b)) AS after_b,
count(*) FILTER (NOT (a OR b OR c)) AS after_c, count(*) FILTER (NOT (a OR b OR c OR d)) AS after_d FROM kept GROUP BY 1, 2""")
def a26(spark, root):
    f = ql.chip_filter(traces(spark, root), "ABCD", "pct")
    return f.groupBy(*WELL).agg(
        F.count("*").alias("n_total"),
        F.count_if(~F.col("a")).alias("after_a"),
        F.count_if(~(F.col("a") | F.col("b"))).alias("after_b"),
        F.count_if(~(F.col("a") | F.col("b") | F.col("c"))).alias("after_c"),
        F.count_if(~(F.col("a") | F.col("b") | F.col("c") | F.col("d"))).alias("after_d"),
    )


@query("a39_retention_fractions", f"""WITH {_filter_sql('mad')}
SELECT chip_id, well_id, {q6('count(*) FILTER (NOT a) / CAST(count(*) AS DOUBLE)')} AS frac_a,
{q6('count(*) FILTER (NOT (a OR b OR c)) / CAST(count(*) AS DOUBLE)')} AS frac_abc,
{q6('count(*) FILTER (keep) / CAST(count(*) AS DOUBLE)')} AS frac_kept FROM kept GROUP BY 1, 2""")
def a39(spark, root):
    f = ql.chip_filter(traces(spark, root), "ABCD", "mad")
    n = F.count("*")
    return f.groupBy(*WELL).agg(
        r6(F.try_divide(F.count_if(~F.col("a")), n)).alias("frac_a"),
        r6(F.try_divide(F.count_if(~(F.col("a") | F.col("b") | F.col("c"))), n)).alias("frac_abc"),
        r6(F.try_divide(F.count_if("keep"), n)).alias("frac_kept"),
    )
