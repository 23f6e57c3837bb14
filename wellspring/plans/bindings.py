"""How the given tables stand in for traces, scores, doses and runs (Spark and SQL forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.functions.kernels import running_sum
from wellspring.operators.ranking import row_index
from wellspring.session import table_path


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(root, name))


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0 so results compare by value."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# --- array traces: embeddings -----------------------------------------------------------
def traces(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(
        F.concat(F.lit("chip"), (F.col("vec_id") % 5).cast("string")).alias("chip_id"),
        F.col("label").alias("well_id"),
        F.col("vec_id").alias("pixel_id"),
        F.floor(F.col("vec_id") / 25).cast("int").alias("prow"),
        (F.col("vec_id") % 25).cast("int").alias("pcol"),
        (F.col("label") == 0).alias("is_ntc"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


TRACES = """traces AS (
  SELECT 'chip' || CAST(vec_id % 5 AS VARCHAR) AS chip_id, label AS well_id, vec_id AS pixel_id,
         CAST(vec_id // 25 AS INTEGER) AS prow, CAST(vec_id % 25 AS INTEGER) AS pcol,
         label = 0 AS is_ntc, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x
  FROM embeddings)"""

TRACES_LONG = TRACES + """, tl AS (
  SELECT chip_id, well_id, pixel_id, prow, pcol, is_ntc, y,
         CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS t, unnest(x) AS v
  FROM traces)"""


def long(df: DataFrame, *keep: str, x: str = "x", v: str = "v") -> DataFrame:
    """One row per sample: t (0-based) and v."""
    return df.select(*keep, F.posexplode(x).alias("t", v))


# --- rising curves: running sum of absolute embedding values --------------------------------
def curves(spark: SparkSession, root: str) -> DataFrame:
    """Monotone traces: running sum of |v|."""
    return traces(spark, root).withColumn("x", running_sum()("x"))


CURVES_LONG = TRACES_LONG + """, cl AS (
  SELECT chip_id, well_id, pixel_id, prow, pcol, is_ntc, y, t,
         sum(abs(v)) OVER (PARTITION BY pixel_id ORDER BY t) AS v FROM tl)"""


# --- scores: squashed trace values ------------------------------------------------------
WINDOW, STRIDE = 8, 4


def scores(spark: SparkSession, root: str) -> DataFrame:
    squash = F.transform("x", lambda v: 1.0 / (1.0 + F.exp(-20.0 * v)))
    return traces(spark, root).select("chip_id", "well_id", "pixel_id", "y", squash.alias("p"))


SCORES = TRACES + """, sc AS (
  SELECT chip_id, well_id, pixel_id, y,
         list_transform(x, lambda v: 1.0 / (1.0 + exp(-20.0 * v))) AS p FROM traces)"""

SCORES_LONG = SCORES + f""", sl AS (
  SELECT chip_id, well_id, pixel_id, t, p, (t * {STRIDE} + ({WINDOW} - 1) / 2.0) / 15.0 AS c
  FROM (SELECT chip_id, well_id, pixel_id,
               CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS t, unnest(p) AS p FROM sc))"""


# --- long series: events per user -------------------------------------------------------
def series(spark: SparkSession, root: str) -> DataFrame:
    ev = table(spark, root, "events").select("user_id", "ts", "event_id", "value")
    idx = row_index(ev, ["user_id"], ["ts", "event_id"], "t")
    return idx.select(
        F.col("user_id").alias("sid"), F.col("t").cast("int").alias("t"), F.col("value").alias("v")
    )


SERIES = """series AS (
  SELECT user_id AS sid, value AS v,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t
  FROM events)"""


# --- predicted and true times with doses: orders -----------------------------------------
def predictions(spark: SparkSession, root: str) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    true = 30.0 - 3.0 * (level + 4)
    return table(spark, root, "orders").select(
        F.concat(
            F.lit("fam"), (F.col("o_custkey") % 3).cast("string"),
            F.lit("_seed"), (F.floor(F.col("o_custkey") / 3) % 4).cast("string"),
        ).alias("method_id"),
        F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("chip_id"),
        ((level - 1) * 2 + F.col("o_orderkey") % 2).cast("int").alias("well_id"),
        F.col("o_orderkey").alias("pixel_id"),
        (true + (F.col("o_totalprice") - 150000.0) / 39999.0).alias("ttp_pred"),
        true.cast("double").alias("ttp_true"),
        (level + 4).cast("double").alias("log10_conc"),
        F.when(F.month("o_orderdate") <= 6, "train").otherwise("test").alias("split"),
    )


PREDICTIONS = """lv AS (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS lvl FROM orders),
pred AS (
  SELECT 'fam' || CAST(o_custkey % 3 AS VARCHAR) || '_seed' || CAST((o_custkey // 3) % 4 AS VARCHAR) AS method_id,
         'c' || CAST(o_orderkey % 3 AS VARCHAR) AS chip_id,
         CAST((lvl - 1) * 2 + o_orderkey % 2 AS INTEGER) AS well_id, o_orderkey AS pixel_id,
         CAST(30.0 - 3.0 * (lvl + 4) AS DOUBLE) + (o_totalprice - CAST(150000 AS DOUBLE)) / CAST(39999 AS DOUBLE) AS ttp_pred,
         CAST(30.0 - 3.0 * (lvl + 4) AS DOUBLE) AS ttp_true, CAST(lvl + 4 AS DOUBLE) AS log10_conc,
         CASE WHEN month(o_orderdate) <= 6 THEN 'train' ELSE 'test' END AS split
  FROM lv)"""


# --- classifier scores: lineitem --------------------------------------------------------
def cls_scores(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.concat(F.lit("cont_"), F.col("l_returnflag")).alias("method_id"),
        (F.col("l_linenumber") % 3).cast("int").alias("seed"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("chip_id"),
        (F.col("l_partkey") % 6).cast("int").alias("well_id"),
        F.col("l_orderkey").alias("pixel_id"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("y_true"),
        (F.col("l_quantity") / F.lit(50.0)).alias("y_score"),
    )


CLS = """cls AS (
  SELECT 'cont_' || l_returnflag AS method_id, CAST(l_linenumber % 3 AS INTEGER) AS seed,
         's' || CAST(l_suppkey % 5 AS VARCHAR) AS chip_id, CAST(l_partkey % 6 AS INTEGER) AS well_id,
         l_orderkey AS pixel_id, CASE WHEN l_discount >= CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END AS y_true,
         l_quantity / CAST(50 AS DOUBLE) AS y_score
  FROM lineitem)"""


# --- run logs: events -------------------------------------------------------------------
def runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per logged epoch of a run (experiment, model, seed)."""
    return table(spark, root, "events").select(
        F.col("event_type").alias("experiment"),
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"),
        (F.floor(F.col("user_id") / 4) % 5).cast("int").alias("seed"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("loss"),
    )


RUNS = """runs AS (
  SELECT event_type AS experiment, 'm' || CAST(user_id % 4 AS VARCHAR) AS model,
         CAST((user_id // 4) % 5 AS INTEGER) AS seed, event_id AS epoch, value AS loss
  FROM events)"""
