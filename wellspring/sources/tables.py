"""Trace, prediction and label tables: typed readers, partitioned writers, key checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.session import ensure_checkpoint_dir

# Column names and types of the stored tables.
TRACE_SCHEMA = "chip_id string, well_id int, pixel_id bigint, prow int, pcol int, is_ntc boolean, y int, x array<double>"
PREDICTION_SCHEMA = "method_id string, seed int, chip_id string, well_id int, pixel_id bigint, ttp_pred double"
LABEL_SCHEMA = "chip_id string, well_id int, pixel_id bigint, ttp_true double, log10_conc double, split string"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan; Spark reports a missing path. NaN samples become NULL once, here."""
    df = spark.read.schema(TRACE_SCHEMA).parquet(path)
    return df.withColumn("x", F.transform("x", lambda v: F.when(~F.isnan(v), v)))


def write_traces(df: DataFrame, path: str) -> DataFrame:
    """Write partitioned by chip and return the log of rows per chip.

    Rows are spread by (chip, pixel hash), so a chip with most of the data still has many writers.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("pixel_id"), F.lit(max(parts // 4, 1)))
    df.repartition(parts, F.col("chip_id"), salt).write.mode("overwrite").partitionBy("chip_id").parquet(path)
    return spark.read.parquet(path).groupBy("chip_id").agg(F.count("*").alias("n_written"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("method_id", "seed").parquet(path)


def read_predictions(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """``extra`` names further typed columns, such as ``density array<double>``."""
    return spark.read.schema(PREDICTION_SCHEMA + (f", {extra}" if extra else "")).parquet(path)


def write_labels(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("split").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).parquet(path)


def misaligned(preds: DataFrame, labels: DataFrame, keys=("chip_id", "well_id", "pixel_id")) -> DataFrame:
    """Keys present on one side only."""
    p = preds.select(*keys).distinct().withColumn("_p", F.lit(True))
    q = labels.select(*keys).distinct().withColumn("_q", F.lit(True))
    both = p.join(q, list(keys), "full")
    return both.filter("_p IS NULL OR _q IS NULL").withColumn("missing_in", F.when(F.col("_p").isNull(), "predictions").otherwise("labels")).drop("_p", "_q")


def validate_alignment(preds: DataFrame, labels: DataFrame) -> None:
    if not misaligned(preds, labels).isEmpty():
        raise ValueError("predictions and labels cover different keys")
