"""Column parsers for plate exports, run logs and nested label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plate_position(rid: Column) -> Column:
    """Reaction number from 1 to plate position A1..H12."""
    i = (rid - 1).cast("int")
    return F.concat(F.char(F.floor(i / 12) + 65), (i % 12 + 1).cast("string"))


def plate_curves(df: DataFrame, file: str, xml: str) -> DataFrame:
    """Rows (file, position, cycle, temp, fluor) from plate XML text."""
    react = F.regexp_extract_all(xml, F.lit(r"(?s)<react id=\"(\d+)\">(.*?)</react>"), F.lit(0))
    per = df.select(file, F.explode(react).alias("_r"))
    rid = F.regexp_extract("_r", r"<react id=\"(\d+)\">", 1).cast("int")
    points = F.regexp_extract_all("_r", F.lit(r"(?s)<adp>(.*?)</adp>"), F.lit(1))
    long = per.select(file, plate_position(rid).alias("position"), F.explode(points).alias("_p"))
    num = lambda tag: F.regexp_extract("_p", f"<{tag}>([^<]*)</{tag}>", 1)
    return long.select(file, "position", num("cyc").cast("int").alias("cycle"), num("tmp").cast("double").alias("temp"), num("fluor").cast("double").alias("fluor"))


def number(col) -> Column:
    """Best-effort float: blanks, dashes and other text become NULL."""
    return F.expr(f"try_cast(nullif(trim({col}), '-') AS double)")


def ragged_runs(df: DataFrame, line: str) -> DataFrame:
    """Comma lines of four fields; with two extra commas run id and fold are stitched back; others drop."""
    p = F.split(line, ",")
    d = df.withColumn("_p", p).filter(F.size("_p").isin(4, 6))
    pick = lambda a, b: F.when(F.size("_p") == 6, a).otherwise(b)
    g = lambda i: F.get("_p", F.lit(i))
    return d.select(
        *[c for c in df.columns if c != line],
        pick(F.concat_ws(",", g(0), g(1)), g(0)).alias("run_id"), pick(F.concat_ws(",", g(2), g(3)), g(1)).alias("fold"),
        pick(g(4), g(2)).alias("model"), pick(g(5), g(3)).cast("double").alias("loss"))


def config_entry(line: str) -> tuple[Column, Column]:
    """``key: <json>`` into key and value; text that is not a JSON string stays as it is."""
    parts = F.split(line, ": ", 2)
    raw = F.get(parts, F.lit(1))
    unquoted = F.when(raw.rlike('^".*"$'), F.expr(f"substr(split({line}, ': ', 2)[1], 2, length(split({line}, ': ', 2)[1]) - 2)"))
    return F.get(parts, F.lit(0)), F.coalesce(unquoted, raw)
