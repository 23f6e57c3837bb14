"""Helpers shared by the operators: kept tables, ranks that split hot groups, connected components."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wellspring.sources.tables import scratch

WORD_RE = r"[^\x20\x09-\x0D]+"  # fixed value: what a word is; bytes.split() cuts at the same six characters


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]):
    """Null-safe equality of the named columns."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank", per_task: int = 20_000) -> DataFrame:
    """Add ``out``: a 0-based dense position within the group of ``keys``.

    A group is cut into pieces by a hash of ``order``; each piece is ordered by ``order`` on its own and
    starts after the rows of the group's earlier pieces. So a group with most of the rows spans many tasks.
    Rows equal in ``order`` get some order among themselves. ``df`` is read twice: give a kept table.
    """
    keys, order = list(keys), list(order)
    pieces = max(1, math.ceil(df.count() / per_task))
    cut = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_piece").alias("_k__piece"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
    )
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)) - 1)
    joined = local.join(base, same(local, base, [(k, f"_k_{k}") for k in [*keys, "_piece"]]))
    return joined.select(*df.columns, (F.col("_base") + F.col("_local")).cast("long").alias(out))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of ``links`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds; each is two shuffles of at most the links, and a
    long chain of n nodes takes about log n rounds. Stops when a round changes nothing and raises,
    rather than returning something unfinished, if that takes more than ``max_rounds``.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        # large star: every node hands its larger neighbours to its smallest one
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every node hands its smaller neighbours, and itself, to the smallest of them
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
