"""Mixing sources to target weights by systematic sampling.

Within a source, documents are laid out by size (ties by a hash), each as long as its expected
copies; the prefix sums are shifted by one random offset per source, and a document is emitted once
per integer boundary its stretch crosses. Lengths are fixed-point integers, so reruns agree however
rows are partitioned. Ordering by size spreads the draws evenly over sizes, which brings the words
taken near the target.

A null source is a source of its own, after all others; null texts have size 0. Sources without a
word have target 0. Repeated rows are drawn one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import WORD_RE, keep, ranked, same

ONE = 26  # bits after the point: expected copies are whole multiples of 2**-26
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # size of the mix over size of the input
MOST = 2.0  # most times a source, and so a document, may be taken


def size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``most`` times its source.

    With sources ordered by cap over weight, those that hit their cap come first. Each row's level is
    what it and all later ones get per unit of weight if all earlier ones stop at their caps; it rises
    up to the first source that stays below its cap and falls after it, so the highest one is the
    answer. One row per source goes through one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("w", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("level", level)
    return rows.withColumn("found", F.max("level").over(whole)).select("source", "source_size", F.least("cap", F.col("w") * F.col("found")).cast("double").alias("target"))


def allot(sized: DataFrame, seed: int = 1, **shares) -> DataFrame:
    """Copies of each row of ``sized`` (doc_id, source, size; a kept table), with its source's size and target."""
    goal = targets(sized, **shares)
    steps = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("first", F.coalesce(F.sum("n").over(smaller), F.lit(0)))
    steps = steps.join(goal, same(steps, goal, [("source", "source")])).select(
        F.col("n"), steps["source"].alias("s_source"), F.col("size").alias("s_size"), "first", "source_size", "target"
    )
    placed = ranked(sized, ["source", "size"], ["doc_id"], "tie")
    joined = placed.join(steps, same(placed, steps, [("source", "s_source"), ("size", "s_size")]))
    length = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * F.lit(float(1 << ONE))), F.lit(0)).cast("long")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit(""))), F.lit(1 << ONE))
    start = (F.col("first") + F.col("tie")) * length + offset
    copies = F.shiftright(start + length, ONE) - F.shiftright(start, ONE)
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, seed: int = 1, **shares) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies."""
    return allot(keep(docs.select("doc_id", "source", size().alias("size")), "sizes"), seed, **shares)


def emit(docs: DataFrame, seed: int = 1, **shares) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with all their columns."""
    drawn = mix(docs, seed, **shares)
    # rows of equal id, source and size are told apart by a number; their draws may be swapped
    order = Window.partitionBy("_id", "_source", "_size").orderBy(F.xxhash64("_row.text"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), size().alias("_size")).withColumn("_nth", F.row_number().over(order))
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("copies"))
    drawn = drawn.withColumn("nth", nth).filter("copies > 0").select("doc_id", "source", "size", "nth", "copies")
    joined = rows.join(drawn, same(rows, drawn, [("_id", "doc_id"), ("_source", "source"), ("_size", "size"), ("_nth", "nth")]))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
