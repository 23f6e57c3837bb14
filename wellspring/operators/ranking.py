"""Order statistics that stay correct and spread out when one group holds most of the rows.

Small groups take the plain Spark route (window or exact ``percentile``). Once the largest
group passes ``SPLIT_ROWS`` the rows are range-partitioned on (keys, order), so a hot group
spans many tasks, and each task's local running sum is lifted by the weight that the same
group has in earlier partitions. The lookup for that lift has at most two rows per partition.

Both routes give the same bits: running sums are whole numbers, and the split quantiles follow the
arithmetic of ``percentile``. So no strict comparison changes sides when a group grows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.session import durable

SPLIT_ROWS = 500_000  # largest group a single task may order


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(df, keys)[0]


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[name])
    return cond


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: str | None = None,
    out: str = "before",
    split_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the weight of all earlier rows of the same group (1 per row by default).

    (keys, order) must be unique, which makes the result independent of partitioning.
    """
    keys, order = list(keys), list(order)
    w = F.col(weight) if weight else F.lit(1).cast("long")
    limit = SPLIT_ROWS if split_rows is None else split_rows
    largest, total = group_sizes(df, keys)
    if largest <= limit:
        win = Window.partitionBy(*keys).orderBy(*order)
        frame = win.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(w).over(frame), F.lit(0)).cast("long"))

    parts = max(math.ceil(total / limit), 2)  # follows the rows, so a piece stays within the limit at any size
    placed = durable(
        df.repartitionByRange(parts, *keys, *order).withColumn("_pid", F.spark_partition_id())
    )
    pieces = placed.groupBy("_pid", *keys).agg(F.sum(w).alias("_w"))
    split = pieces.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    spread = pieces.join(split, _same(pieces, split, keys), "left_semi") if keys else pieces
    lift_win = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    lift = spread.select(
        F.col("_pid").alias("_lpid"),
        *[F.col(k).alias(f"_l_{k}") for k in keys],
        F.coalesce(F.sum("_w").over(lift_win), F.lit(0)).alias("_lift"),
    )
    local = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_local", F.coalesce(F.sum(w).over(local), F.lit(0)))
    cond = F.col("_pid") == F.col("_lpid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_l_{k}"))
    # at most two rows per range partition: a first and a last group each
    joined = summed.join(F.broadcast(lift), cond, "left")
    return joined.select(
        *df.columns,
        (F.col("_local") + F.coalesce(F.col("_lift"), F.lit(0))).cast("long").alias(out),
    )


def row_index(df, keys, order, out="idx", split_rows=None) -> DataFrame:
    """0-based dense position within the group."""
    return running_total(df, keys, order, None, out, split_rows)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """One row per (group, value) with its multiplicity; ties collapse before any shuffle of rows."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
    )


def average_ranks(df, keys, value, split_rows=None, **sums) -> DataFrame:
    """Value table with the average rank of ties (1-based) per group."""
    counted = value_counts(df, keys, value, **sums)
    cum = running_total(counted, keys, [value], "cnt", "before", split_rows)
    return cum.withColumn("avg_rank", F.col("before") + (F.col("cnt") + 1) / 2.0)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    split_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, plus ``n`` (rows with a value).

    ``largest`` passes on a group size that is already known.
    """
    keys = list(keys)
    limit = SPLIT_ROWS if split_rows is None else split_rows
    have = df.filter(F.col(value).isNotNull()).select(*keys, value)
    largest = largest_group(have, keys) if largest is None else largest
    if largest <= limit:
        return have.groupBy(*keys).agg(
            F.count("*").alias("n"),
            *[F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()],
        )
    counted = value_counts(have, keys, value)
    cum = running_total(counted, keys, [value], "cnt", "before", limit)
    totals = have.groupBy(*keys).agg(F.count("*").alias("n"))
    placed = attach_sized(cum, totals, keys, limit)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{tag}"))
    picked = placed.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        between = (F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi
        cols.append(F.when(lo == hi, lo).otherwise(between).alias(name))
    return picked.select(*keys, "n", *cols)


def median_mad(df, keys, value, split_rows=None, extra: dict[str, float] | None = None, largest: int | None = None) -> DataFrame:
    """Per group: n, median ``med``, 1.4826 x median absolute deviation ``mad`` and ``extra`` quantiles.

    ``largest`` passes on a group size that is already known.
    """
    have = df.filter(F.col(value).isNotNull()).select(*keys, value)
    size = largest_group(have, keys) if largest is None else largest
    limit = SPLIT_ROWS if split_rows is None else split_rows
    med = quantiles(have, keys, value, {"med": 0.5, **(extra or {})}, split_rows, size)
    if size <= limit:
        both = attach(have, med.select(*keys, "med"), keys)
    else:
        med = durable(med)
        both = attach_sized(have, med.select(*keys, "med", F.col("n").alias("_n")), keys, limit, "_n")
    dev = both.select(*keys, F.abs(F.col(value) - F.col("med")).alias("_dev"))
    raw = quantiles(dev, keys, "_dev", {"raw": 0.5}, split_rows, size).drop("n")
    return attach(med, raw.withColumn("mad", F.col("raw") * 1.4826).drop("raw"), keys)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the values of a one-row aggregate as literals, which needs no join at all."""
    values = one_row.first()
    return df.withColumns({f.name: F.lit(values[f.name]).cast(f.dataType) for f in one_row.schema})


def attach_sized(df: DataFrame, per_group: DataFrame, keys: Sequence[str], limit: int, size: str = "n") -> DataFrame:
    """Join per-group values, ``size`` (rows of the group) among them, to rows of which a few groups may hold most; NULL keys meet.

    A shuffle by key would put a group into one task. So the values of groups of more than ``limit`` rows, of which there
    are at most rows / limit, go to the rows; only rows of smaller groups are shuffled.
    """
    keys = list(keys)
    if not keys:
        return with_scalars(df, per_group)
    extra = [c for c in per_group.columns if c not in keys]
    sized = durable(per_group).select(*[F.col(k).alias(f"_t_{k}") for k in keys], *extra)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    large, small = F.broadcast(sized.filter(F.col(size) > limit)), sized.filter(F.col(size) <= limit)
    out = df.join(large, cond)
    if not small.isEmpty():
        out = out.unionByName(df.join(large.select(*[f"_t_{k}" for k in keys]), cond, "left_anti").join(small, cond))
    return out.select(*df.columns, *extra)


def attach(df: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group values back; Spark broadcasts them when their measured size allows."""
    if not keys:
        return with_scalars(df, per_group)
    return df.join(per_group, list(keys), how)
