"""Windows over long series (id, t, v) that do not pin one id to one task.

``t`` is a dense 0-based index. A frame reaches ``before`` rows back and ``after`` rows ahead,
so a series is cut into blocks of ``BLOCK`` samples and each block gets a rim of copied rows.
Window functions then partition by (id, block); only rows of the block itself are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.operators.ranking import attach

BLOCK = 65_536


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    columns: Callable[[Window], dict[str, Column]] | Sequence[Callable],
    t: str = "t",
    block: int | None = None,
) -> DataFrame:
    """Add window columns. Each builder gets the ordered window spec; later ones see earlier columns.

    Rim rows have incomplete frames, so ``before`` and ``after`` must cover the chained reach.
    """
    size = block or BLOCK
    if max(before, after) > size:
        raise ValueError("frame longer than a block")
    home = F.floor(F.col(t) / size).cast("long")
    first = F.floor((F.col(t) - after) / size).cast("long")
    last = F.floor((F.col(t) + before) / size).cast("long")
    spread = df.withColumn("_blk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    win = Window.partitionBy(*keys, "_blk").orderBy(t)
    builders = columns if isinstance(columns, (list, tuple)) else [columns]
    for build in builders:
        spread = spread.withColumns(build(win))
    return spread.filter(F.col("_blk") == home).drop("_blk")


def centred_mean(df, keys, span: int, v="v", out="ma", block=None) -> DataFrame:
    """Mean over a symmetric frame with truncated edges; an even span acts as span - 1."""
    h = (span - 1) // 2
    return over_blocks(df, keys, h, h, lambda w: {out: F.avg(v).over(w.rowsBetween(-h, h))}, block=block)


def series_size(df, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("len"))


def padded_mean(df, keys, span: int, v="v", out="ma", block=None) -> DataFrame:
    """Centred mean in which samples beyond either end repeat the end value."""
    h = (span - 1) // 2
    sized = attach(df, series_size(df, keys), keys)
    ends = df.groupBy(*keys).agg(F.min_by(v, "t").alias("_a"), F.max_by(v, "t").alias("_z"))

    def build(w):
        inside = F.sum(v).over(w.rowsBetween(-h, h))
        left = F.greatest(F.lit(h) - F.col("t"), F.lit(0))
        right = F.greatest(F.col("t") + h - (F.col("len") - 1), F.lit(0))
        return {out: (inside + left * F.col("_a") + right * F.col("_z")) / F.lit(2 * h + 1)}

    return over_blocks(attach(sized, ends, keys), keys, h, h, build, block=block).drop("len", "_a", "_z")


def first_difference(df, keys, v="v", out="d", block=None) -> DataFrame:
    """v[t + 1] - v[t]; the last sample of a series has none and is dropped."""
    got = over_blocks(df, keys, 0, 1, lambda w: {out: F.lead(v).over(w) - F.col(v)}, block=block)
    return got.filter(F.col(out).isNotNull())


def _gradient(w, v: str, x: str) -> Column:
    """Second-order central difference on an uneven axis, one-sided at the ends."""
    left, right = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    down, up = F.col(v) - F.lag(v).over(w), F.lead(v).over(w) - F.col(v)
    inner = (left * left * up + right * right * down) / (left * right * (left + right))
    return F.coalesce(inner, up / right, down / left)


def gradients(df, keys, v="v", x="t", block=None) -> DataFrame:
    """First and second derivative (``d1``, ``d2``) with respect to column ``x``.

    A rim of three keeps the end rules of a block from leaking into its own rows.
    """
    return over_blocks(df, keys, 3, 3, [
        lambda w: {"d1": _gradient(w, v, x)},
        lambda w: {"d2": _gradient(w, "d1", x)},
    ], block=block)


def savgol_rows(window: int, poly: int, deriv: int = 0) -> np.ndarray:
    """Least-squares polynomial weights: row i gives the value at position i of the window."""
    pos = np.arange(window, dtype=float)
    out = np.empty((window, window))
    for i in range(window):
        basis = np.vander(pos - i, poly + 1, increasing=True)
        factor = float(np.prod(np.arange(1, deriv + 1))) if deriv else 1.0
        out[i] = np.linalg.pinv(basis)[deriv] * factor
    return out


def savgol(df, keys, window: int, poly: int, deriv: int = 0, v="v", out="sg", block=None) -> DataFrame:
    """Polynomial smoothing; the first and last half window use the end windows' own fits.

    A series shorter than ``window`` gives NULL.
    """
    rows = savgol_rows(window, poly, deriv)
    h = window // 2
    table = F.array(*[F.array(*[F.lit(float(c)) for c in r]) for r in rows])
    sized = attach(df, series_size(df, keys), keys)

    def build(w):
        # samples around t that cover the window starting at clamp(t - h, 0, len - window)
        around = F.collect_list(v).over(w.rowsBetween(-(window - 1), window - 1))
        return {"_near": around}

    def weigh(w):
        begin = F.least(F.greatest(F.col("t") - h, F.lit(0)), F.col("len") - window).cast("int")
        have = F.greatest(F.col("t") - (window - 1), F.lit(0))
        part = F.slice("_near", (begin - have).cast("int") + 1, window)
        weights = F.get(table, (F.col("t") - begin).cast("int"))
        val = F.aggregate(F.zip_with(part, weights, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
        return {out: F.when(F.col("len") >= window, val)}

    got = over_blocks(sized, keys, window - 1, window - 1, [build], block=block)
    return got.withColumns(weigh(None)).drop("_near", "len")


def trailing_stats(df, keys, window: int, v="v", block=None) -> DataFrame:
    """Mean and population std of the last ``window`` samples, fewer at the start."""
    b = window - 1

    def build(w):
        frame = w.rowsBetween(-b, 0)
        return {"roll_mean": F.avg(v).over(frame), "roll_std": F.stddev_pop(v).over(frame)}

    return over_blocks(df, keys, b, 0, build, block=block)


def feature_table(df, keys, window: int = 50, baseline: int = 30, v="v", block=None) -> DataFrame:
    """Nine per-sample features: value, gradients, trailing stats, elapsed share, rise and z against
    the first ``baseline`` samples, and the trailing slope (against the first value while short)."""
    lag = window - 1
    base = df.groupBy(*keys).agg(
        F.count("*").alias("len"),
        F.avg(F.when(F.col("t") < baseline, F.col(v))).alias("_bm"),
        F.stddev_pop(F.when(F.col("t") < baseline, F.col(v))).alias("_bs"),
        F.min_by(v, "t").alias("_v0"),
    )

    def first(w):
        frame = w.rowsBetween(-lag, 0)
        return {
            "d1": _gradient(w, v, "t"),
            "roll_mean": F.avg(v).over(frame),
            "roll_std": F.stddev_pop(v).over(frame),
            "slope": (F.col(v) - F.when(F.col("t") >= lag, F.lag(v, lag).over(w)).otherwise(F.col("_v0"))) / F.lit(float(window)),
        }

    got = over_blocks(attach(df, base, keys), keys, max(lag, 3), 3, [first, lambda w: {"d2": _gradient(w, "d1", "t")}], block=block)
    return got.withColumns({
        "elapsed": F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("len") - 1), F.lit(0.0)),
        "rise": F.col(v) - F.col("_bm"),
        "z": (F.col(v) - F.col("_bm")) / (F.col("_bs") + F.lit(1e-8)),
    }).drop("len", "_bm", "_bs", "_v0")


def scaled_derivative(df, keys, order: int, dt_sec: float, v="v", block=None) -> DataFrame:
    """Smooth, difference, smooth again, in thousandths of a unit per second."""
    h = (order - 1) // 2
    chained = over_blocks(df, keys, 2 * h + 1, 2 * h + 2, [
        lambda w: {"_s": F.avg(v).over(w.rowsBetween(-h, h))},
        lambda w: {"_d": F.lead("_s").over(w) - F.col("_s")},
        lambda w: {"deriv": F.avg("_d").over(w.rowsBetween(-h, h)) * F.lit(1e3 / dt_sec)},
    ], block=block)
    return chained.filter(F.col("_d").isNotNull()).drop("_s", "_d")
