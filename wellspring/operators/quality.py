"""Control-referenced pixel quality layers A-D, whole tables at once (chip is a key, not a loop)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators.ranking import attach, largest_group, median_mad, quantiles
from wellspring.operators.spatial import WELL, WELL_ROWS, nearest, nearest_rows, neighbourhoods, stacked
from wellspring.session import durable, spread
from wellspring.sources.tables import write_traces

STATS = ("dyn_range", "net_slope", "trace_min")


def _number(k: float | Column) -> Column:
    return k if isinstance(k, Column) else F.lit(float(k))


def with_stats(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("dyn_range", ar.dyn_range("x"))
        .withColumn("net_slope", ar.net_slope("x"))
        .withColumn("trace_min", F.array_min("x"))
    )


def control_thresholds(stats: DataFrame, rule: str = "mad", k: float | Column = 1.5, pct_amp: float = 5.0,
                       pct_shape: float = 5.0, split_rows: int | None = None, largest: int | None = None) -> DataFrame:
    """Per chip, from control pixels: ``thr_<stat>`` with medians, MADs and the control count.

    ``rule='pct'`` cuts at a low percentile, ``rule='mad'`` at median - k x MAD. ``largest`` passes on the
    number of control pixels of the largest chip.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in STATS])
    tall = stats.filter("is_ntc").select("chip_id", F.inline(pairs))
    keys = ["chip_id", "stat"]
    extra = {"p_amp": pct_amp / 100.0, "p_shape": pct_shape / 100.0} if rule == "pct" else None
    per = median_mad(tall, keys, "v", split_rows, extra, largest)
    if rule == "pct":
        per = per.withColumn("thr", F.when(F.col("stat") == "dyn_range", F.col("p_amp")).otherwise(F.col("p_shape")))
    else:
        per = per.withColumn("thr", F.col("med") - _number(k) * F.col("mad"))
    wide = [
        F.max(F.when(F.col("stat") == s, F.col(c))).alias(f"{c}_{s}") for s in STATS for c in ("med", "mad", "thr")
    ]
    return per.groupBy("chip_id").agg(F.max("n").alias("n_ntc"), *wide)


def layers_ab(stats: DataFrame, thresholds: DataFrame, layers: str = "AB") -> DataFrame:
    """Boolean ``a`` and ``b`` (disjoint, never NULL: a missing statistic fails no layer); chips without
    controls fall out with the inner join."""
    df = attach(stats, thresholds.select("chip_id", *[f"thr_{s}" for s in STATS]), ["chip_id"])
    under = lambda s: F.coalesce(F.col(s) < F.col(f"thr_{s}"), F.lit(False))
    low, off = under("dyn_range"), under("net_slope") | under("trace_min")
    df = df.withColumn("a", low)
    return df.withColumn("b", off & ~low if "B" in layers else F.lit(False))


def layer_c(flags: DataFrame, k: int = 8, min_bad_frac: float = 0.5, edges: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Add ``bad_count`` (-1 in wells of k pixels or fewer) and ``c``. ``flags`` is read more than once.

    Votes are counted on tiles; pixels whose neighbours a tile cannot prove are joined to theirs.
    """
    id3 = [*WELL, "pixel_id"]
    marked = flags.select(*id3, "prow", "pcol", (F.col("a") | F.col("b")).cast("double").alias("_bad"))
    bad = marked.select(*WELL, F.col("pixel_id").alias("nbr"), "_bad")
    joined = lambda e: e.join(bad, [*WELL, "nbr"]).groupBy(*id3).agg(F.count("*").alias("_n"), F.sum("_bad").alias("value")).filter(F.col("_n") == k).drop("_n")
    if edges is not None:
        votes = joined(edges)
    else:
        votes, rest = neighbourhoods(marked, k, "_bad", lambda values, home, near: np.nansum(values[near], axis=1), largest=largest)
        votes = votes if rest is None else votes.unionByName(joined(nearest(marked, k, asking=rest)))
    need = math.ceil(min_bad_frac * k)
    df = flags.join(votes, id3, "left")
    df = df.withColumn("bad_count", F.coalesce("value", F.lit(-1)).cast("int"))
    hit = (F.col("bad_count") >= need) & ~(F.col("a") | F.col("b")) & ~F.col("is_ntc")
    return df.withColumn("c", hit).drop("value")


def _references(metric: str):
    """``compute`` of ``neighbourhoods``: distance of each trace to its neighbours' reference trace."""
    def score(values: np.ndarray, home: np.ndarray, near: np.ndarray) -> np.ndarray:
        out = np.empty(len(home))
        for lo in range(0, len(home), 256):
            part = near[lo : lo + 256]
            if metric == "kth":
                ref = values[part[:, -1]]
            elif metric == "mean":
                ref = values[part].mean(axis=1)
            else:
                ref = np.median(values[part], axis=1)
            out[lo : lo + 256] = np.sqrt(((values[home[lo : lo + 256]] - ref) ** 2).sum(axis=1))
        return out

    return score


def _elementwise_median(stack: str):
    """Median over the (at most k) gathered traces at every sample."""
    n = F.size(stack)

    def mid(i):
        col = F.array_sort(F.transform(stack, lambda tr: F.get(tr, i)))
        lo = F.get(col, F.floor((n - 1) / 2).cast("int"))
        hi = F.get(col, F.floor(n / 2).cast("int"))
        return (lo + hi) / 2.0

    return F.transform(F.sequence(F.lit(0), F.size(F.get(F.col(stack), F.lit(0))) - 1), mid)


def _elementwise_mean(stack: str):
    n = F.size(stack)
    zero = F.transform(F.get(F.col(stack), F.lit(0)), lambda v: F.lit(0.0))
    sums = F.aggregate(stack, zero, lambda acc, tr: F.zip_with(acc, tr, lambda p, q: p + q))
    return F.transform(sums, lambda v: v / n)


def disagreement(df: DataFrame, metric: str = "median", k: int = 8, kth: str = "farthest", largest: int | None = None) -> DataFrame:
    """keys, pixel_id, ``score``: L2 distance of each trace to its neighbours' reference trace, wells > k pixels.

    Traces meet their neighbours on tiles; only pixels whose neighbours a tile cannot prove have theirs gathered by
    a join, at most k traces per pixel. ``kth='index'`` takes the neighbour with the highest id instead of the farthest one.
    """
    if metric not in ("mean", "median", "kth"):
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "kth" and kth != "farthest":
        return _gathered(df, nearest(df, k), metric, k, kth)
    proven, rest = neighbourhoods(df, k, "x", _references(metric), largest=largest)
    proven = proven.select(*WELL, "pixel_id", F.nullif(F.col("value"), F.lit(float("nan"))).alias("score"))
    return proven if rest is None else proven.unionByName(_gathered(df, nearest(df, k, asking=rest), metric, k, kth))


def _gathered(df: DataFrame, edges: DataFrame, metric: str, k: int, kth: str) -> DataFrame:
    """Scores of the pixels in ``edges`` by joining each to its neighbours' traces."""
    if metric == "kth":
        pick = "nrank" if kth == "farthest" else "nbr"
        edges = edges.groupBy(*WELL, "pixel_id").agg(
            F.count("*").alias("_k"), F.max_by("nbr", pick).alias("nbr")
        )
    other = df.select(*WELL, F.col("pixel_id").alias("nbr"), F.col("x").alias("_nx"))
    hop = edges.join(other, [*WELL, "nbr"])
    if metric == "kth":
        ref = hop.filter(F.col("_k") == k).select(*WELL, "pixel_id", F.col("_nx").alias("_ref"))
    else:
        stacks = spread(hop, *WELL, "pixel_id").groupBy(*WELL, "pixel_id").agg(F.collect_list("_nx").alias("_st")).filter(F.size("_st") == k)
        ref = stacks.select(*WELL, "pixel_id", (_elementwise_median("_st") if metric == "median" else _elementwise_mean("_st")).alias("_ref"))
    return df.join(ref, [*WELL, "pixel_id"]).select(*WELL, "pixel_id", ar.l2("x", "_ref").alias("score"))


def layer_d(df: DataFrame, rule: str = "mad", k_mad: float | Column = 1.5, pct: float = 95.0, metric: str = "median",
            k: int = 8, split_rows: int | None = None) -> DataFrame:
    """Scores and drop flag ``d`` for the surviving pixels given; wells of k or fewer are absent."""
    largest = largest_group(df, WELL)
    return _judged(durable(disagreement(df, metric, k, largest=largest)), rule, k_mad, pct, split_rows, largest)


def _judged(scored: DataFrame, rule: str, k_mad: float | Column, pct: float, split_rows: int | None, largest: int) -> DataFrame:
    """Add the well's ``cut`` and ``d`` to a kept table of scores; rows without score pass with d false."""
    if rule == "pct":
        cut = quantiles(scored, WELL, "score", {"cut": pct / 100.0}, split_rows, largest).drop("n")
    else:
        cut = median_mad(scored, WELL, "score", split_rows, largest=largest).select(
            *WELL, (F.col("med") + _number(k_mad) * F.col("mad")).alias("cut")
        )
    return attach(scored, cut, WELL, "left").withColumn("d", F.coalesce(F.col("score") > F.col("cut"), F.lit(False)))


def _layers_cd(df: DataFrame, flags: DataFrame, metric: str, c_k: int, d_k: int, min_bad_frac: float = 0.5) -> DataFrame:
    """``flags`` with bad_count, c and score, in one task per well: traces move once and meet their flags there."""
    need, score = math.ceil(min_bad_frac * c_k), _references(metric)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flags.schema)

    def work(marks: pd.DataFrame, traces: pd.DataFrame) -> pd.DataFrame:
        marks = marks.reset_index(drop=True)
        at = marks["prow"].notna().to_numpy() & marks["pcol"].notna().to_numpy()
        bad = marks["a"].to_numpy(bool) | marks["b"].to_numpy(bool)
        votes, result = np.full(len(marks), -1), np.full(len(marks), np.nan)

        def near(some: np.ndarray, k: int) -> np.ndarray:
            part = marks.iloc[some]
            return nearest_rows(part["prow"].to_numpy(np.int64), part["pcol"].to_numpy(np.int64), part["pixel_id"].to_numpy(), np.arange(len(some)), k)[0]

        some = np.flatnonzero(at)
        if len(some) > c_k:
            votes[some] = bad[some][near(some, c_k)].sum(axis=1)
        c = (votes >= need) & ~bad & ~marks["is_ntc"].to_numpy(bool)
        some = np.flatnonzero(at & ~bad & ~c)
        if len(some) > d_k:
            x = stacked(traces.set_index("pixel_id").loc[marks["pixel_id"].iloc[some], "x"])
            result[some] = score(x, np.arange(len(some)), near(some, d_k))
        return marks.assign(bad_count=votes, c=c, score=result)

    other = df.select(*[F.col(c).alias(c) for c in (*WELL, "pixel_id", "x")])  # flags descend from the same table
    both = flags.groupBy(*WELL).cogroup(other.groupBy(*WELL)).applyInPandas(work, f"{fields}, bad_count int, c boolean, score double")
    return both.withColumn("score", F.nullif("score", F.lit(float("nan"))))


def chip_filter(df: DataFrame, layers: str = "ABCD", rule: str = "mad", k: float | Column = 1.5,
                clean_controls_first: bool = False, metric: str = "median", c_k: int = 8, d_k: int = 8,
                pct_amp: float = 5.0, pct_shape: float = 5.0, d_pct: float = 95.0,
                split_rows: int | None = None) -> DataFrame:
    """Flags a, b, c, d, ntc_d and keep for every pixel of all chips (without the traces).

    ``is_ntc`` may mark several wells. ``k`` may be an expression of ``chip_id``, so that several
    strictnesses run as one job.
    A-C never drop controls, D may. Chips without control pixels are absent from the result.
    """
    if layers not in ("A", "AB", "ABC", "ABCD"):
        raise ValueError(f"layers must be A, AB, ABC or ABCD, got {layers!r}")
    id3 = [*WELL, "pixel_id"]
    # traces are read once here; everything up to layer D works on ids and three numbers per pixel
    stats = durable(with_stats(df).drop("x"))
    if clean_controls_first:
        dropped = layer_d(df.filter("is_ntc"), rule, k, d_pct, metric, d_k, split_rows).filter("d")
        stats = stats.join(dropped.select(*id3, F.lit(True).alias("ntc_d")), id3, "left")
        stats = stats.withColumn("ntc_d", F.coalesce("ntc_d", F.lit(False)))
    else:
        stats = stats.withColumn("ntc_d", F.lit(False))
    sizes = stats.groupBy(*WELL).agg(F.count("*").alias("_n"), F.count_if("is_ntc").alias("_c")).groupBy("chip_id").agg(F.max("_n").alias("_n"), F.sum("_c").alias("_c"))
    largest, controls = (v or 0 for v in sizes.agg(F.max("_n"), F.max("_c")).first())
    thr = control_thresholds(stats.filter("NOT ntc_d"), rule, k, pct_amp, pct_shape, split_rows, controls)
    flags = layers_ab(stats, thr, layers)
    for name in ("a", "b"):
        flags = flags.withColumn(name, F.col(name) & ~F.col("is_ntc"))
    flags = flags.drop(*[f"thr_{s}" for s in STATS])
    if layers == "ABCD" and largest <= WELL_ROWS:
        flags = durable(_layers_cd(df, flags, metric, c_k, d_k))
        flags = _judged(flags, rule, k, d_pct, split_rows, largest).drop("cut")
        return flags.withColumn("keep", ~(F.col("a") | F.col("b") | F.col("c") | F.col("d") | F.col("ntc_d")))
    if "C" in layers:
        flags = layer_c(durable(flags), c_k, largest=largest)
    else:
        flags = flags.withColumn("bad_count", F.lit(-1)).withColumn("c", F.lit(False))
    if "D" in layers:
        flags = durable(flags)
        alive = flags.filter("NOT (a OR b OR c)").select(*id3)
        d = layer_d(df.join(alive, id3, "left_semi"), rule, k, d_pct, metric, d_k, split_rows)
        flags = flags.join(d.select(*id3, "score", "d"), id3, "left").withColumn("d", F.coalesce("d", F.lit(False)))
    else:
        flags = flags.withColumn("score", F.lit(None).cast("double")).withColumn("d", F.lit(False))
    return flags.withColumn("keep", ~(F.col("a") | F.col("b") | F.col("c") | F.col("d") | F.col("ntc_d")))


def kept_traces(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows of the trace table that the filter keeps, all columns unchanged."""
    id3 = [*WELL, "pixel_id"]
    return df.join(flags.filter("keep").select(*id3), id3, "left_semi")


def cache_id(layers: str, rule: str, k: float = 1.5, clean_controls_first: bool = False) -> str:
    """Name of a filtered table, from the parameters that made it."""
    strict = f"_k{k:g}".replace(".", "p") if rule == "mad" else ""
    return f"{layers}_{rule}{strict}" + ("_ntcclean" if clean_controls_first else "")


def write_filtered(df: DataFrame, folder: str, layers: str = "ABCD", rule: str = "mad", k: float = 1.5, clean_controls_first: bool = False, **options) -> tuple[str, DataFrame]:
    """Filter, write the traces that stay under ``folder`` in a place named by ``cache_id``, and return that place and the rows written per chip.

    Chips without control pixels are skipped.
    """
    flags = chip_filter(df, layers, rule, k, clean_controls_first, **options)
    path = f"{folder}/{cache_id(layers, rule, k, clean_controls_first)}"
    return path, write_traces(kept_traces(df, flags), path)


def settle_time(df: DataFrame, keys, t: str, temp: str, frac: float = 0.995, fallback: str = "zero") -> DataFrame:
    """First t whose temperature reaches ``frac`` of the second half's mean; 0 or the first t if none."""
    keys = list(keys)
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(t).alias("_t0"))
    half = df.join(size, keys)
    target = half.groupBy(*keys).agg(
        F.first("_t0").alias("_t0"),
        (F.lit(frac) * F.avg(F.when(F.col("_i") >= F.floor(F.col("_n") / 2), F.col(temp)))).alias("_goal"),
    )
    hit = attach(df, target, keys).groupBy(*keys).agg(
        F.min(F.when(F.col(temp) >= F.col("_goal"), F.col(t))).alias("_hit"), F.first("_t0").alias("_t0")
    )
    none = F.lit(0.0) if fallback == "zero" else F.col("_t0")
    return hit.select(*keys, F.coalesce("_hit", none).cast("double").alias("settle"))
