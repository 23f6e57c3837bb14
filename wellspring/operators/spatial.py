"""Grid operators: nearest neighbours, box smoothing and tile pooling.

Pixels sit on an integer grid per (chip, well). Nothing here forms all pairs of a group:
neighbours come from coarse grid cells whose size is chosen so that the join stays linear,
and smoothing works on fixed-size tiles with a rim of copied pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.operators.ranking import largest_group
from wellspring.session import durable, spread

WELL = ["chip_id", "well_id"]


def _cell(col: str, level) -> F.Column:
    return F.floor(F.col(col) / F.pow(F.lit(2.0), level)).cast("long")


def nearest(df: DataFrame, k: int = 8, keys=WELL, pid: str = "pixel_id", fan: int | None = None, asking: DataFrame | None = None) -> DataFrame:
    """k nearest pixels of the same well, self excluded, ordered by (d2, row, col, pixel id).

    Returns keys, pid, nbr, d2, nrank (1..k). Each round looks at the 3x3 block of cells around
    a pixel; every pixel outside it is at least one cell side + 1 away, so a pixel whose k-th
    candidate is nearer than that is settled exactly. The rest retry with doubled cells, and only
    the cells they touch are offered again.
    The first cell size is the largest whose mean number of cell mates stays below ``fan``.
    ``asking`` (keys, pid) limits the pixels that get neighbours, not those that may be one.
    """
    keys = list(keys)
    fan = fan or 16 * (k + 1)
    base = durable(df.select(*keys, pid, "prow", "pcol"))
    ext = base.agg(
        F.max("prow") - F.min("prow"), F.max("pcol") - F.min("pcol")
    ).first()
    if ext[0] is None:
        return base.select(*keys, pid, F.col(pid).alias("nbr"), F.lit(0).cast("long").alias("d2"), F.lit(1).alias("nrank")).limit(0)
    top = max(1, math.ceil(math.log2(max(ext[0], ext[1]) + 1)))
    # within one grid position ties are broken by id, so k + 1 lowest ids are all that can matter
    spot = Window.partitionBy(*keys, "prow", "pcol").orderBy(pid)
    cand = base.withColumn("_s", F.row_number().over(spot)).filter(F.col("_s") <= k + 1).drop("_s")
    crowd = (
        cand.select(*keys, "prow", "pcol", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("lvl"))
        .groupBy(*keys, "lvl", _cell("prow", F.col("lvl")).alias("cr"), _cell("pcol", F.col("lvl")).alias("cc"))
        .count()
        .groupBy(*keys, "lvl")
        .agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("mates"))
        .groupBy(*keys)
        .agg(F.max(F.when((F.col("mates") <= fan) | (F.col("lvl") == 0), F.col("lvl"))).alias("lvl"))
    )
    crowd = durable(crowd)  # one row per well
    todo = base.join(crowd, keys)
    levels = crowd
    if asking is not None:
        todo = durable(todo.join(asking.select(*keys, pid), [*keys, pid], "left_semi"))
        levels = durable(todo.select(*keys, "lvl").distinct())
    few = asking is not None
    settled: list[DataFrame] = []
    best = Window.partitionBy(*keys, pid).orderBy("d2", "_nr", "_nc", "nbr")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    while True:
        asks = todo.withColumn("_o", around).select(
            *keys, pid, "prow", "pcol", "lvl",
            (_cell("prow", F.col("lvl")) + F.col("_o.dr")).alias("cr"),
            (_cell("pcol", F.col("lvl")) + F.col("_o.dc")).alias("cc"),
        )
        offers = cand.join(levels, keys).select(
            *keys, "lvl", _cell("prow", F.col("lvl")).alias("cr"), _cell("pcol", F.col("lvl")).alias("cc"),
            F.col(pid).alias("nbr"), F.col("prow").alias("_nr"), F.col("pcol").alias("_nc"),
        )
        if few:
            offers = offers.join(asks.select(*keys, "lvl", "cr", "cc").distinct(), [*keys, "lvl", "cr", "cc"], "left_semi")
        near = (
            asks.join(offers, [*keys, "lvl", "cr", "cc"])
            .filter(F.col(pid) != F.col("nbr"))
            .withColumn("d2", (F.pow(F.col("prow") - F.col("_nr"), 2) + F.pow(F.col("pcol") - F.col("_nc"), 2)).cast("long"))
            .withColumn("nrank", F.row_number().over(best))
            .filter(F.col("nrank") <= k)
        )
        if _everything_in_view(levels, top):
            settled.append(near.select(*keys, pid, "nbr", "d2", "nrank"))
            break
        near = durable(near.select(*keys, pid, "nbr", "d2", "nrank", "lvl"))
        sure = (
            near.groupBy(*keys, pid, "lvl").agg(F.max("d2").alias("far"), F.count("*").alias("got"))
            .filter((F.col("lvl") >= top) | ((F.col("got") == k) & (F.col("far") < F.pow(F.pow(F.lit(2.0), F.col("lvl")) + 1, 2))))
            .select(*keys, pid)
        )
        settled.append(near.join(sure, [*keys, pid], "left_semi").select(*keys, pid, "nbr", "d2", "nrank"))
        left = todo.join(sure, [*keys, pid], "left_anti").filter(F.col("lvl") < top)
        todo = durable(left.withColumn("lvl", F.col("lvl") + 1))
        levels = durable(todo.select(*keys, "lvl").distinct())
        few = True
        if levels.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def _everything_in_view(levels: DataFrame, top: int) -> bool:
    """True when every open well already looks at cells wider than the grid."""
    return (levels.agg(F.min("lvl")).first()[0] or 0) >= top


WELL_ROWS = 4096  # largest well that is worked on as one tile; a table with a larger one takes small tiles
CROWD = 512  # pixels of a small tile, about
CELLS = 4_000_000  # distances that a tile holds at once


def _tile_places(ids: DataFrame, k: int, keys: list[str], pid: str) -> tuple[DataFrame, DataFrame]:
    """Where each pixel is needed: its own tile and the tiles whose rim it lies in (no traces here).

    A well of at most CROWD pixels is one tile. Others get a rim of 1.5 times the distance at which a pixel
    of mean density has k + 1 neighbours, and tiles of six rims; crowded tiles are split further. Of
    the pixels at one position only the k + 1 lowest ids matter to anyone, so only they are placed; the
    second result holds the others.
    """
    spot = Window.partitionBy(*keys, "prow", "pcol").orderBy(pid)
    order = ids.withColumn("_s", F.row_number().over(spot))
    cand, hidden = order.filter(F.col("_s") <= k + 1).drop("_s"), order.filter(F.col("_s") > k + 1).select(*keys, pid)
    well = cand.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("prow").alias("r0"), F.max("prow").alias("r1"), F.min("pcol").alias("c0"), F.max("pcol").alias("c1"),
    ).filter(F.col("_n") > k)
    high, wide = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    single = F.col("_n") <= CROWD
    rim = F.ceil(1.5 * F.sqrt((k + 1) * high * wide / (math.pi * F.col("_n"))))
    well = well.withColumn("rim", F.when(single, 0).otherwise(rim).cast("long")).withColumn("side", F.when(single, F.greatest(high, wide)).otherwise(6 * F.col("rim")).cast("long"))
    placed = cand.join(well, keys)
    span = lambda c, o, lim: F.sequence(
        F.floor(F.greatest(F.col(c) - F.col(o) - F.col("rim"), F.lit(0)) / F.col("side")),
        F.floor((F.least(F.col(c) + F.col("rim"), F.col(lim)) - F.col(o)) / F.col("side")))
    placed = placed.withColumn("tr", F.explode(span("prow", "r0", "r1"))).withColumn("tc", F.explode(span("pcol", "c0", "c1")))
    inside = lambda c, o, t: F.floor((F.col(c) - F.col(o)) / F.col("side")) == F.col(t)
    tile = [*keys, "tr", "tc"]
    crowd = placed.groupBy(*tile).agg(F.count_if(inside("prow", "r0", "tr") & inside("pcol", "c0", "tc")).alias("_home"))
    parts = F.when(F.col("_home") > 4 * CROWD, F.ceil(F.sqrt(F.col("_home") / CROWD))).otherwise(1)
    crowd = crowd.filter("_home > 0").select(*tile, parts.cast("long").alias("parts"))
    placed = placed.join(crowd, tile)
    small = F.greatest(F.lit(1), F.ceil(F.col("side") / F.col("parts")))
    placed = placed.withColumn("sub", F.when(F.col("parts") == 1, F.col("side")).otherwise(small).cast("long"))
    placed = placed.withColumn("rim", F.when(F.col("parts") == 1, F.col("rim")).otherwise(F.ceil(F.col("sub") / 6)).cast("long"))

    def subs(c, o, t):
        start = F.col(o) + F.col(t) * F.col("side")
        last = F.col("side") - 1
        return F.filter(
            F.sequence(F.floor(F.greatest(F.col(c) - F.col("rim") - start, F.lit(0)) / F.col("sub")), F.floor(F.greatest(F.least(F.col(c) + F.col("rim") - start, last), F.lit(0)) / F.col("sub"))),
            lambda i: (start + i * F.col("sub") <= F.col(c) + F.col("rim")) & (F.col(c) - F.col("rim") <= start + last),
        )

    placed = placed.withColumn("ur", F.explode(subs("prow", "r0", "tr"))).withColumn("uc", F.explode(subs("pcol", "c0", "tc")))
    low = lambda o, t, u: F.col(o) + F.col(t) * F.col("side") + F.col(u) * F.col("sub")
    high = lambda o, t, u: F.col(o) + F.least((F.col(u) + 1) * F.col("sub"), F.col("side")) + F.col(t) * F.col("side") - 1
    bounds = F.struct(
        low("r0", "tr", "ur").alias("a0"), high("r0", "tr", "ur").alias("a1"), low("c0", "tc", "uc").alias("b0"), high("c0", "tc", "uc").alias("b1"),
        "rim", "r0", "r1", "c0", "c1",
    )
    return placed.select(*keys, pid, "prow", "pcol", F.struct("tr", "tc", "ur", "uc").alias("tile"), bounds.alias("bounds")), hidden


def nearest_rows(rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, home: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k nearest of each ``home`` pixel by (d2, row, col, id), and the k-th d2."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, cols, rows))] = np.arange(len(ids))
    near, far = [], []
    for lo in range(0, len(home), max(1, CELLS // len(ids))):
        h = home[lo : lo + max(1, CELLS // len(ids))]
        d2 = (rows[h, None] - rows) ** 2 + (cols[h, None] - cols) ** 2
        order = d2 * len(ids) + rank
        order[np.arange(len(h)), h] = np.iinfo(np.int64).max
        top = np.argpartition(order, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(np.take_along_axis(order, top, axis=1), axis=1), axis=1)
        near.append(top)
        far.append(d2[np.arange(len(h)), top[:, -1]])
    return np.concatenate(near), np.concatenate(far)


def stacked(values: pd.Series) -> np.ndarray:
    """Values as one matrix (traces, padded with NaN) or one vector."""
    if not len(values) or not isinstance(values.iloc[0], np.ndarray):
        return values.to_numpy(float)
    mat = np.full((len(values), max(len(v) for v in values)), np.nan)
    for i, v in enumerate(values):
        mat[i, : len(v)] = v
    return mat


def neighbourhoods(df: DataFrame, k: int, column: str, compute, keys=WELL, pid: str = "pixel_id", largest: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """keys, pid, value: ``compute`` over each pixel's k nearest; and the keys of pixels it cannot prove, or None.

    ``compute(values, home, near)`` gets the column's values of a tile (one row per pixel), the positions of its own
    pixels and, per own pixel, the positions of its k nearest, nearest first. Where no well has more than
    WELL_ROWS pixels (``largest`` passes on a known size) a well is a tile and ``column`` moves once. Else tiles are small and
    hold a rim of copied pixels: a pixel is proven if its k-th neighbour is closer than anything outside
    can be, ``column`` moves once to its ids and once, with the rim's copies, to the tiles. Unproven pixels are for ``nearest``.
    Wells of k pixels or fewer and pixels without coordinates have no row.
    """
    keys = list(keys)
    df = df.filter("prow IS NOT NULL AND pcol IS NOT NULL")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, pid).schema)

    def numbers(pdf: pd.DataFrame):
        return pdf["prow"].to_numpy(np.int64), pdf["pcol"].to_numpy(np.int64), pdf[pid].to_numpy()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) <= k:
            return pdf.iloc[:0][[*keys, pid]].assign(value=0.0)
        home = np.arange(len(pdf))
        near, _ = nearest_rows(*numbers(pdf), home, k)
        return pdf[[*keys, pid]].assign(value=compute(stacked(pdf[column]), home, near))

    if (largest_group(df, keys) if largest is None else largest) <= WELL_ROWS:
        return df.select(*keys, pid, "prow", "pcol", column).groupBy(*keys).applyInPandas(whole, f"{kinds}, value double"), None

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols, ids = numbers(pdf)
        b = pdf["bounds"].iat[0]
        own = (rows >= b["a0"]) & (rows <= b["a1"]) & (cols >= b["b0"]) & (cols <= b["b1"])
        home = np.flatnonzero(own)
        out = pdf.iloc[home][[*keys, pid]].assign(value=np.nan, sure=False)
        if not len(home) or len(ids) <= k:
            return out
        near, far = nearest_rows(rows, cols, ids, home, k)
        reach = np.full(len(home), np.inf)  # distance to the nearest place that the tile does not see
        for at, lo, hi, first, last in ((rows, b["a0"], b["a1"], b["r0"], b["r1"]), (cols, b["b0"], b["b1"], b["c0"], b["c1"])):
            if lo - b["rim"] > first:
                reach = np.minimum(reach, at[home] - (lo - b["rim"]) + 1)
            if hi + b["rim"] < last:
                reach = np.minimum(reach, hi + b["rim"] - at[home] + 1)
        sure = far < reach**2
        if sure.any():
            out.loc[out.index[sure], "value"] = compute(stacked(pdf[column]), home[sure], near[sure])
        return out.assign(sure=sure)

    places, hidden = _tile_places(df.select(*keys, pid, "prow", "pcol"), k, keys, pid)
    laid = places.groupBy(*keys, pid).agg(F.collect_list(F.struct("tile", "bounds", "prow", "pcol")).alias("_at"))  # a few copies of one pixel
    tiled = df.select(*keys, pid, column).join(laid, [*keys, pid]).select(*keys, pid, column, F.inline("_at"))
    seen = tiled.groupBy(*keys, "tile").applyInPandas(work, f"{kinds}, value double, sure boolean")
    seen = durable(seen.unionByName(hidden.select(*keys, pid, F.lit(None).cast("double").alias("value"), F.lit(False).alias("sure"))))
    rest = seen.filter("NOT sure").select(*keys, pid)
    return seen.filter("sure").drop("sure"), None if rest.isEmpty() else rest


def sum_traces(df: DataFrame, keys, x: str = "x") -> DataFrame:
    """Elementwise sum and count per group as long rows (keys, t, s, n); combines before the shuffle."""
    return (
        df.select(*keys, F.posexplode(x).alias("t", "v"))
        .groupBy(*keys, "t")
        .agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    )


def mean_trace(df: DataFrame, keys, x: str = "x", out: str = "x") -> DataFrame:
    """Elementwise mean trace per group; only T values per group are ever gathered."""
    per_t = sum_traces(df, keys, x).select(*keys, "t", (F.col("s") / F.col("n")).alias("m"))
    return fold_traces(per_t, keys, "m", out)


def fold_traces(per_t: DataFrame, keys, value: str, out: str = "x") -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(F.col("t"), F.col(value).alias("v"))))
    return per_t.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(out))


TILE = 16


SHARED = 16  # pixels of one grid position up to which a tile takes them as they are


def _box_means(r: np.ndarray, c: np.ndarray, values: np.ndarray, counts: np.ndarray, own: np.ndarray, corner: tuple[int, int], side: int, order: int) -> np.ndarray:
    """Mean over the box around each ``own`` row; missing samples add nothing and are not counted. ``counts`` are pixels behind a row."""
    length = values.shape[1]
    seen = np.isfinite(values)
    grid = np.zeros((side, side, 2 * length))
    np.add.at(grid, (r - corner[0], c - corner[1]), np.concatenate([np.where(seen, values, 0.0), seen * counts[:, None]], axis=1))
    at = np.arange(side)
    lo, hi = np.maximum(at - order, 0), np.minimum(at + order + 1, side)
    for axis in (0, 1):
        run = np.concatenate([np.zeros_like(grid.take([0], axis=axis)), np.cumsum(grid, axis=axis)], axis=axis)
        grid = run.take(hi, axis=axis) - run.take(lo, axis=axis)
    got = grid[r[own] - corner[0], c[own] - corner[1]]
    return np.divide(got[:, :length], got[:, length:], out=np.full((len(got), length), np.nan), where=got[:, length:] > 0)


def _reach(order: int, tile: int):
    """Own tile and the tiles whose rim a position touches, as an array of (tr, tc)."""
    around = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-order, 0, order) for b in (-order, 0, order)]
    return F.array_distinct(F.transform(F.array(*around), lambda o: F.struct(
        F.floor((F.col("prow") + o["a"]) / tile).cast("int").alias("tr"), F.floor((F.col("pcol") + o["b"]) / tile).cast("int").alias("tc"))))


def box_smooth(df: DataFrame, order: int, keys=WELL, pid: str = "pixel_id", x: str = "x", tile: int = TILE) -> DataFrame:
    """Mean of the pixel and all pixels of its well within Chebyshev distance ``order``.

    Pixels go to their own tile and to the tiles whose rim they touch, all columns with them: a trace moves once, in about 1.4-1.9 copies, and
    a task holds at most (tile + 2 x order) squared positions however large the well. Where a position holds more than SHARED
    pixels, positions are summed first and means joined back to their pixels. Row count and other columns are unchanged; pixels without
    coordinates pass through.
    """
    if order == 0:
        return df
    placed = F.col("prow").isNotNull() & F.col("pcol").isNotNull()
    unplaced, df = df.filter(~placed), df.filter(placed)
    keys = list(keys)
    if largest_group(df, [*keys, "prow", "pcol"]) > SHARED:
        return _smooth_shared(df, order, keys, x, tile).unionByName(unplaced)
    tiled = df.withColumn("_t", F.explode(_reach(order, tile)))
    names = df.columns

    def smooth(table: pa.Table) -> pa.Table:
        r, c = (table.column(n).to_numpy().astype(np.int64) for n in ("prow", "pcol"))
        spot = table.column("_t")[0].as_py()
        own = np.flatnonzero((r // tile == spot["tr"]) & (c // tile == spot["tc"]))
        traces = table.column(x).combine_chunks()
        sizes = traces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
        values = np.full((len(r), max(int(sizes.max(initial=0)), 1)), np.nan)
        values[np.arange(values.shape[1]) < sizes[:, None]] = traces.flatten().to_numpy(zero_copy_only=False)
        mean = _box_means(r, c, values, np.ones(len(r)), own, (spot["tr"] * tile - order, spot["tc"] * tile - order), tile + 2 * order, order)
        out = table.take(pa.array(own)).select(names)
        at = names.index(x)
        field = out.schema.field(at)
        return out.set_column(at, field, pa.array([row.tolist() for row in mean], field.type))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return tiled.groupBy(*keys, "_t").applyInArrow(smooth, schema).unionByName(unplaced)


def _smooth_shared(df: DataFrame, order: int, keys: list[str], x: str, tile: int) -> DataFrame:
    """``box_smooth`` where positions may hold any number of pixels: each position is first reduced to one summed trace."""
    spot = [*keys, "prow", "pcol"]
    shared = df.groupBy(*spot).count().filter("count > 1").drop("count")
    single = df.join(shared, spot, "left_anti").select(*spot, F.lit(1).cast("long").alias("n"), F.col(x).alias("s"))
    dup = sum_traces(df.join(shared, spot, "left_semi"), spot, x)
    packed = F.array_sort(F.collect_list(F.struct("t", "s")))
    merged = dup.groupBy(*spot).agg(F.max("n").alias("n"), F.transform(packed, lambda p: p["s"]).alias("s"))
    cells = single.unionByName(merged)
    tiled = cells.withColumn("_t", F.explode(_reach(order, tile))).select(*spot, "n", "s", "_t.tr", "_t.tc")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiled.select(*spot).schema) + ", xs array<double>"

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["prow"].to_numpy(), pdf["pcol"].to_numpy()
        tr, tc = pdf["tr"].iat[0], pdf["tc"].iat[0]
        own = np.flatnonzero((r // tile == tr) & (c // tile == tc))
        values = np.stack([np.asarray(s, float) for s in pdf["s"]])
        mean = _box_means(r, c, values, pdf["n"].to_numpy(), own, (tr * tile - order, tc * tile - order), tile + 2 * order, order)
        out = pdf.iloc[own][spot].copy()
        out["xs"] = pd.Series(mean.tolist(), index=out.index, dtype=object)
        return out

    smoothed = spread(tiled, *keys, "tr", "tc").groupBy(*keys, "tr", "tc").applyInPandas(smooth, schema)
    return df.join(smoothed, spot).withColumn(x, F.col("xs")).drop("xs").select(*df.columns)


def pool_tiles(df: DataFrame, order: int, keys=WELL, x: str = "x") -> DataFrame:
    """Mean trace per non-overlapping (2 x order + 1) squared tile; empty tiles are absent."""
    keys, side = list(keys), 2 * order + 1
    tiled = df.withColumn("tr", F.floor(F.col("prow") / side).cast("int")).withColumn("tc", F.floor(F.col("pcol") / side).cast("int"))
    wide = tiled.groupBy(*keys).agg(F.max("tc").alias("_w"), F.min_by("y", "pixel_id").alias("y"))
    per_t = sum_traces(tiled, [*keys, "tr", "tc"], x).select(*keys, "tr", "tc", "t", (F.col("s") / F.col("n")).alias("m"))
    pooled = fold_traces(per_t, [*keys, "tr", "tc"], "m", x)
    return pooled.join(wide, keys).select(
        *keys, (F.col("tr") * (F.col("_w") + 1) + F.col("tc")).alias("tile_id"), "tr", "tc", "y", x
    )
