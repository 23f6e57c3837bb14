"""Many k-means fits at once, one per group, number of clusters and start: keys of the same jobs, never a loop over them.

Rows are dealt into chunks of at most about CHUNK rows of one group. Every pass hands each chunk the centres of its
group's fits and returns partial results. Seeds come from rounds over the table: each round draws SEEDS rows per start with a
probability that follows their squared distance to the seeds so far (a weighted draw without replacement by hashed
keys, so chunks draw on their own and the best keys win); rows per seed are counted, and the weighted seeds are clustered. A
group of one chunk then moves its centres in one pass until nothing changes; larger groups take a pass per step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators.ranking import quantiles
from wellspring.operators.spatial import fold_traces, mean_trace, sum_traces
from wellspring.session import durable

CHUNK = 4096
SEEDS, SEED_ROUNDS = 16, 3


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one row per row of ``x``."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (the lower id wins ties) and squared distance to it."""
    gap = _gaps(x, centres)
    at = np.argmin(np.round(gap, 12), axis=1)
    return at, gap[np.arange(len(x)), at]


def _step(x: np.ndarray, centres: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted means of the rows nearest to each centre; an empty cluster keeps its centre."""
    at, _ = _nearest(x, centres)
    out = centres.copy()
    for c in np.unique(at):
        mine = at == c
        out[c] = np.average(x[mine], axis=0, weights=weight[mine])
    return out


def _spread_seeds(x: np.ndarray, weight: np.ndarray, k: int, seed: Sequence[int]) -> np.ndarray:
    """k of the weighted candidates, each drawn by weight times squared distance to those before, then moved to their means."""
    rng = np.random.default_rng(list(seed))
    picked = [x[rng.choice(len(x), p=weight / weight.sum())]]
    while len(picked) < k:
        pull = weight * _nearest(x, np.stack(picked))[1]
        picked.append(x[rng.choice(len(x), p=pull / pull.sum())] if pull.sum() > 0 else picked[-1])
    centres = np.stack(picked)
    for _ in range(100):
        fresh = _step(x, centres, weight)
        if np.abs(fresh - centres).max() <= 1e-9:
            break
        centres = fresh
    return centres


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float)


def _vectors(values) -> np.ndarray:
    """A packed array of arrays as a matrix."""
    return np.array([np.asarray(v, float) for v in values])


def kmeans(df: DataFrame, keys, pid: str, features: str, k: int | Sequence[int], rounds: int = 300, seed: int = 0, strict: bool = False,
           starts: int = 10, chunk: int = CHUNK) -> DataFrame:
    """keys, pid, ``k``, ``cluster`` (0..k-1 by lowest pid) and ``inertia`` of the best of ``starts`` fits per group and k.

    Groups with fewer than k rows have no rows for that k, or fail when ``strict``. A fit goes on until
    nothing moves; if one takes more than ``rounds`` steps this raises rather than returning something unfinished.
    """
    keys, ks = list(keys), [k] if isinstance(k, int) else sorted(k)
    have = df.filter(F.col(features).isNotNull()).select(*keys, pid, F.col(features).alias("_f"))
    size = have.groupBy(*keys).agg(F.count("*").alias("_n"))
    if strict and not size.filter(F.col("_n") < max(ks)).isEmpty():
        raise ValueError(f"a group has fewer than {max(ks)} rows")
    parts = F.ceil(F.col("_n") / chunk).cast("int")
    base = have.join(size.select(*keys, "_n", parts.alias("_parts")).filter(F.col("_n") >= min(ks)), keys)
    base = durable(base.withColumn("_part", F.pmod(F.xxhash64(pid), F.col("_parts"))))
    base = base.repartition(*keys, "_part").persist(StorageLevel.MEMORY_AND_DISK)  # dealt once for all passes
    chunks = durable(base.select(*keys, "_part", "_parts", "_n").distinct())
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema]
    by = [*keys, "_part"]

    def over(rows: DataFrame, state: DataFrame, fn, fields: str) -> DataFrame:
        """``fn`` (rows, states) on every chunk with the states of its group."""
        dealt = state.join(chunks.select(*keys, "_part"), keys)
        dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # states descend from the rows
        return rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(fn, ", ".join([*kinds, fields]))

    def frame(rows: pd.DataFrame, out: dict) -> pd.DataFrame:
        size = len(next(iter(out.values())))
        if not size:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*keys, *out]})
        return pd.DataFrame({**{c: [rows[c].iat[0]] * size for c in keys}, **out})

    # seeds: a first row per start, then rounds of draws, then the rows nearest to each seed
    first = base.groupBy(*keys).agg(F.array(*[F.struct(F.lit(s).alias("start"), F.array(F.min_by("_f", F.struct(F.xxhash64(F.lit(seed), F.lit(s), pid), pid))).alias("seeds")) for s in range(starts)]).alias("_s"))
    state = durable(first.select(*keys, F.inline("_s")))
    def drawer(turn: int):
        def draw(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
            out: dict = {"start": [], "luck": [], "seed": []}
            x, salt = _matrix(rows["_f"]), pd.util.hash_array(rows[pid].to_numpy())
            for start, seeds in zip(states["start"], states["seeds"]):
                gap = _nearest(x, _vectors(seeds))[1]
                mixed = pd.util.hash_array(salt + np.uint64(1000 * (1000 * seed + start) + turn))
                luck = np.log((mixed >> np.uint64(11)).astype(float) / 2**53 + 2**-54) / np.where(gap > 0, gap, 1)
                some = np.flatnonzero(gap > 0)
                some = some[np.argsort(-luck[some], kind="stable")[:SEEDS]]
                out["start"] += [start] * len(some)
                out["luck"] += luck[some].tolist()
                out["seed"] += list(x[some])
            return frame(rows, out)

        return draw

    for turn in range(SEED_ROUNDS):
        drawn = over(base, state, drawer(turn), "start int, luck double, seed array<double>")
        best = Window.partitionBy(*keys, "start").orderBy(F.desc("luck"), "seed")
        drawn = drawn.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= SEEDS)
        more = drawn.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("_r", "seed"))).alias("_m"))  # at most SEEDS
        state = state.join(more, [*keys, "start"], "left").select(*keys, "start", F.concat("seeds", F.coalesce(F.col("_m.seed"), F.array().cast("array<array<double>>"))).alias("seeds"))
        state = durable(state)

    def count(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"start": [], "at": [], "n": []}
        x = _matrix(rows["_f"])
        for start, seeds in zip(states["start"], states["seeds"]):
            at, n = np.unique(_nearest(x, _vectors(seeds))[0], return_counts=True)
            out["start"] += [start] * len(at)
            out["at"] += at.tolist()
            out["n"] += n.tolist()
        return frame(rows, out)

    counted = over(base, state, count, "start int, at int, n long").groupBy(*keys, "start", "at").agg(F.sum("n").alias("n"))
    weights = counted.groupBy(*keys, "start").agg(F.collect_list(F.struct("at", "n")).alias("weights"))  # one per seed

    def recluster(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"k": [], "start": [], "centres": []}
        for start, seeds, weights, n in zip(pdf["start"], pdf["seeds"], pdf["weights"], pdf["_n"]):
            x, w = _vectors(seeds), {q["at"]: q["n"] for q in weights}
            at = sorted(w)
            for wanted in (q for q in ks if q <= n):
                centres = _spread_seeds(x[at], np.array([w[i] for i in at], float), wanted, (seed, start, wanted))
                out["k"].append(wanted)
                out["start"].append(start)
                out["centres"].append([c.tolist() for c in centres])
        return frame(pdf, out)

    ready = state.join(weights, [*keys, "start"]).join(chunks.select(*keys, "_n").distinct(), keys)
    fits = durable(ready.groupBy(*keys, "start").applyInPandas(recluster, ", ".join([*kinds, "k int, start int, centres array<array<double>>"])))

    # centres move until nothing changes: one pass for groups of one chunk
    def settle(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"k": [], "start": [], "centres": [], "inertia": [], "settled": []}
        x = _matrix(rows["_f"]) if len(rows) else None
        for wanted, start, packed in zip(states["k"], states["start"], states["centres"]) if x is not None else ():
            centres, done = _vectors(packed), False
            for _ in range(rounds):
                fresh = _step(x, centres, np.ones(len(x)))
                done, centres = np.abs(fresh - centres).max() <= 1e-9, fresh
                if done:
                    break
            out["k"].append(wanted)
            out["start"].append(start)
            out["centres"].append([c.tolist() for c in centres])
            out["inertia"].append(_nearest(x, centres)[1].sum())
            out["settled"].append(bool(done))
        return frame(rows, out)

    done = "k int, start int, centres array<array<double>>, inertia double, settled boolean"
    small = durable(over(base.filter("_parts = 1"), fits, settle, done))
    if not small.filter("NOT settled").isEmpty():
        raise RuntimeError(f"k-means did not settle in {rounds} rounds")
    large = base.filter("_parts > 1")
    fits = fits.join(chunks.filter("_parts > 1").select(*keys).distinct(), keys, "left_semi")
    final = small if fits.isEmpty() else small.unionByName(_large(large, durable(fits), over, frame, keys, rounds))
    choice = final.groupBy(*keys, "k").agg(F.min_by(F.struct("centres", "inertia"), F.struct(F.round("inertia", 9), "start")).alias("_b")).select(*keys, "k", "_b.*")

    def assign(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        x, parts = _matrix(rows["_f"]), []
        for wanted, packed, inertia in zip(states["k"], states["centres"], states["inertia"]):
            parts.append(rows[[*keys, pid]].assign(k=wanted, cluster=_nearest(x, _vectors(packed))[0], inertia=inertia))
        return pd.concat(parts)

    kind = base.schema[pid].dataType.simpleString()
    out = durable(over(base, choice, assign, f"{pid} {kind}, k int, cluster int, inertia double"))
    base.unpersist()
    lead = out.groupBy(*keys, "k", "cluster").agg(F.min(pid).alias("_first"))  # at most k rows a fit
    lead = lead.withColumn("_c", (F.row_number().over(Window.partitionBy(*keys, "k").orderBy("_first")) - 1).cast("int"))
    return out.join(lead.drop("_first"), [*keys, "k", "cluster"]).select(*keys, pid, "k", F.col("_c").alias("cluster"), "inertia")


def _large(rows: DataFrame, fits: DataFrame, over, frame, keys: list[str], rounds: int) -> DataFrame:
    """Fits of groups of several chunks: a pass per step, partial sums per chunk."""
    def partial(part: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"k": [], "start": [], "at": [], "n": [], "total": [], "inertia": []}
        x = _matrix(part["_f"]) if len(part) else None
        for wanted, start, packed in zip(states["k"], states["start"], states["centres"]) if x is not None else ():
            at, gap = _nearest(x, _vectors(packed))
            for c in np.unique(at):
                mine = at == c
                out["k"].append(wanted)
                out["start"].append(start)
                out["at"].append(int(c))
                out["n"].append(int(mine.sum()))
                out["total"].append(x[mine].sum(axis=0).tolist())
                out["inertia"].append(gap[mine].sum())
        return frame(part, out)

    fit = [*keys, "k", "start"]
    done = None
    for _ in range(rounds):
        sums = durable(over(rows, fits, partial, "k int, start int, at int, n long, total array<double>, inertia double"))
        totals = fold_traces(sum_traces(sums, [*fit, "at"], "total"), [*fit, "at"], "s", "total")
        means = sums.groupBy(*fit, "at").agg(F.sum("n").alias("n")).join(totals, [*fit, "at"]).select(*fit, "at", F.transform("total", lambda v: v / F.col("n")).alias("v"))
        old = fits.select(*fit, F.posexplode("centres").alias("at", "old"))
        moved = old.join(means, [*fit, "at"], "left").select(*fit, "at", "old", F.coalesce("v", "old").alias("v"))  # an empty cluster keeps its centre
        packed = F.array_sort(F.collect_list(F.struct("at", "v")))  # k entries
        fresh = moved.groupBy(*fit).agg(F.transform(packed, lambda c: c["v"]).alias("centres"), F.max(ar.l2("v", "old")).alias("_moved"))
        fresh = durable(fresh.join(sums.groupBy(*fit).agg(F.sum("inertia").alias("inertia")), fit))
        still = fresh.filter(F.col("_moved") <= 1e-9).select(*fit, "centres", "inertia", F.lit(True).alias("settled"))
        done = still if done is None else done.unionByName(still)
        fits = fresh.filter(F.col("_moved") > 1e-9).select(*fit, "centres")
        if fits.isEmpty():
            return done
    raise RuntimeError(f"k-means did not settle in {rounds} rounds")


def renumber_by_centre(clusters: DataFrame, keys, pid: str, value: DataFrame, col: str) -> DataFrame:
    """Relabel clusters of a one-dimensional fit in the order of their mean ``col``."""
    from wellspring.operators.ranking import row_index

    keys = list(keys)
    joined = clusters.join(value.select(*keys, pid, col), [*keys, pid])
    means = joined.groupBy(*keys, "cluster").agg(F.avg(col).alias("_m"))
    order = row_index(means, keys, ["_m", "cluster"], "_rank")
    return joined.join(order.drop("_m"), [*keys, "cluster"]).withColumn("cluster", F.col("_rank").cast("int")).drop("_rank", col)


def representatives(df: DataFrame, keys, pid: str = "pixel_id", x: str = "x", label: str | None = None) -> DataFrame:
    """Member nearest to the mean trace of its group (lowest id on ties), the group size and, with ``label``, its median over the members."""
    centre = mean_trace(df, keys, x, "_c")
    d = df.join(centre, list(keys)).withColumn("_d", F.round(ar.l2(x, "_c"), 9))
    out = d.groupBy(*keys).agg(F.min_by(pid, F.struct("_d", pid)).alias("representative"), F.count("*").alias("size"))
    if label is None:
        return out
    med = quantiles(df, list(keys), label, {"median_label": 0.5}).drop("n")  # members without a label do not count
    return out.join(med, list(keys), "left")
