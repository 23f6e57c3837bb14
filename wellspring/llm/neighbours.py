"""Nearest neighbours by vantage-point trees, one tree per shard of rows.

A node holds a vantage point, the largest distance inside and the smallest outside. A side is
skipped if the triangle inequality puts it beyond the k-th best found so far; ``factor`` scales the
bound, so 1 is exact and larger values skip more. Every row is indexed. Queries travel to the
shards in blocks; a shard answers with at most k rows per query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without vec_id; vectors are compared with those of the same length. Rows that share the query's
vec_id count as its own; repeated candidates are listed once each. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.llm.common import keep

SHARD = 4096  # rows of a tree
LEAF = 64
BLOCK = 4096  # queries that a shard answers in one task
FACTOR = 1.05


def _distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def build(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A tree as arrays: rows in tree order; nodes as (from, to, split, largest inside, smallest outside)."""
    rng, order, nodes, todo = np.random.default_rng(5), np.argsort(ids, kind="stable"), {}, [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            continue
        pick = rng.integers(lo, hi)
        order[[lo, pick]] = order[[pick, lo]]
        d = _distance(x[order[lo + 1 : hi]], x[order[lo]])
        by = np.argsort(d, kind="stable")
        order[lo + 1 : hi] = order[lo + 1 : hi][by]
        half = len(d) // 2
        nodes[lo, hi] = (lo + 1 + half, d[by[half - 1]], d[by[half]])
        todo += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
    out = io.BytesIO()
    np.savez(out, ids=ids[order], x=x[order], at=np.array(list(nodes), np.int64).reshape(-1, 2), split=np.array([v[0] for v in nodes.values()], np.int64), bound=np.array([v[1:] for v in nodes.values()]).reshape(-1, 2))
    return out.getvalue()


def search(tree: dict, own: int, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest rows of ``tree``, by (distance, id)."""
    ids, x, nodes = tree["ids"], tree["x"], tree["nodes"]
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    reach, todo = np.inf, [(0, len(ids), 0.0)]
    while todo:
        lo, hi, least = todo.pop()
        if least * factor > reach * (1 + 1e-9) + 1e-300:  # slack for rounding; ties must still be seen
            continue
        node = nodes.get((lo, hi))
        d, i = _distance(x[lo : lo + 1 if node else hi], q), ids[lo : lo + 1 if node else hi]
        use = (i != own) & (d <= reach)
        if use.any():
            best_d, best_i = np.concatenate([best_d, d[use]]), np.concatenate([best_i, i[use]])
            if len(best_d) > k:
                top = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[top], best_i[top]
            if len(best_d) == k:
                reach = best_d.max()
        if node:
            split, inside, outside = node
            sides = [(lo + 1, split, max(least, d[0] - inside)), (split, hi, max(least, outside - d[0]))]
            todo += sides if d[0] > (inside + outside) / 2 else sides[::-1]  # the nearer side is searched first
    top = np.lexsort((best_i, best_d))
    return best_d[top], best_i[top]


def usable(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    return rows.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).filter(fine)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest in ``rows``, nearest first."""
    points, asked = keep(usable(rows, ident, vector), "points"), keep(usable(queries, ident, vector), "asked")
    shards, blocks = max(1, math.ceil(points.count() / SHARD)), max(1, math.ceil(asked.count() / BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build(frame["id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()))
        return pd.DataFrame({"dim": frame["dim"].iloc[:1], "shard": frame["shard"].iloc[:1], "tree": [tree]})

    index = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, tree binary")
    index = keep(index, "trees").withColumn("block", each(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))

    def answer(trees: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for packed in trees["tree"]:
            tree = dict(np.load(io.BytesIO(packed)))
            tree["nodes"] = {(int(a), int(b)): (int(s), *map(float, d)) for (a, b), s, d in zip(tree["at"], tree["split"], tree["bound"])}
            for q, v in zip(qs["id"], qs["v"]):
                d, i = search(tree, q, np.asarray(v, float), k, factor)
                out.append(pd.DataFrame({"query_id": q, "vec_id": i, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    by = ("dim", "shard", "block")
    found = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
