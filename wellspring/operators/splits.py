"""Seeded, leak-free splits. Rows are ordered by a hash of (seed, id), so the same seed gives the same split."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.operators.ranking import attach, row_index
from wellspring.session import durable


def shuffle_key(seed: int, *ids) -> Column:
    """Uniform, engine-independent order: hex digest of seed and ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]).cast("binary"))


def stratified(df: DataFrame, strata, ids, cuts: dict[str, float], seed: int = 0, split_rows=None) -> DataFrame:
    """Assign ``split`` by exact position within each stratum; ``cuts`` maps name to upper share."""
    d = df.withColumn("_k", shuffle_key(seed, *ids))
    d = row_index(d, list(strata), ["_k", *ids], "_i", split_rows)
    d = attach(d, df.groupBy(*strata).agg(F.count("*").alias("_n")), list(strata))
    expr = None
    for name, upper in cuts.items():
        cond = F.col("_i") < F.floor(F.col("_n") * F.lit(float(upper)))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return d.withColumn("split", expr.otherwise(list(cuts)[-1])).drop("_k", "_i", "_n")


def hold_out(df: DataFrame, group: str, held, then: DataFrame) -> DataFrame:
    """Rows of the held groups become ``test``; the others keep the split given in ``then``."""
    test = df.filter(F.col(group).isin(list(held))).withColumn("split", F.lit("test"))
    return then.unionByName(test)


def pick_group(df: DataFrame, group: str, seed: int) -> DataFrame:
    """One group chosen by hash; one row."""
    return df.select(group).distinct().agg(F.min_by(group, shuffle_key(seed, group)).alias("picked"))


def pick_groups(df: DataFrame, keys, n: int, seed: int) -> DataFrame:
    return df.select(*keys).distinct().orderBy(shuffle_key(seed, *keys)).limit(n)


def dealt_folds(df: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """Whole groups per fold with even labels: groups sorted by positive share and size, dealt in a snake; group and ``fold``, one row per group."""
    per = df.groupBy(group).agg(F.avg(label).alias("_p"), F.count("*").alias("_n"))
    d = row_index(per.withColumn("_k", shuffle_key(seed, group)), [], ["_p", "_n", "_k"], "_i")
    turn, seat = F.floor(F.col("_i") / folds), F.col("_i") % folds
    fold = F.when(turn % 2 == 0, seat).otherwise(folds - 1 - seat).cast("int")
    return d.select(group, fold.alias("fold"))


GROUPS = 20_000  # groups that one task places; more are placed in blocks of their own


def _greedy(counts: np.ndarray, folds: int) -> np.ndarray:
    """Fold of each group (rows of label counts, in the order of placement) that keeps the label shares of the folds closest.

    Each group goes where the mean over labels of the standard deviation over folds is smallest, then to the smaller fold.
    """
    share = counts / np.maximum(counts.sum(axis=0), 1)
    held, rows, out = np.zeros((folds, counts.shape[1])), np.zeros(folds), np.empty(len(counts), int)
    for i, group in enumerate(share):
        trial = held[None, :, :] + np.eye(folds)[:, :, None] * group
        out[i] = np.lexsort((rows, np.round(trial.std(axis=1).mean(axis=1), 12)))[0]
        held[out[i]] += group
        rows[out[i]] += counts[i].sum()
    return out


def _placed(groups: DataFrame, keys: list[str], group: str, folds: int, seed: int, out: str) -> DataFrame:
    """keys, group, ``out``: greedy folds within ``keys`` of groups with label counts ``_counts`` (label -> rows)."""
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    total = groups.count()
    blocks = max(1, math.ceil(total / GROUPS))
    block = F.pmod(F.xxhash64(group), F.lit(blocks)).cast("int")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = sorted({k for c in pdf["_counts"] for k in dict(c)})
        counts = np.array([[dict(c).get(k, 0) for k in labels] for c in pdf["_counts"]], float)
        order = np.lexsort((pdf["_k"].to_numpy(str), -counts.std(axis=1)))  # the most uneven groups first
        fold = np.empty(len(pdf), int)
        fold[order] = _greedy(counts[order], folds)
        return pdf[[*keys, group]].assign(**{out: fold})

    rows = groups.select(*keys, group, "_counts", shuffle_key(seed, group).alias("_k"), block.alias("_block"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, group]) + f", {out} int"
    return rows.groupBy(*keys, "_block").applyInPandas(place, schema)


def _label_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    per = df.groupBy(group, F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l")).agg(F.count("*").alias("_c"))
    return per.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_l", "_c"))).alias("_counts"))  # one entry per label


def grouped_folds(df: DataFrame, group: str, label: str, folds: int, seed: int) -> DataFrame:
    """Whole groups per fold with balanced labels: group and ``fold``, one row per group.

    ``group`` counts devices, not samples; beyond GROUPS of them each hash block is balanced on its own.
    """
    return _placed(_label_counts(df, group, label), [], group, folds, seed, "fold")


def nested_folds(df: DataFrame, group: str, label: str, folds: int = 5, inner: int = 7, seed: int = 0) -> DataFrame:
    """fold, group, split: each outer fold is the test set once; of the other groups the first of ``inner`` folds validates."""
    groups = _label_counts(df, group, label)
    outer = _placed(groups, [], group, folds, seed, "_home").join(groups, group)
    every = durable(outer.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))))
    test = every.filter("fold = _home").select("fold", group, F.lit("test").alias("split"))
    rest = _placed(every.filter("fold <> _home").select("fold", group, "_counts"), ["fold"], group, inner, seed + 1, "_in")
    return test.unionByName(rest.select("fold", group, F.when(F.col("_in") == 0, "val").otherwise("train").alias("split")))


def capped_sample(df: DataFrame, keys, ids, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows per group, without replacement: those with the lowest index in the group's hash order."""
    d = df.withColumn("_k", shuffle_key(seed, *ids))
    return row_index(d, list(keys), ["_k", *ids], "_r").filter(F.col("_r") < n).drop("_k", "_r")
