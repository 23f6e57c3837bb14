"""Per-sample and per-window label builders, and boundary comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.functions.arrays import SAMPLES_PER_MIN


def _samples(n: int):
    return F.sequence(F.lit(0), F.lit(n - 1))


def binary(ttp: str, n: int) -> Column:
    return ar.let(F.col(ttp) * SAMPLES_PER_MIN, lambda at: F.transform(_samples(n), lambda t: (t >= at).cast("int")))


def gaussian(ttp: str, sigma: float, n: int) -> Column:
    return ar.let(
        F.col(ttp) * SAMPLES_PER_MIN,
        lambda at: F.transform(_samples(n), lambda t: F.exp(-F.pow(t - at, F.lit(2.0)) / F.lit(2 * sigma * sigma))),
    )


def four_class(ttp: str, n: int, before: int = 30, amp: int = 90) -> Column:
    """0 before, 1 in the ``before`` samples up to the onset, 2 for ``amp`` samples, 3 after."""
    return ar.let(F.col(ttp) * SAMPLES_PER_MIN, lambda at: F.transform(
        _samples(n),
        lambda t: F.when(t < at - before, 0).when(t < at, 1).when(t < at + amp, 2).otherwise(3),
    ))


def from_boundaries(b1, b2, b3, n: int) -> Column:
    """Classes 0-3 split at ascending boundaries; boundaries are clipped into range and order."""
    lo = F.least(F.greatest(b1, F.lit(0)), F.lit(n))
    mid = F.least(F.greatest(b2, lo), F.lit(n))
    hi = F.least(F.greatest(b3, mid), F.lit(n))
    return ar.let(F.struct(lo.alias("a"), mid.alias("b"), hi.alias("c")), lambda s: F.transform(
        _samples(n), lambda t: F.when(t < s["a"], 0).when(t < s["b"], 1).when(t < s["c"], 2).otherwise(3)))


def valid_boundaries(b1, b2, b3, n: int) -> Column:
    return (b1 >= 0) & (b1 <= b2) & (b2 <= b3) & (b3 <= n)


def first_index(c, cls: int) -> Column:
    return ar.first_where(c, lambda v: v == cls)


def boundary_error(pred, true, cls: int) -> Column:
    """Signed sample error of the first ``cls``; NULL when it is absent from either side."""
    return first_index(pred, cls) - first_index(true, cls)


def weighted_accuracy(pred, true, reach: int = 15, weight: float = 5.0) -> Column:
    """Share of matching samples, those within ``reach`` of a true boundary weighing more."""
    marks = F.array_compact(F.array(*[first_index(true, c) for c in (1, 2, 3)]))

    def share(m):
        w = lambda i: F.when(F.exists(m, lambda b: F.abs(i - b) <= reach), F.lit(weight)).otherwise(1.0)
        pairs = F.zip_with(pred, true, lambda p, t: (p == t).cast("double"))
        return ar.let(F.transform(pairs, lambda ok, i: F.struct((ok * w(i)).alias("h"), w(i).alias("w"))), lambda ps: (
            F.aggregate(ps, F.lit(0.0), lambda a, e: a + e["h"]) / F.aggregate(ps, F.lit(0.0), lambda a, e: a + e["w"])))

    return ar.let(marks, share)


def window_labels(ttp: str, count, window: int, stride: int, kind: str = "hard", sigma: float = 1.0) -> Column:
    """Per-window label from centre and onset: hard, soft (logistic) or signed distance."""
    def one(i):
        c = ar.centre_min(i, window, stride)
        if kind == "hard":
            return (c >= F.col(ttp)).cast("double")
        if kind == "soft":
            return 1.0 / (1.0 + F.exp(-(c - F.col(ttp)) / sigma))
        return F.col(ttp) - c

    return F.transform(F.sequence(F.lit(0), count - 1), one)


def sample_at(minutes, n: int, rate: float = 15.0) -> Column:
    """First sample whose time is not before ``minutes``; NULL stays NULL."""
    minutes = F.col(minutes) if isinstance(minutes, str) else minutes
    early = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / F.lit(rate) < minutes)
    return F.when(minutes.isNotNull(), F.size(early))


def shifted_boundaries(onset, before, after, shift, n: int, rate: float = 15.0) -> Column:
    """Struct b1, b2, b3: samples of the onset and of the spacings before and after it (minutes), moved by ``shift`` samples, within 0..n."""
    at = lambda minutes: F.least(F.greatest(F.bround(minutes * rate, 0) + shift, F.lit(0)), F.lit(n)).cast("int")
    return F.struct(at(onset - before).alias("b1"), at(onset).alias("b2"), at(onset + after).alias("b3"))
