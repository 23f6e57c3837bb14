"""Score-to-time rules: each builds one Column of minutes from an array of scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.functions import kernels as kn
from wellspring.functions.arrays import SAMPLES_PER_MIN, _c


def _centre(i, window, stride):
    return ar.centre_min(i, window, stride)


def _last(p, window, stride):
    return _centre(F.size(p) - 1, window, stride)


def first_above(p, window, stride, thr=0.5, k=3) -> Column:
    """Centre of the first of ``k`` consecutive scores above ``thr``; else the last centre."""
    p = _c(p)
    at = ar.k_run_start(p, lambda v: v > thr, k)
    return F.coalesce(_centre(at, window, stride), _last(p, window, stride))


def end_of_run(p, window, stride, thr=0.5, k=3) -> Column:
    """Centre of the k-th window of the first such run; else the last centre."""
    p = _c(p)
    at = ar.k_run_start(p, lambda v: v > thr, k)
    return F.coalesce(_centre(at + (k - 1), window, stride), _last(p, window, stride))


def fraction_above(p, window, stride, lookback=10, thr=0.5, frac=0.5) -> Column:
    """Centre of the first look-back window in which at least ``frac`` of the scores are above."""

    def scan(arr):
        def enough(i):
            part = F.slice(arr, i + 1, lookback)
            hits = F.size(F.filter(part, lambda v: v > thr))
            return (F.size(part) == lookback) & (hits / F.lit(float(lookback)) >= frac)

        starts = F.sequence(F.lit(0), F.greatest(F.size(arr) - lookback, F.lit(0)))
        return F.coalesce(_centre(ar.first_where(starts, enough), window, stride), _last(arr, window, stride))

    return ar.let(p, scan)


def linear_crossing(p, window, stride, thr=0.5) -> Column:
    """First ``p >= thr``, interpolated with the window before it; index 0 gives the first centre."""

    def cross(arr, at):
        p0, p1 = F.get(arr, at - 1), F.get(arr, at)
        c0, c1 = _centre(at - 1, window, stride), _centre(at, window, stride)
        lerp = F.when(p1 == p0, c1).otherwise(c0 + (F.lit(thr) - p0) / (p1 - p0) * (c1 - c0))
        return (
            F.when(at.isNull(), _last(arr, window, stride))
            .when(at == 0, _centre(F.lit(0), window, stride))
            .otherwise(lerp)
        )

    return ar.let(p, lambda arr: ar.let(ar.first_where(arr, lambda v: v >= thr), lambda at: cross(arr, at)))


def rise_peak(p, window, stride) -> Column:
    return _centre(ar.argmax(ar.gradient(p)), window, stride)


def curvature_peak(p, window, stride) -> Column:
    return _centre(ar.argmax(ar.gradient(ar.gradient(p))), window, stride)


def highest(p, window, stride) -> Column:
    return _centre(ar.argmax(p), window, stride)


def first_local_peak(p, window, stride) -> Column:
    """First inner sample above its left and not below its right neighbour; else the maximum."""

    def scan(arr):
        inner = F.sequence(F.lit(1), F.greatest(F.size(arr) - 2, F.lit(1)))
        at = ar.first_where(
            inner, lambda i: (F.get(arr, i) > F.get(arr, i - 1)) & (F.get(arr, i) >= F.get(arr, i + 1))
        )
        return _centre(F.coalesce(at + 1, ar.argmax(arr)), window, stride)

    return ar.let(p, scan)


def nearest_zero(p, window, stride) -> Column:
    return _centre(ar.argmin(F.transform(_c(p), lambda v: F.abs(v))), window, stride)


def first_crossing_or_null(p, thr=0.5) -> Column:
    return ar.first_where(p, lambda v: v > thr) / F.lit(SAMPLES_PER_MIN)


def sample_run(p, thr=0.5, k=3) -> Column:
    """K-run on per-sample scores; the last sample when there is none."""
    p = _c(p)
    return F.coalesce(ar.k_run_start(p, lambda v: v > thr, k), F.size(p) - 1) / F.lit(SAMPLES_PER_MIN)


def class_run(c, classes, k=3) -> Column:
    """K consecutive samples in a class set; the last sample when there is none."""
    c = _c(c)
    return F.coalesce(ar.k_run_start(c, lambda v: v.isin(list(classes)), k), F.size(c) - 1) / F.lit(SAMPLES_PER_MIN)


def smoothed_crossing(p, span=5, thr=0.5) -> Column:
    """Zero-padded moving average, first value above ``thr``; the last sample when there is none."""
    half = span // 2

    def scan(arr):
        n = F.size(arr)

        def avg(v, i):
            lo, hi = F.greatest(i - half, F.lit(0)), F.least(i + half, n - 1)
            return ar.total(F.slice(arr, lo + 1, hi - lo + 1)) / F.lit(float(span))

        return F.coalesce(ar.first_where(F.transform(arr, avg), lambda v: v > thr), n - 1) / F.lit(SAMPLES_PER_MIN)

    return ar.let(p, scan)


def largest_block(c, cls=2) -> Column:
    """Start of the longest run of ``cls``, the first on ties; the last sample when absent."""
    c = _c(c)
    best = F.aggregate(
        c,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("i"), F.lit(0).alias("top"), F.lit(-1).alias("at")),
        lambda s, v: F.struct(
            F.when(v == cls, s["run"] + 1).otherwise(0).alias("run"),
            (s["i"] + 1).alias("i"),
            F.when((v == cls) & (s["run"] + 1 > s["top"]), s["run"] + 1).otherwise(s["top"]).alias("top"),
            F.when((v == cls) & (s["run"] + 1 > s["top"]), s["i"] - s["run"]).otherwise(s["at"]).alias("at"),
        ),
        lambda s: s["at"],
    )
    return F.when(best >= 0, best).otherwise(F.size(c) - 1) / F.lit(SAMPLES_PER_MIN)


def ordered_decode(frames, classes=4, target=2, step_only=False) -> Column:
    """Best non-decreasing class path; minutes of its first ``target`` sample, else the last sample.

    ``frames`` is an array over time of per-class probabilities. The fold keeps, per class, the
    best score so far and when that path first entered ``target``. ``step_only`` allows moves
    by at most one class.
    """
    frames = _c(frames)
    n = F.size(frames)

    def emit(fr, c):
        return F.log(F.get(fr, F.lit(c)) + F.lit(1e-8))

    low = F.lit(float("-inf"))
    first = F.get(frames, F.lit(0))

    def start(c):
        score = emit(first, c) if not step_only or c == 0 else low
        return F.struct(score.alias("s"), F.lit(0 if c == target else -1).alias("at"))

    init = F.struct(F.lit(1).alias("t"), *[start(c).alias(f"k{c}") for c in range(classes)])

    def merge(acc, fr):
        out = []
        for c in range(classes):
            prevs = range(max(c - 1, 0), c + 1) if step_only else range(c + 1)
            best = None
            for q in prevs:  # the lowest class wins ties
                here = acc[f"k{q}"]
                best = here if best is None else F.when(here["s"] > best["s"], here).otherwise(best)
            at = F.when((best["at"] < 0) & F.lit(c == target), acc["t"]).otherwise(best["at"])
            out.append(F.struct((best["s"] + emit(fr, c)).alias("s"), at.alias("at")).alias(f"k{c}"))
        return F.struct((acc["t"] + 1).alias("t"), *out)

    def finish(acc):
        best = acc["k0"]
        for c in range(1, classes):
            best = F.when(acc[f"k{c}"]["s"] > best["s"], acc[f"k{c}"]).otherwise(best)
        return best["at"]

    at = F.aggregate(F.slice(frames, F.lit(2), F.greatest(n - 1, F.lit(0))), init, merge, finish)
    return F.when(at >= 0, at).otherwise(n - 1) / F.lit(SAMPLES_PER_MIN)


# --- density rules ----------------------------------------------------------------------
def density_argmax(d) -> Column:
    return ar.argmax(d) / F.lit(SAMPLES_PER_MIN)


def density_top5(d) -> Column:
    """Weighted mean position of the five largest values; the earlier sample wins ties."""
    d = _c(d)
    ranked = F.array_sort(F.transform(d, lambda v, i: F.struct((-v).alias("n"), i.alias("i"))))
    top = F.slice(ranked, 1, 5)
    mass = F.aggregate(top, F.lit(0.0), lambda s, e: s - e["n"])
    hit = F.aggregate(top, F.lit(0.0), lambda s, e: s - e["n"] * e["i"])
    return hit / (mass + F.lit(1e-12)) / F.lit(SAMPLES_PER_MIN)


def density_mean(d) -> Column:
    d = _c(d)
    hit = ar.total(F.transform(d, lambda v, i: v * i))
    return hit / (ar.total(d) + F.lit(1e-12)) / F.lit(SAMPLES_PER_MIN)


def density_median(d) -> Column:
    """First sample whose cumulative share exceeds one half."""

    def scan(arr, all_):
        return F.aggregate(
            arr,
            F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("at")),
            lambda a, v: F.struct(
                (a["s"] + v).alias("s"),
                (a["i"] + 1).alias("i"),
                F.when((a["at"] < 0) & ((a["s"] + v) / all_ > 0.5), a["i"]).otherwise(a["at"]).alias("at"),
            ),
            lambda a: a["at"],
        )

    at = ar.let(d, lambda arr: ar.let(ar.total(arr) + F.lit(1e-12), lambda all_: scan(arr, all_)))
    return F.greatest(at, F.lit(0)) / F.lit(SAMPLES_PER_MIN)


DENSITY_RULES: dict[str, Callable] = {
    "hard_argmax": density_argmax,
    "soft_argmax_top5": density_top5,
    "expected_value": density_mean,
    "first_moment_thr0p5": density_median,
}


# --- logistic fit (the one rule that needs iteration) -------------------------------------
def logistic_fit(window: int, stride: int, thr: float = 0.5):
    """Pandas UDF: midpoint ``t0`` and rate ``k`` of a fitted logistic, ``converged``, and the time ``ttp``.

    ``ttp`` is t0 clipped to the centres; the last centre (and NULL for the rest) where scores do not span ``thr``.
    All rows of a batch with equal length are fitted together, two parameters each.
    """

    @F.pandas_udf("ttp double, t0 double, k double, converged boolean")
    def fit(p: pd.Series) -> pd.DataFrame:
        out = np.full((len(p), 4), np.nan)
        for at, mat in kn.by_length(p):
            out[at] = _fit_logistic(mat, window, stride, thr)
        frame = pd.DataFrame(out, columns=["ttp", "t0", "k", "converged"]).astype(object).where(~np.isnan(out), None)
        frame["converged"] = frame["converged"].map(lambda v: None if v is None else v == 1)
        return frame

    return fit


def logistic_time(window: int, stride: int, thr: float = 0.5):
    """Time of ``logistic_fit`` as a rule."""
    fit = logistic_fit(window, stride, thr)
    return lambda p: fit(p)["ttp"]


def _fit_logistic(p: np.ndarray, window: int, stride: int, thr: float) -> np.ndarray:
    t = (np.arange(p.shape[1]) * stride + (window - 1) / 2.0) / SAMPLES_PER_MIN
    out = np.full((len(p), 4), np.nan)
    out[:, 0] = t[-1]
    ok = np.flatnonzero((p.max(axis=1) >= thr) & (p.min(axis=1) <= thr))
    if not len(ok):
        return out
    y = p[ok]
    first = np.argmax(y >= thr, axis=1)
    start = np.column_stack([np.where(first > 0, t[first], t[len(t) // 2]), np.ones(len(y))])

    def model(q):
        away = t - q[:, :1]
        f = 1.0 / (1.0 + np.exp(-np.clip(q[:, 1:] * away, -500, 500)))
        g = f * (1 - f)
        return f, np.stack([-q[:, 1:] * g, away * g], axis=2)

    q, _, done = kn.fit_rows(y, start, np.full(2, -np.inf), np.full(2, np.inf), model)
    out[ok] = np.column_stack([np.clip(q[:, 0], t[0], t[-1]), q, done])
    return out


# Rule names, families and parameters of the sweep.
WINDOW_RULES: dict[str, tuple[str, Callable]] = {
    "first_above_K1_thr0p5": ("threshold", lambda p, w, s: first_above(p, w, s, 0.5, 1)),
    "first_above_K2_thr0p5": ("threshold", lambda p, w, s: first_above(p, w, s, 0.5, 2)),
    "first_above_K3_thr0p5": ("threshold", lambda p, w, s: first_above(p, w, s, 0.5, 3)),
    "first_above_K5_thr0p5": ("threshold", lambda p, w, s: first_above(p, w, s, 0.5, 5)),
    "first_above_K3_thr0p3": ("threshold", lambda p, w, s: first_above(p, w, s, 0.3, 3)),
    "first_above_K3_thr0p7": ("threshold", lambda p, w, s: first_above(p, w, s, 0.7, 3)),
    "fraction_above_lb10_thr0p5_f0p5": ("threshold", lambda p, w, s: fraction_above(p, w, s, 10, 0.5, 0.5)),
    "end_of_K3_run_thr0p5": ("threshold", lambda p, w, s: end_of_run(p, w, s, 0.5, 3)),
    "linear_interp_thr0p5": ("interp", lambda p, w, s: linear_crossing(p, w, s, 0.5)),
    "linear_interp_thr0p3": ("interp", lambda p, w, s: linear_crossing(p, w, s, 0.3)),
    "sigmoid_fit_thr0p5": ("interp", lambda p, w, s: logistic_time(w, s, 0.5)(_c(p))),
    "first_deriv_peak": ("deriv", rise_peak),
    "second_deriv_peak": ("deriv", curvature_peak),
    "inflection_sigmoid": ("deriv", lambda p, w, s: logistic_time(w, s, 0.5)(_c(p))),
    "argmax_P": ("argmax", highest),
    "first_local_max": ("argmax", first_local_peak),
}


def apply_rules(df: DataFrame, p: str, window: int, stride: int, rules=None, keep=()) -> DataFrame:
    """One row per (input row, rule): rule columns computed side by side, then unpivoted."""
    names = list(rules or WINDOW_RULES)
    same = {"inflection_sigmoid": "sigmoid_fit_thr0p5"}  # the same fit under two names runs once
    own = [n for n in names if same.get(n) not in names]
    wide = df.select(*keep, *[WINDOW_RULES[n][1](p, window, stride).cast("double").alias(n) for n in own])
    wide = wide.withColumns({n: F.col(same[n]) for n in names if n not in own})
    return wide.unpivot(list(keep), names, "rule_id", "ttp_pred")


# Rules on class sequences; ``target`` classes count as risen, ``rising`` is the class that starts the rise.
CLASS_RULES: dict[str, Callable] = {
    "kcons2": lambda classes, shares, target, rising: class_run(classes, target, 2),
    "kcons3": lambda classes, shares, target, rising: class_run(classes, target, 3),
    "kcons5": lambda classes, shares, target, rising: class_run(classes, target, 5),
    "smoothedP": lambda classes, shares, target, rising: smoothed_crossing(F.transform(shares, lambda p: F.get(p, F.lit(rising))), 5, 0.5),
    "largestBlock": lambda classes, shares, target, rising: largest_block(classes, rising),
    "viterbiMono": lambda classes, shares, target, rising: ordered_decode(shares, target=rising),
}


def apply_class_rules(df: DataFrame, classes: str, shares: str, target=(2, 3), rules=None, keep=()) -> DataFrame:
    """One row per (input row, class rule). ``classes`` is the most likely class per sample, ``shares`` the class shares per sample."""
    names, rising = list(rules or CLASS_RULES), 2 if 2 in target else max(target)
    wide = df.select(*keep, *[CLASS_RULES[n](F.col(classes), F.col(shares), tuple(target), rising).cast("double").alias(n) for n in names])
    return wide.unpivot(list(keep), names, "rule_id", "ttp_pred")
