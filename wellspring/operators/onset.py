"""Onset (landmark) extractors on array traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.functions import kernels as kn
from wellspring.operators.series import savgol_rows
from wellspring.session import spread


def pixel_shift(x: str, mean: str, anchor: int | str, half: int, max_lag: int) -> Column:
    """Lag (within ``max_lag``) at which the pixel best matches its well mean around ``anchor`` (a sample, or the column that holds it).

    Positive means later than the mean; 0 for short or flat stretches; the lowest lag wins ties.
    """
    anchor = F.col(anchor) if isinstance(anchor, str) else F.lit(anchor)
    lo = F.greatest(anchor - half, F.lit(0)).cast("int")

    def unit(a):
        return ar.let(F.struct(ar.mean(a).alias("m"), ar.std(a).alias("s")),
                      lambda st: F.when(st["s"] >= 1e-9, F.transform(a, lambda v: (v - st["m"]) / st["s"])))

    def best(p, m):
        n = F.size(p)
        lag_score = lambda k: F.struct(
            F.round(F.aggregate(
                F.zip_with(F.slice(p, F.greatest(k, F.lit(0)) + 1, n - F.abs(k)), F.slice(m, F.greatest(-k, F.lit(0)) + 1, n - F.abs(k)), lambda a, b: a * b),
                F.lit(0.0), lambda s, v: s + v), 9).alias("s"),
            (-k).alias("neg"))
        lags = F.transform(F.sequence(F.greatest(F.lit(-max_lag), 1 - n), F.least(F.lit(max_lag), n - 1)), lag_score)
        return F.when((n >= 5) & p.isNotNull() & m.isNotNull(), (-F.array_max(lags)["neg"]).cast("int")).otherwise(0)

    cut = lambda c: F.slice(c, lo + 1, (anchor + half - lo).cast("int"))
    return F.coalesce(ar.let(unit(cut(F.col(x))), lambda p: ar.let(unit(cut(F.col(mean))), lambda m: best(p, m))), F.lit(0))


LANDMARKS = "ttp double, peak double, cy0 double, sdm double"
VARIANTS = "array<struct<rule:string,ttp:double,reason:string>>"


def landmarks(start: float, end: float = 35.0, span: int = 100, frac: float = 0.4, baseline: float = 1.0, rate: float = 15.0,
              min_baseline: int = 1):
    """Pandas UDF: threshold time, derivative peak, tangent intercept and curvature peak, in minutes.

    A landmark that cannot be found is NULL. Smoothing and peak search run on slices of a batch, so memory does not follow the batch.
    """
    def batch(x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), 4), np.nan)
        t = np.arange(x.shape[1]) / rate
        s = kn.moving_average(x, span)
        d1 = kn.moving_average(np.diff(s, axis=1), span)
        d2 = kn.moving_average(np.diff(d1, axis=1), span)
        lo, hi = int(np.searchsorted(t, start)), int(np.searchsorted(t, end))
        if d1[:, lo:hi].shape[1] < 10:
            return out
        pk = kn.strongest(d1[:, lo:hi], 1e-5)
        some = np.flatnonzero(pk >= 0)
        if not len(some):
            return out
        pk, x, s, d1, d2 = pk[some] + lo, x[some], s[some], d1[some], d2[some]
        top = np.take_along_axis(d1, pk[:, None], axis=1)[:, 0]
        out[some, 1] = t[pk]
        out[some, 0] = _last_below(x, d1, np.full(len(pk), lo), pk, top, frac, t)
        slope = top * rate
        b0 = max(int(np.searchsorted(t, t[0] + start - baseline)), 0)
        b1 = max(lo, b0 + 1)
        steep = np.isfinite(slope) & (np.abs(slope) >= 1e-6)
        if b1 - b0 >= min_baseline and steep.any():
            level = s[np.arange(len(pk)), pk] - np.median(s[:, b0:b1], axis=1)
            out[some[steep], 2] = (t[pk] - level / np.where(steep, slope, 1.0))[steep]
        size = np.minimum(pk + 1, d2.shape[1]) - lo
        long = np.flatnonzero(size >= 10)
        if len(long):
            k2 = kn.strongest(d2[long, lo:], 1e-7, size[long])
            out[some[long[k2 >= 0]], 3] = t[lo + k2[k2 >= 0]]
        return out

    @F.pandas_udf(LANDMARKS)
    def extract(x: pd.Series) -> pd.DataFrame:
        res = np.full((len(x), 4), np.nan)
        for at, mat in kn.by_length(x, kn.SLICE):
            res[at] = batch(mat)
        return pd.DataFrame(res, columns=["ttp", "peak", "cy0", "sdm"]).astype(object).where(~np.isnan(res), None)

    return extract


def _last_below(x, d, lo, pk, top, frac, t) -> np.ndarray:
    """Time of the last step of ``x`` in lo..pk that stays under ``frac`` of the way from the least ``d`` there to ``top``; NaN if none."""
    col = np.arange(d.shape[1])
    inside = (col >= lo[:, None]) & (col <= pk[:, None])
    floor = np.where(inside, d, np.inf).min(axis=1)
    hit = inside & (np.diff(x, axis=1) < (floor + frac * (top - floor))[:, None])
    last = hit.shape[1] - 1 - np.argmax(hit[:, ::-1], axis=1)
    return np.where(hit.any(axis=1), t[last], np.nan)


def zero_crossing(x, anchor, ahead: float, rate: float = 15.0, window: int = 21, poly: int = 3) -> Column:
    """First + to - change of the smoothed second derivative in [anchor, anchor + ahead], interpolated."""
    def scan(d2, a):
        n = F.size(d2)
        lo = F.ceil(a * rate).cast("int")
        hi = F.least(F.floor((a + ahead) * rate).cast("int"), n - 1)
        idx = F.sequence(F.greatest(lo, F.lit(0)), F.greatest(hi - 1, F.greatest(lo, F.lit(0))))
        falls = lambda i: (i + 1 <= hi) & (F.signum(F.get(d2, i + 1)) < F.signum(F.get(d2, i)))
        at = ar.first_where(idx, falls) + F.greatest(lo, F.lit(0))
        return ar.let(at, lambda i: (i + F.get(d2, i) / (F.get(d2, i) - F.get(d2, i + 1))) / F.lit(rate))

    curve = ar.gradient(ar.gradient(ar.savgol(x, window, poly)))
    return ar.let(curve, lambda d2: ar.let(ar._c(anchor), lambda a: F.when(a.isNotNull() & d2.isNotNull(), scan(d2, a))))


def slope_peak_time(x, lo: float, tail: float, rate: float = 15.0, window: int = 15, poly: int = 3) -> Column:
    """Time of the steepest smoothed slope within [lo, end - tail]; NULL for an empty range."""
    def pick(d):
        last = (F.size(d) - 1) / F.lit(rate)
        inside = F.transform(d, lambda v, i: F.when((i / F.lit(rate) >= lo) & (i / F.lit(rate) <= last - tail), F.round(v, 10)))
        return ar.let(inside, lambda w: F.when(F.array_max(w).isNotNull(), ar.argmax(w) / F.lit(rate)))

    return ar.let(ar.gradient(ar.savgol(x, window, poly)), pick)


def anchored(span: int = 100, window: int = 21, poly: int = 3, ahead: float = 15.0, margin: float = 2.0, baseline: float = 1.0,
             frac: float = 0.4, share: float = 0.05, rate: float = 15.0):
    """Pandas UDF (x, anchor minutes): the four anchored variants with reasons, as an array of structs."""
    names = ("closest_peak_d1", "zero_cross_d2", "cy0_after_plate", "thr_deriv_after_plate")
    weights = savgol_rows(window, poly)

    def closest(d1, t, a):
        row, at, _ = kn.peaks(d1, np.abs(d1).max(axis=1) * share, None)
        use = (t[at] >= a[row]) & (t[at] <= a[row] + ahead)
        row, at = row[use], at[use]
        got = kn.first_per_row(row, at, len(d1), at, np.abs(t[at] - a[row]))
        return np.where(got >= 0, t[got], np.nan), np.where(got >= 0, "ok", "no derivative peak in window")

    def crossing(d2, t, a):
        inside = (t >= a[:, None]) & (t <= a[:, None] + ahead)
        falls = inside[:, :-1] & inside[:, 1:] & (np.diff(np.sign(d2), axis=1) < 0)
        i, some, each = np.argmax(falls, axis=1), falls.any(axis=1), np.arange(len(d2))
        step = np.where(some, d2[each, i] - d2[each, i + 1], 1.0)
        return np.where(some, t[i] + d2[each, i] / step * (t[i + 1] - t[i]), np.nan), np.where(some, "ok", "no zero crossing in window")

    def classical(x, s, ds, t, a):
        each = np.arange(len(x))
        lo, hi = np.searchsorted(t, a - margin), np.searchsorted(t, a + ahead)
        size = np.minimum(hi, ds.shape[1]) - lo
        enough = size >= 10
        why = np.where(enough, "no derivative peak in window", "too few samples in window").astype(object)
        cut = np.take_along_axis(ds, np.minimum(lo[:, None] + np.arange(max(size.max(initial=0), 1)), ds.shape[1] - 1), axis=1)
        pk = kn.strongest(cut, 1e-5, np.where(enough, size, 0))
        some = pk >= 0
        pk = np.where(some, pk + lo, 0)
        top = ds[each, pk]
        b0 = np.searchsorted(t, a - margin - baseline)
        b0 = np.where(lo - b0 < 2, 0, b0)
        n_base, slope = lo - b0, top * rate
        flat = ~np.isfinite(slope) | (np.abs(slope) < 1e-6)
        col = np.arange(s.shape[1])
        base = np.sort(np.where((col >= b0[:, None]) & (col < lo[:, None]), s, np.inf), axis=1)
        n_safe = np.maximum(n_base, 1)
        level = (base[each, (n_safe - 1) // 2] + base[each, n_safe // 2]) / 2
        fine = some & (n_base >= 2) & ~flat
        cy = np.where(fine, t[pk] + (np.where(fine, level, 0.0) - s[each, pk]) / np.where(fine, slope, 1.0), np.nan)
        cy_why = np.where(~some, why, np.where(n_base < 2, "baseline window too small", np.where(flat, "degenerate tangent slope", "ok")))
        thr = np.where(some & (pk > lo), _last_below(x, ds, lo, pk, top, frac, t), np.nan)
        thr_why = np.where(~some, why, np.where(np.isnan(thr), "no crossing below threshold", "ok"))
        return (cy, cy_why), (thr, thr_why)

    @F.pandas_udf(VARIANTS)
    def extract(x: pd.Series, anchor: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        for at, mat in kn.by_length(x):
            n = mat.shape[1]
            t = np.arange(n) / rate
            a = anchor.iloc[at].to_numpy(float, na_value=np.nan)
            known = np.isfinite(a)
            for row, ok in zip(at, known):
                why = "signal too short" if n < window else "no anchor time"
                out.iat[row] = None if ok and n >= window else [{"rule": r, "ttp": None, "reason": why} for r in names]
            if n < window or not known.any():
                continue
            at, mat, a = at[known], mat[known], a[known]
            begin = np.clip(np.arange(n) - window // 2, 0, n - window)
            sg = np.stack([mat[:, b : b + window] @ weights[i - b] for i, b in enumerate(begin)], axis=1)
            d1 = np.gradient(sg, t, axis=1)
            d2 = np.gradient(d1, t, axis=1)
            s = kn.moving_average(mat, span)
            ds = kn.moving_average(np.diff(s, axis=1), span)
            got = [closest(d1, t, a), crossing(d2, t, a), *classical(mat, s, ds, t, a)]
            for i, row in enumerate(at):
                out.iat[row] = [{"rule": r, "ttp": None if np.isnan(v[i]) else float(v[i]), "reason": str(why[i])} for r, (v, why) in zip(names, got)]
        return out

    return extract


def sigmoid_fit(rate: float = 15.0):
    """Pandas UDF: bounded five-parameter fit per trace; ``fit_ok`` is false for a fit that did not converge and, with NULLs, for traces that cannot be fitted."""
    @F.pandas_udf("fm double, fb double, sc double, cs double, asym double, r2 double, fit_ok boolean")
    def fit(x: pd.Series) -> pd.DataFrame:
        res = np.full((len(x), 7), np.nan)
        for at, mat in kn.by_length(x):
            fine = np.isfinite(mat).all(axis=1) & (mat.shape[1] >= 3)
            if fine.any():
                res[at[fine]] = kn.fit_5pl(mat[fine])
        res[:, 2] *= rate
        res[:, 3] /= rate
        ok = np.isfinite(res).all(axis=1) & (res[:, 6] == 1)
        frame = pd.DataFrame(res[:, :6], columns=["fm", "fb", "sc", "cs", "asym", "r2"]).astype(object).where(~np.isnan(res[:, :6]), None)
        frame["fit_ok"] = ok
        return frame

    return fit


def artefact_cut(span: int = 10, search: float = 5.0, grace: int = 3, descent: float = 0.10, settle: float = 0.30, post: float = 1.0, rate: float = 15.0):
    """Pandas UDF on well-mean traces: samples to cut after an early drop-and-jump, 0 when there is none."""
    def cut(s, d):
        m = min(int(np.searchsorted(np.arange(len(s)) / rate, search)), len(d))
        if m < grace + 1:
            return 0
        held = lambda ok: np.convolve(ok, np.ones(grace), "valid") == grace
        fell = np.maximum.accumulate(d < 0)
        turns = np.flatnonzero(held((d >= 0).astype(float))[: m - grace] & fell[: m - grace])
        if not len(turns) or s[: turns[0] + 1].max() - s[turns[0]] < descent * max(np.ptp(s[:m]), 1e-9):
            return 0
        low = int(turns[0])
        stop = min(low + 1 + max(1, round(post * rate)), m)
        climb = d[low + 1 : stop]
        if len(climb) < grace + 1 or climb.max() <= 0:
            return low + 1
        top = low + 1 + int(np.argmax(climb))
        calm = np.flatnonzero(held((d[top + 1 : stop] < settle * climb.max()).astype(float))) if stop - top - 1 >= grace else []
        return (top + 1 + int(calm[0]) if len(calm) else stop - 1) + 1

    @F.pandas_udf("int")
    def find(x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), int)
        for at, mat in kn.by_length(x):
            s = kn.moving_average(mat, span)
            for i, row in enumerate(at):
                out[row] = cut(s[i], np.diff(s[i]))
        return pd.Series(out)

    return find


def trim_artefact(df: DataFrame, keys=("chip_id", "well_id"), **kw) -> DataFrame:
    """Cut every trace of a chip by the largest cut of its wells; adds ``cut_idx``."""
    from wellspring.operators.spatial import mean_trace

    cuts = mean_trace(df, list(keys)).select("chip_id", artefact_cut(**kw)("x").alias("c")).groupBy("chip_id").agg(F.max("c").alias("cut_idx"))
    got = df.join(cuts, "chip_id")
    return got.withColumn("x", F.expr("slice(x, cut_idx + 1, size(x))"))


# --- plate curves and fitted-curve features ---------------------------------------------------
def plate_features(x, window: int = 9, base: int = 5, sigmas: float = 3.0, flat: float = 0.05) -> Column:
    """Baseline, interpolated start, steepest cycle, plateau and end level of a plate curve (cycles from 1)."""
    def lerp(arr, i, level):
        a, b = F.get(arr, i - 1), F.get(arr, i)
        return i + F.when(a == b, 0.0).otherwise((level - a) / (b - a))

    def build(st):
        s, d = st["s"], st["d"]
        n = F.size(s)
        start_at = ar.first_where(s, lambda v: v > st["bm"] + sigmas * st["bs"])
        start = F.when(start_at == 0, 1.0).otherwise(lerp(s, start_at, st["bm"] + sigmas * st["bs"]))
        steep = ar.argmax(d)
        top = F.array_max(d)
        positive = F.coalesce((top > 5.0 * st["dn"]) & (start < n - 5), F.lit(False))
        tail = F.slice(d, steep + 1, n)
        drop = ar.first_where(tail, lambda v: v <= flat * top) + steep
        plateau = F.when(drop.isNull(), n.cast("double")).otherwise(lerp(d, drop, flat * top))
        return F.struct(
            st["bm"].alias("baseline_mean"), st["bs"].alias("baseline_std"), st["pf"].alias("plateau_level"), start.alias("start"),
            F.when(positive, (steep + 1).cast("double")).alias("takeoff"), F.when(positive, plateau).alias("plateau"), top.alias("max_slope"), positive.alias("is_positive"))

    def prep(arr):
        head = F.slice(arr, 1, base)
        tail = F.slice(arr, -5, 5)
        smooth = ar.savgol(arr, window, 3)
        return ar.let(smooth, lambda s: ar.let(ar.gradient(s), lambda d: ar.let(F.struct(
            s.alias("s"), d.alias("d"), ar.mean(head).alias("bm"), F.greatest(ar.std(head), F.lit(1e-9)).alias("bs"), ar.mean(tail).alias("pf"),
            F.greatest(ar.std(F.slice(d, 1, base)), F.lit(1e-9)).alias("dn")), build)))

    return ar.let(x, prep)


def sigmoid_value(x, fm, fb, sc, cs, asym):
    return fm / F.pow(1.0 + F.exp(-sc * (x - cs)), asym) + fb


def kinetic_features(df: DataFrame, n: int, step: float, threshold: float = 0.1) -> DataFrame:
    """Shape features of a fitted curve (columns fm, fb, sc, cs, asym) sampled at n points: ``kernels.FITTED_FEATURES``, a batch of rows at a time.

    Rows are dealt over all tasks first: a table of parameters is small to read and long to work on.
    """
    pars = ("fm", "fb", "sc", "cs", "asym")

    @F.pandas_udf(", ".join(f"{c} double" for c in kn.FITTED_FEATURES))
    def features(fm: pd.Series, fb: pd.Series, sc: pd.Series, cs: pd.Series, asym: pd.Series) -> pd.DataFrame:
        given = np.column_stack([c.to_numpy(float, na_value=np.nan) for c in (fm, fb, sc, cs, asym)])
        res = kn.fitted_features(given, n, step, threshold)
        return pd.DataFrame(res, columns=kn.FITTED_FEATURES).astype(object).where(~np.isnan(res), None)

    return spread(df).select(*df.columns, features(*[F.col(c).cast("double") for c in pars]).alias("_k")).select(*df.columns, "_k.*")


def raw_kinetics(step: float, threshold: float = 0.1, method: str = "gradient"):
    """Pandas UDF: features of the sampled curve itself, with ``ct`` (20 % of the fitted rise) and ``cy0`` of its five-parameter fit.

    ``method`` picks the derivative (gradient, savgol or diff). A feature that does not exist is NULL; ct and cy0 are NULL without a converged fit.
    """
    names = [*kn.RAW_FEATURES, "ct", "cy0"]

    def fitted(mat: np.ndarray) -> np.ndarray:
        fm, fb, sc, cs, asym, _, done = kn.fit_5pl(mat).T
        t = np.arange(mat.shape[1])
        e = np.exp(np.clip(-sc[:, None] * (t - cs[:, None]), -500, 500))
        curve = fm[:, None] * (1 + e) ** -asym[:, None] + fb[:, None]
        low, high = curve.min(axis=1), curve.max(axis=1)
        over = curve > (low + 0.2 * (high - low))[:, None]
        i, each = np.argmax(over, axis=1), np.arange(len(mat))
        before = np.maximum(i - 1, 0)
        a, b = curve[each, before], curve[each, i]
        ct = np.where(a == b, i, before + (low + 0.2 * (high - low) - a) / np.where(a == b, 1.0, b - a))
        ct = np.where(over.any(axis=1) & (high > low), ct, np.nan)
        xi = cs + np.log(asym) / sc
        e = np.exp(np.clip(-sc * (xi - cs), -500, 500))
        slope = fm * asym * sc * e * (1 + e) ** (-asym - 1)
        cy0 = np.where(slope != 0, xi - (fm * (1 + e) ** -asym + fb) / np.where(slope != 0, slope, 1.0), np.nan)
        return np.where((done == 1)[:, None], np.column_stack([ct, cy0]) * step, np.nan)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def features(x: pd.Series) -> pd.DataFrame:
        res = np.full((len(x), len(names)), np.nan)
        for at, mat in kn.by_length(x):
            fine = np.isfinite(mat).all(axis=1)
            if fine.any():
                res[at[fine], :-2] = kn.raw_features(mat[fine], step, threshold, method)
                if mat.shape[1] >= 3:
                    res[at[fine], -2:] = fitted(mat[fine])
        return pd.DataFrame(res, columns=names).astype(object).where(~np.isnan(res), None)

    return features


def derivatives(step: float, method: str, order: int = 1, window: int = 11, poly: int = 2):
    """Pandas UDF: derivative of every trace by ``kernels.derivative``."""
    @F.pandas_udf("array<double>")
    def slopes(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        for at, mat in kn.by_length(x):
            for row, d in zip(at, kn.derivative(mat, step, order, method, window, poly)):
                out.iat[row] = [None if np.isnan(v) else float(v) for v in d]
        return out

    return slopes


def variant_rows(**parameters):
    """Python table function: four rows (id, rule, ttp, reason) per row (id, x, anchor) of its table argument.

    Rows arrive partition by partition and are worked on HELD at a time, so a partition may be of any size.
    """
    run, held = anchored(**parameters).func, HELD

    class Variants:
        def __init__(self):
            self.rows: list = []

        def eval(self, row):
            self.rows.append((row["id"], row["x"], row["anchor"]))
            if len(self.rows) >= held:
                yield from self.flush()

        def terminate(self):
            yield from self.flush()

        def flush(self):
            if self.rows:
                ids, xs, anchors = zip(*self.rows)
                self.rows = []
                found = run(pd.Series([None if x is None else np.array(x, float) for x in xs]), pd.Series(anchors, dtype=float))
                for ident, four in zip(ids, found):
                    for v in four if four is not None else ():
                        yield ident, v["rule"], v["ttp"], v["reason"]

    return F.udtf(Variants, returnType="id bigint, rule string, ttp double, reason string")


HELD = 512  # traces that the table function holds at once
