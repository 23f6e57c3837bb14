"""Small NumPy kernels on batches of equal-length traces, and the pandas UDFs around them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


SLICE = 131_072  # samples of a slice


def by_length(x: pd.Series, most: int | None = None):
    """Yield (row positions, stacked matrix) per trace length, so a batch runs vectorised; with ``most``, in slices of at most that many samples."""
    sizes = x.map(lambda a: -1 if a is None else len(a)).to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        rows = max(1, most // size) if most else len(at)
        for lo in range(0, len(at), rows):
            part = at[lo : lo + rows]
            yield part, np.stack(x.iloc[part].to_numpy()).astype(float)


def running_sum():
    """Pandas UDF: running sum of absolute values, linear in the length of a trace; a missing sample makes the rest missing."""
    @F.pandas_udf("array<double>")
    def total(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else np.cumsum(np.abs(np.asarray(a, float))))

    return total


def spectrogram(window: int, hop: int, keep: int):
    """Pandas UDF: Hann-windowed, mean-removed one-sided power per (bin, frame), lowest bins."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    scale = 1.0 / (taper**2).sum()

    @F.pandas_udf("array<array<double>>")
    def power(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        for at, mat in by_length(x):
            if mat.shape[1] < window:
                continue
            view = np.lib.stride_tricks.sliding_window_view(mat, window, axis=1)[:, ::hop]
            view = view - view.mean(axis=2, keepdims=True)
            spec = np.abs(np.fft.rfft(view * taper, axis=2)) ** 2 * scale
            spec[:, :, 1 : (window + 1) // 2] *= 2
            spec = spec[:, :, :keep].transpose(0, 2, 1)
            for row, s in zip(at, spec):
                out.iat[row] = [list(b) for b in s]
        return out

    return power


def moving_average(mat: np.ndarray, span: int) -> np.ndarray:
    """Centred row means with truncated edges; an even span acts as span - 1."""
    half, n = (span - 1) // 2, mat.shape[1]
    if half < 1 or n == 0:
        return mat.copy()
    run = np.concatenate([np.zeros((len(mat), 1)), np.cumsum(mat, axis=1)], axis=1)
    lo = np.maximum(np.arange(n) - half, 0)
    hi = np.minimum(np.arange(n) + half + 1, n)
    return (run[:, hi] - run[:, lo]) / (hi - lo)


class _Ranges:
    """Sparse tables of range minima and maxima over the rows of a matrix."""

    def __init__(self, y: np.ndarray, length: np.ndarray):
        self.y, self.length = y, length
        self.low, self.high = [y], [y]
        for step in (1 << i for i in range(int(y.shape[1]).bit_length() - 1)):
            self.low.append(np.minimum(self.low[-1][:, :-step], self.low[-1][:, step:]))
            self.high.append(np.maximum(self.high[-1][:, :-step], self.high[-1][:, step:]))

    def least(self, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of first..last, both included."""
        out = np.empty(len(row))
        level = np.frexp(last - first + 1)[1] - 1
        for l in np.unique(level):
            at = level == l
            table, r = self.low[l], row[at]
            out[at] = np.minimum(table[r, first[at]], table[r, last[at] - (1 << l) + 1])
        return out

    def walk(self, row: np.ndarray, start: np.ndarray, value: np.ndarray, left: bool, over: bool) -> np.ndarray:
        """Nearest position beside ``start`` with a sample > value (``over``) or <= value; -1 or the row's length if none.

        Blocks without such a sample are skipped, the largest first.
        """
        at = start.copy() if left else start + 1
        tables, end = self.high if over else self.low, self.length[row]
        for l in range(len(tables) - 1, -1, -1):
            step, table = 1 << l, tables[l]
            begin = at - step if left else at
            inside = begin >= 0 if left else begin + step <= end
            seen = table[row, np.clip(begin, 0, table.shape[1] - 1)]
            skip = inside & (seen <= value if over else seen > value)
            at = np.where(skip, at - step if left else at + step, at)
        return at - 1 if left else at


ROOM = 4_000_000  # cells of the sparse tables held at once


def peaks(mat: np.ndarray, min_prominence, min_width: float | None = 1.0, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, half-prominence width) of the local maxima of all rows, in order; flat tops count once, at their middle.

    ``min_prominence`` is a number or one per row; a row ends after ``length`` samples. Walls (nearest higher samples), bases and
    width ends come from range tables, so there is no loop over rows or peaks.
    """
    count, n = mat.shape
    length = np.full(count, n) if length is None else np.minimum(length, n)
    floor = np.broadcast_to(np.asarray(min_prominence, float), (count,))
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    rows = max(1, ROOM // max(1, n * 2 * n.bit_length()))
    for lo in range(0, count if n >= 3 else 0, rows):
        y, size = mat[lo : lo + rows], length[lo : lo + rows]
        # runs of equal values: a peak is a run that rises before and falls after
        first = np.flatnonzero(np.concatenate([np.ones((len(y), 1), bool), y[:, 1:] != y[:, :-1]], axis=1))
        row, col = first // n, first % n
        last = np.minimum(np.append(first[1:], y.size) - row * n - 1, size[row] - 1)
        use = (col > 0) & (last >= col) & (last < size[row] - 1)
        row, col, last = row[use], col[use], last[use]
        use = (y[row, col] > y[row, col - 1]) & (y[row, last] > y[row, last + 1])
        row, at = row[use], (col[use] + last[use]) // 2
        if not len(row):
            continue
        tables = _Ranges(y, size)
        top = y[row, at]
        left, right = tables.walk(row, at, top, True, True), tables.walk(row, at, top, False, True)
        prominence = top - np.maximum(tables.least(row, left + 1, at), tables.least(row, at, right - 1))
        use = prominence >= floor[lo + row]
        row, at, top, prominence = row[use], at[use], top[use], prominence[use]
        height = top - prominence / 2
        ends = []
        for side in (True, False):  # the nearest sample at or under the height lies within the base
            end = tables.walk(row, at, height, side, False)
            level, inner = y[row, end], y[row, end + (1 if side else -1)]
            part = np.divide(height - level, inner - level, out=np.zeros(len(end)), where=level < height)
            ends.append(end + part if side else end - part)
        width = ends[1] - ends[0]
        use = np.ones(len(width), bool) if min_width is None else width >= min_width
        found.append((lo + row[use], at[use], width[use]))
    return tuple(np.concatenate(x) for x in zip(*found))


def first_per_row(row: np.ndarray, value: np.ndarray, count: int, *order: np.ndarray) -> np.ndarray:
    """Per row 0..count-1 the ``value`` that is first by ``order`` (least significant key first); -1 for rows without any."""
    out = np.full(count, -1)
    by = np.lexsort((*order, row))
    lead = np.flatnonzero(np.diff(row[by], prepend=-1))
    out[row[by][lead]] = value[by][lead]
    return out


def strongest(mat: np.ndarray, min_prominence: float, length: np.ndarray | None = None) -> np.ndarray:
    """Per row the position of the peak with the largest height x width (first on ties), -1 without a peak."""
    row, at, width = peaks(mat, min_prominence, 1.0, length)
    return first_per_row(row, at, len(mat), at, -(mat[row, at] * width))


def fit_rows(y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, model, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounded nonlinear least squares for all rows at once: parameters, squared error, converged.

    ``model(p)`` gives values (rows x samples) and derivatives (rows x samples x parameters). Damped steps within the
    bounds; a parameter at a bound that the gradient pushes outward is held. A row is converged, and
    leaves the batch, when its projected gradient or its step is negligible, or three steps in a row have each taken less than
    1e-9 of its error; rows that need more than ``rounds`` steps are not.
    """
    p, n_par = np.clip(start, low, high), start.shape[1]
    err = ((y - model(p)[0]) ** 2).sum(axis=1)
    scale = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1) + 1e-30
    damp, done, live, slow = np.full(len(y), 1e-2), np.zeros(len(y), bool), np.arange(len(y)), np.zeros(len(y), int)
    for _ in range(rounds):
        if not len(live):
            break
        q = p[live]
        value, jac = model(q)
        turned = np.ascontiguousarray(jac.transpose(0, 2, 1))
        slope = (turned @ (y[live] - value)[:, :, None])[:, :, 0]
        held = ((q <= low) & (slope < 0)) | ((q >= high) & (slope > 0))
        slope = np.where(held, 0.0, slope)
        square = turned @ jac
        square *= ~held[:, :, None] & ~held[:, None, :]
        diag = np.einsum("npp->np", square)
        lift = damp[live][:, None] * diag + np.where(diag > 0, 1e-14 * diag, 1.0)
        step = np.linalg.solve(square + lift[:, :, None] * np.eye(n_par), slope[:, :, None])[:, :, 0]
        trial = np.clip(q + step, low, high)
        new = ((y[live] - model(trial)[0]) ** 2).sum(axis=1)
        good = np.isfinite(new) & (new <= err[live])
        size = np.abs(q) + 1e-3
        flat = (np.abs(slope) * size).max(axis=1) <= 1e-12 * scale[live]
        still = (np.abs(trial - q) / size).max(axis=1) <= 1e-9
        little = good & (err[live] - new <= 1e-9 * err[live])
        slow[live] = np.where(little, slow[live] + 1, np.where(good, 0, slow[live]))
        p[live] = np.where(good[:, None], trial, q)
        err[live] = np.where(good, new, err[live])
        damp[live] = np.clip(np.where(good, damp[live] / 5, damp[live] * 4), 1e-14, 1e12)
        ended = flat | still | (slow[live] >= 3)
        done[live] = ended
        live = live[~ended]
    return p, err, done


# Bounds and start of the scaled five-parameter curve (Fm, Fb, Sc, Cs, As).
LOW_5PL, HIGH_5PL, START_5PL = np.array([-0.5, -0.5, 0.01, -0.5, 0.1]), np.array([2.0, 1.5, 500.0, 1.5, 10.0]), np.array([1.0, 0.0, 10.0, 0.5, 1.0])


def _curve(x: np.ndarray, log_scale: bool):
    """Values and derivatives of Fm / (1 + exp(-Sc (x - Cs)))^As + Fb; with ``log_scale`` Sc and As are given as logarithms."""
    def model(q):
        sc, asym = (np.exp(q[:, 2:3]), np.exp(q[:, 4:5])) if log_scale else (q[:, 2:3], q[:, 4:5])
        e = np.exp(np.clip(-sc * (x - q[:, 3:4]), -60, 60))
        base = (1 + e) ** -asym
        slope = q[:, 0:1] * asym * base * e / (1 + e)
        d_sc, d_as = slope * (x - q[:, 3:4]), -q[:, 0:1] * base * np.log1p(e)
        if log_scale:
            d_sc, d_as = d_sc * sc, d_as * asym
        return q[:, 0:1] * base + q[:, 1:2], np.stack([base, np.ones_like(base), d_sc, -slope * sc, d_as], axis=2)

    return model


def _best_start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Start with the least error over a grid of (Sc, Cs, As), height and base solved exactly for each."""
    best, out = np.full(len(y), np.inf), np.tile(START_5PL, (len(y), 1))
    middle = y - y.mean(axis=1, keepdims=True)
    for sc in (2.0, 6.0, 20.0, 80.0):
        for cs in np.linspace(0.0, 1.0, 9):
            for asym in (0.3, 1.0, 4.0):
                base = (1 + np.exp(np.clip(-sc * (x - cs), -60, 60))) ** -asym
                rise = base - base.mean()
                fm = middle @ rise / max(rise @ rise, 1e-12)
                fb = y.mean(axis=1) - fm * base.mean()
                err = ((middle - fm[:, None] * rise) ** 2).sum(axis=1)
                use = err < best
                best[use] = err[use]
                out[use] = np.column_stack([fm, fb, np.full(len(y), sc), np.full(len(y), cs), np.full(len(y), asym)])[use]
    return out


def fit_5pl(mat: np.ndarray, rounds: int = 400, first: int = 40) -> np.ndarray:
    """Bounded least squares of Fm / (1 + exp(-Sc (x - Cs)))^As + Fb, all rows together.

    Rows and the axis are scaled to [0, 1]; parameters return on the original scale (axis in
    samples): columns Fm, Fb, Sc, Cs, As, r2, converged (0 or 1). Rows that do not converge from the fixed start within ``first`` steps
    are fitted again by a second solver, which the narrow valleys of nearly straight curves need: best of a grid of starts, slope and asymmetry on a log scale; the smaller error stays.
    """
    n, width = mat.shape
    x = np.linspace(0.0, 1.0, width)
    low, high = mat.min(axis=1, keepdims=True), mat.max(axis=1, keepdims=True)
    span = np.where(high > low, high - low, 1.0)
    y = (mat - low) / span
    p, err, done = fit_rows(y, np.tile(START_5PL, (n, 1)), LOW_5PL, HIGH_5PL, _curve(x, False), min(first, rounds))
    again = np.flatnonzero(~done)
    if len(again):
        logs = [2, 4]
        lo, hi, start = LOW_5PL.copy(), HIGH_5PL.copy(), np.clip(_best_start(x, y[again]), LOW_5PL, HIGH_5PL)
        lo[logs], hi[logs], start[:, logs] = np.log(lo[logs]), np.log(hi[logs]), np.log(start[:, logs])
        q, err2, done2 = fit_rows(y[again], start, lo, hi, _curve(x, True), 2 * rounds)
        q[:, logs] = np.exp(q[:, logs])
        use = done2 & (err2 <= err[again] * (1 + 1e-6) + 1e-12) | (err2 < err[again])
        at = again[use]
        p[at], err[at], done[at] = q[use], err2[use], done2[use]
    total = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    r2 = 1 - err / (total + 1e-10)
    last = max(width - 1, 1)
    return np.column_stack([p[:, 0] * span[:, 0], p[:, 1] * span[:, 0] + low[:, 0], p[:, 2] / last, p[:, 3] * last, p[:, 4], r2, done])


def derivative(mat: np.ndarray, step: float, order: int = 1, method: str = "gradient", window: int = 11, poly: int = 2) -> np.ndarray:
    """First or second derivative of evenly sampled rows, as wide as the rows.

    ``gradient``: central differences, one-sided at the ends; ``savgol``: derivative of a local polynomial, the ends by the end windows' own fits
    (NaN where a row is shorter than ``window``); ``diff``: forward differences, the last value repeated.
    """
    n = mat.shape[1]
    if method == "gradient":
        for _ in range(order):
            mat = np.gradient(mat, step, axis=1) if n > 1 else np.full_like(mat, np.nan)
        return mat
    if method == "diff":
        out = np.diff(mat, n=order, axis=1) / step**order
        return np.pad(out, ((0, 0), (0, order)), mode="edge") if out.shape[1] else np.full_like(mat, np.nan)
    if method != "savgol":
        raise ValueError(f"unknown method {method!r}")
    from wellspring.operators.series import savgol_rows

    if n < window:
        return np.full_like(mat, np.nan)
    weights = savgol_rows(window, poly, order)
    begin = np.clip(np.arange(n) - window // 2, 0, n - window)
    return np.stack([mat[:, b : b + window] @ weights[i - b] for i, b in enumerate(begin)], axis=1) / step**order


RAW_FEATURES = (
    "xms", "max_slope", "xs", "xe", "xp1", "xp2", "threshold_distance", "first_half", "second_half", "distance_asymmetry", "peak_shift",
    "area1", "area2", "area_asymmetry", "peak_asymmetry", "y_xms", "y_xs", "y_xe", "y_xp1", "y_xp2", "dy_xp1", "dy_xp2", "end_slope", "end_slope_abs", "neg_log_f0",
)


def raw_features(y: np.ndarray, step: float, threshold: float = 0.1, method: str = "gradient") -> np.ndarray:
    """RAW_FEATURES of sampled curves, one row each, NaN where a feature does not exist.

    Slope peak, the outermost crossings of a share of it, the largest hump and the deepest dip of the second derivative,
    their distances and asymmetries, areas under the slope on both sides of its peak, levels at these points and the final slope.
    """
    count, n = y.shape
    if n < 2:
        return np.full((count, len(RAW_FEATURES)), np.nan)
    each, t = np.arange(count), np.arange(n) * step
    d1, d2 = derivative(y, step, 1, method), derivative(y, step, 2, method)
    divide = lambda a, b: np.divide(a, b, out=np.full(count, np.nan), where=(b != 0) & ~np.isnan(b))
    top_at = np.argmax(d1, axis=1)
    top, xms = d1[each, top_at], t[top_at]
    level = threshold * top if threshold < 1 else np.full(count, threshold)
    over = d1 > level[:, None]
    some = over.any(axis=1)

    def crossing(i, other):
        """Interpolated from sample ``i`` (over the level) towards ``other`` (not over it)."""
        inside = (other >= 0) & (other < n)
        o = np.clip(other, 0, n - 1)
        a, b = d1[each, o], d1[each, i]
        flat = ~inside | (a == b)
        at = np.where(flat, t[i], t[o] + (level - a) * (t[i] - t[o]) / np.where(flat, 1.0, b - a))
        return np.where(some, at, np.nan)

    first, last = np.argmax(over, axis=1), n - 1 - np.argmax(over[:, ::-1], axis=1)
    xs, xe = crossing(first, first - 1), crossing(last, last + 1)

    def hump(sign):
        row, at, _ = peaks(sign * d2, -np.inf, None)
        return first_per_row(row, at, count, at, -(sign * d2)[row, at])

    p1, p2 = hump(1.0), hump(-1.0)
    at = lambda values, i: np.where(i >= 0, values[each, i], np.nan)
    near = lambda v: np.where(np.isnan(v), -1, np.argmin(np.abs(t - np.nan_to_num(v)[:, None]), axis=1))
    xp1, xp2 = np.where(p1 >= 0, t[p1], np.nan), np.where(p2 >= 0, t[p2], np.nan)
    run = np.concatenate([np.zeros((count, 1)), np.cumsum((d1[:, 1:] + d1[:, :-1]) / 2 * step, axis=1)], axis=1)
    i_s, i_e = near(xs), near(xe)
    area1 = np.where(i_s >= 0, run[each, np.maximum(top_at, i_s)] - run[each, i_s], np.nan)
    area2 = np.where(i_e >= 0, run[each, np.maximum(top_at, i_e)] - run[each, top_at], np.nan)
    h1, h2 = at(d2, p1), np.abs(at(d2, p2))
    tail = d1[:, -5:]
    start = y[:, 0]
    out = [
        xms, top, xs, xe, xp1, xp2, xe - xs, xms - xs, xe - xms, divide(xe - xms, xms - xs), xp2 - xp1,
        area1, area2, divide(area2, area1), divide(h1, h2), y[each, top_at], at(y, i_s), at(y, i_e), at(y, p1), at(y, p2), at(d1, p1), at(d1, p2),
        tail.mean(axis=1), np.abs(tail).mean(axis=1), np.where(start > 0, -np.log10(np.where(start > 0, start, 1.0)), np.nan),
    ]
    return np.where(np.isnan(d1).any(axis=1)[:, None], np.nan, np.column_stack(out))


FITTED_FEATURES = (
    "xms", "max_slope", "xs", "xe", "xp1", "xp2", "threshold_distance", "first_half", "second_half", "distance_asymmetry", "peak_shift",
    "area1", "area2", "area_asymmetry", "peak_asymmetry", "ct", "cy0", "neg_log_f0",
)


def fitted_features(given: np.ndarray, n: int, step: float, threshold: float = 0.1) -> np.ndarray:
    """FITTED_FEATURES of the curves with parameters (Fm, Fb, Sc, Cs, As), one row each, sampled at n points; NaN where a feature does not exist.

    Slope peak, threshold crossings, curvature peaks, distances, areas, asymmetries, 20 % time, tangent intercept, -log10 of the
    start. Samples are rounded to 12 digits, so equal samples tie. Areas without both ends are 0.
    """
    count = len(given)
    if not count:
        return np.empty((0, len(FITTED_FEATURES)))
    each, t = np.arange(count), np.arange(n) * step
    fm, fb, sc, cs, asym = given.T
    over = lambda a, b: (a > b) | (np.isnan(a) & ~np.isnan(b))  # noqa: E731  NaN is above all numbers, as in Spark

    def divide(a, b):
        return np.divide(a, b, out=np.full(count, np.nan), where=(b != 0) & ~np.isnan(b))

    def value(x, fm, fb, sc, cs, asym):
        return fm / (1.0 + np.exp(-sc * (x - cs))) ** asym + fb

    def slope(x, fm, sc, cs, asym):
        e = np.exp(-sc * (x - cs))
        return fm * asym * sc * e / (1.0 + e) ** (asym + 1.0)

    def lerp(arr, i, level, there):
        """Time at which ``arr`` passes ``level`` after sample ``i``."""
        i = np.clip(i, 0, n - 2)
        a, b = arr[each, i], arr[each, i + 1]
        flat = (a == b) | (np.isnan(a) & np.isnan(b))
        return np.where(there, t[i] + np.where(flat, step, (level - a) * step / np.where(flat, 1.0, b - a)), np.nan)

    with np.errstate(all="ignore"):
        p1, p2, p3, p4, p5 = (c[:, None] for c in (fm, fb, sc, cs, asym))
        e = np.exp(-p3 * (t - p4))
        f = np.round(value(t, p1, p2, p3, p4, p5), 12)
        d = np.round(slope(t, p1, p3, p4, p5), 12)
        c = np.round(p1 * p5 * p3 * p3 * e * (p5 * e - 1.0) / (1.0 + e) ** (p5 + 2.0), 12)
        peak = np.argmax(d, axis=1)
        top, xms = d[each, peak], t[peak]
        level = threshold * top
        above = over(d, level[:, None])
        some = above.any(axis=1)
        up, down = np.argmax(above, axis=1), n - 1 - np.argmax(above[:, ::-1], axis=1)
        xs = np.where(some & (up == 0), 0.0, lerp(d, up - 1, level, some))
        xe = np.where(some & (down == n - 1), t[n - 1], lerp(d, down, level, some))
        low = 0.2 * f.max(axis=1)
        above = over(f, low[:, None])
        some, up = above.any(axis=1), np.argmax(above, axis=1)
        ct = np.where(some & (up == 0), 0.0, lerp(f, up - 1, low, some))

        def hump(s):
            """Time and height of the highest inner peak of ``s`` times the curvature; the first of equal ones."""
            if n < 3:
                return np.full(count, np.nan), np.full(count, np.nan)
            m = s[:, 1:-1]
            there = over(m, s[:, :-2]) & over(m, s[:, 2:])
            i = np.argmax(np.where(there, m, -np.inf), axis=1)
            some = there.any(axis=1)
            return np.where(some, t[i + 1], np.nan), np.where(some, m[each, i], np.nan)

        (xp1, h1), (xp2, h2) = hump(c), hump(-c)
        run = np.concatenate([np.zeros((count, 1)), np.cumsum((d[:, 1:] + d[:, :-1]) / 2.0 * step, axis=1)], axis=1)
        near = lambda v: np.where(np.isnan(v), n, np.floor(np.nan_to_num(v) / step + 0.5 - 1e-9)).astype(int)
        first, last = near(xs), near(xe)

        def area(a, b):
            there = (b > a) & (a < n) & (b < n)
            return np.where(there, run[each, np.minimum(b, n - 1)] - run[each, np.minimum(a, n - 1)], 0.0)

        a1, a2 = area(first, peak), area(peak, last)
        xi = cs + np.log(asym) / sc
        cy0 = xi - value(xi, fm, fb, sc, cs, asym) / slope(xi, fm, sc, cs, asym)
        out = [
            xms, top, xs, xe, xp1, xp2, xe - xs, xms - xs, xe - xms, divide(xe - xms, xms - xs), xp2 - xp1,
            a1, a2, divide(a2, a1), divide(h1, h2), ct, cy0, np.where(f[:, 0] > 0, -np.log10(np.where(f[:, 0] > 0, f[:, 0], 1.0)), np.nan),
        ]
        res = np.column_stack(out)
    missing = np.isnan(given[:, [0, 2, 3, 4]]).any(axis=1)  # without Fb the slope still has its features
    res[missing] = np.where(np.isin(FITTED_FEATURES, ("area1", "area2")), 0.0, np.nan)
    return res
