"""Column builders on array-valued traces; each stays one JVM expression per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLES_PER_MIN = 15.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    A column used inside a lambda is otherwise inlined there and computed again per element.
    """
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def mean(x) -> Column:
    x = _c(x)
    return F.try_divide(total(x), F.size(x))


def std(x, ddof: int = 0) -> Column:
    """Two-pass standard deviation of an array."""

    def spread(arr):
        dev = let(mean(arr), lambda m: F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)))
        return F.sqrt(F.try_divide(dev, F.size(arr) - F.lit(ddof)))

    return let(x, spread)


def dyn_range(x) -> Column:
    return F.array_max(_c(x)) - F.array_min(_c(x))


def net_slope(x) -> Column:
    return F.element_at(_c(x), -1) - F.get(_c(x), F.lit(0))


def argmax(x) -> Column:
    """0-based first position of the maximum."""
    return (F.array_position(_c(x), F.array_max(_c(x))) - 1).cast("int")


def argmin(x) -> Column:
    return (F.array_position(_c(x), F.array_min(_c(x))) - 1).cast("int")


def first_where(x, pred) -> Column:
    """0-based first position where ``pred(v)`` holds, NULL when it never does."""
    pos = F.array_position(F.transform(_c(x), pred), F.lit(True))
    return F.when(pos > 0, (pos - 1).cast("int"))


def diff(x) -> Column:
    x = _c(x)
    n = F.size(x)
    return F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)


def gradient(x) -> Column:
    """Central differences with unit spacing, one-sided at the ends."""

    def slope(arr):
        last = F.size(arr) - 1
        return F.transform(
            arr,
            lambda v, i: F.when(i == 0, F.get(arr, F.lit(1)) - v)
            .when(i == last, v - F.get(arr, i - 1))
            .otherwise((F.get(arr, i + 1) - F.get(arr, i - 1)) / 2.0),
        )

    return let(x, slope)


def moving_average(x, span: int) -> Column:
    """Centred mean with truncated edges; an even span acts as span - 1."""
    half = (span - 1) // 2

    def smooth(arr):
        def around(v, i):
            lo = F.greatest(i - half, F.lit(0))
            hi = F.least(i + half, F.size(arr) - 1)
            return mean(F.slice(arr, lo + 1, hi - lo + 1))

        return F.transform(arr, around)

    return let(x, smooth)


def dot(x, weights) -> Column:
    return F.aggregate(F.zip_with(_c(x), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def windows(x, window: int, stride: int) -> Column:
    """Array of sliding windows; ``(T - window) // stride + 1`` of them."""
    def cut(arr):
        count = F.floor((F.size(arr) - window) / stride).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(arr, i * stride + 1, window))

    return let(x, cut)


def centre_min(i, window: int, stride: int) -> Column:
    """Window centre in minutes."""
    return (_c(i) * stride + F.lit((window - 1) / 2.0)) / F.lit(SAMPLES_PER_MIN)


def pad_or_cut(x, width) -> Column:
    """Cut to ``width`` samples or fill with zeros on the right."""
    x = _c(x)
    w = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(w - F.size(x), F.lit(0))
    return F.concat(F.slice(x, F.lit(1), w), F.array_repeat(F.lit(0.0), missing))


def roll(x, shift: int) -> Column:
    """Circular shift to the right by ``shift`` samples."""
    x = _c(x)
    n = F.size(x)
    k = F.pmod(F.lit(shift), n)
    return F.when(k == 0, x).otherwise(F.concat(F.slice(x, n - k + 1, k), F.slice(x, F.lit(1), n - k)))


def l2(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def k_run_start(x, hit, k: int) -> Column:
    """0-based start of the first ``k`` consecutive hits, NULL when there is none."""
    done = F.aggregate(
        _c(x),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("i"), F.lit(-1).alias("at")),
        lambda s, v: F.struct(
            F.when(hit(v), s["run"] + 1).otherwise(0).alias("run"),
            (s["i"] + 1).alias("i"),
            F.when((s["at"] < 0) & hit(v) & (s["run"] + 1 == k), s["i"] - (k - 1)).otherwise(s["at"]).alias("at"),
        ),
        lambda s: s["at"],
    )
    return F.when(done >= 0, done)


def savgol(x, window: int, poly: int) -> Column:
    """Polynomial smoothing of an array; ends use the end windows' own fits. NULL when too short."""
    from wellspring.operators.series import savgol_rows

    rows = savgol_rows(window, poly)
    table = F.array(*[F.array(*[F.lit(float(c)) for c in r]) for r in rows])
    h = window // 2

    def smooth(arr):
        n = F.size(arr)

        def at(v, i):
            begin = F.least(F.greatest(i - h, F.lit(0)), n - window)
            return dot(F.slice(arr, begin + 1, window), F.get(table, i - begin))

        return F.when(n >= window, F.transform(arr, at))

    return let(x, smooth)

