"""Queries for moving averages, derivatives, features, windows and normalisation."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.functions import kernels as kn
from wellspring.operators import series as sr
from wellspring.operators.metrics import correlation
from wellspring.operators.ranking import attach, quantiles
from wellspring.plans import query
from wellspring.plans.bindings import (
    SERIES, TRACES, TRACES_LONG, long, predictions, PREDICTIONS, q6, r6, series, traces,
)

K = ["sid"]


def _ma(src, name, col, h, out, part="sid"):
    return f""", {name} AS (SELECT *, avg({col}) OVER (PARTITION BY {part} ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS {out} FROM {src})"""


@query("w01_centred_mean", f"WITH {SERIES}{_ma('series', 'm', 'v', 4, 'ma')} SELECT sid, t, {q6('ma')} AS ma FROM m")
def w01(spark, root):
    return sr.centred_mean(series(spark, root), K, 10).select("sid", "t", r6("ma").alias("ma"))


@query("w01_centred_mean_array", f"WITH {TRACES_LONG}{_ma('tl', 'm', 'v', 4, 'ma', 'pixel_id')} SELECT pixel_id, t, {q6('ma')} AS ma FROM m")
def w01_array(spark, root):
    t = traces(spark, root).withColumn("x", ar.moving_average("x", 10))
    return long(t, "pixel_id", v="ma").select("pixel_id", "t", r6("ma").alias("ma"))


@query("w02_edge_padded_mean", f"""WITH {SERIES}, n AS (SELECT sid, max(t) AS last, arg_min(v, t) AS a, arg_max(v, t) AS z FROM series GROUP BY 1),
p AS (SELECT sid, t, v FROM series UNION ALL SELECT sid, -k, a FROM n, (SELECT unnest([1,2,3,4]) AS k) UNION ALL SELECT sid, last + k, z FROM n, (SELECT unnest([1,2,3,4]) AS k)){_ma('p', 'm', 'v', 4, 'ma')}
SELECT m.sid, m.t, {q6('ma')} AS ma FROM m JOIN n ON m.sid = n.sid WHERE m.t BETWEEN 0 AND n.last""")
def w02(spark, root):
    return sr.padded_mean(series(spark, root), K, 9).select("sid", "t", r6("ma").alias("ma"))


@query("w03_first_difference", f"""WITH {SERIES}, d AS (SELECT sid, t, lead(v) OVER (PARTITION BY sid ORDER BY t) - v AS d FROM series)
SELECT sid, t, {q6('d')} AS d FROM d WHERE d IS NOT NULL""")
def w03(spark, root):
    return sr.first_difference(series(spark, root), K).select("sid", "t", r6("d").alias("d"))


def _uneven(src, name, v, x, out):
    return f""", {name}a AS (SELECT *, {x} - lag({x}) OVER w AS hl, lead({x}) OVER w - {x} AS hr, {v} - lag({v}) OVER w AS dn, lead({v}) OVER w - {v} AS up
  FROM {src} WINDOW w AS (PARTITION BY sid ORDER BY t)),
{name} AS (SELECT * EXCLUDE (hl, hr, dn, up), coalesce((hl * hl * up + hr * hr * dn) / (hl * hr * (hl + hr)), up / hr, dn / hl) AS {out} FROM {name}a)"""


@query("w04_uneven_gradients", f"""WITH {SERIES}, sx AS (SELECT *, CAST(t AS DOUBLE) + (t % 3) * CAST(0.25 AS DOUBLE) AS tm FROM series){_uneven('sx', 'g1', 'v', 'tm', 'd1')}{_uneven('g1', 'g2', 'd1', 'tm', 'd2')}
SELECT sid, t, {q6('d1', 5)} AS d1, {q6('d2', 5)} AS d2 FROM g2""")
def w04(spark, root):
    s = series(spark, root).withColumn("tm", F.col("t").cast("double") + (F.col("t") % 3) * 0.25)
    return sr.gradients(s, K, "v", "tm").select("sid", "t", r6("d1", 5).alias("d1"), r6("d2", 5).alias("d2"))


def _savgol_sql(window, poly, src="series", key="sid", deriv=0, tag=""):
    """CTEs ending in ``<tag>sg`` (key, t, sg): local polynomial value or derivative per sample."""
    rows = sr.savgol_rows(window, poly, deriv)
    vals = ", ".join(f"({i}, {j}, CAST({float(rows[i, j])!r} AS DOUBLE))" for i in range(window) for j in range(window))
    h = window // 2
    return f""", {tag}wt(i, j, c) AS (VALUES {vals}),
{tag}ln AS (SELECT {key}, CAST(count(*) AS INTEGER) AS len FROM {src} z GROUP BY 1),
{tag}bg AS (SELECT s.{key}, s.t, least(greatest(s.t - {h}, 0), len - {window}) AS b FROM {src} s JOIN {tag}ln USING ({key}) WHERE len >= {window}),
{tag}sg AS (SELECT bg.{key}, bg.t, sum(y.v * wt.c) AS sg FROM {tag}bg bg JOIN {tag}wt wt ON wt.i = bg.t - bg.b JOIN {src} y ON y.{key} = bg.{key} AND y.t = bg.b + wt.j GROUP BY 1, 2)"""


@query("w05_savgol", f"WITH {SERIES}{_savgol_sql(9, 3)} SELECT sid, t, {q6('sg', 5)} AS sg FROM sg")
def w05(spark, root):
    g = sr.savgol(series(spark, root), K, 9, 3).filter("sg IS NOT NULL")
    return g.select("sid", "t", r6("sg", 5).alias("sg"))


TRAIL = "PARTITION BY sid ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW"


@query("w06_trailing_stats", f"""WITH {SERIES} SELECT sid, t, {q6(f'avg(v) OVER ({TRAIL})', 7)} AS roll_mean, {q6(f'stddev_pop(v) OVER ({TRAIL})', 7)} AS roll_std FROM series""")
def w06(spark, root):
    return sr.trailing_stats(series(spark, root), K, 50).select("sid", "t", r6("roll_mean", 7).alias("roll_mean"), r6("roll_std", 7).alias("roll_std"))


FEATS = ("d1", "d2", "roll_mean", "roll_std", "elapsed", "rise", "z", "slope")


@query("w07_feature_table", f"""WITH {SERIES}{_uneven('series', 'g1', 'v', 't', 'd1')}{_uneven('g1', 'g2', 'd1', 't', 'd2')},
b AS (SELECT sid, count(*) AS len, avg(v) FILTER (t < 30) AS bm, stddev_pop(v) FILTER (t < 30) AS bs, arg_min(v, t) AS v0 FROM series GROUP BY 1)
SELECT g2.sid, t, {q6('v', 5)} AS v, {q6('d1', 5)} AS d1, {q6('d2', 5)} AS d2, {q6('avg(v) OVER w', 7)} AS roll_mean, {q6('stddev_pop(v) OVER w', 5)} AS roll_std,
{q6('t / CAST(len - 1 AS DOUBLE)', 5)} AS elapsed, {q6('v - bm', 5)} AS rise, {q6('(v - bm) / (bs + CAST(1e-8 AS DOUBLE))', 5)} AS z, {q6('(v - coalesce(lag(v, 49) OVER (PARTITION BY g2.sid ORDER BY t), v0)) / CAST(50 AS DOUBLE)', 5)} AS slope
FROM g2 JOIN b ON g2.sid = b.sid WINDOW w AS (PARTITION BY g2.sid ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def w07(spark, root):
    f = sr.feature_table(series(spark, root), K)
    return f.select("sid", "t", r6("v", 5).alias("v"), *[r6(c, 7 if c == 'roll_mean' else 5).alias(c) for c in FEATS])


@query("w08_scaled_derivative", f"""WITH {SERIES}{_ma('series', 'a', 'v', 4, 's')}, b AS (SELECT sid, t, lead(s) OVER (PARTITION BY sid ORDER BY t) - s AS d FROM a), b2 AS (SELECT * FROM b WHERE d IS NOT NULL){_ma('b2', 'c', 'd', 4, 'dd')}
SELECT sid, t, {q6('dd * 250', 5)} AS deriv FROM c""")
def w08(spark, root):
    return sr.scaled_derivative(series(spark, root), K, 10, 4.0).select("sid", "t", r6("deriv", 5).alias("deriv"))


@query("w09_spectrogram", f"""WITH {TRACES}, fr AS (SELECT pixel_id, frame, n, x[frame * 11 + n + 1] AS v FROM traces, range(4) f(frame), range(22) s(n) WHERE len(x) >= frame * 11 + 22),
c AS (SELECT pixel_id, frame, n, v - avg(v) OVER (PARTITION BY pixel_id, frame) AS v, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 22) AS w FROM fr),
p AS (SELECT pixel_id, bin, frame, (power(sum(v * w * cos(2 * pi() * bin * n / 22)), 2) + power(sum(v * w * sin(2 * pi() * bin * n / 22)), 2)) / sum(w * w) AS p FROM c, range(10) b(bin) GROUP BY 1, 2, 3)
SELECT pixel_id, CAST(bin AS INTEGER) AS bin, CAST(frame AS INTEGER) AS frame, {q6('p * CASE WHEN bin > 0 THEN 2 ELSE 1 END', 8)} AS power FROM p""")
def w09(spark, root):
    """Power per (pixel, frequency bin, frame)."""
    p = traces(spark, root).select("pixel_id", kn.spectrogram(22, 11, 10)("x").alias("s"))
    bins = p.select("pixel_id", F.posexplode("s").alias("bin", "frames"))
    return bins.select("pixel_id", "bin", F.posexplode("frames").alias("frame", "power")).withColumn("power", r6("power", 8))


@query("w10_sliding_windows", f"""WITH {TRACES}, w AS (SELECT pixel_id, x, unnest(range(0, (len(x) - 12) // 4 + 1)) AS i FROM traces)
SELECT pixel_id, CAST(i AS INTEGER) AS win, {q6('list_sum(x[i * 4 + 1 : i * 4 + 12])')} AS total, {q6('x[i * 4 + 1]')} AS first_v, {q6('x[i * 4 + 12]')} AS last_v FROM w""")
def w10(spark, root):
    w = traces(spark, root).select("pixel_id", F.posexplode(ar.windows("x", 12, 4)).alias("win", "w"))
    return w.select("pixel_id", "win", r6(ar.total("w")).alias("total"), r6(F.get("w", F.lit(0))).alias("first_v"), r6(F.element_at("w", -1)).alias("last_v"))


@query("w11_window_centres", f"""WITH {TRACES}, w AS (SELECT pixel_id, unnest(range(0, (len(x) - 12) // 4 + 1)) AS i FROM traces)
SELECT pixel_id, CAST(i AS INTEGER) AS win, {q6('(i * 4 + 5.5) / 15.0')} AS centre FROM w""")
def w11(spark, root):
    w = traces(spark, root).select("pixel_id", F.posexplode(ar.windows("x", 12, 4)).alias("win", "w"))
    return w.select("pixel_id", "win", r6(ar.centre_min("win", 12, 4)).alias("centre"))


def zscore(x):
    """Standard score of each sample; sigma gets 1e-6 added."""
    return ar.let(x, lambda arr: ar.let(
        F.struct(ar.mean(arr).alias("m"), (ar.std(arr) + F.lit(1e-6)).alias("s")),
        lambda st: F.transform(arr, lambda v: (v - st["m"]) / st["s"]),
    ))


@query("w12_shape_zscore", f"""WITH {TRACES_LONG}{_ma('tl', 'm', 'v', 2, 's', 'pixel_id')}, g AS (SELECT pixel_id, avg(s) AS mu, stddev_pop(s) AS sd FROM m GROUP BY 1)
SELECT m.pixel_id, t, {q6('(s - mu) / (sd + CAST(0.000001 AS DOUBLE))', 5)} AS z FROM m JOIN g ON m.pixel_id = g.pixel_id""")
def w12(spark, root):
    t = traces(spark, root).select("pixel_id", zscore(ar.moving_average("x", 5)).alias("x"))
    return long(t, "pixel_id", v="z").select("pixel_id", "t", r6("z", 5).alias("z"))


def amplitude_scaled(x, baseline: int):
    """Subtract the mean of the first samples and divide by the largest absolute value (1 if tiny)."""
    def scale(arr):
        centred = ar.let(ar.mean(F.slice(arr, 1, baseline)), lambda b: F.transform(arr, lambda v: v - b))
        return ar.let(centred, lambda c: ar.let(
            F.array_max(F.transform(c, lambda v: F.abs(v))),
            lambda top: F.transform(c, lambda v: v / F.when(top < 1e-6, 1.0).otherwise(top)),
        ))

    return ar.let(x, scale)


@query("w12_amplitude_scale", f"""WITH {TRACES_LONG}, b AS (SELECT pixel_id, avg(v) AS bm FROM tl WHERE t < 10 GROUP BY 1),
m AS (SELECT tl.pixel_id, max(abs(v - bm)) AS mx FROM tl JOIN b ON tl.pixel_id = b.pixel_id GROUP BY 1)
SELECT tl.pixel_id, t, {q6('(v - bm) / CASE WHEN mx < 0.000001 THEN 1 ELSE mx END')} AS z FROM tl JOIN b ON tl.pixel_id = b.pixel_id JOIN m ON m.pixel_id = tl.pixel_id""")
def w12_amp(spark, root):
    t = traces(spark, root).select("pixel_id", amplitude_scaled("x", 10).alias("x"))
    return long(t, "pixel_id", v="z").select("pixel_id", "t", r6("z").alias("z"))


@query("w13_target_standardise", f"""WITH {PREDICTIONS}, m AS (SELECT method_id, avg(ttp_pred) AS mu, stddev_pop(ttp_pred) + CAST(1e-8 AS DOUBLE) AS sd FROM pred WHERE split = 'train' GROUP BY 1)
SELECT pixel_id, {q6('(ttp_pred - mu) / sd')} AS z, {q6('(ttp_pred - mu) / sd * sd + mu')} AS restored FROM pred JOIN m USING (method_id)""")
def w13(spark, root):
    p = predictions(spark, root)
    m = p.filter("split = 'train'").groupBy("method_id").agg(F.avg("ttp_pred").alias("mu"), (F.stddev_pop("ttp_pred") + F.lit(1e-8)).alias("sd"))
    z = attach(p, m, ["method_id"]).withColumn("z", (F.col("ttp_pred") - F.col("mu")) / F.col("sd"))
    return z.select("pixel_id", r6("z").alias("z"), r6(F.col("z") * F.col("sd") + F.col("mu")).alias("restored"))


def _unit(pid, seed, k):
    """One draw in [0, 1) per row, from a digest: the same row gives the same draw in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), F.col(pid).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _wave(u, i):
    """Noise with unit spread for sample ``i`` of a row whose draw is ``u``: a folded sine, no digest per sample."""
    rough = F.sin(u * 12.9898 + i * 78.233) * 43758.5453
    return F.sin(6.283185307179586 * (rough - F.floor(rough))) * 1.4142135623730951


def augmented(df, x="x", pid="pixel_id", seed=7):
    """Shifted (within 20), drifted, noisy (2 % of the spread) and rescaled (0.85-1.15) copy of each trace."""
    unit = lambda k: _unit(pid, seed, k)
    draw = F.struct(
        (F.floor(unit(0) * 41) - 20).cast("int").alias("shift"), (unit(1) * 0.1).alias("amp"),
        (unit(2) * 6.283185307179586).alias("phase"), (0.85 + unit(3) * 0.3).alias("gain"), unit(4).alias("u"), ar.std(x).alias("sd"),
    )

    def build(arr, d):
        n = F.size(arr)
        return F.transform(arr, lambda v, i: d["gain"] * (
            F.get(arr, F.pmod(i - d["shift"], n).cast("int"))
            + d["amp"] * d["sd"] * F.sin(6.283185307179586 * i / n + d["phase"])
            + _wave(d["u"], i) * 0.02 * d["sd"]
        ))

    return df.withColumn("x_aug", ar.let(x, lambda arr: ar.let(draw, lambda d: build(arr, d))))


def masked_chunks(x, start: int, length: int, pid="pixel_id", seed=7):
    """Replace a chunk by noise with the chunk's own mean and spread."""
    def fill(arr, st):
        return F.transform(arr, lambda v, i: F.when(
            (i >= start) & (i < start + length), st["m"] + st["s"] * _wave(st["u"], i)).otherwise(v))

    part = lambda arr: F.slice(arr, start + 1, length)
    return ar.let(x, lambda arr: ar.let(
        F.struct(ar.mean(part(arr)).alias("m"), ar.std(part(arr)).alias("s"), _unit(pid, seed, 5).alias("u")), lambda st: fill(arr, st)))


def _unit_sql(k):
    return f"(('0x' || substr(md5('7|{k}|' || CAST(pixel_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _wave_sql(u):
    rough = f"(sin({u} * 12.9898::DOUBLE + t * 78.233::DOUBLE) * 43758.5453::DOUBLE)"
    return f"(sin(2 * pi() * ({rough} - floor({rough}))) * sqrt(2::DOUBLE))"


@query("w14_trace_augmentation", f"""WITH {TRACES_LONG}, g AS (SELECT pixel_id, stddev_pop(v) AS sd, avg(v) FILTER (t BETWEEN 16 AND 31) AS m, stddev_pop(v) FILTER (t BETWEEN 16 AND 31) AS s FROM tl GROUP BY 1),
d AS (SELECT *, CAST(floor({_unit_sql(0)} * 41) - 20 AS INTEGER) AS shift, {_unit_sql(1)} * 0.1::DOUBLE AS amp, {_unit_sql(2)} * 2 * pi() AS phase,
  0.85::DOUBLE + {_unit_sql(3)} * 0.3::DOUBLE AS gain, {_unit_sql(4)} AS u, {_unit_sql(5)} AS um FROM g),
a AS (SELECT tl.pixel_id, gain * (x[(t - shift + 64) % 64 + 1] + amp * sd * sin(2 * pi() * t / 64 + phase) + {_wave_sql('u')} * 0.02::DOUBLE * sd) AS aug,
  CASE WHEN t BETWEEN 16 AND 31 THEN m + s * {_wave_sql('um')} ELSE v END AS masked FROM tl JOIN d USING (pixel_id) JOIN (SELECT pixel_id, x FROM traces) z USING (pixel_id))
SELECT pixel_id, CAST(count(*) AS INTEGER) AS n, {q6('avg(aug)')} AS mean_aug, {q6('stddev_pop(aug)')} AS std_aug, {q6('avg(masked)')} AS mean_masked FROM a GROUP BY 1""")
def w14(spark, root):
    a = augmented(traces(spark, root)).withColumn("masked", masked_chunks("x", 16, 16))
    return a.select("pixel_id", F.size("x_aug").alias("n"), r6(ar.mean("x_aug")).alias("mean_aug"), r6(ar.std("x_aug")).alias("std_aug"), r6(ar.mean("masked")).alias("mean_masked"))


@query("w15_time_reversal_check", f"""WITH {TRACES_LONG}, a AS (SELECT well_id, pixel_id, arg_max(t, (v, -t)) / 15.0 AS fwd, arg_max(63 - t, (v, t)) / 15.0 AS rev FROM tl GROUP BY 1, 2)
SELECT well_id, {q6('min(fwd)')} AS min_fwd, {q6('max(fwd)')} AS max_fwd, {q6('min(rev)')} AS min_rev, {q6('max(rev)')} AS max_rev,
{q6('median(abs(fwd - rev))')} AS med_delta, {q6('corr(rev, 63 / 15.0 - fwd)')} AS r FROM a GROUP BY 1""")
def w15(spark, root):
    t = traces(spark, root).select(
        "well_id", (ar.argmax("x") / 15.0).alias("fwd"), (ar.argmax(F.reverse("x")) / 15.0).alias("rev"))
    t = t.withColumn("d", F.abs(F.col("fwd") - F.col("rev")))
    a = t.groupBy("well_id").agg(
        r6(F.min("fwd")).alias("min_fwd"), r6(F.max("fwd")).alias("max_fwd"), r6(F.min("rev")).alias("min_rev"), r6(F.max("rev")).alias("max_rev"),
        r6(correlation("rev", F.lit(63 / 15.0) - F.col("fwd"))).alias("r"))
    m = quantiles(t, ["well_id"], "d", {"m": 0.5}).select("well_id", r6("m").alias("med_delta"))
    return attach(a, m, ["well_id"])
