"""Queries for score-to-time rules and decoders."""

from pyspark.sql import functions as F

from wellspring.functions import arrays as ar
from wellspring.operators import metrics as mt
from wellspring.operators import rules as rl
from wellspring.plans import query
from wellspring.plans.bindings import (table, 
    SCORES_LONG, STRIDE, TRACES_LONG, WINDOW, q6, r6, scores, traces,
)

LAST = f"(63 * {STRIDE} + ({WINDOW} - 1) / 2.0) / 15.0"


def _one(fn, **kw):
    def run(spark, root):
        s = scores(spark, root)
        return s.select("pixel_id", r6(fn("p", WINDOW, STRIDE, **kw)).alias("ttp"))

    return run


def _run_cte(name: str, k: int, thr: float) -> str:
    """First start of k consecutive scores above thr, per pixel (NULL if none)."""
    return f""", {name} AS (
  SELECT pixel_id, min(t) FILTER (run = {k} AND len = {k}) AS pos FROM (
    SELECT pixel_id, t,
           sum(CASE WHEN p > {thr}::DOUBLE THEN 1 ELSE 0 END) OVER w AS run, count(*) OVER w AS len
    FROM sl WINDOW w AS (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) z GROUP BY pixel_id)"""


def _centre(i: str) -> str:
    return f"(({i}) * {STRIDE} + ({WINDOW} - 1) / 2.0) / 15.0"


def _run_sql(k, thr, shift=0):
    return f"WITH {SCORES_LONG}{_run_cte('kr', k, thr)} SELECT pixel_id, {q6(f'coalesce({_centre(f'pos + {shift}')}, {LAST})')} AS ttp FROM kr"


for k_, thr_ in ((1, 0.5), (2, 0.5), (3, 0.5), (5, 0.5), (3, 0.3), (3, 0.7)):
    query(f"r01_first_above_k{k_}_thr{str(thr_).replace('.', 'p')}", _run_sql(k_, thr_))(_one(rl.first_above, thr=thr_, k=k_))
query("r02_end_of_run", _run_sql(3, 0.5, 2))(_one(rl.end_of_run, thr=0.5, k=3))

FRACTION = """, fr AS (SELECT pixel_id, min(t) FILTER (share >= 0.5 AND len = 10) AS pos FROM (
  SELECT pixel_id, t, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) OVER w AS share, count(*) OVER w AS len
  FROM sl WINDOW w AS (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) z GROUP BY pixel_id)"""
query("r03_fraction_above", f"WITH {SCORES_LONG}{FRACTION} SELECT pixel_id, {q6(f'coalesce({_centre('pos')}, {LAST})')} AS ttp FROM fr")(_one(rl.fraction_above))


def _cross(thr, name="cr"):
    return f""", {name} AS (
  SELECT pixel_id, min(t) AS pos, arg_min(p, t) AS p1, arg_min(p0, t) AS p0 FROM (
    SELECT pixel_id, t, p, lag(p) OVER (PARTITION BY pixel_id ORDER BY t) AS p0 FROM sl) z
  WHERE p >= {thr}::DOUBLE GROUP BY pixel_id)"""


def _cross_ttp(thr):
    return f"""CASE WHEN c.pos IS NULL THEN {LAST} WHEN c.pos = 0 THEN {_centre('0')} WHEN c.p1 = c.p0 THEN {_centre('c.pos')}
  ELSE {_centre('c.pos - 1')} + ({thr}::DOUBLE - c.p0) / (c.p1 - c.p0) * ({_centre('c.pos')} - {_centre('c.pos - 1')}) END"""


for thr_ in (0.5, 0.3):
    query(
        f"r04_linear_crossing_thr{str(thr_).replace('.', 'p')}",
        f"WITH {SCORES_LONG}{_cross(thr_)} SELECT s.pixel_id, {q6(_cross_ttp(thr_))} AS ttp FROM sc s LEFT JOIN cr c USING (pixel_id)",
    )(_one(rl.linear_crossing, thr=thr_))


@query("r05_logistic_fit")
def r05(spark, root):
    s = scores(spark, root).select("pixel_id", rl.logistic_fit(WINDOW, STRIDE)("p").alias("f"))
    return s.select("pixel_id", F.round("f.ttp", 3).alias("ttp"), "f.converged")


# known logistics, one per part: the fit has to give back midpoint and rate
KNOWN = """kn AS (SELECT p_partkey, CAST(4 AS DOUBLE) + (p_partkey % 40) / CAST(4 AS DOUBLE) AS t0, CAST(0.5 AS DOUBLE) + (p_size % 7) / CAST(4 AS DOUBLE) AS k FROM part)"""


@query("r05_logistic_recovery", f"WITH {KNOWN} SELECT p_partkey, {q6('t0', 4)} AS t0, {q6('k', 4)} AS k, {q6('t0', 4)} AS ttp, true AS converged FROM kn")
def r05_recovery(spark, root):
    known = table(spark, root, "part").select("p_partkey", (4 + (F.col("p_partkey") % 40) / 4.0).alias("t0"), (0.5 + (F.col("p_size") % 7) / 4.0).alias("k"))
    centre = lambda i: ar.centre_min(i, WINDOW, STRIDE)
    curve = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1.0 / (1.0 + F.exp(-F.col("k") * (centre(i) - F.col("t0")))))
    f = known.withColumn("f", rl.logistic_fit(WINDOW, STRIDE)(curve))
    return f.select("p_partkey", r6("f.t0", 4).alias("t0"), r6("f.k", 4).alias("k"), r6("f.ttp", 4).alias("ttp"), "f.converged")


def _grad(src, name, col, out):
    return f""", {name} AS (
  SELECT pixel_id, t, CASE WHEN lag({col}) OVER w IS NULL THEN lead({col}) OVER w - {col}
    WHEN lead({col}) OVER w IS NULL THEN {col} - lag({col}) OVER w
    ELSE (lead({col}) OVER w - lag({col}) OVER w) / 2.0 END AS {out}
  FROM {src} WINDOW w AS (PARTITION BY pixel_id ORDER BY t))"""


def _argbest(src, col, name="am"):
    return f", {name} AS (SELECT pixel_id, t AS pos FROM (SELECT pixel_id, t, row_number() OVER (PARTITION BY pixel_id ORDER BY {col} DESC, t) AS rn FROM {src}) z WHERE rn = 1)"


query("r06_rise_peak", f"WITH {SCORES_LONG}{_grad('sl', 'g1', 'p', 'd')}{_argbest('g1', 'd')} SELECT pixel_id, {q6(_centre('pos'))} AS ttp FROM am")(_one(rl.rise_peak))
query("r06_curvature_peak", f"WITH {SCORES_LONG}{_grad('sl', 'g1', 'p', 'd')}{_grad('g1', 'g2', 'd', 'dd')}{_argbest('g2', 'dd')} SELECT pixel_id, {q6(_centre('pos'))} AS ttp FROM am")(_one(rl.curvature_peak))
query("r06_highest_score", f"WITH {SCORES_LONG}{_argbest('sl', 'p')} SELECT pixel_id, {q6(_centre('pos'))} AS ttp FROM am")(_one(rl.highest))

LOCAL = """, lm AS (SELECT pixel_id, min(t) AS pos FROM (
  SELECT pixel_id, t, p, lag(p) OVER w AS a, lead(p) OVER w AS b FROM sl WINDOW w AS (PARTITION BY pixel_id ORDER BY t)) z
  WHERE p > a AND p >= b GROUP BY pixel_id)"""
query("r07_first_local_peak", f"WITH {SCORES_LONG}{LOCAL}{_argbest('sl', 'p')} SELECT a.pixel_id, {q6(_centre('coalesce(l.pos, a.pos)'))} AS ttp FROM am a LEFT JOIN lm l USING (pixel_id)")(_one(rl.first_local_peak))


@query("r08_nearest_zero", f"WITH {TRACES_LONG}{_argbest('tl', '-abs(v)')} SELECT pixel_id, {q6(_centre('pos'))} AS ttp FROM am")
def r08(spark, root):
    return traces(spark, root).select("pixel_id", r6(rl.nearest_zero("x", WINDOW, STRIDE)).alias("ttp"))


@query("r09_first_crossing_or_null", f"WITH {SCORES_LONG} SELECT pixel_id, {q6('min(t) FILTER (p > 0.9) / 15.0')} AS ttp FROM sl GROUP BY 1")
def r09(spark, root):
    return scores(spark, root).select("pixel_id", r6(rl.first_crossing_or_null("p", 0.9)).alias("ttp"))


@query("r10_sample_run", f"WITH {SCORES_LONG}{_run_cte('kr', 3, 0.6)} SELECT pixel_id, {q6('coalesce(pos, 63) / 15.0')} AS ttp FROM kr")
def r10(spark, root):
    return scores(spark, root).select("pixel_id", r6(rl.sample_run("p", 0.6, 3)).alias("ttp"))


TOP5 = """, t5 AS (SELECT pixel_id, sum(p * t) / (sum(p) + CAST(1e-12 AS DOUBLE)) / 15.0 AS top5 FROM (
  SELECT pixel_id, t, p, row_number() OVER (PARTITION BY pixel_id ORDER BY p DESC, t) AS rn FROM sl) z WHERE rn <= 5 GROUP BY 1),
ev AS (SELECT pixel_id, sum(p * t) / (sum(p) + CAST(1e-12 AS DOUBLE)) / 15.0 AS expected FROM sl GROUP BY 1),
cd AS (SELECT pixel_id, min(t) FILTER (cum / (tot + CAST(1e-12 AS DOUBLE)) > 0.5) / 15.0 AS half FROM (
  SELECT pixel_id, t, sum(p) OVER (PARTITION BY pixel_id ORDER BY t) AS cum, sum(p) OVER (PARTITION BY pixel_id) AS tot FROM sl) z GROUP BY 1)"""


@query("r11_density_rules", f"""WITH {SCORES_LONG}{_argbest('sl', 'p')}{TOP5}
SELECT a.pixel_id, {q6('a.pos / 15.0')} AS hard_argmax, {q6('top5')} AS soft_argmax_top5, {q6('expected')} AS expected_value, {q6('half')} AS first_moment_thr0p5
FROM am a JOIN t5 USING (pixel_id) JOIN ev USING (pixel_id) JOIN cd USING (pixel_id)""")
def r11(spark, root):
    return scores(spark, root).select("pixel_id", *[r6(fn("p")).alias(n) for n, fn in rl.DENSITY_RULES.items()])


# --- class sequences: softmax over four shifted copies of the trace ------------------------
def class_frames(spark, root):
    """Array over time of four class probabilities, and the most likely class per sample."""
    def frames(arr):
        def frame(v, i):
            e = F.transform(
                F.array(*[F.lit(c) for c in range(4)]),
                lambda c: F.exp((c + 3.0) * F.get(arr, ((i + c * 16) % F.size(arr)).cast("int"))),
            )
            return ar.let(e, lambda w: F.transform(w, lambda q: q / ar.total(w)))

        return F.transform(arr, frame)

    t = traces(spark, root).withColumn("f", ar.let("x", frames))
    return t.withColumn("c", F.transform("f", lambda p: ar.argmax(p)))


CLASSES = TRACES_LONG + """, ex AS (
  SELECT b.pixel_id, b.t, k.c, exp(CAST(3 + k.c AS DOUBLE) * a.v) AS e
  FROM tl b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c) k JOIN tl a ON a.pixel_id = b.pixel_id AND a.t = (b.t + 16 * k.c) % 64),
sm AS (SELECT pixel_id, t, c, e / sum(e) OVER (PARTITION BY pixel_id, t) AS p FROM ex),
cs AS (SELECT pixel_id, t, c FROM (SELECT pixel_id, t, c, row_number() OVER (PARTITION BY pixel_id, t ORDER BY e DESC, c) AS rn FROM ex) z WHERE rn = 1)"""


@query("r12_class_run", f"""WITH {CLASSES} SELECT pixel_id, {q6('coalesce(min(t) FILTER (run = 3), 63) / 15.0')} AS ttp FROM (
  SELECT pixel_id, t, sum(CASE WHEN c IN (2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM cs) z GROUP BY 1""")
def r12(spark, root):
    return class_frames(spark, root).select("pixel_id", r6(rl.class_run("c", (2, 3), 3)).alias("ttp"))


@query("r13_smoothed_crossing", f"""WITH {CLASSES} SELECT pixel_id, {q6('coalesce(min(t) FILTER (s > 0.4), 63) / 15.0')} AS ttp FROM (
  SELECT pixel_id, t, sum(p) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s FROM sm WHERE c = 2) z GROUP BY 1""")
def r13(spark, root):
    rising = F.transform("f", lambda p: F.get(p, F.lit(2)))
    return class_frames(spark, root).select("pixel_id", r6(rl.smoothed_crossing(rising, 5, 0.4)).alias("ttp"))


@query("r14_largest_block", f"""WITH {CLASSES}, isl AS (
  SELECT pixel_id, t, t - row_number() OVER (PARTITION BY pixel_id ORDER BY t) AS g FROM cs WHERE c = 2),
bl AS (SELECT pixel_id, min(t) AS st, count(*) AS len FROM isl GROUP BY pixel_id, g),
bb AS (SELECT pixel_id, st FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY len DESC, st) AS rn FROM bl) z WHERE rn = 1)
SELECT t.pixel_id, {q6('coalesce(bb.st, 63) / 15.0')} AS ttp FROM traces t LEFT JOIN bb USING (pixel_id)""")
def r14(spark, root):
    return class_frames(spark, root).select("pixel_id", r6(rl.largest_block("c", 2)).alias("ttp"))


def _decode_sql(step_only: bool) -> str:
    """CTEs up to ``fin`` (pixel_id, pos): the best path's boundaries found by running maxima over prefix sums of log scores."""
    cells = []
    for c in range(4):
        lo = max(c - 1, 0) if step_only else 0
        prev = [f"d.s{q}" for q in range(lo, c + 1)]
        ats = [f"d.a{q}" for q in range(lo, c + 1)]
        score, pos = prev[0], ats[0]
        for s, a in zip(prev[1:], ats[1:]):
            score, pos = f"CASE WHEN {s} > {score} THEN {s} ELSE {score} END", f"CASE WHEN {s} > {score} THEN {a} ELSE {pos} END"
        pos = f"CASE WHEN ({pos}) < 0 THEN d.t + 1 ELSE ({pos}) END" if c == 2 else f"({pos})"
        cells.append(f"({score}) + e.l{c} AS s{c}, {pos} AS a{c}")
    start = [f"l{c}" if not step_only or c == 0 else "CAST('-inf' AS DOUBLE)" for c in range(4)]
    best_s, best_a = "s0", "a0"
    for c in (1, 2, 3):
        best_s, best_a = f"CASE WHEN s{c} > {best_s} THEN s{c} ELSE {best_s} END", f"CASE WHEN s{c} > {best_s} THEN a{c} ELSE {best_a} END"
    return f"""lg AS (
  SELECT pixel_id, t, {', '.join(f'ln(max(p) FILTER (c = {c}) + CAST(1e-8 AS DOUBLE)) AS l{c}' for c in range(4))} FROM sm GROUP BY 1, 2),
d AS (
  SELECT pixel_id, t, {', '.join(f'{start[c]} AS s{c}, {0 if c == 2 else -1} AS a{c}' for c in range(4))} FROM lg WHERE t = 0
  UNION ALL
  SELECT d.pixel_id, d.t + 1, {', '.join(cells)} FROM d JOIN lg e ON e.pixel_id = d.pixel_id AND e.t = d.t + 1),
fin AS (SELECT pixel_id, {best_a} AS pos FROM d WHERE t = 63)"""


DECODED = f" SELECT pixel_id, {q6('CASE WHEN pos >= 0 THEN pos ELSE 63 END / 15.0')} AS ttp FROM fin"


@query("r15_monotone_decode", f"WITH RECURSIVE {CLASSES}, {_decode_sql(False)}{DECODED}")
def r15(spark, root):
    return class_frames(spark, root).select("pixel_id", r6(rl.ordered_decode("f")).alias("ttp"))


@query("r16_stepwise_decode", f"WITH RECURSIVE {CLASSES}, {_decode_sql(True)}{DECODED}")
def r16(spark, root):
    return class_frames(spark, root).select("pixel_id", r6(rl.ordered_decode("f", step_only=True)).alias("ttp"))


# --- sweeps -------------------------------------------------------------------------------
# all window rules but the two logistic fits, which SQL cannot express
SWEEP = tuple(n for n in rl.WINDOW_RULES if "sigmoid" not in n)


def _sweep_sql() -> str:
    """Ends with CTE ``tall`` (rule_id, chip_id, well_id, pixel_id, ttp_pred): one SELECT per rule, stacked."""
    ctes, rows = [FRACTION, LOCAL, _argbest("sl", "p"), _grad("sl", "g1", "p", "d"), _grad("g1", "g2", "d", "dd"), _argbest("g1", "d", "am1"), _argbest("g2", "dd", "am2")], []
    add = lambda rule, ttp, src: rows.append(f"SELECT '{rule}' AS rule_id, pixel_id, CAST({ttp} AS DOUBLE) AS ttp_pred FROM {src}")
    for k, thr in ((1, 0.5), (2, 0.5), (3, 0.5), (5, 0.5), (3, 0.3), (3, 0.7)):
        tag = f"K{k}_thr{str(thr).replace('.', 'p')}"
        ctes.append(_run_cte(f"run_{tag}", k, thr))
        add(f"first_above_{tag}", f"coalesce({_centre('pos')}, {LAST})", f"run_{tag}")
    add("end_of_K3_run_thr0p5", f"coalesce({_centre('pos + 2')}, {LAST})", "run_K3_thr0p5")
    add("fraction_above_lb10_thr0p5_f0p5", f"coalesce({_centre('pos')}, {LAST})", "fr")
    for thr, name in ((0.5, "cr5"), (0.3, "cr3")):
        ctes.append(_cross(thr, name))
        add(f"linear_interp_thr{str(thr).replace('.', 'p')}", _cross_ttp(thr), f"sc LEFT JOIN {name} c USING (pixel_id)")
    add("first_deriv_peak", _centre("pos"), "am1")
    add("second_deriv_peak", _centre("pos"), "am2")
    add("argmax_P", _centre("pos"), "am")
    add("first_local_max", _centre("coalesce(l.pos, a.pos)"), "am a LEFT JOIN lm l USING (pixel_id)")
    stacked = " UNION ALL ".join(rows)
    return f"WITH {SCORES_LONG}{''.join(ctes)}, st AS ({stacked}), tall AS (SELECT rule_id, chip_id, well_id, pixel_id, ttp_pred FROM st JOIN sc USING (pixel_id))"


SWEEP_SQL = _sweep_sql()


@query("u01_rule_registry", SWEEP_SQL + f" SELECT rule_id, pixel_id, {q6('ttp_pred')} AS ttp FROM tall")
def u01(spark, root):
    out = rl.apply_rules(scores(spark, root), "p", WINDOW, STRIDE, SWEEP, ("pixel_id",))
    return out.select("rule_id", "pixel_id", r6("ttp_pred").alias("ttp"))


@query("r17_rule_sweep", SWEEP_SQL + f""", wm AS (
  SELECT rule_id, chip_id, well_id, avg(ttp_pred) AS m, coalesce(stddev_samp(ttp_pred), 0) AS sd, CAST(any_value(well_id) AS DOUBLE) * 1.5 AS tm, CAST(well_id % 5 AS DOUBLE) AS lc
  FROM tall GROUP BY rule_id, chip_id, well_id),
cm AS (SELECT rule_id, lc, avg(m) AS m FROM wm GROUP BY 1, 2),
ln AS (SELECT rule_id, regr_slope(m, lc) AS slope, regr_r2(m, lc) AS r2 FROM cm GROUP BY 1)
SELECT rule_id, count(*) AS n_wells, {q6('avg(abs(m - tm))')} AS per_well_mae, {q6('avg(CASE WHEN abs(m) > 0.000001 THEN sd / abs(m) END)')} AS within_well_cov,
  {q6('any_value(slope)')} AS slope, {q6('any_value(r2)')} AS r2
FROM wm JOIN ln USING (rule_id) GROUP BY rule_id""")
def r17(spark, root):
    tall = rl.apply_rules(scores(spark, root), "p", WINDOW, STRIDE, SWEEP, ("chip_id", "well_id", "pixel_id"))
    tall = tall.withColumn("ttp_true", F.col("well_id") * 1.5).withColumn("log10_conc", (F.col("well_id") % 5).cast("double"))
    p = mt.portfolio(tall, ["rule_id"], None)
    return p.select("rule_id", "n_wells", *[r6(c).alias(c) for c in ("per_well_mae", "within_well_cov", "slope", "r2")])


@query("r17_full_rule_sweep")
def r17_full(spark, root):
    tall = rl.apply_rules(scores(spark, root), "p", WINDOW, STRIDE, None, ("chip_id", "well_id", "pixel_id"))
    tall = tall.withColumn("ttp_true", F.col("well_id") * 1.5).withColumn("log10_conc", (F.col("well_id") % 5).cast("double"))
    p = mt.portfolio(tall, ["rule_id"], None)
    return p.select("rule_id", "n_wells", *[r6(c, 3).alias(c) for c in ("per_well_mae", "within_well_cov", "slope", "rho")], "passes")


def _class_sweep_sql() -> str:
    """CTE ``tall`` (rule_id, pixel_id, ttp_pred) of all class rules."""
    rows, ctes = [], [_decode_sql(False)]
    for k in (2, 3, 5):
        ctes.append(f"""kc{k} AS (SELECT pixel_id, min(t) FILTER (run = {k}) AS pos FROM (
  SELECT pixel_id, t, sum(CASE WHEN c IN (2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS run FROM cs) z GROUP BY 1)""")
        rows.append(("kcons" + str(k), "pos", f"kc{k}"))
    ctes.append("""sp AS (SELECT pixel_id, min(t) FILTER (s > 0.5) AS pos FROM (
  SELECT pixel_id, t, sum(p) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS s FROM sm WHERE c = 2) z GROUP BY 1)""")
    rows.append(("smoothedP", "pos", "sp"))
    ctes.append("""isl AS (SELECT pixel_id, t, t - row_number() OVER (PARTITION BY pixel_id ORDER BY t) AS g FROM cs WHERE c = 2),
bl AS (SELECT pixel_id, min(t) AS st, count(*) AS len FROM isl GROUP BY pixel_id, g),
lb AS (SELECT pixel_id, st AS pos FROM (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY len DESC, st) AS rn FROM bl) z WHERE rn = 1)""")
    rows.append(("largestBlock", "pos", "lb"))
    rows.append(("viterbiMono", "CASE WHEN pos >= 0 THEN pos END", "fin"))
    stacked = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, t.chip_id, t.well_id, t.pixel_id, coalesce({e}, 63) / 15.0::DOUBLE AS ttp_pred FROM traces t LEFT JOIN {src} q ON q.pixel_id = t.pixel_id" for r, e, src in rows)
    return f"WITH RECURSIVE {CLASSES}, {', '.join(ctes)}, tall AS ({stacked})"


# no r2 here: a rule that fires nowhere gives a constant, and the r2 of a constant is rounding noise
SWEPT = f""", wm AS (
  SELECT rule_id, chip_id, well_id, avg(ttp_pred) AS m, coalesce(stddev_samp(ttp_pred), 0) AS sd, CAST(any_value(well_id) AS DOUBLE) * 1.5 AS tm, CAST(well_id % 5 AS DOUBLE) AS lc
  FROM tall GROUP BY rule_id, chip_id, well_id),
cm AS (SELECT rule_id, lc, avg(m) AS m FROM wm GROUP BY 1, 2),
ln AS (SELECT rule_id, regr_slope(m, lc) AS slope FROM cm GROUP BY 1)
SELECT rule_id, count(*) AS n_wells, {q6('avg(abs(m - tm))')} AS per_well_mae, {q6('avg(CASE WHEN abs(m) > 0.000001 THEN sd / abs(m) END)')} AS within_well_cov, {q6('any_value(slope)')} AS slope
FROM wm JOIN ln USING (rule_id) GROUP BY rule_id"""


@query("r17_class_rule_sweep", _class_sweep_sql() + SWEPT)
def r17_classes(spark, root):
    tall = rl.apply_class_rules(class_frames(spark, root), "c", "f", (2, 3), None, ("chip_id", "well_id", "pixel_id"))
    tall = tall.withColumn("ttp_true", F.col("well_id") * 1.5).withColumn("log10_conc", (F.col("well_id") % 5).cast("double"))
    p = mt.portfolio(tall, ["rule_id"], None)
    return p.select("rule_id", "n_wells", *[r6(c).alias(c) for c in ("per_well_mae", "within_well_cov", "slope")])


@query("r17_class_rule_times", _class_sweep_sql() + f" SELECT rule_id, pixel_id, {q6('ttp_pred')} AS ttp FROM tall")
def r17_class_times(spark, root):
    out = rl.apply_class_rules(class_frames(spark, root), "c", "f", (2, 3), None, ("pixel_id",))
    return out.select("rule_id", "pixel_id", r6("ttp_pred").alias("ttp"))


@query("u02_density_rule_sweep", f"""WITH {SCORES_LONG}{_argbest('sl', 'p')}{TOP5}, wide AS (
  SELECT a.pixel_id, CAST(a.pos / 15.0 AS DOUBLE) AS hard_argmax, top5 AS soft_argmax_top5, expected AS expected_value, CAST(half AS DOUBLE) AS first_moment_thr0p5
  FROM am a JOIN t5 USING (pixel_id) JOIN ev USING (pixel_id) JOIN cd USING (pixel_id)),
tall AS (UNPIVOT wide ON hard_argmax, soft_argmax_top5, expected_value, first_moment_thr0p5 INTO NAME rule_id VALUE ttp)
SELECT rule_id, count(*) AS n, {q6('avg(ttp)')} AS mean_ttp, {q6('min(ttp)')} AS min_ttp, {q6('max(ttp)')} AS max_ttp FROM tall GROUP BY 1""")
def u02(spark, root):
    wide = scores(spark, root).select("pixel_id", *[fn("p").alias(n) for n, fn in rl.DENSITY_RULES.items()])
    tall = wide.unpivot("pixel_id", list(rl.DENSITY_RULES), "rule_id", "ttp")
    return tall.groupBy("rule_id").agg(
        F.count("*").alias("n"), r6(F.avg("ttp")).alias("mean_ttp"), r6(F.min("ttp")).alias("min_ttp"), r6(F.max("ttp")).alias("max_ttp"))


@query("r18_window_scores_to_pixel", f"WITH {SCORES_LONG} SELECT pixel_id, count(*) AS n_windows, {q6('avg(p)')} AS score FROM sl GROUP BY 1")
def r18(spark, root):
    s = scores(spark, root)
    return s.select("pixel_id", F.size("p").cast("long").alias("n_windows"), r6(ar.mean("p")).alias("score"))
