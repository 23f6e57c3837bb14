"""SQL of the landmark extractors: moving means, peaks with prominence and width, anchored variants.

Sources are CTEs (pixel_id, t, v) with t from 0 at 15 samples a minute; pixel_id may be any key.
"""

from __future__ import annotations

from wellspring.plans.windows import _ma, _savgol_sql

RATE = "15::DOUBLE"


def grad(src: str, name: str, col: str, out: str) -> str:
    return f""", {name} AS (SELECT *, CASE WHEN lag({col}) OVER w IS NULL THEN lead({col}) OVER w - {col} WHEN lead({col}) OVER w IS NULL THEN {col} - lag({col}) OVER w
  ELSE (lead({col}) OVER w - lag({col}) OVER w) / 2.0 END AS {out} FROM {src} WINDOW w AS (PARTITION BY pixel_id ORDER BY t))"""


def peaks(src: str, name: str) -> str:
    """CTE ``name`` (pixel_id, p, yp, width): local maxima of ``src`` (pixel_id, t, y, mp) with prominence of at least ``mp``."""
    n = name
    return f""", {n}_k AS (SELECT pixel_id, t AS p, y AS yp, mp FROM (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM {src} WINDOW w AS (PARTITION BY pixel_id ORDER BY t)) z WHERE y > y0 AND y > y1),
{n}_w AS MATERIALIZED (SELECT k.pixel_id, k.p, any_value(k.yp) AS yp, any_value(k.mp) AS mp, coalesce(max(s.t) FILTER (s.t < p AND s.y > yp), -1) AS a, coalesce(min(s.t) FILTER (s.t > p AND s.y > yp), 1000000) AS b
  FROM {n}_k k JOIN {src} s ON s.pixel_id = k.pixel_id GROUP BY 1, 2),
{n}_b AS MATERIALIZED (SELECT k.pixel_id, k.p, any_value(k.yp) AS yp, any_value(k.mp) AS mp, min(s.y) FILTER (s.t <= p) AS lmin, min(s.y) FILTER (s.t >= p) AS rmin,
  arg_min(s.t, (s.y, -s.t)) FILTER (s.t <= p) AS lb, arg_min(s.t, (s.y, s.t)) FILTER (s.t >= p) AS rb
  FROM {n}_w k JOIN {src} s ON s.pixel_id = k.pixel_id AND s.t > k.a AND s.t < k.b GROUP BY 1, 2),
{n}_h AS (SELECT *, yp - (yp - greatest(lmin, rmin)) / 2 AS h FROM {n}_b WHERE yp - greatest(lmin, rmin) >= mp),
{n}_c AS MATERIALIZED (SELECT k.pixel_id, k.p, any_value(k.yp) AS yp, any_value(k.h) AS h, coalesce(max(s.t) FILTER (s.t < p AND s.y <= h), any_value(lb)) AS l, coalesce(min(s.t) FILTER (s.t > p AND s.y <= h), any_value(rb)) AS r
  FROM {n}_h k JOIN {src} s ON s.pixel_id = k.pixel_id AND s.t BETWEEN k.lb AND k.rb GROUP BY 1, 2),
{n}_l AS MATERIALIZED (SELECT pixel_id, min(t) AS t0, list(y ORDER BY t) AS ys FROM {src} GROUP BY 1),
{n}_e AS (SELECT c.*, ys[l - t0 + 1] AS la, ys[l - t0 + 2] AS lb, ys[r - t0 + 1] AS ra, ys[r - t0] AS rb FROM {n}_c c JOIN {n}_l USING (pixel_id)),
{n} AS (SELECT pixel_id, p, yp, r - CASE WHEN ra < h THEN (h - ra) / (rb - ra) ELSE 0 END - l - CASE WHEN la < h THEN (h - la) / (lb - la) ELSE 0 END AS width FROM {n}_e)"""


def strongest(src: str, name: str) -> str:
    """CTE ``name`` (pixel_id, pk, yp): the peak at least one sample wide with the largest height x width."""
    return peaks(src, f"{name}_p") + f""", {name} AS MATERIALIZED (SELECT pixel_id, arg_max(p, (yp * width, -p)) AS pk, arg_max(yp, (yp * width, -p)) AS yp FROM {name}_p WHERE width >= 1 GROUP BY 1)"""


def slopes(src: str, n: str, span: int) -> str:
    """CTE ``{n}1`` (pixel_id, t, dx, s, d1): raw difference, smoothed trace and its smoothed difference."""
    h = (span - 1) // 2
    return _ma(src, f"{n}s", "v", h, "s", "pixel_id") + f""", {n}r AS (SELECT pixel_id, t, s, lead(v) OVER w - v AS dx, lead(s) OVER w - s AS ds FROM {n}s WINDOW w AS (PARTITION BY pixel_id ORDER BY t)),
{n}1 AS (SELECT pixel_id, t, dx, s, avg(ds) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS d1 FROM {n}r WHERE ds IS NOT NULL)"""


def landmarks(src: str, n: str, span: int, lo: int) -> str:
    """CTE ``{n}`` (pixel_id, peak, ttp, cy0, sdm) in minutes; the search starts at sample ``lo``, the baseline at 0."""
    h = (span - 1) // 2
    return slopes(src, n, span) + f""", {n}g AS MATERIALIZED (SELECT pixel_id, t, d1 AS y, 1e-5 AS mp FROM {n}1 WHERE t >= {lo})""" + strongest(f"{n}g", f"{n}k") + f""",
{n}f AS (SELECT d.pixel_id, min(d1) AS low FROM {n}1 d JOIN {n}k k ON k.pixel_id = d.pixel_id WHERE t BETWEEN {lo} AND pk GROUP BY 1),
{n}t AS (SELECT d.pixel_id, max(t) AS hit FROM {n}1 d JOIN {n}k k ON k.pixel_id = d.pixel_id JOIN {n}f f ON f.pixel_id = d.pixel_id WHERE t BETWEEN {lo} AND pk AND dx < low + 0.4::DOUBLE * (yp - low) GROUP BY 1),
{n}m AS (SELECT pixel_id, median(s) AS base FROM {n}1 WHERE t < {lo} GROUP BY 1),
{n}dd AS (SELECT pixel_id, t, lead(d1) OVER (PARTITION BY pixel_id ORDER BY t) - d1 AS dd FROM {n}1),
{n}2 AS (SELECT pixel_id, t, avg(dd) OVER (PARTITION BY pixel_id ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS d2 FROM {n}dd WHERE dd IS NOT NULL),
{n}g2 AS MATERIALIZED (SELECT d.pixel_id, t, d2 AS y, 1e-7 AS mp FROM {n}2 d JOIN {n}k k ON k.pixel_id = d.pixel_id WHERE t BETWEEN {lo} AND pk AND pk - {lo} + 1 >= 10)""" + strongest(f"{n}g2", f"{n}q") + f""",
{n} AS (SELECT z.pixel_id, pk / {RATE} AS peak, f.hit / {RATE} AS ttp, CASE WHEN abs(k.yp * {RATE}) >= 1e-6 THEN pk / {RATE} - (d.s - base) / (k.yp * {RATE}) END AS cy0, q.pk2 / {RATE} AS sdm
  FROM (SELECT DISTINCT pixel_id FROM {src}) z LEFT JOIN {n}k k ON k.pixel_id = z.pixel_id LEFT JOIN {n}t f ON f.pixel_id = z.pixel_id LEFT JOIN {n}m m ON m.pixel_id = z.pixel_id
  LEFT JOIN {n}1 d ON d.pixel_id = z.pixel_id AND d.t = k.pk LEFT JOIN (SELECT pixel_id, pk AS pk2 FROM {n}q) q ON q.pixel_id = z.pixel_id)"""


def anchored(src: str, anchors: str, n: str, span: int = 10, window: int = 9, ahead: str = "3::DOUBLE", margin: str = "0.5::DOUBLE", baseline: str = "0.4::DOUBLE") -> str:
    """CTE ``{n}`` (pixel_id, rule, ttp, reason) of the four variants; ``anchors`` is a CTE (pixel_id, a)."""
    at = f"t / {RATE}"
    before = lambda x: f"(SELECT count(*) FROM {src} i WHERE i.pixel_id = z.pixel_id AND i.t / {RATE} < {x})"
    return slopes(src, n, span) + _savgol_sql(window, 3, src, "pixel_id") + grad("sg", f"{n}v", "sg", "d") + grad(f"{n}v", f"{n}u", "d", "dd") + f""",
{n}g AS MATERIALIZED (SELECT pixel_id, t, d * {RATE} AS y, max(abs(d * {RATE})) OVER (PARTITION BY pixel_id) * 0.05::DOUBLE AS mp FROM {n}u)""" + peaks(f"{n}g", f"{n}p") + f""",
{n}a AS (SELECT p.pixel_id, arg_min(p, (abs(p / {RATE} - a), p)) / {RATE} AS ttp FROM {n}p p JOIN {anchors} k ON k.pixel_id = p.pixel_id WHERE p / {RATE} >= a AND p / {RATE} <= a + {ahead} GROUP BY 1),
{n}x AS (SELECT *, lead(dd) OVER (PARTITION BY pixel_id ORDER BY t) AS nx FROM {n}u),
{n}b AS (SELECT x.pixel_id, arg_min((x.t + dd / (dd - nx)) / {RATE}, x.t) AS ttp FROM {n}x x JOIN {anchors} k ON k.pixel_id = x.pixel_id
  WHERE {at} >= a AND (t + 1) / {RATE} <= a + {ahead} AND sign(nx) < sign(dd) GROUP BY 1),
{n}z AS (SELECT z.pixel_id, a, {before(f'a - {margin}')} AS lo, {before(f'a + {ahead}')} AS hi, {before(f'a - {margin} - {baseline}')} AS b0, (SELECT count(*) - 1 FROM {src} i WHERE i.pixel_id = z.pixel_id) AS len FROM {anchors} z WHERE a IS NOT NULL),
{n}c AS (SELECT *, CASE WHEN lo - b0 < 2 THEN 0 ELSE b0 END AS b1, least(hi, len) - lo >= 10 AS enough FROM {n}z),
{n}h AS MATERIALIZED (SELECT d.pixel_id, t, d1 AS y, 1e-5 AS mp FROM {n}1 d JOIN {n}c c ON c.pixel_id = d.pixel_id WHERE enough AND t >= lo AND t < hi)""" + strongest(f"{n}h", f"{n}k") + f""",
{n}f AS (SELECT d.pixel_id, min(d1) AS low FROM {n}1 d JOIN {n}k k ON k.pixel_id = d.pixel_id JOIN {n}c c ON c.pixel_id = d.pixel_id WHERE t BETWEEN lo AND pk GROUP BY 1),
{n}t AS (SELECT d.pixel_id, max(t) AS hit FROM {n}1 d JOIN {n}k k ON k.pixel_id = d.pixel_id JOIN {n}c c ON c.pixel_id = d.pixel_id JOIN {n}f f ON f.pixel_id = d.pixel_id
  WHERE t BETWEEN lo AND pk AND dx < low + 0.4::DOUBLE * (yp - low) GROUP BY 1),
{n}m AS (SELECT d.pixel_id, median(s) AS base FROM {n}1 d JOIN {n}c c ON c.pixel_id = d.pixel_id WHERE t >= b1 AND t < lo GROUP BY 1),
{n}o AS (SELECT c.*, pk, hit, base, s, yp * {RATE} AS slope FROM {n}c c LEFT JOIN {n}k k ON k.pixel_id = c.pixel_id LEFT JOIN {n}t f ON f.pixel_id = c.pixel_id LEFT JOIN {n}m m ON m.pixel_id = c.pixel_id
  LEFT JOIN {n}1 d ON d.pixel_id = c.pixel_id AND d.t = k.pk),
{n} AS (
  SELECT k.pixel_id, 'closest_peak_d1' AS rule, ttp, CASE WHEN a IS NULL THEN 'no anchor time' WHEN ttp IS NULL THEN 'no derivative peak in window' ELSE 'ok' END AS reason FROM {anchors} k LEFT JOIN {n}a q ON q.pixel_id = k.pixel_id
  UNION ALL SELECT k.pixel_id, 'zero_cross_d2', ttp, CASE WHEN a IS NULL THEN 'no anchor time' WHEN ttp IS NULL THEN 'no zero crossing in window' ELSE 'ok' END FROM {anchors} k LEFT JOIN {n}b q ON q.pixel_id = k.pixel_id
  UNION ALL SELECT k.pixel_id, 'cy0_after_plate', CASE WHEN pk IS NOT NULL AND lo - b1 >= 2 AND abs(slope) >= 1e-6 THEN pk / {RATE} + (base - s) / slope END,
    CASE WHEN k.a IS NULL THEN 'no anchor time' WHEN NOT enough THEN 'too few samples in window' WHEN pk IS NULL THEN 'no derivative peak in window' WHEN lo - b1 < 2 THEN 'baseline window too small'
      WHEN abs(slope) < 1e-6 THEN 'degenerate tangent slope' ELSE 'ok' END FROM {anchors} k LEFT JOIN {n}o o ON o.pixel_id = k.pixel_id
  UNION ALL SELECT k.pixel_id, 'thr_deriv_after_plate', hit / {RATE},
    CASE WHEN k.a IS NULL THEN 'no anchor time' WHEN NOT enough THEN 'too few samples in window' WHEN pk IS NULL THEN 'no derivative peak in window' WHEN hit IS NULL THEN 'no crossing below threshold' ELSE 'ok' END
    FROM {anchors} k LEFT JOIN {n}o o ON o.pixel_id = k.pixel_id)"""
