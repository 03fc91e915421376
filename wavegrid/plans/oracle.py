"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from wavegrid.operators.cwt import piecewise_scales
from wavegrid.plans.queries import BAND, BANKS, BLOCK, CUTOFF, FINE_HIGH, FINE_LOW, FINE_SCALES, FOLDER_COLUMNS, GRID_END, HIGH, KERNEL, LOW, LOW_BINS, MORLET, NAMES, SAMPLING, SCALES, SHARES, THRESHOLD, WINDOW

E_VOX = """vox AS (
  SELECT CAST(vec_id // 25 AS BIGINT) AS x, CAST(vec_id % 25 AS BIGINT) AS y, CAST(i % 2 AS BIGINT) AS c, CAST(i // 2 AS BIGINT) AS t,
         CAST(embedding[i + 1] AS DOUBLE) AS v
  FROM embeddings, range(64) AS r(i))"""
E_LAB = "lab AS (SELECT CAST(vec_id // 25 AS BIGINT) AS x, CAST(vec_id % 25 AS BIGINT) AS y, CAST(label + 1 AS BIGINT) AS label FROM embeddings)"
CEN = "cen AS (SELECT x, y, c, t, v - avg(v) OVER (PARTITION BY x, y, c) AS v FROM vox)"
AMP = """dft AS (
  SELECT x, y, c, CAST(k AS BIGINT) AS k, sum(v * cos(2 * pi() * ((k * t) % 32) / 32)) AS re, -sum(v * sin(2 * pi() * ((k * t) % 32) / 32)) AS im
  FROM cen, range(17) AS q(k) GROUP BY x, y, c, k),
amp AS (SELECT *, sqrt(re * re + im * im) AS a FROM dft)"""
SPEC = """spec AS (
  SELECT *, a / sum(a) OVER w AS na, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS z, atan2(im, re) AS ph
  FROM amp WINDOW w AS (PARTITION BY x, y, c))"""
PEAK = f"""own AS (
  SELECT x, y, c, k AS argmaxes FROM (
    SELECT x, y, c, k, row_number() OVER (PARTITION BY x, y, c ORDER BY round(na, 12) DESC, k) AS n FROM spec WHERE k >= {CUTOFF}) WHERE n = 1),
car AS (SELECT x, y, argmaxes AS k FROM own WHERE c = 0),
qry AS (
  SELECT s.x, s.y, s.c, own.argmaxes, s.a, s.na, s.z, s.ph - p.ph AS d
  FROM spec s JOIN car ON s.x = car.x AND s.y = car.y AND s.k = car.k
  JOIN own ON own.x = s.x AND own.y = s.y AND own.c = s.c
  JOIN spec p ON p.x = s.x AND p.y = s.y AND p.k = s.k AND p.c = 0)"""
E_SPEC = f"WITH {E_VOX}, {CEN}, {AMP}, {SPEC}"
E_QRY = f"{E_SPEC}, {PEAK}"


def r(value: str, name: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0 AS {name}"


def sd(f: str) -> str:
    return f"sqrt(var_pop({f}) * count({f}) / (greatest(count({f}) - 1, 1) + 1e-6))"


V_VOX = """evt AS (
  SELECT user_id, CAST((SELECT count(DISTINCT e.event_type) FROM events e WHERE e.event_type < events.event_type) AS BIGINT) AS c,
         CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS BIGINT) AS t, sum(value) AS v
  FROM events GROUP BY ALL),
vox AS (
  SELECT CAST(p.user_id // 10 AS BIGINT) AS x, CAST(p.user_id % 10 AS BIGINT) AS y, p.c, p.t, coalesce(evt.v, 0) AS v
  FROM (SELECT DISTINCT user_id, c, CAST(day AS BIGINT) AS t FROM evt, range((SELECT max(t) + 1 FROM evt)) AS d(day)) p
  LEFT JOIN evt ON evt.user_id = p.user_id AND evt.c = p.c AND evt.t = p.t)"""
L_VOX = """sal AS (
  SELECT l_suppkey AS s, CAST((SELECT count(DISTINCT e.l_returnflag) FROM lineitem e WHERE e.l_returnflag < lineitem.l_returnflag) AS BIGINT) AS c,
         CAST(date_diff('month', (SELECT min(l_shipdate) FROM lineitem), l_shipdate) AS BIGINT) AS t, sum(l_extendedprice) / 1e5 AS v
  FROM lineitem GROUP BY ALL),
vox AS (
  SELECT CAST(p.s // 10 AS BIGINT) AS x, CAST(p.s % 10 AS BIGINT) AS y, p.c, p.t, coalesce(sal.v, 0) AS v
  FROM (SELECT DISTINCT s, c, CAST(m AS BIGINT) AS t FROM sal, range((SELECT max(t) + 1 FROM sal)) AS d(m)) p
  LEFT JOIN sal ON sal.s = p.s AND sal.c = p.c AND sal.t = p.t)"""
L_LAB = "lab AS (SELECT CAST(s_suppkey // 10 AS BIGINT) AS x, CAST(s_suppkey % 10 AS BIGINT) AS y, CAST(s_nationkey + 1 AS BIGINT) AS label FROM supplier)"

THRESH = f"thresh_queried_normalized_amplitude_at_{THRESHOLD}"
MASKS = f"""msk AS (
  SELECT 'all' AS mask_name, x, y, label FROM lab
  UNION ALL
  SELECT '{THRESH}', lab.x, lab.y, CASE WHEN q.na > {THRESHOLD} THEN lab.label ELSE 0 END FROM lab LEFT JOIN (SELECT * FROM qry WHERE c = 0) q ON q.x = lab.x AND q.y = lab.y)"""
ALL_MASK = "msk AS (SELECT 'all' AS mask_name, x, y, label FROM lab)"
CELL = {"queried_amplitude": "a", "queried_normalized_amplitude": "na", "queried_z_score": "z"}


def cell_sql(masks: str, features: dict[str, str], floor: bool = False, levels: bool = False) -> str:
    """CTEs up to `cel` (mask_name, label, c, feature, stat, value)."""
    parts = []
    for f, col in features.items():
        mean = f"floor(sum({col}) / count({col}))" if floor else f"avg({col})"
        parts += [f"SELECT mask_name, label, c, '{f}' AS feature, 'mean' AS stat, CAST({mean} AS DOUBLE) AS value FROM jnd GROUP BY ALL"]
        parts += [f"SELECT mask_name, label, c, '{f}', 'sd', {sd(col)} FROM jnd GROUP BY ALL"]
    kinds = [f"('{f}', '{s}')" for f in features for s in ("mean", "sd")]
    if levels:
        parts += ["SELECT mask_name, label, c, 'levels', 'mean', avg(v) FROM lvl JOIN msk USING (x, y) GROUP BY ALL"]
        kinds += ["('levels', 'mean')"]
    return f"""{masks}, jnd AS (SELECT msk.mask_name, msk.label, qry.* FROM qry JOIN msk ON qry.x = msk.x AND qry.y = msk.y),
{"lvl AS (SELECT x, y, c, avg(v) AS v FROM vox GROUP BY ALL)," if levels else ""}
sta AS ({" UNION ALL ".join(parts)}),
dom AS (
  SELECT m.mask_name, CAST(l AS BIGINT) AS label, c.c, k.feature, k.stat
  FROM (SELECT DISTINCT mask_name FROM msk) m, (SELECT unnest(range(0, (SELECT max(label) + 1 FROM msk))) AS l), (SELECT DISTINCT c FROM qry) c, (VALUES {", ".join(kinds)}) k(feature, stat)),
cel AS (
  SELECT dom.*, coalesce(sta.value, 0) AS value FROM dom LEFT JOIN sta
  ON dom.mask_name = sta.mask_name AND dom.label = sta.label AND dom.c = sta.c AND dom.feature = sta.feature AND dom.stat = sta.stat)"""


CELL_OUT = f"SELECT mask_name, label, c, feature, stat, {r('value', 'value')} FROM cel"
WIDE = f"{E_QRY}, {E_LAB}, {cell_sql(MASKS, {'queried_amplitude': 'a', 'queried_normalized_amplitude': 'na', 'argmaxes': 'argmaxes'}, levels=True)}"
WIDE = WIDE.replace("CAST(avg(argmaxes) AS DOUBLE)", "CAST(floor(sum(argmaxes) / count(argmaxes)) AS DOUBLE)")


def wide_column(feature: str, stat: str, c: int, mask: str) -> str:
    name = f"{NAMES[c]}_{feature}_{stat}" + ("" if mask == "all" else f"___{mask}")
    return f"round(max(CASE WHEN feature = '{feature}' AND stat = '{stat}' AND c = {c} AND mask_name = '{mask}' THEN value END), 6) + 0.0 AS \"{name}\""


KINDS = [(f, s) for f in ("queried_amplitude", "queried_normalized_amplitude", "argmaxes") for s in ("mean", "sd")] + [("levels", "mean")]
LEVELS = """lev AS (SELECT x, y, c, avg(v) AS v FROM vox GROUP BY ALL),
dom AS (SELECT CAST(l AS BIGINT) AS label, c.c FROM (SELECT unnest(range(0, (SELECT max(label) + 1 FROM lab))) AS l), (SELECT DISTINCT c FROM vox) c),
cel AS (
  SELECT dom.label, dom.c, coalesce(s.v, 0) AS value FROM dom
  LEFT JOIN (SELECT label, c, avg(v) AS v FROM lev JOIN lab USING (x, y) GROUP BY ALL) s ON s.label = dom.label AND s.c = dom.c)"""

HALF = "(SELECT CAST(round_even((max(x) + 1) * 0.5, 0) AS BIGINT) AS h, CAST(round_even((max(y) + 1) * 0.5, 0) AS BIGINT) AS w, max(x) + 1 AS big_h, max(y) + 1 AS big_w FROM {0}) d"
#: Coefficients of the turbo colour map's published polynomials (fixed values).
TURBO = {
    "r": "0.13572138 4.61539260 -42.66032258 132.13108234 -152.94239396 59.28637943",
    "g": "0.09140261 2.19418839 4.84296658 -14.18503333 4.27729857 2.82956604",
    "b": "0.10667330 12.64194608 -60.58204836 110.36276771 -89.90310912 27.34824973",
}
LUT = ", ".join(f"least(1.0, greatest(0.0, {' + '.join(f'({a}) * pow(u, {k})' for k, a in enumerate(v.split()))})) AS {n}" for n, v in TURBO.items())
COLOURS = f"lut AS (SELECT t, {LUT} FROM (SELECT DISTINCT t, t / (max(t) OVER ())::DOUBLE AS u FROM vox))"
MINMAX = "ends AS (SELECT min(v) AS lo, max(v) AS hi FROM vox), nrm AS (SELECT x, y, c, t, (v - lo) / (hi - lo) AS v FROM vox, ends)"


def color_sql(proj: str) -> str:
    return f"""WITH {V_VOX}, {MINMAX}, {COLOURS}
SELECT x, y, c, {", ".join(r(f"{proj}(v * {n})", n) for n in "rgb")} FROM nrm JOIN lut USING (t) GROUP BY x, y, c"""


GAIN = "2 * exp(60.0 / 3.0 * (1 + ln(3.0 / 60.0)) + 60 * ln(s * 2 * pi() * k / {n}) - pow(s * 2 * pi() * k / {n}, 3))"
LISTS = "sig AS MATERIALIZED (SELECT x, y, c, list(v ORDER BY t) AS v FROM cen GROUP BY x, y, c)"


MORLET_GAIN = f"2 * (exp(-0.5 * pow(s * 2 * pi() * k / {{n}} - {MORLET}, 2)) - exp(-0.5 * (pow({MORLET}, 2) + pow(s * 2 * pi() * k / {{n}}, 2))))"


def wave_ctes(n: int = 32, left: int = 0, more: str = "", gain: str = GAIN, scales=tuple(enumerate(SCALES)), low: int = LOW, high: int = HIGH) -> str:
    """From sig (lists of n samples, the first `left` of them padding): coefficients as products with one kernel for each scale and frame.

    more: columns over all scales of a pixel, channel and frame (window w), where they are read.
    """
    gain, angle = gain.format(n=n), f"2 * pi() * ((k * (t + {left} - u + {n})) % {n}) / {n}"
    wide = f"(SELECT *, {more} FROM cof WINDOW w AS (PARTITION BY x, y, c, t))" if more else "cof"
    return f"""scl(i, s) AS (VALUES {", ".join(f"({i}, {s!r})" for i, s in scales)}),
ker AS MATERIALIZED (
  SELECT i, t, list(re ORDER BY u) AS re, list(im ORDER BY u) AS im FROM (
    SELECT CAST(i AS BIGINT) AS i, CAST(t AS BIGINT) AS t, u, sum(({gain}) * cos({angle})) / {n} AS re, sum(({gain}) * sin({angle})) / {n} AS im
    FROM scl, range(1, {n // 2 + 1}) AS q(k), range(32) AS p(t), range({n}) AS o(u) {"" if more else f"WHERE i >= {low} AND i < {high}"} GROUP BY ALL) GROUP BY i, t),
cof AS (
  SELECT *, sqrt(wr * wr + wi * wi) AS a FROM (SELECT x, y, c, i, t, list_dot_product(v, re) AS wr, list_dot_product(v, im) AS wi FROM sig, ker)),
sub AS MATERIALIZED (SELECT *, i - {low} AS j FROM {wide} WHERE i >= {low} AND i < {high})"""


WAVE = f"WITH {E_VOX}, {CEN}, {LISTS}, {wave_ctes()}"
#: Frames normalised and series centred, then padded by reflection from 32 to 64 samples.
PADDED = f"""WITH {E_VOX}, nrm AS (SELECT x, y, c, t, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM vox WINDOW w AS (PARTITION BY c, t)),
cen AS (SELECT x, y, c, t, v - avg(v) OVER (PARTITION BY x, y, c) AS v FROM nrm), {LISTS.replace("sig AS", "raw AS")},
sig AS MATERIALIZED (SELECT x, y, c, list_transform(range(64), lambda u: v[CAST(CASE WHEN u < 16 THEN 17 - u WHEN u < 48 THEN u - 15 ELSE 79 - u END AS BIGINT)]) AS v FROM raw), {wave_ctes(64, 16)}"""
#: All 16 scales of cwt_freq_hz, and what they have in common at a pixel and frame.
FINE = f"WITH {E_VOX}, {CEN}, {LISTS}, {wave_ctes(more='avg(a) OVER w AS m, stddev_samp(a) OVER w AS sd', scales=tuple(enumerate(FINE_SCALES)), low=FINE_LOW, high=FINE_HIGH)}"
#: The default grid's scales that cwt_default_grid reads.
DEFAULT_GRID = [(k, float(v)) for k, v in enumerate(piecewise_scales(32)) if 80 <= k < GRID_END]
CARRIER_AT = "crr AS (SELECT x, y, t, i FROM (SELECT *, row_number() OVER (PARTITION BY x, y, t ORDER BY a DESC, i) AS n FROM sub WHERE c = 0) WHERE n = 1)"
POOL = HIGH - LOW
BANK_ROWS = ", ".join(f"({b}, {b * POOL // BANKS}, {-(-(b + 1) * POOL // BANKS)})" for b in range(BANKS))


AT_CARRIER = "FROM sub s JOIN crr ON s.x = crr.x AND s.y = crr.y AND s.t = crr.t AND s.i = crr.i"


def wave_sql(*values: str, ctes: str = WAVE, where: str = "true") -> str:
    return f"{ctes}, {CARRIER_AT} SELECT s.x, s.y, s.c, s.t, {', '.join(values)} {AT_CARRIER} WHERE {where}"


def track_sql(label: str) -> str:
    return f"""WITH {V_VOX}, stt AS (
  SELECT {label} AS label, c, t, avg(v) AS mean, {sd("v")} AS sd FROM vox GROUP BY ALL),
top AS (SELECT max(label) AS top FROM stt),
dom AS (SELECT CAST(l AS BIGINT) AS label, c.c, CAST(t AS BIGINT) AS t FROM (SELECT unnest(range(0, (SELECT top + 1 FROM top))) AS l), (SELECT DISTINCT c FROM vox) c, range((SELECT max(t) + 1 FROM vox)) AS q(t))
SELECT dom.label, dom.c, dom.t, {r("coalesce(mean, 0)", "mean")}, {r("coalesce(sd, 0)", "sd")} FROM dom LEFT JOIN stt ON dom.label = stt.label AND dom.c = stt.c AND dom.t = stt.t"""


DOWNSAMPLED = f"""WITH {E_VOX}, d AS (SELECT * FROM {HALF.format("vox")}),
nx AS (SELECT CAST(i AS BIGINT) AS nx, i * big_h // h AS a, ((i + 1) * big_h + h - 1) // h AS b FROM d, range((SELECT h FROM d)) AS q(i)),
ny AS (SELECT CAST(i AS BIGINT) AS ny, i * big_w // w AS a, ((i + 1) * big_w + w - 1) // w AS b FROM d, range((SELECT w FROM d)) AS q(i))
SELECT nx AS x, ny AS y, c, t, {r("avg(v)", "value")} FROM vox JOIN nx ON x >= nx.a AND x < nx.b JOIN ny ON y >= ny.a AND y < ny.b GROUP BY nx, ny, c, t"""

FOLDER_CELLS = f"""{E_QRY}, {E_LAB}, jnd AS (SELECT lab.label, lab.x // {BAND} AS band, q.c, q.a, q.argmaxes FROM qry q JOIN lab ON q.x = lab.x AND q.y = lab.y),
lev AS (SELECT lab.label, lab.x // {BAND} AS band, c, avg(v) AS v FROM (SELECT x, y, c, avg(v) AS v FROM vox GROUP BY ALL) JOIN lab USING (x, y) GROUP BY ALL),
sta AS (SELECT band, label, c, avg(a) AS mean, {sd("a")} AS sd, floor(sum(argmaxes) / count(argmaxes)) AS peak FROM jnd GROUP BY ALL),
dom AS (SELECT band, unnest(range(0, top + 1)) AS label FROM (SELECT x // {BAND} AS band, max(label) AS top FROM lab GROUP BY ALL))
SELECT dom.band || '.tif' AS image_filename, dom.band || '_masks.tif' AS mask_filename, CAST(dom.label AS BIGINT) AS mask_index,
  {r("coalesce(a.mean, 0)", "a_queried_amplitude_mean")}, {r("coalesce(b.sd, 0)", "b_queried_amplitude_sd")}, {r("coalesce(b.peak, 0)", "b_argmaxes_mean")}, {r("coalesce(l.v, 0)", "a_levels_mean")}
FROM dom LEFT JOIN sta a ON a.band = dom.band AND a.label = dom.label AND a.c = 0 LEFT JOIN sta b ON b.band = dom.band AND b.label = dom.label AND b.c = 1
LEFT JOIN lev l ON l.band = dom.band AND l.label = dom.label AND l.c = 0"""

K0, K1, K2 = KERNEL
ORACLE_SQL = {
    "series_mean_center": f"WITH {E_VOX}, {CEN} SELECT x, y, c, t, {r('v', 'value')} FROM cen",
    "frame_normalize": f"WITH {V_VOX} SELECT x, y, c, t, {r('(v - avg(v) OVER w) / stddev_samp(v) OVER w', 'value')} FROM vox WINDOW w AS (PARTITION BY c, t)",
    "fft_full_amplitude": f"{E_SPEC} SELECT x, y, c, k, {r('a', 'value')} FROM spec",
    "fft_by_join": f"{E_SPEC} SELECT x, y, c, k, {r('a', 'value')} FROM spec",
    "fft_normalized_amplitude": f"{E_SPEC} SELECT x, y, c, k, {r('na', 'value')} FROM spec",
    "fft_z_score": f"{E_SPEC} SELECT x, y, c, k, {r('z', 'value')} FROM spec",
    "fft_max_bin": f"{E_SPEC} SELECT x, y, c, k, {r('na', 'value')} FROM spec WHERE k < 6",
    "fft_phase": f"{E_SPEC} SELECT x, y, c, k, {r('cos(ph)', 'cos_phase')}, {r('sin(ph)', 'sin_phase')} FROM spec WHERE k BETWEEN 1 AND 15",
    "fft_constant_pixel": f"""WITH {E_VOX.replace("vox AS", "all_vox AS")}, vox AS (SELECT * FROM all_vox UNION ALL SELECT -1, -1, 0, CAST(t AS BIGINT), 1.0 FROM range(32) AS q(t)), {CEN}, {AMP}
SELECT x, y, c, sum(a) = 0 AS undefined, {r("max(a)", "largest")} FROM amp GROUP BY x, y, c""",
    "fft_peak": f"{E_QRY} SELECT x, y, c, argmaxes, {r('na', 'value')} FROM qry",
    "fft_query_features": f"""{E_QRY} SELECT x, y, c, argmaxes, {r("a", "amplitude")}, {r("na", "normalized_amplitude")}, {r("z", "z_score")},
  {r("cos(d)", "cos_difference")}, {r("sin(d)", "sin_difference")} FROM qry""",
    "fft_frequencies": f"{E_QRY} SELECT x, y, c, {r(f'argmaxes * {SAMPLING.fs} / {SAMPLING.N}.0', 'frequency')} FROM qry",
    "threshold_mask": f"{E_QRY}, {E_LAB}, {MASKS} SELECT mask_name, x, y, CAST(label AS BIGINT) AS label FROM msk",
    "cell_stats": f"{E_QRY}, {E_LAB}, {cell_sql(ALL_MASK, CELL)} {CELL_OUT}",
    "cell_stats_thresholded": f"{E_QRY}, {E_LAB}, {cell_sql(MASKS, CELL)} {CELL_OUT}",
    "cell_levels": f"WITH {L_VOX}, {L_LAB}, {LEVELS} SELECT label, c, {r('value', 'value', 4)} FROM cel",
    "cell_argmax_floor_mean": f"{E_QRY}, {E_LAB}, {cell_sql(ALL_MASK, {'argmaxes': 'argmaxes'}, floor=True)} {CELL_OUT}",
    "cells_wide": f"{WIDE} SELECT label AS mask_index, {', '.join(wide_column(f, s, c, m) for m in ('all', THRESH) for f, s in KINDS for c in (0, 1))} FROM cel GROUP BY label",
    "cells_long": f"{WIDE} SELECT label AS mask_index, CASE c WHEN 0 THEN 'a' ELSE 'b' END AS channel, feature, stat, mask_name AS mask_type, {r('value', 'value')} FROM cel",
    "batch_union": f"""WITH ea AS (WITH {E_VOX}, {E_LAB}, {LEVELS} SELECT 'E' AS image_filename, * FROM cel), la AS (WITH {L_VOX}, {L_LAB}, {LEVELS} SELECT 'L' AS image_filename, * FROM cel)
SELECT image_filename, label AS mask_index, {", ".join(f"round(max(CASE WHEN c = {k} THEN value END), 4) + 0.0 AS {n}_levels_mean" for k, n in enumerate("abd"))}
FROM (SELECT * FROM ea UNION ALL SELECT * FROM la) GROUP BY image_filename, label""",
    "downsample_image": DOWNSAMPLED,
    "frames_downsample": DOWNSAMPLED,
    "frames_normalize": f"WITH {E_VOX} SELECT x, y, c, t, {r('(v - avg(v) OVER w) / stddev_samp(v) OVER w', 'value')} FROM vox WINDOW w AS (PARTITION BY c, t)",
    "downsample_scales": f"""WITH {E_VOX}, d AS (SELECT k AS scale, CAST(round_even((max(x) + 1) * f, 0) AS BIGINT) AS h, CAST(round_even((max(y) + 1) * f, 0) AS BIGINT) AS w, max(x) + 1 AS big_h, max(y) + 1 AS big_w
  FROM vox, (VALUES {", ".join(f"({k}, {f})" for k, f in enumerate(SHARES))}) q(k, f) GROUP BY k, f),
nx AS (SELECT scale, CAST(i AS BIGINT) AS nx, i * big_h // h AS a, ((i + 1) * big_h + h - 1) // h AS b FROM d, range(1000) AS q(i) WHERE i < h),
ny AS (SELECT scale, CAST(i AS BIGINT) AS ny, i * big_w // w AS a, ((i + 1) * big_w + w - 1) // w AS b FROM d, range(1000) AS q(i) WHERE i < w)
SELECT CAST(nx.scale AS BIGINT) AS scale, nx AS x, ny AS y, c, t, {r("avg(v)", "value")} FROM nx JOIN ny ON nx.scale = ny.scale JOIN vox ON x >= nx.a AND x < nx.b AND y >= ny.a AND y < ny.b GROUP BY nx.scale, nx, ny, c, t""",
    "fft_long_series": f"""WITH n AS (SELECT (max(event_id) // {BLOCK} + 1) * {BLOCK} AS n FROM events),
z AS (SELECT CAST(k AS BIGINT) AS k, sum(value * cos(2 * pi() * ((k * event_id) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * event_id) % n) / n)) AS im FROM events, n, range({LOW_BINS}) AS q(k) GROUP BY k)
SELECT k, CASE WHEN k = 0 THEN 0.0 ELSE {r("sqrt(re * re + im * im)", "value", 4).removesuffix(" AS value")} END AS value FROM z""",
    "stream_spectrum": f"""WITH {E_VOX}, last AS (SELECT x, y, c, t - {32 - WINDOW} AS t, v - avg(v) OVER (PARTITION BY x, y, c) AS v FROM vox WHERE t >= {32 - WINDOW}),
dft AS (SELECT x, y, c, CAST(k AS BIGINT) AS k, sum(v * cos(2 * pi() * ((k * t) % {WINDOW}) / {WINDOW})) AS re, -sum(v * sin(2 * pi() * ((k * t) % {WINDOW}) / {WINDOW})) AS im
  FROM last, range({WINDOW // 2 + 1}) AS q(k) GROUP BY x, y, c, k)
SELECT x, y, c, k, {r("sqrt(re * re + im * im)", "value")} FROM dft""",
    "downsample_mask": f"""WITH {E_LAB}, d AS (SELECT * FROM {HALF.format("lab")})
SELECT CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y, label FROM d, range((SELECT h FROM d)) AS q(i), range((SELECT w FROM d)) AS p(j), lab
WHERE lab.x = i * big_h // h AND lab.y = j * big_w // w""",
    "convolve_time": f"""WITH {L_VOX} SELECT x, y, c, t, {r(f"{K0} * lag(v, 1, 0.0) OVER w + {K1} * v + {K2} * lead(v, 1, 0.0) OVER w", "value", 10)} FROM vox WINDOW w AS (PARTITION BY x, y, c ORDER BY t)""",
    "minmax_norm": f"WITH {V_VOX}, {MINMAX} SELECT x, y, c, t, {r('v', 'value')} FROM nrm",
    "color_projection_max": color_sql("max"),
    "color_projection_sum": color_sql("sum"),
    "cwt_amp": wave_sql(r("s.a", "value")),
    "cwt_freq_index": wave_sql(r("CAST(s.i AS DOUBLE)", "value")),
    "cwt_z_score": wave_sql(r("(s.a - s.m) / s.sd", "value"), ctes=f"WITH {E_VOX}, {CEN}, {LISTS}, {wave_ctes(more='avg(a) OVER w AS m, stddev_samp(a) OVER w AS sd')}"),
    "cwt_phase_difference": f"""{WAVE}, {CARRIER_AT}
SELECT s.x, s.y, s.c, s.t, {r("cos(atan2(s.wi, s.wr) - atan2(p.wi, p.wr))", "cos_difference")}, {r("sin(atan2(s.wi, s.wr) - atan2(p.wi, p.wr))", "sin_difference")}
FROM sub s JOIN crr ON s.x = crr.x AND s.y = crr.y AND s.t = crr.t AND s.i = crr.i JOIN sub p ON p.x = s.x AND p.y = s.y AND p.t = s.t AND p.i = s.i AND p.c = 0""",
    "cwt_bank_maxpool": f"""{WAVE}, bnk(bank, lo, hi) AS (VALUES {BANK_ROWS}),
crr AS (SELECT x, y, t, bank, i FROM (SELECT *, row_number() OVER (PARTITION BY x, y, t, bank ORDER BY a DESC, i) AS n FROM sub JOIN bnk ON j >= lo AND j < hi WHERE c = 0) WHERE n = 1)
SELECT s.x, s.y, s.c, CAST(crr.bank AS BIGINT) AS bank, s.t, {r("s.a", "value")} FROM sub s JOIN crr ON s.x = crr.x AND s.y = crr.y AND s.t = crr.t AND s.i = crr.i""",
    "cwt_bank_sort": f"""{WAVE}, crr AS (SELECT x, y, t, i, n - 1 AS bank FROM (SELECT *, row_number() OVER (PARTITION BY x, y, t ORDER BY a DESC, i) AS n FROM sub WHERE c = 0) WHERE n <= {BANKS})
SELECT s.x, s.y, s.c, CAST(crr.bank AS BIGINT) AS bank, s.t, {r("s.a", "value")} FROM sub s JOIN crr ON s.x = crr.x AND s.y = crr.y AND s.t = crr.t AND s.i = crr.i""",
    "cwt_phase": wave_sql(r("s.wr / s.a", "cos_phase"), r("s.wi / s.a", "sin_phase")),
    "cwt_freq_hz": wave_sql(r(f"pow(20.0, 1 / 3.0) / (SELECT s FROM scl WHERE scl.i = s.i) / (2 * pi()) * {SAMPLING.fs}", "value"), ctes=FINE),
    "cwt_normalized_amp": wave_sql(r("s.p", "value"), ctes=f"WITH {E_VOX}, {CEN}, {LISTS}, {wave_ctes(more='a / sum(a) OVER w AS p')}"),
    "cwt_default_preprocessing": wave_sql(r("s.a", "value", 5), ctes=PADDED),
    "cwt_morlet": wave_sql(r("s.a", "value"), ctes=f"WITH {E_VOX}, {CEN}, {LISTS}, {wave_ctes(gain=MORLET_GAIN)}"),
    "cwt_default_grid": wave_sql(r("s.a", "value"), ctes=f"WITH {E_VOX}, {CEN}, {LISTS.replace('FROM cen', 'FROM cen WHERE c = 0')}, {wave_ctes(scales=DEFAULT_GRID, low=80, high=GRID_END)}"),
    "cwt_channel_outputs": f"""{WAVE}, {CARRIER_AT}
SELECT s.x, s.y, CASE s.c WHEN 0 THEN 'a' ELSE 'b' END AS channel, o AS output, s.t, {r("CASE o WHEN 'freq' THEN s.i ELSE s.a END", "value")} {AT_CARRIER}
JOIN (VALUES (0, 'freq'), (1, 'amp')) q(c, o) ON q.c = s.c""",
    "cwt_as_series": f"""{WAVE}, {CARRIER_AT} SELECT s.x, s.y, CAST(1 - s.c AS BIGINT) AS c, s.t, {r("s.a", "value")} {AT_CARRIER}""",
    "fft_peak_fallback": f"""{E_QRY.replace("round(na, 12)", "round(z, 12)")} SELECT x, y, c, argmaxes, {r('z', 'value')} FROM qry""",
    "track_mean_sd": track_sql("CAST((x * 10 + y) % 7 + 1 AS BIGINT)"),
    "track_moving_mask": track_sql("CAST((x * 10 + y + t) % 7 + 1 AS BIGINT)"),
    "file_pairing": """SELECT n_name || '.v1.' || CASE WHEN n_regionkey = 0 THEN 'nd2' ELSE 'tif' END AS image_filename, n_name || '.v1_masks.tif' AS mask_filename, n_nationkey % 2 = 0 AS found FROM nation""",
    "tiff_deflate": f"WITH {E_VOX} SELECT x, y, c, t, {r('v', 'value')} FROM vox",
    "tiff_singleton_channel": f"WITH {E_VOX} SELECT x, y, c, t, {r('v', 'value')} FROM vox WHERE c = 0",
    "mask_scan": f"""WITH {E_LAB}, wide AS (SELECT max(y) + 1 AS w, max(x) + 1 AS h FROM lab)
SELECT i // {BAND} || '_masks.tif' AS mask_filename, CAST(i % {BAND} AS BIGINT) AS x, CAST(j AS BIGINT) AS y, coalesce(lab.label, 0) AS label
FROM range((SELECT h FROM wide)) AS p(i) CROSS JOIN range((SELECT w FROM wide)) AS q(j) LEFT JOIN lab ON lab.x = i AND lab.y = j""",
    "folder_cells": FOLDER_CELLS,
    "folder_increments": f"""SELECT image_filename, band % 2 AS batch, mask_index, {", ".join(FOLDER_COLUMNS)}
FROM (SELECT *, CAST(string_split(image_filename, '.')[1] AS BIGINT) AS band FROM ({FOLDER_CELLS}))""",
    "folder_problems": """WITH b AS (SELECT max(vec_id % 25) + 1 AS w FROM embeddings)
SELECT n_name || CASE WHEN n_nationkey % 6 = 4 THEN '.nd2' ELSE '.tif' END AS image_filename, CASE n_nationkey % 6
  WHEN 0 THEN 'no mask file ' || n_name || '_masks.tif' WHEN 1 THEN 'ValueError: not a TIFF file'
  WHEN 2 THEN 'a mask of 2 frames; one is expected' WHEN 3 THEN 'an image of 1 channels; 2 are expected' WHEN 4 THEN 'ValueError: not an ND2 file'
  ELSE 'a mask of 7 x ' || w || ' pixels for an image of 8 x ' || w END AS error FROM nation, b""",
    "stack_scan": f"WITH {E_VOX} SELECT x, y, c, t, {r('v', 'value')} FROM vox",
    "stack_filtered": f"WITH {E_VOX} SELECT x, y, c, t, {r('v', 'value')} FROM vox WHERE c = 1 AND t >= 8 AND t < 16",
    "nd2_scan": f"WITH {E_VOX} SELECT x, y, c, t, CAST(floor((v + 2) * 10000) AS DOUBLE) AS value FROM vox",
    "nd2_stack_scan": f"WITH {E_VOX} SELECT x, y, c, t, CAST(floor((v + 2) * 10000) AS DOUBLE) AS value FROM vox WHERE c = 1",
    "tiff_roundtrip": f"WITH {E_VOX} SELECT x, y, c, t, {r('v', 'value')} FROM vox",
}
