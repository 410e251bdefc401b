"""Common table expressions of the SQL equivalents (DuckDB), by name; each builds on the ones before."""

import re

START, DURATION = 100.0, 400.0
STOP = START + DURATION

ONSET_SELECT = "SELECT user_id AS track_id, event_id, event_type, value, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9 AS t FROM events"
ONSETS = f"WITH onsets AS ({ONSET_SELECT}), downs AS (SELECT DISTINCT track_id, t FROM onsets WHERE event_type = 'click')"
BARS = f"""{ONSETS}, bars0 AS (SELECT track_id, row_number() OVER w - 1 AS bar, t AS bstart, lead(t) OVER w AS bend FROM downs WINDOW w AS (PARTITION BY track_id ORDER BY t)),
bars AS (SELECT *, CASE WHEN bend - bstart > 1e-6 THEN 60.0 / (bend - bstart) * 4 ELSE 0 END AS tempo_bpm FROM bars0 WHERE bend IS NOT NULL)"""
ORDERS = "WITH odays AS (SELECT o_custkey AS track_id, o_orderkey AS tie, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS t FROM orders)"
ORDER_BARS = f"""{ORDERS}, ob AS (SELECT track_id, row_number() OVER w - 1 AS bar, t AS bstart, lead(t) OVER w AS bend FROM odays WINDOW w AS (PARTITION BY track_id ORDER BY t, tie)),
obars AS (SELECT *, CASE WHEN bend - bstart > 1e-6 THEN 60.0 / (bend - bstart) * 4 ELSE 0 END AS tempo_bpm FROM ob WHERE bend IS NOT NULL)"""
BEATS = f"""{BARS}, bt AS (SELECT DISTINCT track_id, t FROM onsets WHERE event_type IN ('click', 'view')), btn AS (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS global_beat FROM bt),
dn AS (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS k FROM downs), j AS (SELECT b.track_id, b.t, CAST(global_beat AS INT) AS global_beat, d.t AS d, CAST(coalesce(d.k, 0) AS INT) AS bar_num FROM btn b ASOF LEFT JOIN dn d ON b.track_id = d.track_id AND b.t >= d.t),
btable AS (SELECT track_id, t AS beat_time, coalesce(d, 0.0) AS downbeat_time, CAST(CASE WHEN bar_num = 0 THEN 0 ELSE row_number() OVER (PARTITION BY track_id, bar_num ORDER BY t) END AS INT) AS beat_pos, global_beat, bar_num FROM j)"""


def signature(table: str) -> str:
    return f"""pb AS (SELECT track_id, bar_num, max(beat_pos) AS n FROM {table} WHERE bar_num >= 1 GROUP BY 1, 2), pc AS (SELECT track_id, n, count(*) AS c, min(bar_num) AS f FROM pb GROUP BY 1, 2),
best AS (SELECT track_id, arg_max(n, (c, -f)) AS n FROM pc GROUP BY 1)"""


CLASSES = f"""{BARS}, b1 AS (SELECT track_id, median(tempo_bpm) AS base, CASE WHEN count(*) FILTER (tempo_bpm > 135) * 2 > count(*) THEN median(tempo_bpm) FILTER (tempo_bpm > 135) / 2 END AS over_ FROM bars GROUP BY 1),
b2 AS (SELECT bars.*, base, over_, coalesce(over_, base) AS b FROM bars JOIN b1 USING (track_id)),
b3 AS (SELECT *, CASE WHEN tempo_bpm BETWEEN b * (0.5::DOUBLE * (1.0::DOUBLE - 0.1::DOUBLE)) AND b * (0.5::DOUBLE * (1.0::DOUBLE + 0.1::DOUBLE)) THEN 'half' WHEN tempo_bpm BETWEEN b * (2.0::DOUBLE * (1.0::DOUBLE - 0.1::DOUBLE)) AND b * (2.0::DOUBLE * (1.0::DOUBLE + 0.1::DOUBLE)) THEN 'double' ELSE 'normal' END AS class FROM b2),
b4 AS (SELECT *, count(*) FILTER (class = 'normal') OVER w AS nn, count(*) FILTER (class = 'double') OVER w AS nd, count(*) FILTER (class = 'half') OVER w AS nh FROM b3 WINDOW w AS (PARTITION BY track_id)),
classed AS (SELECT *, CASE WHEN nn >= nd + nh THEN 'normal' ELSE 'factor2' END AS dominant, CASE WHEN nn >= nd + nh THEN '' WHEN nd >= nh THEN 'double' ELSE 'half' END AS orientation FROM b4)"""
REPAIRED = f"""{CLASSES}, a1 AS (SELECT *, CASE WHEN dominant = 'normal' AND class = 'double' THEN 'merge' WHEN dominant = 'normal' AND class = 'half' THEN 'split' WHEN dominant = 'factor2' AND class = 'normal' THEN CASE orientation WHEN 'double' THEN 'split' ELSE 'merge' END ELSE 'unchanged' END AS act FROM classed),
a2 AS (SELECT *, sum(CASE WHEN act <> 'merge' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY bar ROWS UNBOUNDED PRECEDING) AS island FROM a1),
a3 AS (SELECT *, act = 'merge' AND sum(CASE WHEN act = 'merge' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, island ORDER BY bar ROWS UNBOUNDED PRECEDING) % 2 = 1 AS head FROM a2),
a4 AS (SELECT *, coalesce(lag(head) OVER w, false) AS taken, lead(bend) OVER w AS next_end FROM a3 WINDOW w AS (PARTITION BY track_id ORDER BY bar)),
pieces AS (
SELECT track_id, base, over_, dominant, orientation, bstart, CASE WHEN head THEN coalesce(next_end, bend) ELSE bend END AS stop, CASE WHEN head AND next_end IS NOT NULL THEN 'merged' WHEN head THEN 'merge_impossible_tail' WHEN act = 'split' THEN 'split_A' ELSE 'unchanged' END AS action,
CASE WHEN head AND next_end IS NOT NULL THEN [bar + 1, bar + 2] ELSE [bar + 1] END AS src, CASE WHEN head AND next_end IS NOT NULL THEN bend END AS removed, CASE WHEN act = 'split' THEN (bstart + bend) / 2 END AS inserted FROM a4 WHERE NOT taken
UNION ALL SELECT track_id, base, over_, dominant, orientation, (bstart + bend) / 2, bend, 'split_B', [bar + 1], NULL, (bstart + bend) / 2 FROM a4 WHERE NOT taken AND act = 'split'),
fixed AS (SELECT track_id, base, over_, dominant, orientation, bstart, coalesce(lead(bstart) OVER w, stop) AS bend, action, src, removed, inserted, CAST(row_number() OVER w AS INT) AS corrected_bar_num FROM pieces WINDOW w AS (PARTITION BY track_id ORDER BY bstart))"""
USABLE = """us AS (SELECT *, CASE WHEN bend - bstart > 1e-6 THEN 60.0 / (bend - bstart) * 4 ELSE 0 END AS tempo_bpm, coalesce(over_, base * CASE WHEN dominant = 'factor2' AND orientation = 'double' THEN 2.0 WHEN dominant = 'factor2' THEN 0.5 ELSE 1.0 END) AS ubase FROM fixed),
usable AS (SELECT *, tempo_bpm BETWEEN ubase * (1.0::DOUBLE - 0.1::DOUBLE) AND ubase * (1.0::DOUBLE + 0.1::DOUBLE) AS usable, CASE WHEN over_ IS NOT NULL THEN '135.0' ELSE 'none' END AS bpm_threshold FROM us)"""


def nearest(targets: str, points: str, columns: list[str]) -> str:
    """near_<targets>: the targets (track_id, columns with g) with nearest and distance among points (track_id, t)."""
    own = ", ".join(f"x.{c}" for c in columns)
    return f"""near0_{targets} AS (SELECT x.track_id, {own}, CASE WHEN n.t IS NULL OR x.g - p.t <= n.t - x.g THEN p.t ELSE n.t END AS nearest FROM {targets} x ASOF LEFT JOIN {points} p ON x.track_id = p.track_id AND x.g >= p.t ASOF LEFT JOIN {points} n ON x.track_id = n.track_id AND x.g <= n.t),
near_{targets} AS (SELECT *, abs(nearest - g) AS distance FROM near0_{targets})"""


PRIO = "(VALUES (0, 0), (1, 8), (2, 4), (3, 12)) pr(rank, tick)"
GRID = f"""{BARS}, ranges AS (SELECT track_id, coalesce(min(bar) FILTER (bstart >= {START}), 0) AS first_bar, coalesce(max(bar) FILTER (bstart < {STOP}), max(bar)) AS last_bar FROM bars GROUP BY 1),
clip AS (SELECT bars.* FROM bars JOIN ranges USING (track_id) WHERE bar BETWEEN first_bar AND last_bar),
placed AS (SELECT o.track_id, o.t, c.bar, c.bstart, c.bend FROM onsets o ASOF JOIN clip c ON o.track_id = c.track_id AND o.t >= c.bstart WHERE o.t < c.bend),
ticks AS (SELECT track_id, bar, bstart, bend, CAST(least(greatest(round_even((t - bstart) / (bend - bstart) * 16, 0), 0), 15) AS INT) AS tick, min(t) AS onset_time FROM placed GROUP BY 1, 2, 3, 4, 5),
points AS (SELECT track_id, bar, CAST(tick AS INT) AS tick, bstart + tick * ((bend - bstart) / 16.0::DOUBLE) AS grid_time FROM clip, (SELECT unnest(range(16)) AS tick)),
rcand AS (SELECT b.track_id, b.bar, b.bstart, b.bend - b.bstart AS len, (b.bend - b.bstart) / 16.0::DOUBLE AS step, rank, b.bstart + tick * ((b.bend - b.bstart) / 16.0::DOUBLE) AS g FROM bars b JOIN ranges r ON b.track_id = r.track_id AND b.bar = r.first_bar, {PRIO}),
{nearest('rcand', 'onsets', ['bar', 'bstart', 'len', 'step', 'rank', 'g'])},
rbest AS (SELECT track_id, arg_min({{'ms': (nearest - g) * 1000, 'bar': bar, 'rp': (nearest - bstart) / len, 'gp': (g - bstart) / len}}, (rank, bar)) AS r FROM near_rcand WHERE distance <= step * 0.5 GROUP BY 1),
refs AS (SELECT ranges.track_id, coalesce(r.ms, 0) AS ref_ms, coalesce(r.bar, first_bar) AS ref_bar, coalesce(r.rp, 0) AS ref_phase, coalesce(r.gp, 0) AS grid_phase FROM ranges LEFT JOIN rbest USING (track_id)),
snip AS (SELECT track_id, bar, tick, onset_time, (onset_time - (bstart + ref_ms / 1000)) / (bend - bstart) AS p FROM ticks JOIN refs USING (track_id)),
snippet_same AS (SELECT track_id, bar, tick, onset_time, round(p + 1.0 / 16, 6) AS phase FROM snip), snippet_new AS (SELECT track_id, bar, CAST(least(greatest(round_even(p * 16, 0), 0), 15) AS INT) AS tick, onset_time, round(p + 1.0 / 16, 6) AS phase FROM snip)"""
#: The same over all hours.
ALL_START, ALL_DURATION = -1.0, 1e12
ALL = GRID.replace(f">= {START})", f">= {ALL_START})").replace(f"< {STOP})", f"< {ALL_DURATION})")
LOOPS = f"""lp AS (SELECT b.track_id, x.L, b.bar AS loop_bar, r.last_bar, b.bstart AS loop_start, e.bend AS loop_end FROM bars b JOIN ranges r USING (track_id), (SELECT CAST(unnest([1, 2, 4]) AS INT) AS L) x, bars e WHERE e.track_id = b.track_id AND e.bar = b.bar + x.L - 1 AND b.bar BETWEEN r.first_bar AND r.last_bar AND (b.bar - r.first_bar) % x.L = 0),
lb AS (SELECT lp.*, off, loop_bar + off AS bar, (loop_end - loop_start) / (L * 16) AS step FROM lp, (SELECT unnest(range(4)) AS off) WHERE off < L),
lbars AS (SELECT *, loop_start + (off * 16) * step AS bar_start, 16.0::DOUBLE * step AS bar_length FROM lb),
lcand AS (SELECT track_id, L, loop_bar, bar, bar_start, bar_length, step, rank, loop_start + (off * 16 + tick) * step AS g FROM lbars, {PRIO}),
{nearest('lcand', 'onsets', ['L', 'loop_bar', 'bar', 'bar_start', 'bar_length', 'step', 'rank', 'g'])},
lbest AS (SELECT track_id, L, loop_bar, arg_min({{'ms': (nearest - g) * 1000, 'bar': bar, 'rp': (nearest - bar_start) / bar_length, 'gp': (g - bar_start) / bar_length}}, (rank, bar)) AS r FROM near_lcand WHERE distance <= step * 0.5 GROUP BY 1, 2, 3),
lrefs AS (SELECT lp.*, coalesce(r.ms, 0) AS ref_ms, coalesce(r.bar, loop_bar) AS ref_bar, coalesce(r.rp, 0) AS ref_phase, coalesce(r.gp, 0) AS grid_phase FROM lp LEFT JOIN lbest USING (track_id, L, loop_bar)),
lspan AS (SELECT lbars.*, ref_ms FROM lbars JOIN lrefs USING (track_id, L, loop_bar) WHERE bar <= lbars.last_bar),
lplaced AS (SELECT o.track_id, o.L, s.bar, s.bar_start, s.bar_length, s.ref_ms, o.t FROM (SELECT track_id, L, t FROM onsets, (SELECT CAST(unnest([1, 2, 4]) AS INT) AS L)) o ASOF JOIN lspan s ON o.track_id = s.track_id AND o.L = s.L AND o.t >= s.bar_start WHERE o.t < s.bar_start + s.bar_length),
lp2 AS (SELECT *, (t - (bar_start + ref_ms / 1000)) / bar_length AS p FROM lplaced),
lphases AS (SELECT track_id, L, bar, CAST(least(greatest(round_even(p * 16, 0), 0), 15) AS INT) AS tick, t AS onset_time, p + 1.0 / 16 AS phase FROM lp2),
lgrid AS (SELECT track_id, L, bar, CAST(tick AS INT) AS tick, loop_start + (off * 16 + tick) * step + ref_ms / 1000 AS grid_time FROM lspan, (SELECT unnest(range(16)) AS tick))"""
LONG = """moved AS (SELECT track_id, bar, tick, grid_time + ref_ms / 1000 AS grid_time FROM points JOIN refs USING (track_id)),
snip_new AS (SELECT track_id, bar, CAST(least(greatest(round_even(p * 16, 0), 0), 15) AS INT) AS tick, onset_time, p + 1.0 / 16 AS phase FROM snip),
users AS (SELECT DISTINCT track_id, L FROM lp),
long AS (SELECT track_id, 'uncorrected' AS method, CAST(NULL AS INT) AS L, bar, tick, onset_time, (onset_time - bstart) / (bend - bstart) + 1.0 / 16 AS phase, grid_time FROM points LEFT JOIN ticks USING (track_id, bar, tick)
UNION ALL SELECT track_id, 'per_snippet', NULL, bar, tick, onset_time, p + 1.0 / 16, grid_time FROM moved LEFT JOIN snip USING (track_id, bar, tick)
UNION ALL SELECT track_id, 'per_snippet_remapped', NULL, bar, tick, onset_time, phase, grid_time FROM moved LEFT JOIN snip_new USING (track_id, bar, tick)
UNION ALL SELECT track_id, 'standard_L' || L, L, bar, tick, onset_time, phase, lgrid.grid_time FROM (SELECT track_id, L, bar, tick FROM points JOIN users USING (track_id)) LEFT JOIN lgrid USING (track_id, L, bar, tick) LEFT JOIN lphases USING (track_id, L, bar, tick))"""
RMS = """r0 AS (SELECT track_id, method, CASE WHEN onset_time IS NOT NULL THEN phase - least(greatest(ceil(phase * 16 - 0.5), 0), 15) / 16.0 END AS dev, CASE WHEN count(grid_time) OVER w >= 2 THEN (max(grid_time) OVER w - min(grid_time) OVER w) * (16.0 / 15) ELSE 2.0 END AS dur FROM long WINDOW w AS (PARTITION BY track_id, method, bar)),
rms AS (SELECT track_id, method, count(dev) AS n, coalesce(sqrt(avg(dev * dev)), 0) AS rms_phase, coalesce(sqrt(avg(power(dev * dur * 1000, 2))), 0) AS rms_ms FROM r0 GROUP BY 1, 2)"""
FOLD = """f0 AS (SELECT track_id, bar - min(bar) OVER w AS b, max(bar) OVER w - min(bar) OVER w + 1 AS nb, tick, onset_time, grid_time FROM long WHERE method = 'per_snippet' WINDOW w AS (PARTITION BY track_id)),
fold AS (SELECT track_id, CAST(b // 2 AS INT) AS loop, CAST((b % 2) * 16 + tick + 1 AS INT) AS position, (onset_time - grid_time) * 1000 AS dev FROM f0 WHERE b // 2 < nb // 2 AND onset_time IS NOT NULL AND grid_time IS NOT NULL)"""
VECTORS = """vp AS (SELECT o.track_id, b.bar, CAST(least(floor((o.t - b.bstart) / (b.bend - b.bstart) * 16), 15) AS BIGINT) AS part FROM onsets o ASOF JOIN bars b ON o.track_id = b.track_id AND o.t >= b.bstart WHERE o.t < b.bend),
vs AS (SELECT track_id, bar, list(DISTINCT part) AS parts FROM vp GROUP BY 1, 2),
vectors AS (SELECT track_id, bar, list_transform(range(16), lambda i: CASE WHEN list_contains(coalesce(parts, []), i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM bars LEFT JOIN vs USING (track_id, bar))"""
PROFILE = """pairs AS (SELECT a.track_id, CAST(b.bar - a.bar AS INT) AS lag, a.v AS a, b.v AS b FROM vectors a JOIN vectors b ON a.track_id = b.track_id AND b.bar - a.bar BETWEEN 1 AND 9),
sims AS (SELECT track_id, lag, sqrt(list_sum(a)) * sqrt(list_sum(b)) AS scale, list_max(list_transform([0, 4, 8, 12], lambda s: list_dot_product(a, list_concat(b[17 - s:16], b[1:16 - s])))) AS top FROM pairs),
profile AS (SELECT track_id, lag, round(median(CASE WHEN scale > 0 THEN top / scale ELSE 0 END), 9) AS value FROM sims GROUP BY 1, 2)"""
POWER = """pk AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM profile WINDOW w AS (PARTITION BY track_id ORDER BY lag)),
pm AS (SELECT *, coalesce(CASE WHEN a IS NULL THEN value > b WHEN b IS NULL THEN value > a ELSE value >= a AND value >= b AND (value > a OR value > b) END, false) AND lag > 1 AS peak FROM pk WHERE lag IN (1, 2, 4, 8)),
power AS (SELECT track_id, CAST(coalesce(arg_max(lag, (value, -lag)) FILTER (peak), arg_max(lag, (value, -lag))) AS INT) AS L FROM pm GROUP BY 1)"""
CRITERIA = """q0 AS (SELECT track_id, row_number() OVER w AS i, (bend - bstart) * 1000.0 - lag((bend - bstart) * 1000.0) OVER w AS d FROM bars WINDOW w AS (PARTITION BY track_id ORDER BY bar)),
q1 AS (SELECT track_id, d, x.L, i % x.L AS r FROM q0, (SELECT CAST(unnest([1, 2, 4]) AS INT) AS L) x WHERE d IS NOT NULL), q2 AS (SELECT track_id, L, r, avg(d) AS mu FROM q1 GROUP BY 1, 2, 3), q3 AS (SELECT track_id, L, sum(mu) / L AS m FROM q2 GROUP BY 1, 2),
crit AS (SELECT track_id, L, count(*) AS n, sum(power(d - (mu - m), 2)) AS sse FROM q1 JOIN q2 USING (track_id, L, r) JOIN q3 USING (track_id, L) GROUP BY 1, 2)"""


def contour(table: str, name: str) -> str:
    """Lengths (name: track_id, L) by contours of the voiced values (track_id, t, value) of a table."""
    n = name
    return f"""{n}0 AS (SELECT o.track_id, b.bar, o.t, o.value FROM (SELECT * FROM {table} WHERE value > 0) o ASOF JOIN bars b ON o.track_id = b.track_id AND o.t >= b.bstart WHERE o.t < b.bend),
{n}1 AS (SELECT track_id, bar, CAST(i AS INT) AS i, CASE WHEN i = 15 THEN t1 ELSE t0 + i * ((t1 - t0) / 15.0::DOUBLE) END AS g FROM (SELECT track_id, bar, min(t) AS t0, max(t) AS t1 FROM {n}0 GROUP BY 1, 2), (SELECT unnest(range(16)) AS i)),
{n}2 AS (SELECT p.track_id, p.bar, i, CASE WHEN y.t > x.t THEN x.value + (y.value - x.value) * ((g - x.t) / (y.t - x.t)) ELSE x.value END AS y FROM {n}1 p ASOF JOIN {n}0 x ON p.track_id = x.track_id AND p.bar = x.bar AND p.g >= x.t ASOF JOIN {n}0 y ON p.track_id = y.track_id AND p.bar = y.bar AND p.g <= y.t),
{n}3 AS (SELECT track_id, bar, coalesce(v, list_transform(range(16), lambda i: 0.0::DOUBLE)) AS v FROM bars LEFT JOIN (SELECT track_id, bar, list(y ORDER BY i) AS v FROM {n}2 GROUP BY 1, 2) USING (track_id, bar)),
{n}4 AS (SELECT track_id, bar, list_transform(v, lambda x: round((x - m) / (sqrt(list_avg(list_transform(v, lambda z: (z - m) * (z - m)))) + 1e-9), 9)) AS v FROM (SELECT *, list_avg(v) AS m FROM {n}3)),
{n}5 AS (SELECT a.track_id, CAST(b.bar - a.bar AS INT) AS lag, sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) AS scale, list_max(list_transform([0, 4, 8, 12], lambda s: list_dot_product(a.v, list_concat(b.v[17 - s:16], b.v[1:16 - s])))) AS top FROM {n}4 a JOIN {n}4 b ON a.track_id = b.track_id AND b.bar - a.bar BETWEEN 1 AND 9),
{power(f"SELECT track_id, lag, greatest(0, CASE WHEN scale > 0 THEN top / scale ELSE 0 END) AS s FROM {n}5", n)}"""


def channels(table: str, name: str, n: int, shifts: int | None = None) -> str:
    """Lengths (name) by bars (track_id, bar, v: a list of channels of n frames each) of a table."""
    rolled = f"list_concat(b.v[c][{n + 1} - s:{n}], b.v[c][1:{n} - s])"
    return f"""{name}5 AS (SELECT a.track_id, CAST(b.bar - a.bar AS INT) AS lag, list_sum(list_transform(range(1, len(a.v) + 1), lambda c: sqrt(list_dot_product(a.v[c], a.v[c])) * sqrt(list_dot_product(b.v[c], b.v[c])))) AS scale,
list_max(list_transform(range({n}), lambda s: list_sum(list_transform(range(1, len(a.v) + 1), lambda c: list_dot_product(a.v[c], {rolled}))))) AS top FROM {table} a JOIN {table} b ON a.track_id = b.track_id AND b.bar - a.bar BETWEEN 1 AND 9),
{power(f"SELECT track_id, lag, CASE WHEN scale > 0 THEN top / scale ELSE 0 END AS s FROM {name}5", name)}"""


def power(similarities: str, name: str) -> str:
    """Lengths (name) from similarities (track_id, lag, s), by way of the profile name_p."""
    own = POWER.replace("profile", f"{name}_p").replace("pk", f"{name}_k").replace("pm", f"{name}_m").replace("power", name)
    return f"{name}_p AS (SELECT track_id, lag, round(median(s), 9) AS value FROM ({similarities}) GROUP BY 1, 2), {own}"


def in_steps(sql: str, steps: int) -> str:
    """SQL of the grid for bars of other than 16 steps."""
    return re.sub(r"\b15\b", str(steps - 1), re.sub(r"\b16\b", str(steps), sql))
