"""DuckDB counterparts of the registered queries, put together from shared common table expressions."""

from __future__ import annotations

import math

from ..functions.geo import EARTH_M, UTM_EAST, UTM_SCALE, tm_series
from ..operators.reporting import T_975


def u(*parts: str) -> str:
    """The portable uniform of a key; parts are SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496e0)"


def hav(a: str, b: str, c: str, d: str) -> str:
    s = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(2 * {EARTH_M!r}e0 * asin(sqrt({s})))"


def grid(lat: str, lon: str) -> str:
    part = lambda x, lo, hi: f"least(greatest(CAST(trunc(({x} - {lo}e0) / ({hi}e0 - {lo}e0) * 4) AS INT), 0), 3)"
    return f"({part(lat, '39.75', '40.05')} * 4 + {part(lon, '116.20', '116.55')})"


def utm(src: str) -> str:
    """Adds x and y to a relation with lat and lon."""
    radius, alpha, e = tm_series()
    x = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    y = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    t = f"sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat))))"
    return f"""(SELECT * EXCLUDE (tt, lam, xi, eta), {UTM_EAST!r}e0 + {UTM_SCALE * radius!r}e0 * ({x}) AS x, {UTM_SCALE * radius!r}e0 * ({y}) AS y FROM
 (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM (SELECT *, {t} AS tt, radians(lon - 117) AS lam FROM {src})))"""


T = "(epoch_us(ts) / 1e6)"
PTS = f"""pts AS (SELECT traj_id, user_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY ts, event_id) - 1 AS INT) AS pos, t, lat, lon FROM (
 SELECT user_id || '/' || CAST(floor(({T} - 1704067200) / 864000) AS BIGINT) AS traj_id, user_id, ts, event_id, {T} AS t,
  39.75e0 + 0.30e0 * CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS lat, 116.20e0 + 0.35e0 * least(value, 200e0) / 200 AS lon FROM events))"""
_at = lambda k: u("'1'", "'geoind'", f"'{k}'", "traj_id", "pos")
REL = f"""rel AS (SELECT traj_id, user_id, pos, t, lat + r * sin(a) / 111320e0 AS lat, lon + r * cos(a) / (111320e0 * cos(radians(lat))) AS lon FROM (
 SELECT *, -(ln(1e0 - {_at('a')}) + ln(1e0 - {_at('b')})) * 500e0 AS r, {_at('c')} * {2 * math.pi!r} AS a FROM pts))"""
CELLS = f"cells AS (SELECT traj_id, pos, CAST({grid('lat', 'lon')} AS VARCHAR) AS cell FROM pts)"
PAIRS = """pairs AS (SELECT traj_id, coalesce(lag(cell) OVER (PARTITION BY traj_id ORDER BY pos), '^') AS context, cell AS symbol FROM cells
 UNION ALL SELECT traj_id, arg_max(cell, pos), '$' FROM cells GROUP BY traj_id)"""
SCORES = "scores AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM labels JOIN documents USING (doc_id))"
GROUPS = """groups AS (SELECT *, coalesce(sum(pos + neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
 sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
 SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM scores GROUP BY score))"""


def geom(src: str, name: str) -> str:
    return f"""{name} AS (SELECT traj_id, any_value(user_id) AS user_id, CAST(count(*) AS INT) AS n_points, max(t) - min(t) AS duration_s, coalesce(sum(d), 0) AS length_m,
 min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM (
 SELECT *, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d FROM {src} WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) GROUP BY traj_id)"""


def fold(name: str, ok: str, src: str = "pts") -> str:
    """Recursive fold: keeps a point where ok holds against the last kept one (f)."""
    return f"""{name} AS (SELECT traj_id, pos, pos AS kept_pos, lat, lon, t, 1 AS n, 0 AS outliers, t AS total, 0e0 AS len FROM {src} WHERE pos = 0 UNION ALL
 SELECT traj_id, pos, CASE WHEN ok THEN pos ELSE kp END, CASE WHEN ok THEN lat ELSE flat END, CASE WHEN ok THEN lon ELSE flon END, CASE WHEN ok THEN t ELSE ft END,
  n + CASE WHEN ok THEN 1 ELSE 0 END, outliers + CASE WHEN ok THEN 0 ELSE 1 END, total + CASE WHEN ok THEN t ELSE 0 END, len + CASE WHEN ok THEN {hav('flat', 'flon', 'lat', 'lon')} ELSE 0 END FROM (
  SELECT p.*, f.kept_pos AS kp, f.lat AS flat, f.lon AS flon, f.t AS ft, f.n, f.outliers, f.total, f.len, {ok} AS ok FROM {name} f JOIN {src} p ON p.traj_id = f.traj_id AND p.pos = f.pos + 1))"""


_dist = hav("f.lat", "f.lon", "p.lat", "p.lon")
SLOW = f"(p.t - f.t > 0 AND {_dist} / (p.t - f.t) * 3.6e0 <= 60)"
LATE = "(p.t - f.t >= 43200)"
HOUR = "((floor(floor((t % 86400) / 60) / 60) + (floor((t % 86400) / 60) % 60) / 60e0 + 8) % 24)"


def stays(src: str, p: str) -> str:
    return f"""{p}n AS (SELECT traj_id, CAST(count(*) AS INT) AS n FROM {src} GROUP BY traj_id),
{p}far AS (SELECT a.traj_id, a.pos AS i, min(b.pos) AS j FROM {src} a JOIN {src} b ON a.traj_id = b.traj_id AND b.pos > a.pos AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} > 12000 GROUP BY a.traj_id, a.pos),
{p}end AS (SELECT a.traj_id, a.user_id, a.pos AS i, coalesce(f.j, n.n) AS j, a.t AS t FROM {src} a JOIN {p}n n USING (traj_id) LEFT JOIN {p}far f ON f.traj_id = a.traj_id AND f.i = a.pos),
{p}ok AS (SELECT e.*, l.t - e.t >= 3600 AS ok FROM {p}end e JOIN {src} l ON l.traj_id = e.traj_id AND l.pos = e.j - 1),
{p}chain AS (SELECT * FROM {p}ok WHERE i = 0 UNION ALL SELECT o.* FROM {p}chain c JOIN {p}ok o ON o.traj_id = c.traj_id AND o.i = CASE WHEN c.ok THEN c.j ELSE c.i + 1 END),
{p}stays AS (SELECT c.traj_id, any_value(c.user_id) AS user_id, c.i, avg(s.lat) AS lat, avg(s.lon) AS lon, any_value(c.t) AS t, CAST(count(*) AS INT) AS n
 FROM {p}chain c JOIN {src} s ON s.traj_id = c.traj_id AND s.pos >= c.i AND s.pos < c.j WHERE c.ok GROUP BY c.traj_id, c.i),
{p}places AS (SELECT u.user_id, {', '.join(f"sum({c} * n) FILTER ({w}) / sum(n) FILTER ({w}) AS {name}_{c}" for name, w in (('home', 'h >= 22 OR h < 7'), ('work', 'h >= 9 AND h < 18')) for c in ('lat', 'lon'))}
 FROM (SELECT DISTINCT user_id FROM {src}) u LEFT JOIN (SELECT *, {HOUR} AS h FROM {p}stays) s ON s.user_id = u.user_id GROUP BY u.user_id)"""


E_KEEP = lambda k, e: math.exp(e) / (math.exp(e) + k - 1)


def grr(v: str, k: str, e: float, *key: str) -> str:
    keep = f"({math.exp(e)!r} / ({math.exp(e)!r} + {k} - 1))"
    other = f"CAST(floor({u(chr(39) + 'grr-other' + chr(39), *key)} * ({k} - 1)) AS INT)"
    return f"CASE WHEN {u(chr(39) + 'grr-keep' + chr(39), *key)} < {keep} THEN {v} ELSE {other} + CASE WHEN {other} >= {v} THEN 1 ELSE 0 END END"


SEGMENTS = "seg AS (SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS v FROM customer)"
GRR = f"reports AS (SELECT c_custkey, {grr('v', '5', 1.0, chr(39) + '3' + chr(39), 'c_custkey')} AS report FROM seg)"
OUE = f"""bits AS (SELECT c_custkey, CAST(i AS INT) AS category, CASE WHEN {u("'oue'", "'3'", 'c_custkey', 'i')} < CASE WHEN i = v THEN 0.5e0 ELSE {1 / (math.e + 1)!r} END THEN 1 ELSE 0 END AS bit FROM seg, range(0, 5) AS r(i))"""

SPOTS = """spots AS (SELECT traj_id, CAST(k AS INT) AS k, CASE WHEN n <= 5 THEN k ELSE CAST(round_even(k * ((n - 1) / 4e0), 0) AS INT) END AS pos
 FROM (SELECT traj_id, CAST(count(*) AS INT) AS n FROM pts GROUP BY traj_id), range(0, 5) AS r(k) WHERE k < n)"""


def dtw() -> str:
    rounds = ["r1 AS (SELECT *, sum(c0) OVER w AS cur FROM costs WINDOW w AS (PARTITION BY probe, g ORDER BY j))"]
    for k in range(1, 5):
        rounds.append(f"""r{k + 1} AS (SELECT * EXCLUDE (m, s), s + min(m - (s - c{k})) OVER w AS cur FROM (
 SELECT * EXCLUDE (cur), least(cur, coalesce(lag(cur) OVER w, 'infinity'::DOUBLE)) AS m, sum(c{k}) OVER w AS s FROM r{k} WINDOW w AS (PARTITION BY probe, g ORDER BY j)) WINDOW w AS (PARTITION BY probe, g ORDER BY j))""")
    costs = ", ".join(f"sqrt(pow(p.xs[{k + 1}] - q.x, 2) + pow(p.ys[{k + 1}] - q.y, 2)) AS c{k}" for k in range(5))
    return f"""xy AS MATERIALIZED (SELECT * FROM {utm('pts')}),
{SPOTS},
probes AS (SELECT traj_id, any_value(user_id) AS user_id, list(x ORDER BY k) AS xs, list(y ORDER BY k) AS ys FROM spots JOIN xy USING (traj_id, pos)
 WHERE user_id IN (SELECT user_id FROM pts GROUP BY user_id HAVING count(DISTINCT traj_id) >= 2) GROUP BY traj_id),
costs AS (SELECT p.traj_id AS probe, p.user_id AS true_user, q.traj_id AS g, q.user_id AS user, q.pos AS j, {costs} FROM probes p JOIN xy q ON q.traj_id <> p.traj_id),
{', '.join(rounds)},
ranking AS (SELECT probe AS probe_id, true_user, user, distance, CAST(row_number() OVER (PARTITION BY probe ORDER BY distance, user) AS INT) AS rank FROM (
 SELECT probe, true_user, user, min(d) AS distance FROM (SELECT probe, true_user, user, g, arg_max(cur, j) AS d FROM r5 GROUP BY ALL) GROUP BY ALL))"""


_drawn = lambda purpose, b, k, n: f"CAST(floor({u(chr(39) + '0' + chr(39), chr(39) + purpose + chr(39), b, k)} * {n}) AS INT)"
LENGTHS = f"{geom('pts', 'ga')}, {geom('rel', 'gb')}, lengths AS (SELECT traj_id, ga.length_m AS a, gb.length_m AS b FROM ga JOIN gb USING (traj_id))"

_part = lambda key: f"floor({u(chr(39) + 'number' + chr(39), key)} * 256)"  # noqa: E731  the order in which rows are numbered

NETWORK = f"""m AS (SELECT count(*) AS m FROM nation),
nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS node_id, 450000 + 1500 * cos({2 * math.pi!r} * n_nationkey / m) AS x, 4420000 + 1500 * sin({2 * math.pi!r} * n_nationkey / m) AS y FROM nation, m),
steps AS (SELECT n_nationkey AS a, (n_nationkey + d) % m AS b, w FROM nation, m, (VALUES (1, 1.0e0), (7, 1.0e0), (7, 1.5e0)) AS s(d, w)),
ways AS (SELECT a AS u, b AS v, w FROM steps UNION ALL SELECT b, a, w FROM steps WHERE a % 3 <> 0),
edges AS (SELECT row_number() OVER (ORDER BY u, v, w) - 1 AS edge_id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, round(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) * w, 3) AS length_m FROM ways JOIN nodes p ON p.node_id = u JOIN nodes q ON q.node_id = v)"""
ZONED = """box AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM nodes),
zoned AS (SELECT edge_id, u, v, CAST(dense_rank() OVER (ORDER BY cell) - 1 AS INT) AS zone FROM (SELECT e.*, least(CAST(trunc(((p.y + q.y) / 2 - y0) / (y1 - y0 + 1e-9) * 4) AS INT), 3) * 4 + least(CAST(trunc(((p.x + q.x) / 2 - x0) / (x1 - x0 + 1e-9) * 4) AS INT), 3) AS cell
 FROM edges e JOIN nodes p ON p.node_id = u JOIN nodes q ON q.node_id = v, box)),
arcs AS (SELECT DISTINCT a.zone AS i, b.zone AS j FROM zoned a JOIN zoned b ON a.v = b.u WHERE a.zone <> b.zone),
narcs AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INT) AS arc, i, j FROM arcs)"""
ROUTES = """rt AS (SELECT CAST(user_id AS VARCHAR) AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id * 7 % (SELECT count(*) FROM edges) AS edge_id FROM events),
zs AS (SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY pos) - 1 AS INT) AS pos, zone FROM (
 SELECT traj_id, pos, zone, lag(zone) OVER (PARTITION BY traj_id ORDER BY pos) AS before FROM rt JOIN zoned USING (edge_id)) WHERE before IS NULL OR before <> zone),
ends AS (SELECT traj_id, arg_min(zone, pos) AS s, arg_max(zone, pos) AS e, CAST(count(*) - 1 AS INT) AS moves FROM zs GROUP BY traj_id),
sizes AS (SELECT (SELECT max(zone) + 1 FROM zoned) AS nz, (SELECT count(*) FROM narcs) AS na, (SELECT count(*) FROM ends) AS n)"""
_k = lambda s: ("'6'", f"'{s}'", "traj_id")
_EPS = {s: 2.0 * w for s, w in zip(("start", "end", "length", "step"), (0.15, 0.15, 0.2, 0.5))}
REPORTS = f"""moved AS (SELECT a.traj_id, a.pos, na.arc FROM zs a JOIN zs b ON a.traj_id = b.traj_id AND b.pos = a.pos + 1 JOIN narcs na ON na.i = a.zone AND na.j = b.zone),
picked AS (SELECT e.*, nz, na, coalesce(m.arc, CAST(floor({u(*_k('any'))} * na) AS INT)) AS arc FROM (SELECT ends.*, sizes.*, traj_id AS tid, CAST(floor({u(*_k('pick'))} * moves) AS INT) AS at_pos FROM ends, sizes) e LEFT JOIN moved m ON m.traj_id = e.tid AND m.pos = e.at_pos AND e.moves > 0),
said AS (SELECT 'start' AS stage, {grr('s', 'nz', _EPS['start'], *_k('start'))} AS category FROM picked
 UNION ALL SELECT 'end', {grr('e', 'nz', _EPS['end'], *_k('end'))} FROM picked
 UNION ALL SELECT 'length', {grr('least(moves, 24)', '25', _EPS['length'], *_k('length'))} FROM picked
 UNION ALL SELECT 'step', CAST(i AS INT) FROM picked, LATERAL (SELECT unnest(range(0, na)) AS i) WHERE {u("'oue'", *_k('step'), 'i')} < CASE WHEN i = arc THEN 0.5e0 ELSE {1 / (math.exp(_EPS['step']) + 1)!r} END),
reports AS (SELECT stage, category, count(*) AS n FROM said GROUP BY ALL)""".replace("e.*, nz, na, coalesce(m.arc", "e.* EXCLUDE (tid), coalesce(m.arc").replace(u(*_k("any")), u("'6'", "'any'", "e.traj_id"))


def _estimate(stage: str, k: str) -> str:
    e = math.exp(_EPS[stage])
    if stage == "step":
        value = f"(coalesce(r.n, 0) - sizes.n * {1 / (e + 1)!r}) / {0.5 - 1 / (e + 1)!r}"
    else:
        value = f"(coalesce(r.n, 0) - sizes.n * (1 / ({e!r} + {k} - 1))) / ({e!r} / ({e!r} + {k} - 1) - 1 / ({e!r} + {k} - 1))"
    origin = "(SELECT i FROM narcs WHERE arc = c)" if stage == "step" else "NULL"
    return f"SELECT '{stage}' AS stage, CAST(c AS INT) AS category, {origin} AS i, greatest({value}, 0) AS estimate FROM sizes, LATERAL (SELECT unnest(range(0, {k})) AS c) LEFT JOIN reports r ON r.stage = '{stage}' AND r.category = c"


ESTIMATES = f"""raw AS ({' UNION ALL '.join(_estimate(s, k) for s, k in (('start', 'nz'), ('end', 'nz'), ('length', '25'), ('step', 'na')))}),
model AS (SELECT stage, category, CASE WHEN sum(estimate) OVER w > 0 THEN estimate / sum(estimate) OVER w ELSE 1e0 / count(*) OVER w END AS p FROM raw WINDOW w AS (PARTITION BY stage, i))"""

WEEKLY = f"""weekly AS (SELECT CAST(floor(({T} - 1704067200) / 604800) AS INT) AS seed, event_type AS result_id, avg(value) AS value, count(*) AS n_probes, max(value) AS attack_runtime_s FROM events GROUP BY ALL)"""
T_CASE = "CASE " + " ".join(f"WHEN n - 1 >= {d} THEN {v!r}" for d, v in sorted(T_975.items(), reverse=True)) + " END"
STUDENT = f"CASE WHEN n > 1 THEN {T_CASE} * sd / sqrt(n) ELSE 0 END"
RESULTS = """res AS (SELECT *, family || ':' || target_ref || ':k' || known_points AS result_id FROM (
 SELECT CASE l_returnflag WHEN 'A' THEN 'reidentification' WHEN 'N' THEN 'membership_inference' ELSE 'utility' END AS family, CASE WHEN l_linestatus = 'O' THEN 'raw' ELSE 'protected:none' END AS target_ref,
 CAST(year(l_shipdate) AS INT) AS known_points, CASE l_linenumber % 3 WHEN 0 THEN 'top1_acc' WHEN 1 THEN 'auc' ELSE 'tpr@fpr=0.001' END AS metric,
 avg(l_discount) AS value, min(l_tax) AS ci_low, max(l_tax) AS ci_high, max(l_quantity) AS attack_runtime_s, count(*) % 1500 AS n_nonmembers FROM lineitem GROUP BY ALL))"""
HEAD = "CASE family WHEN 'reidentification' THEN 'top1_acc' WHEN 'membership_inference' THEN 'auc' ELSE 'auc' END"
DRIVES = f"""drv AS (SELECT CAST(user_id AS VARCHAR) AS traj_id, pos, 39.92888e0 + (1490 * sin(turn)) / 111033e0 AS lat, 116.41493e0 + (1490 * cos(turn)) / 85523e0 AS lon FROM (
 SELECT user_id, pos, pos * 0.05e0 + user_id % 25 * {2 * math.pi / 25!r} AS turn FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)))"""
W1 = """SELECT round(sum(abs(f0 - f1) * (nxt - x)), 3) AS w1 FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nxt, sum(n0) OVER (ORDER BY x) / sum(n0) OVER () AS f0, sum(n1) OVER (ORDER BY x) / sum(n1) OVER () AS f1 FROM (
 SELECT x, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1 FROM vals GROUP BY x))"""

SQL: dict[str, str] = {
    "traj_points": f"WITH {PTS} SELECT traj_id, user_id, pos, round(t, 6) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM pts",
    "traj_summary": f"""WITH {PTS}, {geom('pts', 'g')} SELECT traj_id, n_points, round(duration_s, 3) AS duration_s, round(length_m, 3) AS length_m, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat, round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat,
 round(CASE WHEN duration_s > 0 THEN length_m / duration_s ELSE 0 END, 6) AS mean_speed FROM g""",
    "speed_filter": f"WITH RECURSIVE {PTS}, {fold('f', SLOW)} SELECT traj_id, arg_max(n, pos) AS n_kept, arg_max(outliers, pos) AS outliers FROM f GROUP BY traj_id",
    "thinning": f"WITH RECURSIVE {PTS}, {fold('f', LATE)} SELECT traj_id, arg_max(n, pos) AS n_kept, round(arg_max(total, pos) / arg_max(n, pos), 3) AS mean_t FROM f GROUP BY traj_id",
    "min_size_filter": f"WITH RECURSIVE {PTS}, {fold('f', LATE)} SELECT traj_id, n AS n_points, round(len, 3) AS length_m FROM (SELECT traj_id, arg_max(n, pos) AS n, arg_max(len, pos) AS len FROM f GROUP BY traj_id) WHERE n >= 8 AND len >= 100000",
    "user_subsample": f"""WITH {PTS}, ranked AS (SELECT user_id, row_number() OVER (ORDER BY {u("'5'", "'subsample'", 'user_id')}, user_id) AS r FROM (SELECT DISTINCT user_id FROM pts)) SELECT user_id, count(*) AS n FROM pts JOIN ranked USING (user_id) WHERE r <= 10 GROUP BY user_id""",
    "user_split": f"""WITH {PTS}, ranked AS (SELECT user_id, row_number() OVER (ORDER BY {u("'5'", "'split'", 'user_id')}, user_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM pts)),
quota AS (SELECT *, f * n AS q, CAST(floor(f * n + 1e-9) AS BIGINT) AS base FROM (VALUES ('train', 0.5e0, 1), ('test', 0.2e0, 2), ('shadow', 0.2e0, 3), ('attack', 0.1e0, 4)) AS s(split, f, ord), (SELECT count(*) AS n FROM ranked)),
shares AS (SELECT split, ord, base + CASE WHEN row_number() OVER (ORDER BY q - base DESC, ord) <= n - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM quota),
upto AS (SELECT split, sum(share) OVER (ORDER BY ord) AS hi, sum(share) OVER (ORDER BY ord) - share AS lo FROM shares)
SELECT split, count(DISTINCT user_id) AS users, count(*) AS trajectories FROM (SELECT DISTINCT user_id, traj_id FROM pts) JOIN ranked USING (user_id) JOIN upto ON r > lo AND r <= hi GROUP BY split""",
    "grid_cells": f"WITH {PTS} SELECT traj_id, pos, {grid('lat', 'lon')} AS cell FROM pts",
    "cell_counts": f"WITH {PTS} SELECT traj_id, {grid('lat', 'lon')} AS cell, count(*) AS n FROM pts GROUP BY ALL",
    "haversine_pairs": f"WITH {PTS} SELECT traj_id, pos, round({hav('lat0', 'lon0', 'lat', 'lon')}, 6) AS metres FROM (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM pts WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) WHERE lat0 IS NOT NULL",
    "utm_projection": f"WITH {PTS} SELECT traj_id, pos, round(x, 4) AS x, round(y, 4) AS y FROM {utm('pts')}",
    "evenly_spaced": f"WITH {PTS}, {SPOTS} SELECT traj_id, k, CAST(pos AS INT) AS pos FROM spots",
    "local_hour": f"WITH {PTS} SELECT traj_id, pos, round(h, 6) AS hour, h >= 22 OR h < 7 AS home, h >= 9 AND h < 18 AS work FROM (SELECT *, {HOUR} AS h FROM pts)",
    "stay_points": f"WITH RECURSIVE {PTS}, {stays('pts', 'a')} SELECT traj_id, CAST(row_number() OVER (PARTITION BY traj_id ORDER BY i) - 1 AS INT) AS stay, round(lat, 9) AS lat, round(lon, 9) AS lon, round(t, 3) AS t, n FROM astays",
    "home_work": f"WITH RECURSIVE {PTS}, {stays('pts', 'a')} SELECT user_id, round(home_lat, 9) AS home_lat, round(home_lon, 9) AS home_lon, round(work_lat, 9) AS work_lat, round(work_lon, 9) AS work_lon FROM aplaces",
    "poi_error": f"""WITH RECURSIVE {PTS}, {REL}, {stays('pts', 'a')}, {stays('rel', 'b')},
d AS (SELECT a.user_id, a.home_lat, a.work_lat, {hav('a.home_lat', 'a.home_lon', 'b.home_lat', 'b.home_lon')} AS hd, {hav('a.work_lat', 'a.work_lon', 'b.work_lat', 'b.work_lon')} AS wd FROM aplaces a LEFT JOIN bplaces b ON a.user_id = b.user_id)
SELECT user_id, round(hd, 3) AS home_error_m, CASE WHEN home_lat IS NOT NULL THEN CASE WHEN hd <= 2000 THEN 1e0 ELSE 0e0 END END AS home_localised, round(wd, 3) AS work_error_m, CASE WHEN work_lat IS NOT NULL THEN CASE WHEN wd <= 2000 THEN 1e0 ELSE 0e0 END END AS work_localised FROM d""",
    "geoind_release": f"WITH {PTS}, {REL} SELECT traj_id, pos, round(lat, 6) AS lat, round(lon, 6) AS lon FROM rel",
    "identity_release": f"WITH {PTS} SELECT traj_id, pos, round(lat, 6) AS lat, round(lon, 6) AS lon, 'none' AS guarantee, CAST(NULL AS DOUBLE) AS epsilon FROM pts",
    "geoind_budget": f"WITH {PTS} SELECT traj_id, count(*) * 1e0 AS spent_budget FROM pts GROUP BY traj_id",
    "release_geometry": f"WITH {PTS}, {REL}, {geom('rel', 'g')} SELECT traj_id, round(length_m, 3) AS length_m, round(min_lon, 6) AS min_lon, round(max_lat, 6) AS max_lat, round(CASE WHEN duration_s > 0 THEN length_m / duration_s ELSE 0 END, 6) AS mean_speed FROM g",
    "grr_report": f"WITH {SEGMENTS}, {GRR} SELECT * FROM reports",
    "grr_estimate": f"WITH {SEGMENTS}, {GRR} SELECT CAST(i AS INT) AS category, round(greatest((c - n * {1 / (math.e + 4)!r}) / {math.e / (math.e + 4) - 1 / (math.e + 4)!r}, 0), 6) AS estimate FROM (SELECT i, count(report) AS c FROM range(0, 5) AS r(i) LEFT JOIN reports ON report = i GROUP BY i), (SELECT count(*) AS n FROM customer)",
    "oue_report": f"WITH {SEGMENTS}, {OUE} SELECT * FROM bits",
    "oue_estimate": f"WITH {SEGMENTS}, {OUE} SELECT category, round(greatest((sum(bit) - count(*) * {1 / (math.e + 1)!r}) / {0.5 - 1 / (math.e + 1)!r}, 0), 6) AS estimate FROM bits GROUP BY category",
    "dtw_ranking": f"WITH {PTS}, {dtw()} SELECT probe_id, true_user, user, round(distance, 3) AS distance, rank FROM ranking",
    "topk_accuracy": f"WITH {PTS}, {dtw()} SELECT round(avg(hit), 6) AS top5_acc, count(*) AS n_probes FROM (SELECT probe_id, max(CASE WHEN rank <= 5 AND user = true_user THEN 1e0 ELSE 0e0 END) AS hit FROM ranking GROUP BY probe_id)",
    "linkage_rate": f"WITH {PTS}, {dtw()} SELECT round(avg(hit), 6) AS linkage_rate FROM (SELECT probe_id, max(CASE WHEN rank = 1 AND user = true_user THEN 1e0 ELSE 0e0 END) AS hit FROM ranking GROUP BY probe_id)",
    "hausdorff_pairs": f"""WITH {PTS}, {REL}, d AS (SELECT a.traj_id, a.pos AS i, b.pos AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM {utm('pts')} a JOIN {utm('rel')} b USING (traj_id))
SELECT traj_id, round(greatest(l, r), 3) AS hausdorff_m FROM (SELECT traj_id, max(m) AS l FROM (SELECT traj_id, i, min(d) AS m FROM d GROUP BY ALL) GROUP BY traj_id) JOIN (SELECT traj_id, max(m) AS r FROM (SELECT traj_id, j, min(d) AS m FROM d GROUP BY ALL) GROUP BY traj_id) USING (traj_id)""",
    "mean_spatial_error": f"WITH {PTS}, {REL} SELECT a.traj_id, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 3) AS error_m FROM {utm('pts')} a JOIN {utm('rel')} b USING (traj_id, pos) GROUP BY a.traj_id",
    "second_difference": f"""WITH {PTS} SELECT traj_id, CAST(pos - 1 AS INT) AS k, round(dx, 3) AS dx, round(dy, 3) AS dy FROM (SELECT traj_id, pos, lag(x) OVER w - 2 * x + lead(x) OVER w AS dx, lag(y) OVER w - 2 * y + lead(y) OVER w AS dy FROM {utm('pts')} WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) WHERE dx IS NOT NULL""",
    "markov_counts": f"WITH {PTS}, {CELLS}, {PAIRS} SELECT context, symbol, count(*) AS n FROM pairs GROUP BY ALL",
    "markov_logprob": f"""WITH {PTS}, {CELLS}, {PAIRS}, c AS (SELECT context, symbol, count(*) AS n FROM pairs GROUP BY ALL), t AS (SELECT context, sum(n) AS total FROM c GROUP BY ALL), v AS (SELECT count(DISTINCT symbol) AS v FROM c)
SELECT traj_id, round(sum(ln((n + 1e0) / (total + v))), 6) AS log_prob FROM pairs JOIN c USING (context, symbol) JOIN t USING (context), v GROUP BY traj_id""",
    "roc_auc": f"WITH {SCORES}, {GROUPS} SELECT round((sum(pos * (below + (pos + neg + 1) / 2)) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n)), 6) AS auc FROM groups",
    "tpr_at_fpr": f"WITH {SCORES}, {GROUPS} SELECT CAST(f AS DOUBLE) AS fpr_target, round(coalesce(max(tp / p) FILTER (fp / n <= f), 0), 6) AS tpr FROM groups, (VALUES (0.01e0), (0.1e0), (0.5e0)) AS x(f) GROUP BY f",
    "avg_ranks": f"WITH {SCORES}, {GROUPS} SELECT id, score, below + (pos + neg + 1) / 2 AS avg_rank FROM scores JOIN groups USING (score)",
    "membership_report": f"""WITH {SCORES}, {GROUPS} SELECT 'auc' AS metric, round((sum(pos * (below + (pos + neg + 1) / 2)) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n)), 6) AS value FROM groups
UNION ALL SELECT 'tpr@fpr=' || f, CASE WHEN any_value(n) * f >= 1 - 1e-9 THEN round(coalesce(max(tp / p) FILTER (fp / n <= f), 0), 6) END FROM groups, (VALUES (0.001e0), (0.1e0)) AS x(f) GROUP BY f""",
    "cell_jsd": f"""WITH {PTS}, {REL}, c AS (SELECT cell, coalesce(a, 0) / (sum(a) OVER ())::DOUBLE AS p, coalesce(b, 0) / (sum(b) OVER ())::DOUBLE AS q FROM (SELECT {grid('lat', 'lon')} AS cell, count(*) AS a FROM pts GROUP BY ALL) FULL JOIN (SELECT {grid('lat', 'lon')} AS cell, count(*) AS b FROM rel GROUP BY ALL) USING (cell))
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM c""",
    "length_w1_paired": f"WITH {PTS}, {REL}, {LENGTHS} SELECT round(avg(abs(a - b)), 3) AS w1_m FROM (SELECT a, row_number() OVER (ORDER BY a) AS r FROM lengths) JOIN (SELECT b, row_number() OVER (ORDER BY b) AS r FROM lengths) USING (r)",
    "length_w1_unpaired": f"WITH vals AS (SELECT o_totalprice AS x, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS side FROM orders WHERE o_orderstatus IN ('O', 'F')) {W1}",
    "bootstrap_ci": f"""WITH {SCORES}, ix AS (SELECT row_number() OVER (ORDER BY {_part("id")}, id) - 1 AS i, CAST(label AS DOUBLE) AS x, count(*) OVER () AS n FROM scores),
m AS (SELECT b, avg(x) AS m FROM (SELECT b, {_drawn('bootstrap', 'b', 'k', 'n')} AS i FROM range(0, 1000) AS r(b), (SELECT i AS k, n FROM ix)) JOIN ix USING (i) GROUP BY b)
SELECT round((SELECT avg(x) FROM ix), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m""",
    "paired_bootstrap": f"""WITH {PTS}, {REL}, {LENGTHS}, ix AS (SELECT row_number() OVER (ORDER BY {_part("traj_id")}, traj_id) - 1 AS i, a, b, count(*) OVER () AS n FROM lengths),
dr AS (SELECT rd, a, b FROM (SELECT rd, {_drawn('paired', 'rd', 'k', 'n')} AS i FROM range(0, 1000) AS r(rd), (SELECT i AS k, n FROM ix)) JOIN ix USING (i)),
ds AS (SELECT rd, avg(abs(a - b)) AS d FROM (SELECT rd, a, row_number() OVER (PARTITION BY rd ORDER BY a) AS r FROM dr) JOIN (SELECT rd, b, row_number() OVER (PARTITION BY rd ORDER BY b) AS r FROM dr) USING (rd, r) GROUP BY rd),
one AS (SELECT avg(abs(a - b)) AS d FROM (SELECT a, row_number() OVER (ORDER BY a) AS r FROM ix) JOIN (SELECT b, row_number() OVER (ORDER BY b) AS r FROM ix) USING (r))
SELECT round((SELECT d FROM one), 3) AS value, round(quantile_cont(d, 0.025), 3) AS ci_low, round(quantile_cont(d, 0.975), 3) AS ci_high FROM ds""",
    "two_sample_bootstrap": f"""WITH {SCORES}, ix AS (SELECT label AS side, row_number() OVER (PARTITION BY label ORDER BY {_part("id")}, id) - 1 AS i, score AS x, count(*) OVER (PARTITION BY label) AS n FROM scores),
dr AS (SELECT rd, side, x FROM (SELECT rd, side, CASE WHEN side = 0 THEN {_drawn('side0', 'rd', 'k', 'n')} ELSE {_drawn('side1', 'rd', 'k', 'n')} END AS i FROM range(0, 1000) AS r(rd), (SELECT side, i AS k, n FROM ix)) JOIN ix USING (side, i)),
every AS (SELECT * FROM dr UNION ALL SELECT -1, side, x FROM ix),
g AS (SELECT rd, x, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS n1 FROM every GROUP BY ALL),
w AS (SELECT rd, sum(abs(f0 - f1) * (nxt - x)) AS w1 FROM (SELECT rd, x, lead(x) OVER o AS nxt, sum(n0) OVER o / sum(n0) OVER (PARTITION BY rd) AS f0, sum(n1) OVER o / sum(n1) OVER (PARTITION BY rd) AS f1 FROM g WINDOW o AS (PARTITION BY rd ORDER BY x)) GROUP BY rd)
SELECT round((SELECT w1 FROM w WHERE rd = -1), 3) AS value, round(quantile_cont(w1, 0.025), 3) AS ci_low, round(quantile_cont(w1, 0.975), 3) AS ci_high FROM w WHERE rd >= 0""",
    "parallel_edge_collapse": f"WITH {NETWORK} SELECT u, v, arg_min(edge_id, length_m * 1000000 + edge_id) AS edge_id FROM edges GROUP BY u, v",
    "edge_zones": f"WITH {NETWORK}, {ZONED} SELECT edge_id, zone FROM zoned",
    "zone_arcs": f"WITH {NETWORK}, {ZONED} SELECT i, j FROM arcs",
    "zone_hops": f"WITH RECURSIVE {NETWORK}, {ZONED}, h AS (SELECT DISTINCT z AS src, z AS dst, 0 AS hops FROM (SELECT i AS z FROM arcs UNION SELECT j FROM arcs) UNION SELECT src, j, hops + 1 FROM h JOIN arcs ON dst = i WHERE hops < 16) SELECT src, dst, min(hops) AS hops FROM h GROUP BY src, dst",
    "zone_sequence": f"WITH {NETWORK}, {ZONED}, {ROUTES} SELECT traj_id, CAST(count(*) AS INT) AS n, string_agg(CAST(zone AS VARCHAR), ',' ORDER BY pos) AS zones FROM zs GROUP BY traj_id",
    "markov_zone_counts": f"""WITH {NETWORK}, {ZONED}, {ROUTES}, z AS (SELECT traj_id, pos, CAST(zone AS VARCHAR) AS zone FROM zs UNION ALL SELECT traj_id, moves + 1, '$' FROM ends)
SELECT context, symbol, count(*) AS n FROM (SELECT coalesce(lag(zone, 2) OVER w, '^') || ',' || coalesce(lag(zone) OVER w, '^') AS context, zone AS symbol FROM z WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) GROUP BY ALL""",
    "rnldp_reports": f"WITH {NETWORK}, {ZONED}, {ROUTES}, {REPORTS} SELECT stage, category, n FROM reports",
    "rnldp_estimates": f"WITH {NETWORK}, {ZONED}, {ROUTES}, {REPORTS}, {ESTIMATES} SELECT stage, category, round(p, 6) AS p FROM model",
    "rnldp_logprob": f"""WITH {NETWORK}, {ZONED}, {ROUTES}, {REPORTS}, {ESTIMATES}, walk AS (SELECT a.traj_id, sum(ln(greatest(coalesce(p, 1e-12), 1e-12))) AS w FROM zs a JOIN zs b ON a.traj_id = b.traj_id AND b.pos = a.pos + 1 LEFT JOIN narcs na ON na.i = a.zone AND na.j = b.zone LEFT JOIN model m ON m.stage = 'step' AND m.category = na.arc GROUP BY a.traj_id)
SELECT e.traj_id, round(ln(greatest(a.p, 1e-12)) + ln(greatest(b.p, 1e-12)) + ln(greatest(c.p, 1e-12)) + coalesce(w, 0), 4) AS log_prob FROM ends e JOIN model a ON a.stage = 'start' AND a.category = e.s JOIN model b ON b.stage = 'end' AND b.category = e.e JOIN model c ON c.stage = 'length' AND c.category = least(e.moves, 24) LEFT JOIN walk w USING (traj_id)""",
    "near_edges": f"""WITH {NETWORK}, {DRIVES}, p AS (SELECT * FROM {utm('drv')}), e AS (SELECT edge_id, a.x AS ux, a.y AS uy, b.x - a.x AS dx, b.y - a.y AS dy FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
o AS (SELECT traj_id, pos, edge_id, x - ux AS px, y - uy AS py, dx, dy, least(greatest(((x - ux) * dx + (y - uy) * dy) / greatest(dx * dx + dy * dy, 1e-12), 0), 1) AS f FROM p, e)
SELECT traj_id, count(*) AS n, round(avg(d), 3) AS mean_offset_m FROM (SELECT traj_id, sqrt(pow(px - f * dx, 2) + pow(py - f * dy, 2)) AS d FROM o) WHERE d <= 200 GROUP BY traj_id""",
    "shadow_sets": f"""WITH {PTS}, tr AS (SELECT DISTINCT traj_id FROM pts), mem AS (SELECT shadow, traj_id FROM (SELECT shadow, traj_id, row_number() OVER (PARTITION BY shadow ORDER BY {u("'4'", "'shadow'", 'shadow', 'traj_id')}, traj_id) AS r FROM tr, range(0, 16) AS s(shadow)) WHERE r <= (SELECT greatest(1, round_even(count(*) * 0.5e0, 0)) FROM tr))
SELECT CAST(shadow AS INT) AS shadow, count(*) AS n, min(traj_id) AS first, max(traj_id) AS last FROM mem GROUP BY shadow""",
    "lira_scores": f"""WITH {PTS}, {CELLS}, {PAIRS}, tr AS (SELECT DISTINCT traj_id FROM pts), mem AS (SELECT shadow, traj_id FROM (SELECT shadow, traj_id, row_number() OVER (PARTITION BY shadow ORDER BY {u("'4'", "'shadow'", 'shadow', 'traj_id')}, traj_id) AS r FROM tr, range(0, 16) AS s(shadow)) WHERE r <= (SELECT greatest(1, round_even(count(*) * 0.5e0, 0)) FROM tr)),
c AS (SELECT shadow, context, symbol, count(*) AS n FROM pairs JOIN mem USING (traj_id) GROUP BY ALL), t AS (SELECT shadow, context, sum(n) AS total FROM c GROUP BY ALL), v AS (SELECT shadow, count(DISTINCT symbol) AS v FROM c GROUP BY ALL),
lp AS (SELECT traj_id, v.shadow, sum(ln((coalesce(n, 0) + 1e0) / (coalesce(total, 0) + v))) AS lp FROM pairs p CROSS JOIN v LEFT JOIN t ON t.shadow = v.shadow AND t.context = p.context LEFT JOIN c ON c.shadow = v.shadow AND c.context = p.context AND c.symbol = p.symbol GROUP BY ALL),
st AS (SELECT lp.traj_id, count(m.traj_id) AS ni, avg(lp) FILTER (m.traj_id IS NOT NULL) AS mi, greatest(coalesce(stddev_samp(lp) FILTER (m.traj_id IS NOT NULL), 0), 1e-6) AS si, count(*) - count(m.traj_id) AS no, avg(lp) FILTER (m.traj_id IS NULL) AS mo, greatest(coalesce(stddev_samp(lp) FILTER (m.traj_id IS NULL), 0), 1e-6) AS so,
 max(lp) FILTER (lp.shadow = 0) AS x FROM lp LEFT JOIN mem m ON m.shadow = lp.shadow AND m.traj_id = lp.traj_id GROUP BY lp.traj_id)
SELECT traj_id, round(sign(x) * ln(1 + abs(x)), 6) AS signed_log_score FROM (SELECT traj_id, (CASE WHEN ni = 0 OR no = 0 THEN 0 ELSE (-0.5 * ln({2 * math.pi!r} * si * si) - (x - mi) * (x - mi) / (2 * si * si)) - (-0.5 * ln({2 * math.pi!r} * so * so) - (x - mo) * (x - mo) / (2 * so * so)) END) AS x FROM st)""",
    "repetition_aggregate": f"WITH {WEEKLY}, s AS (SELECT result_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM weekly GROUP BY result_id) SELECT result_id, 'mean' AS metric, CAST(n AS INT) AS n_repetitions, round(m, 6) AS mean, round(m - {STUDENT}, 6) AS ci_low, round(m + {STUDENT}, 6) AS ci_high FROM s",
    "seed_aggregate": f"""WITH {WEEKLY}, s AS (SELECT result_id, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, avg(attack_runtime_s) AS rt, CASE WHEN count(DISTINCT n_probes) = 1 THEN min(n_probes) END AS n_probes FROM weekly GROUP BY result_id)
SELECT 'e' AS exp_id, 'h' AS config_hash, result_id, 'mean' AS metric, CAST(n AS INT) AS n_repetitions, round(m, 6) AS value, round(m - {STUDENT}, 6) AS ci_low, round(m + {STUDENT}, 6) AS ci_high, round(rt, 6) AS attack_runtime_s, 5 AS n_pool, n_probes FROM s""",
    "headline_rows": f"WITH {RESULTS} SELECT family, target_ref, metric, known_points, round(value, 6) AS value FROM res WHERE metric = {HEAD} QUALIFY row_number() OVER (PARTITION BY family, target_ref ORDER BY known_points DESC) = 1",
    "risk_matrix": f"""WITH {RESULTS}, c AS (SELECT * FROM res WHERE family <> 'utility' AND metric = {HEAD} QUALIFY row_number() OVER (PARTITION BY family, target_ref ORDER BY known_points DESC) = 1)
SELECT 'h' AS config_hash, target_ref, round(max(value) FILTER (family = 'membership_inference'), 6) AS membership_inference, round(max(value) FILTER (family = 'reidentification'), 6) AS reidentification FROM c GROUP BY target_ref""",
    "attack_summary": f"WITH {RESULTS} SELECT family, target_ref, known_points, round(max(value) FILTER (metric = 'auc'), 6) AS auc, round(max(value) FILTER (metric = 'top1_acc'), 6) AS top1_acc FROM res GROUP BY family, target_ref, known_points",
    "over_budget": f"WITH {RESULTS} SELECT result_id, arg_min(attack_runtime_s, metric) AS attack_runtime_s FROM res GROUP BY result_id HAVING arg_min(attack_runtime_s, metric) > 49.5",
    "mask_unmeasurable": f"""WITH {RESULTS}, b AS (SELECT *, family = 'membership_inference' AND metric = 'tpr@fpr=0.001' AND n_nonmembers * 0.001e0 < 1 - 1e-9 AS bad FROM res)
SELECT result_id, metric, CASE WHEN NOT bad THEN round(value, 6) END AS value, CASE WHEN NOT bad THEN round(ci_low, 6) END AS ci_low, CASE WHEN bad THEN result_id || ' ' || metric || ': ' || n_nonmembers || ' non-members cannot resolve it' END AS warning FROM b""",
    "results_union": f"WITH {RESULTS} SELECT family, count(*) AS n, round(sum(value), 4) AS total FROM res GROUP BY family",
    "arm_merge": """WITH s AS (SELECT l_returnflag AS target_ref, 'line' AS stat, CAST(l_linenumber AS DOUBLE) AS value FROM lineitem UNION ALL SELECT l_returnflag, 'flags', CAST(length(l_returnflag) AS DOUBLE) FROM lineitem)
SELECT target_ref, stat, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM s GROUP BY ALL""",
    "threshold_survival": f"WITH {SCORES} SELECT i / 10e0 AS threshold, (SELECT count(*) FROM scores WHERE score % 1000 / 1000 >= i / 10e0) AS survivors FROM range(0, 11) AS r(i)",
    "segment_view": f"WITH {NETWORK}, {ZONED}, {ROUTES} SELECT traj_id, CAST(traj_id AS BIGINT) AS user_id, CAST(pos - 1 AS INT) AS pos, edge_id FROM rt",
    "strong_component": f"""WITH RECURSIVE {NETWORK}, reach AS (SELECT DISTINCT u AS a, u AS b FROM edges UNION SELECT a, v FROM reach JOIN edges ON b = u),
both_ways AS (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a), parts AS (SELECT a, min(b) AS part FROM both_ways GROUP BY a)
SELECT a AS node_id FROM parts WHERE part = (SELECT part FROM parts GROUP BY part ORDER BY count(*) DESC, part LIMIT 1)""",
    "shortest_paths": f"WITH {NETWORK}, " + ", ".join(["d0 AS (SELECT CAST(0 AS BIGINT) AS n, 0e0 AS d)"] + [f"d{k} AS MATERIALIZED (SELECT n, min(d) AS d FROM (SELECT n, d FROM d{k - 1} UNION ALL SELECT v, d + length_m FROM d{k - 1} JOIN edges ON n = u) GROUP BY n)" for k in range(1, 25)]) + " SELECT n AS node_id, round(d, 3) AS metres FROM d24",
    "network_visits": f"WITH {NETWORK}, {ZONED}, {ROUTES} SELECT zone AS cell, count(*) AS n FROM rt JOIN zoned USING (edge_id) GROUP BY zone",
    "route_lengths": f"WITH {NETWORK}, {ZONED}, {ROUTES} SELECT traj_id, round(sum(length_m), 3) AS length_m FROM rt JOIN edges USING (edge_id) GROUP BY traj_id",
    "unpaired_cell_jsd": f"""WITH {NETWORK}, {ZONED}, {ROUTES}, c AS (SELECT zone, CAST(count(*) FILTER (CAST(traj_id AS BIGINT) % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (CAST(traj_id AS BIGINT) % 2 = 1) AS DOUBLE) AS b FROM rt JOIN zoned USING (edge_id) GROUP BY zone),
s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS jsd FROM s""",
    "display_order": """SELECT *, row_number() OVER (ORDER BY CASE scope WHEN 'raw' THEN 1 WHEN 'protected' THEN 2 WHEN 'synthetic' THEN 3 ELSE 4 END, CASE WHEN arm_id IN ('', 'none') THEN 0 ELSE 1 END, arm_id, coalesce(epsilon, 'inf'::DOUBLE), coalesce(unit_m, 'inf'::DOUBLE), target_ref) AS place FROM (
SELECT DISTINCT *, scope || ':' || arm_id AS target_ref FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'protected' ELSE 'synthetic' END AS scope,
CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_returnflag = 'N' THEN 'none' ELSE 'arm_' || l_returnflag END AS arm_id, CASE WHEN l_quantity > 25 THEN l_tax END AS epsilon, CASE WHEN l_quantity > 10 THEN l_discount END AS unit_m FROM lineitem))""",
    "params_order": """SELECT DISTINCT 'epsilon=' || CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS VARCHAR) ELSE 'x' END || ',unit_m=' || l_linenumber AS params, 'epsilon' AS name, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DOUBLE) END AS first, CAST(l_linenumber AS DOUBLE) AS second FROM lineitem""",
    "results_csv": f"WITH {RESULTS} SELECT result_id || ':' || metric AS metric_id, 1 AS seed, 2 AS split_seed, family, known_points, CASE WHEN known_points <> 1992 THEN round(value, 4) END AS value, known_points = 1992 AS undefined FROM res",
    "tradeoff_points": f"""WITH {RESULTS}, h AS (SELECT * FROM res WHERE family <> 'utility' AND metric = {HEAD} QUALIFY row_number() OVER (PARTITION BY family, target_ref ORDER BY known_points DESC) = 1),
x AS (SELECT target_ref, value AS jsd FROM res WHERE family = 'utility' AND metric = 'auc' AND known_points = 1995)
SELECT family, metric, true AS share, target_ref, CASE WHEN target_ref = 'raw' THEN 0e0 ELSE round(jsd, 6) END AS x, round(value, 6) AS y FROM h LEFT JOIN x USING (target_ref)""",
    "epsilon_points": f"WITH {RESULTS} SELECT family, metric, CASE WHEN target_ref = 'raw' THEN '' ELSE 'none' END AS arm_id, 100e0 AS unit_m, known_points, (known_points - 1990) / 2e0 AS epsilon, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM res WHERE family <> 'utility' AND metric = {HEAD} AND known_points % 2 = 0",
    "knowledge_points": f"WITH {RESULTS} SELECT family, metric, target_ref, known_points, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM res WHERE family <> 'utility' AND metric = {HEAD}",
    "mechanism_bars": f"WITH {RESULTS} SELECT family, metric, target_ref, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, true AS share FROM res WHERE family <> 'utility' AND metric = {HEAD} QUALIFY row_number() OVER (PARTITION BY family, target_ref ORDER BY known_points DESC) = 1",
    "runtime_bars": f"WITH {RESULTS} SELECT result_id, arg_min(attack_runtime_s, metric) AS attack_runtime_s FROM res GROUP BY result_id",
    "metrics_long": f"""WITH {RESULTS} SELECT 'e' AS exp_id, 'h' AS config_hash, 1 AS seed, family, target_ref, known_points, CASE WHEN family = 'utility' AND metric = 'auc' THEN 'cell_js_divergence' ELSE metric END AS metric,
CASE WHEN known_points <> 1993 THEN round(value, 6) END AS value, ci_low, ci_high, 1000 AS n_bootstrap FROM res WHERE family <> 'utility' OR known_points = 1995""",
    "run_labels": """SELECT l_returnflag AS exp_id, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ', ' ORDER BY CAST(l_linenumber AS VARCHAR)) AS seeds, '2' AS split_seeds,
coalesce(string_agg(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber * 10 AS VARCHAR) END, ', ' ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber * 10 AS VARCHAR) END), 'all') AS users, '1000' AS bootstrap FROM lineitem GROUP BY l_returnflag""",
    "report_load": f"""WITH g AS (SELECT l_linenumber AS seed, l_returnflag AS target_ref, avg(l_discount) AS value, count(*) AS n_probes FROM lineitem GROUP BY ALL),
s AS (SELECT target_ref, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, CASE WHEN count(DISTINCT n_probes) = 1 THEN CAST(min(n_probes) AS INT) END AS n_probes FROM g GROUP BY target_ref)
SELECT 'e' AS exp_id, 'utility' AS family, target_ref, 'utility:' || target_ref AS result_id, 'length_dist_error' AS metric, round(m, 6) AS value, round(m - {STUDENT}, 6) AS ci_low, round(m + {STUDENT}, 6) AS ci_high,
5 AS n_pool, n_probes, 1000 AS n_bootstrap, CAST(NULL AS INT) AS max_users, 2 AS split_seed, CAST(NULL AS VARCHAR) AS warning FROM s""",
    "unpaired_jsd_bootstrap": f"""WITH {NETWORK}, {ZONED}, {ROUTES}, v AS (SELECT traj_id, CAST(traj_id AS BIGINT) % 2 AS side, zone AS cell, count(*) AS visits FROM rt JOIN zoned USING (edge_id) GROUP BY ALL),
ix AS (SELECT traj_id, side, row_number() OVER (PARTITION BY side ORDER BY {_part("traj_id")}, traj_id) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM (SELECT DISTINCT traj_id, side FROM v)),
dr AS (SELECT rd, side, i, count(*) AS times FROM (SELECT rd, side, CASE WHEN side = 0 THEN {_drawn('side0', 'rd', 'k', 'n')} ELSE {_drawn('side1', 'rd', 'k', 'n')} END AS i FROM range(0, 1000) AS r(rd), (SELECT side, i AS k, n FROM ix)) GROUP BY ALL),
c AS (SELECT rd, cell, CAST(coalesce(sum(times * visits) FILTER (side = 0), 0) AS DOUBLE) AS a, CAST(coalesce(sum(times * visits) FILTER (side = 1), 0) AS DOUBLE) AS b FROM (SELECT rd, side, times, traj_id FROM dr JOIN ix USING (side, i) UNION ALL SELECT -1, side, 1, traj_id FROM ix) JOIN v USING (traj_id, side) GROUP BY ALL),
s AS (SELECT rd, a / sum(a) OVER (PARTITION BY rd) AS p, b / sum(b) OVER (PARTITION BY rd) AS q FROM c),
d AS (SELECT rd, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM s GROUP BY rd)
SELECT round((SELECT d FROM d WHERE rd = -1), 6) AS value, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high FROM d WHERE rd >= 0""",
    "result_ids": f"""WITH {RESULTS} SELECT DISTINCT result_id, metric, family, CASE WHEN target_ref = 'raw' THEN 'raw' ELSE 'protected' END AS scope, CASE WHEN target_ref = 'raw' THEN '' ELSE 'none' END AS mechanism, known_points AS k, metric <> 'none' AS share FROM res""",
}
