"""The registry's questions in ANSI SQL (as DuckDB reads it), over the same Parquet tables."""

from __future__ import annotations

from pingmill.functions import globe

R = 6371.0


def km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {R} * asin(CASE WHEN {a} > 1 THEN 1.0 ELSE sqrt({a}) END))"


PINGS = """
pings AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS maid, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, CAST(ts AS DATE) AS date, hour(ts) AS hour,
         110.0::DOUBLE + ((user_id * 37) % 80) / 100.0::DOUBLE
           + CASE WHEN event_id % 7 = 0 THEN ((event_id * 13) % 21 - 10) / 100.0::DOUBLE WHEN event_id % 5 = 0 THEN ((event_id * 11) % 7 - 3) / 200.0::DOUBLE ELSE 0.0::DOUBLE END AS longitude,
         -8.2::DOUBLE + ((user_id * 53) % 60) / 100.0::DOUBLE
           + CASE WHEN event_id % 7 = 0 THEN ((event_id * 17) % 21 - 10) / 100.0::DOUBLE WHEN event_id % 5 = 0 THEN ((event_id * 19) % 7 - 3) / 200.0::DOUBLE ELSE 0.0::DOUBLE END AS latitude
  FROM events)"""

PEOPLE = r"""
people AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS maid, d.k AS profile_no,
         nullif(CASE (c.c_custkey + d.k) % 4 WHEN 0 THEN 'female' WHEN 3 THEN '\N' ELSE 'male' END, '\N') AS sex,
         nullif(CASE (c.c_custkey + d.k) % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 4 THEN '\N' ELSE 'low' END, '\N') AS intensity,
         nullif(CASE WHEN (c.c_custkey + d.k) % 6 = 0 THEN '\N' ELSE r.r_name END, '\N') AS place1, n.n_name AS place2
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) d
  WHERE (d.k = 0 OR c.c_custkey % 3 = 0) AND c.c_custkey % 10 <> 9),
profiles AS (SELECT * FROM people WHERE profile_no = 0)"""

#: Areas of the suppliers: corners (part 0: the ring, 1: the hole), edges, and the pings strictly within.
AREAS = """
a AS (SELECT s_suppkey AS k, 'area' || s_suppkey AS name, 110.0::DOUBLE + (s_suppkey * 31) % 80 / 100.0::DOUBLE AS lon0, -8.2::DOUBLE + (s_suppkey * 47) % 60 / 100.0::DOUBLE AS lat0, 3 + s_suppkey % 7 AS r FROM supplier),
v AS (SELECT a.*, part, i, lon0 + (mx * r) / 800.0::DOUBLE AS x, lat0 + (my * r) / 800.0::DOUBLE AS y
      FROM a, (VALUES (0, 0, 0, 0), (0, 1, 8, 0), (0, 2, 8, 4), (0, 3, 4, 4), (0, 4, 4, 8), (0, 5, 0, 8), (1, 0, 1, 1), (1, 1, 3, 1), (1, 2, 3, 3), (1, 3, 1, 3)) t(part, i, mx, my)
      WHERE part = 0 OR k % 3 = 0)"""
AREA_HITS = """
e AS (SELECT v.k, v.name, v.part, v.x AS ax, v.y AS ay, w.x AS cx, w.y AS cy, v.lon0, v.lat0, v.r
      FROM v JOIN v w ON v.k = w.k AND v.part = w.part AND w.i = (v.i + 1) % CASE WHEN v.part = 0 THEN 6 ELSE 4 END),
h AS (SELECT seq, name, part,
        sum(CASE WHEN (ay > latitude) <> (cy > latitude) AND longitude < (cx - ax) * (latitude - ay) / nullif(cy - ay, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS odd,
        bool_or((cx - ax) * (latitude - ay) - (cy - ay) * (longitude - ax) = 0 AND longitude BETWEEN least(ax, cx) AND greatest(ax, cx) AND latitude BETWEEN least(ay, cy) AND greatest(ay, cy)) AS touched
      FROM pings JOIN e ON longitude BETWEEN lon0 - 0.001 AND lon0 + r / 100.0 + 0.001 AND latitude BETWEEN lat0 - 0.001 AND lat0 + r / 100.0 + 0.001 GROUP BY ALL),
i AS (SELECT seq, name FROM h GROUP BY seq, name HAVING bool_or(part = 0 AND odd AND NOT touched) AND NOT bool_or(part = 1 AND (odd OR touched)))"""


def sql(deg: float, hex_deg: float, areas: dict, box: tuple, baseline: int, clip: tuple) -> dict[str, str]:
    cells = f"""
cells AS (SELECT *, 'g' || CAST(floor(longitude / {deg}::DOUBLE) AS BIGINT) || '_' || CAST(floor(latitude / {deg}::DOUBLE) AS BIGINT) AS cell FROM pings)"""
    cx = lambda c: f"((CAST(split_part({c}[2:], '_', 1) AS BIGINT) + 0.5) * {deg}::DOUBLE)"
    cy = lambda c: f"((CAST(split_part({c}[2:], '_', 2) AS BIGINT) + 0.5) * {deg}::DOUBLE)"
    night = "night AS (SELECT * FROM cells WHERE hour >= 22 OR hour <= 5)"
    home = lambda source, least: f"""
hc AS (SELECT maid, cell, count(*) AS n FROM {source} GROUP BY maid, cell),
hn AS (SELECT maid, count(DISTINCT date) AS n_nights FROM {source} GROUP BY maid),
homes AS (SELECT h.maid, h.cell AS home_cell, h.n AS n_home_pings, hn.n_nights, {cy('h.cell')} AS home_lat, {cx('h.cell')} AS home_lon
          FROM (SELECT *, row_number() OVER (PARTITION BY maid ORDER BY n DESC, cell) AS r FROM hc) h JOIN hn ON hn.maid = h.maid WHERE r = 1 AND n_nights >= {least})"""  # noqa: E731
    base = f"WITH {PINGS}"
    with_cells = f"{base}, {cells}"
    with_homes = f"{with_cells}, {night}, {home('night', 1)}"
    days = f"""{with_homes},
m0 AS (SELECT c.*, lag(cell) OVER (PARTITION BY maid, date ORDER BY timestamp, seq) AS b, avg(longitude) OVER (PARTITION BY maid, date) AS x, avg(latitude) OVER (PARTITION BY maid, date) AS y FROM cells c),
m1 AS (SELECT m0.*, home_cell, home_lat, home_lon FROM m0 LEFT JOIN homes h ON h.maid = m0.maid),
days AS (SELECT maid, date, count(*) AS n_pings, count(DISTINCT cell) AS n_cells, CAST(sum(CASE WHEN b IS NULL OR b <> cell THEN 1 ELSE 0 END) AS BIGINT) AS n_trips,
         sqrt(avg(pow({km('longitude', 'latitude', 'x', 'y')}, 2))) AS radius_km, max({km('longitude', 'latitude', 'home_lon', 'home_lat')}) AS max_dist_home_km,
         bool_and(coalesce(cell = home_cell, false)) AS stay_at_home FROM m1 GROUP BY maid, date)"""
    trips = f"{with_cells}, trips AS (SELECT maid, date, first(cell ORDER BY timestamp, seq) AS origin, last(cell ORDER BY timestamp, seq) AS dest, count(*) AS n_pings FROM cells GROUP BY maid, date)"
    flow = "flows AS (SELECT date, origin, dest, count(DISTINCT maid) AS n_devices, CAST(sum(n_pings) AS BIGINT) AS n_pings FROM trips GROUP BY date, origin, dest)"
    flows = f"{trips}, {flow}"
    first = lambda t: f"bd AS (SELECT DISTINCT date FROM {t} ORDER BY date LIMIT {baseline})"
    summary = """count(DISTINCT maid) AS n_devices, count(*) AS n_device_days, CAST(sum(n_pings) AS BIGINT) AS n_pings, CAST(sum(n_trips) AS BIGINT) AS n_trips, avg(radius_km) AS radius_km, avg(n_cells) AS n_cells,
  avg(max_dist_home_km) AS max_dist_home_km, avg(CAST(stay_at_home AS DOUBLE)) AS stay_at_home, sum(n_pings)::DOUBLE / count(*) AS pings_per_device_day"""
    values = ("n_devices", "n_device_days", "n_pings", "n_trips", "radius_km", "n_cells", "max_dist_home_km", "stay_at_home", "pings_per_device_day")
    whole = ("n_devices", "n_device_days", "n_pings", "n_trips")

    def index(keys: str, on: str) -> str:
        select = ", ".join([f"{'s.' + v if v in whole else f'round(s.{v}, 6) AS {v}'}" for v in values] + [f"round(b.{v}, 6) AS {v}_baseline, round((s.{v} - b.{v}) / nullif(b.{v}, 0.0) * 100, 6) AS {v}_pct_change" for v in values])
        group = f"GROUP BY {keys}" if keys else ""
        return f"""{first('s')}, f AS (SELECT s.*, date IN (SELECT date FROM bd) AS is_baseline FROM s), b AS (SELECT {keys + ', ' if keys else ''}{', '.join(f'avg({v}) AS {v}' for v in values)} FROM f WHERE is_baseline {group})
SELECT CAST(s.date AS VARCHAR) AS date, {'s.' + keys + ', ' if keys else ''}s.is_baseline, {select} FROM f s LEFT JOIN b ON {on}"""

    occ = lambda w: f"{with_cells}, occ AS (SELECT timestamp - timestamp % {w} AS bucket, cell, count(DISTINCT maid) AS n_devices, count(*) AS n_pings FROM cells GROUP BY 1, 2)"
    points = f"""{base}, w0 AS (SELECT *, lag(timestamp) OVER w AS pt, lag(longitude) OVER w AS px, lag(latitude) OVER w AS py, row_number() OVER w - 1 AS idx FROM pings WINDOW w AS (PARTITION BY maid ORDER BY timestamp, seq)),
points AS (SELECT maid, idx, format('{{:02d}}:{{:02d}}:{{:02d}}', timestamp % 86400 // 3600, timestamp % 3600 // 60, timestamp % 60) AS time, timestamp % 86400 AS tsec,
           round(coalesce(CASE WHEN timestamp > pt THEN {km('px', 'py', 'longitude', 'latitude')} / ((timestamp - pt) / 3600.0::DOUBLE) END, 0.0), 1) AS speed_kmh, round(longitude, 6) AS lon, round(latitude, 6) AS lat FROM w0)"""
    speed = f"""{base}, w0 AS (SELECT *, lag(timestamp) OVER w AS pt, lag(longitude) OVER w AS px, lag(latitude) OVER w AS py FROM pings WINDOW w AS (PARTITION BY maid ORDER BY timestamp, seq)),
flagged AS (SELECT *, coalesce((timestamp - pt) / 60.0::DOUBLE >= 0.1 AND timestamp > pt AND {km('px', 'py', 'longitude', 'latitude')} / nullif((timestamp - pt) / 60.0::DOUBLE / 60.0, 0) > 120, false) AS bad FROM w0)"""
    conc = lambda keys, source: f"""{with_cells}, {source}, r AS (SELECT *, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY n) AS i FROM g)
SELECT {f'CAST({keys} AS VARCHAR) AS {keys}, ' if keys else ''}round(sum(n::DOUBLE * n) / pow(sum(n), 2), 6) AS hhi, round(2 * sum(i::DOUBLE * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r {'GROUP BY ' + keys if keys else ''}"""  # noqa: E731
    g_day = "g AS (SELECT date, cell, count(*) AS n FROM cells GROUP BY date, cell)"
    g_all = "g AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell)"
    spans = f"{base}, sp AS (SELECT maid, count(*) AS n, {km('min(longitude)', 'min(latitude)', 'max(longitude)', 'max(latitude)')} AS span_km FROM pings GROUP BY maid HAVING count(*) >= 5)"
    cell_map = f"""{with_homes}, {PEOPLE}, named AS (SELECT maid, first(place1 ORDER BY profile_no) AS label FROM people WHERE place1 IS NOT NULL GROUP BY maid),
lc AS (SELECT home_cell, label, count(*) AS n FROM homes JOIN named USING (maid) GROUP BY home_cell, label),
cm AS (SELECT home_cell, label FROM (SELECT *, row_number() OVER (PARTITION BY home_cell ORDER BY n DESC, label) AS r FROM lc) WHERE r = 1)"""
    place = f"""{cell_map}, trips AS (SELECT maid, date, first(cell ORDER BY timestamp, seq) AS origin, last(cell ORDER BY timestamp, seq) AS dest, count(*) AS n_pings FROM cells GROUP BY maid, date), {flow},
pf AS (SELECT date, coalesce(a.label, 'unknown') AS origin_place, coalesce(b.label, 'unknown') AS dest_place, CAST(sum(n_devices) AS BIGINT) AS n_devices, CAST(sum(n_pings) AS BIGINT) AS n_pings
       FROM flows f LEFT JOIN cm a ON a.home_cell = f.origin LEFT JOIN cm b ON b.home_cell = f.dest GROUP BY 1, 2, 3)"""
    people = f"WITH {PEOPLE}"
    both = f"{base}, {PEOPLE}, j AS (SELECT p.maid, p.date, sex, intensity, place1 FROM pings p LEFT JOIN profiles q ON q.maid = p.maid)"
    levels = ("high", "medium", "low")
    q, r = f"((longitude * {(3**0.5 / 3)!r} - latitude / 3) / {hex_deg}::DOUBLE)", f"(latitude * {(2 / 3)!r} / {hex_deg}::DOUBLE)"
    hexes = f"""{base}, h0 AS (SELECT {q} AS q, {r} AS r FROM pings), h1 AS (SELECT q, r, -q - r AS s FROM h0), h2 AS (SELECT *, round(q) AS a, round(r) AS b, round(s) AS c FROM h1),
h3 AS (SELECT *, abs(a - q) AS da, abs(b - r) AS db, abs(c - s) AS dc FROM h2),
hx AS (SELECT CAST(CASE WHEN da > db AND da > dc THEN -b - c ELSE a END AS BIGINT) AS x, CAST(CASE WHEN da > db AND da > dc THEN b WHEN db > dc THEN -a - c ELSE b END AS BIGINT) AS y FROM h3)"""
    ring = lambda pts: " + ".join(
        f"CASE WHEN ({y1}::DOUBLE > latitude) <> ({y2}::DOUBLE > latitude) AND longitude < ({x2}::DOUBLE - {x1}::DOUBLE) * (latitude - {y1}::DOUBLE) / nullif({y2}::DOUBLE - {y1}::DOUBLE, 0) + {x1}::DOUBLE THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in zip(pts, [*pts[1:], pts[0]], strict=True)
    ).replace("(-", "((-1)*").replace("> -", "> (-1)*")
    # Points on an edge or a corner are not within.
    edge = lambda pts: " OR ".join(
        f"(({x2} - ({x1}))::DOUBLE * (latitude - ({y1})::DOUBLE) = ({y2} - ({y1}))::DOUBLE * (longitude - ({x1})::DOUBLE) AND longitude BETWEEN {min(x1, x2)}::DOUBLE AND {max(x1, x2)}::DOUBLE AND latitude BETWEEN ({min(y1, y2)})::DOUBLE AND ({max(y1, y2)})::DOUBLE)"
        for (x1, y1), (x2, y2) in zip(pts, [*pts[1:], pts[0]], strict=True)
    )
    inside = " UNION ALL ".join(f"SELECT seq, '{name}' AS name FROM pings WHERE ({ring(pts)}) % 2 = 1 AND NOT ({edge(pts)})" for name, pts in areas.items())
    hx, hy = f"{hex_deg * 3**0.5!r} * (x + y / 2)", f"{hex_deg * 1.5!r} * y"
    half, size = hex_deg * 3**0.5 / 2, hex_deg
    corners = ((0.0, size), (half, size / 2), (half, -size / 2), (0.0, -size), (-half, -size / 2), (-half, size / 2))
    bars = lambda c, most: f"{days} SELECT CAST(least(floor(least({c}, {most}::DOUBLE) * 40 / {most}::DOUBLE), 39) AS BIGINT) AS bin, count(*) AS n FROM days WHERE {c} IS NOT NULL GROUP BY 1"
    west, south, east, north = box
    stats = ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(median({c}), 6) AS median_{c}" for c in ("n_pings", "n_cells", "n_trips", "radius_km"))
    seg = f"""{base}, w0 AS (SELECT *, lag(timestamp) OVER w AS pt, format('{{:.6f}} {{:.6f}}', longitude, latitude) AS p, lag(format('{{:.6f}} {{:.6f}}', longitude, latitude)) OVER w AS pp FROM pings WINDOW w AS (PARTITION BY maid ORDER BY timestamp, seq)),
w1 AS (SELECT *, coalesce(timestamp - pt > 1800, false) AS gap, CAST(sum(CASE WHEN timestamp - pt > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY maid ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM w0)
SELECT maid, 'move' AS kind, segment, count(*) AS n, min(timestamp) AS start, max(timestamp) AS "end", '' AS label, string_agg(p, ';' ORDER BY timestamp, seq) AS line FROM w1 GROUP BY maid, segment HAVING count(*) >= 2
UNION ALL SELECT maid, 'gap', segment, 2, pt, timestamp, CASE WHEN timestamp - pt >= 3600 THEN format('+{{}}h {{:02d}}m', (timestamp - pt) // 3600, (timestamp - pt) % 3600 // 60) ELSE '' END, pp || ';' || p FROM w1 WHERE gap"""
    day = "CAST(date AS VARCHAR) AS date"
    meet = "CAST(sum(n_devices * (n_devices - 1) // 2) AS BIGINT) AS meeting_index"
    return {
        "ping_clean": f"{base} SELECT seq, maid, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, timestamp, {day}, hour FROM pings",
        "speed_outliers": f"{speed} SELECT seq, maid, timestamp FROM flagged WHERE bad",
        "speed_filtered_counts": f"{speed} SELECT {day}, count(*) AS n_pings FROM flagged WHERE NOT bad GROUP BY date",
        "people_clean": f"{people} SELECT maid, CAST(profile_no AS BIGINT) AS profile_no, sex, intensity, place1, place2 FROM people",
        "people_profiles": f"{people} SELECT maid, sex, intensity, place1, place2 FROM profiles",
        "daily_counts": f"{base} SELECT {day}, count(*) AS n_pings, count(DISTINCT maid) AS n_devices FROM pings GROUP BY date",
        "daily_counts_merged": f"{base} SELECT {day}, count(*) AS n_pings, count(DISTINCT maid) AS n_devices FROM pings GROUP BY date",
        "hourly_counts": f"{base} SELECT timestamp - timestamp % 3600 AS bucket, count(*) AS n_pings FROM pings GROUP BY 1",
        "hourly_zero_filled": f"{base}, h AS (SELECT timestamp - timestamp % 3600 AS bucket, count(*) AS n FROM pings GROUP BY 1), e AS (SELECT unnest(range((SELECT min(bucket) FROM h), (SELECT max(bucket) FROM h) + 1, 3600)) AS bucket) SELECT e.bucket, coalesce(n, 0) AS n_pings FROM e LEFT JOIN h USING (bucket)",
        "diurnal_by_hour_days": f"{base} SELECT hour, count(*) AS n_pings, count(DISTINCT date) AS n_days, round(count(*)::DOUBLE / count(DISTINCT date), 6) AS mean_pings FROM pings GROUP BY hour",
        "diurnal_overall": f"{base}, d AS (SELECT count(DISTINCT date) AS n_days FROM pings) SELECT hour, count(*) AS n_pings, any_value(n_days) AS n_days, round(count(*)::DOUBLE / any_value(n_days), 6) AS mean_pings FROM pings, d GROUP BY hour",
        "grid_daily": f"{with_cells} SELECT {day}, cell, count(*) AS count FROM cells GROUP BY date, cell",
        "grid_total": f"{with_cells} SELECT cell, count(*) AS count FROM cells GROUP BY cell",
        "grid_centroids": f"{with_cells} SELECT DISTINCT cell, round({cy('cell')}, 6) AS lat, round({cx('cell')}, 6) AS lon FROM cells",
        "top_cells": f"{with_cells} SELECT cell, count(*) AS count FROM cells GROUP BY cell ORDER BY 2 DESC, 1 LIMIT 100",
        "concentration_daily": conc("date", g_day),
        "concentration_overall": conc("", g_all),
        "occupancy_1h": f"{occ(3600)} SELECT * FROM occ",
        "occupancy_30min": f"{occ(1800)} SELECT * FROM occ",
        "occupancy_7h": f"{occ(25200)} SELECT * FROM occ",
        "meeting_index": f"{occ(3600)} SELECT bucket, {meet} FROM occ WHERE n_devices >= 2 GROUP BY bucket",
        "meeting_index_daily": f"{occ(3600)} SELECT CAST(DATE '1970-01-01' + CAST(bucket // 86400 AS INT) AS VARCHAR) AS date, {meet} FROM occ WHERE n_devices >= 2 GROUP BY 1",
        "crowding": f"{occ(25200)} SELECT bucket, {', '.join(f'count(*) FILTER (n_devices >= {k}) AS cells_n{k}' for k in (2, 5, 10, 20))} FROM occ WHERE n_devices >= 2 GROUP BY bucket",
        "night_counts": f"{with_cells}, {night} SELECT maid, cell, count(*) AS n FROM night GROUP BY maid, cell",
        "homes": f"{with_homes} SELECT maid, home_cell, n_home_pings, n_nights, round(home_lat, 6) AS home_lat, round(home_lon, 6) AS home_lon FROM homes",
        "homes_all_hours": f"{with_cells}, {home('cells', 3)} SELECT maid, home_cell, n_home_pings, n_nights, round(home_lat, 6) AS home_lat, round(home_lon, 6) AS home_lon FROM homes",
        "device_day_metrics": f"{days} SELECT maid, {day}, n_pings, n_cells, n_trips, round(radius_km, 6) AS radius_km, round(max_dist_home_km, 6) AS max_dist_home_km, stay_at_home FROM days",
        "daily_summary": f"{days}, s AS (SELECT date, {summary} FROM days GROUP BY date) SELECT {day}, {', '.join(v if v in whole else f'round({v}, 6) AS {v}' for v in values)} FROM s",
        "mobility_index": f"{days}, s AS (SELECT date, {summary} FROM days GROUP BY date), {index('', 'true')}",
        "mobility_index_by_group": f"{days}, {PEOPLE}, s AS (SELECT date, place1, {summary} FROM days JOIN (SELECT maid, place1 FROM profiles WHERE place1 IS NOT NULL) USING (maid) GROUP BY date, place1), {index('place1', 's.place1 = b.place1')}",
        "stay_at_home_by_date": f"{days} SELECT {day}, round(avg(CAST(stay_at_home AS DOUBLE)), 6) AS share FROM days GROUP BY date",
        "od_device_day": f"{trips} SELECT maid, {day}, origin, dest, n_pings FROM trips",
        "od_flows": f"{flows} SELECT {day}, origin, dest, n_devices, n_pings FROM flows",
        "od_flows_undirected": f"{trips} SELECT {day}, least(origin, dest) AS origin, greatest(origin, dest) AS dest, count(DISTINCT maid) AS n_devices, CAST(sum(n_pings) AS BIGINT) AS n_pings FROM trips GROUP BY trips.date, 2, 3",
        "flow_distance": f"{flows} SELECT {day}, origin, dest, n_devices, n_pings, round({km(cx('origin'), cy('origin'), cx('dest'), cy('dest'))}, 6) AS od_distance_km FROM flows",
        "od_length_by_date": f"{flows} SELECT {day}, round(avg({km(cx('origin'), cy('origin'), cx('dest'), cy('dest'))}), 6) AS mean_km FROM flows GROUP BY date",
        "corridor_change": f"{flows}, {first('flows')}, b AS (SELECT origin, dest, avg(n_pings) AS v FROM flows WHERE date IN (SELECT date FROM bd) GROUP BY origin, dest) SELECT {day}, origin, dest, n_devices, n_pings, date IN (SELECT date FROM bd) AS is_baseline, round(v, 6) AS n_pings_baseline, round((n_pings - v) / v * 100, 6) AS n_pings_pct_change FROM flows LEFT JOIN b USING (origin, dest)",
        "corridor_change_min_flow": f"{flows}, {first('flows')}, b AS (SELECT origin, dest, avg(n_pings) AS v FROM flows WHERE date IN (SELECT date FROM bd) GROUP BY origin, dest) SELECT {day}, origin, dest, n_devices, n_pings, date IN (SELECT date FROM bd) AS is_baseline, round(v, 6) AS n_pings_baseline, round((n_pings - v) / v * 100, 6) AS n_pings_pct_change FROM flows JOIN b USING (origin, dest) WHERE v >= 2",
        "cell_group_map": f"{cell_map} SELECT * FROM cm",
        "od_by_place": f"{place} SELECT {day}, origin_place, dest_place, n_devices, n_pings FROM pf",
        "net_flows": f"{place} SELECT CAST(a.date AS VARCHAR) AS date, a.origin_place AS pair_a, a.dest_place AS pair_b, a.n_pings - coalesce(b.n_pings, 0) AS net_n_pings FROM pf a LEFT JOIN pf b ON a.date = b.date AND a.origin_place = b.dest_place AND a.dest_place = b.origin_place WHERE a.origin_place < a.dest_place",
        "between_places": f"{flows} SELECT {day}, origin, dest, n_devices, n_pings FROM flows WHERE origin <> dest",
        "top_corridors": f"{flows}, t AS (SELECT origin, dest FROM flows GROUP BY origin, dest ORDER BY sum(n_pings) DESC, origin, dest LIMIT 10) SELECT {day}, origin, dest, n_devices, n_pings FROM flows JOIN t USING (origin, dest)",
        "occupancy_7h_merged": f"{occ(25200)} SELECT * FROM occ",
        "metric_quantiles": f"{days}, q AS (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0])::DOUBLE AS share) " + " UNION ALL ".join(f"SELECT '{c}' AS column, share, round(CAST((SELECT quantile_cont(CAST({c} AS DOUBLE), [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]) FROM days)[list_position([0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]::DOUBLE[], share)] AS DOUBLE), 6) AS value FROM q" for c in ("n_pings", "radius_km")),
        "trace_segments": seg,
        "trace_segments_sql": seg,
        "place_rollup": f"{base}, {PEOPLE}, d AS (SELECT maid, count(*) AS n FROM pings GROUP BY maid) SELECT place1, place2, CAST(GROUPING(place1, place2) AS BIGINT) AS level, count(*) AS n_devices, CAST(sum(n) AS BIGINT) AS n_pings FROM d LEFT JOIN profiles USING (maid) GROUP BY ROLLUP (place1, place2)",
        "trace_points": f"{points} SELECT * FROM points",
        "pick_top": f"{spans} SELECT maid, n, round(span_km, 6) AS span_km FROM sp ORDER BY sp.span_km DESC, maid LIMIT 8",
        "pick_mix": f"{spans}, b AS (SELECT *, CASE WHEN span_km >= 25 THEN 'long' WHEN span_km >= 5 THEN 'med' ELSE 'short' END AS band FROM sp), k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY span_km DESC, maid) AS r FROM b) SELECT maid, band, round(span_km, 6) AS span_km FROM k WHERE r <= CASE WHEN band = 'long' THEN 1 ELSE 10 END ORDER BY CASE band WHEN 'long' THEN 0 WHEN 'med' THEN 2 * r - 1 ELSE 2 * r END LIMIT 8",
        "asof_lookup": f"{points} SELECT maid, idx, tsec, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY maid ORDER BY tsec DESC, idx DESC) AS r FROM points WHERE tsec <= 43200) WHERE r = 1",
        "asof_join": f"{points}, t AS (SELECT * FROM (SELECT DISTINCT maid FROM points) CROSS JOIN (VALUES (21600), (43200), (64800)) v(tsec)), k AS (SELECT t.maid, t.tsec, p.idx, p.lon, p.lat, row_number() OVER (PARTITION BY t.maid, t.tsec ORDER BY p.tsec DESC, p.idx DESC) AS r FROM t LEFT JOIN points p ON p.maid = t.maid AND p.tsec <= t.tsec) SELECT maid, CAST(tsec AS BIGINT) AS tsec, idx, lon, lat FROM k WHERE r = 1",
        "burst_count": f"{points} SELECT a.maid, a.idx, count(*) AS n_near FROM points a JOIN points b ON a.maid = b.maid AND abs(a.lon - b.lon) < 0.001 AND abs(a.lat - b.lat) < 0.001 GROUP BY a.maid, a.idx",
        "timeline": f"{points} SELECT DISTINCT tsec FROM points",
        "timeline_bounds": f"{points} SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM points",
        "overview_mobility": f"{base} SELECT count(*) AS n_pings, count(DISTINCT maid) AS n_devices, min(timestamp) AS first, max(timestamp) AS last, round(min(longitude), 6) AS west, round(max(longitude), 6) AS east, round(min(latitude), 6) AS south, round(max(latitude), 6) AS north FROM pings",
        "value_counts": f"{people} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM profiles WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("sex", "intensity", "place1")),
        "crosstab": f"{people} SELECT place1, {', '.join(f'count(*) FILTER (intensity = {chr(39)}{v}{chr(39)}) AS {v}' for v in levels)} FROM profiles WHERE place1 IS NOT NULL AND intensity IS NOT NULL GROUP BY place1",
        "device_overlap": f"{base}, {PEOPLE}, a AS (SELECT DISTINCT maid FROM pings), b AS (SELECT DISTINCT maid FROM profiles) SELECT (SELECT count(*) FROM a) AS n_mobility, (SELECT count(*) FROM b) AS n_people, count(*) AS n_both, round(count(*) / (SELECT count(*) FROM a)::DOUBLE, 6) AS share FROM a JOIN b USING (maid)",
        "profile_match_rate": f"{both} SELECT {', '.join(f'round(count({c}) / count(*)::DOUBLE, 6) AS {c}_rate' for c in ('sex', 'intensity', 'place1'))} FROM j",
        "pivot_normalised": f"{both}, d AS (SELECT date, {', '.join(f'nullif(count(*) FILTER (intensity = {chr(39)}{v}{chr(39)}), 0) AS {v}' for v in levels)} FROM j WHERE intensity IS NOT NULL GROUP BY date) SELECT {day}, {', '.join(f'round({v} / avg({v}) OVER (), 6) AS {v}' for v in levels)} FROM d",
        "two_level_mean": f"{both}, d AS (SELECT sex, intensity, maid, date, count(*) AS n FROM j WHERE sex IS NOT NULL AND intensity IS NOT NULL GROUP BY ALL) SELECT sex, {', '.join(f'round(avg(n) FILTER (intensity = {chr(39)}{v}{chr(39)}), 6) AS {v}' for v in levels)} FROM d GROUP BY sex",
        "ping_vs_profile_share": f"{both}, a AS (SELECT place1, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS x FROM profiles WHERE place1 IS NOT NULL GROUP BY place1), b AS (SELECT place1, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS y FROM j WHERE place1 IS NOT NULL GROUP BY place1) SELECT place1, round(coalesce(x, 0.0), 6) AS profile_share, round(coalesce(y, 0.0), 6) AS ping_share, round(coalesce(y, 0.0) / nullif(coalesce(x, 0.0), 0.0), 6) AS ratio FROM a FULL JOIN b USING (place1)",
        "clipped_histogram": bars("radius_km", 20.0),
        "clipped_histogram_cells": bars("n_cells", 50.0),
        "clipped_histogram_home": bars("max_dist_home_km", 30.0),
        "hexbin_planar": f"{hexes} SELECT 'x' || x || '_' || y AS cell, count(*) AS n, round(log10(count(*)::DOUBLE), 6) AS log10_n FROM hx GROUP BY x, y",
        "hex_centroids": f"{hexes} SELECT DISTINCT 'x' || x || '_' || y AS cell, round({hex_deg * 1.5!r} * y, 6) AS lat, round({hex_deg * 3**0.5!r} * (x + y / 2), 6) AS lon FROM hx",
        "hex_boundaries": f"{hexes} SELECT DISTINCT 'x' || x || '_' || y AS cell, {', '.join(f'round({hx} + ({a!r}), 6) AS lon{k}, round({hy} + ({b!r}), 6) AS lat{k}' for k, (a, b) in enumerate(corners))} FROM hx",
        "grid_boundaries": f"{with_cells}, k AS (SELECT DISTINCT cell, CAST(split_part(cell[2:], '_', 1) AS BIGINT) AS x, CAST(split_part(cell[2:], '_', 2) AS BIGINT) AS y FROM cells) SELECT cell, {', '.join(f'round((x + {a}) * {deg}::DOUBLE, 6) AS lon{k}, round((y + {b}) * {deg}::DOUBLE, 6) AS lat{k}' for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))))} FROM k",
        "run_summary": f"{days} SELECT {stats} FROM days",
        "bbox_clip": f"{base} SELECT {day}, count(*) AS n_pings FROM pings WHERE longitude BETWEEN {west}::DOUBLE AND {east}::DOUBLE AND latitude BETWEEN ({south})::DOUBLE AND ({north})::DOUBLE GROUP BY date",
        "date_range_scan": f"{base} SELECT {day}, count(*) AS n_pings FROM pings WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' GROUP BY date",
        "sample": f"{base} SELECT seq, maid FROM pings ORDER BY md5('42/' || CAST(seq AS VARCHAR)), seq LIMIT 100",
        "area_clip": f"WITH {AREAS} SELECT name FROM v WHERE part = 0 GROUP BY name HAVING max(x) >= {clip[0]}::DOUBLE AND min(x) <= {clip[2]}::DOUBLE AND max(y) >= ({clip[1]})::DOUBLE AND min(y) <= ({clip[3]})::DOUBLE",
        "area_visits": f"{base}, {AREAS}, {AREA_HITS} SELECT coalesce(i.name, '') AS name, count(*) AS n_pings, count(DISTINCT pings.maid) AS n_devices FROM pings LEFT JOIN i USING (seq) GROUP BY 1",
        "point_in_polygon": f"{base}, i AS ({inside}) SELECT coalesce(name, '') AS name, count(*) AS n_pings FROM pings LEFT JOIN i USING (seq) GROUP BY 1",
    }


def globe_sql(frequency: int, coarse: int) -> dict[str, str]:
    """The queries over the spherical index: faces by the nearest centre, cells by rounded barycentric coordinates."""
    rows = ", ".join("(" + ", ".join(map(repr, [*f, *globe.middle(f), *(x for row in globe.shares(f) for x in row)])) + ")" for f in globe.faces())
    corners = ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in enumerate(globe.vertices()))
    columns = ", ".join(["v0", "v1", "v2", "mx", "my", "mz", *(f"{s}{c}" for s in "pqr" for c in "xyz")])
    part = lambda s: f"x * f.{s}x::DOUBLE + y * f.{s}y::DOUBLE + z * f.{s}z::DOUBLE"

    def mended(source: str, more: str, unit: int = 1) -> str:
        near = {s: f"round({s} / {unit}::DOUBLE)" for s in "abc"}
        off = {s: f"abs({near[s]} * {unit} - {s})" for s in "abc"}
        first = f"{off['a']} > {off['b']} AND {off['a']} > {off['c']}"
        return f"""SELECT {more}, CAST(CASE WHEN {first} THEN whole - {near['b']} - {near['c']} ELSE {near['a']} END AS BIGINT) AS i,
          CAST(CASE WHEN NOT ({first}) AND {off['b']} > {off['c']} THEN whole - {near['a']} - {near['c']} ELSE {near['b']} END AS BIGINT) AS j, whole FROM {source}"""

    name = "'s' || concat_ws('.', " + ", ".join(f"CASE WHEN {w} > 0 THEN v{k} || 'x' || CAST({w} AS BIGINT) END" for k, w in enumerate(("i", "j", "(whole - i - j)"))) + ")"
    base = f"""WITH {PINGS}, f({columns}) AS (VALUES {rows}),
    w AS (SELECT seq, maid, date, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM pings),
    g AS (SELECT seq, maid, date, x, y, z, arg_max(f, x * f.mx::DOUBLE + y * f.my::DOUBLE + z * f.mz::DOUBLE) AS f FROM w, f GROUP BY ALL),
    u AS (SELECT maid, date, f.v0 AS v0, f.v1 AS v1, f.v2 AS v2, {part('p')} AS p, {part('q')} AS q, {part('r')} AS r FROM g),
    s AS (SELECT *, p * {frequency} / (p + q + r) AS a, q * {frequency} / (p + q + r) AS b, r * {frequency} / (p + q + r) AS c, {frequency} AS whole FROM u),
    m AS ({mended('s', 'maid, date, v0, v1, v2')}), named AS (SELECT *, {name} AS cell FROM m)"""
    up = f"t AS (SELECT maid, v0, v1, v2, i * {coarse} AS a, j * {coarse} AS b, (whole - i - j) * {coarse} AS c, {coarse} AS whole FROM named), n AS ({mended('t', 'maid, v0, v1, v2', frequency)})"
    summed = ", ".join(f"sum(w * {c}) AS {c}" for c in "xyz")
    middle = f"""k(v, x, y, z) AS (VALUES {corners}), d AS (SELECT DISTINCT cell, v0, v1, v2, i, j, whole - i - j AS l FROM named),
    e AS (SELECT cell, v0 AS v, i AS w FROM d UNION ALL SELECT cell, v1, j FROM d UNION ALL SELECT cell, v2, l FROM d),
    o AS (SELECT cell, {summed} FROM e JOIN k ON k.v = e.v GROUP BY cell)"""
    return {
        "globe_daily": f"{base} SELECT CAST(date AS VARCHAR) AS date, cell, count(*) AS count FROM named GROUP BY ALL",
        "globe_centroids": f"{base}, {middle} SELECT cell, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM o",
        "globe_rollup": f"{base}, {up} SELECT {name} AS cell, count(*) AS n_pings, count(DISTINCT maid) AS n_devices FROM n GROUP BY 1",
    }
