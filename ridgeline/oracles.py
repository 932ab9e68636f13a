"""SQL (DuckDB) for the registered queries, written apart from their DataFrame forms."""

from __future__ import annotations

DET = """
det AS (
  SELECT stack_id, z_slice, cast(row_number() OVER (PARTITION BY stack_id, z_slice ORDER BY event_id) AS int) AS sperm_id, event_id,
         6.0::double + k::double / 10 AS length_um_geodesic, 1.0::double + (k % 20)::double / 40 AS tortuosity, 0.8::double + (event_id % 7)::double / 10 AS width_um,
         5::double + floor(value / 10) AS area_px, ((event_id % 314)::double - 157) / 100 AS orientation, centroid_x, centroid_y,
         centroid_y - (2 + k::double / 20) AS bbox_min_y, centroid_x - (2 + k::double / 20) AS bbox_min_x, centroid_y + (2 + k::double / 20) AS bbox_max_y, centroid_x + (2 + k::double / 20) AS bbox_max_x
  FROM (SELECT event_id, cast(user_id % (SELECT greatest(4, cast(floor(count(DISTINCT user_id) / 37.5) AS bigint)) FROM events) AS int) AS stack_id, cast(date_diff('day', date '2024-01-01', cast(ts AS date)) AS int) AS z_slice, cast(json_extract(props, '$.k') AS int) AS k, value,
               cast((event_id*event_id*31 + event_id*17) % 257 AS double) AS centroid_x, cast((event_id*event_id*37 + event_id*101) % 251 AS double) AS centroid_y FROM events))"""
CELL = DET + """,
cel AS (SELECT *, stack_id*100000 + cast(floor(centroid_x/12) AS int)*1000 + cast(floor(centroid_y/12) AS int) AS track_id, length_um_geodesic / tortuosity AS euc FROM det)"""
TRK = CELL + """,
agg AS (
  SELECT track_id, min(stack_id) AS stack_id, count(*) AS n_slices, min(z_slice) AS z_start, max(z_slice) AS z_end, max(length_um_geodesic) AS max_length_2d, max(euc) AS max_euc_2d, sum(area_px) AS sum_area_px,
         avg(centroid_x) AS mean_x, avg(centroid_y) AS mean_y, avg(z_slice) AS mean_z,
         first(centroid_x ORDER BY z_slice, sperm_id) AS x0, first(centroid_x ORDER BY z_slice DESC, sperm_id DESC) AS x1, first(centroid_y ORDER BY z_slice, sperm_id) AS y0, first(centroid_y ORDER BY z_slice DESC, sperm_id DESC) AS y1,
         first(area_px ORDER BY z_slice, sperm_id) AS a0, first(area_px ORDER BY z_slice DESC, sperm_id DESC) AS a1
  FROM cel GROUP BY track_id),
m1 AS (SELECT *, (z_end - z_start + 1) * 1.040460::double AS z_extent_um, (z_end - z_start) * 1.040460::double AS dz, sum_area_px * 0.756836::double * 0.756836::double * 1.040460::double AS volume_um3,
       (x1 - x0) * 0.756836::double AS dx, (y1 - y0) * 0.756836::double AS dy FROM agg),
m2 AS (SELECT *, sqrt(pow(greatest(max_length_2d, sqrt(dx*dx + dy*dy)), 2) + z_extent_um*z_extent_um) AS total_3d_length_um FROM m1),
trk AS (
  SELECT *, least(total_3d_length_um / greatest(sqrt(max_euc_2d*max_euc_2d + dz*dz), 0.1), 20.0::double) AS tortuosity_3d, greatest(a0, a1) / greatest(least(a0, a1), 0.001) AS taper_ratio,
         2 * sqrt(volume_um3 / greatest(total_3d_length_um, 0.1) / pi()) AS thickness_um, abs(asin(dz / greatest(sqrt(dx*dx + dy*dy + dz*dz), 1e-9))) * 180 / pi() AS pitch_deg, atan2(dy, dx) * 180 / pi() AS yaw_deg
  FROM m2),
qual AS (
  SELECT *, concat_ws(',', CASE WHEN total_3d_length_um > 15 THEN 'long' END, CASE WHEN tortuosity_3d > 1.5 THEN 'tortuous' END, CASE WHEN thickness_um > 2.0 THEN 'thick' END, CASE WHEN taper_ratio > 1.5 THEN 'taper' END, CASE WHEN n_slices < 1 THEN 'single_slice' END) AS quality_flags,
         NOT (total_3d_length_um > 15 OR tortuosity_3d > 1.5 OR thickness_um > 2.0 OR taper_ratio > 1.5 OR n_slices < 1) AS is_quality_track
  FROM trk),
aud AS (
  SELECT *, total_3d_length_um > 15 AS flag_long, tortuosity_3d > 1.5 AS flag_tortuous, thickness_um > 2.0 AS flag_thick, taper_ratio > 1.5 AS flag_taper, n_slices <= 1 AS flag_single_slice,
         (total_3d_length_um > 15)::int + (tortuosity_3d > 1.5)::int + (thickness_um > 2.0)::int + (taper_ratio > 1.5)::int + (n_slices <= 1)::int AS n_flags,
         concat_ws(',', CASE WHEN total_3d_length_um > 15 THEN 'long' END, CASE WHEN tortuosity_3d > 1.5 THEN 'tortuous' END, CASE WHEN thickness_um > 2.0 THEN 'thick' END, CASE WHEN taper_ratio > 1.5 THEN 'taper' END, CASE WHEN n_slices <= 1 THEN 'single_slice' END) AS reason_flagged
  FROM trk)"""
PAIR = DET + """,
par AS (
  SELECT a.stack_id, a.event_id AS a, b.event_id AS b, sqrt(pow(b.centroid_x - a.centroid_x, 2) + pow(b.centroid_y - a.centroid_y, 2)) AS d,
         a.bbox_min_x - 6 <= b.bbox_max_x + 6 AND a.bbox_max_x + 6 >= b.bbox_min_x - 6 AND a.bbox_min_y - 6 <= b.bbox_max_y + 6 AND a.bbox_max_y + 6 >= b.bbox_min_y - 6 AS overlap,
         a.width_um AS w0, b.width_um AS w1, a.length_um_geodesic AS l0, b.length_um_geodesic AS l1, a.area_px AS p0, b.area_px AS p1, abs(b.orientation - a.orientation) AS turn
  FROM det a JOIN det b ON a.stack_id = b.stack_id AND b.z_slice - a.z_slice IN (1, 2) AND abs(a.centroid_x - b.centroid_x) <= 40 AND abs(a.centroid_y - b.centroid_y) <= 40),
vot AS (SELECT *, (abs(w1-w0)/greatest(w0,1e-9) < 0.1478 AND w0 <> 0 AND w1 <> 0)::int + (abs(l1-l0)/greatest(l0,1e-9) < 0.1478 AND l0 <> 0 AND l1 <> 0)::int + (abs(p1-p0)/greatest(p0,1e-9) < 0.1478 AND p0 <> 0 AND p1 <> 0)::int
         + (CASE WHEN turn > pi()/2 THEN pi() - turn ELSE turn END < 28.1562 * pi() / 180)::int AS votes, CASE WHEN overlap THEN 1.5975 ELSE 1.0 END AS f
  FROM par WHERE overlap OR d <= 8.7613::double / (0.756836::double + 1e-9)),
edg AS (SELECT *, CASE WHEN overlap AND votes < 1 THEN 'overlap_but_' || votes || '_stable' WHEN NOT overlap AND d * 0.756836 > 12.1249 THEN 'centroid_jump' WHEN abs(w1-w0)/greatest(w0,1e-9) > 0.6534*f THEN 'width_jump'
         WHEN abs(l1-l0)/greatest(l0,1e-9) > 0.6521*f THEN 'length_jump' WHEN abs(p1-p0)/greatest(p0,1e-9) > 0.5692*f THEN 'area_jump' END AS reason FROM vot)"""
DRAW = DET + """,
pix AS (
  SELECT image, y, x, max(value) AS value FROM (
    SELECT stack_id::bigint * 1048576 + z_slice AS image, least(greatest(cast(floor(centroid_y + along * cos(orientation) + 0.5) AS int), 0), 255) AS y,
           least(greatest(cast(floor(centroid_x + along * sin(orientation) + 0.5) AS int), 0), 263) AS x, cast(100 + area_px AS int) AS value
    FROM (SELECT *, unnest(range(0, 2 * cast(ceil(length_um_geodesic) AS bigint)))::double / 2 - length_um_geodesic / 2 AS along FROM det) WHERE along < length_um_geodesic / 2)
  GROUP BY image, y, x)"""
#: Steps along an axis and across are counted in 1e-8 pixels. The two sweeps keep the least distance of each pixel.
TOPO = """own AS (SELECT pix.image, label, pix.y::bigint AS y, pix.x::bigint AS x FROM lab JOIN pix ON pix.image = lab.image AND pix.y = lab.y AND pix.x BETWEEN lo AND hi),
link AS (SELECT a.image, a.label, a.y AS ay, a.x AS ax, b.y AS by, b.x AS bx, CASE WHEN dy <> 0 AND dx <> 0 THEN 141421356 ELSE 100000000 END::bigint AS cost
         FROM own a JOIN (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx) WHERE dy <> 0 OR dx <> 0) ON true JOIN own b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx),
deg AS (SELECT own.image, own.label, y, x, count(cost) AS n, coalesce(sum(cost), 0) AS steps FROM own LEFT JOIN link ON link.image = own.image AND ay = y AND ax = x GROUP BY ALL),
fact AS (SELECT image, label, count(*) AS n_pixels, count(*) FILTER (WHERE n = 1) AS n_endpoints, count(*) FILTER (WHERE n > 2) AS n_branch_nodes, sum(steps)::bigint AS steps, min(row(y, x)) FILTER (WHERE n = 1) AS ending FROM deg GROUP BY ALL),
one (image, label, y, x, d) USING KEY (image, y, x) AS (SELECT image, label, ending[1], ending[2], 0::bigint FROM fact WHERE ending IS NOT NULL
     UNION SELECT l.image, l.label, l.by, l.bx, min(s.d + l.cost) FROM one s JOIN link l ON l.image = s.image AND l.ay = s.y AND l.ax = s.x LEFT JOIN recurring.one o ON o.image = l.image AND o.y = l.by AND o.x = l.bx WHERE o.d IS NULL OR s.d + l.cost < o.d GROUP BY ALL),
far AS (SELECT image, label, y, x FROM one QUALIFY row_number() OVER (PARTITION BY image, label ORDER BY d DESC, y, x) = 1),
two (image, label, y, x, d) USING KEY (image, y, x) AS (SELECT image, label, y, x, 0::bigint FROM far
     UNION SELECT l.image, l.label, l.by, l.bx, min(s.d + l.cost) FROM two s JOIN link l ON l.image = s.image AND l.ay = s.y AND l.ax = s.x LEFT JOIN recurring.two o ON o.image = l.image AND o.y = l.by AND o.x = l.bx WHERE o.d IS NULL OR s.d + l.cost < o.d GROUP BY ALL),
way AS (SELECT two.image, two.label, two.d, sqrt((two.y - far.y) ** 2 + (two.x - far.x) ** 2) AS straight FROM two JOIN far USING (image, label) QUALIFY row_number() OVER (PARTITION BY two.image, two.label ORDER BY two.d DESC, two.y, two.x) = 1)
SELECT image, label, n_pixels, round(CASE WHEN ending IS NULL THEN steps / 2e8 ELSE d / 1e8 END, 5) AS length_px_geodesic, round(CASE WHEN ending IS NULL THEN 1 ELSE d / 1e8 / (straight + 1e-9) END, 5) AS tortuosity, n_endpoints, n_branch_nodes, ending IS NULL AS has_loop
FROM fact LEFT JOIN way USING (image, label)"""
LABEL = """isl AS (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM pix WHERE {where}),
run AS (SELECT image, y, min(x) AS lo, max(x) AS hi, y * 4294967296::bigint + min(x) AS node FROM isl GROUP BY image, y, g),
adj AS (SELECT a.image, a.node AS a, b.node AS b FROM run a JOIN run b ON a.image = b.image AND (b.y = a.y + 1 OR b.y = a.y - 1) AND b.lo <= a.hi + 1 AND b.hi >= a.lo - 1),
rch AS (SELECT image, node AS n, node AS m FROM run ANTI JOIN (SELECT image, a AS node FROM adj WHERE b < a) USING (image, node) UNION SELECT r.image, adj.b, r.m FROM rch r JOIN adj ON adj.image = r.image AND adj.a = r.n),
lab AS (SELECT image, y, lo, hi, dense_rank() OVER (PARTITION BY image ORDER BY root) AS label FROM run JOIN (SELECT image, n AS node, min(m) AS root FROM rch GROUP BY image, n) USING (image, node))"""
DEPTH = """off AS (SELECT dy, dx FROM (SELECT unnest(range(-5, 6))::int AS dy), (SELECT unnest(range(-5, 6))::int AS dx)),
dep AS (
  SELECT p.image, p.y, p.x, min(dy * dy + dx * dx) FILTER (WHERE q.image IS NULL AND p.y + dy BETWEEN 0 AND 255 AND p.x + dx BETWEEN 0 AND 263)::bigint AS depth2
  FROM pix p JOIN off ON true LEFT JOIN pix q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY p.image, p.y, p.x)"""
DEGREE = """nbr AS (SELECT p.image, p.y, p.x FROM pix p JOIN (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)) ON true JOIN pix q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx),
deg AS (SELECT image, y, x, (count(*) - 1)::int AS degree FROM nbr GROUP BY image, y, x)"""
FACTS = TRK + """,
fac AS (
  SELECT stack_id, count(*) AS n_tracks, count(*) FILTER (WHERE n_slices > 1)::double AS multi_slice, coalesce(sum(n_slices) FILTER (WHERE n_slices > 1), 0)::double AS total_linked, coalesce(avg(n_slices) FILTER (WHERE n_slices > 1), 0) AS avg_depth,
         count(*) FILTER (WHERE n_slices <= 1)::double AS single_slice, count(*) FILTER (WHERE total_3d_length_um > 15)::double AS n_long, count(*) FILTER (WHERE tortuosity_3d > 1.5)::double AS n_tort,
         count(*) FILTER (WHERE thickness_um > 2.0)::double AS n_thick, count(*) FILTER (WHERE taper_ratio > 1.5)::double AS n_taper, median(total_3d_length_um) AS l3d_median_um, avg(total_3d_length_um) AS l3d_mean_um, median(z_extent_um) AS zextent_median_um
  FROM trk GROUP BY stack_id)"""


def _early(base, good, hard, med, tort, taper, raw, single, least, multi, long, xt, xp, short, iqr) -> str:
    targets = (("total_3d_length_um", 10.0), ("tortuosity_3d", 1.1), ("thickness_um", 1.2), ("taper_ratio", 1.0))
    g = ("avg((total_3d_length_um BETWEEN 8.5 AND 11.5)::int)", f"avg((tortuosity_3d <= {tort[0]})::int)", "avg((thickness_um BETWEEN 0.9 AND 1.8)::int)", f"avg((taper_ratio <= {taper[0]})::int)")
    h = ("avg((total_3d_length_um BETWEEN 5 AND 20)::int)", f"avg((tortuosity_3d <= {tort[1]})::int)", "avg((thickness_um BETWEEN 0.8 AND 2.2)::int)", f"avg((taper_ratio <= {taper[1]})::int)")
    terms = [f"{base} * count(*)"] + [f"{w} * {x}" for w, x in zip(good + hard, g + h, strict=True)] + [f"-{w} * abs(median({m}) - {t})" for w, (m, t) in zip(med, targets, strict=True)]
    terms += [f"-{raw[1]} * greatest(sum(n_slices) / count(*) - {raw[0]}, 0)", f"-{single[1]} * greatest(avg((n_slices <= 1)::int) - {single[0]}, 0)", f"-{multi[1]} * abs(avg((n_slices > 1)::int) - {multi[0]})"]
    terms += [f"-{long[1]} * greatest(avg((total_3d_length_um > 20)::int) - {long[0]}, 0)", f"-{xt[1]} * greatest(avg((tortuosity_3d > {tort[1]})::int) - {xt[0]}, 0)", f"-{xp[1]} * greatest(avg((taper_ratio > {taper[1]})::int) - {xp[0]}, 0)"]
    if least:
        terms.append(f"-{least[1]} * greatest({least[0]} - avg((n_slices > 1)::int), 0)")
    if short:
        terms.append(f"-{short[1]} * greatest(avg((total_3d_length_um < 8.5)::int) - {short[0]}, 0)")
    terms.append(f"-{iqr[1]} * greatest(quantile_cont(total_3d_length_um, 0.75) - quantile_cont(total_3d_length_um, 0.25) - {iqr[0]}, 0)")
    return f"WITH {TRK} SELECT stack_id, count(*) AS n_tracks, sum(n_slices)::bigint AS raw_count, round({' + '.join(f'({t})' for t in terms)}, 5) AS score FROM trk GROUP BY stack_id"


def _stats(metric: str, where: str, extra: str = "") -> str:
    return f"SELECT '{metric}' AS metric{extra}, {metric}::double AS x FROM {where}"


POP_ALL = ["total_3d_length_um", "z_extent_um", "volume_um3", "tortuosity_3d", "thickness_um"]
POP_QUALITY = ["pitch_deg", "yaw_deg", "taper_ratio"]
DESCRIBED = ["total_3d_length_um", "tortuosity_3d", "thickness_um", "taper_ratio"]
_pop = " UNION ALL ".join([_stats(m, "qual", ", 'all' AS population") for m in POP_ALL] + [_stats(m, "qual WHERE is_quality_track", ", 'quality' AS population") for m in POP_ALL + POP_QUALITY])
_desc = " UNION ALL ".join(_stats(m, "trk") for m in DESCRIBED)
_cols = "round(total_3d_length_um, 5) AS total_3d_length_um, round(z_extent_um, 5) AS z_extent_um, round(volume_um3, 5) AS volume_um3, round(tortuosity_3d, 5) AS tortuosity_3d, round(thickness_um, 5) AS thickness_um, round(pitch_deg, 5) AS pitch_deg, round(yaw_deg, 5) AS yaw_deg, round(taper_ratio, 5) AS taper_ratio, n_slices, z_start, z_end, max_length_2d, sum_area_px"

#: Edits in SQL, another way than rounds: a part of an object at a step is what pixels cut later than it reach, and a list of erasures made so far goes along.
EDITS = """edits AS (SELECT stack_id::bigint * 1048576 + z_slice AS image, event_id AS step, CASE WHEN width_um >= 1.3 THEN 'erase' ELSE 'split' END AS tool, centroid_y::int AS y, centroid_x::int AS x FROM det WHERE width_um >= 1.3 OR tortuosity >= 1.4),
off AS (SELECT a.i::int AS dy, b.i::int AS dx FROM range(-2, 3) a(i), range(-2, 3) b(i)),
near AS (SELECT dy, dx FROM off WHERE abs(dy) < 2 AND abs(dx) < 2),
cut AS (SELECT p.image, p.y, p.x, min(step) AS step FROM edits e JOIN off ON dy * dy + dx * dx < 6.25 JOIN pix p ON p.image = e.image AND p.y = e.y + dy AND p.x = e.x + dx WHERE tool = 'split' GROUP BY p.image, p.y, p.x),
aged AS (SELECT pix.image, pix.y, pix.x, coalesce(cut.step, 9223372036854775807) AS age FROM pix LEFT JOIN cut USING (image, y, x)),
era AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY step) AS n FROM edits WHERE tool = 'erase'),
spot AS (SELECT e.image, e.step, e.n, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE 1 + (1 - dy) * 3 + dx + 1 END AS place, a.y, a.x FROM era e JOIN near ON true JOIN aged a ON a.image = e.image AND a.y = e.y + dy AND a.x = e.x + dx WHERE age > e.step),
part AS (SELECT image, step, n, place, y, x FROM spot UNION SELECT p.image, p.step, p.n, p.place, a.y, a.x FROM part p JOIN near ON true JOIN aged a ON a.image = p.image AND a.y = p.y + dy AND a.x = p.x + dx AND a.age > p.step),
foe AS (SELECT s.image, s.n, s.place, list(p.n * 16 + p.place) FILTER (WHERE p.n IS NOT NULL) AS foes FROM spot s LEFT JOIN part p ON p.image = s.image AND p.y = s.y AND p.x = s.x AND p.n < s.n GROUP BY s.image, s.n, s.place),
made AS (SELECT DISTINCT image, 0::bigint AS n, []::bigint[] AS done FROM era UNION ALL SELECT m.image, m.n + 1, list_append(m.done, (m.n + 1) * 16 + min(f.place)) FROM made m JOIN era e ON e.image = m.image AND e.n = m.n + 1 LEFT JOIN foe f ON f.image = m.image AND f.n = m.n + 1 AND NOT list_has_any(coalesce(f.foes, []::bigint[]), m.done) GROUP BY m.image, m.n, m.done),
hit AS (SELECT p.image, p.y, p.x, min(p.step) AS step FROM made JOIN part p ON p.image = made.image AND p.n = made.n AND made.done[-1] = p.n * 16 + p.place GROUP BY p.image, p.y, p.x),
fate AS (SELECT pix.image, pix.y, pix.x, hit.step AS erased, cut.step AS cut FROM pix LEFT JOIN cut USING (image, y, x) LEFT JOIN hit USING (image, y, x))"""

SQL = {
    "src_zidx": f"WITH {DET} SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 0 THEN z_slice ELSE event_id::int END AS z_index FROM det WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, -1 FROM det WHERE event_id % 3 = 2",
    "src_one": f"WITH {DET} SELECT event_id, stack_id, z_slice, sperm_id FROM det WHERE z_slice = 15",
    "src_slices": f"WITH {DET} SELECT stack_id, z_slice, count(*) AS n FROM det WHERE z_slice IN (3, 5, 7, 8, 9, 10, 20, 21, 22) GROUP BY ALL",
    "src_gapwarn": f"WITH {DET}, z AS (SELECT DISTINCT stack_id, z_slice FROM det WHERE z_slice IN (0, 1, 2, 3, 4, 8, 10, 11, 12, 20, 21, 22, 29)), g AS (SELECT stack_id, lag(z_slice) OVER (PARTITION BY stack_id ORDER BY z_slice) AS previous, z_slice FROM z) SELECT * FROM g WHERE z_slice - previous > 1",
    "p_euc2d": f"WITH {DET} SELECT event_id, round(length_um_geodesic / tortuosity, 6) AS euc_um_2d FROM det",
    "a_track": f"WITH {TRK} SELECT track_id, n_slices, z_start, z_end, max_length_2d, round(max_euc_2d, 6) AS max_euc_2d, sum_area_px, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(mean_z, 6) AS mean_z, x0, x1, y0, y1, a0, a1 FROM agg",
    "p_metrics": f"WITH {TRK} SELECT track_id, {_cols} FROM trk",
    "p_flags": f"WITH {TRK} SELECT track_id, quality_flags, is_quality_track FROM qual",
    "f_quality": f"WITH {TRK} SELECT track_id, {_cols} FROM qual WHERE is_quality_track",
    "f_viz": f"WITH {TRK} SELECT track_id, round(tortuosity_3d, 5) AS tortuosity_3d FROM trk WHERE tortuosity_3d BETWEEN 0.95 AND 3.0",
    "p_tonum": "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE value::varchar END AS double) AS x FROM events WHERE event_id % 5 <> 0",
    "f_accept": f"WITH {DET} SELECT event_id, CASE WHEN area_px < 6.02 THEN 'short' WHEN length_um_geodesic * 4 < 6.02 THEN 'short' WHEN length_um_geodesic * 4 > 60 THEN 'long' WHEN width_um * 7 > 8.94 THEN 'wide' WHEN length_um_geodesic * 4 / (width_um * 7 + 1e-9) < 4.5 THEN 'ratio' WHEN event_id % 11 > 8 THEN 'branches' WHEN tortuosity > 1.4 THEN 'tortuous' WHEN event_id % 13 > 10 THEN 'endpoints' END AS reject_reason FROM det",
    "p_rows": f"WITH {DET} SELECT event_id, round(length_um_geodesic * 4, 3) AS length_px_geodesic, round(length_um_geodesic * 4 * 0.756836::double, 3) AS length_um_geodesic, round(area_px, 1) AS length_px_count, round(area_px * 0.756836::double, 3) AS length_um_count, round(width_um * 7, 2) AS width_px, round(width_um * 7 * 0.756836::double, 3) AS width_um, round(length_um_geodesic * 4 / (width_um * 7 + 1e-9), 3) AS length_width_ratio, round(tortuosity, 3) AS tortuosity, CASE WHEN event_id % 13 > 10 THEN 11 ELSE 2 END AS n_endpoints, CASE WHEN event_id % 11 > 8 THEN 1 ELSE 0 END AS n_branch_nodes, centroid_x, centroid_y, area_px, bbox_min_y, bbox_min_x, bbox_max_y, bbox_max_x, round(orientation, 3) AS orientation, '1' AS pipeline_version, cast(row_number() OVER (PARTITION BY stack_id, z_slice ORDER BY event_id) AS int) AS sperm_id FROM det",
    "src_natsort": "SELECT c_custkey, 'z' || lpad(length(c_custkey::varchar)::varchar, 10, '0') || c_custkey::varchar || '_a.tif' AS natural_key FROM customer",
    "f_roi": f"WITH {DET}, px AS (SELECT *, least(greatest(round_even(centroid_y, 0)::int, 0), 250) AS y, least(greatest(round_even(centroid_x, 0)::int, 0), 256) AS x FROM det) SELECT event_id FROM px WHERE EXISTS (SELECT 1 FROM det m WHERE m.z_slice = 15 AND px.y BETWEEN floor(m.bbox_min_y) AND floor(m.bbox_max_y) AND px.x BETWEEN floor(m.bbox_min_x) AND floor(m.bbox_max_x))",
    "trk_adjacent": f"WITH RECURSIVE {DET}, s AS (SELECT stack_id, z_slice, lead(z_slice) OVER (PARTITION BY stack_id ORDER BY z_slice) AS nx FROM (SELECT DISTINCT stack_id, z_slice FROM det)), q AS (SELECT b.stack_id, b.event_id AS b, a.event_id AS a, sqrt(pow(b.centroid_x - a.centroid_x, 2) + pow(b.centroid_y - a.centroid_y, 2)) AS d FROM det a JOIN s USING (stack_id, z_slice) JOIN det b ON b.stack_id = s.stack_id AND b.z_slice = s.nx AND abs(a.centroid_x - b.centroid_x) <= 12 AND abs(a.centroid_y - b.centroid_y) <= 12), par AS (SELECT b, arg_min(a, d * 1e9 + a) AS a FROM q WHERE d * 0.756836::double < 8.7613 GROUP BY b), r AS (SELECT event_id AS e, event_id AS root FROM det WHERE event_id NOT IN (SELECT b FROM par) UNION ALL SELECT p.b, r.root FROM r JOIN par p ON p.a = r.e) SELECT t.event_id, t.stack_id, dense_rank() OVER (PARTITION BY t.stack_id ORDER BY o.z_slice, o.sperm_id) AS track_no FROM r JOIN det t ON t.event_id = r.e JOIN det o ON o.event_id = r.root",
    "k_poly": f"WITH {DET}, e(x0, y0, x1, y1) AS (VALUES (40, 30, 210, 60), (210, 60, 150, 200), (150, 200, 120, 110), (120, 110, 40, 30)) SELECT event_id FROM det, e GROUP BY event_id, centroid_x, centroid_y HAVING count(*) FILTER (WHERE (y0 > centroid_y) <> (y1 > centroid_y) AND centroid_x < (x1 - x0) * (centroid_y - y0) / (y1 - y0)::double + x0) % 2 = 1",
    "j_span": f"WITH {TRK}, sp AS (SELECT track_id, min(z_slice) AS z_min_from_meas, max(z_slice) AS z_max_from_meas, count(*) AS n_rows_in_measurements FROM cel GROUP BY track_id) SELECT track_id, n_slices, coalesce(z_min_from_meas, -1) AS z_min_from_meas, coalesce(z_max_from_meas, -1) AS z_max_from_meas, coalesce(n_rows_in_measurements, -1) AS n_rows_in_measurements FROM trk LEFT JOIN sp USING (track_id)",
    "f_overlap": f"WITH {PAIR} SELECT a, b FROM par WHERE overlap",
    "f_consist": f"WITH {PAIR} SELECT coalesce(reason, 'consistent') AS reason, overlap, count(*) AS n FROM edg GROUP BY ALL",
    "j_cand": f"WITH {PAIR} SELECT stack_id, a, b, overlap, round(CASE WHEN overlap THEN d - 10000 ELSE d END, 6) AS score FROM edg WHERE reason IS NULL",
    "j_nn": f"WITH {PAIR} SELECT stack_id, b, arg_min(a, d * 1e9 + a) AS a, round(min(d), 6) AS distance FROM par WHERE d <= 8.7613::double / (0.756836::double + 1e-9) GROUP BY stack_id, b",
    "j_adjnn": f"WITH {DET}, s AS (SELECT stack_id, z_slice, lead(z_slice) OVER (PARTITION BY stack_id ORDER BY z_slice) AS nx FROM (SELECT DISTINCT stack_id, z_slice FROM det)), q AS (SELECT b.stack_id, b.event_id AS b, a.event_id AS a, sqrt(pow(b.centroid_x - a.centroid_x, 2) + pow(b.centroid_y - a.centroid_y, 2)) AS d FROM det a JOIN s USING (stack_id, z_slice) JOIN det b ON b.stack_id = s.stack_id AND b.z_slice = s.nx AND abs(a.centroid_x - b.centroid_x) <= 12 AND abs(a.centroid_y - b.centroid_y) <= 12) SELECT stack_id, b, arg_min(a, d * 1e9 + a) AS a, round(min(d), 6) AS distance FROM q WHERE d * 0.756836::double < 8.7613 GROUP BY stack_id, b",
    "j_knn": f"WITH {TRK} SELECT a.track_id, round(min(sqrt(pow((a.mean_x - b.mean_x) * 0.756836::double, 2) + pow((a.mean_y - b.mean_y) * 0.756836::double, 2) + pow((a.mean_z - b.mean_z) * 1.040460::double, 2))), 5) AS nearest_neighbor_um FROM trk a LEFT JOIN trk b ON a.stack_id = b.stack_id AND a.track_id <> b.track_id GROUP BY a.track_id",
    "j_radius": f"WITH {DET} SELECT a.stack_id, a.z_slice, a.event_id AS a, b.event_id AS b, round(sqrt(pow(b.centroid_x - a.centroid_x, 2) + pow(b.centroid_y - a.centroid_y, 2)), 6) AS distance FROM det a JOIN det b ON a.stack_id = b.stack_id AND a.z_slice = b.z_slice AND a.event_id < b.event_id AND a.event_id % 3 <> b.event_id % 3 WHERE sqrt(pow(b.centroid_x - a.centroid_x, 2) + pow(b.centroid_y - a.centroid_y, 2)) <= 5",
    "j_dedup": f"WITH {DET} SELECT event_id FROM det s WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM det f WHERE f.event_id % 2 = 0 AND f.stack_id = s.stack_id AND f.z_slice = s.z_slice AND pow(f.centroid_x - s.centroid_x, 2) + pow(f.centroid_y - s.centroid_y, 2) < 25)",
    "j_semi": f"WITH {TRK} SELECT event_id, track_id FROM cel WHERE track_id IN (SELECT track_id FROM qual WHERE is_quality_track)",
    "j_cache": f"WITH {TRK} SELECT event_id, cel.track_id, round(total_3d_length_um, 5) AS total_3d_length_um FROM cel JOIN trk USING (track_id)",
    "j_compare": f"WITH {TRK}, o AS (SELECT count(*) FILTER (WHERE flag_long) AS flag_long, count(*) FILTER (WHERE flag_tortuous) AS flag_tortuous, count(*) FILTER (WHERE flag_thick) AS flag_thick, count(*) FILTER (WHERE flag_taper) AS flag_taper, count(*) FILTER (WHERE flag_single_slice) AS flag_single_slice, count(*) FILTER (WHERE n_flags > 0) AS all_flagged FROM aud WHERE stack_id < 2), n AS (SELECT count(*) FILTER (WHERE flag_long) AS flag_long, count(*) FILTER (WHERE flag_tortuous) AS flag_tortuous, count(*) FILTER (WHERE flag_thick) AS flag_thick, count(*) FILTER (WHERE flag_taper) AS flag_taper, count(*) FILTER (WHERE flag_single_slice) AS flag_single_slice, count(*) FILTER (WHERE n_flags > 0) AS all_flagged FROM aud WHERE stack_id >= 2), uo AS (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE old_count), un AS (UNPIVOT n ON COLUMNS(*) INTO NAME metric VALUE new_count) SELECT metric, old_count, new_count, new_count - old_count AS delta_new_minus_old, CASE WHEN old_count = 0 THEN NULL ELSE round(100.0::double * (new_count - old_count) / old_count, 3) END AS pct_change_new_vs_old, CASE WHEN new_count < old_count THEN 'new' WHEN new_count > old_count THEN 'old' ELSE 'tie' END AS cleaner_run FROM uo FULL JOIN un USING (metric)",
    "a_slice": f"WITH {DET}, s AS (SELECT stack_id, z_slice FROM (SELECT DISTINCT stack_id FROM det), (SELECT unnest(range((SELECT min(z_slice) FROM det), (SELECT max(z_slice) FROM det) + 1))::int AS z_slice)) SELECT stack_id, z_slice, coalesce(count(event_id), 0) AS n_spermatids, coalesce(round(avg(length_um_geodesic), 3), 0) AS mean_length_um, coalesce(round(median(length_um_geodesic), 3), 0) AS median_length_um, coalesce(round(avg(width_um), 3), 0) AS mean_width_um FROM s LEFT JOIN det USING (stack_id, z_slice) GROUP BY stack_id, z_slice",
    "a_slice_gui": f"WITH {DET} SELECT stack_id, z_slice, count(*) AS n_spermatids, round(median(length_um_geodesic), 3) AS median_length_um FROM det GROUP BY ALL",
    "a_pop": f"WITH {TRK}, u AS ({_pop}) SELECT metric, population, count(*) AS n, round(avg(x), 5) AS mean, round(median(x), 5) AS median, round(stddev_samp(x), 5) AS sd FROM u GROUP BY ALL",
    "a_xlstat": f"WITH {TRK}, u AS ({_desc}) SELECT metric, round(avg(x), 5) AS mean, round(median(x), 5) AS median, round(stddev_pop(x), 5) AS sd_pop FROM u GROUP BY metric",
    "a_dist": f"WITH {TRK}, u AS ({_desc}) SELECT metric, round(avg(x), 5) AS mean, round(median(x), 5) AS median, round(quantile_cont(x, 0.95), 5) AS p95, round(max(x), 5) AS greatest FROM u GROUP BY metric",
    "a_analyze": f"WITH {TRK}, u AS ({_desc}) SELECT metric, round(avg(x), 5) AS mean, round(median(x), 5) AS median, round(stddev_samp(x), 5) AS sd, round(max(x), 5) AS greatest, round(min(x), 5) AS least FROM u GROUP BY metric",
    "a_describe": f"WITH {TRK}, u AS ({_desc}) SELECT metric, count(*) AS n, round(avg(x), 5) AS mean, round(min(x), 5) AS least, round(max(x), 5) AS greatest FROM u GROUP BY metric",
    "a_iqr": f"WITH {TRK} SELECT track_id, round(taper_ratio, 5) AS taper_ratio FROM trk WHERE taper_ratio > (SELECT quantile_cont(taper_ratio, 0.75) + 3 * (quantile_cont(taper_ratio, 0.75) - quantile_cont(taper_ratio, 0.25)) FROM trk)",
    "a_span": f"WITH {CELL} SELECT track_id, min(z_slice) AS z_min_from_meas, max(z_slice) AS z_max_from_meas, count(*) AS n_rows_in_measurements FROM cel GROUP BY track_id",
    "a_overlap": f"WITH {TRK} SELECT flag_long, flag_tortuous, flag_thick, flag_taper, flag_single_slice, count(*) AS n FROM aud GROUP BY ALL",
    "a_flagcnt": f"WITH {TRK} SELECT count(*) AS n_tracks, count(*) FILTER (WHERE total_3d_length_um > 15) AS long, count(*) FILTER (WHERE tortuosity_3d > 1.5) AS tortuous, count(*) FILTER (WHERE thickness_um > 2.0) AS thick, count(*) FILTER (WHERE taper_ratio > 1.5) AS taper, 0::bigint AS single_slice, count(*) FILTER (WHERE is_quality_track) AS quality, count(*) FILTER (WHERE NOT is_quality_track) AS all_flagged, count(*) FILTER (WHERE NOT is_quality_track) AS shape_outliers FROM qual",
    "a_funnel": f"WITH {TRK} SELECT 1 AS step, 'raw_2d' AS stage, (SELECT count(*) FROM det) AS n UNION ALL SELECT 2, 'tracks', (SELECT count(*) FROM trk) UNION ALL SELECT 3, 'quality', (SELECT count(*) FROM qual WHERE is_quality_track)",
    "a_donut": f"WITH {TRK}, p AS (SELECT 'quality' AS part, count(*) FILTER (WHERE is_quality_track) AS n FROM qual UNION ALL SELECT 'shape_outliers', count(*) FILTER (WHERE NOT is_quality_track) FROM qual) SELECT part, n, round(100.0::double * n / sum(n) OVER (), 1) AS pct FROM p WHERE n > 0",
    "a_hist": f"WITH {TRK}, e AS (SELECT min(total_3d_length_um) AS lo, (max(total_3d_length_um) - min(total_3d_length_um)) / 20 AS w FROM trk), c AS (SELECT least(floor((total_3d_length_um - lo) / w) + 1, 20)::int AS bin, count(*) AS n FROM trk, e GROUP BY 1) SELECT b::int AS bin, round(lo + (b - 1) * w, 5) AS bin_from, round(lo + b * w, 5) AS bin_to, coalesce(n, 0) AS n FROM e, unnest(range(1, 21)) t(b) LEFT JOIN c ON c.bin = b",
    "a_score5": f"WITH {FACTS} SELECT stack_id, n_tracks, round(0.90 * multi_slice + 0.18 * total_linked + 18 * avg_depth - 120 * greatest(single_slice / n_tracks - 0.70, 0) - 150 * greatest(0.20 - multi_slice / n_tracks, 0) - 2.8 * n_long - 2.2 * n_tort - 0.35 * n_thick - 0.50 * n_taper - 40 * abs(l3d_median_um - 9.5) - 60 * greatest(l3d_mean_um - 13, 0) - 35 * greatest(zextent_median_um - 4, 0) - 250 * greatest(n_long / n_tracks - 0.20, 0), 5) AS score FROM fac",
    "a_scoreu": f"WITH {FACTS} SELECT stack_id, n_tracks, round(1.5 * multi_slice + 0.3 * total_linked + 50 * avg_depth - 2 * single_slice - 3 * n_long - n_tort - n_thick - n_taper - 300 * greatest(single_slice / n_tracks - 0.45, 0) - 200 * greatest(0.50 - multi_slice / n_tracks, 0) - 30 * abs(l3d_median_um - 10), 5) AS score FROM fac",
    "a_scorev1": _early(1.2, (500, 250, 220, 180), (300, 180, 120, 80), (100, 140, 100, 50), (1.5, 2.0), (1.8, 2.5), (4.0, 180), (0.60, 250), None, (0.50, 120), (0.05, 500), (0.02, 600), (0.03, 500), None, (4.5, 80)),
    "a_scorev2": _early(1.0, (420, 220, 180, 260), (220, 140, 100, 160), (110, 120, 90, 90), (1.4, 2.0), (1.6, 2.2), (3.8, 220), (0.45, 550), (0.50, 420), (0.56, 180), (0.04, 520), (0.015, 700), (0.02, 900), (0.10, 320), (4.2, 90)),
    "a_score0": f"WITH {DET}, s AS (SELECT stack_id, z_slice, count(*) AS n, median(length_um_geodesic * 5) * 0.2 AS m FROM det GROUP BY ALL) SELECT sum(n)::bigint AS total_count, round(sum(n - CASE WHEN m < 7.5 THEN (7.5 - m) * n * 3 WHEN m > 13 THEN (m - 13) * n * 2 ELSE 0 END), 4) AS score, round(avg(m), 5) AS avg_median FROM s",
    "a_oldtrk": f"WITH {CELL} SELECT track_id, count(*) AS n_detections, min(z_slice) AS z_min, max(z_slice) AS z_max, round(avg(centroid_x), 6) AS mean_centroid_x, round(avg(centroid_y), 6) AS mean_centroid_y, max(length_um_geodesic) AS max_length_um, round(median(width_um), 6) AS median_width_um, round((max(z_slice) - min(z_slice)) * 1.040460::double, 6) AS z_extent_um, round(sqrt(pow(max(length_um_geodesic), 2) + pow((max(z_slice) - min(z_slice)) * 1.040460::double, 2)), 6) AS length_3d_um_est FROM cel GROUP BY track_id",
    "a_aictx": f"WITH {TRK} SELECT round(median(total_3d_length_um), 5) AS median_length_um, round(avg(tortuosity_3d), 5) AS mean_tortuosity, count(*) AS n FROM qual WHERE is_quality_track",
    "w_id": f"WITH {DET} SELECT event_id, sperm_id FROM det",
    "w_trkord": f"WITH {CELL} SELECT event_id, track_id, cast(row_number() OVER w AS int) AS position, coalesce(z_slice - lag(z_slice) OVER w, 0) AS step FROM cel WINDOW w AS (PARTITION BY track_id ORDER BY z_slice, sperm_id)",
    "w_conv": f"WITH {FACTS} SELECT stack_id, round(max(1.5 * multi_slice + 0.3 * total_linked) OVER (ORDER BY stack_id), 5) AS best_so_far FROM fac",
    "s_zs": f"WITH {DET} SELECT stack_id, event_id, row_number() OVER (PARTITION BY stack_id ORDER BY z_slice, sperm_id) AS position FROM det",
    "s_class": f"WITH {TRK} SELECT 'long' AS class, track_id, row_number() OVER (ORDER BY total_3d_length_um DESC, track_id) AS position FROM aud WHERE flag_long UNION ALL SELECT 'tortuous' AS class, track_id, row_number() OVER (ORDER BY tortuosity_3d DESC, track_id) AS position FROM aud WHERE flag_tortuous UNION ALL SELECT 'thick' AS class, track_id, row_number() OVER (ORDER BY thickness_um DESC, track_id) AS position FROM aud WHERE flag_thick UNION ALL SELECT 'taper' AS class, track_id, row_number() OVER (ORDER BY taper_ratio DESC, track_id) AS position FROM aud WHERE flag_taper UNION ALL SELECT 'single_slice' AS class, track_id, row_number() OVER (ORDER BY n_slices, track_id) AS position FROM aud WHERE flag_single_slice",
    "s_multi": f"WITH {TRK} SELECT track_id, n_flags, row_number() OVER (ORDER BY n_flags DESC, total_3d_length_um DESC, tortuosity_3d DESC, thickness_um DESC, taper_ratio DESC, track_id) AS position FROM aud WHERE n_flags > 0",
    "l_topn": f"WITH {TRK} (SELECT 'total_3d_length_um' AS metric, track_id, round(total_3d_length_um, 5) AS value FROM trk ORDER BY total_3d_length_um DESC, track_id LIMIT 50) UNION ALL (SELECT 'tortuosity_3d' AS metric, track_id, round(tortuosity_3d, 5) AS value FROM trk ORDER BY tortuosity_3d DESC, track_id LIMIT 50) UNION ALL (SELECT 'thickness_um' AS metric, track_id, round(thickness_um, 5) AS value FROM trk ORDER BY thickness_um DESC, track_id LIMIT 50) UNION ALL (SELECT 'taper_ratio' AS metric, track_id, round(taper_ratio, 5) AS value FROM trk ORDER BY taper_ratio DESC, track_id LIMIT 50)",
    "l_head": f"WITH {TRK} SELECT track_id, round(total_3d_length_um, 5) AS total_3d_length_um FROM qual WHERE is_quality_track ORDER BY track_id LIMIT 100",
    "l_best": f"WITH {FACTS} SELECT arg_max(stack_id, 1.5 * multi_slice + 0.3 * total_linked) AS stack_id, round(max(1.5 * multi_slice + 0.3 * total_linked), 5) AS score FROM fac",
    "u_all": f"WITH {DET} SELECT z_slice, count(*) AS n FROM (SELECT * FROM det WHERE stack_id < 2 UNION ALL SELECT * FROM det WHERE stack_id >= 1) GROUP BY z_slice",
    "u_distinct": f"WITH {DET} SELECT DISTINCT stack_id, z_slice FROM det",
    "j_profile": "SELECT n_nationkey, n_name, coalesce(r_name, 'General') AS profile FROM nation LEFT JOIN region r ON n_regionkey = r_regionkey",
    "snk_zproj": f"WITH {DRAW} SELECT image // 1048576 AS stack_id, y, x, max(value) AS brightest FROM pix GROUP BY ALL",
    "k_label": f"WITH RECURSIVE {DRAW}, {LABEL.format(where='true')} SELECT * FROM lab",
    "k_hyst": f"WITH RECURSIVE {DRAW}, {LABEL.format(where='value > 107')} SELECT lab.* FROM lab SEMI JOIN (SELECT lab.image, label FROM lab JOIN pix ON pix.image = lab.image AND pix.y = lab.y AND pix.x BETWEEN lo AND hi AND value > 121) h USING (image, label)",
    "k_props": f"WITH RECURSIVE {DRAW}, {LABEL.format(where='true')}, own AS (SELECT pix.image, label, pix.y::bigint AS y, x::bigint AS x FROM lab JOIN pix ON pix.image = lab.image AND pix.y = lab.y AND x BETWEEN lo AND hi), m AS (SELECT image, label, count(*) AS n_pixels, round(avg(y), 5) AS centroid_y, round(avg(x), 5) AS centroid_x, min(y) AS bbox_min_y, min(x) AS bbox_min_x, max(y) + 1 AS bbox_max_y, max(x) + 1 AS bbox_max_x, sum(y * y) * count(*) - sum(y) * sum(y) AS vy, sum(x * x) * count(*) - sum(x) * sum(x) AS vx, sum(x * y) * count(*) - sum(x) * sum(y) AS vxy FROM own GROUP BY image, label) SELECT image, label, n_pixels, centroid_y, centroid_x, bbox_min_y, bbox_min_x, bbox_max_y, bbox_max_x, round(CASE WHEN vx = vy THEN sign(vxy) * pi() / 4 ELSE 0.5 * atan2(2.0 * vxy::double, (vy - vx)::double) END, 5) AS orientation FROM m",
    "k_edt": f"WITH {DRAW}, {DEPTH} SELECT * FROM dep",
    "k_width": f"WITH RECURSIVE {DRAW}, {LABEL.format(where='true')}, {DEPTH} SELECT lab.image, label, round(median(2 * sqrt(depth2)), 5) AS width_px FROM lab JOIN dep ON dep.image = lab.image AND dep.y = lab.y AND x BETWEEN lo AND hi GROUP BY lab.image, label",
    "k_topo": f"WITH RECURSIVE {DRAW}, {LABEL.format(where='true')}, {TOPO}",
    "k_endpt": f"WITH {DRAW}, {DEGREE} SELECT * FROM deg",
    "k_break": f"WITH {DRAW}, {DEGREE} SELECT image, y, x FROM deg WHERE degree <= 2",
    "k_manual": f"WITH RECURSIVE {DRAW}, {EDITS} SELECT image, y, x, least(erased, cut) AS removed_step, CASE WHEN erased < coalesce(cut, erased + 1) THEN 'erase' WHEN cut IS NOT NULL THEN 'split' END AS removed_tool FROM fate",
    "a_flagcnt_bare": f"WITH {TRK} SELECT count(*) AS n_tracks, count(*) FILTER (WHERE total_3d_length_um > 15) AS long, count(*) FILTER (WHERE tortuosity_3d > 1.5) AS tortuous, count(*) FILTER (WHERE thickness_um > 2.0) AS thick, count(*) FILTER (WHERE taper_ratio > 1.5) AS taper, count(*) FILTER (WHERE n_slices < 1) AS single_slice, count(*) AS quality, 0::bigint AS all_flagged, 0::bigint AS shape_outliers FROM trk",
    "flagship": f"WITH {TRK} SELECT quality_flags, count(*) AS n_tracks, round(avg(total_3d_length_um), 5) AS mean_length_um, round(median(total_3d_length_um), 5) AS median_length_um, round(avg(tortuosity_3d), 5) AS mean_tortuosity FROM qual GROUP BY quality_flags",
}
SQL["a_reject"] = f"SELECT reject_reason, count(*) AS n FROM ({SQL['f_accept']}) WHERE reject_reason IS NOT NULL GROUP BY 1"
SQL["snk_labels"] = SQL["k_label"]
