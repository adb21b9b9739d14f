"""Queries over pixels, stations and polylines (B, C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.operators import coords
from tremor.operators import polyline as pl
from tremor.plans.base import query
from tremor.sources import io


@query("SELECT row, col, round(nullif(ew, 0), 9) AS ew, round(nullif(ns, 0), 9) AS ns FROM fx_pixels")
def b1_clear_empty(fx_pixels: DataFrame) -> DataFrame:
    return rounded(coords.clear_empty(fx_pixels).select("row", "col", "ew", "ns"), "ew", "ns", digits=9)


@query("SELECT row, col, round(ew, 9) AS ew FROM fx_pixels WHERE row % 4 = 0 AND col % 4 = 0")
def b2_decimate(fx_pixels: DataFrame) -> DataFrame:
    return rounded(coords.decimate(fx_pixels, 4).select("row", "col", "ew"), "ew", digits=9)


@query("SELECT row, col FROM fx_pixels WHERE x BETWEEN 500100 AND 500400 AND y BETWEEN 3999000 AND 3999800")
def b3_window(fx_pixels: DataFrame) -> DataFrame:
    return coords.window(fx_pixels, 500100.0, 500400.0, 3999800.0, 3999000.0).select("row", "col")


@query("SELECT row, col, round(ew, 9) AS ew, round(ns, 9) AS ns FROM fx_pixels WHERE ew <> 0 AND ns <> 0")
def b4_flatten(fx_pixels: DataFrame) -> DataFrame:
    return rounded(coords.flatten(coords.clear_empty(fx_pixels)).select("row", "col", "ew", "ns"), "ew", "ns", digits=9)


def _utm_sql(source: str) -> str:
    n, e = coords._N, 2 * coords._N**0.5 / (1 + coords._N)
    xs = " + ".join(f"{a!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(coords.kruger()[0], 1))
    ys = " + ".join(f"{a!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(coords.kruger()[0], 1))
    k = coords.SCALE * coords.RECTIFYING
    return f"""z AS (SELECT CAST(floor((avg(lon) + 180) / 6) + 1 AS INT) AS zone FROM {source}),
    t AS (SELECT s.*, zone, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM {source} s, z),
    g AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t),
    utm AS (SELECT * EXCLUDE (t, lam, xi, eta), 500000 + {k!r}::DOUBLE * (eta + {xs}) AS x, {k!r}::DOUBLE * (xi + {ys}) AS y FROM g)"""


@query(f"WITH {_utm_sql('fx_stations')} SELECT sta, zone, round(x, 3) AS x, round(y, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM utm")
def b5_utm(fx_stations: DataFrame) -> DataFrame:
    there = coords.ll_to_utm(fx_stations.select("sta", "lon", "lat"))
    back = coords.utm_to_ll(there.drop("lon", "lat"), 11)
    return rounded(rounded(back.select("sta", "zone", "x", "y", "lon", "lat"), "x", "y", digits=3), "lon", "lat")


@query("SELECT obs_id FROM fx_los WHERE lon > -117.596 AND lon < -117.593 AND lat > 35.88 AND lat < 35.8985")
def b6_bbox(fx_los: DataFrame) -> DataFrame:
    return coords.bbox(fx_los, -117.596, -117.593, 35.88, 35.8985).select("obs_id")


@query("SELECT obs_id, round(vel, 9) AS vel FROM fx_los WHERE vel IS NOT NULL AND los_u IS NOT NULL")
def b7_drop_missing(fx_los: DataFrame) -> DataFrame:
    return rounded(coords.drop_missing(fx_los).select("obs_id", "vel"), "vel", digits=9)


_PAIRS = "SELECT n_nationkey AS i, (n_nationkey * 3 + k) % 25 AS j, CAST(k AS DOUBLE) AS v FROM {t}, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) q"


@query(f"WITH c AS ({_PAIRS.format(t='nation')}) SELECT i, j, v FROM c WHERE i % 2 = 0 AND j % 2 = 0")
def b8_keep_covariance(nation: DataFrame) -> DataFrame:
    pairs = nation.sparkSession.sql(_PAIRS.replace("{t}", "{nation}"), nation=nation)
    return coords.keep_cov(pairs, coords.keep(nation, nation.where("n_nationkey % 2 = 0"), "n_nationkey"), "n_nationkey").select("i", "j", "v")


@query("SELECT obs_id FROM fx_los WHERE NOT (lon BETWEEN -117.599 AND -117.596 AND lat BETWEEN 35.89 AND 35.899) AND NOT (lon BETWEEN -117.594 AND -117.591 AND lat BETWEEN 35.80 AND 35.895)")
def b9_mask_boxes(fx_los: DataFrame) -> DataFrame:
    return coords.mask_boxes(fx_los, [(-117.599, -117.596, 35.89, 35.899), (-117.594, -117.591, 35.80, 35.895)]).select("obs_id")


#: Points to segments by brute force: the SQL of the distance operators.
_SEG = """seg AS (SELECT * FROM (SELECT strand_id, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM fx_trace WINDOW w AS (PARTITION BY strand_id ORDER BY seq)) WHERE x1 IS NOT NULL),
pair AS (SELECT row, col, x, y, ew, ns, strand_id, seq, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS f FROM fx_pixels, seg),
dist AS (SELECT *, (x - x0 - f * (x1 - x0)) * (x - x0 - f * (x1 - x0)) + (y - y0 - f * (y1 - y0)) * (y - y0 - f * (y1 - y0)) AS d2, (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) AS crossed FROM pair)"""


@query(f"WITH {_SEG} SELECT row, col, min(d2) > 10000 AS far FROM dist GROUP BY row, col")
def b10_near_trace(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    px = fx_pixels.withColumn("id", F.col("row") * 100 + F.col("col"))
    near, far = (coords.near_trace(px, fx_trace, "id", 100.0, inside) for inside in (True, False))
    return near.select("row", "col", F.lit(False).alias("far")).unionByName(far.select("row", "col", F.lit(True).alias("far")))


@query(f"WITH v AS (SELECT strand_id, seq, -117.6 + (x - 500000) / 100000 AS lon, 35.9 + (y - 4000000) / 100000 AS lat FROM fx_trace), {_utm_sql('v')} SELECT strand_id, seq, round(x, 3) AS x, round(y, 3) AS y FROM utm")
def b11_project_trace(fx_trace: DataFrame) -> DataFrame:
    ll = fx_trace.select("strand_id", "seq", (-117.6 + (F.col("x") - 500000) / 100000).alias("lon"), (35.9 + (F.col("y") - 4000000) / 100000).alias("lat"))
    return rounded(coords.ll_to_utm(ll).select("strand_id", "seq", "x", "y"), "x", "y", digits=3)


@query("SELECT row, col, round(ew * sin(radians(30)) + ns * cos(radians(30)), 6) AS par, round(-ew * cos(radians(30)) + ns * sin(radians(30)), 6) AS nrm FROM fx_pixels")
def b12_rotate(fx_pixels: DataFrame) -> DataFrame:
    return rounded(coords.rotate(fx_pixels, F.lit(30.0)).select("row", "col", "par", "nrm"), "par", "nrm")


@query("SELECT obs_id, round(0.3 * los_e - 0.2 * los_n + vel * los_u, 6) AS los FROM fx_los")
def b13_project_los(fx_los: DataFrame) -> DataFrame:
    return rounded(coords.project_los(fx_los.withColumns({"e": F.lit(0.3), "n": F.lit(-0.2), "u": F.col("vel")})).select("obs_id", "los"), "los")


@query("SELECT n_nationkey, round(50 * sin(radians(n_nationkey * 15)), 6) + 0 AS dx, round(-50 * cos(radians(n_nationkey * 15)), 6) + 0 AS dy FROM nation")
def b14_bearing(nation: DataFrame) -> DataFrame:
    dx, dy = coords.bearing_to_xy(F.col("n_nationkey") * 15, F.lit(50.0))
    return rounded(nation.select("n_nationkey", dx.alias("dx"), dy.alias("dy")), "dx", "dy")


@query("SELECT row, col, round(x, 6) AS map_x, round(y, 6) AS map_y, round(CAST(col AS DOUBLE), 6) AS pix_col, round(CAST(row AS DOUBLE), 6) AS pix_row FROM fx_pixels")
def b15_affine(fx_pixels: DataFrame) -> DataFrame:
    aff = (10.0, 0.0, 500000.0, 0.0, -10.0, 4000000.0)
    return rounded(io.to_pixel(io.to_map(fx_pixels.select("row", "col"), *aff), *aff, x="map_x", y="map_y"), "map_x", "map_y", "pix_col", "pix_row")


@query("WITH f AS (SELECT row, col, x, y FROM fx_pixels WHERE ew <> 0 ORDER BY row, col LIMIT 1000) SELECT round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS spacing FROM f a, f b WHERE a.row < b.row OR (a.row = b.row AND a.col < b.col)")
def b16_pixel_spacing(fx_pixels: DataFrame) -> DataFrame:
    return rounded(coords.pixel_spacing(fx_pixels.where("ew <> 0")), "spacing")


_ARC = """arc AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY strand_id ORDER BY seq), 0) AS s FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM fx_trace WINDOW w AS (PARTITION BY strand_id ORDER BY seq)))"""
_AT = """(SELECT {t} FROM arc a JOIN arc b ON a.strand_id = b.strand_id AND b.seq = a.seq + 1 WHERE a.strand_id = {k})"""


@query(f"WITH {_ARC} SELECT strand_id, seq, round(s, 6) AS s, round(max(s) OVER (PARTITION BY strand_id), 6) AS total FROM arc")
def c1_arc_length(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.arclength(fx_trace).select("strand_id", "seq", "s", "total"), "s", "total")


#: Points of the strands every 250 m by linear interpolation.
_RES = f"""{_ARC}, leg AS (SELECT a.strand_id, a.seq, a.s AS s0, b.s AS s1, a.x AS xa, b.x AS xb, a.y AS ya, b.y AS yb, max(b.s) OVER (PARTITION BY a.strand_id) AS total FROM arc a JOIN arc b ON a.strand_id = b.strand_id AND b.seq = a.seq + 1),
res AS (SELECT strand_id, k, k * 250.0::DOUBLE AS s, xa + (xb - xa) * (k * 250 - s0) / (s1 - s0) AS x, ya + (yb - ya) * (k * 250 - s0) / (s1 - s0) AS y FROM leg, range(0, 1000) AS r(k) WHERE k * 250 >= s0 AND (k * 250 < s1 OR (k * 250 = s1 AND s1 = total)))"""


@query(f"WITH {_RES} SELECT strand_id, k, round(s, 6) AS s, round(x, 6) AS x, round(y, 6) AS y FROM res")
def c2_resample(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.resample(fx_trace, 250.0), "s", "x", "y")


@query(f"WITH {_RES} SELECT * FROM (SELECT strand_id, k, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y, count(*) OVER w AS n FROM res WINDOW w AS (PARTITION BY strand_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE n = 5")
def c3_smooth(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.smooth(pl.resample(fx_trace, 250.0), 2), "x", "y")


@query(f"WITH {_RES} SELECT * FROM (SELECT strand_id, k, round((degrees(atan2(x - lag(x) OVER w, y - lag(y) OVER w)) + 360) % 360, 6) AS strike FROM res WINDOW w AS (PARTITION BY strand_id ORDER BY k)) WHERE strike IS NOT NULL")
def c4_strike(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.adjacent_strike(pl.resample(fx_trace, 250.0)).select("strand_id", "k", "strike"), "strike")


@query(f"WITH {_RES} SELECT * FROM (SELECT strand_id, k, round((degrees(atan2(lead(x, 3) OVER w - lag(x, 3) OVER w, lead(y, 3) OVER w - lag(y, 3) OVER w)) + 360) % 360, 6) AS strike FROM res WINDOW w AS (PARTITION BY strand_id ORDER BY k)) WHERE strike IS NOT NULL")
def c5_chord_strike(fx_trace: DataFrame) -> DataFrame:
    centres = pl.resample(fx_trace, 250.0).select("strand_id", "k", "s")
    return rounded(pl.chord_strike(fx_trace, centres, 1500.0).select("strand_id", "k", "strike"), "strike")


@query(f"""WITH {_RES}, g AS (SELECT strand_id, k, coalesce(lead(x, 2) OVER w, last_value(x) OVER f) - coalesce(lag(x, 2) OVER w, first_value(x) OVER f) AS dx,
coalesce(lead(y, 2) OVER w, last_value(y) OVER f) - coalesce(lag(y, 2) OVER w, first_value(y) OVER f) AS dy FROM res
WINDOW w AS (PARTITION BY strand_id ORDER BY k), f AS (PARTITION BY strand_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT strand_id, k, round(dx / sqrt(dx * dx + dy * dy), 6) AS tx, round(dy / sqrt(dx * dx + dy * dy), 6) AS ty, round(-dy / sqrt(dx * dx + dy * dy), 6) AS nx, round(dx / sqrt(dx * dx + dy * dy), 6) AS ny FROM g""")
def c6_tangents(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.tangents(pl.resample(fx_trace, 250.0), 2).select("strand_id", "k", "tx", "ty", "nx", "ny"), "tx", "ty", "nx", "ny")


@query(f"WITH {_SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY round(d2, 6), strand_id, seq) AS k FROM dist) SELECT row, col, round(CASE WHEN crossed >= 0 THEN 1 ELSE -1 END * sqrt(d2), 6) AS d FROM o WHERE k = 1 AND d2 <= 250000")
def c7_signed_distance(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.signed_distance(fx_pixels, fx_trace, ["row", "col"], 500.0).select("row", "col", "d"), "d")


@query(f"""WITH {_RES}, m AS (SELECT strand_id, k, covar_pop(x, y) OVER w AS cxy, var_pop(x) OVER w AS cxx, var_pop(y) OVER w AS cyy, last_value(x) OVER w - first_value(x) OVER w AS dx, last_value(y) OVER w - first_value(y) OVER w AS dy FROM res
WINDOW w AS (PARTITION BY strand_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), a AS (SELECT *, 0.5 * atan2(2 * cxy, cxx - cyy) AS t FROM m)
SELECT strand_id, k, round((90 - degrees(t + CASE WHEN cos(t) * dx + sin(t) * dy < 0 THEN pi() ELSE 0 END) + 720) % 360, 4) AS strike FROM a""")
def c8_fit_strike(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.fit_strike(pl.resample(fx_trace, 250.0), 4).select("strand_id", "k", "strike"), "strike", digits=4)


_PICKS = "SELECT s_suppkey AS pick_id, CAST(500400 + (s_suppkey * 37) % 500 AS DOUBLE) AS x, CAST(3985000 + (s_suppkey * 911) % 14000 AS DOUBLE) AS y, CAST((s_suppkey % 2) * 180 AS DOUBLE) AS strike FROM {supplier}"


@query(f"""WITH {_ARC}, p AS ({_PICKS.format(supplier='supplier')}), q AS (SELECT p.pick_id, p.strike, a.strand_id, a.seq, a.s, b.s AS s1, b.x - a.x AS dx, b.y - a.y AS dy, greatest(0, least(1, ((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2))) AS f, p.x - a.x AS ux, p.y - a.y AS uy
FROM p, arc a JOIN arc b ON a.strand_id = b.strand_id AND b.seq = a.seq + 1), o AS (SELECT *, row_number() OVER (PARTITION BY pick_id ORDER BY round((ux - f * dx) ** 2 + (uy - f * dy) ** 2, 6), strand_id, seq) AS n FROM q),
t AS (SELECT strand_id, max(s) AS total FROM arc GROUP BY strand_id)
SELECT pick_id, strand_id, sin(radians(strike)) * dx + cos(radians(strike)) * dy < 0 AS reversed, round(CASE WHEN sin(radians(strike)) * dx + cos(radians(strike)) * dy < 0 THEN total - (s + f * (s1 - s)) ELSE s + f * (s1 - s) END, 4) AS s FROM o JOIN t USING (strand_id) WHERE n = 1""")
def c9_match_strand(supplier: DataFrame, fx_trace: DataFrame) -> DataFrame:
    picks = supplier.sparkSession.sql(_PICKS, supplier=supplier)
    return rounded(pl.match_strand(picks, fx_trace, 2000.0), "s", digits=4)


@query(f"""WITH {_RES}, e AS (SELECT strand_id, s, x, y FROM arc WHERE s > 1100 AND s < 15200 UNION ALL SELECT strand_id, t, xa + (xb - xa) * (t - s0) / (s1 - s0), ya + (yb - ya) * (t - s0) / (s1 - s0) FROM leg, (SELECT 1100.0::DOUBLE AS t UNION ALL SELECT 15200.0::DOUBLE) WHERE t >= s0 AND t < s1)
SELECT strand_id, round(s, 6) AS s, round(x, 6) AS x, round(y, 6) AS y FROM e""")
def c10_sub_polyline(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.between(fx_trace, 1100.0, 15200.0).select("strand_id", "s", "x", "y"), "s", "x", "y")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY seq) AS a, row_number() OVER (PARTITION BY strand_id ORDER BY seq DESC) AS b, count(*) OVER (PARTITION BY strand_id) AS m FROM fx_trace),
e AS (SELECT strand_id, max(CASE WHEN a = 1 THEN x END) AS x0, max(CASE WHEN a = 1 THEN y END) AS y0, max(CASE WHEN a = least(3, m) THEN x END) AS x2, max(CASE WHEN a = least(3, m) THEN y END) AS y2,
max(CASE WHEN b = 1 THEN x END) AS xe, max(CASE WHEN b = 1 THEN y END) AS ye, max(CASE WHEN b = least(3, m) THEN x END) AS xf, max(CASE WHEN b = least(3, m) THEN y END) AS yf, min(seq) AS s0, max(seq) AS s1 FROM n GROUP BY strand_id)
SELECT strand_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM fx_trace UNION ALL
SELECT strand_id, s0 - 1, round(x0 - 500 * (x2 - x0) / sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2), 6), round(y0 - 500 * (y2 - y0) / sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2), 6) FROM e UNION ALL
SELECT strand_id, s1 + 1, round(xe + 500 * (xe - xf) / sqrt((xe - xf) ** 2 + (ye - yf) ** 2), 6), round(ye + 500 * (ye - yf) / sqrt((xe - xf) ** 2 + (ye - yf) ** 2), 6) FROM e""")
def c11_extend(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.extend(fx_trace, 500.0, 3), "x", "y")


@query(f"WITH {_SEG} SELECT row, col, min(d2) <= 6400 AS inside FROM dist GROUP BY row, col")
def c12_corridor(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    near = pl.signed_distance(fx_pixels, fx_trace, ["row", "col"], 80.0).select("row", "col", F.lit(True).alias("inside"))
    return fx_pixels.select("row", "col").join(near, ["row", "col"], "left").fillna({"inside": False})


@query("""WITH c AS (SELECT fault_id, unnest([a, b, c]) AS vid FROM fx_triangles), p AS (SELECT DISTINCT fault_id, vid, x, y, z FROM c JOIN fx_vertices USING (vid)),
t AS (SELECT * FROM (SELECT *, max(z) OVER (PARTITION BY fault_id) AS top FROM p) WHERE z >= top - 450),
m AS (SELECT fault_id, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th FROM t GROUP BY fault_id)
SELECT fault_id, vid, CAST(row_number() OVER (PARTITION BY fault_id ORDER BY round(cos(th) * (x - mx) + sin(th) * (y - my), 6), vid) - 1 AS INT) AS seq, x, y FROM t JOIN m USING (fault_id)""")
def c13_surface_trace(fx_vertices: DataFrame, fx_triangles: DataFrame) -> DataFrame:
    return pl.surface_trace(fx_vertices, fx_triangles, 450.0)


@query(f"""WITH {_RES}, t AS (SELECT DISTINCT strand_id, total FROM leg), n AS (SELECT strand_id, total, CAST(greatest(1, round(40 * total / sum(total) OVER ())) AS INT) AS n FROM t),
c AS (SELECT strand_id, i, 200 + (total - 400) * CASE WHEN n = 1 THEN 0.5 ELSE i / (n - 1) END AS s, total FROM n, range(0, 1000) AS r(i) WHERE i < n),
q AS (SELECT c.strand_id, i, c.s, xa + (xb - xa) * (c.s - s0) / (s1 - s0) AS x, ya + (yb - ya) * (c.s - s0) / (s1 - s0) AS y FROM c JOIN leg l ON l.strand_id = c.strand_id AND c.s >= s0 AND c.s < s1),
h AS (SELECT c.strand_id, i, d, xa + (xb - xa) * (least(greatest(c.s + d, 0), c.total) - s0) / (s1 - s0) AS x, ya + (yb - ya) * (least(greatest(c.s + d, 0), c.total) - s0) / (s1 - s0) AS y FROM c, (SELECT -100 AS d UNION ALL SELECT 100) k, leg l WHERE l.strand_id = c.strand_id AND least(greatest(c.s + d, 0), c.total) >= s0 AND (least(greatest(c.s + d, 0), c.total) < s1 OR (s1 = l.total AND c.s + d >= s1))),
st AS (SELECT strand_id, i, (degrees(atan2(max(CASE WHEN d > 0 THEN x END) - max(CASE WHEN d < 0 THEN x END), max(CASE WHEN d > 0 THEN y END) - max(CASE WHEN d < 0 THEN y END))) + 360) % 360 AS strike FROM h GROUP BY ALL)
SELECT strand_id, CAST(i AS INT) AS i, round(s, 4) AS s, round(x, 4) AS x, round(y, 4) AS y, round(strike, 4) AS strike, round(x - 1000 * cos(radians(strike)), 4) AS left_x, round(y + 1000 * sin(radians(strike)), 4) AS left_y, round(x + 1000 * cos(radians(strike)), 4) AS right_x, round(y - 1000 * sin(radians(strike)), 4) AS right_y FROM q JOIN st USING (strand_id, i)""")
def c14_profiles_along(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.profiles_along(fx_trace, 40, 1000.0, 200.0, 200.0), "s", "x", "y", "strike", "left_x", "left_y", "right_x", "right_y", digits=4)


@query(f"""WITH {_RES}, c AS (SELECT DISTINCT strand_id, i, total * i / 9 AS s FROM leg, range(0, 10) AS r(i))
SELECT c.strand_id, CAST(i AS INT) AS i, round(c.s, 4) AS s, round(xa + (xb - xa) * (c.s - s0) / (s1 - s0), 4) AS x, round(ya + (yb - ya) * (c.s - s0) / (s1 - s0), 4) AS y, round((degrees(atan2(xb - xa, yb - ya)) + 360) % 360, 4) AS strike
FROM c JOIN leg l ON l.strand_id = c.strand_id AND c.s >= s0 AND (c.s < s1 OR (s1 = total AND i = 9))""")
def c15_even_profiles(fx_trace: DataFrame) -> DataFrame:
    return rounded(pl.even_profiles(fx_trace, 10), "s", "x", "y", "strike", digits=4)


@query(f"WITH {_RES}, g AS (SELECT strand_id, k, x, y, atan2(x - lag(x) OVER w, y - lag(y) OVER w) AS t FROM res WINDOW w AS (PARTITION BY strand_id ORDER BY k)) SELECT strand_id, k, round(x - 300 * cos(t), 4) AS left_x, round(y + 300 * sin(t), 4) AS left_y, round(x + 300 * cos(t), 4) AS right_x, round(y - 300 * sin(t), 4) AS right_y FROM g WHERE t IS NOT NULL")
def c16_perpendicular_ends(fx_trace: DataFrame) -> DataFrame:
    out = pl.perpendicular(pl.adjacent_strike(pl.resample(fx_trace, 250.0)), 300.0)
    return rounded(out.select("strand_id", "k", "left_x", "left_y", "right_x", "right_y"), "left_x", "left_y", "right_x", "right_y", digits=4)


@query(f"WITH {_ARC} SELECT CAST(floor(strand_id / 4.0) AS INT) AS trace_id, max_by(strand_id, s) AS strand_id, round(max(s), 6) AS length FROM arc GROUP BY ALL")
def c17_longest_part(fx_trace: DataFrame) -> DataFrame:
    """Four strands are the parts of a trace."""
    return rounded(pl.longest_part(fx_trace.withColumn("trace_id", F.floor(F.col("strand_id") / 4).cast("int"))), "length")
