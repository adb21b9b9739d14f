"""Queries over meshes and patches (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.operators import mesh as ms
from tremor.plans.base import query

_T = "t AS (SELECT tid, layer, fault_id, a, b, c, p.x AS xa, p.y AS ya, p.z AS za, q.x AS xb, q.y AS yb, q.z AS zb, r.x AS xc, r.y AS yc, r.z AS zc FROM fx_triangles f JOIN fx_vertices p ON p.vid = a JOIN fx_vertices q ON q.vid = b JOIN fx_vertices r ON r.vid = c)"
_G = f"""{_T}, n AS (SELECT *, (yb - ya) * (zc - za) - (zb - za) * (yc - ya) AS px, (zb - za) * (xc - xa) - (xb - xa) * (zc - za) AS py, (xb - xa) * (yc - ya) - (yb - ya) * (xc - xa) AS pz FROM t),
g AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS r, CASE WHEN pz < 0 THEN -1 ELSE 1 END AS sg, (xa + xb + xc) / 3 AS cx, (ya + yb + yc) / 3 AS cy, -(za + zb + zc) / 3 AS depth FROM n)"""


def _mesh(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    return ms.attach(triangles, vertices)


@query(f"WITH {_T} SELECT tid, xa, yb, zc FROM t")
def j1_attach(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    return _mesh(fx_triangles, fx_vertices).select("tid", "xa", "yb", "zc")


@query(f"WITH {_G} SELECT tid, round(cx, 4) AS cx, round(cy, 4) AS cy, round(depth, 4) AS depth, round(r / 2000000, 6) AS area_km2, count(*) OVER () AS n_patches, (SELECT count(DISTINCT fault_id) FROM t) AS n_faults FROM g")
def j2_geometry(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    g = ms.geometry(_mesh(fx_triangles, fx_vertices))
    counts = g.agg(F.count("*").alias("n_patches"), F.countDistinct("fault_id").alias("n_faults"))
    return rounded(rounded(g.crossJoin(F.broadcast(counts)).select("tid", "cx", "cy", "depth", "area_km2", "n_patches", "n_faults"), "cx", "cy", "depth", digits=4), "area_km2")


@query(f"WITH {_G} SELECT tid, round(sg * px / r, 6) + 0 AS nx, round(sg * py / r, 6) + 0 AS ny, round(sg * pz / r, 6) AS nz FROM g")
def j3_normals(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    return rounded(ms.geometry(_mesh(fx_triangles, fx_vertices)).select("tid", "nx", "ny", "nz"), "nx", "ny", "nz")


@query("WITH m AS (SELECT max(vid) + 1 AS dv FROM fx_vertices), n AS (SELECT max(tid) + 1 AS dt, max(fault_id) + 1 AS df FROM fx_triangles) SELECT tid, a, b, c, fault_id FROM fx_triangles UNION ALL SELECT tid + dt, a + dv, b + dv, c + dv, CAST(fault_id + df AS INT) FROM fx_triangles, m, n")
def j4_merge(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    _, t = ms.merge([(fx_vertices, fx_triangles), (fx_vertices, fx_triangles)])
    return t.select("tid", "a", "b", "c", "fault_id")


@query(f"WITH {_G}, m AS (SELECT fault_id, avg(sg * px / r) AS rx, avg(sg * py / r) AS ry, avg(sg * pz / r) AS rz FROM g GROUP BY fault_id), d AS (SELECT tid, sg * (px * rx + py * ry + pz * rz) / r / sqrt(rx * rx + ry * ry + rz * rz) AS dot FROM g JOIN m USING (fault_id)) SELECT tid, CAST(sign(dot) AS INT) AS dip_sign, abs(dot) < 0.17 AS ill FROM d")
def j5_dip_reference(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    return ms.dip_reference(ms.geometry(_mesh(fx_triangles, fx_vertices))).select("tid", "dip_sign", "ill")


_PLANE = "SELECT n_nationkey AS plane_id, CAST(500033.5 + 190 * n_nationkey AS DOUBLE) AS ox, CAST(4000012.25 AS DOUBLE) AS oy, CAST(0.3 AS DOUBLE) AS dx, CAST(1 AS DOUBLE) AS dy FROM {nation}"
_CUT = f"""{_T}, p AS (SELECT plane_id, ox, oy, dx / sqrt(dx * dx + dy * dy) AS ux, dy / sqrt(dx * dx + dy * dy) AS uy FROM ({_PLANE.format(nation='nation')})),
s AS (SELECT *, (xa - ox) * -uy + (ya - oy) * ux AS fa, (xb - ox) * -uy + (yb - oy) * ux AS fb, (xc - ox) * -uy + (yc - oy) * ux AS fc FROM t, p),
e AS (SELECT plane_id, tid, ox, oy, ux, uy, fa AS f0, fb AS f1, xa AS x0, ya AS y0, za AS z0, xb AS x1, yb AS y1, zb AS z1 FROM s UNION ALL SELECT plane_id, tid, ox, oy, ux, uy, fb, fc, xb, yb, zb, xc, yc, zc FROM s UNION ALL SELECT plane_id, tid, ox, oy, ux, uy, fc, fa, xc, yc, zc, xa, ya, za FROM s),
h AS (SELECT *, f0 / (f0 - f1) AS s FROM e WHERE f0 <> f1), k AS (SELECT plane_id, tid, (x0 + s * (x1 - x0) - ox) * ux + (y0 + s * (y1 - y0) - oy) * uy AS pos, -(z0 + s * (z1 - z0)) AS depth FROM h WHERE s BETWEEN -1e-12 AND 1 + 1e-12),
cut AS (SELECT plane_id, tid, arg_min(pos, depth) AS a_top, min(depth) AS depth_top, arg_max(pos, depth) AS a_bottom, max(depth) AS depth_bottom FROM k GROUP BY ALL HAVING count(*) >= 2 AND max(depth) > min(depth))"""


def _cuts(triangles: DataFrame, vertices: DataFrame, nation: DataFrame) -> DataFrame:
    return ms.plane_cut(_mesh(triangles, vertices), nation.sparkSession.sql(_PLANE, nation=nation))


@query(f"WITH {_CUT} SELECT plane_id, tid, round(a_top, 4) AS a_top, round(depth_top, 4) AS depth_top, round(a_bottom, 4) AS a_bottom, round(depth_bottom, 4) AS depth_bottom FROM cut")
def j6_plane_cut(fx_triangles: DataFrame, fx_vertices: DataFrame, nation: DataFrame) -> DataFrame:
    return rounded(_cuts(fx_triangles, fx_vertices, nation), "a_top", "depth_top", "a_bottom", "depth_bottom", digits=4)


@query(f"WITH {_CUT}, b AS (SELECT CAST(k AS INT) AS band, k * 1500.0::DOUBLE AS top, (k + 1) * 1500.0::DOUBLE AS bot FROM range(0, 40) AS r(k)) SELECT plane_id, tid, band, round(sqrt((a_bottom - a_top) ** 2 + (depth_bottom - depth_top) ** 2) * (least(depth_bottom, bot) - greatest(depth_top, top)) / (depth_bottom - depth_top), 4) AS length FROM cut, b WHERE least(depth_bottom, bot) > greatest(depth_top, top)")
def j7_band_weights(fx_triangles: DataFrame, fx_vertices: DataFrame, nation: DataFrame) -> DataFrame:
    bands = nation.sparkSession.range(40).select(F.col("id").cast("int").alias("band"), (F.col("id") * 1500.0).alias("top"), ((F.col("id") + 1) * 1500.0).alias("bot"))
    return rounded(ms.band_weights(_cuts(fx_triangles, fx_vertices, nation), bands), "length", digits=4)


@query(f"""WITH {_T}, l AS (SELECT CAST(300 + 1000 * n_nationkey AS DOUBLE) AS level FROM nation), e AS (SELECT level, tid, xa AS x0, ya AS y0, za AS z0, xb AS x1, yb AS y1, zb AS z1 FROM t, l UNION ALL SELECT level, tid, xb, yb, zb, xc, yc, zc FROM t, l UNION ALL SELECT level, tid, xc, yc, zc, xa, ya, za FROM t, l),
h AS (SELECT level, tid, x0 + (x1 - x0) * (-level - z0) / (z1 - z0) AS x, y0 + (y1 - y0) * (-level - z0) / (z1 - z0) AS y FROM e WHERE (z0 < -level) <> (z1 < -level)), s AS (SELECT level, tid, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS length FROM h GROUP BY ALL HAVING count(*) = 2) SELECT level, count(*) AS n, round(sum(length), 4) AS length FROM s GROUP BY level""")
def j8_slice_levels(fx_triangles: DataFrame, fx_vertices: DataFrame, nation: DataFrame) -> DataFrame:
    levels = nation.select((300.0 + 1000 * F.col("n_nationkey")).alias("level"))
    return rounded(ms.slice_levels(_mesh(fx_triangles, fx_vertices), levels, 1.0).groupBy("level").agg(F.count("*").alias("n"), F.sum("length").alias("length")), "length", digits=4)


@query(f"""WITH {_T}, e AS (SELECT fault_id, a AS i, b AS j, xa AS x0, ya AS y0, za AS z0, xb AS x1, yb AS y1, zb AS z1 FROM t UNION ALL SELECT fault_id, b, c, xb, yb, zb, xc, yc, zc FROM t UNION ALL SELECT fault_id, c, a, xc, yc, zc, xa, ya, za FROM t),
s AS (SELECT fault_id, any_value(x0) AS x0, any_value(y0) AS y0, any_value(z0) AS z0, any_value(x1) AS x1, any_value(y1) AS y1, any_value(z1) AS z1 FROM e GROUP BY fault_id, least(i, j), greatest(i, j) HAVING count(*) = 1), m AS (SELECT fault_id, (min(z0) + max(z0)) / 2 AS mid FROM e GROUP BY fault_id)
SELECT fault_id, min(least(z0, z1)) AS datum FROM s JOIN m USING (fault_id) WHERE z0 >= mid AND z1 >= mid AND abs(z1 - z0) <= sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) GROUP BY fault_id""")
def j11_datum(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    return ms.datum(_mesh(fx_triangles, fx_vertices))


@query(f"WITH {_G}, e AS (SELECT fault_id, 500000.0 + 2500 * fault_id AS x0, 4000000.0 AS y0, 502400.0 + 2500 * fault_id AS x1, 4000500.0 AS y1 FROM (SELECT DISTINCT fault_id FROM t)) SELECT tid, round(((cx - x0) * (x1 - x0) + (cy - y0) * (y1 - y0)) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 1000, 6) AS along_km, round(depth / 1000, 6) AS depth_km FROM g JOIN e USING (fault_id)")
def j13_section(fx_triangles: DataFrame, fx_vertices: DataFrame) -> DataFrame:
    ends = fx_triangles.select("fault_id").distinct()
    trace = ends.select("fault_id", F.lit(0).alias("seq"), (500000.0 + 2500 * F.col("fault_id")).alias("x"), F.lit(4000000.0).alias("y")).unionByName(ends.select("fault_id", F.lit(1).alias("seq"), (502400.0 + 2500 * F.col("fault_id")).alias("x"), F.lit(4000500.0).alias("y")))
    return rounded(ms.section(ms.geometry(_mesh(fx_triangles, fx_vertices)), trace).select("tid", "along_km", "depth_km"), "along_km", "depth_km")


@query("""WITH m AS (SELECT strand_id, max(seq) AS last, -(max_by(y, seq) - min_by(y, seq)) * sin(radians(90)) + (max_by(x, seq) - min_by(x, seq)) * cos(radians(90)) < 0 AS turned FROM fx_trace GROUP BY strand_id),
w AS (SELECT strand_id, turned, CASE WHEN turned THEN last - seq ELSE seq END AS seq, x, y FROM fx_trace JOIN m USING (strand_id)), g AS (SELECT strand_id, turned, seq, x AS ax, y AS ay, lead(x) OVER o AS bx, lead(y) OVER o AS byy FROM w WINDOW o AS (PARTITION BY strand_id ORDER BY seq)),
d AS (SELECT * FROM (VALUES (0, 0.0, 3000.0, 80.0, 0.0), (1, 3000.0, 5000.0, 80.0, 3000.0), (1, 5000.0, 7000.0, 60.0, 5000.0), (2, 7000.0, 12000.0, 60.0, 5000.0)) AS t(row, zt, zb, dip, z)), u AS (SELECT row, zt, zb, dip, CASE WHEN zt <= 5000 THEN zt / tan(radians(80)) ELSE 5000 / tan(radians(80)) + (zt - 5000) / tan(radians(60)) END AS run FROM d)
SELECT strand_id, CAST(seq AS INT) AS seq, row, round(ax - (byy - ay) / sqrt((bx - ax) ** 2 + (byy - ay) ** 2) * run, 4) AS x0, round(ay + (bx - ax) / sqrt((bx - ax) ** 2 + (byy - ay) ** 2) * run, 4) AS y0, CAST(zb AS DOUBLE) AS z0, CAST(zt AS DOUBLE) AS z1, CASE WHEN turned THEN -1 ELSE 1 END AS slip_sign FROM g, u WHERE bx IS NOT NULL""")
def j14_rect_patches(fx_trace: DataFrame) -> DataFrame:
    rows = fx_trace.sparkSession.createDataFrame([(0, 0.0, 3000.0), (1, 3000.0, 7000.0), (2, 7000.0, 12000.0)], "row int, top double, bot double")
    return rounded(ms.rect_patches(fx_trace, rows, 5000.0, 80.0, 60.0, 90.0).select("strand_id", "seq", "row", "x0", "y0", "z0", "z1", "slip_sign"), "x0", "y0", digits=4)


@query("WITH g AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, radians(dip_deg) AS dip FROM fx_patches) SELECT patch_id, round(len, 4) AS length, round((z0 - z1) / sin(dip), 4) AS width, round(len * (z0 - z1) / sin(dip), 4) AS area, round(x0 - (y1 - y0) / len * (z0 - z1) / tan(dip), 4) AS low_x0, round(y1 + (x1 - x0) / len * (z0 - z1) / tan(dip), 4) AS low_y1 FROM g")
def j15_patch_geometry(fx_patches: DataFrame) -> DataFrame:
    return rounded(ms.patch_geometry(fx_patches).select("patch_id", "length", "width", "area", "low_x0", "low_y1"), "length", "width", "area", "low_x0", "low_y1", digits=4)


@query("SELECT * FROM (SELECT n_regionkey AS model_id, n_nationkey AS patch_id, 2.0 * n_nationkey AS x_top, 100.0 * n_nationkey AS top, 2.0 * lead(n_nationkey) OVER w AS x_bot, 100.0 * lead(n_nationkey) OVER w AS bottom FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)) WHERE bottom IS NOT NULL".replace("2.0 *", "2.0::DOUBLE *").replace("100.0 *", "100.0::DOUBLE *"))
def j16_patches_2d(nation: DataFrame) -> DataFrame:
    return ms.patches_2d(nation.select(F.col("n_regionkey").alias("model_id"), F.col("n_nationkey").alias("k"), (100.0 * F.col("n_nationkey")).alias("depth"), (2.0 * F.col("n_nationkey")).alias("x")))


@query("SELECT p_partkey, round(CASE WHEN p_size < 15 THEN 3 * p_size / 15.0 WHEN p_size <= 40 THEN 3 * (40 - p_size) / 25.0 ELSE 0 END, 6)::DOUBLE AS slip FROM part")
def j17_triangular_slip(part: DataFrame) -> DataFrame:
    return rounded(part.select("p_partkey", ms.triangular_slip(F.col("p_size").cast("double"), 3.0, 15.0, 40.0).alias("slip")), "slip")


@query("SELECT p_partkey % 5 AS strand_id, count(*) FILTER (p_size > 20) AS n_up, count(*) FILTER (p_size < 20) AS n_down FROM part GROUP BY 1")
def j18_dip_sense(part: DataFrame) -> DataFrame:
    return ms.dip_sense(part.select((F.col("p_partkey") % 5).alias("strand_id"), (F.col("p_size") - 20).alias("u")))
