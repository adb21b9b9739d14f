"""Queries over sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.sources import io
from tremor.plans.base import query


@query("""SELECT row, col, x, y, round(CASE WHEN NOT isnan(ew) THEN ew END, 9) AS ew, CASE WHEN col % 7 <> 0 THEN round(ns, 9) END AS ns FROM fx_pixels""")
def a1_read_pixels(fx_pixels: DataFrame) -> DataFrame:
    ew = fx_pixels.select("row", "col", "x", "y", F.col("ew").alias("v"))
    ns = fx_pixels.where("col % 7 <> 0").select("row", "col", "x", "y", F.col("ns").alias("v"))
    return rounded(io.read_pixels(ew, ns), "ew", "ns", digits=9)


@query("""SELECT obs_id // 100 AS row, obs_id % 100 AS col, round(vel, 9) AS vel, CAST(0 AS DOUBLE) AS err, los_e, CAST(0 AS DOUBLE) AS los_n, los_u FROM fx_los WHERE vel IS NOT NULL AND los_u IS NOT NULL""")
def a2_read_los(fx_los: DataFrame) -> DataFrame:
    grid = lambda c: fx_los.select(F.expr("obs_id div 100").alias("row"), (F.col("obs_id") % 100).alias("col"), F.col(c).alias("v"))
    return rounded(io.read_los(grid("vel"), east=grid("los_e"), up=grid("los_u")), "vel", digits=9)


@query("""WITH h AS (SELECT max(row) + 1 AS n FROM fx_pixels)
SELECT row, col, round(-117.6 + col * 0.5 / 99, 6) AS lon, round(36.0 - row * 1.5 / (n - 1), 6) AS lat FROM fx_pixels, h""")
def a3_grid_axes(fx_pixels: DataFrame) -> DataFrame:
    header = fx_pixels.agg(F.lit(-117.6).alias("x_min"), F.lit(-117.1).alias("x_max"), F.lit(34.5).alias("y_min"), F.lit(36.0).alias("y_max"), F.lit(100).alias("n_col"), (F.max("row") + 1).alias("n_row"))
    return rounded(io.grid_axes(fx_pixels.select("row", "col"), header), "lon", "lat")


@query("SELECT sta, round(lon, 6) AS lon, round(lat, 6) AS lat, round(de, 6) AS de, round(dn, 6) AS dn, round(sde, 6) AS sde, round(sdn, 6) AS sdn FROM fx_stations")
def a4_parse_gnss(fx_stations: DataFrame) -> DataFrame:
    body = fx_stations.select(F.format_string("%s  %.6f %.6f\t%.6f %.6f 0.0 %.6f %.6f 0.1", "sta", "lon", "lat", "de", "dn", "sde", "sdn").alias("value"))
    heads = fx_stations.limit(1).select(F.explode(F.array(*map(F.lit, ["Sta Lon Lat de dn du sde sdn sdu", "=====", "", "  "]))).alias("value"))
    body = body.withColumn("value", F.regexp_replace("value", "^Supplier", "S_"))
    return rounded(io.parse_gnss(heads.union(body)).withColumn("sta", F.regexp_replace("sta", "^S_", "Supplier")), "lon", "lat", "de", "dn", "sde", "sdn")


@query("SELECT strand_id, seq, x, y FROM fx_trace")
def a5_trace_text(fx_trace: DataFrame) -> DataFrame:
    return io.trace_from_wkt(io.trace_to_wkt(fx_trace))


@query("SELECT 'v' AS kind, vid AS id, round(x, 6) AS p, round(y, 6) AS q, round(z, 6) AS r FROM (SELECT vid - min(vid) OVER () AS vid, x, y, z FROM fx_vertices) UNION ALL SELECT 't', NULL, a - m, b - m, c - m FROM fx_triangles, (SELECT min(vid) AS m FROM fx_vertices)")
def a6_parse_gocad(fx_vertices: DataFrame, fx_triangles: DataFrame) -> DataFrame:
    sparse = fx_vertices.withColumn("vid", 7 * F.col("vid"))
    tri = fx_triangles.select("tid", *((7 * F.col(c)).alias(c) for c in "abc"))
    v, t = io.parse_gocad(io.gocad_lines(sparse, tri).select("value"))
    return v.select(F.lit("v").alias("kind"), F.col("vid").alias("id"), F.round("x", 6).alias("p"), F.round("y", 6).alias("q"), F.round("z", 6).alias("r")).unionByName(
        t.select(F.lit("t").alias("kind"), F.lit(None).cast("long").alias("id"), F.col("a").cast("double").alias("p"), F.col("b").cast("double").alias("q"), F.col("c").cast("double").alias("r")))


@query("""SELECT 0 AS part, vid AS k, printf('VRTX %d %.6f %.6f %.6f', vid + 1, x, y, z) AS value FROM fx_vertices
UNION ALL SELECT 1, tid, printf('TRGL %d %d %d', a + 1, b + 1, c + 1) FROM fx_triangles""")
def a7_gocad_lines(fx_vertices: DataFrame, fx_triangles: DataFrame) -> DataFrame:
    return io.gocad_lines(fx_vertices, fx_triangles)


@query("SELECT 'd' AS part, sta AS row_id, 'gnss' AS dataset, round(de, 6) AS v FROM fx_stations UNION ALL SELECT 'g', sta, 'gnss', round(dn, 6) FROM fx_stations")
def a8_save_and_load(fx_stations: DataFrame) -> DataFrame:
    spark = fx_stations.sparkSession
    path = io.scratch(spark, "system")
    d = fx_stations.select(F.col("sta").alias("row_id"), F.lit("gnss").alias("dataset"), F.round("de", 6).alias("v"))
    io.save_system(path, d=d, g=d.drop("v").join(fx_stations.select(F.col("sta").alias("row_id"), F.round("dn", 6).alias("v")), "row_id"))
    back = lambda n: io.load_system(spark, path, n).select(F.lit(n).alias("part"), "row_id", "dataset", "v")
    return back("d").unionByName(back("g"))


@query("""WITH p AS (SELECT * FROM fx_los WHERE vel IS NOT NULL), b AS (SELECT min(lon) AS lon0, max(lat) AS lat1, max(round((lon + 117.6) / 0.0001)) - min(round((lon + 117.6) / 0.0001)) AS nc, max(round((35.9 - lat) / 0.0001)) - min(round((35.9 - lat) / 0.0001)) AS nr FROM p),
c AS (SELECT r.row, q.col FROM b, range(0, CAST(nr AS BIGINT) + 1) AS r(row), range(0, CAST(nc AS BIGINT) + 1) AS q(col)),
k AS (SELECT CAST(round((lat1 - lat) / 0.0001) AS BIGINT) AS row, CAST(round((lon - lon0) / 0.0001) AS BIGINT) AS col, vel, err FROM p, b)
SELECT row, col, round(vel, 9) AS vel, round(err, 9) AS err, CAST(CASE WHEN vel IS NOT NULL THEN 0 END AS INT) AS off_grid FROM c LEFT JOIN k USING (row, col)""")
def a9_rasterise_grid(fx_los: DataFrame) -> DataFrame:
    px = fx_los.where("vel is not null").withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})
    return rounded(io.rasterise_grid(px, ["vel", "err"]).withColumn("off_grid", F.col("off_grid").cast("int")), "vel", "err", digits=9)


_BLOCKS = """SELECT p_partkey AS ord, (p_partkey * 7) % 60 AS r0, (p_partkey * 7) % 60 + 1 + p_size % 5 AS r1, (p_partkey * 13) % 80 AS c0, (p_partkey * 13) % 80 + 1 + p_size % 7 AS c1, CAST(p_size AS DOUBLE) AS v FROM {part}"""


@query(f"WITH b AS ({_BLOCKS.format(part='part')}) SELECT row, col, arg_max(v, ord) AS v FROM b, range(0, 200) AS r(row), range(0, 200) AS c(col) WHERE row >= r0 AND row < r1 AND col >= c0 AND col < c1 GROUP BY row, col")
def a10_rasterise_blocks(part: DataFrame) -> DataFrame:
    return io.rasterise_blocks(part.sparkSession.sql(_BLOCKS, part=part), "v")


@query("SELECT step, sample_id, CASE WHEN param_idx < 32 THEN 'strike' ELSE 'dip' END AS pset, CAST(param_idx AS BIGINT) AS \"column\", round(v, 9) AS v FROM fx_samples")
def a11_model_matrix(fx_samples: DataFrame) -> DataFrame:
    split = fx_samples.select("step", "sample_id", F.when(F.col("param_idx") < 32, "strike").otherwise("dip").alias("pset"), (F.col("param_idx") % 32).alias("idx"), F.round("v", 9).alias("v"))
    sets = fx_samples.sparkSession.createDataFrame([("strike", 0, 32), ("dip", 1, 32)], "pset string, ord int, width long")
    return io.model_matrix(split, sets).drop("idx")


@query("""SELECT CAST(p_partkey AS INT) AS iteration, round(p_partkey / 1000, 6) AS beta, CAST(p_size AS BIGINT) AS accepted, CAST(p_partkey % 3 AS BIGINT) AS invalid, CAST(p_partkey % 11 AS BIGINT) AS rejected,
round(p_size / (p_size + p_partkey % 3 + p_partkey % 11), 6) AS acceptance FROM part""")
def a12_annealing_log(part: DataFrame) -> DataFrame:
    lines = part.select(F.format_string("%d, %.6f, 0.5, (%d, %d, %d)", F.col("p_partkey").cast("long"), F.col("p_partkey") / 1000.0, F.col("p_size").cast("long"), (F.col("p_partkey") % 3).cast("long"), (F.col("p_partkey") % 11).cast("long")).alias("value"))
    return rounded(io.parse_annealing(lines.union(part.limit(1).select(F.lit("iter, beta, x, (acc, inv, rej)").alias("value")))), "beta", "acceptance")


@query("SELECT tid, printf('%.6f', area * 2.5) AS value FROM (SELECT tid, CAST(tid % 97 AS DOUBLE) / 7 AS area FROM fx_triangles) WHERE tid >= 20 AND tid < 500")
def a13_area_lines(fx_triangles: DataFrame) -> DataFrame:
    return io.area_lines(fx_triangles.select("tid", ((F.col("tid") % 97).cast("double") / 7).alias("area")), 20, 500, 2.5)


@query("SELECT row, col, round(10.0::DOUBLE * col + 0.5::DOUBLE * row + 500000, 6) AS map_x, round(0.25::DOUBLE * col - 10.0::DOUBLE * row + 4000000, 6) AS map_y FROM fx_pixels")
def a14_profile_points(fx_pixels: DataFrame) -> DataFrame:
    return rounded(io.to_map(fx_pixels.select("row", "col"), 10.0, 0.5, 500000.0, 0.25, -10.0, 4000000.0), "map_x", "map_y")


@query("SELECT profile_id, event_id, round(xs, 6) AS xs FROM fx_profile_points WHERE profile_id % 3 <> 0 AND (profile_id % 2 = 0 OR xs BETWEEN -50 AND 50)")
def a15_keep_profiles(fx_profile_points: DataFrame) -> DataFrame:
    odd = F.col("profile_id") % 2 == 1
    decisions = fx_profile_points.select("profile_id").distinct().select("profile_id", (F.col("profile_id") % 3 != 0).alias("keep"), F.when(odd, -50.0).alias("lo"), F.when(odd, 50.0).alias("hi"))
    return rounded(io.keep_profiles(fx_profile_points.select("profile_id", "event_id", "xs"), decisions), "xs")


@query("SELECT row, count(ew) AS n FROM (SELECT row, nullif(ew, 0) AS ew FROM fx_pixels) GROUP BY row")
def a16_stage_checkpoint(fx_pixels: DataFrame) -> DataFrame:
    path = io.scratch(fx_pixels.sparkSession, "stage")
    fx_pixels.select("row", F.nullif("ew", F.lit(0.0)).alias("ew")).write.parquet(path)
    return fx_pixels.sparkSession.read.parquet(path).groupBy("row").agg(F.count("ew").alias("n"))
