"""Queries over down-sampling, statistics and stencils (D, E, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.operators import coords
from tremor.operators import covariance as cv
from tremor.operators import downsample as ds
from tremor.operators import stencil as st
from tremor.plans.base import query
from tremor.sources.io import staged

_START, _LEAST, _CHAR, _EXPO = 800.0, 100.0, 60.0, 0.7


def _extent(px: DataFrame) -> DataFrame:
    return px.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query("WITH e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM fx_pixels) SELECT CAST(0 AS INT) AS level, kx, ky, kx * 800.0::DOUBLE AS left, ky * 800.0::DOUBLE AS bottom, 800.0::DOUBLE AS size FROM e, range(0, 20000) AS r(kx), range(4900, 5100) AS s(ky) WHERE kx BETWEEN floor(a / 800) AND floor(b / 800) AND ky BETWEEN floor(c / 800) AND floor(d / 800) AND kx BETWEEN 600 AND 700".replace("AS left", 'AS "left"'))
def d1_start_blocks(fx_pixels: DataFrame) -> DataFrame:
    return ds.start_blocks(_extent(fx_pixels), 800.0)


_TREE = """sg AS (SELECT * FROM (SELECT x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM fx_trace WINDOW w AS (PARTITION BY strand_id ORDER BY seq)) WHERE x1 IS NOT NULL),
e AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM fx_pixels),
k AS (SELECT level, size, kx, ky, (SELECT min(sqrt((kx * size + i * size - x0 - greatest(0, least(1, ((kx * size + i * size - x0) * (x1 - x0) + (ky * size + j * size - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) * (x1 - x0)) ** 2
  + (ky * size + j * size - y0 - greatest(0, least(1, ((kx * size + i * size - x0) * (x1 - x0) + (ky * size + j * size - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) * (y1 - y0)) ** 2))
  FROM sg, range(0, 2) AS p(i), range(0, 2) AS q(j)) AS dist
  FROM (SELECT level, 800.0::DOUBLE / (1 << level) AS size FROM range(0, 4) AS l(level)), LATERAL (SELECT kx, ky FROM e, range(CAST(floor(a / 800) * (1 << level) AS BIGINT), CAST((floor(b / 800) + 1) * (1 << level) AS BIGINT)) AS r(kx), range(CAST(floor(c / 800) * (1 << level) AS BIGINT), CAST((floor(d / 800) + 1) * (1 << level) AS BIGINT)) AS s(ky))),
t AS (SELECT *, size > 100 AND dist - 60 < size ** 0.7 AS split FROM k),
leaf AS (SELECT t.* FROM t LEFT JOIN t p1 ON p1.level = t.level - 1 AND p1.kx = floor(t.kx / 2) AND p1.ky = floor(t.ky / 2) LEFT JOIN t p2 ON p2.level = t.level - 2 AND p2.kx = floor(t.kx / 4) AND p2.ky = floor(t.ky / 4) LEFT JOIN t p3 ON p3.level = t.level - 3 AND p3.kx = floor(t.kx / 8) AND p3.ky = floor(t.ky / 8)
  WHERE NOT t.split AND coalesce(p1.split, true) AND coalesce(p2.split, true) AND coalesce(p3.split, true))"""


def _leaves(px: DataFrame, trace: DataFrame) -> DataFrame:
    return ds.quadtree(_extent(px), trace, _START, _LEAST, _CHAR, 1.0, _EXPO)


_TREE = _TREE.replace("FROM (SELECT level, 800.0::DOUBLE / (1 << level) AS size FROM range(0, 4) AS l(level)), LATERAL (SELECT kx, ky FROM e, range(CAST(floor(a / 800) * (1 << level) AS BIGINT), CAST((floor(b / 800) + 1) * (1 << level) AS BIGINT)) AS r(kx), range(CAST(floor(c / 800) * (1 << level) AS BIGINT), CAST((floor(d / 800) + 1) * (1 << level) AS BIGINT)) AS s(ky))",
    "FROM (SELECT level, 800.0::DOUBLE / (1 << CAST(level AS INT)) AS size, kx0 * (1 << CAST(level AS INT)) + u AS kx, ky0 * (1 << CAST(level AS INT)) + v AS ky FROM (SELECT kx0, ky0 FROM e, range(620, 640) AS r(kx0), range(4900, 5010) AS s(ky0) WHERE kx0 BETWEEN floor(a / 800) AND floor(b / 800) AND ky0 BETWEEN floor(c / 800) AND floor(d / 800)) z, range(0, 4) AS l(level), range(0, 8) AS m(u), range(0, 8) AS n(v) WHERE u < (1 << CAST(level AS INT)) AND v < (1 << CAST(level AS INT)))")


@query(f"WITH {_TREE} SELECT CAST(level AS INT) AS level, kx, ky, size FROM leaf")
def d2_quadtree(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    return _leaves(fx_pixels, fx_trace).select("level", "kx", "ky", "size")


_CLEAN = "c AS (SELECT row, col, x, y, nullif(ew, 0) AS ew, nullif(ns, 0) AS ns FROM fx_pixels)"


@query(f"WITH {_TREE}, {_CLEAN} SELECT CAST(level AS INT) AS level, kx, ky, size, count(*) AS n, round(avg(ew), 6) AS ew, round(avg(ns), 6) AS ns, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM c JOIN leaf ON kx = floor(x / size) AND ky = floor(y / size) WHERE ew IS NOT NULL AND ns IS NOT NULL GROUP BY ALL")
def d3_block_means(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    px = coords.flatten(coords.clear_empty(fx_pixels))
    out = ds.block_means(ds.assign(px, _leaves(fx_pixels, fx_trace), _START, 3), ["ew", "ns", "x", "y"])
    return rounded(rounded(out, "ew", "ns"), "x", "y", digits=4)


_LOSXY = "l AS (SELECT obs_id, 500000 + 10 * (obs_id % 100) AS x, 4000000 - 10 * floor(obs_id / 100.0) AS y, vel, err, los_e, los_n, los_u FROM fx_los WHERE vel IS NOT NULL AND los_u IS NOT NULL)"


def _los_xy(fx_los: DataFrame) -> DataFrame:
    return coords.drop_missing(fx_los).withColumns({"x": (500000 + 10 * (F.col("obs_id") % 100)).cast("double"), "y": 4000000.0 - 10 * F.floor(F.col("obs_id") / 100.0)})


@query(f"""WITH {_TREE}, {_LOSXY}, g AS (SELECT level, kx, ky, size, count(*) AS n, avg(vel) AS vel, CASE WHEN max(abs(err)) > 0 THEN sqrt(sum(err * err)) / count(*) ELSE stddev_pop(vel) END AS err, avg(los_e) AS e, avg(los_n) AS m, avg(los_u) AS u FROM l JOIN leaf ON kx = floor(x / size) AND ky = floor(y / size) GROUP BY ALL)
SELECT CAST(level AS INT) AS level, kx, ky, size, n, round(vel, 6) AS vel, round(err, 6) AS err, round(e / sqrt(e * e + m * m + u * u), 6) AS los_e, round(m / sqrt(e * e + m * m + u * u), 6) AS los_n, round(u / sqrt(e * e + m * m + u * u), 6) AS los_u FROM g""")
def d4_block_los(fx_los: DataFrame, fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    out = ds.block_los(ds.assign(_los_xy(fx_los), _leaves(fx_pixels, fx_trace), _START, 3)).drop("x", "y")
    return rounded(out, "vel", "err", "los_e", "los_n", "los_u")


@query(f"WITH {_TREE}, {_CLEAN} SELECT CAST(level AS INT) AS level, kx, ky, size, count(*) AS n FROM c JOIN leaf ON kx = floor(x / size) AND ky = floor(y / size) WHERE ew IS NOT NULL AND ns IS NOT NULL GROUP BY ALL HAVING count(*) * 100 / (size * size) >= 0.9")
def d5_covered(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    px = coords.flatten(coords.clear_empty(fx_pixels))
    return ds.covered(ds.block_means(ds.assign(px, _leaves(fx_pixels, fx_trace), _START, 3), []), 100.0, 0.9)


@query(f"""WITH {_TREE}, {_CLEAN}, b AS (SELECT level, kx, ky, avg(x) AS x, avg(y) AS y FROM c JOIN leaf ON kx = floor(x / size) AND ky = floor(y / size) WHERE ew IS NOT NULL AND ns IS NOT NULL GROUP BY ALL),
f AS (SELECT b.*, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS f FROM b, sg)
SELECT CAST(level AS INT) AS level, kx, ky FROM f GROUP BY level, kx, ky HAVING min((x - x0 - f * (x1 - x0)) ** 2 + (y - y0 - f * (y1 - y0)) ** 2) > 6400""")
def d6_reject_near_fault(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    px = coords.flatten(coords.clear_empty(fx_pixels))
    means = ds.block_means(ds.assign(px, _leaves(fx_pixels, fx_trace), _START, 3), ["x", "y"]).withColumn("block", F.struct("level", "kx", "ky"))
    return coords.near_trace(means, fx_trace, "block", 80.0, inside=False).select("level", "kx", "ky")


@query("SELECT obs_id FROM fx_los WHERE ((obs_id + 7) * 1103515245 + 12345) % 2147483648 < 0.05 * 2147483648")
def e1_subsample(fx_los: DataFrame) -> DataFrame:
    return cv.subsample(fx_los, "obs_id", 0.05, 7).select("obs_id")


_RAMP = """m AS (SELECT avg(x) AS mx, avg(y) AS my, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM c WHERE ew IS NOT NULL),
u AS (SELECT row, col, ew, (x - mx) / sx AS u, (y - my) / sy AS v FROM c, m),
s AS (SELECT count(*) AS n, sum(u) AS su, sum(v) AS sv, sum(u * v) AS suv, sum(u * u) AS suu, sum(v * v) AS svv, sum(u * u * v) AS suuv, sum(u * v * v) AS suvv, sum(u * u * v * v) AS suuvv, sum(ew) AS d, sum(u * ew) AS du, sum(v * ew) AS dv, sum(u * v * ew) AS duv FROM u WHERE ew IS NOT NULL)"""


_BASIS = ["u", "v", "1", "u * v"]
_RAMP = ", ".join("[" + ", ".join([*(f"sum({p} * {q})::DOUBLE" for q in _BASIS), f"sum({p} * ew)::DOUBLE"]) + "]" for p in _BASIS)


@query(f"""WITH RECURSIVE {_CLEAN}, o AS (SELECT * FROM c WHERE ew IS NOT NULL), s AS (SELECT avg(x) AS mx, avg(y) AS my, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM o), b AS (SELECT row, col, ew, (x - mx) / sx AS u, (y - my) / sy AS v FROM o, s),
e AS (SELECT 0 AS k, [{_RAMP}] AS a FROM b UNION ALL SELECT k + 1, list_transform(range(1, 5), lambda i: CASE WHEN i = k + 1 THEN list_transform(a[k + 1], lambda x: x / a[k + 1][k + 1]) ELSE list_transform(range(1, 6), lambda j: a[i][j] - a[i][k + 1] / a[k + 1][k + 1] * a[k + 1][j]) END) FROM e WHERE k < 4)
SELECT row, col, round(ew - a[1][5] * u - a[2][5] * v - a[3][5] - a[4][5] * u * v, 6) + 0.0 AS ew_res FROM b, e WHERE k = 4""")
def e2_detrend(fx_pixels: DataFrame) -> DataFrame:
    """What is left of each pixel after the bilinear ramp."""
    out = cv.detrend_bilinear(coords.clear_empty(fx_pixels), ["ew"]).where("ew is not null")
    return rounded(out.select("row", "col", "ew_res"), "ew_res")


_ALL = "o AS (SELECT row * 100 + col AS id, x, y, ew FROM c WHERE ew IS NOT NULL)"
_CVG = f"{_CLEAN}, {_ALL}, b AS (SELECT CAST(floor(d / 40) AS INT) AS bin, avg(abs(p)) * 0.5 AS value, count(*) AS n FROM (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.ew * b.ew AS p FROM o a, o b WHERE a.id < b.id AND b.x BETWEEN a.x - 400 AND a.x + 400 AND b.y BETWEEN a.y - 400 AND a.y + 400) WHERE d < 400 GROUP BY 1)"


def _points(px: DataFrame) -> DataFrame:
    return coords.clear_empty(px).where("ew is not null").select((F.col("row") * 100 + F.col("col")).alias("id"), "x", "y", "ew")


def _cvg(px: DataFrame, **k) -> DataFrame:
    return cv.covariogram(_points(px), "id", "ew", 40.0, 400.0, **k)


@query(f"WITH {_CVG} SELECT bin, (bin + 0.5) * 40 AS centre, CASE WHEN bin < 9 THEN (bin + 1.5) * 40 END AS shifted, round(value, 6) AS value, n FROM b".replace("(bin + 0.5) * 40", "CAST((bin + 0.5) * 40 AS DOUBLE)").replace("THEN (bin + 1.5) * 40", "THEN CAST((bin + 1.5) * 40 AS DOUBLE)"))
def e3_covariogram(fx_pixels: DataFrame) -> DataFrame:
    both = _cvg(fx_pixels).withColumnRenamed("distance", "centre").join(_cvg(fx_pixels, labels="shifted").select("bin", F.col("distance").alias("shifted")), "bin", "left")
    return rounded(both, "value")


@query(f"WITH {_CVG}, r AS (SELECT *, (bin + 0.5) * 40 AS distance, row_number() OVER (ORDER BY bin) AS i, row_number() OVER (ORDER BY bin DESC) AS j FROM b), s AS (SELECT avg(value) FILTER (j <= 4) AS sill, regr_slope(value, distance) FILTER (i <= 4) AS slope, regr_intercept(value, distance) FILTER (i <= 4) AS intercept FROM r) SELECT round(sill, 6) AS sill, round(slope, 9) AS slope, round(intercept, 6) AS intercept FROM s")
def e4_start_values(fx_pixels: DataFrame) -> DataFrame:
    return rounded(rounded(cv.start_values(_cvg(fx_pixels)).select("sill", "slope", "intercept"), "sill", "intercept"), "slope", digits=9)


@query(f"WITH {_CVG}, g AS (SELECT CAST(i * 25 + j * 5 + k AS INT) AS candidate, 0.3 + 0.1 * i AS sill, 0.1 + 0.2 * j AS sigma, 30.0 + 60 * k AS lam FROM range(0, 5) AS r(i), range(0, 5) AS s(j), range(0, 5) AS t(k)), q AS (SELECT candidate, sill, sigma, lam, sum(abs(value - sill - sigma * sigma * exp(-CAST((bin + 0.5) * 40 AS DOUBLE) / lam))) AS cost FROM b, g GROUP BY ALL) SELECT candidate, round(CAST(sill AS DOUBLE), 6) AS sill, round(CAST(sigma AS DOUBLE), 6) AS sigma, round(CAST(lam AS DOUBLE), 6) AS lam, round(cost, 6) AS cost FROM q ORDER BY round(cost, 9), candidate LIMIT 1")
def e5_fit_covariance(fx_pixels: DataFrame) -> DataFrame:
    spark = fx_pixels.sparkSession
    grid = spark.createDataFrame([(i * 25 + j * 5 + k, 0.3 + 0.1 * i, 0.1 + 0.2 * j, 30.0 + 60 * k) for i in range(5) for j in range(5) for k in range(5)], "candidate int, sill double, sigma double, lam double")
    return rounded(cv.score_candidates(_cvg(fx_pixels), grid, "exponential"), "sill", "sigma", "lam", "cost")


@query(None)
def e5_fitted_covariance(fx_pixels: DataFrame) -> DataFrame:
    """The fit from its own starting values, in rounds around the best; tests/test_analysis.py holds it against planted covariograms."""
    return rounded(cv.fit_covariance(staged(_cvg(fx_pixels), "covariogram")), "sill", "sigma", "lam", "cost")


@query(f"WITH {_CLEAN} SELECT n_nationkey AS id, n_nationkey * 4 < 40 OR n_nationkey * 2 > 20 * (SELECT stddev_pop(ew) FROM c) AS degenerate FROM nation")
def e6_degenerate(nation: DataFrame, fx_pixels: DataFrame) -> DataFrame:
    spread = coords.clear_empty(fx_pixels).agg(F.stddev_pop("ew")).first()[0]
    return cv.degenerate(nation.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 4).alias("lam"), (F.col("n_nationkey") * 2).alias("sigma")), 40.0, spread).select("id", "degenerate")


@query(f"WITH {_CLEAN}, {_ALL}, p AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM o a, o b WHERE b.x BETWEEN a.x - 45 AND a.x + 45 AND b.y BETWEEN a.y - 45 AND a.y + 45) SELECT i, j, round(0.04 * exp(-d / 80), 6) AS v FROM p WHERE d < 45")
def e7_build_covariance(fx_pixels: DataFrame) -> DataFrame:
    return rounded(cv.build_cov(_points(fx_pixels), "id", 0.2, 80.0, 45.0), "v")


@query("SELECT sta, CAST(0 AS INT) AS component, round((sde * 2) ** 2, 9) AS var FROM fx_stations UNION ALL SELECT sta, 1, round((sdn * 2) ** 2, 9) FROM fx_stations")
def e8_station_covariance(fx_stations: DataFrame) -> DataFrame:
    return rounded(cv.cov_diag(fx_stations, 2.0), "var", digits=9)


@query("SELECT i, j, round(v * 1.5 + CASE WHEN i = j THEN 0.25 ELSE 0 END, 6) AS v FROM (SELECT n_nationkey AS i, (n_nationkey * 3 + n_regionkey) % 25 AS j, CAST(n_regionkey AS DOUBLE) AS v FROM nation)")
def e9_inflate(nation: DataFrame) -> DataFrame:
    pairs = nation.select(F.col("n_nationkey").alias("i"), ((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).alias("j"), F.col("n_regionkey").cast("double").alias("v"))
    return rounded(cv.inflate(pairs, 1.5, 0.25), "v")


@query("SELECT CAST(floor(xs / 20) AS INT) AS bin, round(var_samp(par), 6) AS var FROM fx_profile_points GROUP BY 1 HAVING count(*) > 1")
def e10_profile_covariance(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(fx_profile_points.groupBy(F.floor(F.col("xs") / 20).cast("int").alias("bin")).agg(F.var_samp("par").alias("var"), F.count("*").alias("n")).where("n > 1").drop("n"), "var")


#: Both components smoothed, along rows and then along columns, each pass spread from the sources to their neighbours.
_SMOOTH = f"""{_CLEAN}, kern AS (SELECT k, exp(-0.5 * k * k) AS w FROM range(-4, 5) AS r(k)),
p1 AS (SELECT row, col + k AS col, sum(w * ew) AS ew, sum(CASE WHEN ew IS NOT NULL THEN w END) AS ew_w, sum(w * ns) AS ns, sum(CASE WHEN ns IS NOT NULL THEN w END) AS ns_w FROM c, kern GROUP BY 1, 2),
p2 AS (SELECT row + k AS row, col, sum(w * ew) AS ew, sum(w * ew_w) AS ew_w, sum(w * ns) AS ns, sum(w * ns_w) AS ns_w FROM p1, kern GROUP BY 1, 2),
n AS (SELECT c.row, c.col, c.x, c.y, CASE WHEN c.ew IS NOT NULL THEN p2.ew / p2.ew_w END AS ew, CASE WHEN c.ns IS NOT NULL THEN p2.ns / p2.ns_w END AS ns FROM c JOIN p2 ON p2.row = c.row AND p2.col = c.col)"""


@query(f"WITH {_SMOOTH} SELECT row, col, round(ew, 6) AS ew FROM n")
def f1_gaussian(fx_pixels: DataFrame) -> DataFrame:
    """The filter is separable, so it costs two windows whatever its width."""
    return rounded(st.nan_gaussian(coords.clear_empty(fx_pixels), ["ew"], 1.0).select("row", "col", "ew"), "ew")


@query("WITH c AS (SELECT row, col, nullif(ew, 0) AS ew FROM fx_pixels) SELECT a.row, a.col, round(CASE WHEN any_value(a.ew) IS NOT NULL THEN sum(exp(-0.5 * ((a.col - b.col) / 2.0) ** 2) * b.ew) / sum(exp(-0.5 * ((a.col - b.col) / 2.0) ** 2)) FILTER (b.ew IS NOT NULL) END, 6) AS ew FROM c a JOIN c b ON a.row = b.row AND b.col BETWEEN a.col - 8 AND a.col + 8 GROUP BY a.row, a.col")
def f2_gaussian_1d(fx_pixels: DataFrame) -> DataFrame:
    return rounded(st.nan_gaussian_1d(coords.clear_empty(fx_pixels), ["row"], "col", "ew", 2.0).select("row", "col", "ew"), "ew")


def _grad_sql(c: str, ky: str, order: str, at: str) -> str:
    w = f"OVER (PARTITION BY {ky} ORDER BY {order})"
    return f"CASE WHEN lag({at}) {w} IS NULL THEN (lead({c}) {w} - {c}) / (lead({at}) {w} - {at}) WHEN lead({at}) {w} IS NULL THEN ({c} - lag({c}) {w}) / ({at} - lag({at}) {w}) ELSE (lead({c}) {w} - lag({c}) {w}) / (lead({at}) {w} - lag({at}) {w}) END"


_GRAD = f"g AS (SELECT row, col, x, y, {_grad_sql('ew', 'row', 'col', 'x')} AS dudx, {_grad_sql('ns', 'row', 'col', 'x')} AS dvdx, {_grad_sql('ew', 'col', 'row', 'y')} AS dudy, {_grad_sql('ns', 'col', 'row', 'y')} AS dvdy FROM {{c}})"


@query(f"WITH {_CLEAN}, {_GRAD.format(c='c')} SELECT row, col, round(dudx, 6) AS dudx, round(dudy, 6) AS dudy, round(dvdx, 6) AS dvdx, round(dvdy, 6) AS dvdy FROM g")
def f3_gradients(fx_pixels: DataFrame) -> DataFrame:
    return rounded(st.gradients(coords.clear_empty(fx_pixels)).select("row", "col", "dudx", "dudy", "dvdx", "dvdy"), "dudx", "dudy", "dvdx", "dvdy")


_STRAIN = "s AS (SELECT row, col, x, y, dudy, dvdx, dudx + 0.5 * (dudx * dudx + dvdx * dvdx) AS a, 0.5 * (dudy + dvdx + dudx * dudy + dvdx * dvdy) AS b, dvdy + 0.5 * (dudy * dudy + dvdy * dvdy) AS d FROM g)"


@query(f"""WITH {_SMOOTH}, {_GRAD.format(c='n')}, {_STRAIN},
sg AS (SELECT * FROM (SELECT x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM fx_trace WINDOW w AS (PARTITION BY strand_id ORDER BY seq)) WHERE x1 IS NOT NULL),
q AS (SELECT row, col, min((x - x0 - f * (x1 - x0)) ** 2 + (y - y0 - f * (y1 - y0)) ** 2) AS d2 FROM (SELECT s.*, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS f FROM s, sg) GROUP BY row, col)
SELECT row, col, round(a, 6) AS exx, round(b, 6) AS exy, round(d, 6) AS eyy FROM s JOIN q USING (row, col) WHERE d2 <= 10000""")
def f4_corridor_strain(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    """Smoothing and differences see the pixels beyond the corridor; the corridor is cut last."""
    strain = st.finite_strain(st.gradients(st.nan_gaussian(coords.clear_empty(fx_pixels), ["ew", "ns"], 1.0))).withColumn("id", F.col("row") * 100 + F.col("col"))
    return rounded(coords.near_trace(strain, fx_trace, "id", 100.0).select("row", "col", "exx", "exy", "eyy"), "exx", "exy", "eyy")


@query(f"""WITH {_CLEAN}, {_GRAD.format(c='c')}, {_STRAIN}, k AS (SELECT cos(radians(60)) AS c, sin(radians(60)) AS s), r AS (SELECT row, col, dudy, dvdx, k.c * k.c * a - 2 * k.c * k.s * b + k.s * k.s * d AS exx, k.c * k.s * (a - d) + (k.c * k.c - k.s * k.s) * b AS exy, k.s * k.s * a + 2 * k.c * k.s * b + k.c * k.c * d AS eyy FROM s, k)
SELECT row, col, round(exx, 6) AS exx, round(exy, 6) AS exy, round(eyy, 6) AS eyy, round(degrees(0.5 * (dudy - dvdx)), 6) AS vorticity, round(exx + eyy, 6) AS dilatation, round((exx + eyy) / 2, 6) AS compression, round(0.5 * sqrt((exx - eyy) ** 2 + 4 * exy ** 2), 6) AS max_shear FROM r""")
def f5_rotated_strain(fx_pixels: DataFrame) -> DataFrame:
    names = ["exx", "exy", "eyy", "vorticity", "dilatation", "compression", "max_shear"]
    return rounded(st.finite_strain(st.gradients(coords.clear_empty(fx_pixels)), 30.0).select("row", "col", *names), *names)


@query(f"WITH {_SMOOTH}, {_GRAD.format(c='n')} SELECT row, col, round(dudx, 6) AS exx, round(dvdy, 6) AS eyy, round(0.5 * (dudy + dvdx), 6) AS exy FROM g")
def f6_strain_maps(fx_pixels: DataFrame) -> DataFrame:
    return rounded(st.strain_maps(coords.clear_empty(fx_pixels), 1.0).select("row", "col", "exx", "eyy", "exy"), "exx", "eyy", "exy")


@query(f"WITH {_CLEAN}, {_GRAD.format(c='c')}, t AS (SELECT *, sin(radians(10)) AS tx, cos(radians(10)) AS ty FROM g) SELECT row, col, round(-tx * ty * dudx + (tx * tx - ty * ty) * 0.5 * (dudy + dvdx) + ty * tx * dvdy, 6) AS shear FROM t")
def f7_shear_along_strike(fx_pixels: DataFrame) -> DataFrame:
    g = st.gradients(coords.clear_empty(fx_pixels)).withColumns({"exx": F.col("dudx"), "eyy": F.col("dvdy"), "exy": 0.5 * (F.col("dudy") + F.col("dvdx"))})
    return rounded(g.select("row", "col", st.shear_along(F.lit(10.0)).alias("shear")), "shear")


@query(f"""WITH {_CLEAN}, p AS (SELECT p_partkey AS id, (p_partkey * 37) % 140 + (p_partkey % 10) / 10.0::DOUBLE AS fr, (p_partkey * 53) % 98 + (p_partkey % 7) / 7.0::DOUBLE AS fc FROM part),
n AS (SELECT id, (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w, ew FROM p, range(0, 2) AS r(i), range(0, 2) AS s(j) LEFT JOIN c ON c.row = floor(fr) + i AND c.col = floor(fc) + j)
SELECT id, round(CASE WHEN count(ew) = 4 THEN sum(w * ew) END, 6) AS ew FROM n GROUP BY id""")
def f8_bilinear(fx_pixels: DataFrame, part: DataFrame) -> DataFrame:
    pts = part.select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37) % 140 + (F.col("p_partkey") % 10) / 10.0).alias("fr"), ((F.col("p_partkey") * 53) % 98 + (F.col("p_partkey") % 7) / 7.0).alias("fc"))
    return rounded(st.bilinear(coords.clear_empty(fx_pixels), pts, ["ew"], ["id"]), "ew")


@query(f"WITH {_CLEAN}, s AS (SELECT col, stddev_pop(CASE WHEN NOT col BETWEEN 45 AND 54 THEN ew END) AS s FROM c GROUP BY col), q AS (SELECT quantile_cont(abs(ew - s), 0.8) AS q FROM c JOIN s USING (col)) SELECT row, col, round(CASE WHEN col BETWEEN 45 AND 54 OR ew - s < q THEN ew END, 9) AS ew FROM c JOIN s USING (col), q")
def f9_marginal_outliers(fx_pixels: DataFrame) -> DataFrame:
    return rounded(st.marginal_outliers(coords.clear_empty(fx_pixels), "ew", 50, 5, 0.8).select("row", "col", "ew"), "ew", digits=9)


@query(f"WITH {_CLEAN} SELECT a.row, a.col, round(CASE WHEN 2 * count(*) FILTER (abs(b.ns - a.ns) <= 0.2) > count(b.ns) THEN any_value(a.ns) END, 9) AS ns FROM c a LEFT JOIN c b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col")
def f10_majority_filter(fx_pixels: DataFrame) -> DataFrame:
    return rounded(st.majority_filter(coords.clear_empty(fx_pixels), "ns", 1, 0.2), "ns", digits=9)


@query(f"WITH {_CLEAN} SELECT a.row, a.col, round(CASE WHEN 2 * count(*) FILTER (abs(b.ew - a.ew) <= 0.08) > count(b.ew) OR stddev_pop(b.ew) <= 0.08 THEN any_value(a.ew) END, 9) AS ew FROM c a LEFT JOIN c b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND (a.row <> b.row OR a.col <> b.col) GROUP BY a.row, a.col")
def f10_delta_or_majority(fx_pixels: DataFrame) -> DataFrame:
    return rounded(st.majority_filter(coords.clear_empty(fx_pixels), "ew", 2, 0.08, flat=True), "ew", digits=9)
