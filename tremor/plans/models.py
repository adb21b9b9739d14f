"""Queries over Green's functions and inversion (K)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.operators import greens as gr
from tremor.operators import inversion as iv
from tremor.plans.base import query

_OBS = "o AS (SELECT row * 100 + col AS obs_id, x, y FROM fx_pixels)"
_TAU = math.pi * 2
_OKADA = f"""{_OBS}, p AS (SELECT patch_id, cell_id, x0, y0, z0, radians(dip_deg) AS dip, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, (z0 - z1) / sin(radians(dip_deg)) AS w, (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS sx, (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS sy FROM fx_patches),
j AS (SELECT obs_id, patch_id, cell_id, sx, sy, len, w, sin(dip) AS sd, cos(dip) AS cd, (x - x0) * sx + (y - y0) * sy AS xs, w * cos(dip) - (-(x - x0) * sy + (y - y0) * sx) AS yo, z0 FROM o, p),
c AS (SELECT obs_id, patch_id, cell_id, sx, sy, sd, cd, yo * sd - z0 * cd AS q, xs - a * len AS xi, yo * cd + z0 * sd - b * w AS eta, CASE WHEN a = b THEN 1 ELSE -1 END AS sg FROM j, range(0, 2) AS r(a), range(0, 2) AS s(b)),
r AS (SELECT *, CASE WHEN sqrt(xi * xi + eta * eta + q * q) + eta * sd - q * cd > 1e-6 THEN sqrt(xi * xi + eta * eta + q * q) END AS r, sqrt(xi * xi + q * q) AS xq, eta * cd + q * sd AS yt, eta * sd - q * cd AS dt FROM c),
i AS (SELECT *, ln(r + eta) AS le, 0.5 / cd * (ln(r + dt) - sd * ln(r + eta)) AS i4, CASE WHEN abs(xi) < 1e-10 THEN 0 ELSE 1 / cd * atan((eta * (xq + q * cd) + xq * (r + xq) * sd) / (xi * (r + xq) * cd)) END AS i5, CASE WHEN abs(q) < 1e-10 THEN 0 ELSE atan(xi * eta / (q * r)) END AS an FROM r),
k AS (SELECT *, 0.5 * (yt / (cd * (r + dt)) - le) + sd / cd * i4 AS i3, -0.5 * xi / (cd * (r + dt)) - sd / cd * i5 AS i1 FROM i),
t AS (SELECT obs_id, patch_id, cell_id, sx, sy, count(r) = 4 AS whole, sum(sg * (xi * q / (r * (r + eta)) + an + i1 * sd)) / -{_TAU!r} AS s1, sum(sg * (yt * q / (r * (r + eta)) + q * cd / (r + eta) + (-0.5 * le - i3) * sd)) / -{_TAU!r} AS s2, sum(sg * (dt * q / (r * (r + eta)) + q * sd / (r + eta) + i4 * sd)) / -{_TAU!r} AS s3,
sum(sg * (q / r - i3 * sd * cd)) / -{_TAU!r} AS d1, sum(sg * (CASE WHEN abs(r * (r + xi)) < 1e-10 THEN 0 ELSE yt * q / (r * (r + xi)) END + cd * an - i1 * sd * cd)) / -{_TAU!r} AS d2, sum(sg * (CASE WHEN abs(r * (r + xi)) < 1e-10 THEN 0 ELSE dt * q / (r * (r + xi)) END + sd * an - i5 * sd * cd)) / -{_TAU!r} AS d3 FROM k GROUP BY ALL),
gf AS (SELECT obs_id, patch_id, cell_id, slip_comp, CASE WHEN whole THEN e END AS e, CASE WHEN whole THEN n END AS n, CASE WHEN whole THEN u END AS u FROM (SELECT obs_id, patch_id, cell_id, whole, 'strike' AS slip_comp, s1 * sx + s2 * sy AS e, s1 * sy - s2 * sx AS n, s3 AS u FROM t UNION ALL SELECT obs_id, patch_id, cell_id, whole, 'dip', d1 * sx + d2 * sy, d1 * sy - d2 * sx, d3 FROM t))"""


def _obs(px: DataFrame) -> DataFrame:
    return px.select((F.col("row") * 100 + F.col("col")).alias("obs_id"), "x", "y")


def _gf(px: DataFrame, patches: DataFrame) -> DataFrame:
    return gr.rectangle_pairs(_obs(px), patches.where("z0 > z1"))


@query(f"WITH {_OKADA} SELECT obs_id, patch_id, cell_id, slip_comp, round(e, 6) AS e, round(n, 6) AS n, round(u, 6) AS u FROM gf")
def k1_rectangle_pairs(fx_pixels: DataFrame, fx_patches: DataFrame) -> DataFrame:
    return rounded(_gf(fx_pixels, fx_patches), "e", "n", "u")


@query(f"WITH {_OKADA} SELECT obs_id, cell_id, slip_comp, CASE WHEN count(e) = count(*) THEN round(sum(e), 6) END AS e, CASE WHEN count(n) = count(*) THEN round(sum(n), 6) END AS n, CASE WHEN count(u) = count(*) THEN round(sum(u), 6) END AS u FROM gf GROUP BY ALL")
def k2_sum_cells(fx_pixels: DataFrame, fx_patches: DataFrame) -> DataFrame:
    return rounded(gr.sum_cells(_gf(fx_pixels, fx_patches)), "e", "n", "u")


def _point_kernel(p: pd.DataFrame) -> pd.DataFrame:
    r2 = (p["x"] - p["x0"]) ** 2 + (p["y"] - p["y0"]) ** 2 + p["z0"] ** 2
    return pd.DataFrame({"obs_id": p["obs_id"], "patch_id": p["patch_id"], "u": p["z0"] / r2**1.5 * 1e6})


@query(f"WITH {_OBS} SELECT obs_id, patch_id, round(z0 / pow((x - x0) ** 2 + (y - y0) ** 2 + z0 ** 2, 1.5) * 1000000, 6) AS u FROM o, fx_patches")
def k3_kernel_pairs(fx_pixels: DataFrame, fx_patches: DataFrame) -> DataFrame:
    return rounded(gr.kernel_pairs(_obs(fx_pixels), fx_patches.select("patch_id", "x0", "y0", "z0"), _point_kernel, "obs_id long, patch_id long, u double"), "u")


@query(f"WITH {_OKADA} SELECT obs_id, patch_id, slip_comp, CAST(0 AS INT) AS component, round(e, 6) AS g FROM gf UNION ALL SELECT obs_id, patch_id, slip_comp, 1, round(n, 6) FROM gf")
def k4_interleave(fx_pixels: DataFrame, fx_patches: DataFrame) -> DataFrame:
    return rounded(gr.interleave(_gf(fx_pixels, fx_patches)), "g")


@query("SELECT p_partkey AS id, round(sum(0.1 * (1 + n_regionkey) / pi() * (atan((500.0 + 400 * n_nationkey) / x) - atan(400.0 * n_nationkey / x))), 6) AS v FROM (SELECT p_partkey, (p_partkey - 1000.25) * 10 AS x FROM part), nation GROUP BY p_partkey")
def k5_screw_2d(part: DataFrame, nation: DataFrame) -> DataFrame:
    x = part.select(((F.col("p_partkey") - 1000.25) * 10).alias("x"))
    patches = nation.select((400.0 * F.col("n_nationkey")).alias("top"), (500.0 + 400 * F.col("n_nationkey")).alias("bottom"), (0.1 * (1 + F.col("n_regionkey"))).alias("slip"))
    return rounded(gr.screw_2d(x, patches).select((F.col("x") / 10 + 1000.25).cast("long").alias("id"), "v"), "v")


_M = gr.terms_needed((1 - 0.4) / (1 + 0.4))


def _line_sql(x0: str, d: str) -> str:
    k = repr(0.6 / 1.4) + "::DOUBLE"
    arc = lambda e: f"(CASE WHEN ({e}) = 0 OR {d} = 0 THEN 0 ELSE atan({d} / ({e})) END)"
    alt = f"(CASE WHEN i % 2 = 0 THEN {x0} ELSE -({x0}) END)"
    near = f"({arc(f'x - ({x0})')} + list_sum(list_transform(range(1, {_M} + 1), lambda i: pow({k}, i) * ({arc(f'x - (600 * i + {alt})')} + {arc(f'x - (-600 * i + {alt})')}))))"
    far = f"((1 - {k}) * list_sum(list_transform(range(0, {_M} + 1), lambda i: pow({k}, i) * {arc(f'x - (-sign(x) * 600 * i + {alt})')})))"
    return f"(CASE WHEN abs(x) <= 300 THEN {near} ELSE {far} END / pi() + CASE WHEN x > {x0} THEN -0.5 WHEN x < {x0} THEN 0.5 ELSE 0 END)"


@query(f"SELECT CAST(x / 10 + 1000.25 AS BIGINT) AS id, round(sum(slip * ({_line_sql('x_bot', 'bottom')} - {_line_sql('x_top', 'top')})), 6) AS v FROM (SELECT (p_partkey - 1000.25) * 10 AS x FROM part), (SELECT 10.0::DOUBLE * n_nationkey AS x_top, 400.0::DOUBLE * n_nationkey AS top, 10.0::DOUBLE * n_nationkey + 8 AS x_bot, 400.0::DOUBLE * n_nationkey + 400 AS bottom, 0.1 AS slip FROM nation) GROUP BY x")
def k6_damage_zone_2d(part: DataFrame, nation: DataFrame) -> DataFrame:
    x = part.select(((F.col("p_partkey") - 1000.25) * 10).alias("x"))
    k = F.col("n_nationkey")
    patches = nation.select((10.0 * k).alias("x_top"), (400.0 * k).alias("top"), (10.0 * k + 8).alias("x_bot"), (400.0 * k + 400).alias("bottom"), F.lit(0.1).alias("slip"))
    return rounded(gr.damage_zone_2d(x, patches, 300.0, 0.4).select((F.col("x") / 10 + 1000.25).cast("long").alias("id"), "v"), "v")


#: A linear system over the samples: rows are samples, columns the first eight parameters, data the last one.
_SYS = "g AS (SELECT sample_id AS row_id, CAST(param_idx AS BIGINT) AS col_id, v FROM fx_samples WHERE param_idx < 8), d AS (SELECT sample_id AS row_id, CAST(step AS VARCHAR) AS dataset, 0 AS component, v, 1.0 / (1 + sample_id % 3) AS w FROM fx_samples WHERE param_idx = 63), m AS (SELECT CAST(k AS BIGINT) AS col_id, (k - 3.5) / 4 AS m FROM range(0, 8) AS r(k)), pred AS (SELECT row_id, sum(v * m) AS pred FROM g JOIN m USING (col_id) GROUP BY row_id)"


def _system(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = s.where("param_idx < 8").select(F.col("sample_id").alias("row_id"), F.col("param_idx").cast("long").alias("col_id"), "v")
    d = s.where("param_idx = 63").select(F.col("sample_id").alias("row_id"), F.col("step").cast("string").alias("dataset"), F.lit(0).alias("component"), "v", (1.0 / (1 + F.col("sample_id") % 3)).alias("w"))
    m = s.sparkSession.range(8).select(F.col("id").alias("col_id"), ((F.col("id") - 3.5) / 4).alias("m"))
    return g, d, m


@query(f"WITH {_SYS} SELECT row_id, round(pred, 6) AS pred FROM pred")
def k7_predict(fx_samples: DataFrame) -> DataFrame:
    g, _, m = _system(fx_samples)
    return rounded(iv.predict(g, m), "pred")


@query(None)
def k8_noise(fx_samples: DataFrame) -> DataFrame:
    g, _, m = _system(fx_samples)
    return iv.predict(g, m).withColumn("noisy", F.col("pred") + F.randn(7) * 0.1)


@query("WITH s AS (SELECT avg(lon) AS mx, avg(lat) AS my, greatest(max(lon) - min(lon), 1) AS sx, greatest(max(lat) - min(lat), 1) AS sy FROM fx_stations) SELECT sta, CAST(0 AS INT) AS term, CAST(1 AS DOUBLE) AS v FROM fx_stations UNION ALL SELECT sta, 1, round((lon - mx) / sx, 6) FROM fx_stations, s UNION ALL SELECT sta, 2, round((lat - my) / sy, 6) FROM fx_stations, s")
def k9_ramp(fx_stations: DataFrame) -> DataFrame:
    return rounded(iv.ramp(fx_stations.select("sta", F.col("lon").alias("x"), F.col("lat").alias("y")), "sta"), "v")


@query("""WITH p AS (SELECT 'gnss' AS dataset, 0 AS ord, sta AS local_id, 0 AS component, de AS v FROM fx_stations UNION ALL SELECT 'gnss', 0, sta, 1, dn FROM fx_stations UNION ALL SELECT 'optical', 1, lpad(CAST(row * 100 + col AS VARCHAR), 9, '0'), 0, ew FROM fx_pixels)
SELECT dataset, local_id, component, round(v, 9) AS v, row_number() OVER (ORDER BY ord, component, local_id) - 1 AS row_id FROM p""")
def k10_assemble(fx_stations: DataFrame, fx_pixels: DataFrame) -> DataFrame:
    st = fx_stations.select(F.lit("gnss").alias("dataset"), F.lit(0).alias("ord"), F.col("sta").alias("local_id"), F.posexplode(F.array("de", "dn")).alias("component", "v"))
    px = fx_pixels.select(F.lit("optical").alias("dataset"), F.lit(1).alias("ord"), F.lpad((F.col("row") * 100 + F.col("col")).cast("string"), 9, "0").alias("local_id"), F.lit(0).alias("component"), F.col("ew").alias("v"))
    return rounded(iv.assemble(st.unionByName(px)).drop("ord"), "v", digits=9)


@query(f"WITH {_SYS} SELECT dataset, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, round(sqrt(avg(v * v)), 6) AS rms FROM d GROUP BY dataset")
def k11_summary(fx_samples: DataFrame) -> DataFrame:
    return rounded(iv.summary(_system(fx_samples)[1]), "low", "high", "mean", "rms")


@query(f"WITH {_SYS} SELECT a.col_id AS i, b.col_id AS j, round(sum(a.v * b.v * w), 4) AS v FROM g a JOIN g b ON a.row_id = b.row_id AND a.col_id <= b.col_id JOIN d ON d.row_id = a.row_id GROUP BY ALL UNION ALL SELECT a.col_id, NULL, round(sum(a.v * d.v * w), 4) FROM g a JOIN d ON d.row_id = a.row_id GROUP BY ALL")
def k12_normal_equations(fx_samples: DataFrame) -> DataFrame:
    g, d, _ = _system(fx_samples)
    gtg, gtd = iv.normal_equations(g, d)
    return rounded(gtg.unionByName(gtd.withColumn("j", F.lit(None).cast("long"))), "v", digits=4)


# The normal matrix with the right side and the identity behind it, as a list of rows; then elimination, one column a step.
_FULL = f"""WITH RECURSIVE {_SYS}, n AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.v * b.v * w) AS v FROM g a JOIN g b ON a.row_id = b.row_id JOIN d ON d.row_id = a.row_id GROUP BY ALL), r AS (SELECT a.col_id AS i, sum(a.v * d.v * w) AS v FROM g a JOIN d ON d.row_id = a.row_id GROUP BY ALL)"""


@query(f"""{_FULL}, full_ AS (SELECT i, j, v FROM n UNION ALL SELECT i, 8, v FROM r UNION ALL SELECT a.i, 9 + b.i, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END FROM r a, r b),
m0 AS (SELECT list(row ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS row FROM full_ GROUP BY i)),
e AS (SELECT 0 AS k, a FROM m0 UNION ALL SELECT k + 1, list_transform(range(1, 9), lambda i: CASE WHEN i = k + 1 THEN list_transform(a[k + 1], lambda x: x / a[k + 1][k + 1]) ELSE list_transform(range(1, 18), lambda j: a[i][j] - a[i][k + 1] / a[k + 1][k + 1] * a[k + 1][j]) END) FROM e WHERE k < 8)
SELECT CAST(c AS BIGINT) AS col_id, round(a[c + 1][9], 6) AS m, round(sqrt(a[c + 1][10 + c]), 6) AS std FROM e, range(0, 8) AS t(c) WHERE k = 8""")
def k12_least_squares(fx_samples: DataFrame) -> DataFrame:
    g, d, _ = _system(fx_samples)
    return rounded(iv.solve(*iv.normal_equations(g, d)).drop("gradient"), "m", "std")


@query(f"""{_FULL}, q AS (SELECT (SELECT list(row ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS row FROM n GROUP BY i)) AS a, (SELECT list(v ORDER BY i) FROM r) AS b, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM n GROUP BY i)) AS most),
p AS (SELECT 0 AS k, list_transform(range(0, 8), lambda i: CAST(0 AS DOUBLE)) AS x UNION ALL
  SELECT k + 1, list_transform(range(1, 9), lambda i: least(0.02, greatest(-0.02, x[i] - (list_sum(list_transform(range(1, 9), lambda j: a[i][j] * x[j])) - b[i]) / most))) FROM p, q WHERE k < 2000)
SELECT CAST(c AS BIGINT) AS col_id, round(x[c + 1], 6) AS m, CASE WHEN x[c + 1] <= -0.02 THEN 'lower' WHEN x[c + 1] >= 0.02 THEN 'upper' ELSE 'free' END AS state FROM p, range(0, 8) AS t(c) WHERE k = 2000""")
def k12_bounded(fx_samples: DataFrame) -> DataFrame:
    """Within bounds, by active sets; its SQL goes down the gradient and back into the bounds 2,000 times."""
    g, d, _ = _system(fx_samples)
    out = iv.solve(*iv.normal_equations(g, d), (-0.02, 0.02))
    state = F.when(F.col("m") <= -0.02, "lower").when(F.col("m") >= 0.02, "upper").otherwise("free")
    return rounded(out.select("col_id", "m", state.alias("state")), "m")


@query(None)
def k12_bounded_whitened(fx_samples: DataFrame) -> DataFrame:
    """A covariance over neighbouring rows of the whole system, whitened by conjugate gradients, then a bounded solve."""
    g, d, _ = _system(fx_samples)
    near = d.select(F.col("row_id").alias("i"), F.explode(F.sequence(F.col("row_id") - 4, F.col("row_id") + 4)).alias("j")).join(d.select(F.col("row_id").alias("j")), "j")
    cov = near.select("i", "j", (1 - F.abs(F.col("i") - F.col("j")) / 5).alias("v"))
    return iv.solve(*iv.whitened_equations(g, d, cov, 1.0, 1e-7), (-0.05, 0.05))


@query(f"WITH {_SYS} SELECT dataset, round(sqrt(avg((v - pred) ** 2)), 6) AS rms FROM d JOIN pred USING (row_id) GROUP BY dataset")
def k14_residual_rms(fx_samples: DataFrame) -> DataFrame:
    g, d, m = _system(fx_samples)
    return rounded(iv.rms(iv.residuals(d, iv.predict(g, m))), "rms")


@query("""WITH c AS (SELECT CAST(k AS INT) AS candidate, 0.05 * k AS rate FROM range(1, 40) AS r(k)), q AS (SELECT profile_id, candidate, rate, sqrt(sum((rate * sign(xs) - par) ** 2)) AS cost FROM fx_profile_points, c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(cost, 9), candidate) AS k FROM q) SELECT profile_id, candidate, round(CAST(rate AS DOUBLE), 6) AS rate, round(cost, 6) AS cost FROM r WHERE k = 1""")
def k15_score_candidates(fx_profile_points: DataFrame) -> DataFrame:
    grid = fx_profile_points.sparkSession.range(1, 40).select(F.col("id").cast("int").alias("candidate"), (0.05 * F.col("id")).alias("rate"))
    obs = fx_profile_points.select("profile_id", "xs", F.col("par").alias("v"))
    return rounded(iv.score_candidates(obs, grid, F.col("rate") * F.signum("xs"), ["profile_id"]), "rate", "cost")


_PRIORS = "SELECT p_partkey AS label, CASE p_partkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'uniform' ELSE 'truncated' END AS kind, CAST(p_size AS DOUBLE) - 25 AS mu, CAST(2 AS DOUBLE) AS sigma, CAST(3 AS DOUBLE) AS lower, CAST(12 AS DOUBLE) AS upper FROM {part}"


@query(f"WITH p AS ({_PRIORS.format(part='part')}) SELECT label, round(CASE kind WHEN 'uniform' THEN (lower + upper) / 2 WHEN 'truncated' THEN greatest(least(mu, upper - 0.002), lower + 0.002) ELSE mu END, 6) AS v FROM p")
def k16_prior_values(part: DataFrame) -> DataFrame:
    return rounded(iv.central(part.sparkSession.sql(_PRIORS, part=part)), "v")


def _sql_poly(c: list[float], x: str) -> str:
    out = f"CAST({c[0]!r} AS DOUBLE)"
    for k in c[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def _sql_cdf(x: str) -> str:
    a = f"abs({x})"
    low = f"""CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_sql_poly(iv.CDF_UP, a)} / {_sql_poly(iv.CDF_DOWN, a)} ELSE exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631::DOUBLE END"""
    return f"CASE WHEN {x} > 0 THEN 1 - ({low}) ELSE {low} END"


_QUANTILE = f"""CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {_sql_poly(iv.MID_UP, '(0.180625 - (p - 0.5) * (p - 0.5))')} / {_sql_poly(iv.MID_DOWN, '(0.180625 - (p - 0.5) * (p - 0.5))')}
  WHEN rt <= 5 THEN sign(p - 0.5) * {_sql_poly(iv.NEAR_UP, '(rt - 1.6)')} / {_sql_poly(iv.NEAR_DOWN, '(rt - 1.6)')} ELSE sign(p - 0.5) * {_sql_poly(iv.FAR_UP, '(rt - 5)')} / {_sql_poly(iv.FAR_DOWN, '(rt - 5)')} END"""


@query(f"""WITH p AS ({_PRIORS.format(part='part')}), h AS (SELECT *, md5(concat('3:', label, ':', draw)) AS hex FROM p, range(0, 20) AS r(draw)),
u AS (SELECT *, (list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(1, 13), lambda i: CAST(instr('0123456789abcdef', substr(hex, CAST(i AS INT), 1)) - 1 AS DOUBLE))), lambda s, x: s * 16 + x) + 0.5) / 281474976710656 AS u, (lower - mu) / sigma AS lo, (upper - mu) / sigma AS hi FROM h),
f AS (SELECT *, CASE WHEN lo > 0 THEN -hi ELSE lo END AS a, CASE WHEN lo > 0 THEN -lo ELSE hi END AS b FROM u), c AS (SELECT *, {_sql_cdf('a')} AS pa, {_sql_cdf('b')} AS pb FROM f),
d AS (SELECT *, CASE kind WHEN 'truncated' THEN greatest(pa + u * (pb - pa), 1e-300) ELSE u END AS p FROM c), e AS (SELECT *, sqrt(-ln(least(p, 1 - p))) AS rt FROM d), z AS (SELECT *, {_QUANTILE} AS z FROM e)
SELECT label, CAST(draw AS INT) AS draw, round(CASE kind WHEN 'uniform' THEN lower + (upper - lower) * u WHEN 'normal' THEN mu + sigma * z ELSE greatest(least(mu + sigma * CASE WHEN lo > 0 THEN -z ELSE z END, upper - 0.002), lower + 0.002) END, 5) AS v FROM z""")
def k16_prior_draws(part: DataFrame) -> DataFrame:
    return rounded(iv.draw_priors(part.sparkSession.sql(_PRIORS, part=part), 20, 3), "v", digits=5)


@query(f"WITH {_SYS}, r AS (SELECT row_id, v - pred AS res FROM d JOIN pred USING (row_id)) SELECT round(sum(a.res * b.res * CASE WHEN a.row_id = b.row_id THEN 2 ELSE -0.5 END), 4) AS misfit FROM r a JOIN r b ON abs(a.row_id - b.row_id) <= 1")
def k17_likelihood(fx_samples: DataFrame) -> DataFrame:
    g, d, m = _system(fx_samples)
    ids = d.select(F.col("row_id").alias("i"))
    w = ids.select("i", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("j")).withColumn("w", F.when(F.col("i") == F.col("j"), 2.0).otherwise(-0.5))
    return rounded(iv.likelihood(iv.residuals(d, iv.predict(g, m)).select("row_id", "res"), w), "misfit", digits=4)
