"""Queries over posterior samples (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.operators import inversion as iv
from tremor.operators import posterior as po
from tremor.plans.models import _SYS, _system
from tremor.plans.base import query
from tremor.sources import io

_SLIP = "slip AS (SELECT a.step, a.sample_id, a.param_idx AS patch, sqrt(a.v * a.v + b.v * b.v) AS v FROM fx_samples a JOIN fx_samples b ON a.sample_id = b.sample_id AND b.param_idx = a.param_idx + 32 WHERE a.param_idx < 32)"
_SUM = f"{_SLIP}, sm AS (SELECT patch, avg(v) AS slip, stddev_pop(v) AS sigma FROM slip GROUP BY patch)"
_AREA = "ar AS (SELECT CAST(k AS INT) AS patch, CAST(k % 3 AS INT) AS strand, 1.0::DOUBLE + k / 10.0::DOUBLE AS area_km2, k * 0.4::DOUBLE AS depth_km, (k * 7 % 32)::DOUBLE AS along_km FROM range(0, 32) AS r(k))"


def _slip(s: DataFrame) -> DataFrame:
    return po.total_slip(s, 32)


def _facts(s: DataFrame) -> DataFrame:
    k = F.col("id")
    return s.sparkSession.range(32).select(k.cast("int").alias("patch"), (k % 3).cast("int").alias("strand"), (1 + k / 10).alias("area_km2"), (k * 0.4).alias("depth_km"), (k * 7 % 32).cast("double").alias("along_km"))


def _summary(s: DataFrame) -> DataFrame:
    return po.moments(_slip(s), ["patch"]).withColumnsRenamed({"mean": "slip", "std": "sigma"})


@query("SELECT param_idx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM fx_samples GROUP BY param_idx")
def l1_moments(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.moments(fx_samples, ["param_idx"]), "mean", "std")


@query("SELECT param_idx, round(quantile_cont(v, 0.5), 6) AS median FROM fx_samples GROUP BY param_idx")
def l2_medians(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.medians(fx_samples, ["param_idx"]), "median")


def _kde(source: str, by: str, points: int) -> str:
    return f"""f AS (SELECT {by}, count(v) AS n, min(v) AS lo, max(v) AS hi, pow(count(v), -0.2) * stddev_samp(v) AS h FROM {source} GROUP BY ALL), gr AS (SELECT f.*, k, lo + k * (hi - lo) / {points - 1} AS x FROM f, range(0, {points}) AS r(k) WHERE h > 0 OR k = 0),
kd AS (SELECT {by}, k, x, sum(exp(-0.5 * ((x - v) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())) AS density FROM gr JOIN {source} USING ({by}) GROUP BY {by}, k, x), md AS (SELECT {by}, x AS mode FROM kd QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY coalesce(round(density, 9), 0) DESC, k) = 1)"""


@query(f"WITH {_kde('fx_samples', 'param_idx', 64)} SELECT param_idx, round(mode, 6) AS mode FROM md")
def l3_modes(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.modes(fx_samples, ["param_idx"], 64), "mode")


@query(f"WITH {_kde('fx_samples', 'param_idx', 64)} SELECT param_idx, CAST(k AS INT) AS k, round(x, 6) AS x, round(density / max(density) OVER (PARTITION BY param_idx), 6) AS density FROM kd")
def l4_density_curves(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.normalised(po.density(fx_samples, ["param_idx"], 64), ["param_idx"]), "x", "density")


@query(f"WITH {_SLIP} SELECT patch, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM slip GROUP BY patch")
def l5_total_slip(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.moments(_slip(fx_samples), ["patch"]), "mean", "std")


@query("SELECT a.param_idx AS i, b.param_idx AS j, round(corr(a.v, b.v), 6) AS r FROM fx_samples a JOIN fx_samples b ON a.sample_id = b.sample_id AND a.param_idx <= b.param_idx GROUP BY ALL")
def l6_correlations(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.correlations(fx_samples), "r")


@query("WITH r AS (SELECT a.param_idx, corr(a.v, b.v) AS r FROM fx_samples a JOIN fx_samples b ON a.sample_id = b.sample_id AND b.param_idx = 5 GROUP BY a.param_idx) SELECT param_idx, round(r, 6) AS r, (SELECT ceil(max(abs(r)) * 10) / 10 FROM r WHERE param_idx <> 5) AS \"limit\" FROM r")
def l7_correlation_with(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.correlation_with(fx_samples, 5), "r")


@query(f"WITH {_SLIP}, {_AREA}, m AS (SELECT strand, sample_id, sum(30000000000 * v * area_km2 * 1000000) AS m0 FROM slip JOIN ar USING (patch) GROUP BY GROUPING SETS ((strand, sample_id), (sample_id))) SELECT strand, round(quantile_cont((log10(m0) - 9.1) * 2 / 3, 0.5), 6) AS mw FROM m GROUP BY strand")
def l8_moment(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.moment(_slip(fx_samples), _facts(fx_samples)).groupBy("strand").agg(F.percentile("mw", F.lit(0.5)).alias("mw")), "mw")


@query(f"WITH {_SUM}, {_AREA} SELECT patch, round(depth_km, 6) AS depth_km, round(sigma, 6) AS sigma FROM sm JOIN ar USING (patch)")
def l9_depth_uncertainty(fx_samples: DataFrame) -> DataFrame:
    return rounded(_summary(fx_samples).join(_facts(fx_samples), "patch").select("patch", "depth_km", "sigma"), "depth_km", "sigma")


@query(f"WITH {_SUM} SELECT patch, round(slip, 6) AS slip FROM sm ORDER BY round(slip, 6) DESC, patch LIMIT 5")
def l10_top_patches(fx_samples: DataFrame) -> DataFrame:
    return rounded(_summary(fx_samples).select("patch", "slip"), "slip").orderBy(F.desc("slip"), "patch").limit(5)


@query("SELECT param_idx AS patch FROM (SELECT DISTINCT param_idx FROM fx_samples WHERE param_idx < 32) ORDER BY ((CAST(param_idx AS BIGINT) + 11) * 1103515245 + 12345) % 2147483648, param_idx LIMIT 6")
def l11_random_patches(fx_samples: DataFrame) -> DataFrame:
    from tremor.operators.covariance import subsample

    ids = fx_samples.where("param_idx < 32").select(F.col("param_idx").cast("long").alias("patch")).distinct()
    return subsample(ids, "patch", 6, 11).select(F.col("patch").cast("int").alias("patch"))


@query(f"WITH {_SUM}, {_AREA}, j AS (SELECT * FROM sm JOIN ar USING (patch)), p AS (SELECT along_km AS peak FROM j ORDER BY slip DESC, patch LIMIT 1), b AS (SELECT patch, CAST(floor(depth_km / 0.8) AS BIGINT) AS band, depth_km, slip FROM j, p QUALIFY row_number() OVER (PARTITION BY floor(depth_km / 0.8) ORDER BY abs(along_km - peak), patch) = 1) SELECT patch, band, round(depth_km, 6) AS depth_km, round(slip, 6) AS slip FROM b ORDER BY band LIMIT 8")
def l12_depth_transect(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.depth_transect(_summary(fx_samples).select("patch", "slip"), _facts(fx_samples), 0.8, 8), "depth_km", "slip")


@query(f"WITH {_SUM}, q AS (SELECT patch, slip, least(floor(sigma / 1.5 * 4), 3) AS q FROM sm) SELECT patch, CAST(CASE q WHEN 0 THEN least(floor(slip / 4 * 8), 7) WHEN 1 THEN 8 + least(floor(slip / 4 * 4), 3) WHEN 2 THEN 12 + least(floor(slip / 4 * 2), 1) ELSE 14 END AS INT) AS class FROM q")
def l13_bivariate_class(fx_samples: DataFrame) -> DataFrame:
    return _summary(fx_samples).select("patch", po.bivariate_class(F.col("slip"), F.col("sigma"), 4.0, 1.5).alias("class"))


@query(f"WITH {_SUM} SELECT patch, round(abs(sigma) / greatest(abs(slip), 0.001), 6) AS cv, round(sigma, 6) AS sigma FROM sm")
def l15_uncertainty(fx_samples: DataFrame) -> DataFrame:
    s = _summary(fx_samples)
    return rounded(s.select("patch", po.uncertainty(F.col("slip"), F.col("sigma"), True).alias("cv"), po.uncertainty(F.col("slip"), F.col("sigma"), False).alias("sigma")), "cv", "sigma")


@query(f"WITH {_SLIP} SELECT step, patch, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM slip GROUP BY step, patch")
def l16_convergence(fx_samples: DataFrame) -> DataFrame:
    return rounded(po.moments(_slip(fx_samples), ["step", "patch"]), "mean", "std")


@query(f"WITH {_SYS} SELECT round(sqrt(avg(pred * pred)), 6) AS rms_pred, round(sqrt(avg(v * v)), 6) AS rms_data, sqrt(avg(pred * pred)) <= 0.8 * sqrt(avg(v * v)) AS ordered FROM d JOIN pred USING (row_id)")
def l17_ordering_check(fx_samples: DataFrame) -> DataFrame:
    g, d, m = _system(fx_samples)
    j = d.join(iv.predict(g, m), "row_id")
    out = j.agg(F.sqrt(F.avg(F.col("pred") ** 2)).alias("rms_pred"), F.sqrt(F.avg(F.col("v") ** 2)).alias("rms_data"))
    return rounded(out.withColumn("ordered", F.col("rms_pred") <= 0.8 * F.col("rms_data")), "rms_pred", "rms_data")


@query(f"WITH {_SYS} SELECT dataset, CAST(component AS INT) AS component, round(sqrt(avg((v - pred) ** 2)), 6) AS rms, round(quantile_cont(abs(v), 0.98), 6) AS \"limit\" FROM d JOIN pred USING (row_id) GROUP BY dataset, component")
def l18_fit_tables(fx_samples: DataFrame) -> DataFrame:
    g, d, m = _system(fx_samples)
    return rounded(po.fit_tables(d, iv.predict(g, m))[1], "rms", "limit")


@query("SELECT fault_id AS block, CAST(sum(n) OVER (ORDER BY fault_id) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY fault_id) AS BIGINT) AS stop FROM (SELECT fault_id, count(*) AS n FROM fx_triangles GROUP BY fault_id)")
def l19_parameter_blocks(fx_triangles: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = fx_triangles.groupBy(F.col("fault_id").alias("block")).agg(F.count("*").alias("n"))  # one row a block
    stop = F.sum("n").over(Window.orderBy("block"))
    return n.select("block", (stop - F.col("n")).alias("start"), stop.alias("stop"))


@query("SELECT CAST(p_partkey AS INT) AS iteration, round(p_partkey / 1000, 6) AS beta, round(p_size / (p_size + 3 + p_partkey % 11), 6) AS acceptance FROM part")
def l20_annealing_curve(part: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    lines = part.select(F.format_string("%d, %.6f, 0.5, (%d, %d, %d)", k.cast("long"), k / 1000.0, size.cast("long"), F.lit(3).cast("long"), (k % 11).cast("long")).alias("value"))
    return rounded(io.parse_annealing(lines).select("iteration", "beta", "acceptance").orderBy("iteration"), "beta", "acceptance")


@query("""WITH n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY param_idx) AS n FROM fx_samples WINDOW w AS (PARTITION BY param_idx ORDER BY v)), s AS (SELECT a.param_idx, a.v AS low, b.v AS high, row_number() OVER (PARTITION BY a.param_idx ORDER BY round(b.v - a.v, 9), a.i) AS k FROM n a JOIN n b ON a.param_idx = b.param_idx AND b.i = a.i + CAST(floor(a.n * 0.94) AS INT)),
c AS (SELECT param_idx, step, avg(v) AS m, var_samp(v) AS w, count(*) AS n FROM fx_samples GROUP BY ALL), r AS (SELECT param_idx, sqrt(((avg(n) - 1) / avg(n) * avg(w) + var_samp(m)) / avg(w)) AS r_hat FROM c GROUP BY param_idx), a AS (SELECT param_idx, avg(v) AS mean, stddev_samp(v) AS sd FROM fx_samples GROUP BY param_idx)
SELECT param_idx, round(mean, 6) AS mean, round(sd, 6) AS sd, round(low, 6) AS low, round(high, 6) AS high, round(r_hat, 6) AS r_hat FROM a JOIN s USING (param_idx) JOIN r USING (param_idx) WHERE k = 1""")
def l21_summary(fx_samples: DataFrame) -> DataFrame:
    by = ["param_idx"]
    base = fx_samples.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    out = base.join(po.shortest_interval(fx_samples, by), by).join(po.r_hat(fx_samples.withColumnRenamed("step", "chain"), by), by)
    return rounded(out, "mean", "sd", "low", "high", "r_hat")
