"""Solvers, draws, densities, cuts and profile records against plain numpy."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import analyse, covariance, inversion, mesh, posterior, swathe
from tremor.operators import spatialjoin as sj
from tremor.sources import io


def test_conjugate_gradients_and_bounds_like_dense_algebra(spark):
    rng = np.random.default_rng(2)
    n, p = 20, 2
    g, d = rng.standard_normal((n, p)), rng.standard_normal(n)
    c = np.exp(-np.abs(np.subtract.outer(np.arange(n), np.arange(n))) / 3.0)
    gdf = spark.createDataFrame([(i, j + 5, float(g[i, j])) for i in range(n) for j in range(p)], "row_id long, col_id long, v double")
    ddf = spark.createDataFrame([(i, float(d[i])) for i in range(n)], "row_id long, v double")
    cov = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(n) for j in range(n)], "i long, j long, v double")
    gtg, gtd = inversion.whitened_equations(gdf, ddf, cov, 0.5)
    w = np.linalg.inv(c + 0.5 * np.eye(n))
    for r in gtg.collect():
        assert r["v"] == pytest.approx((g.T @ w @ g)[r["i"] - 5, r["j"] - 5], rel=1e-8, abs=1e-8)
    free = {r["col_id"]: r for r in inversion.solve(gtg, gtd).collect()}
    want = np.linalg.solve(g.T @ w @ g, g.T @ w @ d)
    assert np.allclose([free[k + 5]["m"] for k in range(p)], want, atol=1e-7)
    assert np.allclose([free[k + 5]["std"] for k in range(p)], np.sqrt(np.diag(np.linalg.inv(g.T @ w @ g))), rtol=1e-7)


@pytest.mark.parametrize("seed", range(6))
def test_bounded_solutions_meet_their_optimality_conditions(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    a = rng.standard_normal((2 * n, n))
    m, r = a.T @ a, a.T @ rng.standard_normal(2 * n) * 3
    low, high = -0.1 * rng.random(), 0.1 * rng.random() + 0.01
    x = inversion.bounded(m, r, low, high)
    gradient = m @ x - r
    assert (x >= low).all() and (x <= high).all()
    inside = (x > low) & (x < high)
    assert np.abs(gradient[inside]).max(initial=0) < 1e-8
    assert (gradient[x == low] > -1e-8).all() and (gradient[x == high] < 1e-8).all()
    assert np.allclose(inversion.bounded(m, r, -np.inf, np.inf), np.linalg.solve(m, r))


def test_normal_distribution_and_its_inverse(spark):
    p = np.concatenate([10.0 ** -np.arange(1, 200, 7.0), np.linspace(0.001, 0.999, 101)])
    df = spark.createDataFrame([(float(v),) for v in p], "p double").withColumn("z", inversion.normal_quantile(F.col("p"))).withColumn("back", inversion.normal_cdf(F.col("z")))
    for r in df.collect():
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-12)
        assert r["back"] == pytest.approx(r["p"], rel=1e-6)  # digits of the distribution function run out in the far tail
        assert r["p"] < 1e-9 or r["back"] == pytest.approx(r["p"], rel=1e-11)


def test_truncated_draws_follow_the_truncated_density(spark):
    priors = [("mid", "truncated", 0.0, 1.0, -1.0, 2.0), ("tail", "truncated", 0.0, 1.0, 6.0, 9.0), ("left", "truncated", 0.0, 2.0, None, -3.0), ("free", "normal", 1.0, 2.0, None, None), ("flat", "uniform", 0.0, 1.0, 2.0, 5.0)]
    n = 4000
    got = inversion.draw_priors(spark.createDataFrame(priors, "label string, kind string, mu double, sigma double, lower double, upper double"), n, 1).toPandas()
    phi = statistics.NormalDist().cdf
    for label, kind, mu, sigma, lo, hi in priors:
        v = np.sort(got[got.label == label].v.to_numpy())
        assert len(v) == n
        if kind == "uniform":
            f = (v - lo) / (hi - lo)
        elif label == "tail":  # survival function, which has digits there
            up = [phi(-x) for x in v]
            f = np.array([(phi(-6.0) - u) / (phi(-6.0) - phi(-9.0)) for u in up])
        else:
            a, b = (0.0 if lo is None else phi((lo - mu) / sigma)), (1.0 if hi is None else phi((hi - mu) / sigma))
            f = np.array([(phi((x - mu) / sigma) - a) / (b - a) for x in v])
        assert np.abs(f - (np.arange(n) + 0.5) / n).max() < 1.95 / np.sqrt(n), label  # Kolmogorov's distance at about a thousandth
        assert np.mean(np.isclose(v, v[0])) < 0.01  # nothing piles up at a bound


def test_density_is_the_direct_sum(spark):
    rng = np.random.default_rng(1)
    groups = {1: rng.standard_normal(500), 2: np.concatenate([rng.random(300), 40 + rng.random(5)]), 3: np.array([2.0, 2.0]), 4: np.array([1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g int, v double")
    got = posterior.density(df, ["g"], 33).toPandas()
    for k in (1, 2):
        v, own = groups[k], got[got.g == k].sort_values("k")
        h = len(v) ** -0.2 * v.std(ddof=1)
        x = np.linspace(v.min(), v.max(), 33)
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose(own.x, x) and np.abs(own.density - want).max() < 1e-12
    assert [len(got[got.g == k]) for k in (3, 4)] == [1, 1]


def test_plane_and_level_cuts_meet_by_cells(spark):
    rng = np.random.default_rng(4)
    tri = [(i, 0, 0, *(float(v) for v in np.concatenate([rng.random(3) * 400 + rng.random() * 600 - (1000 if c == 2 else 0) for c in range(3)]))) for i in range(60)]
    columns = "tid long, layer int, fault_id int, " + ", ".join(f"{k}{c} double" for k in "xyz" for c in "abc")
    t = spark.createDataFrame(tri, columns)
    planes = [(k, float(rng.random() * 1000), float(rng.random() * 1000), float(np.cos(a)), float(np.sin(a))) for k, a in enumerate([0.0, np.pi / 2, np.pi / 4, 1.0, 2.5, -0.2])]
    got = {(r["plane_id"], r["tid"]) for r in mesh.plane_cut(t, spark.createDataFrame(planes, "plane_id int, ox double, oy double, dx double, dy double")).collect()}
    want = set()
    for p, ox, oy, dx, dy in planes:
        for i, _, _, *v in tri:
            f = [-(v[c] - ox) * dy + (v[3 + c] - oy) * dx for c in range(3)]
            if min(f) < 0 < max(f):
                want.add((p, i))
    assert got == want and len(want) > 50
    levels = spark.createDataFrame([(float(z),) for z in (-900, -500, -1, 0, 300)], "level double")
    got = {(r["level"], r["tid"]) for r in mesh.slice_levels(t, levels, 1.0).collect()}
    assert got == {(lv, i) for lv in (-900.0, -500.0, -1.0, 0.0, 300.0) for i, _, _, *v in tri if min(v[6:]) < -lv <= max(v[6:])}
    assert mesh.plane_cut(t.where("false"), spark.createDataFrame(planes, "plane_id int, ox double, oy double, dx double, dy double")).count() == 0


def test_least_step_and_grid(spark):
    rng = np.random.default_rng(6)
    for v in (rng.random(200), np.cumsum(np.exp(rng.standard_normal(100) * 4)), np.array([1.0, 1.0, 4.0]), np.array([2.0])):
        r = io.least_step(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "c double"), "c").first()
        d = np.diff(np.unique(v))
        assert (r["c0"], r["c1"]) == (v.min(), v.max()) and (r["dc"] == pytest.approx(d.min()) if len(d) else r["dc"] is None)
    px = spark.createDataFrame([(10.0, 5.0, 1.0), (12.0, 5.0, 2.0), (11.0, 4.0, 3.0)], "lon double, lat double, v double")
    assert sorted(tuple(r) for r in io.rasterise_grid(px, ["v"]).select("row", "col", "v").fillna(-1.0).collect()) == [(0, 0, 1.0), (0, 1, -1.0), (0, 2, 2.0), (1, 0, -1.0), (1, 1, 3.0), (1, 2, -1.0)]
    assert io.rasterise_grid(px.where("false"), ["v"]).count() == 0


def test_pairs_of_tiles_are_all_pairs(spark):
    rng = np.random.default_rng(8)
    n = 300
    x, y, v = rng.random(n) * 50 - 20, rng.random(n) * 30, rng.standard_normal(n)
    df = spark.createDataFrame([(int(i), float(x[i]), float(y[i]), float(v[i])) for i in range(n)], "id long, x double, y double, v double")
    got = {r["bin"]: (r["n"], r["total"]) for r in covariance.tiled_pairs(df, "id", "v", 1.5, 7.0, 16).collect()}
    i, j = np.triu_indices(n, 1)
    d = np.hypot(x[i] - x[j], y[i] - y[j])
    near = d < 7.0
    b = (d[near] // 1.5).astype(int)
    assert got == {k: ((b == k).sum(), pytest.approx(np.abs(v[i] * v[j])[near][b == k].sum())) for k in range(5)}


def test_few_refuses_large_sides(spark):
    with pytest.raises(ValueError):
        sj.few(spark.range(sj.SMALL + 1))


def profiles(spark, seed=3):
    """Two profiles with a step of 3 at 0, a shear peak there on a cubic background, and gross outliers; one profile of four samples."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in (1, 2):
        for k, x in enumerate(np.arange(-200.0, 201.0, 2.0)):
            back = 1.0 + x / 100 + (x / 150) ** 3
            shear = back + 10 * np.exp(-0.5 * (x / 12) ** 2) + rng.standard_normal() * 0.02
            par = 1.5 * np.sign(x) + 0.002 * x + rng.standard_normal() * 0.02
            shear, par = shear + 8 * (k % 67 == 0), par + 40 * (k % 17 == 0)
            rows.append((p, k, float(x), float(shear), float(5 * np.exp(-0.5 * (x / 20) ** 2)), float(par)))
    rows += [(3, k, float(k), 1.0, 0.0, 1.0) for k in range(4)]
    return spark.createDataFrame(rows, "profile_id long, event_id long, xs double, shear double, dilatation double, par double")


def test_consensus_ignores_outliers(spark):
    s = profiles(spark)
    out = analyse.detrend(s, "shear", 50.0, 100.0, trials=60, near=0.05).where("profile_id < 3 and event_id % 67 <> 0 and abs(xs) >= 60").toPandas()
    assert np.abs(out.shear_res).max() < 0.15 and (out.r2 > 0.99).all()
    kept = analyse.detrend(s, "shear", 50.0, 100.0).where("profile_id = 3").toPandas()
    assert (kept.shear_res == 1.0).all() and (kept.threshold == 0).all() and kept.r2.isna().all()
    at = s.withColumns({"x_min": F.lit(-10.0), "x_max": F.lit(10.0)})
    off = analyse.offset(at, "par", 0.0, 150.0, trim=0.1).where("profile_id < 3").toPandas()
    assert np.abs(off.offset - 3.0).max() < 0.05 and (off.left_first == -160).all() and (off.right_last == 160).all()


def test_the_record_is_its_parts(spark):
    s = profiles(spark)
    out = {r["profile_id"]: r for r in analyse.analyse_profiles(s, 50.0, 100.0, (0.0, 120.0), (30.0, 150.0), 0.5).collect()}
    assert sorted(out) == [1, 2, 3]
    d = analyse.detrend(s, "shear", 50.0, 100.0, threshold=0.5)
    zone = {r["profile_id"]: r for r in analyse.zone_width(d, "shear_res", F.col("threshold")).collect()}
    for p in (1, 2):
        r = out[p]
        assert (r["x_min"], r["x_max"], r["width"]) == (zone[p]["x_min"], zone[p]["x_max"], zone[p]["width"])
        assert r["x_min"] < 0 < r["x_max"] and r["n"] == 201 and r["peak_dilatation"] == pytest.approx(5.0)
        at = d.where(F.col("profile_id") == p).drop("threshold", "r2").join(analyse.zone_width(d, "shear_res", F.col("threshold")), "profile_id")
        assert r["offset_near"] == pytest.approx(analyse.offset(at, "par", 0.0, 120.0, trials=20).first()["offset"])
        assert r["step_amplitude"] == pytest.approx(swathe.step_width(s).where(F.col("profile_id") == p).first()["amplitude"])
    assert out[3]["r2"] is None and out[3]["threshold"] == 0


@pytest.mark.parametrize("sill,sigma,lam", [(0.4, 1.5, 200.0), (0.0, 0.3, 60.0)])
def test_fitted_covariance_follows_a_planted_one(spark, sill, sigma, lam):
    d = 20.0 + 40.0 * np.arange(15)
    value = sill + sigma**2 * np.exp(-d / lam)
    cvg = spark.createDataFrame([(k, float(x), float(v)) for k, (x, v) in enumerate(zip(d, value))], "bin int, distance double, value double")
    fit = covariance.fit_covariance(cvg).first()
    got = fit["sill"] + fit["sigma"] ** 2 * np.exp(-d / fit["lam"])
    assert fit["cost"] == pytest.approx(np.abs(got - value).sum(), abs=1e-6)
    assert fit["cost"] < 0.03 * np.abs(value - np.median(value)).sum() and fit["sigma"] >= 0 and fit["lam"] > 0
