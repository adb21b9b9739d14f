"""Known values, edge rules and identities of the operators that have no SQL equivalent, or whose borders matter."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import analyse, coords, greens, inversion, relocate, swathe
from tremor.operators.spatialjoin import interval_join
from tremor.plans.registry import QUERIES
from tremor.sources import io

SF = "/root/testdata/sf0.001"


def test_utm_control_point_and_round_trip(spark):
    df = spark.createDataFrame([(-117.0, 35.0), (-115.5, 36.25), (-118.9, -10.0)], "lon double, lat double")
    there = coords.ll_to_utm(df, 11, False)
    first = there.first()
    assert first.x == pytest.approx(500000.0, abs=1e-6)  # on the central meridian
    e2 = coords.FLAT * (2 - coords.FLAT)
    t = (np.arange(200_000) + 0.5) / 200_000 * math.radians(35)
    arc = (coords.A * (1 - e2) / (1 - e2 * np.sin(t) ** 2) ** 1.5).mean() * math.radians(35)
    assert first.y == pytest.approx(0.9996 * arc, abs=1e-3)
    back = coords.utm_to_ll(there.select("x", "y"), 11).collect()
    for a, b in zip(df.collect(), back):
        assert b.lon == pytest.approx(a.lon, abs=1e-9) and b.lat == pytest.approx(a.lat, abs=1e-9)


def test_intervals_are_half_open(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.5)], "x double")
    assert [(r.x, r.bin) for r in interval_join(df, [0.0, 1.0, 2.0], "x").collect()] == [(0.0, 0), (0.5, 0), (1.0, 1)]


def test_last_edge_of_uniform_bins_is_inclusive(spark):
    df = spark.createDataFrame([(1, float(k)) for k in range(11)], "profile_id int, xs double").withColumn("v", F.col("xs"))
    assert [r.n for r in swathe.bin_average(df, 5, ["v"]).orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    one = spark.createDataFrame([(1, 3.0, 1.0)], "profile_id int, xs double, v double")
    assert [r.n for r in swathe.bin_average(one, 3, ["v"]).orderBy("bin").collect()] == [0, 0, 1]  # one position: the last bin


def test_bbox_is_strict_and_window_inclusive(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "lon double, lat double")
    assert coords.bbox(df, 0, 2, 0, 2).count() == 1
    px = df.toDF("x", "y")
    assert coords.window(px, 2, 0, 0, 2).count() == 3


def test_edges_grow_and_are_symmetric():
    for e in (swathe.decaying_edges(1000.0), swathe.inversion_edges(5000.0)):
        assert e == sorted(e) and np.allclose(e, [-x for x in e[::-1]]) and 0.0 in e
    assert swathe.inversion_edges(5000.0)[-1] == 5000.0
    # the last bin of the stack keeps its grown width, and so may end beyond the profile
    e = swathe.decaying_edges(1000.0)
    assert e[-2] < 1000.0 <= e[-1] and e[-1] - e[-2] == pytest.approx(min(1.12 * (e[-2] - e[-3]), 100.0))


def test_outliers_in_order_see_replaced_values(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([0, 0, 100, 90, 0, 0])], "g int, i int, v double")
    got = [r.v for r in relocate.replace_outliers(df, "g", "i", "v", 3, 10.0).orderBy("i").collect()]
    v = [0.0, 0, 100, 90, 0, 0]
    for i in range(6):
        near = v[max(0, i - 1) : i] + v[i + 1 : i + 2]
        m = sum(near) / len(near)
        v[i] = m if abs(v[i] - m) > 10 else v[i]
    assert got == v


def test_peak_shift_finds_a_parabola(spark):
    df = spark.createDataFrame([(1, k, 5.0 - (k - 2.3) ** 2) for k in range(-10, 11)] + [(2, k, 0.0) for k in range(-1, 2)], "profile_id long, k int, v double")
    got = {r.profile_id: r.shift for r in relocate.peak_shift(df, "v", [1.0] * 21, 8.0).collect()}
    assert got[1] == pytest.approx(2.3) and got[2] == 0.0


def test_cubic_background_is_removed(spark):
    rows = [(1, x, float(x), 1 + 0.01 * x + 1e-6 * x**3 + (3.0 if abs(x) < 20 else 0.0)) for x in range(-200, 201, 5)]
    df = spark.createDataFrame(rows, "profile_id long, event_id long, xs double, par double")
    res = {r.xs: r.par_res for r in analyse.detrend(df, "par", 20.0, 200.0).collect()}
    assert abs(res[-100.0]) < 1e-6 and res[0.0] == pytest.approx(3.0, abs=1e-6)


def test_homogeneous_limit_and_far_field(spark):
    x = spark.createDataFrame([(-1e7,), (-50.0,), (70.0,), (1e7,)], "x double")
    line = lambda half, ratio: [r.v for r in x.select(greens.line_in_zone(F.col("x"), F.lit(10.0), F.lit(500.0), half, ratio).alias("v")).collect()]
    same, zone = line(300.0, 1.0), line(300.0, 0.4)
    assert same[1] == pytest.approx(math.atan(500 / -60) / math.pi + 0.5)
    for v in (same, zone):
        assert v[0] == pytest.approx(0.5, abs=1e-3) and v[-1] == pytest.approx(-0.5, abs=1e-3)


def test_vertical_patch_uses_the_special_case(spark):
    obs = spark.createDataFrame([(0, 30.0, 40.0), (1, -30.0, 40.0)], "obs_id long, x double, y double")
    patch = lambda dip: spark.createDataFrame([(0, 0, 0.0, -500.0, 100.0, 0.0, 500.0, 0.0, dip)], "patch_id int, cell_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, dip_deg double")
    read = lambda dip: [(r.e, r.n, r.u) for r in greens.rectangle_pairs(obs, patch(dip)).where("slip_comp = 'strike'").orderBy("obs_id").collect()]
    vertical, near = read(90.0), read(89.99)
    assert np.allclose(vertical, near, atol=1e-3)
    assert vertical[0][1] == pytest.approx(-vertical[1][1], abs=1e-6)  # odd across the fault


def test_prior_draws_keep_their_bounds(spark):
    rows = QUERIES["k16_prior_draws"](spark, SF).groupBy("label").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()
    assert len(rows) == 200 and all(r.n == 20 for r in rows) and all(3 <= r.lo and r.hi <= 12 for r in rows if r.label % 3)
