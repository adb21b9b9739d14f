"""The picked-profile driver on a planted fault, and its parts against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import picked, ridge

RASTER = picked.Raster((-90.0, 0.0), (1.0, 1.0))
EDGES = [float(e) for e in range(-40, 41, 5)]


def curve(y):
    return 9 + 2.5 * np.sin(y / 25.0)


@pytest.fixture(scope="module")
def planted(spark):
    """Displacement to the north steps by 2 across x = curve(y); a hundredth of the pixels is missing."""
    y, x = np.meshgrid(np.arange(220.0), np.arange(181) - 90.0, indexing="ij")
    rng = np.random.default_rng(1)
    ns = np.tanh((x - curve(y)) / 2.0) + 0.02 * rng.standard_normal(x.shape)
    gone = rng.random(x.shape) < 0.002
    rows = [(int(r), int(c), float(c - 90), float(r), None if gone[r, c] else 0.01 * float(ns[r, c]), None if gone[r, c] else float(ns[r, c])) for r in range(220) for c in range(181)]
    return spark.createDataFrame(rows, "row long, col long, x double, y double, ew double, ns double").cache()


@pytest.fixture(scope="module")
def result(spark, planted):
    trace = spark.createDataFrame([(4, 0, -4.0, 219.0), (4, 1, -4.0, 100.0), (4, 2, -4.0, 0.0), (5, 0, 85.0, 0.0), (5, 1, 85.0, 219.0)], "strand_id int, seq int, x double, y double")
    # the second pick has the strand's own direction, the third is far from all strands
    picks = spark.createDataFrame([(1, -4.0, 110.0, 3.0, -25.0, 60.0), (2, -4.0, 90.0, 178.0, -60.0, 60.0), (3, 5000.0, 0.0, 0.0, -9.0, 9.0)], "pick_id int, x double, y double, strike double, lo double, hi double")
    out = picked.picked_profiles(planted, trace, picks, RASTER, EDGES, 40.0, 12.0, 30.0, 60.0, 30.0, 20.0, smooth=4.0, stages=((20.0, 4.0, 1.0), (8.0, 2.0, 1.0)), strain_sigma=1.0, radius=50.0, near=15.0)
    return [sorted(map(lambda r: r.asDict(), df.collect()), key=lambda r: tuple(v for v in (r["pick_id"], r.get("bin", 0)))) for df in out]


def test_the_centre_lies_on_the_fault_and_the_frame_follows_the_pick(result):
    profiles = {r["pick_id"]: r for r in result[0]}
    assert sorted(profiles) == [1, 2]
    for pick, north in ((1, 1), (2, -1)):
        p = profiles[pick]
        assert abs(p["x"] - curve(p["y"])) < 0.5 and p["localised"] and p["support"] > 0.9 and p["quality"] > 3
        # to the left of north is west: the fault lies 11 to 16 m east of the drawn trace
        # (the mean of the window is not the mid level of a step beside its centre, so that this first place is a coarse one)
        assert 4 < -north * p["step_shift"] < 18
        slope = np.polyfit(np.arange(-30, 31), curve(p["y"] + np.arange(-30, 31)), 1)[0]
        assert abs((p["strike"] - (0 if north > 0 else 180) - np.degrees(np.arctan(slope)) + 180) % 360 - 180) < 2
        a = np.radians(p["strike"])
        assert p["total_shift"] == pytest.approx(-(p["x"] + 4) * np.cos(a) + (p["y"] - (110 if pick == 1 else 90)) * np.sin(a), abs=1e-9)


def test_bins_hold_the_step_and_only_the_trusted_span(result):
    profiles = {r["pick_id"]: r for r in result[0]}
    for pick, north in ((1, 1), (2, -1)):
        bins = [b for b in result[1] if b["pick_id"] == pick]
        lo, hi = ((-25, 60), (-60, 60))[pick - 1]
        assert bins and all(lo - profiles[pick]["total_shift"] <= b["xs"] <= hi - profiles[pick]["total_shift"] for b in bins)
        assert all(EDGES[b["bin"]] <= b["xs"] < EDGES[b["bin"] + 1] for b in bins)
        # left of the trace is west for the pick to the north and east for the one to the south: a step of -2 either way
        for b in bins:
            if abs(b["xs"]) > 8:
                assert abs(b["par_med"] + np.sign(b["xs"])) < 0.06 and b["par_rstd"] < 0.06
        peak = max(bins, key=lambda b: abs(b["shear_med"]))
        assert abs(peak["xs"]) <= 5
    assert min(b["xs"] for b in result[1] if b["pick_id"] == 1) > -25 + 11  # cropped: the shift is about -13


def test_near_pixels_are_near_and_turned(result):
    for r in result[2]:
        assert abs(r["d"]) <= 15 and abs(r["along"]) <= 12.0
    assert {r["pick_id"] for r in result[2]} == {1, 2}


def test_distances_like_brute_force(spark):
    rng = np.random.default_rng(7)
    line = np.column_stack([np.linspace(-50, 50, 41), 3 * rng.standard_normal(41)])
    pts = rng.uniform(-60, 60, (3000, 2))
    got = picked._left_of(pts, line, 256)
    for p, d in zip(pts[::7], got[::7]):
        a, ab = line[:-1], np.diff(line, axis=0)
        f = np.clip(((p - a) * ab).sum(1) / (ab**2).sum(1), 0, 1)
        assert abs(d) == pytest.approx(np.hypot(*(p - a - f[:, None] * ab).T).min(), abs=1e-6)
    df = spark.createDataFrame([(i % 2, i, float(t), float(u)) for i, (t, u) in enumerate(pts)], "profile_id int, i int, t double, u double")
    lines = spark.createDataFrame([(0, k, float(t), float(u)) for k, (t, u) in enumerate(line)] + [(1, 0, -99.0, 0.0), (1, 1, 99.0, 0.0)], "profile_id int, seq int, t double, u double")
    rows = {r["i"]: r["d"] for r in picked.frame_distance(df, lines, 10.0, 60.0).collect()}
    assert len(rows) == 3000
    assert all(rows[i] == pytest.approx(got[i]) if i % 2 == 0 else rows[i] == pytest.approx(pts[i, 1]) for i in range(3000))


def test_no_step_leaves_the_trace(spark, planted):
    flat = planted.withColumns({"ew": F.lit(0.0), "ns": F.lit(1.0)})
    drawn = spark.createDataFrame([(1, k, 0.0, 60.0 + k, 0.0, 40) for k in range(81)], "strand_id int, k long, x double, y double, strike double, at long")
    assert [r["shift"] for r in picked.step_shifts(flat, drawn, RASTER, 1.0, 20.0, 20).collect()] == [0.0]
    assert [r["shift"] for r in picked.step_shifts(flat.where("false"), drawn, RASTER, 1.0, 20.0, 20).collect()] == [0.0]


def test_step_shift_like_plain_numpy(spark, planted):
    full = planted.na.fill(0.0)
    grid = full.toPandas().pivot(index="row", columns="col", values="ns").to_numpy()
    drawn = spark.createDataFrame([(1, k, 0.0, 60.0 + k, 0.0, 40) for k in range(81)], "strand_id int, k long, x double, y double, strike double, at long")
    offsets = np.arange(-120, 121)
    place = -offsets + 90  # to the left of north is west
    there = (place >= 0) & (place < 180)  # a place on the raster's last column has no right neighbour
    v = np.interp(offsets, offsets[there], np.median(grid[80:121][:, place[there]], axis=0))
    v = ridge.smoothed(v, 10.0)[np.abs(offsets) <= 20]
    v -= v.mean()
    x = np.arange(-20, 21)
    cross = [(abs(v[i + 1] - v[i]), x[i] - v[i] / (v[i + 1] - v[i])) for i in range(40) if v[i] * v[i + 1] <= 0]
    shift = picked.step_shifts(full, drawn, RASTER, 1.0, 20.0, 20, 100).first()["shift"]
    assert shift == pytest.approx(max(cross)[1], abs=1e-9) and shift < -2
