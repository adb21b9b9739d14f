"""The fault-aligned driver on a planted fault, its strain and stacks against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import aligned, relocate

ROWS, MID = 70, 45


def east(i):
    """Where the fault lies east of centre i."""
    return 4 + 2 * np.sin(i / 20.0)


@pytest.fixture(scope="module")
def planted(spark):
    """Rows run south; displacement to the north rises by 2 across the fault, with some noise."""
    r, c = np.meshgrid(np.arange(ROWS + 20.0), np.arange(2 * MID + 1.0), indexing="ij")
    ns = np.tanh((c - MID - east(r - 10)) / 2.0) + 0.01 * np.random.default_rng(2).standard_normal(r.shape)
    rows = [(int(i), int(j), float(j), -float(i), 0.0, float(ns[i, j])) for i in range(ns.shape[0]) for j in range(ns.shape[1])]
    return ns, spark.createDataFrame(rows, "row long, col long, x double, y double, ew double, ns double").cache()


@pytest.fixture(scope="module")
def centres(spark):
    rows = [(i, 0, i, float(MID), -float(i + 10), float(i + 10), float(MID), 0.0) for i in range(ROWS)]
    return spark.createDataFrame(rows, "profile_id long, strand_id int, i long, x double, y double, row0 double, col0 double, strike double")


def run(planted, centres, picks=None):
    return aligned.aligned_profiles(planted[1], centres, 36, 24, 4, 20, 10.0, 4.0, 1.0, 8.0, (1.0, 15.0), (4.0, 25.0), 2.0, 8, picks)


def test_strain_at_whole_places_like_numpy(planted, centres):
    ns, px = planted
    v1, v2 = np.gradient(ns, axis=1), -np.gradient(ns, axis=0)  # to the east, to the north
    e11, e12, e22 = 0.5 * v1**2, 0.5 * (v1 + v1 * v2), v2 + 0.5 * v2**2
    got = aligned.strain_samples(px, centres, 24).where("profile_id = 30").orderBy("k").collect()
    at = [(40, MID - r["k"]) for r in got]  # left of north is west
    assert len(got) == 49
    assert np.allclose([r["shear"] for r in got], [abs(e12[p]) for p in at], atol=1e-9)
    assert np.allclose([r["dilatation"] for r in got], [e11[p] + e22[p] for p in at], atol=1e-9)
    assert np.allclose([r["max_shear"] for r in got], [0.5 * np.hypot(e11[p] - e22[p], 2 * e12[p]) for p in at], atol=1e-9)


def test_profiles_are_moved_onto_the_fault(planted, centres):
    samples, records, trace = run(planted, centres)
    found = {r["profile_id"]: r for r in records.collect()}
    assert sorted(found) == list(range(ROWS))
    inner = [found[i] for i in range(6, ROWS - 6)]
    assert max(abs(r["total_shift"] + east(r["profile_id"])) for r in inner) < 1.0
    # the left is the west, which moves south: par falls by 2 to the left
    assert all(abs(r["offset_near"] + 2) < 0.15 and abs(r["offset_far"] + 2) < 0.15 for r in inner)
    assert all(0.15 < r["peak_shear"] < 0.3 and r["width"] is not None for r in inner)
    for p in trace.collect():
        assert p["x"] == pytest.approx(MID - found[p["profile_id"]]["total_shift"]) and p["along"] == pytest.approx(p["profile_id"])
    for s in samples.where("profile_id = 30").collect():
        if 6 < abs(s["k"]) < 25:
            assert abs(s["par_med"] + np.sign(s["k"])) < 0.05 and abs(s["nrm_med"]) < 0.05
    top = samples.where("profile_id = 30").orderBy(F.desc_nulls_last("shear_med")).first()
    assert abs(top["k"]) <= 1 and top["xs"] == top["k"]


def test_only_picks_are_stacked(spark, planted, centres):
    picks = spark.createDataFrame([(0, 20), (0, 40)], "strand_id int, i long")
    samples, records, _ = run(planted, centres, picks)
    rows = {r["profile_id"]: r for r in records.collect()}
    assert sorted(rows) == [20, 40] and {r["profile_id"] for r in samples.select("profile_id").distinct().collect()} == {20, 40}
    assert all(abs(r["total_shift"] + east(i)) < 1.0 and abs(r["offset_near"] + 2) < 0.15 for i, r in rows.items())


def test_stacks_of_picks_like_those_of_all(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * s + i, s, i, k, None if rng.random() < 0.1 else float(rng.random())) for s in (0, 1) for i in range(15) for k in range(-3, 4)]
    cube = spark.createDataFrame(rows, "profile_id long, strand_id int, i long, k int, v double")
    every = relocate.stack(cube, "i", ["v"], 4, 5, ("strand_id",))
    targets = cube.select("strand_id", "i", "profile_id").distinct()
    want = {(r["profile_id"], r["k"]): (r["v_med"], r["v_std"]) for r in every.collect()}
    got = {(r["profile_id"], r["k"]): (r["v_med"], r["v_std"]) for r in aligned.stack_at(cube, targets, ("v",), 4, 5).collect()}
    assert got.keys() == want.keys()
    for key, (m, s) in want.items():
        assert got[key] == ((None, None) if m is None else (pytest.approx(m), pytest.approx(s, abs=1e-9)))
