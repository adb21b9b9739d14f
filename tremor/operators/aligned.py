"""Fault-aligned profiles: displacement and finite strain across a trace, moved onto the peak of shear, stacked along strike,
moved again, and analysed. Profiles are (strand_id, i, profile_id), samples (profile_id, k), k positive to the left of strike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators import analyse as an
from tremor.operators import relocate as rl
from tremor.operators import stencil as st
from tremor.sources.io import staged

STRAIN = ("shear", "dilatation", "max_shear")
MOTION = ("par", "nrm")


def strain_samples(px: DataFrame, centres: DataFrame, reach: int) -> DataFrame:
    """(profile_id, k, shear, dilatation, max_shear) within ``reach`` places of each centre (profile_id, row0, col0, strike): finite strain of
    ``px(row, col, x, y, ew, ns)``, |shear| taken along the profile's own strike at each pixel before it is interpolated.
    Outliers stay; ``stencil.marginal_outliers`` can take them from the raster before."""
    strain = st.finite_strain(st.gradients(px)).select("row", "col", "exx", "eyy", "exy", "dilatation", "max_shear")
    strain = staged(strain, "finite-strain")
    pts = centres.select("profile_id", "strike", "row0", "col0", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k"))
    dx, dy = F.sin(F.radians(F.col("strike") - 90)), -F.cos(F.radians(F.col("strike") - 90))
    pts = pts.select("profile_id", "k", "strike", (F.col("row0") + F.col("k") * dy).alias("fr"), (F.col("col0") + F.col("k") * dx).alias("fc"))
    wanted = {"shear": F.abs(st.shear_along(F.col("strike"))), "dilatation": F.col("dilatation"), "max_shear": F.col("max_shear")}
    return st.bilinear(strain, pts, wanted, ["profile_id", "k", "strike"]).drop("strike")


def stack_at(cube: DataFrame, targets: DataFrame, columns: tuple[str, ...], half: int, gate: int) -> DataFrame:
    """As ``relocate.stack`` by strand, for the profiles ``targets(strand_id, i, profile_id)`` alone: a sample goes only to targets that it
    reaches, so that one stack costs one window. ``cube`` has strand_id, i and k."""
    to = targets.select("strand_id", F.col("i").alias("_to"), F.col("profile_id").alias("_id"))
    near = cube.withColumn("_to", F.explode(F.sequence(F.col("i") - half + 1, F.col("i") + half))).join(to, ["strand_id", "_to"])
    facts = [f for c in columns for f in (F.percentile(c, F.lit(0.5)).alias(f"{c}_med"), F.stddev_pop(c).alias(f"{c}_std"))]
    out = near.groupBy("strand_id", F.col("_to").alias("i"), F.col("_id").alias("profile_id"), "k").agg(*facts, (F.count("*") - F.count(columns[0]) < half // 3).cast("int").alias("_full"))
    ok = out.groupBy("profile_id").agg((F.sum("_full") >= gate).alias("_ok"))
    out = out.join(ok, "profile_id")
    return out.select("profile_id", "k", *(F.when(F.col("_ok"), F.col(f"{c}_{n}")).alias(f"{c}_{n}") for c in columns for n in ("med", "std")))


def shifts_along(cube: DataFrame, centres: DataFrame, column: str, plen: int, width: int, sigma: float, cap: float) -> DataFrame:
    """(profile_id, strand_id, i, shift): the weighted peak of each profile, failures filled from their neighbours along the strand."""
    found = rl.peak_shift(cube, column, rl.boxcar_weights(plen, width, sigma), cap)
    every = centres.select("profile_id", "strand_id", "i").join(found, "profile_id", "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    return rl.fill_failed(every, ["strand_id"], "i")


def aligned_profiles(px: DataFrame, centres: DataFrame, plen: int, strain_reach: int, half: int, search: int, cap: float, final_cap: float, spacing: float,
                     background: float, near: tuple[float, float], far: tuple[float, float], threshold: float = 2.0, trials: int = 20,
                     picks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, records and refined trace of profiles across ``centres(profile_id, strand_id, i, x, y, row0, col0, strike)``.

    Displacement is sampled ``plen`` places to each side, finite strain ``strain_reach``. Each profile is moved onto its shear peak within
    ``search`` and ``cap`` places; displacement follows the shifts without their outliers. Stacks of 2 ``half`` profiles along the strand
    are moved again by peaks within ``final_cap``, filled and smoothed along the strand, and analysed. Lengths of ``background``,
    ``near`` and ``far`` are metres, ``spacing`` those of a place.

    With ``picks(strand_id, i)`` only their profiles are stacked and given, and the second shift is each one's own. Profiles whose strain is
    missing are moved like their neighbours; stacks with too few full places are NULL. Gives:

    * samples: profile_id, k, xs, medians of shear, dilatation, max_shear, par, nrm and spreads of all;
    * records: ``analyse.analyse_profiles`` by profile, with first_shift, second_shift and total_shift in metres;
    * trace: profile_id, along, x, y of the refined places."""
    ids = centres.select("profile_id", "strand_id", "i")
    strain = staged(strain_samples(px, centres, strain_reach), "strain-samples")
    motion = staged(an.line_samples(px, centres, plen), "motion-samples")
    first = staged(shifts_along(strain, centres, "shear", plen, search, 1.0, cap), "first-shift")
    calm = rl.replace_outliers(first, "strand_id", "i", "shift", 10, 1.0).select("profile_id", "shift")
    moved = {STRAIN: rl.apply_shift(strain, first.select("profile_id", "shift"), list(STRAIN)), MOTION: rl.apply_shift(motion, calm, list(MOTION))}
    stacks = []
    for columns, cube in moved.items():
        cube = staged(cube.join(ids, "profile_id"), "moved")
        gate = 2 * strain_reach // 3 if columns is STRAIN else int(plen / 1.5)
        if picks is None:
            out = rl.stack(cube, "i", list(columns), half, gate, ("strand_id",)).select("profile_id", "k", *(f"{c}_{n}" for c in columns for n in ("med", "std")))
        else:
            out = stack_at(cube, ids.join(picks, ["strand_id", "i"], "left_semi"), columns, half, gate)
        stacks.append(out)
    both = staged(stacks[1].join(stacks[0], ["profile_id", "k"], "left"), "stacks")

    of = both.select("profile_id").distinct().join(ids, "profile_id")
    if picks is None:
        second = st.nan_gaussian_1d(shifts_along(both, of, "shear_med", plen, 8, 1.0, final_cap), ["strand_id"], "i", "shift", 2.0 * half)
    else:
        second = rl.peak_shift(both, "shear_med", rl.boxcar_weights(plen, 8, 1.0), final_cap).join(of, "profile_id", "right").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    second = staged(second.select("profile_id", "shift"), "second-shift")
    names = ["shear_med", "dilatation_med", "par_med", "nrm_med"]
    rest = both.drop(*names)
    samples = staged(rl.apply_shift(both, second, names).join(rest, ["profile_id", "k"]).withColumn("xs", F.col("k") * spacing), "aligned")

    given = samples.select("profile_id", "k", "xs", F.col("shear_med").alias("shear"), F.col("dilatation_med").alias("dilatation"), F.col("par_med").alias("par"))
    total = first.select("profile_id", (F.col("shift") * spacing).alias("first_shift")).join(second.select("profile_id", (F.col("shift") * spacing).alias("second_shift")), "profile_id")
    total = total.withColumn("total_shift", F.col("first_shift") + F.col("second_shift"))
    records = an.analyse_profiles(given, background, strain_reach * spacing, near, far, threshold, "k", trials).join(total, "profile_id")
    trace = an.along_fault(centres.select("strand_id", "i", "profile_id", "x", "y", "strike"), total.select("profile_id", F.col("total_shift").alias("shift")))
    return samples, records, trace
