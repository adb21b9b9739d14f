"""Picked profiles: the trace around each pick found on the displacement step, refined on strain, and a swathe across it
stacked by distance from the refined trace. All picks go through each step together, keyed by pick."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators import polyline as pl
from tremor.operators import relocate as rl
from tremor.operators import ridge as rg
from tremor.operators import stencil as st
from tremor.operators import swathe as sw
from tremor.sources.io import staged


@dataclass(frozen=True)
class Raster:
    """Place (x, y) of row 0 and column 0, and the step of a column in x and of a row in y."""

    origin: tuple[float, float]
    pixel: tuple[float, float]


def drawn_segments(picks: DataFrame, trace: DataFrame, half: float, spacing: float, smooth: int, radius: float) -> DataFrame:
    """(strand_id, k, x, y, strike, at): the trace ``half`` metres around each pick(pick_id, x, y, strike), a sample every ``spacing``
    metres in the direction of the pick's strike, smoothed over 2 ``smooth`` + 1 samples. ``strand_id`` is the pick's id,
    ``at`` its nearest sample. Near an end of its strand the segment is moved inwards; picks without a strand within
    ``radius``, or whose strand is too short to be smoothed, have no samples."""
    found = pl.match_strand(picks, trace, radius).join(pl.totals(trace), "strand_id")
    lo = F.least(F.greatest(F.col("s") - half, F.lit(0.0)), F.greatest(F.col("total") - 2 * half, F.lit(0.0)))
    found = found.withColumn("lo", lo).withColumn("n", F.floor((F.least(lo + 2 * half, F.col("total")) - F.col("lo")) / spacing))
    at = found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).withColumn("_s", F.col("lo") + F.col("k") * spacing)
    at = at.withColumn("_s", F.when(F.col("reversed"), F.col("total") - F.col("_s")).otherwise(F.col("_s")))
    pts = pl.interpolate(at.select("pick_id", "strand_id", "k", "_s"), trace, "_s")
    pts = pl.adjacent_strike(pl.smooth(pts.select(F.col("pick_id").alias("strand_id"), "k", "x", "y"), smooth))
    pts = staged(pts, "drawn")
    away = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    near = pts.join(picks.select(F.col("pick_id").alias("strand_id"), F.col("x").alias("_px"), F.col("y").alias("_py")), "strand_id")
    return pts.join(near.groupBy("strand_id").agg(F.min_by("k", F.struct(F.round(away, 6), "k")).alias("at")), "strand_id")


def step_shifts(px: DataFrame, drawn: DataFrame, raster: Raster, spacing: float, search: float, stack: int, branch: int = 150, sigma: float = 10.0) -> DataFrame:
    """(strand_id, shift): how far to the left of the drawn trace the displacement along it steps.

    Profiles across the ``stack`` samples on each side of the pick (moved inwards at an end) give a median at each offset; gaps are
    bridged, the profile smoothed by ``sigma`` places, and the steepest crossing of its mean within ``search`` metres taken. Profiles reach
    ``branch`` places further than the search, so that the smoothing sees past it. The shift is 0 where there is none, or where under half of the offsets have values."""
    reach = round(search / spacing)
    half = reach + branch
    ends = drawn.groupBy("strand_id").agg(F.min("k").alias("_lo"), F.max("k").alias("_hi"))
    mid = F.least(F.greatest(F.col("at"), F.col("_lo") + stack), F.col("_hi") - stack)
    rows = drawn.join(ends, "strand_id").where(F.abs(F.col("k") - mid) <= stack)
    pts = rows.select("strand_id", "k", "strike", "x", "y", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"))
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    fr = (F.col("y") + F.col("o") * spacing * s - raster.origin[1]) / raster.pixel[1]
    fc = (F.col("x") - F.col("o") * spacing * c - raster.origin[0]) / raster.pixel[0]
    got = st.bilinear(px, pts.select("strand_id", "k", "o", "strike", fr.alias("fr"), fc.alias("fc")), ["ew", "ns"], ["strand_id", "k", "o", "strike"])
    # the bundle of a pick has 2 stack + 1 values at an offset
    profile = got.groupBy("strand_id", F.col("o").cast("long").alias("k")).agg(F.percentile(F.col("ew") * s + F.col("ns") * c, F.lit(0.5)).alias("v"))
    profile = staged(profile, "bundles")
    enough = profile.groupBy("strand_id").agg(F.count("v").alias("n")).where(F.col("n") >= half).select("strand_id")
    smooth = rg.gaussian_along(rg.bridged(profile.join(enough, "strand_id", "left_semi"), "k", "v"), "k", ["v"], sigma)
    window = smooth.where(F.abs("k") <= reach).select(F.col("strand_id").alias("profile_id"), (F.col("k") * spacing).alias("x"), "v")
    cross = rl.step_crossing(window, search).withColumnRenamed("profile_id", "strand_id")
    return ends.select("strand_id").join(cross, "strand_id", "left").select("strand_id", F.coalesce("shift", F.lit(0.0)).alias("shift"))


def _left_of(points: np.ndarray, line: np.ndarray, chunk: int = 2000) -> np.ndarray:
    """Distance of points to a polyline, positive to its left; of equally near segments (to a micrometre squared) the first counts."""
    a, ab = line[:-1], np.diff(line, axis=0)
    length2 = np.maximum((ab**2).sum(1), 1e-300)
    out = np.empty(len(points))
    for i in range(0, len(points), chunk):
        rx, ry = points[i : i + chunk, :1] - a[:, 0], points[i : i + chunk, 1:] - a[:, 1]
        f = np.clip((rx * ab[:, 0] + ry * ab[:, 1]) / length2, 0.0, 1.0)
        d2 = (rx - f * ab[:, 0]) ** 2 + (ry - f * ab[:, 1]) ** 2
        k = np.round(d2, 6).argmin(1)
        n = np.arange(len(k))
        out[i : i + chunk] = np.where(ab[k, 0] * ry[n, k] - ab[k, 1] * rx[n, k] >= 0, 1.0, -1.0) * np.sqrt(d2[n, k])
    return out


def frame_distance(swathe: DataFrame, line: DataFrame, strip: float, half_length: float) -> DataFrame:
    """Adds ``d``, the signed distance of ``swathe(profile_id, t, u, ...)`` from its own profile's ``line(profile_id, seq, t, u)``. The swathe is dealt out
    in strips of ``strip`` metres of u, which bound a group; a line has as many vertices as the refined trace has samples."""
    def one(pixels: pd.DataFrame, vertices: pd.DataFrame) -> pd.DataFrame:
        v = vertices.sort_values("seq")[["t", "u"]].to_numpy(float)
        d = _left_of(pixels[["t", "u"]].to_numpy(float), v) if len(pixels) and len(v) > 1 else np.full(len(pixels), np.nan)
        return pixels.drop(columns="_strip").assign(d=d)

    n = int(np.ceil(half_length / strip))
    every = line.withColumn("_strip", F.explode(F.sequence(F.lit(-n - 1), F.lit(n))))
    left = swathe.withColumn("_strip", F.floor(F.col("u") / strip).cast("int")).groupBy("profile_id", "_strip")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in swathe.dtypes), "d double"])
    return left.cogroup(every.groupBy("profile_id", "_strip")).applyInPandas(one, schema).where(~F.isnan("d"))


def _one_of_alike(picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``picks`` alike in all but their pick_id the first; and (pick_id, _of), the one that stands for each. What follows hangs on a pick's place
    alone, so it is done once for all that share it."""
    first = F.min("pick_id").over(Window.partitionBy("x", "y", "strike", "lo", "hi"))
    marked = staged(picks.select("pick_id", "x", "y", "strike", "lo", "hi").withColumn("_of", first), "picks")
    return marked.where("pick_id = _of").drop("_of"), marked.select("pick_id", "_of")


def picked_profiles(px: DataFrame, trace: DataFrame, picks: DataFrame, raster: Raster, edges: list[float], half_length: float, half_width: float = 50.0,
                    strike_half: float = 100.0, refine_half: float = 400.0, step_search: float | None = 350.0, step_stack: float = 150.0, branch: int = 150, smooth: float = 15.0,
                    stages: Sequence[tuple[float, float, float]] = ((100.0, 10.0, 0.5), (20.0, 5.0, 0.5)), strain_sigma: float = 1.5, dn: float = 0.5,
                    peak_quality: float = 2.0, prior_weight: float = 0.5, offset_sigma: float = 4.0, least: int = 5, near: float = 100.0,
                    min_support: float = 0.5, min_quality: float = 3.0, radius: float = 2000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of ``picks(pick_id, x, y, strike, lo, hi)`` on ``px(row, col, x, y, ew, ns)``, NULL where a component is missing; lengths in metres.

    The drawn trace is moved onto the displacement step (``step_search`` None leaves it), refined on strain within ``refine_half``, and a
    swathe across its mean strike over ``strike_half`` takes each pixel at its distance from the refined trace, which runs
    straight on beyond its ends. Gives three tables:

    * profiles: pick_id, x, y (0 of the profile), strike, step_shift, total_shift (from the drawn place, to the left), support and quality of
      the last stage within ``half_width``, localised;
    * bins: pick_id, bin, xs, n, medians and robust spreads of par, nrm and shear, NULL under ``least`` pixels, within
      [lo, hi] of the pick less its total shift; bins without pixels are absent;
    * near: pick_id, d, par, nrm, along of the pixels within ``near`` of the trace.

    Picks at one place share its rows. A pick without a strand within ``radius`` is in none of them; one whose swathe has no pixels is in the first only."""
    picks, alike = _one_of_alike(picks)
    spacing = abs(raster.pixel[0])
    samples = max(refine_half, step_stack if step_search else 0.0) + smooth + 50.0
    drawn = staged(drawn_segments(picks.select("pick_id", "x", "y", "strike"), trace, samples, spacing, max(0, round(smooth / spacing / 2)), radius), "segments")
    none = drawn.select("strand_id", F.lit(0.0).alias("shift")).distinct()
    shifts = none if step_search is None else staged(step_shifts(px, drawn, raster, spacing, step_search, round(step_stack / spacing), branch), "steps")
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    coarse = drawn.join(shifts, "strand_id").where(F.abs(F.col("k") - F.col("at")) <= F.floor(F.lit(refine_half / spacing)))
    coarse = coarse.select("strand_id", "k", (F.col("x") - F.col("shift") * c).alias("x"), (F.col("y") + F.col("shift") * s).alias("y"))
    strain = staged(st.strain_maps(px, strain_sigma).select("row", "col", "exx", "eyy", "exy"), "strain")
    refined, _ = rg.refine_trace(coarse, strain, stages, raster.origin, raster.pixel, spacing, dn, peak_quality, prior_weight, offset_sigma)

    marks = drawn.select("strand_id", "at").distinct()
    path = staged(pl.arclength(refined.select("strand_id", F.col("k").alias("seq"), "x", "y", "accepted", "quality")).drop("total"), "refined")
    centres = path.join(marks, "strand_id").where("seq = at").select("strand_id", "s", F.col("x").alias("cx"), F.col("y").alias("cy"))
    strikes = sw.scale_strikes(path, centres.select(F.col("strand_id").alias("pick_id"), "strand_id", "s"), [strike_half]).select(F.col("pick_id").alias("profile_id"), "strike")
    frame = staged(centres.withColumnRenamed("strand_id", "profile_id").join(strikes, "profile_id"), "frames")

    around = path.join(frame.select(F.col("profile_id").alias("strand_id"), F.col("s").alias("_s")), "strand_id").where(F.abs(F.col("s") - F.col("_s")) <= half_width)
    judged = sw.localised(around.select(F.col("strand_id").alias("profile_id"), F.col("accepted").isNotNull().alias("accepted"), "quality"), min_support, min_quality)
    drawn_at = picks.select(F.col("pick_id").alias("profile_id"), F.col("x").alias("_px"), F.col("y").alias("_py"), "lo", "hi")
    moved = -(F.col("cx") - F.col("_px")) * c + (F.col("cy") - F.col("_py")) * s
    facts = frame.join(drawn_at, "profile_id").join(judged, "profile_id", "left").join(shifts.select(F.col("strand_id").alias("profile_id"), F.col("shift").alias("step_shift")), "profile_id")
    facts = staged(facts.withColumn("total_shift", moved), "picked")

    line = pl.extend(path.select("strand_id", "seq", "x", "y"), 1.5 * half_length, 31).withColumnRenamed("strand_id", "profile_id").join(frame, "profile_id")
    t = (F.col("x") - F.col("cx")) * s + (F.col("y") - F.col("cy")) * c
    u = -(F.col("x") - F.col("cx")) * c + (F.col("y") - F.col("cy")) * s
    full = sw.frame_pixels(px.where("ew is not null and ns is not null"), frame.select("profile_id", "cx", "cy", "strike"), half_width, half_length)
    far = frame_distance(full, line.select("profile_id", "seq", t.alias("t"), u.alias("u")), max(20 * spacing, half_length / 40), half_length)
    turned = far.join(strain, ["row", "col"], "left").join(frame.select("profile_id", "strike"), "profile_id")
    swathe = staged(turned.select("profile_id", "d", (F.col("ew") * s + F.col("ns") * c).alias("par"), (-F.col("ew") * c + F.col("ns") * s).alias("nrm"),
                                  st.shear_along(F.col("strike")).alias("shear"), F.col("t").alias("along")), "swathe")
    bins = sw.robust_stack(swathe, edges, "d", ["par", "nrm", "shear"], least, ["profile_id"]).withColumnRenamed("x", "xs")
    spans = facts.select("profile_id", (F.col("lo") - F.col("total_shift")).alias("lo"), (F.col("hi") - F.col("total_shift")).alias("hi"))
    named = lambda df: alike.join(df.withColumnRenamed("profile_id", "_of"), "_of").drop("_of")
    profiles = facts.select("profile_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "strike", "step_shift", "total_shift", "support", "quality", "localised")
    return named(profiles), named(sw.crop(bins, spans)), named(swathe.where(F.abs("d") <= near).select("profile_id", "d", "par", "nrm", "along"))
