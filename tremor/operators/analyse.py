"""Measures of single profiles: background, fault-zone width, offset. Samples: (profile_id, xs, values)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators import relocate as rl
from tremor.operators import swathe as sw
from tremor.operators.inversion import uniform
from tremor.sources.io import staged


def cubic_fit(samples: DataFrame, value: str, scale: float, keys: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """(keys, p0..p3) of a cubic in xs / scale: power sums in one aggregate, a 4 by 4 solve for each group's row of sums; none under five samples."""
    u = F.col("xs") / scale
    sums = samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in range(7)), *(F.sum(F.pow(u, F.lit(k)) * F.col(value)).alias(f"t{k}") for k in range(4)))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            m = np.stack([np.stack([p[f"s{i + j}"] for j in range(4)], 1) for i in range(4)], 1) + 1e-12 * np.eye(4)
            c = np.linalg.solve(m, np.stack([p[f"t{k}"] for k in range(4)], 1)[..., None])[..., 0] if len(p) else np.zeros((0, 4))
            yield pd.DataFrame({**{k: p[k] for k in keys}, **{f"p{k}": c[:, k] for k in range(4)}})

    types = dict(samples.dtypes)
    return sums.where("n >= 5").mapInPandas(solve, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "p0 double, p1 double, p2 double, p3 double"]))


def cubic(scale: float) -> Column:
    u = F.col("xs") / scale
    return F.col("p0") + u * (F.col("p1") + u * (F.col("p2") + u * F.col("p3")))


def most_agreed(tried: DataFrame, keys: list[str], miss: Column, limit: Column) -> DataFrame:
    """(keys, trial) of the trial on whose hypothesis most samples lie within ``limit``; of several the one with the least sum of squares there, then the
    first. ``tried`` has a row for each sample and trial."""
    inside = F.abs(miss) <= limit
    votes = tried.groupBy(*keys, "trial").agg(F.count_if(inside).alias("_k"), F.round(F.sum(F.when(inside, miss * miss).otherwise(0.0)), 9).alias("_ss"))
    return votes.where("_k > 0").groupBy(*keys).agg(F.max_by("trial", F.struct("_k", -F.col("_ss"), -F.col("trial"))).alias("trial"))


def detrend(samples: DataFrame, value: str, inner: float, scale: float, key: str = "event_id", trials: int = 20, share: float = 0.6, near: float = 0.2, threshold: float = 2.0, seed: int = 5) -> DataFrame:
    """Adds ``<value>_res``, ``threshold`` and ``r2``: the rest after a cubic background through the samples (profile_id, key, xs, value) outside +-inner.

    The background is a consensus: in each of ``trials`` trials about ``share`` of the samples, drawn by a digest of (profile, key, trial), give a
    cubic; the one that most samples lie near, within ``near`` spreads of the background, is fitted again to those, or stays as it is
    where those are under five. ``threshold`` spreads of what is left of all background samples make the threshold, and r2 is the fit's over the agreeing ones. A profile without five
    background samples keeps its values, with threshold 0 and no r2."""
    outside = samples.where((F.abs("xs") >= inner) & F.col(value).isNotNull()).select("profile_id", key, "xs", value)
    limit = outside.groupBy("profile_id").agg((near * F.stddev_pop(value)).alias("_limit"))
    every = outside.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    fits = cubic_fit(every.where(uniform(seed, F.col("profile_id"), F.col(key), F.col("trial")) < share), value, scale, ("profile_id", "trial"))
    fits = staged(fits.join(limit, "profile_id"), "consensus")
    # all hypotheses of a profile stand in one row, so that samples meet them without a shuffle for each trial
    hypotheses = fits.groupBy("profile_id").agg(F.collect_list(F.struct("trial", "p0", "p1", "p2", "p3", "_limit")).alias("h"))
    tried = outside.join(hypotheses, "profile_id").withColumn("h", F.explode("h")).select("profile_id", "xs", value, "h.*")
    best = fits.join(most_agreed(tried, ["profile_id"], F.col(value) - cubic(scale), F.col("_limit")), ["profile_id", "trial"])
    agreed = outside.join(best, "profile_id").where(F.abs(F.col(value) - cubic(scale)) <= F.col("_limit")).select(*outside.columns)
    terms = F.struct("p0", "p1", "p2", "p3")
    again = cubic_fit(agreed, value, scale).select("profile_id", terms.alias("_again"))
    fit = staged(best.select("profile_id", terms.alias("_own")).join(again, "profile_id", "left").select("profile_id", F.coalesce("_again", "_own").alias("_p")).select("profile_id", "_p.*"), "background")
    left = F.col(value) - cubic(scale)
    r2 = agreed.join(fit, "profile_id").groupBy("profile_id").agg((1 - F.try_divide(F.sum(left * left), F.var_pop(value) * F.count("*"))).alias("r2"))
    spread = outside.join(fit, "profile_id").groupBy("profile_id").agg((threshold * F.stddev_pop(left)).alias("threshold"))
    facts = fit.join(spread, "profile_id").join(r2, "profile_id", "left")
    out = samples.join(facts, "profile_id", "left").withColumn(f"{value}_res", F.col(value) - F.coalesce(cubic(scale), F.lit(0.0)))
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).drop("p0", "p1", "p2", "p3")


def zone_width(samples: DataFrame, value: str, threshold: Column) -> DataFrame:
    """(profile_id, x_min, x_max, width): the nearest place on each side of 0 where ``value`` is under the threshold."""
    low = F.col(value) < threshold
    out = samples.groupBy("profile_id").agg(F.max(F.when(low & (F.col("xs") <= 0), F.col("xs"))).alias("x_min"), F.min(F.when(low & (F.col("xs") >= 0), F.col("xs"))).alias("x_max"))
    return out.withColumn("width", F.col("x_max") - F.col("x_min"))


def consensus_lines(samples: DataFrame, keys: list[str], value: str, trim: float, trials: int, key: str, seed: int) -> DataFrame:
    """(keys, m, b, std, x_first, x_last, n_agreed): a line through each group's samples (xs, value). A trial's line goes through two samples, drawn by a
    digest of the group and the trial; the line that most samples lie near, within ``trim`` spreads of the values, is fitted again to
    those. std is the spread of all samples of the group around it. Groups of under two samples have none."""
    s = samples.where(F.col(value).isNotNull())
    by = Window.partitionBy(*keys).orderBy("xs", key)  # the window of one profile on one side
    s = s.withColumns({"_r": F.row_number().over(by), "_n": F.count("*").over(Window.partitionBy(*keys)), "_limit": trim * F.stddev_pop(value).over(Window.partitionBy(*keys))})
    s = staged(s.select(*keys, "xs", F.col(value).alias("_y"), "_r", "_n", "_limit"), "windows")
    draw = lambda k: uniform(seed, *(F.col(c) for c in keys), F.col("trial"), F.lit(k))
    h = s.where("_r = 1 and _n >= 2").select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    h = h.withColumns({"_i": (1 + F.floor(draw(0) * F.col("_n"))).cast("int"), "_j": (1 + F.floor(draw(1) * (F.col("_n") - 1))).cast("int")})
    h = h.withColumn("_j", F.when(F.col("_j") >= F.col("_i"), F.col("_j") + 1).otherwise(F.col("_j")))
    for one in "ij":
        h = h.join(s.select(*keys, F.col("_r").alias(f"_{one}"), F.col("xs").alias(f"_x{one}"), F.col("_y").alias(f"_y{one}")), [*keys, f"_{one}"])
    h = h.where("_xi <> _xj").withColumn("_m", (F.col("_yj") - F.col("_yi")) / (F.col("_xj") - F.col("_xi"))).withColumn("_b", F.col("_yi") - F.col("_m") * F.col("_xi"))
    h = staged(h.groupBy(*keys).agg(F.collect_list(F.struct("trial", "_m", "_b")).alias("h")), "lines")
    miss = F.col("_y") - F.col("_b") - F.col("_m") * F.col("xs")
    tried = s.join(h, keys).withColumn("h", F.explode("h")).select(*keys, "xs", "_y", "_limit", "h.*")
    best = h.join(most_agreed(tried, keys, miss, F.col("_limit")), keys).withColumn("h", F.filter("h", lambda x: x["trial"] == F.col("trial"))[0]).select(*keys, "h._m", "h._b")
    agreed = s.join(best, keys).where(F.abs(miss) <= F.col("_limit"))
    line = agreed.groupBy(*keys).agg(F.regr_slope("_y", "xs").alias("m"), F.regr_intercept("_y", "xs").alias("b"), F.count("*").alias("n_agreed")).where("m is not null")
    rest = F.col("_y") - F.col("b") - F.col("m") * F.col("xs")
    return s.join(line, keys).groupBy(*keys).agg(F.first("m").alias("m"), F.first("b").alias("b"), F.stddev_pop(rest).alias("std"), F.min("xs").alias("x_first"), F.max("xs").alias("x_last"), F.first("n_agreed").alias("n_agreed"))


def offset(samples: DataFrame, value: str, inner: float, outer: float, trim: float = 3.0, trials: int = 30, key: str = "event_id", seed: int = 9) -> DataFrame:
    """(profile_id, offset, std, left_first, left_last, right_first, right_last): difference at 0 of consensus lines through windows beyond the zone
    edges x_min and x_max of each sample's profile. A side without a line counts as 0, as in an empty window."""
    right = F.col("xs").between(F.col("x_max") + inner, F.col("x_max") + outer)
    left = F.col("xs").between(F.col("x_min") - outer, F.col("x_min") - inner)
    side = samples.withColumn("side", F.when(right, "r").when(left, "l")).where("side is not null")
    lines = consensus_lines(side, ["profile_id", "side"], value, trim, trials, key, seed)
    of = lambda c, k: F.max(F.when(F.col("side") == k, F.col(c)))
    out = lines.groupBy("profile_id").agg((F.coalesce(of("b", "r"), F.lit(0.0)) - F.coalesce(of("b", "l"), F.lit(0.0))).alias("offset"), F.sqrt(F.sum(F.col("std") ** 2)).alias("std"),
                                          of("x_first", "l").alias("left_first"), of("x_last", "l").alias("left_last"), of("x_first", "r").alias("right_first"), of("x_last", "r").alias("right_last"))
    return out


def analyse_profiles(samples: DataFrame, background: float, scale: float, near: tuple[float, float], far: tuple[float, float], threshold: float = 2.0, key: str = "event_id", trials: int = 20,
                     weight: Column | None = None) -> DataFrame:
    """One row of named results for each profile of ``samples(profile_id, key, xs, shear, dilatation, par)``.

    Shear is freed of its background; where it and the dilatation, times ``weight``, fall under the threshold on either side of 0 is the
    fault zone. Offsets of ``par`` are taken near and far from the shear zone and near the dilatation zone, each with its spread
    and the ends of its windows. Peaks, the place of the shear's peak, r2 of the background and the step width end the row."""
    w = F.lit(1.0) if weight is None else weight
    s = staged(detrend(samples.select("profile_id", key, "xs", "shear", "dilatation", "par"), "shear", background, scale, key, trials, threshold=threshold).withColumns({"_s": F.col("shear_res") * w, "_d": F.col("dilatation") * w}), "detrended")
    zone, wide = (zone_width(s, c, F.col("threshold")) for c in ("_s", "_d"))
    out = zone.join(wide.withColumnsRenamed({"x_min": "x_min_dil", "x_max": "x_max_dil", "width": "width_dil"}), "profile_id")
    for name, edges, limits in (("near", zone, near), ("far", zone, far), ("dil", wide, near)):
        at = s.join(edges.where("x_min is not null and x_max is not null"), "profile_id")
        got = offset(at, "par", *limits, key=key, trials=trials)
        out = out.join(got.withColumnsRenamed({c: f"{c}_{name}" for c in got.columns if c != "profile_id"}), "profile_id", "left")
    facts = s.groupBy("profile_id").agg(F.count("*").alias("n"), F.min("xs").alias("from_x"), F.max("xs").alias("to_x"), F.first("threshold").alias("threshold"), F.first("r2").alias("r2"), F.max("shear_res").alias("peak_shear"),
                                        F.max("dilatation").alias("peak_dilatation"), F.max_by("xs", F.struct(F.round("_s", 12), -F.col("xs"))).alias("x_shift"), F.avg("par").alias("par_mean"))
    return out.join(sw.step_width(samples).withColumnsRenamed({"width": "step_width", "amplitude": "step_amplitude"}), "profile_id", "left").join(facts, "profile_id")


def along_fault(centres: DataFrame, shifts: DataFrame) -> DataFrame:
    """Distance along the fault of profile centres (strand_id, i, profile_id, x, y, strike) and their places after the shift across it."""
    by = Window.partitionBy("strand_id").orderBy("i")
    d = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)), F.lit(0.0))
    at = centres.withColumn("_d", d).withColumn("along", F.sum("_d").over(by)).join(shifts, "profile_id")
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    return at.select("profile_id", "along", (F.col("x") - F.col("shift") * c).alias("x"), (F.col("y") + F.col("shift") * s).alias("y"))


def line_samples(px: DataFrame, centres: DataFrame, plen: int, columns: tuple[str, ...] = ("ew", "ns")) -> DataFrame:
    """(profile_id, k, par, nrm): values on the line across each centre (profile_id, row0, col0, strike), one place a pixel, turned after sampling."""
    from tremor.operators.stencil import bilinear

    dx, dy = F.sin(F.radians(F.col("strike") - 90)), -F.cos(F.radians(F.col("strike") - 90))
    pts = centres.select("profile_id", "strike", "row0", "col0", F.explode(F.sequence(F.lit(-plen), F.lit(plen))).alias("k"))
    pts = pts.select("profile_id", "k", "strike", (F.col("row0") + F.col("k") * dy).alias("fr"), (F.col("col0") + F.col("k") * dx).alias("fc"))
    got = bilinear(px, pts, list(columns), ["profile_id", "k", "strike"])
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    return got.select("profile_id", "k", (F.col("ew") * s + F.col("ns") * c).alias("par"), (-F.col("ew") * c + F.col("ns") * s).alias("nrm"))


def fault_aligned(px: DataFrame, centres: DataFrame, plen: int, half: int, cap: float) -> DataFrame:
    """The fault-aligned path: line samples, gradient of par as shear, peak shift, filled, outliers replaced, samples moved, stacked along strike."""
    cube = line_samples(px, centres, plen)
    by = Window.partitionBy("profile_id").orderBy("k")
    shear = cube.withColumn("shear", F.abs(F.lead("par").over(by) - F.lag("par").over(by)) / 2)
    shifts = rl.peak_shift(shear, "shear", rl.boxcar_weights(plen, plen, plen / 8), cap)
    shifts = shifts.join(centres.select("profile_id", "strand_id", "i"), "profile_id").select("profile_id", "strand_id", "i", "shift")
    shifts = rl.replace_outliers(rl.fill_failed(shifts, ["strand_id"], "i"), "strand_id", "i", "shift")
    moved = rl.apply_shift(cube, shifts.select("profile_id", "shift"), ["par", "nrm"])
    stacked = rl.stack(moved, "profile_id", ["par", "nrm"], half)
    return stacked.join(shifts.select("profile_id", "shift"), "profile_id").select("profile_id", "k", "shift", "par_med", "par_std", "nrm_med", "nrm_std")


def second_shift(cube: DataFrame, column: str, plen: int, cap: float, sigma: float, strands: DataFrame | None = None) -> DataFrame:
    """Finer shifts of stacked samples: peaks within ``cap``, failures filled, smoothed along the fault, applied. ``strands`` (profile_id, strand_id)
    says which profiles are neighbours; without it all lie on one strand."""
    from tremor.operators.stencil import nan_gaussian_1d

    shifts = rl.peak_shift(cube, column, rl.boxcar_weights(plen, plen, 2.0), cap)
    shifts = shifts.withColumn("strand_id", F.lit(0)) if strands is None else shifts.join(strands, "profile_id")
    smooth = nan_gaussian_1d(rl.fill_failed(shifts, ["strand_id"], "profile_id"), ["strand_id"], "profile_id", "shift", sigma)
    return rl.apply_shift(cube, smooth.select("profile_id", "shift"), [column])
