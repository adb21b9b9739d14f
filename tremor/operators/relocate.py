"""Relocation of profiles on the fault, along-strike windows, ridge tracking, robust filters. Samples: (profile_id, k, ...), k the step from the centre."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.quantile import with_quantile
from tremor.sources.io import staged


def boxcar_weights(plen: int, width: int, sigma: float) -> list[float]:
    """A box of ``width`` around the centre of 2 plen + 1 places, smoothed by a Gaussian, 1 at most."""
    box = np.zeros(2 * plen + 1)
    box[plen - width // 2 : plen + width // 2 + 1] = 1.0
    r = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    out = np.convolve(np.concatenate([box[:r][::-1], box, box[-r:][::-1]]), g / g.sum(), "valid")
    return (out / out.max()).tolist()


def peak_shift(cube: DataFrame, column: str, weights: list[float], cap: float, centre: float = 0.0) -> DataFrame:
    """(profile_id, shift): the weighted peak by a parabola through its three places, less ``centre``; 0 at or beyond ``cap`` or under four values."""
    plen = len(weights) // 2
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") + plen + 1).cast("int"))
    by = Window.partitionBy("profile_id").orderBy("k")
    v = cube.where(F.abs("k") <= plen).withColumn("_v", F.col(column) * w).where("_v is not null")
    v = v.withColumns({"_a": F.lag("_v").over(by), "_b": F.lead("_v").over(by)})
    top = v.groupBy("profile_id").agg(F.count("*").alias("n"), F.max_by(F.struct("k", "_a", "_v", "_b"), F.struct(F.col("_v"), -F.col("k"))).alias("t"))
    bend = F.col("t._a") - 2 * F.col("t._v") + F.col("t._b")
    sub = F.when(bend < 0, 0.5 * (F.col("t._a") - F.col("t._b")) / bend).otherwise(0.0)
    at = F.col("t.k") + F.coalesce(sub, F.lit(0.0)) - centre
    return top.select("profile_id", F.when((F.col("n") >= 4) & (F.abs(at) < cap), at).otherwise(0.0).alias("shift"))


def fill_failed(shifts: DataFrame, by: list[str], order: str, column: str = "shift") -> DataFrame:
    """Zeros are interpolated from their neighbours along ``order``; those outside stay 0."""
    # both frames begin at an end of the group, so that each row adds to the one before it; a frame that ends at the group's end is read anew for each row
    before, after = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc(order), F.desc(order)))
    good = F.when(F.col(column) != 0, F.struct(F.col(order).alias("o"), F.col(column).alias("v")))
    out = shifts.withColumn("_g", good).withColumns({"_p": F.last("_g", True).over(before), "_n": F.last("_g", True).over(after)})
    lerp = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(order) - F.col("_p.o")) / (F.col("_n.o") - F.col("_p.o"))
    return out.withColumn(column, F.when(F.col(column) != 0, F.col(column)).otherwise(F.coalesce(lerp, F.lit(0.0)))).drop("_g", "_p", "_n")


def replace_outliers(df: DataFrame, by: str, order: str, column: str, window: int = 5, threshold: float = 5.0) -> DataFrame:
    """In order, each value further than ``threshold`` from the mean of its window (itself left out) becomes that mean; later windows see it.
    Each group is one fault's shifts."""
    half = window // 2

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = pdf[column].to_numpy(float, copy=True)
        for i in range(len(v)):
            near = np.concatenate([v[max(0, i - half) : i], v[i + 1 : i + half + 1]])
            near = near[~np.isnan(near)]
            if len(near) and not np.isnan(v[i]) and abs(v[i] - near.mean()) > threshold:
                v[i] = near.mean()
        return pdf.assign(**{column: v})

    return df.groupBy(by).applyInPandas(one, df.schema)


def replace_outliers_once(df: DataFrame, by: str, order: str, column: str, window: int = 5, threshold: float = 5.0) -> DataFrame:
    """As replace_outliers, but all windows see the original values."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(window // 2), window // 2)
    mean = (F.sum(column).over(w) - F.col(column)) / (F.count(column).over(w) - 1)
    return df.withColumn(column, F.when(F.abs(F.col(column) - mean) > threshold, mean).otherwise(F.col(column)))


def apply_shift(cube: DataFrame, shifts: DataFrame, columns: list[str]) -> DataFrame:
    """Values at k + shift by linear interpolation of the two places around; NULL outside."""
    moved = cube.join(shifts, "profile_id").select("profile_id", F.col("k").alias("_k"), "shift", *(F.col(c).alias(f"_{c}") for c in columns))
    two = F.array(F.struct(F.lit(0).alias("up"), F.floor("_at").alias("k")), F.struct(F.lit(1).alias("up"), (F.floor("_at") + 1).alias("k")))
    want = cube.join(shifts, "profile_id").select("profile_id", "k", "shift").withColumn("_at", F.col("k") + F.col("shift")).select("profile_id", F.col("k").alias("_to"), "_at", F.explode(two).alias("t"))
    near = want.select("profile_id", "_to", (F.when(F.col("t.up") == 1, F.col("_at") - F.floor("_at")).otherwise(1 - (F.col("_at") - F.floor("_at")))).alias("w"), F.col("t.k").alias("_k"))
    got = near.where("w > 0").join(moved, ["profile_id", "_k"], "left")
    return got.groupBy("profile_id", F.col("_to").alias("k")).agg(*(F.when(F.count(f"_{c}") == F.count("*"), F.sum(F.col("w") * F.col(f"_{c}"))).alias(c) for c in columns))


def stack(cube: DataFrame, order: str, columns: list[str], half: int, gate: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Medians and spreads along strike over the profiles from ``half`` before to ``half`` - 1 after, at each k; NULL where under ``gate`` places
    of the profile have at least two thirds of the window. ``by`` keeps strands apart."""
    w = Window.partitionBy(*by, "k").orderBy(order).rowsBetween(-half, half - 1)
    out = cube.withColumns({f"{c}_{n}": f for c in columns for n, f in (("med", F.percentile(c, F.lit(0.5)).over(w)), ("std", F.stddev_pop(c).over(w)))})
    missing = F.count("*").over(w) - F.count(columns[0]).over(w)
    full = out.withColumn("_full", (missing < half // 3).cast("int"))
    ok = F.sum("_full").over(Window.partitionBy(*by, order)) >= gate
    return full.withColumn("_ok", ok).withColumns({f"{c}_{n}": F.when(F.col("_ok"), F.col(f"{c}_{n}")) for c in columns for n in ("med", "std")}).drop("_full", "_ok")


def step_crossing(profile: DataFrame, reach: float) -> DataFrame:
    """(profile_id, shift): zero crossing of the demeaned samples (profile_id, x, v) with the steepest slope within ``reach``."""
    by = Window.partitionBy("profile_id").orderBy("x")
    d = profile.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("profile_id"))).withColumns({"x1": F.lead("x").over(by), "v1": F.lead("v").over(by)})
    cross = d.where("v * v1 <= 0 and v <> v1").withColumns({"at": F.col("x") - F.col("v") * (F.col("x1") - F.col("x")) / (F.col("v1") - F.col("v")), "slope": F.abs((F.col("v1") - F.col("v")) / (F.col("x1") - F.col("x")))})
    return cross.where(F.abs("at") <= reach).groupBy("profile_id").agg(F.max_by("at", F.struct(F.round("slope", 9), -F.col("x"))).alias("shift"))


def straighten(px: DataFrame, near: DataFrame, value: str, step: float, bin_width: float) -> DataFrame:
    """|mean| of ``value`` by (strand_id, along, off): pixels with s and d of the nearest trace point, binned. Values of either sign cancel in a bin, so that
    noise does not lift the background, which is the strand's median over bins that have pixels; bins without pixels are absent and count as 0."""
    at = px.join(near, ["row", "col"]).select("strand_id", F.round(F.col("s") / step).cast("int").alias("along"), F.round(F.col("d") / bin_width).cast("int").alias("off"), F.col(value).alias("v"))
    mean = staged(at.groupBy("strand_id", "along", "off").agg(F.abs(F.avg("v")).alias("v")), "straightened")
    return with_quantile(mean.where("v is not null"), ["strand_id"], "v", 0.5, "background")


def clear_runs(path: DataFrame, clear: Column, least: int) -> DataFrame:
    """Adds ``kept``: whether a row is in a run of at least ``least`` rows along a strand for which ``clear`` holds."""
    by = Window.partitionBy("strand_id").orderBy("along")
    d = path.withColumn("_c", clear).withColumn("_run", F.row_number().over(by) - F.row_number().over(Window.partitionBy("strand_id", "_c").orderBy("along")))
    return d.withColumn("kept", F.col("_c") & (F.count("*").over(Window.partitionBy("strand_id", "_c", "_run")) >= least)).drop("_c", "_run")


def iqr_filter(df: DataFrame, by: list[str], order: str, column: str, half: int, factor: float = 1.5) -> DataFrame:
    """NULL for values beyond ``factor`` quartile ranges of their window (windows of under three values keep all)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    lo, hi = F.percentile(column, F.lit(0.25)).over(w), F.percentile(column, F.lit(0.75)).over(w)
    d = df.withColumns({"_l": lo, "_h": hi, "_n": F.count(column).over(w)})
    r = factor * (F.col("_h") - F.col("_l"))
    return d.withColumn(column, F.when((F.col("_n") < 3) | F.col(column).between(F.col("_l") - r, F.col("_h") + r), F.col(column))).drop("_l", "_h", "_n")


def robust_subset(df: DataFrame, key: str, column: str, factor: float, least: int) -> DataFrame:
    """Rows within ``factor`` robust spreads of their group's median; the whole group if under ``least`` are left."""
    med = df.groupBy(key).agg(F.percentile(column, F.lit(0.5)).alias("_m"))
    dev = df.join(med, key).withColumn("_d", F.abs(F.col(column) - F.col("_m")))
    mad = dev.groupBy(key).agg((1.4826 * F.percentile("_d", F.lit(0.5))).alias("_s"))
    inside = dev.join(mad, key).withColumn("_in", F.col("_d") <= factor * F.col("_s"))
    count = inside.groupBy(key).agg(F.count_if("_in").alias("_k"))
    return inside.join(count, key).where((F.col("_k") < least) | F.col("_in")).select(*df.columns)


def median_filter(df: DataFrame, by: list[str], order: str, column: str, half: int) -> DataFrame:
    """Running median without NULLs; at the ends the first or last value stands for the places beyond."""
    w = Window.partitionBy(*by).orderBy(order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = [F.coalesce(F.lag(column, -k).over(w), F.when(F.col("_i") + k < 1, F.first(column).over(full)).when(F.col("_i") + k > F.col("_n"), F.last(column).over(full))) if k else F.col(column) for k in range(-half, half + 1)]
    d = df.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(full)}).withColumn("_a", F.sort_array(F.filter(F.array(*places), lambda x: x.isNotNull())))
    mid = (F.element_at("_a", F.floor((F.size("_a") + 1) / 2).cast("int")) + F.element_at("_a", F.floor(F.size("_a") / 2).cast("int") + 1)) / 2
    return d.withColumn(column, F.when(F.size("_a") > 0, mid)).drop("_i", "_n", "_a")


def gaussian_weighted_mean(df: DataFrame, key: str, order: str, column: str, sigma: float) -> DataFrame:
    """(key, mean): values weighted by their distance in places from the middle of the group; NULLs are left out."""
    by = Window.partitionBy(key)
    d = df.withColumn("_z", F.row_number().over(by.orderBy(order)) - 1 - (F.count("*").over(by) - 1) / 2)
    w = F.when(F.col(column).isNotNull(), F.exp(-0.5 * (F.col("_z") / sigma) ** 2))
    return d.groupBy(key).agg((F.sum(w * F.col(column)) / F.sum(w)).alias("mean"))


def total_variation(df: DataFrame, key: str, order: str, column: str, weight: Column) -> DataFrame:
    by = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_d", weight * F.abs(F.col(column) - F.lag(column).over(by))).groupBy(key).agg(F.sum("_d").alias("tv"))


def sigmoid(x: Column, a: float, centre: float, slope: float, power: float) -> Column:
    """Signed generalised sigmoid from 0 to a."""
    return a / F.pow(1 + F.exp(-slope * (x - centre)), F.lit(1 / power)) if math.isfinite(a) else F.lit(None)
