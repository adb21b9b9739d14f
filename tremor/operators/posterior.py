"""Posterior samples as a table (step, sample_id, param_idx, v): summaries, modes, correlations, moments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.spatialjoin import small
from tremor.sources.io import staged


def moments(s: DataFrame, by: list[str]) -> DataFrame:
    return s.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def medians(s: DataFrame, by: list[str]) -> DataFrame:
    return s.groupBy(*by).agg(F.percentile("v", F.lit(0.5)).alias("median"))


#: Cells into which a group's range is cut before the kernel sums: what a grid point meets, however many samples there are.
CELLS = 4096


def density(s: DataFrame, by: list[str], points: int = 256, cells: int = CELLS) -> DataFrame:
    """(by, k, x, density) of a Gaussian kernel estimate with width n**-0.2 times the sample spread, on an even grid over the range.
    Groups without spread give one point.

    Samples are first summed by cell: with t = (x - c) / h and s = (v - c) / h from a cell's centre c, exp(-(t - s)**2 / 2) is
    exp(-t * t / 2) times the sum of He_p(t) s**p / p!, so six sums of powers of s by cell stand for its samples. |s| is at most half a
    cell over h; what is left out is under |s|**6 / 48 of a sample's weight, 1e-15 at 4,096 cells and a range of 30 widths."""
    f = s.groupBy(*by).agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("h", F.pow("n", F.lit(-0.2)) * F.col("sd"))
    f = staged(f, "density")
    size = (F.col("hi") - F.col("lo")) / cells
    at = s.where("v is not null").select(*by, "v").join(small(f.where("h > 0")), by).withColumn("_c", F.least(F.floor((F.col("v") - F.col("lo")) / size), F.lit(cells - 1)))
    at = at.withColumn("_s", (F.col("v") - F.col("lo") - (F.col("_c") + 0.5) * size) / F.col("h"))
    sums = at.groupBy(*by, "_c").agg(*(F.sum(F.pow("_s", F.lit(p))).alias(f"_m{p}") for p in range(6)))
    grid = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).where("h > 0 or k = 0").withColumn("x", F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / (points - 1))
    t = F.col("_t")
    hermite = [F.lit(1.0), t, t**2 - 1, t**3 - 3 * t, t**4 - 6 * t**2 + 3, t**5 - 10 * t**3 + 15 * t]
    met = grid.join(sums, by).withColumn("_t", (F.col("x") - F.col("lo") - (F.col("_c") + 0.5) * size) / F.col("h"))
    total = F.sum(F.exp(-0.5 * t * t) * sum((h * F.col(f"_m{p}") / math.factorial(p) for p, h in enumerate(hermite)), F.lit(0.0)))
    flat = grid.where("h is null or h <= 0").select(*by, "k", "x", F.lit(None).cast("double").alias("density"))
    return met.groupBy(*by, "k", "x").agg((total / F.first(F.col("n") * F.col("h") * (2 * F.pi()) ** 0.5)).alias("density")).unionByName(flat)


def modes(s: DataFrame, by: list[str], points: int = 256) -> DataFrame:
    return density(s, by, points).groupBy(*by).agg(F.max_by("x", F.struct(F.coalesce(F.round("density", 9), F.lit(0.0)), -F.col("k"))).alias("mode"))


def normalised(d: DataFrame, by: list[str]) -> DataFrame:
    return d.withColumn("density", F.col("density") / F.max("density").over(Window.partitionBy(*by)))


def total_slip(s: DataFrame, patches: int) -> DataFrame:
    """(step, sample_id, patch, v): length of the strike-slip and dip-slip vector; parameters are all strike-slip, then all dip-slip."""
    split = s.select("step", "sample_id", (F.col("param_idx") % patches).alias("patch"), F.when(F.col("param_idx") < patches, F.col("v")).alias("ss"), F.when(F.col("param_idx") >= patches, F.col("v")).alias("dd"))
    return split.groupBy("step", "sample_id", "patch").agg(F.hypot(F.max("ss"), F.max("dd")).alias("v"))


def correlations(s: DataFrame) -> DataFrame:
    """(i, j, r) for i <= j."""
    a, b = (s.select("sample_id", F.col("param_idx").alias(k), F.col("v").alias(f"v{k}")) for k in "ij")
    return a.join(b, "sample_id").where("i <= j").groupBy("i", "j").agg(F.corr("vi", "vj").alias("r"))


def correlation_with(s: DataFrame, reference: int) -> DataFrame:
    """(param_idx, r) with one parameter, and the colour limit over the others, to a tenth upwards."""
    ref = s.where(F.col("param_idx") == reference).select("sample_id", F.col("v").alias("_v"))
    r = s.join(ref, "sample_id").groupBy("param_idx").agg(F.corr("v", "_v").alias("r"))
    top = r.where(F.col("param_idx") != reference).agg((F.ceil(F.max(F.abs("r")) * 10) / 10).alias("limit"))
    return r.crossJoin(F.broadcast(top))  # one row


def moment(slip: DataFrame, areas: DataFrame, mu: float = 3e10) -> DataFrame:
    """(strand, sample_id, m0, mw) by strand and for all strands together (strand NULL); areas: (patch, strand, area_km2)."""
    j = slip.join(small(areas), "patch").withColumn("m", mu * F.col("v") * F.col("area_km2") * 1e6)
    both = j.select("sample_id", "m", F.explode(F.array(F.col("strand"), F.lit(None).cast("int"))).alias("strand"))
    return both.groupBy("strand", "sample_id").agg(F.sum("m").alias("m0")).withColumn("mw", (F.log10("m0") - 9.1) * 2 / 3)


def depth_transect(slip: DataFrame, facts: DataFrame, step_km: float, n: int) -> DataFrame:
    """One patch for each depth band of ``step_km``, nearest along strike to the largest slip; the first ``n`` by depth. facts: (patch, along_km, depth_km)."""
    j = slip.join(facts, "patch")
    peak = j.agg(F.max_by("along_km", F.struct("slip", -F.col("patch"))).alias("peak"))
    j = j.crossJoin(F.broadcast(peak)).withColumn("band", F.floor(F.col("depth_km") / step_km))
    w = Window.partitionBy("band").orderBy(F.abs(F.col("along_km") - F.col("peak")), "patch")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").orderBy("band").limit(n).select("patch", "band", "depth_km", "slip")


def bivariate_class(slip: Column, sigma: Column, top_slip: float, top_sigma: float) -> Column:
    """15 classes: eight, four, two and one slip bins at rising quarters of uncertainty."""
    q = F.least(F.floor(F.abs(sigma) / top_sigma * 4), F.lit(3))
    out = None
    for level, (bins, first) in enumerate(((8, 0), (4, 8), (2, 12), (1, 14))):
        c = first + F.least(F.floor(F.greatest(slip, F.lit(0.0)) / top_slip * bins), F.lit(bins - 1))
        out = F.when(q == level, c) if out is None else out.when(q == level, c)
    return out.cast("int")


def uncertainty(slip: Column, sigma: Column, relative: bool) -> Column:
    return F.abs(sigma) / F.greatest(F.abs(slip), F.lit(1e-3)) if relative else sigma


def shortest_interval(s: DataFrame, by: list[str], mass: float = 0.94) -> DataFrame:
    """(by, low, high): the shortest interval over sorted draws that holds ``mass`` of them."""
    w = Window.partitionBy(*by).orderBy("v")
    d = s.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*by))}).withColumn("_k", F.floor(F.col("_n") * mass).cast("int"))
    ahead = d.select(*by, (F.col("_i") - F.col("_k")).alias("_i"), F.col("v").alias("_hi"))
    return d.join(ahead, [*by, "_i"]).groupBy(*by).agg(F.min_by(F.struct(F.col("v").alias("low"), F.col("_hi").alias("high")), F.struct(F.round(F.col("_hi") - F.col("v"), 9), F.col("_i"))).alias("b")).select(*by, "b.*")


def r_hat(s: DataFrame, by: list[str]) -> DataFrame:
    """(by, r_hat): between- and within-chain variance of draws with a ``chain`` column."""
    c = s.groupBy(*by, "chain").agg(F.avg("v").alias("m"), F.var_samp("v").alias("w"), F.count("*").alias("n"))
    g = c.groupBy(*by).agg(F.avg("w").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return g.select(*by, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w")).alias("r_hat"))


def fit_tables(d: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with data, model and residual; per data set and component RMS and the 98th percentile of |data|)."""
    rows = d.join(pred, "row_id").select("row_id", "dataset", "component", F.col("v").alias("data"), F.col("pred").alias("model"), (F.col("v") - F.col("pred")).alias("residual"))
    return rows, rows.groupBy("dataset", "component").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rms"), F.percentile(F.abs("data"), F.lit(0.98)).alias("limit"))
