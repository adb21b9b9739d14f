"""Swathe profiles: extraction, binning, robust stacks and step measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators import quantile as qt
from tremor.operators.spatialjoin import bucketed_join, cell_of, interval_join, small
from tremor.sources.io import staged


def extract(px: DataFrame, profiles: DataFrame, half_width: float, cell: float = 500.0) -> DataFrame:
    """Samples (profile_id, xs, par, nrm, perp) of pixels in each profile's swathe. Profiles: (profile_id, x0, y0, x1, y1, fault_x);
    xs runs from the start, less fault_x; par and nrm are along and to the left of the profile. Borders belong to the swathe."""
    p = profiles.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).withColumns({"ux": (F.col("x1") - F.col("x0")) / F.col("length"), "uy": (F.col("y1") - F.col("y0")) / F.col("length")})
    along = (F.col("x") - F.col("x0")) * F.col("ux") + (F.col("y") - F.col("y0")) * F.col("uy")
    perp = -(F.col("x") - F.col("x0")) * F.col("uy") + (F.col("y") - F.col("y0")) * F.col("ux")
    bounds = (F.least("x0", "x1") - half_width, F.greatest("x0", "x1") + half_width, F.least("y0", "y1") - half_width, F.greatest("y0", "y1") + half_width)
    inside = (F.abs(perp) <= half_width) & (along >= 0) & (along <= F.col("length"))
    hit = bucketed_join(px.where("ew is not null and ns is not null"), small(p), cell, bounds, inside)
    return hit.select("profile_id", "row", "col", (along - F.col("fault_x")).alias("xs"), (F.col("ew") * F.col("ux") + F.col("ns") * F.col("uy")).alias("par"), (-F.col("ew") * F.col("uy") + F.col("ns") * F.col("ux")).alias("nrm"), perp.alias("perp"))


def bin_average(samples: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """Means in ``n`` equal bins between the ends of each profile; the last edge belongs to the last bin; empty bins are NULL."""
    ends = samples.groupBy("profile_id").agg(F.min("xs").alias("lo"), F.max("xs").alias("hi"))
    at = samples.join(ends, "profile_id").withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col("xs") - F.col("lo"), (F.col("hi") - F.col("lo")) / n)), F.lit(n - 1)), F.lit(0)).cast("int"))
    full = ends.select("profile_id", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    means = at.groupBy("profile_id", "bin").agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))
    return full.join(means, ["profile_id", "bin"], "left").select("profile_id", "bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / n).alias("x"), *columns, F.coalesce("n", F.lit(0)).alias("n"))


def zone_edges(lo: float, hi: float, near: float, n: int) -> list[float]:
    """Edges of three zones (left, within +-near, right): half of the bins near, the rest in proportion to the two sides."""
    inner = n // 2
    left = max(1, round((n - inner) * (-near - lo) / ((-near - lo) + (hi - near))))
    step = lambda a, b, k: [a + (b - a) * i / k for i in range(k)]
    return step(lo, -near, left) + step(-near, near, inner) + step(near, hi, max(1, n - inner - left)) + [hi]


def edge_average(samples: DataFrame, edges: list[float], columns: list[str]) -> DataFrame:
    return interval_join(samples, edges, "xs").groupBy("profile_id", "bin").agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def populated_span(samples: DataFrame, n: int = 50, share: float = 0.1) -> DataFrame:
    """(profile_id, lo, hi): from the first to the last of ``n`` bins with more than ``share`` of the median count of filled bins."""
    ends = samples.groupBy("profile_id").agg(F.min("xs").alias("a"), F.max("xs").alias("b"))
    width = (F.col("b") - F.col("a")) / n
    at = samples.join(ends, "profile_id").withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col("xs") - F.col("a"), width)), F.lit(n - 1)), F.lit(0)).cast("int"))
    counts = at.groupBy("profile_id", "a", "b", "bin").agg(F.count("*").alias("n"))
    mid = counts.groupBy("profile_id").agg(F.percentile("n", F.lit(0.5)).alias("mid"))
    return counts.join(mid, "profile_id").where(F.col("n") > share * F.col("mid")).groupBy("profile_id").agg(F.min(F.col("a") + F.col("bin") * width).alias("lo"), F.max(F.col("a") + (F.col("bin") + 1) * width).alias("hi"))


def crop(samples: DataFrame, spans: DataFrame, shift: Column | None = None) -> DataFrame:
    """Samples within [lo, hi] of their profile, both moved by ``shift``."""
    d = F.lit(0.0) if shift is None else shift
    return samples.join(spans, "profile_id").where(F.col("xs").between(F.col("lo") + d, F.col("hi") + d)).drop("lo", "hi")


def quick_profiles(samples: DataFrame, n: int, least: int, side: int, valid: int) -> DataFrame:
    """Cropped, binned profiles that pass the gates: samples, samples on each side of 0, filled bins."""
    cropped = crop(samples, populated_span(samples))
    good = cropped.groupBy("profile_id").agg(F.count("*").alias("n"), F.count_if(F.col("xs") < 0).alias("l"), F.count_if(F.col("xs") > 0).alias("r")).where((F.col("n") >= least) & (F.col("l") >= side) & (F.col("r") >= side)).select("profile_id")
    bins = bin_average(cropped.join(good, "profile_id", "left_semi"), n, ["par", "nrm"])
    filled = bins.groupBy("profile_id").agg(F.count("par").alias("k")).where(F.col("k") >= valid).select("profile_id")
    return bins.join(filled, "profile_id", "left_semi")


def frame_pixels(px: DataFrame, profiles: DataFrame, half_width: float, half_length: float) -> DataFrame:
    """Pixels in rectangles around centres (profile_id, cx, cy, strike), as (t along strike, u to its left); the upper ends are left out."""
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    t = (F.col("x") - F.col("cx")) * s + (F.col("y") - F.col("cy")) * c
    u = -(F.col("x") - F.col("cx")) * c + (F.col("y") - F.col("cy")) * s
    r = half_width + half_length
    hit = bucketed_join(px, small(profiles), max(2 * r, 100.0), (F.col("cx") - r, F.col("cx") + r, F.col("cy") - r, F.col("cy") + r), (t >= -half_width) & (t < half_width) & (u >= -half_length) & (u < half_length))
    return hit.select("profile_id", "row", "col", t.alias("t"), u.alias("u"), "ew", "ns")


def decaying_edges(plen: float) -> list[float]:
    """Fixed rule: 1 m steps to 30 m, growing 1.05 times to 200 m and 1.12 times beyond, 100 m at most; symmetric about 0.
    The last edge is the first at or beyond ``plen``."""
    out, at, step = [0.0], 0.0, 1.0
    while at < plen:
        step = 1.0 if at < 30 else min(step * (1.05 if at < 200 else 1.12), 100.0)
        at += step
        out.append(at)
    return [-e for e in out[:0:-1]] + out


def inversion_edges(plen: float) -> list[float]:
    """Fixed rule: 10 m steps to 500 m, then growing 1.1 times, to ``plen``; symmetric about 0."""
    out, at, step = [0.0], 0.0, 10.0
    while at < plen:
        step = 10.0 if at < 500 else step * 1.1
        at = min(at + step, plen)
        out.append(at)
    return [-e for e in out[:0:-1]] + out


def robust_std(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, med, rstd): median and 1.4826 times the median absolute deviation."""
    return qt.robust_spread(df, keys, column)


def robust_stack(df: DataFrame, edges: list[float], column: str, values: list[str], least: int, keys: list[str] | None = None) -> DataFrame:
    """Medians and robust spreads of ``values`` in half-open bins of ``column``; NULL under ``least`` rows; x is the median position. All columns are
    ranked together, by bin and column, in two rounds of distributed quantiles."""
    keys = [*(keys or []), "bin"]
    at = interval_join(df, edges, column)
    long = staged(at.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(c).cast("double").alias("_x")) for n, c in (("x", column), *((v, v) for v in values))))).alias("_e")).select(*keys, "_e.*"), "stack")
    found = staged(qt.robust_spread(long, [*keys, "_name"], "_x"), "stack-medians")
    count = at.groupBy(*keys).agg(F.count("*").alias("n"))
    pick = lambda n, c: F.max(F.when(F.col("_name") == n, F.col(c)))
    wide = found.groupBy(*keys).agg(pick("x", "med").alias("x"), *(pick(v, c).alias(f"{v}_{c}") for v in values for c in ("med", "rstd")))
    enough = F.col("n") >= least
    return wide.join(count, keys).select(*keys, "x", "n", *(F.when(enough, F.col(f"{v}_{k}")).alias(f"{v}_{k}") for v in values for k in ("med", "rstd")))


def step_fit(samples: DataFrame, value: str = "par", half: float = 60.0, inner: float = 30.0) -> DataFrame:
    """(profile_id, c0, c1, c2) of value = c0 + c1 x + c2 sign(x) over inner <= |x| <= half: normal equations in one aggregate, by Cramer's rule."""
    s = samples.where(F.abs("xs").between(inner, half) & F.col(value).isNotNull()).withColumn("g", F.signum("xs"))
    x, g, y = F.col("xs"), F.col("g"), F.col(value)
    m = s.groupBy("profile_id").agg(F.count("*").cast("double").alias("n"), F.count_if(x < 0).alias("l"), F.count_if(x > 0).alias("r"), F.sum(x).alias("x"), F.sum(g).alias("g"), F.sum(x * x).alias("xx"), F.sum(x * g).alias("xg"), F.sum(g * g).alias("gg"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(g * y).alias("gy"))
    m = m.where((F.col("n") >= 6) & (F.col("l") >= 2) & (F.col("r") >= 2))
    def det(a: list[str]) -> Column:
        c = [F.col(k) for k in a]
        return c[0] * (c[4] * c[8] - c[5] * c[7]) - c[1] * (c[3] * c[8] - c[5] * c[6]) + c[2] * (c[3] * c[7] - c[4] * c[6])

    d = det(["n", "x", "g", "x", "xx", "xg", "g", "xg", "gg"])
    return m.withColumn("d", d).where("d <> 0").select("profile_id", (det(["y", "x", "g", "xy", "xx", "xg", "gy", "xg", "gg"]) / F.col("d")).alias("c0"), (det(["n", "y", "g", "x", "xy", "xg", "g", "gy", "gg"]) / F.col("d")).alias("c1"), (det(["n", "x", "y", "x", "xx", "xy", "g", "xg", "gy"]) / F.col("d")).alias("c2"))


def step_width(samples: DataFrame, value: str = "par", half: float = 60.0, inner: float = 30.0) -> DataFrame:
    """(profile_id, width, amplitude): 10-90 % width of the step at 0, after the line is removed and the rest made monotonic."""
    fit = step_fit(samples, value, half, inner)
    z = (F.col(value) - F.col("c0") - F.col("c1") * F.col("xs")) / (2 * F.col("c2")) + 0.5
    by = Window.partitionBy("profile_id").orderBy("xs", value)
    at = samples.where((F.abs("xs") <= half) & F.col(value).isNotNull()).join(fit, "profile_id").withColumn("_z", z)
    at = at.withColumn("z", F.max("_z").over(by)).withColumns({"px": F.lag("xs").over(by), "pz": F.lag("z").over(by)})
    def cross(level: float) -> Column:
        here = (F.col("z") >= level) & (F.col("pz").isNull() | (F.col("pz") < level))
        lerp = F.when(F.col("pz").isNull(), F.col("xs")).otherwise(F.col("px") + (F.col("xs") - F.col("px")) * (level - F.col("pz")) / (F.col("z") - F.col("pz")))
        return F.coalesce(F.min(F.when(here, lerp)), F.max("xs"))

    return at.groupBy("profile_id").agg((cross(0.9) - cross(0.1)).alias("width"), (2 * F.first("c2")).alias("amplitude"))


def localised(points: DataFrame, least_share: float, least_quality: float) -> DataFrame:
    """(profile_id, support, quality, localised) of points (profile_id, accepted, quality)."""
    out = points.groupBy("profile_id").agg(F.avg(F.col("accepted").cast("double")).alias("support"), F.percentile("quality", F.lit(0.5)).alias("quality"))
    return out.withColumn("localised", (F.col("support") >= least_share) & (F.col("quality") >= least_quality))


def scale_strikes(points: DataFrame, picks: DataFrame, windows: list[float]) -> DataFrame:
    """(pick_id, window, strike): the strike of each pick (pick_id, strand_id, s) at each length scale, by total least squares through the points
    (strand_id, s, x, y) of its strand within +-window metres of arc length, along the strand. Points and picks meet by pieces of
    the strand as long as the largest window."""
    reach = max(windows)
    piece = F.explode(F.sequence(cell_of(F.col("_s") - reach, reach), cell_of(F.col("_s") + reach, reach)))
    at = picks.select("pick_id", "strand_id", F.col("s").alias("_s")).withColumn("_p", piece).join(points.select("strand_id", "s", "x", "y", cell_of(F.col("s"), reach).alias("_p")), ["strand_id", "_p"])
    at = at.withColumn("window", F.explode(F.array(*(F.lit(float(w)) for w in windows)))).where(F.abs(F.col("s") - F.col("_s")) <= F.col("window"))
    ends = at.groupBy("pick_id", "window").agg((0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("_t"), (F.max_by("x", "s") - F.min_by("x", "s")).alias("_dx"), (F.max_by("y", "s") - F.min_by("y", "s")).alias("_dy"))
    turn = F.when(F.cos("_t") * F.col("_dx") + F.sin("_t") * F.col("_dy") < 0, F.pi()).otherwise(0.0)
    return ends.select("pick_id", "window", ((90 - F.degrees(F.col("_t") + turn) + 720) % 360).alias("strike"))


def circular_median(df: DataFrame, keys: list[str], angle: str, order: str) -> DataFrame:
    """(keys, angle): median of angles in degrees, taken relative to the group's first so that 0 and 360 are neighbours."""
    first = df.groupBy(*keys).agg(F.min_by(angle, order).alias("_first"))
    rel = df.join(first, keys).withColumn("_rel", (F.col(angle) - F.col("_first") + 540) % 360 - 180)
    return rel.groupBy(*keys).agg(((F.first("_first") + F.percentile("_rel", F.lit(0.5)) + 360) % 360).alias(angle))  # one value a length scale


def multi_strike(px: DataFrame, distance: DataFrame, centres: DataFrame, strikes: DataFrame, edges: list[float], half_width: float, half_length: float, spans: DataFrame, least: int) -> DataFrame:
    """(pick_id, bin, x, par_med, par_std, nrm_med, nrm_std, scatter, n): one swathe across the fault for each strike (pick_id, window, strike) of a pick.

    Pixels (row, col, x, y, ew, ns) of each swathe, ``half_width`` along and ``half_length`` across from ``centres(pick_id, x, y)``, are binned by their
    signed ``distance(row, col, d)`` from the fault; a bin's value is the median of at least ``least`` pixels along and to the left of the
    swathe's own strike. Bins that all swathes of the pick fill, whose x lies in ``spans(pick_id, lo, hi)``, are kept; each swathe is moved to
    the pick's mean level over these; then medians and sample spreads over the swathes, and medians of pixel scatter and count."""
    frames = strikes.join(centres.select("pick_id", F.col("x").alias("cx"), F.col("y").alias("cy")), "pick_id").withColumn("profile_id", F.struct("pick_id", "window"))
    hit = frame_pixels(px, frames.select("profile_id", "cx", "cy", "strike"), half_width, half_length).join(distance, ["row", "col"])
    turned = hit.join(small(strikes.select(F.struct("pick_id", "window").alias("profile_id"), "strike")), "profile_id").withColumns({"_a": F.radians("strike")})
    turned = turned.select("profile_id.pick_id", "profile_id.window", "d", (F.col("ew") * F.sin("_a") + F.col("ns") * F.cos("_a")).alias("par"), (-F.col("ew") * F.cos("_a") + F.col("ns") * F.sin("_a")).alias("nrm"))
    stacks = staged(robust_stack(turned.where("par is not null and nrm is not null"), edges, "d", ["par", "nrm"], least, ["pick_id", "window"]), "swathes")
    filled = stacks.where("par_med is not null and nrm_med is not null")
    n = strikes.groupBy("pick_id").agg(F.count("*").alias("_n"))
    common = filled.groupBy("pick_id", "bin").agg(F.count("*").alias("_k"), F.percentile("x", F.lit(0.5)).alias("x")).join(n, "pick_id").where("_k = _n").join(spans, "pick_id").where(F.col("x").between(F.col("lo"), F.col("hi")))
    kept = staged(filled.drop("x").join(common.select("pick_id", "bin", "x"), ["pick_id", "bin"]), "common")
    own = kept.groupBy("pick_id", "window").agg(F.avg("par_med").alias("_p"), F.avg("nrm_med").alias("_q"))
    level = own.groupBy("pick_id").agg(F.avg("_p").alias("_pm"), F.avg("_q").alias("_qm"))
    moved = kept.join(own, ["pick_id", "window"]).join(level, "pick_id").withColumns({"par": F.col("par_med") - F.col("_p") + F.col("_pm"), "nrm": F.col("nrm_med") - F.col("_q") + F.col("_qm")})
    half = F.lit(0.5)
    return moved.groupBy("pick_id", "bin").agg(F.first("x").alias("x"), *(f for c in ("par", "nrm") for f in (F.percentile(c, half).alias(f"{c}_med"), F.stddev_samp(c).alias(f"{c}_std"))), F.percentile("par_rstd", half).alias("scatter"), F.percentile("n", half).alias("n"))


def ensemble(swathes: DataFrame, value: str) -> DataFrame:
    """Means by profile and bin of several swathes (profile_id, swathe, bin, value): each swathe is moved to its profile's mean, then the
    median and sample spread of the bins that all swathes fill."""
    per = swathes.where(F.col(value).isNotNull())
    own = per.groupBy("profile_id", "swathe").agg(F.avg(value).alias("_own"))
    mean = own.groupBy("profile_id").agg(F.avg("_own").alias("_mean"), F.count("*").alias("_n"))
    moved = per.join(own, ["profile_id", "swathe"]).join(mean, "profile_id").withColumn("_v", F.col(value) - F.col("_own") + F.col("_mean"))
    return moved.groupBy("profile_id", "bin").agg(F.percentile("_v", F.lit(0.5)).alias("med"), F.stddev_samp("_v").alias("std"), F.countDistinct("swathe").alias("k"), F.first("_n").alias("_n")).where("k = _n").drop("k", "_n")
