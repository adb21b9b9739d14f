"""Polylines as vertex tables (strand_id, seq, x, y): arc length, resampling, strikes, distances, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.spatialjoin import point_segment_join, segments, small

def _strand():
    return Window.partitionBy("strand_id")


def arclength(trace: DataFrame) -> DataFrame:
    """Adds s (from the strand's start) and total."""
    w = _strand().orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    out = trace.withColumn("_d", step).withColumn("s", F.coalesce(F.sum("_d").over(w), F.lit(0.0))).drop("_d")
    return out.withColumn("total", F.max("s").over(_strand()))


def legs(trace: DataFrame) -> DataFrame:
    """Segments with s0, s1, total."""
    s = segments(trace).where("length > 0").withColumn("s1", F.col("s0") + F.col("length"))
    return s.withColumn("total", F.max("s1").over(_strand()))


def interpolate(targets: DataFrame, trace: DataFrame, s: str = "s") -> DataFrame:
    """Adds x, y of the point at arc position ``s`` of its strand; positions beyond the ends are moved to them."""
    at = F.least(F.greatest(F.col(s), F.lit(0.0)), F.col("total"))
    leg = small(legs(trace))
    found = targets.join(leg, "strand_id").where((at >= F.col("s0")) & ((at < F.col("s1")) | ((F.col("s1") == F.col("total")) & (at >= F.col("s1")))))
    f = (at - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return found.select(*targets.columns, (F.col("x0") + (F.col("x1") - F.col("x0")) * f).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * f).alias("y"))


def totals(trace: DataFrame) -> DataFrame:
    return arclength(trace).groupBy("strand_id").agg(F.max("s").alias("total"))


def resample(trace: DataFrame, spacing: float) -> DataFrame:
    """(strand_id, k, s, x, y) at every multiple of ``spacing`` from the start."""
    k = F.explode(F.expr(f"sequence(0L, cast(floor(total / {spacing}) as long))"))
    return interpolate(totals(trace).select("strand_id", k.alias("k")).withColumn("s", F.col("k") * spacing), trace)


def smooth(pts: DataFrame, half: int) -> DataFrame:
    """Moving mean over 2 half + 1 samples; samples without a full window are dropped."""
    w = _strand().orderBy("k").rowsBetween(-half, half)
    return pts.select("strand_id", "k", F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"), F.count("*").over(w).alias("n")).where(F.col("n") == 2 * half + 1)


def _bearing(dx: Column, dy: Column) -> Column:
    return (F.degrees(F.atan2(dx, dy)) + 360) % 360


def adjacent_strike(pts: DataFrame) -> DataFrame:
    """Bearing from the sample before; a strand's first sample is dropped."""
    w = _strand().orderBy("k")
    return pts.withColumn("strike", _bearing(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).where("strike is not null").select("strand_id", "k", "x", "y", "strike")


def chord_strike(trace: DataFrame, centres: DataFrame, span: float, clamp: bool = False) -> DataFrame:
    """Bearing of the chord span / 2 before to span / 2 after each centre (strand_id, s). Without ``clamp``, centres whose chord
    leaves the strand are dropped."""
    if not clamp:
        centres = centres.join(totals(trace), "strand_id").where((F.col("s") >= span / 2) & (F.col("s") + span / 2 <= F.col("total"))).select(*centres.columns)
    ends = [interpolate(centres.withColumn("_t", F.col("s") + d), trace, "_t").drop("_t").withColumnsRenamed({"x": f"_x{n}", "y": f"_y{n}"}) for n, d in ((0, -span / 2), (1, span / 2))]
    both = ends[0].join(ends[1], centres.columns)
    return both.withColumn("strike", _bearing(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))).select(*centres.columns, "strike")


def tangents(pts: DataFrame, h: int) -> DataFrame:
    """Unit tangents by differences over +-h samples, clamped at the ends, and left normals."""
    w, full = _strand().orderBy("k"), _strand().orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = lambda c: F.coalesce(F.lead(c, h).over(w), F.last(c).over(full)) - F.coalesce(F.lag(c, h).over(w), F.first(c).over(full))
    out = pts.withColumns({"_dx": d("x"), "_dy": d("y")}).withColumn("_r", F.hypot("_dx", "_dy"))
    return out.withColumns({"tx": F.col("_dx") / F.col("_r"), "ty": F.col("_dy") / F.col("_r"), "nx": -F.col("_dy") / F.col("_r"), "ny": F.col("_dx") / F.col("_r")}).drop("_dx", "_dy", "_r")


def signed_distance(pts: DataFrame, trace: DataFrame, key: list[str], radius: float) -> DataFrame:
    """Points (x, y) within ``radius`` of the polylines with d, positive to the left of their direction, strand_id and s of the
    nearest point. Equal distances (to a micrometre) go to the first segment."""
    near = point_segment_join(pts, trace, radius)
    order = F.struct(F.round("d2", 6), F.col("strand_id"), F.col("seq"))
    facts = F.struct("d2", "cross", "strand_id", (F.col("s0") + F.col("f") * F.col("length")).alias("s"))
    best = near.groupBy(*key).agg(F.min_by(facts, order).alias("b"))
    sign = F.when(F.col("b.cross") >= 0, 1).otherwise(-1)
    return pts.join(best, key).select(*pts.columns, (sign * F.sqrt("b.d2")).alias("d"), F.col("b.strand_id").alias("strand_id"), F.col("b.s").alias("s"))


def fit_strike(pts: DataFrame, half: int) -> DataFrame:
    """Total least squares strike over +-half samples, along the polyline's direction."""
    w = _strand().orderBy("k").rowsBetween(-half, half)
    # y before x: far from the origin the noise of this sum tells a strike due north as 0 or 360, and so it is that of the SQL
    th = 0.5 * F.atan2(2 * F.covar_pop("y", "x").over(w), F.var_pop("x").over(w) - F.var_pop("y").over(w))
    out = pts.withColumns({"_t": th, "_dx": F.last("x").over(w) - F.first("x").over(w), "_dy": F.last("y").over(w) - F.first("y").over(w)})
    turn = F.when(F.cos("_t") * F.col("_dx") + F.sin("_t") * F.col("_dy") < 0, F.pi()).otherwise(0.0)
    return out.withColumn("strike", (90 - F.degrees(F.col("_t") + turn) + 720) % 360).drop("_t", "_dx", "_dy")


def match_strand(picks: DataFrame, trace: DataFrame, radius: float) -> DataFrame:
    """(pick_id, strand_id, reversed, s): nearest strand of picks (pick_id, x, y, strike); reversed if the strand runs against the strike,
    s then counts from its other end."""
    near = point_segment_join(picks, trace, radius)
    order = F.struct(F.round("d2", 6), F.col("strand_id"), F.col("seq"))
    facts = F.struct("strand_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"), (F.col("s0") + F.col("f") * F.col("length")).alias("s"), "strike")
    best = near.groupBy("pick_id").agg(F.min_by(facts, order).alias("b")).select("pick_id", "b.*")
    back = F.sin(F.radians("strike")) * F.col("dx") + F.cos(F.radians("strike")) * F.col("dy") < 0
    return best.join(small(totals(trace)), "strand_id").select("pick_id", "strand_id", back.alias("reversed"), F.when(back, F.col("total") - F.col("s")).otherwise(F.col("s")).alias("s"))


def between(trace: DataFrame, a: float, b: float) -> DataFrame:
    """Vertices of the strands' parts from arc position a to b, with interpolated ends where they lie on the strand."""
    ends = totals(trace).select("strand_id", "total", F.explode(F.array(F.lit(a), F.lit(b))).alias("s")).where("s >= 0 and s < total").drop("total")
    inner = arclength(trace).where((F.col("s") > a) & (F.col("s") < b)).select("strand_id", "s", "x", "y")
    return inner.unionByName(interpolate(ends, trace))


def extend(trace: DataFrame, length: float, n: int) -> DataFrame:
    """A straight vertex before and after each strand, along the mean direction of its first or last ``n`` vertices."""
    up, down = _strand().orderBy("seq"), _strand().orderBy(F.desc("seq"))
    marked = trace.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down), "_n": F.count("*").over(_strand())})
    at = lambda c, k, i: F.max(F.when(F.col(k) == F.least(F.lit(i), F.col("_n")), F.col(c)))
    parts = []
    for k, step, edge in (("_a", -1, F.min("seq")), ("_b", 1, F.max("seq"))):
        e = marked.groupBy("strand_id").agg(at("x", k, 1).alias("x"), at("y", k, 1).alias("y"), at("x", k, n).alias("u"), at("y", k, n).alias("v"), (edge + step).cast("int").alias("seq"))
        r = F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))
        parts.append(e.select("strand_id", "seq", (F.col("x") + length * (F.col("x") - F.col("u")) / r).alias("x"), (F.col("y") + length * (F.col("y") - F.col("v")) / r).alias("y")))
    return trace.select("strand_id", "seq", "x", "y").unionByName(parts[0]).unionByName(parts[1])


def surface_trace(vertices: DataFrame, triangles: DataFrame, tol: float) -> DataFrame:
    """Vertices of each subfault within ``tol`` of its top, in order along their main axis: (fault_id, vid, seq, x, y)."""
    corner = triangles.select("fault_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct().join(vertices, "vid")
    top = corner.groupBy("fault_id").agg(F.max("z").alias("top"))
    near = corner.join(top, "fault_id").where(F.col("z") >= F.col("top") - tol)
    axis = near.groupBy("fault_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))).alias("th"))
    along = F.round(F.cos("th") * (F.col("x") - F.col("mx")) + F.sin("th") * (F.col("y") - F.col("my")), 6)
    w = Window.partitionBy("fault_id").orderBy("_p", "vid")  # the top row of one subfault
    return near.join(axis, "fault_id").withColumn("_p", along).select("fault_id", "vid", (F.row_number().over(w) - 1).cast("int").alias("seq"), "x", "y")


def perpendicular(pts: DataFrame, half: float) -> DataFrame:
    """Ends of the line across ``strike`` through each point, ``half`` to the left and to the right."""
    s, c = F.sin(F.radians("strike")), F.cos(F.radians("strike"))
    return pts.withColumns({"left_x": F.col("x") - half * c, "left_y": F.col("y") + half * s, "right_x": F.col("x") + half * c, "right_y": F.col("y") - half * s})


def profiles_along(trace: DataFrame, n: int, half: float, span: float, margin: float) -> DataFrame:
    """``n`` profiles over all strands, by length and one at least for each, evenly between the end margins, across the local chord strike."""
    share = totals(trace).withColumn("n", F.greatest(F.lit(1), F.round(n * F.col("total") / F.sum("total").over(Window.partitionBy(F.lit(0))))).cast("int"))  # one row a strand
    centres = share.select("strand_id", "total", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn(
        "s", margin + (F.col("total") - 2 * margin) * F.when(F.col("n") == 1, 0.5).otherwise(F.col("i") / (F.col("n") - 1))).select("strand_id", "i", "s")
    return perpendicular(interpolate(centres, trace).join(chord_strike(trace, centres, span, clamp=True), ["strand_id", "i", "s"]), half)


def even_profiles(trace: DataFrame, n: int) -> DataFrame:
    """``n`` profile centres on each strand, ends included, with the strike of their segment."""
    leg = small(legs(trace))
    at = leg.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("s", F.col("total") * F.col("i") / (n - 1))
    at = at.where((F.col("s") >= F.col("s0")) & ((F.col("s") < F.col("s1")) | ((F.col("s1") == F.col("total")) & (F.col("i") == n - 1))))
    f = (F.col("s") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    return at.select("strand_id", "i", "s", (F.col("x0") + (F.col("x1") - F.col("x0")) * f).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * f).alias("y"), _bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("strike"))


def longest_part(trace: DataFrame) -> DataFrame:
    """The longest strand of each trace_id."""
    parts = trace.groupBy("trace_id", "strand_id").agg(F.count("*").alias("n")).join(totals(trace), "strand_id")
    return parts.groupBy("trace_id").agg(F.max_by("strand_id", "total").alias("strand_id"), F.max("total").alias("length"))
