"""Triangular meshes (vertices: vid, x, y, z with z up; triangles: tid, a, b, c, layer, fault_id) and rectangular patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.spatialjoin import cell_of, small


def attach(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with xa, ya, za, ..., zc."""
    out = triangles
    for c in "abc":
        out = out.join(vertices.select(F.col("vid").alias(c), *(F.col(k).alias(f"{k}{c}") for k in "xyz")), c)
    return out


def geometry(t: DataFrame) -> DataFrame:
    """Adds centroid (cx, cy, cz), depth, area_km2 and the unit normal (nx, ny, nz) that points up."""
    ux, uy, uz = (F.col(f"{k}b") - F.col(f"{k}a") for k in "xyz")
    vx, vy, vz = (F.col(f"{k}c") - F.col(f"{k}a") for k in "xyz")
    t = t.withColumns({"_x": uy * vz - uz * vy, "_y": uz * vx - ux * vz, "_z": ux * vy - uy * vx})
    t = t.withColumn("_r", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2))
    sign = F.when(F.col("_z") < 0, -1.0).otherwise(1.0)
    mean = lambda k: (F.col(f"{k}a") + F.col(f"{k}b") + F.col(f"{k}c")) / 3
    return t.withColumns({"cx": mean("x"), "cy": mean("y"), "cz": mean("z"), "depth": -mean("z"), "area_km2": F.col("_r") / 2e6, "nx": sign * F.col("_x") / F.col("_r"), "ny": sign * F.col("_y") / F.col("_r"), "nz": sign * F.col("_z") / F.col("_r")}).drop("_x", "_y", "_z", "_r")


def merge(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several (vertices, triangles) as one; ids are moved behind those of the parts before. One aggregate for each part."""
    v_all = t_all = None
    dv = dt = df = 0
    for v, t in parts:
        vs = v.withColumn("vid", F.col("vid") + dv)
        ts = t.withColumns({"tid": F.col("tid") + dt, **{c: F.col(c) + dv for c in "abc"}, "fault_id": F.col("fault_id") + df})
        v_all, t_all = (vs, ts) if v_all is None else (v_all.unionByName(vs), t_all.unionByName(ts))
        top, last = v.agg(F.max("vid").alias("v")).first(), t.agg(F.max("tid").alias("t"), F.max("fault_id").alias("f")).first()
        dv, dt, df = dv + (top.v or 0) + 1, dt + (last.t or 0) + 1, df + (last.f or 0) + 1
    return v_all, t_all


def dip_reference(t: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Adds dip_sign and ill (|cos| < 0.17): each patch's normal against its strand's mean normal, or against ``given`` (fault_id, rx, ry, rz)."""
    ref = t.groupBy("fault_id").agg(*(F.avg(f"n{k}").alias(f"r{k}") for k in "xyz")) if given is None else given
    j = t.join(small(ref), "fault_id")
    dot = (F.col("nx") * F.col("rx") + F.col("ny") * F.col("ry") + F.col("nz") * F.col("rz")) / F.sqrt(F.col("rx") ** 2 + F.col("ry") ** 2 + F.col("rz") ** 2)
    return j.withColumns({"dip_sign": F.signum(dot).cast("int"), "ill": F.abs(dot) < 0.17}).drop("rx", "ry", "rz")


def edges(t: DataFrame) -> DataFrame:
    """Three rows for each triangle: (x0, y0, z0) to (x1, y1, z1) with both vertex ids."""
    one = lambda p, q: F.struct(F.col(p).alias("i"), F.col(q).alias("j"), *(F.col(f"{k}{p}").alias(f"{k}0") for k in "xyz"), *(F.col(f"{k}{q}").alias(f"{k}1") for k in "xyz"))
    return t.select("tid", "layer", "fault_id", F.explode(F.array(one("a", "b"), one("b", "c"), one("c", "a"))).alias("e")).select("tid", "layer", "fault_id", "e.*")


def plane_cut(t: DataFrame, planes: DataFrame) -> DataFrame:
    """(plane_id, tid, a_top, depth_top, a_bottom, depth_bottom) of triangles that vertical planes (plane_id, ox, oy, dx, dy) cut; a is the position along the plane.

    Seen from above a plane is a line. Both are dealt to square cells of about a triangle's size, a line to those that it passes
    within the mesh, and meet by cell."""
    r = F.hypot("dx", "dy")
    box = lambda f, k: f(*(f"{k}{c}" for c in "abc"))
    low, high = F.least, F.greatest
    size = F.greatest(box(high, "x") - box(low, "x"), box(high, "y") - box(low, "y"))
    m = t.agg(F.min(box(low, "x")).alias("x0"), F.max(box(high, "x")).alias("x1"), F.min(box(low, "y")).alias("y0"), F.max(box(high, "y")).alias("y1"), F.avg(size).alias("w")).first()
    w = max(m["w"] or 1.0, max((m["x1"] or 0) - (m["x0"] or 0), (m["y1"] or 0) - (m["y0"] or 0), 1e-9) / 100_000)  # a line passes 200,000 cells at most
    p = planes.select("plane_id", "ox", "oy", (F.col("dx") / r).alias("ux"), (F.col("dy") / r).alias("uy"))
    side = lambda k: (F.col(f"x{k}") - F.col("ox")) * -F.col("uy") + (F.col(f"y{k}") - F.col("oy")) * F.col("ux")
    if m["w"] is None:
        lines = p.withColumns({"_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    else:
        # step along the axis that the line follows more; across it a step covers at most one cell's width, and one to be safe
        flat = F.abs("ux") >= F.abs("uy")
        a0, a1 = F.when(flat, m["x0"]).otherwise(m["y0"]), F.when(flat, m["x1"]).otherwise(m["y1"])
        walk = p.withColumn("_flat", flat).withColumn("_i", F.explode(F.sequence(cell_of(a0, w), cell_of(a1, w))))
        across = lambda at: F.when(F.col("_flat"), F.col("oy") + (at - F.col("ox")) * F.col("uy") / F.col("ux")).otherwise(F.col("ox") + (at - F.col("oy")) * F.col("ux") / F.col("uy"))
        one, two = across(F.col("_i") * w), across((F.col("_i") + 1) * w)
        walk = walk.withColumn("_j", F.explode(F.sequence(cell_of(F.least(one, two) - 1e-6 * w, w), cell_of(F.greatest(one, two) + 1e-6 * w, w))))
        lines = walk.select(*p.columns, F.when(F.col("_flat"), F.col("_i")).otherwise(F.col("_j")).alias("_cx"), F.when(F.col("_flat"), F.col("_j")).otherwise(F.col("_i")).alias("_cy"))
    cells = t.withColumn("_cx", F.explode(F.sequence(cell_of(box(low, "x"), w), cell_of(box(high, "x"), w)))).withColumn("_cy", F.explode(F.sequence(cell_of(box(low, "y"), w), cell_of(box(high, "y"), w))))
    hit = cells.join(lines, ["_cx", "_cy"]).where((F.least(side("a"), side("b"), side("c")) <= 0) & (F.greatest(side("a"), side("b"), side("c")) >= 0)).dropDuplicates(["plane_id", "tid"])
    e = hit.select("plane_id", "ox", "oy", "ux", "uy", "tid", F.explode(F.array(*(F.struct(side(a).alias("f0"), side(b).alias("f1"), *(F.col(f"{k}{a}").alias(f"{k}0") for k in "xyz"), *(F.col(f"{k}{b}").alias(f"{k}1") for k in "xyz")) for a, b in ("ab", "bc", "ca")))).alias("e"))
    e = e.select("plane_id", "ox", "oy", "ux", "uy", "tid", "e.*").where("f0 <> f1").withColumn("s", F.col("f0") / (F.col("f0") - F.col("f1"))).where("s between -1e-12 and 1 + 1e-12")
    at = lambda k: F.col(f"{k}0") + F.col("s") * (F.col(f"{k}1") - F.col(f"{k}0"))
    e = e.withColumns({"pos": (at("x") - F.col("ox")) * F.col("ux") + (at("y") - F.col("oy")) * F.col("uy"), "depth": -at("z")})
    out = e.groupBy("plane_id", "tid").agg(F.count("*").alias("n"), F.min_by("pos", F.struct("depth", "pos")).alias("a_top"), F.min("depth").alias("depth_top"), F.max_by("pos", F.struct("depth", "pos")).alias("a_bottom"), F.max("depth").alias("depth_bottom"))
    return out.where((F.col("n") >= 2) & ((F.col("depth_bottom") > F.col("depth_top")) | (F.col("a_bottom") != F.col("a_top")))).drop("n")


def band_weights(cuts: DataFrame, bands: DataFrame) -> DataFrame:
    """(plane_id, tid, band, length): length of each crossing inside depth bands (band, top, bot); a level one belongs to the band that holds its depth."""
    full = F.hypot(F.col("a_bottom") - F.col("a_top"), F.col("depth_bottom") - F.col("depth_top"))
    tall = F.col("depth_bottom") - F.col("depth_top")
    part = F.greatest(F.least("depth_bottom", "bot") - F.greatest("depth_top", "top"), F.lit(0.0))
    w = F.when(tall > 0, full * part / tall).otherwise(F.when((F.col("depth_top") >= F.col("top")) & (F.col("depth_top") < F.col("bot")), full).otherwise(0.0))
    return cuts.join(small(bands), (F.col("depth_bottom") >= F.col("top")) & (F.col("depth_top") <= F.col("bot"))).select("plane_id", "tid", "band", w.alias("length")).where("length > 0")


def slice_levels(t: DataFrame, levels: DataFrame, tol: float) -> DataFrame:
    """(level, tid, x0, y0, x1, y1, key0, key1, length): contour segments of the mesh at z = -level, with snapped end keys. Triangles and levels meet by
    depth interval: intervals are as high as a triangle is in the mean, and a level is in one."""
    z = -F.col("level")
    bottom, top = F.least("za", "zb", "zc"), F.greatest("za", "zb", "zc")
    m = t.agg(F.avg(top - bottom).alias("w"), (F.max(top) - F.min(bottom)).alias("h")).first()
    w = max(m["w"] or 1.0, (m["h"] or 0.0) / 100_000, 1e-9)
    banded = t.withColumn("_b", F.explode(F.sequence(cell_of(bottom, w), cell_of(top, w))))
    hit = banded.join(levels.withColumn("_b", cell_of(z, w)), "_b").where((bottom < z) & (top >= z)).drop("_b")
    e = hit.select("level", "tid", F.posexplode(F.array(*(F.struct(*(F.col(f"{k}{a}").alias(f"{k}0") for k in "xyz"), *(F.col(f"{k}{b}").alias(f"{k}1") for k in "xyz")) for a, b in ("ab", "bc", "ca")))).alias("n", "e")).select("level", "tid", "n", "e.*")
    e = e.where((F.col("z0") < z) != (F.col("z1") < z)).withColumn("s", (z - F.col("z0")) / (F.col("z1") - F.col("z0")))
    e = e.withColumns({"x": F.col("x0") + F.col("s") * (F.col("x1") - F.col("x0")), "y": F.col("y0") + F.col("s") * (F.col("y1") - F.col("y0"))})
    ends = e.groupBy("level", "tid").agg(F.count("*").alias("k"), *(f(c, "n").alias(f"{c}{i}") for i, f in ((0, F.min_by), (1, F.max_by)) for c in "xy")).where("k = 2")
    key = lambda i: F.concat_ws(",", F.round(F.col(f"x{i}") / tol).cast("long"), F.round(F.col(f"y{i}") / tol).cast("long"))
    return ends.withColumns({"key0": key(0), "key1": key(1), "length": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))}).drop("k")


def datum(t: DataFrame) -> DataFrame:
    """(fault_id, datum): lowest end of the top boundary: edges of one triangle, in the upper half, rising by 45 degrees at most."""
    e = edges(t)
    single = e.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).groupBy("fault_id", "lo", "hi").agg(F.count("*").alias("n"), *(F.first(f"{k}{i}").alias(f"{k}{i}") for k in "xyz" for i in (0, 1))).where("n = 1")
    span = e.groupBy("fault_id").agg(((F.min("z0") + F.max("z0")) / 2).alias("mid"))
    top = single.join(span, "fault_id").where((F.col("z0") >= F.col("mid")) & (F.col("z1") >= F.col("mid")) & (F.abs(F.col("z1") - F.col("z0")) <= F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))))
    return top.groupBy("fault_id").agg(F.min(F.least("z0", "z1")).alias("datum"))


def section(t: DataFrame, trace: DataFrame) -> DataFrame:
    """Adds along_km and depth_km: centroids on the line from the first to the last trace point (fault_id, seq, x, y) of their strand."""
    ends = trace.groupBy("fault_id").agg(*(f(c, "seq").alias(f"{c}{n}") for n, f in (("0", F.min_by), ("1", F.max_by)) for c in "xy"))
    r = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    along = ((F.col("cx") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("cy") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / r / 1000
    return t.join(small(ends), "fault_id").withColumns({"along_km": along, "depth_km": F.col("depth") / 1000}).drop("x0", "x1", "y0", "y1")


def patch_geometry(p: DataFrame) -> DataFrame:
    """Adds dip (radians), width, length, area and the lower corners of patches (x0, y0, z0 lower depth, x1, y1, z1 upper depth, dip_deg)."""
    p = p.withColumns({"dip": F.radians("dip_deg"), "length": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))})
    p = p.withColumns({"width": (F.col("z0") - F.col("z1")) / F.sin("dip"), "run": (F.col("z0") - F.col("z1")) / F.tan("dip")})
    nx, ny = -(F.col("y1") - F.col("y0")) / F.col("length"), (F.col("x1") - F.col("x0")) / F.col("length")
    return p.withColumns({"area": F.col("width") * F.col("length"), "low_x0": F.col("x0") + nx * F.col("run"), "low_y0": F.col("y0") + ny * F.col("run"), "low_x1": F.col("x1") + nx * F.col("run"), "low_y1": F.col("y1") + ny * F.col("run")})


def rect_patches(trace: DataFrame, rows: DataFrame, kink: float, dip_shallow: float, dip_deep: float, dip_az: float) -> DataFrame:
    """Dipping patches under each trace segment (strand_id, seq, x, y) for depth rows (row, top, bot): a row across the kink is split; each
    lower part starts where the one above ends. Strands run so that the down-dip side, to their left, faces ``dip_az``."""
    ends = trace.groupBy("strand_id").agg(*(f(c, "seq").alias(f"{c}{n}") for n, f in (("0", F.min_by), ("1", F.max_by)) for c in "xy"), F.max("seq").alias("last"))
    turn = -(F.col("y1") - F.col("y0")) * F.sin(F.radians(F.lit(dip_az))) + (F.col("x1") - F.col("x0")) * F.cos(F.radians(F.lit(dip_az))) < 0
    way = trace.join(small(ends.select("strand_id", "last", turn.alias("turned"))), "strand_id").withColumn("seq", F.when(F.col("turned"), F.col("last") - F.col("seq")).otherwise(F.col("seq")))
    by = Window.partitionBy("strand_id").orderBy("seq")
    seg = way.select("strand_id", "seq", "turned", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(by).alias("bx"), F.lead("y").over(by).alias("by_")).where("bx is not null")
    parts = F.when((F.col("top") < kink) & (F.col("bot") > kink), F.array(F.struct(F.col("top").alias("zt"), F.lit(kink).alias("zb")), F.struct(F.lit(kink).alias("zt"), F.col("bot").alias("zb")))).otherwise(F.array(F.struct(F.col("top").alias("zt"), F.col("bot").alias("zb"))))
    sub = rows.select("row", F.explode(parts).alias("p")).select("row", "p.*").withColumn("dip_deg", F.when(F.col("zb") <= kink, dip_shallow).otherwise(dip_deep))
    sub = sub.withColumn("step", (F.col("zb") - F.col("zt")) / F.tan(F.radians("dip_deg")))
    sub = sub.withColumn("run", F.coalesce(F.sum("step").over(Window.partitionBy(F.lit(0)).orderBy("zt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))  # depth rows, few
    r = F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    nx, ny = -(F.col("by_") - F.col("ay")) / r, (F.col("bx") - F.col("ax")) / r
    j = seg.join(small(sub))
    return j.select("strand_id", "seq", "row", F.when(F.col("turned"), -1).otherwise(1).alias("slip_sign"), "dip_deg", (F.col("ax") + nx * F.col("run")).alias("x0"), (F.col("ay") + ny * F.col("run")).alias("y0"), F.col("zb").alias("z0"), (F.col("bx") + nx * F.col("run")).alias("x1"), (F.col("by_") + ny * F.col("run")).alias("y1"), F.col("zt").alias("z1"))


def patches_2d(interfaces: DataFrame) -> DataFrame:
    """(model_id, patch_id, x_top, top, x_bot, bottom) between successive interfaces (model_id, k, depth, x)."""
    by = Window.partitionBy("model_id").orderBy("k")
    return interfaces.select("model_id", F.col("k").alias("patch_id"), F.col("x").alias("x_top"), F.col("depth").alias("top"), F.lead("x").over(by).alias("x_bot"), F.lead("depth").over(by).alias("bottom")).where("bottom is not null")


def triangular_slip(depth: Column, peak: float, peak_depth: float, bottom: float) -> Column:
    """Slip that rises to ``peak`` at ``peak_depth`` and falls to 0 at ``bottom``."""
    return F.when(depth < peak_depth, peak * depth / peak_depth).when(depth <= bottom, peak * (bottom - depth) / (bottom - peak_depth)).otherwise(0.0)


def dip_sense(up: DataFrame) -> DataFrame:
    """(strand_id, n_up, n_down) of vertical motion (strand_id, u)."""
    return up.groupBy("strand_id").agg(F.count_if(F.col("u") > 0).alias("n_up"), F.count_if(F.col("u") < 0).alias("n_down"))
