"""Sources and sinks: grids, text formats, assembled systems. Missing values are NULL from here on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place of spark.checkpoint.dir; where that is unset a local one, if Spark runs in this machine alone."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tremor-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of ``scratch`` and read back: it is computed once, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finite(c: Column) -> Column:
    """``c``, with NaN and infinities as NULL."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def read_pixels(ew: DataFrame, ns: DataFrame) -> DataFrame:
    """Two one-component grids (row, col, x, y, v) on one grid."""
    e, n = (df.withColumnsRenamed({"v": c, "x": f"x_{c}", "y": f"y_{c}"}) for df, c in ((ew, "ew"), (ns, "ns")))
    return e.join(n, ["row", "col"], "full").select("row", "col", F.coalesce("x_ew", "x_ns").alias("x"), F.coalesce("y_ew", "y_ns").alias("y"), finite(F.col("ew")).alias("ew"), finite(F.col("ns")).alias("ns"))


def read_los(vel: DataFrame, east: DataFrame | None = None, north: DataFrame | None = None, up: DataFrame | None = None) -> DataFrame:
    """Velocity grid (row, col, v) with line-of-sight grids; without them the look direction is (1, 0, 0). Error is 0."""
    out = vel.select("row", "col", finite(F.col("v")).alias("vel")).where("vel is not null").withColumn("err", F.lit(0.0))
    for name, grid, default in (("los_e", east, 1.0), ("los_n", north, 0.0), ("los_u", up, 0.0)):
        out = out.withColumn(name, F.lit(default)) if grid is None else out.join(grid.select("row", "col", finite(F.col("v")).alias(name)), ["row", "col"], "left")
    return out.dropna()


def grid_axes(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Axis values of (row, col) from a one-row header (x_min, x_max, y_min, y_max, n_col, n_row); y runs from the maximum down."""
    return cells.join(F.broadcast(header)).withColumns({
        "lon": F.col("x_min") + F.col("col") * (F.col("x_max") - F.col("x_min")) / (F.col("n_col") - 1),
        "lat": F.col("y_max") - F.col("row") * (F.col("y_max") - F.col("y_min")) / (F.col("n_row") - 1)}).select(*cells.columns, "lon", "lat")


def parse_gnss(lines: DataFrame) -> DataFrame:
    """Station offsets from text lines (value): station, lon, lat, de, dn, du, sde, sdn, sdu; heads and blank lines are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    num = {"lon": 1, "lat": 2, "de": 3, "dn": 4, "sde": 6, "sdn": 7}
    body = lines.where((F.trim("value") != "") & ~F.col("value").startswith("Sta") & ~F.col("value").startswith("="))
    return body.select(part[0].alias("sta"), *(part[i].cast("double").alias(c) for c, i in num.items()))


def trace_to_wkt(trace: DataFrame) -> DataFrame:
    """One LINESTRING for each strand of (strand_id, seq, x, y)."""
    point = F.format_string("%.3f %.3f", "x", "y")
    points = F.transform(F.sort_array(F.collect_list(F.struct("seq", point.alias("p")))), lambda s: s["p"])
    return trace.groupBy("strand_id").agg(F.concat(F.lit("LINESTRING ("), F.array_join(points, ", "), F.lit(")")).alias("wkt"))


def trace_from_wkt(lines: DataFrame) -> DataFrame:
    """(strand_id, seq, x, y) from (strand_id, wkt); a multi-line gives a strand for each part; strands are renumbered from 0 in
    order of id and part; a third coordinate is dropped; other geometries are left out."""
    parts = (lines.where(F.col("wkt").rlike("^(MULTI)?LINESTRING")).select("strand_id", F.posexplode(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("part", "points")))
    numbered = parts.withColumn("new_id", F.row_number().over(Window.orderBy("strand_id", "part")) - 1)  # one row for each line, few
    pts = numbered.select(F.col("new_id").alias("strand_id"), F.posexplode(F.split("points", r"\s*,\s*")).alias("seq", "p"))
    xy = F.split(F.trim("p"), r"\s+")
    return pts.select("strand_id", "seq", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))


def parse_gocad(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of TSurf lines (value); sparse vertex ids become 0, 1, ... in their order."""
    part = F.split(F.trim("value"), r"\s+")
    v = lines.where(part[0].isin("VRTX", "PVRTX")).select(part[1].cast("long").alias("id"), *(part[i].cast("double").alias(c) for c, i in (("x", 2), ("y", 3), ("z", 4))))
    t = lines.where(part[0] == "TRGL").select(*(part[i].cast("long").alias(c) for c, i in (("a", 1), ("b", 2), ("c", 3))))
    dense = dense_ids(v.select("id"), "id").withColumnRenamed("dense", "vid")
    vertices = v.join(dense, "id").select("vid", "x", "y", "z")
    for c in "abc":
        t = t.join(dense.select(F.col("id").alias(c), F.col("vid").alias(f"v{c}")), c)
    return vertices, t.select(F.col("va").alias("a"), F.col("vb").alias("b"), F.col("vc").alias("c"))


def dense_ids(ids: DataFrame, column: str, step: int = 1 << 20) -> DataFrame:
    """(column, dense): rank of each distinct value from 0. Ranks are local to blocks of values plus the blocks' running counts,
    so no window holds the whole table."""
    base = ids.select(column).distinct().withColumn("_block", F.floor(F.col(column) / step))
    counts = base.groupBy("_block").count().withColumn("_before", F.sum("count").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("_block").orderBy(column)) - 1
    return base.withColumn("_at", local).join(counts, "_block").select(column, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("long").alias("dense"))


def gocad_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Ordered TSurf lines, ids from 1, six decimals."""
    v = vertices.select(F.lit(0).alias("part"), F.col("vid").alias("k"), F.format_string("VRTX %d %.6f %.6f %.6f", F.col("vid") + 1, "x", "y", "z").alias("value"))
    t = triangles.select(F.lit(1).alias("part"), F.col("tid").alias("k"), F.format_string("TRGL %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    return v.unionByName(t).orderBy("part", "k").select("part", "k", "value")


def save_system(path: str, **tables: DataFrame) -> None:
    """Write the tables of an assembled system, partitioned by dataset where they have one."""
    for name, df in tables.items():
        writer = df.write.partitionBy("dataset") if "dataset" in df.columns else df.write
        writer.parquet(f"{path}/{name}")


def load_system(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def least_step(values: DataFrame, c: str) -> DataFrame:
    """One row (c0, c1, dc): least, largest and smallest positive difference of a column's distinct values.

    The smallest difference is at most the mean one, so its two values lie in one cell of that width or in neighbours: values
    are compared within cells, and the largest of a cell with the least of the next. NULL without two values."""
    own = staged(values.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("v")).distinct(), "axis")
    e = own.agg(F.min("v").alias("a"), F.max("v").alias("z"), F.count("*").alias("n")).first()
    spark = values.sparkSession
    if e["n"] < 2:
        return spark.createDataFrame([(e["a"], e["z"], None)], f"{c}0 double, {c}1 double, d{c} double")
    width = (e["z"] - e["a"]) / (e["n"] - 1)
    at = own.withColumn("cell", F.floor((F.col("v") - e["a"]) / width).cast("long"))
    inside = at.withColumn("d", F.col("v") - F.lag("v").over(Window.partitionBy("cell").orderBy("v"))).select("d")
    ends = at.groupBy("cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    across = ends.select((F.col("cell") + 1).alias("cell"), "hi").join(ends.select("cell", "lo"), "cell").select((F.col("lo") - F.col("hi")).alias("d"))
    return inside.union(across).agg(F.lit(e["a"]).alias(f"{c}0"), F.lit(e["z"]).alias(f"{c}1"), F.min("d").alias(f"d{c}"))


def rasterise_grid(px: DataFrame, fields: list[str]) -> DataFrame:
    """Pixels (lon, lat, fields) on a full regular grid: (row, col, fields, off_grid). Spacing is the smallest positive step;
    row 0 has the largest lat; off_grid tells whether any pixel is over a hundredth of a step off. An axis of one value has one
    row or column; without pixels there is no cell."""
    lon, lat = least_step(px, "lon").first(), least_step(px, "lat").first()
    if lon["lon0"] is None or lat["lat0"] is None:
        return px.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), *fields, F.lit(False).alias("off_grid")).where("false")
    dlon, dlat = lon["dlon"] or 1.0, lat["dlat"] or 1.0
    at = px.withColumns({"fc": (F.col("lon") - lon["lon0"]) / dlon, "fr": (lat["lat1"] - F.col("lat")) / dlat})
    at = at.withColumns({"col": F.round("fc").cast("long"), "row": F.round("fr").cast("long"), "off": F.greatest(F.abs(F.col("fc") - F.round("fc")), F.abs(F.col("fr") - F.round("fr"))) > 0.01})
    rows, cols = round((lat["lat1"] - lat["lat0"]) / dlat) + 1, round((lon["lon1"] - lon["lon0"]) / dlon) + 1
    cells = px.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))
    values = at.groupBy("row", "col").agg(*(F.max(f).alias(f) for f in fields), F.max("off").alias("off_grid"))
    return cells.join(values, ["row", "col"], "left")


def rasterise_blocks(blocks: DataFrame, field: str) -> DataFrame:
    """Burn blocks (ord, r0, r1, c0, c1, field), ends exclusive, onto cells; the block of the highest ord wins."""
    cells = blocks.select("ord", field, F.explode(F.expr("sequence(r0, r1 - 1)")).alias("row"), "c0", "c1").select("ord", field, "row", F.explode(F.expr("sequence(c0, c1 - 1)")).alias("col"))
    return cells.groupBy("row", "col").agg(F.max_by(field, "ord").alias(field))


def model_matrix(samples: DataFrame, sets: DataFrame) -> DataFrame:
    """Samples (step, sample_id, pset, idx, v) with the column of the model vector; ``sets``: (pset, ord, width)."""
    offsets = sets.withColumn("first", F.coalesce(F.sum("width").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return samples.join(F.broadcast(offsets.select("pset", "first")), "pset").withColumn("column", (F.col("first") + F.col("idx")).cast("long")).drop("first")


def parse_annealing(lines: DataFrame) -> DataFrame:
    """iteration, beta, accepted, rejected and acceptance rate from the lines of an annealing log; the head line is skipped."""
    num = lambda k: F.regexp_extract("value", r"\((\d+),\s*(\d+),\s*(\d+)\)", k).cast("long")
    part = F.split("value", r"\s*,\s*")
    body = lines.where(F.col("value").rlike(r"^\s*\d+")).select(F.trim(part[0]).cast("int").alias("iteration"), part[1].cast("double").alias("beta"), num(1).alias("accepted"), num(2).alias("invalid"), num(3).alias("rejected"))
    total = F.col("accepted") + F.col("invalid") + F.col("rejected")
    return body.withColumn("acceptance", F.when(total > 0, F.col("accepted") / total))


def area_lines(areas: DataFrame, first: int = 0, last: int | None = None, times: float = 1.0) -> DataFrame:
    """(tid, value): patch areas as text, of the patches from ``first`` to before ``last``."""
    part = areas.where(F.col("tid") >= first) if last is None else areas.where((F.col("tid") >= first) & (F.col("tid") < last))
    return part.select("tid", F.format_string("%.6f", F.col("area") * times).alias("value"))


def to_map(df: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float, col: str = "col", row: str = "row") -> DataFrame:
    """Pixel (col, row) to map coordinates by an affine transform."""
    return df.withColumns({"map_x": a * F.col(col) + b * F.col(row) + c, "map_y": d * F.col(col) + e * F.col(row) + f})


def to_pixel(df: DataFrame, a: float, b: float, c: float, d: float, e: float, f: float, x: str = "x", y: str = "y") -> DataFrame:
    det = a * e - b * d
    return df.withColumns({"pix_col": (e * (F.col(x) - c) - b * (F.col(y) - f)) / det, "pix_row": (a * (F.col(y) - f) - d * (F.col(x) - c)) / det})


def keep_profiles(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """Samples (profile_id, xs, ...) of kept profiles, within [lo, hi] where it is given; decisions: (profile_id, keep, lo, hi)."""
    inside = (F.col("lo").isNull() | (F.col("xs") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("xs") <= F.col("hi")))
    return samples.join(decisions.where("keep"), "profile_id").where(inside).drop("keep", "lo", "hi")
