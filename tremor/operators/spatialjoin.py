"""Range joins by spatial cells: points get one cell, shapes the cells that they can reach, then an equi-join and the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SMALL = 5_000  # rows of a side that may be broadcast, counted before


def segments(trace: DataFrame, strand: str = "strand_id") -> DataFrame:
    """(strand, seq, x0, y0, x1, y1, s0, length) of polylines (strand, seq, x, y); s0 is the arc length at the start."""
    w = Window.partitionBy(strand).orderBy("seq")
    s = trace.select(strand, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    s = s.withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return s.withColumn("s0", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most SMALL rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def unspread(df: DataFrame) -> DataFrame:
    """``df`` for a join with a side that an explode has made: Spark takes its size for that before the explode, and would broadcast it whole. Both
    sides are shuffled and sorted, unless one has been counted by ``small``."""
    return df.hint("merge")


def few(df: DataFrame) -> DataFrame:
    """``df`` for a join of every row with every row of another table: broadcast if it has at most SMALL rows, else refused."""
    if df.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"over {SMALL} rows would meet every row of the other table; give them in parts")
    return F.broadcast(df)


def cell_of(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def bucketed_join(points: DataFrame, shapes: DataFrame, size: float, bounds: tuple[Column, Column, Column, Column], condition: Column) -> DataFrame:
    """Points (x, y) with the shapes whose bounding box (x_min, x_max, y_min, y_max as columns of ``shapes``) may hold them and for which
    ``condition`` is true. A point has one cell, so no pair comes twice."""
    x0, x1, y0, y1 = bounds
    s = shapes.withColumn("_cx", F.explode(F.sequence(cell_of(x0, size), cell_of(x1, size)))).withColumn("_cy", F.explode(F.sequence(cell_of(y0, size), cell_of(y1, size))))
    p = points.withColumns({"_cx": cell_of(F.col("x"), size), "_cy": cell_of(F.col("y"), size)})
    return unspread(p).join(s, ["_cx", "_cy"]).where(condition).drop("_cx", "_cy")


def along_segment() -> tuple[Column, Column, Column]:
    """(fraction of the nearest point on the segment, squared distance, cross product) of a point to a segment."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    px, py = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))
    return f, (px - f * dx) ** 2 + (py - f * dy) ** 2, dx * py - dy * px


def point_segment_join(points: DataFrame, trace: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """Points with every segment within ``radius``: adds segment columns, f, d2, cross."""
    segs = segments(trace).where("length > 0")
    f, d2, cross = along_segment()
    bounds = (F.least("x0", "x1") - radius, F.greatest("x0", "x1") + radius, F.least("y0", "y1") - radius, F.greatest("y0", "y1") + radius)
    # cells of about the radius: a few cells for each segment of that length, and few useless candidates
    joined = bucketed_join(points, segs, size or max(2 * radius, 1.0), bounds, F.lit(True))
    return joined.withColumns({"f": f, "d2": d2, "cross": cross}).where(F.col("d2") <= radius**2)


def interval_join(df: DataFrame, edges: list[float], column: str) -> DataFrame:
    """Adds ``bin`` (from 0) of half-open intervals between rising ``edges``; rows outside are dropped."""
    inner = F.array(*(F.lit(float(e)) for e in edges))
    k = F.size(F.filter(inner, lambda e: e <= F.col(column))) - 1
    return df.where((F.col(column) >= edges[0]) & (F.col(column) < edges[-1])).withColumn("bin", k.cast("int"))
