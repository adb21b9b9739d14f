"""Distance quadtree and block means."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators.spatialjoin import segments, small


def start_blocks(extent: DataFrame, size: float) -> DataFrame:
    """Grid of blocks (level, kx, ky, left, bottom, size) that covers the extent (x_min, x_max, y_min, y_max)."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("long"), F.floor(F.col(hi) / size).cast("long"))
    cells = extent.select(F.explode(span("x_min", "x_max")).alias("kx"), "y_min", "y_max").select("kx", F.explode(span("y_min", "y_max")).alias("ky"))
    return cells.select(F.lit(0).alias("level"), "kx", "ky", (F.col("kx") * size).alias("left"), (F.col("ky") * size).alias("bottom"), F.lit(float(size)).alias("size"))


def corner_distance(blocks: DataFrame, trace: DataFrame) -> DataFrame:
    """Adds ``distance``: the smallest distance of a block's corners to the polylines."""
    corners = blocks.select("*", F.explode(F.array(*(F.struct((F.col("left") + i * F.col("size")).alias("x"), (F.col("bottom") + j * F.col("size")).alias("y")) for i in (0, 1) for j in (0, 1)))).alias("c")).select(*blocks.columns, "c.x", "c.y")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / (dx * dx + dy * dy)))
    d = F.hypot(F.col("x") - F.col("x0") - f * dx, F.col("y") - F.col("y0") - f * dy)
    # blocks are as many as the extent needs at the coarsest sizes; a trace has few segments
    return corners.crossJoin(small(segments(trace).where("length > 0").select("x0", "y0", "x1", "y1"))).groupBy(*blocks.columns).agg(F.min(d).alias("distance"))


def quadtree(extent: DataFrame, trace: DataFrame, start: float = 20000, least: float = 2500, char_dist: float = 1500, scaler: float = 1, expo: float = 0.7) -> DataFrame:
    """Leaf blocks. A block is split into four while it is larger than ``least`` and scaler (corner distance - char_dist) < size ** expo.
    Blocks depend on the geometry alone."""
    todo, leaves = start_blocks(extent, start), None
    for _ in range(max(0, math.ceil(math.log2(start / least)))):
        d = corner_distance(todo, trace)
        split = (F.col("size") > least) & (scaler * (F.col("distance") - char_dist) < F.pow("size", F.lit(expo)))
        done = d.where(~split).drop("distance")
        leaves = done if leaves is None else leaves.unionByName(done)
        half = F.col("size") / 2
        todo = d.where(split).select(F.col("level") + 1, F.explode(F.array(*(F.struct((2 * F.col("kx") + i).alias("kx"), (2 * F.col("ky") + j).alias("ky"), (F.col("left") + i * half).alias("left"), (F.col("bottom") + j * half).alias("bottom")) for i in (0, 1) for j in (0, 1)))).alias("b"), half.alias("size"))
        todo = todo.select(F.col("(level + 1)").alias("level"), "b.*", "size")
    return todo if leaves is None else leaves.unionByName(todo)


def assign(px: DataFrame, blocks: DataFrame, start: float, levels: int) -> DataFrame:
    """Pixels with their leaf block, half-open: an equi-join on the block key of each level."""
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / (start / 2**k)).cast("long").alias("kx"), F.floor(F.col("y") / (start / 2**k)).cast("long").alias("ky")) for k in range(levels + 1))))
    return px.withColumn("_k", keys).select("*", "_k.*").drop("_k").join(small(blocks), ["level", "kx", "ky"])


def block_means(assigned: DataFrame, columns: list[str]) -> DataFrame:
    return assigned.groupBy("level", "kx", "ky", "size").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def block_los(assigned: DataFrame) -> DataFrame:
    """Means with the error of the mean (spread of vel where no error is given) and the mean look direction at unit length."""
    err = F.when(F.max(F.abs("err")) > 0, F.sqrt(F.sum(F.col("err") ** 2)) / F.count("*")).otherwise(F.stddev_pop("vel"))
    out = assigned.groupBy("level", "kx", "ky", "size").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("vel").alias("vel"), err.alias("err"), *(F.avg(c).alias(c) for c in ("los_e", "los_n", "los_u")))
    r = F.sqrt(F.col("los_e") ** 2 + F.col("los_n") ** 2 + F.col("los_u") ** 2)
    return out.withColumns({c: F.col(c) / r for c in ("los_e", "los_n", "los_u")})


def covered(means: DataFrame, pixel_area: float, tolerance: float) -> DataFrame:
    """Blocks whose pixels cover at least ``tolerance`` of their area."""
    return means.where(F.col("n") * pixel_area / (F.col("size") ** 2) >= tolerance)
