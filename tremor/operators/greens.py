"""Green's functions as pair tables: observations by sources, one Column expression for each kernel.

A kernel may be registered as a Column builder (``COLUMN_KERNELS``) or as a pandas function (``kernel_pairs``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.mesh import patch_geometry
from tremor.operators.spatialjoin import SMALL, few

EPS = 1e-10
EDGE = 1e-6  # metres: a point this close to a corner at the surface has no finite displacement
RATIO = 0.5  # mu / (lambda + mu) of a Poisson solid


def _corner(xi: np.ndarray, eta: np.ndarray, q: np.ndarray, sd: np.ndarray, cd: np.ndarray) -> list[np.ndarray]:
    """Displacement terms of one corner, strike-slip x, y, z and dip-slip x, y, z, after the published closed form for a finite rectangle; NaN where a
    corner at the surface is too near."""
    flat = np.abs(cd) < EPS
    slope = np.where(flat, 1.0, cd)
    y, d = eta * cd + q * sd, eta * sd - q * cd
    r = np.sqrt(xi * xi + eta * eta + q * q)
    r = np.where(r + d > EDGE, r, np.nan)
    le, ld = np.log(r + eta), r + d
    x = np.sqrt(xi * xi + q * q)
    small = lambda v, w: np.where(np.abs(v) < EPS, 0.0, w)
    safe = lambda v: np.where(np.abs(v) < EPS, 1.0, v)
    turn = np.arctan((eta * (x + q * cd) + x * (r + x) * sd) / np.where(np.abs(xi) < EPS, 1.0, xi * (r + x) * slope))
    i5 = np.where(flat, -RATIO * xi * sd / ld, small(xi, RATIO * 2 / slope * turn))
    i4 = np.where(flat, -RATIO * q / ld, RATIO / slope * (np.log(ld) - sd * le))
    i3 = np.where(flat, RATIO / 2 * (eta / ld + y * q / (ld * ld) - le), RATIO * (y / (slope * ld) - le) + sd / slope * i4)
    i1 = np.where(flat, -RATIO / 2 * xi * q / (ld * ld), -RATIO * xi / (slope * ld) - sd / slope * i5)
    angle = small(q, np.arctan(xi * eta / np.where(np.abs(q) < EPS, 1.0, q * r)))
    re, rx = r * (r + eta), r * (r + xi)
    yx, dx = small(rx, y * q / safe(rx)), small(rx, d * q / safe(rx))
    return [xi * q / re + angle + i1 * sd, y * q / re + q * cd / (r + eta) - (RATIO * le + i3) * sd, d * q / re + q * sd / (r + eta) + i4 * sd,
            q / r - i3 * sd * cd, yx + cd * angle - i1 * sd * cd, dx + sd * angle - i5 * sd * cd]


def _all(c: Column | str) -> Column:
    """Sum, null if any row of the group is."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def rectangle_pairs(obs: DataFrame, patches: DataFrame, rows: int = 2048) -> DataFrame:
    """(obs_id, patch_id, cell_id, slip_comp, e, n, u): surface displacement of unit strike-slip and dip-slip on rectangles at points
    (obs_id, x, y). At a corner that reaches the surface the closed form is singular: e, n and u are null there, as for null coordinates.

    Each task holds the patches, at most SMALL of them (more are refused), and evaluates blocks of points against them in numpy:
    pairs are neither joined nor shuffled. As columns the form of four corners makes a method too long for the JVM to compile (over
    8,000 bytes), and corners as rows have to be shuffled to be summed."""
    p = patch_geometry(patches).select("patch_id", "cell_id", "x0", "y0", "x1", "y1", "z0", "dip", "length", "width").limit(SMALL + 1).toPandas()
    if len(p) > SMALL:
        raise ValueError(f"over {SMALL} patches would meet every point; give them in parts")
    types = dict(obs.dtypes) | dict(patches.dtypes)
    schema = f"obs_id {types['obs_id']}, patch_id {types['patch_id']}, cell_id {types['cell_id']}, slip_comp string, e double, n double, u double"
    ids = [pa.Array.from_pandas(p[c]) for c in ("patch_id", "cell_id")]
    x0, y0, z0, length, width, dip = (p[c].to_numpy(float)[None] for c in ("x0", "y0", "z0", "length", "width", "dip"))
    sx, sy = (p["x1"].to_numpy(float)[None] - x0) / length, (p["y1"].to_numpy(float)[None] - y0) / length
    sd, cd = np.sin(dip), np.cos(dip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, rows * 32 // max(1, len(p)))
        for whole in batches:
            for a in range(0, len(whole) if len(p) else 0, step):
                batch = whole.slice(a, step)
                m, k = len(batch), len(p)
                px, py = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in "xy")
                with np.errstate(all="ignore"):
                    xs, yo = (px - x0) * sx + (py - y0) * sy, width * cd - ((py - y0) * sx - (px - x0) * sy)
                    ps, q = yo * cd + z0 * sd, yo * sd - z0 * cd
                    total = [0.0] * 6
                    for i in (0, 1):
                        for j in (0, 1):
                            total = [t + (1 - 2 * ((i + j) % 2)) * c for t, c in zip(total, _corner(xs - i * length, ps - j * width, q, sd, cd))]
                    s1, s2, s3, d1, d2, d3 = (t / (-2 * math.pi) for t in total)
                flat = [np.stack(two, 2).ravel() for two in ((s1 * sx + s2 * sy, d1 * sx + d2 * sy), (s1 * sy - s2 * sx, d1 * sy - d2 * sx), (s3, d3))]
                null = ~np.isfinite(flat).all(0)
                at = pa.array(np.tile(np.repeat(np.arange(k), 2), m))
                names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.array([0, 1], np.int8), m * k)), pa.array(["strike", "dip"])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("obs_id").take(pa.array(np.repeat(np.arange(m), 2 * k))), *(c.take(at) for c in ids), names, *(pa.array(v, mask=null) for v in flat)],
                                                 ["obs_id", "patch_id", "cell_id", "slip_comp", "e", "n", "u"])

    # a point makes many rows: points are dealt out first, as a small file of them would be one task
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return obs.select("obs_id", "x", "y").repartition(parts).mapInArrow(run, schema)


def sum_cells(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("obs_id", "cell_id", "slip_comp").agg(*(_all(c).alias(c) for c in "enu"))


def kernel_pairs(obs: DataFrame, sources: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Pair table by a pandas kernel: it gets a batch of pairs (all columns of both sides) and returns rows of ``schema``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield kernel(p)

    return obs.join(few(sources)).mapInPandas(run, schema)


def interleave(pairs: DataFrame) -> DataFrame:
    """East and north of each station as components 0 and 1."""
    return pairs.select("obs_id", "patch_id", "slip_comp", F.posexplode(F.array("e", "n")).alias("component", "g"))


def screw_2d(x: DataFrame, patches: DataFrame) -> DataFrame:
    """(x, v): displacement at the surface of slipping patches (top, bottom, slip) under x = 0 in a uniform half-space."""
    v = F.col("slip") / math.pi * (F.atan(F.col("bottom") / F.col("x")) - F.atan(F.col("top") / F.col("x")))
    return x.join(few(patches)).groupBy("x").agg(F.sum(v).alias("v"))


def _arc(depth: Column, dx: Column) -> Column:
    return F.when((dx == 0) | (depth == 0), 0.0).otherwise(F.atan(depth / dx))


def terms_needed(k: float, tol: float = 1e-6) -> int:
    return 0 if abs(k) < 1e-12 else math.ceil(math.log(tol) / math.log(abs(k)))


def line_in_zone(x: Column, x0: Column, depth: Column, half: float, ratio: float) -> Column:
    """Surface displacement of a unit screw dislocation line at (x0, depth) with a vertical compliant zone |x| < half of modulus
    ``ratio`` times the outside's: images mirrored at the walls, as many as the tolerance needs."""
    k = (1 - ratio) / (1 + ratio)
    m = 0 if half < 1e-3 else terms_needed(k)
    cut = F.when(x > x0, -0.5).when(x < x0, 0.5).otherwise(0.0)
    if m == 0:
        return _arc(depth, x - x0) / math.pi + cut

    def series(first: int, last: int, weight: Callable[[Column], Column], place: Callable[[Column], Column], at: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), F.lit(0.0), lambda s, i: s + weight(i) * _arc(depth, at - place(i)))

    alt = lambda i: F.when(i % 2 == 0, x0).otherwise(-x0)
    power = lambda i: F.pow(F.lit(k), i)
    side = F.when(x > 0, 1.0).otherwise(-1.0)
    inside = F.when(F.abs(x) <= half, _arc(depth, x - x0) + series(1, m, power, lambda i: 2.0 * i * half + alt(i), x) + series(1, m, power, lambda i: -2.0 * i * half + alt(i), x)).otherwise(
        (1 - k) * series(0, m, power, lambda i: -side * 2.0 * i * half + alt(i), x))
    s = F.when(x0 > 0, 1.0).otherwise(-1.0)
    a, b = s * x, s * x0
    mirror = lambda i: F.when(i % 2 == 0, 2.0 * i * half + b).otherwise(-(2.0 * i * half + b))
    outside = F.when(a > half, _arc(depth, a - b) - k * _arc(depth, a - (2 * half - b)) + (1 - k * k) * series(1, m // 2 + 1, lambda j: F.pow(F.lit(k), 2 * j - 1), lambda j: -((4.0 * j - 2) * half + b), a)).when(
        a >= -half, (1 + k) * series(0, m, power, mirror, a)).otherwise((1 - k * k) * series(0, m // 2 + 1, lambda j: F.pow(F.lit(k), 2 * j), lambda j: b + 4.0 * j * half, a))
    return F.when(F.abs(x0) <= half, inside).otherwise(s * outside) / math.pi + cut


def damage_zone_2d(x: DataFrame, patches: DataFrame, half: float, ratio: float) -> DataFrame:
    """(x, v) of patches (x_top, top, x_bot, bottom, slip): the line at the bottom less the line at the top."""
    v = F.col("slip") * (line_in_zone(F.col("x"), F.col("x_bot"), F.col("bottom"), half, ratio) - line_in_zone(F.col("x"), F.col("x_top"), F.col("top"), half, ratio))
    return x.join(few(patches)).groupBy("x").agg(F.sum(v).alias("v"))


COLUMN_KERNELS: dict[str, Callable[..., Column]] = {"line_in_zone": line_in_zone}
