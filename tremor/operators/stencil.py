"""Neighbourhood operators on pixel grids (row, col, x, y, values) and on sampled lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.quantile import with_quantile
from tremor.operators.spatialjoin import unspread


def weights(sigma: float) -> list[float]:
    """Gaussian weights at steps 0, 1, ... up to 4 sigma."""
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(int(4 * sigma + 0.5) + 1)]


def _along(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], sigma: float) -> DataFrame:
    """Weighted sums of columns over steps of ``order`` within ``by``; places that are absent count as nothing."""
    w = Window.partitionBy(*by).orderBy(order)
    out = {}
    for name, c in sums.items():
        total = c * weights(sigma)[0]
        for k, g in enumerate(weights(sigma)[1:], 1):
            for f, sign in ((F.lag, -1), (F.lead, 1)):
                near = f(order, k).over(w) == F.col(order) + sign * k
                total = total + F.when(near, f(c, k).over(w)).otherwise(0.0) * g
        out[name] = total
    return df.withColumns(out)


def nan_gaussian(px: DataFrame, columns: list[str], sigma: float, least: float = 0.0) -> DataFrame:
    """Normalised convolution along columns, then along rows; NULL stays NULL, as do places whose present share of weights is under ``least``."""
    total = (weights(sigma)[0] + 2 * sum(weights(sigma)[1:])) ** 2
    start = {f"_{k}{c}": v for c in columns for k, v in (("n", F.coalesce(F.col(c), F.lit(0.0))), ("w", F.col(c).isNotNull().cast("double")))}
    df = px.withColumns(start)
    for by, order in (("row", "col"), ("col", "row")):
        df = _along(df, [by], order, {n: F.col(n) for n in start}, sigma)
    ok = lambda c: F.col(c).isNotNull() & (F.col(f"_w{c}") >= least * total)
    return df.withColumns({c: F.when(ok(c), F.col(f"_n{c}") / F.col(f"_w{c}")) for c in columns}).drop(*start)


def nan_gaussian_1d(df: DataFrame, by: list[str], order: str, column: str, sigma: float) -> DataFrame:
    df = _along(df.withColumns({"_n": F.coalesce(F.col(column), F.lit(0.0)), "_w": F.col(column).isNotNull().cast("double")}), by, order, {"_n": F.col("_n"), "_w": F.col("_w")}, sigma)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.col("_n") / F.col("_w"))).drop("_n", "_w")


def _gradient(c: str, by: str, order: str, at: str) -> Column:
    w = Window.partitionBy(by).orderBy(order)
    a, b = F.lag(c).over(w), F.lead(c).over(w)
    xa, xb = F.lag(at).over(w), F.lead(at).over(w)
    return F.when(xa.isNull(), (b - F.col(c)) / (xb - F.col(at))).when(xb.isNull(), (F.col(c) - a) / (F.col(at) - xa)).otherwise((b - a) / (xb - xa))


def gradients(px: DataFrame) -> DataFrame:
    """Adds dudx, dudy, dvdx, dvdy of (ew, ns): central differences, one-sided at the ends of a row or column."""
    return px.withColumns({"dudx": _gradient("ew", "row", "col", "x"), "dvdx": _gradient("ns", "row", "col", "x")}).withColumns({"dudy": _gradient("ew", "col", "row", "y"), "dvdy": _gradient("ns", "col", "row", "y")})


def finite_strain(px: DataFrame, strike: float | None = None) -> DataFrame:
    """Green-Lagrange strain from gradients, turned so that the first axis runs along ``strike`` where one is given, and derived values."""
    u1, u2, v1, v2 = (F.col(c) for c in ("dudx", "dudy", "dvdx", "dvdy"))
    e11, e12, e22 = u1 + 0.5 * (u1 * u1 + v1 * v1), 0.5 * (u2 + v1 + u1 * u2 + v1 * v2), v2 + 0.5 * (u2 * u2 + v2 * v2)
    df = px.withColumns({"exx": e11, "exy": e12, "eyy": e22})
    if strike:
        a = math.radians(90 - strike)
        c, s = math.cos(a), math.sin(a)
        df = df.withColumns({"exx": c * c * F.col("exx") - 2 * c * s * F.col("exy") + s * s * F.col("eyy"), "exy": c * s * (F.col("exx") - F.col("eyy")) + (c * c - s * s) * F.col("exy"),
                             "eyy": s * s * F.col("exx") + 2 * c * s * F.col("exy") + c * c * F.col("eyy")})
    return df.withColumns({"vorticity": F.degrees(0.5 * (u2 - v1)), "dilatation": F.col("exx") + F.col("eyy"), "compression": (F.col("exx") + F.col("eyy")) / 2,
                           "max_shear": 0.5 * F.sqrt((F.col("exx") - F.col("eyy")) ** 2 + 4 * F.col("exy") ** 2)})


def strain_maps(px: DataFrame, sigma: float) -> DataFrame:
    """Infinitesimal strain of smoothed components."""
    g = gradients(nan_gaussian(px, ["ew", "ns"], sigma))
    return g.withColumns({"exx": F.col("dudx"), "eyy": F.col("dvdy"), "exy": 0.5 * (F.col("dudy") + F.col("dvdx"))})


def shear_along(strike: Column) -> Column:
    """t . strain . n for the unit vectors along and to the left of ``strike``."""
    tx, ty = F.sin(F.radians(strike)), F.cos(F.radians(strike))
    nx, ny = -ty, tx
    return tx * nx * F.col("exx") + (tx * ny + ty * nx) * F.col("exy") + ty * ny * F.col("eyy")


def bilinear(px: DataFrame, pts: DataFrame, columns: list[str] | dict[str, Column], key: list[str]) -> DataFrame:
    """Values of ``columns`` at points with fractional (fr, fc); NULL unless all four pixels around have a value. Expressions, given by name, are
    taken at each of the four pixels, and may use the key."""
    wanted = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    four = F.array(*(F.struct((F.floor("fr") + i).alias("row"), (F.floor("fc") + j).alias("col"),
                              ((F.col("fr") - F.floor("fr")) if i else (1 - (F.col("fr") - F.floor("fr")))).alias("a"), ((F.col("fc") - F.floor("fc")) if j else (1 - (F.col("fc") - F.floor("fc")))).alias("b")) for i in (0, 1) for j in (0, 1)))
    near = pts.select(*key, F.explode(four).alias("p")).select(*key, F.col("p.row").cast("long").alias("row"), F.col("p.col").cast("long").alias("col"), (F.col("p.a") * F.col("p.b")).alias("w"))
    cells = px if isinstance(columns, dict) else px.select("row", "col", *columns)
    near = near.join(cells.withColumns({c: F.col(c).cast("long") for c in ("row", "col")}), ["row", "col"], "left")
    value = lambda c, v: F.when(F.count(v) == 4, F.sum(F.col("w") * v)).alias(c)
    return near.groupBy(*key).agg(*(value(c, v) for c, v in wanted.items()))


def marginal_outliers(px: DataFrame, column: str, centre: int, buffer: int, q: float) -> DataFrame:
    """NULL where value - spread of its column reaches the q quantile of |value - spread|; the centre band is kept."""
    band = F.col("col").between(centre - buffer, centre + buffer - 1)
    spread = px.groupBy("col").agg(F.stddev_pop(F.when(~band, F.col(column))).alias("_s"))
    df = px.join(spread, "col")
    df = with_quantile(df.withColumn("_d", F.abs(F.col(column) - F.col("_s"))), [], "_d", q, "_q")
    return df.withColumn(column, F.when(band | (F.col(column) - F.col("_s") < F.col("_q")), F.col(column))).drop("_s", "_d", "_q")


def majority_filter(px: DataFrame, column: str, half: int, tolerance: float, flat: bool = False) -> DataFrame:
    """(row, col, column): NULL unless over half of the present neighbours are within ``tolerance`` of the value. With ``flat`` a value also stays where
    the spread of its neighbours is at most ``tolerance``: a spike on a quiet background is signal, one in a noisy region is not."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1) if i or j))
    near = px.where(F.col(column).isNotNull()).select(F.explode(steps).alias("s"), "row", "col", F.col(column).alias("_v")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "_v")
    votes = unspread(px.select("row", "col", column)).join(near, ["row", "col"], "left").groupBy("row", "col", column).agg(F.count("_v").alias("n"), F.count_if(F.abs(F.col("_v") - F.col(column)) <= tolerance).alias("k"), F.stddev_pop("_v").alias("s"))
    keep = 2 * F.col("k") > F.col("n")
    return votes.select("row", "col", F.when(keep | (F.col("s") <= tolerance) if flat else keep, F.col(column)).alias(column))
