"""Filters, projections and coordinates of pixels, line-of-sight points and stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.spatialjoin import point_segment_join


def clear_empty(px: DataFrame, zero: bool = True, nan: bool = True, columns: tuple[str, ...] = ("ew", "ns")) -> DataFrame:
    """Exact zeros and/or NaN become NULL, each component for itself."""
    def one(c: str) -> Column:
        bad = F.lit(False)
        if zero:
            bad = bad | (F.col(c) == 0)
        if nan:
            bad = bad | F.isnan(c)
        return F.when(~F.coalesce(bad, F.lit(False)), F.col(c))

    return px.withColumns({c: one(c) for c in columns})


def decimate(px: DataFrame, n: int) -> DataFrame:
    """Every n-th row and column."""
    return px.where((F.col("row") % n == 0) & (F.col("col") % n == 0))


def window(px: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Rectangle with its borders; the order of each pair of bounds does not matter."""
    return px.where(F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1)))


def flatten(px: DataFrame) -> DataFrame:
    """Pixels with both components."""
    return px.where("ew is not null and ns is not null and not isnan(ew) and not isnan(ns)")


def bbox(df: DataFrame, lon0: float, lon1: float, lat0: float, lat1: float) -> DataFrame:
    """Strictly inside."""
    return df.where((F.col("lon") > lon0) & (F.col("lon") < lon1) & (F.col("lat") > lat0) & (F.col("lat") < lat1))


def drop_missing(df: DataFrame, columns: tuple[str, ...] = ("vel", "err", "los_e", "los_n", "los_u")) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c)
    return df.where(cond)


def keep(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def keep_cov(cov: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Pairs (i, j, v) of a covariance table with both ends in ``ids``."""
    ends = ids.select(key)
    return cov.join(ends.withColumnRenamed(key, "i"), "i", "left_semi").join(ends.withColumnRenamed(key, "j"), "j", "left_semi")


def mask_boxes(df: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows outside every (lon0, lon1, lat0, lat1) box; borders belong to a box."""
    inside = F.lit(False)
    for lon0, lon1, lat0, lat1 in boxes:
        inside = inside | (F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))
    return df.where(~inside)


def rotate(df: DataFrame, strike: Column, ew: str = "ew", ns: str = "ns") -> DataFrame:
    """Components along (par) and across (nrm, positive to the left) a strike in degrees from north, clockwise."""
    s, c = F.sin(F.radians(strike)), F.cos(F.radians(strike))
    return df.withColumns({"par": F.col(ew) * s + F.col(ns) * c, "nrm": -F.col(ew) * c + F.col(ns) * s})


def project_los(df: DataFrame, e: str = "e", n: str = "n", u: str = "u") -> DataFrame:
    return df.withColumn("los", F.col(e) * F.col("los_e") + F.col(n) * F.col("los_n") + F.col(u) * F.col("los_u"))


def bearing_to_xy(bearing: Column, distance: Column) -> tuple[Column, Column]:
    """Steps in columns and rows of an image whose rows run south."""
    return distance * F.sin(F.radians(bearing)), -(distance * F.cos(F.radians(bearing)))


def pixel_spacing(px: DataFrame, first: int = 1000) -> DataFrame:
    """Smallest distance of two of the first pixels by row and column."""
    few = px.orderBy("row", "col").limit(first).select("row", "col", "x", "y")
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(F.broadcast(b), F.expr("a.row < b.row or (a.row = b.row and a.col < b.col)"))  # at most first**2 / 2
    return pairs.agg(F.min(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))).alias("spacing"))


def near_trace(pts: DataFrame, trace: DataFrame, key: str, distance: float, inside: bool = True) -> DataFrame:
    """Points within ``distance`` of the polylines (or farther than it)."""
    near = point_segment_join(pts, trace, distance).where(F.col("d2") <= distance**2).select(key).distinct()
    return pts.join(near, key, "left_semi" if inside else "left_anti")


# WGS84 and UTM.
A, FLAT, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def kruger() -> tuple[list[float], list[float]]:
    """Coefficients of the transverse Mercator series in the third flattening to the fourth order, forward and back."""
    n = _N
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return forward, back


def ll_to_utm(df: DataFrame, zone: int | None = None, south: bool | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds x, y, zone. Without a zone, the one of the mean longitude and the hemisphere of the mean latitude."""
    wrapped = F.when(F.col(lon) > 180, F.col(lon) - 360).otherwise(F.col(lon))
    if zone is None:
        middle = df.agg((F.floor((F.avg(wrapped) + 180) / 6) + 1).cast("int").alias("zone"), (F.avg(lat) < 0).alias("_south"))
        df = df.crossJoin(F.broadcast(middle))  # one row
    else:
        df = df.withColumns({"zone": F.lit(zone), "_south": F.lit(bool(south))})
    phi, lam = F.radians(lat), F.radians(wrapped - (F.col("zone") * 6 - 183))
    e = 2 * _N**0.5 / (1 + _N)
    df = df.withColumn("_t", F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi))))
    df = df.withColumns({"_xi": F.atan2("_t", F.cos(lam)), "_eta": F.asinh(F.sin(lam) / F.sqrt(F.col("_t") ** 2 + F.cos(lam) ** 2))})
    x, y = F.col("_eta"), F.col("_xi")
    for k, a in enumerate(kruger()[0], 1):
        x = x + a * F.cos(2 * k * F.col("_xi")) * F.sinh(2 * k * F.col("_eta"))
        y = y + a * F.sin(2 * k * F.col("_xi")) * F.cosh(2 * k * F.col("_eta"))
    return df.withColumns({"x": EAST + SCALE * RECTIFYING * x, "y": SCALE * RECTIFYING * y + F.when(F.col("_south"), SOUTH).otherwise(0.0)}).drop("_t", "_xi", "_eta", "_south")


def utm_to_ll(df: DataFrame, zone: int, south: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Adds lon, lat."""
    df = df.withColumns({"_xi": (F.col(y) - (SOUTH if south else 0.0)) / (SCALE * RECTIFYING), "_eta": (F.col(x) - EAST) / (SCALE * RECTIFYING)})
    xi, eta = F.col("_xi"), F.col("_eta")
    for k, b in enumerate(kruger()[1], 1):
        xi = xi - b * F.sin(2 * k * F.col("_xi")) * F.cosh(2 * k * F.col("_eta"))
        eta = eta - b * F.cos(2 * k * F.col("_xi")) * F.sinh(2 * k * F.col("_eta"))
    df = df.withColumns({"_a": xi, "_b": eta})
    chi = F.asin(F.sin("_a") / F.cosh("_b"))
    n = _N
    # Conformal to geodetic latitude
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return df.withColumns({"lon": zone * 6 - 183 + F.degrees(F.atan2(F.sinh("_b"), F.cos("_a"))), "lat": F.degrees(lat)}).drop("_xi", "_eta", "_a", "_b")
