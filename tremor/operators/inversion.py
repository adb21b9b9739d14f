"""Joint linear systems as tables: d (row_id, dataset, component, v), g (row_id, col_id, v), weights; only sums of P by P meet on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.spatialjoin import few, small
from tremor.sources.io import staged


def ramp(df: DataFrame, key: str) -> DataFrame:
    """(key, term, v): 1 and both coordinates, centred and scaled by their range (1 at least)."""
    s = df.agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("m", F.avg), ("h", F.max), ("l", F.min))))
    norm = lambda c: (F.col(c) - F.col(f"{c}m")) / F.greatest(F.col(f"{c}h") - F.col(f"{c}l"), F.lit(1.0))
    j = df.crossJoin(F.broadcast(s))  # one row
    return j.select(key, F.posexplode(F.array(F.lit(1.0), norm("x"), norm("y"))).alias("term", "v"))


def assemble(parts: DataFrame) -> DataFrame:
    """Running row numbers over data sets in their order: (dataset, ord, local_id, component, v) gives row_id, by a prefix sum of set sizes."""
    sizes = parts.groupBy("dataset", "ord").agg(F.count("*").alias("n"))
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a set
    local = F.row_number().over(Window.partitionBy("dataset").orderBy("component", "local_id")) - 1
    return parts.withColumn("_k", local).join(F.broadcast(first.select("dataset", "first")), "dataset").withColumn("row_id", (F.col("first") + F.col("_k")).cast("long")).drop("_k", "first")


def summary(d: DataFrame) -> DataFrame:
    return d.groupBy("dataset").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") ** 2)).alias("rms"))


def predict(g: DataFrame, m: DataFrame) -> DataFrame:
    """(row_id, pred) = G m for m (col_id, m)."""
    return g.join(small(m), "col_id").groupBy("row_id").agg(F.sum(F.col("v") * F.col("m")).alias("pred"))


def residuals(d: DataFrame, pred: DataFrame) -> DataFrame:
    return d.join(pred, "row_id").withColumn("res", F.col("v") - F.col("pred"))


def rms(res: DataFrame) -> DataFrame:
    return res.groupBy("dataset").agg(F.sqrt(F.avg(F.col("res") ** 2)).alias("rms"))


def normal_equations(g: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, v) of G'WG for i <= j and (i, v) of G'Wd; weights are the w column of d (row_id, v, w). One join by row, then grouped sums."""
    a = g.select("row_id", F.col("col_id").alias("i"), F.col("v").alias("a"))
    b = g.select("row_id", F.col("col_id").alias("j"), F.col("v").alias("b"))
    w = d.select("row_id", "w", F.col("v").alias("d"))
    aw = a.join(w, "row_id")
    gtg = aw.join(b, "row_id").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b") * F.col("w")).alias("v"))
    gtd = aw.groupBy("i").agg(F.sum(F.col("a") * F.col("d") * F.col("w")).alias("v"))
    return gtg, gtd


def conjugate_gradients(cov: DataFrame, right: DataFrame, columns: list[str], tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """(row_id, columns): solution of C X = B for a symmetric positive definite C given as pairs (i, j, v), both orders and the diagonal, and
    B (row_id, columns). Conjugate gradients with the diagonal as preconditioner, all columns side by side.

    A round is one join of the pairs with the directions and one grouped sum by row, partly summed in each task; a row's numbers
    are the only thing held together, and the driver sees three numbers a column. Ends when each column's residual is under
    ``tolerance`` of its right side; more than ``most`` rounds raise an error. Rows without pairs must not occur.
    """
    names = [f"{k}{i}" for k in "xrpq" for i in range(len(columns))]
    x, r, p, q = (names[k * len(columns) : (k + 1) * len(columns)] for k in range(4))
    cov = staged(cov.select("i", "j", "v"), "cov")
    diagonal = cov.where("i = j").select(F.col("i").alias("row_id"), F.col("v").alias("d"))
    state = right.join(diagonal, "row_id").select("row_id", "d", *(F.lit(0.0).alias(n) for n in x), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, r)), *((F.col(c) / F.col("d")).alias(n) for c, n in zip(columns, p)))
    def dots(df: DataFrame, *pairs: tuple[list[str], list[str], Column]) -> list[list[float]]:
        found = df.agg(*(F.sum(F.col(a) * F.col(b) / over) for u, v, over in pairs for a, b in zip(u, v))).first()
        return [[float(z or 0) for z in found[k * len(columns) : (k + 1) * len(columns)]] for k in range(len(pairs))]

    state, one = staged(state, "cg"), F.lit(1.0)
    now, rz = dots(state, (r, r, one), (r, r, F.col("d")))
    goal = [tolerance * tolerance * z for z in now]
    for _ in range(most):
        if all(z <= g for z, g in zip(now, goal)):
            return state.select("row_id", *(F.col(n).alias(c) for n, c in zip(x, columns)))
        product = cov.join(state.select(F.col("row_id").alias("j"), *p), "j").groupBy("i").agg(*(F.sum(F.col("v") * F.col(a)).alias(b) for a, b in zip(p, q)))
        both = staged(state.join(product.withColumnRenamed("i", "row_id"), "row_id"), "cg")
        step = [u / v if v else 0.0 for u, v in zip(rz, dots(both, (p, q, one))[0])]
        moved = both.select("row_id", "d", *((F.col(a) + s * F.col(b)).alias(a) for a, b, s in zip(x, p, step)), *((F.col(a) - s * F.col(b)).alias(a) for a, b, s in zip(r, q, step)), *p)
        now, after = dots(moved, (r, r, one), (r, r, F.col("d")))
        state = moved.select("row_id", "d", *x, *r, *((F.col(a) / F.col("d") + (u / v if v else 0.0) * F.col(b)).alias(b) for a, b, u, v in zip(r, p, after, rz)))
        rz = after
    raise RuntimeError("conjugate gradients did not settle")


def whitened_equations(g: DataFrame, d: DataFrame, cov: DataFrame, nugget: float = 0.0, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Sums of the normal equations under a full covariance, (i, j, v) of G'C^-1 G for i <= j and (i, v) of G'C^-1 d: cov (i, j, v) has both orders and
    the diagonal, to which ``nugget`` is added. C^-1 is applied to all columns by conjugate gradients, no block is factorised."""
    ids = [r["col_id"] for r in g.select("col_id").distinct().orderBy("col_id").collect()]  # the parameters of the model
    wide = g.groupBy("row_id").pivot("col_id", ids).agg(F.sum("v")).join(d.select("row_id", F.col("v").alias("_d")), "row_id", "right").fillna(0.0)
    names = [f"c{k}" for k in range(len(ids))]
    wide = wide.select("row_id", *(F.col(str(i)).alias(n) for i, n in zip(ids, names)), F.col("_d").alias("data"))
    full = cov.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), nugget).otherwise(0.0))
    white = conjugate_gradients(full, wide, [*names, "data"], tolerance)
    long = white.select("row_id", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("j"), F.col(n).alias("b")) for i, n in zip([*ids, -1], [*names, "data"])))).alias("e")).select("row_id", "e.*")
    sums = g.select("row_id", F.col("col_id").alias("i"), F.col("v").alias("a")).join(long, "row_id").where("j < 0 or i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
    sums = staged(sums, "whitened")
    return sums.where("j >= 0"), sums.where("j < 0").select("i", "v")


def bounded(m: np.ndarray, r: np.ndarray, low: float, high: float) -> np.ndarray:
    """Minimum of x'mx / 2 - r'x within bounds, m positive definite, by active sets: free values solve their equations, a step stops at the first
    bound that it meets, and of fixed values the one whose gradient points furthest inside is freed. Ends when none does."""
    n = len(r)
    x = np.clip(np.linalg.lstsq(m, r, rcond=None)[0], low, high)
    side = np.where(x <= low, -1, np.where(x >= high, 1, 0))
    slack = 1e-10 * (np.abs(m) @ np.maximum(np.abs(x), 1e-300) + np.abs(r))
    for _ in range(50 * n + 50):
        free = np.flatnonzero(side == 0)
        fixed = np.flatnonzero(side != 0)
        if len(free):
            goal = np.linalg.lstsq(m[np.ix_(free, free)], r[free] - m[np.ix_(free, fixed)] @ x[fixed], rcond=None)[0]
            move = goal - x[free]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(move < 0, (low - x[free]) / move, np.where(move > 0, (high - x[free]) / move, np.inf))
            first = int(room.argmin())
            if room[first] < 1:
                x[free] += max(room[first], 0.0) * move
                side[free[first]] = -1 if move[first] < 0 else 1
                x[free[first]] = low if move[first] < 0 else high
                continue
            x[free] = goal
        wrong = (m @ x - r) * side  # at the lower bound the gradient must not be negative, at the upper not positive
        if not len(fixed) or (wrong[fixed] <= slack[fixed]).all():
            return x
        side[fixed[(wrong[fixed] - slack[fixed]).argmax()]] = 0
    raise RuntimeError("active sets did not settle")


def solve(gtg: DataFrame, gtd: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(col_id, m, std, gradient) from the sums of the normal equations, P by P numbers: the solution, within ``bounds`` by active sets where they are
    given, the unbounded standard deviation, and the gradient of half the misfit, 0 for values inside the bounds."""
    a, b = gtg.toPandas(), gtd.toPandas()
    ids = sorted(b["i"])
    at = {c: k for k, c in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    m[a["i"].map(at), a["j"].map(at)] = a["v"]
    m = np.triu(m) + np.triu(m, 1).T
    r = np.zeros(len(ids))
    r[b["i"].map(at)] = b["v"]
    inv = np.linalg.pinv(m)
    x = bounded(m, r, *bounds) if bounds else inv @ r
    g = m @ x - r
    return gtd.sparkSession.createDataFrame([(int(c), float(x[k]), float(np.sqrt(max(inv[k, k], 0))), float(g[k])) for c, k in at.items()], "col_id long, m double, std double, gradient double")


def score_candidates(obs: DataFrame, candidates: DataFrame, model: Column, by: list[str]) -> DataFrame:
    """Best candidate for each group by the norm of prediction less data ``v``, all in one job."""
    cost = obs.join(few(candidates)).groupBy(*by, *candidates.columns).agg(F.sqrt(F.sum((model - F.col("v")) ** 2)).alias("cost"))
    return cost.groupBy(*by).agg(F.min_by(F.struct(*candidates.columns, "cost"), F.struct(F.round("cost", 9), F.col(candidates.columns[0]))).alias("b")).select(*by, "b.*")


def likelihood(res: DataFrame, inverse: DataFrame) -> DataFrame:
    """(misfit) sum of r_i W_ij r_j over pairs (i, j, w) of an inverse covariance."""
    a = inverse.join(res.select(F.col("row_id").alias("i"), F.col("res").alias("ri")), "i").join(res.select(F.col("row_id").alias("j"), F.col("res").alias("rj")), "j")
    return a.agg(F.sum(F.col("ri") * F.col("w") * F.col("rj")).alias("misfit"))


# Coefficients of the normal distribution function (Hart 1968, in West's form) and of its inverse (Wichura 1988, AS 241), highest power first.
CDF_UP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
CDF_DOWN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
MID_UP = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
MID_DOWN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
NEAR_UP = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
NEAR_DOWN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
FAR_UP = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772]
FAR_DOWN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]


def _poly(c: list[float], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + k
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, to about 1e-15; the tails beyond 37 are 0 and 1."""
    a = F.abs(x)
    tail = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    low = F.when(a > 37, 0.0).when(a < 7.07106781186547, F.exp(-a * a / 2) * _poly(CDF_UP, a) / _poly(CDF_DOWN, a)).otherwise(tail)
    return F.when(x > 0, 1 - low).otherwise(low)


def normal_quantile(p: Column) -> Column:
    """Inverse of ``normal_cdf``, to about 1e-15, for 0 < p < 1."""
    q = p - 0.5
    mid = 0.180625 - q * q
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    side = F.when(r <= 5, _poly(NEAR_UP, r - 1.6) / _poly(NEAR_DOWN, r - 1.6)).otherwise(_poly(FAR_UP, r - 5) / _poly(FAR_DOWN, r - 5))
    return F.when(F.abs(q) <= 0.425, q * _poly(MID_UP, mid) / _poly(MID_DOWN, mid)).otherwise(F.signum(q) * side)


def uniform(seed: int, *keys: Column) -> Column:
    """A number inside (0, 1) by the 48 first bits of a digest of the keys: the same on every run and in any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def draw_priors(priors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(label, draw, v) of priors (label, kind, mu, sigma, lower, upper): normal, uniform, or the truncated normal density, which is drawn by the inverse
    of its distribution function and kept a thousandth of sigma inside the bounds. A missing bound does not cut. Where both
    bounds lie in the same far tail the draw is taken in the mirrored tail, which has the digits."""
    r = priors.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("_u", uniform(seed, F.col("label"), F.col("draw")))
    low, high = (F.col("lower") - F.col("mu")) / F.col("sigma"), (F.col("upper") - F.col("mu")) / F.col("sigma")
    r = r.withColumn("_flip", F.coalesce(low, F.lit(-1e9)) > 0)
    r = r.withColumns({"_a": F.when(F.col("_flip"), -high).otherwise(low), "_b": F.when(F.col("_flip"), -low).otherwise(high)})
    r = r.withColumns({"_pa": F.coalesce(normal_cdf(F.col("_a")), F.lit(0.0)), "_pb": F.coalesce(normal_cdf(F.col("_b")), F.lit(1.0))})
    z = normal_quantile(F.greatest(F.col("_pa") + F.col("_u") * (F.col("_pb") - F.col("_pa")), F.lit(1e-300)))
    cut = F.col("mu") + F.col("sigma") * F.when(F.col("_flip"), -z).otherwise(z)
    kept = F.greatest(F.least(cut, F.col("upper") - 1e-3 * F.col("sigma")), F.col("lower") + 1e-3 * F.col("sigma"))
    v = F.when(F.col("kind") == "uniform", F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("_u")).when(F.col("kind") == "truncated", kept).otherwise(F.col("mu") + F.col("sigma") * normal_quantile(F.col("_u")))
    return r.select("label", "draw", v.alias("v"))


def central(priors: DataFrame) -> DataFrame:
    inside = F.greatest(F.least("mu", F.col("upper") - 1e-3 * F.col("sigma")), F.col("lower") + 1e-3 * F.col("sigma"))
    return priors.select("label", F.when(F.col("kind") == "uniform", (F.col("lower") + F.col("upper")) / 2).when(F.col("kind") == "truncated", inside).otherwise(F.col("mu")).alias("v"))
