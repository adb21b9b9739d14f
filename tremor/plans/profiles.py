"""Queries over swathes, relocation and profile measures (G, H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.frames import rounded
from tremor.operators import aligned as al
from tremor.operators import analyse as an
from tremor.operators import coords
from tremor.operators import picked as pk
from tremor.operators import polyline as pl
from tremor.operators import relocate as rl
from tremor.operators import ridge as rg
from tremor.operators import stencil as st
from tremor.operators import swathe as sw
from tremor.plans.geometry import _SEG
from tremor.plans.base import query, sql_uniform
from tremor.sources.io import staged

_CLEAN = "c AS (SELECT row, col, x, y, nullif(ew, 0) AS ew, nullif(ns, 0) AS ns FROM fx_pixels)"
_PROF = "SELECT n_nationkey AS profile_id, CAST(500050 AS DOUBLE) AS x0, CAST(3998600 + 50 * n_nationkey AS DOUBLE) AS y0, CAST(500950 AS DOUBLE) AS x1, CAST(3998600 + 50 * n_nationkey + 40 * (n_nationkey % 5) AS DOUBLE) AS y1, CAST(450 AS DOUBLE) AS fault_x FROM {nation}"
_SW = f"""{_CLEAN}, p AS ({_PROF.format(nation='nation')}), q AS (SELECT *, (x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS ux, (y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS uy, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM p),
sw AS (SELECT profile_id, row, col, (x - x0) * ux + (y - y0) * uy - fault_x AS xs, ew * ux + ns * uy AS par, -ew * uy + ns * ux AS nrm FROM c, q WHERE ew IS NOT NULL AND ns IS NOT NULL AND abs(-(x - x0) * uy + (y - y0) * ux) <= 45 AND (x - x0) * ux + (y - y0) * uy BETWEEN 0 AND len)"""
_PTS = "e AS (SELECT profile_id, event_id, xs, par, nrm FROM fx_profile_points)"


def _swathes(px: DataFrame, nation: DataFrame) -> DataFrame:
    return sw.extract(coords.clear_empty(px), nation.sparkSession.sql(_PROF, nation=nation), 45.0)


@query(f"WITH {_SW} SELECT profile_id, row, col, round(xs, 6) AS xs, round(par, 6) AS par, round(nrm, 6) AS nrm FROM sw")
def g1_extract(fx_pixels: DataFrame, nation: DataFrame) -> DataFrame:
    return rounded(_swathes(fx_pixels, nation).drop("perp"), "xs", "par", "nrm")


_BIN = "f AS (SELECT profile_id, min(xs) AS lo, max(xs) AS hi FROM {t} GROUP BY profile_id), k AS (SELECT t.*, CAST(coalesce(least(floor((xs - lo) / ((hi - lo) / {n})), {n} - 1), 0) AS INT) AS bin FROM {t} t JOIN f USING (profile_id))"


@query(f"WITH {_PTS}, {_BIN.format(t='e', n=20)}, m AS (SELECT profile_id, bin, avg(par) AS par, count(*) AS n FROM k GROUP BY ALL), z AS (SELECT f.*, CAST(i AS INT) AS bin FROM f, range(0, 20) AS r(i)) SELECT z.profile_id, z.bin, round(lo + (z.bin + 0.5) * (hi - lo) / 20, 6) AS x, round(par, 6) AS par, coalesce(n, 0) AS n FROM z LEFT JOIN m ON m.profile_id = z.profile_id AND m.bin = z.bin")
def g2_bin_average(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(sw.bin_average(fx_profile_points, 20, ["par"]), "x", "par")


_EDGES = sw.zone_edges(-400.0, 300.0, 50.0, 24)


@query(f"WITH {_PTS}, g AS (SELECT CAST(k - 1 AS INT) AS bin, e[k] AS a, e[k + 1] AS b FROM (SELECT {_EDGES!r}::DOUBLE[] AS e), range(1, {len(_EDGES)}) AS r(k)) SELECT profile_id, bin, round(avg(par), 6) AS par, count(*) AS n FROM e JOIN g ON xs >= a AND xs < b GROUP BY ALL")
def g3_zone_bins(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(sw.edge_average(fx_profile_points, _EDGES, ["par"]), "par")


_SPAN = f"{_BIN.format(t='e', n=50)}, h AS (SELECT profile_id, lo, hi, bin, count(*) AS n FROM k JOIN f USING (profile_id) GROUP BY ALL), o AS (SELECT profile_id, min(lo + bin * ((hi - lo) / 50)) AS a, max(lo + (bin + 1) * ((hi - lo) / 50)) AS b FROM (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY profile_id) AS mid FROM h) WHERE n > 0.1 * mid GROUP BY profile_id)".replace("SELECT profile_id, lo, hi, bin, count(*) AS n FROM k JOIN f USING (profile_id) GROUP BY ALL", "SELECT k.profile_id, f.lo, f.hi, bin, count(*) AS n FROM k JOIN f ON f.profile_id = k.profile_id GROUP BY ALL")


@query(f"WITH {_PTS}, {_SPAN} SELECT profile_id, round(a, 6) AS lo, round(b, 6) AS hi FROM o")
def g4_populated_span(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(sw.populated_span(fx_profile_points), "lo", "hi")


@query(f"""WITH {_PTS}, {_SPAN}, w AS (SELECT e.* FROM e JOIN o USING (profile_id) WHERE xs BETWEEN a AND b), ok AS (SELECT profile_id FROM w GROUP BY profile_id HAVING count(*) >= 10 AND count(*) FILTER (xs < 0) >= 4 AND count(*) FILTER (xs > 0) >= 4),
z AS (SELECT w.*, min(xs) OVER v AS l, max(xs) OVER v AS u FROM w SEMI JOIN ok USING (profile_id) WINDOW v AS (PARTITION BY profile_id)), y AS (SELECT profile_id, CAST(coalesce(least(floor((xs - l) / ((u - l) / 8)), 7), 0) AS INT) AS bin, avg(par) AS par, avg(nrm) AS nrm FROM z GROUP BY ALL)
SELECT profile_id, bin, round(par, 9) AS par, round(nrm, 9) AS nrm FROM y WHERE profile_id IN (SELECT profile_id FROM y GROUP BY profile_id HAVING count(*) >= 5)""")
def g5_quick_profiles(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(sw.quick_profiles(fx_profile_points, 8, 10, 4, 5).where("n > 0").select("profile_id", "bin", "par", "nrm"), "par", "nrm", digits=9)


_CENT = "SELECT n_nationkey AS profile_id, CAST(500500 AS DOUBLE) AS cx, CAST(3998650 + 50 * n_nationkey AS DOUBLE) AS cy, CAST(3 * n_nationkey AS DOUBLE) AS strike FROM {nation}"


@query(f"WITH p AS ({_CENT.format(nation='nation')}), z AS (SELECT profile_id, row, col, (x - cx) * sin(radians(strike)) + (y - cy) * cos(radians(strike)) AS t, -(x - cx) * cos(radians(strike)) + (y - cy) * sin(radians(strike)) AS u FROM fx_pixels, p) SELECT profile_id, row, col, round(t, 6) AS t, round(u, 6) AS u FROM z WHERE t >= -33.3 AND t < 33.3 AND u >= -222.2 AND u < 222.2")
def g6_frame_pixels(fx_pixels: DataFrame, nation: DataFrame) -> DataFrame:
    out = sw.frame_pixels(fx_pixels, nation.sparkSession.sql(_CENT, nation=nation), 33.3, 222.2)
    return rounded(out.select("profile_id", "row", "col", "t", "u"), "t", "u")


_FAULT = "SELECT * FROM fx_trace WHERE strand_id = 0"
_DIST = f"{_SEG.replace('FROM fx_trace WINDOW', 'FROM fx_trace WHERE strand_id = 0 WINDOW')}, near AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY round(d2, 6), strand_id, seq) AS k FROM dist), sd AS (SELECT row, col, ew, ns, CASE WHEN crossed >= 0 THEN 1 ELSE -1 END * sqrt(d2) AS d FROM near WHERE k = 1 AND d2 <= 250000 AND ew <> 0 AND ns <> 0)"
_STACK = [-500.0, -200.0, -100.0, -50.0, -20.0, 0.0, 20.0, 50.0, 100.0, 200.0, 500.0]


@query(f"""WITH {_DIST}, g AS (SELECT CAST(k - 1 AS INT) AS bin, e[k] AS a, e[k + 1] AS b FROM (SELECT {_STACK!r}::DOUBLE[] AS e), range(1, {len(_STACK)}) AS r(k)),
r AS (SELECT bin, d, ew * sin(radians(1)) + ns * cos(radians(1)) AS par, -ew * cos(radians(1)) + ns * sin(radians(1)) AS nrm FROM sd JOIN g ON d >= a AND d < b), m AS (SELECT *, quantile_cont(par, 0.5) OVER (PARTITION BY bin) AS pm, quantile_cont(nrm, 0.5) OVER (PARTITION BY bin) AS nm FROM r)
SELECT bin, round(quantile_cont(d, 0.5), 6) AS x, count(*) AS n, round(any_value(pm), 6) AS par_med, round(1.4826 * quantile_cont(abs(par - pm), 0.5), 6) AS par_rstd, round(any_value(nm), 6) AS nrm_med, round(1.4826 * quantile_cont(abs(nrm - nm), 0.5), 6) AS nrm_rstd FROM m GROUP BY bin""")
def g9_robust_stack(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    """Median displacement along and across the fault by signed distance from it."""
    px = coords.flatten(coords.clear_empty(fx_pixels))
    at = pl.signed_distance(px, fx_trace.where("strand_id = 0"), ["row", "col"], 500.0)
    out = sw.robust_stack(coords.rotate(at, F.lit(1.0)), _STACK, "d", ["par", "nrm"], 5)
    return rounded(out, "x", "par_med", "par_rstd", "nrm_med", "nrm_rstd")


@query(f"""WITH {_PTS}, s AS (SELECT *, sign(xs) AS g FROM e WHERE abs(xs) BETWEEN 30 AND 200), m AS (SELECT profile_id, count(*)::DOUBLE AS n, sum(xs) AS x, sum(g) AS g, sum(xs * xs) AS xx, sum(xs * g) AS xg, sum(g * g) AS gg, sum(par) AS y, sum(xs * par) AS xy, sum(g * par) AS gy FROM s GROUP BY profile_id HAVING count(*) >= 6 AND count(*) FILTER (xs < 0) >= 2 AND count(*) FILTER (xs > 0) >= 2),
d AS (SELECT *, n * (xx * gg - xg * xg) - x * (x * gg - xg * g) + g * (x * xg - xx * g) AS det FROM m),
f AS (SELECT profile_id, (y * (xx * gg - xg * xg) - x * (xy * gg - gy * xg) + g * (xy * xg - gy * xx)) / det AS c0, (n * (xy * gg - gy * xg) - y * (x * gg - xg * g) + g * (x * gy - xy * g)) / det AS c1,
  (n * (xx * gy - xy * xg) - x * (x * gy - xy * g) + y * (x * xg - xx * g)) / det AS c2 FROM d WHERE det <> 0),
z AS (SELECT e.profile_id, xs, par, max((par - c0 - c1 * xs) / (2 * c2) + 0.5) OVER (PARTITION BY e.profile_id ORDER BY xs, par ROWS UNBOUNDED PRECEDING) AS z FROM e JOIN f USING (profile_id) WHERE abs(xs) <= 200),
l AS (SELECT *, lag(xs) OVER w AS px, lag(z) OVER w AS pz FROM z WINDOW w AS (PARTITION BY profile_id ORDER BY xs, par)),
k AS (SELECT profile_id, max(xs) AS last, min(CASE WHEN z >= 0.9 AND (pz IS NULL OR pz < 0.9) THEN CASE WHEN pz IS NULL THEN xs ELSE px + (xs - px) * (0.9 - pz) / (z - pz) END END) AS hi, min(CASE WHEN z >= 0.1 AND (pz IS NULL OR pz < 0.1) THEN CASE WHEN pz IS NULL THEN xs ELSE px + (xs - px) * (0.1 - pz) / (z - pz) END END) AS lo FROM l GROUP BY profile_id)
SELECT profile_id, round(coalesce(hi, last) - coalesce(lo, last), 4) AS width, round(2 * c2, 4) AS amplitude FROM k JOIN f USING (profile_id)""")
def g10_step(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(sw.step_width(fx_profile_points, half=200.0, inner=30.0).select("profile_id", "width", "amplitude"), "width", "amplitude", digits=4)


@query(None)
def g11_picked_swathes(fx_pixels: DataFrame, fx_trace: DataFrame, supplier: DataFrame) -> DataFrame:
    """The whole driver over picks along the first strand, every second one against its direction; tests/test_picked.py holds it against a planted fault."""
    fault = fx_trace.where("strand_id = 0")
    at = supplier.select(F.col("s_suppkey").alias("pick_id"), F.lit(0).alias("strand_id"), (15980.0 - 10 * F.col("s_suppkey")).alias("s"))
    picks = pl.interpolate(at, fault).select("pick_id", "x", "y", (2.0 + 180 * (F.col("pick_id") % 2)).alias("strike"), F.lit(-250.0).alias("lo"), F.lit(220.0).alias("hi"))
    profiles, bins, _ = pk.picked_profiles(
        coords.clear_empty(fx_pixels), fault, picks, pk.Raster((500000.0, 4000000.0), (10.0, -10.0)), _STACK, 400.0, strike_half=100.0, refine_half=200.0, step_search=100.0,
        step_stack=60.0, branch=20, smooth=30.0, stages=((100.0, 40.0, 0.5), (40.0, 20.0, 0.5)), dn=5.0, offset_sigma=20.0, least=3, near=60.0, min_quality=1.5)
    out = bins.join(profiles.select("pick_id", "strike", "step_shift", "total_shift", "support", "quality", "localised"), "pick_id")
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query("SELECT profile_id, round(avg(CASE WHEN nrm > 0 THEN 1.0 ELSE 0.0 END), 6) AS support, round(quantile_cont(par, 0.5), 6) AS quality, avg(CASE WHEN nrm > 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AND quantile_cont(par, 0.5) >= 0 AS localised FROM fx_profile_points WHERE abs(xs) <= 100 GROUP BY profile_id")
def g12_localised(fx_profile_points: DataFrame) -> DataFrame:
    points = fx_profile_points.where("abs(xs) <= 100").select("profile_id", (F.col("nrm") > 0).alias("accepted"), F.col("par").alias("quality"))
    return rounded(sw.localised(points, 0.5, 0.0), "support", "quality")


@query(f"WITH {_SW} SELECT profile_id, round(xs, 6) AS d, round(par, 6) AS par, round(nrm, 6) AS nrm FROM sw WHERE abs(xs) <= 60")
def g13_near_fault_cloud(fx_pixels: DataFrame, nation: DataFrame) -> DataFrame:
    return rounded(_swathes(fx_pixels, nation).where("abs(xs) <= 60").select("profile_id", F.col("xs").alias("d"), "par", "nrm"), "d", "par", "nrm")


_SCALES = [120.0, 400.0, 1500.0]
_LEGS = "leg AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, coalesce(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM seg)"


@query(f"""WITH {_DIST}, {_LEGS}, tot AS (SELECT max(s0 + len) AS total FROM leg), pts AS (SELECT 25.0 * k AS s, x0 + (x1 - x0) * (25.0 * k - s0) / len AS x, y0 + (y1 - y0) * (25.0 * k - s0) / len AS y FROM tot, range(0, CAST(floor(total / 25) AS BIGINT) + 1) AS r(k), leg WHERE 25.0 * k >= s0 AND (25.0 * k < s0 + len OR (s0 + len = total AND 25.0 * k >= s0 + len))),
pick AS (SELECT s_suppkey AS pick_id, 15980.0 - 10 * s_suppkey AS s FROM supplier), cen AS (SELECT pick_id, x0 + (x1 - x0) * (s - s0) / len AS cx, y0 + (y1 - y0) * (s - s0) / len AS cy FROM pick, leg WHERE s >= s0 AND s < s0 + len),
sc AS (SELECT pick_id, w, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t, max_by(x, p.s) - min_by(x, p.s) AS dx, max_by(y, p.s) - min_by(y, p.s) AS dy FROM pick, (SELECT unnest({_SCALES!r}::DOUBLE[]) AS w), pts p WHERE abs(p.s - pick.s) <= w GROUP BY ALL),
st AS (SELECT pick_id, w, radians((90 - degrees(t + CASE WHEN cos(t) * dx + sin(t) * dy < 0 THEN pi() ELSE 0 END) + 720) % 360) AS a FROM sc),
fr AS (SELECT pick_id, w, d, ew * sin(a) + ns * cos(a) AS par, -ew * cos(a) + ns * sin(a) AS nrm FROM (SELECT sd.*, p.x, p.y FROM sd JOIN fx_pixels p USING (row, col)) q, st JOIN cen USING (pick_id)
  WHERE (x - cx) * sin(a) + (y - cy) * cos(a) >= -60 AND (x - cx) * sin(a) + (y - cy) * cos(a) < 60 AND -(x - cx) * cos(a) + (y - cy) * sin(a) >= -300 AND -(x - cx) * cos(a) + (y - cy) * sin(a) < 300),
g AS (SELECT CAST(k - 1 AS INT) AS bin, e[k] AS lo, e[k + 1] AS hi FROM (SELECT {_STACK!r}::DOUBLE[] AS e), range(1, {len(_STACK)}) AS r(k)), m AS (SELECT pick_id, w, bin, d, par, nrm, quantile_cont(par, 0.5) OVER v AS pm, quantile_cont(nrm, 0.5) OVER v AS qm FROM fr JOIN g ON d >= lo AND d < hi WINDOW v AS (PARTITION BY pick_id, w, bin)),
b AS (SELECT pick_id, w, bin, count(*) AS n, quantile_cont(d, 0.5) AS x, any_value(pm) AS pm, any_value(qm) AS qm, 1.4826 * quantile_cont(abs(par - pm), 0.5) AS sp FROM m GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT pick_id, bin, quantile_cont(x, 0.5) AS x FROM b GROUP BY ALL HAVING count(*) = {len(_SCALES)} AND quantile_cont(x, 0.5) BETWEEN -250 AND 220), k AS (SELECT b.pick_id, b.w, b.bin, c.x, pm, qm, sp, n FROM b JOIN c ON c.pick_id = b.pick_id AND c.bin = b.bin),
o AS (SELECT pick_id, w, avg(pm) AS p, avg(qm) AS q FROM k GROUP BY ALL), lv AS (SELECT pick_id, avg(p) AS p, avg(q) AS q FROM o GROUP BY pick_id),
f AS (SELECT k.pick_id, bin, x, pm - o.p + lv.p AS par, qm - o.q + lv.q AS nrm, sp, n FROM k JOIN o ON o.pick_id = k.pick_id AND o.w = k.w JOIN lv ON lv.pick_id = k.pick_id)
SELECT pick_id, bin, round(any_value(x), 5) AS x, round(quantile_cont(par, 0.5), 5) AS par_med, round(stddev_samp(par), 5) AS par_std, round(quantile_cont(nrm, 0.5), 5) AS nrm_med, round(stddev_samp(nrm), 5) AS nrm_std, round(quantile_cont(sp, 0.5), 5) AS scatter, quantile_cont(n, 0.5) AS n FROM f GROUP BY pick_id, bin""")
def g14_ensemble(fx_pixels: DataFrame, fx_trace: DataFrame, supplier: DataFrame) -> DataFrame:
    """Picks along the first strand, each with a strike and a swathe for three length scales; a place beyond the strand's ends is no pick."""
    fault = fx_trace.where("strand_id = 0")
    picks = supplier.select(F.col("s_suppkey").alias("pick_id"), F.lit(0).alias("strand_id"), (15980.0 - 10 * F.col("s_suppkey")).alias("s"))
    picks = picks.join(F.broadcast(pl.totals(fault)), "strand_id").where("s >= 0 and s < total").drop("total")  # one row
    centres = pl.interpolate(picks, fault).select("pick_id", "x", "y")
    strikes = staged(sw.scale_strikes(pl.resample(fault, 25.0), picks, _SCALES), "strikes")
    px = coords.flatten(coords.clear_empty(fx_pixels))
    far = pl.signed_distance(px, fault, ["row", "col"], 500.0).select("row", "col", "d")
    spans = picks.select("pick_id", F.lit(-250.0).alias("lo"), F.lit(220.0).alias("hi"))
    out = sw.multi_strike(px, far, centres, strikes, _STACK, 60.0, 300.0, spans, 3)
    return rounded(out, "x", "par_med", "par_std", "nrm_med", "nrm_std", "scatter", digits=5)


@query("""WITH z AS (SELECT o_orderkey % 500 AS g, o_orderkey AS k, (o_custkey * 7 % 720) / 2.0 AS a FROM orders), f AS (SELECT g, arg_min(a, k) AS first FROM z GROUP BY g) SELECT g, round((any_value(first) + quantile_cont((a - first + 540) % 360 - 180, 0.5) + 360) % 360, 6) AS a FROM z JOIN f USING (g) GROUP BY g""")
def g14_circular_median(orders: DataFrame) -> DataFrame:
    z = orders.select((F.col("o_orderkey") % 500).alias("g"), F.col("o_orderkey").alias("k"), ((F.col("o_custkey") * 7 % 720) / 2).alias("a"))
    return rounded(sw.circular_median(z, ["g"], "a", "k"), "a")


@query(f"WITH {_PTS}, {_SPAN} SELECT profile_id, event_id FROM e JOIN o USING (profile_id) WHERE xs BETWEEN a + 5 AND b + 5")
def g15_crop(fx_profile_points: DataFrame) -> DataFrame:
    return sw.crop(fx_profile_points, sw.populated_span(fx_profile_points), F.lit(5.0)).select("profile_id", "event_id")


_LINE = f"""{_CLEAN}, p AS (SELECT n_nationkey AS profile_id, 20.0 + 4 * n_nationkey AS row0, 48.0 AS col0, radians(2.0 * n_nationkey - 20) AS s FROM nation), w AS (SELECT profile_id, k, s, row0 + k * -cos(s - pi() / 2) AS fr, col0 + k * sin(s - pi() / 2) AS fc FROM p, range(-30, 31) AS r(k)),
n AS (SELECT profile_id, w.k, s, (CASE WHEN i = 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END) * (CASE WHEN j = 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END) AS w, ew, ns FROM w, range(0, 2) AS a(i), range(0, 2) AS b(j) LEFT JOIN c ON c.row = floor(fr) + i AND c.col = floor(fc) + j),
ln AS (SELECT profile_id, k, CASE WHEN count(ew) = 4 THEN sum(w * ew) END * sin(any_value(s)) + CASE WHEN count(ns) = 4 THEN sum(w * ns) END * cos(any_value(s)) AS par, -CASE WHEN count(ew) = 4 THEN sum(w * ew) END * cos(any_value(s)) + CASE WHEN count(ns) = 4 THEN sum(w * ns) END * sin(any_value(s)) AS nrm FROM n GROUP BY profile_id, k)"""


def _centres(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").cast("long").alias("profile_id"), F.lit(0).alias("strand_id"), F.col("n_nationkey").alias("i"), (20.0 + 4 * F.col("n_nationkey")).alias("row0"), F.lit(48.0).alias("col0"), (2.0 * F.col("n_nationkey") - 20).alias("strike"))


def _lines(px: DataFrame, nation: DataFrame) -> DataFrame:
    return an.line_samples(coords.clear_empty(px), _centres(nation), 30)


@query(f"WITH {_LINE} SELECT CAST(profile_id AS BIGINT) AS profile_id, CAST(k AS INT) AS k, round(par, 4) AS par, round(nrm, 4) AS nrm FROM ln")
def g16_line_samples(fx_pixels: DataFrame, nation: DataFrame) -> DataFrame:
    return rounded(_lines(fx_pixels, nation), "par", "nrm", digits=4)


_CUBE = "q AS (SELECT CAST(row AS BIGINT) AS profile_id, CAST(col - 50 AS INT) AS k, nullif(ew, 0) AS v FROM fx_pixels WHERE col <> 0)"


def _cube(px: DataFrame) -> DataFrame:
    return coords.clear_empty(px).where("col <> 0").select(F.col("row").cast("long").alias("profile_id"), (F.col("col") - 50).cast("int").alias("k"), F.col("ew").alias("v"))


_W = rl.boxcar_weights(20, 20, 2.0)


@query(f"""WITH {_CUBE}, w AS (SELECT profile_id, k, v * ({_W!r}::DOUBLE[])[k + 21] AS v FROM q WHERE abs(k) <= 20 AND v IS NOT NULL), s AS (SELECT *, lag(v) OVER z AS a, lead(v) OVER z AS b, count(*) OVER (PARTITION BY profile_id) AS n, row_number() OVER (PARTITION BY profile_id ORDER BY v DESC, k) AS r FROM w WINDOW z AS (PARTITION BY profile_id ORDER BY k)),
t AS (SELECT profile_id, n, k + coalesce(CASE WHEN a - 2 * v + b < 0 THEN 0.5 * (a - b) / (a - 2 * v + b) ELSE 0 END, 0) AS pos FROM s WHERE r = 1) SELECT profile_id, round(CASE WHEN n >= 4 AND abs(pos) < 12 THEN pos ELSE 0 END, 6) AS shift FROM t""")
def h2_peak_shift(fx_pixels: DataFrame) -> DataFrame:
    return rounded(rl.peak_shift(_cube(fx_pixels), "v", _W, 12.0), "shift")


_SHIFT = "z AS (SELECT p_partkey AS i, p_partkey % 4 AS strand, CASE WHEN p_partkey % 7 < 3 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS shift FROM part)"


def _shifts(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 4).alias("strand"), F.when(F.col("p_partkey") % 7 < 3, 0.0).otherwise(F.col("p_size").cast("double")).alias("shift"))


@query(f"""WITH {_SHIFT}, n AS (SELECT *, last_value(CASE WHEN shift <> 0 THEN i END IGNORE NULLS) OVER a AS pi, last_value(nullif(shift, 0) IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN shift <> 0 THEN i END IGNORE NULLS) OVER b AS ni, first_value(nullif(shift, 0) IGNORE NULLS) OVER b AS nv FROM z
WINDOW a AS (PARTITION BY strand ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY strand ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT i, strand, round(CASE WHEN shift <> 0 THEN shift ELSE coalesce(pv + (nv - pv) * (i - pi) / (ni - pi), 0) END, 6) AS shift FROM n""")
def h3_fill_failed(part: DataFrame) -> DataFrame:
    return rounded(rl.fill_failed(_shifts(part), ["strand"], "i"), "shift")


@query(None)
def h4_replace_outliers(part: DataFrame) -> DataFrame:
    return rounded(rl.replace_outliers(_shifts(part), "strand", "i", "shift", 5, 10.0), "shift")


@query(f"WITH {_SHIFT}, m AS (SELECT *, (sum(shift) OVER w - shift) / (count(shift) OVER w - 1) AS mean FROM z WINDOW w AS (PARTITION BY strand ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT i, strand, round(CASE WHEN abs(shift - mean) > 10 THEN mean ELSE shift END, 6) AS shift FROM m")
def h4_replace_outliers_once(part: DataFrame) -> DataFrame:
    return rounded(rl.replace_outliers_once(_shifts(part), "strand", "i", "shift", 5, 10.0), "shift")


@query(f"WITH {_CUBE}, s AS (SELECT DISTINCT profile_id, (profile_id % 9 - 4) / 4.0::DOUBLE AS shift FROM q), t AS (SELECT q.profile_id, q.k, q.k + shift AS pos FROM q JOIN s ON s.profile_id = q.profile_id) SELECT t.profile_id, t.k, round(CASE WHEN pos = floor(pos) THEN a.v ELSE a.v + (b.v - a.v) * (pos - floor(pos)) END, 11) AS v FROM t LEFT JOIN q a ON a.profile_id = t.profile_id AND a.k = floor(pos) LEFT JOIN q b ON b.profile_id = t.profile_id AND b.k = floor(pos) + 1")
def h5_apply_shift(fx_pixels: DataFrame) -> DataFrame:
    cube = _cube(fx_pixels)
    shifts = cube.select("profile_id").distinct().withColumn("shift", (F.col("profile_id") % 9 - 4) / 4.0)
    return rounded(rl.apply_shift(cube, shifts, ["v"]), "v", digits=11)


@query(f"WITH {_CUBE}, w AS (SELECT *, quantile_cont(v, 0.5) OVER x AS m, stddev_pop(v) OVER x AS s, CASE WHEN count(*) OVER x - count(v) OVER x < 2 THEN 1 ELSE 0 END AS full_ FROM q WINDOW x AS (PARTITION BY k ORDER BY profile_id ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)), g AS (SELECT *, sum(full_) OVER (PARTITION BY profile_id) >= 80 AS ok FROM w) SELECT profile_id, k, round(CASE WHEN ok THEN m END, 9) AS v_med, round(CASE WHEN ok THEN s END, 6) AS v_std FROM g")
def h6_stack(fx_pixels: DataFrame) -> DataFrame:
    return rounded(rounded(rl.stack(_cube(fx_pixels), "profile_id", ["v"], 6, 80).select("profile_id", "k", "v_med", "v_std"), "v_std"), "v_med", digits=9)


@query(f"WITH {_CUBE}, m AS (SELECT k, quantile_cont(v, 0.5) AS v, floor(profile_id / 10) AS pid FROM q GROUP BY ALL), d AS (SELECT pid, k, v - avg(v) OVER (PARTITION BY pid) AS v FROM m), n AS (SELECT *, lead(k) OVER w AS k1, lead(v) OVER w AS v1 FROM d WINDOW w AS (PARTITION BY pid ORDER BY k)), c AS (SELECT pid, k, k - v * (k1 - k) / (v1 - v) AS pos, abs((v1 - v) / (k1 - k)) AS slope FROM n WHERE v * v1 <= 0 AND v <> v1) SELECT CAST(pid AS BIGINT) AS profile_id, round(pos, 6) AS shift FROM c WHERE abs(pos) <= 30 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(slope, 9) DESC, k) = 1")
def h7_step_crossing(fx_pixels: DataFrame) -> DataFrame:
    bundle = _cube(fx_pixels).groupBy(F.floor(F.col("profile_id") / 10).alias("profile_id"), "k").agg(F.percentile("v", F.lit(0.5)).alias("v")).select("profile_id", F.col("k").cast("double").alias("x"), "v")
    return rounded(rl.step_crossing(bundle, 30.0), "shift")


@query(None)
def h8_second_shift(fx_pixels: DataFrame) -> DataFrame:
    cube = _cube(fx_pixels)
    strands = cube.select("profile_id", F.floor(F.col("profile_id") / 60).cast("int").alias("strand_id")).distinct()
    return rounded(an.second_shift(cube, "v", 20, 12.0, 4.0, strands), "v")


_NEARALL = f"{_SEG}, arcs AS (SELECT *, coalesce(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) OVER (PARTITION BY strand_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM seg), nb AS (SELECT d.*, a.s0 + f * a.len AS s, row_number() OVER (PARTITION BY row, col ORDER BY round(d2, 6), d.strand_id, d.seq) AS k FROM dist d JOIN arcs a ON a.strand_id = d.strand_id AND a.seq = d.seq)"


@query(f"WITH {_NEARALL}, b AS (SELECT strand_id, CAST(round(s / 50) AS INT) AS along, CAST(round(CASE WHEN crossed >= 0 THEN 1 ELSE -1 END * sqrt(d2) / 20) AS INT) AS off, abs(avg(nullif(ew, 0))) AS v FROM nb WHERE k = 1 AND d2 <= 40000 AND ew <> 0 GROUP BY ALL) SELECT strand_id, along, off, round(v, 6) AS v, round(quantile_cont(v, 0.5) OVER (PARTITION BY strand_id), 6) AS background FROM b")
def h10_straighten(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    px = coords.clear_empty(fx_pixels).where("ew is not null")
    near = pl.signed_distance(px, fx_trace, ["row", "col"], 200.0).select("row", "col", "strand_id", "s", "d")
    # prices in cents make means that end in exactly half a sixth digit; without the noise of their sums, which hangs on the order of rows, these go up
    return rounded(rounded(rl.straighten(px, near, "ew", 50.0, 20.0), "v", "background", digits=11), "v", "background")


def _image(px: DataFrame, trace: DataFrame) -> DataFrame:
    px = coords.clear_empty(px).where("ew is not null")
    near = pl.signed_distance(px, trace, ["row", "col"], 200.0).select("row", "col", "strand_id", "s", "d")
    return rl.straighten(px, near, "ew", 50.0, 20.0).select("strand_id", "along", "off", "v")


REACH = 10  # columns on either side of the trace in _image


def _ridge(px: DataFrame, trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    image = staged(_image(px, trace), "image")
    path = rg.best_path(image.withColumn("off", F.col("off") + REACH), 0.05, 2, 2 * REACH + 1).withColumn("off", F.col("off") - REACH)
    return image, path


@query(None)
def h11_ridge_path(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    image, path = _ridge(fx_pixels, fx_trace)
    return rounded(path.join(image, ["strand_id", "along", "off"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))), "v")


_IMAGE = f"""{_NEARALL}, b AS (SELECT strand_id, CAST(round(s / 50) AS INT) AS along, CAST(round(CASE WHEN crossed >= 0 THEN 1 ELSE -1 END * sqrt(d2) / 20) AS INT) AS off, abs(avg(nullif(ew, 0))) AS v FROM nb WHERE k = 1 AND d2 <= 40000 AND ew <> 0 GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_IMAGE}, span AS (SELECT strand_id, min(along) AS lo, max(along) AS hi FROM b GROUP BY strand_id),
cells AS (SELECT strand_id, lo, unnest(range(lo, hi + 1)) AS along FROM span), full_ AS (SELECT c.strand_id, c.lo, c.along, list(coalesce(b.v, 0) ORDER BY o.off) AS v
  FROM cells c CROSS JOIN (SELECT unnest(range(-10, 11)) AS off) o LEFT JOIN b ON b.strand_id = c.strand_id AND b.along = c.along AND b.off = o.off GROUP BY ALL),
walk AS (SELECT strand_id, along, v AS best FROM full_ WHERE along = lo UNION ALL
  SELECT f.strand_id, f.along, list_transform(range(1, 22), lambda c: f.v[c] + list_max(list_transform(range(-2, 3), lambda d: CASE WHEN c + d BETWEEN 1 AND 21 THEN w.best[c + d] - 0.05 * abs(d) ELSE -1e300 END)))
  FROM walk w JOIN full_ f ON f.strand_id = w.strand_id AND f.along = w.along + 1)
SELECT s.strand_id, hi - lo + 1 AS n, round(list_max(best), 6) AS total FROM walk w JOIN span s ON s.strand_id = w.strand_id AND s.hi = w.along""")
def h11_ridge_total(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    """What the best path of each strand gathers, less what its steps aside cost."""
    image, path = _ridge(fx_pixels, fx_trace)
    by = Window.partitionBy("strand_id", F.floor(F.col("along") / 1000)).orderBy("along")
    # the step onto a block's first row is found by a join, so that no window holds a strand
    before = path.select("strand_id", (F.col("along") + 1).alias("along"), F.col("off").alias("_before"))
    step = F.abs(F.col("off") - F.coalesce(F.lag("off").over(by), F.col("_before"), F.col("off")))
    gain = path.join(before, ["strand_id", "along"], "left").withColumn("step", step).join(image, ["strand_id", "along", "off"], "left")
    return rounded(gain.groupBy("strand_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("v", F.lit(0.0)) - 0.05 * F.col("step")).alias("total")), "total")


def _strain(px: DataFrame) -> DataFrame:
    return staged(st.strain_maps(coords.clear_empty(px), 1.0).select("row", "col", "x", "y", "exx", "eyy", "exy"), "strain")


@query(None)
def h12_refine_trace(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    """Three stages over the parts of the strands that the pixels cover; tests/test_ridge.py holds them against a planted curve."""
    south = fx_pixels.agg(F.min("y").alias("south"))
    samples = pl.resample(fx_trace, 10.0).crossJoin(F.broadcast(south)).where("y >= south and y <= 4000000").select("strand_id", "k", "x", "y")
    last, _ = rg.refine_trace(samples, _strain(fx_pixels), [(100.0, 40.0, 0.5), (50.0, 20.0, 0.5), (20.0, 10.0, 0.5)], (500000.0, 4000000.0), (10.0, -10.0), 10.0, 5.0, 1.5, 0.5, 30.0)
    return rounded(last, "x", "y", "path", "accepted", "offset", "prior", "quality")


@query("""WITH z AS (SELECT p_partkey AS along, CAST(p_partkey % 3 AS INT) AS strand_id, p_size > 12 AS c FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY along) - row_number() OVER (PARTITION BY strand_id, c ORDER BY along) AS run FROM z) SELECT along, strand_id, c AND count(*) OVER (PARTITION BY strand_id, c, run) >= 4 AS kept FROM r""")
def h13_clear_runs(part: DataFrame) -> DataFrame:
    path = part.select(F.col("p_partkey").alias("along"), (F.col("p_partkey") % 3).cast("int").alias("strand_id"), "p_size")
    return rl.clear_runs(path, F.col("p_size") > 12, 4).select("along", "strand_id", "kept")


_KEEP = "SELECT CAST(n_nationkey % 3 AS INT) AS strand_id, CAST(40 * n_nationkey AS DOUBLE) AS start, CAST(40 * n_nationkey + 60 AS DOUBLE) AS stop FROM {nation} WHERE n_nationkey % 2 = 0"


@query(f"""WITH p AS (SELECT CAST(p_partkey % 3 AS INT) AS strand_id, CAST(floor(p_partkey / 3.0) AS BIGINT) AS along, CAST(p_size - 25 AS DOUBLE) AS path_offset, p_size > 12 AS c FROM part), keep AS ({_KEEP.format(nation='nation')}),
r AS (SELECT *, row_number() OVER (PARTITION BY strand_id ORDER BY along) - row_number() OVER (PARTITION BY strand_id, c ORDER BY along) AS run FROM p),
k AS (SELECT *, c AND count(*) OVER (PARTITION BY strand_id, c, run) >= 4 AS long_, EXISTS (SELECT 1 FROM keep WHERE keep.strand_id = r.strand_id AND 5 * along >= start AND 5 * along < stop) AS kept FROM r),
a AS (SELECT *, long_ AND NOT kept AS clear, CASE WHEN long_ AND NOT kept THEN path_offset WHEN along = min(along) OVER s OR along = max(along) OVER s THEN 0 END AS anchor FROM k WINDOW s AS (PARTITION BY strand_id)),
n AS (SELECT *, last_value(anchor IGNORE NULLS) OVER u AS v0, last_value(CASE WHEN anchor IS NOT NULL THEN along END IGNORE NULLS) OVER u AS a0, first_value(anchor IGNORE NULLS) OVER d AS v1, first_value(CASE WHEN anchor IS NOT NULL THEN along END IGNORE NULLS) OVER d AS a1
  FROM a WINDOW u AS (PARTITION BY strand_id ORDER BY along ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY strand_id ORDER BY along ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT strand_id, along, clear, kept, round(CASE WHEN kept THEN 0 WHEN a1 > a0 THEN v0 + (v1 - v0) * (along - a0) / (a1 - a0) ELSE v0 END, 6) + 0.0 AS "offset" FROM n""")
def h13_anchored_offsets(part: DataFrame, nation: DataFrame) -> DataFrame:
    path = part.select((F.col("p_partkey") % 3).cast("int").alias("strand_id"), F.floor(F.col("p_partkey") / 3).cast("long").alias("along"), (F.col("p_size") - 25).cast("double").alias("path_offset"), (F.col("p_size") > 12).alias("clear"))
    out = rg.anchored(path, 5.0, 20.0, nation.sparkSession.sql(_KEEP, nation=nation), size=128)
    return rounded(out.select("strand_id", "along", "clear", "kept", "offset"), "offset")


@query(None)
def h14_refined_mesh_trace(fx_pixels: DataFrame, fx_trace: DataFrame) -> DataFrame:
    """All strands, with every third one kept as it is over its first kilometre."""
    keep = fx_trace.select("strand_id").distinct().where("strand_id % 3 = 2").select("strand_id", F.lit(0.0).alias("start"), F.lit(1000.0).alias("stop"))
    out = rg.refine_mesh_trace(fx_trace, _strain(fx_pixels), 100.0, 20.0, 10.0, 60.0, 0.1, 20.0, 1.5, 60.0, keep)
    return rounded(out, "x", "y", "path_offset", "path_strain", "offset")


def _rows_across(supplier: DataFrame) -> DataFrame:
    """Centres down the middle of the raster, one for each supplier."""
    k, row0 = F.col("s_suppkey").cast("long"), 1.4 * F.col("s_suppkey")
    return supplier.select(k.alias("profile_id"), F.lit(0).alias("strand_id"), k.alias("i"), F.lit(500495.0).alias("x"), (4000000 - 10 * row0).alias("y"), row0.alias("row0"),
                           F.lit(49.5).alias("col0"), (F.col("s_suppkey") % 9 - 4).cast("double").alias("strike"))


def _aligned(px: DataFrame, supplier: DataFrame, picks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    return al.aligned_profiles(coords.clear_empty(px), _rows_across(supplier), 30, 20, 4, 24, 12.0, 6.0, 10.0, 60.0, (0.0, 100.0), (50.0, 250.0), 1.0, 8, picks)


@query(None)
def h15_fault_aligned(fx_pixels: DataFrame, supplier: DataFrame) -> DataFrame:
    """Stacked samples of displacement and strain of the whole driver; tests/test_aligned.py holds it against a planted fault."""
    out, _, _ = _aligned(fx_pixels, supplier)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(None)
def h15_fault_aligned_records(fx_pixels: DataFrame, supplier: DataFrame) -> DataFrame:
    """The driver's record and refined place of each profile."""
    _, records, trace = _aligned(fx_pixels, supplier)
    out = records.join(trace, "profile_id")
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(None)
def h15_picked_aligned(fx_pixels: DataFrame, supplier: DataFrame) -> DataFrame:
    """The driver with each profile as a pick, whose second shift is its own."""
    picks = supplier.select(F.lit(0).alias("strand_id"), F.col("s_suppkey").cast("long").alias("i"))
    out, records, _ = _aligned(fx_pixels, supplier, picks)
    out = out.join(records.select("profile_id", "total_shift", "offset_near", "width"), "profile_id")
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(f"WITH {_SHIFT}, q AS (SELECT *, quantile_cont(shift, 0.25) OVER w AS l, quantile_cont(shift, 0.75) OVER w AS h FROM z WINDOW w AS (PARTITION BY strand ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT i, strand, round(CASE WHEN shift BETWEEN l - 0.5 * (h - l) AND h + 0.5 * (h - l) THEN shift END, 6) AS shift FROM q")
def h16_iqr_filter(part: DataFrame) -> DataFrame:
    return rounded(rl.iqr_filter(_shifts(part), ["strand"], "i", "shift", 5, 0.5), "shift")


@query(f"WITH {_PTS}, m AS (SELECT *, abs(par - quantile_cont(par, 0.5) OVER (PARTITION BY profile_id)) AS d FROM e), s AS (SELECT *, d <= 0.5 * 1.4826 * quantile_cont(d, 0.5) OVER (PARTITION BY profile_id) AS inside FROM m), c AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY profile_id) AS k FROM s) SELECT profile_id, event_id FROM c WHERE k < 4 OR inside")
def h17_robust_subset(fx_profile_points: DataFrame) -> DataFrame:
    return rl.robust_subset(fx_profile_points.select("profile_id", "event_id", "par"), "profile_id", "par", 0.5, 4).select("profile_id", "event_id")


@query(f"""WITH {_SHIFT}, o AS (SELECT *, row_number() OVER (PARTITION BY strand ORDER BY i) AS r, count(*) OVER (PARTITION BY strand) AS n FROM z), j AS (SELECT a.i, a.strand, b.shift FROM o a, range(-2, 3) AS s(d), o b WHERE b.strand = a.strand AND b.r = least(greatest(a.r + d, 1), a.n)) SELECT i, strand, round(quantile_cont(shift, 0.5), 6) AS shift FROM j GROUP BY i, strand""")
def h18_median_filter(part: DataFrame) -> DataFrame:
    return rounded(rl.median_filter(_shifts(part), ["strand"], "i", "shift", 2), "shift")


@query(f"WITH {_PTS}, m AS (SELECT *, quantile_cont(par, 0.5) OVER (PARTITION BY profile_id) AS med FROM e) SELECT profile_id, round(any_value(med), 6) AS med, round(1.4826 * quantile_cont(abs(par - med), 0.5), 6) AS rstd FROM m GROUP BY profile_id")
def h19_robust_std(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(sw.robust_std(fx_profile_points, ["profile_id"], "par"), "med", "rstd")


@query(f"WITH {_SHIFT}, w AS (SELECT strand, shift, exp(-0.5 * ((row_number() OVER (PARTITION BY strand ORDER BY i) - 1 - (count(*) OVER (PARTITION BY strand) - 1) / 2) / 40.0) ** 2) AS w FROM z) SELECT strand, round(sum(w * shift) / sum(w), 6) AS mean FROM w GROUP BY strand")
def h20_gaussian_weighted_mean(part: DataFrame) -> DataFrame:
    return rounded(rl.gaussian_weighted_mean(_shifts(part), "strand", "i", "shift", 40.0), "mean")


@query(f"WITH {_SHIFT}, d AS (SELECT strand, (1 + i % 3) * abs(shift - lag(shift) OVER (PARTITION BY strand ORDER BY i)) AS d FROM z) SELECT strand, round(sum(d), 6) AS tv FROM d GROUP BY strand")
def h21_total_variation(part: DataFrame) -> DataFrame:
    return rounded(rl.total_variation(_shifts(part), "strand", "i", "shift", 1 + F.col("i") % 3), "tv")


@query("SELECT p_partkey, round(3 / (1 + exp(-0.2 * (p_size - 25))) ** 0.5, 6) AS v FROM part")
def h22_sigmoid(part: DataFrame) -> DataFrame:
    return rounded(part.select("p_partkey", rl.sigmoid(F.col("p_size"), 3.0, 25.0, 0.2, 2.0).alias("v")), "v")


def _cubic_sql(source: str, keys: str) -> str:
    """Rows (keys, c) of cubic coefficients by power sums and elimination, from (keys, xs, par); needs WITH RECURSIVE."""
    sums = ", ".join([*(f"sum(pow(xs / 200.0, {k})) AS s{k}" for k in range(7)), *(f"sum(pow(xs / 200.0, {k}) * par) AS t{k}" for k in range(4))])
    rows = ", ".join("[" + ", ".join([*(f"s{i + j} + {1e-12 if i == j else 0}" for j in range(4)), f"t{i}"]) + "]" for i in range(4))
    return f"""{source}_p AS (SELECT {keys}, {sums} FROM {source} GROUP BY {keys} HAVING count(*) >= 5), {source}_e AS (SELECT {keys}, 0 AS k, [{rows}] AS a FROM {source}_p UNION ALL
  SELECT {keys}, k + 1, list_transform(range(1, 5), lambda i: CASE WHEN i = k + 1 THEN list_transform(a[k + 1], lambda x: x / a[k + 1][k + 1]) ELSE list_transform(range(1, 6), lambda j: a[i][j] - a[i][k + 1] / a[k + 1][k + 1] * a[k + 1][j]) END) FROM {source}_e WHERE k < 4),
{source}_c AS (SELECT {keys}, a[1][5] AS p0, a[2][5] AS p1, a[3][5] AS p2, a[4][5] AS p3 FROM {source}_e WHERE k = 4)"""


_AT = "(p0 + xs / 200.0 * (p1 + xs / 200.0 * (p2 + xs / 200.0 * p3)))"


@query(f"""WITH RECURSIVE {_PTS}, o AS (SELECT * FROM e WHERE abs(xs) >= 20), lim AS (SELECT profile_id, CAST(0.2 AS DOUBLE) * stddev_pop(par) AS lim FROM o GROUP BY profile_id),
dr AS (SELECT profile_id, event_id, trial, xs, par FROM o, range(0, 8) AS t(trial) WHERE {sql_uniform("concat('5:', profile_id, ':', event_id, ':', trial)")} < 0.6), {_cubic_sql('dr', 'profile_id, trial')},
v AS (SELECT profile_id, trial, count(*) FILTER (abs(par - {_AT}) <= lim) AS k, round(sum(CASE WHEN abs(par - {_AT}) <= lim THEN (par - {_AT}) ** 2 ELSE 0 END), 9) AS ss FROM o JOIN dr_c USING (profile_id) JOIN lim USING (profile_id) GROUP BY ALL),
b AS (SELECT profile_id, trial FROM v WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY k DESC, ss, trial) = 1),
ag AS (SELECT profile_id, xs, par FROM o JOIN b USING (profile_id) JOIN dr_c USING (profile_id, trial) JOIN lim USING (profile_id) WHERE abs(par - {_AT}) <= lim), {_cubic_sql('ag', 'profile_id')},
fc AS (SELECT * FROM ag_c UNION ALL SELECT profile_id, p0, p1, p2, p3 FROM b JOIN dr_c USING (profile_id, trial) WHERE profile_id NOT IN (SELECT profile_id FROM ag_c)),
r AS (SELECT profile_id, 1 - sum((par - {_AT}) ** 2) / nullif(var_pop(par) * count(*), 0) AS r2 FROM ag JOIN fc USING (profile_id) GROUP BY profile_id), th AS (SELECT profile_id, 2 * stddev_pop(par - {_AT}) AS threshold FROM o JOIN fc USING (profile_id) GROUP BY profile_id)
SELECT e.profile_id, event_id, round(par - coalesce({_AT}, 0), 6) AS par_res, round(coalesce(threshold, 0), 6) AS threshold, round(r2, 6) AS r2 FROM e LEFT JOIN fc USING (profile_id) LEFT JOIN th USING (profile_id) LEFT JOIN r USING (profile_id)""")
def i1_detrend(fx_profile_points: DataFrame) -> DataFrame:
    out = an.detrend(fx_profile_points.select("profile_id", "event_id", "xs", "par"), "par", 20.0, 200.0, trials=8)
    return rounded(out.select("profile_id", "event_id", "par_res", "threshold", "r2"), "par_res", "threshold", "r2")


@query(f"WITH {_PTS}, z AS (SELECT profile_id, max(CASE WHEN abs(nrm) < 0.04 AND xs <= 0 THEN xs END) AS x_min, min(CASE WHEN abs(nrm) < 0.04 AND xs >= 0 THEN xs END) AS x_max FROM e GROUP BY profile_id) SELECT profile_id, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(x_max - x_min, 6) AS width FROM z")
def i2_zone_width(fx_profile_points: DataFrame) -> DataFrame:
    return rounded(an.zone_width(fx_profile_points.withColumn("s", F.abs("nrm")), "s", F.lit(0.04)), "x_min", "x_max", "width")


_OFF = f"""{_PTS}, z AS (SELECT *, CASE WHEN xs BETWEEN 5 AND 150 THEN 'r' WHEN xs BETWEEN -150 AND -5 THEN 'l' END AS side FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY profile_id, side ORDER BY xs, event_id) AS r, count(*) OVER w AS n, 1.2 * stddev_pop(par) OVER w AS lim FROM z WHERE side IS NOT NULL WINDOW w AS (PARTITION BY profile_id, side)),
h0 AS (SELECT profile_id, side, n, trial, 1 + floor({sql_uniform("concat('9:', profile_id, ':', side, ':', trial, ':0')")} * n) AS i, 1 + floor({sql_uniform("concat('9:', profile_id, ':', side, ':', trial, ':1')")} * (n - 1)) AS j FROM a, range(0, 12) AS t(trial) WHERE r = 1 AND n >= 2),
h1 AS (SELECT h.profile_id, h.side, h.trial, p.xs AS xi, p.par AS yi, q.xs AS xj, q.par AS yj FROM h0 h JOIN a p ON p.profile_id = h.profile_id AND p.side = h.side AND p.r = h.i JOIN a q ON q.profile_id = h.profile_id AND q.side = h.side AND q.r = CASE WHEN h.j >= h.i THEN h.j + 1 ELSE h.j END),
h AS (SELECT profile_id, side, trial, (yj - yi) / (xj - xi) AS m, yi - (yj - yi) / (xj - xi) * xi AS b FROM h1 WHERE xi <> xj),
v AS (SELECT profile_id, side, trial, count(*) FILTER (abs(par - b - m * xs) <= lim) AS k, round(sum(CASE WHEN abs(par - b - m * xs) <= lim THEN (par - b - m * xs) ** 2 ELSE 0 END), 9) AS ss FROM a JOIN h USING (profile_id, side) GROUP BY ALL),
c AS (SELECT profile_id, side, trial FROM v WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY profile_id, side ORDER BY k DESC, ss, trial) = 1),
f AS (SELECT profile_id, side, regr_slope(par, xs) AS m, regr_intercept(par, xs) AS b FROM a JOIN c USING (profile_id, side) JOIN h USING (profile_id, side, trial) WHERE abs(par - h.b - h.m * xs) <= lim GROUP BY ALL),
g AS (SELECT profile_id, side, any_value(b) AS b, stddev_pop(par - b - m * xs) AS s, min(xs) AS x0, max(xs) AS x1 FROM a JOIN f USING (profile_id, side) WHERE m IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_OFF} SELECT profile_id, round(coalesce(max(b) FILTER (side = 'r'), 0) - coalesce(max(b) FILTER (side = 'l'), 0), 6) AS "offset", round(sqrt(sum(s * s)), 6) AS std,
round(max(x0) FILTER (side = 'l'), 6) AS left_first, round(max(x1) FILTER (side = 'l'), 6) AS left_last, round(max(x0) FILTER (side = 'r'), 6) AS right_first, round(max(x1) FILTER (side = 'r'), 6) AS right_last FROM g GROUP BY profile_id""")
def i3_offset(fx_profile_points: DataFrame) -> DataFrame:
    at = fx_profile_points.withColumns({"x_min": F.lit(0.0), "x_max": F.lit(0.0)})
    return rounded(an.offset(at, "par", 5.0, 150.0, 1.2, 12), "offset", "std", "left_first", "left_last", "right_first", "right_last")


@query(None)
def i4_analyse_profiles(fx_profile_points: DataFrame) -> DataFrame:
    """The whole record; its parts are checked by i1, i2, i3 and g10, the record against them in tests/test_analysis.py."""
    s = fx_profile_points.select("profile_id", "event_id", "xs", "par", F.abs("nrm").alias("shear"), F.col("nrm").alias("dilatation"))
    out = an.analyse_profiles(s, 20.0, 200.0, (0.0, 150.0), (50.0, 400.0), 1.0, trials=8)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query("""WITH c AS (SELECT n_nationkey AS i, 500000.0 + 10 * n_nationkey AS x, 4000000.0 - 30 * n_nationkey + n_nationkey % 3 AS y, radians(4.0 * n_nationkey) AS s, n_regionkey - 2 AS sh FROM nation), d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER (ORDER BY i)) ** 2 + (y - lag(y) OVER (ORDER BY i)) ** 2), 0) AS d FROM c)
SELECT i AS profile_id, round(sum(d) OVER (ORDER BY i), 6) AS along, round(x - sh * cos(s), 6) AS x, round(y + sh * sin(s), 6) AS y FROM d""")
def i5_along_fault(nation: DataFrame) -> DataFrame:
    k = F.col("n_nationkey")
    centres = nation.select(F.lit(0).alias("strand_id"), k.alias("i"), k.alias("profile_id"), (500000.0 + 10 * k).alias("x"), (4000000.0 - 30 * k + k % 3).alias("y"), (4.0 * k).alias("strike"))
    return rounded(an.along_fault(centres, nation.select(k.alias("profile_id"), (F.col("n_regionkey") - 2).alias("shift"))), "along", "x", "y")
