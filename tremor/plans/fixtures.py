"""Views over the driver's tables that stand for the engine's inputs. The text is valid in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

SQL = {
    "fx_pixels": """
SELECT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS row, o_orderkey % 100 AS col,
  CAST(500000 + 10 * (o_orderkey % 100) AS DOUBLE) AS x,
  CAST(4000000 AS DOUBLE) - 10 * floor(o_orderkey / 100.0) AS y,
  CASE WHEN o_orderkey % 41 = 0 THEN CAST(0 AS DOUBLE)
       ELSE (o_totalprice - 250000) / CAST(1000000 AS DOUBLE) + CASE WHEN o_orderkey % 100 >= 50 THEN 1 ELSE -1 END END AS ew,
  CASE WHEN o_orderkey % 43 = 0 THEN CAST(0 AS DOUBLE)
       ELSE (o_custkey % 1000 - 500) / CAST(2000 AS DOUBLE) + CASE WHEN o_orderkey % 100 >= 50 THEN 2 ELSE -2 END END AS ns
FROM orders""",
    "fx_trace": """
SELECT CAST(floor(c_custkey / 25.0) AS INT) AS strand_id, CAST(c_custkey % 25 AS INT) AS seq,
  CAST(500480 + 320 * (floor(c_custkey / 25.0) % 2) + 2 * (c_nationkey - 12) AS DOUBLE) AS x,
  CAST(3984000 - 16200 * floor(c_custkey / 50.0) + 675 * (c_custkey % 25) AS DOUBLE) AS y
FROM customer""",
    "fx_los": """
SELECT o_orderkey AS obs_id, CAST(-117.6 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * (o_orderkey % 100) AS lon,
  CAST(35.9 AS DOUBLE) - CAST(0.0001 AS DOUBLE) * floor(o_orderkey / 100.0) AS lat,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE (o_totalprice - 250000) / CAST(1000000 AS DOUBLE) END AS vel,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE (o_custkey % 97) / CAST(10000 AS DOUBLE) END AS err,
  CAST(0.6 AS DOUBLE) AS los_e, CAST(-0.1 AS DOUBLE) AS los_n,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(0.79 AS DOUBLE) END AS los_u
FROM orders""",
    "fx_stations": """
SELECT s_name AS sta, CAST(-117.9 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (s_suppkey % 40) AS lon,
  CAST(35.4 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (s_suppkey % 31) AS lat,
  s_acctbal / CAST(10000 AS DOUBLE) AS de, (s_nationkey - 12) / CAST(50 AS DOUBLE) AS dn,
  CAST(0.001 AS DOUBLE) * (1 + s_suppkey % 5) AS sde, CAST(0.001 AS DOUBLE) * (1 + s_suppkey % 7) AS sdn
FROM supplier""",
    "fx_profile_points": """
SELECT user_id AS profile_id, event_id,
  CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS xs,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END + (event_id % 101 - 50) / CAST(500 AS DOUBLE) AS par,
  (event_id % 89 - 44) / CAST(400 AS DOUBLE) AS nrm
FROM events""",
    "fx_patches": """
SELECT n_nationkey AS patch_id, CAST(floor(n_nationkey / 5.0) AS INT) AS cell_id,
  CAST(500000 + 40 * n_nationkey AS DOUBLE) AS x0, CAST(3999000 AS DOUBLE) AS y0, CAST(1000 + 500 * n_regionkey AS DOUBLE) AS z0,
  CAST(500040 + 40 * n_nationkey AS DOUBLE) AS x1, CAST(3999100 AS DOUBLE) AS y1, CAST(200 * n_regionkey AS DOUBLE) AS z1,
  CAST(60 + n_regionkey AS DOUBLE) AS dip_deg, 1 AS slip_sign
FROM nation""",
    "fx_vertices": """
SELECT p_partkey AS vid, CAST(500000 + 250 * (p_partkey % 20) AS DOUBLE) AS x,
  CAST(4000000 AS DOUBLE) + 100 * floor(p_partkey / 20.0) + p_size AS y,
  CAST(-400 AS DOUBLE) * floor(p_partkey / 20.0) AS z
FROM part""",
    "fx_triangles": """
SELECT 2 * v.vid + k.k AS tid, CASE WHEN k.k = 0 THEN v.vid ELSE v.vid + 1 END AS a,
  CASE WHEN k.k = 0 THEN v.vid + 1 ELSE v.vid + 21 END AS b, v.vid + 20 AS c,
  CAST(floor(v.vid / 20.0) AS INT) AS layer, CAST(CASE WHEN v.vid % 20 < 10 THEN 0 ELSE 1 END AS INT) AS fault_id
FROM (SELECT p_partkey AS vid FROM part) v CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k
WHERE v.vid % 20 < 19 AND v.vid + 21 <= (SELECT max(p_partkey) FROM part)""",
}
SAMPLES = {
    "spark": """SELECT vec_id AS sample_id, label AS step, pos AS param_idx, CAST(v AS DOUBLE) * 10 AS v
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v""",
    "duckdb": """SELECT vec_id AS sample_id, label AS step, CAST(pos - 1 AS INT) AS param_idx, CAST(embedding[pos] AS DOUBLE) * 10 AS v
FROM embeddings, range(1, 65) r(pos)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table or view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SAMPLES["spark"] if name == "fx_samples" else SQL[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b{t}\b(?!\.)", "{" + t + "}", text)
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in used})


def oracle(sql: str) -> str:
    """``sql`` with the definitions of the views that it uses in front."""
    names = [n for n in (*SQL, "fx_samples") if re.search(rf"\b{n}\b", sql)]
    heads = ", ".join(f"{n} AS ({SAMPLES['duckdb'] if n == 'fx_samples' else SQL[n]})" for n in names)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    rest = re.sub(r"(?i)^WITH (RECURSIVE )?", "", body) if body.upper().startswith("WITH ") else None
    if not heads:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}{', ' + rest if rest is not None else ' ' + body}"
