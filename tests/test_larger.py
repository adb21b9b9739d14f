"""Queries on tables beyond the given ones: far from the origin, beyond a strand's ends, and in plans that hold at size."""

import os

import duckdb
import pytest

from tests.test_oracles import SF, TABLES, rows
from tremor.operators import picked, relocate
from tremor.plans.registry import ORACLES, QUERIES


def made(folder, **tables):
    """A folder of tables: those given by SQL over the tables of sf0.001, and the rest of these as they are."""
    for t in TABLES:
        if t in tables:
            duckdb.sql(tables[t].format(sf=SF)).write_parquet(f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    return str(folder)


def wanted(name, folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = c.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    return columns, rows(columns, found.fetchall())


def same(spark, name, folder):
    columns, want = wanted(name, folder)
    df = QUERIES[name](spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(columns) and got == want
    return want


def test_strike_due_north_far_from_the_origin(spark, tmp_path):
    """A strand whose covariance at k = 2 is exactly 0 but for the noise of the places' last bits."""
    nations = [15, 6, 15, 6, 2, 6, 6, 3, 0, 23, 12, 10, 23, 5, 10, 21, 15, 9, 6, 0, 2, 4, 19, 15, 10]
    values = ", ".join(f"({438300 + k}, {n})" for k, n in enumerate(nations))
    folder = made(tmp_path, customer=f"SELECT CAST(k AS BIGINT) AS c_custkey, CAST(n AS INT) AS c_nationkey FROM (VALUES {values}) t(k, n)")
    same(spark, "c8_fit_strike", folder)


def test_place_beyond_the_strand_is_no_pick(spark, tmp_path):
    """Pixels around the strand's start, which places before it were moved to."""
    orders = "SELECT * FROM '{sf}/orders.parquet' UNION ALL SELECT * REPLACE (o_orderkey + 159000 AS o_orderkey) FROM '{sf}/orders.parquet'"
    supplier = "SELECT * REPLACE (s_suppkey * 180 AS s_suppkey) FROM '{sf}/supplier.parquet' UNION ALL SELECT * REPLACE (1590 + s_suppkey AS s_suppkey) FROM '{sf}/supplier.parquet'"
    want = same(spark, "g14_ensemble", made(tmp_path, orders=orders, supplier=supplier))
    assert want


def test_gaps_are_filled_by_frames_that_grow(spark):
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate([0, 2, 0, 0, 8, 0, 5, 0])], "g int, k int, shift double")
    out = relocate.fill_failed(df, ["g"], "k")
    assert [r.shift for r in out.orderBy("k").collect()] == [0, 2, 4, 6, 8, 6.5, 5, 0]
    # a frame up to the group's end is read anew for each row, the square of the group in all
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_not_broadcast(spark):
    """The pixels' table is small enough to broadcast, its 24 neighbours a pixel are not; Spark takes the one for the other."""
    text = plan(QUERIES["f10_delta_or_majority"](spark, SF))
    assert "SortMergeJoin [row" in text and "Broadcast" not in text


@pytest.mark.parametrize("name", ["b10_near_trace", "c12_corridor", "f4_corridor_strain"])
def test_cells_of_segments_are_not_broadcast(spark, name):
    """A segment becomes a row for each cell that it can reach."""
    text = plan(QUERIES[name](spark, SF))
    assert "SortMergeJoin [_cx" in text and "BroadcastHashJoin [_cx" not in text


def test_picks_at_one_place_are_worked_out_once(spark):
    rows_ = [(7, 0.0, 1.0, 2.0, -9.0, 9.0), (3, 0.0, 1.0, 2.0, -9.0, 9.0), (4, 0.0, 1.0, 182.0, -9.0, 9.0), (5, 0.0, 1.0, 2.0, -9.0, None), (6, 0.0, 1.0, 2.0, -9.0, None)]
    one, alike = picked._one_of_alike(spark.createDataFrame(rows_, "pick_id int, x double, y double, strike double, lo double, hi double"))
    assert sorted(r.pick_id for r in one.collect()) == [3, 4, 5]
    assert sorted(map(tuple, alike.collect())) == [(3, 3), (4, 4), (5, 5), (6, 5), (7, 3)]
