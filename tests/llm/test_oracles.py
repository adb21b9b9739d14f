"""Every query of this subpackage that has SQL against it, on the smallest tables."""

import duckdb
import pytest

from tests.llm.helpers import SF
from tremor.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want.fetchall()))
