"""Every registered query of the library against its SQL equivalent on the smallest tables."""

import duckdb
import pytest

from tremor.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "-" if v is None or v != v else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


#: Columns that name a row of the queries without SQL; their values are held in test_ridge.py, test_analysis.py and test_identities.py.
KEYS = {
    "e5_fitted_covariance": ["sigma", "lam"],
    "g11_picked_swathes": ["pick_id", "bin"], "h4_replace_outliers": ["i"], "h8_second_shift": ["profile_id", "k"], "h11_ridge_path": ["strand_id", "along"], "h12_refine_trace": ["strand_id", "k"],
    "h14_refined_mesh_trace": ["strand_id", "along"], "h15_fault_aligned": ["profile_id", "k"], "h15_fault_aligned_records": ["profile_id"],
    "h15_picked_aligned": ["profile_id", "k"], "i4_analyse_profiles": ["profile_id"], "k8_noise": ["row_id"], "k12_bounded_whitened": ["col_id"]}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_oracle(spark, name):
    """Rows are there, each once, without NaN."""
    df = QUERIES[name](spark, SF)
    got = df.collect()
    keys = KEYS[name]
    assert got and len({tuple(r[k] for k in keys) for r in got}) == len(got) and all(r[k] is not None for r in got for k in keys)
    assert not any(isinstance(v, float) and v != v for r in got for v in r)
