"""Whitened coordinates against a dense eigensolver, and the exact integers against Python's."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.helpers import SF
from tremor.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def brute(rows):
    """n, exact deviations and the covariance of the integer vectors."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dim)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(dim)) for r in x]
    c = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(dim)] for r in x])
    return n, deviations, c, c.T @ c / n


def hold(found, ids, rows, components=32):
    n, deviations, c, v = brute(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == rank * len(rows)
    z = np.zeros((len(rows), rank))
    place = {i: k for k, i in enumerate(ids)}
    for r in found:
        assert r["n"] == n and r["deviation"] == deviations[place[r["vec_id"]]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-8
        z[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(z.T @ z / n - np.eye(rank)).max() < 1e-8
    return z, c, values, vectors


def test_like_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((200, 40)) * np.geomspace(3, 0.2, 40)).astype(np.float32)
    bad = [(500, None, "x"), (501, [None] * 40, "x"), (502, [float("nan")] * 40, "x"), (503, [float("inf")] * 40, "x"), (504, [1.0] * 3, "x"), (505, [], "x")]
    found = whitening.whiten(spark.createDataFrame([*((i, v.tolist(), "x") for i, v in enumerate(rows)), *bad], SCHEMA)).collect()
    z, c, values, vectors = hold(found, range(200), rows.tolist())
    want = c @ vectors[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-7
    assert np.abs(np.abs((z * want).sum(0)) / np.linalg.norm(z, axis=0) / np.linalg.norm(want, axis=0) - 1).max() < 1e-12


def test_equal_eigenvalues_and_low_rank(spark):
    rows = [[s * (i == j) for j in range(6)] + [0.5, 0.5] for i in range(6) for s in (1.0, -1.0)]
    hold(whitening.whiten(spark.createDataFrame([(i, v, "") for i, v in enumerate(rows)], SCHEMA)).collect(), range(12), rows)
    some = [[float(i % 7), 2.0 * (i % 7), float(i % 3)] for i in range(50)]
    hold(whitening.whiten(spark.createDataFrame([(i, v, "") for i, v in enumerate(some)], SCHEMA), 2).collect(), range(50), some, 2)


def test_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "")], SCHEMA)).count() == 0
    same = [(None, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (1, [1.0, 2.0], "")]
    assert whitening.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    ids = [r["vec_id"] for r in whitening.whiten(spark.createDataFrame([*same, (2, [0.0, 2.0], "")], SCHEMA)).collect()]
    assert sorted(ids, key=str) == [1, 1, 2, None]
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [3e38], ""), (2, [0.0], "")], SCHEMA)).count()


@pytest.mark.parametrize("seed", range(4))
def test_spectrum_slicing(seed):
    rng = np.random.default_rng(seed)
    d = [5, 20, 33, 64][seed]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.concatenate([[9.0, 9.0 - 1e-9, 4.0, 4.0], rng.random(d - 4)])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.leading_pairs(v, 32)
    want = np.linalg.eigvalsh(v)[::-1][:32]
    assert np.abs(got - want).max() < 1e-13 * 100
    assert np.abs(vectors @ vectors.T - np.eye(len(got))).max() < 1e-11
    assert np.abs(v @ vectors.T - vectors.T * got).max() < 1e-12
    for s in (*want[:3], 0.5, -1.0):
        shifted = v - (s + 1e-7) * np.eye(d)
        assert whitening.positives(whitening.ldl(shifted)) == (np.linalg.eigvalsh(shifted) > 0).sum()


def test_given_vectors(spark):
    table = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    hold(queries.op13_whitening(spark, SF).collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])
