"""Whitening of embeddings: projections on the leading principal components, each scaled to unit variance.

Three passes over the vectors, each a sum by task in numpy and then by Spark: exact sums of the scaled integers, the covariance
of centred vectors, and the covariance of the whitened output, which says how far it is from the identity. Only sums of
dimension times dimension reach the driver; MAX_DIM bounds them.

The eigenvectors come by spectrum slicing. By Sylvester's law the signs of D in an LDLt factorisation of V - s I count the
eigenvalues above s, so bisection isolates the k-th from the top; Rayleigh quotient iteration then converges cubically, and
counts on both sides of the quotient certify that it is the k-th. Equal eigenvalues, which no shift parts, are taken as one
invariant subspace by inverse iteration.

Defined cases: rows whose vector is null or has a null or non-finite entry are dropped, and rows whose vector is not of the
commonest length (the longer of equally common ones); vec_id may be null or repeated, each row stands for itself; components
beyond the rank of V (eigenvalues under RANK of the largest) are not returned, as nothing scales them to 1, so equal vectors
alone give no row; an empty table gives none. A sum or deviation that a long can't hold raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
MAX_DIM = 2048
RANK = 1e-12
_ALPHA = (1 + 17**0.5) / 8


def ldl(a: np.ndarray) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Bunch-Kaufman factorisation of a symmetric matrix: steps of (rows of the pivot, pivot block, multipliers of all rows)."""
    a, left, steps = a.copy(), list(range(len(a))), []
    while left:
        rows = np.array(left)
        i = left[0]
        rest = rows[1:]
        pivot = [i]
        if len(rest):
            r = rest[np.abs(a[rest, i]).argmax()]
            most = abs(a[r, i])
            if most and abs(a[i, i]) < _ALPHA * most:
                other = rows[rows != r]
                sigma = np.abs(a[other, r]).max()
                if abs(a[i, i]) * sigma >= _ALPHA * most * most:
                    pass
                elif abs(a[r, r]) >= _ALPHA * sigma:
                    pivot = [int(r)]
                else:
                    pivot = [i, int(r)]
        block = a[np.ix_(pivot, pivot)].copy()
        left = [k for k in left if k not in pivot]
        multipliers = np.zeros((len(a), len(pivot)))
        if left and np.any(block):
            col = a[np.ix_(left, pivot)]
            multipliers[left] = np.linalg.solve(block, col.T).T
            a[np.ix_(left, left)] -= multipliers[left] @ col.T
        steps.append((pivot, block, multipliers))
    return steps


def positives(steps: list) -> int:
    """Positive eigenvalues of the matrix that was factorised."""
    return sum(int((np.linalg.eigvalsh(block) > 0).sum()) if len(pivot) == 2 else int(block[0, 0] > 0) for pivot, block, _ in steps)


def solved(steps: list, b: np.ndarray, least: float) -> np.ndarray:
    """Solution of the factorised system; pivots under ``least`` count as that, as in inverse iteration."""
    x = b.astype(float).copy()
    for pivot, _, m in steps:
        x -= m @ x[pivot]
    for pivot, block, _ in steps:
        if len(pivot) == 1:
            d = block[0, 0]
            x[pivot] /= d if abs(d) > least else least
        else:
            x[pivot] = np.linalg.solve(block, x[pivot])
    for pivot, _, m in reversed(steps):
        x[pivot] -= m.T @ x
    return x


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows; fewer if it is smaller."""
    d = len(v)
    k = min(k, d)
    reach = np.abs(v).sum(1).max() if d else 0.0
    if not k or not reach:
        return np.zeros(k), np.eye(d)[:k]
    tiny, eye = np.finfo(float).eps * reach, np.eye(d)
    above = lambda s: positives(ldl(v - s * eye))
    random = np.random.default_rng(7)
    values, vectors = np.zeros(k), np.zeros((k, d))

    def apart(x: np.ndarray, done: int) -> np.ndarray:
        for _ in range(2):
            x = x - vectors[:done].T @ (vectors[:done] @ x)
        return x / np.linalg.norm(x)

    def refined(shift: float, done: int) -> tuple[float, np.ndarray]:
        x = apart(random.standard_normal(d), done)
        steps = ldl(v - shift * eye)
        for _ in range(3):
            x = apart(solved(steps, x, tiny), done)
        rho = float(x @ v @ x)
        for _ in range(8):
            x = apart(solved(ldl(v - rho * eye), x, tiny), done)
            rho, was = float(x @ v @ x), rho
            if abs(rho - was) <= tiny:
                break
        return rho, x

    # (low, high, eigenvalues above low, eigenvalues above high), the highest on top
    stack, done = [(-1.01 * reach - tiny, 1.01 * reach + tiny, d, 0)], 0
    while stack and done < k:
        low, high, n_low, n_high = stack.pop()
        if n_low == n_high:
            continue
        narrow = high - low <= 16 * tiny
        if n_low - n_high == 1 or narrow:
            trial = []
            for _ in range(n_low - n_high):
                if done < k:
                    rho, x = refined((low + high) / 2, done)
                    trial.append(rho)
                    values[done], vectors[done] = rho, x
                    done += 1
            if narrow:
                continue
            rho, width = trial[0], 64 * tiny
            if low - width <= rho <= high + width and above(rho - width) >= done and above(rho + width) < done:
                continue  # certified: the eigenvalue with this number lies within ``width``
            done -= 1
        middle = (low + high) / 2
        n = above(middle)
        stack += [(low, middle, n_low, n), (middle, high, n, n_high)]
    order = np.argsort(-values[:done], kind="stable")
    vectors = vectors[:done][order]
    at = np.abs(vectors).argmax(1)
    return values[:done][order], vectors * np.sign(vectors[np.arange(done), at])[:, None]


def _vectors(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each part of a batch and its scaled integer vectors."""
    for whole in batches:
        for a in range(0, len(whole), rows):
            batch = whole.slice(a, rows)
            c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dim)
            x = np.floor(SCALE * c)
            if len(x) and np.abs(x).max() >= 2.0**62:
                raise OverflowError("an entry is too large for a long")
            yield batch, x.astype(np.int64) + SHIFT


def _matrix(value: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(value.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(value.ravel())], ["i", "j", "value"])


def _summed(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, object if dict(df.dtypes)["value"] == "bigint" else float)
    for r in df.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n without the loss of a large common part: the whole part goes in integers."""
    whole, rest = zip(*(divmod(s, n) for s in sums))
    return (x - np.array(whole, np.int64)) - np.array(rest, float) / n


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows to fit on, and their dimension."""
    good = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    lengths = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dim = lengths[0]["size"] if lengths else 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIM}")
    return good.where(F.size("embedding") == dim), dim


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """For each usable row of ``vectors(vec_id, embedding)`` and each component its whitened coordinate; see the module."""
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dim = usable(vectors.select("vec_id", "embedding"))
    empty = vectors.sparkSession.createDataFrame([], out)
    if not dim:
        return empty
    only = rows.select("embedding")

    def add_up(batches):
        total, n = np.zeros(dim, np.int64), 0
        for _, x in _vectors(batches, dim):
            total, n = total + x.sum(0), n + len(x)
        yield _matrix(np.append(total, n)[None, :])

    first = _summed(only.mapInArrow(add_up, "i int, j int, value long"), (1, dim + 1))[0]
    sums, n = [int(s) for s in first[:dim]], int(first[dim])

    def scatter(batches):
        total = np.zeros((dim + 1, dim))
        for _, x in _vectors(batches, dim):
            c = centred(x, n, sums)
            total[:dim] += c.T @ c
            total[dim] += c.sum(0)
        yield _matrix(total)

    second = _summed(only.mapInArrow(scatter, "i int, j int, value double"), (dim + 1, dim))
    v = second[:dim] / n
    v = (v + v.T) / 2
    values, basis = leading_pairs(v, components)
    keep = values > RANK * max(values.max(initial=0.0), 0.0)
    values, basis = values[keep], basis[keep]
    if not len(values):
        return empty
    scaled, trace = basis / np.sqrt(values)[:, None], float(np.trace(v))
    offset = scaled @ (second[dim] / n)  # the mean of the whitened rows, 0 up to rounding

    def check(batches):
        total = np.zeros((len(values), len(values)))
        for _, x in _vectors(batches, dim):
            z = centred(x, n, sums) @ scaled.T - offset
            total += z.T @ z
        yield _matrix(total)

    covariance = _summed(only.mapInArrow(check, "i int, j int, value double"), (len(values), len(values))) / n
    error = float(np.abs(covariance - np.eye(len(values))).max())
    explained = values / trace

    def emit(batches):
        m = len(values)
        for batch, x in _vectors(batches, dim):
            far = n * (x - np.array([s // n for s in sums])) - np.array([s % n for s in sums])
            if len(far) and (far.astype(float) ** 2).sum(1).max() >= 2.0**63:
                raise OverflowError("a deviation is too large for a long")
            k, z = len(batch), centred(x, n, sums) @ scaled.T
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(k), m))), pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()), pa.array(np.full(k * m, n)),
                pa.array(np.repeat((far * far).sum(1), m)), pa.array(z.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, out)
