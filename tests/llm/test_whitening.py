"""Whitening against an eigendecomposition of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relscope.llm import whitening

SCHEMA = "vec_id long, x array<long>, n int, component string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, r, 0, "") for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def check(rows, found, k):
    """Returned rows against numpy's eigenpairs of the covariance of ``rows``, by vec_id."""
    x = np.array(list(rows.values()), float)
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    whole = np.array(list(rows.values()), object)
    deviation = {i: int(d) for i, d in zip(rows, (np.square(whole * len(x) - whole.sum(axis=0))).sum(axis=1), strict=True)}
    want = c @ axes[:, :k] / np.sqrt(values[:k])
    got = np.zeros((len(x), k))
    place = {i: p for p, i in enumerate(rows)}
    for r in found:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(x) and r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-6
    assert len(found) == len(x) * k
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * sign).max() < 1e-6


def spread(seed, n, dim, power=1.0):
    rng = np.random.default_rng(seed)
    return np.floor(rng.standard_normal((n, dim)) * 300 / np.arange(1, dim + 1) ** power @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]).astype(int) + 1_000_000


@pytest.mark.parametrize("dim, k", [(6, 32), (20, 3), (90, 4)])
def test_against_numpy(spark, dim, k):
    x = spread(dim, 300, dim).tolist()
    found = whitening.whiten(table(spark, x), F.col("x"), k).collect()
    check(dict(enumerate(x)), found, min(k, dim))


def test_passes_are_certified():
    rng = np.random.default_rng(1)
    for power in (0.02, 0.5, 1.5):
        dim, k = 150, 6
        q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        v = q @ np.diag(1 / np.arange(1, dim + 1) ** power) @ q.T
        blocks = []

        def multiply(b, v=v, blocks=blocks):
            blocks.append(b.shape[1])
            return v @ b

        values, axes = whitening.eigenpairs(multiply, dim, k)
        assert np.abs(values - 1 / np.arange(1, k + 1) ** power).max() < 1e-10
        assert np.linalg.norm(v @ axes - axes * values, axis=0).max() < 1e-11
        assert blocks[0] == 2 * k and len(blocks) < 150


def test_odd_rows_and_ranks(spark):
    rows = spread(3, 40, 4).tolist()
    odd = [None, [], [1, None, 2, 3], [1, 2], [1 << 60, 0, 0, 0]]
    some = table(spark, rows + odd).unionByName(spark.createDataFrame([(None, rows[0], 0, "")], SCHEMA))
    found = whitening.whiten(some, F.col("x"), 4).collect()
    own = {i: r for i, r in enumerate(rows)} | {None: rows[0]}
    check(own, found, 4)
    flat = [[r[0], r[1], 5, r[0]] for r in rows]  # of rank 2
    found = whitening.whiten(table(spark, flat), F.col("x"), 4).collect()
    assert {r.component for r in found} == {1, 2} and max(r.identity_error for r in found) < 1e-6
    for nothing in ([], [[1, 2]], [[3, 4]] * 5, [None]):
        assert whitening.whiten(table(spark, nothing, 1), F.col("x")).collect() == []


def test_exact_beyond_a_long(spark):
    rows = [[(-1) ** i * (1 << 50) + i, i * i] for i in range(30)]
    found = whitening.whiten(table(spark, rows), F.col("x"), 2).collect()
    # The second component has under 1e-13 of the trace.
    assert all(r.deviation is None for r in found) and len(found) == 30
