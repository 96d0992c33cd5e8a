import numpy as np
import pytest

from memlayer.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """By a full covariance matrix in numpy: ids, whole numbers, eigenvalues, directions."""
    kept = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64) + 100_000) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept])
    c = (len(x) * x - x.sum(axis=0)) / len(x)
    values, directions = np.linalg.eigh(c.T @ c / len(x))
    return [i for i, _ in kept], x, c, values[::-1], directions[:, ::-1]


def check(spark, rows, count=8):
    ids, x, c, values, directions = plain(rows)
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA), count).collect()
    n = len(ids)
    d = [sum(int(v) ** 2 for v in n * row - x.sum(axis=0)) for row in x]
    k = min(count, x.shape[1], int((values > 1e-9 * values[0]).sum()))
    assert sorted((r.vec_id, r.component) for r in out) == sorted((i, j + 1) for i in ids for j in range(k))
    at = {i: j for j, i in enumerate(ids)}
    got = np.zeros((n, k))
    for r in out:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == d[at[r.vec_id]] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    return got, c, values, directions, k


def test_whitened_rows_equal_those_of_the_full_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 24)) * np.linspace(3, 0.1, 24)
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(900, None), (901, [None] + [1.0] * 23), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, [])]
    got, c, values, directions, k = check(spark, rows)
    for j in range(k):
        want = c @ directions[:, j] / np.sqrt(values[j])
        assert min(np.abs(want - got[:, j]).max(), np.abs(want + got[:, j]).max()) < 1e-7


def test_few_rows_few_dimensions_repeated_rows(spark):
    rng = np.random.default_rng(2)
    few = [(int(i), [float(v) for v in row]) for i, row in enumerate(rng.standard_normal((5, 12)))]
    check(spark, few)
    check(spark, [(int(i), [float(v) for v in row]) for i, row in enumerate(rng.standard_normal((40, 3)))])
    assert whitening.whiten(spark.createDataFrame(few[:1] * 4, SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame(few + few, SCHEMA)).count() == 2 * len(few) * 4


def test_empty_table_other_lengths_and_clashing_columns(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in row], 1, 2) for i, row in enumerate(rng.standard_normal((30, 4)))] + [(99, [1.0] * 5, 1, 2), (None, [1.0, 2.0, 3.0, 4.0], 1, 2)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA + ", x long, n long")).collect()
    assert {r.vec_id for r in out} == {*range(30), None} and {r.n for r in out} == {31}


def test_subspace_iteration_restarts_and_certifies():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 400))
    q = np.linalg.qr(a)[0]
    m = (q * np.concatenate([np.linspace(2, 1.2, 12), np.linspace(1, 0.01, 388)])) @ q.T
    directions, values, passes = whitening.leading(lambda b: m @ b, 400, 8, blocks=3)
    assert passes < 60 and np.allclose(values, np.linspace(2, 1.2, 12)[:8], rtol=1e-12)
    assert np.abs(np.abs((directions * q[:, :8]).sum(axis=0)) - 1).max() < 1e-10


def test_deviations_beyond_a_long():
    n, x = 10**10, np.array([[1, 2], [10**5, 10**5]])
    assert whitening.deviation(x, np.array([0, 0]), n) == [None, None]
    assert whitening.deviation(x, np.array([0, 0]), 10) == [500, 2 * 10**12]
    assert whitening.deviation(np.array([[3 * 10**9, 0]]), np.array([0, 0]), 1) == [9 * 10**18]
