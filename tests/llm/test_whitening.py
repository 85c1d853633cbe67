import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake.llm import whitening


def brute(vectors, k=8):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    y = y.astype(float)
    values, columns = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    deviation = [int(sum(v * v for v in row)) for row in (n * x - s).tolist()]
    return deviation, values[order], columns[:, order].T, y


def check(rows, vectors, k=8):
    """Deviations exactly, components up to sign, whitened values, shares of the trace, and the identity."""
    deviation, values, components, y = brute(vectors, k)
    total = np.var(y, axis=0).sum()
    for i, dev in enumerate(deviation):
        own = {r.component: r for r in rows if r.vec_id == i}
        assert sorted(own) == list(range(1, len(values) + 1)) and {r.deviation for r in own.values()} == {dev}
    for c in range(1, len(values) + 1):
        got = np.array([r.whitened for r in sorted((r for r in rows if r.component == c), key=lambda r: r.vec_id)])
        want = y @ components[c - 1] / np.sqrt(values[c - 1])
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-8
        assert {abs(r.explained - values[c - 1] / total) < 1e-10 for r in rows if r.component == c} == {True}
    assert all(r.n == len(vectors) and r.identity_error < 1e-10 for r in rows)


def test_against_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(500, 12)) @ np.diag(np.arange(1, 13)) + 7).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(5)
    check(whitening.whiten(df).collect(), vectors)


def test_badly_conditioned(spark):
    """Spread over five orders of magnitude in each row: their squares take half of a double's digits."""
    rng = np.random.default_rng(6)
    base, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    vectors = (rng.normal(size=(300, 9)) @ np.diag([1e6, 3e5, 1e4, 1e3, 100, 40, 20, 9, 2]) @ base).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert max(r.identity_error for r in rows) < 1e-6
    x = np.floor(1024 * np.array(vectors))
    sigma = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    share = sigma**2 / (sigma**2).sum()
    for r in rows:
        assert abs(r.explained - share[r.component - 1]) < 1e-7 * share[r.component - 1]


def test_triangular_solves_compose():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 6)) @ np.diag([1, 1e-2, 1e-4, 1e-6, 1e-7, 1e-8])
    r = whitening.cholesky(x.T @ x, 50, shifted=True)
    q, whole = whitening.solve_right(x, r), r
    for _ in range(2):
        r = whitening.cholesky(q.T @ q, 50, shifted=False)
        q, whole = whitening.solve_right(q, r), r @ whole
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-12 and np.abs(q @ whole - x).max() < 1e-12
    assert np.allclose(np.linalg.svd(whole, compute_uv=False), np.linalg.svd(x, compute_uv=False), rtol=1e-9)


def test_odd_rows(spark):
    """Nulls, NaN, infinities, empty and shorter vectors go; repeated ids, null ids and a clashing column stay or are not read."""
    rng = np.random.default_rng(8)
    good = rng.normal(size=(40, 3)).tolist()
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(1000 + i, v, "y") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component string")
    out = whitening.whiten(df).collect()
    exact = [np.array(v, np.float32).tolist() for v in good]
    check(out, exact)
    named = df.select(F.lit(None).cast("bigint").alias("vec_id"), "embedding")
    assert whitening.whiten(named).count() == 40 * 3 and whitening.whiten(named).where("vec_id is not null").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_varies(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_directions_without_variance_have_no_component(spark):
    rng = np.random.default_rng(9)
    flat = [[a, b, 3.0, 2 * a, 0.0] for a, b in rng.integers(-50, 50, size=(200, 2)).astype(float).tolist()]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(flat)), "vec_id bigint, embedding array<double>")).collect()
    assert {r.component for r in rows} == {1, 2} and abs(sum(r.explained for r in rows if r.vec_id == 0) - 1) < 1e-9
    check(rows, flat, 2)


def test_huge_entries(spark):
    """Entries are held at 2**53 steps; deviations that are no long come back null, others exact."""
    vectors = [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")).collect()
    assert len(rows) == 3 and {r.component for r in rows} == {1} or len(rows) == 6
    assert [r.deviation is None for r in sorted(rows, key=lambda r: r.vec_id) if r.component == 1][:2] == [True, True]
