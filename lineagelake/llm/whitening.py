"""Whitening components of embeddings by shifted CholeskyQR.

Rows become fixed-point integers, so the column sums are exact, and are centred before anything is
multiplied.  A pass over all rows adds up a Gram matrix, one a task; the driver factors it, R'R = G, and
the next pass orthogonalises the rows by triangular solves with every R so far.  The first factor is
taken of G plus a small shift, which keeps it positive definite however badly conditioned the rows
are; the passes after it remove what the shift left.  X = Q R with R the product of the factors, so the
singular values and right vectors of R are those of X, without the loss of digits of an
eigen-decomposition of X'X.  The driver holds matrices of dims x dims, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: A row's entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Gram passes: one shifted, two that repair it.
PASSES = 3
#: Beyond 2**53, doubles no longer tell neighbouring integers apart: entries are held at that.
LIMIT = 2.0**53
_LONG = 1 << 63
_EPS = float(np.finfo(np.float64).eps)


@dataclass
class Whitening:
    """What the passes have found of the rows' ``dims`` dimensions."""

    dims: int = 0
    n: int = 0
    sums: list[int] = field(default_factory=list)
    #: Upper triangular factors, in the order in which rows are solved through them.
    factors: list[np.ndarray] = field(default_factory=list)
    #: Unit rows, by falling eigenvalue; empty where nothing varies.
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float = 0.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows whose vector is not null and has finite entries only."""
    infinite = F.lit(float("inf"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < infinite))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & finite)


def fixed_point(column: pa.Array, dims: int) -> np.ndarray:
    """The integers of a batch of vectors, one row each."""
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(SCALE * entries), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def _spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in longs where they fit, else in Python's integers."""
    if x.size and n * int(np.abs(x).max()) < _LONG >> 2 and max(map(abs, sums)) < _LONG >> 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_spread(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - sums)**2; none where it is no long."""
    y = _spread(x, n, sums)
    if y.dtype == object or y.size and int(np.abs(y).max()) ** 2 * y.shape[1] >= _LONG:
        exact = (sum(int(v) ** 2 for v in row) for row in y.tolist())
        return [v if v < _LONG else None for v in exact]
    return (y * y).sum(axis=1).tolist()


def solve_right(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = X, R upper triangular: column by column."""
    q = np.empty_like(x)
    for j in range(r.shape[0]):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def cholesky(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """Upper R with R'R = gram, plus a shift a little above the rounding errors of the Gram matrix of
    that many rows if ``shifted`` or if the matrix is not positive definite without one."""
    d = gram.shape[0]
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (rows * d + d * (d + 1)) * _EPS / 2 * float(np.linalg.norm(gram, 2))
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def _dimension(rows: DataFrame) -> int:
    """The most frequent length (the largest of several); 0 without vectors."""
    found = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    return found["dims"] if found else 0


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for b in batches:
            x = fixed_point(b.column(0), dims)
            total, n = [t + int(s) for t, s in zip(total, x.sum(axis=0))], n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["i", "n", "s"])

    found = map_batches(rows.select("v"), run, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by = {r["i"]: r for r in found}
    return by[0]["n"], [int(by[i]["s"]) for i in range(dims)]


def _gram(rows: DataFrame, fit: Whitening, project: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows, solved through the factors so far; or that of their
    projections on the columns of ``project``, with a last column of ones for their sums."""
    sent = rows.sparkSession.sparkContext.broadcast((fit.dims, fit.n, fit.sums, fit.factors, project))
    d = fit.dims if project is None else project.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, n, sums, factors, onto = sent.value
        total = np.zeros((d, d))
        for b in batches:
            q = centred(fixed_point(b.column(0), dims), n, sums)
            if onto is not None:
                q = np.column_stack((q @ onto, np.ones(len(q))))
            else:
                for r in factors:
                    q = solve_right(q, r)
            total += q.T @ q
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    out = np.zeros((d, d))
    for r in map_batches(rows.select("v"), run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def fit(rows: DataFrame, components: int = COMPONENTS, passes: int = PASSES) -> Whitening:
    """The whitening of ``usable`` rows.

    A direction in which nothing varies gets no component, so there may be fewer than asked for: none if all
    vectors are equal or the table is empty.  Of equal eigenvalues, any orthogonal basis comes.
    """
    found = Whitening(dims=_dimension(rows))
    if not found.dims:
        return found
    rows = rows.where(F.size("v") == found.dims)
    found.n, found.sums = _sums(rows, found.dims)
    whole = np.eye(found.dims)
    for k in range(passes):
        gram = _gram(rows, found)
        if k == 0:
            found.trace = float(np.trace(gram)) / found.n
            if found.trace == 0:
                return found
        r = cholesky(gram, found.n, shifted=k == 0)
        found.factors.append(r)
        whole = r @ whole
    _, sigma, right = np.linalg.svd(whole)
    held = int((sigma > sigma[0] * found.dims * _EPS).sum())
    right, sigma = right[: min(held, components)], sigma[: min(held, components)]
    # one sign for all rows: the entry of largest magnitude is positive
    signs = np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])
    right = right * signs[:, None]
    eigen = sigma**2 / found.n
    gram = _gram(rows, found, (right / np.sqrt(eigen)[:, None]).T)
    means = gram[-1, :-1] / found.n
    covariance = gram[:-1, :-1] / found.n - np.outer(means, means)
    real = np.diag(covariance) > 0.5  # what only the shift put there has no variance
    found.components, found.eigenvalues = right[real], eigen[real]
    covariance = covariance[np.ix_(real, real)]
    found.identity_error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    return found


def transform(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row a vector and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    k = len(fitted.components)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        onto = (f.components / np.sqrt(f.eigenvalues)[:, None]).T
        explained = f.eigenvalues / f.trace
        for b in batches:
            x = fixed_point(b.column(1), f.dims)
            m, each = len(x), np.repeat(np.arange(len(x)), k)
            out = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, f.n), pa.int64())]
            out += [pa.array(deviations(x, f.n, f.sums), pa.int64()).take(pa.array(each)), pa.array((centred(x, f.n, f.sums) @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, f.identity_error))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows.where(F.size("v") == fitted.dims).select("vec_id", "v"), run, schema)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``transform`` of the usable vectors by their own fit.

    Rows with a null vector, or one with a null, infinite or NaN entry, are dropped; so are empty vectors and
    those of another length than the most frequent one.  Null and repeated ids are rows like others.  A deviation
    beyond a long is null.  Other columns of the table are not read, whatever their names.
    """
    rows = usable(vectors, id_col, vector_col)
    return transform(rows, fit(rows, components))
