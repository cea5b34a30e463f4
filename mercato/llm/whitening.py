"""Embedding whitening by shifted CholeskyQR (operator 12).

Every entry c of a vector becomes the whole number x = floor(64 c) + 1000000, so sums are
exact.  The centred rows A = x - mean are never stored.  A Gram pass adds up Q'Q
over all rows, with Q = A at first; the Cholesky factor of the Gram matrix is R,
and from then on rows are orthogonalised on the way through
triangular solves by every R so far (Q = A R1^-1 R2^-1 ...).  The first factor is of the
shifted matrix, which exists however badly conditioned the rows are; passes
go on until the Gram matrix is the identity to rounding, three as a rule.  The composed
R = ... R2 R1, corrected by the root of the last Gram matrix (the identity, or
less where columns depend on each other), has the singular values and right
vectors of A: covariance eigenvalues are s^2 / n, components the right vectors.

``whiten`` gives each row's whitened values; a last pass measures their
covariance against the identity.

Defined cases: null vectors and those holding null or non-finite parts, or parts of
2^40 and more, take no part; empty vectors neither; of vectors of several lengths
those of the commonest length (ties: the shorter) are the fit list; components without variance
(their deviation below 1e-6 of the largest: fewer rows than parts, constant or
dependent parts) are not returned; identity_error covers the components up to
``components``; a deviation that does not fit a long is null; repeated
rows and ids, and null ids, are rows of their own; no rows give no rows; only the
id and vector columns are read.  The driver holds matrices of length x length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS, MAX_PASSES = 32, 8
SCALE, OFFSET, LIMIT = 64, 1_000_000, 2.0 ** 40
#: Least deviation along a component, as a part of the largest.
RANK = 1e-6
#: Partial matrices are added up in so many groups before the last sum.
GROUPS = 64
LONG = 2 ** 63


def fit_rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): vectors that can take part, of any length."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    return (rows.select(F.col(id_col).cast("long").alias("id"),
                        F.col(vector_col).cast("array<double>").alias("v"))
            .where("v IS NOT NULL AND size(v) > 0").where(~F.coalesce(bad, F.lit(True))))


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * v).astype(np.int64) + OFFSET


@dataclass
class Sums:
    """Rows of the fit list and per-part sums of x, exact."""

    n: int
    total: list[int]

    def mean(self) -> np.ndarray:
        whole = [s // self.n for s in self.total]
        return np.array(whole, float) + np.array(
            [(s - w * self.n) / self.n for s, w in zip(self.total, whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean, the difference of the whole numbers taken first."""
        whole = [s // self.n for s in self.total]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.total, whole)])
        return (x - np.array(whole, np.int64)) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over parts of (n x - S)^2, exact."""
        far = max((abs(self.n * int(m) - s) for r in (x.min(0), x.max(0))
                   for m, s in zip(r, self.total)), default=0)
        if far * far * x.shape[1] < LONG and self.n * LIMIT * SCALE * 2 < LONG:
            d = self.n * x - np.array(self.total, np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - np.array(self.total, object)
        return [s if s < LONG else None for s in (d * d).sum(1)]


def column_sums(rows: DataFrame, dim: int) -> Sums:
    """n and S.  Each batch adds low and high halves of the numbers apart, so long sums hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = _whole(batch.column(0), dim)
            n += len(x)
            for half in ((x >> 24).sum(0) * (1 << 24), (x & 0xFFFFFF).sum(0)):
                total = [a + int(b) for a, b in zip(total, half)]
        if n:
            at = np.arange(dim + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array([n, *(t >> 24 for t in total)], pa.int64()),
                 pa.array([0, *(t & 0xFFFFFF for t in total)], pa.int64())],
                names=["part", "high", "low"])

    # one row for each part
    sums = {r.part: (r.high, r.low) for r in
            rows.select("v").mapInArrow(run, "part long, high long, low long")
            .groupBy("part").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    if not sums:
        return Sums(0, [0] * dim)
    return Sums(sums[0][0], [(sums[i][0] << 24) + sums[i][1] for i in range(1, dim + 1)])


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, sums: Sums, factors: list[np.ndarray],
         last: np.ndarray | None = None) -> np.ndarray:
    """Q'Q over all rows, Q the centred rows solved by each factor in turn (and
    multiplied by ``last``, if given)."""
    dim = len(sums.total)
    upper = np.triu_indices(dim if last is None else last.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = 0
        for batch in batches:
            q = sums.centred(_whole(batch.column(0), dim))
            for r in factors:
                q = solve_rows(q, r)
            q = q if last is None else q @ last
            g = g + q.T @ q
        if not np.isscalar(g):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(g[upper])],
                names=["cell", "value"])

    partial = rows.select("v").mapInArrow(run, "cell int, value double")
    partial = (partial.withColumn("part", F.spark_partition_id() % GROUPS)
               .groupBy("cell", "part").agg(F.sum("value").alias("value")))
    # one row for each cell of a length x length matrix
    found = partial.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    size = dim if last is None else last.shape[1]
    g = np.zeros((size, size))
    at = found["cell"].to_numpy()
    g[upper[0][at], upper[1][at]] = found["value"].to_numpy()
    return np.triu(g) + np.triu(g, 1).T


def shifted_factor(g: np.ndarray, rows: int) -> np.ndarray:
    """The upper Cholesky factor of g, of g + shift where g alone has none."""
    dim, norm = len(g), float(np.linalg.norm(g, 2))
    shift = 11 * (rows * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * norm
    shift = min(shift, 1e-2 * norm) or 1.0
    while True:
        try:
            r = np.linalg.cholesky(g + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 100
            continue
        return r


@dataclass
class Components:
    """``vectors`` has one component a column; ``values`` are covariance eigenvalues."""

    sums: Sums
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int


def fit(rows: DataFrame, dim: int) -> Components | None:
    """Components of (v) rows of one length by passes of CholeskyQR."""
    sums = column_sums(rows, dim)
    if not sums.n:
        return None
    factors: list[np.ndarray] = []
    composed, trace, seen = np.eye(dim), 0.0, np.inf
    for k in range(MAX_PASSES):
        g = gram(rows, sums, factors)
        if not k:
            trace = float(np.trace(g)) / sums.n
            if not trace:
                return None
        off = float(np.abs(g - np.eye(dim)).max())
        # orthonormal to rounding, or no further gain (dependent columns stay short)
        if k and (off < 1e-12 * dim or k > 2 and off > 0.1 * seen):
            break
        seen = off
        if not k or np.linalg.eigvalsh(g)[0] < 0.5:
            r = shifted_factor(g, sums.n)
        else:
            r = np.linalg.cholesky(g).T
        factors.append(r)
        composed = r @ composed
    else:
        g = gram(rows, sums, factors)
    value, vector = np.linalg.eigh(g)
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    _, s, right = np.linalg.svd(root @ composed)
    keep = s > RANK * s[0]
    return Components(sums, s[keep] ** 2 / sums.n, right[keep].T, trace, len(factors))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for
    each row of the fit list and each component."""
    spark = rows.sparkSession
    every = fit_rows(rows, id_col, vector_col)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    # one row for each vector length
    top = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return spark.createDataFrame([], schema)
    dim = top.dim
    every = every.where(F.size("v") == dim)
    model = fit(every, dim)
    if model is None:
        return spark.createDataFrame([], schema)
    sums, k = model.sums, min(components, len(model.values))
    axes = model.vectors[:, :k] / np.sqrt(model.values[:k])
    error = float(np.abs(gram(every, sums, [], axes) / sums.n - np.eye(k)).max())
    explained = model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), dim)
            if not len(x):
                continue
            white = sums.centred(x) @ axes
            who = pa.array(np.repeat(np.arange(len(x)), k))
            far = pa.array(sums.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column(0), who),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(x) * k, sums.n)), pc.take(far, who), pa.array(white.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return every.mapInArrow(run, schema)
