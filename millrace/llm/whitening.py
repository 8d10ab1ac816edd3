"""Whitening of embeddings by a two-pass covariance.

Entries become whole numbers, so that the first pass's sums are exact in any order. The second pass
centres each block by them, as exact whole numbers, and adds up its outer products with one matrix
product a block. ``treeAggregate`` merges the tasks' sums, so that the driver receives a few matrices
and never rows. The driver solves the symmetric eigenproblem with LAPACK, and the projection (at most
dimension x components doubles, whatever the number of rows) is broadcast. A third pass measures the
covariance of what it gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: A whole number is SCALE times its entry, rounded down, plus SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this in size count as not finite: whole numbers of more than 45 bits have no use as embeddings.
LARGEST = float(1 << 38)
#: Rows of a block: the sum of so many whole numbers fits 64 bits.
ROWS = 8192
#: An eigenvalue under this part of the largest is rounding: there is no such component.
RANK_TOLERANCE = 1e-11
#: Levels of the merging tree.
DEPTH = 2


def whole(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers) by blocks, of a batch's vectors that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimension), False)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    for a in range(0, len(vectors), ROWS):
        block = vectors.slice(a, ROWS)
        values = block.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)  # null becomes NaN
        ok = (np.abs(values) <= LARGEST).all(axis=1)
        if ok.any():
            yield ids.slice(a, ROWS).filter(pa.array(ok)), np.floor(SCALE * values[ok]).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Fit:
    """What was learned: ``n`` vectors, their sums (exact), eigenvalues and unit eigenvectors (columns)
    from the largest on, the trace, and the largest error of the whitened covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums over n, as whole numbers and what remains (0 to n - 1), so that sums = n * whole + rest."""
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part of the mean is taken away exactly, before anything is rounded."""
        mean, rest = self.mean()
        return (x - mean) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Of each row the exact sum over dimensions of (n * x - sums)^2.

        With z = x - whole mean that is n^2 sum(z^2) - 2 n sum(z rest) + sum(rest^2): the sums over
        dimensions fit 64 bits unless entries are huge, and Python's numbers put them together.
        """
        mean, rest = self.mean()
        z = x - mean
        bound = int(np.abs(z).max()) * len(mean)
        if bound * max(bound, int(rest.max())) >= 1 << 63:
            z, rest = z.astype(object), rest.astype(object)
        squares, cross, fixed = (z * z).sum(axis=1), (z * rest).sum(axis=1), sum(int(r) ** 2 for r in rest)
        return [self.n * (self.n * int(s) - 2 * int(c)) + fixed for s, c in zip(squares, cross, strict=True)]


def dimension_of(vectors: DataFrame) -> int:
    """The length that most vectors have (of equally many, the largest); 0 without any."""
    sizes = vectors.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def _merged(vectors: DataFrame, dimension: int, partial, merge, size: int) -> tuple:
    """(n, mean, outer): ``partial`` folds the blocks of a task, ``merge`` tasks, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, outer = partial(x for batch in batches for _, x in whole(batch, dimension))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([outer.tobytes()], pa.binary())], names=["n", "mean", "outer"])

    def add(total: tuple, row) -> tuple:
        return merge(total, (row["n"], np.frombuffer(bytes(row["mean"])), np.frombuffer(bytes(row["outer"])).reshape(size, size)))

    rows = vectors.mapInArrow(run, "n long, mean binary, outer binary").rdd
    return rows.treeAggregate((0, np.zeros(size), np.zeros((size, size))), add, merge, DEPTH)


def exact_sums(vectors: DataFrame, dimension: int) -> tuple[int, tuple[int, ...]]:
    """(number of vectors that take part, their whole numbers' sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for batch in batches:
            for _, x in whole(batch, dimension):
                n += len(x)
                sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    def add(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], tuple(x + int(y) for x, y in zip(a[1], b[1], strict=True))

    return vectors.mapInArrow(run, "n long, sums array<string>").rdd.treeAggregate((0, (0,) * dimension), add, add, DEPTH)


def combined(a: tuple, b: tuple) -> tuple:
    """(n, mean, sum of outer products about the mean) of two sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _outer(vectors: DataFrame, dimension: int, fit: Fit) -> np.ndarray:
    """The sum of outer products of vectors centred by the exact mean."""

    def partial(blocks: Iterator[np.ndarray]) -> tuple:
        n, outer = 0, np.zeros((dimension, dimension))
        for x in blocks:
            y = fit.centred(x)
            n, outer = n + len(x), outer + y.T @ y
        return n, np.zeros(dimension), outer

    return _merged(vectors, dimension, partial, lambda a, b: (a[0] + b[0], a[1], a[2] + b[2]), dimension)[2]


def _identity_error(vectors: DataFrame, dimension: int, fit: Fit) -> float:
    """The largest entry of the whitened rows' covariance minus the identity: each block is centred by
    its own mean, and blocks are merged by their means' distance."""
    k = len(fit.values)
    if not k:
        return 0.0

    def partial(blocks: Iterator[np.ndarray]) -> tuple:
        total = 0, np.zeros(k), np.zeros((k, k))
        for x in blocks:
            w = fit.whitened(x)
            mean = w.mean(axis=0)
            total = combined(total, (len(w), mean, (w - mean).T @ (w - mean)))
        return total

    n, _, outer = _merged(vectors, dimension, partial, combined, k)
    return float(np.abs(outer / n - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, dimension: int, components: int = COMPONENTS) -> Fit | None:
    """Fits on all vectors (vec_id, embedding) of that length; None if there are none."""
    n, sums = exact_sums(vectors, dimension) if dimension else (0, ())
    if not n:
        return None
    fit = Fit(n, sums, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    covariance = _outer(vectors, dimension, fit) / n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    real = values > max(values[0], 0.0) * RANK_TOLERANCE
    values, basis = values[real], basis[:, real]
    # of a component and its negative the one whose largest entry is positive
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(values))])
    fit = replace(fit, values=values, vectors=basis, trace=float(np.trace(covariance)))
    return replace(fit, identity_error=_identity_error(vectors, dimension, fit))


_ROWS = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, dimension: int | None = None) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and each
    of the first ``components`` principal components.

    Vectors that are null, empty or hold null, non-finite or huge entries (over ``LARGEST``) take no part,
    nor do those of another length than ``dimension`` (by default the length that most have). There
    are fewer components if the vectors have fewer dimensions or vary along fewer: a component without
    variance can't be whitened and is left out, so equal vectors, or one alone, give no rows.
    Repeated rows and rows without an id count like others. An empty table gives none. Only the two
    columns named are read. ``deviation`` is exact up to 38 digits.
    """
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    dimension = dimension_of(vectors) if dimension is None else dimension
    fit = fit_whitening(vectors, dimension, components)
    if fit is None or not len(fit.values):
        return table.sparkSession.createDataFrame([], _ROWS)
    shared = table.sparkSession.sparkContext.broadcast(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        k = len(fit.values)
        explained = fit.values / fit.trace
        for batch in batches:
            for ids, x in whole(batch, dimension):
                rows = len(x)
                each = pa.array(np.repeat(np.arange(rows), k))
                deviation = pa.array(fit.deviation(x), pa.decimal128(38, 0)).take(each)
                columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit.n)), deviation, pa.array(fit.whitened(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, fit.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROWS.split(", ")])

    return vectors.mapInArrow(project, _ROWS)
