"""Whitening of embeddings along the leading principal components, found by spectrum slicing.

The factors of a shifted covariance ``V - sI = L D Lt`` tell by the signs of ``D`` how many eigenvalues lie
above ``s``.  Such counts halve an interval until it holds the wanted eigenvalue alone, Rayleigh
quotient iteration then converges cubically to its vector, and two more counts around the value found certify
its number.  Eigenvalues that equal each other to rounding share an interval; their vectors are made orthogonal to
one another.  The matrix has the square of the dimension as its size, whatever the rows; it is
summed by Spark in two passes (sums, then products of centred entries).

Entries become whole numbers (``SCALE`` times the entry, rounded down, plus ``OFFSET``), so sums are exact.

Edge cases: rows whose vector is null or holds nulls or non-finite entries are left out, and those whose length is not
the most frequent one (the longest of several).  Components of an eigenvalue that is nothing but rounding
(at most ``TINY`` of the trace) can't be scaled to variance 1 and are left out; so all are where every vector is the same.
Fewer dimensions than components give fewer rows a vector.  Repeated rows count and are answered each.
An empty table gives no rows; other columns are ignored.  ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
TINY = 1e-13
#: Beyond this a scaled entry has lost its unit; entries are held there.
_LARGEST = 2.0**52
_LONG = 2**63

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Factors(NamedTuple):
    """``A[order][:, order] = L D Lt`` with blocks of one or two on ``D``'s diagonal."""

    order: np.ndarray
    lower: np.ndarray
    diagonal: np.ndarray
    beside: np.ndarray

    def above(self) -> int:
        """Positive eigenvalues, by the inertia of ``D``: a block of two has one of each sign."""
        paired = self.beside != 0
        single = ~paired & ~np.concatenate([[False], paired[:-1]])
        return int((self.diagonal[single] > 0).sum() + paired.sum())

    def solve(self, b: np.ndarray) -> np.ndarray:
        n = len(b)
        y = b[self.order].astype(float)
        for i in range(n):
            y[i + 1 :] -= self.lower[i + 1 :, i] * y[i]
        i = 0
        while i < n:
            if i + 1 < n and self.beside[i] != 0:
                a, c, d = self.diagonal[i], self.beside[i], self.diagonal[i + 1]
                det = a * d - c * c
                y[i], y[i + 1] = (d * y[i] - c * y[i + 1]) / det, (a * y[i + 1] - c * y[i]) / det
                i += 2
            else:
                y[i] /= self.diagonal[i]
                i += 1
        for i in range(n - 1, -1, -1):
            y[i] -= self.lower[i + 1 :, i] @ y[i + 1 :]
        x = np.empty(n)
        x[self.order] = y
        return x


def factorise(matrix: np.ndarray) -> Factors:
    """Symmetric factors with complete pivoting; a pivot of 0 becomes the smallest that doesn't matter."""
    a = matrix.astype(float).copy()
    n = len(a)
    order, lower = np.arange(n), np.eye(n)
    diagonal, beside = np.zeros(n), np.zeros(n)
    smallest = max(np.abs(a).max(initial=0.0), 1.0) * 1e-140
    ratio = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            order[[i, j]] = order[[j, i]]
            lower[[i, j], :k] = lower[[j, i], :k]

    k = 0
    while k < n:
        rest = np.abs(a[k:, k:])
        best = k + int(rest.diagonal().argmax())
        off = np.tril(rest, -1)
        i, j = (k + int(v) for v in np.unravel_index(int(off.argmax()), off.shape))
        if rest[best - k, best - k] >= ratio * off.max(initial=0.0):
            swap(k, best)
            pivot = diagonal[k] = a[k, k] or smallest
            column = a[k + 1 :, k].copy()
            lower[k + 1 :, k] = column / pivot
            a[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], column)
            k += 1
        else:  # the pair (j, i) below the diagonal has j < i
            swap(k, j)
            swap(k + 1, i)
            block = a[k : k + 2, k : k + 2].copy()
            diagonal[k], diagonal[k + 1], beside[k] = block[0, 0], block[1, 1], block[1, 0]
            columns = a[k + 2 :, k : k + 2].copy()
            lower[k + 2 :, k : k + 2] = np.linalg.solve(block, columns.T).T
            a[k + 2 :, k + 2 :] -= lower[k + 2 :, k : k + 2] @ columns.T
            k += 2
    return Factors(order, lower, diagonal, beside)


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``."""
    return factorise(matrix - shift * np.eye(len(matrix))).above()


def _orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in to:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as rows, largest entry positive."""
    n = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    eps = np.finfo(float).eps * max(bound, np.finfo(float).tiny) * max(n, 8)
    counts = {-bound - eps: n, bound + eps: 0}
    values: list[float] = []
    vectors: list[np.ndarray] = []
    start = np.random.Generator(np.random.PCG64(12)).standard_normal((n, n))
    for number in range(1, min(k, n) + 1):
        low = max(s for s, c in counts.items() if c >= number)
        high = min(s for s, c in counts.items() if c < number)
        found = None
        while found is None:
            alone = counts[low] == number and counts[high] == number - 1
            tight = high - low <= 8 * eps
            if tight or (alone and high - low <= 0.05 * max(abs(low), abs(high))):
                found = _refined(matrix, low, high, start[number - 1], vectors, eps, tight)
            if found is None:
                middle = (low + high) / 2
                counts[middle] = above(matrix, middle)
                low, high = (middle, high) if counts[middle] >= number else (low, middle)
        value, vector = found
        if above(matrix, value - 4 * eps) < number or above(matrix, value + 4 * eps) >= number:
            raise ArithmeticError(f"the counts around eigenvalue {number} don't certify it")
        values.append(value)
        vectors.append(vector * (1.0 if vector[np.abs(vector).argmax()] > 0 else -1.0))
    return np.array(values), np.array(vectors).reshape(-1, n)


def _refined(
    matrix: np.ndarray, low: float, high: float, v: np.ndarray, known: list[np.ndarray], eps: float, last: bool
) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval; none where it leaves the interval."""
    unit = np.eye(len(matrix))
    shift = (low + high) / 2
    v = _orthogonal(v, known)
    for turn in range(60):
        v = _orthogonal(factorise(matrix - shift * unit).solve(v), known)
        value = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if residual <= eps:
            break
        shift = value if turn >= 2 and not last else shift
        if not low - eps <= value <= high + eps and turn >= 3 and not last:
            return None
    if low - 2 * eps <= value <= high + 2 * eps and (residual <= eps or last):
        return value, v
    return None


def _cleaned(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of a batch's rows that stay, and their whole-number vectors."""
    column = batch.column("vector")
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False)))
    flat = column.take(pa.array(at)).flatten()
    raw = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    good = np.isfinite(raw).all(axis=1)
    scaled = np.clip(np.floor(SCALE * raw[good]), -_LARGEST, _LARGEST)
    return at[good], scaled.astype(np.int64) + OFFSET


def _vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))


def _usable(vector: str) -> F.Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def _summed(df: DataFrame, make, size: int) -> np.ndarray:
    """The sum of arrays of ``size`` numbers that tasks make of their batches, as text exact to the last digit.

    One row a task and entry is added up by entry, so nothing but the totals reaches the driver.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
        if total is not None:
            places = np.arange(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array([float(v) for v in total])], ["place", "value"])

    rows = df.mapInArrow(scan, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


class Whitening(NamedTuple):
    """``n`` vectors with sums ``sums``; components as rows, their eigenvalues and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.components.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares; in whole numbers of any size where a long might not hold them."""
        sums = np.array(self.sums, object)
        widest = max(abs(self.n * int(x.max(initial=0)) - min(self.sums)), abs(self.n * int(x.min(initial=0)) - max(self.sums)))
        exact = widest * widest * len(self.sums) < _LONG
        if exact:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1).tolist()
        return [int(v) if v < _LONG else None for v in found]


def fit(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; none where there is no vector with an entry."""
    vectors = _vectors(df, id_column, vector_column)
    usable = vectors.where(_usable("vector"))
    common = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None or common["size"] == 0:
        return None
    size, n = common["size"], common["count"]

    entries = usable.where(F.size("vector") == size).select(F.posexplode("vector").alias("place", "c"))
    whole = F.greatest(F.least(F.floor(F.col("c") * SCALE).cast("double"), F.lit(_LARGEST)), F.lit(-_LARGEST))
    by_place = entries.groupBy("place").agg(F.sum((whole.cast("long") + OFFSET).cast("decimal(28,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted((r["place"], r["s"]) for r in by_place)]
    mean = np.array([s / n for s in sums])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        centred = _cleaned(batch, size)[1] - mean
        return (centred.T @ centred)[np.tril_indices(size)]

    covariance = np.zeros((size, size))
    covariance[np.tril_indices(size)] = _summed(vectors, products, size * (size + 1) // 2) / n
    covariance += np.tril(covariance, -1).T
    values, components = leading(covariance, k)
    trace = float(np.trace(covariance))
    kept = values > TINY * trace
    return Whitening(n, sums, values[kept], components[kept], trace)


def identity_error(df: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of all whitened vectors less the identity."""
    size, k = len(model.sums), len(model.values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.project(_cleaned(batch, size)[1])
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _summed(_vectors(df, id_column, vector_column), moments, k + k * k) / model.n
    off = found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)
    return float(np.abs(off).max(initial=0.0))


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component."""
    model = fit(df, id_column, vector_column, k)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(df, model, id_column, vector_column)
    size, k = len(model.sums), len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _cleaned(batch, size)
            rows = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return _vectors(df, id_column, vector_column).mapInArrow(apply, SCHEMA)
