"""Whitening of embeddings by their leading principal components.

Entries become integers floor(scale * c) + shift. One pass sums them exactly, a second one sums
the products of the centred entries (a matrix a task, added by Spark), so that the driver gets
dimensions^2 numbers. There the covariance is brought to tridiagonal form by Householder
reflections; the leading eigenvalues are bisected by Sturm counts, their vectors found by inverse
iteration, with those of close eigenvalues made orthogonal to one another, and carried back. The
vectors go to all tasks (components x dimensions numbers), which project the rows.

Components whose eigenvalue is not above ``LEAST`` of the largest one (constant or dependent
dimensions) have no whitened value and are left out, so fewer than asked may come back; a table of
one row, or of equal rows, or without a row gives none. All kept vectors must have one length,
or an error is raised. Rows are taken one by one: repeated rows, repeated and null ids stay.
Columns other than key and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm.heap_clusters import finite
from truegauge.session import ship_package

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LEAST = 1e-12
#: Eigenvalues closer than this share of the largest are one cluster for inverse iteration.
CLOSE = 1e-3
_EPS = np.finfo(np.float64).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and the reflections' vectors of Q^T A Q, by Householder."""
    a = np.array(matrix, np.float64)
    n, reflections = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        v, length = x.copy(), np.linalg.norm(x)
        v[0] += np.copysign(length, x[0])
        norm = np.linalg.norm(v)
        if not np.any(x[1:]) or norm == 0:
            reflections.append(np.zeros(n - k - 1))
            continue
        v /= norm
        reflections.append(v)
        block = a[k + 1:, k + 1:]
        p = 2 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(length, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(diagonal: np.ndarray, side: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Eigenvalues smaller than each point: the negative pivots of T - point (Sturm)."""
    square = np.concatenate(([0.0], side ** 2))
    tiny = np.finfo(np.float64).tiny / _EPS * max(1.0, square.max(initial=0.0))
    q, count = np.ones_like(points), np.zeros(len(points), np.int64)
    for d, s in zip(diagonal, square):
        q = d - points - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, side: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, by bisection of Sturm counts."""
    n = len(diagonal)
    around = np.abs(np.concatenate(([0.0], side))) + np.abs(np.concatenate((side, [0.0])))
    low, high = (diagonal - around).min(), (diagonal + around).max()
    room = 2 * _EPS * max(abs(low), abs(high)) + np.finfo(np.float64).tiny
    # The eigenvalue with k others above has n - k - 1 below it.
    rank = n - 1 - np.arange(wanted)
    lows, highs = np.full(wanted, low - room), np.full(wanted, high + room)
    for _ in range(200):
        middle = lows + (highs - lows) / 2
        if np.all((middle <= lows) | (middle >= highs)):
            break
        under = below(diagonal, side, middle) <= rank
        lows, highs = np.where(under, middle, lows), np.where(under, highs, middle)
    return lows + (highs - lows) / 2


def solved(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchanges; near-singular on purpose."""
    n = len(diagonal)
    d, u, v = diagonal - shift, np.append(side, 0.0), np.zeros(n)
    x, floor = right.copy(), _EPS * max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), 1e-300)
    for k in range(n - 1):
        below_pivot = side[k]
        if abs(below_pivot) > abs(d[k]):
            factor = d[k] / below_pivot
            d[k], next_d = below_pivot, u[k] - factor * d[k + 1]
            u[k], next_u = d[k + 1], v[k] - factor * u[k + 1]
            v[k], d[k + 1], u[k + 1] = u[k + 1], next_d, next_u
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            if abs(d[k]) < floor:
                d[k] = floor
            factor = below_pivot / d[k]
            d[k + 1] -= factor * u[k]
            u[k + 1] -= factor * v[k]
            x[k + 1] -= factor * x[k]
    if abs(d[-1]) < floor:
        d[-1] = floor
    for k in range(n - 1, -1, -1):
        rest = x[k] - (u[k] * x[k + 1] if k + 1 < n else 0.0) - (v[k] * x[k + 2] if k + 2 < n else 0.0)
        x[k] = rest / d[k]
    return x


def tridiagonal_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors, a column a value, by inverse iteration; those of a cluster are kept orthogonal."""
    n = len(diagonal)
    draw = np.random.Generator(np.random.PCG64(5))
    size = max(np.abs(values).max(initial=0.0), np.finfo(np.float64).tiny)
    out, first, shift = np.empty((n, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * size:
            first = k
        # Equal shifts would find one vector twice.
        shift = value if k == first else min(value, shift - 4 * _EPS * size)
        x = draw.uniform(-1, 1, n)
        for _ in range(rounds):
            x = solved(diagonal, side, shift, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors (columns); values of no weight are left out."""
    unit = np.abs(covariance).max(initial=0.0) or 1.0
    diagonal, side, reflections = tridiagonal(covariance / unit)
    values = leading_eigenvalues(diagonal, side, min(wanted, len(diagonal)))
    values = values[values > LEAST * max(values.max(initial=0.0), 0.0)]
    vectors = tridiagonal_vectors(diagonal, side, values)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * unit, vectors


@dataclass(frozen=True)
class Whitening:
    """A fit: row count, exact sums, leading eigenvalues and vectors, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean, without the rounding of large entries."""
        floors = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - floors).astype(np.float64) - rest

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 a row; null where it does not fit a long."""
        apart = self.n * x.astype(object) - np.array(self.sums, object) if self.n > 1 << 30 else \
            self.n * x - np.array(self.sums, np.int64)
        about = (apart.astype(np.float64) ** 2).sum(axis=1)
        if about.max(initial=0.0) < 2.0 ** 62:
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in apart]
        return [v if v < 1 << 63 else None for v in exact]


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * SCALE) + SHIFT)
    return vectors.where(finite(vector)).select(F.col(key).alias("id"), x.alias("x"))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def products(rows: DataFrame, turn, width: int) -> np.ndarray:
    """Sum over rows of the outer products of what ``turn`` makes of a matrix of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = turn(batch.column(0))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "value"])

    found = rows.select("x").mapInArrow(run, "at bigint, value double").groupBy("at").agg(
        F.sum("value").alias("value")).collect()
    out = np.zeros(width * width)
    for r in found:
        out[r["at"]] = r["value"]
    return out.reshape(width, width)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows; None without a row."""
    ship_package(vectors.sparkSession)
    rows = integers(vectors, vector, vector).select("x")
    sized = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")
                     ).first()
    if not sized["n"]:
        return None
    if sized["low"] != sized["high"]:
        raise ValueError("vectors of different lengths have no common covariance")
    n, dimensions = sized["n"], sized["low"]
    summed = dict(rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    sums = [int(summed[k]) for k in range(dimensions)]
    bare = Whitening(n, sums, np.empty(0), np.empty((dimensions, 0)), 0.0, 0.0)
    covariance = products(rows, lambda x: bare.centred(matrix(x, dimensions)), dimensions) / n
    values, axes = leading_components(covariance, components)
    model = Whitening(n, sums, values, axes, float(np.trace(covariance)), 0.0)
    if not len(values):
        return model
    # The whitened rows are centred, as x is.
    whitened = products(rows, lambda x: model.projected(matrix(x, dimensions)), len(values)) / n
    return Whitening(n, sums, values, axes, model.trace, float(np.abs(whitened - np.eye(len(values))).max()))


def whitened(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, deviation, whitened) for every kept row and component of the model."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"id {kind}, component int, deviation bigint, whitened double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    ship_package(vectors.sparkSession)
    dimensions, m = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimensions)
            places = pa.array(np.repeat(np.arange(len(x)), m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(places), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                 pa.array(model.deviation(x), pa.int64()).take(places), pa.array(model.projected(x).ravel())],
                names=["id", "component", "deviation", "whitened"])

    return integers(vectors, key, vector).mapInArrow(run, schema)
