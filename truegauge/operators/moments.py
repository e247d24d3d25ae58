"""Centred co-moments of wide features, and the linear fits that follow from them.

One row per key holds the count, the mean vector and the centred sum of products of the features
with the target as last coordinate: two arrays instead of a column per pair. Tasks build them block by
block in numpy; partial results are merged pairwise by the parallel-variance rule, so nothing is
squared before it is centred and a mean a million times the deviation costs no digits. Leaving a group out,
ridge, reduced rank and squared errors are arithmetic on these rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.session import ship_package

MOMENTS = "n double, mean array<double>, moment array<double>"
#: A task holds at most so many numbers of unfinished keys before it hands them on.
HELD = 1 << 23
#: Partial results of one key that meet in one task; a key with more is merged in two steps.
FAN_IN = 64


@dataclass
class Moment:
    """Count, mean and centred sum of products (k x k) of some rows."""

    n: float
    mean: np.ndarray
    moment: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moment:
        mean = rows.mean(axis=0)
        apart = rows - mean
        # The mean of large numbers is rounded; its error is taken out once more.
        rest = apart.mean(axis=0)
        apart -= rest
        return cls(float(len(rows)), mean + rest, apart.T @ apart)

    @classmethod
    def unpacked(cls, n: float, mean, moment) -> Moment:
        mean = np.asarray(mean, float)
        return cls(float(n), mean, np.asarray(moment, float).reshape(len(mean), len(mean)))

    def __add__(self, other: Moment) -> Moment:
        if not other.n:
            return self
        n, apart = self.n + other.n, other.mean - self.mean
        return Moment(n, self.mean + apart * (other.n / n), self.moment + other.moment
                      + np.outer(apart, apart) * (self.n * other.n / n))

    def __sub__(self, part: Moment) -> Moment:
        """The rows without a part of them."""
        n = self.n - part.n
        if n <= 0:
            return Moment(0.0, self.mean, np.zeros_like(self.moment))
        apart = (part.mean - self.mean) * (self.n / n)
        return Moment(n, part.mean - apart, self.moment - part.moment - np.outer(apart, apart) * (n * part.n / self.n))

    def ridge(self, lam: float) -> tuple[float, np.ndarray]:
        """Intercept and coefficients minimizing mean squared error + lam |coef|^2."""
        d = len(self.mean) - 1
        c = self.moment / self.n
        coef = np.linalg.pinv(c[:d, :d] + lam * np.eye(d), hermitian=True) @ c[:d, d]
        return float(self.mean[d] - self.mean[:d] @ coef), coef

    def squared_error(self, intercept: float, coef: np.ndarray) -> float:
        """Of a linear model on these rows, from centred products only."""
        turn = np.append(-coef, 1.0)
        return float(self.n * (turn @ self.mean - intercept) ** 2 + turn @ self.moment @ turn)


def merged_by(parts: DataFrame, keys: Sequence[str], columns: Sequence[str], schema: str,
              unpack: Callable[..., object], pack: Callable[[object], Sequence]) -> DataFrame:
    """Values of ``columns`` (numbers or arrays of one length) added up per key.

    Rows are dealt by key and sorted, so that a task adds runs of rows without a call per group. They are
    added pairwise, by a ladder of sums of 1, 2, 4, ... rows, so rounding grows with its height.
    """
    ship_package(parts.sparkSession)
    types = dict(parts.dtypes)
    full = ", ".join([*[f"{k} {types[k]}" for k in keys], schema])
    dealt = parts.select(*keys, *columns)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys) if keys else dealt.coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ladder, done, kinds = None, [], [], None

        def finish() -> None:
            total = ladder[-1][1]
            for _, value in reversed(ladder[:-1]):
                total = total + value
            done.append((*current, *pack(total)))

        def out() -> pa.RecordBatch:
            names = [*keys, *columns]
            arrays = [pa.array([r[i] for r in done], kinds[i]) for i in range(len(names))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [column.type for column in batch.columns]
            keyed = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))])) or [()] * batch.num_rows
            values = [c.to_numpy(zero_copy_only=False) if not pa.types.is_list(c.type) else
                      c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                      for c in batch.columns[len(keys):]]
            for row, key in enumerate(keyed):
                if key != current:
                    if ladder:
                        finish()
                    current, ladder = key, []
                rank, value = 0, unpack(*[v[row] for v in values])
                while ladder and ladder[-1][0] == rank:
                    rank, value = rank + 1, ladder.pop()[1] + value
                ladder.append((rank, value))
                if len(done) >= 1024:
                    yield out()
        if ladder:
            finish()
        if done:
            yield out()

    return dealt.mapInArrow(run, full)


def _packed(m: Moment) -> Sequence:
    return m.n, m.mean, m.moment.ravel()


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of moments merged per key."""
    return merged_by(parts, keys, ("n", "mean", "moment"), MOMENTS, Moment.unpacked, _packed)


def summed_by(rows: DataFrame, keys: Sequence[str], x: str, y: str, of: Callable[[np.ndarray, np.ndarray], object],
              columns: Sequence[str], schema: str, unpack: Callable[..., object],
              pack: Callable[[object], Sequence]) -> DataFrame:
    """``of(vectors, targets)`` of each key's rows, added up; rows with a null in either are left out.

    Every vector has to have one length. A hot key is summed where its rows lie; what is
    shuffled is a block per task and key, and these meet in groups of bounded size.
    """
    ship_package(rows.sparkSession)
    types = dict(rows.dtypes)
    given = rows.select(*keys, F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y")).where(
        "_x is not null and _y is not null and not exists(_x, v -> v is null)")
    names = [f"_k{i}" for i in range(len(keys))]
    full = ", ".join([*[f"{n} {types[k]}" for n, k in zip(names, keys)], schema, "_salt int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % FAN_IN
        kinds, held = None, 0
        found: dict[tuple, object] = {}

        def out() -> pa.RecordBatch:
            packed = [pack(value) for value in found.values()]
            arrays = [pa.array([k[i] for k in found], kinds[i]) for i in range(len(keys))]
            arrays += [pa.array([p[i] for p in packed]) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([salt] * len(found), pa.int32())],
                                              names=[*names, *columns, "_salt"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or [batch.column(i).type for i in range(len(keys))]
            values = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            target = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            where = pd.DataFrame({n: batch.column(i).to_pandas() for i, n in enumerate(names)}) if keys else None
            groups = where.groupby(names, sort=False, dropna=False).indices if keys else {(): np.arange(len(target))}
            for places in groups.values():
                own = tuple(batch.column(i)[int(places[0])].as_py() for i in range(len(keys)))
                fresh = of(values[places], target[places])
                if own in found:
                    fresh = found[own] + fresh
                else:
                    held += sum(np.size(part) for part in pack(fresh))
                found[own] = fresh
            if held > HELD:
                yield out()
                found, held = {}, 0
        if found:
            yield out()

    near = merged_by(given.mapInArrow(run, full), [*names, "_salt"], columns, schema, unpack, pack)
    return merged_by(near, names, columns, schema, unpack, pack).select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], *columns)


def moments(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, mean, moment) of the vectors ``x`` with ``y`` appended."""
    return summed_by(rows, keys, x, y, lambda v, t: Moment.of(np.column_stack((v, t))),
                     ("n", "mean", "moment"), MOMENTS, Moment.unpacked, _packed)


def narrow_moments(rows: DataFrame, keys: Sequence[str], x: str, y: str, width: int) -> DataFrame:
    """``moments`` of the first ``width`` entries of ``x``, for few features and very many keys.

    Spark's own covariances are centred and merged alike, map-side and without a call per key.
    """
    given = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.exists(x, lambda v: v.isNull())).select(
        *keys, *[F.col(x)[i].cast("double").alias(f"_c{i}") for i in range(width)], F.col(y).cast("double").alias(f"_c{width}"))
    k = width + 1
    sums = given.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.avg(f"_c{i}") for i in range(k)]).alias("mean"),
        *[F.covar_pop(f"_c{i}", f"_c{j}").alias(f"_{i}_{j}") for i in range(k) for j in range(i, k)])
    return sums.select(*keys, "n", "mean", F.array(
        *[F.col("n") * F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]).alias("moment"))


def without(parts: DataFrame, keys: Sequence[str], whole: DataFrame) -> DataFrame:
    """Per key the moments of all other rows: ``whole`` (one row) less the key's own.

    ``whole`` is a few thousand numbers and goes with the function.
    """
    found = whole.select("n", "mean", "moment").head()
    total = Moment.unpacked(*found) if found else None
    ship_package(parts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest = [total - Moment.unpacked(*r) for r in zip(batch["n"], batch["mean"], batch["moment"])]
            yield batch[list(keys)].assign(n=[m.n for m in rest], mean=[m.mean for m in rest],
                                           moment=[m.moment.ravel() for m in rest])

    types = dict(parts.dtypes)
    return parts.select(*keys, "n", "mean", "moment").mapInPandas(
        run, ", ".join([*[f"{k} {types[k]}" for k in keys], MOMENTS]))


MODEL = "intercept double, coef array<double>"


def ridges(parts: DataFrame, keys: Sequence[str], lam: float) -> DataFrame:
    """(keys, intercept, coef) of a ridge per row of moments; rows without data give none."""
    ship_package(parts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [Moment.unpacked(*r).ridge(lam) for r in zip(batch["n"], batch["mean"], batch["moment"])]
            yield batch[list(keys)].assign(intercept=[f[0] for f in fits], coef=[f[1] for f in fits])

    types = dict(parts.dtypes)
    return parts.where("n > 0.5").select(*keys, "n", "mean", "moment").mapInPandas(
        run, ", ".join([*[f"{k} {types[k]}" for k in keys], MODEL]))


def ridge(rows: DataFrame, x: str, y: str, lam: float) -> tuple[float, np.ndarray]:
    """One ridge over all rows: its numbers, for literals."""
    found = moments(rows, [], x, y).head()
    if found is None:
        raise ValueError("no training rows")
    return Moment.unpacked(*found).ridge(lam)


def directions(models: DataFrame, weights: DataFrame, keys: Sequence[str], rank: int) -> np.ndarray:
    """Leading directions (d x rank) of the stacked coefficients, each weighted by its rows.

    The stack's second moment is summed as moments are; sign: the largest entry is positive.
    """
    stacked = models.join(weights.select(*keys, "n"), list(keys)).select(
        F.transform("coef", lambda c: c * F.sqrt("n")).alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                c = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    found = dict(stacked.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v")).collect())  # d x d
    d = round(len(found) ** 0.5)
    values, vectors = np.linalg.eigh(np.array([found[i] for i in range(d * d)]).reshape(d, d))
    basis = vectors[:, np.argsort(values)[::-1][:rank]]
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return basis * np.where(signs == 0, 1.0, signs)


def reduced_rank(parts: DataFrame, keys: Sequence[str], rank: int, lam: float) -> DataFrame:
    """Ridges refit inside the leading directions that all keys share; coefficients in feature space."""
    basis = directions(ridges(parts, keys, lam), parts, keys, rank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = []
            for r in zip(batch["n"], batch["mean"], batch["moment"]):
                m, d = Moment.unpacked(*r), len(basis)
                turn = np.block([[basis, np.zeros((d, 1))], [np.zeros((1, basis.shape[1])), np.ones((1, 1))]])
                intercept, inner = Moment(m.n, m.mean @ turn, turn.T @ m.moment @ turn).ridge(lam)
                fits.append((intercept, basis @ inner))
            yield batch[list(keys)].assign(intercept=[f[0] for f in fits], coef=[f[1] for f in fits])

    types = dict(parts.dtypes)
    return parts.where("n > 0.5").select(*keys, "n", "mean", "moment").mapInPandas(
        run, ", ".join([*[f"{k} {types[k]}" for k in keys], MODEL]))


def dot(a: str, b: str | Column) -> Column:
    """Sum of products of two array columns, without a UDF."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def predicted(rows: DataFrame, models: DataFrame, keys: Sequence[str], x: str, out: str = "yhat") -> DataFrame:
    return rows.join(models, list(keys)).withColumn(
        out, F.col("intercept") + dot(x, "coef")).drop("intercept", "coef")
