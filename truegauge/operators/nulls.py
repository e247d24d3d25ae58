"""Null models every result has to beat."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_bucket
from truegauge.operators.moments import merged_by
from truegauge.session import ship_package


#: Positions packed into one row by ``null_shuffle``.
CHUNK = 8192
#: Rows that it hands on at once.
OUT_ROWS = 1 << 16


def turns_of(reps: int, seed: str) -> Column:
    """How far each repetition rotates a session of ``n_pos`` positions, 1 .. n_pos - 1."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))
    most = F.greatest(F.col("n_pos") - 1, F.lit(1))
    return F.transform(numbers, lambda rep: 1 + hash_bucket(1 << 31, "eid", rep, F.lit(seed)) % most)


def _met(rows: DataFrame, reps: int, seed: str, chunk: int) -> DataFrame:
    """Each chunk of targets beside each chunk of predictions that a repetition moves it to, with all shifts."""
    ship_package(rows.sparkSession)
    shifts = turns_of(reps, seed)
    number = lambda p: F.floor(p / F.lit(chunk)).cast("bigint")
    given = rows.where("n_pos > 1").select("eid", F.col("pos").cast("bigint").alias("pos"),
                                           F.col("n_pos").cast("bigint").alias("n_pos"), "y", "yhat")

    def places(shift: Column) -> Column:
        first, last = F.pmod(F.col("_low") + shift, F.col("n_pos")), F.pmod(F.col("_high") + shift, F.col("n_pos"))
        wrapped = F.concat(F.sequence(number(first), number(F.col("n_pos") - 1)),
                           F.sequence(F.lit(0).cast("bigint"), number(last)))
        return F.when(first <= last, F.sequence(number(first), number(last))).otherwise(wrapped)

    targets = given.groupBy("eid", "n_pos", number(F.col("pos")).alias("_from")).agg(
        F.min("pos").alias("_low"), F.max("pos").alias("_high"), F.collect_list(F.struct("pos", "y")).alias("_t"))
    # In a session of one chunk there is no other place, whatever the shifts are.
    one = F.array(F.lit(0).cast("bigint"))
    moved = targets.withColumn("_at", F.explode(F.when(F.col("n_pos") <= chunk, one).otherwise(
        F.array_distinct(F.flatten(F.transform(shifts, places))))))
    held = given.groupBy("eid", number(F.col("pos")).alias("_at")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "yhat"))).alias("_p"))
    return moved.join(held, ["eid", "_at"]).select(
        "eid", "n_pos", F.col("_t.pos").alias("_tpos"), F.col("_t.y").alias("_y"), F.col("_p.pos").alias("_pos"),
        F.col("_p.yhat").alias("_yhat"), shifts.alias("_shift"))


def null_shuffle(rows: DataFrame, reps: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """Targets rotated against the predictions inside the block of each session, ``reps`` times.

    ``rows`` are scored rows of a split with one block per session: eid, pos, n_pos, y,
    yhat (of any type that has an order), each position at most once. The shift is 1 .. n_pos - 1 from a hash.

    Targets and predictions are packed per ``chunk`` of positions. A target chunk goes once to each prediction
    chunk that any repetition moves it to, and the repetitions are applied where the two meet: a session of one
    chunk is moved once whatever ``reps`` is, a longer one at most once per pair of its chunks.
    Result: eid, pos, yhat, rep, y.
    """
    types, met = dict(rows.dtypes), _met(rows, reps, seed, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            eid, size, at, y, place, yhat, shift = batch.columns
            for i in range(batch.num_rows):
                own, where = at[i].values.to_numpy(), place[i].values.to_numpy()
                turns, n = shift[i].values.to_numpy(), size[i].as_py()
                step = max(1, OUT_ROWS // len(own))
                for begin in range(0, len(turns), step):
                    to = (own[None, :] + turns[begin:begin + step, None]) % n
                    found = np.minimum(np.searchsorted(where, to), len(where) - 1)
                    rep, which = np.nonzero(where[found] == to)
                    if len(rep):
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(eid[i], len(rep)), pa.array(to[rep, which]),
                             yhat[i].values.take(pa.array(found[rep, which])), pa.array(rep + begin),
                             y[i].values.take(pa.array(which))], names=["eid", "pos", "yhat", "rep", "y"])

    return met.mapInArrow(run, f"eid {types['eid']}, pos bigint, yhat {types['yhat']}, rep bigint, y {types['y']}")


def rotated_errors(rows: DataFrame, reps: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """(eid, n, valid, squares): arrays with an entry per rotation of ``null_shuffle``.

    ``n`` counts its rows, ``valid`` those where target and prediction are known, ``squares`` sums their squared
    differences. The sessions of a batch are rotated together, and no row is made per repetition.
    """
    known = rows.select("eid", "pos", "n_pos", F.col("y").cast("double").alias("y"),
                        F.col("yhat").cast("double").alias("yhat"))
    kind, names = dict(rows.dtypes)["eid"], ("n", "valid", "squares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
                             + pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 8 * OUT_ROWS, "right")))
                part = batch.slice(at, stop - at)
                at = stop
                eid, size, own, y, place, yhat, shift = part.columns
                n, turns = size.to_numpy(), shift.flatten().to_numpy().reshape(part.num_rows, -1)
                owner, holder = (np.repeat(np.arange(part.num_rows), pc.list_value_length(c).to_numpy(
                    zero_copy_only=False)) for c in (own, place))
                own, target, where, guess = (c.flatten() for c in (own, y, place, yhat))
                # Places of all sessions in one ascending order.
                wide = int(n.max()) + 1
                keys, own = holder * wide + where.to_numpy(), own.to_numpy()
                fits, given = (c.is_valid().to_numpy(zero_copy_only=False) for c in (guess, target))
                guess, target = (c.to_numpy(zero_copy_only=False) for c in (guess, target))
                out = [np.empty((part.num_rows, turns.shape[1])) for _ in names]
                for rep in range(turns.shape[1]):
                    to = owner * wide + (own + turns[owner, rep]) % n[owner]
                    found = np.minimum(np.searchsorted(keys, to), len(keys) - 1)
                    met = keys[found] == to
                    both = np.flatnonzero(met & given & fits[found])
                    apart = target[both] - guess[found[both]]
                    for column, of, weight in zip(out, (owner[met], owner[both], owner[both]), (None, None, apart * apart)):
                        column[:, rep] = np.bincount(of, weight, part.num_rows)
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * turns.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [eid, *[pa.ListArray.from_arrays(offsets, pa.array(c.ravel())) for c in out]], names=["eid", *names])

    near = _met(known, reps, seed, chunk).mapInArrow(
        run, f"eid {kind}, " + ", ".join(f"{c} array<double>" for c in names))
    # A session of several chunks has a row per meeting.
    return near.groupBy("eid").agg(*[F.array(*[F.sum(F.col(c)[rep]) for rep in range(reps)]).alias(c) for c in names])


def shuffle_errors(rows: DataFrame, reps: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """(eid, rep, n, value): the root mean squared error of every rotation that has rows."""
    met = rotated_errors(rows, reps, seed, chunk).select("eid", F.posexplode(F.arrays_zip("n", "valid", "squares")))
    return met.where("col.n > 0").select(
        "eid", F.col("pos").cast("bigint").alias("rep"), F.col("col.n").cast("bigint").alias("n"),
        F.sqrt(F.try_divide("col.squares", "col.valid")).alias("value"))


class Turns:
    """Centred moments of a block of rows under each rotation: n (runs), mean (runs x k), moment (runs x k x k)."""

    def __init__(self, n, mean, moment) -> None:
        self.n = np.asarray(n, float)
        self.mean = np.asarray(mean, float).reshape(len(self.n), -1)
        self.moment = np.asarray(moment, float).reshape(len(self.n), self.mean.shape[1], -1)

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, found: np.ndarray, ok: np.ndarray) -> Turns:
        """Features ``x`` at ``found`` (runs x targets) with the targets, where ``ok``."""
        both = np.concatenate((x[found], np.broadcast_to(y[None, :, None], (*found.shape, 1))), axis=2)
        n = ok.sum(axis=1).astype(float)
        safe, weight = np.maximum(n, 1.0)[:, None], ok[:, :, None]
        mean = np.where(weight, both, 0.0).sum(axis=1) / safe
        apart = np.where(weight, both - mean[:, None], 0.0)
        rest = apart.sum(axis=1) / safe
        apart = np.where(weight, apart - rest[:, None], 0.0)
        return cls(n, mean + rest, apart.transpose(0, 2, 1) @ apart)

    def __add__(self, other: Turns) -> Turns:
        n = self.n + other.n
        safe, apart = np.maximum(n, 1.0), other.mean - self.mean
        mean = self.mean + apart * (other.n / safe)[:, None]
        outer = apart[:, :, None] * apart[:, None, :] * (self.n * other.n / safe)[:, None, None]
        return Turns(n, mean, self.moment + other.moment + outer)

    def packed(self) -> tuple[np.ndarray, ...]:
        return self.n, self.mean.ravel(), self.moment.ravel()


def rotated_moments(rows: DataFrame, width: int, reps: int, seed: str, chunk: int = CHUNK) -> DataFrame:
    """(eid, n, mean, moment): moments of features and target under every rotation of ``null_shuffle``, in arrays.

    ``rows`` are as there with an array ``x`` of ``width`` features for ``yhat``; pairs with a null count nowhere. The
    rotations of a session are summed where its chunks meet and are not made as rows.
    """
    known = rows.select("eid", "pos", "n_pos", F.col("y").cast("double").alias("y"),
                        F.array(*[F.col("x")[i].cast("double") for i in range(width)]).alias("yhat"))
    kind = dict(rows.dtypes)["eid"]
    names = ("n", "mean", "moment")
    schema = "n array<double>, mean array<double>, moment array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            eid, size, at, y, place, yhat, shift = batch.columns
            out = []
            for i in range(batch.num_rows):
                own, where, target = (c[i].values.to_numpy(zero_copy_only=False) for c in (at, place, y))
                flat = yhat[i].values.flatten()
                x = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
                whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
                turns, n = shift[i].values.to_numpy(), size[i].as_py()
                given = y[i].values.is_valid().to_numpy(zero_copy_only=False)
                step, blocks = max(1, OUT_ROWS // len(own)), []
                for begin in range(0, len(turns), step):
                    to = (own[None, :] + turns[begin:begin + step, None]) % n
                    found = np.minimum(np.searchsorted(where, to), len(where) - 1)
                    blocks.append(Turns.of(x, target, found, (where[found] == to) & whole[found] & given).packed())
                out.append([np.concatenate(b) for b in zip(*blocks)])
            yield pa.RecordBatch.from_arrays([eid, *[pa.array([o[c] for o in out], pa.list_(pa.float64())) for c in range(3)]],
                                             names=["eid", *names])

    near = _met(known, reps, seed, chunk).mapInArrow(run, f"eid {kind}, {schema}")
    return merged_by(near, ["eid"], names, schema, Turns, Turns.packed)


def null_trialstruct(train: DataFrame, test: DataFrame, features: Sequence[str]
                     ) -> DataFrame:
    """Predict from trial structure alone: train means of the features, no neural data.

    Cells without a train row fall back to the first feature, then to the overall mean.
    """
    fine = train.groupBy(*features).agg(F.avg("y").alias("_fine"))
    coarse = train.groupBy(features[0]).agg(F.avg("y").alias("_coarse"))
    overall = train.agg(F.avg("y")).head()[0]
    guess = F.coalesce("_fine", "_coarse", F.lit(overall))
    return (test.join(fine, list(features), "left").join(coarse, features[0], "left")
            .withColumn("yhat", guess).drop("_fine", "_coarse"))


def null_p_value(model: DataFrame, null: DataFrame, keys: Sequence[str] = ("eid",),
                 higher_is_better: bool = True, tie: float = 1e-9) -> DataFrame:
    """One-sided p-value (1 + nulls at least as good) / (1 + nulls) and margin to the null mean.

    Scores closer than ``tie`` are equal: sums of the same numbers differ in the last bits.
    """
    a, b = F.col("score"), F.col("null_score")
    as_good = (b >= a - tie) if higher_is_better else (b <= a + tie)
    margin = (F.max(a) - F.avg(b)) if higher_is_better else (F.avg(b) - F.max(a))
    joined = null.withColumnRenamed("score", "null_score").join(model, list(keys))
    return joined.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_null"),
        ((1 + F.count_if(as_good)) / (1 + F.count(F.lit(1)))).alias("p_value"),
        margin.alias("margin"))
