"""Toxicity as ordered severity grades by cumulative-link regression.

P(grade > j) = sigmoid(w.x - t_j): the grades share the weights w of the text's features and
differ in ordered thresholds t_0 < t_1 < ... Features are the words present in a text
(ASCII lower case; digits, letters, characters outside ASCII) and the beginnings of longer
words, which stand for stems in inflecting and compounding languages; hashed to ``CELLS`` cells.

Fitted on a sample of at most ``SAMPLE`` labelled texts a grade (those with the smallest hash of
their id) and on the ``FEATURES`` cells whose presence differs most between the lowest grade and
the others; an L1 penalty leaves few weights. A sampled text weighs as many labels as it stands for,
its grade's number over the number sampled, so shares, loss and thresholds are those of all labels
whether the bound cuts a grade or not. Every text is scored, whole. Null and empty
texts have no features: their score is that of the thresholds alone. Labels that are
null are left out; without two grades to learn from, all weights are zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.llm import tokens
from truegauge.session import ship_package

CELL_BITS = 22
CELLS = 1 << CELL_BITS
SAMPLE = 8000
FEATURES = 8192
#: Bytes of word beginnings.
STEMS = (5, 6, 7, 8, 9)
LEAST_TEXTS = 5
#: Standard errors by which a cell's share of texts must differ between lowest and other grades.
LEAST_SCORE = 5.0
PENALTY = 2e-4
STEPS = 1200
_PIECE = 1 << 21


@dataclass
class SeverityModel:
    """Weights by cell (zero for most) and ordered thresholds, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > j) per row and threshold."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -500, 500)))


def present(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a column: first row, rows, and the distinct (row, cell) pairs."""
    for at, piece in tokens.pieces(column, _PIECE):
        data, bounds = tokens.flat(piece)
        hashes, starts, stops, first = tokens.word_hashes(data, bounds, tokens.ALNUM)
        rows = np.repeat(np.arange(len(piece)), np.diff(first))
        found = [(rows, hashes)]
        for size in STEMS:
            long = np.flatnonzero(stops - starts > size)
            found.append((rows[long], tokens.beginnings(data, starts[long], size)))
        rows, hashes = (np.concatenate(x) for x in zip(*found))
        keys = np.unique(rows << CELL_BITS | (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64))
        yield at, len(piece), keys >> CELL_BITS, keys & (CELLS - 1)


def fit_thresholds(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_columns: int, n_grades: int,
                   penalty: float = PENALTY, steps: int = STEPS, stands_for: np.ndarray | None = None
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient on the mean log loss.

    ``stands_for``: labels that each row stands for, one if not given.
    """
    n, cuts = len(grades), n_grades - 1
    part = np.full(n, 1 / n) if stands_for is None else stands_for / stands_for.sum()
    share = np.array([part[grades > j].sum() for j in range(cuts)]).clip(1e-4, 1 - 1e-4)
    w, t = np.zeros(n_columns), -np.log(share / (1 - share))
    vw, vt = w.copy(), t.copy()
    # The loss bends at most half as much as the squares of the features with a constant one.
    v, constant = np.ones(n_columns), 1.0
    for _ in range(30):
        z = np.bincount(rows, v[columns], n) + constant
        z *= part
        v, constant = np.bincount(columns, z[rows], n_columns), z.sum()
        size = float(np.sqrt((v ** 2).sum() + constant ** 2))
        v, constant = v / size, constant / size
    rate = 1.0 / (0.6 * size)
    low, high = grades - 1, grades
    for step in range(steps):
        z = np.bincount(rows, vw[columns], n)
        edge = lambda j: np.where(j < 0, -500.0, np.where(
            j >= cuts, 500.0, vt[np.clip(j, 0, cuts - 1)] - z))
        upper, lower = (1 / (1 + np.exp(-np.clip(edge(j), -500, 500))) for j in (high, low))
        mass = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        slope = (du - dl) * part
        gw = np.bincount(columns, slope[rows], n_columns)
        gt = np.array([((dl * (low == j) - du * (high == j)) * part).sum() for j in range(cuts)])
        nw = vw - rate * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = np.maximum.accumulate(vt - rate * gt + np.arange(cuts) * 1e-9)
        pull = step / (step + 3)
        vw, vt = nw + pull * (nw - w), nt + pull * (nt - t)
        w, t = nw, nt
    return w, np.maximum.accumulate(t)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade",
        n_grades: int = 3, sample: int = SAMPLE) -> SeverityModel:
    """Fit on at most ``sample`` labelled texts a grade, each weighted by the labels that it stands for."""
    spark = docs.sparkSession
    ship_package(spark)
    plain = labels.select(F.col(key).alias("k"), F.col(grade).cast("int").alias("g")).where(
        F.col("k").isNotNull() & F.col("g").between(0, n_grades - 1))
    labelled = np.zeros(n_grades)
    for g, count in plain.groupBy("g").count().collect():
        labelled[g] = count
    stands_for = np.maximum(labelled / sample, 1.0)
    chosen = None
    for g in range(n_grades):
        part = plain.where(F.col("g") == g).orderBy(F.xxhash64("k"), "k").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    # At most n_grades * sample rows of two numbers.
    taught = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "k").select("g", "text")

    size = 4 * n_grades * CELLS

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros((n_grades, CELLS), np.int32), np.zeros(n_grades, np.int64)
        for batch in batches:
            grades = batch.column(0).to_numpy()
            for at, n, rows, found in present(batch.column(1)):
                own = grades[at:at + n].astype(np.int64)
                texts += np.bincount(own, minlength=n_grades)
                for g in np.unique(own):
                    seen[g] += np.bincount(found[own[rows] == g], minlength=CELLS).astype(np.int32)
        if texts.sum():
            yield pa.RecordBatch.from_arrays(
                [pa.array([pa.compress(seen.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                 pa.array([texts.tolist()], pa.list_(pa.int64()))], names=["seen", "texts"])

    def add(a, b):
        if a is None or b is None:
            return a or b
        counts = sum(np.frombuffer(pa.decompress(bytes(x[0]), size, codec="zstd"), np.int32) for x in (a, b))
        return pa.compress(counts.tobytes(), codec="zstd", asbytes=True), [x + y for x, y in zip(a[1], b[1])]

    total = taught.mapInArrow(cells, "seen binary, texts array<bigint>").rdd.map(tuple).treeAggregate(
        None, add, add, depth=2)
    model = SeverityModel(np.zeros(CELLS, np.float32), np.linspace(1.0, 2.0, n_grades - 1))
    if total is None or total[1][0] == 0 or sum(total[1][1:]) == 0:
        return model
    seen = np.frombuffer(pa.decompress(bytes(total[0]), size, codec="zstd"), np.int32).reshape(n_grades, CELLS)
    texts = np.array(total[1], float)
    # Labels that the lowest grade's texts and the others stand for, and with a cell; a text that stands
    # for many makes them no surer, so errors go by the effective number of texts.
    mass, with_cell = texts * stands_for, seen * stands_for[:, None]
    n = np.array([mass[0], mass[1:].sum()])
    sure = n ** 2 / np.array([mass[0] * stands_for[0], (mass[1:] * stands_for[1:]).sum()])
    pooled = with_cell.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / sure).sum())
    score = np.abs(with_cell[1:].sum(0) / n[1] - with_cell[0] / n[0]) / spread
    score *= (seen.sum(0) >= LEAST_TEXTS) & (score >= LEAST_SCORE)
    top = np.sort(np.argsort(-score, kind="stable")[:FEATURES])
    place = np.full(CELLS, -1, np.int32)
    place[top[score[top] > 0]] = np.arange((score[top] > 0).sum())
    shared = spark.sparkContext.broadcast(place)

    def chosen_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, rows, found in present(batch.column(1)):
                column = shared.value[found]
                rows, column = rows[column >= 0], column[column >= 0]
                parts = np.split(column.astype(np.int16), np.searchsorted(rows, np.arange(1, n)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["g", "cells"])

    # Sample rows with FEATURES small numbers each at most.
    data = taught.mapInArrow(chosen_cells, "g int, cells binary").toArrow()
    grades = data["g"].to_numpy().astype(np.int64)
    parts = [np.frombuffer(x, np.int16).astype(np.int64) for x in data["cells"].to_pylist()]
    order = sorted(range(len(parts)), key=lambda i: (grades[i], parts[i].tobytes()))  # as if in one order
    grades, parts = grades[order], [parts[i] for i in order]
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    w, thresholds = fit_thresholds(rows, np.concatenate(parts), grades, int(place.max()) + 1, n_grades,
                                   stands_for=stands_for[grades])
    model.weights[np.flatnonzero(place >= 0)] = w
    model.thresholds = thresholds
    return model


def scored(docs: DataFrame, model: SeverityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity, grade, toxic) per row: expected grade, most likely grade, P(grade > 0) >= 1/2."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # CELLS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, rows, found in present(batch.column(1)):
                above = shared.value.above(np.bincount(rows, shared.value.weights[found], n))
                full = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(above.sum(1)),
                     pa.array((full[:, :-1] - full[:, 1:]).argmax(1).astype(np.int32)),
                     pa.array(above[:, 0] >= 0.5)], names=["key", "severity", "grade", "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"key {kind}, severity double, grade int, toxic boolean").withColumnRenamed("key", key)
