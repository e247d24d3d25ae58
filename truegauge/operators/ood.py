"""Distribution-shift scores, larger = further from the training data, and gating."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truegauge.functions.arrays import log_sum_exp, total
from truegauge.operators.ordered import quantiles
from truegauge.session import cut_lineage, ship_package

# Fixed gate levels, from trusted to refused.
LEVELS = ("high", "moderate", "low", "abstain")


# --- distance to the training distribution ---------------------------------------------

@dataclass(frozen=True)
class Reference:
    """Mean and shrunk precision of the training vectors; dim x dim numbers."""

    mean: np.ndarray
    precision: np.ndarray

    def full(self, x: str = "x") -> Column:
        mean, root = self.mean, np.linalg.cholesky(self.precision)

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            if vectors.empty:
                return pd.Series([], dtype=float)
            centred = np.stack(vectors.to_numpy()).astype(float) - mean
            return pd.Series(((centred @ root) ** 2).sum(axis=1))
        return score(F.col(x))


def moments(train: DataFrame, dim: int, x: str = "x") -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sum and outer-product sum of an array column.

    Each task folds its Arrow batches into one dim x dim partial; the partials are
    added on the cluster position by position, so the driver gets dim * (dim + 1)
    numbers whatever the number of tasks.
    """
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                block = np.stack(batch[x].to_numpy()).astype(float)
                n, s, q = n + len(block), s + block.sum(axis=0), q + block.T @ block
        if n:
            flat = np.concatenate([[n], s, q.ravel()])
            yield pd.DataFrame({"pos": np.arange(len(flat)), "value": flat})
    partials = train.select(x).mapInPandas(fold, "pos int, value double")
    rows = partials.groupBy("pos").agg(F.sum("value").alias("value")).collect()
    if not rows:
        raise ValueError("no training rows")
    flat = np.zeros(1 + dim + dim * dim)
    for row in rows:
        flat[row["pos"]] = row["value"]
    return flat[0], flat[1:1 + dim], flat[1 + dim:].reshape(dim, dim)


def fit_reference(train: DataFrame, dim: int, shrink: float, x: str = "x") -> Reference:
    """Population covariance pulled towards its mean variance by ``shrink``."""
    n, s, q = moments(train, dim, x)
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    cov = (1 - shrink) * cov + shrink * np.trace(cov) / dim * np.eye(dim)
    precision = np.linalg.inv(cov)
    return Reference(mean, (precision + precision.T) / 2)


def diagonal_distance(train: DataFrame, rows: DataFrame, dim: int, x: str = "x",
                      out: str = "score") -> DataFrame:
    """Sum of squared z-scores, all inside the JVM."""
    found = train.agg(*[F.avg(F.col(x)[i]).alias(f"m{i}") for i in range(dim)],
                      *[F.var_pop(F.col(x)[i]).alias(f"v{i}") for i in range(dim)]).head()
    means = F.array(*[F.lit(found[f"m{i}"]) for i in range(dim)])
    weights = F.array(*[F.lit(1.0 / found[f"v{i}"] if found[f"v{i}"] else 0.0) for i in range(dim)])
    gap = F.zip_with(F.col(x), means, lambda a, m: (a.cast("double") - m) * (a.cast("double") - m))
    return rows.withColumn(out, total(F.zip_with(gap, weights, lambda g, w: g * w)))


# --- nearest neighbours ---------------------------------------------------------------

#: Rows of a block; a task holds a block of each side, or two while rows are assigned.
BLOCK_ROWS = 4096
#: Distances of rows to block centres that a task holds at once, and numbers of a slice of a distance matrix.
MOST_PAIRS, _SLICE = 1 << 18, 1 << 20
#: Vectors of the first level go to all tasks.
MOST_PIVOTS = 1024
_SLACK = 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _apart(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances, a slice of rows at a time."""
    out = np.empty((len(rows), len(centres)))
    step = max(1, _SLICE // max(1, centres.size))
    for at in range(0, len(rows), step):
        out[at:at + step] = np.sqrt(((rows[at:at + step, None, :] - centres[None]) ** 2).sum(axis=2))
    return out


def _k_least(rows: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """Distances of each row to its k nearest of a block, in order, a slice of rows at a time."""
    out, squares = np.empty((len(rows), k)), (block * block).sum(axis=1)
    step = max(1, _SLICE // max(1, len(block)))
    for at in range(0, len(rows), step):
        q = rows[at:at + step]
        own = (q * q).sum(axis=1)
        # Near ties of the rough distances are kept beside the k best, then measured exactly.
        rough = own[:, None] + squares[None] - 2 * q @ block.T
        border = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-12 * (own + squares.max())
        for i in range(len(q)):
            out[at + i] = np.sort(np.sqrt(((block[rough[i] <= border[i]] - q[i]) ** 2).sum(axis=1)))[:k]
    return out


def _salt(rows: Column, size: int) -> Column:
    """A group of ``rows`` rows in parts of about ``size``."""
    return F.pmod(F.xxhash64("qid"), F.greatest(F.ceil(rows / F.lit(size)), F.lit(1))).cast("int")


class Neighbours:
    """Training rows in blocks of bounded size under two levels of pivots.

    The number of pivots follows the number of rows: about one block per ``block_rows`` rows, their
    centres drawn from the rows by hash, under the square root of that many first-level
    pivots. Only these reach the driver; blocks (cell, sub, chunk, centre, radius, n) are a table.
    """

    def __init__(self, train: DataFrame, block_rows: int = BLOCK_ROWS, x: str = "x", pivots: int | None = None) -> None:
        ship_package(train.sparkSession)
        self.block_rows = block_rows
        self.rows = cut_lineage(self._numbered(train, x))
        n = self.rows.count()
        first = pivots or min(MOST_PIVOTS, max(1, ceil(sqrt(n / block_rows))))
        self.pivots = np.array([r["x"] for r in self.rows.orderBy(F.xxhash64("x", "qid"), "qid").limit(first).collect()])
        if not n:
            return
        first = len(self.pivots)
        celled = cut_lineage(self.in_cells(self.rows))
        # Per first-level cell: rows and the farthest of them.
        found = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()
        self.sizes, self.reach = np.zeros(first), np.full(first, -np.inf)
        for r in found:
            self.sizes[r["cell"]], self.reach[r["cell"]] = r["n"], r["reach"]
        spark = train.sparkSession
        share = max(1, block_rows // 2)
        drawn = celled.where(F.pmod(F.xxhash64(F.lit(7), "qid"), F.lit(share)) == 0).select("cell", F.col("x").alias("centre"))
        own = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(self.pivots)], "cell int, centre array<double>")
        centres = cut_lineage(own.unionByName(drawn).distinct().withColumn("sub", F.row_number().over(
            W.partitionBy("cell").orderBy(F.xxhash64("centre"), "centre"))))
        placed = self._with_centres(celled, celled, centres, self._nearest_sub, "qid bigint, x array<double>, sub int, far double")
        crowd = placed.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("crowd"))
        self.placed = cut_lineage(placed.join(crowd, ["cell", "sub"]).withColumn(
            "chunk", _salt(F.col("crowd"), block_rows)).drop("crowd"))
        self.blocks = cut_lineage(self.placed.groupBy("cell", "sub", "chunk").agg(
            F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(centres, ["cell", "sub"]))

    @staticmethod
    def _numbered(rows: DataFrame, x: str) -> DataFrame:
        """Every row has its own number, whatever its id is."""
        return rows.where(F.col(x).isNotNull()).select(
            *(["eid"] if "eid" in rows.columns else []), F.col(x).cast("array<double>").alias("x"),
            F.monotonically_increasing_id().alias("qid"))

    def in_cells(self, rows: DataFrame) -> DataFrame:
        """(qid, x, cell, reach): the nearest first-level pivot."""
        pivots = self.pivots

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = _apart(_matrix(batch["x"]), pivots)
                    yield batch.assign(cell=d.argmin(axis=1).astype("int32"), reach=d.min(axis=1))

        return rows.select("qid", "x").mapInPandas(run, "qid bigint, x array<double>, cell int, reach double")

    def _with_centres(self, rows: DataFrame, sized: DataFrame, centres: DataFrame, run, schema: str) -> DataFrame:
        """``run(rows of a cell, its centres)`` for parts of each cell's rows; the centres go to every part.

        Parts are the smaller, the more centres a cell has, so that a task's pairs don't grow with the table.
        """
        held = centres.groupBy("cell").agg(F.count(F.lit(1)).alias("_centres"))
        count = F.greatest(F.ceil(F.col("_rows") / F.lit(2 * self.block_rows)),
                           F.ceil(F.col("_rows") * F.col("_centres") / F.lit(MOST_PAIRS)), F.lit(1)).cast("int")
        sizes = sized.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows")).join(held, "cell").select(
            "cell", count.alias("_parts"))
        left = rows.join(sizes, "cell").withColumn("_part", F.pmod(F.xxhash64("qid"), F.col("_parts")).cast("int")).drop(
            "_parts")
        right = centres.join(sizes, "cell").withColumn("_part", F.explode(F.sequence(
            F.lit(0), F.col("_parts") - 1))).drop("_parts")

        def both(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = run(a, b) if len(a) and len(b) else None
            if found is None or found.empty:
                return pd.DataFrame(columns=["cell", *[c.split()[0] for c in schema.split(", ")]])
            return found.assign(cell=key[0])

        return left.groupBy("cell", "_part").cogroup(right.groupBy("cell", "_part")).applyInPandas(
            both, "cell int, " + schema)

    @staticmethod
    def _nearest_sub(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        d = _apart(_matrix(rows["x"]), _matrix(centres["centre"]))
        return pd.DataFrame({"qid": rows["qid"], "x": rows["x"], "sub": centres["sub"].to_numpy()[d.argmin(axis=1)],
                             "far": d.min(axis=1)})

    def own_block(self, asking: DataFrame, k: int) -> DataFrame:
        """(qid, x, cell, sub, chunk): the block of a row whose centre is nearest, of those with k rows if there are any."""
        def run(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            if (blocks["n"] >= k).any():
                blocks = blocks[blocks["n"] >= k]
            at = _apart(_matrix(rows["x"]), _matrix(blocks["centre"])).argmin(axis=1)
            return pd.DataFrame({"qid": rows["qid"], "x": rows["x"], "sub": blocks["sub"].to_numpy()[at],
                                 "chunk": blocks["chunk"].to_numpy()[at]})

        celled = cut_lineage(self.in_cells(asking))
        return self._with_centres(celled, celled, self.blocks, run, "qid bigint, x array<double>, sub int, chunk int")

    def met(self, asking: DataFrame, k: int) -> DataFrame:
        """(qid, distance): of each asking row (qid, x, cell, sub, chunk) its k nearest in that block.

        Asking rows of a block meet it in parts of bounded size.
        """
        keys = ["cell", "sub", "chunk"]
        sizes = asking.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        left = asking.join(sizes, keys).withColumn("_part", _salt(F.col("_rows"), self.block_rows)).drop("_rows")
        right = self.placed.select(*keys, "x").join(sizes, keys).withColumn("_part", F.explode(F.sequence(
            F.lit(0), F.greatest(F.ceil(F.col("_rows") / F.lit(self.block_rows)), F.lit(1)).cast("int") - 1))).drop("_rows")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"qid": np.array([], np.int64), "distance": np.array([], float)})
            c = _matrix(b["x"])
            take = min(k, len(c))
            out = _k_least(_matrix(a["x"]), c, take)
            return pd.DataFrame({"qid": np.repeat(a["qid"].to_numpy(), take), "distance": out.ravel()})

        parts = [*keys, "_part"]
        return left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInPandas(run, "qid bigint, distance double")

    def candidates(self, asking: DataFrame) -> DataFrame:
        """(qid, cell, sub, chunk): blocks that may hold a row within ``bound`` of an asking row (qid, x, bound)."""
        pivots, reach = self.pivots, self.reach

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    d = _apart(_matrix(batch["x"]), pivots)
                    limit = batch["bound"].to_numpy()[:, None] * (1 + _SLACK) + _SLACK
                    near = (d - reach <= limit) & np.isfinite(reach)
                    yield batch.assign(near=[np.flatnonzero(row).astype("int32") for row in near])

        def run(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            d = _apart(_matrix(rows["x"]), _matrix(blocks["centre"])) - blocks["radius"].to_numpy()
            i, j = np.nonzero(d <= rows["bound"].to_numpy()[:, None] * (1 + _SLACK) + _SLACK)
            return pd.DataFrame({"qid": rows["qid"].to_numpy()[i], "sub": blocks["sub"].to_numpy()[j],
                                 "chunk": blocks["chunk"].to_numpy()[j]})

        routed = asking.mapInPandas(cells, "qid bigint, x array<double>, bound double, near array<int>").select(
            "qid", "x", "bound", F.explode("near").alias("cell"))
        return self._with_centres(routed, routed, self.blocks, run, "qid bigint, sub int, chunk int")


def knn_search(test: DataFrame, near: Neighbours, k: int, x: str = "x") -> tuple[DataFrame, DataFrame]:
    """Returns (answers, meetings): eid, knn_mean, knn_kth of every row; and each row's blocks (qid, cell, sub, chunk).

    A row first meets its own block; its k-th distance there is a true bound, and the triangle inequality
    leaves only blocks within it. No task holds more than one block of each side, and a meeting returns k
    distances a row, never pairs. Rows that repeat an eid are answered one by one.
    """
    asking = cut_lineage(near._numbered(test, x))
    own = cut_lineage(near.own_block(asking, k))
    first = cut_lineage(near.met(own, k))
    bounds = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(
        F.lit(float("inf"))).alias("bound"))
    # A row whose cell is empty has no bound yet.
    known = asking.select("qid", "x").join(bounds, "qid", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf"))))
    keys = ["qid", "cell", "sub", "chunk"]
    more = cut_lineage(near.candidates(known).join(own.select(*keys), keys, "left_anti"))
    found = first.unionByName(near.met(more.join(asking.select("qid", "x"), "qid"), k))
    # Only the k best per row survive, and Spark drops the others before the shuffle.
    rank = F.row_number().over(W.partitionBy("qid").orderBy("distance"))
    best = found.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("qid").agg(
        F.avg("distance").alias("knn_mean"), F.max("distance").alias("knn_kth"))
    return (asking.select("qid", "eid").join(best, "qid").drop("qid"),
            own.select(*keys).unionByName(more.select(*keys)))


def knn_distance(test: DataFrame, train: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS,
                 x: str = "x") -> DataFrame:
    """Exact mean and k-th distance of each test row to its k nearest train rows (all of them, if fewer).

    ``pivots`` sets the number of first-level pivots, which follows the rows by default.
    """
    near = Neighbours(train, block_rows, x, pivots)
    if not len(near.pivots):
        return test.select("eid", F.lit(None).cast("double").alias("knn_mean"),
                           F.lit(None).cast("double").alias("knn_kth")).where("false")
    return knn_search(test, near, k, x)[0]


# --- scores from the model's own outputs ------------------------------------------------

def energy(logits: str = "logits", temperature: float = 1.0) -> Column:
    return -F.lit(float(temperature)) * log_sum_exp(F.col(logits), temperature)


def vote_entropy(votes: Column, classes: int) -> Column:
    """Entropy of the classes an ensemble voted for (array of class indices)."""
    def share(c: int) -> Column:
        return F.size(F.filter(votes, lambda v: v == c)) / F.size(votes)
    shares = F.array(*[share(c) for c in range(classes)])
    return -total(F.transform(shares, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))


def argmax(logits: Column) -> Column:
    return F.array_position(logits, F.array_max(logits)) - 1


# --- metadata ----------------------------------------------------------------------------

def profile_distance(units: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    """Total variation between a session's shares of a unit category and the train shares.

    The category can be the region or a bin of depth, rate or coordinate. Categories a
    session lacks contribute their train share; that part is folded into the constant 1,
    so sessions are never crossed with the list of categories.
    """
    counts = units.groupBy("eid", column).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("eid").agg(F.sum("n").alias("size"))
    known = units.join(train.select("eid"), "eid", "left_semi").groupBy(column).agg(
        F.count(F.lit(1)).alias("_n"))
    whole = known.agg(F.sum("_n")).head()[0]
    shares = known.select(column, (F.col("_n") / F.lit(whole)).alias("_t"))
    t = F.coalesce("_t", F.lit(0.0))
    return (counts.join(sizes, "eid").join(shares, column, "left").groupBy("eid")
            .agg((0.5 * (1 + F.sum(F.abs(F.col("n") / F.col("size") - t) - t))).alias(out)))


def z_distance(features: DataFrame, train: DataFrame, columns: Sequence[str],
               out: str = "z_l2") -> DataFrame:
    """Euclidean norm of the features z-scored with train statistics (a handful of numbers)."""
    known = features.join(train.select("eid"), "eid", "left_semi")
    s = known.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                  *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).head()
    square = F.lit(0.0)
    for c in columns:
        if s[f"s_{c}"]:
            z = (F.coalesce(F.col(c), F.lit(s[f"m_{c}"])) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"])
            square = square + z * z
    return features.withColumn(out, F.sqrt(square))


def metadata_distance(units: DataFrame, features: DataFrame, train: DataFrame,
                      columns: Sequence[str], profiles: Sequence[str] = ("region",)) -> DataFrame:
    """Composition profiles of the units plus numeric session metadata, as one session score."""
    out, score = z_distance(features, train, columns), F.col("z_l2")
    for p in profiles:
        out = out.join(profile_distance(units, train, p, f"{p}_tv"), "eid")
        score = score + F.col(f"{p}_tv")
    return out.withColumn("score", score)


# --- sessions and gates ---------------------------------------------------------------

def session_scores(windows: DataFrame, score: str = "score", tail: float = 0.9) -> DataFrame:
    means = windows.groupBy("eid").agg(F.avg(score).alias("mean_score"))
    return means.join(quantiles(windows, ["eid"], score, {"tail_score": tail}), "eid")


def gate(scores: DataFrame, calib: DataFrame, score: str = "score",
         cuts: Mapping[str, float] | None = None) -> DataFrame:
    """high / moderate / low / abstain by calibration quantiles, never by test data."""
    wanted = cuts or {"moderate": 0.5, "low": 0.8, "abstain": 0.95}
    limits = quantiles(calib, [], score, wanted).head()
    level = F.when(F.col(score).isNull(), "abstain")
    for name in ("abstain", "low", "moderate"):
        level = level.when(F.col(score) > F.lit(limits[name]), name)
    return scores.withColumn("gate", level.otherwise("high"))
