"""Descriptive latent states, named latent_state_<k> and nothing more."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.arrays import dot
from truegauge.functions.timing import bin_of
from truegauge.operators.binning import CHUNK_BINS
from truegauge.operators.ordered import previous, running
from truegauge.operators.targets import state_epochs
from truegauge.session import cut_lineage


def _assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def assign_states(train: DataFrame, rows: DataFrame, features: Sequence[str], k: int,
                  seed: int = 7) -> DataFrame:
    """k-means states fit on train rows, numbered by the first feature of their centre."""
    model = KMeans(k=k, seed=seed).fit(_assemble(train, features))
    order = sorted(range(k), key=lambda i: tuple(model.clusterCenters()[i]))
    rank = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(k)]), F.col("prediction") + 1)
    return (model.transform(_assemble(rows, features))
            .withColumn("state", F.concat(F.lit("latent_state_"), rank.cast("string")))
            .drop("features", "prediction"))


def transitions(states: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Counts and probabilities of moves between directly consecutive bins."""
    seen = previous(states.select(*keys, "bin", "state"), keys, ["bin"],
                    bin_of("bin", CHUNK_BINS), ["bin", "state"])
    moves = (seen.where(F.col("prev_bin") == F.col("bin") - 1)
             .groupBy(F.col("prev_state").alias("from_state"), F.col("state").alias("to_state"))
             .agg(F.count(F.lit(1)).alias("n")))
    sizes = moves.groupBy("from_state").agg(F.sum("n").alias("_size"))
    return moves.join(sizes, "from_state").select(
        "from_state", "to_state", "n", (F.col("n") / F.col("_size")).alias("probability"))


def dwell_times(states: DataFrame, keys: Sequence[str] = ("eid",)) -> DataFrame:
    length = F.col("end_bin") - F.col("start_bin") + 1
    return state_epochs(states, keys).groupBy("state").agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg(length).alias("mean_bins"),
        F.max(length).alias("max_bins"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information (nats) of two discrete columns from their joint counts."""
    joint = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    left = joint.groupBy(a).agg(F.sum("n").alias("na"))
    right = joint.groupBy(b).agg(F.sum("n").alias("nb"))
    n = joint.agg(F.sum("n")).head()[0] or 1
    p = F.col("n") / F.lit(n)
    term = p * F.ln(F.col("n") * F.lit(float(n)) / (F.col("na") * F.col("nb")))
    return joint.join(left, a).join(right, b).agg(F.sum("n").alias("n"), F.sum(term).alias("mi"))


def transition_lags(states: DataFrame, events: DataFrame, width_us: int,
                    lag_us: int) -> DataFrame:
    """Histogram of the signed time from each state change to its nearest event.

    Changes and events are merged in time; last and next event meet at every
    change in one pass, so no change is paired with all events. Equal distances go to the earlier
    event.
    """
    changes = state_epochs(states, order="_first").where(~F.col("_first")).select(
        "eid", (F.col("start_bin") * width_us).alias("t_us"), F.lit(1).alias("_mark"))
    both = cut_lineage(changes.unionByName(events.select("eid", "t_us").withColumn("_mark", F.lit(0))))
    at = F.when(F.col("_mark") == 0, F.col("t_us"))
    full = running(both, ["eid"], ["t_us", "_mark"], bin_of("t_us", width_us * CHUNK_BINS),
                   {"_before": ("last", at)}, back={"_after": ("last", at)})
    since, until = F.col("t_us") - F.col("_before"), F.col("_after") - F.col("t_us")
    lag = (F.when(until.isNull() | (since <= until), -since).otherwise(until))
    return (full.where("_mark = 1").where(F.col("_before").isNotNull() | F.col("_after").isNotNull())
            .groupBy(bin_of(lag, lag_us).alias("lag_bin")).agg(F.count(F.lit(1)).alias("n")))


def state_counts(train: DataFrame, rows: DataFrame, features: Sequence[str],
                 candidates: Sequence[int], seed: int = 7, restarts: int = 2) -> DataFrame:
    """Number of states each session prefers by BIC among shared mixtures, per session.

    The mixtures are fit once on train rows; a session only sums its log likelihoods, so
    no session is ever gathered in one place.
    """
    d = len(features)
    fitted = cut_lineage(_assemble(train, features).select("features"))
    scored = _assemble(rows, features).withColumn("_x", vector_to_array("features"))
    terms = []
    for k in candidates:
        # A mixture can get stuck; the best of a few starts is kept.
        starts = [GaussianMixture(k=k, seed=seed + i, maxIter=60, tol=1e-3).fit(fitted)
                  for i in range(restarts)]
        model = max(starts, key=lambda m: m.summary.logLikelihood)
        parts = [_log_density(model.weights[i], g) for i, g in enumerate(model.gaussians)]
        top = F.greatest(*parts) if len(parts) > 1 else parts[0]
        like = top + F.ln(sum((F.exp(p - top) for p in parts), F.lit(0.0)))
        free = k * (d + d * (d + 1) // 2) + k - 1
        terms.append((-2 * F.sum(like) + free * F.ln(F.count(F.lit(1)))).alias(f"bic_{k}"))
    bics = scored.groupBy("eid").agg(F.count(F.lit(1)).alias("n_bins"), *terms)
    best = F.array_min(F.array(*[F.struct(F.col(f"bic_{k}").alias("bic"), F.lit(k).alias("k"))
                                 for k in candidates]))
    return bics.select("eid", "n_bins", best["k"].cast("bigint").alias("n_states"))


def _log_density(weight: float, gaussian):
    """ln(weight * normal density) of one mixture component on the array column ``_x``."""
    import numpy as np
    mean = gaussian.mean.toArray()
    cov = np.asarray(gaussian.cov.toArray())
    d = len(mean)
    values, vectors = np.linalg.eigh(cov)
    # A direction without spread keeps a floor, so that points off the component pay for it.
    values = np.maximum(values, 1e-12)
    root = (vectors / np.sqrt(values)).T
    const = math.log(max(weight, 1e-300)) - 0.5 * (
        d * math.log(2 * math.pi) + float(np.log(values).sum()))
    square = F.lit(0.0)
    for row in root:
        z = dot(F.col("_x"), row) - F.lit(float(row @ mean))
        square = square + z * z
    return F.lit(const) - 0.5 * square


def count_stability(counts: DataFrame) -> DataFrame:
    """Most frequent number of states and how far sessions spread around it."""
    return counts.agg(F.count(F.lit(1)).alias("n_sessions"), F.mode("n_states", True).alias("mode"),
                      F.min("n_states").alias("low"), F.max("n_states").alias("high"),
                      F.stddev_pop("n_states").alias("spread"))
