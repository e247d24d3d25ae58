"""Prediction targets: continuous per bin, label per trial, events and state runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truegauge.functions.timing import bin_of
from truegauge.operators.binning import CHUNK_BINS
from truegauge.operators.intervals import join_points
from truegauge.operators.ordered import previous, running, with_halo
from truegauge.session import cut_lineage

# The velocity filter is fixed and recorded with every run: it is never tuned.
VELOCITY_FILTER = "binned mean, central difference, 3-bin boxcar"


def _same_bins(*columns: Column) -> Column:
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return known


def wheel_velocity(position: DataFrame, width_us: int, keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Velocity per second from binned mean ``position(keys, bin, value)``.

    Central difference over the direct neighbour bins, then the mean over the
    velocities of bins -1..1 that exist. A bin lacking a neighbour has no velocity.
    """
    near = with_halo(position.select(*keys, "bin", "value"), "bin", CHUNK_BINS, back=2, ahead=2)
    w = W.partitionBy(*keys, "_chunk").orderBy("bin")
    lead_ok = F.lead("bin").over(w) == F.col("bin") + 1
    lag_ok = F.lag("bin").over(w) == F.col("bin") - 1
    diff = (F.lead("value").over(w) - F.lag("value").over(w)) / F.lit(2 * width_us / 1e6)
    raw = near.withColumn("_v", F.when(lead_ok & lag_ok, diff))
    box = W.partitionBy(*keys, "_chunk").orderBy("bin").rangeBetween(-1, 1)
    return (raw.withColumn("velocity", F.avg("_v").over(box))
            .where(F.col("_core") & F.col("_v").isNotNull())
            .select(*keys, "bin", "velocity"))


def choice_target(trials: DataFrame) -> DataFrame:
    """1 for a positive choice, 0 for a negative one; no-go trials (0 or null) are dropped."""
    return (trials.where(F.col("choice") != 0)
            .select("eid", "trial_id", (F.col("choice") > 0).cast("bigint").alias("y")))


def choice_counts(trials: DataFrame) -> DataFrame:
    """Kept and dropped trials per session, so that a drop is never silent."""
    kept = F.coalesce(F.col("choice") != 0, F.lit(False))
    return trials.groupBy("eid").agg(F.count_if(kept).alias("n_kept"),
                                     F.count_if(~kept).alias("n_no_go"))


def block_target(trials: DataFrame) -> DataFrame:
    """1 if left is likelier; the unbiased 0.5 block is excluded."""
    return (trials.where(F.col("probability_left") != 0.5)
            .select("eid", "trial_id", (F.col("probability_left") > 0.5).cast("bigint").alias("y")))


def movement_onset(velocity: DataFrame, threshold: float, quiet_bins: int,
                   keys: Sequence[str] = ("eid",)) -> DataFrame:
    """Bins where speed reaches the threshold after ``quiet_bins`` observed quiet bins."""
    near = with_halo(velocity.withColumn("_fast", F.abs("velocity") >= threshold), "bin",
                     max(CHUNK_BINS, quiet_bins + 1), back=quiet_bins)
    trailing = W.partitionBy(*keys, "_chunk").orderBy("bin").rangeBetween(-quiet_bins, -1)
    quiet = F.count_if(~F.col("_fast")).over(trailing) == quiet_bins
    return near.withColumn("_onset", quiet).where("_core AND _fast AND _onset").select(
        *keys, "bin", "velocity")


def movement_state(velocity: DataFrame, cuts: Sequence[float],
                   labels: Sequence[str]) -> DataFrame:
    """State by speed: ``labels[i]`` below ``cuts[i]``, the last label above all cuts."""
    if len(labels) != len(cuts) + 1 or list(cuts) != sorted(cuts):
        raise ValueError("need ascending cuts and one label more than cuts")
    speed, state = F.abs("velocity"), F
    for cut, label in zip(cuts, labels):
        state = state.when(speed < cut, label)
    return velocity.withColumn("state", state.otherwise(labels[-1]))


def state_epochs(states: DataFrame, keys: Sequence[str] = ("eid",),
                 state: str = "state", order: str | None = None) -> DataFrame:
    """Maximal runs of one state over consecutive bins, as inclusive [start_bin, end_bin].

    Whether a bin starts or ends a run shows in the bins next to it; only such bins are carried on, and a
    start meets the first end from there on. ``order`` names a column that tells a key's first run.
    """
    chunk = bin_of("bin", CHUNK_BINS)
    near = with_halo(states.select(*keys, "bin", state), "bin", CHUNK_BINS, back=1, ahead=1)
    beside = lambda step: F.max(state).over(W.partitionBy(*keys, "_chunk").orderBy("bin").rangeBetween(step, step))
    edges = near.withColumns({"_starts": ~F.coalesce(beside(-1) == F.col(state), F.lit(False)),
                              "_ends": ~F.coalesce(beside(1) == F.col(state), F.lit(False))}).where(
        "_core AND (_starts OR _ends)").drop("_chunk", "_core")
    edges = cut_lineage(edges)  # read for the chunk sums and for the rows
    first = {} if order is None else {"_earlier": ("min", F.col("bin"))}
    runs = running(edges, keys, ["bin"], chunk, {"end_bin": ("last", F.when(F.col("_ends"), F.col("bin")))}, reverse=True,
                   back=first).where("_starts")
    told = [] if order is None else [(F.col("_earlier") == F.col("bin")).alias(order)]
    return runs.select(*keys, state, F.col("bin").alias("start_bin"), "end_bin", *told)


def trial_bins(bins: DataFrame, trials: DataFrame, width_us: int, phases: int) -> DataFrame:
    """Each bin whose midpoint lies in a trial, with the trial's phase 0..phases-1.

    Trials without an end are left out: a duration is never invented.
    """
    mids = bins.withColumn("_mid", F.col("bin") * width_us + width_us // 2)
    closed = trials.where(F.col("end_us").isNotNull())
    hits = join_points(mids, closed, ["eid"], "_mid", "start_us", "end_us", width_us * 16)
    length = F.col("end_us") - F.col("start_us")
    phase = bin_of((F.col("_mid") - F.col("start_us")) * phases, length)
    return hits.withColumn("phase", phase).drop("_mid")


def horizon_targets(rows: DataFrame, value: str, horizons: Mapping[str, int],
                    keys: Sequence[str] = ("eid", "part")) -> DataFrame:
    """Long table of the value ``h`` bins ahead; rows without such a bin are dropped."""
    far = max(horizons.values())
    near = with_halo(rows, "bin", max(CHUNK_BINS, far + 1), ahead=far)
    w = W.partitionBy(*keys, "_chunk").orderBy("bin")
    ahead = [F.max(value).over(w.rangeBetween(h, h)).alias(f"_h_{name}")
             for name, h in horizons.items()]
    wide = near.select(*keys, "bin", F.col(value).alias("y_now"), "_core", *ahead).where("_core")
    return (wide.unpivot([*keys, "bin", "y_now"], [f"_h_{n}" for n in horizons],
                         "horizon", "y_ahead")
            .where(F.col("y_ahead").isNotNull())
            .withColumn("horizon", F.substring("horizon", 4, 100)))


def with_trial_ends(starts: DataFrame, chunk_us: int) -> DataFrame:
    """``end_us`` of each trial = start of the next one in the session; the last stays open."""
    nxt = previous(starts, ["eid"], ["start_us", "trial_id"], bin_of("start_us", chunk_us),
                   ["start_us"], prefix="next_", reverse=True)
    return nxt.withColumnRenamed("next_start_us", "end_us")
