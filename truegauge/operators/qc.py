"""Unit quality control. Thresholds are frozen configuration, rates come from train time only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from truegauge.operators.intervals import join_points
from truegauge.operators.ordered import with_halo


@dataclass(frozen=True)
class QcConfig:
    min_label: float = 1.0
    min_rate_hz: float = 0.1
    max_rp_violation: float = 0.1
    rp_tau_us: int = 2_000


def firing_rate(spikes: DataFrame, units: DataFrame, spans: DataFrame,
                bucket_us: int = 60_000_000) -> DataFrame:
    """Spikes per second of each unit inside ``spans(eid, start_us, end_us)``.

    Pass the train spans of a split: a rate over the whole recording lets test time
    decide which units survive. Units silent in the spans get rate 0.
    """
    inside = join_points(spikes.select("eid", "unit_id", "t_us"), spans, ["eid"],
                         "t_us", "start_us", "end_us", bucket_us)
    counts = inside.groupBy("eid", "unit_id").agg(F.count(F.lit(1)).alias("n_spikes"))
    seconds = spans.groupBy("eid").agg(
        (F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds"))
    return (units.select("eid", "unit_id").join(counts, ["eid", "unit_id"], "left")
            .join(seconds, "eid")
            .select("eid", "unit_id", F.coalesce("n_spikes", F.lit(0)).alias("n_spikes"),
                    (F.coalesce("n_spikes", F.lit(0)) / F.col("seconds")).alias("rate_hz")))


def rp_violation(spikes: DataFrame, spans: DataFrame, tau_us: int,
                 bucket_us: int = 60_000_000) -> DataFrame:
    """Share of inter-spike intervals shorter than ``tau_us``; null for a single spike.

    As with ``firing_rate``, pass the train spans: test time must not decide which units
    survive. Only whether the previous spike lies within tau matters, so a halo of tau
    suffices. Spikes at one instant are intervals of zero.
    """
    inside = join_points(spikes.select("eid", "unit_id", "t_us"), spans, ["eid"],
                         "t_us", "start_us", "end_us", bucket_us)
    rows = with_halo(inside.select("eid", "unit_id", "t_us"), "t_us", 64 * tau_us, back=tau_us)
    prev = F.lag("t_us").over(W.partitionBy("eid", "unit_id", "_chunk").orderBy("t_us"))
    short = F.coalesce((F.col("t_us") - prev < tau_us).cast("bigint"), F.lit(0))
    isi = F.count(F.lit(1)) - 1
    return (rows.withColumn("_short", short).where("_core")
            .groupBy("eid", "unit_id")
            .agg(isi.alias("n_isi"),
                 F.try_divide(F.sum("_short"), isi).alias("rp_violation")))


def qc_units(units: DataFrame, rates: DataFrame, violations: DataFrame,
             config: QcConfig) -> DataFrame:
    """Verdict and first failed criterion per unit: label, then rate, then refractory period."""
    reason = (F.when(~(F.col("label") >= config.min_label) | F.col("label").isNull(), "label")
              .when(F.col("rate_hz") < config.min_rate_hz, "rate")
              .when(F.col("rp_violation") > config.max_rp_violation, "refractory")
              .otherwise("pass"))
    return (units.join(rates.select("eid", "unit_id", "rate_hz"), ["eid", "unit_id"])
            .join(violations.select("eid", "unit_id", "rp_violation"), ["eid", "unit_id"], "left")
            .withColumn("reason", reason)
            .withColumn("passed", F.col("reason") == "pass"))


def qc_report(verdicts: DataFrame) -> DataFrame:
    def count(reason: str):
        return F.count_if(F.col("reason") == reason)
    return verdicts.groupBy("eid").agg(
        F.count(F.lit(1)).alias("n_units"), count("pass").alias("n_pass"),
        count("label").alias("n_fail_label"), count("rate").alias("n_fail_rate"),
        count("refractory").alias("n_fail_refractory"))
