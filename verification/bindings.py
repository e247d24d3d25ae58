"""Binds the operators to the driver tables.

events: subject = user, lab = nation of the customer, session = 6-day block of a
user, unit = event type, behaviour = value, a trial starts at each signup.
orders/lineitem: animal = customer, session = order, unit = line, region = part
type. embeddings: session = vec_id. labels/documents: binary outcomes. pages: text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_bucket
from truegauge.operators import binning, splits, targets
from truegauge.session import cut_lineage

SESSION_US = 6 * 86_400_000_000
BIN_US = 21_600_000_000
N_BINS = 24
CONTEXT = 4
GAP = 4
CLASSES = 10


class Tables:
    """Tables of one scale folder.

    Sessions, units, bins and regression rows are what a recording pipeline stores:
    they are derived from the events once and written, not scanned for again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- events ---------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
        return (self.read("events").withColumn("abs_us", at)
                .select("event_id", F.col("user_id").alias("subject"),
                        F.expr(f"user_id * 10 + abs_us div {SESSION_US}").alias("eid"),
                        F.col("event_type").alias("unit_id"),
                        (F.col("abs_us") % SESSION_US).alias("t_us"), "value",
                        F.get_json_object("props", "$.k").cast("int").alias("k")))

    @cached_property
    def spikes(self) -> DataFrame:
        return self.events.select("eid", "unit_id", "t_us")

    @cached_property
    def behaviour(self) -> DataFrame:
        return self.events.select("eid", F.lit("value").alias("series"),
                                  F.col("event_id").alias("sample_idx"), "t_us", "value")

    @cached_property
    def sessions(self) -> DataFrame:
        owners = self.read("customer").select(F.col("c_custkey").alias("subject"),
                                              F.col("c_nationkey").alias("lab"))
        return cut_lineage(
            self.events.select("eid", "subject").distinct().join(owners, "subject")
            .select("eid", "subject", F.col("lab").cast("bigint").alias("lab"),
                    F.lit(N_BINS).cast("bigint").alias("n_bins")))

    @cached_property
    def units(self) -> DataFrame:
        """Units present in a session; the label stands for the curated quality score."""
        return cut_lineage(
            self.events.groupBy("eid", "unit_id").agg(F.count(F.lit(1)).alias("n_spikes"))
            .withColumn("label", F.when(F.col("unit_id") == "error", 0.0).otherwise(1.0))
            .withColumn("region", F.substring("unit_id", 1, 1)))

    @cached_property
    def trial_starts(self) -> DataFrame:
        left = F.when(F.col("k") < 40, 0.2).when(F.col("k") < 60, 0.5).otherwise(0.8)
        return self.events.where("unit_id = 'signup'").select(
            "eid", "subject", F.col("event_id").alias("trial_id"), F.col("t_us").alias("start_us"),
            (F.col("k") % 3 - 1).cast("bigint").alias("choice"),
            left.alias("probability_left"),
            ((F.col("k") % 5) / 4.0).cast("double").alias("contrast"))

    @cached_property
    def trials(self) -> DataFrame:
        return targets.with_trial_ends(self.trial_starts, BIN_US)

    @cached_property
    def bins(self) -> DataFrame:
        return cut_lineage(binning.bin_spikes(self.spikes, BIN_US))

    @cached_property
    def dense(self) -> DataFrame:
        return binning.densify(self.bins, self.units, binning.whole_spans(self.sessions))

    @cached_property
    def within_blocks(self) -> DataFrame:
        return splits.split_within(self.sessions, 0.5, GAP)

    @cached_property
    def within(self) -> splits.Split:
        return splits.Split("within_session", self.within_blocks, CONTEXT, GAP, bin_width_us=BIN_US)

    @cached_property
    def aligned(self) -> DataFrame:
        return binning.align_mean(self.behaviour, BIN_US)

    @cached_property
    def velocity(self) -> DataFrame:
        return targets.wheel_velocity(self.aligned, BIN_US)

    @cached_property
    def samples(self) -> DataFrame:
        """Regression rows: y = mean behaviour in the bin, x1 = all counts, x2 = views.

        Every model reads them, so they are written once.
        """
        counts = self.bins.groupBy("eid", "bin").agg(
            F.sum("n").cast("double").alias("x1"),
            F.sum(F.when(F.col("unit_id") == "view", F.col("n")).otherwise(0))
            .cast("double").alias("x2"))
        y = self.aligned.select("eid", "bin", F.col("value").alias("y"))
        return cut_lineage(counts.join(y, ["eid", "bin"]))

    @cached_property
    def parted(self) -> DataFrame:
        return self.within.rows(self.samples, "train", "test")

    # --- orders / lineitem ----------------------------------------------------
    @cached_property
    def order_units(self) -> DataFrame:
        parts = self.read("part").select(F.col("p_partkey").alias("l_partkey"),
                                         F.col("p_type").alias("region"))
        return self.read("lineitem").join(parts, "l_partkey").select(
            F.col("l_orderkey").alias("eid"), "region",
            (F.col("l_returnflag") != "R").alias("passed"))

    @cached_property
    def order_sessions(self) -> DataFrame:
        owner = self.read("customer").select(F.col("c_custkey").alias("o_custkey"),
                                             F.col("c_nationkey").cast("bigint").alias("lab"))
        return self.read("orders").join(owner, "o_custkey").select(
            F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("subject"), "lab",
            F.lit(1).cast("bigint").alias("n_bins"))

    # --- embeddings -----------------------------------------------------------
    @cached_property
    def vectors(self) -> DataFrame:
        bucket = hash_bucket(100, "vec_id")
        part = F.when(bucket < 50, "train").when(bucket < 75, "calib").otherwise("test")
        return self.read("embeddings").select(
            F.col("vec_id").alias("eid"), F.col("label").cast("bigint").alias("y"),
            F.col("embedding").cast("array<double>").alias("x"), part.alias("part"))

    # --- labels / documents ---------------------------------------------------
    @cached_property
    def outcomes(self) -> DataFrame:
        docs = self.read("documents").select("doc_id", "source", "lang", "n_chars")
        p = F.col("n_chars") / (F.col("n_chars") + 400.0)
        return self.read("labels").join(docs, "doc_id").select(
            F.col("source").alias("eid"), "lang", F.col("doc_id").alias("row_id"),
            F.col("quality").cast("bigint").alias("y"), p.alias("p"),
            (p >= 0.5).cast("bigint").alias("yhat"))
