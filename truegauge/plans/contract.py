"""The evaluation contract and the protocols built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed row names of the contract.
ROWS = ("ceiling_within", "null_shuffle", "null_trialstruct", "baseline_ridge",
        "baseline_multisession", "model")


class Contract:
    """Six scored frames (eid, value) of one metric; it cannot be built without all six."""

    def __init__(self, metric: str, frames: Mapping[str, DataFrame],
                 higher_is_better: bool) -> None:
        missing = [r for r in ROWS if r not in frames]
        unknown = [r for r in frames if r not in ROWS]
        if missing or unknown:
            raise ValueError(f"contract rows missing {missing}, unknown {unknown}")
        self.metric, self.higher_is_better = metric, higher_is_better
        self.long = reduce(DataFrame.unionByName, [
            frames[r].select("eid", F.lit(r).alias("row_kind"), "value") for r in ROWS])

    def per_session(self) -> DataFrame:
        return self.long.groupBy("eid").agg(*[
            F.max(F.when(F.col("row_kind") == r, F.col("value"))).alias(r) for r in ROWS])

    def table(self) -> DataFrame:
        """The six rows: sessions, mean and deviation of the metric over sessions."""
        return self.long.groupBy("row_kind").agg(
            F.count("value").alias("n_sessions"), F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"))

    def gate(self, margin: float) -> DataFrame:
        """Does the ridge baseline clear the trial-structure null by ``margin``?"""
        gain = F.col("baseline_ridge") - F.col("null_trialstruct")
        gain = gain if self.higher_is_better else -gain
        return self.per_session().agg(
            F.count(gain).alias("n_sessions"), F.avg(gain).alias("mean_gain"),
            (F.avg(gain) > margin).alias("passed"))


def gap_table(scores: DataFrame, higher_is_better: bool) -> DataFrame:
    """Mean score per split kind and its drop from within_session.

    ``scores`` has kind, eid, value. The drop is positive when the held-out kind is
    worse, over the sessions scored under both.
    """
    ceiling = scores.where("kind = 'within_session'").select("eid", F.col("value").alias("_top"))
    sign = 1 if higher_is_better else -1
    return scores.join(ceiling, "eid", "left").groupBy("kind").agg(
        F.count("value").alias("n_sessions"), F.avg("value").alias("mean"),
        F.avg(sign * (F.col("_top") - F.col("value"))).alias("drop"))


def too_close(gaps: DataFrame, tolerance: float) -> DataFrame:
    """Smell: a held-out kind whose drop is suspiciously small."""
    return gaps.where((F.col("kind") != "within_session") & (F.col("drop") < tolerance))


def inflation(leaky: DataFrame, honest: DataFrame, higher_is_better: bool) -> DataFrame:
    """Score of the leaky split minus the honest one per session, positive if inflated."""
    a = leaky.select("eid", F.col("value").alias("leaky"))
    b = honest.select("eid", F.col("value").alias("honest"))
    diff = F.col("leaky") - F.col("honest")
    return a.join(b, "eid").withColumn("inflation", diff if higher_is_better else -diff)


def drift(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("eid", "row_kind"),
          tolerance: float = 1e-9) -> DataFrame:
    """Rows of two contract runs that differ, appeared or vanished."""
    a = before.select(*keys, F.col("value").alias("before"))
    b = after.select(*keys, F.col("value").alias("after"))
    change = F.col("after") - F.col("before")
    same = F.coalesce(F.abs(change) <= tolerance,
                      F.col("before").isNull() & F.col("after").isNull())
    return a.join(b, list(keys), "full").where(~same).withColumn("change", change)


def over_list(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Average over a fixed list of sessions, as published averages are taken."""
    return scores.join(wanted.select("eid").distinct(), "eid", "left_semi").groupBy("row_kind").agg(
        F.count("value").alias("n_sessions"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"))


def relative_horizon(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Error per horizon next to the behaviour-only baseline; ratio < 1 is a gain."""
    a = model.select("horizon", F.col("rmse").alias("model_rmse"))
    b = baseline.select("horizon", F.col("rmse").alias("baseline_rmse"))
    return a.join(b, "horizon").withColumn("ratio", F.try_divide("model_rmse", "baseline_rmse"))


def matrix(scores: DataFrame, kinds: Sequence[str], value: Column | str = "value") -> DataFrame:
    """Methods by split kinds, one column per kind; the kinds are given, not discovered."""
    v = F.col(value) if isinstance(value, str) else value
    return scores.groupBy("method").agg(*[
        F.avg(F.when(F.col("kind") == k, v)).alias(k) for k in kinds])
