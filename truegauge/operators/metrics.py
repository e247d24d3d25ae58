"""Scores per session (or any other keys): counts and moments in one aggregation each.

Classification rows have y and yhat, binary scores p = P(y = 1), regression rows y and
yhat, intervals lo and hi, prediction sets an array of classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.stats import correlation
from truegauge.operators.ordered import cumulative_cells

KEYS = ("eid",)


def confusion(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Balanced accuracy (mean recall of the classes present) next to plain accuracy."""
    recall = confusion(rows, keys).groupBy(*keys, "y").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n"))
                                     .otherwise(0)).alias("hit"))
    return recall.groupBy(*keys).agg(
        F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"),
        (F.sum("hit") / F.sum("n")).alias("accuracy"))


def auroc(rows: DataFrame, score: str = "p", keys: Sequence[str] = KEYS,
          chunk: Column | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null with one class only."""
    cells = cumulative_cells(rows, keys, score, {
        "pos": F.count_if(F.col("y") == 1), "neg": F.count_if(F.col("y") == 0)}, chunk)
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return cells.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auroc"))


def f1(rows: DataFrame, keys: Sequence[str] = KEYS, positive: int = 1) -> DataFrame:
    """F1 of the positive class and the mean over all classes seen or predicted."""
    cells = confusion(rows, keys)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero)
    sides = F.array(F.struct(F.col("y").alias("cls"), hit.alias("tp"), F.col("n").alias("size")),
                    F.struct(F.col("yhat").alias("cls"), zero.alias("tp"), F.col("n").alias("size")))
    per = (cells.withColumn("_s", F.explode(sides)).groupBy(*keys, F.col("_s.cls").alias("cls"))
           .agg((2 * F.sum("_s.tp") / F.sum("_s.size")).alias("f1")))
    return per.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("cls") == positive, F.col("f1"))), F.lit(0.0)).alias("f1"),
        F.avg("f1").alias("macro_f1"))


def log_loss(rows: DataFrame, keys: Sequence[str] = KEYS, eps: float = 1e-15) -> DataFrame:
    """Binary log loss of p clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    own = F.when(F.col("y") == 1, p).otherwise(1 - p)
    return rows.groupBy(*keys).agg((-F.avg(F.ln(own))).alias("log_loss"))


def class_log_loss(rows: DataFrame, keys: Sequence[str] = KEYS, eps: float = 1e-15) -> DataFrame:
    """Log loss of ``probs`` (array by class index) at class y."""
    own = F.greatest(F.element_at("probs", (F.col("y") + 1).cast("int")), F.lit(eps))
    return rows.groupBy(*keys).agg((-F.avg(F.ln(own))).alias("log_loss"))


def reliability(rows: DataFrame, bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reliability diagram: per equal-width bin of p the mean p, the hit rate and the count."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1).cast("bigint"))
    return rows.groupBy(*keys, b.alias("pbin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"),
        F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(rows: DataFrame, bins: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected and maximum calibration error, and the signed mean gap (over-confidence > 0)."""
    gap = F.col("mean_p") - F.col("rate")
    return reliability(rows, bins, keys).groupBy(*keys).agg(
        (F.sum(F.col("n") * F.abs(gap)) / F.sum("n")).alias("ece"),
        F.max(F.abs(gap)).alias("mce"),
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("signed_gap"))


def regression(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """r2, pearson, mae, rmse in a single pass; r2 is null for a constant target."""
    err = F.col("y") - F.col("yhat")
    sse, n = F.sum(err * err), F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("n"), (1 - F.try_divide(sse, n * F.var_pop("y"))).alias("r2"),
        correlation("y", "yhat").alias("pearson"), F.avg(F.abs(err)).alias("mae"),
        F.sqrt(sse / n).alias("rmse"))


def interval_coverage(rows: DataFrame, nominal: float, keys: Sequence[str] = KEYS) -> DataFrame:
    hit = F.col("y").between(F.col("lo"), F.col("hi"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("coverage"),
        F.avg(F.col("hi") - F.col("lo")).alias("mean_width")
    ).withColumn("miss", F.col("coverage") - nominal)


def set_coverage(rows: DataFrame, nominal: float, keys: Sequence[str] = KEYS) -> DataFrame:
    hit = F.array_contains("set", F.col("y"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("coverage"),
        F.avg(F.size("set").cast("double")).alias("mean_size")
    ).withColumn("miss", F.col("coverage") - nominal)
