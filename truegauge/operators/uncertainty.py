"""Calibration, ensembles and conformal prediction.

Coverage is exact only when calibration and test rows are exchangeable. Across
animals they are not: coverage is then reported with ``guarantee_applies`` false.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.arrays import dot, log_sum_exp
from truegauge.operators.baselines import LinearModel, gram, solve_ridge
from truegauge.operators.classifiers import member_draw
from truegauge.operators.ordered import kth_smallest, quantiles

# Kinds whose calibration and test rows can be taken as exchangeable. Within a session the test
# rows are later than the calibration rows, so they cannot.
EXCHANGEABLE_KINDS = ("held_out_session",)


def temperature_losses(calib: DataFrame, grid: Sequence[float], logits: str = "logits") -> DataFrame:
    """Mean negative log likelihood per temperature, with the best one marked.

    Every temperature is a column of one aggregation: the rows are read once and not
    multiplied by the grid. Equal losses go to the smaller temperature.
    """
    own = F.element_at(logits, (F.col("y") + 1).cast("int"))
    losses = [F.avg(log_sum_exp(F.col(logits), t) - own / F.lit(float(t))) for t in grid]
    cells = F.array(*[F.struct(loss.alias("nll"), F.lit(float(t)).alias("temperature"))
                      for loss, t in zip(losses, grid)])
    table = calib.agg(cells.alias("cells"))
    best = F.array_min("cells")["temperature"]
    return table.select(F.explode("cells").alias("c"), best.alias("best")).select(
        "c.temperature", "c.nll", (F.col("c.temperature") == F.col("best")).alias("chosen"))


def fit_temperature(calib: DataFrame, grid: Sequence[float], logits: str = "logits") -> float:
    return temperature_losses(calib, grid, logits).where("chosen").head()["temperature"]


def fit_ridge_ensemble(train: DataFrame, xs: Sequence[str], y: str, lam: float, members: int = 5,
                       share: int = 63, key: Sequence[str] = ("eid", "bin")) -> list[LinearModel]:
    """Members on hash-drawn subsets; the copies collapse map-side into one Gram each."""
    drawn = train.withColumn("member", F.explode(member_draw(key, members, share)))
    models = solve_ridge(gram(drawn, ["member"], xs, y), ["member"], len(xs), lam).collect()
    return [LinearModel(tuple(xs), m["intercept"], tuple(m["coef"]))
            for m in sorted(models, key=lambda m: m["member"])]


def array_moments(values: Column) -> tuple[Column, Column]:
    """Mean and population variance of an array column."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return mean, square / n


def ensemble_predict(rows: DataFrame, models: Sequence[LinearModel]) -> DataFrame:
    scored = rows.withColumn("_m", F.array(*[m.score() for m in models]))
    mean, variance = array_moments(F.col("_m"))
    return scored.withColumn("yhat", mean).withColumn("variance", variance).drop("_m")


def masked_weights(weights: Sequence[float], passes: int, drop_pct: int, seed: str) -> list[Column]:
    """Per pass the weights with hash-dropped inputs set to 0 and the rest scaled up."""
    keep = 1.0 - drop_pct / 100.0

    def kept(i: int, t: int) -> bool:
        digest = hashlib.md5(f"{i}|{t}|{seed}".encode()).hexdigest()
        return int(digest[:8], 16) % 100 >= drop_pct
    return [F.array(*[F.lit(float(w) / keep if kept(i, t) else 0.0)
                      for i, w in enumerate(weights)]) for t in range(passes)]


def masked_passes(rows: DataFrame, weights: Sequence[float], passes: int, drop_pct: int,
                  seed: str, x: str = "x") -> DataFrame:
    """Mean and deviation of a linear score over passes with dropped inputs.

    The masks depend on input and pass alone, so they are constants of the plan.
    """
    scores = F.array(*[dot(F.col(x), w) for w in masked_weights(weights, passes, drop_pct, seed)])
    scored = rows.withColumn("_s", scores)
    mean, variance = array_moments(F.col("_s"))
    return (scored.withColumn("score_mean", mean).withColumn("score_std", F.sqrt(variance))
            .drop("_s"))


def conformal_k(n: Column, alpha: float) -> Column:
    return F.ceil((n + 1) * F.lit(1.0 - alpha))


def conformal_threshold(calib: DataFrame, score: str, alpha: float,
                        keys: Sequence[str] = ()) -> DataFrame:
    """The ceil((n+1)(1-alpha))-th smallest score; infinite when n is too small for it."""
    return kth_smallest(calib, keys, score, conformal_k(F.col("size"), alpha), "threshold")


def conformal_sets(calib: DataFrame, test: DataFrame, alpha: float, p: str = "probs") -> DataFrame:
    """Prediction sets: all classes whose score 1 - p is within the calibration threshold."""
    own = F.element_at(p, (F.col("y") + 1).cast("int"))
    threshold = conformal_threshold(calib.select((1 - own).alias("score")), "score", alpha)
    limit = threshold.head()["threshold"]
    index = F.sequence(F.lit(0).cast("bigint"), F.size(p).cast("bigint") - 1)
    inside = F.filter(index, lambda c: 1 - F.element_at(p, (c + 1).cast("int")) <= F.lit(limit))
    return test.withColumn("set", inside)


def conformal_quantile(train: DataFrame, calib: DataFrame, test: DataFrame, bucket: str,
                       alpha: float, y: str = "y") -> DataFrame:
    """Conformalized quantile intervals without a quantile regressor.

    Raw quantiles per prediction bucket come from train rows; one widening constant
    from the calibration rows makes them cover. A bucket unseen in training gets an
    infinite interval rather than a guess.
    """
    raw = quantiles(train, [bucket], y, {"_lo": alpha / 2, "_hi": 1 - alpha / 2})
    miss = F.greatest(F.col("_lo") - F.col(y), F.col(y) - F.col("_hi"))
    scored = calib.join(raw, bucket, "left").withColumn(
        "score", F.coalesce(miss, F.lit(-math.inf)))
    widen = conformal_threshold(scored, "score", alpha).head()["threshold"]
    return test.join(raw, bucket, "left").select(
        *test.columns,
        F.coalesce(F.col("_lo") - F.lit(widen), F.lit(-math.inf)).alias("lo"),
        F.coalesce(F.col("_hi") + F.lit(widen), F.lit(math.inf)).alias("hi"))


def coverage_by_kind(rows: DataFrame, alpha: float) -> DataFrame:
    """Residual conformal coverage per split kind; rows have kind, part, y, yhat.

    A miss under animal or lab shift is the expected finding, never a guarantee.
    """
    res = rows.withColumn("score", F.abs(F.col("y") - F.col("yhat")))
    limits = conformal_threshold(res.where("part = 'calib'"), "score", alpha, ["kind"])
    tested = res.where("part = 'test'").join(limits.select("kind", "threshold"), "kind")
    return tested.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("score") <= F.col("threshold")).cast("double")).alias("coverage"),
        F.avg(2 * F.col("threshold")).alias("mean_width")
    ).withColumn("miss", F.col("coverage") - (1 - alpha)).withColumn(
        "guarantee_applies", F.col("kind").isin(*EXCHANGEABLE_KINDS))


def confidence_rows(rows: DataFrame, probs: Mapping[str, Column]) -> DataFrame:
    """Top-1 confidence p and hit y per method, long over the given methods."""
    def top(name: str, p: Column) -> Column:
        best = F.array_max(p)
        hit = F.element_at(p, (F.col("y") + 1).cast("int")) >= best
        return F.struct(F.lit(name).alias("method"), best.alias("p"),
                        hit.cast("bigint").alias("hit"))
    cells = F.explode(F.array(*[top(n, p) for n, p in probs.items()])).alias("_c")
    kept = [c for c in rows.columns if c not in ("y", "p", "hit", "method")]
    return rows.select(*[F.col(c) for c in kept], cells).select(
        *kept, "_c.method", "_c.p", F.col("_c.hit").alias("y"))


