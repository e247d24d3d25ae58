"""Metrics, baselines, nulls and the evaluation contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_bucket
from truegauge.operators import baselines, binning, metrics, nulls, splits, targets
from truegauge.plans import contract
from verification.bindings import BIN_US, Tables
from verification.ctes import bucket, cte, sql
from verification.registry import query, r6, rounded
from verification.splitting import interleaved

LAM = 0.1
REPS = 20

# --- metrics on binary outcomes ---------------------------------------------------

cte("recall", ("outcomes",), """
SELECT eid, y, count(*) AS n, count(*) FILTER (WHERE y = yhat) AS hit
FROM outcomes GROUP BY eid, y""")
cte("pbins", ("outcomes",), """
SELECT eid, least(floor(p * 10), 9)::BIGINT AS pbin, count(*) AS n, avg(p) AS mean_p,
       avg(y) AS rate FROM outcomes GROUP BY ALL""")


@query("m01_accuracy", sql("recall", """
SELECT eid, round(avg(hit / n), 6) AS balanced_accuracy, round(sum(hit) / sum(n), 6) AS accuracy
FROM recall GROUP BY eid"""))
def _(t: Tables):
    return rounded(metrics.accuracy(t.outcomes), "balanced_accuracy", "accuracy")


@query("m02_auroc", sql("outcomes", """
SELECT eid, round((sum(mid) FILTER (WHERE y = 1) - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auroc
FROM (SELECT *, rank() OVER (PARTITION BY eid ORDER BY p)
             + (count(*) OVER (PARTITION BY eid, p) - 1) / 2.0::DOUBLE AS mid,
             count(*) FILTER (WHERE y = 1) OVER (PARTITION BY eid) AS p_,
             count(*) FILTER (WHERE y = 0) OVER (PARTITION BY eid) AS n_ FROM outcomes)
     CROSS JOIN LATERAL (SELECT p_::DOUBLE AS p, n_::DOUBLE AS n) k(p, n)
GROUP BY eid, k.p, k.n""".replace("p * (p + 1)", "k.p * (k.p + 1)").replace(
    "nullif(p * n, 0)", "nullif(k.p * k.n, 0)")))
def _(t: Tables):
    return rounded(metrics.auroc(t.outcomes), "auroc")


@query("m02_auroc_by_language", sql("outcomes", """
SELECT lang, round(auroc, 6) AS auroc FROM (SELECT DISTINCT lang FROM outcomes) LEFT JOIN (
  SELECT a.lang, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END::DOUBLE)
         / count(*) AS auroc
  FROM outcomes a JOIN outcomes b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang) USING (lang)"""))
def _(t: Tables):
    return rounded(metrics.auroc(t.outcomes, keys=["lang"]), "auroc")


@query("m03_f1", sql("outcomes", """
SELECT eid, round(coalesce(max(f) FILTER (WHERE cls = 1), 0), 6) AS f1,
       round(avg(f), 6) AS macro_f1
FROM (SELECT eid, cls, 2 * sum(tp) / sum(size) AS f FROM (
        SELECT eid, y AS cls, (y = yhat)::INT AS tp, 1 AS size FROM outcomes
        UNION ALL SELECT eid, yhat, 0, 1 FROM outcomes) GROUP BY eid, cls)
GROUP BY eid"""))
def _(t: Tables):
    return rounded(metrics.f1(t.outcomes), "f1", "macro_f1")


@query("m04_log_loss", sql("outcomes", """
SELECT eid, round(-avg(ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-15), 1e-15)
                    ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)), 6) AS log_loss
FROM outcomes GROUP BY eid"""))
def _(t: Tables):
    return rounded(metrics.log_loss(t.outcomes), "log_loss")


@query("m05_m06_calibration_error", sql("pbins", """
SELECT eid, round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece,
       round(max(abs(mean_p - rate)), 6) AS mce,
       round(sum(n * (mean_p - rate)) / sum(n), 6) AS signed_gap FROM pbins GROUP BY eid"""))
def _(t: Tables):
    return rounded(metrics.calibration_error(t.outcomes), "ece", "mce", "signed_gap")


@query("m07_reliability", sql("pbins", """
SELECT eid, pbin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM pbins"""))
def _(t: Tables):
    return rounded(metrics.reliability(t.outcomes), "mean_p", "rate")


@query("m13_confusion", sql("outcomes", """
SELECT eid, y, yhat, count(*) AS n FROM outcomes GROUP BY ALL"""))
def _(t: Tables):
    return metrics.confusion(t.outcomes)


# --- ridge and metrics on its predictions ---------------------------------------------

def ridge_ctes(lam: float, name: str) -> None:
    cte(f"ridge{name}", ("parted",), f"""
SELECT b, my - b * mx AS a FROM (
  SELECT covar_pop(y, x1) / (var_pop(x1) + {lam}) AS b, avg(x1) AS mx, avg(y) AS my
  FROM parted WHERE part = 'train')""")
    cte(f"preds{name}", ("parted", f"ridge{name}"), f"""
SELECT eid, bin, bin - 16 AS pos, x1, x2, y, a + b * x1 AS yhat
FROM parted, ridge{name} WHERE part = 'test'""")


ridge_ctes(LAM, "")
ridge_ctes(10.0, "_stiff")
cte("rmse", ("preds",), """
SELECT eid, count(*) AS n, sqrt(avg((y - yhat) * (y - yhat))) AS value FROM preds GROUP BY eid""")


def ridge(t: Tables, lam: float = LAM, xs=("x1",)) -> baselines.LinearModel:
    return baselines.fit_ridge(t.within, t.samples, list(xs), "y", lam)


def preds(t: Tables, lam: float = LAM, xs=("x1",)):
    return ridge(t, lam, xs).predict(t.within.rows(t.samples, "test"))


def rmse(rows, keys=("eid",)):
    err = F.col("y") - F.col("yhat")
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(err * err)).alias("value"))


@query("m08_m11_regression", sql("preds", """
SELECT eid, count(*) AS n,
       round(1 - sum((y - yhat) * (y - yhat)) / CASE WHEN var_pop(y) > 0 THEN count(*) * var_pop(y) END, 6)
       AS r2, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse
FROM preds GROUP BY eid"""))
def _(t: Tables):
    return rounded(metrics.regression(preds(t)).drop("pearson"), "r2", "mae", "rmse")


@query("m09_pearson", sql("preds", """
SELECT bin, count(*) AS n, round(corr(y, yhat), 6) AS pearson FROM preds GROUP BY bin"""))
def _(t: Tables):
    scored = metrics.regression(preds(t), keys=["bin"])
    return rounded(scored.select("bin", "n", "pearson"), "pearson")


@query("m12_interval_coverage", sql("preds", """
SELECT eid, count(*) AS n, round(avg((y BETWEEN yhat - 15 AND yhat + 15)::INT), 6) AS coverage,
       30.0::DOUBLE AS mean_width, round(avg((y BETWEEN yhat - 15 AND yhat + 15)::INT) - 0.8, 6) AS miss
FROM preds GROUP BY eid"""))
def _(t: Tables):
    rows = preds(t).withColumn("lo", F.col("yhat") - 15).withColumn("hi", F.col("yhat") + 15)
    return rounded(metrics.interval_coverage(rows, 0.8), "coverage", "mean_width", "miss")


@query("h01_ridge", sql("preds", """
SELECT eid, bin, round(y, 6) AS y, round(yhat, 6) AS yhat FROM preds"""))
def _(t: Tables):
    return rounded(preds(t).select("eid", "bin", "y", "yhat"), "y", "yhat")


def _ridge2(where: str, group: str = "") -> str:
    by = f"GROUP BY {group}" if group else ""
    lead = f"{group}, " if group else ""
    return f"""
SELECT {lead}n, b1, b2, my - b1 * m1 - b2 * m2 AS a FROM (
  SELECT *, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1,
         (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM (
    SELECT {lead}count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
           var_pop(x1) + {LAM} AS c11, var_pop(x2) + {LAM} AS c22, covar_pop(x1, x2) AS c12,
           covar_pop(x1, y) AS d1, covar_pop(x2, y) AS d2
    FROM parted WHERE {where} {by}))"""


cte("ridge2", ("parted",), _ridge2("part = 'train'"))
cte("ridge2_each", ("parted",), _ridge2("part = 'train'", "eid"))
cte("ridge1_each", ("parted",), f"""
SELECT eid, b, my - b * mx AS a FROM (
  SELECT eid, covar_pop(y, x1) / (var_pop(x1) + {LAM}) AS b, avg(x1) AS mx, avg(y) AS my
  FROM parted WHERE part = 'train' GROUP BY eid)""")


@query("h01_ridge_two_features", sql("parted ridge2", """
SELECT eid, bin, round(a + b1 * x1 + b2 * x2, 6) AS yhat FROM parted, ridge2 WHERE part = 'test'"""))
def _(t: Tables):
    return rounded(preds(t, xs=("x1", "x2")).select("eid", "bin", "yhat"), "yhat")


def _newton(link: str, steps: int, source: str) -> str:
    """Newton steps for an intercept and a slope, one subquery per step."""
    mean = {"logit": "1 / (1 + exp(-(a + b * x)))", "log": "exp(a + b * x)"}[link]
    weight = {"logit": "m * (1 - m)", "log": "m"}[link]
    start = {"logit": "0.0::DOUBLE", "log": f"(SELECT ln(avg(y)) FROM {source})"}[link]
    beta = f"(SELECT {start} AS a, 0.0::DOUBLE AS b)"
    for _ in range(steps):
        beta = f"""(SELECT a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS a,
          b + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) AS b FROM (
          SELECT any_value(a) AS a, any_value(b) AS b, sum(y - m) AS g0, sum((y - m) * x) AS g1,
          sum({weight}) AS h00, sum({weight} * x) AS h01, sum({weight} * x * x) AS h11
          FROM (SELECT *, {mean} AS m FROM {source}, {beta})))"""
    return f"SELECT a, b FROM {beta}"


cte("binary_train", ("parted",),
    "SELECT x1 AS x, (y > 20)::INT AS y FROM parted WHERE part = 'train'")
cte("logistic", ("binary_train",), _newton("logit", 7, "binary_train"))
cte("poisson_train", ("parted",),
    "SELECT (bin % 4)::DOUBLE AS x, x1 AS y FROM parted WHERE part = 'train'")
cte("poisson", ("poisson_train",), _newton("log", 6, "poisson_train"))


@query("h02_logistic", sql("parted logistic", """
SELECT eid, bin, (y > 20)::BIGINT AS y, round(1 / (1 + exp(-(a + b * x1))), 4) AS p
FROM parted, logistic WHERE part = 'test'"""))
def _(t: Tables):
    rows = t.samples.withColumn("y", (F.col("y") > 20).cast("bigint"))
    model = baselines.fit_logistic(t.within, rows, ["x1"], "y")
    weight, icpt = float(model.coefficients[0]), float(model.intercept)
    linear = F.lit(icpt) + F.lit(weight) * F.col("x1")
    return t.within.rows(rows, "test").select(
        "eid", "bin", "y", F.round(1 / (1 + F.exp(-linear)), 4).alias("p"))


@query("h03_poisson", sql("parted poisson", """
SELECT eid, bin, x1 AS y, round(exp(a + b * (bin % 4)), 4) AS rate
FROM parted, poisson WHERE part = 'test'"""))
def _(t: Tables):
    rows = t.samples.withColumn("phase", (F.col("bin") % 4).cast("double"))
    model = baselines.fit_poisson(t.within, rows, ["phase"], "x1")
    linear = F.lit(float(model.intercept)) + F.lit(float(model.coefficients[0])) * F.col("phase")
    return t.within.rows(rows, "test").select(
        "eid", "bin", F.col("x1").alias("y"), F.round(F.exp(linear), 4).alias("rate"))


cte("basis", ("ridge2_each",), """
SELECT v1 * s AS v1, v2 * s AS v2 FROM (
  SELECT *, CASE WHEN abs(v1) >= abs(v2) THEN sign(v1) ELSE sign(v2) END AS s FROM (
    SELECT m12 / sqrt(m12 * m12 + (top - m11) * (top - m11)) AS v1,
           (top - m11) / sqrt(m12 * m12 + (top - m11) * (top - m11)) AS v2 FROM (
      SELECT *, (m11 + m22) / 2 + sqrt(((m11 - m22) / 2) * ((m11 - m22) / 2) + m12 * m12) AS top
      FROM (SELECT sum(n * b1 * b1) AS m11, sum(n * b1 * b2) AS m12, sum(n * b2 * b2) AS m22
            FROM ridge2_each))))""")
cte("rrr", ("parted", "basis"), f"""
SELECT eid, my - g * mz AS a, g * v1 AS b1, g * v2 AS b2 FROM (
  SELECT eid, any_value(v1) AS v1, any_value(v2) AS v2, avg(y) AS my, avg(z) AS mz,
         covar_pop(y, z) / (var_pop(z) + {LAM}) AS g
  FROM (SELECT *, v1 * x1 + v2 * x2 AS z FROM parted, basis WHERE part = 'train') GROUP BY eid)""")


def rrr(t: Tables):
    return baselines.fit_rrr(t.within, t.samples, ["x1", "x2"], "y", 1, LAM)


def coefficients(models):
    return models.select("eid", F.round("intercept", 5).alias("intercept"),
                         F.round(F.col("coef")[0], 5).alias("b1"),
                         F.round(F.col("coef")[1], 5).alias("b2"))


@query("h04_reduced_rank", sql("rrr", """
SELECT eid, round(a, 5) AS intercept, round(b1, 5) AS b1, round(b2, 5) AS b2 FROM rrr"""))
def _(t: Tables):
    return coefficients(rrr(t))


@query("h05_per_session", sql("ridge2_each", """
SELECT eid, round(sqrt(b1 * b1 + b2 * b2), 6) AS coef_norm, round(atan2(b2, b1), 6) AS coef_angle
FROM ridge2_each"""))
def _(t: Tables):
    models = baselines.fit_per_session(t.within, t.samples, ["x1", "x2"], "y", LAM)
    b1, b2 = F.col("coef")[0], F.col("coef")[1]
    return models.select("eid", r6(F.sqrt(b1 * b1 + b2 * b2)).alias("coef_norm"),
                         r6(F.atan2(b2, b1)).alias("coef_angle"))


cte("pairs", ("parted",), """
SELECT a.eid, a.part, a.bin, a.x1, a.y AS y_now, 't' || h::VARCHAR AS horizon, b.y AS y_ahead
FROM parted a CROSS JOIN (VALUES (1), (2), (5)) v(h)
JOIN parted b ON b.eid = a.eid AND b.part = a.part AND b.bin = a.bin + h""")


def _line(predictor: str) -> str:
    return f"""
SELECT p.horizon, count(*) AS n, sqrt(avg((y_ahead - (i + s * {predictor})) ** 2)) AS rmse
FROM pairs p JOIN (SELECT horizon, regr_slope(y_ahead, {predictor}) AS s,
                          regr_intercept(y_ahead, {predictor}) AS i
                   FROM pairs WHERE part = 'train' GROUP BY horizon) l ON l.horizon = p.horizon
WHERE part = 'test' GROUP BY p.horizon"""


cte("behaviour_only", ("pairs",), _line("y_now"))
cte("from_counts", ("pairs",), _line("x1"))


def pairs(t: Tables):
    rows = targets.horizon_targets(t.parted, "y", {"t1": 1, "t2": 2, "t5": 5})
    return rows.join(t.samples.select("eid", "bin", "x1"), ["eid", "bin"])


def horizon_rmse(scored):
    err = F.col("y_ahead") - F.col("yhat")
    return scored.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"),
                                         F.sqrt(F.avg(err * err)).alias("rmse"))


@query("h06_behaviour_only", sql("behaviour_only", """
SELECT horizon, n, round(rmse, 6) AS rmse FROM behaviour_only"""))
def _(t: Tables):
    return rounded(horizon_rmse(baselines.horizon_line(pairs(t))), "rmse")


POOLED = """
SELECT d.eid, d.bin, count(*) AS n_units, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std,
       max(n)::DOUBLE AS max, sum(n)::DOUBLE AS sum,
       round(avg(n) FILTER (WHERE region = 'v'), 6) AS mean_v,
       round(avg(n) FILTER (WHERE region = 'c'), 6) AS mean_c
FROM dense d JOIN units u USING (eid, unit_id) GROUP BY d.eid, d.bin"""


@query("h07_pool_units", sql("dense units", POOLED))
def _(t: Tables):
    pooled = baselines.pool_units(t.bins, t.units, binning.whole_spans(t.sessions), ["v", "c"])
    return rounded(pooled, "mean", "std", "mean_v", "mean_c")


@query("h08_invariance", sql("dense", """
SELECT eid, count(DISTINCT bin) AS n_rows, 0::BIGINT AS n_unmatched, 0.0::DOUBLE AS max_gap
FROM dense GROUP BY eid"""))
def _(t: Tables):
    """Units renamed, shuffled and joined by masked noise units: nothing may change."""
    spans = binning.whole_spans(t.sessions)
    pooled = baselines.pool_units(t.bins, t.units, spans, ["v", "c"])
    renamed = F.md5("unit_id")
    ghost = F.concat(F.lit("ghost"), F.col("unit_id"))
    units = t.units.select("eid", renamed.alias("unit_id"), "region", F.lit(True).alias("mask"))
    ghosts = t.units.select("eid", ghost.alias("unit_id"), "region", F.lit(False).alias("mask"))
    bins = t.bins.withColumn("unit_id", renamed)
    noise = t.bins.select("eid", ghost.alias("unit_id"), "bin", (F.col("n") + 1000).alias("n"))
    shuffled = baselines.pool_units(bins.unionByName(noise).repartition("bin"),
                                    units.unionByName(ghosts), spans, ["v", "c"])
    return rounded(baselines.invariance_gap(pooled, shuffled), "max_gap")


cte("pool", ("samples", "three_way"), """
SELECT s.*, w.part AS side, w.lab FROM samples s JOIN three_way w USING (eid)""")
cte("shared_line", ("pool",), f"""
SELECT b, my - b * mx AS a FROM (
  SELECT covar_pop(y, x1) / (var_pop(x1) + {LAM}) AS b, avg(x1) AS mx, avg(y) AS my
  FROM pool WHERE side = 'train')""")
cte("offsets", ("pool", "shared_line"), """
SELECT eid, lab, avg(y - (a + b * x1)) AS off FROM pool, shared_line
WHERE side = 'train' GROUP BY eid, lab""")


@query("h09_session_offsets", sql("offsets", """
SELECT policy, count(*) AS n, round(sqrt(avg((y - base - o) ** 2)), 6) AS rmse FROM (
  SELECT y, a + b * x1 AS base, policy, CASE policy WHEN 'zero' THEN 0 WHEN 'average' THEN m
         ELSE coalesce(lo, m) END AS o
  FROM pool CROSS JOIN shared_line CROSS JOIN (SELECT avg(off) AS m FROM offsets)
  CROSS JOIN (VALUES ('zero'), ('average'), ('inferred')) v(policy)
  LEFT JOIN (SELECT lab, avg(off) AS lo FROM offsets GROUP BY lab) l ON l.lab = pool.lab
  WHERE side = 'test') GROUP BY policy"""))
def _(t: Tables):
    split = three_way(t)
    rows = t.samples.join(t.sessions.select("eid", "lab"), "eid")
    model = baselines.fit_ridge(split, rows, ["x1"], "y", LAM)
    offsets = baselines.session_offsets(split.rows(rows, "train"), model)
    return rounded(baselines.offset_costs(split.rows(rows, "test"), offsets, model), "rmse")


def three_way(t: Tables) -> splits.Split:
    if "_three_way" not in t.__dict__:
        blocks = splits.split_three_way(t.sessions, 60, 20, "s1")
        t.__dict__["_three_way"] = splits.Split("three_way", blocks, 1,
                                                required_parts=("train", "calib", "test"))
    return t.__dict__["_three_way"]


# --- nulls --------------------------------------------------------------------------

cte("reps", (), f"SELECT unnest(range({REPS})) AS rep")
cte("shuffled", ("preds", "reps"), f"""
SELECT p.eid, q.rep, p.y AS y0, p.yhat, q.y FROM preds p JOIN (
  SELECT eid, rep, y, (pos + 1 + {bucket("eid::VARCHAR || '|' || rep::VARCHAR || '|n1'", 2147483648)} % 7) % 8 AS pos
  FROM preds, reps) q ON q.eid = p.eid AND q.pos = p.pos""")
cte("shuffle_rmse", ("shuffled",), """
SELECT eid, rep, count(*) AS n, sqrt(avg((y - yhat) ** 2)) AS value FROM shuffled GROUP BY eid, rep""")


def shuffle_rmse(t: Tables):
    return nulls.shuffle_errors(preds(t), REPS, "n1")


@query("k01_null_shuffle", sql("shuffle_rmse", """
SELECT eid, rep, n, round(value, 6) AS value FROM shuffle_rmse"""))
def _(t: Tables):
    return rounded(shuffle_rmse(t), "value")


cte("phased", ("parted", "trials"), """
SELECT p.*, t.trial_id, t.probability_left, t.contrast,
       ((p.bin * 21600000000 + 10800000000 - t.start_us) * 4) // (t.end_us - t.start_us) AS phase
FROM parted p LEFT JOIN trials t ON t.eid = p.eid AND t.end_us IS NOT NULL
 AND p.bin * 21600000000 + 10800000000 >= t.start_us
 AND p.bin * 21600000000 + 10800000000 < t.end_us""")
cte("structure", ("phased",), """
SELECT p.eid, p.bin, p.y, coalesce(f.m, c.m, (SELECT avg(y) FROM phased WHERE part = 'train')) AS yhat
FROM phased p
LEFT JOIN (SELECT phase, probability_left, contrast, avg(y) AS m FROM phased WHERE part = 'train'
           GROUP BY ALL) f
  ON f.phase = p.phase AND f.probability_left = p.probability_left AND f.contrast = p.contrast
LEFT JOIN (SELECT phase, avg(y) AS m FROM phased WHERE part = 'train' GROUP BY phase) c
  ON c.phase = p.phase
WHERE p.part = 'test'""")


def phased(t: Tables):
    trials = t.trials.select("eid", "trial_id", "start_us", "end_us", "probability_left", "contrast")
    marks = targets.trial_bins(t.samples.select("eid", "bin"), trials, BIN_US, 4).select(
        "eid", "bin", "phase", "probability_left", "contrast")
    return t.parted.join(marks, ["eid", "bin"], "left")


def structure(t: Tables):
    rows = phased(t)
    return nulls.null_trialstruct(rows.where("part = 'train'"), rows.where("part = 'test'"),
                                  ["phase", "probability_left", "contrast"])


@query("k02_null_trialstruct", sql("structure", """
SELECT eid, bin, round(ln(yhat), 6) AS log_yhat FROM structure"""))
def _(t: Tables):
    return structure(t).select("eid", "bin", r6(F.ln("yhat")).alias("log_yhat"))


@query("k03_null_p_value", sql("shuffle_rmse rmse", """
SELECT s.eid, count(*) AS n_null,
       round((1 + count(*) FILTER (WHERE s.value <= r.value + 1e-9)) / (1 + count(*)), 6) AS p_value,
       round(avg(s.value) - any_value(r.value), 6) AS margin
FROM shuffle_rmse s JOIN rmse r ON r.eid = s.eid GROUP BY s.eid"""))
def _(t: Tables):
    model = rmse(preds(t)).withColumnRenamed("value", "score")
    null = shuffle_rmse(t).select("eid", F.col("value").alias("score"))
    return rounded(nulls.null_p_value(model, null, higher_is_better=False), "p_value", "margin")


# --- contract -----------------------------------------------------------------------

cte("contract_rows", ("parted", "ridge1_each", "shuffle_rmse", "structure", "rmse", "rrr", "ridge2"), """
SELECT 'ceiling_within' AS row_kind, p.eid, sqrt(avg((y - a - b * x1) ** 2)) AS value
  FROM parted p JOIN ridge1_each m ON m.eid = p.eid WHERE part = 'test' GROUP BY p.eid
UNION ALL SELECT 'null_shuffle', eid, avg(value) FROM shuffle_rmse GROUP BY eid
UNION ALL SELECT 'null_trialstruct', eid, sqrt(avg((y - yhat) ** 2)) FROM structure GROUP BY eid
UNION ALL SELECT 'baseline_ridge', eid, value FROM rmse
UNION ALL SELECT 'baseline_multisession', p.eid, sqrt(avg((y - a - b1 * x1 - b2 * x2) ** 2))
  FROM parted p JOIN rrr m ON m.eid = p.eid WHERE part = 'test' GROUP BY p.eid
UNION ALL SELECT 'model', eid, sqrt(avg((y - a - b1 * x1 - b2 * x2) ** 2))
  FROM parted, ridge2 WHERE part = 'test' GROUP BY eid""")


def contract_of(t: Tables) -> contract.Contract:
    test = t.within.rows(t.samples, "test")
    own = baselines.fit_per_session(t.within, t.samples, ["x1"], "y", LAM)
    return contract.Contract("rmse", {
        "ceiling_within": rmse(baselines.predict_per_key(test, own, ["x1"])),
        "null_shuffle": shuffle_rmse(t).groupBy("eid").agg(F.avg("value").alias("value")),
        "null_trialstruct": rmse(structure(t)),
        "baseline_ridge": rmse(preds(t)),
        "baseline_multisession": rmse(baselines.predict_per_key(test, rrr(t), ["x1", "x2"])),
        "model": rmse(preds(t, xs=("x1", "x2"))),
    }, higher_is_better=False)


@query("k04_contract", sql("contract_rows", """
SELECT row_kind, count(value) AS n_sessions, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std FROM contract_rows GROUP BY row_kind"""))
def _(t: Tables):
    return rounded(contract_of(t).table(), "mean", "std")


@query("k04_contract_per_session", sql("contract_rows", """
SELECT eid, """ + ", ".join(
    f"round(max(value) FILTER (WHERE row_kind = '{r}'), 6) AS {r}" for r in contract.ROWS)
    + " FROM contract_rows GROUP BY eid"))
def _(t: Tables):
    return rounded(contract_of(t).per_session(), *contract.ROWS)


@query("k10_decision_gate", sql("contract_rows", """
SELECT count(g) AS n_sessions, round(avg(g), 6) AS mean_gain, avg(g) > 0.5 AS passed FROM (
  SELECT max(value) FILTER (WHERE row_kind = 'null_trialstruct')
         - max(value) FILTER (WHERE row_kind = 'baseline_ridge') AS g
  FROM contract_rows GROUP BY eid)"""))
def _(t: Tables):
    return rounded(contract_of(t).gate(0.5), "mean_gain")


# --- smell tests and comparisons of runs --------------------------------------------

cte("leaky_rows", ("samples", "interleaved"), """
SELECT s.eid, s.bin, s.x1, s.y, t.part FROM samples s JOIN interleaved t ON t.eid = s.eid
 AND t.end_us IS NOT NULL AND s.bin * 21600000000 + 10800000000 >= t.start_us
 AND s.bin * 21600000000 + 10800000000 < t.end_us""")
cte("leaky_rmse", ("leaky_rows",), f"""
SELECT eid, sqrt(avg((y - (my - b * mx) - b * x1) ** 2)) AS value FROM leaky_rows, (
  SELECT covar_pop(y, x1) / (var_pop(x1) + {LAM}) AS b, avg(x1) AS mx, avg(y) AS my
  FROM leaky_rows WHERE part = 'train') WHERE part = 'test' GROUP BY eid""")


@query("k08_leakage_inflation", sql("leaky_rmse rmse", """
SELECT l.eid, round(l.value, 6) AS leaky, round(r.value, 6) AS honest,
       round(r.value - l.value, 6) AS inflation FROM leaky_rmse l JOIN rmse r ON r.eid = l.eid"""))
def _(t: Tables):
    trials = interleaved(t).select("eid", "trial_id", "start_us", "end_us", "part")
    rows = targets.trial_bins(t.samples, trials, BIN_US, 1)
    model = baselines.ridge_of(rows.where("part = 'train'"), ["x1"], "y", LAM)
    leaky = rmse(model.predict(rows.where("part = 'test'")))
    return rounded(contract.inflation(leaky, rmse(preds(t)), False), "leaky", "honest", "inflation")


@query("k09_contract_drift", sql("preds preds_stiff", """
SELECT a.eid, 'baseline_ridge' AS row_kind, round(a.v, 6) AS before, round(b.v, 6) AS after,
       round(b.v - a.v, 6) AS change
FROM (SELECT eid, sqrt(avg((y - yhat) ** 2)) AS v FROM preds GROUP BY eid) a
JOIN (SELECT eid, sqrt(avg((y - yhat) ** 2)) AS v FROM preds_stiff GROUP BY eid) b ON b.eid = a.eid
WHERE abs(a.v - b.v) > 1e-9"""))
def _(t: Tables):
    def run(lam):
        return rmse(preds(t, lam)).withColumn("row_kind", F.lit("baseline_ridge"))
    return rounded(contract.drift(run(LAM), run(10.0)), "before", "after", "change")


@query("k11_over_fixed_sessions", sql("rmse sessions", f"""
SELECT 'baseline_ridge' AS row_kind, count(*) AS n_sessions, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std
FROM rmse WHERE eid IN (SELECT eid FROM sessions WHERE {bucket("subject::VARCHAR")} < 20)"""))
def _(t: Tables):
    wanted = t.sessions.where(hash_bucket(100, "subject") < 20)
    scores = rmse(preds(t)).withColumn("row_kind", F.lit("baseline_ridge"))
    return rounded(contract.over_list(scores, wanted), "mean", "std")


@query("k12_relative_horizon", sql("from_counts behaviour_only", """
SELECT a.horizon, round(a.rmse, 6) AS model_rmse, round(b.rmse, 6) AS baseline_rmse,
       round(a.rmse / b.rmse, 6) AS ratio
FROM from_counts a JOIN behaviour_only b ON b.horizon = a.horizon"""))
def _(t: Tables):
    model = horizon_rmse(baselines.horizon_line(pairs(t), "x1"))
    base = horizon_rmse(baselines.horizon_line(pairs(t)))
    return rounded(contract.relative_horizon(model, base), "model_rmse", "baseline_rmse", "ratio")
