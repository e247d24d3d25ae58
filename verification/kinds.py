"""The six contract rows under all six split kinds, against folds spelled out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.operators import baselines, binning, splits, targets
from truegauge.plans import contract, kinds
from truegauge.session import cut_lineage
from verification.bindings import BIN_US, Tables
from verification.ctes import bucket, cte, sql
from verification.modelling import LAM, REPS
from verification.registry import query, rounded
from verification.splitting import configured

# Features of a row: all counts, views, and the mean and maximum over the session's units.
RECIPE = kinds.Recipe(ridge=(0,), multisession=(0, 1), model=(2, 3), rank=1, lam=LAM)

cte("feats", ("samples", "dense", "trials", "parts24", "sessions"), """
SELECT s.eid, s.bin, s.x1, s.x2, d.x3, d.x4, s.y, g.part, o.subject, o.lab,
       t.probability_left, t.contrast,
       ((s.bin * 21600000000 + 10800000000 - t.start_us) * 4) // (t.end_us - t.start_us) AS phase
FROM samples s JOIN parts24 g USING (bin) JOIN sessions o ON o.eid = s.eid
JOIN (SELECT eid, bin, avg(n)::DOUBLE AS x3, max(n)::DOUBLE AS x4 FROM dense GROUP BY ALL) d
  ON d.eid = s.eid AND d.bin = s.bin
LEFT JOIN trials t ON t.eid = s.eid AND t.end_us IS NOT NULL
 AND s.bin * 21600000000 + 10800000000 >= t.start_us
 AND s.bin * 21600000000 + 10800000000 < t.end_us""")
_PAIRS = ("11", "12", "22", "33", "34", "44", "1y", "2y", "3y", "4y")
_NAMES = ["n", "s1", "s2", "s3", "s4", "sy", *[f"p{p}" for p in _PAIRS]]
_col = lambda c: "y" if c == "y" else f"x{c}"
cte("k_sums", ("feats",), "SELECT eid, scope, count(*)::DOUBLE AS n, "
    + ", ".join([f"sum({_col(c)}) AS s{c}" for c in "1234y"]
                + [f"sum({_col(p[0])} * {_col(p[1])}) AS p{p}" for p in _PAIRS])
    + """ FROM (SELECT 'whole' AS scope, * FROM feats UNION ALL
  SELECT 'train', * FROM feats WHERE part = 'train') GROUP BY eid, scope""")


def _centred(source: str, keys: str, more: str = "") -> str:
    c = ", ".join(f"p{p} / n - s{p[0]} / n * s{p[1]} / n AS c{p}" for p in _PAIRS)
    m = ", ".join(f"s{v} / n AS m{v}" for v in "1234y")
    return f"SELECT {keys}, n, {m}, {c} {more} FROM {source}"


cte("k_stack", ("k_sums",), f"""
SELECT eid, scope, n * b1 * b1 AS k11, n * b1 * b2 AS k12, n * b2 * b2 AS k22 FROM (
  SELECT *, (c1y * (c22 + {LAM}) - c2y * c12) / ((c11 + {LAM}) * (c22 + {LAM}) - c12 * c12) AS b1,
         (c2y * (c11 + {LAM}) - c1y * c12) / ((c11 + {LAM}) * (c22 + {LAM}) - c12 * c12) AS b2
  FROM ({_centred("k_sums", "eid, scope")}))""")
cte("fold_train", ("sessions", "region_parts", "config_parts"), """
SELECT 'within_session' AS kind, '0' AS fold, eid FROM sessions
UNION ALL SELECT 'held_out_session', t.eid::VARCHAR, s.eid FROM sessions t
  JOIN sessions s ON s.subject = t.subject AND s.eid <> t.eid
UNION ALL SELECT 'held_out_animal', t.subject::VARCHAR, s.eid FROM (SELECT DISTINCT subject FROM sessions) t
  JOIN sessions s ON s.subject <> t.subject
UNION ALL SELECT 'held_out_lab', t.lab::VARCHAR, s.eid FROM (SELECT DISTINCT lab FROM sessions) t
  JOIN sessions s ON s.lab <> t.lab
UNION ALL SELECT 'held_out_region', '0', eid FROM region_parts WHERE part = 'train'
UNION ALL SELECT 'held_out_config', '0', eid FROM config_parts WHERE part = 'train'""")
cte("fold_test", ("sessions", "region_parts", "config_parts"), """
SELECT 'within_session' AS kind, '0' AS fold, eid FROM sessions
UNION ALL SELECT 'held_out_session', eid::VARCHAR, eid FROM sessions
UNION ALL SELECT 'held_out_animal', subject::VARCHAR, eid FROM sessions
UNION ALL SELECT 'held_out_lab', lab::VARCHAR, eid FROM sessions
UNION ALL SELECT 'held_out_region', '0', eid FROM region_parts WHERE part = 'test'
UNION ALL SELECT 'held_out_config', '0', eid FROM config_parts WHERE part = 'test'""")
cte("k_fold", ("fold_train", "k_sums", "k_stack"), "SELECT kind, fold, "
    + ", ".join(f"sum({c}) AS {c}" for c in [*_NAMES, "k11", "k12", "k22"]) + """
FROM fold_train f JOIN k_sums s USING (eid) JOIN k_stack USING (eid, scope)
WHERE scope = CASE kind WHEN 'within_session' THEN 'train' ELSE 'whole' END GROUP BY kind, fold""")


def _basis(source: str) -> str:
    """Leading direction of (k11, k12, k22), its largest entry positive or not: the fit does not change."""
    top = "((k11 + k22) / 2 + sqrt(((k11 - k22) / 2) * ((k11 - k22) / 2) + k12 * k12))"
    norm = f"sqrt(k12 * k12 + ({top} - k11) * ({top} - k11))"
    # Without a second feature in the train sessions the first one is the direction.
    return (f"SELECT *, CASE WHEN {norm} > 0 THEN k12 / {norm} ELSE 1 END AS v1, "
            f"CASE WHEN {norm} > 0 THEN ({top} - k11) / {norm} ELSE 0 END AS v2 FROM {source}")


_LINE = "c1y / (c11 + {lam}) AS r1".format(lam=LAM)
cte("k_models", ("k_fold", "k_sums"), f"""
SELECT kind, fold, 'baseline_ridge' AS row_kind, my - r1 * m1 AS a, r1 AS b1, 0.0 AS b2, 0.0 AS b3, 0.0 AS b4
FROM (SELECT *, {_LINE} FROM ({_centred("k_fold", "kind, fold")}))
UNION ALL SELECT kind, fold, 'model', my - d3 * m3 - d4 * m4, 0, 0, d3, d4 FROM (
  SELECT *, (c3y * (c44 + {LAM}) - c4y * c34) / ((c33 + {LAM}) * (c44 + {LAM}) - c34 * c34) AS d3,
         (c4y * (c33 + {LAM}) - c3y * c34) / ((c33 + {LAM}) * (c44 + {LAM}) - c34 * c34) AS d4
  FROM ({_centred("k_fold", "kind, fold")}))
UNION ALL SELECT kind, fold, 'baseline_multisession', my - g * (v1 * m1 + v2 * m2), g * v1, g * v2, 0, 0 FROM (
  SELECT *, (v1 * c1y + v2 * c2y) / (v1 * v1 * c11 + 2 * v1 * v2 * c12 + v2 * v2 * c22 + {LAM}) AS g
  FROM ({_centred("(" + _basis("k_fold") + ")", "kind, fold", ", v1, v2")}))
WHERE kind <> 'within_session'""")
cte("k_own", ("k_fold", "k_sums"), f"""
SELECT eid, 'ceiling_within' AS row_kind, my - r1 * m1 AS a, r1 AS b1, 0.0 AS b2
FROM (SELECT *, {_LINE} FROM ({_centred("k_sums", "eid, scope")}) WHERE scope = 'train')
UNION ALL SELECT eid, 'baseline_multisession', my - g * (v1 * m1 + v2 * m2), g * v1, g * v2 FROM (
  SELECT *, (v1 * c1y + v2 * c2y) / (v1 * v1 * c11 + 2 * v1 * v2 * c12 + v2 * v2 * c22 + {LAM}) AS g
  FROM ({_centred("k_sums", "eid, scope")}) CROSS JOIN (
    SELECT v1, v2 FROM ({_basis("k_fold")}) WHERE kind = 'within_session') WHERE scope = 'train')""")
cte("k_turned", ("feats", "reps"), f"""
SELECT p.eid, q.rep, p.x1, q.y FROM (SELECT *, bin - 16 AS pos FROM feats WHERE part = 'test') p JOIN (
  SELECT eid, rep, y, (bin - 16 + 1 + {bucket("eid::VARCHAR || '|' || rep::VARCHAR || '|n1'", 2147483648)} % 7) % 8 AS pos
  FROM feats, reps WHERE part = 'test') q ON q.eid = p.eid AND q.pos = p.pos""")
cte("k_cells", ("feats",), """
SELECT eid, part = 'train' AS in_train, phase, probability_left, contrast, count(*) AS n, sum(y) AS s
FROM feats GROUP BY ALL""")
cte("fold_cells", ("fold_train", "k_cells"), """
SELECT kind, fold, phase, probability_left, contrast, sum(n) AS n, sum(s) AS s FROM fold_train JOIN k_cells USING (eid)
WHERE kind <> 'within_session' OR in_train GROUP BY ALL""")
cte("k_structure", ("fold_cells", "fold_test", "feats"), """
SELECT t.kind, t.eid, sqrt(avg((f.y - coalesce(c.m, p.m, o.m)) ** 2)) AS value
FROM fold_test t JOIN feats f ON f.eid = t.eid AND f.part = 'test'
LEFT JOIN (SELECT kind, fold, phase, probability_left, contrast, s / n AS m FROM fold_cells) c
  ON c.kind = t.kind AND c.fold = t.fold AND c.phase = f.phase AND c.probability_left = f.probability_left
     AND c.contrast = f.contrast
LEFT JOIN (SELECT kind, fold, phase, sum(s) / sum(n) AS m FROM fold_cells GROUP BY ALL) p
  ON p.kind = t.kind AND p.fold = t.fold AND p.phase = f.phase
JOIN (SELECT kind, fold, sum(s) / sum(n) AS m FROM fold_cells GROUP BY ALL) o
  ON o.kind = t.kind AND o.fold = t.fold
GROUP BY t.kind, t.eid""")
_ERROR = "sqrt(avg((f.y - m.a - m.b1 * f.x1 - m.b2 * f.x2 {more}) ** 2))"
cte("kind_rows", ("k_models", "k_own", "k_turned", "k_structure", "fold_test", "feats"), f"""
SELECT t.kind, m.row_kind, t.eid, {_ERROR.format(more="- m.b3 * f.x3 - m.b4 * f.x4")} AS value
  FROM fold_test t JOIN k_models m ON m.kind = t.kind AND m.fold = t.fold
  JOIN feats f ON f.eid = t.eid AND f.part = 'test' GROUP BY ALL
UNION ALL SELECT t.kind, m.row_kind, t.eid, {_ERROR.format(more="")}
  FROM fold_test t JOIN k_own m ON m.eid = t.eid AND (m.row_kind = 'ceiling_within' OR t.kind = 'within_session')
  JOIN feats f ON f.eid = t.eid AND f.part = 'test'
  JOIN k_models k ON k.kind = t.kind AND k.fold = t.fold AND k.row_kind = 'baseline_ridge' GROUP BY ALL
UNION ALL SELECT kind, 'null_shuffle', eid, avg(v) FROM (
  SELECT t.kind, t.eid, f.rep, sqrt(avg((f.y - m.a - m.b1 * f.x1) ** 2)) AS v
  FROM fold_test t JOIN k_models m ON m.kind = t.kind AND m.fold = t.fold AND m.row_kind = 'baseline_ridge'
  JOIN k_turned f ON f.eid = t.eid GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT s.kind, 'null_trialstruct', s.eid, s.value FROM k_structure s
  JOIN fold_test t ON t.kind = s.kind AND t.eid = s.eid
  JOIN k_models k ON k.kind = t.kind AND k.fold = t.fold AND k.row_kind = 'baseline_ridge'""")


def feature_rows(t: Tables):
    pooled = baselines.pool_units(t.bins, t.units, binning.whole_spans(t.sessions), []).select("eid", "bin", "mean", "max")
    trials = t.trials.select("eid", "trial_id", "start_us", "end_us", "probability_left", "contrast")
    marks = targets.trial_bins(t.samples.select("eid", "bin"), trials, BIN_US, 4).select(
        "eid", "bin", F.col("phase").cast("string").alias("coarse"), F.concat(
            F.col("phase").cast("string"), F.lit("|"), "probability_left", F.lit("|"), "contrast").alias("cell"))
    rows = t.within.rows(t.samples, "train", "gap", "test").join(pooled, ["eid", "bin"])
    return rows.join(marks, ["eid", "bin"], "left").select(
        "eid", "bin", "part", "pos", "n_pos", F.array("x1", "x2", "mean", "max").alias("x"), "y", "cell", "coarse")


def kind_rows(t: Tables):
    """Scores of all kinds and rows, computed once per binding."""
    if "_kind_rows" not in t.__dict__:
        units = t.units.withColumn("passed", F.col("label") >= 1)
        region = splits.Split("held_out_region", splits.split_region(t.sessions, units, "v"), 1)
        config = splits.Split("held_out_config", splits.split_config(configured(t), "config"), 1)
        given = kinds.prepared(feature_rows(t), t.sessions, RECIPE, REPS, "n1")
        t.__dict__["_kind_rows"] = cut_lineage(kinds.contracts(given, {
            "held_out_region": region.blocks.select("eid", "part"),
            "held_out_config": config.blocks.select("eid", "part")}, RECIPE))
    return t.__dict__["_kind_rows"]


@query("k04_contract_kinds", sql("kind_rows", """
SELECT kind, row_kind, count(value) AS n_sessions, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM kind_rows GROUP BY kind, row_kind"""))
def _(t: Tables):
    return rounded(kinds.contract_table(kind_rows(t)), "mean", "std")


@query("k04_contract_kinds_per_session", sql("kind_rows", """
SELECT kind, row_kind, eid, round(value, 6) AS value FROM kind_rows"""))
def _(t: Tables):
    return rounded(kind_rows(t), "value")


@query("k05_gap_by_row", sql("kind_rows", """
SELECT r.kind, r.row_kind, count(r.value) AS n_sessions, round(avg(r.value), 6) AS mean,
       round(avg(r.value - c.value), 6) + 0.0 AS "drop"
FROM kind_rows r JOIN kind_rows c ON c.eid = r.eid AND c.kind = 'within_session' AND c.row_kind = 'ceiling_within'
GROUP BY r.kind, r.row_kind"""))
def _(t: Tables):
    return rounded(kinds.drops(kind_rows(t)), "mean", "drop").withColumn("drop", F.col("drop") + 0.0)


@query("x03_matrix_of_methods", sql("kind_rows", "SELECT row_kind AS method, " + ", ".join(
    f"round(avg(value) FILTER (WHERE kind = '{k}'), 6) AS {k}" for k in kinds.KINDS)
    + " FROM kind_rows WHERE row_kind IN ('baseline_ridge', 'baseline_multisession', 'model') GROUP BY row_kind"))
def _(t: Tables):
    runs = kind_rows(t).where(F.col("row_kind").isin(*kinds.FITTED)).withColumnRenamed("row_kind", "method")
    return rounded(contract.matrix(runs, kinds.KINDS), *kinds.KINDS)
