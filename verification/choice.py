"""The six contract rows for a choice per trial under all six split kinds, against folds spelled out in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from truegauge.functions.timing import bin_of
from truegauge.operators import splits, targets
from truegauge.plans import choice, kinds
from truegauge.session import cut_lineage
from verification.bindings import BIN_US, CONTEXT, GAP, Tables
from verification.ctes import CTES, bucket, cte, sql
from verification.kinds import RECIPE, feature_rows
from verification.modelling import REPS
from verification.registry import query, rounded
from verification.splitting import configured

# Every event starts a trial that lasts until the next one; a choice of 0 is no response.
cte("choice_trials", ("ev",), """
SELECT eid, event_id AS trial_id, t_us AS start_us, lead(t_us) OVER (PARTITION BY eid ORDER BY t_us, event_id) AS end_us,
       k % 3 - 1 AS choice, CASE WHEN k < 40 THEN 0.2 WHEN k < 60 THEN 0.5 ELSE 0.8 END AS probability_left,
       (k % 5) / 4.0 AS contrast FROM ev""")
cte("c_feats", ("choice_trials", "feats"), f"""
SELECT t.eid, t.trial_id, t.start_us, f.x1, f.x2, f.x3, f.x4, (t.choice = 1)::INT::DOUBLE AS y,
       CASE WHEN f.part = 'train' AND t.end_us <= 12 * {BIN_US} THEN 'train'
            WHEN f.part = 'test' AND t.end_us <= 24 * {BIN_US} THEN 'test' ELSE 'other' END AS part,
       t.contrast AS phase, t.probability_left, t.contrast
FROM choice_trials t JOIN (SELECT DISTINCT eid, bin, part, x1, x2, x3, x4 FROM feats) f
  ON f.eid = t.eid AND f.bin = t.start_us // {BIN_US}
WHERE t.end_us IS NOT NULL AND t.choice <> 0""")


def _over(rows: str, prefix: str, names: tuple[str, ...]) -> None:
    """The fold fits of verification.kinds once more, over other rows."""
    to = {n: prefix + n for n in names} | {"feats": rows}
    for name in names:
        needs, body = CTES[name]
        cte(to[name], tuple(to.get(n, n) for n in needs),
            re.sub(r"\b(" + "|".join(to) + r")\b", lambda m: to[m[0]], body))


_over("c_feats", "c_", ("k_sums", "k_stack", "k_fold", "k_models", "k_own", "k_cells", "fold_cells"))
cte("c_placed", ("c_feats",), """
SELECT *, row_number() OVER (PARTITION BY eid ORDER BY start_us, trial_id) - 1 AS pos,
       count(*) OVER (PARTITION BY eid) AS n_pos FROM c_feats WHERE part = 'test'""")
cte("c_turned", ("c_placed", "reps"), f"""
SELECT p.eid, q.rep, p.x1, q.y FROM c_placed p JOIN (
  SELECT eid, rep, y, (pos + 1 + {bucket("eid::VARCHAR || '|' || rep::VARCHAR || '|c1'", 2147483648)} % (n_pos - 1)) % n_pos AS pos
  FROM c_placed, reps WHERE n_pos > 1) q ON q.eid = p.eid AND q.pos = p.pos""")
cte("c_known", ("fold_test", "c_k_models", "c_placed"), """
SELECT t.kind, t.fold, t.eid, m.a, m.b1 FROM fold_test t
JOIN c_k_models m ON m.kind = t.kind AND m.fold = t.fold AND m.row_kind = 'baseline_ridge'
WHERE t.eid IN (SELECT eid FROM c_placed)""")
cte("c_scores", ("c_known", "c_k_models", "c_k_own", "c_turned", "c_placed", "c_fold_cells"), """
SELECT k.kind, m.row_kind, k.eid, 0 AS rep, round(m.a + m.b1 * f.x1 + m.b2 * f.x2 + m.b3 * f.x3 + m.b4 * f.x4, 9) AS score, f.y
FROM c_known k JOIN c_k_models m ON m.kind = k.kind AND m.fold = k.fold JOIN c_placed f ON f.eid = k.eid
UNION ALL SELECT k.kind, m.row_kind, k.eid, 0, round(m.a + m.b1 * f.x1 + m.b2 * f.x2, 9), f.y
FROM c_known k JOIN c_k_own m ON m.eid = k.eid AND (m.row_kind = 'ceiling_within' OR k.kind = 'within_session')
JOIN c_placed f ON f.eid = k.eid
UNION ALL SELECT k.kind, 'null_shuffle', k.eid, f.rep, round(k.a + k.b1 * f.x1, 9), f.y
FROM c_known k JOIN c_turned f ON f.eid = k.eid
UNION ALL SELECT k.kind, 'null_trialstruct', k.eid, 0, round(coalesce(c.m, p.m, o.m), 9), f.y
FROM c_known k JOIN c_placed f ON f.eid = k.eid
LEFT JOIN (SELECT kind, fold, phase, probability_left, contrast, s / n AS m FROM c_fold_cells) c
  ON c.kind = k.kind AND c.fold = k.fold AND c.phase = f.phase AND c.probability_left = f.probability_left
     AND c.contrast = f.contrast
LEFT JOIN (SELECT kind, fold, phase, sum(s) / sum(n) AS m FROM c_fold_cells GROUP BY ALL) p
  ON p.kind = k.kind AND p.fold = k.fold AND p.phase = f.phase
JOIN (SELECT kind, fold, sum(s) / sum(n) AS m FROM c_fold_cells GROUP BY ALL) o ON o.kind = k.kind AND o.fold = k.fold""")
cte("choice_rows", ("c_scores",), """
SELECT kind, row_kind, eid, avg(coalesce((r + l) / 2, r, l)) AS balanced_accuracy, avg(auroc) AS auroc FROM (
  SELECT kind, row_kind, eid, rep,
         avg((score >= 0.5)::INT) FILTER (WHERE y = 1) AS r, avg((score < 0.5)::INT) FILTER (WHERE y = 0) AS l,
         (sum(rank) FILTER (WHERE y = 1) - any_value(n1) * (any_value(n1) + 1) / 2)
           / nullif(any_value(n1) * (count(*) - any_value(n1)), 0) AS auroc
  FROM (SELECT *, sum(y) OVER (PARTITION BY kind, row_kind, eid, rep) AS n1,
               rank() OVER (PARTITION BY kind, row_kind, eid, rep ORDER BY score)
               + (count(*) OVER (PARTITION BY kind, row_kind, eid, rep, score) - 1) / 2 AS rank FROM c_scores)
  GROUP BY ALL) GROUP BY ALL""")


def choice_rows(t: Tables):
    """Scores of all kinds and rows, computed once per binding."""
    if "_choice_rows" not in t.__dict__:
        left = F.when(F.col("k") < 40, 0.2).when(F.col("k") < 60, 0.5).otherwise(0.8)
        starts = t.events.select("eid", F.col("event_id").alias("trial_id"), F.col("t_us").alias("start_us"),
                                 (F.col("k") % 3 - 1).alias("choice"), left.cast("string").alias("probability_left"),
                                 ((F.col("k") % 5) / 4.0).cast("string").alias("contrast"))
        trials = cut_lineage(targets.with_trial_ends(starts, BIN_US))
        assigned = splits.assign_trials(trials, t.within_blocks, BIN_US)
        within = splits.Split("within_session", t.within_blocks, CONTEXT, GAP, bin_width_us=BIN_US, target="trial",
                              trials=assigned.withColumn("split_id", F.lit("within_session")))
        units = t.units.withColumn("passed", F.col("label") >= 1)
        region = splits.Split("held_out_region", splits.split_region(t.sessions, units, "v"), 1)
        config = splits.Split("held_out_config", splits.split_config(configured(t), "config"), 1)
        rows = within.trial_rows(trials, "train", "gap", "test", "dropped", width_us=BIN_US).where("choice <> 0").select(
            "eid", "trial_id", "start_us", "part", bin_of("start_us", BIN_US).alias("bin"),
            F.when(F.col("choice") == 1, 1.0).otherwise(0.0).alias("y"), F.col("contrast").alias("coarse"),
            F.concat_ws("|", "contrast", "probability_left").alias("cell"))
        rows = choice.placed(rows, ("start_us", "trial_id"), F.col("bin"))
        given = choice.prepared(rows.join(feature_rows(t).select("eid", "bin", "x"), ["eid", "bin"]),
                                t.sessions, RECIPE, REPS, "c1")
        t.__dict__["_choice_rows"] = cut_lineage(choice.choice_contracts(given, {
            "held_out_region": region.blocks.select("eid", "part"),
            "held_out_config": config.blocks.select("eid", "part")}, RECIPE))
    return t.__dict__["_choice_rows"]


@query("k04_contract_choice", sql("choice_rows", """
SELECT kind, row_kind, count(balanced_accuracy) AS n_sessions, round(avg(balanced_accuracy), 6) AS balanced_accuracy,
       round(stddev_samp(balanced_accuracy), 6) AS balanced_accuracy_std, count(auroc) AS n_auroc,
       round(avg(auroc), 6) AS auroc, round(stddev_samp(auroc), 6) AS auroc_std
FROM choice_rows GROUP BY kind, row_kind"""))
def _(t: Tables):
    return rounded(choice.choice_table(choice_rows(t)), "balanced_accuracy", "balanced_accuracy_std", "auroc", "auroc_std")


@query("k04_contract_choice_per_session", sql("choice_rows", """
SELECT kind, row_kind, eid, round(balanced_accuracy, 6) AS balanced_accuracy, round(auroc, 6) AS auroc FROM choice_rows"""))
def _(t: Tables):
    return rounded(choice_rows(t), "balanced_accuracy", "auroc")
