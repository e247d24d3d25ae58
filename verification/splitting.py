"""Splits and guards. Each guard query runs on a split that is leaky on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_bucket
from truegauge.operators import binning, guards, splits, targets
from verification.bindings import BIN_US, CONTEXT, GAP, N_BINS, Tables
from verification.ctes import bucket, cte, sql
from verification.registry import query

BLOCKS = "split_id, kind, part, eid, subject, lab, start_bin, end_bin"
WHOLE = "CAST(0 AS BIGINT) AS start_bin, n_bins - 1 AS end_bin"


@query("e01_within_session", sql("within_blocks", f"SELECT {BLOCKS} FROM within_blocks"))
def _(t: Tables):
    return t.within_blocks


@query("e02_held_out_session", sql("sessions", f"""
SELECT 'held_out_session=52' AS split_id, 'held_out_session' AS kind,
       CASE WHEN eid = 52 THEN 'test' ELSE 'train' END AS part, eid, subject, lab, {WHOLE}
FROM sessions WHERE subject IN (SELECT subject FROM sessions WHERE eid = 52)"""))
def _(t: Tables):
    return splits.split_session(t.sessions, 52)


@query("e03_held_out_animal", sql("sessions", f"""
SELECT 'held_out_animal=5' AS split_id, 'held_out_animal' AS kind,
       CASE WHEN subject = 5 THEN 'test' ELSE 'train' END AS part, eid, subject, lab, {WHOLE}
FROM sessions"""))
def _(t: Tables):
    return splits.split_animal(t.sessions, 5)


@query("e04_held_out_lab", sql("sessions", f"""
SELECT 'held_out_lab=7' AS split_id, 'held_out_lab' AS kind,
       CASE WHEN lab = 7 THEN 'test' ELSE 'train' END AS part, eid, subject, lab, {WHOLE}
FROM sessions"""))
def _(t: Tables):
    return splits.split_lab(t.sessions, 7)


cte("region_part", ("order_units",), """
SELECT eid, CASE WHEN count(*) FILTER (WHERE region = 'PROMO') = 0 THEN 'train'
  WHEN count(*) FILTER (WHERE passed) > 0 AND
       count(*) FILTER (WHERE passed AND region = 'PROMO') >= 0.2 * count(*) FILTER (WHERE passed)
  THEN 'test' ELSE 'dropped' END AS part
FROM order_units GROUP BY eid""")


@query("e05_held_out_region", sql("region_part order_sessions", """
SELECT 'held_out_region=PROMO' AS split_id, 'held_out_region' AS kind, part, eid, subject, lab,
       CAST(0 AS BIGINT) AS start_bin, CAST(0 AS BIGINT) AS end_bin
FROM region_part JOIN order_sessions USING (eid)"""))
def _(t: Tables):
    return splits.split_region(t.order_sessions, t.order_units, "PROMO")


cte("configs", ("sessions", "units"), """
SELECT s.*, string_agg(u.region, '' ORDER BY u.region) AS config
FROM sessions s JOIN units u USING (eid) GROUP BY s.eid, s.subject, s.lab, s.n_bins""")


def configured(t: Tables):
    config = t.units.groupBy("eid").agg(
        F.concat_ws("", F.array_sort(F.collect_list("region"))).alias("config"))
    return t.sessions.join(config, "eid")


@query("e06_held_out_config", sql("configs", f"""
SELECT 'held_out_config=config' AS split_id, 'held_out_config' AS kind,
       CASE WHEN config = (SELECT config FROM configs GROUP BY config
                           ORDER BY count(*) DESC, config LIMIT 1)
            THEN 'train' ELSE 'test' END AS part, eid, subject, lab, {WHOLE}
FROM configs"""))
def _(t: Tables):
    return splits.split_config(configured(t), "config")


cte("three_way", ("sessions",), f"""
SELECT 'three_way=s1' AS split_id, 'three_way' AS kind,
       CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'calib' ELSE 'test' END AS part,
       eid, subject, lab, {WHOLE}
FROM (SELECT *, {bucket("subject::VARCHAR || '|s1'")} AS b FROM sessions)""")


@query("e07_three_way", sql("three_way", f"SELECT {BLOCKS} FROM three_way"))
def _(t: Tables):
    return splits.split_three_way(t.sessions, 60, 20, "s1")


cte("assigned", ("trials", "within_blocks"), """
SELECT t.eid, t.trial_id, t.start_us, t.end_us, CASE
  WHEN t.end_us <= (b.end_bin + 1) * 21600000000 THEN b.part ELSE 'dropped' END AS part
FROM trials t JOIN within_blocks b ON b.eid = t.eid AND t.start_us >= b.start_bin * 21600000000
 AND t.start_us < (b.end_bin + 1) * 21600000000
WHERE t.end_us IS NOT NULL""")


@query("e08_assign_trials", sql("assigned", "SELECT eid, trial_id, part FROM assigned"))
def _(t: Tables):
    assigned = splits.assign_trials(t.trials, t.within_blocks, BIN_US)
    return assigned.select("eid", "trial_id", "part")


def _logo(kind: str, group: str, pool: str) -> str:
    return sql("sessions", f"""
SELECT '{kind}=' || {group}::VARCHAR AS split_id, eid, subject, lab,
       count(*) OVER (PARTITION BY {group}) AS n_test,
       count(*) OVER ({pool}) - count(*) OVER (PARTITION BY {group}) AS n_train
FROM sessions""")


@query("e09_all_animals", _logo("held_out_animal", "subject", ""))
def _(t: Tables):
    return splits.all_splits(t.sessions, "held_out_animal")


@query("e09_all_labs", _logo("held_out_lab", "lab", ""))
def _(t: Tables):
    return splits.all_splits(t.sessions, "held_out_lab")


@query("e09_all_sessions", _logo("held_out_session", "eid", "PARTITION BY subject"))
def _(t: Tables):
    return splits.all_splits(t.sessions, "held_out_session")


@query("e09_all_regions", sql("order_units", """
SELECT 'held_out_region=' || region AS split_id, eid,
       CASE WHEN p > 0 AND n >= 0.2 * p THEN 'test' ELSE 'dropped' END AS part,
       (SELECT count(DISTINCT eid) FROM order_units) - count(*) OVER (PARTITION BY region) AS n_train
FROM (SELECT eid, region, count(*) FILTER (WHERE passed) AS n FROM order_units GROUP BY eid, region)
JOIN (SELECT eid, count(*) FILTER (WHERE passed) AS p FROM order_units GROUP BY eid) USING (eid)"""))
def _(t: Tables):
    return splits.all_region_splits(t.order_units)


def _hash_sql(source: str, manifest: str) -> str:
    words = ", ".join(
        f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))
    return f"""
SELECT split_id, count(*) AS n_blocks, sha256(concat_ws('|', {words}, '{manifest}', '1')) AS hash
FROM (SELECT split_id, sha256(concat_ws('|', kind, part, eid, subject, lab, start_bin, end_bin)) AS d
      FROM {source}) GROUP BY split_id"""


@query("e10_split_hash", sql("within_blocks three_way", _hash_sql(
    f"(SELECT {BLOCKS} FROM within_blocks UNION ALL SELECT {BLOCKS} FROM three_way)", "7")))
def _(t: Tables):
    both = t.within_blocks.unionByName(splits.split_three_way(t.sessions, 60, 20, "s1"))
    return splits.split_hash(both, "7")


cte("lab_splits", ("sessions",), f"""
SELECT 'lab=' || lab::VARCHAR AS split_id, 'three_way' AS kind,
       CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'calib' ELSE 'test' END AS part,
       eid, subject, lab, {WHOLE}
FROM (SELECT *, {bucket("subject::VARCHAR")} AS b FROM sessions)""")


def lab_splits(t: Tables):
    b = hash_bucket(100, "subject")
    return splits.whole_sessions(
        t.sessions, "three_way", F.concat(F.lit("lab="), F.col("lab").cast("string")),
        F.when(b < 60, "train").when(b < 80, "calib").otherwise("test"))


@query("e11_split_power", sql("lab_splits", """
SELECT split_id, count(DISTINCT eid) AS n_test_sessions, count(DISTINCT eid) >= 10 AS enough
FROM lab_splits WHERE part = 'test' GROUP BY split_id"""))
def _(t: Tables):
    return splits.split_power(lab_splits(t), 10)


cte("interleaved", ("trials", "sessions"), """
SELECT eid, trial_id, start_us, end_us, subject, lab,
       CASE WHEN rn * 100 <= n * 70 THEN 'train' WHEN rn * 100 <= n * 80 THEN 'calib'
            ELSE 'test' END AS part
FROM (SELECT t.*, s.lab, count(*) OVER (PARTITION BY eid) AS n, row_number() OVER (
        PARTITION BY eid ORDER BY md5(trial_id::VARCHAR || '|s2'), trial_id) AS rn
      FROM trials t JOIN (SELECT eid, lab FROM sessions) s USING (eid))""")
cte("trial_blocks", ("interleaved",), """
SELECT DISTINCT 'interleaved' AS split_id, eid, part, start_us // 21600000000 AS start_bin,
       (end_us - 1) // 21600000000 AS end_bin
FROM interleaved WHERE end_us IS NOT NULL AND part <> 'calib'""")
cte("trial_sweep", ("trial_blocks",), """
SELECT *, start_bin - max(CASE WHEN part = 'train' THEN end_bin END) OVER w - 1 AS after_train,
       start_bin - max(CASE WHEN part = 'test' THEN end_bin END) OVER w - 1 AS after_test,
       lag(part) OVER (PARTITION BY eid ORDER BY start_bin, end_bin, part) AS prev_part
FROM trial_blocks WINDOW w AS (PARTITION BY eid ORDER BY start_bin, end_bin, part
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


def interleaved(t: Tables):
    labs = t.sessions.select("eid", "lab")
    return splits.split_interleaved(t.trials.join(labs, "eid"), "s2")


@query("e12_interleaved", sql("interleaved", "SELECT eid, trial_id, part FROM interleaved"))
def _(t: Tables):
    return interleaved(t).select("eid", "trial_id", "part")


# --- guards ---------------------------------------------------------------------

def _violations(needs: str, guard: str, subject: str, detail: str, rest: str,
                split_id: str = "split_id") -> str:
    return sql(needs, f"SELECT '{guard}' AS guard, {split_id} AS split_id, "
                      f"({subject})::VARCHAR AS subject_of, ({detail})::VARCHAR AS detail {rest}")


def overlapping(t: Tables):
    """Test starts inside the train block for odd animals, inside the gap for others."""
    early = F.when(F.col("subject") % 2 == 1, 10).otherwise(13).cast("bigint")
    return t.within_blocks.withColumn(
        "start_bin", F.when(F.col("part") == "test", early).otherwise(F.col("start_bin")))


_OVERLAP = "FROM within_blocks WHERE part = 'test'"


@query("g01_shared_bins", _violations(
    "within_blocks", "shared_bins", "eid",
    "'test:' || CASE WHEN subject % 2 = 1 THEN '10' ELSE '13' END || ':23'", _OVERLAP))
def _(t: Tables):
    return guards.shared_bins(guards.sweep(overlapping(t)), CONTEXT)


@query("g01_shared_bins_trials", _violations(
    "trial_sweep", "shared_bins", "eid",
    "part || ':' || start_bin || ':' || end_bin", """FROM trial_sweep
WHERE CASE WHEN part = 'train' THEN after_test ELSE after_train END < 3"""))
def _(t: Tables):
    blocks = splits.trial_blocks(interleaved(t), BIN_US)
    return guards.shared_bins(guards.sweep(blocks), CONTEXT)


@query("g02_short_gap", _violations(
    "within_blocks", "short_gap", "eid",
    "'test:' || CASE WHEN subject % 2 = 1 THEN '10:23:-2' ELSE '13:23:1' END", _OVERLAP))
def _(t: Tables):
    return guards.short_gap(guards.sweep(overlapping(t)), max(CONTEXT, GAP))


def by_session(t: Tables):
    """Sessions of one animal spread over the parts: the leak an animal split must not have."""
    b = hash_bucket(100, "eid")
    return splits.whole_sessions(t.sessions, "three_way", "by_session",
                                 F.when(b < 60, "train").when(b < 80, "calib").otherwise("test"))


cte("by_session", ("sessions",), f"""
SELECT 'by_session' AS split_id, eid, subject,
       CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'calib' ELSE 'test' END AS part
FROM (SELECT *, {bucket("eid::VARCHAR")} AS b FROM sessions)""")


@query("g03_shared_subjects", _violations(
    "by_session", "shared_subject", "subject", "'subject'", """FROM by_session
WHERE part <> 'calib' GROUP BY split_id, subject HAVING count(DISTINCT part) > 1"""))
def _(t: Tables):
    return guards.shared_subjects(by_session(t))


@query("g04_shared_sessions", _violations(
    "trial_blocks", "shared_session", "eid", "'eid'", """FROM trial_blocks
GROUP BY split_id, eid HAVING count(DISTINCT part) > 1"""))
def _(t: Tables):
    return guards.shared_sessions(splits.trial_blocks(interleaved(t), BIN_US))


@query("g05_calibration_overlap", _violations(
    "by_session", "calib_subject", "subject", "'subject'", """FROM by_session
GROUP BY split_id, subject HAVING bool_or(part = 'calib') AND bool_or(part <> 'calib')"""))
def _(t: Tables):
    return guards.calibration_overlap(by_session(t), animal_level=True)


cte("trial_parts", ("trials", "parts24"), """
SELECT DISTINCT 'mid_trial' AS split_id, t.eid, t.trial_id, p.part
FROM trials t JOIN parts24 p ON p.bin * 21600000000 + 10800000000 >= t.start_us
 AND p.bin * 21600000000 + 10800000000 < t.end_us""")


@query("g06_straddling_trials", _violations(
    "trial_parts", "straddling_trial", "trial_id", "min(part) || ':' || max(part)",
    "FROM trial_parts GROUP BY split_id, eid, trial_id HAVING count(DISTINCT part) > 1"))
def _(t: Tables):
    bins = t.sessions.select("eid", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(N_BINS - 1).cast("bigint"))).alias("bin"))
    labelled = targets.trial_bins(t.within.rows(bins, "train", "gap", "test"),
                                  t.trials.drop("subject"), BIN_US, 4)
    return guards.straddling_trials(labelled.withColumn("split_id", F.lit("mid_trial")))


@query("g07_empty_parts", _violations(
    "lab_splits", "empty_part", "s.split_id", "p.part", """
FROM (SELECT DISTINCT split_id FROM lab_splits) s
CROSS JOIN (VALUES ('train'), ('calib'), ('test')) p(part)
WHERE NOT EXISTS (SELECT 1 FROM lab_splits l WHERE l.split_id = s.split_id AND l.part = p.part)
""", "s.split_id"))
def _(t: Tables):
    return guards.empty_parts(lab_splits(t), ("train", "calib", "test"))


@query("g08_version_mismatch", _violations(
    "lab_splits", "version_mismatch", "split_id",
    "CASE WHEN lab % 3 = 0 THEN '6' ELSE '7' END || ':' || CASE WHEN lab % 2 = 0 THEN '' ELSE '1' END",
    """FROM (SELECT DISTINCT split_id, lab FROM lab_splits) WHERE lab % 3 = 0 OR lab % 2 = 0"""))
def _(t: Tables):
    meta = lab_splits(t).select("split_id", "lab").distinct().select(
        "split_id", F.when(F.col("lab") % 3 == 0, "6").otherwise("7").alias("manifest_version"),
        F.when(F.col("lab") % 2 == 1, "1").alias("preproc_version"))
    return guards.version_mismatch(meta, "7", "1")


@query("g09_interleaved", _violations(
    "trial_sweep", "interleaved", "eid",
    "count(*) FILTER (WHERE prev_part <> part)", """FROM trial_sweep
GROUP BY split_id, eid HAVING count(*) FILTER (WHERE prev_part <> part) > 1"""))
def _(t: Tables):
    return guards.interleaved(guards.sweep(splits.trial_blocks(interleaved(t), BIN_US)))


@query("g10_norm_leak", _violations(
    "dense", "norm_leak", "eid", "unit_id", """FROM (
SELECT eid, unit_id, avg(n) AS m1, stddev_pop(n) AS s1,
       avg(n) FILTER (WHERE bin < 12) AS m0, stddev_pop(n) FILTER (WHERE bin < 12) AS s0
FROM dense GROUP BY eid, unit_id) WHERE abs(m1 - m0) > 1e-9 OR abs(s1 - s0) > 1e-9""", "''"))
def _(t: Tables):
    everything = splits.Split("whole", splits.whole_sessions(t.sessions, "whole", "whole",
                                                              F.lit("train")), 1,
                              required_parts=("train",))
    leaky = binning.fit_norm(t.bins, t.units, everything)
    return guards.norm_leak(leaky, binning.fit_norm(t.bins, t.units, t.within))
