"""Quality control, binning, windows and targets on the events binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.operators import binning, qc, targets
from verification.bindings import BIN_US, CONTEXT, Tables
from verification.ctes import cte, sql
from verification.registry import query, r6, rounded

TAU_US = BIN_US
CONFIG = qc.QcConfig(min_label=1.0, min_rate_hz=5e-6, max_rp_violation=0.4, rp_tau_us=TAU_US)

cte("rates", ("units", "ev"), """
SELECT u.eid, u.unit_id, count(e.t_us) AS n_spikes, count(e.t_us) / 259200.0 AS rate_hz
FROM units u LEFT JOIN ev e ON e.eid = u.eid AND e.unit_id = u.unit_id AND e.t_us < 259200000000
GROUP BY u.eid, u.unit_id""")
cte("violations", ("ev",), """
SELECT eid, unit_id, count(isi) AS n_isi,
       CASE WHEN count(isi) > 0 THEN count(*) FILTER (WHERE isi < 21600000000)::DOUBLE / count(isi) END
       AS rp_violation
FROM (SELECT eid, unit_id, t_us - lag(t_us) OVER (PARTITION BY eid, unit_id ORDER BY t_us) AS isi
      FROM ev WHERE t_us < 259200000000) GROUP BY eid, unit_id""")
cte("verdicts", ("units", "rates", "violations"), """
SELECT u.eid, u.unit_id, u.region, r.rate_hz, v.rp_violation,
       CASE WHEN u.label < 1.0 THEN 'label' WHEN r.rate_hz < 5e-6 THEN 'rate'
            WHEN v.rp_violation > 0.4 THEN 'refractory' ELSE 'pass' END AS reason
FROM units u JOIN rates r USING (eid, unit_id) LEFT JOIN violations v USING (eid, unit_id)""")


def verdicts(t: Tables):
    spans = t.within.spans("train", BIN_US)
    rates = qc.firing_rate(t.spikes, t.units, spans, BIN_US)
    return qc.qc_units(t.units, rates, qc.rp_violation(t.spikes, spans, TAU_US, BIN_US), CONFIG)


@query("c01_unit_qc", sql("verdicts", """
SELECT eid, unit_id, reason, reason = 'pass' AS passed FROM verdicts"""))
def _(t: Tables):
    return verdicts(t).select("eid", "unit_id", "reason", "passed")


@query("c02_firing_rate", sql("rates", """
SELECT eid, unit_id, n_spikes, round(rate_hz * 3600, 6) AS per_hour FROM rates"""))
def _(t: Tables):
    rates = qc.firing_rate(t.spikes, t.units, t.within.spans("train", BIN_US), BIN_US)
    return rates.select("eid", "unit_id", "n_spikes", r6(F.col("rate_hz") * 3600).alias("per_hour"))


@query("c03_rp_violation", sql("violations", """
SELECT eid, unit_id, n_isi, round(rp_violation, 6) AS rp_violation FROM violations"""))
def _(t: Tables):
    return rounded(qc.rp_violation(t.spikes, t.within.spans("train", BIN_US), TAU_US, BIN_US), "rp_violation")


@query("c04_qc_report", sql("verdicts", """
SELECT eid, count(*) AS n_units, count(*) FILTER (WHERE reason = 'pass') AS n_pass,
       count(*) FILTER (WHERE reason = 'label') AS n_fail_label,
       count(*) FILTER (WHERE reason = 'rate') AS n_fail_rate,
       count(*) FILTER (WHERE reason = 'refractory') AS n_fail_refractory
FROM verdicts GROUP BY eid"""))
def _(t: Tables):
    return qc.qc_report(verdicts(t))


@query("c05_bin_spikes", sql("bins", "SELECT eid, unit_id, bin, n FROM bins"))
def _(t: Tables):
    return binning.bin_spikes(t.spikes, BIN_US)


@query("c06_densify", sql("dense", "SELECT eid, unit_id, bin, n FROM dense"))
def _(t: Tables):
    return t.dense


@query("c07_bin_multi", sql("ev", """
SELECT w AS width_us, eid, unit_id, t_us // w AS bin, count(*) AS n
FROM ev CROSS JOIN (VALUES (10800000000), (21600000000), (54000000000)) v(w) GROUP BY ALL"""))
def _(t: Tables):
    return binning.bin_multi(t.spikes, [BIN_US // 2, BIN_US, BIN_US * 5 // 2])


@query("c08_align_mean", sql("aligned", """
SELECT eid, series, bin, round(value, 6) AS value, n_samples FROM aligned"""))
def _(t: Tables):
    return rounded(t.aligned, "value")


@query("c08_align_as_of", sql("ev sessions", """
SELECT s.eid, 'value' AS series, s.bin, e.value
FROM (SELECT eid, unnest(range(24)) AS bin FROM sessions) s
ASOF LEFT JOIN ev e ON e.eid = s.eid AND e.t_us <= s.bin * 21600000000"""))
def _(t: Tables):
    return binning.align_as_of(t.behaviour, t.sessions, BIN_US)


@query("c09_fit_norm", sql("norm", """
SELECT eid, unit_id, round(mean, 6) AS mean, round(std, 6) AS std, n FROM norm"""))
def _(t: Tables):
    return rounded(binning.fit_norm(t.bins, t.units, t.within), "mean", "std")


@query("c10_apply_norm", sql("dense norm", """
SELECT d.eid, d.unit_id, d.bin, d.n,
       round(CASE WHEN std > 0 THEN (d.n - mean) / std ELSE 0.0 END, 6) AS z
FROM dense d JOIN norm USING (eid, unit_id)"""))
def _(t: Tables):
    stats = binning.fit_norm(t.bins, t.units, t.within)
    return rounded(binning.normalized_grid(t.bins, stats, binning.whole_spans(t.sessions)), "z")


@query("c11_context_windows", sql("dense parts24", """
SELECT eid, unit_id, part, bin AS end_bin, first, total, ctx FROM (
  SELECT eid, unit_id, part, bin, lag(n, 3) OVER w AS first,
         CAST(n + lag(n, 1) OVER w + lag(n, 2) OVER w + lag(n, 3) OVER w AS BIGINT) AS total,
         concat_ws(',', lag(n, 3) OVER w, lag(n, 2) OVER w, lag(n, 1) OVER w, n) AS ctx
  FROM dense JOIN parts24 USING (bin) WHERE part <> 'gap'
  WINDOW w AS (PARTITION BY eid, unit_id, part ORDER BY bin))
WHERE first IS NOT NULL"""))
def _(t: Tables):
    rows = binning.densify(t.bins, t.units, t.within.bin_spans("train", "test"))
    ctx = binning.context_windows(rows, "n", CONTEXT)
    return ctx.select("eid", "unit_id", "part", "end_bin", F.col("ctx")[0].alias("first"),
                      F.aggregate("ctx", F.lit(0).cast("bigint"), lambda a, v: a + v)
                      .alias("total"),
                      F.concat_ws(",", F.col("ctx").cast("array<string>")).alias("ctx"))


@query("c12_peri_event", sql("ev trial_starts", """
SELECT e.eid, s.trial_id, e.unit_id,
       (e.t_us - (s.start_us - 10800000000)) // 3600000000 AS bin, count(*) AS n
FROM trial_starts s JOIN ev e ON e.eid = s.eid
 AND e.t_us >= s.start_us - 10800000000 AND e.t_us < s.start_us + 32400000000
GROUP BY ALL"""))
def _(t: Tables):
    return binning.peri_event(t.spikes, t.trial_starts, BIN_US // 2, BIN_US * 3 // 2, BIN_US // 6)


@query("c13_population_vectors", sql("dense", """
SELECT eid, bin, string_agg(n::VARCHAR, ',' ORDER BY unit_id) AS vector, count(*) AS n_units
FROM dense GROUP BY eid, bin"""))
def _(t: Tables):
    vectors = binning.population_vectors(t.bins, t.units, binning.whole_spans(t.sessions))
    return vectors.select("eid", "bin",
                          F.concat_ws(",", F.col("vector").cast("array<string>")).alias("vector"),
                          F.size("vector").cast("bigint").alias("n_units"))


@query("c_flagship_normalized_rate", sql("dense norm", """
SELECT d.eid, d.unit_id, count(*) AS n_bins,
       round(avg(CASE WHEN std > 0 THEN (d.n - mean) / std ELSE 0.0 END), 6) AS mean_z
FROM dense d JOIN norm USING (eid, unit_id) WHERE d.bin >= 16 GROUP BY d.eid, d.unit_id"""))
def _(t: Tables):
    stats = binning.fit_norm(t.bins, t.units, t.within)
    z = binning.normalized_grid(t.bins, stats, t.within.bin_spans("test"))
    return z.groupBy("eid", "unit_id").agg(F.count(F.lit(1)).alias("n_bins"),
                                           r6(F.avg("z")).alias("mean_z"))


# --- targets ------------------------------------------------------------------

cte("speed_state", ("velocity",), """
SELECT eid, bin, velocity, CASE WHEN abs(velocity) < 0.0002 THEN 'still'
       WHEN abs(velocity) < 0.001 THEN 'slow' ELSE 'fast' END AS state FROM velocity""")
cte("epochs", ("speed_state",), """
SELECT eid, state, min(bin) AS start_bin, max(bin) AS end_bin FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY eid ORDER BY bin) AS run FROM (
    SELECT *, CASE WHEN lag(bin) OVER w = bin - 1 AND lag(state) OVER w = state
                   THEN 0 ELSE 1 END AS fresh
    FROM speed_state WINDOW w AS (PARTITION BY eid ORDER BY bin)))
GROUP BY eid, run, state""")
STATES = dict(cuts=[0.0002, 0.001], labels=["still", "slow", "fast"])


@query("d01_wheel_velocity", sql("velocity", """
SELECT eid, bin, round(velocity * 3600, 6) AS per_hour FROM velocity"""))
def _(t: Tables):
    return t.velocity.select("eid", "bin", r6(F.col("velocity") * 3600).alias("per_hour"))


@query("d02_choice_target", sql("trial_starts", """
SELECT eid, trial_id, CASE WHEN choice > 0 THEN 1 ELSE 0 END::BIGINT AS y
FROM trial_starts WHERE choice <> 0"""))
def _(t: Tables):
    return targets.choice_target(t.trial_starts)


@query("d02_choice_counts", sql("trial_starts", """
SELECT eid, count(*) FILTER (WHERE choice <> 0) AS n_kept,
       count(*) FILTER (WHERE choice = 0) AS n_no_go FROM trial_starts GROUP BY eid"""))
def _(t: Tables):
    return targets.choice_counts(t.trial_starts)


@query("d03_movement_onset", sql("velocity", """
SELECT eid, bin, round(velocity * 3600, 6) AS per_hour FROM (
  SELECT *, count(*) FILTER (WHERE abs(velocity) < 0.0005) OVER (
    PARTITION BY eid ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS quiet
  FROM velocity) WHERE quiet = 2 AND abs(velocity) >= 0.0005"""))
def _(t: Tables):
    onset = targets.movement_onset(t.velocity, 0.0005, 2)
    return onset.select("eid", "bin", r6(F.col("velocity") * 3600).alias("per_hour"))


@query("d04_block_target", sql("trial_starts", """
SELECT eid, trial_id, CASE WHEN probability_left > 0.5 THEN 1 ELSE 0 END::BIGINT AS y
FROM trial_starts WHERE probability_left <> 0.5"""))
def _(t: Tables):
    return targets.block_target(t.trial_starts)


@query("d05_movement_state", sql("speed_state", "SELECT eid, bin, state FROM speed_state"))
def _(t: Tables):
    return targets.movement_state(t.velocity, **STATES).select("eid", "bin", "state")


@query("d06_state_epochs", sql("epochs", "SELECT eid, state, start_bin, end_bin FROM epochs"))
def _(t: Tables):
    return targets.state_epochs(targets.movement_state(t.velocity, **STATES))


@query("d07_trial_bins", sql("trials sessions", """
SELECT s.eid, s.bin, t.trial_id, t.choice,
       ((s.bin * 21600000000 + 10800000000 - t.start_us) * 4) // (t.end_us - t.start_us) AS phase
FROM (SELECT eid, unnest(range(24)) AS bin FROM sessions) s
JOIN trials t ON t.eid = s.eid AND t.end_us IS NOT NULL
 AND s.bin * 21600000000 + 10800000000 >= t.start_us
 AND s.bin * 21600000000 + 10800000000 < t.end_us"""))
def _(t: Tables):
    bins = t.sessions.select("eid", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                         F.col("n_bins") - 1)).alias("bin"))
    return targets.trial_bins(bins, t.trials.drop("subject"), BIN_US, 4).select(
        "eid", "bin", "trial_id", "choice", "phase")


@query("d08_horizon_targets", sql("parted", """
SELECT a.eid, a.part, a.bin, round(a.y, 6) AS y_now, 't' || h::VARCHAR AS horizon,
       round(b.y, 6) AS y_ahead
FROM parted a CROSS JOIN (VALUES (1), (2), (5)) v(h)
JOIN parted b ON b.eid = a.eid AND b.part = a.part AND b.bin = a.bin + h"""))
def _(t: Tables):
    rows = targets.horizon_targets(t.parted, "y", {"t1": 1, "t2": 2, "t5": 5})
    return rounded(rows.select("eid", "part", "bin", "y_now", "horizon", "y_ahead"),
                   "y_now", "y_ahead")
