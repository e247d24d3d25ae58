"""Session tables, cache, artifacts, inventories and traceability."""

import hashlib

import pytest
from pyspark.sql import functions as F

from truegauge.operators import integrity, report
from truegauge.sources import artifacts, cache, inventory, sessions


@pytest.fixture(scope="module")
def tables(spark):
    spikes = spark.createDataFrame([(e, "u", t) for e in ("a", "b", "c") for t in range(50)],
                                   "eid string, unit_id string, t_us bigint")
    units = spikes.select("eid", "unit_id").distinct()
    trials = spark.createDataFrame([("a", 1)], "eid string, trial_id int")
    behaviour = spark.createDataFrame([("a", "wheel", 0, 0, 1.0)],
                                      "eid string, series string, sample_idx bigint, t_us bigint, value double")
    return {"spikes": spikes, "units": units, "trials": trials, "behaviour": behaviour}


def test_load_session_round_trip_and_pruning(spark, tables, tmp_path):
    sessions.write_tables(tables, str(tmp_path), "main", buckets=8)
    one = sessions.load_session(spark, str(tmp_path), "a", "main", buckets=8)
    assert one.spikes.count() == 50 and one.trials.count() == 1
    plan = one.spikes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_bucket" in plan
    assert "EqualTo(eid,a)" in plan
    present = {r["capability"]: r["present"] for r in
               sessions.load_session(spark, str(tmp_path), "b", "main", buckets=8).available.collect()}
    assert present == {"spikes": True, "units": True, "trials": False, "behaviour": False}


def test_capabilities_of_every_session(spark):
    eids = spark.createDataFrame([("a",), ("b",)], "eid string")
    rows = spark.createDataFrame([("a",), ("a",), ("elsewhere",)], "eid string")
    got = sessions.session_capabilities(eids, {"spikes": rows, "trials": rows.limit(0)}).collect()
    assert {(r["eid"], r["capability"], r["n_rows"], r["present"], r["reason"]) for r in got} == {
        ("a", "spikes", 2, True, None), ("a", "trials", 0, False, "no rows"),
        ("b", "spikes", 0, False, "no rows"), ("b", "trials", 0, False, "no rows")}


def test_cache_hit_is_identical_and_version_invalidates(spark, tables, tmp_path):
    root, calls = str(tmp_path), []

    def compute(missing):
        calls.append(sorted(r["eid"] for r in missing.collect()))
        return tables["spikes"].join(missing, "eid").groupBy("eid").agg(F.sum("t_us").alias("s"))
    wanted = tables["units"].select("eid")
    cold = sorted(cache.cached(wanted.where("eid <> 'c'"), compute, root, {"w": 1}).collect())
    warm = sorted(cache.cached(wanted.where("eid <> 'c'"), compute, root, {"w": 1}).collect())
    assert cold == warm and calls == [["a", "b"]]
    assert len(cache.cached(wanted, compute, root, {"w": 1}).collect()) == 3 and calls[-1] == ["c"]
    cache.cached(wanted, compute, root, {"w": 1}, version="other")
    cache.cached(wanted, compute, root, {"w": 2})
    assert calls[-2:] == [["a", "b", "c"]] * 2


def test_manifest_rejects_null_subjects_and_empty_sessions(spark):
    rows = spark.createDataFrame([("a", "m", 3, 2), ("b", None, 3, 2), ("c", "m", 0, 0), ("d", "m", 1, 2)],
                                 "eid string, subject string, n_units bigint, n_units_qc bigint")
    assert {r["eid"] for r in sessions.manifest_violations(rows).collect()} == {"b", "c", "d"}


def test_selection_spreads_over_subjects_or_raises(spark):
    rows = spark.createDataFrame([(f"s{i}{j}", f"m{i}", f"l{i % 2}") for i in range(4) for j in range(3)],
                                 "eid string, subject string, lab string")
    assert sessions.select_sessions(rows, 4, 4, 2).select("subject").distinct().count() == 4
    with pytest.raises(ValueError):
        sessions.select_sessions(rows, 3, 4, 2)


def test_backends_agree_on_counts_with_zero_tolerance(spark):
    a = spark.createDataFrame([("e", "probe00", "u1", 5), ("e", "probe00", "u2", 7)],
                              "eid string, probe_name string, unit_id string, n_spikes bigint")
    b = a.withColumn("probe_name", F.upper("probe_name"))
    assert integrity.backend_agreement(a, b).head()["agree"]
    off = b.withColumn("n_spikes", F.col("n_spikes") + F.when(F.col("unit_id") == "u1", 1).otherwise(0))
    assert not integrity.backend_agreement(a, off).head()["agree"]
    diff = integrity.unit_set_diff(a, off.where("unit_id = 'u1'"), ["n_spikes"]).head()
    assert (diff["only_a"], diff["only_b"], diff["common"], diff["max_diff_n_spikes"]) == (1, 0, 1, 1)
    assert integrity.common_units(a, off.where("unit_id = 'u1'")).count() == 1


def test_monotonic_across_chunks(spark):
    times = [0, 5, 9, 8, 20, 20, 30]
    rows = spark.createDataFrame([("e", "w", i, t) for i, t in enumerate(times)],
                                 "eid string, series string, sample_idx bigint, t_us bigint")
    for chunk in (1, 3, 100):
        assert [r["sample_idx"] for r in integrity.monotonic_violations(rows, chunk).collect()] == [3]


def test_checksums_of_landed_files(spark, tmp_path):
    for name, text in (("a.bin", b"one"), ("b.bin", b"two")):
        (tmp_path / name).write_bytes(text)
    landed = inventory.landed_checksums(spark, str(tmp_path)).withColumn(
        "file", F.element_at(F.split("file", "/"), -1))
    expected = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest()),
                                      ("b.bin", hashlib.sha256(b"x").hexdigest()), ("c.bin", "0")],
                                     "file string, checksum string")
    got = {r["file"]: r["status"] for r in inventory.verify_checksums(landed, expected).collect()}
    assert got == {"a.bin": "ok", "b.bin": "mismatch", "c.bin": "missing"}


def test_probe_and_capabilities_of_foreign_files(spark):
    paths = {"full": ["units/spike_times", "units/location", "intervals/trials/start", "processing/wheel/timestamps"],
             "no_region": ["units/spike_times", "intervals/trials/start"],
             "rate_only": ["acquisition/series/starting_time"], "odd": ["???"], "empty_name": [""]}
    rows = spark.createDataFrame([(f, p) for f, ps in paths.items() for p in ps], "file string, path string")
    probe = inventory.schema_probe(rows)
    assert probe.count() == 5
    needs = {"choice": ["spike_times", "trials_interval"], "by_region": ["spike_times", "region_column"]}
    got = {(r["file"], r["capability"]): (r["present"], r["missing"])
           for r in inventory.capability_report(probe, needs).collect()}
    assert got["full", "by_region"] == (True, "")
    assert got["no_region", "choice"] == (True, "")
    assert got["no_region", "by_region"] == (False, "region_column")
    assert got["odd", "choice"] == (False, "spike_times, trials_interval")


def test_known_columns_map_and_scale(spark):
    mapping = inventory.column_mapping(spark)
    trials = spark.createDataFrame([(1.5, -1, 9)], "gabor_stimulus_onset_time double, mouse_wheel_choice int, other int")
    assert inventory.apply_mapping(trials, mapping, "nwb").columns == ["stim_on", "choice", "other"]
    metres = inventory.column_mapping(spark, [("one", "x", "x_um", 1e6)])
    assert inventory.apply_mapping(spark.createDataFrame([(0.002,)], "x double"), metres, "one").head()["x_um"] == 2000.0


def test_every_numeral_is_traceable(spark):
    reports = spark.createDataFrame([(1, "gate low, coverage 0.81 over 12 units"), (2, "error 3.5")],
                                    "report_id int, text string")
    fields = spark.createDataFrame([(1, "0.81"), (1, "12"), (2, "3.6")], "report_id int, field string")
    got = report.untraceable_numerals(reports, fields).collect()
    assert [(r["report_id"], r["numeral"]) for r in got] == [(2, "3.5")]


def test_artifacts_round_trip(spark, tmp_path):
    root = str(tmp_path)
    preds = spark.createDataFrame([("a", 1, 0.5)], "eid string, bin bigint, yhat double")
    qc = spark.createDataFrame([("a", 3)], "eid string, n_pass bigint")
    artifacts.write_artifacts({"predictions": preds, "qc": qc}, root)
    assert artifacts.read_artifact(spark, root, "predictions").collect() == preds.collect()
    assert artifacts.read_artifact(spark, root, "qc", "eid string, n_pass bigint").collect() == qc.collect()
    with pytest.raises(ValueError):
        artifacts.write_artifacts({"report": qc}, root)
