"""Uncertainty, shift scores and selective prediction against brute force."""

import math
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import planted
from truegauge.operators import latent, nulls, ood, selective, uncertainty
from truegauge.operators.classifiers import fit_centroids
from verification.check import compare


def vectors(n, dim, shift=0.0, name="v"):
    return [(f"{name}{i}", [planted.gauss(name, i, d) + shift for d in range(dim)]) for i in range(n)]


@pytest.fixture(scope="module")
def clouds(spark):
    train = vectors(300, 6, name="t") + vectors(150, 6, 8.0, name="far")
    test = vectors(40, 6, name="q") + vectors(10, 6, 4.0, name="mid")
    schema = "eid string, x array<double>"
    return train, test, spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)


@pytest.mark.parametrize("pivots,block_rows", [(1, 4096), (8, 20), (40, 7)])
def test_nearest_neighbours_are_exact(clouds, pivots, block_rows):
    train, test, known, asked = clouds
    c = np.array([x for _, x in train])
    got = {r["eid"]: r for r in ood.knn_distance(asked, known, 5, pivots, block_rows).collect()}
    assert len(got) == len(test)
    for eid, x in test:
        want = np.sort(np.sqrt(((c - np.array(x)) ** 2).sum(axis=1)))[:5]
        assert np.isclose(got[eid]["knn_mean"], want.mean()) and np.isclose(got[eid]["knn_kth"], want[4])


def test_neighbours_of_repeated_ids_and_few_rows(spark, clouds):
    train, _, known, _ = clouds
    schema = "eid string, x array<double>"
    rows = [("same", train[0][1]), ("same", train[400][1]), (None, train[3][1]), ("none", None)]
    asked = spark.createDataFrame(rows, schema)
    c = np.array([x for _, x in train])
    want = sorted(np.sort(np.sqrt(((c - np.array(x)) ** 2).sum(axis=1)))[:5].mean() for _, x in rows[:3])
    got = ood.knn_distance(asked, known, 5, block_rows=30).collect()
    assert sorted(str(r["eid"]) for r in got) == ["None", "same", "same"]
    assert np.allclose(sorted(r["knn_mean"] for r in got), want)
    few = ood.knn_distance(asked, known.limit(2), 5).collect()
    assert len(few) == 3 and all(r["knn_kth"] >= r["knn_mean"] for r in few)
    assert ood.knn_distance(asked, known.where("false"), 5).count() == 0
    equal = spark.createDataFrame([("a", [1.0, 2.0])] * 50, schema)
    assert {(r["knn_mean"], r["knn_kth"]) for r in ood.knn_distance(equal, equal, 5, block_rows=8).collect()} == {(0.0, 0.0)}


def test_clustered_rows_meet_few_blocks(spark):
    """On clusters far apart a row meets blocks of its own cluster, not all."""
    rows = [(f"e{i}", [planted.gauss(i, d) + 50.0 * ((i % 12) == d) for d in range(12)]) for i in range(1500)]
    known = spark.createDataFrame(rows, "eid string, x array<double>").repartition(5)
    near = ood.Neighbours(known, 30)
    answers, met = ood.knn_search(known.where("eid like '%7'"), near, 5)
    blocks, asked = near.blocks.count(), known.where("eid like '%7'").count()
    assert blocks >= 40 and len(near.pivots) > 5
    assert answers.count() == asked and met.count() < 0.4 * blocks * asked
    assert near.blocks.agg(F.max("n")).head()[0] <= 150


def test_tasks_of_neighbours_hold_bounded_pairs(spark, monkeypatch):
    """Parts of a cell get smaller with its blocks; a distance matrix is never made whole."""
    rng = np.random.default_rng(4)
    known = spark.createDataFrame([(str(i), rng.normal(size=3).tolist()) for i in range(900)], "eid string, x array<double>")
    monkeypatch.setattr(ood, "MOST_PAIRS", 200)
    near = ood.Neighbours(known, 20, pivots=1)
    celled = near.in_cells(near.rows)
    pairs = near._with_centres(celled, celled, near.blocks, lambda a, b: a[["qid"]].assign(pairs=len(a) * len(b)),
                               "qid bigint, pairs bigint").collect()
    assert len(pairs) == 900 and near.blocks.count() > 20 and max(r["pairs"] for r in pairs) < 1500

    rows, block = rng.normal(size=(700, 64)), rng.normal(size=(4096, 64))
    tracemalloc.start()
    apart, least = ood._apart(rows, block[:1024]), ood._k_least(rows, block, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    want = np.sqrt(((rows[:20, None] - block[None]) ** 2).sum(axis=2))
    assert np.allclose(apart[:20], want[:, :1024]) and np.allclose(least[:20], np.sort(want, axis=1)[:, :5])


def test_mahalanobis_matches_numpy(clouds):
    train, test, known, asked = clouds
    c = np.array([x for _, x in train])
    cov = np.cov(c.T, bias=True)
    cov = 0.8 * cov + 0.2 * np.trace(cov) / 6 * np.eye(6)
    reference = ood.fit_reference(known.repartition(5), 6, 0.2)
    got = {r["eid"]: r["s"] for r in asked.select("eid", reference.full().alias("s")).collect()}
    for eid, x in test:
        d = np.array(x) - c.mean(axis=0)
        assert np.isclose(got[eid], d @ np.linalg.solve(cov, d))
    flat = {r["eid"]: r["score"] for r in ood.diagonal_distance(known, asked, 6).collect()}
    for eid, x in test:
        assert np.isclose(flat[eid], (((np.array(x) - c.mean(axis=0)) / c.std(axis=0)) ** 2).sum())


def test_gate_cuts_come_from_calibration(spark):
    calib = spark.createDataFrame([(f"c{i}", float(i)) for i in range(101)], "eid string, score double")
    test = spark.createDataFrame([("a", 10.0), ("b", 60.0), ("c", 90.0), ("d", 99.0), ("e", None)],
                                 "eid string, score double")
    got = {r["eid"]: r["gate"] for r in ood.gate(test, calib).collect()}
    assert got == {"a": "high", "b": "moderate", "c": "low", "d": "abstain", "e": "abstain"}


def test_conformal_threshold_is_infinite_when_calibration_is_too_small(spark):
    small = spark.createDataFrame([(float(i),) for i in range(5)], "score double")
    assert uncertainty.conformal_threshold(small, "score", 0.1).head()["threshold"] == math.inf
    assert uncertainty.conformal_threshold(small, "score", 0.4).head()["threshold"] == 3.0


def test_conformal_quantile_covers_exchangeable_rows_and_misses_shift(spark):
    def rows(name, n, spread):
        return spark.createDataFrame([(i % 3, spread * planted.gauss(name, i)) for i in range(n)],
                                     "b bigint, y double")
    train, calib = rows("tr", 900, 1.0), rows("ca", 600, 1.0)
    for name, spread, covered in (("te", 1.0, True), ("sh", 4.0, False)):
        out = uncertainty.conformal_quantile(train, calib, rows(name, 600, spread), "b", 0.1)
        coverage = out.agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))).head()[0]
        assert (abs(coverage - 0.9) < 0.04) == covered
    unseen = spark.createDataFrame([(9, 0.0)], "b bigint, y double")
    row = uncertainty.conformal_quantile(train, calib, unseen, "b", 0.1).head()
    assert row["lo"] == -math.inf and row["hi"] == math.inf


def test_coverage_table_never_promises_across_animals(spark):
    rows = [(k, p, planted.gauss(k, p, i), 0.0) for k in ("held_out_session", "held_out_animal")
            for p in ("calib", "test") for i in range(200)]
    got = {r["kind"]: r for r in uncertainty.coverage_by_kind(spark.createDataFrame(
        rows, "kind string, part string, y double, yhat double"), 0.2).collect()}
    assert got["held_out_session"]["guarantee_applies"] and not got["held_out_animal"]["guarantee_applies"]
    assert abs(got["held_out_session"]["miss"]) < 0.08


def test_temperature_finds_the_planted_sharpness(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        z = rng.normal(size=3)
        p = np.exp(z) / np.exp(z).sum()
        rows.append((int(rng.choice(3, p=p)), [float(v) for v in 4 * z]))
    df = spark.createDataFrame(rows, "y bigint, logits array<double>")
    assert uncertainty.fit_temperature(df, [0.5, 1.0, 2.0, 4.0, 8.0]) == 4.0


def test_centroids_and_large_logits(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [0.0, 5.0])], "y bigint, x array<double>")
    model = fit_centroids(rows, 2, 2, 1000.0)
    assert model.weights.tolist() == [[2.0, 0.0], [0.0, 5.0]]
    energies = [r[0] for r in rows.select(model.logits().alias("logits")).select(ood.energy()).collect()]
    assert np.isfinite(energies).all()


def brute_risk(scores, errors):
    order = np.lexsort((np.arange(len(scores)), scores))
    return np.cumsum(np.array(errors)[order]) / np.arange(1, len(scores) + 1)


def test_risk_coverage_and_areas(spark):
    n = 60
    rows = [(i, round(planted.draw(i, "s"), 1), planted.draw(i, "c"), planted.draw(i, "e")) for i in range(n)]
    df = spark.createDataFrame(rows, "eid bigint, s double, c double, error double")
    curve = selective.risk_coverage(selective.orderings(df, {"ood": "s", "confidence": "c"}))
    got = curve.toPandas().sort_values(["method", "rank"])
    frame = pd.DataFrame(rows, columns=["eid", "s", "c", "error"])
    for method, column in (("ood", "s"), ("confidence", "c")):
        want = brute_risk(frame[column], frame.error)
        assert np.allclose(got[got.method == method].risk, want)
        area = selective.aurc(curve).where(F.col("method") == method).head()["aurc"]
        assert np.isclose(area, want.mean())
    gain = {r["method"]: r for r in selective.abstention_gain(curve, 0.25).collect()}
    assert {r["n_kept"] for r in gain.values()} == {45} and "random" in gain


def test_shifted_animals_are_found_and_yield_is_removed(spark):
    """Error follows the planted shift; the unit count is a bystander."""
    rows = [(f"s{i}", i / 40 + 0.05 * planted.gauss(i, "o"), i / 40 + 0.05 * planted.gauss(i, "e"),
             float(50 + 10 * planted.gauss(i, "u"))) for i in range(40)]
    df = spark.createDataFrame(rows, "eid string, score double, error double, n_units double")
    found = {r["control"]: r["rho"] for r in
             selective.controlled_spearman(df, "score", "error", ["n_units"]).collect()}
    assert found["none"] > 0.9 and found["n_units"] > 0.9
    doubt = df.withColumn("doubt", F.col("n_units"))
    areas = selective.aurc(selective.risk_coverage(
        selective.orderings(doubt, {"ood": "score", "confidence": "doubt"})))
    row = selective.success_summary(selective.spearman(df, "score", "error"), areas, "ood", "confidence").head()
    assert row["rho_ok"] and row["aurc_ok"] and row["enough"]


def test_count_confound_vanishes_when_controlled(spark):
    rows = []
    for i in range(200):
        u = planted.gauss(i, "u")
        rows.append((u + 0.5 * planted.gauss(i, "a"), u + 0.5 * planted.gauss(i, "b"), u,
                     planted.gauss(i, "d")))
    df = spark.createDataFrame(rows, "score double, error double, n_units double, duration double")
    found = {r["control"]: r["rho"] for r in selective.controlled_spearman(
        df, "score", "error", ["n_units", "duration"]).collect()}
    assert found["none"] > 0.6 and abs(found["n_units"]) < 0.25 and abs(found["all"]) < 0.25
    assert found["duration"] > 0.6
    smell = selective.strongest_covariate(df, "error", ["n_units", "duration"]).where("strongest").head()
    assert smell["covariate"] == "n_units"


def test_latent_states_follow_planted_clusters(spark):
    rows = [("a", i, (i % 2) * 10.0 + 0.1 * planted.gauss(i, "f"), 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "eid string, bin bigint, f1 double, f2 double")
    states = latent.assign_states(df, df, ["f1", "f2"], 2)
    got = {(r["bin"] % 2, r["state"]) for r in states.collect()}
    assert got == {(0, "latent_state_0"), (1, "latent_state_1")}
    moves = {(r["from_state"], r["to_state"]): r["n"] for r in latent.transitions(states).collect()}
    assert moves == {("latent_state_0", "latent_state_1"): 100, ("latent_state_1", "latent_state_0"): 99}
    mi = latent.mutual_information(states.withColumn("odd", F.col("bin") % 2), "state", "odd").head()["mi"]
    assert np.isclose(mi, math.log(2))


def test_state_count_by_bic(spark):
    rows = [(f"s{i % 3}", float((i % 2) * 8) + planted.gauss(i, "f"), planted.gauss(i, "g")) for i in range(600)]
    df = spark.createDataFrame(rows, "eid string, f1 double, f2 double")
    counts = latent.state_counts(df, df, ["f1", "f2"], [2, 3, 4])
    assert {r["n_states"] for r in counts.collect()} == {2}
    row = latent.count_stability(counts).head()
    assert row["mode"] == 2 and row["spread"] == 0.0 and row["n_sessions"] == 3


@pytest.mark.parametrize("chunk", [3, 8192])
def test_rotated_errors_are_those_of_the_rows(spark, chunk):
    """Errors of whole batches of sessions equal the errors of the rotated rows, nulls and a lone row included."""
    rows = [(e, p, n, None if (e + p) % 7 == 0 else planted.gauss("y", e, p), None if (e * p) % 11 == 5 else planted.gauss("z", e, p))
            for e, n in enumerate([1, 2, 5, 8, 12, 3]) for p in range(n) if (e, p) != (4, 6)]
    scored = spark.createDataFrame(rows, "eid long, pos long, n_pos long, y double, yhat double")
    err = F.col("y") - F.col("yhat")
    want = {(r["eid"], r["rep"]): (r["n"], r["value"]) for r in nulls.null_shuffle(scored, 9, "s", chunk).groupBy(
        "eid", "rep").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("value")).collect()}
    got = {(r["eid"], r["rep"]): (r["n"], r["value"]) for r in nulls.shuffle_errors(scored, 9, "s", chunk).collect()}
    assert got.keys() == want.keys() and len({e for e, _ in got}) == 5
    for key, (n, value) in want.items():
        assert got[key][0] == n
        assert got[key][1] == (None if value is None else pytest.approx(value, rel=1e-12))
    assert nulls.shuffle_errors(scored.where("false"), 9, "s", chunk).count() == 0


def test_a_fitted_temperature_of_one_is_audited_once(spark, tmp_path):
    """The SQL has no second method where the raw logits are the best ones already."""
    rng, n = np.random.default_rng(3), 400
    label = rng.integers(0, 10, n)
    x = 0.15 * (rng.standard_normal((n, 64)) + 2 * np.eye(10, 64)[label])
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x.astype("float32")), pa.list_(pa.float32())),
                      "label": pa.array(label, pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    connection = duckdb.connect()
    connection.register("embeddings", table)
    text, ok = compare("u08_calibration_audit", entry.queries()["u08_calibration_audit"](spark, str(tmp_path)), connection)
    assert ok and text.startswith("rows=2"), text
