"""Metrics, baselines and nulls against numpy, on planted sessions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import planted
from truegauge.functions.hashing import hash_bucket
from truegauge.operators import baselines, metrics, nulls, splits
from truegauge.plans import contract, protocols

LAM = 0.05


@pytest.fixture(scope="module")
def frame():
    return planted.sessions()


@pytest.fixture(scope="module")
def split(spark, frame):
    return splits.Split("within_session", splits.split_within(spark.createDataFrame(frame), 0.5, 5), 4, 5, bin_width_us=2_000_000)


@pytest.fixture(scope="module")
def signal(spark, frame):
    rows = planted.regression_rows(frame, 2.0)
    return rows, spark.createDataFrame(rows)


def solve(x, y, lam):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc / len(y) + lam * np.eye(x.shape[1]), xc.T @ yc / len(y))
    return y.mean() - x.mean(axis=0) @ coef, coef


def test_ridge_matches_numpy(split, signal):
    rows, df = signal
    train = rows[rows.bin < 30]
    for xs in (["x1"], ["x1", "x2"]):
        model = baselines.fit_ridge(split, df, xs, "y", LAM)
        icpt, coef = solve(train[xs].to_numpy(), train.y.to_numpy(), LAM)
        assert np.isclose(model.intercept, icpt) and np.allclose(model.coef, coef)


def test_per_session_ridge_matches_numpy(split, signal):
    rows, df = signal
    for xs in (["x1"], ["x1", "x2"]):
        fits = baselines.fit_per_session(split, df, xs, "y", LAM).collect()
        assert len(fits) == 12
        for fit in fits:
            own = rows[(rows.eid == fit["eid"]) & (rows.bin < 30)]
            icpt, coef = solve(own[xs].to_numpy(), own.y.to_numpy(), LAM)
            assert np.isclose(fit["intercept"], icpt) and np.allclose(fit["coef"], coef)


def test_constant_feature_has_no_coefficient_at_all(split, signal):
    _, df = signal
    rows = df.withColumn("x2", F.lit(0.1))
    again = rows.repartition(7, "bin")
    for fit in baselines.fit_per_session(split, rows, ["x1", "x2"], "y", LAM).collect():
        assert fit["coef"][1] == 0.0  # not 1e-17 of either sign, which would turn the angle
    one = {r["eid"]: (r["intercept"], r["coef"]) for r in baselines.fit_per_session(split, df, ["x1", "x2"], "y", LAM).collect()}
    for r in baselines.fit_per_session(split, df.repartition(7, "bin"), ["x1", "x2"], "y", LAM).collect():
        assert one[r["eid"]] == (r["intercept"], r["coef"])
    wide = baselines.fit_per_session(split, again.withColumn("x3", F.col("x1") * F.col("x1")), ["x1", "x2", "x3"], "y", LAM)
    assert all(abs(r["coef"][1]) < 1e-12 for r in wide.collect())


def test_reduced_rank_matches_numpy(split, signal):
    rows, df = signal
    xs = ["x1", "x2"]
    train = {e: r for e, r in rows[rows.bin < 30].groupby("eid")}
    stack = np.array([np.sqrt(len(r)) * solve(r[xs].to_numpy(), r.y.to_numpy(), LAM)[1]
                      for r in train.values()])
    basis = np.linalg.svd(stack)[2][0]
    for fit in baselines.fit_rrr(split, df, xs, "y", 1, LAM).collect():
        own = train[fit["eid"]]
        icpt, gain = solve((own[xs].to_numpy() @ basis)[:, None], own.y.to_numpy(), LAM)
        assert np.allclose(fit["coef"], gain[0] * basis) and np.isclose(fit["intercept"], icpt)


def test_full_rank_equals_per_session_ridge(split, signal):
    _, df = signal
    a = {r["eid"]: r["coef"] for r in baselines.fit_rrr(split, df, ["x1", "x2"], "y", 2, LAM).collect()}
    for r in baselines.fit_per_session(split, df, ["x1", "x2"], "y", LAM).collect():
        assert np.allclose(a[r["eid"]], r["coef"])


def test_logistic_and_poisson_recover_the_direction(spark, split, signal):
    _, df = signal
    rows = df.withColumn("y", (F.col("y") > 0).cast("int"))
    assert baselines.fit_logistic(split, rows, ["x1", "x2"], "y").coefficients[0] > 1
    counts = df.withColumn("y", F.floor(F.exp(0.5 + 0.7 * F.col("x1"))).cast("double"))
    assert 0.5 < baselines.fit_poisson(split, counts, ["x1"], "y").coefficients[0] < 1.1


def test_squared_error_from_gram(signal):
    rows, df = signal
    g = baselines.gram(df, ["eid"], ["x1", "x2"], "y")
    sse = baselines.squared_error(2, F.lit(0.3), [F.lit(1.5), F.lit(-0.2)])
    got = {r["eid"]: r["s"] for r in g.select("eid", sse.alias("s")).collect()}
    for eid, own in rows.groupby("eid"):
        want = ((own.y - 0.3 - 1.5 * own.x1 + 0.2 * own.x2) ** 2).sum()
        assert np.isclose(got[eid], want)


def test_leave_one_out_by_subtraction(spark, frame, signal):
    rows, df = signal
    owner = spark.createDataFrame(frame).select("eid", "subject", "lab")
    g = baselines.gram(df, ["eid"], ["x1"], "y").join(owner, "eid")
    for kind, group in splits.GROUP_OF.items():
        got = {r["eid"]: r["value"] for r in protocols.held_out_scores(g, g, kind, 1, LAM).collect()}
        owned = rows.merge(frame, on="eid")
        for eid, test in owned.groupby("eid"):
            rest = owned[owned[group] != test[group].iloc[0]]
            if kind == "held_out_session":
                rest = rest[rest.subject == test.subject.iloc[0]]
            icpt, coef = solve(rest[["x1"]].to_numpy(), rest.y.to_numpy(), LAM)
            want = np.sqrt(((test.y - icpt - coef[0] * test.x1) ** 2).mean())
            assert np.isclose(got[eid], want)


def run_contract(spark, frame, split, df):
    test = split.rows(df, "test")
    err = F.col("y") - F.col("yhat")

    def rmse(rows, keys=("eid",)):
        return rows.groupBy(*keys).agg(F.sqrt(F.avg(err * err)).alias("value"))
    ridge = baselines.fit_ridge(split, df, ["x1"], "y", LAM).predict(test)
    shuffled = rmse(nulls.null_shuffle(ridge, 10, "t"), ("eid", "rep"))
    phase = df.withColumn("phase", F.col("bin") % 6)
    structure = nulls.null_trialstruct(split.rows(phase, "train"), split.rows(phase, "test"), ["phase"])
    own = baselines.fit_per_session(split, df, ["x1"], "y", LAM)
    return contract.Contract("rmse", {
        "ceiling_within": rmse(baselines.predict_per_key(test, own, ["x1"])),
        "null_shuffle": shuffled.groupBy("eid").agg(F.avg("value").alias("value")),
        "null_trialstruct": rmse(structure), "baseline_ridge": rmse(ridge),
        "baseline_multisession": rmse(ridge), "model": rmse(ridge)}, higher_is_better=False)


def test_planted_signal_passes_the_gate(spark, frame, split, signal):
    c = run_contract(spark, frame, split, signal[1])
    table = {r["row_kind"]: r["mean"] for r in c.table().collect()}
    assert table["baseline_ridge"] < 1.3 < table["null_shuffle"] and table["null_trialstruct"] > 1.8
    assert c.gate(0.5).head()["passed"]


def test_no_signal_fails_the_gate(spark, frame, split):
    df = spark.createDataFrame(planted.regression_rows(frame, 0.0))
    assert not run_contract(spark, frame, split, df).gate(0.2).head()["passed"]


def test_trial_structure_alone_is_not_beaten(spark, frame, split):
    rows = planted.regression_rows(frame, 0.0, 0.2)
    rows["y"] += (rows.bin % 6) * 1.0
    table = {r["row_kind"]: r["mean"] for r in
             run_contract(spark, frame, split, spark.createDataFrame(rows)).table().collect()}
    assert table["null_trialstruct"] < 0.5 < table["baseline_ridge"]


def test_contract_needs_all_six_rows(spark):
    one = spark.createDataFrame([("a", 1.0)], "eid string, value double")
    with pytest.raises(ValueError, match="missing"):
        contract.Contract("rmse", {"model": one}, False)


def test_interleaved_split_inflates_autocorrelated_scores(spark, frame):
    """Nearest-train-bin prediction looks good only if test bins lie between train bins."""
    rows = planted.slow_walk(frame)
    one = rows[rows.eid == "s0_0_0"]
    inside = one[one.bin % 3 == 0]
    between = np.interp(inside.bin, one[one.bin % 3 != 0].bin, one[one.bin % 3 != 0].y)
    late = one[one.bin >= 35]
    leaky = spark.createDataFrame([("a", float(np.sqrt(((inside.y - between) ** 2).mean())))], "eid string, value double")
    honest = spark.createDataFrame([("a", float(np.sqrt(((late.y - one[one.bin < 30].y.iloc[-1]) ** 2).mean())))],
                                   "eid string, value double")
    assert contract.inflation(leaky, honest, False).head()["inflation"] > 0


def test_shuffle_is_a_rotation_by_at_least_one(spark):
    rows = spark.createDataFrame([("a", i, 9, float(i), 0.0) for i in range(9)],
                                 "eid string, pos bigint, n_pos bigint, y double, yhat double")
    got = nulls.null_shuffle(rows, 30, "q").toPandas()
    seen = set()
    for _, rep in got.groupby("rep"):
        shifts = set((rep.pos - rep.y.astype(int)) % 9)
        assert len(shifts) == 1 and 0 not in shifts and len(rep) == 9
        seen |= shifts
    assert len(seen) > 3


@pytest.mark.parametrize("chunk", [1, 4, 7, 100])
def test_packed_rotation_equals_one_row_per_repetition(spark, chunk):
    """Gaps, wrapping, sessions of one and two positions, null targets, wide predictions."""
    places = {"a": (23, [p for p in range(23) if p % 5]), "b": (2, [0, 1]), "c": (1, [0]), "d": (9, [8])}
    rows = spark.createDataFrame(
        [(e, p, n, None if p == 3 else float(p), [float(p), 1.0]) for e, (n, at) in places.items() for p in at],
        "eid string, pos bigint, n_pos bigint, y double, yhat array<double>")
    got = nulls.null_shuffle(rows, 30, "q", chunk).select("eid", "rep", "pos", "y", "yhat")
    turn = 1 + hash_bucket(1 << 31, "eid", "rep", F.lit("q")) % (F.col("n_pos") - 1)
    moved = rows.where("n_pos > 1").select("eid", "pos", "n_pos", "y", F.explode(
        F.sequence(F.lit(0), F.lit(29))).alias("rep")).select(
        "eid", F.col("rep").cast("bigint").alias("rep"), "y", F.pmod(F.col("pos") + turn, F.col("n_pos")).alias("pos"))
    want = moved.join(rows.select("eid", "pos", "yhat"), ["eid", "pos"]).select("eid", "rep", "pos", "y", "yhat")
    assert got.count() > 300 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_every_repetition_keeps_all_targets(spark):
    """Five hundred repetitions of a session of four chunks."""
    rows = spark.range(400).select(F.lit("a").alias("eid"), F.col("id").alias("pos"), F.lit(400).cast("bigint").alias("n_pos"),
                                   F.col("id").cast("double").alias("y"), F.lit(0.0).alias("yhat"))
    shuffled = nulls.null_shuffle(rows, 500, "q", 100)
    assert shuffled.count() == 500 * 400
    assert shuffled.groupBy("rep").agg(F.sum("y").alias("s")).where("s <> 79800").isEmpty()


def test_p_value_counts_nulls_at_least_as_good(spark):
    model = spark.createDataFrame([("a", 0.8)], "eid string, score double")
    null = spark.createDataFrame([("a", s) for s in (0.1, 0.8, 0.9, 0.2)], "eid string, score double")
    row = nulls.null_p_value(model, null).head()
    assert np.isclose(row["p_value"], 3 / 5) and np.isclose(row["margin"], 0.3)


# --- metrics ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a" if planted.draw(i, "g") < 0.7 else "b", int(planted.draw(i, "y") < 0.3),
             round(planted.draw(i, "p"), 2)) for i in range(400)]
    rows.append(("one_class", 1, 0.4))
    frame = pd.DataFrame(rows, columns=["eid", "y", "p"])
    frame["yhat"] = (frame.p >= 0.5).astype(int)
    return frame, spark.createDataFrame(frame)


def test_auroc_is_the_share_of_ordered_pairs(scored):
    frame, df = scored
    got = {r["eid"]: r["auroc"] for r in metrics.auroc(df).collect()}
    assert got["one_class"] is None
    for eid in ("a", "b"):
        own = frame[frame.eid == eid]
        pos, neg = own[own.y == 1].p.to_numpy(), own[own.y == 0].p.to_numpy()
        diff = pos[:, None] - neg[None]
        assert np.isclose(got[eid], ((diff > 0) + 0.5 * (diff == 0)).mean())


def test_accuracy_f1_and_calibration(scored):
    frame, df = scored
    acc = {r["eid"]: r for r in metrics.accuracy(df).collect()}
    f1 = {r["eid"]: r for r in metrics.f1(df).collect()}
    cal = {r["eid"]: r for r in metrics.calibration_error(df).collect()}
    for eid in ("a", "b"):
        own = frame[frame.eid == eid]
        hit = own.y == own.yhat
        assert np.isclose(acc[eid]["accuracy"], hit.mean())
        assert np.isclose(acc[eid]["balanced_accuracy"], np.mean([hit[own.y == c].mean() for c in (0, 1)]))
        per = [2 * ((own.y == c) & (own.yhat == c)).sum() / ((own.y == c).sum() + (own.yhat == c).sum())
               for c in (0, 1)]
        assert np.isclose(f1[eid]["f1"], per[1]) and np.isclose(f1[eid]["macro_f1"], np.mean(per))
        bins = np.minimum(np.floor(own.p * 10), 9)
        gaps = [(abs(own.p[bins == b].mean() - own.y[bins == b].mean()), (bins == b).sum())
                for b in np.unique(bins)]
        assert np.isclose(cal[eid]["ece"], sum(g * n for g, n in gaps) / len(own))
        assert np.isclose(cal[eid]["mce"], max(g for g, _ in gaps))


def test_constant_target_has_no_r2(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("a", 1.0, 1.5)], "eid string, y double, yhat double")
    row = metrics.regression(rows).head()
    assert row["r2"] is None and row["mae"] == 0.5 and row["rmse"] == 0.5


def test_unit_slots_lose_no_unit_and_follow_the_order(spark):
    """Five units in three slots and a rest; masked units count for nothing, empty slots are flagged."""
    units = spark.createDataFrame(
        [(1, u, u != "m") for u in "abcdem"] + [(2, "z", True)], "eid bigint, unit_id string, mask boolean")
    bins = spark.createDataFrame(
        [(1, "a", 0, 1), (1, "c", 0, 3), (1, "d", 0, 4), (1, "e", 0, 5), (1, "m", 0, 90), (2, "z", 1, 7)],
        "eid bigint, unit_id string, bin bigint, n bigint")
    spans = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "eid bigint, start_bin bigint, end_bin bigint")
    got = {(r["eid"], r["bin"]): list(r["x"]) for r in baselines.slot_units(bins, units, spans, 3).collect()}
    assert got == {(1, 0): [1, 0, 3, 9, 1, 1, 1], (1, 1): [0, 0, 0, 0, 1, 1, 1],
                   (2, 0): [0, 0, 0, 0, 1, 0, 0], (2, 1): [7, 0, 0, 0, 1, 0, 0]}
    turned = baselines.slot_units(bins, units, spans, 3, F.col("unit_id").desc()).collect()
    assert {(r["eid"], r["bin"]): list(r["x"]) for r in turned}[1, 0] == [5, 4, 3, 1, 1, 1, 1]
