"""Binning, quality control, normalization, windows and targets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import planted
from truegauge.operators import baselines, binning, integrity, qc, splits, targets

W_US = 20_000


@pytest.fixture(scope="module")
def spikes(spark):
    rows = [("a", f"u{i % 3}", int(planted.draw(i) * 2_000_000)) for i in range(900)]
    # On the borders, and several at one instant.
    rows += [("a", "u0", t) for t in (0, W_US - 1, W_US, 2 * W_US, 2 * W_US)]
    return spark.createDataFrame(rows, "eid string, unit_id string, t_us bigint")


@pytest.fixture(scope="module")
def session(spark):
    return spark.createDataFrame([("a", "m", "l", 100)], "eid string, subject string, lab string, n_bins bigint")


@pytest.fixture(scope="module")
def split(session):
    return splits.Split("within_session", splits.split_within(session, 0.5, 10), 5, 10, bin_width_us=2_000_000)


def test_border_spikes_open_the_next_bin(spark):
    rows = spark.createDataFrame([("a", "u", t) for t in (-1, 0, 19_999, 20_000)],
                                 "eid string, unit_id string, t_us bigint")
    got = {r["bin"]: r["n"] for r in binning.bin_spikes(rows, W_US).collect()}
    assert got == {-1: 1, 0: 2, 1: 1}


def test_binning_determinism_and_round_trip(spikes):
    one = binning.bin_spikes(spikes, W_US)
    two = binning.bin_spikes(spikes.repartition(9, "t_us"), W_US)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert integrity.binning_roundtrip(spikes, one).isEmpty()


def test_multi_width_equals_single_width(spikes):
    many = binning.bin_multi(spikes, [10_000, 20_000, 50_000])
    for width in (10_000, 20_000, 50_000):
        single = binning.bin_spikes(spikes, width)
        part = many.where(F.col("width_us") == width).drop("width_us")
        assert part.exceptAll(single).isEmpty() and single.exceptAll(part).isEmpty()


def test_dense_grid_has_empty_bins_and_silent_units(spark, spikes, session):
    units = spark.createDataFrame([("a", u) for u in ("u0", "u1", "u2", "silent")],
                                  "eid string, unit_id string")
    wide = session.withColumn("n_bins", F.lit(700).cast("bigint"))
    bins = binning.bin_spikes(spikes, W_US)
    dense = binning.densify(bins, units, binning.whole_spans(wide))
    assert dense.count() == 4 * 700
    assert dense.agg(F.sum("n")).head()[0] == spikes.count()
    assert dense.where("unit_id = 'silent'").agg(F.sum("n")).head()[0] == 0


def test_normalization_fit_on_train_only(spark, spikes, split):
    units = spikes.select("eid", "unit_id").distinct()
    bins = binning.bin_spikes(spikes, W_US)
    mutated = bins.withColumn("n", F.when(F.col("bin") >= 60, F.col("n") * 50).otherwise(F.col("n")))
    a = binning.fit_norm(bins, units, split)
    b = binning.fit_norm(mutated, units, split)
    from truegauge.operators.guards import norm_leak
    assert norm_leak(a, b).isEmpty()
    changed = bins.withColumn("n", F.when(F.col("bin") < 50, F.col("n") * 50).otherwise(F.col("n")))
    assert norm_leak(a, binning.fit_norm(changed, units, split)).count() == 3


def test_norm_equals_numpy_and_zero_variance_is_zero(spark, spikes, split):
    units = spark.createDataFrame([("a", u) for u in ("u0", "u1", "u2", "silent")],
                                  "eid string, unit_id string")
    bins = binning.bin_spikes(spikes, W_US)
    stats = binning.fit_norm(bins, units, split)
    grid = binning.normalized_grid(bins, stats, split.bin_spans("train", "test"))
    frame = grid.toPandas()
    train = frame[(frame.part == "train") & (frame.unit_id == "u1")]["n"].to_numpy()
    row = stats.where("unit_id = 'u1'").head()
    assert np.isclose(row["mean"], train.mean()) and np.isclose(row["std"], train.std())
    assert (frame[frame.unit_id == "silent"]["z"] == 0).all()
    joined = binning.apply_norm(grid.drop("z"), stats).select("eid", "unit_id", "bin", "z").toPandas()
    both = frame.merge(joined, on=["eid", "unit_id", "bin"])
    assert np.allclose(both.z_x, both.z_y)


def test_windows_never_cross_a_border(spikes, split):
    units = spikes.select("eid", "unit_id").distinct()
    dense = binning.densify(binning.bin_spikes(spikes, W_US), units, split.bin_spans("train", "test"))
    windows = binning.context_windows(dense, "n", 5, chunk_bins=8).toPandas()
    assert len(windows) == 3 * ((50 - 4) + (40 - 4))
    assert windows[windows.part == "test"].end_bin.min() == 64
    lookup = {(r["unit_id"], r["bin"]): r["n"] for r in dense.collect()}
    for row in windows.itertuples():
        assert list(row.ctx) == [lookup[row.unit_id, row.end_bin - 4 + i] for i in range(5)]


def whole(spikes):
    return spikes.groupBy("eid").agg(F.min("t_us").alias("start_us"), (F.max("t_us") + 1).alias("end_us"))


def test_refractory_share_leaves_test_time_out(spark):
    rows = [("a", "u", t) for t in (0, 10, 20, 1_000, 1_001, 1_002)]
    spikes = spark.createDataFrame(rows, "eid string, unit_id string, t_us bigint")
    train = spark.createDataFrame([("a", 0, 100)], "eid string, start_us bigint, end_us bigint")
    assert qc.rp_violation(spikes, train, 5).head()["rp_violation"] == 0.0


def test_refractory_share_against_numpy(spikes):
    got = {r["unit_id"]: (r["n_isi"], r["rp_violation"]) for r in qc.rp_violation(spikes, whole(spikes), 3_000).collect()}
    frame = spikes.toPandas()
    for unit, rows in frame.groupby("unit_id"):
        isi = np.diff(np.sort(rows.t_us.to_numpy()))
        assert got[unit][0] == len(isi) and np.isclose(got[unit][1], (isi < 3_000).mean())


def test_single_spike_has_no_refractory_share(spark):
    one = spark.createDataFrame([("a", "u", 5)], "eid string, unit_id string, t_us bigint")
    assert qc.rp_violation(one, whole(one), 2_000).head()["rp_violation"] is None


def test_firing_rate_ignores_test_time(spark, spikes, split):
    units = spikes.select("eid", "unit_id").distinct()
    spans = split.spans("train", W_US)
    a = qc.firing_rate(spikes, units, spans).orderBy("unit_id").collect()
    b = qc.firing_rate(spikes.where("t_us < 1000000"), units, spans).orderBy("unit_id").collect()
    assert a == b


def test_movement_onset_needs_quiet_before(spark):
    speeds = [0, 0, 0, 5, 5, 0, 5, 0, 0, 0, 9]
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(speeds)],
                                 "eid string, bin bigint, velocity double")
    got = [r["bin"] for r in targets.movement_onset(rows, 1.0, 3).orderBy("bin").collect()]
    assert got == [3, 10]


def test_state_epochs_end_at_holes(spark):
    rows = [(0, "x"), (1, "x"), (2, "y"), (5, "y"), (6, "x")]
    df = spark.createDataFrame([("a", b, s) for b, s in rows], "eid string, bin bigint, state string")
    got = sorted((r["start_bin"], r["end_bin"], r["state"]) for r in targets.state_epochs(df).collect())
    assert got == [(0, 1, "x"), (2, 2, "y"), (5, 5, "y"), (6, 6, "x")]


def test_trial_without_end_is_left_out(spark):
    trials = spark.createDataFrame([("a", 1, 0, 40_000), ("a", 2, 40_000, None)],
                                   "eid string, trial_id int, start_us bigint, end_us bigint")
    bins = spark.createDataFrame([("a", b) for b in range(5)], "eid string, bin bigint")
    got = targets.trial_bins(bins, trials, W_US, 2).collect()
    assert sorted((r["bin"], r["phase"]) for r in got) == [(0, 0), (1, 1)]


def pooled(spark, n_units, order, ghosts=0):
    rows = [("a", f"u{u}", b, int(planted.draw(u % 7, b) * 5)) for u in order(range(n_units)) for b in range(6)]
    rows += [("a", f"g{u}", b, 1000) for u in range(ghosts) for b in range(6)]
    units = [("a", f"u{u}", "RS"[u % 2], True) for u in range(n_units)]
    units += [("a", f"g{u}", "R", False) for u in range(ghosts)]
    return baselines.pool_units(
        spark.createDataFrame(rows, "eid string, unit_id string, bin bigint, n bigint"),
        spark.createDataFrame(units, "eid string, unit_id string, region string, mask boolean"),
        spark.createDataFrame([("a", 0, 5)], "eid string, start_bin bigint, end_bin bigint"), ["R", "S"])


def test_pooled_features_against_numpy(spark):
    counts = {(u, b): int(planted.draw(u, b) * 3) for u in range(9) for b in range(6)}
    rows = [("a", f"u{u}", b, n) for (u, b), n in counts.items() if n]
    df = spark.createDataFrame(rows, "eid string, unit_id string, bin bigint, n bigint")
    units = spark.createDataFrame([("a", f"u{u}", "RS"[u % 2]) for u in range(9)],
                                  "eid string, unit_id string, region string")
    spans = spark.createDataFrame([("a", 0, 6)], "eid string, start_bin bigint, end_bin bigint")
    pooled_rows = {r["bin"]: r for r in baselines.pool_units(df, units, spans, ["R", "S"]).collect()}
    vectors = {r["bin"]: r["vector"] for r in binning.population_vectors(df, units, spans).collect()}
    assert len(pooled_rows) == len(vectors) == 7
    for b in range(7):
        v = np.array([counts.get((u, b), 0) for u in range(9)])
        assert vectors[b] == v.tolist()
        row = pooled_rows[b]
        assert np.allclose([row["mean"], row["std"], row["max"], row["sum"], row["mean_R"], row["mean_S"]],
                           [v.mean(), v.std(), v.max(), v.sum(), v[::2].mean(), v[1::2].mean()])


def test_permutation_invariance_variable_unit_count_and_masking(spark):
    plain = pooled(spark, 200, list)
    for other in (pooled(spark, 200, reversed), pooled(spark, 200, list, ghosts=30)):
        gap = baselines.invariance_gap(plain, other).head()
        assert gap["max_gap"] < 1e-9 and gap["n_unmatched"] == 0
    large = pooled(spark, 900, list)
    assert large.columns == plain.columns and large.head()["n_units"] == 900
    assert baselines.invariance_gap(plain, large).head()["max_gap"] > 1


def test_bin_means_do_not_depend_on_the_order_of_reading(spark):
    # 0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1 in doubles; a chunk of sample numbers ends between b's samples.
    last = binning.SUM_CHUNK - 1
    rows = [("a", "s", i, 5 + i, v) for i, v in enumerate((0.1, 0.2, 0.3))]
    rows += [("b", "s", last + i, 5, v) for i, v in enumerate((0.1, 0.2, 0.3))]
    rows += [("c", "s", 0, 5, None), ("c", "s", 1, 5, 2.0), ("d", "s", 0, 5, None)]
    df = spark.createDataFrame(rows[::-1], "eid string, series string, sample_idx bigint, t_us bigint, value double")
    for parts in (1, 5):
        got = {r["eid"]: (r["value"], r["n_samples"]) for r in binning.align_mean(df.repartition(parts).orderBy(
            F.desc("sample_idx")), W_US).collect()}
        assert got["a"] == ((0.1 + 0.2 + 0.3) / 3, 3)
        assert got["b"] == ((0.1 + (0.2 + 0.3)) / 3, 3)
        assert got["c"] == (2.0, 2) and got["d"] == (None, 1)


def test_as_of_values_are_carried_without_sorting_bins(spark):
    rows = [("a", "s", 0, -5, 1.0), ("a", "s", 1, 0, 2.0), ("a", "s", 2, 0, 3.0), ("a", "s", 3, 21, 4.0), ("a", "s", 4, 25, None),
            ("a", "s", 5, 290 * 10, 5.0), ("a", "s", 6, 290 * 10 + 1, 6.0), ("a", "s", 7, 512 * 10, 7.0), ("a", "s", 8, 9_000, 8.0),
            ("b", "s", 0, 15, 9.0), ("b", "s", 1, 100, 1.0), ("c", "s", 0, 5, None), ("d", "s", 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "eid string, series string, sample_idx bigint, t_us bigint, value double")
    sizes = {"a": 600, "b": 5, "c": 2, "d": 0}
    spans = spark.createDataFrame(list(sizes.items()), "eid string, n_bins bigint")
    made = binning.align_as_of(df, spans, 10)
    got = {(r["eid"], r["bin"]): r["value"] for r in made.collect()}
    wanted = {}
    for eid, n in sizes.items():
        for b in range(n):
            known = {}
            for _, _, i, t, v in sorted(r for r in rows if r[0] == eid):
                if t <= b * 10:
                    known[t] = v
            past = [known[t] for t in sorted(known) if known[t] is not None]
            wanted[eid, b] = past[-1] if past else None
    assert got == wanted
    # What is sorted and carried is a row per series and chunk of bins.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(_run") < plan.index("Window")


def test_bin_means_are_added_in_sample_order_whatever_the_sample_numbers(spark):
    # 0.1 + 0.2 + 0.3 is not 0.1 + (0.2 + 0.3): a border between two samples of a bin would show.
    rows = [(f"{gap}", "s", 100_000 * (gap + 8 * i), 5, v) for gap in range(8) for i, v in enumerate((0.1, 0.2, 0.3))]
    rows += [("a", "s", (1 << 20) - 1 + i, 5, v) for i, v in enumerate((0.1, 0.2, 0.3))]
    df = spark.createDataFrame(rows[::-1], "eid string, series string, sample_idx bigint, t_us bigint, value double")
    got = [r["value"] for r in binning.align_mean(df, W_US).collect()]
    assert got == [(0.1 + 0.2 + 0.3) / 3] * 9
