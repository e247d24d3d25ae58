"""Every split kind validates; every guard fires on a split that is leaky on purpose."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import planted
from truegauge.operators import guards, splits
from truegauge.operators.guards import SplitViolation
from truegauge.operators.splits import Split

COLUMNS = ("split_id string, kind string, part string, eid string, subject string, lab string, "
           "start_bin bigint, end_bin bigint")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(planted.sessions())


def blocks(spark, *rows, kind="within_session"):
    return spark.createDataFrame([("x", kind, *r) for r in rows], COLUMNS)


def test_all_six_kinds_validate(spark, table):
    Split("within_session", splits.split_within(table, 0.5, 5), 4, 5, bin_width_us=2_000_000)
    Split("held_out_session", splits.split_session(table, "s0_0_0"), 1)
    Split("held_out_animal", splits.split_animal(table, "m0_1"), 1)
    Split("held_out_lab", splits.split_lab(table, "lab1"), 1)
    units = table.select("eid", F.explode(F.array(F.lit("A"), F.when(
        F.col("lab") == "lab1", "B").otherwise("A"))).alias("region"), F.lit(True).alias("passed"))
    Split("held_out_region", splits.split_region(table, units, "B"), 1)
    config = table.withColumn("config", F.when(F.col("subject") == "m1_2", "odd").otherwise("std"))
    Split("held_out_config", splits.split_config(config, "config"), 1)


def test_region_rule_is_asymmetric(spark):
    rows = []
    for eid, inside, outside in (("zero", 0, 10), ("ten", 1, 9), ("twenty", 2, 8), ("half", 5, 5)):
        rows += [(eid, "R", True)] * inside + [(eid, "S", True)] * outside
    rows += [("failed", "R", False)] + [("failed", "S", True)] * 9
    got = splits.region_part(spark.createDataFrame(rows, "eid string, region string, passed boolean"), "R")
    parts = {r["eid"]: r["part"] for r in got.collect()}
    assert parts == {"zero": "train", "ten": "dropped", "twenty": "test", "half": "test",
                     "failed": "dropped"}


def test_no_temporal_leakage(spark):
    bad = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 8, 20))
    with pytest.raises(SplitViolation, match="shared_bins"):
        Split("within_session", bad, 1, bin_width_us=2_000_000)
    # The context of a test window reaches back into the train block.
    close = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 12, 20))
    with pytest.raises(SplitViolation, match="shared_bins"):
        Split("within_session", close, 5, bin_width_us=2_000_000)


def test_short_gap(spark):
    close = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 13, 20))
    Split("within_session", close, 2, 3, bin_width_us=2_000_000)
    with pytest.raises(SplitViolation, match="short_gap"):
        Split("within_session", close, 2, 4, bin_width_us=2_000_000)


def test_gap_lasts_two_seconds_even_with_a_short_context(spark):
    rows = (("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 60, 99))
    Split("within_session", blocks(spark, *rows), 5, bin_width_us=50_000)
    with pytest.raises(SplitViolation, match="short_gap"):
        Split("within_session", blocks(spark, *rows), 5, bin_width_us=20_000)


def test_test_block_before_train_is_checked_too(spark):
    close = blocks(spark, ("test", "a", "m", "l", 0, 9), ("train", "a", "m", "l", 10, 20))
    with pytest.raises(SplitViolation, match="short_gap"):
        Split("within_session", close, 1, 2, bin_width_us=2_000_000)


def test_no_subject_leakage(spark):
    bad = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "b", "m", "l", 0, 9))
    with pytest.raises(SplitViolation, match="shared_subject"):
        Split("held_out_animal", bad, 1)
    Split("held_out_session", bad, 1)


def test_shared_session(spark):
    bad = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 30, 39))
    with pytest.raises(SplitViolation, match="shared_session"):
        Split("held_out_session", bad, 1)


def test_calibration_is_disjoint_at_animal_level(spark):
    rows = (("train", "a", "m1", "l", 0, 9), ("calib", "b", "m2", "l", 0, 9),
            ("test", "c", "m2", "l", 0, 9))
    Split("held_out_session", blocks(spark, *rows), 1)
    with pytest.raises(SplitViolation, match="calib_subject"):
        Split("three_way", blocks(spark, *rows), 1)


def test_straddling_trial(spark):
    good = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 20, 29))
    trials = spark.createDataFrame([("x", "a", 1, "train"), ("x", "a", 1, "test")],
                                   "split_id string, eid string, trial_id int, part string")
    with pytest.raises(SplitViolation, match="straddling_trial"):
        Split("within_session", good, 1, trials=trials, bin_width_us=2_000_000)


def test_empty_part(spark):
    only = blocks(spark, ("train", "a", "m", "l", 0, 9))
    with pytest.raises(SplitViolation, match="empty_part"):
        Split("within_session", only, 1, bin_width_us=2_000_000)
    with pytest.raises(SplitViolation, match="no blocks"):
        Split("within_session", only.where("false"), 1, bin_width_us=2_000_000)


def test_versions(spark):
    good = blocks(spark, ("train", "a", "m", "l", 0, 9), ("test", "a", "m", "l", 20, 29))
    with pytest.raises(SplitViolation, match="another version"):
        Split("within_session", good, 1, manifest_version="1", current_manifest_version="2", bin_width_us=2_000_000)
    with pytest.raises(SplitViolation, match="another version"):
        Split("within_session", good, 1, preproc_version="0", bin_width_us=2_000_000)


def test_interleaved(spark):
    rows = [(p, "a", "m", "l", 20 * i, 20 * i + 9) for i, p in enumerate(["train", "test", "train"])]
    with pytest.raises(SplitViolation, match="interleaved"):
        Split("within_session", blocks(spark, *rows), 1, bin_width_us=2_000_000)


def test_shuffled_trials_fail_the_gap_guard(spark):
    trials = pd.DataFrame([("a", "m", "l", i, i * 100, (i + 1) * 100) for i in range(40)],
                          columns=["eid", "subject", "lab", "trial_id", "start_us", "end_us"])
    leaky = splits.trial_blocks(splits.split_interleaved(spark.createDataFrame(trials), "z"), 50)
    assert leaky.groupBy("part").count().count() == 3
    with pytest.raises(SplitViolation):
        Split("within_session", leaky, 4, bin_width_us=2_000_000)


def test_hash_ignores_order_but_not_content(spark, table):
    a = splits.split_within(table, 0.5, 5)
    one = splits.split_hash(a, "1").head()["hash"]
    assert splits.split_hash(a.repartition(7), "1").head()["hash"] == one
    assert splits.split_hash(a, "2").head()["hash"] != one
    moved = a.withColumn("end_bin", F.col("end_bin") + F.when(F.col("eid") == "s0_0_0", 1).otherwise(0))
    assert splits.split_hash(moved, "1").head()["hash"] != one


def test_leave_one_out_sizes(table):
    rows = splits.all_splits(table, "held_out_animal").collect()
    assert len(rows) == 12 and {(r["n_test"], r["n_train"]) for r in rows} == {(2, 10)}
    rows = splits.all_splits(table, "held_out_session").collect()
    assert {(r["n_test"], r["n_train"]) for r in rows} == {(1, 1)}


def test_sweep_of_many_blocks_across_chunks(spark):
    """Blocks far apart still see the latest end of the other side."""
    rows = [("train", "a", "m", "l", 0, 200_000), ("test", "a", "m", "l", 150_000, 150_010)]
    swept = guards.sweep(blocks(spark, *rows))
    assert guards.shared_bins(swept, 1).count() == 1


def test_unknown_kind_and_missing_width_are_refused(spark):
    sides = blocks(spark, ("train", "a", "m1", "l", 0, 9), ("test", "a", "m1", "l", 10_000, 10_009))
    with pytest.raises(SplitViolation, match="unknown kind"):
        Split("held_out_animals", sides, 1)
    with pytest.raises(SplitViolation, match="bin_width_us"):
        Split("within_session", sides, 1)
