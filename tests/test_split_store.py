"""Split files and cache runs: round trips, tampering, versions, two writers."""

import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests import planted
from truegauge.operators import splits
from truegauge.operators.guards import SplitViolation
from truegauge.operators.splits import Split
from truegauge.sources import cache, inventory, runs, split_store


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(planted.sessions())


@pytest.fixture(scope="module")
def counts(spark, table):
    units = table.select("eid", F.explode(F.array(F.lit("u1"), F.lit("u2"))).alias("unit_id"))
    bins = units.select("eid", "unit_id", F.explode(F.sequence(F.lit(0), F.lit(59), F.lit(3))).alias("bin"))
    return units, bins.selectExpr("eid", "unit_id", "bigint(bin) AS bin", "bigint(bin % 7) AS n")


def within(table):
    return Split("within_session", splits.split_within(table, 0.5, 5), 4, 5, bin_width_us=2_000_000)


def test_round_trip_and_address(spark, table, tmp_path):
    root = str(tmp_path)
    name = split_store.save_split(within(table), root, table)
    assert split_store.save_split(within(table.repartition(3)), root, table.orderBy("eid")) == name
    back = split_store.load_split(spark, root, name, table)
    assert sorted(back.blocks.collect()) == sorted(within(table).blocks.select(*back.blocks.columns).collect())
    assert (back.kind, back.context_bins, back.min_gap_bins, back.bin_width_us) == ("within_session", 4, 5, 2_000_000)
    other = Split("within_session", splits.split_within(table, 0.6, 5), 4, 5, bin_width_us=2_000_000)
    assert split_store.save_split(other, root, table) != name
    assert split_store.recorded_versions(spark, root).count() == 1


@pytest.mark.parametrize("part", ["blocks", "header"])
def test_a_changed_byte_raises(spark, table, tmp_path, part):
    name = split_store.save_split(within(table), str(tmp_path), table)
    for file in (Path(tmp_path) / name / part).rglob("part-*"):
        file.write_text(file.read_text().replace("29", "28") if part == "blocks" else
                        file.read_text().replace('"context_bins":4', '"context_bins":3'))
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(SplitViolation, match="changed"):
        split_store.load_split(spark, str(tmp_path), name, table)


def test_versions_come_from_the_file(spark, table, tmp_path, monkeypatch):
    name = split_store.save_split(within(table), str(tmp_path), table)
    with pytest.raises(SplitViolation, match="made for manifest"):
        split_store.load_split(spark, str(tmp_path), name, table.where("eid <> 's0_0_0'"))
    monkeypatch.setattr(split_store, "PREPROC_VERSION", "2")
    with pytest.raises(SplitViolation, match="made for manifest"):
        split_store.load_split(spark, str(tmp_path), name, table)
    with pytest.raises(SplitViolation, match="no split file"):
        split_store.load_split(spark, str(tmp_path), "0" * 64, table)


def test_statistics_travel_with_the_split(spark, table, counts, tmp_path):
    units, bins = counts
    name = split_store.save_split(within(table), str(tmp_path), table)
    split = split_store.load_split(spark, str(tmp_path), name, table)
    assert split.norm() is None
    stats = split.fit_norm(bins, units)
    # Later data change nothing: the stored statistics count, and they were fit on train bins.
    changed = bins.withColumn("n", F.when(F.col("bin") > 40, F.col("n") + 100).otherwise(F.col("n")))
    assert sorted(split.fit_norm(changed, units).collect()) == sorted(stats.collect())
    assert split.normalized(bins, stats).count() == bins.count()
    with pytest.raises(SplitViolation, match="used under split"):
        split.normalized(bins, stats.withColumn("split_hash", F.lit("other")))
    for file in (Path(tmp_path) / name / "norm" / "stats").rglob("part-*"):
        spark.read.parquet(str(file)).withColumn("mean", F.col("mean") + 1).coalesce(1).write.parquet(
            str(tmp_path / "more" / file.name))
        fresh = next((tmp_path / "more" / file.name).glob("part-*"))
        file.write_bytes(fresh.read_bytes())
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(SplitViolation, match="statistics"):
        split_store.load_split(spark, str(tmp_path), name, table).norm()


def test_blocks_of_another_kind_are_not_stored(spark, table, tmp_path):
    blocks = splits.split_animal(table, "m0_1").withColumn("kind", F.lit("held_out_lab"))
    with pytest.raises(SplitViolation, match="kind"):
        split_store.save_split(Split("held_out_animal", blocks, 1), str(tmp_path), table)


def test_trial_targets_need_trials(spark, table, tmp_path):
    blocks = splits.split_within(table, 0.5, 5)
    with pytest.raises(SplitViolation, match="needs its trials"):
        Split("within_session", blocks, 4, 5, bin_width_us=2_000_000, target="trial")
    with pytest.raises(ValueError, match="not made for trial targets"):
        within(table).trial_rows(table, "train", width_us=1)
    trials = table.select("eid", F.explode(F.array(F.lit(0), F.lit(29), F.lit(40))).alias("b")).select(
        "eid", F.col("b").alias("trial_id"), (F.col("b") * 2_000_000).cast("bigint").alias("start_us"),
        ((F.col("b") + 2) * 2_000_000).cast("bigint").alias("end_us"))
    assigned = splits.assign_trials(trials, blocks, 2_000_000).withColumn("split_id", F.lit("w"))
    split = Split("within_session", blocks, 4, 5, bin_width_us=2_000_000, target="trial", trials=assigned)
    name = split_store.save_split(split, str(tmp_path), table)
    back = split_store.load_split(spark, str(tmp_path), name, table)
    got = back.trial_rows(trials, "train", "test", width_us=2_000_000)
    assert {(r["trial_id"], r["part"]) for r in got.collect()} == {(0, "train"), (40, "test")}


def test_two_writers_of_one_key_give_each_row_once(spark, table, tmp_path):
    root, wanted = str(tmp_path), table.select("eid")
    compute = lambda missing: missing.withColumn("v", F.lit(1))

    def late(missing):
        """Another run stores the same keys while this one computes."""
        cache.cached(wanted, compute, root, {"w": 1})
        return compute(missing)
    got = cache.cached(wanted, late, root, {"w": 1})
    assert sorted(r["eid"] for r in got.collect()) == sorted(r["eid"] for r in wanted.collect())
    assert spark.read.parquet(f"{root}/index").count() == 2 * wanted.count()


def test_a_hit_reads_its_bucket_only(spark, table, tmp_path):
    root, compute = str(tmp_path), lambda missing: missing.withColumn("v", F.lit(1))
    cache.cached(table.select("eid"), compute, root, {"w": 1})
    one = cache.cached(table.select("eid").where("eid = 's0_0_0'"), compute, root, {"w": 1})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*session_bucket#\d+ (=|IN)", plan)
    assert one.count() == 1


def test_only_a_missing_path_counts_as_empty(spark, tmp_path):
    assert runs.existing(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        runs.existing(spark, str(tmp_path / "bad")).count()


def test_large_files_are_hashed_in_a_stream(spark, tmp_path):
    """Beyond 2 GB, which no row of one file could hold; a sparse file takes no disk."""
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "small file.txt").write_bytes(b"x")
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((1 << 31) + 10)
    want = hashlib.sha256()
    for _ in range(1 << 9):
        want.update(bytes(1 << 22))
    want.update(bytes(10))
    got = {Path(r["file"]).name: (r["n_bytes"], r["checksum"]) for r in
           inventory.landed_checksums(spark, str(tmp_path)).collect()}
    assert got == {"small file.txt": (1, hashlib.sha256(b"x").hexdigest()),
                   "large.bin": ((1 << 31) + 10, want.hexdigest())}
