"""Guards return violation tables, empty when the split is sound.

``assert_split_valid`` unions them, runs one action and raises. It never warns.
All violations share the columns guard, split_id, subject_of, detail.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.timing import bin_of
from truegauge.operators.ordered import running

if TYPE_CHECKING:
    from truegauge.operators.splits import Split

SIDES = ("train", "test")
CHUNK_BINS = 65536
# Fixed rule: behaviour stays correlated longer than the context of a window.
MIN_GAP_US = 2_000_000


class SplitViolation(AssertionError):
    """A split that must not be used, with the first violations found."""


def _violation(guard: str, where: Column, detail: Column) -> list[Column]:
    return [F.lit(guard).alias("guard"), F.col("split_id"),
            where.cast("string").alias("subject_of"), detail.cast("string").alias("detail")]


def sweep(blocks: DataFrame) -> DataFrame:
    """Train/test blocks in order of start, each with ``free_bins`` and ``prev_part``.

    ``free_bins`` counts the bins since the latest end of the other side before it. A
    running maximum finds it: no pair of blocks is formed, so a session with
    thousands of blocks stays linear. Overlapping pairs show at their later block.
    """
    order = ["start_bin", "end_bin", "part"]
    sides = blocks.where(F.col("part").isin(*SIDES)).groupBy("split_id", "eid", *order).agg(
        F.lit(True).alias("_seen"))
    carry = {f"_last_{p}": ("max", F.when(F.col("part") == p, F.col("end_bin"))) for p in SIDES}
    carry["prev_part"] = ("last", F.col("part"))
    swept = running(sides, ["split_id", "eid"], order, bin_of("start_bin", CHUNK_BINS), carry,
                    inclusive=False)
    other = F.when(F.col("part") == "train", F.col("_last_test")).otherwise(F.col("_last_train"))
    return swept.withColumn("free_bins", F.col("start_bin") - other - 1)


def required_gap(context_bins: int, bin_width_us: int | None) -> int:
    """max(context, 2 s) in bins; without a bin width only the context is known."""
    floor = -(-MIN_GAP_US // bin_width_us) if bin_width_us else 0
    return max(context_bins, floor)


def shared_bins(swept: DataFrame, context_bins: int) -> DataFrame:
    """G1: a train and a test window touch the same bin; windows look back context - 1 bins."""
    hit = swept.where(F.col("free_bins") < max(context_bins - 1, 0))
    return hit.select(*_violation("shared_bins", F.col("eid"),
                                  F.concat_ws(":", "part", "start_bin", "end_bin")))


def short_gap(swept: DataFrame, min_gap_bins: int) -> DataFrame:
    """G2: fewer than ``min_gap_bins`` bins between a train and a test block."""
    hit = swept.where(F.col("free_bins") < min_gap_bins)
    return hit.select(*_violation("short_gap", F.col("eid"),
                                  F.concat_ws(":", "part", "start_bin", "end_bin", "free_bins")))


def _in_several_parts(blocks: DataFrame, guard: str, unit: str, parts: Sequence[str]) -> DataFrame:
    flags = [F.max((F.col("part") == p).cast("int")) for p in parts]
    seen = reduce(lambda a, b: a + b, flags)
    return (blocks.where(F.col("part").isin(*parts)).groupBy("split_id", unit)
            .agg(seen.alias("_seen")).where("_seen > 1")
            .select(*_violation(guard, F.col(unit), F.lit(unit))))


def shared_subjects(blocks: DataFrame) -> DataFrame:
    """G3: an animal on both sides."""
    return _in_several_parts(blocks, "shared_subject", "subject", SIDES)


def shared_sessions(blocks: DataFrame) -> DataFrame:
    """G4: a session on both sides."""
    return _in_several_parts(blocks, "shared_session", "eid", SIDES)


def calibration_overlap(blocks: DataFrame, animal_level: bool) -> DataFrame:
    """G5: calibration shares a session (and, across animals, an animal) with train or test."""
    unit = [("eid", "calib_session")] + ([("subject", "calib_subject")] if animal_level else [])
    found = []
    for column, guard in unit:
        calib = F.max((F.col("part") == "calib").cast("int"))
        other = F.max(F.col("part").isin(*SIDES).cast("int"))
        found.append(blocks.groupBy("split_id", column)
                     .agg((calib + other).alias("_seen")).where("_seen > 1")
                     .select(*_violation(guard, F.col(column), F.lit(column))))
    return reduce(DataFrame.unionByName, found)


def straddling_trials(trials: DataFrame) -> DataFrame:
    """G6: a trial with rows in more than one part; input split_id, eid, trial_id, part."""
    lo, hi = F.min("part"), F.max("part")
    return (trials.groupBy("split_id", "eid", "trial_id").agg(lo.alias("_lo"), hi.alias("_hi"))
            .where("_lo <> _hi")
            .select(*_violation("straddling_trial", F.col("trial_id"),
                                F.concat_ws(":", "_lo", "_hi"))))


def empty_parts(blocks: DataFrame, required: Sequence[str]) -> DataFrame:
    """G7: a required part without a block, per split (an empty table lacks every part)."""
    flags = [F.max((F.col("part") == p).cast("int")).alias(p) for p in required]
    per = blocks.groupBy("split_id").agg(*flags)
    missing = F.explode(F.array_compact(F.array(
        *[F.when(F.coalesce(F.col(p), F.lit(0)) == 0, F.lit(p)) for p in required])))
    return per.withColumn("_missing", missing).select(
        *_violation("empty_part", F.col("split_id"), F.col("_missing")))


def version_mismatch(meta: DataFrame, manifest_version: str, preproc_version: str) -> DataFrame:
    """G8: recorded versions differ from the current ones; a missing version differs too."""
    same = (F.col("manifest_version").eqNullSafe(manifest_version)
            & F.col("preproc_version").eqNullSafe(preproc_version))
    return meta.where(~same).select(*_violation(
        "version_mismatch", F.col("split_id"),
        F.concat_ws(":", F.coalesce("manifest_version", F.lit("")),
                    F.coalesce("preproc_version", F.lit("")))))


def interleaved(swept: DataFrame) -> DataFrame:
    """G9: more than one change between train and test along a session."""
    changed = F.count_if(F.col("prev_part") != F.col("part"))
    return (swept.groupBy("split_id", "eid").agg(changed.alias("_changes")).where("_changes > 1")
            .select(*_violation("interleaved", F.col("eid"), F.col("_changes"))))


def norm_leak(stored: DataFrame, refit: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """G10: statistics change when test data change, so they were not fit on train alone."""
    a, b = stored.alias("a"), refit.alias("b")
    keys = ["eid", "unit_id"]

    def differs(column: str) -> Column:
        x, y = F.col(f"a.{column}"), F.col(f"b.{column}")
        return ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
    return (a.join(b, keys, "full").where(differs("mean") | differs("std"))
            .select(F.lit("norm_leak").alias("guard"), F.lit("").alias("split_id"),
                    F.col("eid").cast("string").alias("subject_of"),
                    F.col("unit_id").cast("string").alias("detail")))


def split_violations(split: "Split", context_bins: int) -> DataFrame:
    """The guards that apply to the kind of a split, in one table."""
    from truegauge.operators.splits import ANIMAL_KINDS, SESSION_KINDS
    if split.kind not in ("within_session", "whole", *SESSION_KINDS, *ANIMAL_KINDS):
        raise SplitViolation(f"unknown kind of split {split.kind!r}: no guard would apply")
    blocks = split.blocks
    swept = sweep(blocks)
    found = [shared_bins(swept, context_bins),
             calibration_overlap(blocks, split.kind in ANIMAL_KINDS),
             empty_parts(blocks, split.required_parts)]
    if split.kind == "within_session":
        if split.bin_width_us is None:
            raise SplitViolation("a within_session split needs bin_width_us to keep its 2 s gap")
        needed = required_gap(context_bins, split.bin_width_us)
        found += [short_gap(swept, max(needed, split.min_gap_bins)), interleaved(swept)]
    if split.kind in SESSION_KINDS + ANIMAL_KINDS:
        found.append(shared_sessions(blocks))
    if split.kind in ANIMAL_KINDS:
        found.append(shared_subjects(blocks))
    if split.target not in ("bin", "trial"):
        raise SplitViolation(f"unknown target {split.target!r}")
    if split.target == "trial" and split.trials is None:
        raise SplitViolation("a split for trial targets needs its trials, so that none straddles a border")
    if split.trials is not None:
        found.append(straddling_trials(split.trials))
    return reduce(DataFrame.unionByName, found)


def assert_split_valid(split: "Split", context_bins: int) -> None:
    """Raise on the first violations; also raise for an empty split or stale versions."""
    stale = (split.manifest_version != split.current_manifest_version)
    from truegauge import PREPROC_VERSION
    if stale or split.preproc_version != PREPROC_VERSION:
        raise SplitViolation(f"split {split.kind} was made for another version: manifest "
                             f"{split.manifest_version}, preprocessing {split.preproc_version}")
    found = (split_violations(split, context_bins).groupBy("guard")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.min(F.concat_ws(" ", "subject_of", "detail")).alias("first")).collect())
    if found:
        shown = "; ".join(f"{v['guard']} x{v['n']}, first {v['first']}" for v in found)
        raise SplitViolation(f"split {split.kind}: {shown}")
    if split.blocks.isEmpty():
        raise SplitViolation(f"split {split.kind} has no blocks")
