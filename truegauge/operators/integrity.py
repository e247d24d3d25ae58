"""Checks on loaded tables. Each returns the rows that disagree or a row per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.ordered import previous

UNIT_KEY = ("eid", "probe_name", "unit_id")


def normal_probes(df: DataFrame) -> DataFrame:
    """Probe names compare in lower case across backends."""
    return df.withColumn("probe_name", F.lower("probe_name"))


def unit_totals(spikes: DataFrame) -> DataFrame:
    """Spikes per unit: the small table the backend checks work on."""
    return normal_probes(spikes).groupBy(*UNIT_KEY).agg(F.count(F.lit(1)).alias("n_spikes"))


def backend_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units and spikes per session in both backends; equal means exactly equal.

    Inputs are ``unit_totals``. A session present on one side only disagrees.
    """
    def per_session(units: DataFrame, side: str) -> DataFrame:
        return units.groupBy("eid").agg(F.count(F.lit(1)).alias(f"units_{side}"),
                                        F.sum("n_spikes").alias(f"spikes_{side}"))
    both = per_session(a, "a").join(per_session(b, "b"), "eid", "full")
    return both.withColumn("agree", F.col("units_a").eqNullSafe(F.col("units_b"))
                           & F.col("spikes_a").eqNullSafe(F.col("spikes_b")))


def unit_set_diff(a: DataFrame, b: DataFrame, values: Sequence[str]) -> DataFrame:
    """Units on one side only, and the largest difference of each value on common units."""
    left = normal_probes(a).select(*UNIT_KEY, *[F.col(v).alias(f"a_{v}") for v in values],
                                   F.lit(True).alias("_a"))
    right = normal_probes(b).select(*UNIT_KEY, *[F.col(v).alias(f"b_{v}") for v in values],
                                    F.lit(True).alias("_b"))
    both = left.join(right, list(UNIT_KEY), "full")
    gaps = [F.max(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))).alias(f"max_diff_{v}") for v in values]
    return both.groupBy("eid").agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("_a") & F.col("_b")).alias("common"), *gaps)


def common_units(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units of ``a`` that ``b`` has too."""
    return normal_probes(a).join(normal_probes(b).select(*UNIT_KEY), list(UNIT_KEY), "left_semi")


def monotonic_violations(samples: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Samples earlier than the one before them in the same series.

    The series are cut by sample index, so a chunk has a fixed number of rows.
    """
    chunk = F.floor(F.col("sample_idx") / chunk_rows)
    seen = previous(samples.select("eid", "series", "sample_idx", "t_us"), ["eid", "series"],
                    ["sample_idx"], chunk, ["t_us"])
    return seen.where(F.col("t_us") < F.col("prev_t_us"))


def trial_bounds_violations(trials: DataFrame, bounds: DataFrame) -> DataFrame:
    """Trials that start before or end after ``bounds(eid, first_us, last_us)``.

    Missing times are not violations; a trial of an unknown session is one.
    """
    joined = trials.join(bounds, "eid", "left")
    reason = (F.when(F.col("last_us").isNull(), "unknown session")
              .when(F.col("start_us") < F.col("first_us"), "starts early")
              .when(F.col("end_us") > F.col("last_us"), "ends late"))
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "eid", "trial_id", "reason")


def _compare(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    both = a.join(b, list(keys), "full").select(
        *keys, F.coalesce(left, zero).alias(left), F.coalesce(right, zero).alias(right))
    return both.where(F.col(left) != F.col(right))


def binning_roundtrip(spikes: DataFrame, bins: DataFrame) -> DataFrame:
    """Units whose bins do not sum up to their spikes."""
    a = spikes.groupBy("eid", "unit_id").agg(F.count(F.lit(1)).alias("n_spikes"))
    b = bins.groupBy("eid", "unit_id").agg(F.sum("n").alias("n_binned"))
    return _compare(a, b, ["eid", "unit_id"], "n_spikes", "n_binned")


def reconcile_rows(expected: DataFrame, written: DataFrame,
                   weight: Column | None = None) -> DataFrame:
    """Rows per part promised by the split against rows actually written."""
    size = F.sum(weight) if weight is not None else F.count(F.lit(1))
    a = expected.groupBy("part").agg(size.alias("n_expected"))
    b = written.groupBy("part").agg(F.count(F.lit(1)).alias("n_written"))
    zero = F.lit(0).cast("bigint")
    return a.join(b, "part", "full").select(
        "part", F.coalesce("n_expected", zero).alias("n_expected"),
        F.coalesce("n_written", zero).alias("n_written")).withColumn(
        "agree", F.col("n_expected") == F.col("n_written"))
