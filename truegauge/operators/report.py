"""Reports in which every number can be traced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed pattern of a numeral: digits with an optional fraction.
NUMERAL = r"(\d+(?:\.\d+)?)"


def numerals(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERAL), F.lit(1)))


def untraceable_numerals(reports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Numerals of a report text that occur in no artifact field of the same report.

    ``reports`` has report_id and text, ``artifacts`` report_id and field (as text).
    """
    claimed = reports.select("report_id", F.explode(numerals(F.col("text"))).alias("numeral"))
    known = artifacts.select("report_id", F.explode(numerals(F.col("field"))).alias("numeral"))
    return claimed.join(known, ["report_id", "numeral"], "left_anti")


def session_report(gates: DataFrame, coverage: DataFrame, capabilities: DataFrame,
                   errors: DataFrame) -> DataFrame:
    """One row per gated session; a part that is missing stays null and is named."""
    out = reduce(lambda a, b: a.join(b, "eid", "left"),
                 [coverage.select("eid", "coverage"), errors.select("eid", "error"),
                  capabilities.select("eid", "n_units", "n_trials")], gates)
    lacking = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c))
                                  for c in ("coverage", "error", "n_units", "n_trials")])
    rationale = (F.when(F.col("gate") == "abstain", "score beyond the calibration range")
                 .when(F.col("gate") == "low", "score in the upper calibration range")
                 .when(F.col("gate") == "moderate", "score above the calibration median")
                 .otherwise("score within the calibration core"))
    return out.withColumn("rationale", rationale).withColumn("missing", lacking)


def ablation_table(scores: DataFrame) -> DataFrame:
    """Mean score per (factor, level) and the difference to the reference level of the factor.

    ``scores`` has factor, level, reference (boolean), eid, value; only sessions scored
    under both levels enter the difference.
    """
    base = scores.where("reference").select("factor", "eid", F.col("value").alias("_base"))
    return scores.join(base, ["factor", "eid"], "left").groupBy("factor", "level").agg(
        F.count("value").alias("n_sessions"), F.avg("value").alias("mean"),
        F.avg(F.col("value") - F.col("_base")).alias("change"))
