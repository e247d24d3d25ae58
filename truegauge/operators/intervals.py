"""Interval joins without all pairs: both sides meet in a shared time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.timing import bin_of


def join_points(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str,
                start: str, end: str, bucket: int, how: str = "inner") -> DataFrame:
    """Points with the half-open intervals [start, end) that contain them.

    An interval is copied into each bucket it touches; ``(keys, bucket)`` is the
    equi-join key, so one busy key is spread over its buckets. Choose ``bucket``
    near the usual interval length.
    """
    touched = F.sequence(bin_of(start, bucket), bin_of(F.col(end) - 1, bucket))
    right = (intervals.where(F.col(start) < F.col(end))
             .withColumn("_bucket", F.explode(touched))).alias("_r")
    left = points.withColumn("_bucket", bin_of(at, bucket)).alias("_l")
    condition = ((F.col(f"_l.{at}") >= F.col(f"_r.{start}"))
                 & (F.col(f"_l.{at}") < F.col(f"_r.{end}")))
    for key in [*keys, "_bucket"]:
        condition = condition & (F.col(f"_l.{key}") == F.col(f"_r.{key}"))
    extra = [c for c in intervals.columns if c not in keys]
    return left.join(right, condition, how).select(
        *[F.col(f"_l.{c}") for c in points.columns], *[F.col(f"_r.{c}") for c in extra])
