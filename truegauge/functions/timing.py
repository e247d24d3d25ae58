"""Integer microseconds: floats put events that sit on a bin border on either side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(seconds: Column | str) -> Column:
    col = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.round(col * F.lit(1e6)).cast("bigint")


def bin_of(t_us: Column | str, width_us: int | Column) -> Column:
    """Index of the half-open bin [k*width, (k+1)*width), also for negative times."""
    col = F.col(t_us) if isinstance(t_us, str) else t_us
    width = F.lit(width_us) if isinstance(width_us, int) else width_us
    return ((col - F.pmod(col, width)) / width).cast("bigint")
