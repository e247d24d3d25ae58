"""Deterministic pseudo-random draws: a retried task must draw the same again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(*parts: Column | str) -> Column:
    """Hex digest over the parts joined by '|': a shuffled order that is stable."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_bucket(buckets: int, *parts: Column | str) -> Column:
    """Uniform bucket 0..buckets-1 from the first 32 bits of the digest."""
    head = F.substring(hash_order(*parts), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(buckets)
