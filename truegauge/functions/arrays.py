"""Row-wise algebra on array columns with higher-order functions (no Python per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(vector: Column, weights: Sequence[float] | Column) -> Column:
    other = weights if isinstance(weights, Column) else F.array(*[F.lit(float(w)) for w in weights])
    return total(F.zip_with(vector, other, lambda a, b: a.cast("double") * b))


def log_sum_exp(logits: Column, temperature: float | Column = 1.0) -> Column:
    """ln(sum(exp(z/T))), shifted by the maximum so that it cannot overflow."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    top = F.array_max(logits)
    return top / t + F.ln(total(F.transform(logits, lambda z: F.exp((z - top) / t))))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    norm = log_sum_exp(logits, t)
    return F.transform(logits, lambda z: F.exp(z / t - norm))


def entropy(probabilities: Column) -> Column:
    """-sum(p ln p) with 0 ln 0 = 0."""
    return -total(F.transform(probabilities,
                              lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))
