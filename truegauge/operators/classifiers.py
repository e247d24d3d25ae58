"""A linear class scorer on array features: scaled dot products with class centroids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.arrays import dot
from truegauge.functions.hashing import hash_bucket


@dataclass(frozen=True)
class CentroidModel:
    """classes x dim weights; the size depends on the model, not on the data."""

    weights: np.ndarray
    scale: float = 1.0

    def logits(self, x: str = "x") -> Column:
        return F.array(*[F.lit(self.scale) * dot(F.col(x), w) for w in self.weights])


def _means(dim: int, x: str) -> Column:
    return F.array(*[F.avg(F.col(x)[i]) for i in range(dim)]).alias("mean")


def _model(rows, classes: int, dim: int, scale: float) -> CentroidModel:
    weights = np.zeros((classes, dim))
    for row in rows:
        weights[row["y"]] = row["mean"]
    return CentroidModel(weights, scale)


def fit_centroids(train: DataFrame, classes: int, dim: int, scale: float = 1.0,
                  x: str = "x") -> CentroidModel:
    """Mean vector per class, one aggregate per position (nothing is exploded)."""
    found = train.where(F.col("y").between(0, classes - 1)).groupBy("y").agg(_means(dim, x))
    return _model(found.collect(), classes, dim, scale)


def fit_centroid_ensemble(train: DataFrame, members: int, share: int, classes: int, dim: int,
                          scale: float = 1.0, x: str = "x") -> list[CentroidModel]:
    """Members on hash-drawn subsets of the rows, fitted together in one aggregation."""
    drawn = train.where(F.col("y").between(0, classes - 1)).withColumn(
        "member", F.explode(member_draw(["eid"], members, share)))
    rows = drawn.groupBy("member", "y").agg(_means(dim, x)).collect()
    return [_model([r for r in rows if r["member"] == m], classes, dim, scale)
            for m in range(members)]


def member_draw(key: Sequence[str], members: int, share: int) -> Column:
    """Array of the ensemble members whose subset (``share`` percent) contains the row."""
    everyone = F.array(*[F.lit(m) for m in range(members)])
    return F.filter(everyone, lambda m: hash_bucket(100, *key, m) < share)
