"""Multinomial logistic models of wide features by Newton steps over the cluster.

One pass sums loss, gradient and Hessian, each task in blocks, merged per key like moments; the
driver solves a system of classes x (features + 1) unknowns. Steps are halved while the loss
does not fall enough, and a fit that has not converged raises. Minimized is the mean negative log
likelihood + lam / 2 times the squared coefficients of all classes; intercepts are free.

Leaving a group out does not read the rows again: its gradient and Hessian at the pooled fit
are taken off, and one Newton step leads from the pooled fit to the fit without the group, up to
second order in the step. ``left_out`` returns the step's size, so that large ones can be refit exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.operators.moments import dot, summed_by
from truegauge.session import ship_package

SUMS = "n double, loss double, gradient array<double>, hessian array<double>"
COLUMNS = ("n", "loss", "gradient", "hessian")


@dataclass
class Derivatives:
    n: float
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> Derivatives:
        """Sums over rows; ``theta`` has a row (intercept, coefficients) per class, ``y`` is its number."""
        z = np.column_stack((np.ones(len(x)), x))
        score = z @ theta.T
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        hit = y.astype(np.int64)[:, None] == np.arange(len(theta))
        loss = -np.log(np.maximum(p[hit], np.finfo(float).tiny)).sum()
        k, d = theta.shape
        hessian = np.zeros((k, d, k, d))
        for a in range(k):
            for b in range(a, k):
                weight = p[:, a] * ((a == b) - p[:, b])
                hessian[a, :, b] = (z * weight[:, None]).T @ z
                hessian[b, :, a] = hessian[a, :, b]
        return cls(float(len(x)), float(loss), ((p - hit).T @ z).ravel(), hessian.reshape(k * d, k * d))

    @classmethod
    def unpacked(cls, n, loss, gradient, hessian) -> Derivatives:
        g = np.asarray(gradient, float)
        return cls(float(n), float(loss), g, np.asarray(hessian, float).reshape(len(g), len(g)))

    def packed(self) -> tuple:
        return self.n, self.loss, self.gradient, self.hessian.ravel()

    def __add__(self, other: Derivatives) -> Derivatives:
        return Derivatives(self.n + other.n, self.loss + other.loss, self.gradient + other.gradient,
                           self.hessian + other.hessian)

    def __sub__(self, other: Derivatives) -> Derivatives:
        return Derivatives(self.n - other.n, self.loss - other.loss, self.gradient - other.gradient,
                           self.hessian - other.hessian)

    def penalized(self, theta: np.ndarray, lam: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss, gradient and Hessian with the penalty."""
        weight = np.full(theta.shape, lam)
        weight[:, 0] = 0
        return (self.loss / self.n + (weight * theta ** 2).sum() / 2, self.gradient / self.n + (weight * theta).ravel(),
                self.hessian / self.n + np.diag(weight.ravel()))

    def step(self, theta: np.ndarray, lam: float) -> np.ndarray:
        """The Newton step; a shift of all intercepts changes nothing and is left out."""
        _, gradient, hessian = self.penalized(theta, lam)
        return -np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0].reshape(theta.shape)


@dataclass(frozen=True)
class Softmax:
    """A fit: a row (intercept, coefficients) per class."""

    theta: np.ndarray
    loss: float
    gradient: float
    rounds: int

    def probabilities(self, x: str) -> Column:
        return _probabilities(x, [F.array(*[F.lit(float(v)) for v in row]) for row in self.theta])


def _probabilities(x: str, rows: Sequence[Column]) -> Column:
    wide = F.concat(F.array(F.lit(1.0)), F.col(x).cast("array<double>"))
    scores = F.array(*[dot(wide, row) for row in rows])
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, v: a + v))


def derivatives(rows: DataFrame, keys: Sequence[str], x: str, y: str, theta: np.ndarray) -> DataFrame:
    """(keys, n, loss, gradient, hessian) at ``theta``, summed over the rows of each key."""
    return summed_by(rows, keys, x, y, lambda v, t: Derivatives.of(v, t, theta), COLUMNS, SUMS,
                     Derivatives.unpacked, Derivatives.packed)


def fit_softmax(rows: DataFrame, x: str, y: str, classes: int, lam: float, tolerance: float = 1e-9,
                most: int = 50) -> Softmax:
    """Fit on ``rows``; ``y`` is 0 .. classes - 1. Raises if the gradient has not fallen to ``tolerance``."""
    at = rows.where(F.col(x).isNotNull()).select(F.size(x).alias("d"), F.col(y).alias("y")).agg(
        F.max("d").alias("d"), F.min("y").alias("low"), F.max("y").alias("high")).head()
    if at["d"] is None or at["low"] is None:
        raise ValueError("no training rows")
    if at["low"] < 0 or at["high"] >= classes:
        raise ValueError(f"classes are 0 to {classes - 1}, found {at['low']} to {at['high']}")

    def measured(theta: np.ndarray) -> Derivatives:
        return Derivatives.unpacked(*derivatives(rows, [], x, y, theta).head())

    theta = np.zeros((classes, at["d"] + 1))
    here = measured(theta)
    for round_ in range(most):
        loss, gradient, _ = here.penalized(theta, lam)
        if np.abs(gradient).max() <= tolerance:
            return Softmax(theta, loss, float(np.abs(gradient).max()), round_)
        step, share = here.step(theta, lam), 1.0
        slope = gradient @ step.ravel()
        while True:
            there = measured(theta + share * step)
            # Rounding of the loss counts as no rise.
            if there.penalized(theta + share * step, lam)[0] <= loss + 1e-4 * share * slope + 1e-13 * abs(loss):
                break
            share /= 2
            if share < 1e-6:
                raise RuntimeError("no step lowers the loss")
        theta, here = theta + share * step, there
    raise RuntimeError(f"not converged after {most} rounds: gradient {np.abs(gradient).max():.2e}")


def left_out(rows: DataFrame, key: str, x: str, y: str, model: Softmax, lam: float) -> DataFrame:
    """(key, theta, step): the fit without each group, one Newton step from the fit on all."""
    types = dict(rows.dtypes)
    each = derivatives(rows, [key], x, y, model.theta)
    whole = derivatives(rows, [], x, y, model.theta).head()
    total = Derivatives.unpacked(*whole)
    ship_package(rows.sparkSession)
    theta = model.theta

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rest = [total - Derivatives.unpacked(*r) for r in zip(*[batch[c] for c in COLUMNS])]
            steps = [r.step(theta, lam) if r.n > 0.5 else np.full_like(theta, np.nan) for r in rest]
            yield batch[[key]].assign(theta=[(theta + s).ravel() for s in steps], step=[np.abs(s).max() for s in steps])

    return each.mapInPandas(run, f"{key} {types[key]}, theta array<double>, step double")


def probabilities_by(rows: DataFrame, models: DataFrame, key: str, x: str, classes: int, out: str = "p") -> DataFrame:
    """Class probabilities of each row under its key's model."""
    width = (F.size("theta") / classes).cast("int")
    parts = [F.slice("theta", width * k + 1, width) for k in range(classes)]
    return rows.join(models.select(key, "theta"), key).withColumn(out, _probabilities(x, parts)).drop("theta")
