"""Multinomial fits against a plain Newton in numpy; folds against exact refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from truegauge.operators import softmax

LAM = 0.05


def rows_of(n=1500, d=64, classes=3, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 1, (n, d))
    score = x @ draw.normal(0, 0.5, (d, classes))
    return x, (score + draw.gumbel(size=score.shape)).argmax(axis=1), np.arange(n) % 20


def newton(x, y, classes, lam):
    theta = np.zeros((classes, x.shape[1] + 1))
    for _ in range(60):
        theta = theta + softmax.Derivatives.of(x, y, theta).step(theta, lam)
    return theta


@pytest.fixture(scope="module")
def table(spark):
    x, y, g = rows_of()
    rows = [(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, g)]
    rows += [(None, 1, 3), ([0.0] * 64, None, 3)]
    return spark.createDataFrame(rows, "x array<double>, y int, g int").repartition(6)


def test_fit_is_stationary_and_equals_numpy(spark, table):
    x, y, _ = rows_of()
    model = softmax.fit_softmax(table, "x", "y", 3, LAM)
    assert model.gradient <= 1e-9 and model.rounds < 20
    assert np.allclose(model.theta, newton(x, y, 3, LAM), atol=1e-7)
    # The gradient by differences of the loss, from Spark's own probabilities.
    known = table.where("x is not null and y is not null")
    chance = model.probabilities("x")
    loss = known.select(F.avg(-F.log(F.element_at(chance, F.col("y") + 1)))).head()[0]
    assert loss + LAM / 2 * (model.theta[:, 1:] ** 2).sum() == pytest.approx(model.loss, rel=1e-9)
    for k, j in ((0, 0), (1, 5), (2, 64)):
        values = []
        for h in (-1e-4, 1e-4):
            moved = model.theta.copy()
            moved[k, j] += h
            d = softmax.Derivatives.of(x, y, moved)
            values.append(d.penalized(moved, LAM)[0])
        assert abs(values[1] - values[0]) / 2e-4 < 1e-6


def test_left_out_is_close_to_the_exact_refit(table):
    model = softmax.fit_softmax(table, "x", "y", 3, LAM)
    near = {r["g"]: (np.reshape(r["theta"], model.theta.shape), r["step"]) for r in
            softmax.left_out(table, "g", "x", "y", model, LAM).collect()}
    assert len(near) == 20
    x, y, g = rows_of()
    for k in (0, 7):
        exact = newton(x[g != k], y[g != k], 3, LAM)
        off = np.abs(near[k][0] - exact).max()
        assert off < 0.1 * near[k][1] and off < 0.01
    scored = softmax.probabilities_by(table.where("g = 7 and x is not null and y is not null"), softmax.left_out(
        table, "g", "x", "y", model, LAM), "g", "x", 3).collect()
    z = np.column_stack((np.ones(len(scored)), [r["x"] for r in scored])) @ near[7][0].T
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose([r["p"] for r in scored], want, atol=1e-12)


def test_unfit_input_raises(spark, table):
    with pytest.raises(ValueError, match="classes"):
        softmax.fit_softmax(table, "x", "y", 2, LAM)
    with pytest.raises(ValueError, match="no training"):
        softmax.fit_softmax(table.where("false"), "x", "y", 3, LAM)
    with pytest.raises(RuntimeError, match="converged"):
        softmax.fit_softmax(table, "x", "y", 3, LAM, most=1)
