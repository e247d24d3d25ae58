"""Wide fits from co-moments against numpy, with means far beyond the deviations."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from truegauge.operators import moments
from truegauge.operators.moments import Moment

D, LAM = 64, 0.1


@pytest.fixture(scope="module")
def wide():
    draw = np.random.default_rng(3)
    x = draw.normal(0, 1, (3000, D)) @ draw.normal(0, 1, (D, D)) / 8
    coef = draw.normal(0, 1, D)
    key = np.where(np.arange(3000) % 3 == 0, 0, np.arange(3000) % 10)  # one key holds a third
    return key, x + 1e6 * draw.normal(0, 1, D), x @ coef + draw.normal(0, 0.1, 3000) + 5e6


@pytest.fixture(scope="module")
def table(spark, wide):
    key, x, y = wide
    rows = [(int(k) if k != 9 else None, a.tolist(), float(b)) for k, a, b in zip(key, x, y)]
    rows += [(1, None, 1.0), (1, [0.0] * D, None), (2, [None] + [0.0] * (D - 1), 1.0)]
    return spark.createDataFrame(rows, "k bigint, x array<double>, y double").repartition(7)


def exact(x, y, lam=LAM):
    x = x.astype(np.longdouble)
    mx, my = x.mean(axis=0), y.astype(np.longdouble).mean()
    cx, cy = (x - mx).astype(float), (y - my).astype(float)
    coef = np.linalg.solve(cx.T @ cx / len(y) + lam * np.eye(x.shape[1]), cx.T @ cy / len(y))
    return float(my - mx @ coef), coef


def test_ridge_of_all_rows_and_per_key(table, wide):
    key, x, y = wide
    intercept, coef = moments.ridge(table, "x", "y", LAM)
    assert np.allclose(coef, exact(x, y)[1], rtol=1e-7, atol=1e-9)
    each = moments.ridges(moments.moments(table, ["k"], "x", "y"), ["k"], LAM).collect()
    assert {r["k"] for r in each} == {0, 1, 2, 3, 4, 5, 6, 7, 8, None} - {k for k in range(10) if not (key == k).any()}
    for r in each:
        mine = key == (9 if r["k"] is None else r["k"])
        assert np.allclose(r["coef"], exact(x[mine], y[mine])[1], rtol=1e-6, atol=1e-8)
    scored = moments.predicted(table.where("k = 0 and y is not null"), moments.ridges(
        moments.moments(table, ["k"], "x", "y"), ["k"], LAM), ["k"], "x")
    a, b = exact(x[key == 0], y[key == 0])
    want = dict(zip(y[key == 0].tolist(), x[key == 0] @ b + a))
    for r in scored.collect():
        assert abs(r["yhat"] - want[r["y"]]) < 1e-4  # of 5e6


def test_without_a_group_and_squared_error(table, wide):
    key, x, y = wide
    parts = moments.moments(table, ["k"], "x", "y")
    rest = {r["k"]: Moment.unpacked(r["n"], r["mean"], r["moment"]) for r in moments.without(
        parts, ["k"], moments.moments(table, [], "x", "y")).collect()}
    own = {r["k"]: Moment.unpacked(r["n"], r["mean"], r["moment"]) for r in parts.collect()}
    for k in (0, 4):
        a, b = exact(x[key != k], y[key != k])
        intercept, coef = rest[k].ridge(LAM)
        assert np.allclose(coef, b, rtol=1e-6, atol=1e-8)
        sse = ((y[key == k] - my_line(x[key == k], x[key != k], y[key != k], b)) ** 2).sum()
        assert own[k].squared_error(intercept, coef) == pytest.approx(sse, rel=1e-6)


def my_line(x, train_x, train_y, b):
    middle = train_x.astype(np.longdouble).mean(axis=0)
    return ((x - middle) @ b + train_y.astype(np.longdouble).mean()).astype(float)


def test_reduced_rank_equals_numpy(table, wide):
    key, x, y = wide
    parts = moments.moments(table.where("k is not null"), ["k"], "x", "y")
    found = {r["k"]: np.array(r["coef"]) for r in moments.reduced_rank(parts, ["k"], 2, LAM).collect()}
    keys = [k for k in range(9) if (key == k).any()]
    stack = sum((key == k).sum() * np.outer(*[exact(x[key == k], y[key == k])[1]] * 2) for k in keys)
    basis = np.linalg.eigh(stack)[1][:, ::-1][:, :2]
    for k in keys:
        mine, z = key == k, (x[key == k] - x[key == k].mean(axis=0)) @ basis
        inner = exact(z, y[mine])[1]
        assert np.allclose(found[k], basis @ inner, rtol=1e-5, atol=1e-7)


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], "k int, x array<double>, y double")
    assert moments.moments(none, ["k"], "x", "y").count() == 0
    with pytest.raises(ValueError):
        moments.ridge(none, "x", "y", LAM)


def test_queries_with_python_workers_run_from_another_folder(tmp_path):
    """Workers that start elsewhere get the package shipped."""
    root = Path(__file__).resolve().parents[1]
    code = (f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e\n"
            "from truegauge.session import local_session\n"
            "s = local_session(4)\n"
            "for q in ('h04_reduced_rank', 'h05_per_session', 'k04_contract_per_session'):\n"
            "    assert e.queries()[q](s, '/root/testdata/sf0.001').count() > 0\n"
            "print('ran')\n")
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, text=True,
                          timeout=600)
    assert done.stdout.endswith("ran\n"), done.stderr[-2000:]


def test_rotated_moments_equal_the_moments_of_rotated_rows(spark):
    from pyspark.sql import functions as F

    from truegauge.operators import nulls

    draw = np.random.default_rng(5)
    rows = [(e, p, 41, [float(v) for v in draw.normal(0, 1, 2)] if p != 3 else None, float(draw.normal()) if p != 7 else None)
            for e in ("a", "b") for p in range(41) if e == "a" or p % 3]
    rows += [("c", 0, 1, [1.0, 2.0], 3.0)]  # one position cannot be rotated
    df = spark.createDataFrame(rows, "eid string, pos bigint, n_pos bigint, x array<double>, y double")
    turned = nulls.null_shuffle(df.withColumnRenamed("x", "yhat"), 5, "s", 8)
    want = {(r["eid"], r["rep"]): r for r in moments.moments(turned, ["eid", "rep"], "yhat", "y").collect()}
    got = nulls.rotated_moments(df, 2, 5, "s", 8).collect()
    assert {r["eid"] for r in got} == {"a", "b"} and len(want) == 10
    for r in got:
        for rep in range(5):
            w = want[r["eid"], rep]
            assert r["n"][rep] == w["n"]
            assert np.allclose(r["mean"][3 * rep:3 * rep + 3], w["mean"])
            assert np.allclose(r["moment"][9 * rep:9 * rep + 9], w["moment"])
    narrow = {r["rep"]: r for r in moments.narrow_moments(turned, ["rep"], "yhat", "y", 2).select(
        "*", F.lit(0).alias("_")).collect()}
    for r in moments.moments(turned, ["rep"], "yhat", "y").collect():
        assert r["n"] == narrow[r["rep"]]["n"] and np.allclose(r["moment"], narrow[r["rep"]]["moment"])


def test_models_that_all_sessions_share_meet_them_without_a_join(spark):
    from truegauge.plans import kinds

    tests = spark.createDataFrame([(1,), (2,)], "eid bigint")
    found = kinds.met(tests, [("model", 0.5, [1.0, 2.0])], "")
    assert sorted(map(tuple, found.collect())) == [(1, "model", 0.5, [1.0, 2.0]), (2, "model", 0.5, [1.0, 2.0])]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert kinds.met(tests, [], "").count() == 0
    recipe = kinds.Recipe(ridge=(0,), multisession=(0, 1), model=(1, 2), rank=1, lam=LAM)
    draw = np.random.default_rng(6)
    some = [Moment.of(draw.normal(0, 1, (9, 4))) for _ in range(3)]
    n, mean, moment = (np.array([getattr(m, c) for m in some]) for c in ("n", "mean", "moment"))
    for row, at in (("baseline_ridge", [0]), ("model", [1, 2])):
        a, b = recipe.fits(row, n, mean, moment, recipe.stacks(n, mean, moment))
        for i, m in enumerate(some):
            keep = [*at, 3]
            one = Moment(m.n, m.mean[keep], m.moment[np.ix_(keep, keep)]).ridge(LAM)
            assert np.isclose(a[i], one[0]) and np.allclose(b[i][at], one[1]) and np.count_nonzero(b[i]) == len(at)
