"""Chunked ordered operations against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.planted import draw, mid_rank
from truegauge.operators import latent, ordered, targets
from truegauge.operators.intervals import join_points


@pytest.fixture(scope="module")
def hot(spark):
    rows = [("hot" if draw(i, "k") < 0.6 else f"k{i % 5}", i, round(draw(i, "v") * 20) / 2,
             None if draw(i, "n") < 0.2 else i * 10) for i in range(600)]
    frame = pd.DataFrame(rows, columns=["key", "i", "v", "maybe"]).astype({"maybe": "Int64"})
    return frame, spark.createDataFrame(rows, "key string, i bigint, v double, maybe bigint")


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_running_matches_plain_window(hot, chunk):
    _, df = hot
    w = W.partitionBy("key").orderBy("i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    plain = df.select("key", "i", F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"),
                      F.last("maybe", True).over(upto).alias("l"))
    mine = ordered.running(df, ["key"], ["i"], F.floor(F.col("i") / chunk), {
        "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("maybe"))})
    assert mine.select("key", "i", "s", "m", "l").exceptAll(plain).isEmpty()
    assert mine.count() == 600


@pytest.mark.parametrize("reverse", [False, True])
def test_previous_is_lag_or_lead_with_nulls(hot, reverse):
    _, df = hot
    w = W.partitionBy("key").orderBy("i")
    plain = df.select("key", "i", (F.lead if reverse else F.lag)("maybe").over(w).alias("p"))
    mine = ordered.previous(df, ["key"], ["i"], F.floor(F.col("i") / 13), ["maybe"], reverse=reverse)
    assert mine.select("key", "i", F.col("prev_maybe").alias("p")).exceptAll(plain).isEmpty()


def test_quantiles_are_exact(hot):
    frame, df = hot
    got = ordered.quantiles(df, ["key"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.93}).toPandas()
    for row in got.itertuples():
        values = frame.loc[frame.key == row.key, "v"]
        assert np.allclose([row.lo, row.mid, row.hi], np.quantile(values, [0.1, 0.5, 0.93]))


def test_order_statistic_and_infinity_beyond_the_size(hot):
    frame, df = hot
    got = {r["key"]: r["t"] for r in ordered.kth_smallest(df, ["key"], "v", 60, "t").collect()}
    for key, values in frame.groupby("key")["v"]:
        want = np.sort(values)[59] if len(values) >= 60 else np.inf
        assert got[key] == want
    assert np.inf in got.values()


def test_ranks_give_ties_their_mean(hot):
    frame, df = hot
    ranks = {r["v"]: r["rk"] for r in ordered.rank_cells(df, [], "v", "rk").collect()}
    assert np.allclose([ranks[v] for v in frame.v], mid_rank(frame.v))


def test_halo_needs_no_more_than_its_reach(hot):
    _, df = hot
    near = ordered.with_halo(df.withColumn("bin", F.col("i")), "bin", 16, back=3, ahead=2)
    assert near.where("_core").count() == 600
    w = W.partitionBy("_chunk").orderBy("bin").rowsBetween(-3, 2)
    mine = near.withColumn("s", F.sum("v").over(w)).where("_core").select("i", "s")
    plain = df.select("i", F.sum("v").over(W.orderBy("i").rowsBetween(-3, 2)).alias("s"))
    assert mine.exceptAll(plain).isEmpty()
    with pytest.raises(ValueError):
        ordered.with_halo(df.withColumn("bin", F.col("i")), "bin", 3, back=3)


def test_interval_join_matches_brute_force(spark):
    points = [("a", int(draw(i) * 1000) - 100) for i in range(300)]
    spans = [("a", int(draw(i, "s") * 900) - 50, 0) for i in range(25)]
    spans = [(k, s, s + 1 + int(draw(s, "l") * 200)) for k, s, _ in spans]
    got = join_points(spark.createDataFrame(points, "k string, t bigint"),
                      spark.createDataFrame(spans, "k string, lo bigint, hi bigint"),
                      ["k"], "t", "lo", "hi", 37)
    want = sorted((t, lo, hi) for _, t in points for _, lo, hi in spans if lo <= t < hi)
    assert sorted((r["t"], r["lo"], r["hi"]) for r in got.collect()) == want


def test_rows_with_null_keys_stay(spark):
    from pyspark.sql import functions as F

    from truegauge.operators.ordered import running
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1)], "k string, i bigint, v bigint")
    out = running(rows, ["k"], ["i"], F.col("i"), {"best": ("max", F.col("v"))})
    assert sorted((str(r["k"]), r["i"], r["best"]) for r in out.collect()) == [
        ("None", 1, 5), ("None", 2, 7), ("a", 1, 1)]


def test_running_shuffles_the_rows_once(spark):
    """Window, chunk sums and join use one partitioning of the rows, with null keys among them."""
    rows = spark.range(1000).selectExpr("if(id % 7 = 0, null, id % 7) AS k", "id AS i", "id % 5 AS v",
                                        "if(id % 11 = 0, null, date'2024-01-01' + int(id % 3)) AS day")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered.running(rows, ["k", "day"], ["i"], F.floor(F.col("i") / 100), {"s": ("sum", F.col("v"))})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 4, plan
        got = {(r["k"], r["day"], r["i"]): r["s"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sums: dict = {}
    for r in rows.orderBy("i").collect():
        sums[r["k"], r["day"]] = sums.get((r["k"], r["day"]), 0) + r["v"]
        assert got[r["k"], r["day"], r["i"]] == sums[r["k"], r["day"]]


def test_running_both_ways_in_one_pass(hot):
    frame, rows = hot
    both = ordered.running(rows, ["key"], ["i"], F.floor(F.col("i") / 50), {"s": ("sum", F.col("v")), "l": ("last", F.col("maybe"))},
                           back={"r": ("sum", F.col("v")), "n": ("last", F.col("maybe")), "m": ("max", F.col("v"))})
    got = both.orderBy("i").toPandas()
    for key, part in frame.groupby("key"):
        mine = got[got["key"] == key]
        v, maybe = part["v"].to_numpy(), part["maybe"]
        assert np.allclose(mine["s"], v.cumsum()) and np.allclose(mine["r"], v[::-1].cumsum()[::-1])
        assert np.allclose(mine["m"], np.maximum.accumulate(v[::-1])[::-1])
        assert np.array_equal(mine["l"].fillna(-1).to_numpy(float), maybe.ffill().fillna(-1).to_numpy(float))
        assert np.array_equal(mine["n"].fillna(-1).to_numpy(float), maybe.bfill().fillna(-1).to_numpy(float))


def test_epochs_and_lags_shuffle_little(spark):
    """One shuffle for the edges (written), four for the runs (written), four for the carries both ways and one to count."""
    states = spark.range(500).selectExpr("id % 3 AS eid", "id div 3 AS bin", "string(id * 7 % 5 < 2) AS state")
    events = spark.range(60).selectExpr("id % 3 AS eid", "id * 500 AS t_us")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = latent.transition_lags(states, events, 100, 50)._jdf.queryExecution().executedPlan().toString()
        epochs = targets.state_epochs(states)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 5 and epochs.count("Exchange hashpartitioning") <= 4


def test_tasks_follow_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from truegauge.operators import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    assert ordered.tasks_for(rows, 400) == 40 and ordered.tasks_for(rows, 5) is None
    made = ordered.running(rows, ["k"], ["v"], F.floor(F.col("v") / 50), {"s": ("sum", F.lit(1))}, parts=40)
    assert made.rdd.getNumPartitions() > 8
    assert {(r["v"], r["s"]) for r in made.collect()} == {(v, v // 3 + 1) for v in range(400)}
