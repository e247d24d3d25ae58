"""Generalization protocols for linear baselines, on session-level Gram tables.

The event data are read once to get one Gram per session. Leaving a session, an
animal or a lab out is then a subtraction, so all folds of all kinds cost a few
joins of session-level tables instead of one fit over the data per fold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_order
from truegauge.operators.baselines import (gram_columns, merge_grams, solve_ridge,
                                           squared_error)
from truegauge.operators.ordered import running
from truegauge.operators.splits import GROUP_OF
from truegauge.session import cut_lineage


def score_models(models: DataFrame, tests: DataFrame, key: str, d: int, kind: str) -> DataFrame:
    """Root mean squared error of each test session from its Gram, (kind, eid, value)."""
    coef = [F.col("coef")[i] for i in range(d)]
    sse = squared_error(d, F.col("intercept"), coef)
    return tests.where("n > 0").join(models, key).select(
        F.lit(kind).alias("kind"), "eid", F.sqrt(sse / F.col("n")).alias("value"))


def within_scores(trains: DataFrame, tests: DataFrame, d: int, lam: float) -> DataFrame:
    models = solve_ridge(trains.where("n > 0"), ["eid"], d, lam)
    return score_models(models, tests, "eid", d, "within_session")


def held_out_scores(grams: DataFrame, tests: DataFrame, kind: str, d: int, lam: float) -> DataFrame:
    """Leave one group out: pooled Gram minus the Gram of the held-out group.

    ``grams`` and ``tests`` carry eid, subject and lab. The pool of held_out_session is
    the animal, otherwise everything (one row, read as literals).
    """
    group, cols = GROUP_OF[kind], gram_columns(d)
    if kind == "held_out_session":
        pool = merge_grams(grams, ["subject"], d, prefix="all_")
        own = grams.join(pool, "subject")
        rest = own.select(group, *[(F.col("all_" + c) - F.col(c)).alias(c) for c in cols])
    else:
        whole = merge_grams(grams, [], d).head()
        own = merge_grams(grams, [group], d)
        rest = own.select(group, *[(F.lit(whole[c]) - F.col(c)).alias(c) for c in cols])
    models = solve_ridge(rest.where("n > 0.5"), [group], d, lam)
    return score_models(models, tests, group, d, kind)


def partition_scores(grams: DataFrame, tests: DataFrame, parts: DataFrame, kind: str, d: int,
                     lam: float) -> DataFrame:
    """One fit on the train sessions of ``parts(eid, part)``, scored on its test sessions."""
    train = grams.join(parts.where("part = 'train'").select("eid"), "eid", "left_semi")
    pooled = merge_grams(train.withColumn("_all", F.lit(1)), ["_all"], d)
    models = solve_ridge(pooled.where("n > 0"), ["_all"], d, lam)
    chosen = tests.join(parts.where("part = 'test'").select("eid"), "eid", "left_semi")
    return score_models(models, chosen.withColumn("_all", F.lit(1)), "_all", d, kind)


def all_kinds(grams: DataFrame, trains: DataFrame, tests: DataFrame, d: int, lam: float,
              partitions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scores of every split kind: within, the three leave-one-group-out kinds, partitions.

    The three Gram tables are written once, so the rows behind them are read once.
    """
    grams, trains, tests = cut_lineage(grams), cut_lineage(trains), cut_lineage(tests)
    found = [within_scores(trains, tests, d, lam)]
    found += [held_out_scores(grams, tests, kind, d, lam) for kind in GROUP_OF]
    found += [partition_scores(grams, tests, parts, kind, d, lam)
              for kind, parts in (partitions or {}).items()]
    return reduce(DataFrame.unionByName, found)


def scaling_curve(grams: DataFrame, tests: DataFrame, shares: Sequence[float], seed: str, d: int,
                  lam: float) -> DataFrame:
    """Error against the number of training animals, with nested subsets.

    Animals are ranked once in a stable shuffled order; a share takes the first
    ceil(share * animals) of them. Each animal adds its Gram to every subset it is in.
    """
    animals = merge_grams(grams, ["subject"], d).withColumn(
        "_h", hash_order("subject", F.lit(seed)))
    chunk = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = running(animals, [], ["_h", "subject"], chunk,
                     {"_rank": ("sum", F.lit(1).cast("bigint"))})
    n = grams.select(F.count_distinct("subject")).head()[0]
    sizes = sorted({math.ceil(s * n) for s in shares})
    every = F.array(*[F.lit(s).cast("bigint") for s in sizes])
    steps = F.explode(F.filter(every, lambda s: s >= F.col("_rank"))).alias("n_animals")
    pooled = merge_grams(ranked.select("*", steps), ["n_animals"], d)
    models = solve_ridge(pooled, ["n_animals"], d, lam)
    coef = [F.col("coef")[i] for i in range(d)]
    sse = squared_error(d, F.col("intercept"), coef)
    reach = tests.where("n > 0").select("*", F.explode(every).alias("n_animals"))
    return reach.join(models, "n_animals").groupBy("n_animals").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg(F.sqrt(sse / F.col("n"))).alias("mean_rmse"))
