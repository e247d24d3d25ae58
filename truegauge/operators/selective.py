"""Selective prediction: does the score say where the errors are?"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.functions.hashing import hash_bucket
from truegauge.functions.stats import correlation
from truegauge.operators.ordered import rank_cells, running, with_value_chunk
from truegauge.session import cut_lineage


def orderings(sessions: DataFrame, scores: Mapping[str, str | Column], error: str = "error",
              seed: str = "random") -> DataFrame:
    """Long (method, eid, score, error): the given scores plus a stable random order.

    A session without a score is trusted last.
    """
    def known(c: str | Column) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("double")
        return F.coalesce(value, F.lit(math.inf)).alias("score")
    cells = [F.struct(F.lit(m).alias("method"), known(c)) for m, c in scores.items()]
    cells.append(F.struct(F.lit("random").alias("method"),
                          hash_bucket(1 << 32, "eid", F.lit(seed)).cast("double").alias("score")))
    return sessions.select("eid", F.col(error).alias("error"), F.explode(F.array(*cells)).alias("_c")
                           ).select("_c.method", "eid", "_c.score", "error")


def risk_coverage(ordered: DataFrame) -> DataFrame:
    """Mean error over the most trusted sessions, for every coverage.

    The running sums are chunked by score, so a million sessions do not end up in one
    sorted task.
    """
    sizes = ordered.groupBy("method").agg(F.count(F.lit(1)).alias("_n"))
    ordered = cut_lineage(ordered)
    chunked = with_value_chunk(ordered, "score")
    curve = running(chunked, ["method"], ["score", "eid"], F.col("_part"),
                    {"rank": ("sum", F.lit(1).cast("bigint")), "_err": ("sum", F.col("error"))})
    return curve.join(sizes, "method").select(
        "method", "eid", "score", "error", "rank",
        (F.col("rank") / F.col("_n")).alias("coverage"), (F.col("_err") / F.col("rank")).alias("risk"))


def aurc(curve: DataFrame) -> DataFrame:
    return curve.groupBy("method").agg(F.count(F.lit(1)).alias("n_sessions"),
                                       F.avg("risk").alias("aurc"))


def abstention_gain(curve: DataFrame, worst: float) -> DataFrame:
    """Error saved by refusing the ``worst`` share of sessions of each ordering."""
    kept = F.col("coverage") <= 1 - worst + 1e-12
    kept_error = F.avg(F.when(kept, F.col("error")))
    return curve.groupBy("method").agg(
        F.count_if(kept).alias("n_kept"), F.avg("error").alias("error_all"),
        kept_error.alias("error_kept"), (F.avg("error") - kept_error).alias("reduction"))


def rank_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mid-ranks ``rk_<column>`` of complete rows."""
    rows = cut_lineage(rows.dropna(subset=list(columns)))
    out = rows
    for c in columns:
        ranks = rank_cells(rows, [], c, f"rk_{c}")
        out = out.join(ranks, c)
    return out


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    ranked = rank_table(rows, [x, y])
    return ranked.agg(F.count(F.lit(1)).alias("n"), correlation(f"rk_{x}", f"rk_{y}").alias("rho"))


def rank_correlations(rows: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    """Spearman matrix of a few columns; only the matrix reaches the driver."""
    ranked = rank_table(rows, columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    found = ranked.agg(F.count(F.lit(1)).alias("n"), *[
        correlation(f"rk_{columns[i]}", f"rk_{columns[j]}").alias(f"c_{i}_{j}") for i, j in pairs]).head()
    matrix = np.eye(len(columns))
    for i, j in pairs:
        value = found[f"c_{i}_{j}"]
        matrix[i, j] = matrix[j, i] = math.nan if value is None else value
    return found["n"], matrix


def partial_correlation(matrix: np.ndarray, controls: Sequence[int]) -> float:
    """Correlation of columns 0 and 1 with ``controls`` held fixed, from the inverse matrix."""
    chosen = [0, 1, *controls]
    sub = matrix[np.ix_(chosen, chosen)]
    if not np.isfinite(sub).all():
        return math.nan
    inverse = np.linalg.pinv(sub, hermitian=True)
    scale = math.sqrt(max(inverse[0, 0] * inverse[1, 1], 0.0))
    return -inverse[0, 1] / scale if scale else math.nan


def controlled_spearman(rows: DataFrame, x: str, y: str, controls: Sequence[str]) -> DataFrame:
    """rho raw, with each confound removed alone, and with all of them removed."""
    n, matrix = rank_correlations(rows, [x, y, *controls])
    results = [("none", float(matrix[0, 1]))]
    results += [(c, partial_correlation(matrix, [2 + i])) for i, c in enumerate(controls)]
    results.append(("all", partial_correlation(matrix, list(range(2, 2 + len(controls))))))
    return rows.sparkSession.createDataFrame(
        [(name, n, float(rho)) for name, rho in results], "control string, n bigint, rho double")


def strongest_covariate(rows: DataFrame, score: str, covariates: Sequence[str]) -> DataFrame:
    """Smell: which covariate follows the per-session score most closely."""
    n, matrix = rank_correlations(rows, [score, *covariates])
    table = [(c, n, float(matrix[0, 1 + i])) for i, c in enumerate(covariates)]
    top = max((abs(r) for _, _, r in table if not math.isnan(r)), default=math.nan)
    return rows.sparkSession.createDataFrame(
        [(c, n, r, abs(r) == top) for c, n, r in table],
        "covariate string, n bigint, rho double, strongest boolean")


def success_summary(rho: DataFrame, areas: DataFrame, ood: str, confidence: str,
                    min_rho: float = 0.5, min_sessions: int = 20) -> DataFrame:
    """The criteria side by side: correlation, area below confidence and a random order, enough sessions."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("aurc")))
    both = areas.agg(pick(ood).alias("aurc_ood"), pick(confidence).alias("aurc_confidence"),
                     pick("random").alias("aurc_random"),
                     F.max("n_sessions").alias("n_sessions")).withColumn("_one", F.lit(1))
    joined = rho.select("rho").withColumn("_one", F.lit(1)).join(both, "_one").drop("_one")
    return joined.withColumns({
        "rho_ok": F.coalesce(F.abs("rho") > min_rho, F.lit(False)),
        "aurc_ok": F.coalesce(F.col("aurc_ood") < F.least("aurc_confidence", "aurc_random"), F.lit(False)),
        "enough": F.col("n_sessions") >= min_sessions})
