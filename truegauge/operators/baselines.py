"""Linear baselines from sufficient statistics.

One aggregation reduces the rows to a small Gram table per key. Ridge fits, fits
without one group (subtract its Gram), reduced-rank fits and squared errors all
follow from it without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truegauge.functions.stats import slope
from truegauge.functions.timing import bin_of
from truegauge.operators.binning import CHUNK_BINS, session_bins
from truegauge.operators.splits import Split
from truegauge.session import ship_package


# --- sufficient statistics --------------------------------------------------------

def gram_columns(d: int) -> list[str]:
    pairs = [f"xx_{i}_{j}" for i in range(d) for j in range(i, d)]
    return ["n", "sy", "syy", *[f"sx_{i}" for i in range(d)],
            *[f"xy_{i}" for i in range(d)], *pairs]


def gram(rows: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """n, sums and products of the features and the target, summed map-side per key."""
    d, cols = len(xs), [F.col(x).cast("double") for x in xs]
    target = F.col(y).cast("double")
    exprs = [F.count(F.lit(1)).cast("double"), F.sum(target), F.sum(target * target),
             *[F.sum(c) for c in cols], *[F.sum(c * target) for c in cols],
             *[F.sum(cols[i] * cols[j]) for i in range(d) for j in range(i, d)]]
    return rows.groupBy(*keys).agg(*[e.alias(n) for e, n in zip(exprs, gram_columns(d))])


def merge_grams(grams: DataFrame, keys: Sequence[str], d: int, prefix: str = "") -> DataFrame:
    return grams.groupBy(*keys).agg(*[F.sum(c).alias(prefix + c) for c in gram_columns(d)])


def grams_without(total: DataFrame, own: str, d: int, prefix: str = "all_") -> DataFrame:
    """Subtract each row's own Gram (prefix ``own``) from the pooled one (``prefix``)."""
    return total.withColumns({c: F.col(prefix + c) - F.col(own + c) for c in gram_columns(d)})


def squared_error(d: int, intercept: Column, coef: Sequence[Column], prefix: str = "") -> Column:
    """Sum of squared errors of a linear model from the Gram of the scored rows."""
    g = lambda name: F.col(prefix + name)
    total = g("syy") - 2 * intercept * g("sy") + g("n") * intercept * intercept
    for i in range(d):
        total = total - 2 * coef[i] * g(f"xy_{i}") + 2 * intercept * coef[i] * g(f"sx_{i}")
        for j in range(d):
            total = total + coef[i] * coef[j] * g(f"xx_{min(i, j)}_{max(i, j)}")
    return F.greatest(total, F.lit(0.0))


# --- ridge -------------------------------------------------------------------------

def _centred(frame: pd.DataFrame, d: int) -> tuple[np.ndarray, ...]:
    n = frame["n"].to_numpy(float)
    mx = np.stack([frame[f"sx_{i}"].to_numpy(float) / n for i in range(d)], axis=1)
    my = frame["sy"].to_numpy(float) / n
    cxy = np.stack([frame[f"xy_{i}"].to_numpy(float) / n for i in range(d)], axis=1)
    cxx = np.empty((len(frame), d, d))
    for i in range(d):
        for j in range(i, d):
            cxx[:, i, j] = cxx[:, j, i] = frame[f"xx_{i}_{j}"].to_numpy(float) / n
    return mx, my, cxx - mx[:, :, None] * mx[:, None, :], cxy - mx * my[:, None]


def _ridge(frame: pd.DataFrame, d: int, lam: float) -> tuple[np.ndarray, np.ndarray]:
    mx, my, cxx, cxy = _centred(frame, d)
    inverse = np.linalg.pinv(cxx + lam * np.eye(d), hermitian=True)
    coef = np.einsum("nij,nj->ni", inverse, cxy)
    return my - (mx * coef).sum(axis=1), coef


def solve_ridge(grams: DataFrame, keys: Sequence[str], d: int, lam: float) -> DataFrame:
    """Intercept and coefficients per row of a Gram table; ``lam`` is per sample.

    Minimizes mean squared error + lam * |coef|^2 with a free intercept. One feature
    is a closed form in the JVM; more are solved in batches, a few numbers per row.
    """
    if d == 1:
        mx, my = F.col("sx_0") / F.col("n"), F.col("sy") / F.col("n")
        slope = F.try_divide(F.col("xy_0") / F.col("n") - mx * my,
                             F.col("xx_0_0") / F.col("n") - mx * mx + lam)
        fitted = grams.withColumn("coef", F.array(F.coalesce(slope, F.lit(0.0))))
        return fitted.withColumn("intercept", my - F.col("coef")[0] * mx).select(
            *keys, "intercept", "coef")

    ship_package(grams.sparkSession)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            intercept, coef = _ridge(batch, d, lam)
            yield batch[list(keys)].assign(intercept=intercept, coef=list(coef))

    types = dict(grams.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys],
                        "intercept double", "coef array<double>"])
    return grams.select(*keys, *gram_columns(d)).mapInPandas(solve, schema)


@dataclass(frozen=True)
class LinearModel:
    """One global linear model; its few numbers travel as literals."""

    features: tuple[str, ...]
    intercept: float
    coef: tuple[float, ...]

    def predict(self, rows: DataFrame, out: str = "yhat") -> DataFrame:
        return rows.withColumn(out, self.score())

    def score(self) -> Column:
        value = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coef):
            value = value + F.lit(weight) * F.col(name)
        return value


def ridge_of(train: DataFrame, xs: Sequence[str], y: str, lam: float) -> LinearModel:
    frame = gram(train, [], xs, y).toPandas()
    if not frame["n"].iloc[0]:
        raise ValueError("no training rows")
    intercept, coef = _ridge(frame, len(xs), lam)
    return LinearModel(tuple(xs), float(intercept[0]), tuple(float(c) for c in coef[0]))


def fit_ridge(split: Split, rows: DataFrame, xs: Sequence[str], y: str, lam: float) -> LinearModel:
    """Ridge on the train rows of a checked split."""
    return ridge_of(split.rows(rows, "train"), xs, y, lam)


def fit_per_session(split: Split, rows: DataFrame, xs: Sequence[str], y: str,
                    lam: float) -> DataFrame:
    """A ridge per session on its own train rows: centred sums in the order of the bins, then small solves.

    A constant feature has a covariance of zero, not of what products rounded before they were subtracted leave, so
    that coefficients that are zero have no sign or direction of their own.
    """
    d, target = len(xs), F.col(y).cast("double")
    known = split.rows(rows, "train").select("eid", "bin", *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)],
                                             target.alias("_y")).withColumn("_chunk", bin_of("bin", CHUNK_BINS))
    at = ["eid", "_chunk"]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = known.repartition(*at).sortWithinPartitions(*at, "bin").groupBy("eid").agg(
        F.avg("_y").alias("my"), *[F.avg(f"_x{i}").alias(f"m_{i}") for i in range(d)],
        *[F.covar_pop("_y", f"_x{i}").alias(f"c_{i}") for i in range(d)],
        *[F.covar_pop(f"_x{j}", f"_x{i}").alias(f"c_{i}_{j}") for i, j in pairs])
    c = {(i, j): F.col(f"c_{i}_{j}") + (lam if i == j else 0.0) for i, j in pairs}
    if d == 1:
        coef = [F.coalesce(F.try_divide(F.col("c_0"), c[0, 0]), F.lit(0.0))]
    elif d == 2 and lam > 0:
        det = c[0, 0] * c[1, 1] - c[0, 1] * c[0, 1]
        coef = [(F.col("c_0") * c[1, 1] - F.col("c_1") * c[0, 1]) / det,
                (F.col("c_1") * c[0, 0] - F.col("c_0") * c[0, 1]) / det]
    else:
        return _solve_centred(sums, d, lam)
    intercept = F.col("my")
    for i in range(d):
        intercept = intercept - F.col("coef")[i] * F.col(f"m_{i}")
    return sums.withColumn("coef", F.array(*coef)).select("eid", intercept.alias("intercept"), "coef")


def _solve_centred(sums: DataFrame, d: int, lam: float) -> DataFrame:
    ship_package(sums.sparkSession)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mx, cxy = (np.stack([batch[f"{c}_{i}"].to_numpy(float) for i in range(d)], axis=1) for c in "mc")
            cxx = np.empty((len(batch), d, d))
            for i in range(d):
                for j in range(i, d):
                    cxx[:, i, j] = cxx[:, j, i] = batch[f"c_{i}_{j}"].to_numpy(float)
            coef = np.einsum("nij,nj->ni", np.linalg.pinv(cxx + lam * np.eye(d), hermitian=True), cxy)
            yield pd.DataFrame({"eid": batch["eid"], "intercept": batch["my"] - (mx * coef).sum(axis=1), "coef": list(coef)})

    return sums.mapInPandas(solve, f"eid {dict(sums.dtypes)['eid']}, intercept double, coef array<double>")


def predict_per_key(rows: DataFrame, models: DataFrame, xs: Sequence[str],
                    keys: Sequence[str] = ("eid",)) -> DataFrame:
    value = F.col("intercept")
    for i, x in enumerate(xs):
        value = value + F.col("coef")[i] * F.col(x)
    return rows.join(models, list(keys)).withColumn("yhat", value).drop("intercept", "coef")


# --- reduced rank --------------------------------------------------------------------

def shared_basis(models: DataFrame, weights: DataFrame, d: int, rank: int) -> np.ndarray:
    """Leading directions (d x rank) of the stacked per-session coefficients.

    The second moment of the stack is d x d and summed on the cluster; only that
    matrix reaches the driver.
    """
    stacked = models.join(weights, "eid")
    sums = [F.sum(F.col("n") * F.col("coef")[i] * F.col("coef")[j]).alias(f"m_{i}_{j}")
            for i in range(d) for j in range(i, d)]
    found = stacked.agg(*sums).head()
    moment = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            moment[i, j] = moment[j, i] = found[f"m_{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(moment)
    basis = vectors[:, np.argsort(values)[::-1][:rank]]
    # Fix the sign, so that a repeated fit returns the same basis.
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(rank)])
    return basis * np.where(signs == 0, 1.0, signs)


def fit_rrr(split: Split, rows: DataFrame, xs: Sequence[str], y: str, rank: int,
            lam: float) -> DataFrame:
    """Multi-session reduced-rank regression from one Gram per session.

    Per-session ridges are stacked, their leading directions become the shared basis,
    and each session is refit inside it; coefficients return in feature space.
    """
    d = len(xs)
    grams = gram(split.rows(rows, "train"), ["eid"], xs, y)
    first = solve_ridge(grams, ["eid"], d, lam)
    basis = shared_basis(first, grams.select("eid", "n"), d, rank)
    ship_package(rows.sparkSession)

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mx, my, cxx, cxy = _centred(batch, d)
            inner = basis.T @ cxx @ basis + lam * np.eye(rank)
            inverse = np.linalg.pinv(inner, hermitian=True)
            coef = np.einsum("nij,nj->ni", inverse, cxy @ basis) @ basis.T
            yield pd.DataFrame({"eid": batch["eid"], "intercept": my - (mx * coef).sum(axis=1),
                                "coef": list(coef)})

    kind = dict(grams.dtypes)["eid"]
    return grams.mapInPandas(refit, f"eid {kind}, intercept double, coef array<double>")


# --- logistic and Poisson ------------------------------------------------------------

def fit_logistic(split: Split, rows: DataFrame, xs: Sequence[str], y: str, reg: float = 0.0,
                 **options):
    """Binomial or multinomial logistic model on the train rows (Spark ML)."""
    train = VectorAssembler(inputCols=list(xs), outputCol="features").transform(
        split.rows(rows, "train"))
    return LogisticRegression(labelCol=y, regParam=reg, tol=1e-10, maxIter=200, **options).fit(train)


def fit_poisson(split: Split, rows: DataFrame, xs: Sequence[str], y: str):
    """Poisson model with log link on the train rows (Spark ML)."""
    train = VectorAssembler(inputCols=list(xs), outputCol="features").transform(
        split.rows(rows, "train"))
    return GeneralizedLinearRegression(family="poisson", link="log", labelCol=y, tol=1e-10,
                                       maxIter=100).fit(train)


# --- behaviour-only and session baselines ---------------------------------------------

def horizon_line(pairs: DataFrame, predictor: str = "y_now",
                 keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Future behaviour from one current value: per horizon a line fit on train pairs.

    With the default predictor this is the behaviour-only baseline. ``pairs`` has
    part, y_ahead and the predictor; the result is the test pairs with yhat.
    """
    known = pairs.where("part = 'train'").where(F.col(predictor).isNotNull())
    lines = known.groupBy(*keys).agg(
        F.coalesce(slope("y_ahead", predictor), F.lit(0.0)).alias("_slope"),
        F.avg("y_ahead").alias("_my"), F.avg(predictor).alias("_mx"))
    lines = lines.withColumn("_icpt", F.col("_my") - F.col("_slope") * F.col("_mx"))
    return (pairs.where("part = 'test'").join(lines, list(keys))
            .withColumn("yhat", F.col("_icpt") + F.col("_slope") * F.col(predictor))
            .drop("_slope", "_icpt", "_my", "_mx"))


def pool_units(bins: DataFrame, units: DataFrame, spans: DataFrame, regions: Sequence[str],
               value: str = "n") -> DataFrame:
    """Features over the unit axis that no order or number of units can change.

    Per bin of ``spans``: mean, deviation, maximum and sum over all units, and mean per
    region. They come from the sparse counts and the number of units per session, so
    silent units are counted without a row each. A unit with ``mask`` false in ``units``
    contributes nothing.
    """
    live = units.where("mask") if "mask" in units.columns else units
    is_in = {r: F.col("region") == r for r in regions}
    sizes = live.groupBy("eid").agg(
        F.count(F.lit(1)).alias("n_units"),
        *[F.count_if(is_in[r]).alias(f"_n_{r}") for r in regions])
    rows = bins.join(live.select("eid", "unit_id", "region"), ["eid", "unit_id"])
    v = F.col(value).cast("double")
    sums = rows.groupBy("eid", "bin").agg(
        F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.max(v).alias("_m"),
        *[F.sum(F.when(is_in[r], v)).alias(f"_s_{r}") for r in regions])
    zero = F.lit(0.0)
    s, q, n = F.coalesce("_s", zero), F.coalesce("_q", zero), F.col("n_units")
    per_region = [F.try_divide(F.coalesce(f"_s_{r}", zero), F.col(f"_n_{r}")).alias(f"mean_{r}")
                  for r in regions]
    return (session_bins(spans, sizes).join(sums, ["eid", "bin"], "left")
            .select("eid", "bin", "n_units", (s / n).alias("mean"),
                    (F.sqrt(F.greatest(n * q - s * s, zero)) / n).alias("std"),
                    F.coalesce("_m", zero).alias("max"), s.alias("sum"), *per_region))


def slot_units(bins: DataFrame, units: DataFrame, spans: DataFrame, slots: int, order: Column | str = "unit_id",
               value: str = "n") -> DataFrame:
    """Features that depend on the order of units: one slot per unit of a session, then the rest, then a mask.

    Live units of a session take slots 1, 2, ... by ``order``, ties by unit_id; those beyond the last slot
    are summed in one more value, so none is lost. ``x`` holds ``slots`` + 1 values and ``slots`` flags that
    tell a silent unit from an empty slot. It is made from the sparse counts, as in ``pool_units``.
    """
    live = units.where("mask") if "mask" in units.columns else units
    rank = F.row_number().over(Window.partitionBy("eid").orderBy(order, "unit_id"))
    placed = live.select("eid", "unit_id", F.least(rank, F.lit(slots + 1)).alias("_slot"))
    sizes = placed.groupBy("eid").agg(F.count(F.lit(1)).alias("n_units"))
    v = F.col(value).cast("double")
    sums = (bins.join(placed, ["eid", "unit_id"]).groupBy("eid", "bin", "_slot").agg(F.sum(v).alias("_v"))
            .groupBy("eid", "bin").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_v"))).alias("_held")))
    zero = F.lit(0.0)
    held = F.transform(F.sequence(F.lit(1), F.lit(slots + 1)),
                       lambda i: F.coalesce(F.try_element_at("_held", i), zero))
    mask = F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: (F.col("n_units") >= i).cast("double"))
    return (session_bins(spans, sizes).join(sums, ["eid", "bin"], "left")
            .select("eid", "bin", "n_units", F.concat(held, mask).alias("x")))


def invariance_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two pooled tables per session, unmatched rows counted."""
    features = [c for c in a.columns if c not in ("eid", "bin")]
    both = a.alias("a").join(b.alias("b"), ["eid", "bin"], "full")
    gaps = [F.abs(F.coalesce(F.col(f"a.{c}"), F.lit(0)) - F.coalesce(F.col(f"b.{c}"), F.lit(0)))
            for c in features]
    unmatched = F.col("a.n_units").isNull() | F.col("b.n_units").isNull()
    return both.groupBy("eid").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(unmatched).alias("n_unmatched"),
        F.max(F.greatest(*gaps)).alias("max_gap"))


def session_offsets(train: DataFrame, model: LinearModel) -> DataFrame:
    """Mean residual of each known session under a shared slope."""
    return train.groupBy("eid", "lab").agg(F.avg(F.col("y") - model.score()).alias("offset"))


def offset_costs(test: DataFrame, offsets: DataFrame, model: LinearModel) -> DataFrame:
    """Squared error of three policies for a session never seen in training.

    zero: no offset; average: mean offset of the known sessions; inferred: mean offset
    of the known sessions of the same lab, or the average where the lab is new.
    """
    average = offsets.agg(F.avg("offset")).head()[0] or 0.0
    labs = offsets.groupBy("lab").agg(F.avg("offset").alias("_lab_offset"))
    inferred = F.coalesce("_lab_offset", F.lit(average))
    policies = F.explode(F.map_from_arrays(
        F.array(*[F.lit(p) for p in ("zero", "average", "inferred")]),
        F.array(F.lit(0.0), F.lit(average), inferred))).alias("policy", "offset")
    scored = test.join(labs, "lab", "left").select("eid", "y", model.score().alias("_base"), policies)
    err = F.col("y") - F.col("_base") - F.col("offset")
    return scored.groupBy("policy").agg(F.count(F.lit(1)).alias("n"),
                                        F.sqrt(F.avg(err * err)).alias("rmse"))
