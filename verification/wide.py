"""Fits on 64 features against iterations spelled out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from truegauge.operators import moments, softmax
from verification.bindings import Tables
from verification.ctes import cte, sql
from verification.modelling import LAM
from verification.registry import query, r6, rounded

D, CLASSES, SESSIONS = 64, 3, 5
#: Steps of the SQL side and their lengths; the features' covariance is far below the penalty.
RIDGE_STEPS, RIDGE_RATE = 40, 6.0
SOFTMAX_STEPS, STEP_W, STEP_B = 60, 5.0, 2.0

cte("wide", ("vectors",), f"""
SELECT eid, (eid % {SESSIONS})::BIGINT AS g, part, y, y % {CLASSES} AS cls, x::DOUBLE[] AS x FROM vectors""")
cte("wide_long", ("wide",), """
SELECT g, eid, y, j, v - avg(v) OVER (PARTITION BY g, j) AS v, avg(v) OVER (PARTITION BY g, j) AS m FROM (
  SELECT g, eid, y, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM wide WHERE part = 'train')""")
cte("wide_all", ("wide_long",), """
SELECT eid, y, j, v - avg(v) OVER (PARTITION BY j) AS v, avg(v) OVER (PARTITION BY j) AS m FROM (
  SELECT eid, y, j, v + m AS v FROM wide_long)""")


def ridge_chain(name: str, source: str, key: str) -> None:
    """CTEs of gradient steps to the ridge solution per key, the last one named ``name`` (key, n, my, mx, b)."""
    on = f"b.{key} = a.{key} AND b.eid = a.eid"
    cte(f"{name}_c", (source,), f"""
SELECT {key}, j, list(c ORDER BY l) AS row FROM (
  SELECT a.{key}, a.j, b.j AS l, avg(a.v * b.v) AS c FROM {source} a JOIN {source} b ON {on} GROUP BY ALL)
GROUP BY {key}, j""")
    cte(f"{name}_y", (source,), f"SELECT {key}, j, covar_pop(v, y) AS cxy, any_value(m) AS m, count(*) AS n, "
        f"avg(y) AS my FROM {source} GROUP BY {key}, j")
    cte(f"{name}_0", (f"{name}_y",), f"SELECT {key}, list(0.0::DOUBLE ORDER BY j) AS b FROM {name}_y GROUP BY {key}")
    for i in range(RIDGE_STEPS):
        cte(f"{name}_{i + 1}", (f"{name}_{i}", f"{name}_c", f"{name}_y"), f"""
SELECT {key}, list(b[j] + {RIDGE_RATE} * (cxy - list_dot_product(row, b) - {LAM} * b[j]) ORDER BY j) AS b
FROM {name}_{i} JOIN {name}_c USING ({key}) JOIN {name}_y USING ({key}, j) GROUP BY {key}""")
    cte(name, (f"{name}_{RIDGE_STEPS}", f"{name}_y"), f"""
SELECT {key}, any_value(n) AS n, any_value(my) AS my, list(m ORDER BY j) AS mx, any_value(b) AS b
FROM {name}_{RIDGE_STEPS} JOIN {name}_y USING ({key}) GROUP BY {key}""")


cte("wide_one", ("wide_all",), "SELECT 0 AS one, * FROM wide_all")
ridge_chain("wide_ridge", "wide_one", "one")
ridge_chain("wide_each", "wide_long", "g")


def rows(t: Tables):
    return t.vectors.select("eid", (F.col("eid") % SESSIONS).alias("g"), "part", "y",
                            (F.col("y") % CLASSES).alias("cls"), "x")


@query("h01_ridge_wide", sql("wide wide_ridge", """
SELECT eid, y, round(my + list_dot_product(x, b) - list_dot_product(mx, b), 6) AS yhat
FROM wide, wide_ridge WHERE part = 'test'"""))
def _(t: Tables):
    intercept, coef = moments.ridge(rows(t).where("part = 'train'"), "x", "y", LAM)
    line = F.lit(intercept) + moments.dot("x", F.array(*[F.lit(float(c)) for c in coef]))
    return rows(t).where("part = 'test'").select("eid", "y", r6(line).alias("yhat"))


@query("h05_per_session_wide", sql("wide_each", """
SELECT g, round(my - list_dot_product(mx, b), 6) AS intercept, round(b[1], 6) AS b1, round(b[2], 6) AS b2,
       round(b[64], 6) AS b64, round(sqrt(list_dot_product(b, b)), 6) AS norm FROM wide_each"""))
def _(t: Tables):
    parts = moments.moments(rows(t).where("part = 'train'"), ["g"], "x", "y")
    return shown(moments.ridges(parts, ["g"], LAM))


def shown(models):
    at = lambda i: F.col("coef")[i]
    return rounded(models.select("g", "intercept", at(0).alias("b1"), at(1).alias("b2"), at(63).alias("b64"),
                                 F.sqrt(moments.dot("coef", "coef")).alias("norm")), "intercept", "b1", "b2", "b64", "norm")


# The leading direction of the stacked coefficients, by squaring their second moment again and again.
cte("stack_0", ("wide_each",), """
SELECT i, j, sum(n * b[i] * b[j]) AS v FROM wide_each, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j)
GROUP BY i, j""")
for _i in range(14):
    cte(f"stack_{_i + 1}", (f"stack_{_i}",), f"""
SELECT i, j, v / (sum(CASE WHEN i = j THEN v END) OVER ()) AS v FROM (
  SELECT a.i, b.j, sum(a.v * b.v) AS v FROM stack_{_i} a JOIN stack_{_i} b ON b.i = a.j GROUP BY a.i, b.j)""")
cte("wide_basis", ("stack_14",), """
SELECT list(v / norm ORDER BY i) AS v FROM (
  SELECT i, v, sqrt(sum(v * v) OVER ()) AS norm FROM stack_14
  WHERE j = (SELECT i FROM stack_14 WHERE i = j ORDER BY v DESC LIMIT 1))""")


@query("h04_reduced_rank_wide", sql("wide wide_basis", f"""
SELECT g, round(my - s * mz, 6) AS intercept, round(s * v[1], 6) AS b1, round(s * v[2], 6) AS b2, round(s * v[64], 6) AS b64,
       round(abs(s), 6) AS norm FROM (
  SELECT g, any_value(v) AS v, avg(y) AS my, avg(z) AS mz, covar_pop(y, z) / (var_pop(z) + {LAM}) AS s FROM (
    SELECT g, y, v, list_dot_product(x, v) AS z FROM wide, wide_basis WHERE part = 'train') GROUP BY g)"""))
def _(t: Tables):
    parts = moments.moments(rows(t).where("part = 'train'"), ["g"], "x", "y")
    return shown(moments.reduced_rank(parts, ["g"], 1, LAM))


cte("soft_0", (), f"SELECT unnest(range({CLASSES})) AS k, 0.0::DOUBLE AS b, list_transform(range({D}), lambda i: 0.0::DOUBLE) AS w")
for _i in range(SOFTMAX_STEPS):
    cte(f"soft_p{_i}", (f"soft_{_i}", "wide"), f"""
SELECT k, x, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY eid) - (cls = k)::INT AS e FROM (
  SELECT *, max(s) OVER (PARTITION BY eid) AS m FROM (
    SELECT eid, x, cls, k, b + list_dot_product(x, w) AS s FROM wide, soft_{_i} WHERE part = 'train'))""")
    cte(f"soft_{_i + 1}", (f"soft_p{_i}", f"soft_{_i}"), f"""
SELECT k, any_value(b) - {STEP_B} * any_value(gb) AS b, list(w[j] - {STEP_W} * (g + {LAM} * w[j]) ORDER BY j) AS w FROM (
  SELECT k, j, avg(e * v) AS g, avg(e) AS gb FROM (
    SELECT k, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM soft_p{_i}) GROUP BY k, j)
JOIN soft_{_i} USING (k) GROUP BY k""")


@query("h02_multinomial", sql(f"wide soft_{SOFTMAX_STEPS}", f"""
SELECT eid, cls, round(max(p) FILTER (WHERE k = 0), 5) AS p0, round(max(p) FILTER (WHERE k = 1), 5) AS p1,
       round(max(p) FILTER (WHERE k = 2), 5) AS p2, arg_max(k, p)::BIGINT AS guess FROM (
  SELECT eid, cls, k, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY eid) AS p FROM (
    SELECT *, max(s) OVER (PARTITION BY eid) AS m FROM (
      SELECT eid, cls, k, b + list_dot_product(x, w) AS s FROM wide, soft_{SOFTMAX_STEPS} WHERE part = 'test')))
GROUP BY eid, cls"""))
def _(t: Tables):
    """Three classes from 64 features; the SQL side takes plain gradient steps from zero."""
    model = softmax.fit_softmax(rows(t).where("part = 'train'"), "x", "cls", CLASSES, LAM)
    scored = rows(t).where("part = 'test'").withColumn("p", model.probabilities("x"))
    return scored.select("eid", "cls", *[F.round(F.col("p")[k], 5).alias(f"p{k}") for k in range(CLASSES)],
                         (F.array_position("p", F.array_max("p")) - 1).cast("bigint").alias("guess"))
