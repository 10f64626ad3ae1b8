"""Registered queries: k-NN imputation, simple imputation, the fitted
preprocessor (SURVEY 2.9 I1-I3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from .common import r6, table
from .registry import register

_SRC = """c_custkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x0,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS x1,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 13 AS DOUBLE) END AS x2"""


def _need(i):
    return f"""c{i} AS (SELECT k, avg(d{i}) AS v FROM (
      SELECT *, row_number() OVER (PARTITION BY k ORDER BY floor(dist * 1e9 + 0.5), dk) AS rn FROM dd WHERE r{i} IS NULL AND d{i} IS NOT NULL)
      WHERE rn <= 5 GROUP BY k)"""


def _sq(i):
    return f"COALESCE((r.z{i} - d.z{i}) * (r.z{i} - d.z{i}), 0)"


def _has(i):
    return f"(CASE WHEN r.z{i} IS NOT NULL AND d.z{i} IS NOT NULL THEN 1 ELSE 0 END)"


@register("knn_impute", f"""
WITH t AS (SELECT {_SRC} FROM customer),
s AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1,
             avg(x2) AS m2, stddev_pop(x2) AS s2 FROM t),
z AS (SELECT c_custkey AS k, x0, x1, x2, (x0 - m0) / s0 AS z0, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM t, s),
pr AS (SELECT r.k, d.k AS dk, r.x0 AS r0, r.x1 AS r1, r.x2 AS r2, d.x0 AS d0, d.x1 AS d1, d.x2 AS d2,
              {_sq(0)} + {_sq(1)} + {_sq(2)} AS ss, {_has(0)} + {_has(1)} + {_has(2)} AS m
       FROM z r JOIN z d ON r.k <> d.k WHERE r.x0 IS NULL OR r.x1 IS NULL OR r.x2 IS NULL),
dd AS (SELECT *, sqrt(ss) * sqrt(3.0 / m) AS dist FROM pr WHERE m > 0),
{_need(0)}, {_need(1)}, {_need(2)}
SELECT z.k AS c_custkey, round(COALESCE(z.x0, c0.v, s.m0), 6) AS x0, round(COALESCE(z.x1, c1.v, s.m1), 6) AS x1,
       round(COALESCE(z.x2, c2.v, s.m2), 6) AS x2
FROM z CROSS JOIN s LEFT JOIN c0 ON c0.k = z.k LEFT JOIN c1 ON c1.k = z.k LEFT JOIN c2 ON c2.k = z.k
""")
def q_knn_impute(spark, sf):
    c = table(spark, sf, "customer").selectExpr(*[x.strip() for x in _SRC.split(",\n")])
    out = I.knn_impute(c, "c_custkey", ["x0", "x1", "x2"], k=5)
    return out.select("c_custkey", *[r6(x).alias(x) for x in ["x0", "x1", "x2"]])


@register("simple_impute", f"""
WITH t AS (SELECT {_SRC} FROM customer)
SELECT c_custkey, round(COALESCE(x0, (SELECT median(x0) FROM t)), 6) AS x0,
       round(COALESCE(x1, (SELECT median(x1) FROM t)), 6) AS x1, round(COALESCE(x2, 0), 6) AS x2 FROM t
""")
def q_simple_impute(spark, sf):
    c = table(spark, sf, "customer").selectExpr(*[x.strip() for x in _SRC.split(",\n")])
    out = I.simple_impute(I.simple_impute(c, ["x0", "x1"], "median"), ["x2"], "zero")
    return out.select("c_custkey", *[r6(x).alias(x) for x in ["x0", "x1", "x2"]])


@register("preprocess_transform")
def q_preprocess_transform(spark, sf):
    """Fit on the customers of even keys, apply to all: impute, round the
    integer-like columns, derive a ratio, drop its input, canonical order."""
    c = table(spark, sf, "customer").selectExpr(*[x.strip() for x in _SRC.split(",\n")])
    pre = I.Preprocessor("c_custkey", ["x0", "x1", "x2"], k=5, ratios=[("x0", "x2", "x0_over_x2")], drop=["x0"],
                         order=["x1", "x2", "x0_over_x2", "x_absent"]).fit(c.filter(F.col("c_custkey") % 2 == 0))
    out = pre.transform(c)
    return out.select(*[r6(x).alias(x) if x != "c_custkey" else F.col(x) for x in out.columns])
