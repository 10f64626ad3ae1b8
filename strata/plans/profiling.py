"""Registered queries: profiling, ranks, sort/limit/union."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import ranks as K
from .common import r6, sql_expr, table
from .prep import _split
from .registry import register

_LI_NULLS = """CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax"""
_NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li_nulls(spark, sf, *extra):
    return table(spark, sf, "lineitem").selectExpr(*extra, *_split(_LI_NULLS))


def _describe_sql(c):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM t")


@register("describe_numeric", f"""
WITH t AS (SELECT {_LI_NULLS} FROM lineitem)
{' UNION ALL '.join(_describe_sql(c) for c in _NUM_COLS)}
""")
def q_describe_numeric(spark, sf):
    d = P.describe_numeric(_li_nulls(spark, sf), _NUM_COLS)
    return d.select("column", "count", *[r6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


_CAT = """l_returnflag, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus,
  CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class"""


@register("describe_categorical", f"""
WITH t AS (SELECT {_CAT} FROM lineitem),
u AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM t UNION ALL
      SELECT 'l_linestatus', l_linestatus FROM t UNION ALL SELECT 'size_class', size_class FROM t),
c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM c)
SELECT "column", sum(n) AS count, count(*) AS "unique", max(CASE WHEN rn = 1 THEN value END) AS top,
       max(CASE WHEN rn = 1 THEN n END) AS freq FROM r GROUP BY 1
""")
def q_describe_categorical(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(*_split(_CAT))
    return P.describe_categorical(li, ["l_returnflag", "l_linestatus", "size_class"])


@register("table_info", """
WITH n AS (SELECT count(*) AS n_rows, count(p_partkey) AS c0, count(p_name) AS c1, count(p_brand) AS c2,
                  count(p_type) AS c3, count(p_size) AS c4, count(p_retailprice) AS c5 FROM part)
SELECT * FROM (
  SELECT 0 AS position, 'p_partkey' AS "column", 'bigint' AS dtype, c0 AS non_null, n_rows FROM n UNION ALL
  SELECT 1, 'p_name', 'string', c1, n_rows FROM n UNION ALL
  SELECT 2, 'p_brand', 'string', c2, n_rows FROM n UNION ALL
  SELECT 3, 'p_type', 'string', c3, n_rows FROM n UNION ALL
  SELECT 4, 'p_size', 'int', c4, n_rows FROM n UNION ALL
  SELECT 5, 'p_retailprice', 'double', c5, n_rows FROM n)
""")
def q_table_info(spark, sf):
    return P.table_info(table(spark, sf, "part"))


@register("null_profile", f"""
WITH t AS (SELECT {_LI_NULLS} FROM lineitem)
{' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
                    f"round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct_null FROM t" for c in _NUM_COLS)}
""")
def q_null_profile(spark, sf):
    p = P.null_profile(_li_nulls(spark, sf), _NUM_COLS)
    return p.select("column", "n_null", r6("pct_null").alias("pct_null"))


_ORD_NULLS = """o_custkey, o_orderkey, o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderdate END AS odate"""


@register("null_share_per_row", f"""
WITH t AS (SELECT {_ORD_NULLS} FROM orders),
r AS (SELECT o_custkey, ((CASE WHEN price IS NULL THEN 1 ELSE 0 END) + (CASE WHEN status IS NULL THEN 1 ELSE 0 END)
        + (CASE WHEN odate IS NULL THEN 1 ELSE 0 END)) / 3.0 AS s,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM t)
SELECT o_custkey, round(s, 6) AS null_share FROM r WHERE rn = 1
""")
def q_null_share_per_row(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*_split(_ORD_NULLS))
    r = P.null_share_per_row(o, ["price", "status", "odate"], "o_custkey", "o_orderkey")
    return r.select("o_custkey", r6("null_share").alias("null_share"))


@register("null_share_per_group", f"""
WITH t AS (SELECT {_ORD_NULLS} FROM orders)
SELECT o_orderpriority, round((avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END)
  + avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN odate IS NULL THEN 1.0 ELSE 0.0 END)) / 3, 6)
  AS null_share FROM t GROUP BY 1
""")
def q_null_share_per_group(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*_split(_ORD_NULLS)).select("o_orderpriority", "price", "status", "odate")
    r = P.null_share_per_group(o, "o_orderpriority")
    return r.select("o_orderpriority", r6("null_share").alias("null_share"))


@register("value_counts", """
SELECT l_returnflag, count(*) AS count, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share
FROM lineitem GROUP BY 1
""")
def q_value_counts(spark, sf):
    vc = P.value_counts(table(spark, sf, "lineitem"), "l_returnflag", normalize=True)
    return vc.select("l_returnflag", "count", r6("share").alias("share"))


@register("value_counts_with_null", """
SELECT st AS o_orderstatus, count(*) AS count FROM (
  SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders) GROUP BY 1
""")
def q_value_counts_with_null(spark, sf):
    o = table(spark, sf, "orders").select(
        sql_expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END").alias("o_orderstatus"))
    return P.value_counts(o, "o_orderstatus", dropna=False)


@register("crosstab", """
SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS "F",
       round(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / count(*), 6) AS "O",
       round(sum(CASE WHEN l_linestatus = 'X' THEN 1 ELSE 0 END) / count(*), 6) AS "X"
FROM lineitem GROUP BY 1
""")
def q_crosstab(spark, sf):
    ct = P.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O", "X"], normalize=True)
    return ct.select("l_returnflag", *[r6(c).alias(c) for c in ["F", "O", "X"]])


@register("group_median", """
SELECT event_type, round(median(value), 6) AS value, round(median(user_id), 6) AS user_id FROM events GROUP BY 1
""")
def q_group_median(spark, sf):
    m = P.group_median(table(spark, sf, "events"), "event_type", ["value", "user_id"])
    return m.select("event_type", r6("value").alias("value"), r6("user_id").alias("user_id"))


@register("visits_per_subject", """
SELECT visits, count(*) AS subjects FROM (SELECT user_id, count(*) AS visits FROM events GROUP BY 1) GROUP BY 1
""")
def q_visits_per_subject(spark, sf):
    hist, _ = P.visits_per_subject(table(spark, sf, "events"), "user_id")
    return hist


@register("visits_summary", """
SELECT count(*) AS subjects, round(avg(visits), 6) AS mean_visits, round(stddev_samp(visits), 6) AS std_visits,
       min(visits) AS min_visits, max(visits) AS max_visits
FROM (SELECT user_id, count(*) AS visits FROM events GROUP BY 1)
""")
def q_visits_summary(spark, sf):
    _, s = P.visits_per_subject(table(spark, sf, "events"), "user_id")
    return s.select("subjects", r6("mean_visits").alias("mean_visits"), r6("std_visits").alias("std_visits"),
                    "min_visits", "max_visits")


@register("filtered_value_counts", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2
""")
def q_filtered_value_counts(spark, sf):
    return P.filtered_value_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("correlation_matrix", f"""
WITH t AS (SELECT {_LI_NULLS} FROM lineitem)
{' UNION ALL '.join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM t" for a, b in _pairs(_NUM_COLS))}
""")
def q_correlation_matrix(spark, sf):
    c = P.correlation_matrix(_li_nulls(spark, sf), _NUM_COLS, "pearson")
    return c.select("x", "y", r6("corr").alias("corr"))


_SP_COLS = ["l_quantity", "l_discount", "l_tax"]


def _spearman_sql(a, b):
    return (f"SELECT '{a}' AS x, '{b}' AS y, round(corr(rx, ry), 6) AS corr FROM ("
            f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS rx, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS ry "
            f"FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@register("spearman_correlation", f"""
WITH t AS (SELECT {_LI_NULLS} FROM lineitem)
{' UNION ALL '.join(_spearman_sql(a, b) for a, b in _pairs(_SP_COLS))}
""")
def q_spearman_correlation(spark, sf):
    c = P.correlation_matrix(_li_nulls(spark, sf), _SP_COLS, "spearman")
    return c.select("x", "y", r6("corr").alias("corr"))


_KT_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _kendall_sql(a, b):
    """All couples of distinct value pairs with their counts."""
    return f"""SELECT '{a}' AS x, '{b}' AS y, round((sum(n * m) FILTER (s > 0) - sum(n * m) FILTER (s < 0)) / (sqrt(sum(n * m) FILTER (x1 <> x2)) * sqrt(sum(n * m) FILTER (y1 <> y2))), 6) AS corr FROM (
 SELECT p.vx AS x1, q.vx AS x2, p.vy AS y1, q.vy AS y2, p.n::DOUBLE AS n, q.n::DOUBLE AS m, sign(p.vx - q.vx) * sign(p.vy - q.vy) AS s
 FROM (SELECT {a} AS vx, {b} AS vy, count(*) AS n FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) p,
      (SELECT {a} AS vx, {b} AS vy, count(*) AS n FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) q)"""


@register("kendall_correlation", f"""
WITH t AS (SELECT {_LI_NULLS}, l_linenumber FROM lineitem)
{' UNION ALL '.join(_kendall_sql(a, b) for a, b in _pairs(_KT_COLS))}
""")
def q_kendall_correlation(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(*_split(_LI_NULLS), "l_linenumber")
    c = P.correlation_matrix(t, _KT_COLS, "kendall")
    return c.select("x", "y", r6("corr").alias("corr"))


@register("kendall_wide_range", """
WITH t AS (SELECT c_acctbal AS a, c_custkey % 997 AS b FROM customer)
SELECT 'a' AS x, 'b' AS y, round((sum(s) FILTER (s > 0) + sum(s) FILTER (s < 0)) / (sqrt(count(*) FILTER (x1 <> x2)) * sqrt(count(*) FILTER (y1 <> y2))), 6) AS corr
FROM (SELECT p.a AS x1, q.a AS x2, p.b AS y1, q.b AS y2, sign(p.a - q.a) * sign(p.b - q.b) AS s FROM t p, t q)
""")
def q_kendall_wide_range(spark, sf):
    """A12 where almost every value stands once."""
    t = table(spark, sf, "customer").select(F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 997).alias("b"))
    return P.correlation_matrix(t, ["a", "b"], "kendall").select("x", "y", r6("corr").alias("corr"))


@register("pair_correlation", """
SELECT round(corr(o_totalprice, o_custkey), 6) AS corr FROM orders
""")
def q_pair_correlation(spark, sf):
    return table(spark, sf, "orders").agg(r6(F.corr("o_totalprice", "o_custkey")).alias("corr"))


_CUST = """c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 4 = 0 OR c_mktsegment = 'FURNITURE' THEN NULL ELSE c_acctbal END AS acctbal"""


@register("impute_mean_by_class", f"""
WITH t AS (SELECT {_CUST} FROM customer),
m AS (SELECT segment, avg(acctbal) AS m FROM t WHERE segment IS NOT NULL GROUP BY 1),
g AS (SELECT avg(acctbal) AS g FROM t)
SELECT c_custkey, t.segment, round(CASE WHEN t.segment IS NULL THEN acctbal
                                        ELSE COALESCE(acctbal, m.m, g.g) END, 6) AS acctbal
FROM t LEFT JOIN m ON m.segment = t.segment, g
""")
def q_impute_mean_by_class(spark, sf):
    c = table(spark, sf, "customer").selectExpr(*_split(_CUST))
    out = P.impute_mean_by_class(c, ["acctbal"], "segment")
    return out.select("c_custkey", "segment", r6("acctbal").alias("acctbal"))


@register("drop_duplicate_rows", """
SELECT l_returnflag, l_linestatus, l_quantity, min(l_orderkey * 100 + l_linenumber) AS row_id
FROM lineitem GROUP BY 1, 2, 3
""")
def q_drop_duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity",
                                             (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"))
    return P.drop_duplicate_rows(li, exclude=["row_id"])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("pivot_metric", f"""
SELECT user_id, {', '.join(f"round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}" for t in _TYPES)}
FROM events GROUP BY 1
""")
def q_pivot_metric(spark, sf):
    long = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean_value"))
    pv = P.pivot_metric(long, "user_id", "event_type", "mean_value", _TYPES)
    return pv.select("user_id", *[r6(t).alias(t) for t in _TYPES])


@register("year_counts", """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS count FROM lineitem GROUP BY 1
""")
def q_year_counts(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("string").alias("d"))
    return P.year_counts(li, "d").select(F.col("year").cast("bigint").alias("year"), "count")


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@register("class_distribution", f"""
WITH spine AS (SELECT * FROM (VALUES {', '.join(f"('{p}', {i})" for i, p in enumerate(_PRIO))}) s(o_orderpriority, position)),
c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT position, spine.o_orderpriority, COALESCE(n, 0) AS count,
       round(100.0 * COALESCE(n, 0) / (SELECT count(*) FROM orders), 6) AS pct
FROM spine LEFT JOIN c USING (o_orderpriority)
""")
def q_class_distribution(spark, sf):
    d = P.class_distribution(table(spark, sf, "orders"), "o_orderpriority", _PRIO)
    return d.select(F.col("position").cast("int"), "o_orderpriority", "count", r6("pct").alias("pct"))


@register("ordered_category", f"""
SELECT o_orderkey, CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_PRIO[::-1]))} END
       AS position FROM orders
""")
def q_ordered_category(spark, sf):
    from ..operators.recode import ordered_category
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ordered_category(o, "o_orderpriority", _PRIO[::-1]).select("o_orderkey", "position")


# ------------------------------------------------------------------ windows / ranks

@register("average_rank", """
SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
       + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events
""")
def q_average_rank(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    return K.average_rank(ev, "value", "event_type").select("event_id", "rank")


@register("average_rank_global", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem
""")
def q_average_rank_global(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return K.average_rank(li, "l_quantity").drop("l_quantity")


@register("stratified_rank", """
SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey)) AS rank
FROM customer
""")
def q_stratified_rank(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return K.seeded_rank(c, 42, "c_custkey", "c_mktsegment")


@register("sort_values", """
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer
""")
def q_sort_values(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", r6("c_acctbal").alias("c_acctbal"))
    return P.sort_values(c, ["c_acctbal", "c_custkey"], [False, True])


@register("head_n", """
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10
""")
def q_head_n(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", r6("c_acctbal").alias("c_acctbal"))
    return P.sort_values(c, ["c_acctbal", "c_custkey"], [False, True]).limit(10)


@register("shuffle_rows", """
SELECT c_custkey, c_mktsegment FROM customer
""")
def q_shuffle_rows(spark, sf):
    return P.shuffle_rows(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 42)


@register("sample_n", """
SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100
""")
def q_sample_n(spark, sf):
    return P.sample_n(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 100, 42)


@register("union_rows", """
SELECT s_suppkey AS key, s_nationkey AS nationkey, round(s_acctbal, 6) AS acctbal, NULL AS segment FROM supplier
UNION ALL
SELECT c_custkey, c_nationkey, round(c_acctbal, 6), c_mktsegment FROM customer
""")
def q_union_rows(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nationkey"),
                                           r6("s_acctbal").alias("acctbal"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nationkey"),
                                           r6("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return P.union_rows(s, c)
