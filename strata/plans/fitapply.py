"""Registered queries: scaling/encoding/binning, outliers, splits, chart data
(SURVEY 2.8, 2.10 O1-O3, 2.11, 2.18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chartdata as D
from ..operators import encode as N
from ..operators import outliers as O
from ..operators import resample as RS
from .common import r6, sql_expr, table
from .registry import register


def _scale_sql(center: str, scale: str) -> str:
    return f"""
WITH s AS (SELECT {center.format(c='c_acctbal')} AS ca, {scale.format(c='c_acctbal')} AS sa,
                  {center.format(c='c_nationkey')} AS cn, {scale.format(c='c_nationkey')} AS sn FROM customer)
SELECT c_custkey, round((c_acctbal - ca) / CASE WHEN sa = 0 OR sa IS NULL THEN 1 ELSE sa END, 6) AS c_acctbal,
       round((c_nationkey - cn) / CASE WHEN sn = 0 OR sn IS NULL THEN 1 ELSE sn END, 6) AS c_nationkey
FROM customer, s"""


def _scaled(spark, sf, fn):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = fn(c, ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"), r6("c_nationkey").alias("c_nationkey"))


@register("min_max_scale", _scale_sql("min({c})", "max({c}) - min({c})"))
def q_min_max_scale(spark, sf):
    return _scaled(spark, sf, N.min_max_scale)


@register("z_score_scale", _scale_sql("avg({c})", "stddev_pop({c})"))
def q_z_score_scale(spark, sf):
    return _scaled(spark, sf, N.z_score_scale)


@register("robust_scale", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def q_robust_scale(spark, sf):
    return _scaled(spark, sf, N.robust_scale)


_BRAND = "p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type"


@register("label_encode", f"""
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY COALESCE(p_brand, 'nan')) - 1 AS INTEGER) AS p_brand,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type
FROM (SELECT {_BRAND} FROM part)
""")
def q_label_encode(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_brand END AS p_brand",
                                            "p_type")
    return N.label_encode(p, ["p_brand", "p_type"])


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot_encode", f"""
SELECT c_custkey, {', '.join(f"CAST(CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS DOUBLE) AS c_mktsegment_{s}" for s in _SEGS[1:])}
FROM customer
""")
def q_one_hot_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return N.one_hot_encode(c, ["c_mktsegment"], drop_first=True)


_PRIOS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@register("ordinal_encode", f"""
SELECT o_orderkey,
  CASE o_orderpriority {' '.join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_PRIOS))} END AS o_orderpriority,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 0 END AS o_orderstatus
FROM orders
""")
def q_ordinal_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    a = N.ordinal_encode(o, ["o_orderpriority"], categories=[_PRIOS])
    return N.ordinal_encode(a, ["o_orderstatus"], mapping={"o_orderstatus": {"F": 2, "O": 0}})


def _ladder_sql(x: str, edges: list[str], lowest: str | None) -> str:
    parts = []
    for i in range(len(edges) - 1):
        cond = f"{x} <= {edges[i + 1]}"
        if i == 0 and lowest is not None:
            cond = f"{x} >= {lowest} AND " + cond
        parts.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


_W_EDGES = ["e0"] + [f"lo + {i} * ((hi - lo) / 10)" for i in range(1, 10)] + ["hi"]


@register("equal_width_bins", f"""
WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
e AS (SELECT lo, hi, lo - (hi - lo) * 0.001 AS e0 FROM s)
SELECT c_custkey, {_ladder_sql('c_acctbal', _W_EDGES, None)} AS bin FROM customer, e
""")
def q_equal_width_bins(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out, _ = N.equal_width_bins(c, "c_acctbal", 10, out="bin")
    return out.select("c_custkey", "bin")


_Q_EDGES = [f"q[{i + 1}]" for i in range(5)]


@register("equal_frequency_bins", f"""
WITH s AS (SELECT quantile_cont(p_retailprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM part)
SELECT p_partkey, CASE {' '.join(f"WHEN p_retailprice {'>= q[1] AND p_retailprice ' if i == 0 else ''}<= q[{i + 2}] THEN '{lab}'"
                                for i, lab in enumerate(['low', 'mid-low', 'mid-high', 'high']))} END AS price_band
FROM part, s
""")
def q_equal_frequency_bins(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    out, _ = N.equal_frequency_bins(p, "p_retailprice", 4, labels=["low", "mid-low", "mid-high", "high"], out="price_band")
    return out.select("p_partkey", "price_band")


_C_EDGES = [0, 10, 20, 30, 40]


@register("custom_bins", f"""
SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'Missing' ELSE
  {_ladder_sql('p_size', [str(e) for e in _C_EDGES], '0').replace('THEN 0', "THEN 'xs'").replace('THEN 1', "THEN 's'")
   .replace('THEN 2', "THEN 'm'").replace('THEN 3', "THEN 'l'")} END AS size_band
FROM (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS p_size FROM part)
""")
def q_custom_bins(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS p_size")
    out = N.custom_bins(p, "p_size", _C_EDGES, labels=["xs", "s", "m", "l"], handle_na="separate", out="size_band")
    return out.select("p_partkey", "size_band")


@register("bin_summary", f"""
WITH b AS (SELECT p_size, {_ladder_sql('p_size', [str(e) for e in _C_EDGES], '0')} AS bin FROM part),
s AS (SELECT bin, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS pct,
             min(p_size) AS min, max(p_size) AS max FROM b GROUP BY 1),
d AS (SELECT DISTINCT bin, p_size FROM b),
x AS (SELECT bin, array_to_string(list(p_size ORDER BY p_size), ',') AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY bin ORDER BY p_size) AS rn FROM d) WHERE rn <= 5 GROUP BY 1)
SELECT s.bin, count, pct, min, max, examples FROM s LEFT JOIN x ON x.bin IS NOT DISTINCT FROM s.bin
""")
def q_bin_summary(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    binned = N.custom_bins(p, "p_size", _C_EDGES, out="bin")
    s = N.bin_summary(binned, "p_size", "bin")
    return s.select("bin", "count", r6("pct").alias("pct"), "min", "max", F.array_join("examples", ",").alias("examples"))


# ------------------------------------------------------------------ outliers O1-O3

@register("iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT 'value' AS "column", event_id, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper
FROM events, b WHERE value < lower OR value > upper
""")
def q_iqr_outliers(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    o = O.iqr_outliers(ev, "event_id", ["value"])
    return o.select("column", "event_id", r6("value").alias("value"), r6("lower").alias("lower"), r6("upper").alias("upper"))


@register("iqr_outliers_by_group", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
b AS (SELECT event_type, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT e.event_type, 'value' AS "column", event_id, round(value, 6) AS value FROM events e JOIN b USING (event_type)
WHERE value < lower OR value > upper
""")
def q_iqr_outliers_by_group(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    o = O.iqr_outliers(ev, "event_id", ["value"], group=["event_type"])
    return o.select("event_type", "column", "event_id", r6("value").alias("value"))


@register("zscore_outliers", """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT 'value' AS "column", event_id, round(value, 6) AS value, round(abs(value - m) / sd, 6) AS z
FROM events, s WHERE sd > 0 AND abs(value - m) / sd > 3
""")
def q_zscore_outliers(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    o = O.zscore_outliers(ev, "event_id", ["value"], 3.0)
    return o.select("column", "event_id", r6("value").alias("value"), r6("z").alias("z"))


# ------------------------------------------------------------------ splits R1-R7

@register("stratified_holdout", """
WITH c AS (SELECT c_mktsegment AS cls, count(*) AS n FROM customer GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM c),
a AS (SELECT cls, n * n_test / total AS exact, floor(n * n_test / total) AS base FROM c, t),
b AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, cls) AS pos FROM a),
alloc AS (SELECT cls, base + CASE WHEN pos <= (SELECT n_test FROM t) - (SELECT sum(base) FROM a) THEN 1 ELSE 0 END AS k
          FROM b),
r AS (SELECT c_custkey, c_mktsegment,
             row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey)) AS rk FROM customer)
SELECT c_custkey, c_mktsegment, CASE WHEN rk <= k THEN 'test' ELSE 'train' END AS split
FROM r JOIN alloc ON alloc.cls = r.c_mktsegment
""")
def q_stratified_holdout(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return RS.stratified_holdout(c, "c_mktsegment", "c_custkey", 0.2, 42)


@register("stratified_holdout_unlabelled", """
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer),
c AS (SELECT seg AS cls, count(*) AS n FROM x GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM c),
a AS (SELECT cls, n * n_test / total AS exact, floor(n * n_test / total) AS base FROM c, t),
b AS (SELECT *, row_number() OVER (ORDER BY exact - base DESC, COALESCE(cls, 'None')) AS pos FROM a),
alloc AS (SELECT cls, base + CASE WHEN pos <= (SELECT n_test FROM t) - (SELECT sum(base) FROM a) THEN 1 ELSE 0 END AS k FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY md5('42:' || c_custkey)) AS rk FROM x)
SELECT c_custkey, seg, CASE WHEN rk <= k THEN 'test' ELSE 'train' END AS split
FROM r JOIN alloc ON alloc.cls IS NOT DISTINCT FROM r.seg
""")
def q_stratified_holdout_unlabelled(spark, sf):
    """R1 with a third of the rows unlabelled: they are a class, and none is lost."""
    x = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS seg")
    return RS.stratified_holdout(x, "seg", "c_custkey", 0.2, 42)


@register("stratified_kfold", """
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels
""")
def q_stratified_kfold(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return RS.stratified_kfold(lab, "quality", "doc_id", 5)


@register("repeated_stratified_kfold", """
SELECT c_custkey, c_mktsegment, r AS repeat,
  CAST((row_number() OVER (PARTITION BY c_mktsegment, r ORDER BY md5('42:' || r || ':' || c_custkey)) - 1) % 5 AS INTEGER)
  AS fold
FROM (SELECT c_custkey, c_mktsegment, unnest(range(3)) AS r FROM customer)
""")
def q_repeated_stratified_kfold(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    out = RS.repeated_stratified_kfold(c, "c_mktsegment", "c_custkey", 5, 3, 42)
    return out.select("c_custkey", "c_mktsegment", F.col("repeat").cast("bigint").alias("repeat"), "fold")


@register("random_undersample", """
WITH t AS (SELECT ((count(*) // 5) * 4) // count(DISTINCT c_mktsegment) AS n FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey)) AS rk FROM customer)
SELECT c_custkey, c_mktsegment FROM r, t
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR rk <= t.n
""")
def q_random_undersample(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    counts = RS.class_counts(c, "c_mktsegment")
    n = RS.fold_resample_target(sum(counts.values()), 5, len(counts))  # R7 per-fold target
    return RS.random_undersample(c, "c_mktsegment", "c_custkey", {"BUILDING": n, "MACHINERY": n}, 42)


@register("resample_targets", """
SELECT ((count(*) // 5) * 4) // count(DISTINCT quality) AS fold_target,
       greatest(count(*) // count(DISTINCT quality), 500) AS final_target FROM labels
""")
def q_resample_targets(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("quality").alias("k")).select(
        sql_expr("((n div 5) * 4) div k").alias("fold_target"), sql_expr("greatest(n div k, 500)").alias("final_target"))


@register("balanced_class_weights", """
SELECT doc_id, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * n), 6) AS weight
FROM labels JOIN (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) USING (toxic)
""")
def q_balanced_class_weights(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    return RS.balanced_class_weights(lab, "toxic").select("doc_id", r6("weight").alias("weight"))


# ------------------------------------------------------------------ chart data D1-D8

@register("histogram_data", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(greatest(CAST(floor((value - lo) / (hi - lo) * 30) AS INTEGER), 0), 29) AS bin, lo, hi
      FROM events, s)
SELECT bin, count(*) AS count, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30), 6) AS "left",
       round(any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 30), 6) AS "right" FROM b GROUP BY bin
""")
def q_histogram_data(spark, sf):
    h = D.histogram_data(table(spark, sf, "events"), "value", 30)
    return h.select("bin", "count", r6("left").alias("left"), r6("right").alias("right"))


@register("kde_data", """
WITH st AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi
            FROM events GROUP BY 1),
st2 AS (SELECT *, sd * pow(n, -0.2) AS h FROM st WHERE sd * pow(n, -0.2) > 0),
j AS (SELECT e.event_type, value AS x, n, h, lo, hi,
             least(floor((value - lo) / CASE WHEN (hi - lo) / 2048 > 0 THEN (hi - lo) / 2048 ELSE 1.0 END), 2047) AS b
      FROM events e JOIN st2 USING (event_type)),
c AS (SELECT event_type, b, n, h, lo, hi, count(*) AS w, avg(x) AS c FROM j GROUP BY ALL),
g AS (SELECT *, unnest(range(200)) AS gi FROM c),
d AS (SELECT event_type, gi, (lo - 3.0 * h) + ((hi + 3.0 * h) - (lo - 3.0 * h)) * gi / 199 AS gx, w, c, n, h FROM g)
SELECT event_type, round(gx, 6) AS x,
       round(sum(w * exp(-0.5 * ((gx - c) / h) * ((gx - c) / h)) / (n * h * sqrt(2 * pi()))), 6) AS density
FROM d GROUP BY event_type, gi, gx
""")
def q_kde_data(spark, sf):
    k = D.kde_data(table(spark, sf, "events"), "value", by="event_type")
    return k.select("event_type", r6("x").alias("x"), r6("density").alias("density"))


@register("box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT e.event_type, value, q1, median, q3, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
      FROM events e JOIN q USING (event_type))
SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN inside THEN value END), 6) AS whisker_low,
       round(max(CASE WHEN inside THEN value END), 6) AS whisker_high,
       sum(CASE WHEN inside THEN 0 ELSE 1 END) AS n_outliers FROM j GROUP BY ALL
""")
def q_box_stats(spark, sf):
    b = D.box_stats(table(spark, sf, "events"), "value", by="event_type")
    return b.select("event_type", *[r6(c).alias(c) for c in ["q1", "median", "q3", "whisker_low", "whisker_high"]],
                    "n_outliers")


@register("bar_data", """
SELECT l_returnflag, round(avg(l_extendedprice), 6) AS value, round(stddev_samp(l_extendedprice), 6) AS std,
       count(l_extendedprice) AS n FROM lineitem GROUP BY 1
""")
def q_bar_data(spark, sf):
    b = D.bar_data(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return b.select("l_returnflag", r6("value").alias("value"), r6("std").alias("std"), "n")


@register("count_data", """
SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2
""")
def q_count_data(spark, sf):
    return D.count_data(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("pie_data", """
SELECT o_orderstatus, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY 1
""")
def q_pie_data(spark, sf):
    p = D.pie_data(table(spark, sf, "orders"), "o_orderstatus")
    return p.select("o_orderstatus", "count", r6("share").alias("share"))


@register("hexbin_data", """
WITH s AS (SELECT min(l_quantity) AS xlo, max(l_quantity) AS xhi, min(l_extendedprice) AS ylo,
                  max(l_extendedprice) AS yhi FROM lineitem),
p AS (SELECT (l_quantity - xlo) / ((xhi - xlo) / 30) AS px, (l_extendedprice - ylo) / ((yhi - ylo) / 17) AS py
      FROM lineitem, s),
c AS (SELECT *, floor(px + 0.5) AS i1, floor(py + 0.5) AS j1, floor(px) AS i2, floor(py) AS j2 FROM p),
d AS (SELECT *, (px - i1) * (px - i1) + 3.0 * (py - j1) * (py - j1)
                 < (px - i2 - 0.5) * (px - i2 - 0.5) + 3.0 * (py - j2 - 0.5) * (py - j2 - 0.5) AS lattice1 FROM c)
SELECT lattice1, CAST(CASE WHEN lattice1 THEN i1 ELSE i2 END AS INTEGER) AS ix,
       CAST(CASE WHEN lattice1 THEN j1 ELSE j2 END AS INTEGER) AS iy, count(*) AS count FROM d GROUP BY ALL
""")
def q_hexbin_data(spark, sf):
    return D.hexbin_data(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 30)


@register("series_data", """
SELECT x, event_type, round(mean, 6) AS mean,
       round(sum(mean) OVER (PARTITION BY x ORDER BY event_type ROWS UNBOUNDED PRECEDING), 6) AS stacked
FROM (SELECT user_id % 7 AS x, event_type, avg(value) AS mean FROM events GROUP BY 1, 2)
""")
def q_series_data(spark, sf):
    ev = table(spark, sf, "events").select((F.col("user_id") % 7).alias("x"), "event_type", "value")
    s = D.series_data(ev, "x", "value", "event_type", stacked=True)
    return s.select("x", "event_type", r6("mean").alias("mean"), r6("stacked").alias("stacked"))


@register("point_sample", """
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, c_nationkey FROM customer
ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 200
""")
def q_point_sample(spark, sf):
    c = table(spark, sf, "customer")
    s = D.point_sample(c, "c_custkey", ["c_acctbal", "c_nationkey"], 200, 42)
    return s.select("c_custkey", r6("c_acctbal").alias("c_acctbal"), "c_nationkey")
