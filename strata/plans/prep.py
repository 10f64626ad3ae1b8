"""Registered queries: selection, recoding, back-fill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import backfill as B
from ..operators import recode as RC
from ..operators import select as S
from .common import r6, sql_expr, table
from .registry import register

NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _orders_labelled(spark, sf):
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        sql_expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END").alias("label"))


@register("select_baseline", """
WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice,
                  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS label FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
      FROM t WHERE o_orderstatus = 'F' AND label IS NOT NULL)
SELECT o_custkey, o_orderkey, label, round(o_totalprice, 6) AS o_totalprice FROM k WHERE rn = 1
""")
def q_select_baseline(spark, sf):
    o = _orders_labelled(spark, sf).select("o_custkey", "o_orderkey", "o_orderstatus", "label", "o_totalprice")
    b = S.select_baseline(o, subject="o_custkey", order="o_orderkey",
                          visit="o_orderstatus", baseline_value="F", label="label")
    return b.select("o_custkey", "o_orderkey", "label", r6("o_totalprice").alias("o_totalprice"))


@register("dedupe_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1
""")
def q_dedupe_keep_first(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    f = S.first_per_key(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("l_quantity").alias("l_quantity"))


@register("reindex_columns", """
SELECT p_partkey, p_brand, p_size, round(p_retailprice, 6) AS p_retailprice FROM part
""")
def q_reindex_columns(spark, sf):
    p = table(spark, sf, "part")
    out = S.reindex_columns(p, ["p_partkey", "p_brand", "p_color", "p_size", "p_retailprice"])
    return out.withColumn("p_retailprice", r6("p_retailprice"))


@register("rename_columns", """
SELECT p_partkey AS part_id, p_type AS kind, p_size AS size FROM part
""")
def q_rename_columns(spark, sf):
    p = table(spark, sf, "part")
    p = S.drop_columns(p, ["p_name", "p_brand", "p_retailprice", "not_there"])
    return S.rename_columns(p, {"p_partkey": "part_id", "p_type": "kind", "p_size": "size"})


@register("intersect_columns", """
SELECT s_suppkey AS key, s_nationkey AS nationkey, round(s_acctbal, 6) AS acctbal FROM supplier
""")
def q_intersect_columns(spark, sf):
    s = table(spark, sf, "supplier").toDF("key", "name", "nationkey", "acctbal")
    c = table(spark, sf, "customer").toDF("key", "cname", "nationkey", "acctbal", "segment")
    out = S.intersect_columns(s, c)
    return out.withColumn("acctbal", r6("acctbal"))


_SPARSE = """l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_partkey % 3 <> 0 THEN NULL ELSE l_tax END AS l_tax"""


@register("drop_sparse_columns", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
       round(l_discount, 6) AS l_discount FROM (SELECT {_SPARSE} FROM lineitem)
""")
def q_drop_sparse_columns(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(*[x.strip() for x in _split(_SPARSE)])
    kept, _ = S.drop_sparse_columns(li, 50.0)
    return kept.select(*[r6(c).alias(c) if c in ("l_quantity", "l_discount", "l_tax") else F.col(c)
                         for c in kept.columns])


def _split(select_list: str) -> list[str]:
    """Split a SELECT list on top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in select_list:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    out.append(cur)
    return [x.strip() for x in out if x.strip()]


_SINGLE = """l_orderkey, l_partkey, l_suppkey, l_linenumber, 1 AS one, CAST(NULL AS DOUBLE) AS nothing,
  CASE WHEN l_linenumber = 1 THEN 1 ELSE NULL END AS one_or_null, l_returnflag"""


@register("drop_single_value_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_linenumber = 1 THEN 1 ELSE NULL END AS one_or_null, l_returnflag FROM lineitem
""")
def q_drop_single_value_columns(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(*_split(_SINGLE))
    kept, _ = S.drop_single_value_columns(li)
    return kept


@register("clamp_below", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(CASE WHEN q < 10 THEN 10 ELSE q END, 6) AS l_quantity
FROM (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem)
""")
def q_clamp_below(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *LI_KEY, sql_expr("CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity END").alias("q"))
    return li.select(*LI_KEY, r6(S.clamp_below("q", 10.0)).alias("l_quantity"))


@register("null_out_cells", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN NULL ELSE round(o_totalprice, 6) END AS o_totalprice,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders
""")
def q_null_out_cells(spark, sf):
    o = table(spark, sf, "orders")
    corr = (o.filter("o_totalprice > 300000").select("o_orderkey", F.lit("o_totalprice").alias("column"))
            .unionByName(o.filter("o_orderstatus = 'P'").select("o_orderkey", F.lit("o_orderpriority").alias("column"))))
    out = S.null_out_cells(o.select("o_orderkey", "o_totalprice", "o_orderpriority"), corr, "o_orderkey")
    return out.withColumn("o_totalprice", r6("o_totalprice"))


@register("drop_rows_by_key", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)
""")
def q_drop_rows_by_key(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    bad = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.drop_rows_by_key(o, bad, "o_orderkey")


@register("filter_not_equal", """
SELECT o_orderkey, st AS o_orderstatus FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders)
WHERE st IS DISTINCT FROM 'F'
""")
def q_filter_not_equal(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", sql_expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END").alias("o_orderstatus"))
    return S.filter_not_equal(o, "o_orderstatus", "F")


@register("filter_unlabelled", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 11 = 0
""")
def q_filter_unlabelled(spark, sf):
    o = _orders_labelled(spark, sf)
    return S.filter_unlabelled(o, "o_orderstatus", "F", "label").select("o_orderkey", "o_custkey")


_VALID_SRC = """event_id,
  CASE WHEN event_id % 17 = 0 THEN 'x' WHEN event_id % 19 = 0 THEN '' ELSE CAST(value AS {t}) END AS value_s,
  CAST(user_id AS {t}) AS user_s"""


def _num(s):
    return f"(CASE WHEN regexp_full_match(trim({s}), '{NUM_RE}') THEN TRY_CAST(trim({s}) AS DOUBLE) END)"


def _reason(col, lo, hi, kind):
    num = _num(col)
    val = f"trunc({num})" if kind == "int" else num
    return (f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN '{col}: missing' "
            f"WHEN {num} IS NULL THEN '{col}: not a number' "
            f"WHEN {val} < {lo} OR {val} > {hi} THEN '{col}: outside [{lo}, {hi}]' END")


@register("validate_rows", f"""
SELECT event_id,
  {_num('value_s')} AS value_s,
  CAST(trunc({_num('user_s')}) AS DOUBLE) AS user_s,
  concat_ws('; ', {_reason('value_s', 1, 400, 'float')}, {_reason('user_s', 0, 140, 'int')}) AS reasons
FROM (SELECT {_VALID_SRC.format(t='VARCHAR')} FROM events)
""")
def q_validate_rows(spark, sf):
    ev = table(spark, sf, "events").selectExpr(*_split(_VALID_SRC.format(t="STRING")))
    valid, bad = S.validate_rows(ev, [("value_s", 1, 400, "float"), ("user_s", 0, 140, "int")])
    return (valid.withColumn("reasons", F.lit(""))
            .unionByName(bad.withColumn("reasons", F.array_join("reasons", "; "))))


_LIMIT_SRC = """p_partkey, CASE p_size % 6
    WHEN 0 THEN '<' || CAST(p_size AS {t})
    WHEN 1 THEN '>' || CAST(p_retailprice AS {t})
    WHEN 2 THEN ' ' || CAST(p_size AS {t}) || ' '
    WHEN 3 THEN 'n/a'
    WHEN 4 THEN CAST(p_size AS {t}) || 'd'
    ELSE CAST(p_retailprice AS {t}) END AS raw"""


@register("clean_limit_values", f"""
WITH t AS (SELECT {_LIMIT_SRC.format(t='VARCHAR')} FROM part),
u AS (SELECT p_partkey, raw, trim(raw) AS s,
             {_num("replace(replace(trim(raw), '<', ''), '>', '')")} AS num FROM t)
SELECT p_partkey, raw, round(CASE WHEN s LIKE '<%' THEN num * 0.99 WHEN s LIKE '>%' THEN num * 1.01
                                  ELSE num END, 6) AS value FROM u
""")
def q_clean_limit_values(spark, sf):
    p = table(spark, sf, "part").selectExpr(*_split(_LIMIT_SRC.format(t="STRING")))
    return p.select("p_partkey", "raw", r6(R.clean_limit_value("raw")).alias("value"))


_NUMERIC_SRC = """event_id, CASE event_id % 5
    WHEN 0 THEN CAST(value AS {t}) || 'x'
    WHEN 1 THEN 'nan'
    WHEN 2 THEN ' ' || CAST(value AS {t})
    WHEN 3 THEN '1.5d'
    ELSE CAST(value AS {t}) END AS raw"""


@register("to_numeric_coerce", f"""
SELECT event_id, raw, round({_num('raw')}, 6) AS value FROM (SELECT {_NUMERIC_SRC.format(t='VARCHAR')} FROM events)
""")
def q_to_numeric_coerce(spark, sf):
    ev = table(spark, sf, "events").selectExpr(*_split(_NUMERIC_SRC.format(t="STRING")))
    return ev.select("event_id", "raw", r6(R.to_numeric("raw")).alias("value"))


_LABEL_SRC = """event_id, CASE event_id % 9
    WHEN 0 THEN CAST(user_id % 6 AS {t})
    WHEN 1 THEN ' emci '
    WHEN 2 THEN 'Late MCI stage'
    WHEN 3 THEN 'Alzheimer'
    WHEN 4 THEN 'cognitively normal'
    WHEN 5 THEN 'Early mci'
    WHEN 6 THEN event_type
    WHEN 7 THEN 'Dementia (AD)'
    ELSE 'lmci' END AS raw"""


@register("normalize_label", f"""
WITH t AS (SELECT {_LABEL_SRC.format(t='VARCHAR')} FROM events),
u AS (SELECT event_id, raw, upper(trim(raw)) AS k, CAST(trunc({_num('raw')}) AS BIGINT) AS code FROM t)
SELECT event_id, raw, CASE
  WHEN code = 0 THEN 'CN' WHEN code = 1 THEN 'EMCI' WHEN code = 2 THEN 'LMCI' WHEN code = 3 THEN 'AD'
  WHEN k IN ('CN', 'EMCI', 'LMCI', 'AD') THEN k
  WHEN contains(k, 'CN') THEN 'CN' WHEN contains(k, 'EMCI') THEN 'EMCI'
  WHEN contains(k, 'LMCI') THEN 'LMCI' WHEN contains(k, 'AD') THEN 'AD'
  WHEN contains(k, 'NORMAL') OR contains(k, 'COGNITIVELY') THEN 'CN'
  WHEN contains(k, 'EARLY') AND contains(k, 'MCI') THEN 'EMCI'
  WHEN contains(k, 'LATE') AND contains(k, 'MCI') THEN 'LMCI'
  WHEN contains(k, 'ALZ') THEN 'AD' END AS label FROM u
""")
def q_normalize_label(spark, sf):
    ev = table(spark, sf, "events").selectExpr(*_split(_LABEL_SRC.format(t="STRING")))
    return ev.select("event_id", "raw", R.normalize_label("raw").alias("label"))


_HALF = "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity / 2 - 12 END"


@register("float_to_int", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  COALESCE(CAST(floor(x + 0.5) AS BIGINT), 0) AS x_round,
  COALESCE(CAST(floor(x) AS BIGINT), 0) AS x_floor,
  COALESCE(CAST(ceil(x) AS BIGINT), -1) AS x_ceil
FROM (SELECT *, {_HALF} AS x FROM lineitem)
""")
def q_float_to_int(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, sql_expr(_HALF).alias("x"))
    return li.select(*LI_KEY, R.float_to_int("x", "round").alias("x_round"),
                     R.float_to_int("x", "floor").alias("x_floor"),
                     R.float_to_int("x", "ceil", fill_value=-1).alias("x_ceil"))


@register("safe_ratio", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(num / NULLIF(l_discount, 0), 6) AS tax_over_discount
FROM (SELECT *, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax END AS num FROM lineitem)
""")
def q_safe_ratio(spark, sf):
    li = table(spark, sf, "lineitem").select(
        *LI_KEY, "l_discount", sql_expr("CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_tax END").alias("num"))
    return li.select(*LI_KEY, r6(R.safe_ratio(F.col("num"), F.col("l_discount"))).alias("tax_over_discount"))


_PARTS = """CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount * 100 END AS b,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_tax * 100 END AS c,
  l_quantity + l_discount * 100 + l_tax * 100 AS total"""


@register("row_stats", f"""
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_PARTS} FROM lineitem),
u AS (SELECT *, COALESCE(a, 0) + COALESCE(b, 0) + COALESCE(c, 0) AS s,
             (CASE WHEN a IS NULL THEN 0 ELSE 1 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END
              + CASE WHEN c IS NULL THEN 0 ELSE 1 END) AS k FROM t)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(s, 6) AS row_sum,
       round(CASE WHEN k > 0 THEN s / k END, 6) AS row_mean, round(abs(total - s), 6) AS abs_diff FROM u
""")
def q_row_stats(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(*LI_KEY, *_split(_PARTS))
    s = R.row_sum(["a", "b", "c"])
    return li.select(*LI_KEY, r6(s).alias("row_sum"), r6(R.row_mean(["a", "b", "c"])).alias("row_mean"),
                     r6(F.abs(F.col("total") - s)).alias("abs_diff"))


@register("derive_features", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
       round(l_discount, 6) AS l_discount, round(l_extendedprice / NULLIF(l_quantity, 0), 6) AS unit_price,
       round(l_tax / NULLIF(l_discount, 0), 6) AS tax_per_discount FROM lineitem
""")
def q_derive_features(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY, "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    out = RC.derive_ratios(li, [("l_extendedprice", "l_quantity", "unit_price"), ("l_tax", "l_discount", "tax_per_discount")],
                           drop_inputs=["l_extendedprice", "l_tax"])
    return out.select(*LI_KEY, *[r6(c).alias(c) for c in ["l_quantity", "l_discount", "unit_price", "tax_per_discount"]])


_DX = """o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN 'CN' WHEN 1 THEN 'SMC' WHEN 2 THEN 'EMCI' WHEN 3 THEN 'LMCI' WHEN 4 THEN 'AD' END AS dx_bl,
  CASE o_custkey % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'MCI' WHEN 2 THEN 'Dementia' END AS dx"""


@register("remap_smc", f"""
SELECT o_orderkey, dx_bl, dx, CASE WHEN dx_bl = 'SMC' THEN
   CASE WHEN dx = 'CN' THEN 'CN' WHEN dx = 'MCI' THEN 'EMCI' WHEN dx = 'Dementia' THEN 'AD' ELSE 'CN' END
   ELSE dx_bl END AS dx_bl_fixed
FROM (SELECT {_DX} FROM orders)
""")
def q_remap_smc(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*_split(_DX))
    return o.select("o_orderkey", "dx_bl", "dx", R.remap_smc("dx_bl", "dx").alias("dx_bl_fixed"))


@register("fix_label_discrepancies", f"""
WITH t AS (SELECT {_DX} FROM orders),
a AS (SELECT *, CASE WHEN dx = 'CN' AND dx_bl = 'EMCI' THEN 'CN' ELSE dx_bl END AS s1 FROM t),
b AS (SELECT *, CASE WHEN dx = 'MCI' AND s1 = 'AD' THEN 'LMCI' ELSE s1 END AS s2 FROM a)
SELECT o_orderkey, dx_bl, dx, CASE WHEN dx = 'Dementia' AND s2 = 'LMCI' THEN 'AD' ELSE s2 END AS dx_bl_fixed FROM b
""")
def q_fix_label_discrepancies(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*_split(_DX))
    return o.select("o_orderkey", "dx_bl", "dx", R.fix_label_discrepancies("dx_bl", "dx").alias("dx_bl_fixed"))


@register("map_values", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'vehicle' WHEN 'MACHINERY' THEN 'industry'
                  WHEN 'BUILDING' THEN 'industry' END AS sector FROM customer
""")
def q_map_values(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", R.map_values("c_mktsegment", {"AUTOMOBILE": "vehicle", "MACHINERY": "industry",
                                                               "BUILDING": "industry"}).alias("sector"))


@register("derive_group", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'Hispanic'
                  ELSE c_mktsegment END AS grp FROM customer
""")
def q_derive_group(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment",
        sql_expr("CASE WHEN c_nationkey % 3 = 0 THEN 'Hisp/Latino' ELSE 'Not Hisp/Latino' END").alias("eth"))
    return c.select("c_custkey", R.derive_group("eth", "c_mktsegment", ("BUILDING", "FURNITURE")).alias("grp"))


@register("parse_date_parts", """
SELECT CAST(year(TRY_CAST(s AS TIMESTAMP)) AS BIGINT) AS year, count(*) AS count FROM (
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE CAST(o_orderdate AS VARCHAR) END AS s FROM orders)
GROUP BY 1
""")
def q_parse_date_parts(spark, sf):
    from ..operators.profile import year_counts
    o = table(spark, sf, "orders").select(
        sql_expr("CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE CAST(o_orderdate AS STRING) END").alias("s"))
    return year_counts(o, "s").select(F.col("year").cast("bigint").alias("year"), "count")


_VIS = """o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'bl' WHEN 1 THEN 'm' || CAST(o_orderkey % 48 AS {t})
    WHEN 2 THEN 'sc' ELSE 'm0' || CAST(o_custkey % 10 AS {t}) END AS viscode"""


@register("visit_sort_key", f"""
SELECT o_orderkey, viscode, CASE WHEN viscode = 'bl' THEN -1.0
  WHEN regexp_extract(viscode, 'm(\\d+)', 1) <> '' THEN CAST(regexp_extract(viscode, 'm(\\d+)', 1) AS DOUBLE)
  ELSE 1e300 END AS sort_key
FROM (SELECT {_VIS.format(t='VARCHAR')} FROM orders)
""")
def q_visit_sort_key(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*_split(_VIS.format(t="STRING")))
    k = R.visit_sort_key("viscode")
    # +inf is reported as 1e300 so both engines hash the same finite value.
    return o.select("o_orderkey", "viscode", F.when(F.isnan(k) | (k == float("inf")), F.lit(1e300)).otherwise(k)
                    .alias("sort_key"))


@register("format_percent", """
SELECT l_returnflag, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM lineitem)) AS pct
FROM lineitem GROUP BY l_returnflag
""")
def q_format_percent(spark, sf):
    from ..operators.profile import value_counts
    vc = value_counts(table(spark, sf, "lineitem"), "l_returnflag", normalize=True)
    return vc.select("l_returnflag", R.format_percent(F.col("share") * 100).alias("pct"))


@register("softmax_rows", """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
t AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS ex FROM s)
SELECT vec_id, round(list_max(ex) / list_sum(ex), 6) AS top_p FROM t
""")
def q_softmax_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", r6(F.array_max(R.softmax_array("e"))).alias("top_p"))


# ------------------------------------------------------------------ J1 / J2

_COARSE = ("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' "
           "WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'LOW' ELSE o_orderpriority END")
# Base label -> equivalent follow-up label; '3-MEDIUM' is unmapped (exact match).
PRIORITY_EQUIVALENCE = {"1-URGENT": "HIGH", "2-HIGH": "HIGH", "4-NOT SPECIFIED": "LOW", "5-LOW": "LOW"}
_ORD = f"""o_orderkey, o_custkey, o_orderdate, o_orderpriority,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_COARSE} END AS vlabel,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status"""
_MAP_SQL = ("(SELECT * FROM (VALUES ('1-URGENT', 'HIGH'), ('2-HIGH', 'HIGH'), ('4-NOT SPECIFIED', 'LOW'), "
            "('5-LOW', 'LOW')) m(a, b))")


def _orders_visits(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*_split(_ORD))
    # one row per subject, read by three branches of the back-fill plan: persist once
    base = S.first_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"]).persist()
    visits = S.drop_rows_by_key(o, base.select("o_orderkey"), "o_orderkey")
    return base, visits


_BASE_SQL = f"""o AS (SELECT {_ORD} FROM orders),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
         FROM o) WHERE rn = 1),
visits AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)),
m AS {_MAP_SQL},
j AS (SELECT b.o_custkey, v.o_orderkey AS vid, v.o_orderdate AS vd, v.price, v.status,
        CASE WHEN b.o_orderpriority IS NULL OR v.vlabel IS NULL THEN FALSE
             WHEN b.o_orderpriority IN (SELECT a FROM m)
               THEN EXISTS (SELECT 1 FROM m WHERE m.a = b.o_orderpriority AND m.b = v.vlabel)
             ELSE b.o_orderpriority = v.vlabel END AS ok
      FROM base b JOIN visits v ON v.o_custkey = b.o_custkey AND (b.o_orderdate IS NULL OR v.o_orderdate >= b.o_orderdate))"""


@register("label_equivalence", f"""
WITH {_BASE_SQL}
SELECT vid AS o_orderkey, o_custkey, ok AS matches FROM j
""")
def q_label_equivalence(spark, sf):
    base, visits = _orders_visits(spark, sf)
    b = base.select("o_custkey", F.col("o_orderpriority").alias("base_label"), F.col("o_orderdate").alias("bd"))
    j = visits.join(b, "o_custkey").filter(F.col("o_orderdate") >= F.col("bd"))
    return j.select("o_orderkey", "o_custkey",
                    B.label_equivalent("base_label", "vlabel", PRIORITY_EQUIVALENCE).alias("matches"))


@register("longitudinal_backfill", f"""
WITH {_BASE_SQL},
w AS (SELECT *, max(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY vd DESC, vid
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS brk FROM j),
f AS (SELECT o_custkey,
        arg_min(price, -(epoch(vd) // 86400) * 1e9 + vid) FILTER (WHERE price IS NOT NULL) AS price,
        arg_min(status, -(epoch(vd) // 86400) * 1e9 + vid) FILTER (WHERE status IS NOT NULL) AS status
      FROM w WHERE brk = 0 GROUP BY o_custkey)
SELECT b.o_custkey, b.o_orderkey, round(COALESCE(b.price, f.price), 6) AS price, COALESCE(b.status, f.status) AS status
FROM base b LEFT JOIN f ON f.o_custkey = b.o_custkey
""")
def q_longitudinal_backfill(spark, sf):
    base, visits = _orders_visits(spark, sf)
    out, _ = B.longitudinal_backfill(base, visits, subject="o_custkey", date="o_orderdate", label="o_orderpriority",
                                     visit_label="vlabel", visit_id="o_orderkey", fill_cols=["price", "status"],
                                     mapping=PRIORITY_EQUIVALENCE)
    return out.select("o_custkey", "o_orderkey", r6("price").alias("price"), "status")
