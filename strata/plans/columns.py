"""Registered queries: sources and sinks (S1, S2, S5), column choice (P14, P16, P17), baseline columns and constants
(C1, C4, C6, C7, C13), the correlation heat map (D10) and fold quartiles (D11)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import chartdata as D
from ..operators import evaluate as V
from ..operators import recode as RC
from ..operators import select as S
from ..session import checkpoint_dir
from ..sources import io
from .common import r6, sql_expr, table
from .evaluation import _FOLD_SQL, _folds
from .registry import register


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), name, uuid.uuid4().hex)


# ------------------------------------------------------------------ S1, S2, S5

@register("read_table", """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 6) END AS o_totalprice FROM orders
""")
def q_read_table(spark, sf):
    """Orders exported as CSV, with NaN for some prices, and read back with a declared schema."""
    path = _folder(spark, "csv-export")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", sql_expr("CASE WHEN o_orderkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END").alias("o_totalprice"))
    io.write_table(o, path, fmt="csv")
    back = io.read_table(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double", fmt="csv")
    return back.withColumn("o_totalprice", r6("o_totalprice"))


_LINE = """CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey || ',' || o_custkey || ',not a price'
  WHEN o_orderkey % 50 = 9 THEN '' || o_orderkey WHEN o_orderkey % 50 = 11 THEN o_orderkey || ',' || o_custkey || ',1.5,surplus'
  ELSE o_orderkey || ',' || o_custkey || ',' || (o_custkey % 1000) || '.25' END"""


@register("read_quarantined", f"""
WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey % 50 IN (7, 9, 11) AS bad, {_LINE} AS line FROM orders)
SELECT CASE WHEN NOT bad THEN o_orderkey END AS o_orderkey, CASE WHEN NOT bad THEN o_custkey END AS o_custkey, CASE WHEN NOT bad THEN (o_custkey % 1000 + 0.25)::DOUBLE END AS price, CASE WHEN bad THEN line END AS line FROM t
""")
def q_read_quarantined(spark, sf):
    """A CSV in which some rows do not parse, lack fields or have too many: those are kept apart, as they stand."""
    path = _folder(spark, "csv-broken")
    table(spark, sf, "orders").select(sql_expr(_LINE).alias("value")).write.text(path)
    rows, broken = io.read_quarantined(spark, path, "o_orderkey bigint, o_custkey bigint, price double", header=False)
    return rows.withColumn("line", F.lit(None).cast("string")).unionByName(broken.select(
        F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("bigint").alias("o_custkey"), F.lit(None).cast("double").alias("price"), "line"))


@register("write_table", """
SELECT l_orderkey, l_linenumber, l_returnflag, round(l_quantity, 6) AS l_quantity FROM lineitem
""")
def q_write_table(spark, sf):
    """Parquet, partitioned by a column, read back."""
    path = _folder(spark, "parquet-export")
    io.write_table(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), path, partition_by=["l_returnflag"])
    back = io.read_table(spark, path, fmt="parquet")
    return back.select("l_orderkey", "l_linenumber", F.col("l_returnflag").cast("string").alias("l_returnflag"), r6("l_quantity").alias("l_quantity"))


# ------------------------------------------------------------------ P14, P16, P17

@register("infer_columns", """
SELECT 'o_orderkey' AS "column", 'numeric' AS kind, count(o_orderkey) AS n FROM orders UNION ALL SELECT 'o_custkey', 'numeric', count(o_custkey) FROM orders
UNION ALL SELECT 'o_totalprice', 'numeric', count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderstatus', 'categorical', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', count(o_orderpriority) FROM orders
""")
def q_infer_columns(spark, sf):
    """Numeric and categorical columns by the schema, with their values."""
    o = table(spark, sf, "orders")
    kinds = {c: kind for kind in ("numeric", "categorical") for c in S.infer_columns(o, kind=kind)}
    counts = o.agg(*[F.count(c).alias(c) for c in kinds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("n")) for c, k in kinds.items()])).alias("x")).select("x.*")


@register("lookup_rows", """
SELECT l_orderkey, l_linenumber, l_returnflag AS returnflag FROM lineitem WHERE l_returnflag IN ('R', 'N')
""")
def q_lookup_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("returnflag"))
    return S.lookup_rows(li, "returnflag", ["R", "N", "not there"])


@register("slice_alt_features", """
SELECT vec_id, label, embedding[4]::DOUBLE AS e3, embedding[5]::DOUBLE AS e4 FROM embeddings
""")
def q_slice_alt_features(spark, sf):
    """A model's own features, without three dominant ones."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(5)])
    return S.slice_features(e, ["e0", "e1", "e2"])


# ------------------------------------------------------------------ C1, C4, C6, C7, C13

_VISITS = """o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 2 END AS price_bl,
  o_orderpriority AS DX, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS DX_BL, o_custkey AS only_bl"""


def _visits(spark, sf):
    from .prep import _split
    return table(spark, sf, "orders").selectExpr(*_split(_VISITS))


@register("fill_bl_from_base", f"""
WITH t AS (SELECT {_VISITS} FROM orders)
SELECT o_orderkey, round(price, 6) AS price, round(COALESCE(price_bl, price), 6) AS price_bl, DX, COALESCE(DX_BL, DX) AS DX_BL, only_bl FROM t
""")
def q_fill_bl_from_base(spark, sf):
    filled, _ = RC.fill_bl_from_base(_visits(spark, sf))
    return filled.withColumn("price", r6("price")).withColumn("price_bl", r6("price_bl"))


@register("fill_bl_report", f"""
WITH t AS (SELECT {_VISITS} FROM orders)
SELECT 'price_bl' AS "column", count(*) FILTER (price_bl IS NULL AND price IS NOT NULL) AS filled FROM t
UNION ALL SELECT 'DX_BL', count(*) FILTER (DX_BL IS NULL AND DX IS NOT NULL) FROM t
""")
def q_fill_bl_report(spark, sf):
    return RC.fill_bl_from_base(_visits(spark, sf))[1]


@register("consolidate_bl", f"""
WITH t AS (SELECT {_VISITS} FROM orders)
SELECT o_orderkey, round(price_bl, 6) AS price, DX_BL AS DX, only_bl FROM t
""")
def q_consolidate_bl(spark, sf):
    return RC.consolidate_bl(_visits(spark, sf)).withColumn("price", r6("price"))


@register("replace_value", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def q_replace_value(spark, sf):
    c = RC.replace_value(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "BUILDING", "HOUSES")
    return RC.replace_value(c, "not there", 1, 2)


@register("fill_null_constant", """
SELECT c_custkey, COALESCE(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END, 'NONE') AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer
""")
def q_fill_null_constant(spark, sf):
    """A text fills a text column; a text for a number column is passed over."""
    c = table(spark, sf, "customer").select("c_custkey", sql_expr("CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END").alias("segment"), sql_expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END").alias("nation"))
    return RC.fill_null_constant(RC.fill_null_constant(c, "segment", "NONE"), "nation", "no number")


@register("detect_integer_like", """
SELECT unnest(['l_quantity', 'whole_or_null', 'l_orderkey', 'l_linenumber', 'l_tax']) AS "column", unnest(range(5)) AS position, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def q_detect_integer_like(spark, sf):
    """Float columns of whole numbers, integer columns, and a forced one, in that order."""
    li = table(spark, sf, "lineitem").select(F.floor("l_quantity").cast("double").alias("l_quantity"), "l_discount", "l_tax", F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("double")).alias("whole_or_null"),
                                             F.lit(None).cast("double").alias("nothing"), "l_orderkey", "l_linenumber")
    names = RC.detect_integer_like(li, forced=["l_tax", "l_orderkey"])
    return li.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(F.array(*[F.lit(c) for c in names])).alias("position", "column"), "n").select("column", F.col("position").cast("bigint").alias("position"), "n")


_MARKERS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS TAU, l_quantity AS PTAU, l_discount AS ABETA,
  l_tax AS Hippocampus, l_quantity * 3 AS WholeBrain, CAST(l_linenumber - 1 AS DOUBLE) AS ICV"""
_RATIOS = """round(TAU / nullif(ABETA, 0), 6) AS "TAU/ABETA", round(PTAU / nullif(ABETA, 0), 6) AS "PTAU/ABETA", round(Hippocampus / nullif(ICV, 0), 6) AS "Hippocampus/ICV", round(WholeBrain / nullif(ICV, 0), 6) AS "WholeBrain/ICV\""""


@register("derive_features_by_rule", f"""
WITH t AS (SELECT {_MARKERS} FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_RATIOS} FROM t
""")
def q_derive_features_by_rule(spark, sf):
    """Markers over the reference and volumes over the whole, what went in dropped."""
    from .prep import _split
    out = RC.derive_features(table(spark, sf, "lineitem").selectExpr(*_split(_MARKERS)))
    return out.select(*[r6(f"`{c}`").alias(c) if "/" in c else F.col(c) for c in out.columns])


# ------------------------------------------------------------------ D10, D11

_HEAT = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@register("heatmap_data", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round({'max(1.0::DOUBLE)' if a == b else f'corr({min(a, b)}, {max(a, b)})'}, 6) AS corr FROM lineitem" for a in _HEAT for b in _HEAT))
def q_heatmap_data(spark, sf):
    c = D.heatmap_data(table(spark, sf, "lineitem"), _HEAT)
    return c.select("x", "y", r6("corr").alias("corr"))


@register("fold_distribution", f"""
WITH {_FOLD_SQL},
l AS (SELECT model, r, fold, CASE WHEN model = 'a' THEN pred_a ELSE pred_c END AS pred, true_label FROM f, (VALUES ('a'), ('c')) m(model)),
s AS (SELECT model, r, fold, avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM l WHERE pred IS NOT NULL GROUP BY ALL)
SELECT model, count(*) AS n, round(min(accuracy), 6) AS min, round(quantile_cont(accuracy, 0.25), 6) AS q1, round(quantile_cont(accuracy, 0.5), 6) AS median, round(quantile_cont(accuracy, 0.75), 6) AS q3, round(max(accuracy), 6) AS max
FROM s GROUP BY model
""")
def q_fold_distribution(spark, sf):
    f = _folds(spark, sf)
    long = f.select("true_label", "repeat", "fold", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in ("a", "c")])).alias("p")).select("true_label", "repeat", "fold", "p.*")
    scores = V.metric_set(long.where("pred IS NOT NULL"), "true_label", "pred", by=["model", "repeat", "fold"])
    d = D.fold_distribution(scores)
    return d.select("model", "n", *[r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@register("write_comparison", f"""
WITH {_FOLD_SQL},
l AS (SELECT model, CASE WHEN model = 'a' THEN pred_a ELSE pred_c END AS pred, true_label FROM f, (VALUES ('a'), ('c')) m(model) WHERE r = 0)
SELECT model, round(avg(CASE WHEN pred = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l WHERE pred IS NOT NULL GROUP BY 1
""")
def q_write_comparison(spark, sf):
    """The comparison table as one CSV file, read back."""
    f = _folds(spark, sf).where("repeat = 0")
    long = f.select("true_label", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{m}").alias("pred")) for m in ("a", "c")])).alias("p")).select("true_label", "p.*")
    path = _folder(spark, "comparison")
    io.write_comparison(V.test_comparison(V.metric_set(long.where("pred IS NOT NULL"), "true_label", "pred", by=["model"])).select("model", "accuracy"), path)
    return io.read_table(spark, path, "model string, accuracy double", fmt="csv").select("model", r6("accuracy").alias("accuracy"))
