"""Hand-worked fixtures (FIXTURES.md section 3) for selection, recoding,
back-fill, profiling and imputation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.functions import recode as R
from strata.operators import backfill as B
from strata.operators import profile as P
from strata.operators import select as S


def test_clean_limit_values_fixture2(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([" <80 ", ">1700", "200.5", "n/a", None, "1.5d", "nan"])],
                               "i int, v string")
    got = [r["x"] for r in df.select("i", R.clean_limit_value("v").alias("x")).orderBy("i").collect()]
    assert got[0] == pytest.approx(79.2)
    assert got[1] == pytest.approx(1717.0)
    assert got[2] == 200.5
    assert got[3:] == [None, None, None, None]


def test_float_to_int_fixture3(spark):
    df = spark.createDataFrame([(0, 2.5), (1, -2.5), (2, 2.4), (3, None), (4, 2.1)], "i int, x double")
    rows = df.select("i", R.float_to_int("x", "round").alias("r"), R.float_to_int("x", "floor").alias("f"),
                     R.float_to_int("x", "ceil").alias("c")).orderBy("i").collect()
    assert [r["r"] for r in rows[:4]] == [3, -2, 2, 0]
    assert rows[1]["f"] == -3
    assert rows[4]["c"] == 3


def test_remap_smc_fixture4(spark):
    df = spark.createDataFrame([(0, "SMC", "CN"), (1, "SMC", "MCI"), (2, "SMC", "Dementia"), (3, "SMC", None),
                                (4, "LMCI", "CN")], "i int, DX_bl string, DX string")
    got = [r[0] for r in df.select(R.remap_smc()).collect()]
    assert got == ["CN", "EMCI", "AD", "CN", "LMCI"]


def test_fix_label_discrepancies_fixture5(spark):
    df = spark.createDataFrame([("CN", "EMCI"), ("MCI", "AD"), ("Dementia", "LMCI"), ("MCI", "EMCI")],
                               "DX string, DX_bl string")
    assert [r[0] for r in df.select(R.fix_label_discrepancies()).collect()] == ["CN", "LMCI", "AD", "EMCI"]


def test_safe_ratio_fixture6(spark):
    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0), (None, 2.0), (3.0, None)], "a double, b double")
    assert [r[0] for r in df.select(R.safe_ratio(F.col("a"), F.col("b"))).collect()] == [2.0, None, None, None]


def test_single_value_columns_fixture7(spark):
    df = spark.createDataFrame([(1, None, 1, 1), (1, None, None, 2)], "a int, b int, c int, d int")
    _, dropped = S.drop_single_value_columns(df)
    assert dropped == ["a", "b"]


def test_sparse_columns_fixture8(spark):
    rows = [(None if i < 50 else 1, None if i < 51 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int")
    _, dropped = S.drop_sparse_columns(df, 50.0)
    assert dropped == ["b"]


def test_impute_mean_by_class_fixture9(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", None), (2, "a", 3.0), (3, "c", 8.0), (4, "b", None),
                                (5, "b", None), (6, None, None)], "i int, k string, x double")
    got = {r["i"]: r["x"] for r in P.impute_mean_by_class(df, ["x"], "k").collect()}
    assert got[1] == 2.0
    assert got[4] == pytest.approx(4.0) and got[5] == pytest.approx(4.0)
    assert got[6] is None


def test_backfill_fixture1(spark):
    d = dt.date
    base = spark.createDataFrame([("A", d(2010, 1, 1), "EMCI", None, None), ("B", d(2010, 1, 1), "CN", None, None),
                                  ("C", d(2010, 1, 1), "CN", None, None), ("D", None, "AD", None, None)],
                                 "s string, d date, dx string, mmse double, fdg double")
    visits = spark.createDataFrame([
        (1, "A", d(2010, 6, 1), "Dementia", 20.0, 0.9), (2, "A", d(2011, 1, 1), "MCI", 27.0, None),
        (3, "A", d(2012, 1, 1), "MCI", None, 1.2), (4, "B", d(2011, 1, 1), "CN", 29.0, None),
        (5, "B", d(2012, 1, 1), "MCI", 25.0, None), (6, "C", d(2009, 1, 1), "CN", 30.0, None),
        (7, "D", d(2009, 1, 1), "Dementia", 18.0, None)], "id int, s string, d date, vdx string, mmse double, fdg double")
    out, report = B.longitudinal_backfill(base, visits, "s", "d", "dx", "vdx", "id", ["mmse", "fdg"])
    got = {r["s"]: (r["mmse"], r["fdg"]) for r in out.collect()}
    assert got == {"A": (27.0, 1.2), "B": (None, None), "C": (None, None), "D": (18.0, None)}
    rep = report.first()
    assert (rep["filled_cells"], rep["filled_rows"]) == (3, 2)


def test_label_equivalence(spark):
    df = spark.createDataFrame([("EMCI", "MCI"), ("AD", "MCI"), ("XX", "XX"), (None, "CN"), ("CN", None)],
                               "a string, b string")
    assert [r[0] for r in df.select(B.label_equivalent("a", "b")).collect()] == [True, False, True, False, False]


def test_select_baseline_first_in_order(spark):
    df = spark.createDataFrame([(3, "p1", "bl", "CN"), (1, "p1", "bl", "AD"), (2, "p1", "m06", "AD"),
                                (4, "p2", "bl", None), (5, "p3", "bl", "LMCI")],
                               "row_id long, PTID string, VISCODE string, DX_bl string")
    got = {r["PTID"]: r["row_id"] for r in S.select_baseline(df).collect()}
    assert got == {"p1": 1, "p3": 5}


def test_filter_not_equal_keeps_nulls(spark):
    df = spark.createDataFrame([("bl",), ("m06",), (None,)], "v string")
    assert S.filter_not_equal(df, "v", "bl").count() == 2


def test_validate_rows_fixture26(spark):
    rules = [("AGE", 0, 120, "int"), ("MMSE", 0, 30, "int"), ("APOE4", 0, 2, "int"), ("FAQ", 0, 30, "int")]
    df = spark.createDataFrame([("130", "27", "1", "3"), ("70", "x", "1", "3"), ("70", "27", "3", "3"),
                                ("70", "27", "1", " "), ("70", "27.9", "1", "3")],
                               "AGE string, MMSE string, APOE4 string, FAQ string")
    valid, bad = S.validate_rows(df, rules)
    v = valid.collect()
    assert len(v) == 1 and v[0]["MMSE"] == 27.0
    assert bad.count() == 4


def test_normalize_label_synonyms(spark):
    df = spark.createDataFrame([("0",), ("3",), (" emci ",), ("Late MCI",), ("Alzheimer",), ("cognitively normal",),
                                ("??",)], "v string")
    assert [r[0] for r in df.select(R.normalize_label("v")).collect()] == ["CN", "AD", "EMCI", "LMCI", "AD", "CN", None]


def test_majority_rank_ties_average(spark):
    from strata.operators.ranks import average_rank
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, None])], "i int, v double")
    got = {r["i"]: r["rank"] for r in average_rank(df, "v").collect()}
    assert got == {0: 1.0, 1: 2.5, 2: 2.5, 3: 4.0, 4: None}


def test_seeded_rank_matches_row_number(spark):
    from strata.operators.ranks import seeded_rank
    df = spark.range(2000).withColumn("g", F.col("id") % 3)
    a = seeded_rank(df, 42, "id", "g", out="rk", prefix_hex=2)
    from pyspark.sql import Window
    b = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))))))
    assert a.join(b, ["id", "g"]).filter("rk <> rk2").count() == 0
