"""Hand-worked fixtures (FIXTURES.md section 3) for outliers, encoders,
splits, statistics, evaluation and voting."""

import pytest
from pyspark.sql import functions as F

from strata.functions.stats_math import chi2_sf, wilcoxon_exact_p
from strata.operators import encode as N
from strata.operators import evaluate as V
from strata.operators import outliers as O
from strata.operators import resample as RS
from strata.operators import score as Q
from strata.operators import stats as T


def test_iqr_fixture10(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "k int, x double")
    b = O.iqr_bounds(df, ["x"]).first()
    assert (b["q1"], b["q3"], b["lower"], b["upper"]) == (2.0, 4.0, -1.0, 7.0)
    assert [r["value"] for r in O.iqr_outliers(df, "k", ["x"]).collect()] == [100.0]


def test_zscore_fixture11(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 10 else 100.0, 5.0) for i in range(11)], "k int, x double, c double")
    out = O.zscore_outliers(df, "k", ["x", "c"]).collect()
    assert len(out) == 1 and out[0]["column"] == "x" and out[0]["z"] == pytest.approx(3.1623, abs=1e-4)


def test_equal_width_fixture12(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    out, edges = N.equal_width_bins(df, "x", 2, out="b")
    assert edges == pytest.approx([-0.01, 5.0, 10.0])
    assert [r["b"] for r in out.orderBy("x").collect()] == [0, 0, 1]


def test_constant_scalers_fixture13(spark):
    df = spark.createDataFrame([(7.0,), (7.0,), (7.0,)], "x double")
    for fn in (N.min_max_scale, N.z_score_scale, N.robust_scale):
        assert [r["x"] for r in fn(df, ["x"]).collect()] == [0.0, 0.0, 0.0]


def test_label_encode_fixture14(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "a")], "i int, v string")
    assert [r["v"] for r in N.label_encode(df, ["v"]).orderBy("i").collect()] == [1, 0, 2, 0]


def test_codes_of_more_categories_than_a_literal_map_takes(spark):
    n = N.MAX_CATEGORIES + 500
    df = spark.range(2 * n).select("id", F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") % n)).alias("v"), (F.col("id") % n * 3).alias("x"), F.lit("one").alias("y")).repartition(5)
    names = sorted({f"c{i % n}" for i in range(1, 2 * n)} | {"nan"})
    code = {v: i for i, v in enumerate(names)}
    got = N.label_encode(df, ["v", "y"])
    assert got.columns == df.columns
    assert {r["id"]: (r["v"], r["x"], r["y"]) for r in got.collect()} == {i: (code[f"c{i % n}" if i else "nan"], i % n * 3, 0) for i in range(2 * n)}
    assert {r["id"]: r["x"] for r in N.ordinal_encode(df, ["x"]).collect()} == {i: i % n for i in range(2 * n)}
    found = {r["id"]: r["v"] for r in N.ordinal_encode(df, ["v"]).collect()}
    assert found[0] is None and all(found[i] == code[f"c{i % n}"] for i in range(1, 2 * n))


def test_min_max_in_unit_interval(spark):
    df = spark.range(100).select((F.col("id") * 3.7 - 50).alias("x"))
    r = N.min_max_scale(df, ["x"]).agg(F.min("x"), F.max("x")).first()
    assert r[0] == 0.0 and r[1] == 1.0


def test_kruskal_fixture16(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 4.0), ("B", 5.0), ("B", 6.0)], "g string, x double")
    r = T.kruskal_wallis(df, ["x"], "g").first()
    assert r["h"] == pytest.approx(3.857143, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.049535, abs=1e-6)


def test_wilcoxon_fixture17(spark):
    rows = [(m, f, s) for f, d in enumerate([1, 2, 3, 4, 5]) for m, s in (("a", 10.0 + d), ("b", 10.0))]
    df = spark.createDataFrame(rows, "model string, fold int, score double")
    r = T.wilcoxon_pairwise(df).first()
    assert r["statistic"] == 0.0 and r["n"] == 5
    assert r["p_value"] == pytest.approx(0.0625)


def test_wilcoxon_25_one_signed():
    assert wilcoxon_exact_p(25, 0) == pytest.approx(5.96e-8, rel=1e-2)


def test_chi2_sf_known_values():
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6)


def test_metric_set_fixture18(spark):
    df = spark.createDataFrame([("CN", "CN"), ("CN", "AD"), ("AD", "AD"), ("AD", "AD")], "t string, p string")
    m = V.metric_set(df, "t", "p").first()
    assert m["accuracy"] == 0.75 and m["balanced_accuracy"] == 0.75
    assert m["f1_macro"] == pytest.approx(0.733333, abs=1e-6)
    assert m["precision_weighted"] == pytest.approx(0.833333, abs=1e-6)


def test_auc_fixture19(spark):
    df = spark.createDataFrame([("P", [0.1, 0.9]), ("P", [0.5, 0.5]), ("N", [0.5, 0.5]), ("N", [0.9, 0.1])],
                               "t string, probs array<double>")
    a = {r["class"]: r["auc"] for r in V.class_auc(df, "t", "probs", ["N", "P"]).collect()}
    assert a["P"] == pytest.approx(0.875)


def test_confusion_sums_to_n(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "b"), ("c", "a")], "t string, p string")
    cm = V.confusion_matrix(df, "t", "p", ["a", "b", "c"])
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 4


def test_severity_fixture20(spark):
    df = spark.createDataFrame([([0.4, 0.2, 0.0, 0.4],)], "p array<double>")
    assert df.select(Q.severity_tie_break("p", ["CN", "EMCI", "LMCI", "AD"])).first()[0] == "AD"


def test_majority_vote_fixture21(spark):
    df = spark.createDataFrame([(0, ["CN", "AD", "AD", "LMCI"]), (1, ["CN", "EMCI", "LMCI", "AD"]),
                                (2, [None, "EMCI", "LMCI", "AD"]), (3, ["CN", "AD", "AD", "CN"]),
                                (4, [None, None, None, None])], "i int, a array<string>")
    got = [r[0] for r in df.orderBy("i").select(Q.majority_vote("a")).collect()]
    assert got == ["AD", "CN", "EMCI", "CN", None]


def test_holdout_fixture23(spark):
    rows = [(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(5)] + [(200 + i, "c") for i in range(5)]
    df = spark.createDataFrame(rows, "k int, y string")
    out = RS.stratified_holdout(df, "y", "k", 0.2)
    got = {r["y"]: r["n"] for r in out.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_repeated_kfold_fixture24(spark):
    rows = [(i, "x" if i < 8 else "y") for i in range(12)]
    df = spark.createDataFrame(rows, "k int, y string")
    out = RS.repeated_stratified_kfold(df, "y", "k", k=4, repeats=2)
    per = out.groupBy("repeat", "fold", "y").count().collect()
    assert all((r["count"] == 2) if r["y"] == "x" else (r["count"] == 1) for r in per)
    assert out.groupBy("repeat", "k").count().filter("count <> 1").count() == 0
    assert out.count() == 24


def test_undersample_error_when_small(spark):
    df = spark.createDataFrame([(i, "a") for i in range(3)], "k int, y string")
    with pytest.raises(ValueError):
        RS.random_undersample(df, "y", "k", {"a": 5})


def _psi(n):
    import math
    return -0.5772156649015329 + sum(1.0 / j for j in range(1, n)) if n < 2000 else math.log(n) - 1 / (2 * n)


def _mi_brute(xs, ys, k=3):
    import math
    from collections import Counter
    cnt = Counter(ys)
    pts = [(x, y) for x, y in zip(xs, ys) if cnt[y] > 1]
    n = len(pts)
    acc_k = acc_n = acc_m = 0.0
    for i, (x, y) in enumerate(pts):
        same = sorted(abs(x - x2) for j, (x2, y2) in enumerate(pts) if y2 == y and j != i)
        kk = min(k, cnt[y] - 1)
        r = same[kk - 1]
        tk = lambda v: math.floor(v * 1e9 + 0.5)  # noqa: E731 - the library's tie rule
        m = sum(1 for x2, _ in pts if (tk(abs(x2 - x)) < tk(r) if tk(r) > 0 else tk(abs(x2 - x)) == 0))
        acc_k += _psi(kk)
        acc_n += _psi(cnt[y])
        acc_m += _psi(m)
    return max(0.0, _psi(n) + acc_k / n - acc_n / n - acc_m / n)


def test_mutual_information_matches_brute_force(spark):
    import math
    xs = [round(math.sin(i * 0.7) * 5 + (i % 3), 3) for i in range(90)] + [1.0, 1.0, 2.0]
    ys = ["a" if x > 1 else ("b" if i % 2 else "c") for i, x in enumerate(xs)]
    ys[-1] = "solo"
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(xs, ys))], "k long, x double, y string")
    got = T.mutual_information(df, "k", "x", "y").first()
    assert got["mi"] == pytest.approx(_mi_brute(xs, ys), abs=1e-9)


def test_digamma_int(spark):
    df = spark.range(1, 40).select(F.col("id"), T.digamma_int(F.col("id")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(_psi(r["id"]), abs=1e-9)
