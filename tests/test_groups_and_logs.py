"""NULL groups, bucketed order statistics, long chains, the feedback log, probabilities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.recode import softmax_array
from strata.operators import evaluate, graph, models, neighbours, profile, ranks, resample, stats
from strata.sources import io


def test_rows_without_a_group_are_kept(spark):
    d = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("label"))
    split = resample.stratified_holdout(d, "label", "id", 0.2)
    assert split.count() == 100 and split.filter("split = 'test'").count() == 20
    assert split.filter("split = 'test' AND label IS NULL").count() == 10
    folds = resample.repeated_stratified_kfold(d, "label", "id", 5, 2)
    assert folds.count() == 200 and folds.filter("label IS NULL").groupBy("repeat", "fold").count().filter("count = 10").count() == 10
    under = resample.random_undersample(d, "label", "id", {"c0": 3})
    assert under.filter("label IS NULL").count() == 50 and under.filter("label = 'c0'").count() == 3


def test_exact_quantiles_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_VALUES", 7)
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else f"g{i % 3}", None if i % 13 == 0 else float(v)) for i, v in enumerate(rng.integers(0, 60, 400))]
    d = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: r["_p"] for r in ranks.exact_quantiles(d, "x", probs, "g").collect()}
    for g in (None, "g0", "g1", "g2"):
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g and x is not None], probs))
    whole = ranks.exact_quantiles(d, "x", probs).collect()
    assert np.allclose(whole[0]["_p"], np.quantile([x for _, x in rows if x is not None], probs))
    assert ranks.exact_quantiles(d.limit(0), "x", probs, "g").collect() == []
    assert ranks.exact_quantiles(d.limit(0), "x", [0.5]).first()["_p"] == [None]


def test_components_of_a_long_chain(spark):
    n = 3000
    got = graph.connected_components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).agg(F.countDistinct("component").alias("c"), F.count(F.lit(1)).alias("n")).first()
    assert (got["c"], got["n"]) == (1, n + 1)
    pair = spark.createDataFrame([(1, 1), (5, 4), (6, 5), (9, 8)], "a long, b long")
    assert {(r["node"], r["component"]) for r in graph.connected_components(pair).collect()} == {(1, 1), (4, 4), (5, 4), (6, 4), (8, 8), (9, 8)}


def test_dbscan_does_not_cut_a_chain(spark):
    pts = spark.range(260).select("id", F.array(F.col("id").cast("double")).alias("v"))
    assert neighbours.dbscan(pts, "id", "v", eps=1.0, min_samples=2).select("cluster").distinct().count() == 1


def test_mutual_information_with_a_rare_class(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=300).round(3), np.where(np.arange(300) % 50 == 0, "rare", np.where(np.arange(300) % 2, "a", "b"))
    d = spark.createDataFrame([(i, float(v), str(c)) for i, (v, c) in enumerate(zip(x, y))], "k long, x double, y string")
    psi = lambda n: sum(1 / i for i in range(1, int(n))) - 0.5772156649015329
    parts = []
    for i in range(300):
        same = np.sort(np.abs(x[(y == y[i]) & (np.arange(300) != i)] - x[i]))
        k = min(3, len(same))
        r = same[k - 1]
        m = ((np.abs(x - x[i]) < r - 1e-10) if r > 0 else (x == x[i])).sum()
        parts.append(psi(k) - psi((y == y[i]).sum()) - psi(m))
    got = stats.mutual_information(d, "k", "x", "y").first()
    assert got["n"] == 300 and math.isclose(got["mi"], max(0, psi(300) + np.mean(parts)), abs_tol=1e-9)


def test_mean_of_whole_numbers_is_not_cut(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", None), (None, None)], "c string, x int")
    got = profile.impute_mean_by_class(d, ["x"], "c").collect()
    assert sorted(r["x"] for r in got if r["x"] is not None) == pytest.approx([1, 5 / 3, 2, 2])


def test_softmax_and_roc_without_positives(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], "x"), ([0.0, 0.0, 1000.0], "y")], "p array<double>, t string")
    for r in d.select("p", softmax_array("p").alias("s")).collect():
        e = np.exp(np.asarray(r["p"]) - max(r["p"]))
        assert np.allclose(r["s"], e / e.sum())
    roc = evaluate.roc_curve(d.select(F.array(F.lit(0.2), F.lit(0.8)).alias("q"), "t"), "t", "q", ["x", "none"])
    assert {(r["tpr"], r["fpr"]) for r in roc.filter("class = 'none'").collect()} == {(0.0, 0.0), (1.0, 1.0)}


def test_balanced_fit_favours_no_class(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "rare" if i % 20 == 0 else "many", float(rng.normal(1.0 if i % 20 == 0 else 0.0))) for i in range(600)]
    d = spark.createDataFrame(rows, "k long, label string, x double")
    share = lambda balanced: models.fit_classifier(d, ["x"], "label", models.Preset("lr", "lr", {"C": 10.0}, balanced=balanced)).transform(d).filter("pred = 'rare'").count()
    assert share(False) < 10 < 100 < share(True)


def test_undone_batches_can_come_back_and_ids_are_not_reused(spark, tmp_path):
    path, row = str(tmp_path / "log"), spark.createDataFrame([(1, "a")], "k int, v string")
    live = lambda: sorted((r["batch_id"], r["k"]) for r in io.live_rows(spark, path).collect())
    assert io.live_rows(spark, path) is None and not io.undo_last_append(spark, path, 0)
    assert [io.append_feedback(row, path, ["k", "v"]), io.append_feedback(row, path, ["k", "v"])] == [0, 1]
    with pytest.raises(ValueError):
        io.undo_last_append(spark, path, 1, undo_batch_id=0)
    assert io.undo_last_append(spark, path, 1) and live() == [(0, 1)]
    assert not io.undo_last_append(spark, path, 1)
    assert io.append_feedback(row, path, ["k", "v"], batch_id=1) == 1 and live() == [(0, 1), (1, 1)]
    assert io.append_feedback(row, path, ["k", "v"]) == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        io.live_rows(spark, str(tmp_path / "bad"))


def test_malformed_csv_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        io.read_table(spark, str(tmp_path / "t.csv"), "a int, b int").collect()
