"""Fits that tasks make on their own: against MLlib, against plain counting, and what they must not depend on."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from strata.operators import models as M
from strata.operators import neighbours as NB
from strata.operators import taskfits as TF
from strata.operators import training as T
from strata.sources import io as IO

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, "abc"[i % 3 if i % 5 else 0], float(i % 3) + rng.normal(), float(rng.integers(0, 6)), float(rng.normal())) for i in range(400)]
    return spark.createDataFrame(data, "id bigint, label string, f0 double, f1 double, f2 double").cache()


def said(model, rows):
    return {r["id"]: r for r in model.transform(rows).select("id", "pred", "probs").collect()}


def agree(a, b, off=1e-9):
    assert len(a) == len(b) and all(a[i]["pred"] == b[i]["pred"] and a[i]["probs"] == pytest.approx(b[i]["probs"], abs=off) for i in a)


@pytest.mark.parametrize("preset, off", [
    (M.Preset("t", "dt", {"impurity": "entropy", "maxDepth": 5, "minInstancesPerNode": 8, "ccp_alpha": 0.005}), 1e-9),
    (M.Preset("t", "dt", {"impurity": "gini", "maxDepth": 4, "minInstancesPerNode": 3}, balanced=False), 1e-9),
    (M.Preset("b", "ada", {"impurity": "gini", "maxDepth": 3, "minInstancesPerNode": 8, "learningRate": 0.1, "rounds": 6}), 1e-9),
    (M.Preset("l", "lr", {"penalty": "l1", "C": 0.1}, scaled=True), 1e-4),
    (M.Preset("l", "lr", {"penalty": "l2", "C": 1.0}, scaled=True), 1e-4)], ids=["pruned", "tree", "boosting", "l1", "l2"])
def test_a_fit_in_a_task_is_the_one_of_mllib(rows, preset, off):
    own = M.fit_classifier(rows, FEATURES, "label", preset, at_once=4)
    assert own.kind == "packed" and M.fit_classifier(rows, FEATURES, "label", preset).kind != "packed"
    agree(said(own, rows), said(M.fit_classifier(rows, FEATURES, "label", preset), rows), off)


def test_a_forest_says_about_what_mllib_says(rows):
    preset = M.Preset("f", "rf", {"impurity": "entropy", "maxDepth": 4, "minInstancesPerNode": 4, "numTrees": 60})
    a, b = said(M.fit_classifier(rows, FEATURES, "label", preset, at_once=4), rows), said(M.fit_classifier(rows, FEATURES, "label", preset), rows)
    assert np.mean([a[i]["pred"] == b[i]["pred"] for i in a]) > 0.9 and np.mean([np.abs(np.subtract(a[i]["probs"], b[i]["probs"])).max() for i in a]) < 0.08


def test_extra_trees_are_one_job_and_do_not_depend_on_the_tasks(spark, rows, tmp_path):
    preset = M.Preset("e", "et", {"impurity": "entropy", "maxDepth": 30, "minInstancesPerNode": 2, "numTrees": 9})
    spark.sparkContext.setJobGroup("extra", "extra")
    model = M.fit_classifier(rows, FEATURES, "label", preset)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("extra"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10  # not some for each level of the trees
    assert model.kind == "packed" and len(model.packed) == 4
    again = M.fit_classifier(rows.repartition(7), FEATURES, "label", preset, at_once=99)
    assert len(again.packed) == 1
    told = said(model, rows)
    agree(told, said(again, rows))
    model.save(str(tmp_path / "m"))
    agree(told, said(M.FittedClassifier.load(spark, str(tmp_path / "m")), rows))
    assert model.transform(rows.limit(0)).count() == 0
    assert model.transform(rows.limit(1).withColumn("f1", F.lit(None).cast("double"))).first()["pred"] in "abc"


def test_large_tables_are_left_to_mllib_whose_extra_trees_say_about_the_same(rows, monkeypatch):
    preset = M.Preset("e", "et", {"impurity": "entropy", "maxDepth": 8, "minInstancesPerNode": 2, "numTrees": 80, "cuts": 4})
    own = said(M.fit_classifier(rows, FEATURES, "label", preset), rows)
    monkeypatch.setattr(TF, "TASK_CELLS", 400 * 3 - 1)
    model = M.fit_classifier(rows, FEATURES, "label", preset, at_once=4)
    assert model.kind == "et"
    other = said(model, rows)
    assert np.mean([own[i]["pred"] == other[i]["pred"] for i in own]) > 0.9 and np.mean([np.abs(np.subtract(own[i]["probs"], other[i]["probs"])).max() for i in own]) < 0.08


def test_numbers_that_are_none_and_unknown_settings_fail(rows):
    holes = rows.withColumn("f0", F.when(F.col("id") > 3, F.col("f0")))
    with pytest.raises(Exception, match="finite numbers"):
        M.fit_classifier(holes, FEATURES, "label", M.Preset("t", "dt", {"maxDepth": 2}), at_once=4)
    assert M.fit_classifier(holes, FEATURES, "label", M.Preset("e", "et", {"maxDepth": 3, "numTrees": 3})).kind == "packed"
    with pytest.raises(ValueError, match="impurity"):
        M.fit_classifier(rows, FEATURES, "label", M.Preset("t", "dt", {"impurity": "none"}), at_once=4)


def test_drawn_cuts_are_counted_as_by_hand():
    rng = np.random.default_rng(0)
    y, w, x = rng.integers(0, 3, 200), rng.random(200), rng.normal(size=(200, 4))
    for weights in (w, np.array([1.0, 2.0, 0.5])[y]):
        rows, codes = TF.Rows(y, weights, 3), rng.integers(0, 5, (4, 200)).astype(np.uint8)
        cuts = np.asarray([(f, c) for f in range(4) for c in range(4)])
        r = np.lexsort((y, node := (x[:, 0] > 0).astype(int)))
        pos = node[r]
        weight, n = np.asarray([np.bincount(y[node == m], weights[node == m], 3) for m in (0, 1)]), np.bincount(node)
        gain, f, c = TF.drawn_search(rows, codes, cuts, "gini", 5, 16, np.random.default_rng(1))(r, pos, weight, n)
        for m in (0, 1):
            best = -np.inf
            for g, d in cuts:
                left = (node == m) & (codes[g] <= d)
                right = (node == m) & ~(codes[g] <= d)
                if min(left.sum(), right.sum()) >= 5:
                    sides = [np.bincount(y[s], weights[s], 3) for s in (left, right)]
                    gini = lambda v: v.sum() - (v * v).sum() / v.sum()
                    best = max(best, (gini(weight[m]) - sum(map(gini, sides))) / weight[m].sum())
            assert gain[m] == pytest.approx(best)
    picks = TF.drawn(np.random.default_rng(3), 4000, 5, 8)
    assert all(len(set(p)) == 5 for p in picks) and np.bincount(picks.ravel(), minlength=8) == pytest.approx(2500, rel=0.1)


def test_a_run_fits_in_tasks_and_counts_classes_once(spark, rows, tmp_path, monkeypatch):
    def counted(*a):
        raise AssertionError("classes are counted when folds and parts are made")

    monkeypatch.setattr(M, "class_counts", counted)
    run = T.TrainingRun(str(tmp_path / "run"), FEATURES, "label", "id", k=2, repeats=1, rebalance=lambda part, target: part)
    presets = [M.Preset("Tree", "dt", {"maxDepth": 3}), M.Preset("Forest_Sampled", "rf", {"maxDepth": 3, "numTrees": 3}, sampled=True), M.Preset("Logistic", "lr", {"C": 1.0}, scaled=True)]
    assert {r["model"]: (r["status"], r["error"]) for r in T.train_all_store(rows, run, presets).collect()} == {p.name: ("stored", None) for p in presets}
    models = IO.load_models(spark, [run.path("models")], suffixes=("",))
    assert {n: m.kind for n, m in models.items()} == {"Tree": "packed", "Forest_Sampled": "packed", "Logistic": "packed"}
    assert run.part_counts(0, 1) == run.rebalanced_counts["0-1"] and sum(run.rebalanced_counts["all"].values()) == run.rows == 400


def test_classes_grow_together_whatever_their_number_and_keys(spark, monkeypatch):
    calls, found = [], NB.knn_join
    monkeypatch.setattr(NB, "knn_join", lambda *a, **k: calls.append(1) or found(*a, **k))
    rng = np.random.default_rng(1)
    data = [(i % 7, f"c{c}", 100.0 * c + float(rng.random()), "uv"[i % 2] + str(c)) for c in range(5) for i in range(9)]  # keys in all classes, some twice
    df = spark.createDataFrame(data, "id bigint, cls string, x double, tag string")
    out = NB.smotenc_oversample(df, "id", "cls", ["x"], ["tag"], {f"c{c}": 30 for c in range(5)})
    new = out.where("id < 0").collect()
    assert len(calls) == NB.CLASSES_AT_ONCE and {r["cls"] for r in new} == {f"c{c}" for c in range(5)}
    assert all(100 * int(r["cls"][1]) <= r["x"] <= 100 * int(r["cls"][1]) + 1 and r["tag"][1] == r["cls"][1] for r in new)
    with pytest.raises(ValueError, match="no points"):
        NB.smotenc_oversample(df, "id", "cls", ["x"], [], {"none": 3})
    assert NB.smotenc_oversample(df, "id", "cls", ["x"], [], {"c0": 2}).count() == df.count()


def test_the_registered_run_has_the_folds_of_the_operator():
    import inspect

    from strata.plans import training as P
    told = inspect.signature(T.TrainingRun).parameters
    assert (P.FOLDS, P.REPEATS) == (told["k"].default, told["repeats"].default) == (5, 5)
    sql = E.oracle_sql()
    assert "% 5 AS fold" in sql["train_all_store"] and "range(5)" in sql["train_all_store"]
    assert "% 2 AS fold" in sql["evaluate_stored_models"] and "range(1)" in sql["evaluate_stored_models"]  # its SQL stays


def test_blocks_of_tiles_meet_and_find_the_same_neighbours(spark):
    x = np.random.default_rng(7).normal(size=(600, 12)).round(1)
    x[100:140] = x[100]  # equal points
    df = spark.createDataFrame([(i, "uv"[i % 2], v.tolist()) for i, v in enumerate(x)], "id bigint, g string, v array<double>")
    index = NB.NeighbourIndex(df, "id", "v", ring_size=16)
    tiles = index._tiled(index.points)
    rows, n = tiles.rows.select("_k", "_v", "_tile"), len(tiles.ids)

    def count(left, right):
        return pa.table({"left": [left.num_rows], "right": [right.num_rows]})

    every = [(int(t), int(s)) for t in tiles.ids for s in tiles.ids]
    met = index._met(rows, rows, every, count, "left bigint, right bigint").agg(F.sum("left"), F.sum(F.col("left") * F.col("right"))).first()
    assert n >= 24 and met[0] <= 600 * (NB.LEAST_BLOCKS + 2) < 600 * n and met[1] == 600 * 600  # handed on for blocks, all pairs met
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for group in (None, "g"):
        got = {}
        for r in NB.NeighbourIndex(df, "id", "v", group, ring_size=16).knn(4).collect():
            got.setdefault(r["key"], {})[r["rank"]] = r["nbr"]
        for i in range(600):
            others = [j for j in range(600) if j != i and (group is None or j % 2 == i % 2)]
            assert [got[i][k] for k in (1, 2, 3, 4)] == sorted(others, key=lambda j: (np.floor(d[i, j] * 1e9 + 0.5), j))[:4]
