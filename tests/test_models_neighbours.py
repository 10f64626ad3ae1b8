"""Models, rules, neighbours, DBSCAN, feedback log and stream (FIXTURES 22, 25
plus properties from SURVEY section 5)."""

import math
import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from strata.operators import explain as E
from strata.operators import models as M
from strata.operators import neighbours as NB
from strata.sources import io as IO


def _separable(spark, n=240):
    rows = []
    for i in range(n):
        c = i % 3
        rows.append((i, f"k{c}", float(c * 10 + (i % 7) * 0.5), float((i * 7919) % 13), float(c)))
    return spark.createDataFrame(rows, "id long, y string, a double, b double, c double")


@pytest.mark.parametrize("kind,name", [("dt", "Decision_Tree"), ("rf", "Random_Forest_Sampled"),
                                       ("lr", "M_L_R_Sampled")])
def test_classifiers_learn_separable(spark, kind, name):
    df = _separable(spark)
    p = [x for x in M.model_presets("standard") if x.name == name][0]
    p = M.Preset(p.name, p.kind, {**p.params, "numTrees": 10}, p.sampled, p.scaled)
    m = M.fit_classifier(df, ["a", "b"], "y", p)
    acc = m.transform(df).select(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.9


def test_extra_trees_and_samme_learn(spark):
    df = _separable(spark)
    et = M.fit_classifier(df, ["a", "b"], "y", M.Preset("et", "et", {"numTrees": 10, "maxDepth": 6,
                                                                   "minInstancesPerNode": 2}))
    ada = M.fit_classifier(df, ["a", "b"], "y", M.Preset("ada", "ada", {"maxDepth": 2, "rounds": 5,
                                                                     "learningRate": 1.0}))
    for m in (et, ada):
        out = m.transform(df)
        acc = out.select(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
        assert acc > 0.9
        s = out.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
        assert s[0] == pytest.approx(1.0) and s[1] == pytest.approx(1.0)


def test_rules_reproduce_tree_predictions(spark):
    df = _separable(spark)
    m = M.fit_classifier(df, ["a", "b"], "y", M.Preset("dt", "dt", {"maxDepth": 4}))
    rules = E.tree_rules(E.tree_nodes(spark, m), ["a", "b"], m.classes)
    out = E.apply_rules(m.transform(df), rules)
    assert out.filter(F.col("pred") != F.col("rule_class")).count() == 0


def test_pruning_only_removes_leaves(spark):
    df = _separable(spark)
    m = M.fit_classifier(df, ["a", "b"], "y", M.Preset("dt", "dt", {"maxDepth": 6}))
    nodes = E.tree_nodes(spark, m)
    assert E.prune_tree(nodes, 1.0).count() <= nodes.count()
    assert E.prune_tree(nodes, 10.0).count() == 1


def test_save_load_roundtrip(spark):
    df = _separable(spark)
    m = M.fit_classifier(df, ["a", "b"], "y", M.Preset("ada", "ada", {"maxDepth": 2, "rounds": 3}))
    root = tempfile.mkdtemp(prefix="strata-models-")
    IO.save_model(m, root, "Adaptive Boosting/1")
    loaded = IO.load_models(spark, [root])
    assert list(loaded) == ["Adaptive_Boosting_1"]
    a = m.transform(df).select("id", "pred")
    b = loaded["Adaptive_Boosting_1"].transform(df).select("id", F.col("pred").alias("p2"))
    assert a.join(b, "id").filter("pred <> p2").count() == 0


def test_knn_matches_brute_force(spark):
    pts = [(i, [math.sin(i) * 3, math.cos(i * 1.3) * 2, (i % 5) * 0.7]) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = {(r["key"], r["rank"]): r["nbr"] for r in NB.knn_join(df, "id", "v", 4, pivots=8, ring_size=16).collect()}
    for i, v in pts:
        d = sorted((math.dist(v, w), j) for j, w in pts if j != i)[:4]
        for rank, (_, j) in enumerate(d, start=1):
            assert got[(i, rank)] == j


def test_dbscan_fixture22(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.1]), (2, [0.2]), (3, [5.0])], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in NB.dbscan(df, "id", "v", eps=0.15, min_samples=2, pivots=2).collect()}
    assert got[0] == got[1] == got[2] != -1 and got[3] == -1


def test_lof_duplicate_free_lattice_near_one(spark):
    pts = [(i * 10 + j, [float(i), float(j)]) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    s = NB.lof_scores(df, "id", "v", k=4, pivots=8).filter("id = 55").first()
    assert s["lof"] == pytest.approx(1.0, abs=0.05)


def test_undo_fixture25(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="strata-log-"), "log")
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    IO.append_feedback(a, path, ["k", "v"], 1)
    IO.append_feedback(a.withColumn("k", F.lit(2)), path, ["k", "v"], 2)
    assert IO.undo_last_append(spark, path, 2, 10) is True
    assert sorted(r["k"] for r in IO.live_rows(spark, path).collect()) == [1]
    IO.append_feedback(a.withColumn("k", F.lit(3)), path, ["k", "v"], 3)
    assert IO.undo_last_append(spark, path, 1, 11) is False


def test_knn_impute_fixture15(spark):
    from strata.operators.impute import knn_impute
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 3.0, 30.0), (4, 4.0, None)], "k long, a double, b double")
    got = {r["k"]: r["b"] for r in knn_impute(df, "k", ["a", "b"], k=2, pivots=2).collect()}
    assert got[4] == pytest.approx(25.0)
    assert got[1] == 10.0


def test_knn_impute_leaves_present_cells(spark):
    from strata.operators.impute import knn_impute
    rows = [(i, float(i % 9) if i % 4 else None, float(i % 5) if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = {r["k"]: (r["a"], r["b"]) for r in knn_impute(df, "k", ["a", "b"], k=3, pivots=4).collect()}
    for k, a, b in rows:
        if a is not None:
            assert out[k][0] == a
        if b is not None:
            assert out[k][1] == b
        assert out[k][0] is not None and out[k][1] is not None


def _lists(nn):
    out = {}
    for r in nn.orderBy("key", "rank").collect():
        out.setdefault(r["key"], []).append(r["nbr"])
    return out


def test_knn_with_many_equal_points_keeps_as_many_as_a_result_can_hold(spark):
    """Equal points and tiles smaller than them: ties go to the smaller keys, a point is not its own neighbour."""
    pts = [(i, [float(i % 3), float(i % 3)]) for i in range(300)] + [(1000 + i, [float(i) * 7, -float(i)]) for i in range(40)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    index = NB.NeighbourIndex(df, "id", "v", ring_size=16)
    got = _lists(index.knn(4))
    for i, v in pts:
        assert got[i] == [j for _, j in sorted((math.dist(v, w), j) for j, w in pts if j != i)[:4]], i
    assert index._tiled(index.points.withColumn("_rn", F.lit(1)), ("_k", "_v")).n.max() <= 64  # a heavy value is cut into parts
    assert len(index.tree.dim) > 3


def test_knn_by_matrix_product_matches_brute_force(spark):
    """More coordinates than are summed up directly, far from the origin."""
    import random
    rng = random.Random(3)
    pts = [(i, [1000.0 + rng.random() for _ in range(12)]) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    got = _lists(NB.knn_join(df, "id", "v", 5, ring_size=32))
    for i, v in pts:
        assert got[i] == [j for _, j in sorted((math.dist(v, w), j) for j, w in pts if j != i)[:5]]


def test_dbscan_never_makes_the_pairs_of_a_dense_cloud_into_rows(spark):
    """Cores, links and border points come from pairs of tiles."""
    pts = [(i, [float(i % 20), float(i // 20) * 0.01]) for i in range(1200)] + [(5000, [19.9, 5.0]), (5001, [100.0, 0.0])]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    out = NB.dbscan(df, "id", "v", eps=0.5, min_samples=3, ring_size=64)
    got = {r["id"]: r["cluster"] for r in out.collect()}
    assert all(got[i] == i % 20 for i in range(1200)) and got[5000] == got[5001] == -1
    near = NB.eps_join(df, "id", "v", 0.5, ring_size=64).groupBy("key").count()
    want = {i: sum(math.dist(v, w) <= 0.5 for _, w in pts) for i, v in pts[:40]}
    assert {r["key"]: r["count"] for r in near.where("key < 40").collect()} == want


def test_mutual_information_asks_equal_points_once(spark):
    """Counts within a radius are those of all pairs, with equal points as one row."""
    df = spark.createDataFrame([(i, [float(i % 4)]) for i in range(200)], "id long, v array<double>")
    index = NB.NeighbourIndex(df, "id", "v", ring_size=16)
    asked = index.points.select("_v", F.when(F.col("_k") % 2 == 0, 0.0).otherwise(1.5).alias("_r")).withColumn("_ub", F.col("_r"))
    got = {(r["_v"][0], r["_r"]): r["hits"] for r in index.counts_within(asked).collect()}
    assert got == {(v, r): 50 if r == 0 else 50 * sum(abs(v - w) < 1.5 for w in range(4)) for v, r in [(0.0, 0.0), (1.0, 1.5), (2.0, 0.0), (3.0, 1.5)]}


def test_training_tables_are_dealt_by_their_cells(spark):
    assert M.fit_partitions(8_000, 64, 1, 6) == 2 and M.fit_partitions(100, 4, 1, 6) == 1
    assert M.fit_partitions(8_000, 64, 100, 6) == 12  # a forest: two for each core
    assert M.fit_partitions(600_000, 64, 1, 6) == 12 and M.fit_partitions(6_000_000, 64, 100, 6) == 92
    assert M._tree_params({"maxDepth": 30})["cacheNodeIds"] and not M._tree_params({"maxDepth": 5})["cacheNodeIds"]


def _two_classes(spark, n=90):
    return spark.createDataFrame([(i, "x" if i % 3 else "y", float(i % 3), float(i % 7)) for i in range(n)], "k long, y string, a double, b double")


def test_a_grid_shares_folds_and_cells_are_stored(spark, monkeypatch):
    from strata.operators import resample
    calls, plain = [], resample.repeated_stratified_kfold
    monkeypatch.setattr(resample, "repeated_stratified_kfold", lambda *a, **k: calls.append(1) or plain(*a, **k))
    grid = [{"maxDepth": 1, "minInstancesPerNode": 1}, {"maxDepth": 2, "minInstancesPerNode": 1}, {"maxDepth": -1, "impurity": "none"}]
    rows = {r["setting"]: r for r in M.grid_search(_two_classes(spark), ["a", "b"], "y", "k", "dt", grid, k=3).collect()}
    assert len(calls) == 1
    assert rows[0]["mean_score"] == rows[1]["mean_score"] == 1.0 and rows[0]["std_score"] == 0.0 and rows[2]["mean_score"] is None
    told = M.cross_validate(_two_classes(spark), ["a", "b"], "y", "k", M.Preset("dt", "dt", {"maxDepth": 2}), k=3, repeats=2)
    assert told.columns == ["k", "repeat", "fold", "y", "pred", "probs"]
    assert told.inputFiles()  # read back, not fitted or scored again by each metric
    assert told.groupBy("repeat").count().orderBy("repeat").collect() == [(0, 90), (1, 90)] and told.filter("pred <> y").count() == 0


def test_importance_of_all_features_at_once(spark, monkeypatch):
    from pyspark.sql import functions as F
    from strata.operators import evaluate, explain
    from strata.operators.ranks import average_rank, seeded_rank
    df = _two_classes(spark)
    m = M.fit_classifier(df, ["a", "b"], "y", M.Preset("dt", "dt", {"maxDepth": 2, "minInstancesPerNode": 1}))
    calls, plain = [], evaluate.metric_set
    monkeypatch.setattr(evaluate, "metric_set", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {r["feature"]: r for r in explain.permutation_importance(m, df, ["a", "b"], "y", "k").collect()}
    assert len(calls) == 2  # the baseline, and all features
    pos = average_rank(df, "k", out="_pos").withColumn("_pos", F.col("_pos").cast("long"))
    for f in ("a", "b"):  # as one join a feature has it
        donor = seeded_rank(df.select("k", f), 42, "k", out="_pos", extra_keys=[F.lit(f)]).select("_pos", F.col(f).alias("_perm"))
        one = pos.join(donor, "_pos").drop(f, "_pos").withColumnRenamed("_perm", f)
        assert abs(plain(m.transform(one), "y", "pred").first()["f1_macro"] - got[f]["permuted"]) < 1e-12
    assert got["a"]["importance"] > 0 and got["b"]["importance"] == 0


def test_classes_look_for_neighbours_at_once(spark, monkeypatch):
    """And the rows are those of one class after the other: on the line between a row and one of its class."""
    both, found = threading.Barrier(2, timeout=60), NB.knn_join
    monkeypatch.setattr(NB, "knn_join", lambda *a, **k: (both.wait(), found(*a, **k))[1])
    data = [(i, "abc"[0 if i < 20 else 1 if i < 26 else 2], float(i), i * 2.0) for i in range(33)]
    df = spark.createDataFrame(data, "id bigint, cls string, x double, y double")
    out = NB.smotenc_oversample(df, "id", "cls", ["x", "y"], [], {"b": 12, "c": 11, "a": 5})
    rows = out.collect()
    assert {c: sum(r["cls"] == c for r in rows) for c in "abc"} == {"a": 20, "b": 12, "c": 11}
    new = {c: [r for r in rows if r["cls"] == c and r["id"] < 0] for c in "bc"}
    assert all(r["y"] == pytest.approx(2 * r["x"]) for c in "bc" for r in new[c])
    assert all(20 <= r["x"] <= 25 for r in new["b"]) and all(26 <= r["x"] <= 32 for r in new["c"])


def test_a_single_tile_needs_no_box(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "id bigint, v array<double>")
    index = NB.NeighbourIndex(df, "id", "v")
    tiles = index._tiled(index.points)
    assert tiles.lo.max() < -1e300 and tiles.hi.min() > 1e300  # no aggregate over its coordinates
    assert list(tiles.ids) == [0] and list(tiles.n) == [12] and tiles.gaps(0, tiles).tolist() == [0.0]
