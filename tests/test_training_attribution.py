"""Training runs, Shapley contributions, local surrogates, Kendall's tau-b, quarantined reads, byte-bounded broadcasts."""

import itertools
import math
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import attribution as A
from strata.operators import chartdata, joins, profile, ranks, recode
from strata.operators import models as M
from strata.operators import training as T
from strata.sources import io

FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def rows(spark):
    """90 rows of three classes that the first two features tell apart, and a row without a label."""
    rng = np.random.default_rng(2)
    data = [(i, "abc"[i % 3], float(i % 3) + 0.3 * rng.normal(), float((i % 3) ** 2) + 0.3 * rng.normal(), float(rng.normal())) for i in range(90)]
    return spark.createDataFrame([*data, (1000, None, 0.0, 0.0, 0.0)], "id bigint, label string, f0 double, f1 double, f2 double").cache()


PRESETS = [M.Preset("Tree", "dt", {"impurity": "gini", "maxDepth": 3}), M.Preset("Tree_Sampled", "dt", {"maxDepth": 2}, sampled=True), M.Preset("No such kind", "xx"),
           M.Preset("Logistic", "lr", {"penalty": "l2", "C": 1.0}, scaled=True), M.Preset("Boosted", "ada", {"maxDepth": 1, "rounds": 4, "learningRate": 0.5})]


@pytest.fixture(scope="module")
def run(spark, rows, tmp_path_factory):
    calls = []

    def rebalance(part, target):
        calls.append(target)
        return part.withColumn("_n", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("label").orderBy("id"))).where(F.col("_n") <= target).drop("_n")

    run = T.TrainingRun(str(tmp_path_factory.mktemp("run")), FEATURES, "label", "id", k=3, repeats=2, rebalance=rebalance, concurrent=4)
    run.status = {r["model"]: r for r in T.train_all_store(rows, run, PRESETS).collect()}
    run.calls = calls
    return run


def test_training_survives_a_failing_model(run):
    assert run.status["No such kind"]["status"] == "failed" and "unknown model kind" in run.status["No such kind"]["error"]
    assert all(r["status"] == "stored" and r["folds"] == 6 and r["error"] is None for n, r in run.status.items() if n != "No such kind")


def test_rebalanced_parts_are_shared(run):
    # six folds at ((90 // 3) * 2) // 3 rows a class, and the refit at its floor of 500
    assert sorted(run.calls) == [20] * 6 + [500]


def test_every_row_is_predicted_once_a_repeat(spark, run):
    told = T.stored_predictions(spark, run).where("split = 'CrossVal'")
    counts = told.groupBy("model", "repeat").agg(F.count("key").alias("n"), F.countDistinct("key").alias("d")).collect()
    assert len(counts) == 8 and all(r["n"] == r["d"] == 90 for r in counts)
    assert told.where("key = 1000").isEmpty()


def test_metrics_equal_sql_over_the_stored_files(spark, run, rows):
    told = T.predict_splits(spark, run, rows.withColumn("id", F.col("id") + 5000))
    metrics = {(r["model"], r["split"]): r for r in T.evaluate_splits(told, run.classes).collect()}
    plain = duckdb.sql(f"""
        WITH p AS (SELECT * FROM read_parquet('{run.root}/predictions/*/*/*/*/*.parquet', hive_partitioning = true) WHERE true_label IS NOT NULL),
        t AS (SELECT model, split, true_label AS c, count(*) AS s, count(*) FILTER (pred = true_label) AS h FROM p GROUP BY ALL), g AS (SELECT model, split, pred AS c, count(*) AS g FROM p GROUP BY ALL)
        SELECT model, split, sum(COALESCE(h, 0)) / sum(COALESCE(s, 0)), avg(2 * COALESCE(h, 0) / (COALESCE(s, 0) + COALESCE(g, 0))) FROM t FULL JOIN g USING (model, split, c) GROUP BY ALL""").fetchall()
    assert len(plain) == len(metrics) == 12
    for model, split, accuracy, f1 in plain:
        assert metrics[model, split]["accuracy"] == pytest.approx(accuracy) and metrics[model, split]["f1_macro"] == pytest.approx(f1)
        assert metrics[model, split]["roc_auc_macro"] is not None
    assert metrics["Logistic", "CrossVal"]["accuracy"] > 0.9
    table = {r["model"]: r for r in T.stored_f1_by_split(T.evaluate_splits(told, run.classes)).collect()}
    assert all(r["CrossVal"] is not None and r["Train"] is not None and r["Test"] is not None for r in table.values())
    best = T.promote_stored(T.evaluate_splits(told), run, "best").first()
    assert M.FittedClassifier.load(spark, best["path"]).classes == ["a", "b", "c"]


def test_a_second_call_goes_on_where_the_first_stopped(spark, run, rows, monkeypatch):
    fits = []
    monkeypatch.setattr(T, "fit_classifier", lambda *a, **k: fits.append(1))
    again = T.train_all_store(rows, run, [p for p in PRESETS if p.name != "No such kind"])
    assert not fits and {r["status"] for r in again.collect()} == {"stored"}


def test_missing_folds_are_refitted(spark, rows, tmp_path):
    run = T.TrainingRun(str(tmp_path / "run"), FEATURES, "label", "id", k=3, repeats=1)
    run.begin(rows)
    run.refit_cell(spark, PRESETS[0])
    told = T.predict_splits(spark, run, rows)
    assert {(r["split"], r["n"]) for r in told.groupBy("split").agg(F.count("key").alias("n")).collect()} == {("CrossVal", 90), ("Train", 90), ("Test", 90)}
    with pytest.raises(ValueError, match="no training run"):
        T.predict_splits(spark, T.TrainingRun(str(tmp_path / "none"), FEATURES, "label", "id"), rows)


def test_plain_presets_do_not_wait_for_rebalancing(spark, rows, tmp_path, monkeypatch):
    fitted = threading.Event()
    fit = T.fit_classifier
    monkeypatch.setattr(T, "fit_classifier", lambda part, features, label, preset, **k: (fit(part, features, label, preset, **k), preset.sampled or fitted.set())[0])

    def rebalance(part, target):
        assert fitted.wait(60), "no plain model was fitted while rows were rebalanced"
        return part

    run = T.TrainingRun(str(tmp_path / "run"), FEATURES, "label", "id", k=2, repeats=1, rebalance=rebalance, concurrent=8)
    assert {r["model"]: r["status"] for r in T.train_all_store(rows, run, PRESETS[:2]).collect()} == {"Tree": "stored", "Tree_Sampled": "stored"}


def test_rebalancing_that_fails_is_raised(spark, rows, tmp_path):
    def rebalance(part, target):
        raise RuntimeError("cannot be rebalanced")

    run = T.TrainingRun(str(tmp_path / "run"), FEATURES, "label", "id", k=2, repeats=1, rebalance=rebalance, concurrent=2)
    with pytest.raises(RuntimeError, match="cannot be rebalanced"):
        T.train_all_store(rows, run, PRESETS[:2])


def test_fits_that_go_at_once_share_the_cores(spark, rows, monkeypatch):
    known = M._indexed(rows.where("label IS NOT NULL"), "label", ["a", "b", "c"])

    def parts(n_rows, n):
        return M._training_table(known, FEATURES, None, n_rows, 100, ["a", "b", "c"], {"a": 30, "b": 30, "c": 30}, n).rdd.getNumPartitions()

    cores = spark.sparkContext.defaultParallelism
    assert parts(1_000_000, 1) == 2 * cores and parts(1_000_000, 100) == 2 * min(cores, M.LEAST_SHARE)
    assert parts(20_000, 100) == parts(20_000, 1)  # a small table alike
    monkeypatch.setattr(M, "LEAST_SHARE", 1)
    assert [parts(1_000_000, n) for n in (2, 100)] == [2 * max(1, cores // 2), 2]


def test_printed_trees_predict_like_the_model(spark, rows):
    known = rows.where("label IS NOT NULL")
    data = M._assembler(FEATURES).transform(M._indexed(known, "label", ["a", "b", "c"]))
    fitted = M.DecisionTreeClassifier(labelCol=M.LABEL_IDX, featuresCol=M.FEATURES, maxDepth=6).fit(data)
    trees = [M.tree_rows_from_text(fitted.toDebugString)]
    got = fitted.transform(data).withColumn("own", M.forest_expression(trees, FEATURES, "pred")[0])
    assert got.where("own != prediction").isEmpty() and len(trees[0]) == fitted.numNodes


# --- attribution -----------------------------------------------------------------------------------------------------

def linear():
    return A.LinearScorer(FEATURES, ["a", "b"], [[1.0, -2.0, 0.0], [0.5, 0.25, 3.0]], [0.1, -1.0])


def test_contributions_of_linear_scores_are_exact(spark, rows):
    few = rows.where("id < 12")
    background = A.background_rows(rows.where("id >= 50"), "id", FEATURES, 7)
    found = {(r["id"], r["class"], r["feature"]): r for r in A.shapley_sampling(linear(), few, background, FEATURES, "id", orders=3).collect()}
    assert len(found) == 12 * 2 * 3 and background.shape == (7, 3)
    for r in few.collect():
        for c, w, b in zip("ab", linear().weights, linear().intercepts):
            for j, f in enumerate(FEATURES):
                got = found[r["id"], c, f]
                assert got["contribution"] == pytest.approx(w[j] * (r[f] - background[:, j].mean()), abs=1e-9)
                assert got["base"] == pytest.approx(b + sum(v * m for v, m in zip(w, background.mean(axis=0))))
                assert got["prediction"] == pytest.approx(b + sum(v * r[g] for v, g in zip(w, FEATURES)))


def test_contributions_of_a_tree_add_up_and_converge(spark, rows):
    model = M.fit_classifier(rows, FEATURES, "label", PRESETS[0])
    background = A.background_rows(rows, "id", FEATURES, 10)
    few = rows.where("id IN (0, 1, 2)")
    found = A.shapley_sampling(model, few, background, FEATURES, "id", orders=2)
    gaps = found.groupBy("id", "class").agg((F.sum("contribution") - F.max("prediction") + F.max("base")).alias("gap")).collect()
    assert len(gaps) == 9 and all(abs(r["gap"]) < 1e-9 for r in gaps)
    # against all orders of the features
    said = {}
    hybrids = [(r["id"], i, bits, *[r[f] if bits >> j & 1 else float(background[i, j]) for j, f in enumerate(FEATURES)]) for r in few.collect() for i in range(10) for bits in range(8)]
    for r in model.transform(spark.createDataFrame(hybrids, "id bigint, i int, bits int, f0 double, f1 double, f2 double")).collect():
        said[r["id"], r["i"], r["bits"]] = r["probs"]
    many = {(r["id"], r["class"], r["feature"]): r["contribution"] for r in A.shapley_sampling(model, few, background, FEATURES, "id", orders=120).collect()}
    for (i, c, f), got in many.items():
        j, k = FEATURES.index(f), model.classes.index(c)
        exact = np.mean([said[i, b, sum(1 << x for x in order[:order.index(j) + 1])][k] - said[i, b, sum(1 << x for x in order[:order.index(j)])][k] for b in range(10) for order in itertools.permutations(range(3))])
        assert got == pytest.approx(exact, abs=0.03)


def test_repeated_keys_and_no_background(spark, rows):
    two = rows.where("id = 3").unionAll(rows.where("id = 3"))
    background = A.background_rows(rows, "id", FEATURES, 5)
    one = {(r["class"], r["feature"]): r["contribution"] for r in A.shapley_sampling(linear(), rows.where("id = 3"), background, FEATURES, "id").collect()}
    got = A.shapley_sampling(linear(), two, background, FEATURES, "id").collect()
    assert len(got) == 6 and all(r["contribution"] == pytest.approx(one[r["class"], r["feature"]]) for r in got)
    assert A.shapley_sampling(linear(), rows.limit(0), background, FEATURES, "id").collect() == []
    with pytest.raises(ValueError, match="background"):
        A.shapley_sampling(linear(), rows, A.background_rows(rows.limit(0), "id", FEATURES), FEATURES, "id")


def test_path_of_an_instance(spark, rows):
    background = A.background_rows(rows, "id", FEATURES, 20)
    path = A.instance_explanation(linear(), rows, [4, 8], background, FEATURES, "id").orderBy("id", "class", "step").collect()
    assert [(r["id"], r["class"], r["step"]) for r in path] == [(i, c, s) for i in (4, 8) for c in "ab" for s in (1, 2, 3)]
    whole = {(r["id"], r["class"]): r for r in A.shapley_sampling(linear(), rows.where("id IN (4, 8)"), background, FEATURES, "id").collect()}
    for first, mid, last in zip(path[::3], path[1::3], path[2::3]):
        key = first["id"], first["class"]
        assert first["before"] == pytest.approx(whole[key]["base"]) and last["after"] == pytest.approx(whole[key]["prediction"]) and mid["before"] == pytest.approx(first["after"])
        assert abs(first["contribution"]) >= abs(mid["contribution"]) >= abs(last["contribution"])


def test_surrogate_recovers_a_linear_model(spark, rows):
    scales = {"f0": 0.5, "f1": 2.0, "f2": 0.0}
    found = A.local_surrogate(linear(), rows.where("id IN (1, 2)"), FEATURES, "id", scales, samples=400, top=2).collect()
    assert len(found) == 2 * 2 * 2
    for r in found:
        w = linear().weights["ab".index(r["class"])][FEATURES.index(r["feature"])]
        assert r["coefficient"] == pytest.approx(w, abs=1e-8) and r["weight"] == pytest.approx(w * scales[r["feature"]], abs=1e-8)
    # a feature that cannot vary has no weight, so it comes last
    assert {r["feature"] for r in found} == {"f0", "f1"}
    gaps = spark.createDataFrame([(1, 1.0, None, 2.0), (2, 1.0, 1.0, 2.0), (2, 1.0, 1.0, 2.0)], "id bigint, f0 double, f1 double, f2 double")
    assert {r["id"] for r in A.local_surrogate(linear(), gaps, FEATURES, "id", {"f0": 1.0, "f1": 1.0, "f2": 1.0}, samples=50).collect()} == {2}
    model = M.fit_classifier(rows, FEATURES, "label", PRESETS[3])
    near = {(r["class"], r["feature"]): r["weight"] for r in A.local_surrogate(model, rows.where("id = 1"), FEATURES, "id", {"f0": 0.01, "f1": 0.01, "f2": 0.01}, samples=200).collect()}
    assert abs(near["b", "f2"]) < max(abs(near["b", "f0"]), abs(near["b", "f1"]))


# --- Kendall, Spearman, heat map -------------------------------------------------------------------------------------

def tau_b(x, y):
    pairs = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and not math.isnan(a) and not math.isnan(b)]
    score = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        s = (a > c) - (a < c)
        t = (b > d) - (b < d)
        score, tx, ty = score + s * t, tx + (s != 0), ty + (t != 0)
    return score / math.sqrt(tx * ty) if tx and ty else None


@pytest.mark.parametrize("bucket", [50_000, 7])
def test_kendall_with_ties_and_gaps(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranks, "BUCKET_VALUES", bucket)
    rng = np.random.default_rng(5)
    columns = {"a": rng.integers(0, 6, 150).astype(float).tolist(), "b": rng.normal(size=150).tolist(), "c": rng.integers(0, 40, 150).astype(float).tolist(), "d": [1.0] * 150}
    columns["c"] = [x + 0.5 * y for x, y in zip(columns["c"], columns["a"])]
    columns["a"][3], columns["b"][7], columns["c"][11] = None, float("nan"), None
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double, c double, d double")
    got = {(r["x"], r["y"]): r["corr"] for r in profile.correlation_matrix(df, list(columns), "kendall").collect()}
    assert set(got) == set(itertools.combinations("abcd", 2))
    for (x, y), value in got.items():
        want = tau_b(columns[x], columns[y])
        assert value is None if want is None else value == pytest.approx(want, abs=1e-12)
    assert profile.correlation_matrix(df.limit(0), ["a", "b"], "kendall").collect() == []


def test_spearman_equals_pearson_of_ranks(spark):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, 200).astype(float), rng.normal(size=200)
    y[5] = np.nan
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    fine = ~np.isnan(y)
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    got = profile.correlation_matrix(df, ["a", "b"], "spearman").first()["corr"]
    assert got == pytest.approx(np.corrcoef(rank(x[fine]), rank(y[fine]))[0, 1])


def test_heat_map_has_every_cell(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (3.0, 0.5, 5.0)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["corr"] for r in chartdata.heatmap_data(df, ["a", "b", "c"], "kendall").collect()}
    assert got["a", "a"] == 1.0 and got["a", "b"] == got["b", "a"] == pytest.approx(-1.0) and got["c", "c"] is None and got["a", "c"] is None and len(got) == 9


# --- sources, joins, derived features --------------------------------------------------------------------------------

def test_malformed_rows_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([("1,2.5,x",), ("2,no number,y",), ("3",), ("4,1.0,z,more",), ("5,NaN,",), ("6,,\"a,b\"",)], "value string").coalesce(1).write.text(path)
    good, bad = io.read_quarantined(spark, path, "id int, price double, name string", header=False)
    assert sorted((r["id"], r["price"], r["name"]) for r in good.collect()) == [(1, 2.5, "x"), (5, None, None), (6, None, "a,b")]
    # the same rows whichever columns a query reads
    assert sorted(r["id"] for r in good.select("id").collect()) == [1, 5, 6]
    assert sorted(r["line"] for r in bad.collect()) == ["2,no number,y", "3", "4,1.0,z,more"]
    assert bad.count() == 3 and good.count() == 3


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("t"), F.array("id").alias("a"))
    assert joins.is_small(wide) and not joins.is_small(wide, max_bytes=100_000) and not joins.is_small(wide, max_rows=49)
    assert joins.join_small(wide, wide.select("id", F.col("t").alias("u")), "id", "inner", max_bytes=1000).count() == 50
    assert joins.is_small(wide.limit(0))


@pytest.mark.parametrize("columns, want", [
    (["TAU", "PTAU", "ABETA", "Hippocampus", "ICV"], {"TAU/ABETA", "PTAU/ABETA", "Hippocampus/ICV"}), (["TAU", "ABETA", "Hippocampus"], {"TAU/ABETA", "Hippocampus"}), (["PTAU", "ABETA"], {"PTAU/ABETA"}),
    (["TAU", "PTAU"], {"TAU", "PTAU"}), (["ABETA", "ICV"], {"ABETA"})])
def test_derived_features_by_what_is_there(spark, columns, want):
    df = spark.createDataFrame([tuple(float(i + 1) for i in range(len(columns))), (None, *[0.0] * (len(columns) - 1))], ", ".join(f"`{c}` double" for c in columns)).withColumn("k", F.lit(1))
    assert set(recode.derive_features(df).columns) == want | {"k"}


def test_hybrids_are_scored_in_the_task_where_the_scorer_can(spark):
    """A scorer with ``scores`` is never asked to transform hybrids, and contributions are the same either way."""
    class Closed(A.LinearScorer):
        def transform(self, df):
            raise AssertionError("hybrids went through a DataFrame")

    class Open:
        def __init__(self, scorer):
            self.classes, self.transform = scorer.classes, scorer.transform

    own = (["a", "b", "c"], ["x", "y"], [[1.0, -2.0, 0.5], [0.0, 3.0, 1.0]], [0.25, -1.0])
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, -1.0, 0.0, 4.0), (2, -1.0, 0.0, 4.0), (3, None, 1.0, 1.0)], "id long, a double, b double, c double")
    background = np.array([[0.0, 1.0, 2.0], [2.0, 2.0, -1.0]])
    told = [{(r["id"], r["class"], r["feature"]): (r["contribution"], r["base"], r["prediction"]) for r in A.shapley_sampling(s, rows, background, own[0], "id").collect()} for s in (Closed(*own), Open(A.LinearScorer(*own)))]
    assert told[0].keys() == told[1].keys() and len(told[0]) == 18
    for k in told[0]:
        assert told[0][k] == pytest.approx(told[1][k], abs=1e-9, nan_ok=True), k
