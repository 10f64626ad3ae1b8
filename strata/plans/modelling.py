"""Registered queries: classifiers, tuning, scoring with models, explanations
(SURVEY 2.13, 2.14, 2.16 Q1, 2.17, 2.1 S6/S7).

Model fits are not SQL-expressible: these queries have no oracle and are
checked for row counts by the driver and for behaviour in tests. The
learning set is ``embeddings``: 64 float features, 10 labels.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import explain as E
from ..operators import models as M
from ..operators import neighbours as NB
from ..operators import resample as RS
from ..operators.ranks import exact_quantiles
from ..session import checkpoint_dir
from .common import r6, table
from .registry import register

DIMS = 64
FEATURES = [f"e{i}" for i in range(DIMS)]


def learning_set(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])


def _split(spark, sf):
    d = RS.stratified_holdout(learning_set(spark, sf), "label", "vec_id", 0.2, 42).cache()
    return d.filter("split = 'train'").drop("split"), d.filter("split = 'test'").drop("split")


def _preset(kind: str, name: str, preset: str = "standard"):
    return [p for p in M.model_presets(preset) if p.kind == kind and p.name == name][0]


def _rebalanced(train):
    """R6 with the R7 fold target."""
    counts = RS.class_counts(train, "label")
    target = RS.fold_resample_target(sum(counts.values()), 5, len(counts))
    return NB.hybrid_resample(train, "vec_id", "label", FEATURES, [], target).drop("position")


def _holdout_metrics(spark, sf, preset):
    train, test = _split(spark, sf)
    if preset.sampled:  # R6 on the training part only (no leakage)
        train = _rebalanced(train)
    m = M.fit_classifier(train, FEATURES, "label", preset)
    pred = m.transform(test).select("vec_id", "label", "pred", "probs").cache()  # scored once, read by every metric
    ms = V.metric_set(pred, "label", "pred", probs="probs", classes=m.classes)
    return ms.select(F.lit(preset.name).alias("model"), *[r6(c).alias(c) for c in ms.columns])


@register("decision_tree")
def q_decision_tree(spark, sf):
    return _holdout_metrics(spark, sf, _preset("dt", "Decision_Tree"))


@register("random_forest")
def q_random_forest(spark, sf):
    return _holdout_metrics(spark, sf, _preset("rf", "Random_Forest"))


@register("extra_trees")
def q_extra_trees(spark, sf):
    return _holdout_metrics(spark, sf, _preset("et", "Extra_Trees"))


@register("adaboost")
def q_adaboost(spark, sf):
    return _holdout_metrics(spark, sf, _preset("ada", "Adaptive_Boosting"))


@register("multinomial_logistic")
def q_multinomial_logistic(spark, sf):
    return _holdout_metrics(spark, sf, _preset("lr", "M_L_R"))


@register("sampled_decision_tree")
def q_sampled_decision_tree(spark, sf):
    return _holdout_metrics(spark, sf, _preset("dt", "Decision_Tree_Sampled"))


@register("cross_validate")
def q_cross_validate(spark, sf):
    """Leak-free repeated stratified CV of the decision tree: per
    fold accuracy and macro F1, plus the pooled row."""
    d = learning_set(spark, sf)
    preds = M.cross_validate(d, FEATURES, "label", "vec_id", _preset("dt", "Decision_Tree"), k=5, repeats=5)
    per = V.metric_set(preds, "label", "pred", by=["repeat", "fold"]).select(
        F.col("repeat").cast("string").alias("repeat"), F.col("fold").cast("string").alias("fold"),
        r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"))
    pooled = V.metric_set(preds, "label", "pred").select(F.lit("all").alias("repeat"), F.lit("all").alias("fold"),
                                                          r6("accuracy").alias("accuracy"), r6("f1_macro").alias("f1_macro"))
    return per.unionByName(pooled)


@register("grid_search")
def q_grid_search(spark, sf):
    """The whole grid of the logistic regression, 5-fold CV."""
    return M.grid_search(learning_set(spark, sf), FEATURES, "label", "vec_id", "lr", M.param_grid("lr"), k=5)


# Fixed values: (kind, settings) of the tuning grids and the published presets, as literals for the oracle.
@register("param_grids", """
SELECT kind, settings, params, settings * (SELECT count(label) FROM embeddings) AS predictions
FROM (VALUES ('ada', 162, 5), ('dt', 90, 4), ('et', 216, 5), ('lr', 8, 2), ('rf', 216, 5)) t(kind, settings, params)
""")
def q_param_grids(spark, sf):
    """Distinct settings of each grid, and the predictions that a search of it makes on the learning set."""
    rows = [(kind, json.dumps(g, sort_keys=True), len(g)) for kind in ("dt", "rf", "et", "ada", "lr") for g in M.param_grid(kind)]
    n = learning_set(spark, sf).agg(F.count("label").alias("n"))
    return spark.createDataFrame(rows, "kind string, setting string, params int").groupBy("kind", "params").agg(
        F.countDistinct("setting").cast("int").alias("settings")).crossJoin(F.broadcast(n)).select("kind", "settings", "params", (F.col("settings") * F.col("n")).alias("predictions"))  # one row


@register("model_presets", """
WITH c AS (SELECT count(label) AS n, count(DISTINCT label) AS k FROM embeddings)
SELECT preset, model, impurity, depth, leaf, sampled, balanced, CASE WHEN sampled THEN greatest(n // k, 500) * k ELSE n END AS rows FROM (VALUES
  ('standard', 'Decision_Tree', 'entropy', 5, 8, false, true), ('standard', 'Decision_Tree_Sampled', 'gini', 5, 8, true, true),
  ('standard', 'Random_Forest', 'entropy', 6, 4, false, true), ('standard', 'Random_Forest_Sampled', 'entropy', 6, 4, true, true),
  ('standard', 'Extra_Trees', 'entropy', 30, 4, false, true), ('standard', 'Extra_Trees_Sampled', 'gini', 30, 8, true, true),
  ('standard', 'Adaptive_Boosting', 'gini', 4, 8, false, true), ('standard', 'Adaptive_Boosting_Sampled', 'gini', 4, 8, true, true),
  ('standard', 'M_L_R', NULL, NULL, NULL, false, true), ('standard', 'M_L_R_Sampled', NULL, NULL, NULL, true, true),
  ('alternative', 'Decision_Tree', 'gini', 5, 2, false, true), ('alternative', 'Decision_Tree_Sampled', 'entropy', 5, 2, true, true),
  ('alternative', 'Random_Forest', 'gini', 6, 2, false, true), ('alternative', 'Random_Forest_Sampled', 'gini', 6, 4, true, true),
  ('alternative', 'Extra_Trees', 'gini', 30, 4, false, true), ('alternative', 'Extra_Trees_Sampled', 'gini', 6, 8, true, true),
  ('alternative', 'Adaptive_Boosting', 'gini', 6, 8, false, true), ('alternative', 'Adaptive_Boosting_Sampled', 'gini', 6, 2, true, true),
  ('alternative', 'M_L_R', NULL, NULL, NULL, false, true), ('alternative', 'M_L_R_Sampled', NULL, NULL, NULL, true, true)
) t(preset, model, impurity, depth, leaf, sampled, balanced), c
""")
def q_model_presets(spark, sf):
    """M7: the published presets, and the rows that each is refitted on (R7: rebalanced ones have equal classes)."""
    counts = RS.class_counts(learning_set(spark, sf).where("label IS NOT NULL"), "label")
    n, k = sum(counts.values()), len(counts)
    rows = [(name, p.name, p.params.get("impurity"), p.params.get("maxDepth"), p.params.get("minInstancesPerNode"), p.sampled, p.balanced, RS.final_resample_target(n, k) * k if p.sampled else n)
            for name in ("standard", "alternative") for p in M.model_presets(name)]
    return spark.createDataFrame(rows, "preset string, model string, impurity string, depth int, leaf int, sampled boolean, balanced boolean, rows bigint")


@register("score_batch")
def q_score_batch(spark, sf):
    """Q1: score the whole table with two fitted models (per-model rows)."""
    train, _ = _split(spark, sf)
    full = learning_set(spark, sf)
    out = None
    for p in [_preset("dt", "Decision_Tree"), _preset("lr", "M_L_R")]:
        m = M.fit_classifier(train, FEATURES, "label", p)
        part = m.transform(full).select("vec_id", F.lit(p.name).alias("model"), "pred",
                                        r6(F.array_max("probs")).alias("top_p"))
        out = part if out is None else out.unionByName(part)
    return out


def _tree(spark, sf, name="Decision_Tree"):
    train, _ = _split(spark, sf)
    p = _preset("dt", name)
    return M.fit_classifier(train, FEATURES, "label", p), p


@register("tree_rules")
def q_tree_rules(spark, sf):
    """if/then rules of the fitted tree, one row per leaf."""
    m, _ = _tree(spark, sf)
    return E.tree_rules(E.tree_nodes(spark, m), FEATURES, m.classes)


@register("prune_tree")
def q_prune_tree(spark, sf):
    """M1 alpha: weakest-link pruning, at the preset's ccp_alpha, of a tree that was grown without."""
    train, _ = _split(spark, sf)
    p = _preset("dt", "Decision_Tree")
    m = M.fit_classifier(train, FEATURES, "label", M.Preset(p.name, p.kind, {**p.params, "ccp_alpha": 0.0}))
    pruned = E.prune_tree(E.tree_nodes(spark, m), float(p.params.get("ccp_alpha", 0.0)))
    return E.tree_rules(pruned, FEATURES, m.classes)


@register("apply_model_rules")
def q_apply_model_rules(spark, sf):
    """E2 on a fitted tree: rule predictions next to the model's own."""
    m, _ = _tree(spark, sf)
    rules = E.tree_rules(E.tree_nodes(spark, m), FEATURES, m.classes)
    scored = m.transform(learning_set(spark, sf))
    return E.apply_rules(scored, rules).select("vec_id", "pred", "rule_class")


_Q = "quantile_cont"


@register("apply_rules", f"""
WITH s AS (SELECT {_Q}(c_acctbal, 0.5) AS a, {_Q}(CAST(c_nationkey AS DOUBLE), 0.5) AS b FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal <= a AND c_nationkey <= b THEN 'low-low'
                       WHEN c_acctbal <= a AND c_nationkey > b THEN 'low-high'
                       WHEN c_acctbal > a AND c_nationkey <= b THEN 'high-low' ELSE 'high-high' END AS rule_class
FROM customer, s
""")
def q_apply_rules(spark, sf):
    """E2 with a rules table derived from the data (medians as thresholds)."""
    c = table(spark, sf, "customer")
    med = exact_quantiles(c, "c_acctbal", [0.5]).select(F.col("_p")[0].alias("a")).crossJoin(
        exact_quantiles(c, "c_nationkey", [0.5]).select(F.col("_p")[0].alias("b")))
    rules = med.select(F.explode(F.array(
        *[F.struct(F.lit(i).alias("rule_id"), cond.alias("condition"), F.lit(lab).alias("class"))
          for i, (cond, lab) in enumerate([
              (F.format_string("`c_acctbal` <= %.17g AND `c_nationkey` <= %.17g", "a", "b"), "low-low"),
              (F.format_string("`c_acctbal` <= %.17g AND `c_nationkey` > %.17g", "a", "b"), "low-high"),
              (F.format_string("`c_acctbal` > %.17g AND `c_nationkey` <= %.17g", "a", "b"), "high-low"),
              (F.format_string("`c_acctbal` > %.17g AND `c_nationkey` > %.17g", "a", "b"), "high-high")])])).alias("r")
    ).select("r.*")
    return E.apply_rules(c, rules).select("c_custkey", "rule_class")


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """E3 on all embedding features of a decision tree."""
    feats = FEATURES
    train, test = _split(spark, sf)
    m = M.fit_classifier(train, feats, "label", _preset("dt", "Decision_Tree"))
    imp = E.permutation_importance(m, test, feats, "label", "vec_id")
    return imp.select("feature", r6("baseline").alias("baseline"), r6("permuted").alias("permuted"),
                      r6("importance").alias("importance"))


def _model_dir(spark) -> str:
    return os.path.join(checkpoint_dir(spark), "models", uuid.uuid4().hex)


@register("save_load_models")
def q_save_load_models(spark, sf):
    """Save under a cleaned name, load every model of the folder back and
    score with the loaded copies."""
    from ..sources.io import load_models, save_model
    train, _ = _split(spark, sf)
    root = _model_dir(spark)
    for p in [_preset("dt", "Decision_Tree"), _preset("lr", "M_L_R")]:
        save_model(M.fit_classifier(train, FEATURES, "label", p), root, p.name)
    models = load_models(spark, [root])
    full = learning_set(spark, sf)
    out = None
    for name, m in models.items():
        part = m.transform(full).select("vec_id", F.lit(name).alias("model"), "pred")
        out = part if out is None else out.unionByName(part)
    return out


@register("export_rules")
def q_export_rules(spark, sf):
    """Rules written as text, read back."""
    m, _ = _tree(spark, sf)
    path = _model_dir(spark) + "_rules"
    E.export_rules(E.tree_rules(E.tree_nodes(spark, m), FEATURES, m.classes), path)
    return spark.read.text(path)
