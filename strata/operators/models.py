"""Classifiers, presets, tuning and persistence.

Every model is a Spark ML fit: the data never leave the executors. MLlib
covers the decision tree, random forest and multinomial logistic
regression; extra trees and SAMME boosting are built from MLlib trees:

* extra trees: each tree sees the features cut at random thresholds
  (uniform between the feature's min and max), so MLlib's split search can
  only choose among random cuts; no bootstrap; probabilities averaged.
* SAMME: a driver loop of weighted MLlib trees; the weighted error is one
  aggregate per round and lineage is cut with a reliable checkpoint.

A fitted model maps a DataFrame with the feature columns to the same
DataFrame plus ``pred`` (label string) and ``probs`` (array<double> in
``classes`` order).
"""

from __future__ import annotations

import functools
import json
import math
import os
import random
import re
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recode import array_shares, bound_to
from ..session import checkpoint_dir, cut_lineage
from . import taskfits
from .encode import fit_z_score
from .resample import balanced_class_weights, class_counts
from .select import q

LABEL_IDX = "_label_idx"
FEATURES = "_features"
ET_FEATURES = "_et_features"


def cut_indicators(features: Sequence[str], cuts: Mapping[str, Sequence[float]]) -> Column:
    """Extra trees: one 0/1 feature per random cut, [x_f > c]. A forest
    whose nodes sample a random subset of these indicators evaluates random
    (feature, threshold) candidates at every node, as extra trees do, and
    all trees train in one distributed fit."""
    from pyspark.ml.functions import array_to_vector
    def above(f):
        x = F.col(q(f)).cast("double")
        return lambda c: F.coalesce(x > c, F.lit(False)).cast("double")
    parts = [F.transform(_sql_array(cuts[f]), above(f)) for f in features if cuts.get(f)]
    return array_to_vector(F.flatten(F.array(*parts)) if parts else F.array(F.lit(0.0)))


#: Model fits that the driver submits at once.
PARALLEL_FITS = 8
#: Cells (rows x features) of a training table that are worth a task in each pass.
CELLS = 1 << 18
#: Cores that a fit counts on at least beside others (a small table has the same parts beside them as alone).
LEAST_SHARE = 4


@dataclass
class Preset:
    """M7: one named pipeline: estimator kind, hyper-parameters, whether the
    training data are rebalanced first, whether features are z-scored, and
    whether classes weigh alike in the fit (all presets: balanced weights)."""
    name: str
    kind: str  # dt | rf | et | ada | lr
    params: dict = field(default_factory=dict)
    sampled: bool = False
    scaled: bool = False
    balanced: bool = True


# The reference's two presets (standard / alternative), each
# plain and rebalanced ("_Sampled").
PRESETS = {
    "standard": [
        Preset("Decision_Tree", "dt", {"impurity": "entropy", "maxDepth": 5, "minInstancesPerNode": 8, "ccp_alpha": 0.005}),
        Preset("Decision_Tree_Sampled", "dt", {"impurity": "gini", "maxDepth": 5, "minInstancesPerNode": 8,
                                               "ccp_alpha": 0.0}, sampled=True),
        Preset("Random_Forest", "rf", {"impurity": "entropy", "maxDepth": 6, "featureSubsetStrategy": "all",
                                       "minInstancesPerNode": 4, "numTrees": 100}),
        Preset("Random_Forest_Sampled", "rf", {"impurity": "entropy", "maxDepth": 6, "featureSubsetStrategy": "all",
                                               "minInstancesPerNode": 4, "numTrees": 50}, sampled=True),
        Preset("Extra_Trees", "et", {"impurity": "entropy", "maxDepth": 30, "minInstancesPerNode": 4, "numTrees": 75}),
        Preset("Extra_Trees_Sampled", "et", {"impurity": "gini", "maxDepth": 30, "minInstancesPerNode": 8,
                                             "numTrees": 75}, sampled=True),
        Preset("Adaptive_Boosting", "ada", {"impurity": "gini", "maxDepth": 4, "minInstancesPerNode": 8,
                                            "learningRate": 0.1, "rounds": 50}),
        Preset("Adaptive_Boosting_Sampled", "ada", {"impurity": "gini", "maxDepth": 4, "minInstancesPerNode": 8,
                                                    "learningRate": 0.1, "rounds": 50}, sampled=True),
        Preset("M_L_R", "lr", {"penalty": "l1", "C": 0.1}, scaled=True),
        Preset("M_L_R_Sampled", "lr", {"penalty": "l1", "C": 1.0}, sampled=True, scaled=True),
    ],
    "alternative": [
        Preset("Decision_Tree", "dt", {"impurity": "gini", "maxDepth": 5, "minInstancesPerNode": 2, "ccp_alpha": 0.01}),
        Preset("Decision_Tree_Sampled", "dt", {"impurity": "entropy", "maxDepth": 5, "minInstancesPerNode": 2,
                                               "ccp_alpha": 0.01}, sampled=True),
        Preset("Random_Forest", "rf", {"impurity": "gini", "maxDepth": 6, "featureSubsetStrategy": "0.8",
                                       "minInstancesPerNode": 2, "numTrees": 100}),
        Preset("Random_Forest_Sampled", "rf", {"impurity": "gini", "maxDepth": 6, "featureSubsetStrategy": "0.5",
                                               "minInstancesPerNode": 4, "numTrees": 100}, sampled=True),
        Preset("Extra_Trees", "et", {"impurity": "gini", "maxDepth": 30, "featureSubsetStrategy": "0.8",
                                     "minInstancesPerNode": 4, "numTrees": 100}),
        Preset("Extra_Trees_Sampled", "et", {"impurity": "gini", "maxDepth": 6, "minInstancesPerNode": 8,
                                             "numTrees": 100}, sampled=True),
        Preset("Adaptive_Boosting", "ada", {"impurity": "gini", "maxDepth": 6, "minInstancesPerNode": 8,
                                            "learningRate": 0.05, "rounds": 100}),
        Preset("Adaptive_Boosting_Sampled", "ada", {"impurity": "gini", "maxDepth": 6, "minInstancesPerNode": 2,
                                                    "learningRate": 0.05, "rounds": 50}, sampled=True),
        Preset("M_L_R", "lr", {"penalty": "l2", "C": 1.0}, scaled=True),
        Preset("M_L_R_Sampled", "lr", {"penalty": "l2", "C": 1.0}, sampled=True, scaled=True),
    ],
}


def model_presets(name: str) -> list[Preset]:
    """M7: preset list by name (case-insensitive); unknown -> error."""
    key = name.strip().lower()
    if key not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; choose one of {sorted(PRESETS)}")
    return list(PRESETS[key])


def _tree_params(p: Mapping, keep=("impurity", "maxDepth", "minInstancesPerNode", "seed", "maxBins",
                                    "maxMemoryInMB", "cacheNodeIds")) -> dict:
    out = {k: v for k, v in p.items() if k in keep}
    out["maxDepth"] = min(int(out.get("maxDepth", 5)), 30)  # MLlib's deepest tree
    # Per-task histogram buffer: bounds how many nodes one pass splits, not
    # the result. Every concurrent task holds one, so keep it modest.
    out.setdefault("maxMemoryInMB", 96)
    # Tasks of a deep forest get the rows' nodes, not all trees grown so far, with each pass.
    out.setdefault("cacheNodeIds", out["maxDepth"] > 10)
    return out


def tree_rows(tree_model) -> list[dict]:
    """Node rows of a fitted MLlib tree (bounded by the tree size), read back
    from its saved form in the shared checkpoint folder."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = os.path.join(checkpoint_dir(spark), "trees", uuid.uuid4().hex)
    tree_model.write().overwrite().save(path)
    out = []
    for r in spark.read.parquet(path + "/data").collect():
        stats = list(r["impurityStats"] or [])
        tot = sum(stats) or 1.0
        thr = r["split"]["leftCategoriesOrThreshold"]
        out.append({"id": r["id"], "left": r["leftChild"], "right": r["rightChild"],
                    "fi": r["split"]["featureIndex"], "thr": float(thr[0]) if thr else None,
                    "pred": int(r["prediction"]), "probs": [float(x) / tot for x in stats],
                    "impurity": float(r["impurity"]), "n": int(r["rawCount"])})
    return out


_SPLIT_LINE = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def tree_rows_from_text(text: str) -> list[dict]:
    """Node rows (split, children and class only) of a fitted MLlib tree from its printed form, which has thresholds in full:
    a boosted member votes for a class, so nothing has to be written and read back for it."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]
    rows: list[dict] = []
    at = 0

    def add() -> int:
        nonlocal at
        i = len(rows)
        row = {"id": i, "left": -1, "right": -1, "fi": -1, "thr": None, "pred": 0, "probs": [], "impurity": 0.0, "n": 0}
        rows.append(row)
        line, at = lines[at], at + 1
        if split := _SPLIT_LINE.fullmatch(line):
            row["fi"], row["thr"] = int(split[1]), float(split[2])
            row["left"] = add()
            at += 1  # the line of the opposite condition
            row["right"] = add()
        else:
            row["pred"] = int(float(line.removeprefix("Predict: ")))
        return i

    add()
    return rows


def forest_expression(trees: list[list[dict]], features: Sequence[str], leaf: str = "probs") -> Column:
    """Trees as flat literal node arrays plus a bounded traversal per tree
    (``aggregate`` over depth steps): the expression size does not grow with
    the trees, Catalyst sees a handful of literals, and scoring is row-local.
    Returns, per tree, the leaf's class-probability array (``leaf='probs'``)
    or the leaf's class index ('pred') as an array over trees."""
    fi, thr, left, right, leaf_p, leaf_c, roots = [], [], [], [], [], [], []
    depth = 1
    for rows in trees:
        base = len(fi)
        pos = {r["id"]: base + i for i, r in enumerate(rows)}
        roots.append(pos[0])
        for r in rows:
            inner = r["left"] >= 0
            fi.append(int(r["fi"]) if inner else -1)
            t = r["thr"] if inner else 0.0
            thr.append(float(t) if t is not None else 0.0)
            left.append(pos[r["left"]] if inner else -1)
            right.append(pos[r["right"]] if inner else -1)
            leaf_p.append([float(v) for v in r["probs"]])
            leaf_c.append(int(r["pred"]))
        depth = max(depth, _depth(rows))
    x = F.array(*[F.col(q(c)).cast("double") for c in features])
    FI, THR, L, R = _sql_array(fi), _sql_array(thr), _sql_array(left), _sql_array(right)

    def step(n, _):
        f = FI[n]
        return (F.when(f < 0, n)
                .when(F.get(x, f) <= THR[n], L[n])
                .otherwise(R[n]))
    leaves = F.transform(_sql_array(roots), lambda r: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), r, step))
    if leaf == "probs":
        P = _sql_array(leaf_p)
        return F.transform(leaves, lambda g: P[g])
    C = _sql_array(leaf_c)
    return F.transform(leaves, lambda g: C[g])


def _sql_literal(v) -> str:
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(x) for x in v) + ")"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    v = float(v)
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return repr(v) + "D"


def _sql_array(values) -> Column:
    """One array literal parsed once by the JVM (not one call per element)."""
    return F.expr(_sql_literal(list(values)))


def _depth(rows: list[dict]) -> int:
    by_id = {r["id"]: r for r in rows}
    best, stack = 0, [(0, 0)]
    while stack:
        i, d = stack.pop()
        best = max(best, d)
        r = by_id[i]
        if r["left"] >= 0:
            stack += [(r["left"], d + 1), (r["right"], d + 1)]
    return best + 1


def prune_rows(rows: list[dict], alpha: float) -> list[dict]:
    """Weakest-link cost-complexity pruning (the ccp_alpha MLlib lacks):
    collapse the internal node with the smallest
    g(t) = (R(t) - R(subtree)) / (leaves - 1), R = n_t / n * impurity,
    while g <= alpha."""
    if alpha <= 0 or not rows:
        return rows
    by_id = {r["id"]: dict(r) for r in rows}
    total = float(by_id[0]["n"]) or 1.0

    def walk(i):
        r = by_id[i]
        own = r["n"] / total * r["impurity"]
        if r["left"] < 0:
            return own, 1, [(0.0, i)][:0]
        lr, ll, lc = walk(r["left"])
        rr, rl, rc = walk(r["right"])
        sub, leaves = lr + rr, ll + rl
        return sub, leaves, lc + rc + [((own - sub) / (leaves - 1), i)]

    while True:
        _, _, cands = walk(0)
        if not cands:
            break
        g, i = min(cands)
        if g > alpha:
            break
        by_id[i]["left"], by_id[i]["right"] = -1, -1
    keep, stack = set(), [0]
    while stack:
        i = stack.pop()
        keep.add(i)
        if by_id[i]["left"] >= 0:
            stack += [by_id[i]["left"], by_id[i]["right"]]
    return [by_id[i] for i in sorted(keep)]


class FittedClassifier:
    """A fitted model: ``transform(df)`` adds ``pred`` and ``probs``.

    kinds: 'pipeline' (one MLlib PipelineModel: tree, forest, logistic),
    'et' (one over random cuts), 'trees' (tree node tables scored as
    expressions: 'avg' averages the trees' probabilities, 'samme' combines
    weighted votes, one pruned tree) and 'packed' (what ``taskfits`` made;
    modes 'avg', 'cuts' (extra trees), 'samme' and 'linear').
    """

    def __init__(self, kind: str, features: Sequence[str], classes: Sequence[str], pipeline=None,
                 trees: list | None = None, weights: Sequence[float] | None = None, mode: str = "avg",
                 scaling: Mapping | None = None, cuts: Mapping | None = None, packed: Sequence[bytes] | None = None):
        self.kind = kind
        self.features = list(features)
        self.classes = list(classes)
        self.pipeline = pipeline
        self.trees = trees or []
        self.weights = list(weights or [1.0] * len(self.trees))
        self.mode = mode
        self.scaling = dict(scaling or {})
        self.cuts = dict(cuts or {})
        self.packed = list(packed or [])

    def _scaled(self, df: DataFrame) -> DataFrame:
        if not self.scaling:
            return df
        return df.select(*[((F.col(q(c)).cast("double") - F.lit(self.scaling[c][0])) / F.lit(self.scaling[c][1])).alias(c)
                           if c in self.scaling else F.col(q(c)) for c in df.columns])

    def probability_expression(self) -> Column:
        """'trees' kind: class probabilities as one expression over the features."""
        k = len(self.classes)
        zero = F.array(*[F.lit(0.0) for _ in range(k)])
        if self.mode == "avg":
            members = forest_expression(self.trees, self.features, "probs")
            total = F.aggregate(members, zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))
            return F.transform(total, lambda x: x / float(len(self.trees)))
        # samme: decision_k = sum(alpha_m ([pred_m = k] - [pred_m != k] / (K - 1))) / sum(alpha); probs = softmax(decision / (K - 1))
        wsum = sum(self.weights) or 1.0
        W = _sql_array([w / wsum for w in self.weights])
        votes = F.col("_votes")  # materialised once per row by transform()
        dec = F.transform(zero, lambda _, j: F.aggregate(
            F.sequence(F.lit(0), F.size(votes) - 1), F.lit(0.0),
            lambda acc, m: acc + F.when(votes[m] == j, W[m]).otherwise(-W[m] / float(max(k - 1, 1)))))
        return bound_to(F.transform(dec, lambda x: F.exp(x / float(max(k - 1, 1)))), array_shares)

    def transform(self, df: DataFrame, pred: str = "pred", probs: str = "probs") -> DataFrame:
        labels = F.array(*[F.lit(c) for c in self.classes])
        if self.kind in ("pipeline", "et"):
            stash = {c: f"_orig_{j}" for j, c in enumerate(self.features)}
            kept = self._scaled(df.select("*", *[F.col(q(c)).alias(a) for c, a in stash.items()]))
            if self.kind == "et":
                kept = kept.withColumn(ET_FEATURES, cut_indicators(self.features, self.cuts))
            scored = self.pipeline.transform(kept)
            out = (scored.withColumn(probs, vector_to_array("probability"))
                   .drop("probability", "rawPrediction", "prediction", FEATURES, ET_FEATURES, *self.features)
                   .withColumnsRenamed({a: c for c, a in stash.items()}))
        else:
            stash = {c: f"_orig_{j}" for j, c in enumerate(self.features)} if self.scaling else {}
            kept = df.select("*", *[F.col(q(c)).alias(a) for c, a in stash.items()]) if stash else df
            out = self._scaled(kept)
            if self.kind == "packed":
                told = taskfits.scorer(self.packed, "avg" if self.mode == "cuts" else self.mode, len(self.features))(taskfits.features_of(self.features, "et" if self.mode == "cuts" else ""))
            else:
                if self.mode == "samme":
                    out = out.withColumn("_votes", forest_expression(self.trees, self.features, "pred"))
                told = self.probability_expression()
            out = out.withColumn(probs, told).drop("_votes")
            if stash:
                out = out.drop(*self.features).withColumnsRenamed({a: c for c, a in stash.items()})
        arg = F.array_position(F.col(probs), F.array_max(F.col(probs)))
        return out.withColumn(pred, labels[arg - 1])

    # ---- persistence
    def save(self, path: str) -> None:
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(os.path.join(path, "pipeline"))
        if self.kind == "packed":
            from pyspark.sql import SparkSession
            spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            spark.createDataFrame([*enumerate(self.packed)], "part int, packed binary").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "packed"))
        meta = {"kind": self.kind, "features": self.features, "classes": self.classes, "trees": self.trees,
                "weights": self.weights, "mode": self.mode, "scaling": self.scaling, "cuts": self.cuts}
        _write_text(path + "/meta.json", json.dumps(meta))

    @staticmethod
    def load(spark, path: str) -> "FittedClassifier":
        meta = json.loads(_read_text(spark, path + "/meta.json"))
        pipe = PipelineModel.load(os.path.join(path, "pipeline")) if meta["kind"] in ("pipeline", "et") else None
        packed = [bytes(r["packed"]) for r in spark.read.parquet(os.path.join(path, "packed")).orderBy("part").collect()] if meta["kind"] == "packed" else None
        return FittedClassifier(meta["kind"], meta["features"], meta["classes"], pipe, meta["trees"], meta["weights"],
                                meta["mode"], {k: tuple(v) for k, v in (meta["scaling"] or {}).items()},
                                meta.get("cuts"), packed)


def _write_text(path: str, text: str) -> None:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def _indexed(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn(LABEL_IDX, F.try_element_at(m, F.col(q(label)).cast("string")))


def fit_partitions(rows: int, features: int, trees: int, parallelism: int) -> int:
    """Parts of a training table: one for each ``CELLS`` cells (a forest works on each row once a tree), as every pass of a fit
    starts a task for each; over two for each core only so that no part has more than 16 times as many cells."""
    cells = rows * features
    work = cells * trees // 8 if trees > 1 else cells
    return max(1, -(-cells // (16 * CELLS)), min(-(-work // CELLS), 2 * parallelism))


def _training_table(data: DataFrame, features: Sequence[str], weight: str | None, rows: int, trees: int, classes: Sequence[str], counts: Mapping, at_once: int = 1) -> DataFrame:
    """The columns that a fit reads, kept for its passes in parts of a size, for its share of the cores. The label says how many classes there are, which
    MLlib would otherwise look for in a job of its own before each fit."""
    seen = [str(c) for c in counts]
    known = [c for i, c in enumerate(classes) if any(x in seen for x in classes[i:])]  # up to the last one with rows
    told = {"ml_attr": {"type": "nominal", "name": LABEL_IDX, "vals": known}} if known else {}
    cores = data.sparkSession.sparkContext.defaultParallelism
    parts = fit_partitions(rows, len(features), trees, min(cores, max(LEAST_SHARE, cores // at_once)))
    narrow = data.select(*[q(c) for c in dict.fromkeys(features)], LABEL_IDX, *([q(weight)] if weight else [])).repartition(parts)
    return narrow.withColumn(LABEL_IDX, F.col(LABEL_IDX).alias(LABEL_IDX, metadata=told)).cache()


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")


def packed_mode(kind: str, cells: int, at_once: int) -> str | None:
    """How a fit that tasks make on their own is scored, or nothing where MLlib fits: tables that no task should hold, and
    single fits of the kinds that its passes are good enough for. Extra trees would be 16 indicators a feature there."""
    if cells > taskfits.TASK_CELLS or (at_once == 1 and kind != "et"):
        return None
    return {"dt": "avg", "rf": "avg", "et": "cuts", "ada": "samme", "lr": "linear"}.get(kind)


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, preset: Preset,
                   weight: str | None = None, seed: int = 42, classes: Sequence[str] | None = None,
                   counts: Mapping | None = None, at_once: int = 1) -> FittedClassifier:
    """M1-M5: fit one preset on ``train`` (features = numeric columns).
    Without a ``weight`` column a balanced preset weighs rows by
    n / (classes * rows of the class). ``counts``, the rows of each class
    where they are known, save a pass. ``at_once``: fits that share the cores;
    where a task can hold the rows such a fit, and any of extra trees, is made
    in tasks (``taskfits``), beyond that in passes of MLlib."""
    p = dict(preset.params)
    train = train.filter(F.col(q(label)).isNotNull())
    if counts is None:
        counts = class_counts(train, label)
    if classes is None:
        classes = sorted(str(c) for c in counts)
    if weight is None and preset.balanced:
        weight = "_class_weight"
        train = balanced_class_weights(train, label, weight, counts)
    data = _indexed(train, label, classes)
    scaling = fit_z_score(data, list(features)) if preset.scaled else {}
    if scaling:
        data = data.select(*[((F.col(q(c)).cast("double") - F.lit(scaling[c][0])) / F.lit(scaling[c][1])).alias(c)
                             if c in scaling else F.col(q(c)) for c in data.columns])
    if mode := packed_mode(preset.kind, sum(counts.values()) * len(features), at_once):
        share = max(1, data.sparkSession.sparkContext.defaultParallelism // at_once)
        packed = taskfits.fit(data, features, LABEL_IDX, weight, preset.kind, p, seed, len(classes), share)
        return FittedClassifier("packed", features, classes, mode=mode, scaling=scaling, packed=packed)
    trees = int(p.get("numTrees", 100)) if preset.kind in ("rf", "et") else 1
    table = _training_table(data, features, weight, sum(counts.values()), trees, classes, counts, at_once)
    try:
        return _fit(table, features, preset, p, weight, seed, classes, scaling)
    finally:
        table.unpersist()


def _fit(data: DataFrame, features, preset, p, weight, seed, classes, scaling) -> FittedClassifier:
    wkw = {"weightCol": weight} if weight else {}
    if preset.kind == "dt":
        est = DecisionTreeClassifier(labelCol=LABEL_IDX, featuresCol=FEATURES, seed=seed, **_tree_params(p), **wkw)
        m = Pipeline(stages=[_assembler(features), est]).fit(data)
        alpha = float(p.get("ccp_alpha", 0.0) or 0.0)
        if alpha > 0:  # MLlib has no cost-complexity pruning: prune the node table, score it as an expression
            rows = prune_rows(tree_rows(m.stages[-1]), alpha)
            return FittedClassifier("trees", features, classes, trees=[rows], mode="avg", scaling=scaling)
        return FittedClassifier("pipeline", features, classes, pipeline=m, scaling=scaling)
    if preset.kind == "rf":
        est = RandomForestClassifier(labelCol=LABEL_IDX, featuresCol=FEATURES, seed=seed,
                                     numTrees=int(p.get("numTrees", 100)),
                                     featureSubsetStrategy=str(p.get("featureSubsetStrategy", "all")),
                                     **_tree_params(p), **wkw)
        m = Pipeline(stages=[_assembler(features), est]).fit(data)
        return FittedClassifier("pipeline", features, classes, pipeline=m, scaling=scaling)
    if preset.kind == "lr":
        n_w = data.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
        C = float(p.get("C", 1.0))
        est = LogisticRegression(labelCol=LABEL_IDX, featuresCol=FEATURES, family="multinomial",
                                 elasticNetParam=1.0 if p.get("penalty", "l2") == "l1" else 0.0,
                                 regParam=1.0 / (C * float(n_w)), standardization=False,
                                 maxIter=int(p.get("maxIter", 200)), **wkw)
        m = Pipeline(stages=[_assembler(features), est]).fit(data)
        return FittedClassifier("pipeline", features, classes, pipeline=m, scaling=scaling)
    if preset.kind == "et":
        rng = random.Random(seed)
        n_cuts = int(p.get("cuts", 16))
        frac = p.get("featureSubsetStrategy", "all")
        frac = 1.0 if frac == "all" else len(features) ** -0.5 if frac == "sqrt" else float(frac)
        r = data.agg(*[x for c in features for x in (F.min(q(c)).alias(f"lo|{c}"), F.max(q(c)).alias(f"hi|{c}"))]).first()
        cuts = {}
        for f in features:
            lo, hi = r[f"lo|{f}"], r[f"hi|{f}"]
            cuts[f] = (sorted(rng.uniform(float(lo), float(hi)) for _ in range(n_cuts))
                       if lo is not None and hi is not None and hi > lo else [])
        est = RandomForestClassifier(labelCol=LABEL_IDX, featuresCol=ET_FEATURES, seed=seed,
                                     numTrees=int(p.get("numTrees", 100)), bootstrap=False, subsamplingRate=1.0,
                                     featureSubsetStrategy=repr(min(1.0, frac / max(n_cuts, 1))),
                                     **{**_tree_params(p), "maxBins": 2}, **wkw)
        m = Pipeline(stages=[est]).fit(data.withColumn(ET_FEATURES, cut_indicators(features, cuts)))
        return FittedClassifier("et", features, classes, pipeline=m, scaling=scaling, cuts=cuts)
    if preset.kind == "ada":
        return _fit_samme(data, features, classes, p, weight, seed, scaling)
    raise ValueError(f"unknown model kind {preset.kind}")


def _fit_samme(data: DataFrame, features, classes, p, weight, seed, scaling) -> FittedClassifier:
    """M4: multiclass SAMME boosting of weighted MLlib trees.

    Features are assembled once, into a narrow table of (vector, label, class weight) that all rounds read; only the
    weight column changes. One aggregate per round gives both the weighted error and the new weight total
    (sum w*(1-miss) + e^alpha * sum w*miss), so a round is one tree fit plus one aggregate. ``weight`` (class weights)
    multiplies the boosting weights in the trees' fits only. Lineage is cut with a reliable checkpoint every few rounds."""
    k = len(classes)
    lr = float(p.get("learningRate", 1.0))
    rounds = int(p.get("rounds", 50))
    own = _assembler(features).transform(data).select(FEATURES, LABEL_IDX, (F.col(q(weight)).cast("double") if weight else F.lit(1.0)).alias("_class"))
    own = cut_lineage(own)
    cur = own.withColumn("_w", F.lit(1.0 / max(1, own.count())))
    trees, alphas = [], []
    for r in range(rounds):
        est = DecisionTreeClassifier(labelCol=LABEL_IDX, featuresCol=FEATURES, weightCol="_fit_w", seed=seed + r, **_tree_params(p))
        m = est.fit(cur.withColumn("_fit_w", F.col("_w") * F.col("_class")))
        scored = m.transform(cur).select(FEATURES, LABEL_IDX, "_class", "_w", (F.col("prediction") != F.col(LABEL_IDX)).cast("double").alias("_miss"))
        g = scored.agg(F.sum(F.col("_w") * F.col("_miss")).alias("wm"), F.sum("_w").alias("w")).first()
        e = (g["wm"] / g["w"]) if g["w"] else None
        if e is None or e >= 1.0 - 1.0 / k:
            if not trees:
                trees, alphas = [tree_rows_from_text(m.toDebugString)], [1.0]
            break
        trees.append(tree_rows_from_text(m.toDebugString))
        if e <= 0:
            alphas.append(1.0)
            break
        alpha = lr * (math.log((1.0 - e) / e) + math.log(k - 1))
        alphas.append(alpha)
        new_total = (g["w"] - g["wm"]) + math.exp(alpha) * g["wm"]
        nxt = scored.select(FEATURES, LABEL_IDX, "_class", (F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(new_total)).alias("_w"))
        prev, cur = cur, (cut_lineage(nxt) if (r + 1) % 10 == 0 else nxt.cache())
        if r:
            prev.unpersist()
    cur.unpersist()
    return FittedClassifier("trees", features, classes, trees=trees, weights=alphas, mode="samme", scaling=scaling)


# ------------------------------------------------------------------ tuning G1-G3

def param_grid(kind: str) -> list[dict]:
    """Hyper-parameter grids per model kind (cartesian products)."""
    import itertools
    # Fixed values. 30 is MLlib's deepest tree, for no limit; MLlib has no smallest size of a node that may be
    # split, so min_samples_split is listed and recorded but has no effect on the fit.
    forest = {"numTrees": [50, 75, 100], "maxDepth": [30, 6, 4], "minInstancesPerNode": [2, 4, 8],
              "featureSubsetStrategy": ["0.5", "0.8", "all", "sqrt"], "impurity": ["gini", "entropy"]}
    grids = {
        "dt": {"impurity": ["gini", "entropy"], "min_samples_split": [2, 4, 8], "minInstancesPerNode": [2, 4, 8],
               "ccp_alpha": [0.0, 0.001, 0.005, 0.01, 0.05]},
        "rf": forest,
        "et": forest,
        "ada": {"rounds": [50, 75, 100], "learningRate": [0.01, 0.05, 0.1], "maxDepth": [30, 6, 4],
                "minInstancesPerNode": [2, 4, 8], "impurity": ["gini", "entropy"]},
        "lr": {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
    }[kind]
    keys = list(grids)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grids[k] for k in keys])]


@dataclass
class StoredFolds:
    """Learning rows dealt to the folds of each repeat, written once below the shared checkpoint folder by (repeat, fold), so
    that a fit reads its own folds only, with the rows of each class there. Predictions are written beside them, cell by cell."""

    path: str
    features: Sequence[str]
    label: str
    key: str
    k: int
    repeats: int
    seed: int
    classes: Sequence[str]
    counts: dict

    @staticmethod
    def write(df: DataFrame, features: Sequence[str], label: str, key: str, k: int, repeats: int, seed: int, classes: Sequence[str] | None) -> StoredFolds:
        from .resample import repeated_stratified_kfold
        spark = df.sparkSession
        path = os.path.join(checkpoint_dir(spark), "folds", uuid.uuid4().hex)
        rows = df.filter(F.col(q(label)).isNotNull()).select(*[q(c) for c in dict.fromkeys([key, label, *features])])
        per = class_counts(rows, label)
        salt = F.pmod(F.xxhash64(q(key)), F.lit(1 + sum(per.values()) * len(features) // (16 * CELLS)))  # files of a size
        repeated_stratified_kfold(rows, label, key, k, repeats, seed).repartition("repeat", "fold", salt).write.partitionBy("repeat", "fold").parquet(path + "/rows")
        if classes is None:
            classes = sorted(str(c) for c in per)
        out = StoredFolds(path, features, label, key, k, repeats, seed, classes, {})
        for r in out.rows(spark).groupBy("repeat", "fold", q(label)).agg(F.count(F.lit(1)).alias("n")).collect():
            out.counts[r["repeat"], r["fold"], r[label]] = r["n"]
        return out

    def rows(self, spark) -> DataFrame:
        return spark.read.parquet(self.path + "/rows")

    def cell(self, spark, preset: Preset, run: str, repeat: int, fold: int, rebalance=None) -> None:
        """Fit on the other folds, write what the model says about this one."""
        train = self.rows(spark).filter((F.col("repeat") == repeat) & (F.col("fold") != fold)).drop("repeat", "fold")
        counts: dict | None = {}
        for (r, f, c), n in self.counts.items():
            if r == repeat and f != fold:
                counts[c] = counts.get(c, 0) + n
        if rebalance is not None and preset.sampled:
            train, counts = rebalance(train), None
        m = fit_classifier(train, self.features, self.label, preset, seed=self.seed, classes=self.classes, counts=counts)
        test = self.rows(spark).filter((F.col("repeat") == repeat) & (F.col("fold") == fold))
        m.transform(test).select(q(self.key), q(self.label), "pred", "probs").write.mode("overwrite").parquet(f"{self.path}/{run}/repeat={repeat}/fold={fold}")

    def predictions(self, spark, run: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{run}").select(
            q(self.key), F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold"), q(self.label), "pred", "probs")

    def cells(self) -> list[tuple[int, int]]:
        return sorted({(r, f) for r, f, _ in self.counts})


def cross_validate(df: DataFrame, features: Sequence[str], label: str, key: str, preset: Preset, k: int = 5,
                   repeats: int = 1, seed: int = 42, rebalance=None, classes: Sequence[str] | None = None) -> DataFrame:
    """Leak-free repeated stratified CV. Every fold refits scaling
    and rebalancing on its own training part. Returns the pooled prediction
    table (key, repeat, fold, label, pred, probs)."""
    spark = df.sparkSession
    folds = StoredFolds.write(df, features, label, key, k, repeats, seed, classes)
    with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:  # independent fits share the executors
        list(pool.map(lambda c: folds.cell(spark, preset, "predictions", *c, rebalance), folds.cells()))
    return folds.predictions(spark, "predictions")


def grid_search(df: DataFrame, features: Sequence[str], label: str, key: str, kind: str, grid: Sequence[dict],
                k: int = 5, seed: int = 42, scoring: str = "f1_macro") -> DataFrame:
    """G1: exhaustive grid with stratified k-fold; one row per parameter set
    (params json, mean score, std); a failing setting is recorded with a
    NULL score instead of stopping the search. All settings see the same
    folds, written once; their fits go at once."""
    from .evaluate import metric_set
    spark = df.sparkSession
    folds = StoredFolds.write(df, features, label, key, k, 1, seed, None)
    presets = [Preset(f"{kind}_{i}", kind, dict(params), scaled=kind == "lr") for i, params in enumerate(grid)]
    failed: set[int] = set()

    def one(cell):
        i, (r, f) = cell
        try:
            if i not in failed:
                folds.cell(spark, presets[i], f"setting={i}", r, f)
        except Exception:  # noqa: BLE001 - recorded, search continues
            failed.add(i)

    with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:
        list(pool.map(one, [(i, c) for i in range(len(grid)) for c in folds.cells()]))
    told = [folds.predictions(spark, f"setting={i}").withColumn("setting", F.lit(i)) for i in range(len(grid)) if i not in failed and folds.counts]
    scores = {}
    if told:
        by_fold = metric_set(functools.reduce(DataFrame.unionByName, told), label, "pred", by=["setting", "fold"])
        scores = {r["setting"]: r for r in by_fold.groupBy("setting").agg(F.avg(scoring).alias("m"), F.stddev_samp(scoring).alias("s")).collect()}
    rows = [(i, json.dumps(params, sort_keys=True), *((float(scores[i]["m"]), float(scores[i]["s"] or 0.0)) if i in scores else (None, None))) for i, params in enumerate(grid)]
    return spark.createDataFrame(rows, "setting int, params string, mean_score double, std_score double")
