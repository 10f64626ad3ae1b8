"""Explanations as tables.

E1 reads a fitted MLlib tree's node table (id, prediction, impurity,
impurityStats, rawCount, leftChild, rightChild, split) and expands root-to-
leaf paths level by level with joins (depth <= 30). Thresholds keep full
precision so the rules score exactly like the model (E2). Weakest-link
cost-complexity pruning (the alpha MLlib lacks) works on the node table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .select import q

MAX_RULES = 100_000


NODE_SCHEMA = ("id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
               "leftChild int, rightChild int, "
               "split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>")


def tree_nodes(spark, fitted, member: int = 0) -> DataFrame:
    """Node table of a fitted single tree: read back from the saved MLlib
    model (pipeline kind) or built from the stored node rows (trees kind)."""
    from pyspark.ml.classification import DecisionTreeClassificationModel
    if fitted.kind == "pipeline":
        tree = [s for s in fitted.pipeline.stages if isinstance(s, DecisionTreeClassificationModel)][0]
        path = os.path.join(checkpoint_dir(spark), f"tree-{uuid.uuid4().hex}")
        tree.write().overwrite().save(path)
        return spark.read.parquet(path + "/data")
    rows = fitted.trees[member]
    data = [(r["id"], float(r["pred"]), r.get("impurity", 0.0), [p * r.get("n", 1) for p in r["probs"]],
             int(r.get("n", 0)), r["left"], r["right"],
             (r["fi"] if r["left"] >= 0 else -1, [r["thr"]] if r["left"] >= 0 else [], -1)) for r in rows]
    return spark.createDataFrame(data, NODE_SCHEMA)


def prune_tree(nodes: DataFrame, alpha: float) -> DataFrame:
    """Minimal cost-complexity pruning: repeatedly collapse the internal node
    with the smallest g(t) = (R(t) - R(subtree)) / (leaves - 1) while
    g <= alpha, R = weighted impurity share. Works on the node table (one
    row per node, bounded by the tree size); returns the pruned table."""
    if alpha <= 0:
        return nodes
    rows = {r["id"]: r.asDict(recursive=True) for r in nodes.collect()}  # bounded: a tree's nodes
    total = float(rows[0]["rawCount"]) if 0 in rows else 1.0
    cut = set()

    def stats(i):
        r = rows[i]
        own = r["rawCount"] / total * r["impurity"]
        if r["leftChild"] < 0 or i in cut:
            return own, own, 1
        lr, _, ll = stats(r["leftChild"])
        rr, _, rl = stats(r["rightChild"])
        return lr + rr, own, ll + rl

    while True:
        best, best_g = None, None
        for i, r in rows.items():
            if r["leftChild"] < 0 or i in cut or _under_cut(rows, i, cut):
                continue
            sub, own, leaves = stats(i)
            if leaves <= 1:
                continue
            g = (own - sub) / (leaves - 1)
            if best_g is None or g < best_g - 1e-15:
                best, best_g = i, g
        if best is None or best_g > alpha:
            break
        cut.add(best)
    keep = {i for i in rows if not _under_cut(rows, i, cut)}
    spark = nodes.sparkSession
    out = []
    for i in sorted(keep):
        r = dict(rows[i])
        if i in cut:
            r["leftChild"], r["rightChild"] = -1, -1
        out.append(r)
    return spark.createDataFrame(out, nodes.schema)


def _under_cut(rows, i, cut) -> bool:
    """Is node i strictly below a collapsed node?"""
    parent = {c: p for p, r in rows.items() for c in (r["leftChild"], r["rightChild"]) if c >= 0}
    j = i
    while j in parent:
        j = parent[j]
        if j in cut:
            return True
    return False


def tree_rules(nodes: DataFrame, features: Sequence[str], classes: Sequence[str],
               severity: Sequence[str] | None = None) -> DataFrame:
    """One row per leaf: rule_id, depth, condition (SQL text, full
    precision), class, n, purity. Leaf class = largest class count; ties go
    to the most severe class when ``severity`` is given."""
    feats = F.array(*[F.lit(f) for f in features])
    n = nodes.select("id", "leftChild", "rightChild", F.col("split.featureIndex").alias("fi"),
                     F.col("split.leftCategoriesOrThreshold")[0].alias("thr"), "impurityStats", "rawCount")
    frontier = n.filter("id = 0").select("id", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("conds"))
    leaves = None
    for _ in range(31):
        cur = frontier.join(n, "id")
        leaf = cur.filter("leftChild < 0").select("id", "depth", "conds", "impurityStats", "rawCount")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        inner = cur.filter("leftChild >= 0")
        name = F.concat(F.lit("`"), feats[F.col("fi")], F.lit("`"))
        thr = F.format_string("%.17g", F.col("thr"))
        left = inner.select(F.col("leftChild").alias("id"), (F.col("depth") + 1).alias("depth"),
                            F.array_append("conds", F.concat(name, F.lit(" <= "), thr)).alias("conds"))
        right = inner.select(F.col("rightChild").alias("id"), (F.col("depth") + 1).alias("depth"),
                             F.array_append("conds", F.concat(name, F.lit(" > "), thr)).alias("conds"))
        frontier = left.unionByName(right)
        if frontier.limit(1).count() == 0:
            break
    order = list(severity) if severity else list(classes)
    rank = {c: order.index(c) if c in order else -1 for c in classes}
    stats = F.col("impurityStats")
    best = F.aggregate(F.sequence(F.lit(0), F.size(stats) - 1), F.struct(F.lit(-1.0).alias("v"), F.lit(-1).alias("s"),
                                                                         F.lit(-1).alias("i")),
                       lambda acc, i: F.when((stats[i] > acc["v"]) | ((stats[i] == acc["v"]) & (
                           F.array(*[F.lit(rank[c]) for c in classes])[i] > acc["s"])),
                           F.struct(stats[i].alias("v"), F.array(*[F.lit(rank[c]) for c in classes])[i].alias("s"),
                                    i.alias("i"))).otherwise(acc))
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    labels = F.array(*[F.lit(c) for c in classes])
    return leaves.select(F.col("id").alias("rule_id"), "depth",
                         F.when(F.size("conds") == 0, F.lit("TRUE")).otherwise(F.array_join("conds", " AND ")).alias("condition"),
                         labels[best["i"]].alias("class"), F.col("rawCount").alias("n"),
                         (best["v"] / total).alias("purity"))


def rules_expression(rules: DataFrame, default=None):
    """The rules as one CASE WHEN expression (rules are bounded in number)."""
    rs = rules.select("condition", "class").limit(MAX_RULES + 1).collect()
    if len(rs) > MAX_RULES:
        raise ValueError("too many rules for one expression")
    if not rs:
        return F.lit(default)
    body = " ".join(f"WHEN {r['condition']} THEN '{str(r['class']).replace(chr(39), chr(39) * 2)}'" for r in rs)
    tail = f" ELSE '{default}'" if default is not None else ""
    return F.expr(f"CASE {body}{tail} END")


def apply_rules(df: DataFrame, rules: DataFrame, out: str = "rule_class") -> DataFrame:
    """Score a table with a rules table."""
    return df.withColumn(out, rules_expression(rules))


def export_rules(rules: DataFrame, path: str) -> None:
    """Write the rules as text, one 'IF ... THEN ...' line per leaf."""
    (rules.orderBy("rule_id")
     .select(F.format_string("IF %s THEN %s  [n=%d, purity=%.3f]", "condition", "class", "n", "purity").alias("value"))
     .coalesce(1).write.mode("overwrite").text(path))


def permutation_importance(fitted, df: DataFrame, features: Sequence[str], label: str, key: str,
                           metric: str = "f1_macro", seed: int = 42) -> DataFrame:
    """Metric drop when one feature is shuffled. The shuffle is a join on
    position: row at key-rank p receives the feature value of the row with
    seeded-hash rank p (both ranks bucketed, no single-task sort).

    All features go at once: values are ranked by (feature, hash), the donors of a position are one small map, and a row
    turns into its variants in the task that scores them, so rows are shuffled once and not once a feature."""
    from .evaluate import metric_set
    from .ranks import average_rank, seeded_rank
    features = list(features)
    base = metric_set(fitted.transform(df), label, "pred").select(F.col(metric).alias("m")).first()["m"]
    values = [F.col(q(f)).cast("double") for f in features]
    long = df.select(q(key), F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), v.alias("_perm")) for i, v in enumerate(values)])).alias("_x"))
    names = F.array(*[F.lit(f) for f in features])
    donor = seeded_rank(long.select(q(key), "_x.*"), seed, key, "_f", out="_pos", extra_keys=[names[F.col("_f")]])
    donors = donor.groupBy("_pos").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_perm"))).alias("_donors"))  # a value for each feature
    pos = average_rank(df, key, out="_pos").withColumn("_pos", F.col("_pos").cast("long"))
    variants = pos.join(donors, "_pos").withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    shuffled = variants.select(q(label), "_f", *[F.when(F.col("_f") == i, F.col("_donors")[i]).otherwise(v).alias(f) for i, (f, v) in enumerate(zip(features, values))])
    scored = fitted.transform(shuffled).groupBy(q(label), "_f", "pred").agg(F.count(F.lit(1)).alias("_n")).cache()  # classes x classes rows a feature
    told = metric_set(scored.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))), label, "pred", by=["_f"])
    scores = {r["_f"]: r["m"] for r in told.select("_f", F.col(metric).alias("m")).collect()}
    scored.unpersist()
    rows = [(f, float(base), float(scores[i]), float(base - scores[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, baseline double, permuted double, importance double")
