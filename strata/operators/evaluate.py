"""Evaluation over prediction tables.

A prediction table has one row per (group..., key): ``true``, ``pred`` and
optionally ``probs`` (array<double> in class order). Groups are e.g.
(model, split) or (model, repeat, fold). Every metric is an aggregate over
the confusion counts, so evaluating 20 models x 25 folds is one job with a
small shuffle, not 500 driver loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recode import array_shares, bound_to
from .ranks import value_ranks
from .select import q


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def align_probabilities(df: DataFrame, probs: str, model_classes: Sequence[str], classes: Sequence[str],
                        pred: str | None = None, out: str = "probs", floor: float = 1e-6) -> DataFrame:
    """V0: reorder a probability array from the model's class order to
    ``classes``; absent classes get ``floor``; rows are renormalised. Rows
    without probabilities fall back to the one-hot of ``pred``."""
    pos = {c: i for i, c in enumerate(model_classes)}
    picked = F.array(*[(F.col(q(probs))[pos[c]] if c in pos else F.lit(floor)).cast("double") for c in classes])
    norm = bound_to(picked, array_shares)
    if pred is not None:
        onehot = F.array(*[F.when(F.col(q(pred)) == F.lit(c), F.lit(1.0)).otherwise(F.lit(0.0)) for c in classes])
        norm = F.when(F.col(q(probs)).isNull(), onehot).otherwise(norm)
    return df.withColumn(out, norm)


def confusion_matrix(df: DataFrame, true: str, pred: str, classes: Sequence[str], by: Sequence[str] = ()
                     ) -> DataFrame:
    """V1: (by..., true, pred, n, frac) over the full class x class grid;
    frac = n / row total (0 for an empty row). The grid is generated per
    group with ``explode`` (no join with a made-up table)."""
    by = list(by)
    counts = df.groupBy(*[q(b) for b in by], q(true), q(pred)).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(*[q(b) for b in by]).distinct() if by else df.sparkSession.range(1).select()
    spine = (groups.withColumn(true, F.explode(_lit_array(classes)))
             .withColumn(pred, F.explode(_lit_array(classes))))
    cm = spine.join(counts, by + [true, pred], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy(*[q(b) for b in by], q(true))
    row = F.sum("n").over(w)
    return cm.withColumn("frac", F.when(row > 0, F.col("n") / row).otherwise(F.lit(0.0)))


def per_class_report(df: DataFrame, true: str, pred: str, by: Sequence[str] = (),
                     classes: Sequence[str] | None = None) -> DataFrame:
    """V3: precision, recall, F1 and support per class (0 when undefined).
    Classes are the union of true and predicted labels (or ``classes``)."""
    by = list(by)
    t = df.groupBy(*[q(b) for b in by], F.col(q(true)).alias("class")).agg(
        F.count(F.lit(1)).alias("support"), F.sum((F.col(q(true)) == F.col(q(pred))).cast("long")).alias("tp"))
    p = df.groupBy(*[q(b) for b in by], F.col(q(pred)).alias("class")).agg(F.count(F.lit(1)).alias("predicted"))
    rep = t.join(p, by + ["class"], "full")
    if classes is not None:
        rep = rep.filter(F.col("class").isin(*classes))
    rep = rep.select(*[q(b) for b in by], "class", F.coalesce("support", F.lit(0)).alias("support"),
                     F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    rep = rep.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return rep.withColumn("f1", f1)


def class_auc(df: DataFrame, true: str, probs: str, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUC per class from tie-averaged ranks:
    (sum of positive ranks - n+(n+ + 1)/2) / (n+ * n-). NULL when a class
    has no positives or no negatives."""
    by = list(by)
    long = df.select(*[q(b) for b in by], q(true), F.posexplode(q(probs)).alias("_ci", "score"))
    long = long.withColumn("class", _lit_array(classes)[F.col("_ci")]).withColumn(
        "pos", (F.col(q(true)) == F.col("class")).cast("long"))
    grouped = long.groupBy(*[q(b) for b in by], "class", "score").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("pos").alias("n_pos"))
    ranked = value_ranks(grouped, "score", by + ["class"], "rank", weight="n_all")
    ranked = ranked.join(grouped.select(*[q(b) for b in by], "class", "score", "n_pos"), by + ["class", "score"])
    return ranked.groupBy(*[q(b) for b in by], "class").agg(
        F.sum(F.col("rank") * F.col("n_pos")).alias("rsum"), F.sum("n_pos").alias("npos"), F.sum("n").alias("ntot")
    ).select(*[q(b) for b in by], "class",
             F.when((F.col("npos") > 0) & (F.col("ntot") > F.col("npos")),
                    (F.col("rsum") - F.col("npos") * (F.col("npos") + 1) / 2.0)
                    / (F.col("npos") * (F.col("ntot") - F.col("npos")))).alias("auc"))


def metric_set(df: DataFrame, true: str, pred: str, by: Sequence[str] = (), probs: str | None = None,
               classes: Sequence[str] | None = None) -> DataFrame:
    """V2: macro F1, accuracy, balanced accuracy (mean recall of classes
    present in ``true``), weighted precision / recall / F1 and macro
    one-vs-rest ROC-AUC (NULL if any class lacks positives or negatives)."""
    by = list(by)
    rep = per_class_report(df, true, pred, by)
    m = rep.groupBy(*[q(b) for b in by]).agg(
        F.avg("f1").alias("f1_macro"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))
    if probs is not None and classes is not None:
        auc = class_auc(df, true, probs, classes, by).groupBy(*[q(b) for b in by]).agg(
            F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc_macro"))
        m = m.join(auc, by, "left") if by else _attach_one(m, auc)
    return m


def _attach_one(m: DataFrame, one: DataFrame) -> DataFrame:
    r = one.first()
    return m.withColumn("roc_auc_macro", F.lit(r["roc_auc_macro"] if r else None).cast("double"))


def roc_curve(df: DataFrame, true: str, probs: str, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """V4: one-vs-rest ROC points per class: for each distinct score s,
    tpr/fpr of the rule 'score >= s', plus the (0, 0) start point (NULL
    threshold). Cumulative counts come from the bucketed ``cumulative_below``,
    not a window over a whole class."""
    from .ranks import cumulative_below
    by = list(by)
    long = df.select(*[q(b) for b in by], q(true), F.posexplode(q(probs)).alias("_ci", "score"))
    long = long.withColumn("class", _lit_array(classes)[F.col("_ci")]).withColumn(
        "pos", (F.col(q(true)) == F.col("class")).cast("long"))
    g = long.groupBy(*[q(b) for b in by], "class", "score").agg(F.count(F.lit(1)).alias("n_all"),
                                                               F.sum("pos").alias("n_pos"))
    tot = g.groupBy(*[q(b) for b in by], "class").agg(F.sum("n_pos").alias("P"), F.sum("n_all").alias("A"))
    c = cumulative_below(g, "score", by + ["class"], ["n_all", "n_pos"]).join(tot, by + ["class"])
    tp = F.col("P") - F.col("below_n_pos")
    fp = (F.col("A") - F.col("below_n_all")) - tp
    pts = c.select(*[q(b) for b in by], "class", F.col("score").cast("double").alias("threshold"),
                   F.when(F.col("P") > 0, tp / F.col("P")).alias("tpr"),
                   F.when(F.col("A") > F.col("P"), fp / (F.col("A") - F.col("P"))).alias("fpr"), "P")
    start = tot.select(*[q(b) for b in by], "class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"),
                       F.when((F.col("A") > F.col("P")) | (F.col("P") == 0), F.lit(0.0)).alias("fpr"))
    # a class without positives has the diagonal, as nothing can be ranked
    end = tot.filter("P = 0").select(*[q(b) for b in by], "class", F.lit(None).cast("double").alias("threshold"),
                                     F.lit(1.0).alias("tpr"), F.lit(1.0).alias("fpr"))
    return pts.filter("P > 0").drop("P").unionByName(start).unionByName(end)


def test_comparison(metrics: DataFrame, model: str = "model") -> DataFrame:
    """V7: one row per model, best macro F1 first (missing -> NULL, last)."""
    return metrics.orderBy(F.col("f1_macro").desc_nulls_last(), q(model))


def f1_by_split(metrics: DataFrame, model: str = "model", split: str = "split",
                splits: Sequence[str] = ("Train", "CrossVal", "Test")) -> DataFrame:
    """V8: model x split macro-F1 matrix, ordered by the first available
    of Test, CrossVal, Train."""
    pv = metrics.groupBy(q(model)).pivot(split, list(splits)).agg(F.first("f1_macro"))
    key = F.coalesce(*[F.col(q(s)) for s in reversed(list(splits))])
    return pv.withColumn("order_key", key).orderBy(F.col("order_key").desc_nulls_last(), q(model))


def class_list(*dfs_and_cols) -> DataFrame:
    """V9: sorted distinct labels over several (DataFrame, column) pairs."""
    out = None
    for df, c in dfs_and_cols:
        part = df.select(F.col(q(c)).cast("string").alias("label")).filter(F.col("label").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.distinct().orderBy("label")


def promote_best(metrics: DataFrame, alias: str, model: str = "model", metric: str = "f1_macro") -> DataFrame:
    """Registry row (alias -> model) for the best model by ``metric``
    (ties: model name), chosen by rank rather than by hand."""
    best = metrics.agg(F.min_by(F.col(q(model)), F.struct((-F.col(metric)).alias("m"), F.col(q(model)).alias("n")))
                       .alias("model"))
    return best.select(F.lit(alias).alias("alias"), "model")
