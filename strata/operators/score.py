"""Scoring helpers over prediction columns.

All of these are row-local higher-order-function expressions: no shuffle,
stream-safe, and the same code scores one row or a billion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import q


def _c(x) -> Column:
    return F.col(q(x)) if isinstance(x, str) else x


def top_probability(probs) -> Column:
    """Q2: highest class probability; NULL when there are none."""
    return F.array_max(_c(probs))


def severity_tie_break(probs, classes_by_severity: Sequence[str], tol: float = 1e-12) -> Column:
    """Q3: the class with the highest probability; probabilities within
    ``tol`` of the best count as tied and the most severe class wins.
    ``probs`` is aligned with ``classes_by_severity`` (least severe first)."""
    p = _c(probs)
    m = F.array_max(p)
    n = len(classes_by_severity)
    idx = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(-1),
                      lambda acc, i: F.when(p[i] >= m - F.lit(tol), i).otherwise(acc))
    labels = F.array(*[F.lit(c) for c in classes_by_severity])
    return F.when(idx >= 0, labels[idx])


def majority_vote(preds) -> Column:
    """Q4: most frequent non-NULL prediction; a tie goes to the label seen
    first in model order; when no label appears twice, the first non-NULL
    prediction; all NULL -> NULL."""
    a = _c(preds)
    n = F.size(a)
    count_at = lambda i: F.when(a[i].isNull(), F.lit(0)).otherwise(F.size(F.filter(a, lambda x: x == a[i])))
    best = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(-1).alias("i"), F.lit(0).alias("c")),
                       lambda acc, i: F.when(count_at(i) > acc["c"], F.struct(i.alias("i"), count_at(i).alias("c")))
                       .otherwise(acc))
    first_non_null = F.get(F.filter(a, lambda x: x.isNotNull()), 0)
    return F.when(best["c"] >= 2, F.get(a, best["i"])).otherwise(first_non_null)


def vote_report(df: DataFrame, model_cols: Sequence[str], final: str) -> DataFrame:
    """Q5: prediction counts per model and for the final vote."""
    cols = list(model_cols) + [final]
    long = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols]).unpivot([], cols, "model", "label")
    return long.groupBy("model", "label").agg(F.count(F.lit(1)).alias("count"))


def fill_label_by_vote(df: DataFrame, label: str, vote: str) -> DataFrame:
    """NULL labels <- the vote."""
    return df.withColumn(label, F.coalesce(F.col(q(label)), F.col(q(vote))))
