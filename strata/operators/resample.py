"""Splitting, folds and class rebalancing.

Every seeded choice is a rank in md5('seed:key') order (``ranks.seeded_rank``),
so splits are exact in size, reproducible across engines and re-reads, and
computed without a window that holds a whole class.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import has_at_most
from .ranks import seeded_rank
from .select import q

MAX_CLASSES = 100_000


def class_counts(df: DataFrame, label: str) -> dict:
    """Per-class row counts (one row per class, bounded)."""
    counts = df.groupBy(q(label)).agg(F.count(F.lit(1)).alias("n"))
    if not has_at_most(counts, MAX_CLASSES):
        raise ValueError("too many classes")
    return {r[label]: r["n"] for r in counts.collect()}


def allocate(counts: Mapping, total: int) -> dict:
    """Split ``total`` over classes proportionally: floors, then the
    remaining units to the largest remainders (ties: class order)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    exact = {k: c * total / n for k, c in counts.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    left = total - sum(out.values())
    order = sorted(counts, key=lambda k: (-(exact[k] - out[k]), str(k)))
    for k in order[:left]:
        out[k] += 1
    return out


def stratified_holdout(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                       out: str = "split") -> DataFrame:
    """Exact stratified split. n_test = ceil(test_size * N), shared by
    largest remainder; the first n_c rows of each class in seeded order go
    to 'test'. Rows without a label are a class of their own."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    per = allocate(counts, n_test)
    ranked = seeded_rank(df, seed, key, label, out="_rk")
    m = F.create_map(*[x for k, v in per.items() if k is not None for x in (F.lit(k), F.lit(v))])
    cut = F.coalesce(F.try_element_at(m, F.col(q(label))), F.lit(0)) if any(k is not None for k in per) else F.lit(0)
    cut = F.when(F.col(q(label)).isNull(), F.lit(per.get(None, 0))).otherwise(cut)
    return ranked.withColumn(out, F.when(F.col("_rk") <= cut, F.lit("test")).otherwise(F.lit("train"))).drop("_rk")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, shuffle: bool = False, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """R2: fold = (position within class - 1) mod k; unshuffled = key order."""
    if shuffle:
        ranked = seeded_rank(df, seed, key, label, out="_rk")
    else:  # key order, ranked with range buckets (keys are unique)
        from .ranks import average_rank
        ranked = average_rank(df, key, label, out="_rk").withColumn("_rk", F.col("_rk").cast("long"))
    return ranked.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def repeated_stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, repeats: int = 5, seed: int = 42
                              ) -> DataFrame:
    """Every row once per repeat with its fold; each repeat reshuffles
    (order md5('seed:repeat:key')). Repeats are generated with ``explode``
    of a fixed sequence, not a join."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = seeded_rank(x, seed, key, [label, "repeat"], out="_rk", extra_keys=[F.col("repeat")])
    return ranked.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_rk")


def random_undersample(df: DataFrame, label: str, key: str, targets: Mapping, seed: int = 42) -> DataFrame:
    """Listed classes reduced to n rows (no replacement); others pass.
    A class smaller than its target is an error."""
    counts = class_counts(df, label)
    short = {c: (counts.get(c, 0), n) for c, n in targets.items() if counts.get(c, 0) < n}
    if short:
        raise ValueError(f"classes smaller than their target: {short}")
    ranked = seeded_rank(df, seed, key, label, out="_rk")
    m = F.create_map(*[x for c, n in targets.items() for x in (F.lit(c), F.lit(n))])
    cap = F.try_element_at(m, F.col(q(label)))
    return ranked.filter(cap.isNull() | (F.col("_rk") <= cap)).drop("_rk")


def fold_resample_target(n_rows: int, k: int, n_classes: int) -> int:
    """Per-fold target ((N // k) * (k - 1)) // classes."""
    return ((n_rows // k) * (k - 1)) // n_classes


def final_resample_target(n_rows: int, n_classes: int, floor: int = 500) -> int:
    """Refit target max(N // classes, floor)."""
    return max(n_rows // n_classes, floor)


def balanced_class_weights(df: DataFrame, label: str, out: str = "weight", counts: Mapping | None = None) -> DataFrame:
    """M6: weight = n / (K * n_c), attached by a join of the class table (``counts``, where it is known)."""
    if counts is None:
        counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, v in counts.items() if c is not None for x in (F.lit(c), F.lit(n / (k * v)))])
    return df.withColumn(out, F.try_element_at(m, F.col(q(label))))
