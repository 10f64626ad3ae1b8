"""Outlier detection: O1-O3 here; LOF / DBSCAN in ``neighbours``.

Result shape for every detector: one row per flagged cell,
(column, key..., value, lower, upper) or (column, key..., value, score).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_small
from .ranks import exact_quantiles
from .select import infer_columns, q


def _long(df: DataFrame, cols: Sequence[str], key: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    return (df.select(*[q(k) for k in key], *[q(g) for g in group if g not in key],
                      *[F.col(q(c)).cast("double").alias(c) for c in cols])
            .unpivot(list(key) + [g for g in group if g not in key], list(cols), "column", "value")
            .filter(F.col("value").isNotNull()))


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = 1.5, group: Sequence[str] = ()) -> DataFrame:
    """Exact Q1/Q3 per (group..., column) and the fences."""
    long = _long(df, cols, [], group)
    return (exact_quantiles(long, "value", [0.25, 0.75], [*group, "column"], "_q")
            .select(*[q(g) for g in group], "column", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
            .withColumn("lower", F.col("q1") - F.lit(factor) * (F.col("q3") - F.col("q1")))
            .withColumn("upper", F.col("q3") + F.lit(factor) * (F.col("q3") - F.col("q1"))))


def iqr_outliers(df: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None, factor: float = 1.5,
                 group: Sequence[str] = ()) -> DataFrame:
    """O1 (and O2 with ``group``): values strictly outside
    [Q1 - f*IQR, Q3 + f*IQR]. The bounds table has one row per
    (group, column) and is joined behind a size check."""
    key = [key] if isinstance(key, str) else list(key)
    cols = infer_columns(df, cols, "numeric")
    cols = [c for c in cols if c not in key and c not in group]
    bounds = iqr_bounds(df, cols, factor, group)
    long = _long(df, cols, key, group)
    j = join_small(long, bounds, list(group) + ["column"], "inner")
    return (j.filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
            .select(*[q(g) for g in group], "column", *[q(k) for k in key], "value", "lower", "upper"))


def zscore_outliers(df: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None,
                    threshold: float = 3.0, group: Sequence[str] = ()) -> DataFrame:
    """O3: |x - mean| / population std > threshold (strict); a zero or
    undefined std flags nothing."""
    key = [key] if isinstance(key, str) else list(key)
    cols = infer_columns(df, cols, "numeric")
    cols = [c for c in cols if c not in key and c not in group]
    long = _long(df, cols, key, group)
    stats = long.groupBy(*[q(g) for g in group], "column").agg(F.avg("value").alias("mean"),
                                                                F.stddev_pop("value").alias("std"))
    j = join_small(long, stats, list(group) + ["column"], "inner")
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    return (j.filter(F.col("std").isNotNull() & (F.col("std") > 0))
            .withColumn("z", z).filter(F.col("z") > F.lit(threshold))
            .select(*[q(g) for g in group], "column", *[q(k) for k in key], "value", "z"))
