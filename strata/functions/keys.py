"""Deterministic keys and seeded orderings.

Every seeded operation (splits, folds, samplers, shuffles) orders rows by
``md5('<seed>:' || key)``. The same expression exists in DuckDB and Spark,
so seeded results are reproducible across engines and across re-reads, unlike
``rand()`` or ``monotonically_increasing_id()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(seed, *keys) -> Column:
    """md5 of ``'<seed>:' || key1 [|| ':' || key2 ...]`` as a hex string."""
    parts = [F.lit(f"{seed}:")]
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit(":"))
        parts.append(_as_col(k).cast("string"))
    return F.md5(F.concat(*parts))


def add_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Attach a stable ingest id (file order within the read).

    Use once at ingest and persist the result: ids are stable only for the
    same files and the same read, so later reads must carry the column.
    """
    return df.withColumn(name, F.monotonically_increasing_id())
