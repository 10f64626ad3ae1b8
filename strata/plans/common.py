"""Shared helpers for the registered queries over the driver tables.

Nulls, detection-limit strings and class labels do not exist in the driver
tables, so each query makes them with an expression that is written the same
way in the Spark plan and in its DuckDB oracle (SURVEY 7.3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c) -> Column:
    """Doubles are compared at 6 decimals in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    # Same arithmetic as DuckDB's round(x, 6): scale, round half away from
    # zero, unscale (Spark's round(x, 6) rounds the decimal string instead).
    return F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6)


def sql_expr(s: str) -> Column:
    """A Spark SQL expression written identically in the oracle."""
    return F.expr(s)
