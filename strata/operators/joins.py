"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that we are willing to ship to every executor.
BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES = 2_000_000, 64 << 20


def has_at_most(df: DataFrame, n: int) -> bool:
    """Cheap bound check: reads at most n+1 rows (LIMIT stops the scan early)."""
    return df.limit(n + 1).count() <= n


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 8 for each number or date, and the length of what can be long (nested values as JSON)."""
    size = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; reads at most max_rows + 1 rows."""
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df).cast("long")).alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= max_bytes


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join ``small`` into ``big``: broadcast when ``small`` is proven to hold at most ``max_rows`` rows and
    ``max_bytes`` bytes, otherwise a regular shuffle join (AQE may still convert it at runtime)."""
    if is_small(small, max_rows, max_bytes):
        small = F.broadcast(small)
    return big.join(small, on, how)
