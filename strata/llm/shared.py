"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memo(dict):
    """Results of ``compute`` for short keys, in two generations of ``limit`` each; the older goes when the newer is full."""

    def __init__(self, compute, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 48:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_HELD: dict[str, Any] = {}
_C = ctypes.CDLL(None)


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker process keeps under ``name`` from task to task. A worker serves one operator after the other, so
    it holds the tables of one at a time: another name's go first, and their memory with them."""
    if name not in _HELD:
        if _HELD:
            emptied()
        _HELD[name] = make()
    return _HELD[name]


def emptied() -> None:
    """Called by tasks that keep nothing: what earlier operators left in this Python worker goes, and its free memory goes back
    to the system, which the JVM beside it may need."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(_C, "malloc_trim", None):
        trim(0)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of ``k`` items of ``h`` (empty with fewer items), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, step, width, mul = np.zeros(n, dtype=np.uint64), 0, h, 1, base
    while True:
        if k & width:
            out = out * np.uint64(mul) + step[done:done + n]
            done += width
        if 2 * width > k:
            return out
        step = step[:-width] * np.uint64(mul) + step[width:]
        width *= 2
        mul = mul * mul % 2**64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def carried(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> list[Column]:
    """What an operator takes of a document besides its text: the id as ``doc_id`` or, to carry all columns along
    whatever their names, ``row`` with all columns but the text."""
    if carry:
        return [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")]
    return [F.col(f"`{id_col}`").cast("bigint").alias("doc_id")]


def uncarried(df: DataFrame, columns: list[str], text_col: str, **changed: Column) -> DataFrame:
    """``columns`` as they were, from ``row`` and ``text``, but for ``changed``."""
    own = {c: F.col("text") if c == text_col else F.col(f"row.`{c}`") for c in columns} | {c: v for c, v in changed.items() if c in columns}
    return df.select(*[v.alias(c) for c, v in own.items()])


def strings(column: pa.Array) -> list[str]:
    """Values of a string column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 512):
    """``batch`` in parts, so that what is made of whole texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fits(small: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """``small`` (a written table) with a broadcast hint if its counted rows take at most ``most`` bytes; else it
    is joined by a shuffle."""
    return F.broadcast(small) if small.count() * row_bytes <= most else small
