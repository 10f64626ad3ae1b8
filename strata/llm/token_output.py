"""Token ids as ORC: run-length-encoded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import fits, slices, strings

SCHEMA = "doc_id bigint, part int, first bigint, n_tokens bigint, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_index_rows: int = 1000) -> None:
    """Encode every whole text, append ``end_id`` and write ORC files in ascending document order.

    Documents are dealt to range partitions by id (texts move once; encoding comes after it, so no id is
    shuffled) and each partition becomes one file, whose rows say where their ids begin in the file. The
    ORC writer run-length encodes the integers and keeps, for each ``row_index_rows`` rows, minima, maxima
    and a Bloom filter of the document ids, from which ``read_documents`` prunes stripes and row groups.

    A null text is empty (one id, the end). A null document id sorts first. Rows with the same id stay
    separate documents, in the order of a hash of their texts. Other columns are not used, whatever their
    names. An empty table gives files without rows.
    """
    def rows(batches):
        part, first, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for b in slices(batch, 2048):
                ids = [x + end for x in enc.encode(strings(b.column(1)))]
                n = np.asarray([len(x) // 4 for x in ids], dtype=np.int64)
                begin = first + np.concatenate([[0], np.cumsum(n)])
                first = int(begin[-1])
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(begin[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array((begin - begin[0]).astype(np.int32)), flat)],
                    names=["doc_id", "part", "first", "n_tokens", "ids"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    (own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(rows, SCHEMA)
     .write.option("orc.compress", "ZSTD").option("orc.row.index.stride", str(row_index_rows)).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files, each with ``start``: the ids of all documents before it.

    The files are read in parallel by stripes. ``start`` needs only the sums of the files before, which come
    from two small columns; one row for each file goes into the window.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = fits(sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), 16)
    return files.join(base, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of the given ids: the filter goes down to the ORC reader's statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def ids_crc32(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``ids_crc32``: the unsigned crc32 of ``ids`` as little-endian unsigned 32-bit integers."""
    def rows(batches):
        for b in batches:
            ids = b.column(b.num_columns - 1)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])

    own = df.select(*keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(rows, f"{schema}, ids_crc32 bigint")
