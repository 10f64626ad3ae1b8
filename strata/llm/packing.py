"""Packing by power-of-two decomposition: pieces of binary lengths, equal lengths in one bucket."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import fits, slices, strings, written

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids array<int>, ids_crc32 bigint, part int, nth bigint"


def binary_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: as many of ``most`` as fit, then the binary digits of the rest, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text",
         kept: int = 400_000, rows_at_once: int = 1024) -> DataFrame:
    """Sequences of at most ``max_tokens`` (a power of two) ids, none of which crosses documents and none padded.

    Each document (ids of its whole text, then ``end_id``) is cut into pieces whose lengths are powers of
    two. A piece is a sequence of its own (``offset`` 0); sequences of equal length form a bucket, in which
    ``sequence_id`` runs without gaps, buckets in ascending order of length. A training job takes each batch
    from one bucket, so batches are rectangular without padding.

    One row a piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset. Texts are
    encoded once, in a written table that also holds each piece's place within (task, length); places
    in the buckets come from sums of those few counts, no piece is sorted or shuffled for it.

    A null text is empty: one piece with the end id. Rows with equal or null ids stay separate documents.
    Other columns are not used, whatever their names. An empty table gives no rows.

    A Python worker keeps the ids of up to two times ``kept`` chunks and encodes ``rows_at_once`` texts in a call: with less it
    takes less memory (100,000 and 256: some 140 MB less) and more time; the results are the same.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def rows(batches):
        part, enc, nth = TaskContext.get().partitionId(), encoder(tokenizer, kept), dict.fromkeys((1 << k for k in range(max_tokens.bit_length())), 0)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for b in slices(batch, rows_at_once):
                cols, flat = ([], [], [], [], [], []), []
                for doc, ids in zip(b.column(0).to_pylist(), enc.encode(strings(b.column(1)))):
                    ids += end
                    flat.append(ids)
                    total, start = len(ids) // 4, 0
                    for n in binary_lengths(total, max_tokens):
                        for c, v in zip(cols, (doc, start, n, total, zlib.crc32(ids[4 * start:4 * (start + n)]), nth[n])):
                            c.append(v)
                        nth[n] += 1
                        start += n
                doc, start, length, total, crc, place = (pa.array(c, pa.int64()) for c in cols)
                at = pa.array(np.concatenate([[0], np.cumsum(length.to_numpy())]).astype(np.int32))
                ids = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(flat), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([doc, start, length, total, ids, crc, pa.array(np.full(len(place), part, dtype=np.int32)), place],
                                                 names=["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "part", "nth"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(own.mapInArrow(rows, SCHEMA), "packed")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each power of two
    bases = counts.select("length", "part", (_lower(totals) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    return pieces.join(fits(bases, 24), ["length", "part"]).select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
                                                         (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def _lower(totals: dict[int, int]):
    """Sequences in the buckets of shorter lengths, by ``length``."""
    out = F.lit(0).cast("bigint")
    for length in sorted(totals):
        out = F.when(F.col("length") > length, F.lit(sum(n for k, n in totals.items() if k <= length)).cast("bigint")).otherwise(out)
    return out
