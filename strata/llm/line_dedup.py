"""Line dedup: two Bloom filters, of hashes seen once and seen twice; only suspected repeats are shuffled and confirmed by their text."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, mixed, slices, strings, uncarried, written

#: Code points of a key from which on its lines can go.
LEAST_CHARS = 10
#: Bits of each filter in one block, bits of a filter for each line, and bits that a hash sets.
CELLS, CELLS_EACH, PROBES = 1 << 20, 16, 4
#: A task hands on what it gathered after so many lines, or so many bytes of them.
LINES, BYTES = 200_000, 16 << 20
#: The merged filter is broadcast up to this size; beyond it, hashes go to its blocks.
BROADCAST_BYTES = 32 << 20


def line_key(line: bytes) -> bytes | None:
    """A line without space and \\t to \\r at its ends, A-Z lower-cased; nothing if that is under ``LEAST_CHARS`` code points."""
    key = line.strip().lower()
    if len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS):
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


def gathered(batches, lines: int, size: int):
    """(docs, keys) of the tasks' (doc, text) rows in parts of at most ``lines`` and about ``size`` bytes, inside long texts
    too; in a part each key stands once for each row."""
    docs, keys, held = [], [], 0
    for batch in batches:
        for b in slices(batch):
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                own = set()
                for line in text.encode().split(b"\n"):
                    key = line_key(line)
                    if key is not None and key not in own:
                        own.add(key)
                        docs.append(doc)
                        keys.append(key)
                        held += len(key)
                        if len(keys) >= lines or held >= size:
                            yield docs, keys
                            own, docs, keys, held = set(), [], [], 0
    if keys:
        yield docs, keys


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def block_of(hashed: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def cells(low: np.ndarray) -> np.ndarray:
    """(PROBES, n) bits, within its block, of the lower half of each hash."""
    probe = np.arange(1, PROBES + 1, dtype=np.uint64)[:, None] << np.uint64(32)
    return (mixed(low.astype(np.uint64)[None, :] | probe) >> np.uint64(64 - int(math.log2(CELLS)))).astype(np.int64)


def low_half(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(0xFFFFFFFF)).astype("<u4")


def cut_by(order: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values of a sorted array begin and end."""
    if not len(order):
        return []
    at = [0, *(np.flatnonzero(order[1:] != order[:-1]) + 1).tolist(), len(order)]
    return list(zip(at[:-1], at[1:]))


def filters(docs: DataFrame, blocks: int, lines: int) -> DataFrame:
    """(block, twice): the bits of the filter of hashes that were seen twice, merged over all tasks.

    A task hands on its distinct hashes for each block, and which of them it saw for several rows. A block's hashes are put
    into its two filters one part after the other: one whose bits are all in the first filter goes into the second. A hash
    of two parts always meets itself there, so no repeat is lost; what else gets in is weeded out by text.
    """
    def partial(batches):
        for _, keys in gathered(batches, lines, BYTES):
            found, times = np.unique(hashes(keys), return_counts=True)
            block, low = block_of(found, blocks), low_half(found)
            parts = cut_by(block)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[i]) for i, _ in parts], pa.int64()), pa.array([low[i:j].tobytes() for i, j in parts], pa.binary()),
                                              pa.array([low[i:j][times[i:j] > 1].tobytes() for i, j in parts], pa.binary())], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, second = 0, np.zeros(CELLS, dtype=bool), np.zeros(CELLS, dtype=bool)
        for batch in batches:
            block = batch.column("block")[0].as_py()
            for once, twice in zip(batch.column("once"), batch.column("twice")):
                at = cells(np.frombuffer(once.as_buffer(), dtype="<u4"))
                second[at[:, first[at].all(axis=0)]] = True
                first[at] = True
                second[cells(np.frombuffer(twice.as_buffer(), dtype="<u4"))] = True
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(second).tobytes()], pa.binary())], names=["block", "twice"])

    return docs.mapInArrow(partial, "block bigint, once binary, twice binary").groupBy("block").applyInArrow(merge, "block bigint, twice binary")


def seen_twice(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set in its block's ``bits``."""
    at = cells(low)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


SUSPECT = "key string, least bigint, most bigint, doc_id bigint, line binary"


def suspect_batch(docs: list[int], keys: list[bytes]) -> pa.RecordBatch:
    """Of suspected lines: for each key its smallest and largest document; and the lines that must go, those of other
    documents than the smallest, at once. So a line that very many documents have is one row for each part."""
    by_key: dict[bytes, list[int]] = {}
    for doc, key in zip(docs, keys):
        by_key.setdefault(key, []).append(doc)
    gone = [(d, digest(key)) for key, own in by_key.items() if len(own) > 1 for least in (min(own),) for d in set(own) if d > least]
    n, m = len(by_key), len(gone)
    return pa.RecordBatch.from_arrays([
        pa.array([*[k.decode() for k in by_key], *[None] * m], pa.string()), pa.array([*map(min, by_key.values()), *[None] * m], pa.int64()), pa.array([*map(max, by_key.values()), *[None] * m], pa.int64()),
        pa.array([*[None] * n, *[d for d, _ in gone]], pa.int64()), pa.array([*[None] * n, *[x for _, x in gone]], pa.binary())], names=["key", "least", "most", "doc_id", "line"])


def suspects_by_broadcast(docs: DataFrame, twice: DataFrame, blocks: int, lines: int) -> DataFrame:
    """Suspected lines, with the whole filter in each task."""
    bits = np.zeros((blocks, CELLS // 8), dtype=np.uint8)
    for r in twice.toLocalIterator():
        bits[r["block"]] = np.frombuffer(r["twice"], dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches):
        for own, keys in gathered(batches, lines, BYTES):
            hashed = hashes(keys)
            at = cells(low_half(hashed))
            hit = np.ones(len(keys), dtype=bool)
            for row in at:
                hit &= ((shared.value[block_of(hashed, blocks), row >> 3] >> (7 - (row & 7)).astype(np.uint8)) & 1).astype(bool)
            at = np.flatnonzero(hit).tolist()
            yield suspect_batch([own[i] for i in at], [keys[i] for i in at])

    return docs.mapInArrow(rows, SUSPECT)


def suspects_by_block(docs: DataFrame, twice: DataFrame, blocks: int, lines: int) -> DataFrame:
    """Suspected lines, with hashes sent to the filter's blocks and those that it knows back to their documents."""
    def sent(batches):
        for own, keys in gathered(batches, lines, BYTES):
            ids, hashed = np.asarray(own, dtype=np.int64), hashes(keys)
            order = np.argsort(hashed, kind="stable")
            ids, hashed = ids[order], hashed[order]
            block = block_of(hashed, blocks)
            parts = cut_by(block)
            yield pa.RecordBatch.from_arrays([pa.array([int(block[i]) for i, _ in parts], pa.int64()), pa.array([ids[i:j].tobytes() for i, j in parts], pa.binary()), pa.array([hashed[i:j].tobytes() for i, j in parts], pa.binary())], names=["block", "docs", "hashes"])

    def look_up(marks: pa.Table, block: pa.Table) -> pa.Table:
        ids, hashed = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        bits = np.frombuffer(block["twice"][0].as_buffer(), dtype=np.uint8) if block.num_rows else np.zeros(CELLS // 8, dtype=np.uint8)
        for d, h in zip(marks["docs"], marks["hashes"]):
            h = np.frombuffer(h.as_buffer(), dtype=np.uint64)
            hit = seen_twice(bits, low_half(h))
            ids.append(np.frombuffer(d.as_buffer(), dtype=np.int64)[hit])
            hashed.append(h[hit])
        return pa.table({"doc_id": np.concatenate(ids), "hash": np.concatenate(hashed).view(np.int64)})

    def rows(batches):
        for batch in batches:
            for b in slices(batch, 64):
                known = {d: set(h) for d, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}
                for own, keys in gathered([b], lines, BYTES):
                    hit = [i for i, (d, h) in enumerate(zip(own, hashes(keys).view(np.int64).tolist())) if h in known[d]]
                    yield suspect_batch([own[i] for i in hit], [keys[i] for i in hit])

    marks = docs.mapInArrow(sent, "block bigint, docs binary, hashes binary")
    found = marks.groupBy("block").cogroup(twice.groupBy("block")).applyInArrow(look_up, "doc_id bigint, hash bigint")
    found = found.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    return docs.join(found, "doc_id").select("doc_id", "text", "hashes").mapInArrow(rows, SUSPECT)


def repeated_lines(docs: DataFrame, lines: int = LINES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, lines): the digests of the keys that each document of ``docs`` (doc_id, text) has to lose."""
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(n * CELLS_EACH / CELLS))
    twice = written(filters(docs, blocks, lines), "twice")
    way = suspects_by_broadcast if blocks * CELLS // 8 <= broadcast_bytes else suspects_by_block
    suspects = written(way(docs, twice, blocks, lines), "suspects")
    sent = suspects.where("key IS NOT NULL").select("key", "least", "most")
    repeats = sent.groupBy("key").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("key", "first")
    later = sent.join(repeats, "key").where("least > first").select(F.col("least").alias("doc_id"), F.unhex(F.md5("key")).alias("line"))
    known = suspects.where("line IS NOT NULL").select("doc_id", "line")
    return known.unionAll(later).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


RESULT = (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("text", T.StringType()), ("kept_sha256", T.StringType()))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, lines: int = LINES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop the lines (split at \\n) whose key stands in a document with a smaller id: the line without space and \\t to \\r at
    its ends, A-Z lower-cased, if that has at least ``LEAST_CHARS`` code points. One row a document: doc_id, n_lines (before),
    n_dropped, text (the other lines, unchanged, joined by \\n; as it was, null too, where none goes) and kept_sha256.

    1. Tasks hand on the hashes of their keys for two Bloom filters, of those seen once and twice, which are merged by block
       and grow with the input (``CELLS_EACH`` bits a line each).
    2. Only lines that the second filter knows are shuffled. The filter goes to all tasks if it takes at most
       ``broadcast_bytes``; beyond that hashes go to its blocks. A part (at most ``lines`` lines) sends on each key once.
    3. Suspected keys are grouped by their text; those of two documents or more stay in the smallest only.

    All lines of the smallest document stay, also if it has a key several times. A null or empty text is one empty line. Rows
    of one id are one document: they do not repeat each other, and each loses what a smaller id has. A row with a null id
    loses nothing and takes nothing from others. An empty table gives no rows. With ``carry`` there is ``row`` (all columns
    but the text, whatever their names) in place of the id. Memory is bounded by lines and bytes, inside long texts too, but
    for the one text at hand.
    """
    own = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("bigint").alias("id"), *carried(docs, id_col, text_col, carry))
    gone = written(repeated_lines(own.where("id IS NOT NULL").select(F.col("id").alias("doc_id"), "text"), lines, broadcast_bytes), "lines")
    size = gone.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("lines")).alias("lines")).first()
    cut = gone.select(F.col("doc_id").alias("id"), "lines")
    if 32 * (size["lines"] or 0) + 32 * size["docs"] <= 32 << 20:
        cut = F.broadcast(cut)
    last = own.columns[-1]

    def rows(batches):
        for batch in batches:
            for b in slices(batch):
                out = []
                for text, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    data, dropped = (text or "").encode(), 0
                    n_lines = data.count(b"\n") + 1
                    if known:
                        known = set(known)
                        left = [line for line in data.split(b"\n") if (key := line_key(line)) is None or digest(key) not in known]
                        dropped = n_lines - len(left)
                        data = b"\n".join(left)
                    out.append((n_lines, dropped, data.decode() if dropped else text, hashlib.sha256(data).hexdigest()))
                n, d, kept, sha = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=[last, *[c for c, _ in RESULT]])

    return own.join(cut, "id", "left").select("text", "lines", last).mapInArrow(rows, T.StructType([own.schema[last], *[T.StructField(c, k) for c, k in RESULT]]))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns it has, their texts without repeated lines."""
    return uncarried(line_dedup(docs, id_col, text_col, carry=True), docs.columns, text_col)
