"""Substring dedup: count-min sketches of window fingerprints find windows that may repeat; those are grouped exactly."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, emptied, mixed, rolling, slices, strings, word_hashes, written

#: Words of a window, and of the part whose smallest hash is a window's fingerprint.
WINDOW, PART = 50, 10
#: Rows of the count-min sketch, and cells of each row in one block of it.
DEPTH, CELLS = 2, 1 << 18
#: Cells of a row for each estimated fingerprint, and windows that one task groups at once.
CELLS_EACH, SHARD_WINDOWS = 8, 400_000
#: A task hands on what it gathered after so many fingerprints, or windows (inside a long text too).
PRINTS_AT_ONCE, WINDOWS_AT_ONCE = 200_000, 100_000
#: Odd multipliers: of rolling hashes, and of the sketch's rows.
BASE_PART, BASE_ONE, BASE_TWO = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ROWS = np.asarray([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and \\t to \\r, unchanged."""
    return text.encode().split()


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """For each window, the smallest hash of its ``PART``-word runs. Equal windows have equal fingerprints, and
    neighbouring windows mostly share theirs, so a text has about one for each 20 windows."""
    if len(hashes) < WINDOW:
        return np.empty(0, dtype=np.uint64)
    least, width, most = mixed(rolling(hashes, PART, BASE_PART)), 1, WINDOW - PART + 1
    while 2 * width <= most:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:len(hashes) - WINDOW + 1], least[most - width:][:len(hashes) - WINDOW + 1])


def cells(prints: np.ndarray) -> np.ndarray:
    """(DEPTH, n) cells of a block's sketch."""
    at = (prints[None, :] * ROWS[:, None] >> np.uint64(64 - int(math.log2(CELLS)))).astype(np.int64)
    return at + (np.arange(DEPTH) * CELLS)[:, None]


def block_of(prints: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(prints ^ np.uint64(BASE_TWO)) % np.uint64(blocks)).astype(np.int64)


def packed(values, kind: str) -> bytes:
    return np.asarray(values, dtype=kind).tobytes()


def cuts(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]]) if len(sorted_) else np.asarray([0])


def marks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, docs, prints): the distinct fingerprints of each document, packed for each part of a task and block.

    A part holds ``PRINTS_AT_ONCE`` fingerprints or those of one long text. A fingerprint that several documents of a part
    have repeats for certain: those are given at once (block null), and one mark of it (in place of a document) is sent on.
    So a fingerprint that very many documents have is one mark a part.
    """
    def sent(ids, prints):
        ids, prints = np.concatenate(ids), np.concatenate(prints)
        found, back, times = np.unique(prints, return_inverse=True, return_counts=True)
        several = times[back] > 1
        if several.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([ids[several].tobytes()], pa.binary()), pa.array([prints[several].tobytes()], pa.binary())], names=MARK_NAMES)
        ids = np.concatenate([ids[~several], np.full((times > 1).sum(), MARK, dtype=np.int64)])
        prints = np.concatenate([prints[~several], found[times > 1]])
        block = block_of(prints, blocks)
        order = np.argsort(block, kind="stable")
        ids, prints, block, at = ids[order], prints[order], block[order], cuts(block[order])
        pack = lambda values: pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block[at[:-1]]), pack(ids), pack(prints)], names=MARK_NAMES)

    def rows(batches):
        emptied()
        ids, prints, held = [], [], 0
        for batch in batches:
            for b in slices(batch):
                for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                    own = np.unique(fingerprints(word_hashes(words_of(text))))
                    ids.append(np.full(len(own), doc, dtype=np.int64))
                    prints.append(own)
                    held += len(own)
                    if held >= PRINTS_AT_ONCE:
                        yield from sent(ids, prints)
                        ids, prints, held = [], [], 0
        if held:
            yield from sent(ids, prints)

    return docs.mapInArrow(rows, "block bigint, docs binary, prints binary")


MARK_NAMES = ["block", "docs", "prints"]
#: Stands for a document in the mark of a fingerprint that several documents of a part have.
MARK = np.iinfo(np.int64).min


def sketch(marks_: DataFrame) -> DataFrame:
    """(block, repeated): the merged count-min sketch, one bit a cell: whether its count is over one.

    Each task sums its rows to a partial sketch of (cell, count) for each block; partial sketches are added up.
    """
    def partial(batches):
        for batch in batches:
            own: dict[int, list[np.ndarray]] = {}
            for block, prints in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own.setdefault(block, []).append(np.frombuffer(prints, dtype=np.uint64))
            out = [(block, *np.unique(cells(np.concatenate(prints)).ravel(), return_counts=True)) for block, prints in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([packed(o[1], "<u4") for o in out], pa.binary()), pa.array([packed(np.minimum(o[2], 255), "u1") for o in out], pa.binary())],
                                             names=["block", "cells", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(DEPTH * CELLS, dtype=np.uint32)
        for at, n in zip(table["cells"], table["counts"]):
            total[np.frombuffer(at.as_buffer(), dtype="<u4")] += np.frombuffer(n.as_buffer(), dtype="u1")
        return pa.table({"block": [table["block"][0].as_py()], "repeated": pa.array([np.packbits(total > 1).tobytes()], pa.binary())})

    return marks_.where("block IS NOT NULL").mapInArrow(partial, "block bigint, cells binary, counts binary").groupBy("block").applyInArrow(merge, "block bigint, repeated binary")


def estimated_repeats(marks_: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc_id, prints): each document's fingerprints whose estimated count (the least over the rows) is over one."""
    def unpacked(batches):
        for b in batches:
            for docs, prints in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, dtype=np.int64)), pa.array(np.frombuffer(prints, dtype=np.int64))], names=["doc_id", "print"])

    def look_up(sent: pa.Table, block: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "print": pa.array([], pa.int64())})
        docs, prints = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in sent[name]]) for name, kind in (("docs", np.int64), ("prints", np.uint64)))
        bits, at = np.frombuffer(block["repeated"][0].as_buffer(), dtype=np.uint8), cells(prints)
        hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0) & (docs != MARK)
        return pa.table({"doc_id": docs[hit], "print": prints[hit].view(np.int64)})

    kind = "doc_id bigint, print bigint"
    found = marks_.where("block IS NOT NULL").groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(look_up, kind)
    known = marks_.where("block IS NULL").select("docs", "prints").mapInArrow(unpacked, kind)
    return found.unionAll(known).groupBy("doc_id").agg(F.collect_list("print").alias("prints"))


def runs_of(docs: np.ndarray, wholes: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """doc_id, whole, first and last of the runs of successive windows of a row, from (doc, whole, window) in any order."""
    order = np.lexsort((at, wholes[:, 1], wholes[:, 0], docs))
    docs, wholes, at = docs[order], wholes[order], at[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (wholes[1:] != wholes[:-1]).any(axis=1) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs))[:len(first)] - 1
    return [pa.array(docs[first], pa.int64()), pa.array([w.tobytes() for w in wholes[first]], pa.binary()), pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32())]


def grouped(one: np.ndarray, two: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and document, and for each place in it whether a smaller document has the window."""
    order = np.lexsort((docs, two, one))
    one, two, docs = one[order], two[order], docs[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    least = docs[new][np.cumsum(new) - 1] if len(docs) else docs
    return order, docs > least


RUN = "doc_id bigint, whole binary, first int, last int"


def windows(docs: DataFrame, shards: int) -> DataFrame:
    """Windows of (doc_id, whole, text, prints) rows whose fingerprint is among ``prints``, packed for each part of a task and
    shard. A part holds at most ``WINDOWS_AT_ONCE`` windows; a long text may make several.

    In each part, an occurrence in another document than the part's smallest is known to repeat: it is
    given as a run at once (shard null). So a window sends on one document for each part, however many have it.
    """
    def sent(parts):
        ids, wholes, at, one, two, prints = (np.concatenate(p) for p in zip(*parts))
        order, repeats = grouped(one, two, ids)
        known = order[repeats]
        runs = runs_of(ids[known], wholes[known], at[known])
        if n := len(runs[0]):
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *runs, *[pa.nulls(n, pa.binary())] * 5], names=WINDOW_NAMES)
        keep = np.sort(order[~repeats])
        shard = (mixed(prints[keep] ^ np.uint64(BASE_ONE)) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        keep, shard, cut = keep[by], shard[by], cuts(shard[by])
        pick = lambda values, kind: pa.array([packed(values[keep[i:j]], kind) for i, j in zip(cut[:-1], cut[1:])], pa.binary())
        n = len(cut) - 1
        none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), *none, pick(ids, "<i8"), pick(wholes, "<u8"), pick(at, "<i4"), pick(one, "<u8"), pick(two, "<u4")], names=WINDOW_NAMES)

    def rows(batches):
        emptied()
        parts, held = [], 0
        for batch in batches:
            for b in slices(batch):
                for doc, whole, text, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2)), b.column(3)):
                    hashes = word_hashes(words_of(text))
                    prints = fingerprints(hashes)
                    every = np.flatnonzero(np.isin(prints, np.asarray(known.values).view(np.uint64)))
                    if not len(every):
                        continue
                    one, two = (mixed(rolling(hashes, WINDOW, base)) for base in (BASE_ONE, BASE_TWO))
                    while len(every):
                        at, every = every[:WINDOWS_AT_ONCE - held], every[WINDOWS_AT_ONCE - held:]
                        parts.append((np.full(len(at), doc, dtype=np.int64), np.tile(np.frombuffer(whole, dtype="<u8"), (len(at), 1)), at, one[at], (two[at] >> np.uint64(32)).astype(np.uint32), prints[at]))
                        held += len(at)
                        if held >= WINDOWS_AT_ONCE:
                            yield from sent(parts)
                            parts, held = [], 0
        if parts:
            yield from sent(parts)

    return docs.mapInArrow(rows, f"shard bigint, {RUN}, docs binary, wholes binary, at binary, one binary, two binary")


WINDOW_NAMES = ["shard", "doc_id", "whole", "first", "last", "docs", "wholes", "at", "one", "two"]


def exact_repeats(found: DataFrame) -> DataFrame:
    """Runs of windows that a smaller document has too, by grouping each shard's windows exactly."""
    def group(table: pa.Table) -> pa.Table:
        ids, wholes, at, one, two = (np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in table[name]]) for name, kind in (("docs", "<i8"), ("wholes", "<u8"), ("at", "<i4"), ("one", "<u8"), ("two", "<u4")))
        order, repeats = grouped(one, two, ids)
        known = order[repeats]
        return pa.Table.from_arrays(runs_of(ids[known], wholes.reshape(-1, 2)[known], at[known]), names=["doc_id", "whole", "first", "last"])

    sent = found.where("shard IS NOT NULL").select("shard", "docs", "wholes", "at", "one", "two")
    return found.where("shard IS NULL").select("doc_id", "whole", "first", "last").unionAll(sent.groupBy("shard").applyInArrow(group, RUN))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, runs): first and last window of each run of windows of ``docs`` (doc_id, whole, text) that start in a
    document with a smaller id too.

    Rows of one id may have different texts, so a row is known by its id and ``whole``, a 128-bit hash of its text.
    Fingerprints go by 63 bits of both (which never are ``MARK``): rows that share them only look up each other's too.
    """
    docs = docs.withColumn("key", F.shiftright(F.xxhash64("doc_id", "whole"), 1))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # Words have some six characters, and a text has two fingerprints for each run of windows of one fingerprint's reach.
    blocks = max(1, math.ceil(chars / 6 / (WINDOW - PART + 1) * 2 * CELLS_EACH / CELLS))
    marked = written(marks(docs.select(F.col("key").alias("doc_id"), "text"), blocks), "marks")
    suspects = written(estimated_repeats(marked, written(sketch(marked), "sketch")).withColumnRenamed("doc_id", "key"), "suspects")
    n = suspects.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("prints")).alias("prints")).first()
    prints = n["prints"] or 0
    shards = max(1, math.ceil(prints * (WINDOW - PART + 1) / 2 / SHARD_WINDOWS))
    hinted = F.broadcast(suspects) if 8 * prints + 24 * n["docs"] <= 32 << 20 else suspects
    found = written(windows(docs.join(hinted, "key").select("doc_id", "whole", "text", "prints"), shards), "windows")
    return exact_repeats(found).groupBy("doc_id", "whole").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def covered(n_words: int, runs: list[dict] | None) -> np.ndarray:
    """Which of a document's words a repeated window covers."""
    depth = np.zeros(n_words + 1, dtype=np.int64)
    for r in runs or ():
        depth[r["first"]] += 1
        depth[r["last"] + WINDOW] -= 1
    return np.cumsum(depth[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Remove each word that a window of ``WINDOW`` successive words covers whose words also start in a document
    with a smaller id. One row a document: doc_id, n_words, n_removed, text (the remaining words joined by one
    space; as it was, null too, where nothing goes) and kept_sha256 (of the remaining words joined by one space).

    1. Each window has a fingerprint, the smallest hash of its ten-word runs. Tasks count the fingerprints of
       their documents in count-min sketches, blocks of which are merged; the sketch grows with the input (eight
       cells a row for each fingerprint) and stays a distributed table.
    2. A window's count is at most its fingerprint's, and a sketch never underestimates. So only windows of
       fingerprints with an estimate over one can repeat; those are hashed (96 bits) and grouped exactly,
       in shards by fingerprint. Each batch sends on a window for its smallest document only.
    3. Runs of repeated windows go back to the documents, which are cut.

    Windows are judged on the input, not on what is left. A null text is empty. Rows with equal ids do not
    repeat each other, whatever their texts, and each loses what a smaller id has. A row with a null id loses nothing, and takes
    nothing from others. An empty table gives no rows. With ``carry`` there is ``row`` (all columns but the text,
    whatever their names) in place of the id.
    """
    text = F.col(f"`{text_col}`")
    own = docs.select(text.alias("text"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.unhex(F.md5(text)).alias("whole"), *carried(docs, id_col, text_col, carry))
    runs = written(repeated_runs(own.where("id IS NOT NULL").select(F.col("id").alias("doc_id"), "whole", "text")), "runs")
    size = runs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("runs")).alias("runs")).first()
    cut = runs.select(F.col("doc_id").alias("id"), "whole", "runs")
    if 8 * (size["runs"] or 0) + 48 * size["docs"] <= 32 << 20:
        cut = F.broadcast(cut)
    last = own.columns[-1]

    def rows(batches):
        emptied()
        for batch in batches:
            for b in slices(batch):
                out = []
                for text, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    left = words = words_of(text or "")
                    if known:
                        left = [w for w, gone in zip(words, covered(len(words), known)) if not gone]
                    joined = b" ".join(left)
                    out.append((len(words), len(words) - len(left), joined.decode() if len(left) < len(words) else text, hashlib.sha256(joined).hexdigest()))
                n, gone, kept, digest = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], names=[last, *RESULT])

    kinds = zip(RESULT, (T.LongType(), T.LongType(), T.StringType(), T.StringType()))
    return own.join(cut, ["id", "whole"], "left").select("text", "runs", last).mapInArrow(rows, T.StructType([own.schema[last], *[T.StructField(n, k) for n, k in kinds]]))


RESULT = ("n_words", "n_removed", "text", "kept_sha256")
