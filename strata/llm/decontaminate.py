"""Benchmark decontamination: exact pieces of test items locate candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_scan import WORDS_ONLY
from .shared import carried, held, slices, strings, uncarried

#: Characters of a normalised item for each allowed edit.
CHARS_PER_EDIT = 16
#: Bytes of items that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 1 << 20

MATCH = "doc_id bigint, item_id bigint, distance int, match_start bigint, match_end bigint"


def normalised(text: str) -> bytes:
    """Lower-cased words (ASCII letters and digits, all non-ASCII characters) with one space between, UTF-8."""
    return b" ".join(text.lower().encode().translate(WORDS_ONLY).split())


def ends(pattern: bytes, text: bytes, most: int) -> list[tuple[int, int]]:
    """Myers' bit-vectors: (distance, end) of every place in ``text`` where an approximate match of ``pattern`` ends."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv, xh = eq | minus, (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
        if score <= most:
            out.append((score, j))
    return out


def best_match(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest match of ``item`` in ``text`` with at most ``most`` edits; the first of equals."""
    if not (found := ends(item, text, most)):
        return None
    distance, end = min(found)
    back = min((d, j) for d, j in ends(item[::-1], text[:end][::-1], most) if d == distance)
    return distance, end - back[1], end


class Items:
    """Test items with an automaton of their pieces: edits + 1 of each, one of which every match holds unchanged."""

    def __init__(self, items: list[tuple[int, bytes]], chars_per_edit: int):
        self.items = [(i, t, len(t) // chars_per_edit) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            at = [len(t) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(at[:-1], at[1:]):
                pieces.setdefault(t[a:b].decode("latin-1"), []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def matches(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) for each item and place."""
        starts: dict[int, list[int]] = {}
        for last, (length, places) in self.automaton.iter(text.decode("latin-1")):
            for n, offset in places:
                starts.setdefault(n, []).append(last + 1 - length - offset)
        out = set()
        for n, at in starts.items():
            item, words, k = self.items[n]
            if not k:
                out.update((item, 0, s, s + len(words)) for s in at if text[s - 1:s] in (b"", b" ") and text[s + len(words):s + len(words) + 1] in (b"", b" "))
                continue
            at.sort()
            # Starts that are near each other may be one match; its true start is within k of each of its seeds'.
            runs = [[at[0], at[0]]]
            for s in at[1:]:
                if s - runs[-1][1] <= 2 * k:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for first, final in runs:
                low = max(0, first - k)
                if found := best_match(words, text[low:final + len(words) + k], k):
                    out.add((item, found[0], low + found[1], low + found[2]))
        return sorted(out)


def benchmark_matches(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_bytes: int = BLOCK_BYTES,
                      id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end) for each place where a whole test item stands in a
    document with at most length / ``chars_per_edit`` edits; places are byte offsets in the normalised text.

    An item too short for an edit stands only where its words are whole words of the document.

    Both sides are normalised first. Items go to the tasks in blocks of at most ``block_bytes`` (measured,
    by a running size over their ids), one pass over the documents for each block, so a large benchmark
    costs passes, not memory. Documents are not shuffled.

    A null or empty item, or one without words, matches nothing, and so does a null or empty text. Rows with
    equal ids each give their matches; items with equal texts are each reported. An empty table on either
    side gives no rows. Other columns are not used.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for block in item_blocks(items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")), block_bytes):
        part = own.mapInArrow(_matcher(block, chars_per_edit), MATCH)
        found = part if found is None else found.unionAll(part)
    return own.sparkSession.createDataFrame([], MATCH) if found is None else found


def decontaminated(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_bytes: int = BLOCK_BYTES,
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item stands (see ``benchmark_matches``)."""
    for block in item_blocks(items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")), block_bytes):
        own = docs.select(F.col(f"`{text_col}`").alias("text"), *carried(docs, id_col, text_col, True))
        docs = uncarried(own.mapInArrow(_cleaner(block, chars_per_edit), own.schema), docs.columns, text_col)
    return docs


def _name(block: list[tuple[int, bytes]], chars_per_edit: int) -> str:
    """What a worker process keeps the automaton of a block under; what an earlier operator left there goes."""
    return f"items {xxhash.xxh3_128_hexdigest(repr((block, chars_per_edit)).encode())}"


def _cleaner(block: list[tuple[int, bytes]], chars_per_edit: int):
    name = _name(block, chars_per_edit)

    def rows(batches):
        items = held(name, lambda: Items(block, chars_per_edit))
        for batch in batches:
            for b in slices(batch):
                yield b.filter(pa.array([not items.matches(normalised(t)) for t in strings(b.column(0))], pa.bool_()))
    return rows


def item_blocks(items: DataFrame, block_bytes: int):
    """Lists of (id, normalised text), each of at most ``block_bytes`` (or one item); rows come one by one."""
    block, size = [], 0
    for r in items.where("t IS NOT NULL").toLocalIterator():
        if not (t := normalised(r["t"])):
            continue
        if block and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["i"], t))
        size += len(t)
    if block:
        yield block


def _matcher(block: list[tuple[int, bytes]], chars_per_edit: int):
    name = _name(block, chars_per_edit)

    def rows(batches):
        items = held(name, lambda: Items(block, chars_per_edit))
        for batch in batches:
            for b in slices(batch):
                out = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))) for m in items.matches(normalised(text))]
                if out:
                    doc, item, distance, start, end = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                                     names=["doc_id", "item_id", "distance", "match_start", "match_end"])
    return rows
