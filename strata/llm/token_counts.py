"""Byte-pair token counts: a heap of adjacent pairs over a linked list of symbols, without any identifiers."""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MARK, OTHER_SPACE, byte_symbols
from .shared import Memo, slices, strings

#: The byte-level splitting rule (fixed value: it decides the counts).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairMerger:
    """Counts tokens of byte-level byte-pair vocabularies (``tokenizers`` JSON files).

    A piece of the splitting rule starts as a linked list of its bytes; the heap holds the ranked adjacent
    pairs. The pair of the lowest rank (the leftmost of equals) is popped and merged while it still stands
    there, and its new neighbours are pushed. Each merge takes one symbol away: tokens = bytes - merges.
    Cost is n log n in a piece's length, so a piece may be as long as a text.

    Counts of pieces and of chunks between borders (spaces and line feeds) are kept in bounded memos.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level byte-pair vocabulary without normalisation is needed")
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.symbols, self.find = byte_symbols(), regex.compile(PATTERN).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.pieces = Memo(lambda piece: self.merged(piece.encode()))
        self.chunks = Memo(self._pieces)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string inside it is one token."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)

    def _plain(self, text: str) -> int:
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or OTHER_SPACE.search(text):
            return self._pieces(text)
        # Single spaces and line feeds only: no piece goes across the place in front of one.
        return sum(map(self.chunks.__getitem__, text.replace(" ", MARK + " ").replace("\n", MARK + "\n").split(MARK)))

    def _pieces(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find(text)))

    def merged(self, data: bytes) -> int:
        """Symbols left of ``data`` when no adjacent pair is ranked any more."""
        rank, n = self.ranks.get, len(data)
        symbols = [self.symbols[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        left = n
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] is None or rank((symbols[i], symbols[j])) != r:
                continue  # one of the two has gone into another symbol since
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h))
        return left


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One for each Python worker process."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    One pass without any shuffle. A null text is empty (no bytes, no tokens); rows with equal or null ids
    each get their row; other columns are not used, whatever their names; an empty table gives no rows.
    """
    def rows(batches):
        count = merger(tokenizer).count
        for batch in batches:
            for b in slices(batch):
                texts = strings(b.column(1))
                n = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
