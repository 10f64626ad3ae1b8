"""Token ids of whole texts, by the tokenizers library, with a memo of space-separated chunks."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .shared import held

#: Longest chunk that the memo keeps, in characters.
KEPT_CHARS = 48
#: White space besides space and line feed, with all that Python or the library might take for it.
OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A code that no valid text holds, put before each border so that splitting keeps the space.
MARK = "\udc00"

#: ASCII marks.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Chunks whose ids are gathered at once.
GATHERED = 1 << 18
#: Bytes that a text with some of ``OTHER_SPACE`` has: control characters, or the first byte of a longer code.
ODD_BYTES = np.zeros(256, dtype=bool)
ODD_BYTES[[9, *range(11, 14), *range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True

#: Latin letters, which the library's normalisation leaves alone but for lower case.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A chunk of one Latin word; a Latin letter.
_WORD, _LETTER = re.compile(f"[ \n]?[{_LETTERS}]+").fullmatch, re.compile(f"[{_LETTERS}]").fullmatch


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


_SYMBOLS = dict(enumerate(byte_symbols()))
SPACE = _SYMBOLS[32]


class ChunkEncoder(dict):
    """Ids of ``tokenizers.Tokenizer.from_file(path)`` without added special tokens, as little-endian
    unsigned 32-bit bytes.

    Texts repeat their words, so a call looks up each distinct chunk (from a space or line feed on) once and
    gathers the ids from there, and chunks are kept from call to call, in
    two generations of ``limit`` chunks each, the older of which goes when the newer is full. That is right
    only where no token and no context of the tokenizer's splitting rule crosses such a border:

    * ``drop``: the rule throws white space away, so each space or line feed is a border;
    * ``lead``: the byte-level rule puts a space in front of the word that follows it; a single space or
      line feed between other characters is a border. In texts with other white space, chunks are joined
      with their neighbours up to such a border before they are encoded.

    A chunk that ends in a Latin letter and ASCII marks is the chunk without the marks, which
    is often known, and the marks, and is not kept itself: both rules always split between a letter and a mark after it, but for
    an apostrophe before further letters and for special strings.
    Other tokenizers get whole texts. Special strings inside texts are handled by the library, as its
    default has it (they hold no space, so a chunk has them whole).
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.style, self.older = Tokenizer.from_file(path), limit, style_of(path), {}
        self.tokenize = self.tokenizer.model.tokenize
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)).search if special else lambda chunk: None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.style == "whole":
            return self._library(texts)
        chunks, cut = self._split(texts)
        coded = chunks.dictionary_encode()
        known, place = list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), coded.indices.to_numpy()
        size, flat = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4, np.frombuffer(b"".join(known), dtype="<u4")
        first, parts = np.cumsum(size) - size, [flat[:0]]
        for at in range(0, len(place), GATHERED):
            own = place[at:at + GATHERED]
            n = size[own]
            parts.append(flat[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        ids, ends = np.concatenate(parts).tobytes(), 4 * np.concatenate([[0], np.cumsum(size[place])])[cut]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk[-1] in MARKS:
                stem = chunk.rstrip(MARKS)
                if _LETTER(stem[-1:]) and not self.special(chunk):
                    return self[stem] + self[chunk[len(stem):]]
            word = chunk[1:]
            if chunk[0] == " " and word.isascii() and word.isalpha():  # most words, in short
                ids = array("I", [t.id for t in self.tokenize(word.lower() if self.style == "drop" else SPACE + word)]).tobytes()
            else:
                ids = array("I", [t.id for p in self._pieces(chunk) for t in self.tokenize(p)]).tobytes() if _WORD(chunk) else self._library([chunk])[0]
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, one after the other in the texts' bytes, and which of them each text begins with (and how
        many there are)."""
        column = pa.array(texts, pa.large_string())
        at = np.frombuffer(column.buffers()[1], dtype=np.int64)[:len(texts) + 1] if texts else np.zeros(1, dtype=np.int64)
        held = column.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(held, dtype=np.uint8)[:at[-1]]
        begins = (data == 32) | (data == 10)
        if self.style == "lead":
            odd = ODD_BYTES[data]
            odd[1:] |= begins[1:] & begins[:-1]
            for i in np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1).tolist():
                begins[at[i]:at[i + 1]] = False
                begins[at[i] + np.cumsum([0, *[len(c.encode()) for c in self._chunks(texts[i])[:-1]]])] = True
        begins[at[:-1][at[1:] > at[:-1]]] = True
        first = np.flatnonzero(begins)
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data))), held), np.searchsorted(first, at)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, chunk: str) -> tuple[str, ...]:
        """A chunk of one Latin word as pieces of the rule, in the model's symbols."""
        head, letters = (chunk[0], chunk[1:]) if chunk[0] in " \n" else ("", chunk)
        if self.style == "drop":
            head, letters = "", letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_SYMBOLS)
        return (_SYMBOLS[10], letters) if head == "\n" else (_SYMBOLS[32] + letters if head else letters,)

    def _chunks(self, text: str) -> list[str]:
        if self.style == "drop" or not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or OTHER_SPACE.search(text)):
            return text.replace(" ", MARK + " ").replace("\n", MARK + "\n").split(MARK)
        items = text.split(" ")
        out, open_ = [], [items[0]]
        for x in items[1:]:
            if _ends(open_[-1]) and x and not x[0].isspace():
                out.append(" ".join(open_))
                open_ = ["", x]
            else:
                open_.append(x)
        return [*out, " ".join(open_)]


def _ends(x: str) -> bool:
    return bool(x) and not x[-1].isspace()


def style_of(path: str) -> str:
    """Which spaces are borders, read from the tokenizer's file; see ``ChunkEncoder``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or spec.get("post_processor"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "lead"
    parts = pre.get("pretokenizers") or [{}]
    rules = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s" in parts[0]["pattern"].get("Regex", "") and len(parts) == 2 \
            and parts[1].get("type") == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and set(rules) <= {"NFC", "Replace", "Lowercase"}:
        return "drop"
    return "whole"


def encoder(path: str, limit: int = 400_000) -> ChunkEncoder:
    """One for each Python worker process."""
    return held(f"encoder {path} {limit}", lambda: ChunkEncoder(path, limit))
