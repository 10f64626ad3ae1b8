"""License phrases of whole texts: exact places, and short notices found with a bounded number of edits."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, strings

#: Phrases that are looked for exactly, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices that may hold edits, with their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "apache license": "apache",
    "gnu general public license": "gpl",
    "general public license": "gpl",
    "licensed under cc by": "cc",
    "creative commons attribution": "cc",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 9

#: A-Z to a-z, other ASCII characters but digits and letters to a space; other bytes stay.
WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPAN = "struct<label: string, notice: string, first_word: bigint, last_word: bigint, edits: int>"


class Notice:
    """One notice: its exact seeds (edits + 1 pieces, one of which every match holds unchanged) and its pattern."""

    def __init__(self, phrase: str, label: str):
        self.phrase, self.label, self.edits = phrase, label, len(phrase) // CHARS_PER_EDIT
        at = [len(phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.seeds = [(i, phrase[i:j].encode()) for i, j in zip(at[:-1], at[1:])]
        self.pattern = regex.compile(rf"(?<= )(?:{regex.escape(phrase)}){{e<={self.edits}}}(?= )", regex.BESTMATCH)

    def windows(self, padded: bytes) -> list[tuple[int, int]]:
        """Byte ranges that may hold a match, one for each place that a seed points to; places within the edit budget of
        each other are one range. So a range is as long as the notice and its margins, however often a text repeats it."""
        starts = set()
        for offset, seed in self.seeds:
            at = padded.find(seed)
            while at >= 0:
                starts.add(at - offset)
                at = padded.find(seed, at + 1)
        margin, out, first = 3 * self.edits + 1, [], None
        for a in sorted(starts):
            if first is None or a > first + self.edits:
                first = a
                out.append((max(0, a - margin), a + len(self.phrase) + margin))
            else:
                out[-1] = (out[-1][0], a + len(self.phrase) + margin)
        return out

    def matches(self, text: str) -> list:
        """Matches in a range that do not overlap: the best one, and those of the parts before and after it."""
        out, parts = [], [(0, len(text))]
        while parts:
            lo, hi = parts.pop()
            if hi - lo >= len(self.phrase) - self.edits and (m := self.pattern.search(text, lo, hi)):
                out.append(m)
                parts += [(lo, m.start()), (m.end(), hi)]
        return out

    def spans(self, padded: bytes, spaces: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, last word, edits) of each match that the bounded-error pattern confirms, in order; of matches that
        overlap, that with fewer edits (then the first). ``spaces`` are the places of all spaces of the padded text."""
        found = set()
        for a, b in self.windows(padded):
            while a and padded[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(padded) and padded[b] & 0xC0 == 0x80:
                b += 1
            text = padded[a:b].decode()
            for m in self.matches(text):
                start, end = (a + len(text[:i].encode()) for i in m.span())
                found.add((sum(m.fuzzy_counts), start, end))
        taken: list[tuple[int, int, int]] = []
        for edits, start, end in sorted(found):
            at = bisect.bisect(taken, (start, end))
            if (not at or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (start, end, edits))
        return [(int(np.searchsorted(spaces, start)) - 1, int(np.searchsorted(spaces, end)) - 1, edits) for start, end, edits in taken]


def scan_text(text: str, phrases: dict[bytes, str], notices: list[Notice]):
    """(number of words, [(start word, label)] of exact places, spans of notices)."""
    words = text.encode().translate(WORDS_ONLY).split()
    padded = b" " + b" ".join(words) + b" "
    spaces = np.flatnonzero(np.frombuffer(padded, dtype=np.uint8) == 32)
    base = []
    for phrase, label in phrases.items():
        at = padded.find(phrase)
        while at >= 0:
            base.append((int(np.searchsorted(spaces, at)), label))
            at = padded.find(phrase, at + 1)
    return len(words), base, [(n.label, n.phrase, *s) for n in notices for s in n.spans(padded, spaces)]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row a document: n_words, n_base (places where a phrase's words stand consecutively), first_word and
    last_word (smallest and largest start of those), base_labels, labels, score and spans.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and of all non-ASCII characters. A notice
    may be off by one edit for each ``CHARS_PER_EDIT`` characters: of its edits + 1 pieces one must stand
    unchanged (pigeonhole), which finds the candidates; the regex library then confirms the edits between
    word borders and gives the span. ``score`` is 1 with a base place, else the best share of a notice's
    characters that needed no edit, else 0.

    One pass without any shuffle. A null text is empty: no words, empty label strings, score 0. Rows with
    equal or null ids each get their row; other columns are not used; an empty table gives no rows.
    """
    exact = {f" {p} ".encode(): label for p, label in phrases.items()}

    def rows(batches):
        known = [Notice(p, label) for p, label in notices.items()]
        for batch in batches:
            for b in slices(batch):
                out = []
                for text in strings(b.column(1)):
                    n, base, spans = scan_text(text, exact, known)
                    starts, own = [s for s, _ in base], {label for _, label in base}
                    score = 1.0 if base else max((1 - s[4] / len(s[1]) for s in spans), default=0.0)
                    out.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score,
                                [dict(zip(("label", "notice", "first_word", "last_word", "edits"), s)) for s in spans]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                         pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                                                 names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(rows, f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<{SPAN}>")
