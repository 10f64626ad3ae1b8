"""Small tables with every awkward case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random

import numpy as np

#: Extra columns whose names clash with those that operators make.
EXTRA = "n string, row string, kept string, score string, node string, block string, text2 string"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


_rng = random.Random(5)
VOCABULARY = sorted({"".join(_rng.choice(["an", "the", "io", "ré", "ña", "st", "qu", "Be", "o", "中"]) for _ in range(_rng.randint(1, 4))) for _ in range(900)})


def documents(spark, more: list[tuple] = ()):
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows and ids, a null id."""
    rng = random.Random(11)
    passage, base, long = words(rng, 80), words(rng, 300), words(rng, 25_000)
    near = base.split(" ")
    near[40] = "changed"
    rows = [(1, words(rng, 120)), (2, None), (3, ""), (4, " \n\t "), (5, base), (6, base), (6, base), (7, " ".join(near)), (8, words(rng, 40) + " " + passage + " " + words(rng, 30)),
            (9, passage.upper()), (10, passage + " " + words(rng, 200)), (11, "one two"), (12, "one two"), (13, long), (14, long + " tail"), (15, "x" * 70_000), (16, "De " * 900),
            (17, "a  double\t\ttab\x1c and\xa0odd \r\n\n\n spaces  "), (18, "<|endoftext|> inside <|startoftext|>"), (None, words(rng, 60)), (None, None), (19, "The MIT License, and the Apache\nLicense; GNU General-Public License"),
            (20, "All rights reservd. Licenced under the Apache License, Version 2.0"), *more]
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), *["clash"] * 7) for d, t in rows], SCHEMA)


def rows_of(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def substring(rows: list[tuple], window: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by grouping all windows."""
    least: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i:i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i:i + window])] < d:
                gone[i:i + window] = True
        left = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


def near(rows: list[tuple], percent: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) from all pairs; a row with a null id is linked by equal sets only."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            equal = sets[i] == sets[j]
            if both and (equal or (100 * both >= percent * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None)):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (d, least.get(find(i))) if x is not None]
        least[find(i)] = min(ids, default=None)
    return [(d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def groups(rows: list[tuple], percent: int) -> list[list[int]]:
    """Row numbers of each group of linked rows with words and an id; the others are left out."""
    known = [i for i, (d, t) in enumerate(rows) if d is not None and shingles(t)]
    own, out = {i: shingles(rows[i][1]) for i in known}, {}
    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in known:
        for j in known:
            if j < i and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                root[find(i)] = find(j)
    for i in known:
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def distance(item: bytes, text: bytes) -> int:
    """Smallest edit distance of ``item`` to any part of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
