"""Periodic runs of words: rare words split a text, over and over; what is left is scanned lag by lag."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, slices, uncarried

#: A run holds its period so many times at least, and so many words.
REPEATS, LEAST_WORDS = 4, 6
#: Offsets within a period at which a suspected run is tried before it is followed word by word.
TRIES = 8


def dense_segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """Segments of ``codes`` in which every code stands ``REPEATS`` times or more.

    A run holds each of its words ``REPEATS`` times, so a word that is rarer within a segment is in no run there and splits
    it; what is left is judged again by the counts within it, until nothing splits.
    """
    n = len(codes)
    if n < LEAST_WORDS:
        return []
    place, segment, done = np.arange(n), np.zeros(n, dtype=np.int64), []
    while len(place):
        _, back, times = np.unique(segment * (int(codes.max()) + 1) + codes[place], return_inverse=True, return_counts=True)
        rare = times[back] < REPEATS
        split = np.zeros(int(segment[-1]) + 1, dtype=bool)
        split[segment[rare]] = True
        whole = ~split[segment]
        done.append(place[whole])
        place = place[~whole & ~rare]
        if not len(place):
            break
        # Successive places of what is left are the new segments; those too short for a run go.
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1] + 1
        segment = np.cumsum(new) - 1
        long = np.bincount(segment)[segment] >= LEAST_WORDS
        place, segment = place[long], segment[long]
        segment = np.unique(segment, return_inverse=True)[1]
    out = []
    for kept in done:
        # Two stable segments of one round are never neighbours: a rare word lies between them.
        first = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1] + 1]) if len(kept) else []
        last = np.r_[first[1:] - 1, len(kept) - 1] if len(kept) else []
        out += [(int(kept[i]), int(kept[j]) + 1) for i, j in zip(first, last)]
    return sorted(out)


def stretch(codes: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest stretch around ``at`` whose words are equal ``q`` apart: first word, and the one after the last."""
    n = len(codes)
    right, step = at, 64
    while right + q < n:
        to = min(right + step, n - q)
        differ = np.flatnonzero(codes[right:to] != codes[right + q:to + q])
        if len(differ):
            right += int(differ[0])
            break
        right, step = to, 4 * step
    left, step = at, 64
    while left > 0:
        start = max(0, left - step)
        differ = np.flatnonzero(codes[start:left] != codes[start + q:left + q])
        if len(differ):
            left = start + int(differ[-1]) + 1
            break
        left, step = start, 4 * step
    return left, right + q


def lag_scan(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a segment, from the smallest lag to the largest possible.

    A run of period q holds four successive multiples of q, so only every q-th word is compared with the next ones, m/q for a
    lag and m log m in all. Where four are equal, other words of the period are tried, then the run is followed to both ends.
    A stretch whose smallest period p is less than q is the run of p itself, which was found before: places within a run
    whose period divides q are passed over.
    """
    n = len(codes)
    found: list[tuple[int, int, int]] = []
    longer: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by period: starts and ends of the runs long enough for later lags
    for q in range(1, n // REPEATS + 1):
        if q & (q - 1) == 0:
            kept = {p: ends - starts >= REPEATS * q for p, (starts, ends) in longer.items()}
            longer = {p: (starts[kept[p]], ends[kept[p]]) for p, (starts, ends) in longer.items() if kept[p].any()}
        every = codes[::q]
        same = every[1:] == every[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        if not len(at):
            continue
        for p, (starts, ends) in longer.items():
            if q % p == 0:
                # Runs of one period overlap by less than it, so only the last that starts up to a place can hold it and the word q on.
                own = np.searchsorted(starts, at, side="right") - 1
                at = at[(own < 0) | (at + q >= ends[own])]
        for i in range(1, TRIES + 1):
            if not len(at):
                break
            t = at + i * q // (TRIES + 1)
            at = at[(codes[t] == codes[t + q]) & (codes[t] == codes[t + 2 * q])]
        end, first = 0, len(found)
        for c in at.tolist():
            if c < end:
                continue
            start, stop = stretch(codes, c, q)
            end = stop - q
            if stop - start >= max(LEAST_WORDS, REPEATS * q):
                found.append((start, stop - start, q))
        if len(found) > first:
            longer[q] = tuple(np.asarray(x) for x in zip(*[(start, start + length) for start, length, _ in found[first:]]))
    return found


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, by start, then period."""
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return sorted((first + start, length, q) for first, last in dense_segments(codes) for start, length, q in lag_scan(codes[first:last]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without what any run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def folded(words: list, doc: int | None) -> list:
    """The words as the digest query wants them: of every tenth document, by the crc32 of its id, the words from some place
    on repeat that place's first ones. No id, no change."""
    if doc is None or not words:
        return words
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
RESULT = (("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()), ("runs", RUN), ("text", T.StringType()),
          ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, change=None) -> DataFrame:
    """Runs of words that repeat a period ``REPEATS`` times or more, and the texts without the repetitions.

    Words are runs of characters other than space and \\t to \\r, unchanged, numbered from 0. A run is a stretch of at least
    ``LEAST_WORDS`` words and four times its smallest period q (words q apart are equal) that no neighbouring word extends. One
    row a document: doc_id, n_runs; start, length, period and exponent_milli (floor of 1000 * length / period) of the run with
    the greatest length / period (ties: the smallest start, then period; without runs null); runs (all of them, by start, then
    period); text (as it was, null too, if nothing goes; else the words left, joined by one space: a word goes that any run
    holds after its first period), and runs_sha256 and collapsed_sha256 (every run's ``start,length,period`` and a line feed;
    the words left joined by one space).

    Rarer words split a text until every word stands four times in its segment; segments are scanned lag by lag. One pass,
    no shuffle; a whole text is one row's work, m log m for m words, and memory is a few numbers a word of the text at hand.
    ``change`` (words, id -> words) is applied to the words first.

    A null text, like an empty one, has no words and no runs. Repeated rows and ids are judged each by itself; an id may be
    null. An empty table gives no rows. With ``carry`` there is ``row`` (all columns but the text, whatever their names) in
    place of the id.
    """
    own = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("bigint").alias("id"), *carried(docs, id_col, text_col, carry))
    last = own.columns[-1]
    schema = T.StructType([own.schema[last], *[T.StructField(c, k) for c, k in RESULT]])

    def row(text: str | None, doc: int | None) -> tuple:
        words = (text or "").encode().split()
        if change is not None:
            words = change(words, doc)
        runs = runs_of(words)
        left = collapsed(words, runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        joined = b" ".join(left)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], [dict(zip(("start", "length", "period"), r)) for r in runs], joined.decode() if runs else text,
                hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(joined).hexdigest())

    def rows(batches):
        for batch in batches:
            for b in slices(batch):
                out = list(zip(*[row(t, d) for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))] + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([b.column(2), *[pa.array(v, k) for v, k in zip(out, kinds)]], names=schema.names)

    return own.mapInArrow(rows, schema)


def without_repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the columns it has, their texts with one period of each run."""
    return uncarried(periodic_runs(docs, id_col, text_col, carry=True), docs.columns, text_col)
