"""Centroid clustering, periodic runs and line dedup, against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import centroids, line_dedup, periodic_runs
from tests.llm import cases


# --- centroid clustering ---------------------------------------------------------------------------------------------

def lloyd(rows, k=8, rounds=10, dim=64, seed=3):
    """Rows of (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), by Python integers and all distances."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * np.float64(x))) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [v for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in at]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        owner = [c for _, c in assign()]
        for c in range(len(at)):
            own = [v for (_, v), o in zip(kept, owner) if o == c]
            if own:
                at[c] = [sum(x) // len(own) for x in zip(*own)]
    last = assign()
    fit = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, c, fit(d), fit(sum(x for x, o in last if o == c)), fit(sum(x for x, _ in last)), sha[c]) for (i, _), (d, c) in zip(kept, last)]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1, 2.0) for i, v in rows],
                                 "vec_id bigint, embedding array<float>, cluster string, vec int, distance double")


def vectors(n, spread=1.0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64)) * spread
    return [(int(i), (centres[rng.integers(5)] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def awkward():
    some = vectors(60)
    inf, nan = float("inf"), float("nan")
    return [*some, (None, some[3][1]), (None, None), (200, None), (201, some[0][1][:63]), (202, []), (203, [nan, *some[0][1][1:]]), (204, [inf, *some[0][1][1:]]), (205, [None, *some[0][1][1:]]),
            (206, [0.0] * 64), (207, [-0.0] * 64), (208, some[7][1]), (9, some[9][1]), (9, some[10][1]), (9, some[9][1]), (-5, some[11][1])]


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 2), (40, 3)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = awkward()
    # arrays of floats lose nothing on the way to Spark, as they are float32 already
    got = centroids.clusters(table(spark, rows).repartition(3), k=k, rounds=rounds)
    assert cases.ordered(got.collect()) == cases.ordered(lloyd(rows, k, rounds))


def test_clusters_of_few_equal_and_no_vectors(spark):
    one = vectors(1)[0][1]
    for rows in ([(1, one)], [(i, one) for i in range(20)], [(None, one), (None, one)]):
        assert cases.ordered(centroids.clusters(table(spark, rows)).collect()) == cases.ordered(lloyd(rows))
    none = centroids.clusters(table(spark, [(1, None), (2, [1.0])]))
    assert none.collect() == [] and none.columns == centroids.clusters(table(spark, [(1, one)])).columns
    assert centroids.clusters(table(spark, [(1, one)]).limit(0)).collect() == []


def test_clusters_of_large_components_are_exact(spark):
    rows = [(i, [float(np.float32((-1) ** (i + j) * 2.0 ** (10 + (i * j) % 30))) for j in range(64)]) for i in range(30)]
    got = cases.ordered(centroids.clusters(table(spark, rows), k=4, rounds=3).collect())
    assert got == cases.ordered(lloyd(rows, 4, 3))
    assert any(r[2] is None for r in got)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.integers(0, 10**6))
def test_tree_finds_the_smallest_number_at_the_smallest_distance(k, dim, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, size=(k, dim))
    queries = rng.integers(-4, 5, size=(50, dim))
    number, square = centroids.vantage_point_tree(points.tolist()).nearest(queries)
    d = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert number.tolist() == d.argmin(axis=1).tolist() and square.tolist() == d.min(axis=1).tolist()


def test_tree_leaves_nodes_unopened():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(0, 9, size=(50, 8)) + 1000 * i for i in range(8)])
    tree = centroids.vantage_point_tree(points.tolist())
    seen = []
    tree.centroids = type("Counted", (), {"dtype": points.dtype, "__len__": lambda s: len(points), "__getitem__": lambda s, c: seen.append(c) or points[c]})()
    tree.nearest(points[:1])
    assert len(seen) < len(points) / 2


# --- periodic runs ---------------------------------------------------------------------------------------------------

def all_runs(w):
    """All lags, all stretches; a period is smallest if no smaller one holds throughout."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(w[t] == w[t + p] for t in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def runs_row(doc, text, fold):
    w = (text or "").encode().split()
    if fold and doc is not None and w and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest())


PART = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 8)).map(lambda x: x[0] * x[1])


@settings(max_examples=600, deadline=None)
@given(st.lists(PART | st.lists(st.integers(0, 30), max_size=5), max_size=8), st.integers(1, 5))
def test_runs_equal_all_lags(parts, times):
    w = [x for p in parts for x in p] * times
    assert periodic_runs.runs_of(w) == all_runs(w)


def test_segments_are_stable():
    w = np.asarray([1, 2, 1, 2, 9, 1, 2, 1, 2, 1, 2, 1, 2, 3, 3, 3, 3, 3, 3, 8, 5, 5, 5, 5, 6, 5, 5])
    got = periodic_runs.dense_segments(w)
    # 1 and 2 stand twice only before the 9, and four times after it; 5 stands six times, but four and two times around the 6
    assert got == [(5, 19)]
    for first, last in got:
        assert min(np.unique(w[first:last], return_counts=True)[1]) >= 4


def run_cases(spark):
    rng = random.Random(3)
    more = [(100 + i, cases.words(rng, rng.randint(1, 90)), "en") for i in range(60)]
    more += [(200, "x " * 5000), (201, ("a b c d " * 30) + "e " + "a b " * 9), (202, "= " * 6), (203, "= " * 5), (204, "a b " * 4), (205, ("a a b " * 4 + "z ") * 4), (205, "y y y y y y")]
    return cases.documents(spark, [(r[0], r[1]) for r in more])


@pytest.mark.parametrize("fold", [False, True])
def test_periodic_runs(spark, fold):
    docs = run_cases(spark)
    rows = [r for r in cases.rows_of(docs) if len((r[1] or "").split()) < 8000]
    few = docs.where("text IS NULL OR size(split(text, ' ')) < 8000")
    got = periodic_runs.periodic_runs(few, change=periodic_runs.folded if fold else None)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert cases.ordered(got.select(names).collect()) == cases.ordered(runs_row(d, t, fold) for d, t in rows)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_texts_without_repetitions(spark):
    docs = run_cases(spark)
    got = periodic_runs.without_repetitions(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[200]["text"] == "x" and by_id[204]["text"] == "a b" and by_id[203]["text"] == "= " * 5 and by_id[2]["text"] is None and by_id[200]["row"] == "clash"
    whole = periodic_runs.periodic_runs(docs).where("doc_id = 201").first()
    assert [tuple(r) for r in whole["runs"]] == [(0, 90, 3), (91, 18, 2)]


def test_very_long_texts_are_scanned_fast():
    assert periodic_runs.runs_of([i % 500 for i in range(300_000)]) == [(0, 300_000, 500)]
    rng = random.Random(1)
    assert len(periodic_runs.runs_of([rng.randrange(3) for _ in range(100_000)])) > 10


# --- line dedup ------------------------------------------------------------------------------------------------------

SPACE = " \t\n\v\f\r"


def lines_rows(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    first, last = {}, {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None:
                first[key(x)], last[key(x)] = min(d, first.get(key(x), d)), max(d, last.get(key(x), d))
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if d is None or len(key(x)) < least or first[key(x)] == last[key(x)] or first[key(x)] == d]
        out.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def line_cases(spark):
    rng = random.Random(8)
    common = [cases.words(rng, 6).replace("\n", " ") for _ in range(12)]
    rows = [(300 + i, "\n".join(rng.choice([rng.choice(common), cases.words(rng, 5), "short", "", rng.choice(common).upper() + " \t\r"]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    rows += [(500, "exactly10c\n123456789"), (501, " EXACTLY10C\v\n123456789"), (502, "ééééééééé\nééééééééé"), (503, "ééééééééé"), (504, "中中中中中中中中中中"), (505, "\f中中中中中中中中中中\r"), (506, "twice in one document\ntwice in one document"),
             (507, "one id, several rows"), (507, "one id, several rows\nand another line of it"), (508, "one id, several rows"), (None, common[0]), (None, common[0]), (509, "É is not lower-cased\nA is lower-cased"), (510, "é is not lower-cased\na IS LOWER-CASED"),
             (511, "\n".join(common[i % 12] + str(i % 700) for i in range(5000))), (512, "\n".join(common[i % 12] + str(i % 900) for i in range(5000))), (513, "long line " * 20_000 + "\nlong line " * 20_000), (514, "\n\n\n"), (515, "nbsp stays here "), (516, "nbsp stays here")]
    return cases.documents(spark, rows)


@pytest.mark.parametrize("lines, most", [(line_dedup.LINES, line_dedup.BROADCAST_BYTES), (7, line_dedup.BROADCAST_BYTES), (40, 0)])
def test_line_dedup(spark, lines, most):
    docs = line_cases(spark).repartition(5)
    want = lines_rows(cases.rows_of(docs))
    got = line_dedup.line_dedup(docs, lines=lines, broadcast_bytes=most)
    assert cases.ordered(got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == cases.ordered(want)
    assert sum(r[2] for r in want) > 300
    for r in got.collect():
        assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == r["kept_sha256"]
    assert line_dedup.line_dedup(docs.limit(0), lines=lines, broadcast_bytes=most).collect() == []


def test_few_lines_are_suspected(spark):
    docs = line_cases(spark).where("doc_id IS NOT NULL").select("doc_id", "text")
    twice = line_dedup.filters(docs, 1, line_dedup.LINES)
    once = docs.selectExpr("doc_id", "explode(split(text, '\\n')) AS line").selectExpr("doc_id", "lower(trim(line)) AS key").where("length(key) >= 10")
    single = once.groupBy("key").agg({"doc_id": "count"}).where("`count(doc_id)` = 1").count()
    suspects = line_dedup.suspects_by_broadcast(docs, twice, 1, line_dedup.LINES).where("key IS NOT NULL").select("key").distinct()
    assert single > 200 and suspects.join(once.groupBy("key").agg({"doc_id": "count"}).where("`count(doc_id)` = 1"), "key").count() <= single / 50


def test_columns_are_carried(spark):
    docs = line_cases(spark)
    got = line_dedup.without_repeated_lines(docs)
    assert got.schema == docs.schema and got.count() == docs.count()
    assert {r["row"] for r in got.collect()} == {"clash"}
