"""URL filter, quality classifier, nearest neighbours and the pipeline."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import near_dedup, nearest, quality, queries, url_filter
from tests.conftest import SF_SMALL
from tests.llm import cases

URLS = ["http://www.Example.COM/en/a", "http://a.example.com/en/a?x=1&y=2", "https://example.com/de/1#t", "https://b.net/es/2", "https://c.net/en/2", None, "", "no scheme", "x://", "http://net/fr/",
        "http://y.org?u=://z.com/", "a://b\nc.com/d\ne", "http://xexample.com/en/", "http://com/", "http://example.com"]


def parsed(url):
    """(host, path) by the letter of the rules."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[:min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host):]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]


def ruled(host, path):
    fit = [(r, v) for r, v in url_filter.RULES if (host == r[:r.find("/")] or host.endswith("." + r[:r.find("/")])) and path.startswith(r[r.find("/"):])]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS * 3)] + [(None, URLS[0], "c", "c"), (1, URLS[1], "c", "c")], "page_id bigint, url string, host string, rule string")
    got = url_filter.url_verdicts(pages).collect()
    assert len(got) == pages.count()
    urls = {i: u for i, u in enumerate(URLS * 3)} | {None: URLS[0]}
    for r in got:
        host, path = parsed(urls[r["page_id"]])
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0)).collect() == []
    assert {r["verdict"] for r in url_filter.url_verdicts(pages.where("page_id IN (4, 5)")).collect()} == {"allow"}


def test_trees_learn_the_labelled_urls(spark):
    """Held-out accuracy: of a rule that the filter is not told, on URLs that no other rule labels."""
    pages = spark.read.parquet(f"{SF_SMALL[:-3]}1/pages.parquet")
    hidden = "net/fr/"
    told = tuple(r for r in url_filter.RULES if r[0] != hidden)
    whole = url_filter.url_verdicts(pages).where(F.col("rule") == hidden).select("page_id", F.col("verdict").alias("truth"))
    got = url_filter.url_verdicts(pages, rules=told).where("rule IS NULL").join(whole, "page_id")
    right = got.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("verdict") == F.col("truth")).cast("int")).alias("a")).first()
    assert right["n"] > 20 and right["a"] > 0.9


def test_lexical_features_equal_plain_ones(spark):
    urls = [u or "" for u in URLS] + ["https://Éa.example.org/x/y/z?a=1&b=22&c#f?d=3", "aaaa", "http://1.2.3.4/%20%20/"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", url_filter.host_of("url")).withColumn("path", url_filter.path_of("url"))
    for r in url_filter.lexical(rows).collect():
        u, n = r["url"], max(len(r["url"]), 1)
        query = re.search(r"(?s)\A[^?#]*\?([^#]*)", u)
        params = 0.0 if query is None or not query[1] else query[1].count("&") + 1.0
        bits = -sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u))
        want = [len(u), len(r["host"]), len(r["path"]), r["path"].count("/"), len(r["host"].split(".")), sum(c in "0123456789" for c in u) / n, sum(not ("0" <= c <= "9" or "a" <= c.lower() <= "z" and c.isascii()) for c in u) / n, bits, params]
        assert [r[c] for c in url_filter.FEATURES[:9]] == pytest.approx(want), u
        assert r["suffix"] == ".".join(r["host"].split(".")[-2:])


def test_training_urls_do_not_see_their_own_label(spark):
    """Each URL has a suffix of its own: shares taken with the URL's own label would tell it, those of other folds tell nothing."""
    rows = [(i, f"http://h{i}.s{i}.{'com' if i % 2 else 'net'}/{'x' if i % 2 else 'es'}/{i % 7}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", url_filter.host_of("url")).withColumn("path", url_filter.path_of("url"))
    rule, verdict = url_filter.rule_of(url_filter.RULES)
    known = url_filter.lexical(pages).select("*", (verdict == "block").cast("double").alias("label"), url_filter.fold_of("url"))
    statistics = url_filter.training_suffixes(known, known.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("seen")))
    assert {(r["suffix_share"], r["suffix_weight"]) for r in statistics.collect()} == {(0.5, 0.0)} and statistics.count() == 200


def test_no_python_in_the_url_filter(spark, capsys):
    queries.QUERIES["op2_url_filter"](spark, SF_SMALL).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan and "Pandas" not in plan


def test_quality_held_out_accuracy(spark):
    sf = SF_SMALL[:-3] + "1"
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_quality"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    labels = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in got]
    own = [(r["predicted"], y) for r, y in labels if r["held_out"]]
    assert np.mean([p == y for p, y in own]) > 0.93
    good, bad = ([r["score"] for r, y in labels if r["held_out"] and y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_scores_come_from_the_size_differences_alone(spark):
    """The whole score again: two compressors, the normalised differences, the bent line."""
    docs, labels = (spark.read.parquet(f"{SF_SMALL[:-3]}01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    size = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for d in (model.bad, model.good)]
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, model).collect()}
    for r in docs.limit(40).collect():
        data = (r["text"] or "").encode()
        x, y = (len(c.compress(data)) for c in size)
        d = [(x - y) / max(x + y, 1), (x - y) / max(len(data), 1)]
        terms = [1.0, *d, *[max(v - b, 0.0) for v, own in zip(d, model.bends) for b in own]]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.clip(np.dot(terms, model.weights), -30, 30))))
    assert 0 < len(model.bad) <= 1 << 20 and len(model.weights) == 3 + sum(map(len, model.bends))


def test_quality_edge_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (5, 1), (8, 1), (16, 0), (15, 0), (13, None), (None, 1), (1, 1), (10, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert cases.ordered((r["doc_id"],) for r in got) == cases.ordered((d,) for d, _ in cases.rows_of(docs))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert quality.quality_scores(docs.limit(0), model).collect() == []
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    carried = quality.quality_scores(docs, model, carry=True)
    assert carried.columns == ["text", "row", "score", "predicted"] and carried.select("row.score").first()[0] == "clash"


def test_nearest_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    got = {}
    for r in queries.QUERIES["op7_nearest"](spark, SF_SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = table.orderBy("vec_id").collect()
    ids, data = np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], dtype=float)
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, far)) if i != q][:10]
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(abs(far[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for _, v, s in own)
        hits.append(len({v for _, v, _ in own} & set(ids[best].tolist())) / 10)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("spread, most", [(0.15, 0.3), (1.0, 1.0)])
def test_recall_on_ten_thousand_rows(spark, spread, most):
    """Vectors in clusters need little of the table; vectors without any structure need much, and still reach the recall."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 32))
    data = centres[rng.integers(200, size=10_000)] * (spread < 1) + spread * rng.normal(size=(10_000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<double>").repartition(8)
    found = {}
    for r in nearest.nearest(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recalls = []
    for q in range(0, 10_000, 100):
        far = np.square(data - data[q]).sum(axis=1)
        far[q] = np.inf
        recalls.append(len(found[q] & set(np.argsort(far)[:10].tolist())) / 10)
    assert np.mean(recalls) >= 0.9 and np.mean(np.asarray(recalls) < 0.7) <= 0.05, (np.mean(recalls), np.mean(np.asarray(recalls) < 0.7))
    forest = [nearest.fit_tree(data, 19, np.random.default_rng(5 + t)) for t in range(8)]
    share = nearest.needed_coverage(forest, data, 10, nearest.RECALL)
    assert share < most  # not a search of everything


def test_nearest_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 30)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(25)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (200, None), (300, [0.0] * 4), (400, [1.0, None, 0.0, 0.0]), (500, [1.0, float("nan"), 0.0, 0.0]), (600, [float("inf"), 0.0, 0.0, 0.0]), (700, [1.0, 2.0]), (800, []), (None, [1.0] * 4), (5, [0.5] * 4)]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id bigint, embedding array<double>, node string, rank int")
    got = nearest.nearest(table, F.col("vec_id") % 100 == 0, coverage=1.0, block_rows=7).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 100}
    for q in (0, 100):
        own = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
        assert own == [(i, 0.0) for i in [0, *range(100, 125)] if i != q][:10]
    few = nearest.nearest(table.where("vec_id IN (0, 3, 4)"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [3, 4]
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert nearest.nearest(table.where("vec_id = 0"), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("times", [2, 12])
@pytest.mark.parametrize("step", [0.0, 0.001])
def test_nearest_of_a_repeated_query_id(spark, times, step):
    """The query's own row ``times`` times, with one vector or several; a candidate id that stands 3 times."""
    rng = np.random.default_rng(2)
    rows = [(100, [1.0 + step * i, 0.0]) for i in range(times)] + [(i, [float(x) for x in rng.normal(size=2)]) for i in range(1, 40)] + [(7, [1.0, 0.1])] * 3 + [(8, [1.0, 0.0])] * 3
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = nearest.nearest(table, F.col("vec_id") == 100, coverage=1.0, block_rows=9).orderBy("rank").collect()
    want = sorted((float(np.hypot(v[0] - q[0], v[1] - q[1])), i) for q in {tuple(v) for i, v in rows if i == 100} for i, v in rows if i != 100)[:10]
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert [r["vec_id"] for r in got] == [i for _, i in want]
    assert np.allclose([r["score"] for r in got], [d for d, _ in want], atol=1e-12)


def test_equal_vectors_are_limited_before_the_shuffle(spark):
    table = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(600)], "vec_id bigint, embedding array<double>")
    got = nearest.nearest(table, F.col("vec_id") == 300, coverage=1.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [i for i in range(0, 600, 3) if i != 300][:10]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The awkward cases, leaks and junk beside labelled rows of the small tables, with clashing extra columns."""
    top = str(tmp_path_factory.mktemp("corpus"))
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars", *[f"'x' AS {c.split()[0]}" for c in cases.EXTRA.split(", ")])
    cases.documents(spark).unionByName(real).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic").write.parquet(f"{top}/labels.parquet")
    spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_pipeline_stages(spark, corpus):
    """Each stage against brute force on its own input; the columns of documents go through."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = cases.rows_of(docs)
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
        assert docs.columns == columns and docs.where("n_chars != length(text)").isEmpty()
        seen[name] = (before, cases.rows_of(docs))
    before, after = seen["near_dedup"]
    left = cases.ordered(after)
    for group in cases.groups(before, 80):
        rows = [before[i] for i in group]
        kept = [r for r in after if r in rows]
        assert len(kept) == 1 and kept[0][0] == min(d for d, _ in rows)
        left.remove(kept[0])
    assert left == cases.ordered(r for r in before if r[0] is None or not cases.shingles(r[1])) and len(after) < len(before)
    before, after = seen["substring_dedup"]
    want = {d: (n, r, h) for d, n, r, h in cases.substring(before)}
    assert {d for d, _ in after} == {d for d, (n, r, _) in want.items() if not (r and r == n)}
    assert all((d, t) in before if not want[d][1] else len(t.encode().split()) == want[d][0] - want[d][1] for d, t in after if d is not None)
    before, after = seen["decontaminate"]
    assert 0 < len(after) < len(before)
    items = [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    assert not any(i in (t or "") for _, t in after for i in items)
    before, after = seen["quality"]
    assert 0 < len(after) < len(before)
    total = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(total.columns)
    assert {r["doc_id"] for r in total.select("doc_id").distinct().collect()} == {d for d, _ in seen["decontaminate"][1]}


def test_rows_of_one_id_are_told_apart(spark):
    rng = random.Random(4)
    a, b, c = (cases.words(rng, 80) for _ in range(3))
    rows = [(7, a), (7, a), (7, a), (8, b), (8, c), (9, a), (6, c), (10, None), (10, ""), (10, ""), (None, a), (None, a), (11, cases.words(rng, 30)), (12, "two words"), (12, "two words")]
    docs = spark.createDataFrame([(d, t, "clash", i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, whole string, rows int")
    got = near_dedup.without_near_duplicates(docs)
    assert got.schema == docs.schema
    kept = cases.ordered((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == cases.ordered([(7, a), (8, b), (6, c), (10, None), (10, ""), (10, ""), (None, a), (None, a), rows[12], (12, "two words")])
    assert near_dedup.without_near_duplicates(docs.limit(0)).collect() == []


def test_pipeline_of_an_empty_table(spark, corpus, tmp_path):
    top = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    assert corpus_pipeline.run(spark, top).collect() == []
