"""Token ids, counts, packing, license scans, decontamination, near and substring dedup, against brute force."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import decontaminate, encoding, license_scan, near_dedup, packing, shared, substring_dedup, token_counts, token_output
from strata.llm.shared import shared_path
from tests.conftest import SF_SMALL
from tests.llm import cases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(alphabet=st.one_of(st.sampled_from(list(" \t\n\r\x1c\x85\xa0abcdeEéÉ'sİßΣσ19.,!|-中\u0301")), st.characters(exclude_categories=("Cs",))), max_size=60)


def ids_of(path, texts, end):
    return [[*e.ids, end] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_encode_like_whole_texts(path):
    own, whole = encoding.ChunkEncoder(path, limit=50), Tokenizer.from_file(path)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(ODD | st.sampled_from(["<|endoftext|>x", "it's a.\nNew one", "don't, we'll", ""]), max_size=6))
    def same(texts):
        assert own.encode(texts) == [np.asarray(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]

    same()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_each_distinct_chunk_is_looked_up_once_a_call(path):
    asked = []

    class Counting(encoding.ChunkEncoder):
        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)

    own = Counting(path)
    texts = ["a dog, a cat and a dog, " * 50 + "\n", "", "a cat"]
    assert own.encode(texts) == [np.asarray(e.ids, dtype="<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) <= 20 and " dog," not in own and " dog" in own


def test_tasks_that_keep_nothing_empty_the_worker():
    """A worker that has packed does not hold its chunks while it looks for near copies or repeated passages."""
    class Taken:
        def mapInArrow(self, rows, schema):
            return rows

    for task in (near_dedup.sketches(Taken()), substring_dedup.marks(Taken(), 1), substring_dedup.windows(Taken(), 1)):
        shared.held("left over", list)
        assert list(task(iter([]))) == [] and not shared._HELD


def test_packing_is_the_same_with_little_memory(spark):
    docs = cases.documents(spark).coalesce(1)
    much, little = (sorted(map(str, packing.pack(docs, BYTE, end_id=0, **few).collect())) for few in ({}, {"kept": 5, "rows_at_once": 2}))
    assert much == little


def test_pair_merger_counts_like_the_library():
    own, whole = token_counts.PairMerger(BYTE), Tokenizer.from_file(BYTE)

    @settings(max_examples=400, deadline=None)
    @given(ODD | st.sampled_from(["<|endoftext|> a<|endoftext|>", "aaaa" * 300]))
    def same(text):
        assert own.count(text) == len(whole.encode(text, add_special_tokens=False).ids)

    same()


def test_token_counts(spark):
    docs = cases.documents(spark)
    want = [(d, len((t or "").encode()), len(i) - 1, len(i) - 1 > 1024) for (d, t), i in zip(cases.rows_of(docs), ids_of(BYTE, [t for _, t in cases.rows_of(docs)], 0))]
    got = token_counts.token_counts(docs, BYTE, 1024)
    assert cases.ordered(got.collect()) == cases.ordered(want)
    assert token_counts.token_counts(docs.limit(0), BYTE, 1024).collect() == []


def test_token_output_round_trip(spark):
    docs = cases.documents(spark)
    rows = cases.rows_of(docs)
    path = shared_path(spark, "tokens")
    token_output.write_token_ids(docs, path, WORD, end_id=1, row_index_rows=1000)
    got = token_output.ids_crc32(token_output.read_token_ids(spark, path), "doc_id", "start", "n_tokens").orderBy("start").collect()
    ids = ids_of(WORD, [t for _, t in rows], 1)
    assert cases.ordered((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == cases.ordered((d, len(i), crc(i)) for (d, _), i in zip(rows, ids))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in got][:2] == [None, None]
    assert [r["ids"] for r in token_output.read_documents(spark, path, [11]).collect()] == [ids_of(WORD, ["one two"], 1)[0]]
    empty = shared_path(spark, "tokens")
    token_output.write_token_ids(docs.limit(0), empty, WORD, end_id=1)
    assert token_output.read_token_ids(spark, empty).collect() == []


def test_reader_pushes_the_id_filter_down(spark, capsys):
    path = shared_path(spark, "tokens")
    token_output.write_token_ids(cases.documents(spark), path, WORD, end_id=1)
    token_output.read_documents(spark, path, [7, 8]).explain("formatted")
    assert re.search(r"PushedFilters: \[[^\]]*In\(doc_id, \[7,8\]\)", capsys.readouterr().out)


def test_packing_holds_every_id_once(spark):
    docs = cases.documents(spark).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = packing.pack(docs, BYTE, end_id=0).collect()
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0 and len(r["ids"]) == r["length"] and r["ids_crc32"] == crc(r["ids"]) for r in got)
    by_id = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in by_id] == list(range(len(got)))
    assert [r["length"] for r in by_id] == sorted(r["length"] for r in got)
    for (d, _), ids in zip(rows, ids_of(BYTE, [t for _, t in rows], 0)):
        if [x for x, _ in rows].count(d) == 1:
            own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
            assert [i for r in own for i in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in own)
    assert sum(r["length"] for r in got) == sum(map(len, ids_of(BYTE, [t for _, t in rows], 0)))
    assert packing.pack(docs.limit(0), BYTE, end_id=0).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**7), st.integers(0, 12))
def test_binary_lengths(n, k):
    parts = packing.binary_lengths(n, 1 << k)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 1 << k for p in parts)
    assert all(parts.count(p) == 1 for p in parts if p < 1 << k)


def test_license_scan(spark):
    docs = cases.documents(spark)
    got = license_scan.license_scan(docs).collect()
    for (d, t), r in zip(cases.rows_of(docs), got):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            d, len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({label for _, label in places})))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
        for s in r["spans"]:
            assert cases.distance(s["notice"].encode(), " ".join(w[s["first_word"]:s["last_word"] + 1]).encode()) <= s["edits"] <= len(s["notice"]) // license_scan.CHARS_PER_EDIT
    by = {r["doc_id"]: r for r in got}
    assert by[19]["base_labels"] == "apache,gpl,mit" and by[20]["labels"] == "apache,proprietary" and by[2]["score"] == 0
    assert {(s["notice"], s["edits"]) for s in by[20]["spans"]} >= {("all rights reserved", 1), ("licensed under the apache license version 2 0", 1)}
    assert license_scan.license_scan(docs.limit(0)).collect() == []


def test_notices_with_edits_are_all_found():
    rng = random.Random(3)
    for phrase, label in license_scan.NOTICES.items():
        notice = license_scan.Notice(phrase, label)
        for _ in range(40):
            text = list(phrase)
            for _ in range(notice.edits):
                at = rng.randrange(1, len(text) - 1)
                text[at:at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
            if cases.distance(phrase.encode(), " ".join("".join(text).split()).encode()) <= notice.edits:
                assert license_scan.scan_text("ñu " * 5 + "".join(text) + " end", {}, [notice])[2], (phrase, "".join(text))


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=7, max_size=80), st.text("ab c", max_size=60), st.integers(0, 6))
def test_myers_distance_is_the_edit_distance(item, text, most):
    item, text = item.encode(), text.encode()
    found, want = decontaminate.best_match(item, text, most), cases.distance(item, text)
    assert (found is None) == (want > most)
    if found:
        assert found[0] == want and cases.distance(item, text[found[1]:found[2]]) == want


def test_license_spans_before_a_better_match():
    notice = license_scan.Notice("apache license", "apache")
    spans = license_scan.scan_text("apache licnse or apache license or apach license", {}, [notice])[2]
    assert [s[2:] for s in spans] == [(0, 1, 1), (3, 4, 0), (6, 7, 1)]


def test_license_scan_of_a_megabyte_of_notices():
    known = [license_scan.Notice(p, label) for p, label in license_scan.NOTICES.items()]
    began = time.process_time()
    n, _, spans = license_scan.scan_text("licensd under the apache license version 2 0 " * 22_000, {}, known)
    assert n == 22_000 * 8 and sum(s[1].startswith("licensed") for s in spans) == 22_000
    assert time.process_time() - began < 60


def test_parts_of_long_texts_find_the_same(spark, monkeypatch):
    """Tasks that hand on a few windows and fingerprints at a time, inside texts too."""
    docs = cases.documents(spark).repartition(3)
    parts = []
    monkeypatch.setattr(substring_dedup, "WINDOWS_AT_ONCE", 97)
    monkeypatch.setattr(substring_dedup, "PRINTS_AT_ONCE", 50)
    own = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "unhex(md5(text)) AS whole", "text")
    marked = list(substring_dedup.marks(own.select("doc_id", "text"), 3).collect())
    parts = [r for r in marked if r["block"] is not None]
    assert len(parts) > 10 and max(len(r["prints"]) for r in parts) < 8 * 3000
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert cases.ordered(got) == cases.ordered(cases.substring(cases.rows_of(docs)))


def contaminated(spark):
    rng = random.Random(9)
    items = [(0, cases.words(rng, 40)), (1, cases.words(rng, 30)), (2, None), (3, ""), (4, " .,"), (5, "short one")]
    edited = items[1][1].replace("the", "teh", 1).replace(" ", "  ", 3).upper()
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(items[0][1].split(" ")))
    docs = cases.documents(spark, [(30, "before " + items[0][1] + " after"), (31, "x " + edited), (32, far), (33, "a Short\nONE here " + items[0][1] + items[0][1])])
    return docs, spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string"), items


def test_decontamination_finds_what_brute_force_finds(spark):
    docs, table, items = contaminated(spark)
    want = set()
    for d, t in cases.rows_of(docs):
        if t and len(t) < 5000:
            for i, item in items:
                own = decontaminate.normalised(item or "")
                if own and cases.distance(own, decontaminate.normalised(t)) <= len(own) // decontaminate.CHARS_PER_EDIT:
                    want.add((d, i))
    one = decontaminate.benchmark_matches(docs, table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in one} == want >= {(30, 0), (31, 1), (33, 0), (33, 5)}
    assert cases.ordered(decontaminate.benchmark_matches(docs, table, block_bytes=10).collect()) == cases.ordered(one)
    assert sum((r["doc_id"], r["item_id"]) == (33, 0) for r in one) == 2
    kept = decontaminate.decontaminated(docs, table, block_bytes=10)
    assert kept.columns == docs.columns
    assert cases.ordered(kept.select("doc_id", "text").collect()) == cases.ordered(r for r in cases.rows_of(docs) if r[0] not in {d for d, _ in want})
    assert decontaminate.benchmark_matches(docs, table.limit(0)).collect() == [] == decontaminate.benchmark_matches(docs.limit(0), table).collect()


def test_decontamination_takes_short_items_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "concatenate a category, tomcat"), (2, "Cat food"), (3, "a cat, the CAT"), (4, "cat"), (5, "bobcat cat"), (6, "ñcat catñ")], "doc_id bigint, text string")
    items = spark.createDataFrame([(0, "cat"), (1, "t c")], "item_id bigint, text string")
    got = decontaminate.benchmark_matches(docs, items).collect()
    assert cases.ordered(got) == cases.ordered([(2, 0, 0, 0, 3), (3, 0, 0, 2, 5), (3, 0, 0, 10, 13), (4, 0, 0, 0, 3), (5, 0, 0, 7, 10)])
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()) == [1, 6]


def test_substring_dedup_edge_cases(spark):
    docs = cases.documents(spark)
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert cases.ordered(got) == cases.ordered(cases.substring(cases.rows_of(docs)))
    carried = substring_dedup.substring_dedup(docs, carry=True)
    assert [c for c in carried.select("row.*").columns] == [c for c in docs.columns if c != "text"]
    assert substring_dedup.substring_dedup(docs.limit(0)).collect() == []


def test_substring_dedup_of_one_id_with_several_texts(spark):
    rng = random.Random(3)
    passage, other = cases.words(rng, 80), cases.words(rng, 60)
    rows = [(1, passage), (2, other), (5, cases.words(rng, 90) + " " + passage), (5, cases.words(rng, 20)), (5, cases.words(rng, 300)), (5, other + " " + cases.words(rng, 70)), (6, cases.words(rng, 9))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for parts in (1, 4):
        got = substring_dedup.substring_dedup(docs.repartition(parts)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert cases.ordered(got) == cases.ordered(cases.substring(rows))


def test_substring_dedup_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = substring_dedup.substring_dedup(docs.repartition(7)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert cases.ordered(got) == cases.ordered(cases.substring(cases.rows_of(docs)))


def test_sketch_never_underestimates(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    marked = substring_dedup.marks(docs.repartition(5), 3).cache()
    suspects = {(r["doc_id"], p) for r in substring_dedup.estimated_repeats(marked, substring_dedup.sketch(marked)).collect() for p in r["prints"]}
    seen: dict[int, set[int]] = {}
    for d, t in cases.rows_of(docs):
        for p in substring_dedup.fingerprints(substring_dedup.word_hashes(substring_dedup.words_of(t or ""))).view(np.int64).tolist():
            seen.setdefault(p, set()).add(d)
    repeated = {(d, p) for p, ids in seen.items() if len(ids) > 1 for d in ids}
    assert repeated <= suspects and len(suspects) <= 1.1 * len(repeated) + 20
    marked.unpersist()


def test_near_dedup_edge_cases(spark):
    docs = cases.documents(spark)
    assert cases.ordered(near_dedup.near_duplicates(docs).collect()) == cases.ordered(cases.near(cases.rows_of(docs)))
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_near_dedup_whole_table_and_a_chain(spark):
    """A chain of documents, each linked with the next only, beside the whole small table."""
    rng = random.Random(2)
    w = [f"w{i}" for i in range(400)]
    chain = []
    for i in range(40):
        chain.append((10_000 + i, " ".join(w)))
        w[rng.randrange(400)] = f"new{i}"
        w[rng.randrange(400)] = f"more{i}"
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(chain, "doc_id bigint, text string"))
    assert cases.ordered(near_dedup.near_duplicates(docs.repartition(5)).collect()) == cases.ordered(cases.near(cases.rows_of(docs)))


def test_tensored_keys_meet():
    """A pair of 0.85 similarity shares a key of both collections (the chance of a miss is 2e-5)."""
    rng = np.random.default_rng(4)
    for _ in range(150):
        s = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        x, y = (near_dedup.half_keys(near_dedup.min_hashes(part)) for part in (s[:925], s[75:]))
        assert set(x[0]) & set(y[0]) and set(x[1]) & set(y[1])


def test_decontamination_frees_what_an_earlier_operator_held():
    import pyarrow as pa

    from strata.llm import decontaminate, shared

    shared.held("encoder of before", lambda: [0])
    batch = pa.RecordBatch.from_arrays([pa.array(["a leaked test item stands here", "clean"])], names=["text"])
    clean = decontaminate._cleaner([(1, b"leaked test item")], 16)
    assert [b.column(0).to_pylist() for b in clean([batch])] == [["clean"]]
    assert len(shared._HELD) == 1 and next(iter(shared._HELD)).startswith("items ")
    shared.word_hashes([b"x", b"y"])
    assert len(shared._HELD) == 1  # hashes of words are not kept
