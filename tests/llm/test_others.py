"""Vectors, pages, license spans, the registered queries with SQL, and the pipeline."""

from __future__ import annotations

import random
import re

import oracle
import pytest
from frames import awkward, empty, fold

import corpus_pipeline
from threadloom.llm import knn, licenses, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, key):
    _, problem = oracle.compare(spark, oracle.connect(SF), SF, queries.QUERIES[key], queries.ORACLES[key])
    assert problem is None


def test_top_k_equals_brute_force_with_awkward_vectors(spark):
    import math

    rng = random.Random(8)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    vectors += [(1000 + i, [0.5] * 6) for i in range(300)] + [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2004, [math.inf] * 6), (2005, [0.1, 0.2]), (None, [0.3] * 6), (100, [0.2] * 6)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in ((r.vec_id, r.embedding) for r in frame.collect()) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for pivots in (1, 16):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(frame, frame_query(), 10, pivots=pivots).collect())
        want = []
        for q in {i for i, _ in usable if i % 100 == 0}:
            best = sorted((-sum(a * b for a, b in zip(v, x)), i) for j, v in usable if j == q for i, x in usable if i != q and len(x) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
        assert got == sorted(want)
    assert knn.top_k(frame.limit(0), frame_query()).count() == 0


def frame_query():
    from pyspark.sql import functions as F

    return F.col("id") % 100 == 0


def test_license_places_equal_brute_force_and_texts_are_found(spark):
    notice = licenses.TEXTS["mit"].split()
    edited = [*notice[:9], "really", *notice[9:20], *notice[22:]]
    docs = awkward(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(500, "Intro. " + " ".join(edited).upper() + " end"), (501, " ".join(notice[:8])), (502, "MIT license mit LICENSE general public license " * 3)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in licenses.scan(docs).collect() if r.doc_id is not None}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(r.text))
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        if r.doc_id not in (None, 12):
            got = rows[r.doc_id]
            assert (got.n_words, got.n_base, got.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
            assert (got.first_word, got.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
            assert 0 <= got.score <= 1
    assert rows[500].labels == "mit" and rows[500].n_base == 0 and rows[501].labels == "" and 0 < rows[501].score < 1
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty(spark)).count() == 0


def test_a_notice_that_repeats_keeps_its_label(spark):
    short, long = licenses.TEXTS["cc-by-nc"], licenses.TEXTS["bsd"]
    edited = " ".join([*short.split()[:2], "really", *short.split()[2:]])
    texts = {1: short, 2: "\n".join([short] * 3), 3: "\n".join([short] * 200), 4: "\n".join([long] * 3), 5: f"{short} of {short}. {short}", 6: edited}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert {i: got[i] for i in range(1, 6)} == {i: ("bsd" if i == 4 else "cc-by-nc", 1.0) for i in range(1, 6)}
    assert 0 <= got[6][1] <= 1


def test_audit_finds_altered_lost_and_added_records(spark):
    pages = [(i, f"http://h/{i}", "<p>" + "x" * (i % 50)) for i in range(5000) if i != 70] + [(3, "http://h/again", None), (None, None, None), (None, "http://h/none", "")]
    left = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert warc.audit(left, left).count() == 0
    changed = [(i, u, h + "!" if i == 4097 else h) for i, u, h in pages if i != 17] + [(70, "http://h/70", "new")]
    right = spark.createDataFrame(changed, "page_id long, url string, html string")
    got = {(r.number, r.fault) for r in warc.audit(left, right).collect()}
    assert got == {(17, "missing"), (70, "extra"), (4097, "altered")}
    assert {r.fault for r in warc.audit(left, right.limit(0)).collect()} == {"missing"}
    raw = warc.records(left.where("page_id = 3")).orderBy("offset").collect()
    assert raw[1].offset == raw[0].length and raw[0].record.startswith("WARC/1.0\r\n") and len(raw[0].record.encode()) == raw[0].length


def test_pipeline_keeps_columns_and_every_stage_acts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = corpus_pipeline.run(spark, SF)
    rows = made.collect()
    assert rows and made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in rows} < {r.doc_id for r in docs.select("doc_id").collect()}
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_top_k_of_a_repeated_query_id_equals_brute_force(spark):
    import math

    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(101, 400)] + [(100, [9.0] * 6)] * 14 + [(100, [-2.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    pairs = sorted((-sum(a * b for a, b in zip(v, x)), j) for i, v in whole if i == 100 for j, x in whole if j != 100)[:10]
    for pivots in (1, 16, 64):
        got = sorted((r["rank"], r.vec_id, r.score) for r in knn.top_k(frame, frame_query(), 10, pivots=pivots).where("query_id = 100").collect())
        assert got == [(k + 1, j, -s) for k, (s, j) in enumerate(pairs)]
