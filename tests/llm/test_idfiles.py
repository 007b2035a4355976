"""Token-id files: codes against plain Huffman, blocks against whole decoding, files against the tokenizer."""

from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import pytest
from frames import awkward, empty

from threadloom.llm import idfiles, queries


def plain_cost(counts):
    """Bits of a Huffman code without a limit."""
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total


@pytest.mark.parametrize("seed", range(12))
def test_lengths_are_optimal_and_codes_are_free_of_prefixes(seed):
    rng = np.random.default_rng(seed)
    counts = np.where(rng.random(300) < 0.7, (2.0 ** rng.uniform(0, 30, 300)).astype(np.int64), 0)
    wide = idfiles.code_lengths(counts, 63)
    assert int((wide * counts).sum()) == plain_cost(counts)
    for limit in (9, 10, 16):
        lengths = idfiles.code_lengths(counts, limit)
        assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
        assert int((lengths * counts).sum()) >= plain_cost(counts)
        codes = idfiles.canonical(lengths)
        words = sorted(format(int(c), f"0{n}b") for c, n in zip(codes, lengths) if n)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_limited_code_is_the_best_of_all_on_a_small_alphabet():
    import itertools

    for seed in range(20):
        counts = np.random.default_rng(seed).integers(1, 200, 5)
        best = min(sum(int(c) * n for c, n in zip(counts, own)) for own in itertools.product((1, 2, 3), repeat=5) if sum(2.0**-n for n in own) <= 1)
        assert int((idfiles.code_lengths(counts, 3) * counts).sum()) == best


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 65, 5000])
def test_any_range_of_a_file_is_decoded_from_its_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 70_000).astype(np.uint32)
    if n > 2:
        ids[1] = 69_999
    raw = idfiles.file_bytes(ids, idfiles.code_lengths(np.bincount(ids)), [None, 5][: min(n, 2)], [n - n // 2, n // 2][: min(n, 2)], block=16)
    file = idfiles.IdFile(raw)
    assert (file.ids() == ids).all() and file.doc_ids == [None, 5][: min(n, 2)]
    for a, b in [(random.Random(k).randint(0, n), random.Random(-k).randint(0, n)) for k in range(30)]:
        assert (file.ids(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
    with pytest.raises(ValueError):
        idfiles.IdFile(raw[:-9] + bytes([raw[-9] ^ 1]) + raw[-8:])


def expected(rows, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    made = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    made = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in made]
    out, start = [], 0
    for i, n, crc in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        out.append((i, start, n, crc))
        start += n
    return out


AWKWARD = [
    "a\x0bb\x0cc\rd\te\n\nf", "it's we'll THEY'RE 'd 's", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ΟΔΟΣ ΣΑΣ İstanbul ǅ", "é ́x ạ̀", "中文　字 한국어 ᄒ ᅡᆫ", "x y z\u0085w\u001cq​v",
    "12345 a1b2 _under_score_ --- ... !!!", "\U0001f600️‍ x ﬁ ﷺ", "\x00\x01 \x7f", "s" * 3000, "'", " ",
    "a≠b ≮ ≯c x.̈y —,a,—b ,é é, ß.ẞ ÷×a Kelvin Å", "don't.'s x'S 'ſ a'", "café,cafe", "<|endoftext|", "x<|endoftext|>é <|Endoftext|>",
]


def test_files_give_back_the_tokenizers_ids(spark):
    docs = awkward(spark).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(AWKWARD)], docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    path = queries.word_vocabulary()
    want = sorted(expected(rows, path), key=repr)
    for options in ({}, {"per_file": 3000, "block": 7, "words_apart": True}):
        assert sorted((tuple(r) for r in idfiles.round_trip(docs, path, **options).collect()), key=repr) == want


def test_ids_themselves_and_empty_tables(spark, tmp_path):
    path = queries.word_vocabulary()
    docs = awkward(spark)
    listed = idfiles.write(docs, path, str(tmp_path / "files"), per_file=5000)
    got = idfiles.read(spark, str(tmp_path / "files"), listed, with_ids=True).collect()
    assert len(got) == docs.count() and listed.count() > 3
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 2 and len(r.ids) == r.n_tokens
    assert listed.agg({"n_ids": "sum"}).first()[0] == sum(r.n_tokens for r in got)
    none = idfiles.round_trip(empty(spark), path)
    assert none.count() == 0 and none.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_query_equals_the_tokenizer_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_huffman_ids"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(rows, queries.word_vocabulary()))
