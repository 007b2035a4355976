"""The manifest against a plain tree in Python: shapes, proofs, versions, awkward rows."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from frames import awkward, empty

from threadloom.llm import manifest, rows


def sha(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(r, text):
    return sha("".join(field(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def grow(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def beside(levels, at):
    out = []
    for level in levels[:-1]:
        low = at - at % 3
        out.append(("".join(level[low:at]), "".join(level[at + 1 : low + 3])))
        at //= 3
    return out


def expected(docs):
    own = {}
    for r in docs:
        tampered = crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 2 == 0
        broken = leaf_of(r, r.text.replace("\n", "") if r.text is not None else None)
        own.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), broken if tampered else None))
    sources = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(own[s], key=lambda x: x[:3])]) for s in sources}
    top = grow([trees[s][-1][0] for s in sources])
    out, copies = [], []
    for k, s in enumerate(sources):
        for i, (has, doc, leaf, changed) in enumerate(sorted(own[s], key=lambda x: x[:3])):
            sides = beside(trees[s], i) + beside(top, k)
            chain = [changed or leaf]
            for a, b in sides:
                chain.append(sha(a + chain[-1] + b))
            root = top[-1][0]
            out.append((doc if has else None, leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in sides)), chain[-1], chain[-1] == root))
            copies += [(doc if has else None, i, level, d) for level, d in enumerate(chain)] if changed else []
    return out, copies


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_and_versions_equal_a_plain_tree(spark, levels):
    docs = awkward(spark)
    want, copies = expected(docs.collect())
    hit = rows.fold_of("doc_id", 2) == 0
    got = [tuple(r) for r in manifest.manifest(docs, hit, levels).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    made = [(r.doc_id, r.pos, r.level, r.digest) for r in manifest.versions(docs, hit, levels).collect()]
    assert sorted(made, key=repr) == sorted(copies, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (4, 9, 10), (1, 1, 1, 1), (27, 28, 81)])
def test_shapes(spark, sizes):
    rng = random.Random(len(sizes))
    data = [(100 * s + i, f"s{s}", None, i, rng.choice(["a\nb", "\n", "x", None])) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    want, _ = expected(docs.collect())
    assert sorted(tuple(r) for r in manifest.manifest(docs, rows.fold_of("doc_id", 2) == 0, 1).collect()) == sorted(want)


def test_many_sources_and_one_hot_source_and_none(spark):
    data = [(i, f"s{i % 40}" if i % 3 else None, "en", 1, f"line {i}\nend") for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    want, _ = expected(docs.collect())
    assert sorted(tuple(r) for r in manifest.manifest(docs, rows.fold_of("doc_id", 2) == 0, 2).collect()) == sorted(want)
    assert all(r.verified for r in manifest.manifest(docs).collect())
    none = manifest.manifest(empty(spark), rows.fold_of("doc_id", 2) == 0)
    assert none.count() == 0
