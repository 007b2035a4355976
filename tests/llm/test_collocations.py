"""Collocations against plain counting, with many waves, small blocks of keys and awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from frames import awkward, empty, fold

from threadloom.llm import collocations


def expected(rows, least, keep):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        covered = {}
        for g, c in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    covered[g[i : i + k]] = max(covered.get(g[i : i + k], 0), c)
        found = []
        for g, a in often.items():
            if 100 * covered.get(g, 0) < 80 * a:
                score, k, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:keep])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ab", "AB", "naïve", "中文"]
    phrases = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 6))] for _ in range(40)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(vocabulary)]
            if rng.random() < 0.15:
                words.append(rng.choice([",", "\n", "..", "\t", " ? ", "\x0b"]))
        rows.append((rng.choice(["en", "en", "de", None]), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,keep,first,keys,held", [(2, 12, 1, 1 << 21, 50), (3, 25, 2, 37, 1_000_000), (5, 60, 1, 1 << 21, 1_000_000)])
def test_mining_equals_plain_counting(spark, monkeypatch, seed, keep, first, keys, held):
    for name, value in (("LEAST", 5), ("FIRST", first), ("KEYS", keys), ("HELD", held)):
        monkeypatch.setattr(collocations, name, value)
    if first == 1:
        waves = []
        own = collocations._wave
        monkeypatch.setattr(collocations, "_wave", lambda *a: waves.append(1) or own(*a))
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "lang string, text string, a long, score double")
    got = sorted(tuple(r) for r in collocations.mine(docs, keep=keep).collect())
    want = expected(rows, 5, keep)
    assert want and got == want


def test_awkward_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", 2)
    docs = awkward(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in collocations.mine(docs).collect()) == expected(rows, 2, 2000)
    none = collocations.mine(empty(spark))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 6 * 10**12
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").select(collocations.ratio("a", "l", "r").alias("s")).first()
    assert row.s == 2_000_000 * big // (2 * big + 3)
