"""Frames with every awkward case that the operators define a result for."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, kept string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ta", "ri", "mon", "é", "sel", "du", "kor"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def awkward(spark, seed: int = 5):
    """Nulls in every column, empty, short and long texts, copies, near copies, repeated rows, and columns named as the operators' own."""
    rng = random.Random(seed)
    base = words(rng, 240)
    near = [*base[:100], "changed", *base[101:]]
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "de", "b"), (4, None, "en", "a"), (5, "", "en", None), (6, " \n\t ", None, "b"), (7, "one two", "en", "a"), (8, "One\nTWO", "fr", "a"),
        (9, " ".join(words(rng, 30_000)), "en", "a"), (10, "x" * 50_000, "en", "c"), (None, "no id stands here", "en", "a"), (None, None, None, None), (11, "twice here", "es", "a"), (11, "twice here", "es", "a"), (12, "one id", "en", "a"), (12, "two texts of it", "en", "a"),
        (13, 'He said "you idiot" MIT License, the Apache  license.', "en", "a"), (14, "a | b | c | d\na | b | c | d", "en", "b"), (15, "###$$$ %%% 中文 текст <|endoftext|> done", "en", "a"),
    ]
    rows += [(100 + i, " ".join(words(rng, rng.randint(20, 90))), rng.choice(["en", "de"]), f"s{i % 3}") for i in range(60)]
    return spark.createDataFrame([(*r, None, 0.5, "w", "k") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, docs, of):
    """Labels of ``of(text)`` for all documents with an id, with nulls, other values and repeats among them."""
    rows = [(r.doc_id, of(r.text or ""), of(r.text or "")) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    return spark.createDataFrame(rows + rows[:3] + [(999, None, None), (None, 1, 1), (1000, 7, 7)], "doc_id long, quality int, toxic int")


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def spaced(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
