"""License scans by diagonal voting, in DataFrame functions only.

Texts are cut into words and every rolling window of ``SHORT`` and of ``LONG`` words is hashed and joined to the positions
at which it stands in a template: phrases by short windows, license texts by long ones. The templates are a parameter of
bounded size and are broadcast; a window joins only if its words are equal too, so votes are exact.

A hit at document position p and template position t votes for the diagonal ``p - t``. A phrase stands where all its windows
vote for one diagonal. For license texts, neighbouring diagonals (at most ``GAP`` apart, as words were put in or left out) are
merged, and the span is verified: the share of the template's windows that it covers, each counted once, must reach
``COVERED``, over at most twice the template's length.

Only hits are shuffled, and they are counted by (document, template, diagonal) before anything else.

Defined results: a null or empty text has no words and no places; a document without hits has empty labels and score 0;
rows of one id and text count as one document each with the same result; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import small_side

SHORT, LONG = 2, 4
GAP = 8
COVERED = 0.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a text before its letters are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Opening passages of public license texts, as words.
TEXTS = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
}


def template_windows(phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> list[tuple[int, str, int, str, str, int]]:
    """(size, words, position, template, label, windows) of every window of every template."""
    out = []
    for size, templates in ((SHORT, [(f"phrase:{p}", p, label) for p, label in phrases.items()]), (LONG, [(f"text:{label}", t, label) for label, t in texts.items()])):
        for name, text, label in templates:
            words = text.split()
            n = len(words) - size + 1
            out += [(size, " ".join(words[i : i + size]), i, name, label, n) for i in range(n)]
    return out


def folded_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def _windows(texts: DataFrame, size: int, known: DataFrame) -> DataFrame:
    """Hits of the windows of ``size`` words: key columns, position p, and the template columns."""
    words = F.col("words")
    shifted = [F.slice(words, i + 1, F.greatest(F.size(words) - size + 1, F.lit(0))).alias(f"w{i}") for i in range(size)]
    rolled = texts.select("doc_id", "key", F.posexplode(F.arrays_zip(*shifted)).alias("p", "w"))
    gram = F.concat_ws(" ", *(F.col(f"w.w{i}") for i in range(size)))
    rolled = rolled.select("doc_id", "key", "p", F.xxhash64(*(F.col(f"w.w{i}") for i in range(size))).alias("hash"), gram.alias("gram"))
    return rolled.join(F.broadcast(known), "hash").where(F.col("gram") == F.col("words")).drop("gram", "words", "hash")


def hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Every window of a document that stands in a template: doc_id, key, p, t, template, label, windows."""
    spark = docs.sparkSession
    known = spark.createDataFrame(template_windows(phrases, texts), "size int, words string, t int, template string, label string, windows int")
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), folded_words(F.col(text_col)).alias("words"))
    parts = []
    for size in (SHORT, LONG):
        # The hash of the words one by one, as the windows' own.
        hashed = known.where(F.col("size") == size).withColumn("hash", F.xxhash64(*(F.split("words", " ")[i] for i in range(size)))).drop("size")
        parts.append(_windows(own, size, hashed))
    return parts[0].unionByName(parts[1])


def spans(found: DataFrame) -> DataFrame:
    """Merged diagonals: doc_id, key, template, label, first and last word, coverage, verified; for phrases a row for each place."""
    diagonal = found.groupBy("doc_id", "key", "template", "label", "windows", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("seen"), F.min("p").alias("low"), F.max("p").alias("high"), F.min("t").alias("t_low"), F.max("t").alias("t_high"))
    is_phrase = F.col("template").startswith("phrase:")
    ordered = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered)) > GAP, F.lit(True)) | is_phrase
    # After an edit the template goes on; where it goes back behind all earlier words, the notice begins again.
    again = F.coalesce((F.col("low") > F.lag("high").over(ordered)) & (F.col("t_low") <= F.lag("t_high").over(ordered)), F.lit(False))
    apart = apart | again
    grouped = diagonal.withColumn("__new", apart.cast("int")).withColumn("group", F.sum("__new").over(ordered))
    merged = grouped.groupBy("doc_id", "key", "template", "label", "windows", "group").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"), F.min("low").alias("first"), F.max("high").alias("last"))
    length = F.col("last") - F.col("first") + 1
    enough = F.when(is_phrase, F.col("covered") == F.col("windows")).otherwise((F.col("covered") >= COVERED * F.col("windows")) & (length <= 2 * F.col("windows") + LONG))
    return merged.withColumn("coverage", F.col("covered") / F.col("windows")).withColumn("verified", enough).drop("group")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(hits(docs, id_col, text_col, phrases, texts))
    base = F.col("template").startswith("phrase:") & F.col("verified")
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(F.when(x, F.col("label")))), ",")
    per_doc = found.groupBy("doc_id", "key").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("verified")).alias("labels"), F.max(F.when(F.col("verified"), F.lit(1.0)).otherwise(F.col("coverage"))).alias("score"))
    per_doc = small_side(per_doc.withColumnsRenamed({"doc_id": "__id", "key": "__key"}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql_values() -> str:
    return ", ".join(f"({size}, '{words}', {t}, '{name}', '{label}', {n})" for size, words, t, name, label, n in template_windows())


ORACLE = rf"""
WITH texts AS (
  SELECT doc_id, md5(coalesce(text, '')) AS k,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), known(size, words, t, template, label, windows) AS (VALUES {_sql_values()}),
grams AS (
  SELECT doc_id, k, {SHORT} AS size, unnest(generate_series(1, len(w) - {SHORT - 1})) AS i, w FROM texts WHERE len(w) >= {SHORT}
  UNION ALL
  SELECT doc_id, k, {LONG}, unnest(generate_series(1, len(w) - {LONG - 1})), w FROM texts WHERE len(w) >= {LONG}
), hits AS (
  SELECT DISTINCT doc_id, k, i - 1 AS p, t, template, label, windows
  FROM (SELECT doc_id, k, size, i, array_to_string(w[i : i + size - 1], ' ') AS words FROM grams) g JOIN known USING (size, words)
), diagonals AS (
  SELECT doc_id, k, template, label, windows, p - t AS d, list(DISTINCT t) AS seen, min(p) AS low, max(p) AS high, min(t) AS t_low, max(t) AS t_high FROM hits GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN starts_with(template, 'phrase:') OR lag(d) OVER o IS NULL OR d - lag(d) OVER o > {GAP} OR (low > lag(high) OVER o AND t_low <= lag(t_high) OVER o) THEN 1 ELSE 0 END AS is_new
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, k, template ORDER BY d)
), grouped AS (
  SELECT *, sum(is_new) OVER (PARTITION BY doc_id, k, template ORDER BY d) AS grp FROM marked
), merged AS (
  SELECT doc_id, k, template, label, windows, grp, len(list_distinct(flatten(list(seen)))) AS covered, min(low) AS first, max(high) AS last FROM grouped GROUP BY ALL
), judged AS (
  SELECT *, starts_with(template, 'phrase:') AS phrase, covered / windows AS coverage,
    CASE WHEN starts_with(template, 'phrase:') THEN covered = windows ELSE covered >= {COVERED} * windows AND last - first + 1 <= 2 * windows + {LONG} END AS verified
  FROM merged
), per_doc AS (
  SELECT doc_id, k, count(*) FILTER (phrase AND verified) AS n_base, min(first) FILTER (phrase AND verified) AS first_word, max(first) FILTER (phrase AND verified) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (phrase AND verified)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (verified)), ',') AS labels,
    max(CASE WHEN verified THEN 1.0::DOUBLE ELSE coverage END) AS score
  FROM judged GROUP BY ALL
)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM texts t LEFT JOIN per_doc d ON t.doc_id IS NOT DISTINCT FROM d.doc_id AND t.k = d.k
"""
