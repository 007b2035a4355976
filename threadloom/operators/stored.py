"""Saved queries that are a table: every clause kind matched by joins, with no query in the plan.

Of every clause the longest piece that one word must hold is its anchor. A text makes its distinct grams of three characters
once and meets the clauses whose anchor begins with one of them; only these are looked for in it, where the text stands, so
neither texts nor words are moved. Word clauses are counted over the token index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx
from ..functions.let import let
from ..session import cut_lineage

GRAM = 3
# Clauses that are broadcast at a time; texts are read once for each such part.
CLAUSES_AT_ONCE = 500_000
_KEYS = ["query_id", "clause_no"]
# One term: exclusion, title, then a phrase in quotes or a bare value; only white space may stand between terms.
TERM = r'(-?)((?i:title:)?)(?:"([^"]*)"(?=\s|\z)|([^\s"-][^\s"]*))(?:\s+|\z)'


def _clause(kind: Column, value: Column, title: Column, no: Column, plain: bool = False) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), title.alias("title_only"), no.alias("exclude"), F.lit(plain).alias("plain"))


def _split(text: Column) -> Column:
    """Clauses of one query; a text that is no clause query is one clause of words, a blank one has none."""
    groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(TERM), F.lit(i)).alias(n) for i, n in enumerate(("no", "title", "phrase", "bare"), 1)))

    def term(t: Column) -> Column:
        bare = t["bare"] != ""
        kind = F.when(~bare, "phrase").when(F.contains(t["bare"], F.lit("*")), "glob").otherwise("words")
        return _clause(kind, F.when(bare, t["bare"]).otherwise(t["phrase"]), t["title"] != "", t["no"] != "")

    def settle(terms: Column) -> Column:
        ordinary = lambda c: (c["kind"] == "words") & ~c["title_only"] & ~c["exclude"]
        said = lambda c: c["value"].rlike(r"\S") & ((c["kind"] != "glob") | (F.translate(c["value"], "*", "") != ""))
        usable = text.rlike(rf"\A(?:{TERM})+\z") & F.forall(terms, said) & F.exists(terms, lambda c: ~ordinary(c)) & F.exists(terms, lambda c: ~c["exclude"])
        words = F.array_join(F.transform(F.filter(terms, ordinary), lambda c: c["value"]), " ")
        alone = lambda value, plain: F.filter(F.array(_clause(F.lit("words"), value, F.lit(False), F.lit(False), plain)), lambda c: c["value"] != "")
        return F.when(usable, F.concat(alone(words, False), F.filter(terms, lambda c: ~ordinary(c)))).otherwise(alone(text, True))

    return let(F.transform(groups, term), settle)


def stored_clauses(queries: DataFrame) -> DataFrame:
    """Clauses of a table (query_id, raw): query_id, clause_no, kind, value (normalised), title_only, exclude, plain, tokens, positives."""
    text = F.regexp_replace(F.coalesce("raw", F.lit("")), r"\A\s+|\s+\z", "")
    split = queries.select("query_id", text.alias("text")).select("query_id", _split(F.col("text")).alias("c"))
    rows = split.select("query_id", F.size(F.filter("c", lambda c: ~c["exclude"])).alias("positives"), F.posexplode("c").alias("clause_no", "c"))
    rows = tx.with_normalised(rows.select("query_id", "clause_no", "positives", "c.kind", "c.title_only", "c.exclude", "c.plain", F.col("c.value").alias("said")), "value", F.col("said"))
    return rows.withColumn("tokens", tx.drop_stopwords(tx.distinct_tokens("value"))).drop("said")


# All but spaces, letters, digits and CJK. Ranges are written out: Java takes three times as long to negate them.
SIGN = rf"([\x{{00}}-\x{{1F}}!-/:-@A-Z\[-`{{-\x{{10FFFF}}&&[^{tx.CJK_RUN}]])"
BORDER = rf"(?<=[a-z0-9])(?=[{tx.CJK_RUN}])|(?<=[{tx.CJK_RUN}])(?=[a-z0-9])"


def _apart(text: Column) -> Column:
    """Text with spaces between its words (letters and digits, or CJK) and around every other sign."""
    signs = F.regexp_replace(text, SIGN, " $1 ")
    return F.when(text.rlike(tx.CJK_TEST), F.regexp_replace(signs, BORDER, " ")).otherwise(signs)


def _pieces(value: Column) -> Column:
    """Words of a literal with a space on every side on which they end; its own ends are open, as a text may go on there."""
    return F.regexp_extract_all(F.regexp_replace(_apart(value), r"\s+", "  "), F.lit("( ?[^ ]+ ?)"), F.lit(1))


def texts_of(headers: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, titled, norm) of all titles and visible bodies."""
    titles = headers.select(F.col("id").alias("conversation_id"), F.lit(True).alias("titled"), F.col("title").alias("text"))
    bodies = messages.select("conversation_id", F.lit(False).alias("titled"), markup.visible_text("body").alias("text"))
    return tx.with_normalised(titles.unionByName(bodies), "norm", F.coalesce("text", F.lit(""))).drop("text")


def anchored(clauses: DataFrame) -> DataFrame:
    """Clauses with what finds them in a text: anchor, gram, pattern, by_anchor (it alone decides), one row for titles, one for bodies.

    A space in an anchor is a side on which the word must end. Patterns are those of wildcards with several pieces. Anchors
    shorter than a gram have none: their clauses are looked for in every text.
    """
    glob, value = F.col("kind") == "glob", F.col("value")
    between = F.concat(F.lit(" "), value, F.lit(" "))
    single = ~_apart(value).rlike(r"\s")
    latin = single & (F.col("kind") == "words") & value.rlike("^[a-z0-9]+$")
    pieces = (
        F.when(glob, F.filter(F.regexp_extract_all(between, F.lit("([^*]+)"), F.lit(1)), lambda p: F.trim(p) != ""))
        .when(latin, F.array(between))
        .otherwise(_pieces(value))
    )
    # Words hold no other signs, so a wildcard with one matches nothing.
    usable = ~glob | F.translate(value, "*", "").rlike(f"^[a-z0-9{tx.CJK_RUN}]+$")
    pattern = F.when(glob & (F.size("pieces") > 1), F.replace(between, F.lit("*"), F.lit("[^ ]*")))
    # Titles are looked at as a whole; bodies only for clauses that have no token and are part of a clause query.
    body_too = ~F.col("title_only") & ~F.col("plain") & ~((F.col("kind") == "words") & (F.size("tokens") > 0))
    sides = F.when(body_too, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    anchor = F.get(F.array_sort("pieces", lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    held = clauses.where(usable).withColumn("pieces", pieces).where(F.size("pieces") > 0)
    held = held.select(*_KEYS, "kind", "value", anchor.alias("anchor"), pattern.alias("pattern"), (glob | latin | (single & (F.col("kind") == "phrase"))).alias("by_anchor"), F.explode(sides).alias("titled"))
    return held.withColumn("gram", F.when(F.length("anchor") < GRAM, "").otherwise(F.substring("anchor", 1, GRAM)))


def _held_in(texts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query_id, clause_no, conversation_id) of anchored clauses that a text satisfies, once for each text."""
    rows = texts.withColumn("flat", F.concat(F.lit(" "), _apart(F.col("norm")), F.lit(" ")))
    grams = F.array_distinct(F.regexp_extract_all("flat", F.lit("(?=(.[^ ].))"), F.lit(1)))
    near = rows.select("*", F.explode(F.array_append(grams, F.lit(""))).alias("gram")).join(F.broadcast(clauses), ["gram", "titled"])
    anchor = (F.length("anchor") == GRAM) | F.contains("flat", F.col("anchor"))  # an anchor of that length is its gram
    said = F.when(F.col("kind") == "phrase", F.contains("norm", F.col("value"))).otherwise(tx.contains_whole(F.col("norm"), F.col("value")))
    fits = F.when(~F.col("by_anchor"), said).when(F.col("pattern").isNull(), anchor).otherwise(anchor & F.regexp_like("flat", F.col("pattern")))
    return near.where(fits).select(*_KEYS, "conversation_id")


def held_in_texts(texts: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses that titles and bodies satisfy; as many are broadcast at once as ``CLAUSES_AT_ONCE`` allows."""
    clauses = cut_lineage(anchored(clauses))
    parts = max(1, -(-clauses.count() // CLAUSES_AT_ONCE))
    part = F.pmod(F.xxhash64(*_KEYS), F.lit(parts))
    return reduce(DataFrame.unionByName, [_held_in(texts, clauses.where(part == i) if parts > 1 else clauses) for i in range(parts)])


def tokens_in(texts: DataFrame) -> DataFrame:
    """(token, conversation_id, titled): distinct tokens of every text."""
    return texts.select("conversation_id", "titled", F.explode(tx.distinct_tokens("norm")).alias("token"))


def matches(headers: DataFrame, messages: DataFrame, postings: DataFrame | None, queries: DataFrame) -> DataFrame:
    """(query_id, conversation_id) of every stored query (query_id, raw): each positive clause matches, no excluded one does.

    Blank queries, which would list everything, have no rows. Without a stored index (``postings`` None) tokens come from the texts.
    """
    clauses = cut_lineage(stored_clauses(queries))
    texts = cut_lineage(texts_of(headers, messages))

    tokens = clauses.where("kind = 'words'").select(*_KEYS, "title_only", F.explode("tokens").alias("token"), F.size("tokens").alias("n_tokens"))
    placed = tokens_in(texts) if postings is None else postings.select("token", "conversation_id", (F.col("source") == "title").alias("titled"))
    by_token = placed.join(tokens, "token").where(~F.col("title_only") | F.col("titled"))
    by_token = by_token.groupBy(*_KEYS, "conversation_id").agg(F.count_distinct("token").alias("found"), F.max("n_tokens").alias("n_tokens")).where("found = n_tokens")

    keys = [*_KEYS, "conversation_id"]
    seen = by_token.select(*keys).unionByName(held_in_texts(texts, clauses).select(*keys)).distinct()
    seen = cut_lineage(seen.join(clauses.select(*_KEYS, "exclude", "positives"), _KEYS))
    found = seen.where("NOT exclude").groupBy("query_id", "conversation_id").agg(F.count("*").alias("n"), F.max("positives").alias("positives")).where("n = positives")
    return found.join(seen.where("exclude").select("query_id", "conversation_id").distinct(), ["query_id", "conversation_id"], "left_anti").select("query_id", "conversation_id")
