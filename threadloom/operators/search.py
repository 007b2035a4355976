"""Search: AND queries, phrases, wildcards, exclusions, title clauses and ranking.

A set of saved queries is a short driver-side list, so it travels as literals inside the
plan: title and text tests are one map-only pass, and only posting hits are joined (to a
local relation the optimiser broadcasts after checking its size). Query sets that are
tables themselves use :func:`table_tokens` and ordinary joins.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx
from ..session import cut_lineage
from . import index

# --- fixed values -----------------------------------------------------------------
TITLE, PHRASE, USER, ASSISTANT, HIT_CAP = 10000, 1000, 100, 10, 8
# ----------------------------------------------------------------------------------

_TERM = re.compile(r'(?P<no>-?)(?P<title>(?i:title:)?)(?:"(?P<phrase>[^"]*)"(?=\s|$)|(?P<bare>[^\s"-][^\s"]*))(?:\s+|$)')


@dataclass
class Clause:
    query_id: int
    clause_no: int
    kind: str
    value: str
    title_only: bool = False
    exclude: bool = False
    tokens: list[str] = field(default_factory=list)

    @property
    def folded(self) -> str:
        return tx.fold(self.value)


def clauses_of(query_id: int, raw: str, max_chars: int | None = None, max_clauses: int | None = None, max_glob: int | None = None) -> list[Clause]:
    """Clauses of one query string; an empty list means it is a plain query.

    A caller may turn longer strings, more clauses or longer wildcards into plain queries.
    """
    text = (raw or "").strip()
    over = lambda n, limit: limit is not None and n > limit
    if not text or over(len(text), max_chars):
        return []
    special, ordinary, at = [], [], 0
    marked = False
    while at < len(text):
        term = _TERM.match(text, at)
        if not term:
            return []
        at = term.end()
        phrase, bare = term["phrase"], term["bare"]
        value = bare if phrase is None else phrase
        glob = phrase is None and "*" in value
        if not value.strip() or (glob and (not value.strip("*") or over(len(value), max_glob))):
            return []
        kind = "phrase" if phrase is not None else "glob" if glob else "words"
        plain_word = kind == "words" and not term["no"] and not term["title"]
        marked = marked or not plain_word
        if plain_word:
            ordinary.append(value)
        else:
            special.append((kind, value, bool(term["title"]), bool(term["no"])))
        if over(len(special) + len(ordinary), max_clauses):
            return []
    if ordinary:
        special.insert(0, ("words", " ".join(ordinary), False, False))
    if not marked or all(no for *_, no in special):
        return []
    return [
        Clause(query_id, i, kind, value, title, no, tx.literal_tokens(value))
        for i, (kind, value, title, no) in enumerate(special)
    ]


class Queries:
    """Saved queries: ``{query_id: text}``, split into plain and clause queries."""

    def __init__(self, saved: dict[int, str]):
        self.plain: list[Clause] = []
        self.clauses: list[Clause] = []
        for query_id, raw in saved.items():
            found = clauses_of(query_id, raw)
            if found:
                self.clauses += found
            else:
                value = (raw or "").strip()
                self.plain.append(Clause(query_id, 0, "words", value, tokens=tx.literal_tokens(value)))


def token_frame(spark: SparkSession, clauses: list[Clause]) -> DataFrame:
    rows = [(c.query_id, c.clause_no, t, len(c.tokens)) for c in clauses for t in c.tokens]
    return spark.createDataFrame(rows, "query_id INT, clause_no INT, token STRING, n_tokens INT")


def span_frame(spark: SparkSession, clauses: list[Clause]) -> DataFrame:
    rows = []
    for c in clauses:
        spans = tx.literal_spans(c.value)
        rows += [(c.query_id, c.clause_no, t, s, len(spans)) for t, s in spans]
    return spark.createDataFrame(rows, "query_id INT, clause_no INT, token STRING, start INT, n_spans INT")


def table_tokens(queries: DataFrame) -> DataFrame:
    """Query tokens of a table of saved plain queries (query_id, raw)."""
    tokens = tx.drop_stopwords(tx.distinct_tokens("norm"))
    held = queries.select("query_id", tx.normalise("raw").alias("norm")).select("query_id", tokens.alias("t"))
    return held.select("query_id", F.lit(0).alias("clause_no"), F.explode("t").alias("token"), F.size("t").alias("n_tokens"))


def table_spans(queries: DataFrame) -> DataFrame:
    """Surviving spans of a table of saved plain queries (query_id, raw)."""
    held = queries.select("query_id", tx.token_spans("raw").alias("s"))
    names = F.array_distinct(F.col("s.token"))
    held = held.select("query_id", "s", tx.drop_stopwords(names).alias("kept"))
    spans = F.filter("s", lambda s: F.array_contains(F.col("kept"), s["token"]))
    held = held.select("query_id", spans.alias("s"))
    return held.select("query_id", F.lit(0).alias("clause_no"), F.inline("s"), F.size("s").alias("n_spans")).select(
        "query_id", "clause_no", "token", "start", "n_spans"
    )


# --- matching -----------------------------------------------------------------------


def and_matches(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, clause_no, conversation_id) whose title and turns together hold every token."""
    hits = postings.select("token", "conversation_id").join(tokens, "token")
    return (
        hits.groupBy("query_id", "clause_no", "conversation_id")
        .agg(F.count_distinct("token").alias("found"), F.max("n_tokens").alias("n_tokens"))
        .where(F.col("found") == F.col("n_tokens"))
        .select("query_id", "clause_no", "conversation_id")
    )


def _literal_matches(rows: DataFrame, keep: list[str], tests: list[tuple[Clause, Column]]) -> DataFrame:
    """One row per clause a row passes; every clause is a literal inside one projection."""
    if not tests:
        tests = [(Clause(0, 0, "words", ""), F.lit(False))]
    flags = [
        F.when(test, F.struct(F.lit(c.query_id).alias("query_id"), F.lit(c.clause_no).alias("clause_no")))
        for c, test in tests
    ]
    return rows.select(*keep, F.inline(F.array_compact(F.array(*flags))))


def text_test(norm: Column, clause: Clause) -> Column:
    """Whether one normalised text satisfies one clause on its own."""
    needle = F.lit(clause.folded)
    if clause.kind == "phrase":
        return F.contains(norm, needle)
    if clause.kind == "glob":
        pieces = [p for p in clause.folded.split("*") if p]
        cheap = F.contains(norm, F.lit(max(pieces, key=len)))
        pattern = re.sub(r"([\\%_])", r"\\\1", clause.folded).replace("*", "%")
        return cheap & F.exists(tx.words_of(norm), lambda w: w.like(pattern))
    whole = tx.contains_whole(norm, needle)
    if not clause.tokens:
        return whole
    wanted = F.array(*[F.lit(t) for t in clause.tokens])
    return whole | (F.size(F.array_except(wanted, tx.distinct_tokens(norm))) == 0)


def title_matches(headers: DataFrame, clauses: list[Clause]) -> DataFrame:
    """(conversation_id, query_id, clause_no) for clauses a title satisfies on its own."""
    rows = headers.select(F.col("id").alias("conversation_id"), tx.normalise("title").alias("norm"))
    return _literal_matches(rows, ["conversation_id"], [(c, text_test(F.col("norm"), c)) for c in clauses])


def whole_title_matches(headers: DataFrame, clauses: list[Clause]) -> DataFrame:
    """Titles that hold the whole query: CJK as a substring, otherwise as whole words."""
    rows = headers.select(F.col("id").alias("conversation_id"), tx.normalise("title").alias("norm"))
    tests = [(c, tx.contains_whole(F.col("norm"), F.lit(c.folded))) for c in clauses]
    return _literal_matches(rows, ["conversation_id"], tests)


def anchor_of(clause: Clause) -> tuple[str, bool] | None:
    """The longest index token every match must hold: (token, whether it is only a prefix).

    A phrase matches whole words, so any of its tokens stands in the turn; of a wildcard only
    the token that opens the word is sure.
    """
    spans = tx.literal_spans(clause.folded if clause.kind == "phrase" else clause.folded.split("*")[0])
    sure = [token for token, start in spans if clause.kind == "phrase" or start == 0]
    token = max(sure, key=len, default=None)
    return None if token is None else (token, not re.fullmatch(f"[{tx.CJK_RUN}]+", token))


def candidates(postings: DataFrame, clauses: list[Clause]) -> DataFrame | None:
    """Sources that can match any of the clauses, or None when one clause has no anchor."""
    anchors = [anchor_of(c) for c in clauses]
    if not anchors or any(a is None for a in anchors):
        return None
    token = F.col("token")
    any_of = F.lit(False)
    for text, prefix in anchors:
        any_of = any_of | (token.startswith(text) if prefix else token == text)
    low, high = min(a for a, _ in anchors), max(a + "￿" for a, _ in anchors)
    return postings.where((token >= low) & (token < high) & any_of).select(F.col("source").alias("id")).distinct()


def body_matches(messages: DataFrame, clauses: list[Clause], postings: DataFrame | None = None) -> DataFrame:
    """Turns whose visible text satisfies a phrase, wildcard or token-free clause.

    One scan serves every clause. With a stored index, turns that cannot match are left
    out by a semi join first; the rows are the same either way.
    """
    narrowed = candidates(postings, clauses) if postings is not None else None
    if narrowed is not None:
        messages = messages.join(narrowed, "id", "left_semi")
    rows = messages.select("conversation_id", F.col("id").alias("source"), "role", "body")
    rows = tx.with_normalised(rows, "norm", markup.visible_text("body"))
    tests = [(c, text_test(F.col("norm"), c)) for c in clauses]
    return _literal_matches(rows, ["conversation_id", "source", "role"], tests)


def scope(headers: DataFrame, platform: str = "", archive: str = "all") -> DataFrame:
    """Platform and archive scope; an unset archive flag counts as active."""
    if platform:
        headers = headers.where(F.col("platform") == platform)
    if archive == "active":
        return headers.where(~F.col("archived").eqNullSafe(F.lit(True)))
    if archive == "archived":
        return headers.where(F.col("archived").eqNullSafe(F.lit(True)))
    return headers


# --- ranking ------------------------------------------------------------------------


def rounded(score: Column) -> Column:
    return F.floor(score * 100 + 0.5) / 100


def source_hits(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct query tokens per turn, with the weight of its role."""
    body = postings.where(F.col("source") != "title").select("token", "conversation_id", "source", "role")
    return (
        body.join(tokens, "token")
        .groupBy("query_id", "clause_no", "conversation_id", "source")
        .agg(
            F.count_distinct("token").alias("found"),
            F.max("n_tokens").alias("n_tokens"),
            F.when(F.bool_or(F.col("role") == "user"), USER).otherwise(ASSISTANT).alias("weight"),
        )
    )


def top_sources(hits: DataFrame, value: Column, keys: list[str], k: int = HIT_CAP) -> DataFrame:
    """The ``k`` best turns per key; the limit is applied before rows are moved."""
    best = Window.partitionBy(*keys).orderBy(F.desc("value"), "source")
    return hits.withColumn("value", value).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def aligned_phrases(postings: DataFrame, spans: DataFrame) -> DataFrame:
    """Sources in which all query spans stand at the same distance from each other.

    The places of a turn stay in arrays; only turns that hold every span compare them.
    """
    keys = ["query_id", "clause_no", "conversation_id", "source"]
    placed = (
        postings.where(F.col("source") != "title")
        .join(spans, "token")
        .select(*keys, "n_spans", "start", "positions")
    )
    shifted = F.transform("positions", lambda p: p - F.col("start"))
    turns = placed.groupBy(*keys).agg(F.max("n_spans").alias("n_spans"), F.collect_list(shifted).alias("placed"))
    common = F.aggregate(
        F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))), F.col("placed")[0], lambda a, b: F.array_intersect(a, b)
    )
    return turns.where((F.size("placed") == F.col("n_spans")) & (F.size(common) > 0)).select(*keys)


def title_covers(norm: Column, raw: str) -> Column:
    """Every term of the query stands in the title; stopword terms only count alone."""
    terms = [tx.fold(t) for t in raw.split()]
    stop = set(tx.STOPWORDS)
    need = [t for t in terms if t not in stop] or terms
    covered = tx.contains_whole(norm, F.lit(tx.fold(raw)))
    every = F.lit(bool(need))
    for term in need:
        every = every & tx.contains_whole(norm, F.lit(term))
    return covered | every


def plain_frame(spark: SparkSession, clauses: list[Clause]) -> DataFrame:
    """One row per query token: its bit in the word ``word`` and its starts in the query."""
    rows = []
    for c in clauses:
        spans = tx.literal_spans(c.value)
        for i, token in enumerate(c.tokens):
            starts = [s for t, s in spans if t == token]
            rows.append((c.query_id, token, i // 62, 1 << (i % 62), starts, len(c.tokens), len(spans)))
    return spark.createDataFrame(
        rows, "query_id INT, token STRING, word INT, bit BIGINT, starts ARRAY<INT>, n_tokens INT, n_spans INT"
    )


def search_plain(headers: DataFrame, postings: DataFrame, clauses: list[Clause]) -> DataFrame:
    """Plain queries: AND over the index or the whole query in the title, with relevance.

    Hits are folded per turn, then per (conversation, value), then per conversation, each
    step pre-aggregated before it moves rows, so one conversation holding most of the hits
    never becomes one task. Title verdicts come from one pass over the headers and enter
    the last step as extra rows instead of through joins.
    """
    spark = headers.sparkSession
    words = max(1, max(-(-len(c.tokens) // 62) for c in clauses))
    found = index.lookup(postings, sorted({t for c in clauses for t in c.tokens}))
    hits = found.join(plain_frame(spark, clauses), "token")
    keys = ["query_id", "conversation_id"]
    masks = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(f"m{w}") for w in range(words)]
    joined = [F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)]
    shifted = F.transform("starts", lambda s: F.transform("positions", lambda p: p - s))
    per_turn = hits.groupBy(*keys, "source").agg(
        *masks,
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_spans").alias("n_spans"),
        F.count("*").alias("found"),
        F.when(F.bool_or(F.col("role") == "user"), USER).otherwise(ASSISTANT).alias("weight"),
        F.flatten(F.collect_list(shifted)).alias("placed"),
    )
    in_body = F.col("source") != "title"
    common = F.aggregate(
        F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))), F.col("placed")[0], lambda a, b: F.array_intersect(a, b)
    )
    per_turn = per_turn.select(
        *keys, *[f"m{w}" for w in range(words)], "n_tokens",
        (in_body & (F.size("placed") == F.col("n_spans")) & (F.size(common) > 0)).alias("phrase"),
        F.when(in_body, F.col("weight") * F.col("found")).alias("value"),
    )
    per_value = per_turn.groupBy(*keys, "value").agg(
        *joined, F.max("n_tokens").alias("n_tokens"), F.bool_or("phrase").alias("phrase"), F.count("*").alias("n"),
    )
    norm = F.col("norm")
    rows = headers.select(F.col("id").alias("conversation_id"), tx.normalise("title").alias("norm"))
    verdicts = rows.select(
        "conversation_id",
        F.inline(F.array(*[
            F.struct(
                F.lit(c.query_id).alias("query_id"),
                title_covers(norm, c.value).alias("covers"),
                tx.contains_whole(norm, F.lit(c.folded)).alias("whole"),
            )
            for c in clauses
        ])),
    ).where("covers OR whole")
    no = F.lit(False)
    body_rows = per_value.withColumn("covers", no).withColumn("whole", no)
    title_rows = verdicts.select(
        *keys, F.lit(None).cast("bigint").alias("value"), *[F.lit(0).cast("bigint").alias(f"m{w}") for w in range(words)],
        F.lit(0).alias("n_tokens"), F.col("whole").alias("phrase"), F.lit(0).cast("bigint").alias("n"), "covers", "whole",
    )
    folded = body_rows.unionByName(title_rows).groupBy(*keys).agg(
        *joined,
        F.max("n_tokens").alias("n_tokens"),
        F.bool_or("phrase").alias("phrase"),
        F.bool_or("covers").alias("covers"),
        F.bool_or("whole").alias("whole"),
        F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n"))).alias("values"),
    )
    held = sum((F.bit_count(f"m{w}") for w in range(words)), F.lit(0))
    matched = (held == F.col("n_tokens")) & (F.col("n_tokens") > 0)
    best = F.aggregate(
        F.sort_array("values", asc=False),
        F.struct(F.lit(HIT_CAP).cast("bigint").alias("room"), F.lit(0).cast("bigint").alias("total")),
        lambda a, v: F.struct(
            (a["room"] - F.least(a["room"], v["n"])).alias("room"),
            (a["total"] + v["value"] * F.least(a["room"], v["n"])).alias("total"),
        ),
        lambda a: a["total"],
    )
    score = (
        F.when(F.col("covers"), TITLE).otherwise(0)
        + F.when(F.col("phrase"), PHRASE).otherwise(0)
        + best / F.greatest(F.col("n_tokens"), F.lit(1))
    )
    return folded.where(matched | F.col("whole")).select(*keys, rounded(score).alias("relevance"))


def clause_matches(headers: DataFrame, messages: DataFrame, postings: DataFrame, clauses: list[Clause], use_index: bool = False, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(titled, bodied): titles each clause satisfies, and turns with their share of it.

    ``found``: postings of the clauses' tokens, where they were looked up before.
    """
    spark = headers.sparkSession
    titled = title_matches(headers, clauses).withColumn("titled", F.lit(True))
    wordy = [c for c in clauses if c.kind == "words" and c.tokens and not c.title_only]
    literal = [c for c in clauses if not c.title_only and not (c.kind == "words" and c.tokens)]
    empty = spark.createDataFrame([], "query_id INT, clause_no INT, conversation_id STRING, source STRING, weight INT, share DOUBLE")
    shares = exact = empty
    if wordy:
        found = index.lookup(postings, sorted({t for c in wordy for t in c.tokens})) if found is None else found
        shares = source_hits(found, token_frame(spark, wordy)).select(
            "query_id", "clause_no", "conversation_id", "source", "weight",
            (F.col("found") / F.col("n_tokens")).alias("share"),
        )
    if literal:  # only then are bodies read
        exact = body_matches(messages, literal, postings if use_index else None).select(
            "query_id", "clause_no", "conversation_id", "source",
            F.when(F.col("role") == "user", USER).otherwise(ASSISTANT).alias("weight"),
            F.lit(1.0).alias("share"),
        )
    return titled, shares.unionByName(exact)


def search_clauses(headers: DataFrame, messages: DataFrame, postings: DataFrame, clauses: list[Clause], use_index: bool = False) -> DataFrame:
    """Clause queries: every positive clause must match somewhere, no excluded one may.

    Titles, postings of the asked tokens and matching turns are read several times, so they are written first; all are
    short rows, and the texts behind them are read once.
    """
    spark = headers.sparkSession
    headers = cut_lineage(headers.select("id", "title"))
    keys = ["query_id", "conversation_id"]
    wordy = [c for c in clauses if c.kind == "words" and c.tokens and not c.title_only]
    literal = {(c.query_id, c.clause_no) for c in clauses if not c.title_only} - {(c.query_id, c.clause_no) for c in wordy}
    facts = spark.createDataFrame(
        [
            (c.query_id, c.clause_no, c.kind, c.exclude, (c.query_id, c.clause_no) in literal,
             sum(1 for o in clauses if o.query_id == c.query_id and not o.exclude))
            for c in clauses
        ],
        "query_id INT, clause_no INT, kind STRING, exclude BOOLEAN, literal BOOLEAN, positives INT",
    )
    found = cut_lineage(index.lookup(postings, sorted({t for c in wordy for t in c.tokens}))) if wordy else None
    titled, bodied = clause_matches(headers, messages, postings, clauses, use_index, found)
    bodied = cut_lineage(bodied).join(facts, ["query_id", "clause_no"])
    names = ["query_id", "clause_no", "conversation_id"]
    none = F.lit(False)
    flagged = lambda rows, name: rows.select(*names, *((F.lit(True) if n == name else none).alias(n) for n in ("in_title", "matched", "worded")))
    seen = flagged(titled, "in_title")
    if literal:
        seen = seen.unionByName(flagged(bodied.where("literal"), "matched"))
    if wordy:
        whole = whole_title_matches(headers, wordy).select(*names).unionByName(aligned_phrases(found, span_frame(spark, wordy)).select(*names))
        seen = seen.unionByName(flagged(and_matches(found, token_frame(spark, wordy)), "matched")).unionByName(flagged(whole, "worded"))
    seen = (
        seen.groupBy(*names)
        .agg(F.bool_or("in_title").alias("in_title"), F.bool_or(F.col("matched") | F.col("in_title")).alias("matched"), F.bool_or("worded").alias("worded"))
        .join(facts, ["query_id", "clause_no"])
    )
    positive = ~F.col("exclude")
    accepted = (
        seen.groupBy(*keys)
        .agg(
            F.count_if(positive & F.col("matched")).alias("n_matched"),
            F.count_if(positive & F.col("in_title")).alias("n_titled"),
            F.bool_or(positive & ((F.col("kind") == "phrase") & F.col("matched") | F.col("worded"))).alias("phrase"),
            F.bool_or(F.col("exclude") & F.col("matched")).alias("barred"),
            F.max("positives").alias("positives"),
        )
        .where((F.col("n_matched") == F.col("positives")) & ~F.col("barred"))
    )
    per_source = (
        bodied.where(positive)
        .groupBy(*keys, "source")
        .agg(F.sum(F.col("share") / F.col("positives")).alias("share"), F.max("weight").alias("weight"))
    )
    hits = top_sources(per_source, F.col("weight") * F.least(F.lit(1.0), F.col("share")), keys)
    bodies = hits.groupBy(*keys).agg(F.sum("value").alias("body"))
    score = (
        F.when(F.col("n_titled") == F.col("positives"), TITLE).otherwise(0)
        + F.when(F.col("phrase"), PHRASE).otherwise(0)
        + F.coalesce("body", F.lit(0.0))
    )
    return accepted.join(bodies, keys, "left").select(*keys, rounded(score).alias("relevance"))


def search(headers: DataFrame, messages: DataFrame, postings: DataFrame, saved: dict[int, str], platform: str = "", archive: str = "all", use_index: bool = False) -> DataFrame:
    """Every saved query at once: (query_id, header columns, relevance).

    An empty query lists all headers in scope with relevance 0; no queries give no rows.
    """
    queries = Queries(saved)
    inside = scope(headers, platform, archive)
    blank = [c.query_id for c in queries.plain if not c.value]
    plain = [c for c in queries.plain if c.value]
    parts = []
    if blank or not saved:
        every = F.array(*[F.lit(q) for q in blank]).cast("array<int>")
        parts.append(inside.select(F.explode(every).alias("query_id"), F.col("id").alias("conversation_id"), F.lit(0.0).alias("relevance")))
    if plain:
        parts.append(search_plain(inside, postings, plain))
    if queries.clauses:
        parts.append(search_clauses(inside, messages, postings, queries.clauses, use_index))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.join(inside.withColumnRenamed("id", "conversation_id"), "conversation_id")
