"""Match ranges inside one text, snippets around them, and merging of ranges.

Offsets are those of the normalised text; ``offsets`` leads back to the stored one. Patterns are built from quoted literals only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .let import let

RANGES = "ARRAY<STRUCT<start: INT, end: INT>>"
BEFORE, AFTER, LONGEST = 28, 120, 180


def quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_pattern(term: str) -> str:
    """The literal stands first, so that a text is searched for it and only its places are tested for their edges."""
    return f"{quoted(term)}(?<![a-z0-9]{quoted(term)})(?![a-z0-9])"


def term_pattern(term: str) -> str:
    """A highlighted term: words of [a-z0-9] count whole, anything else anywhere."""
    return word_pattern(term) if term.isascii() and term.isalnum() else quoted(term)


def glob_pattern(glob: str) -> str:
    """A whole word of literal pieces with any word characters in place of each star."""
    cjk = any(ord(c) > 0x2E7F for c in glob)
    kind = f"[{tx.CJK_RUN}]" if cjk else "[a-z0-9]"
    head, *rest = [quoted(p) if p else "" for p in glob.split("*")]
    return f"{kind}*".join([f"{head}(?<!{kind}{head})", *rest]) + f"(?!{kind})"


def find_ranges(norm: Column, pattern: str) -> Column:
    """All matches of a pattern, left to right."""

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        end = F.aggregate(
            F.sequence(F.lit(1), F.size(found)),
            F.struct(F.lit(0).alias("at"), F.array().cast(RANGES).alias("out")),
            lambda acc, i: let(
                F.struct((acc["at"] + F.length(F.element_at(gaps, i))).alias("from"), F.length(F.element_at(found, i)).alias("n")),
                lambda s: F.struct(
                    (s["from"] + s["n"]).alias("at"),
                    F.array_append(acc["out"], F.struct(s["from"].alias("start"), (s["from"] + s["n"]).alias("end"))).alias("out"),
                ),
            ),
        )
        return F.when(F.size(found) > 0, end["out"]).otherwise(F.array().cast(RANGES))

    pieces = F.struct(F.regexp_extract_all(norm, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(norm, pattern).alias("gaps"))
    return let(pieces, placed)


def merge_ranges(ranges: Column) -> Column:
    """Overlapping or touching ranges become one; the result is sorted."""

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        joins = F.coalesce(r["start"] <= F.try_element_at(acc, F.lit(-1))["end"], F.lit(False))
        return F.when(joins, F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, r))

    real = F.array_sort(F.filter(ranges, lambda r: r["end"] > r["start"]))
    return F.aggregate(real, F.array().cast(RANGES), add)


def term_ranges(norm: Column, query: str) -> Column:
    """Ranges of all terms of a plain query."""
    terms = [tx.fold(t) for t in query.split()]
    return merge_ranges(F.flatten(F.array(*[find_ranges(norm, term_pattern(t)) for t in terms])))


def clause_ranges(norm: Column, clause) -> Column:
    """Ranges of one clause: literal, whole words of a wildcard, or every token."""
    if clause.kind == "phrase" or (clause.kind == "words" and not clause.tokens):
        return find_ranges(norm, quoted(clause.folded))
    if clause.kind == "glob":
        return find_ranges(norm, glob_pattern(clause.folded))
    return token_ranges(norm, list(clause.tokens))


# Runs so long that the index cuts them; positions inside them come from the tokeniser itself.
CUT_RUN = "[a-z][a-z0-9]{48}|[0-9]{25}"


def token_pattern(token: str) -> str:
    """A token of the index inside runs that the index does not cut; the literal first, the dearest test of its edges last."""
    own = quoted(token)
    if token[0].isascii() and token[0].isalpha():
        return f"{own}(?<![a-z]{own})(?![a-z0-9])(?<=(?<![a-z0-9])[0-9]{{0,48}}{own})"
    if token.isascii():
        return f"{own}(?<![0-9]{own})(?![0-9])"
    # Two equal characters overlap with themselves, so a run of them is one range.
    return f"{quoted(token)}{quoted(token[1])}*" if len(token) == 2 and token[0] == token[1] else quoted(token)


def token_ranges(norm: Column, tokens: list[str]) -> Column:
    """Ranges of all places of ``tokens``; only text that holds one of them beside a cut run leaves the JVM."""
    plain = F.flatten(F.array(*[find_ranges(norm, token_pattern(t)) for t in tokens]))
    held = reduce(or_, [F.contains(norm, F.lit(t)) for t in tokens])
    wanted = F.array(*[F.lit(t) for t in tokens])
    spans = F.filter(tx.token_spans(F.when(held & norm.rlike(CUT_RUN), norm)), lambda s: F.array_contains(wanted, s["token"]))
    slow = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["token"])).alias("end")))
    none = F.array().cast(RANGES)
    return merge_ranges(F.when(~held, none).when(norm.rlike(CUT_RUN), slow).otherwise(plain))


def query_ranges(norm: Column, clauses: list, field: str = "body") -> Column:
    """Ranges of all clauses that ask for something; those on titles only count in titles."""
    parts = [clause_ranges(norm, c) for c in clauses if not c.exclude and (field == "title" or not c.title_only)]
    return merge_ranges(F.flatten(F.array(*parts))) if parts else F.array().cast(RANGES)


def snippet(flat: Column, ranges: Column, literal: bool = True) -> Column:
    """struct(text, ranges): a window around the first range, with an ellipsis at cut ends.

    With ``literal`` (clause queries) a single long match is shown whole.
    """
    first = ranges[0]

    def window(w: Column) -> Column:
        size, match = F.length(flat), w["b"] - w["a"]
        longest = F.greatest(F.lit(LONGEST), match) if literal else F.lit(LONGEST)
        start, end = F.greatest(F.lit(0), w["a"] - BEFORE), F.least(size, w["b"] + AFTER)
        lead = F.least(F.lit(BEFORE), F.floor((longest - match) * 0.25).cast("int"))
        tight = F.greatest(F.lit(0), w["a"] - lead)
        wide = end - start > longest
        start = F.when(wide & (match >= longest), w["a"]).when(wide, tight).otherwise(start)
        end = F.when(wide & (match >= longest), F.least(size, w["a"] + longest)).when(wide, F.greatest(F.least(size, tight + longest), F.least(size, w["b"]))).otherwise(end)
        return F.struct(start.alias("s"), end.alias("e"), size.alias("n"))

    def cut(c: Column) -> Column:
        mark = F.when(c["s"] > 0, 1).otherwise(0)
        shown = F.concat(
            F.when(c["s"] > 0, "…").otherwise(""), F.substring(flat, c["s"] + 1, c["e"] - c["s"]), F.when(c["e"] < c["n"], "…").otherwise("")
        )
        inside = F.filter(ranges, lambda r: (r["end"] > c["s"]) & (r["start"] < c["e"]))
        local = F.transform(
            inside,
            lambda r: F.struct(
                (F.greatest(r["start"], c["s"]) - c["s"] + mark).cast("int").alias("start"), (F.least(r["end"], c["e"]) - c["s"] + mark).cast("int").alias("end")
            ),
        )
        return F.struct(shown.alias("text"), local.alias("ranges"))

    made = let(let(F.struct(first["start"].alias("a"), first["end"].alias("b")), window), cut)
    return F.when(F.size(ranges) > 0, made)
