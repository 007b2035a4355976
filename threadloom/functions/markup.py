"""Visible text of Markdown bodies as a chain of native replacements.

Code stands as it was written: fenced blocks, code spans and escaped marks are taken out behind a
placeholder, the rest is cleaned, and they are put back. Accepted differences from a full parser:
nested lists lose their depth, and a bar between spaces is always treated as a table cell edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

MARKS = r"[*_`#|\[\]>]|[hH][tT][tT][pP][sS]?://"
URL = r"[hH][tT][tT][pP][sS]?://[^\s\uE000]+"
PLACE = "\ue000"
FENCED = r"^[ \t]{0,3}(`{3,}|~{3,})[^\n`]*(?:\n|\z)((?s:.*?))(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\z)"
SPAN = r"(?<!`)(`+)(?!`)((?s:.+?))(?<!`)\3(?!`)"
ESCAPED = r"\\([!-/:-@\[-`{-~])"
CODE = rf"(?m){FENCED}|{SPAN}|{ESCAPED}"
WORDY = r"\p{L}\p{N}_"

# (pattern, replacement) in order; a replacement is the first group or nothing.
VISIBLE_STEPS = [
    (r"<[hH][tT][tT][pP][sS]?://[^>\s]*>", " "),
    (r"!?\[([^\]\n]*)\]\((?:[^()\n\uE000]|\([^()\n\uE000]*\))*\)", "$1"),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\n", ""),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*(?:>[ \t]?)+", ""),
    (r"(?m)^[ \t]*(?:[-+*]|[0-9]{1,9}[.)])[ \t]+", ""),
    (r"(?m)^[ \t]*\|[ \t]*", ""),
    (r"[ \t]*\|[ \t]*", " "),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"\*([^*\s][^*\n]*)\*", "$1"),
    (rf"(?<![{WORDY}])__(?=\S)([^\n]*?[^\s_])__(?![{WORDY}])", "$1"),
    (rf"(?<![{WORDY}])_(?=[^\s_])([^\n_]*(?:_+[{WORDY}][^\n_]*)*?)(?<=\S)_(?![{WORDY}])", "$1"),
]
BLANKS = (r"[ \t]{2,}", " ")
LAST_STEPS = [(URL, " "), BLANKS, (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]


def visible_text(body: Column | str, folded: bool = False) -> Column:
    """Text the index and every literal match should see; plain prose is left as it is, or with ``folded`` loses only its runs of blanks."""
    raw = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    plain = F.regexp_replace(raw, *BLANKS) if folded else raw
    text = F.regexp_replace(F.translate(raw, PLACE, " "), CODE, PLACE)
    for pattern, replacement in VISIBLE_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    codes = F.transform(F.regexp_extract_all(raw, F.lit(CODE), F.lit(0)), lambda c: F.regexp_replace(F.regexp_replace(c, rf"(?m)\A{FENCED}", "$2"), rf"\A(?:(`+)(?s:(.+?))\1|{ESCAPED})\z", "$2$3"))
    text = F.array_join(F.zip_with(F.split(text, PLACE), codes, lambda part, code: F.concat(F.coalesce(part, F.lit("")), F.coalesce(code, F.lit("")))), "")
    for pattern, replacement in LAST_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    shown = F.transform(F.array(F.regexp_replace(text, r"\A\s+|\s+\z", "")), lambda t: F.when(t == "", plain).otherwise(t))[0]
    return F.when(raw.rlike(MARKS), shown).otherwise(plain)


FLAT_MARKS = r"[`|#]|---|\*\*\*|___"
FLAT_STEPS = [
    (r"`{3,}", " "),
    (r"(^|\s)\|?(?:\s*:?-{3,}:?\s*\|)+(?:\s*:?-{3,}:?\s*\|?)?", "$1"),
    (r"(^|\s)\|", "$1"),
    (r"(^|\s)#{1,6}\s", "$1"),
    (r"(^|\s)(?:-{3,}|\*{3,}|_{3,})", "$1"),
]


def idle_text(excerpt: Column | str) -> Column:
    """Excerpt as a list row shows it: marks gone, spaces folded to one."""
    source = F.coalesce(F.col(excerpt) if isinstance(excerpt, str) else excerpt, F.lit(""))
    flat = tx.flatten_spaces(visible_text(source))
    stripped = flat
    for pattern, replacement in FLAT_STEPS:
        stripped = F.regexp_replace(stripped, pattern, replacement)
    # Most texts hold no mark that a step could take away.
    return F.when(F.contains(source, F.lit("\n")) | ~flat.rlike(FLAT_MARKS), flat).otherwise(tx.flatten_spaces(stripped))


def turn_text(body: Column | str) -> Column:
    """Wording of a turn: marks dropped, spaces folded, links kept."""
    source = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    return tx.flatten_spaces(F.regexp_replace(source, r"[*_`#\[\]()>~]+", ""))


def activity_key(body: Column | str, read: int | None = None, keep: int | None = None) -> Column:
    """Comparable wording of a turn: links and marks out. ``read`` and ``keep`` cut what goes in and what comes out."""
    head = tx.flatten_spaces(body)
    head = head if read is None else F.substring(head, 1, read)
    bare = F.regexp_replace(F.regexp_replace(head, URL, " "), r"[*_`#\[\]()>~]+", "")
    bare = tx.flatten_spaces(bare)
    return bare if keep is None else F.substring(bare, 1, keep)
