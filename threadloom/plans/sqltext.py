"""SQL fragments shared by the oracles."""

from __future__ import annotations

from ..functions.text import STOPWORDS

WORD = "[a-z][a-z0-9]{1,47}"
NUMBER = "[0-9]{2,24}"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Written out for the oracle; the driver tables hold no code, escapes or underscores.
_VISIBLE = [
    ("<(?i:https?)://[^>\\s]*>", " "), ("!?\\[([^\\]\\n]*)\\]\\((?:[^()\\n]|\\([^()\\n]*\\))*\\)", "\\1"),
    ("(?m)^[ \\t]*\\|?[ \\t]*:?-{3,}:?[ \\t]*(?:\\|[ \\t]*:?-{3,}:?[ \\t]*)+\\|?[ \\t]*\\n", ""),
    ("(?m)^[ \\t]{0,3}#{1,6}[ \\t]+", ""), ("(?m)^[ \\t]*(?:>[ \\t]?)+", ""), ("(?m)^[ \\t]*(?:[-+*]|[0-9]{1,9}[.)])[ \\t]+", ""),
    ("(?m)^[ \\t]*[|][ \\t]*", ""), ("[ \\t]*[|][ \\t]*", " "), ("[*]{2}([^*\\n]+)[*]{2}", "\\1"), ("[*]([^*\\s][^*\\n]*)[*]", "\\1"),
    ("(?i:https?)://\\S+", " "), ("[ \\t]{2,}", " "), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"),
]


def visible(col: str) -> str:
    """Visible text of a Markdown body without code."""
    text = f"coalesce({col}, '')"
    raw = text
    for pattern, replacement in _VISIBLE:
        new = replacement.replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, {quote(pattern)}, '{new}', 'g')"
    return (
        f"CASE WHEN regexp_matches({raw}, '[*_`#|\\[\\]>]|(?i:https?)://') THEN "
        f"coalesce(nullif(regexp_replace({text}, '\\A\\s+|\\s+\\z', '', 'g'), ''), {raw}) ELSE {raw} END"
    )


def flat(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '[\\s\\v\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'))"


def turn_text(expr: str) -> str:
    return flat(f"regexp_replace(coalesce({expr}, ''), '[*_`#\\[\\]()>~]+', '', 'g')")


SRC = f"""src AS (
  SELECT conversation_id, id AS source, role, lower({visible('body')}) AS t FROM msg
  UNION ALL SELECT id, 'title', 'title', lower(title) FROM hdr)"""


def occurrences(name: str, source: str, pattern: str, carry: str) -> str:
    """Token occurrences with their start: cut the text at a mark and add up the lengths."""
    return f"""{name} AS (
  SELECT {carry}, piece AS token, start::INT AS start FROM (
    SELECT *, sum(length(piece)) OVER (PARTITION BY {carry} ORDER BY i) - length(piece) AS start FROM (
      SELECT {carry}, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (
        SELECT {carry}, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM {source})))
  WHERE i % 2 = 0)"""


_CARRY = "conversation_id, source, role"
OCC = (
    occurrences("occ_word", "src", WORD, _CARRY) + ",\n" + occurrences("occ_num", "src", NUMBER, _CARRY)
    + ",\nocc AS (SELECT * FROM occ_word UNION ALL SELECT * FROM occ_num)"
)
TOK = f"""tok AS (
  SELECT DISTINCT conversation_id, source, role, token FROM (
    SELECT conversation_id, source, role, unnest(regexp_extract_all(t, '{WORD}')) AS token FROM src
    UNION ALL SELECT conversation_id, source, role, unnest(regexp_extract_all(t, '{NUMBER}')) FROM src))"""
STOP = "[" + ", ".join(quote(w) for w in STOPWORDS) + "]"


def whole(hay: str, needle: str) -> str:
    """Whole-word test for a plain literal."""
    return f"regexp_matches(' ' || {hay} || ' ', '[^a-z0-9]{needle}[^a-z0-9]')"


def values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({names}))"
