"""Text columns: normalisation, tokens, whole-word tests and clipping.

Everything that has a JVM-side expression uses it. Two things have none and are
Arrow functions: NFKC, which only ever receives the rare rows that can change under
it, and token positions, which stay in the row of their text so that the index is
built without moving a single token between tasks.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------
STOPWORDS = (
    "the a an and or to of in is it for on you that this with be as at by from are was "
    "were not but if we they me my your have has had do does did can will just so than "
    "then too very about into over after also its our out up what when which who how "
    "的 了 在 是 我 你 他 她 它 这 那 和 与 或 也 就 都 而 及 为 以 把 被 让 向 对 从 跟 给 到 "
    "着 过 呢 吗 吧 啊"
).split()
CJK = r"一-鿿㐀-䶿぀-ヿ가-힯"
CJK_RUN = CJK + r"々"
WORD = "[a-z][a-z0-9]{1,47}"
NUMBER = "[0-9]{2,24}"
# White space as browsers see it. ASCII letters leave after two comparisons.
SPACE = r"[\s[\x{80}-\x{FFFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]]"
PREVIEW_CHARS = 360
# ----------------------------------------------------------------------------------

# Characters NFKC never changes, alone or next to each other. Text made only of these
# skips the Arrow function.
NFKC_STABLE = (
    r"¡§©«®°±¶·»¿"
    r"À-ıĴ-ľŁ-ňŊ-žЁА-яё"
    r"–—‘-‟†-•€、-〃々〈-】"
    r"ぁ-ゖァ-ヺー㐀-䶿一-鿿가-힣"
)
# The intersection lets ASCII leave after one comparison.
NFKC_TEST = rf"[\x{{80}}-\x{{10FFFF}}&&[^{NFKC_STABLE}]]"
CJK_TEST = rf"[\x{{80}}-\x{{FFFF}}&&[{CJK_RUN}]]"

_word = re.compile(f"{WORD}")
_number = re.compile(f"{NUMBER}")
_cjk = re.compile(f"[{CJK_RUN}]+")

SPAN = T.ArrayType(
    T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.IntegerType())])
)

# Texts that an Arrow function takes into Python at a time, and positions after which postings are handed on: an Arrow
# batch may hold ten thousand whole texts, whose tokens as Python objects are many times as large.
TEXTS_AT_ONCE = 64
PLACES_AT_ONCE = 100_000


def _in_parts(texts: pa.Array, build) -> pa.Array:
    """``build`` (list of values -> array) over a few texts at a time."""
    starts = range(0, max(1, len(texts)), TEXTS_AT_ONCE)
    return pa.concat_arrays([build(texts.slice(i, TEXTS_AT_ONCE).to_pylist()) for i in starts])


def fold(text: str) -> str:
    """Driver-side twin of :func:`normalise` for literals."""
    return unicodedata.normalize("NFKC", (text or "").lower())


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts
    return _in_parts(texts, lambda part: pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part], pa.string()))


def nfkc(col: Column | str) -> Column:
    """NFKC; only text holding a character that could change crosses into Python."""
    text = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_nfkc(F.when(text.rlike(NFKC_TEST), text)), text)


def normalise(col: Column | str) -> Column:
    return nfkc(F.lower(col))


def with_normalised(df: DataFrame, name: str, text: Column) -> DataFrame:
    """``df`` with ``name`` = normalised ``text``, computed in one place however often it is read."""
    return df.withColumn(name, F.lower(text)).withColumn(name, nfkc(name))


def _spans_of(text: str):
    for found in _word.finditer(text):
        yield found.group(), found.start()
    for found in _number.finditer(text):
        yield found.group(), found.start()
    for found in _cjk.finditer(text):
        run, base = found.group(), found.start()
        for i, char in enumerate(run):
            yield char, base + i
        for i in range(len(run) - 1):
            yield run[i : i + 2], base + i


def _nested(rows: list[list], build) -> pa.Array:
    """A list array from per-row lists, with the values laid out flat."""
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    flat = [item for row in rows for item in row]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), build(flat))


def _span_array(flat: list[tuple[str, int]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array([t for t, _ in flat], pa.string()), pa.array([s for _, s in flat], pa.int32())], ["token", "start"]
    )


def _grouped(text: str, wanted: frozenset[str] | None = None) -> list[tuple[str, list[int]]]:
    by_token: dict[str, list[int]] = {}
    for token, start in _spans_of(text):
        if wanted is None or token in wanted:
            by_token.setdefault(token, []).append(start)
    return list(by_token.items())


@F.arrow_udf(SPAN)
def token_spans(texts: pa.Array) -> pa.Array:
    """Every token of a text with its start in the normalised text."""
    return _in_parts(texts, lambda part: _nested([list(_spans_of(fold(t))) for t in part], _span_array))


def posting_rows(keys: list[str], tokens: list[str] | None = None):
    """For ``mapInArrow``: rows of (keys..., text) as rows of (token, keys..., positions).

    One posting per distinct token of a text with all its starts. The keys are
    repeated with Arrow's own ``take``, so Python only ever touches the text. Texts are taken one
    by one and postings handed on in parts, so memory does not grow with the batch.
    """
    wanted = None if tokens is None else frozenset(tokens)

    def made(batch, owners, names, places, offsets):
        repeat = pa.array(owners, pa.int32())
        columns = [pa.array(names, pa.string()), *[batch.column(k).take(repeat) for k in keys]]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["token", *keys, "positions"])

    def run(batches):
        for batch in batches:
            owners, names, places, offsets = [], [], [], [0]
            for row, text in enumerate(batch.column("text")):
                for token, starts in _grouped(fold(text.as_py()), wanted):
                    owners.append(row)
                    names.append(token)
                    places.extend(starts)
                    offsets.append(len(places))
                if len(places) >= PLACES_AT_ONCE:
                    yield made(batch, owners, names, places, offsets)
                    owners, names, places, offsets = [], [], [], [0]
            if owners:
                yield made(batch, owners, names, places, offsets)

    return run


def distinct_tokens(normalised: Column | str) -> Column:
    """Distinct tokens of already normalised text, as native expressions."""
    text = F.col(normalised) if isinstance(normalised, str) else normalised
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK_RUN}]+)"), F.lit(1))
    grams = F.flatten(
        F.transform(
            runs,
            lambda run: F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.length(run)),
                    lambda i: F.array_distinct(
                        F.array(F.substring(run, i, F.lit(1)), F.substring(run, i, F.lit(2)))
                    ),
                )
            ),
        )
    )
    latin = F.concat(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)),
    )
    return F.array_distinct(
        F.when(text.rlike(CJK_TEST), F.concat(latin, grams)).otherwise(latin)
    )


def drop_stopwords(tokens: Column) -> Column:
    """Query tokens: stopwords go unless nothing else is left."""
    kept = F.array_except(tokens, F.array(*[F.lit(w) for w in STOPWORDS]))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def literal_tokens(text: str) -> list[str]:
    """Query tokens of a driver-side literal."""
    every = list(dict.fromkeys(token for token, _ in _spans_of(fold(text))))
    stop = set(STOPWORDS)
    kept = [token for token in every if token not in stop]
    return kept or every


def literal_spans(text: str) -> list[tuple[str, int]]:
    kept = set(literal_tokens(text))
    return [(token, start) for token, start in _spans_of(fold(text)) if token in kept]


def contains_whole(hay: Column, needle: Column) -> Column:
    """``needle`` inside ``hay`` (both normalised): CJK anywhere, otherwise no ``[a-z0-9]`` next to it.

    The pattern is only ever the quoted needle, so text never acts as a regular expression.
    """
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    edged = F.regexp_like(hay, F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))
    found = F.contains(hay, needle) & (F.length(needle) > 0)
    return F.coalesce(found & (needle.rlike(f"[{CJK}]") | edged), F.lit(False))


def flatten_spaces(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit("")), f"{SPACE}+", " "))


def clip(col: Column, limit: int = PREVIEW_CHARS) -> Column:
    """At most ``limit`` characters, then an ellipsis in place of the rest."""
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.rtrim(F.substring(col, 1, limit)), F.lit("…"))
    )


def preview_text(col: Column | str) -> Column:
    return clip(flatten_spaces(col))


def preview_source(col: Column | str) -> Column:
    """Stored excerpt: spaces folded, line breaks kept, at most one blank line in a row."""
    text = F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[\t\f\x0b 　 ]+", " ")
    text = F.regexp_replace(text, " *\n *", "\n")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"^[\n ]+|[\n ]+\z", "")
    clipped = F.regexp_replace(F.substring(text, 1, PREVIEW_CHARS), r"[\n ]+\z", "")
    return F.when(F.length(text) <= PREVIEW_CHARS, text).otherwise(F.concat(clipped, F.lit("…")))


def words_of(col: Column) -> Column:
    """Words a wildcard is tested against: ``[a-z0-9]+`` and CJK runs."""
    return F.regexp_extract_all(col, F.lit(f"([a-z0-9]+|[{CJK_RUN}]+)"), F.lit(1))


def like_pattern(glob: Column) -> Column:
    """``*`` becomes ``%``; the pattern characters of LIKE are escaped first."""
    escaped = F.regexp_replace(glob, r"([\\%_])", r"\\$1")
    return F.replace(escaped, F.lit("*"), F.lit("%"))


@F.udtf(returnType="token: string, start: int")
class TokensTable:
    """``tokens(text)`` for SQL: one row per token, usable with LATERAL."""

    def eval(self, text: str):
        yield from _spans_of(fold(text))


def register_functions(spark: SparkSession) -> None:
    """Make ``tokens(text)`` and ``nfkc(text)`` callable from SQL."""
    spark.udtf.register("tokens", TokensTable)
    spark.udf.register("nfkc", _nfkc)
