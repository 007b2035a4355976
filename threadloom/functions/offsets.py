"""From ranges in shown, normalised text back to the text as it is stored.

Two things move characters: dropping marks, and lower-casing with NFKC. Each leaves an array of runs, struct(at, src, n):
``n`` characters from ``at`` of its result stood at ``src`` of its input (-1: put in). A position goes back through the runs
of one step after the other, so no map of single characters is made, and only rows with a hit make runs at all. Offsets
count code points; a range of normalised text grows to whole grapheme clusters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import markup, ranges
from . import text as tx
from .let import let
from .text import fold

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RUN = "STRUCT<at: INT, src: INT, n: INT, stored: BOOLEAN>"
RUNS = f"ARRAY<{RUN}>"
CODES = "ARRAY<STRUCT<src: INT, text: STRING>>"
# What stands before the kept group of a step that keeps one.
LEAD = r"\A(!?\[|\*\*?|__?)"
FENCE_LEAD = r"(?m)\A([ \t]{0,3}(?:`{3,}|~{3,})[^\n`]*(?:\n|\z))"
CODE_LEAD = r"\A(`+|\\)"

def _run(at: Column, src: Column, n: Column, stored: bool = False) -> Column:
    return F.struct(at.cast("int").alias("at"), src.cast("int").alias("src"), n.cast("int").alias("n"), F.lit(stored).alias("stored"))


def _steps(steps: list[tuple[str, str]]) -> Column:
    return F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("put")) for p, r in steps))


def _step(text: Column, step: Column) -> Column:
    """struct(text, runs) after one replacement; no runs where nothing matched."""
    pattern, keeps = step["pattern"], step["put"] == "$1"
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.when(keeps, F.regexp_extract_all(text, pattern, F.lit(1))).otherwise(F.transform(found, lambda _: step["put"]))
    pieces = F.struct(found.alias("found"), kept.alias("kept"), F.split(text, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            gap, whole, own = F.length(F.element_at(p["gaps"], i)), F.element_at(p["found"], i), F.element_at(p["kept"], i)
            src = F.when(keeps, acc["src"] + gap + F.length(F.regexp_extract(whole, LEAD, 1))).otherwise(F.lit(-1))
            both = F.filter(F.array(_run(acc["at"], acc["src"], gap), _run(acc["at"] + gap, src, F.length(own))), lambda r: r["n"] > 0)
            return F.struct((acc["at"] + gap + F.length(own)).alias("at"), (acc["src"] + gap + F.length(whole)).alias("src"), F.concat(acc["runs"], both).alias("runs"))

        def end(acc: Column) -> Column:
            return F.concat(acc["runs"], F.filter(F.array(_run(acc["at"], acc["src"], F.length(F.element_at(p["gaps"], -1)))), lambda r: r["n"] > 0))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("src"), F.array().cast(RUNS).alias("runs"))
        done = F.aggregate(F.sequence(F.lit(1), F.size(p["found"])), start, add, end)
        return F.struct(F.regexp_replace(text, pattern, step["put"]).alias("text"), done.alias("runs"))

    return F.when(F.regexp_like(text, pattern), let(pieces, placed)).otherwise(F.struct(text.alias("text"), F.array().cast(RUNS).alias("runs")))


def _codes(raw: Column) -> Column:
    """Code and escaped signs in order: struct(whole, lead, text)."""

    def one(c: Column) -> Column:
        fence = F.regexp_extract(c, FENCE_LEAD, 1)
        inner = F.regexp_replace(F.regexp_replace(c, rf"(?m)\A{markup.FENCED}", "$2"), rf"\A(?:(`+)(?s:(.+?))\1|{markup.ESCAPED})\z", "$2$3")
        lead = F.when(fence != "", F.length(fence)).otherwise(F.length(F.regexp_extract(c, CODE_LEAD, 1)))
        return F.struct(F.length(c).alias("whole"), lead.alias("lead"), inner.alias("text"))

    return F.transform(F.regexp_extract_all(raw, F.lit(markup.CODE), F.lit(0)), one)


def _marked(text: Column) -> Column:
    """struct(text, codes, maps): code and escapes behind one mark each, with the runs that leaves."""

    def on(codes: Column) -> Column:
        gaps = F.split(text, markup.CODE, -1)

        def add(acc: Column, i: Column) -> Column:
            gap, code = F.length(F.element_at(gaps, i)), F.element_at(codes, i)
            both = F.filter(F.array(_run(acc["at"], acc["src"], gap), _run(acc["at"] + gap, F.lit(-1), F.lit(1))), lambda r: r["n"] > 0)
            place = F.struct((acc["src"] + gap + code["lead"]).cast("int").alias("src"), code["text"].alias("text"))
            return F.struct((acc["at"] + gap + 1).alias("at"), (acc["src"] + gap + code["whole"]).cast("int").alias("src"), F.concat(acc["runs"], both).alias("runs"), F.array_append(acc["codes"], place).alias("codes"))

        def end(acc: Column) -> Column:
            last = F.filter(F.array(_run(acc["at"], acc["src"], F.length(F.element_at(gaps, -1)))), lambda r: r["n"] > 0)
            return F.struct(F.regexp_replace(text, markup.CODE, markup.PLACE).alias("text"), acc["codes"].alias("codes"), F.array(F.concat(acc["runs"], last)).alias("maps"))

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("src"), F.array().cast(RUNS).alias("runs"), F.array().cast(CODES).alias("codes"))
        none = F.struct(text.alias("text"), F.array().cast(CODES).alias("codes"), F.array(F.array().cast(RUNS)).alias("maps"))
        return F.when(F.size(codes) > 0, F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, add, end)).otherwise(none)

    return let(_codes(text), on)


def _chain(state: Column, steps: list[tuple[str, str]]) -> Column:
    """``state`` struct(text, maps) after all ``steps``."""

    def on(acc: Column, step: Column) -> Column:
        return let(_step(acc["text"], step), lambda r: F.struct(r["text"].alias("text"), F.array_append(acc["maps"], r["runs"]).alias("maps")))

    start = F.struct(state["text"].alias("text"), state["maps"].cast(f"ARRAY<{RUNS}>").alias("maps"))
    return F.aggregate(_steps(steps), start, on)


def _put_back(state: Column, codes: Column) -> Column:
    gaps = F.split(state["text"], markup.PLACE, -1)
    text = F.array_join(F.zip_with(gaps, codes, lambda part, code: F.concat(F.coalesce(part, F.lit("")), F.coalesce(code["text"], F.lit("")))), "")

    def add(acc: Column, i: Column) -> Column:
        gap, code = F.length(F.element_at(gaps, i)), F.try_element_at(codes, i)
        own = F.coalesce(F.length(code["text"]), F.lit(0))
        both = F.filter(F.array(_run(acc["at"], acc["src"], gap), _run(acc["at"] + gap, F.coalesce(code["src"], F.lit(-1)), own, True)), lambda r: r["n"] > 0)
        return F.struct((acc["at"] + gap + own).alias("at"), (acc["src"] + gap + 1).alias("src"), F.concat(acc["runs"], both).alias("runs"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("src"), F.array().cast(RUNS).alias("runs"))
    runs = F.aggregate(F.sequence(F.lit(1), F.size(gaps)), start, add)["runs"]
    some = F.size(codes) > 0
    return F.struct(F.when(some, text).otherwise(state["text"]).alias("text"), F.array_append(state["maps"], F.when(some, runs).otherwise(F.array().cast(RUNS))).alias("maps"))


def _stripped(state: Column) -> Column:
    lead = F.length(F.regexp_extract(state["text"], r"\A(\s*)", 1))
    text = F.regexp_replace(state["text"], r"\A\s+|\s+\z", "")
    runs = F.when(lead > 0, F.array(_run(F.lit(0), lead, F.length(text)))).otherwise(F.array().cast(RUNS))
    return F.struct(text.alias("text"), F.array_append(state["maps"], runs).alias("maps"))


def with_trace(df: DataFrame, text: Column, name: str, where: Column | None = None, folded: bool = False) -> DataFrame:
    """``df`` with ``name`` struct(text, maps): the visible text as ``markup.visible_text`` makes it and the runs of each step.

    Where ``where`` does not hold, or the text has no marks, there are no runs but those that ``folded`` leaves. Each part is
    a projection of its own, so that none of them is copied into another.
    """
    raw, asked = F.coalesce(text, F.lit("")), F.lit(True) if where is None else where
    wanted = raw.rlike(markup.MARKS) & asked
    plain = F.struct(raw.alias("text"), F.array().cast(f"ARRAY<{RUNS}>").alias("maps"))
    if folded:
        plain = F.when(asked, _chain(plain, [markup.BLANKS])).otherwise(plain)
    out = df.withColumn(f"{name}_1", F.when(wanted, _marked(F.translate(raw, markup.PLACE, " "))))
    out = out.withColumn(f"{name}_2", F.when(wanted, _chain(F.col(f"{name}_1"), markup.VISIBLE_STEPS)))
    out = out.withColumn(f"{name}_3", F.when(wanted, _put_back(F.col(f"{name}_2"), F.col(f"{name}_1")["codes"])))
    out = out.withColumn(f"{name}_4", F.when(wanted, _stripped(_chain(F.col(f"{name}_3"), markup.LAST_STEPS))))
    shown = F.col(f"{name}_4")
    return out.withColumn(name, F.when(shown.isNull() | (shown["text"] == ""), plain).otherwise(shown)).drop(*(f"{name}_{i}" for i in range(1, 5)))


def stored_place(place: Column, maps: Column) -> Column:
    """Where the character at ``place`` of the visible text stands in the stored one; -1 if it was put in."""

    def back(acc: Column, runs: Column) -> Column:
        run = F.get(F.filter(runs, lambda r: (r["at"] <= acc["at"]) & (acc["at"] < r["at"] + r["n"])), F.lit(0))
        moved = F.when(run.isNull() | (run["src"] < 0), F.struct(F.lit(-1).alias("at"), F.lit(True).alias("done"))).otherwise(
            F.struct((run["src"] + acc["at"] - run["at"]).alias("at"), run["stored"].alias("done")))
        return F.when(acc["done"] | (F.size(runs) == 0), acc).otherwise(moved)

    return F.aggregate(F.reverse(maps), F.struct(place.cast("int").alias("at"), F.lit(False).alias("done")), back)["at"]


def _rows_of(ranges_: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's ranges, and all starts and ends; a null row has none."""
    sizes = pc.fill_null(pc.list_value_length(ranges_), 0).to_numpy(zero_copy_only=False)
    flat = ranges_.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


def _ranges_array(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(starts) for starts, _ in rows])])
    both = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in (0, 1)]
    values = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in both], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


@F.arrow_udf(SPANS)
def _outward(clusters: pa.Array, found: pa.Array) -> pa.Array:
    """Sorted ranges of normalised text as ranges of the shown text, by its grapheme clusters; those that overlap or come to touch become one."""
    bounds, starts, ends = _rows_of(found)
    out = []
    for row, own in enumerate(clusters):
        a, b = starts[bounds[row]:bounds[row + 1]], ends[bounds[row]:bounds[row + 1]]
        if own.is_valid and len(a):
            # Each distinct cluster is folded once.
            coded = own.values.dictionary_encode()
            words = coded.dictionary.to_pylist()
            at = coded.indices.to_numpy()
            norm, shown = (np.cumsum(np.array([len(f(w)) for w in words], np.int64)[at]) for f in (fold, str))
            a_norm, b_norm = a, b
            first, last = np.searchsorted(norm, a, "right"), np.searchsorted(norm, b, "left")
            a = np.where(first == 0, 0, shown[np.maximum(first - 1, 0)])
            b = shown[np.minimum(last, len(shown) - 1)]
            # Ranges that touched when they were found were left apart on purpose.
            touched = np.concatenate([[False], a_norm[1:] == b_norm[:-1]])
            real = b > a
            a, b, touched = a[real], b[real], touched[real]
            opens = np.concatenate([[True], (a[1:] > b[:-1]) | (touched[1:] & (a[1:] == b[:-1]))])[:len(a)]
            a, b = a[opens], b[np.concatenate([opens[1:], [True]])[:len(a)]]
        out.append((a, b))
    return _ranges_array(out)


def _back(places: np.ndarray, maps: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Where the characters at ``places`` of the visible text stand in the stored one; -1 if they were put in."""
    now, going = places.copy(), np.ones(len(places), bool)
    for at, src, n, stored in reversed(maps):
        run = np.maximum(np.searchsorted(at, now, "right") - 1, 0)
        inside = (at[run] <= now) & (now < at[run] + n[run]) & (src[run] >= 0)
        now = np.where(going, np.where(inside, src[run] + now - at[run], -1), now)
        going &= inside & ~stored[run]
    return now


@F.arrow_udf(SPANS)
def _stored(found: pa.Array, maps: pa.Array) -> pa.Array:
    """Ranges of the visible text as ranges of the stored one; characters put in do not count at either end."""
    bounds, starts, ends = _rows_of(found)
    out = []
    for row, own in enumerate(maps):
        a, b = starts[bounds[row]:bounds[row + 1]], ends[bounds[row]:bounds[row + 1]]
        steps = [] if not own.is_valid or not len(a) else [m.values for m in own.values if len(m.values)]
        if steps:
            runs = [tuple(m.field(i).to_numpy(zero_copy_only=False) for i in range(4)) for m in steps]
            left, right = _back(a, runs), _back(b - 1, runs) + 1
            # Most ranges begin and end with characters of the text; the others end with their first and last that are.
            for i in np.flatnonzero((left < 0) | (right <= 0)):
                inside = _back(np.arange(a[i], b[i]), runs)
                inside = inside[inside >= 0]
                left[i], right[i] = (inside.min(), inside.max() + 1) if len(inside) else (0, 0)
            real = right > left
            a, b = left[real], right[real]
        out.append((a, b))
    return _ranges_array(out)


def with_stored_ranges(df: DataFrame, text: Column, find: Callable[[Column], Column] | dict[str, Callable[[Column], Column]], name: str = "ranges", marked: bool = True, folded: bool = False) -> DataFrame:
    """``df`` with ``name``: the ranges that ``find`` gives for the normalised (with ``marked`` visible) text, as offsets of ``text``.

    With ``folded`` a run of blanks counts as one space in texts without marks, too.

    Several kinds of ranges (``find``: name -> function) share one text, its clusters and its runs. Each step back takes the
    sorted ranges of a text at once, so its cost grows with their number, not with its product by the text's length.
    """
    finds = find if isinstance(find, dict) else {name: find}
    names = {x: f"_{x}_of_{name}" for x in ("shown", "norm", "clusters", "trace")}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in finds]
    out = df.withColumn(names["shown"], markup.visible_text(text, folded) if marked else F.coalesce(text, F.lit("")))
    out = tx.with_normalised(out, names["norm"], F.col(names["shown"]))
    # Exploding an array of one keeps the ranges from being copied into what reads them, the next Arrow function above all.
    for key, one in finds.items():
        out = out.select("*", F.explode(F.array(one(F.col(names["norm"])))).alias(f"_found_of_{key}"))
    shown, found = F.col(names["shown"]), {key: F.col(f"_found_of_{key}") for key in finds}
    hit = reduce(or_, [F.size(c) > 0 for c in found.values()])
    clusters = F.when(hit & shown.rlike(tx.NFKC_TEST), F.regexp_extract_all(shown, F.lit(r"(\X)"), F.lit(1)))
    out = out.withColumn(names["clusters"], clusters)
    for key, made in found.items():
        out = out.withColumn(f"_outer_of_{key}", _outward(F.col(names["clusters"]), made))
    if marked:
        out = with_trace(out.drop(names["clusters"]), text, names["trace"], hit, folded)
    back = lambda c: _stored(c, F.col(names["trace"])["maps"]) if marked else c
    # Tests on the result end here too: pushed below, each would take the whole chain along.
    for key in finds:
        out = out.select("*", F.explode(F.array(back(F.col(f"_outer_of_{key}")).cast(ranges.RANGES))).alias(f"_made_of_{key}"))
    return out.select(*kept, *[F.col(f"_made_of_{key}").alias(key) for key in finds])
