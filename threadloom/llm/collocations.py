"""Collocations of each language by best-first branch and bound over growing phrases.

A phrase of 2 to ``LONGEST`` words that occurs ``LEAST`` times or more inside pieces of text is a candidate. Its score is
``floor(2000000 * a / (l + r))`` at its lowest cut, for a occurrences of it, l of the part before the cut and r of the rest.

*Bound.* Whatever is grown from a prefix p with first word u occurs f(p) times at most, and the rest after u occurs no less
often than the phrase. So no phrase grown from p scores more than ``floor(2000000 * f(p) / (f(u) + f(p)))``.

*Growth.* Words and pairs are counted for all of the corpus. Then waves expand the best nodes of the frontier: those whose
bound reaches a floor, and to the left those whose own score does, as a longer phrase there may cover them. A candidate is
covered if a longer one that holds it is nearly as frequent; some phrase of one word more is then, too, so neighbours
suffice. A language is settled when ``KEEP`` uncovered candidates reach the floor or the floor is 0: nothing unexpanded can
score as much, ties included. Otherwise its floor falls to that of eight times as many pairs. Every wave is a pass over the texts for each length of phrase.

*Counting.* Tasks cut texts into words in numpy, add up equal phrases as 64-bit keys of words salted with the language, and
send one row for each distinct phrase; Spark adds these up. Words under ``LEAST`` are left out of pairs by a bit map of
fixed size, which only errs on the side of counting. Nodes to expand travel in blocks of ``KEYS`` keys, one pass a block, so
what is broadcast is bounded whatever the corpus. Equal keys are taken as equal words.

Defined results: null texts are empty, a null language is ``und``; repeated rows count as often as they stand there;
languages without candidates have no rows; no rows give none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lexer, rows

LEAST = 30
LONGEST = 4
KEEP = 2000
#: Percent of a phrase's occurrences from which a longer one covers it.
COVER = 80
#: Pairs of a language in the first wave, as a multiple of ``KEEP``, and how many times more each wave takes.
FIRST, MORE = 8, 8
#: Keys that one pass over the texts may look for.
KEYS = 1 << 21
#: Distinct phrases that a task adds up before it sends them.
HELD = 1_000_000
#: Bits of the map of frequent words.
BITS = 1 << 25

SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_APART = lexer.byte_mask(SEPARATORS)
_WORD = lexer.byte_mask(b"\x20\x09" + SEPARATORS, inverse=True)


def _keys(chunk: lexer.Chunk, salts: np.ndarray) -> tuple[lexer.Words, np.ndarray, np.ndarray]:
    """Words, their salted keys, and whether each word but the last is followed by the next one inside a piece."""
    found = lexer.words(chunk, _WORD)
    keys = lexer.mix(found.keys ^ salts[found.doc])
    cuts = np.cumsum(_APART[chunk.data])
    if len(keys) < 2:
        return found, keys, np.zeros(0, bool)
    return found, keys, (found.doc[1:] == found.doc[:-1]) & (cuts[found.starts[1:]] == cuts[found.ends[:-1] - 1])


def _windows(keys: np.ndarray, follows: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the windows of 1 to ``k`` words from each place, and the places where ``k`` words stand in one piece."""
    n = len(keys)
    hashes, whole = [keys], np.ones(n, bool)
    for i in range(1, k):
        grown = np.zeros_like(keys)
        grown[: n - i] = lexer.mix(hashes[-1][: n - i] * lexer.U64(lexer._BASE) + keys[i:])
        hashes.append(grown)
        whole[: n - i] &= follows[i - 1 :]
        whole[n - i :] = False
    return hashes, np.flatnonzero(whole)


class _Sums:
    """Distinct rows of keys with counts; the first column decides which rows are equal."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, columns: list[np.ndarray]) -> None:
        self.parts.append([*columns, np.ones(len(columns[0]), np.int64)])
        self.size += len(columns[0])

    def fold(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.argsort(columns[0])
        first = np.flatnonzero(np.append(True, np.diff(columns[0][order].view(np.int64)) != 0)) if len(order) else order
        columns = [*(c[order[first]] for c in columns[:-1]), np.add.reduceat(columns[-1][order], first) if len(order) else columns[-1]]
        self.parts, self.size = [columns], len(columns[0])
        return columns

    def full(self) -> bool:
        """Whether the distinct rows are as many as may be held."""
        return self.size > 2 * HELD and len(self.fold()[0]) > HELD


def _batches(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    made = [pa.array(c.view(np.int64)) for c in columns]
    for low in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([c.slice(low, 100_000) for c in made], names=names)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    rows.small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return docs.select(F.col(f"`{text_col}`").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("salt"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[lexer.Chunk, np.ndarray, pa.Array]]:
    for batch in batches:
        for chunk in lexer.chunks(batch.column(0)):
            yield chunk, batch.column(2).slice(chunk.first, len(chunk)).to_numpy().view(np.uint64), batch.column(1).slice(chunk.first, len(chunk))


def words(texts: DataFrame) -> DataFrame:
    """lang, word, key, f: all words with their numbers in their language; a null word stands for all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}

        def send() -> Iterator[pa.RecordBatch]:
            values = list(seen.values())
            for low in range(0, len(values), 20_000):
                lang, word, key, n = zip(*values[low : low + 20_000])
                yield pa.record_batch({"lang": pa.array(lang, pa.string()), "word": pa.array(word, pa.string()), "key": pa.array(np.array(key, np.uint64).view(np.int64)), "f": pa.array(n, pa.int64())})
            seen.clear()

        for chunk, salts, langs in _chunks(batches):
            found, keys, _ = _keys(chunk, salts)
            distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
            raw, langs = chunk.data.tobytes(), langs.to_pylist()
            for key, i, count in zip(distinct.tolist(), first.tolist(), n.tolist()):
                known = seen.get(key)
                if known is None:
                    word = raw[found.starts[i] : found.ends[i]]
                    seen[key] = [langs[found.doc[i]], word.decode().translate(_LOWER), key, count]
                else:
                    known[3] += count
            for lang, salt, count in zip(langs, salts.tolist(), np.diff(found.bounds).tolist()):
                # Keys of words are 64 bits long, so a pair cannot be one.
                seen.setdefault((salt,), [lang, None, 0, 0])[3] += count
            if len(seen) > HELD // 4:
                yield from send()
        yield from send()

    return texts.mapInArrow(run, "lang string, word string, key long, f long").groupBy("lang", "word", "key").agg(F.sum("f").alias("f"))


_LOWER = {c: c + 32 for c in range(65, 91)}


def _bit_map(frequent: DataFrame) -> np.ndarray:
    """One bit for each remainder that a frequent word's key has; ``BITS / 8`` rows at most come to the driver."""
    slot = frequent.select(F.pmod("key", F.lit(BITS)).cast("int").alias("slot"))
    bits = slot.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, slot & 7)")).alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    return out


def _has(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def _count(texts: DataFrame, k: int, bit_map, wanted: dict[str, np.ndarray] | None) -> DataFrame:
    """Phrases of ``k`` frequent words: w1 … wk, h (whole), hs (all but the first), n; with ``wanted`` those of which the prefix, suffix or whole is in its keys."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    names = [*(f"w{i + 1}" for i in range(k)), "h", "hs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, look = bit_map.value, shared.value
        sums = _Sums()
        for chunk, salts, _ in _chunks(batches):
            _, keys, follows = _keys(chunk, salts)
            if len(keys) < k:
                continue
            slot = keys & lexer.U64(BITS - 1)
            common = (bits[(slot >> lexer.U64(3)).astype(np.int64)] >> (slot & lexer.U64(7)).astype(np.uint8) & 1).astype(bool)
            hashes, at = _windows(keys, follows & common[1:] & common[:-1], k)
            if look is not None:
                at = at[_has(look["prefix"], hashes[k - 2][at]) | _has(look["suffix"], hashes[k - 2][at + 1]) | _has(look["whole"], hashes[k - 1][at])]
            sums.add([hashes[k - 1][at], *(keys[at + i] for i in range(k)), hashes[k - 2][at + 1]])
            if sums.full():
                h, *own = sums.fold()
                yield from _batches([*own[:k], h, *own[k:]], names)
                sums = _Sums()
        if sums.parts:
            h, *own = sums.fold()
            yield from _batches([*own[:k], h, *own[k:]], names)

    return texts.select("text", "lang", "salt").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _grown(texts: DataFrame, k: int, bit_map, prefix: DataFrame | None = None, suffix: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Phrases of ``k`` words, ``LEAST`` times or more, of which a part is among the keys given (frames of one column ``h``); all where none are."""
    keys = [c for c in (*(f"w{i + 1}" for i in range(k)), "h", "hs")]

    def settle(found: DataFrame) -> DataFrame:
        return found.groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)

    sets = {"prefix": prefix, "suffix": suffix, "whole": whole}
    if not any(x is not None for x in sets.values()):
        return cut_lineage(settle(_count(texts, k, bit_map, None)))
    nodes = [frame.select("h", F.lit(i).cast("tinyint").alias("part")) for i, frame in enumerate(sets.values()) if frame is not None]
    every = nodes[0]
    for frame in nodes[1:]:
        every = every.unionByName(frame)
    every = cut_lineage(every.distinct())
    blocks = -(-every.count() // KEYS)
    made = []
    for b in range(blocks):
        some = every.where(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b).toArrow()
        part, h = some.column("part").to_numpy(), some.column("h").to_numpy().view(np.uint64)
        made.append(cut_lineage(settle(_count(texts, k, bit_map, {name: np.sort(h[part == i]) for i, name in enumerate(sets)}))))
    out = made[0] if made else None
    for more in made[1:]:
        out = out.unionByName(more)
    if out is None:
        return texts.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in (*keys, "a")))
    # A phrase found by its prefix in one block and by its suffix in another was counted whole in both.
    return out.distinct() if blocks > 1 else out


def ratio(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)), exact."""
    return F.expr(f"CAST((CAST({a} AS DECIMAL(20, 0)) * 2000000) div (CAST({l} AS DECIMAL(20, 0)) + {r}) AS BIGINT)")


def _lowest(*cuts: tuple[str, str]) -> Column:
    """Score, k, l and r of the lowest cut, the first among equals."""
    return F.array_min(F.array(*(F.struct(ratio("a", left, right).alias("score"), F.lit(k + 1).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts))))


def _named(frame: DataFrame, **names: str) -> DataFrame:
    """The columns of ``frame`` given by new name."""
    return frame.select(*(F.col(old).alias(new) for new, old in names.items()))


def _reached(frame: DataFrame, floors: DataFrame, what: str) -> DataFrame:
    return frame.join(floors, "lang").where(F.col(what) >= F.col("floor"))


def _uncovered(found: DataFrame, longer: DataFrame, k: int) -> DataFrame:
    """``found`` (phrases of ``k`` words) without those that one of ``longer`` (one word more) covers."""
    own = [f"w{i + 1}" for i in range(k)]
    left = longer.select(*own, "a")
    right = longer.select(*(F.col(f"w{i + 2}").alias(f"w{i + 1}") for i in range(k)), "a")
    most = left.unionByName(right).groupBy(*own).agg(F.max("a").alias("most"))
    return found.join(most, own, "left").where(F.col("most").isNull() | (100 * F.col("most") < COVER * F.col("a"))).drop("most")


_OUT = ["lang", "score", "a", "l", "r", "w1", "w2", "w3", "w4"]


def _shaped(found: DataFrame, k: int) -> DataFrame:
    words_ = [F.col(f"w{i + 1}") if i < k else F.lit(None).cast("long").alias(f"w{i + 1}") for i in range(LONGEST)]
    return found.select("lang", "low.score", "a", "low.l", "low.r", *words_)


def _wave(texts: DataFrame, bit_map, pairs: DataFrame, floors: DataFrame) -> DataFrame:
    """The uncovered candidates of the languages in ``floors`` that reach their floor."""
    frontier, strong = _reached(pairs, floors, "bound"), _reached(pairs, floors, "low.score")
    triples = _grown(texts, 3, bit_map, prefix=frontier.select("h"), suffix=strong.select("h"))
    head = _named(pairs, lang="lang", w1="w1", w2="w2", f12="a", f1="l1")
    tail = _named(pairs, w2="w1", w3="w2", f23="a", f3="r1")
    triples = cut_lineage(
        triples.join(head, ["w1", "w2"]).join(tail, ["w2", "w3"]).withColumn("low", _lowest(("f1", "f23"), ("f12", "f3"))).withColumn("bound", ratio("a", "f1", "a"))
    )
    frontier3, strong3 = _reached(triples, floors, "bound"), _reached(triples, floors, "low.score")
    fours = cut_lineage(_grown(texts, 4, bit_map, prefix=frontier3.select("h"), suffix=strong3.select("h")))
    head = _named(triples, lang="lang", w1="w1", w2="w2", w3="w3", f123="a", f12="f12", f1="f1")
    tail = _named(pairs, w3="w1", w4="w2", f34="a", f4="r1")
    open_ = fours.join(head, ["w1", "w2", "w3"]).join(tail, ["w3", "w4"])
    # The last three words are known only if they were expanded; those that may still matter are counted now.
    last = _named(triples, w2="w1", w3="w2", w4="w3", f234="a")
    open_ = open_.join(last, ["w2", "w3", "w4"], "left").withColumn("bound", F.least(ratio("a", "f1", "a"), ratio("a", "f12", "f34"), ratio("a", "f123", "f4")))
    open_ = cut_lineage(_reached(open_, floors, "bound").drop("floor"))
    more = _grown(texts, 3, bit_map, whole=open_.where("f234 IS NULL").select(F.col("hs").alias("h")))
    more = _named(more, w2="w1", w3="w2", w4="w3", g234="a")
    whole = open_.join(more, ["w2", "w3", "w4"], "left").withColumn("f234", F.coalesce("f234", "g234")).withColumn("low", _lowest(("f1", "f234"), ("f12", "f34"), ("f123", "f4")))
    found = _shaped(_uncovered(strong, triples, 2), 2).unionByName(_shaped(_uncovered(strong3, fours, 3), 3)).unionByName(_shaped(_reached(whole, floors, "low.score"), 4))
    return cut_lineage(found)


def _floors(pairs: DataFrame, langs: DataFrame, many: int) -> DataFrame:
    """For each language the score of its pair number ``many``, 0 where it has fewer."""
    scores = pairs.join(langs, "lang").groupBy("lang", F.col("low.score").alias("score")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    return scores.withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= many, F.col("score"))), F.lit(0)).alias("floor"))


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """The ``keep`` best collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = _texts(docs, lang_col, text_col)
    vocabulary = cut_lineage(words(texts).where(F.col("word").isNull() | (F.col("f") >= LEAST)))
    totals = vocabulary.where("word IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = vocabulary.where("word IS NOT NULL")
    bit_map = spark.sparkContext.broadcast(_bit_map(frequent))
    first, second = _named(frequent, lang="lang", w1="key", l1="f"), _named(frequent, w2="key", r1="f")
    pairs = _grown(texts, 2, bit_map).join(first, "w1").join(second, "w2")
    pairs = cut_lineage(pairs.withColumn("low", _lowest(("l1", "r1"))).withColumn("bound", ratio("a", "l1", "a")))
    langs, many = pairs.select("lang").distinct(), FIRST * keep
    done = []
    while True:
        floors = rows.small_side(_floors(pairs, langs, many))
        if not floors.count():
            break
        found = _wave(texts, bit_map, pairs, floors)
        settled = floors.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("c")), "lang", "left")
        settled = rows.small_side(settled.withColumn("ready", (F.coalesce("c", F.lit(0)) >= keep) | (F.col("floor") == 0)))
        done.append(found.join(settled.where("ready").select("lang"), "lang", "left_semi"))
        langs, many = settled.where("NOT ready").select("lang"), many * MORE
    if not done:
        return spark.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    best = done[0]
    for more in done[1:]:
        best = best.unionByName(more)
    return _ranked(best, frequent, totals, keep)


def _ranked(found: DataFrame, frequent: DataFrame, totals: DataFrame, keep: int) -> DataFrame:
    # Scores and counts are added up first, so that only rows which may be among the best meet in a language's window.
    steps = found.groupBy("lang", "score", "a").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))) - F.col("c")
    steps = steps.withColumn("before", before).where(F.col("before") < keep).select("lang", "score", "a")
    best = cut_lineage(found.join(steps, ["lang", "score", "a"]))
    used = best.select(F.explode(F.array("w1", "w2", "w3", "w4")).alias("key")).where("key IS NOT NULL").distinct()
    names = rows.small_side(frequent.join(used, "key").select("key", "word"))
    for i in range(1, LONGEST + 1):
        best = best.join(names.select(F.col("key").alias(f"w{i}"), F.col("word").alias(f"word{i}")), f"w{i}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *(f"word{i}" for i in range(1, LONGEST + 1))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return best.join(rows.small_side(totals), "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
  FROM words CROSS JOIN range(1, 5) s(k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), n AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.g, c.a, s.j, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score
  FROM f c JOIN range(1, 4) s(j) ON s.j < c.k
  JOIN f l ON l.lang = c.lang AND l.k = s.j AND l.g = c.g[1:s.j] JOIN f r ON r.lang = c.lang AND r.k = c.k - s.j AND r.g = c.g[s.j + 1:c.k]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), inner_parts AS (
  SELECT f.lang, s.k, g[p.i:p.i + s.k - 1] AS g, max(f.a) AS most
  FROM f JOIN range(2, 4) s(k) ON s.k < f.k JOIN range(1, 4) p(i) ON p.i + s.k - 1 <= f.k GROUP BY ALL
), left_over AS (
  SELECT scored.*, array_to_string(scored.g, ' ') AS phrase FROM scored LEFT JOIN inner_parts p ON p.lang = scored.lang AND p.g = scored.g
  WHERE p.most IS NULL OR 100 * p.most < 80 * scored.a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
