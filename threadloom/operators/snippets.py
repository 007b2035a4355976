"""Snippets, previews and hit lists of search results."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, offsets, ranges
from ..functions import text as tx
from ..session import cut_lineage
from .ordered import chunk_of, ordinals, running


def snippet_tokens(tokens: DataFrame, k: int = 3) -> DataFrame:
    """The three longest tokens per query; one-character tokens only when there are no others."""
    longer = F.max(F.length("token") >= 2).over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.length("token").desc(), "token")
    pool = tokens.select("query_id", "token").withColumn("longer", longer)
    pool = pool.where((F.length("token") >= 2) | ~F.col("longer"))
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("longer")


def with_ranges(messages: DataFrame, query: str) -> DataFrame:
    """Messages that match a plain query, with their flat text and ranges.

    A cheap test on the body drops the others before any range is computed.
    """
    terms = [tx.fold(t) for t in query.split()]
    low = F.lower("body")
    maybe = reduce(or_, [F.contains(low, F.lit(t)) for t in terms], low.rlike(tx.NFKC_TEST) | F.col("body").rlike(markup.MARKS))
    # Exploding an array of one keeps the flat text from being copied into all that reads it.
    rows = messages.where(maybe).select("*", F.explode(F.array(markup.idle_text("body"))).alias("flat"))
    rows = tx.with_normalised(rows, "norm", F.col("flat"))
    rows = rows.withColumn("ranges", ranges.term_ranges(F.col("norm"), query)).drop("norm")
    return rows.where(F.size("ranges") > 0)


def best_snippets(messages: DataFrame, query: str) -> DataFrame:
    """One snippet per conversation: most ranges, then the earliest first range, then id."""
    hits = with_ranges(messages, query)
    score = F.size("ranges") * 100000 - F.col("ranges")[0]["start"]
    cut = ranges.snippet(F.col("flat"), F.col("ranges"), literal=False)
    rows = hits.select("conversation_id", "id", score.alias("score"), cut.alias("cut"))
    best = F.max_by(F.struct("id", "cut"), F.struct("score", "id"))
    return rows.groupBy("conversation_id").agg(best.alias("b")).select("conversation_id", "b.id", "b.cut.text", "b.cut.ranges")


def choose_preview(kind_rows: DataFrame) -> DataFrame:
    """Snippet, else first prompt, else last message, else none or title-only.

    ``kind_rows``: snippet, first_user_preview, last_preview, message_count and any keys.
    """
    first, last = tx.preview_text(markup.idle_text("first_user_preview")), tx.preview_text(markup.idle_text("last_preview"))
    some = lambda c, kind: F.when(c != "", F.struct(F.lit(kind).alias("kind"), c.alias("text")))
    rest = F.struct(F.when(F.col("message_count") > 0, "none").otherwise("title-only").alias("kind"), F.lit("").alias("text"))
    picked = F.coalesce(some(F.coalesce("snippet", F.lit("")), "snippet"), some(first, "first-user"), some(last, "last"), rest)
    keys = [c for c in kind_rows.columns if c not in ("snippet", "first_user_preview", "last_preview", "message_count")]
    return kind_rows.select(*keys, picked.alias("p")).select(*keys, "p.kind", "p.text")


def hit_list(headers: DataFrame, ordered: DataFrame, query: str) -> DataFrame:
    """Numbered hits: title first, then messages in order, each with its neighbours; offsets are those of the stored text.

    ``ordered``: conversation_id, id, pos, body.
    """
    find = lambda norm: ranges.term_ranges(norm, query)
    titles = offsets.with_stored_ranges(headers.select(F.col("id").alias("conversation_id"), "title"), F.col("title"), find, marked=False)
    in_title = titles.select("conversation_id", F.lit(0).cast("bigint").alias("pos"), F.lit("title").alias("id"), F.inline("ranges"))
    bodies = offsets.with_stored_ranges(ordered, F.col("body"), find, marked=False)
    in_body = bodies.select("conversation_id", F.col("pos").cast("bigint").alias("pos"), "id", F.inline("ranges"))
    hits = cut_lineage(in_title.unionByName(in_body))  # short rows; texts are read once
    numbered = ordinals(hits, ["conversation_id"], ["pos", "start"], chunk_of("pos", 256), "hit")
    here = F.col("id")
    return running(numbered, ["conversation_id"], ["hit"], chunk_of("hit"), prev_id=("near", here, "before"), next_id=("near", here, "after"))


def shown_hits(hits: DataFrame, hidden: DataFrame) -> DataFrame:
    """Hits that are not wholly inside a hidden range of the same message.

    ``hits``: id, start, end. ``hidden``: id, h_start, h_end.
    """
    covered = (hits["id"] == hidden["id"]) & (hits["start"] >= hidden["h_start"]) & (hits["end"] <= hidden["h_end"])
    return hits.join(hidden, covered, "left_anti")
