"""The positional posting table: build, store, refresh.

A posting is one row per (token, conversation, source). All occurrences of a token in a
source sit in one text, so postings are formed inside the row of that text and the build
moves no data. Only storing them does, by token bucket, with tasks sized at run time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx

SCHEMA = "token STRING, conversation_id STRING, source STRING, role STRING, positions ARRAY<INT>"
BUCKETS = 64


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _postings(texts: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """``texts``: conversation_id, source, role, text."""
    keys = ["conversation_id", "source", "role"]
    rows = texts.select(*keys, "text")
    return rows.mapInArrow(tx.posting_rows(keys, tokens), SCHEMA)


def _may_hold(text: Column, tokens: list[str]) -> Column:
    """False only where none of the tokens can occur; text that cleaning or NFKC may change passes."""
    low = F.lower(text)
    held = reduce(or_, [F.contains(low, F.lit(t)) for t in tokens], F.lit(False))
    return held | text.rlike(f"{tx.NFKC_TEST}|{markup.MARKS}")


def message_postings(messages: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Postings of turn bodies, taken from their visible text."""
    if tokens is not None:
        messages = messages.where(_may_hold(F.col("body"), tokens))
    return _postings(
        messages.select(
            "conversation_id",
            F.col("id").alias("source"),
            F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"),
            markup.visible_text("body").alias("text"),
        ),
        tokens,
    )


def title_postings(headers: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    return _postings(
        headers.select(
            F.col("id").alias("conversation_id"),
            F.lit("title").alias("source"),
            F.lit("title").alias("role"),
            F.col("title").alias("text"),
        ),
        tokens,
    )


def build_postings(headers: DataFrame, messages: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """All postings, or without a stored index only those of the tokens a query asks for."""
    return message_postings(messages, tokens).unionByName(title_postings(headers, tokens))


def write_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store by token bucket; rows of a file are sorted by token for min-max pruning.

    The rebalance step sizes the writing tasks at run time: buckets are kept together while
    they are small, and one swollen by a token found everywhere is split over many tasks.
    """
    (
        postings.withColumn("token_bucket", bucket_of(F.col("token")))
        .hint("rebalance", "token_bucket")
        .sortWithinPartitions("token_bucket", "token", "conversation_id")
        .write.mode(mode)
        .partitionBy("token_bucket")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def lookup(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """Rows of exactly these tokens; reads only their buckets of a stored index."""
    rows = postings.where(F.col("token").isin(tokens))
    if "token_bucket" in postings.columns:
        rows = rows.where(F.col("token_bucket").isin(*_buckets(postings, tokens)))
    return rows


def _buckets(postings: DataFrame, tokens: list[str]) -> list[int]:
    spark = postings.sparkSession
    frame = spark.createDataFrame([(t,) for t in tokens], "token STRING")
    return sorted({r[0] for r in frame.select(bucket_of(F.col("token"))).collect()})


def prefix_lookup(postings: DataFrame, prefix: str) -> DataFrame:
    """Rows whose token starts with ``prefix``; the range bounds reach the file statistics."""
    token = F.col("token")
    return postings.where((token >= prefix) & (token < prefix + "￿") & token.startswith(prefix))


def reindex(postings: DataFrame, changed: DataFrame, removed_sources: DataFrame) -> DataFrame:
    """Postings after a write: every posting of a changed or removed source is replaced.

    ``changed``: messages as they now are. ``removed_sources``: conversation_id, source.
    """
    touched = (
        changed.select("conversation_id", F.col("id").alias("source"))
        .unionByName(removed_sources.select("conversation_id", "source"))
        .distinct()
    )
    kept = postings.join(touched, ["conversation_id", "source"], "left_anti")
    return kept.select("token", "conversation_id", "source", "role", "positions").unionByName(
        message_postings(changed)
    )


def token_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tokens a re-index removes and adds per source (conversation_id, source, token)."""
    keys = ["conversation_id", "source", "token"]
    gone = old.select(*keys).exceptAll(new.select(*keys)).withColumn("change", F.lit("removed"))
    came = new.select(*keys).exceptAll(old.select(*keys)).withColumn("change", F.lit("added"))
    return gone.unionByName(came)
