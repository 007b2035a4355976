"""Capture and observation sources: schemas, validation and splitting by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links

_CONVERSATION = (
    "STRUCT<id: STRING, platform: STRING, platform_id: STRING, url: STRING, title: STRING, created_ms: BIGINT, "
    "updated_ms: BIGINT, updated_source: STRING, archived: BOOLEAN, archive_source: STRING>"
)
CAPTURE_SCHEMA = (
    f"type STRING, platform STRING, page_url STRING, at TIMESTAMP, conversation {_CONVERSATION}, conversations ARRAY<{_CONVERSATION}>, "
    "messages ARRAY<STRUCT<id: STRING, role: STRING, body: STRING, turn_id: STRING, progress: BOOLEAN>>, "
    "page_message_ids ARRAY<STRING>, capture_id STRING, body_hash STRING, identity_verified BOOLEAN, "
    "guard_transcript BOOLEAN, ownership_verified BOOLEAN, complete_page BOOLEAN, health MAP<STRING, STRING>"
)
OBSERVATION_SCHEMA = (
    "tab_id BIGINT, at TIMESTAMP, url STRING, title STRING, message_count STRING, "
    "links ARRAY<STRUCT<url: STRING, updated_ms: STRING, message_count: STRING, copies: STRING>>"
)


def _own_host(url: Column, platform: Column) -> Column:
    return F.coalesce(links.plain_authority(url) & (links.platform_of(url) == platform), F.lit(False))


def valid_conversation() -> Column:
    """Known platform, id under its platform, page address (if any) on a host of the platform."""
    platform, url = F.col("platform"), F.coalesce("url", F.lit(""))
    known = platform.isin(*links.HOSTS)
    prefixed = F.startswith(F.col("id"), F.concat(platform, F.lit(":")))
    return F.coalesce(known & prefixed & ((url == "") | _own_host(url, platform)), F.lit(False))


def sender_allowed() -> Column:
    """The page belongs to the row's platform; for chatgpt it shows that very conversation."""
    page, platform = F.col("page_url"), F.col("platform")
    same = F.coalesce(links.conversation_id(page) == F.col("id"), F.lit(False))
    return _own_host(page, platform) & ((platform != "chatgpt") | same)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture stream of JSON files with its declared schema."""
    return spark.readStream.schema(CAPTURE_SCHEMA).json(path)


def split_captures(captures: DataFrame) -> dict[str, DataFrame]:
    """Validated conversation, message and health rows of a capture stream or table."""
    listed = captures.where(F.col("type") == "CAPTURE_CONVERSATIONS").select("page_url", "at", F.explode("conversations").alias("c")).select("page_url", "at", "c.*")
    opened = captures.where((F.col("type") == "CAPTURE_MESSAGES") & F.col("conversation").isNotNull()).select(
        "page_url", "at", "conversation.*", "messages", "capture_id", "body_hash", "complete_page", "identity_verified",
        F.coalesce("page_message_ids", F.array().cast("array<string>")).alias("page_message_ids"),
    ).where(valid_conversation() & sender_allowed())
    health = captures.where(F.col("type") == "CAPTURE_HEALTH").select("platform", "at", "health")
    return {
        "conversations": listed.where(valid_conversation()),
        "opened": opened.drop("messages"),
        "messages": opened.select("at", F.col("id").alias("conversation_id"), "capture_id", "complete_page", F.posexplode("messages").alias("capture_index", "m")).select(
            "at", "conversation_id", "capture_id", "complete_page", "capture_index", "m.*"),
        "health": fit_health(health),
    }


def fit_health(rows: DataFrame) -> DataFrame:
    """Health rows with both counts numeric."""
    h = F.col("health")
    number = lambda k: h[k].try_cast("double")
    kept = rows.where(number("messageCount").isNotNull() & number("sidebarCount").isNotNull())
    hits = F.map_filter(h, lambda k, v: k.startswith("hit:"))
    return kept.select(
        "platform", "at",
        F.coalesce(h["pathKind"], F.lit("other")).alias("path_kind"),
        number("sidebarCount").cast("bigint").alias("sidebar_count"),
        number("messageCount").cast("bigint").alias("message_count"),
        F.coalesce(h["selector"], F.lit("none")).alias("selector"),
        F.transform_values(hits, lambda k, v: F.greatest(F.coalesce(F.floor(v.try_cast("double")), F.lit(0)), F.lit(0))).alias("selector_hits"),
        F.coalesce(h["warn"].try_cast("boolean"), F.lit(False)).alias("warn"),
        links.redact(F.coalesce(h["diag"], F.lit(""))).alias("diag"),
    )


def clean_observations(rows: DataFrame, platform: str) -> DataFrame:
    """Page probes with safe links only and counts from 0; a link may stand for several equal ones, ``copies`` says how many (1 if missing)."""
    safe = F.filter(
        F.transform(F.coalesce("links", F.array()), lambda l: F.struct(
            links.canonical_url(l["url"], F.lit(platform)).alias("url"), l["updated_ms"].try_cast("bigint").alias("updated_ms"), l["message_count"].try_cast("bigint").alias("message_count"),
            F.coalesce(l["copies"].try_cast("bigint"), F.lit(1)).alias("copies"))),
        lambda l: (l["url"] != "") & (l["copies"] > 0),
    )
    return rows.select(
        "tab_id", "at", F.coalesce("url", F.lit("")).alias("href"), F.coalesce("title", F.lit("")).alias("title"),
        F.greatest(F.floor(F.coalesce(F.col("message_count").try_cast("double"), F.lit(0.0))), F.lit(0)).alias("message_count"),
        safe.alias("links"), F.aggregate(safe, F.lit(0).cast("bigint"), lambda n, l: n + l["copies"]).alias("n_links"),
    )
