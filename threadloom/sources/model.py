"""Declared schemas and the model tables derived from the driver tables.

``conversations`` and ``documents`` both stand for stored turns; headers are one
partial-aggregation pass over the turns that only carries short strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
PLATFORMS = ["chatgpt", "claude", "grok", "gemini"]
MIN_PAGE_MS = 1577836800000
DAY_MS = 86400000
NOW_MS = 1735689600000
SOURCES = ["page-exact", "observed", "page-bucket", "sidebar-rank", "first-seen", "legacy"]
# ----------------------------------------------------------------------------------

SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}
HEADER_SCHEMA = (
    "id STRING, platform STRING, platform_id STRING, url STRING, title STRING, created_ms BIGINT, "
    "updated_ms BIGINT, updated_source STRING, first_seen_ms BIGINT, older_than_ms BIGINT, "
    "message_count INT, archived BOOLEAN, archive_source STRING, archived_ms BIGINT, "
    "prev_archive_source STRING, first_user_preview STRING, first_user_message_id STRING, "
    "last_preview STRING, last_preview_role STRING, tail_message_id STRING"
)
MESSAGE_SCHEMA = (
    "id STRING, conversation_id STRING, role STRING, body STRING, captured_ms BIGINT, "
    "capture_index INT, turn_id STRING"
)
IMAGE_SCHEMA = (
    "message_id STRING, idx INT, conversation_id STRING, status STRING, alt STRING, prompt STRING, "
    "off INT, bytes INT, mime STRING, width INT, height INT"
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One driver table with its declared schema; no inference pass over the files."""
    frame = spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")
    return spread(frame) if table in ("documents", "pages", "conversations") else frame


def spread(frame: DataFrame) -> DataFrame:
    """Text work needs every core: inputs of fewer splits than cores are dealt out once.

    Large inputs have more splits than cores and are left as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def load_tables(spark: SparkSession, base: str, **schemas: str) -> dict[str, DataFrame]:
    """The stored model tables of a library folder, each with its declared schema."""
    return {n: spark.read.schema(s).parquet(f"{base}/{n}") for n, s in schemas.items()}


def platform_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), (number % 4 + 1).cast("int"))


def _turns(raw: DataFrame) -> DataFrame:
    platform = platform_of(F.col("conv_no"))
    conversation = F.concat(platform, F.lit(":c"), F.col("conv_no").cast("string"))
    return raw.select(
        F.concat_ws(":", conversation, F.col("turn").cast("string")).alias("id"),
        conversation.alias("conversation_id"),
        "conv_no",
        platform.alias("platform"),
        "role",
        "body",
        "turn",
        (F.lit(1700000000000) + F.col("conv_no") * 3600000 + F.col("turn") * 60000).alias("captured_ms"),
        F.col("turn").cast("int").alias("capture_index"),
        F.when(F.col("turn") % 3 != 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("turn_id"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns of ``conversations``; system and tool rows are never stored."""
    raw = load(spark, sf_dir, "conversations").where(~F.col("role").isin("system", "tool"))
    return _turns(
        raw.select(
            F.col("conv_id").alias("conv_no"),
            "turn",
            F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"),
            F.col("text").alias("body"),
        )
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as turns: ten to a conversation, roles by parity."""
    turn = F.col("doc_id") % 10
    return _turns(
        load(spark, sf_dir, "documents").select(
            F.expr("doc_id div 10").alias("conv_no"),
            turn.alias("turn"),
            F.when(turn % 2 == 0, "user").otherwise("assistant").alias("role"),
            F.col("text").alias("body"),
        )
    )


def opening_words(body: Column, n: int = 6) -> Column:
    head = F.regexp_extract(body, rf"^\s*(\S+(?:\s+\S+){{0,{n - 1}}})", 1)
    return F.regexp_replace(head, r"\s+", " ")


def headers(turns: DataFrame) -> DataFrame:
    """Conversation headers of stored turns, in one aggregation."""
    no = F.col("conv_no")
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (no % 6 + 1).cast("int"))
    grouped = turns.groupBy("conversation_id", "conv_no", "platform").agg(
        F.min_by(opening_words(F.col("body")), "turn").alias("title"),
        F.count("*").cast("int").alias("message_count"),
        F.max_by("id", "turn").alias("tail_message_id"),
    )
    return grouped.select(
        F.col("conversation_id").alias("id"),
        "conv_no",
        "platform",
        F.concat(F.lit("c"), no.cast("string")).alias("platform_id"),
        "title",
        (F.lit(1690000000000) + no * 1000).alias("created_ms"),
        (F.lit(1700000000000) + (no * 7919 % 1000) * 3600000).alias("updated_ms"),
        F.when(no % 7 != 5, source).alias("updated_source"),
        F.when(no % 5 != 0, F.lit(1695000000000) + no * 2000).alias("first_seen_ms"),
        F.when((no % 6 == 3) & (no % 4 != 3), F.lit(1701000000000) + no * 1000).alias("older_than_ms"),
        "message_count",
        F.when(no % 7 == 0, True).when(no % 7 == 1, False).alias("archived"),
        "tail_message_id",
    )


# The same derivations for the SQL oracle --------------------------------------------
_TURN_SQL = """
  SELECT p || ':c' || conv_no || ':' || turn AS id, p || ':c' || conv_no AS conversation_id, conv_no,
    p AS platform, role, body, turn, 1700000000000 + conv_no * 3600000 + turn * 60000 AS captured_ms,
    turn::INT AS capture_index, CASE WHEN turn % 3 <> 0 THEN 't' || turn END AS turn_id
  FROM (SELECT *, ['chatgpt','claude','grok','gemini'][(conv_no % 4 + 1)::INT] AS p FROM ({raw}))"""
MSG = "msg AS (" + _TURN_SQL.format(
    raw="""SELECT conv_id AS conv_no, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role,
    text AS body FROM conversations WHERE role NOT IN ('system', 'tool')"""
) + ")"
DOC_MSG = "msg AS (" + _TURN_SQL.format(
    raw="""SELECT doc_id // 10 AS conv_no, doc_id % 10 AS turn,
    CASE WHEN doc_id % 10 % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text AS body FROM documents"""
) + ")"
HDR = r"""hdr AS (
  SELECT conversation_id AS id, conv_no, platform, 'c' || conv_no AS platform_id,
    arg_min(regexp_replace(regexp_extract(body, '^\s*(\S+(?:\s+\S+){0,5})', 1), '\s+', ' ', 'g'), turn) AS title,
    1690000000000 + conv_no * 1000 AS created_ms,
    1700000000000 + (conv_no * 7919 % 1000) * 3600000 AS updated_ms,
    CASE WHEN conv_no % 7 <> 5 THEN
      ['page-exact','observed','page-bucket','sidebar-rank','first-seen','legacy'][(conv_no % 6 + 1)::INT] END AS updated_source,
    CASE WHEN conv_no % 5 <> 0 THEN 1695000000000 + conv_no * 2000 END AS first_seen_ms,
    CASE WHEN conv_no % 6 = 3 AND conv_no % 4 <> 3 THEN 1701000000000 + conv_no * 1000 END AS older_than_ms,
    count(*)::INT AS message_count,
    CASE conv_no % 7 WHEN 0 THEN true WHEN 1 THEN false END AS archived,
    arg_max(id, turn) AS tail_message_id
  FROM msg GROUP BY conversation_id, conv_no, platform)"""
