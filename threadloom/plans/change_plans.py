"""Folds, removals and image writes over all stored tables: one query for each table they change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, identity, images, index
from ..sources import model
from .curation_plans import _FOLD, _PROGRESS, _RUNS, _fold_rows
from .display_plans import IMG, _images
from .registry import query, with_ctes
from .sqltext import NUMBER, WORD, visible

NOW = model.NOW_MS

# --- folds --------------------------------------------------------------------------

# Every header's tail lags behind: turn 2 to 7 of its conversation.
_HEADS = "heads AS (SELECT conversation_id AS id, 99 AS message_count, arg_max(id, ord) FILTER (ord <= 3 + conv_no % 6) AS tail_message_id, 'old' AS last_preview, 'user' AS last_preview_role FROM (SELECT *, split_part(conversation_id, ':c', 2)::BIGINT AS conv_no FROM runs) GROUP BY conversation_id)"


def _heads(rows):
    no = F.split_part("conversation_id", F.lit(":c"), F.lit(2)).cast("bigint")
    tail = F.when(F.col("ord") <= 3 + no % 6, F.col("ord"))
    heads = rows.groupBy(F.col("conversation_id").alias("id")).agg(F.max_by("id", tail).alias("tail_message_id"))
    return heads.select("id", F.lit(99).alias("message_count"), "tail_message_id", F.lit("old").alias("last_preview"), F.lit("user").alias("last_preview_role"))


def _excerpt(text):
    for pattern, replacement in (("\\r\\n?", "chr(10)"), ("[\\t\\f\\x0b \\x{a0}\\x{3000}]+", "' '"), (" *\\n *", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^[\\n ]+|[\\n ]+\\z", "''")):
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    return text


@query("s14_fold_headers", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, _HEADS, f"""
  n AS (SELECT conversation_id AS id, count(*) AS n FROM runs WHERE id NOT IN (SELECT drop_id FROM folds) GROUP BY 1),
  moved AS (SELECT h.id, keep_id, k.role, {_excerpt('k.b')} AS t, trim(k.b) <> '' AND NOT {_PROGRESS} AS said FROM heads h JOIN folds f ON f.drop_id = h.tail_message_id JOIN (SELECT * FROM runs) k ON k.id = f.keep_id)""".strip(), body="""
  SELECT h.id, CASE WHEN h.id IN (SELECT conversation_id FROM folds) THEN n.n ELSE message_count END::INT AS message_count, coalesce(m.keep_id, tail_message_id) AS tail_message_id,
    md5(CASE WHEN said THEN CASE WHEN length(t) <= 360 THEN t ELSE regexp_replace(t[:360], '[\\n ]+\\z', '') || '…' END ELSE last_preview END) AS last_preview, CASE WHEN said THEN m.role ELSE last_preview_role END AS last_preview_role
  FROM heads h LEFT JOIN n USING (id) LEFT JOIN moved m USING (id)"""))
def fold_headers(spark, sf_dir):
    rows = _fold_rows(spark, sf_dir)
    heads = changes.apply_fold_plan({"headers": _heads(rows), "messages": rows}, identity.progress_folds(rows))["headers"]
    return heads.withColumn("last_preview", F.md5("last_preview"))


@query("s14_fold_postings", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, f"""
  txt AS (SELECT conversation_id, id AS source, lower({visible('b')}) AS t FROM runs WHERE id NOT IN (SELECT drop_id FROM folds)),
  tok AS (SELECT DISTINCT conversation_id, source, unnest(regexp_extract_all(t, '{WORD}') || regexp_extract_all(t, '{NUMBER}')) AS token FROM txt)""".strip(), body="""
  SELECT token, count(*) AS n, count(DISTINCT conversation_id) AS conversations FROM tok GROUP BY token"""))
def fold_postings(spark, sf_dir):
    rows = _fold_rows(spark, sf_dir)
    left = changes.apply_fold_plan({"postings": index.message_postings(rows)}, identity.progress_folds(rows))["postings"]
    return left.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conversation_id").alias("conversations"))


@query("s14_fold_page_order", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, body="""
  SELECT conversation_id, 20 - ord AS pos, id AS message_id FROM runs WHERE id NOT IN (SELECT drop_id FROM folds)"""))
def fold_page_order(spark, sf_dir):
    rows = _fold_rows(spark, sf_dir)
    order = rows.select("conversation_id", (20 - F.col("ord")).alias("pos"), F.col("id").alias("message_id"))
    return changes.apply_fold_plan({"page_order": order}, identity.progress_folds(rows))["page_order"]


# Numbers are given out by the sequential rule, which tests compare; here each kept turn's pictures and their bytes.
_MOVED = "moved AS (SELECT coalesce(keep_id, message_id) AS message_id, keep_id, i.off, i.bytes, i.alt FROM nimg i LEFT JOIN folds f ON f.drop_id = i.message_id)"


@query("s14_fold_images", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, IMG, _MOVED, body="""
  SELECT message_id, count(*) AS images, count(*) AS slots, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN keep_id IS NULL THEN off ELSE 0 END) AS BIGINT) AS offs FROM moved GROUP BY message_id"""))
def fold_images(spark, sf_dir):
    stored = images.normalise_images(_images(spark, sf_dir))
    left = changes.apply_fold_plan({"images": stored}, identity.progress_folds(_fold_rows(spark, sf_dir)))["images"]
    return left.groupBy("message_id").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("idx").alias("slots"), F.sum(F.col("bytes").cast("bigint")).alias("bytes"), F.sum(F.col("off").cast("bigint")).alias("offs"))


@query("s14_fold_blobs", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, IMG, _MOVED, body="""
  SELECT message_id, count(*) AS blobs, string_agg(md5(alt), ',' ORDER BY md5(alt)) AS held FROM moved GROUP BY message_id"""))
def fold_blobs(spark, sf_dir):
    stored = images.normalise_images(_images(spark, sf_dir))
    blobs = stored.select("message_id", "idx", F.col("alt").cast("binary").alias("blob"))
    left = changes.apply_fold_plan({"images": stored, "blobs": blobs}, identity.progress_folds(_fold_rows(spark, sf_dir)))["blobs"]
    return left.groupBy("message_id").agg(F.count(F.lit(1)).alias("blobs"), F.array_join(F.sort_array(F.collect_list(F.md5("blob"))), ",").alias("held"))


# --- removals and image writes ------------------------------------------------------


@query("s11_freed_bytes", sql=with_ctes(model.DOC_MSG, IMG, f"""
  txt AS (SELECT conversation_id, id AS source, lower({visible('body')}) AS t FROM msg WHERE conv_no % 4 <> 1),
  tok AS (SELECT DISTINCT source, unnest(regexp_extract_all(t, '{WORD}') || regexp_extract_all(t, '{NUMBER}')) AS token FROM txt)""".strip(), body="""
  SELECT 'postings' AS part, count(*) AS n, NULL::BIGINT AS bytes FROM tok
  UNION ALL SELECT 'images', count(*), CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM nimg WHERE conv_no % 4 <> 1
  UNION ALL SELECT 'blobs', count(*), CAST(coalesce(sum(strlen(alt)), 0) AS BIGINT) FROM nimg WHERE conv_no % 4 <> 1
  UNION ALL SELECT 'freed', count(*), CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM nimg WHERE conv_no % 4 = 1"""))
def freed_bytes(spark, sf_dir):
    turns = model.document_messages(spark, sf_dir)
    stored = images.normalise_images(_images(spark, sf_dir))
    ids = turns.where("conv_no % 4 = 1").select("conversation_id")
    tables = {"postings": index.message_postings(turns), "images": stored, "blobs": stored.select("message_id", "idx", F.col("alt").cast("binary").alias("blob"))}
    left = changes.remove_conversations(tables, ids, NOW)
    held = {"postings": F.lit(None).cast("bigint"), "images": F.coalesce(F.sum(F.col("bytes").cast("bigint")), F.lit(0)), "blobs": F.coalesce(F.sum(F.length("blob").cast("bigint")), F.lit(0))}
    parts = [left[name].agg(F.count(F.lit(1)).alias("n"), of.alias("bytes")).select(F.lit(name).alias("part"), "n", "bytes") for name, of in held.items()]
    out = left["freed"].select(F.lit("freed").alias("part"), F.col("images").alias("n"), "bytes")
    for part in parts:
        out = out.unionByName(part)
    return out


@query("s13_image_blobs", sql=with_ctes(IMG, body="""
  SELECT message_id, idx, md5(alt) AS held FROM nimg WHERE conv_no % 3 = 0 AND alt IS NOT NULL
  UNION ALL SELECT message_id, idx, md5('new' || alt) FROM nimg WHERE conv_no % 3 > 0 AND status = 'cached' AND bytes % 5 > 0"""))
def image_blobs(spark, sf_dir):
    rows = images.normalise_images(_images(spark, sf_dir))
    no = F.regexp_extract("conversation_id", ":c([0-9]+)$", 1).cast("int")
    stored = rows.where(no % 3 < 2).select("message_id", "idx", F.col("alt").cast("binary").alias("blob"))
    fresh = rows.where(no % 3 > 0)
    # The first arrival has other bytes and another status; the second decides, some without bytes.
    early = fresh.withColumns({"arrival": F.lit(1), "status": F.lit("cached"), "blob": F.lit("early").cast("binary")})
    late = fresh.withColumns({"arrival": F.lit(2), "blob": F.when(F.col("bytes") % 5 > 0, F.concat(F.lit("new"), F.col("alt"))).cast("binary")})
    return changes.write_blobs(stored, early.unionByName(late)).select("message_id", "idx", F.md5("blob").alias("held"))
