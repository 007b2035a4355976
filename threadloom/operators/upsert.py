"""Keyed writes of conversations and messages, archive states, deletion and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links
from . import clock, identity
from .sorting import valid_ms


def archive_state(old: dict[str, Column], flag: Column, source: Column, now_ms: int) -> dict[str, Column]:
    """Archive columns after one observation: true sets, false clears, absent keeps."""
    named = F.substring(F.coalesce(source, F.lit("explicit")), 1, 80)
    unchanged = F.coalesce(old["archived"], F.lit(False)) & old["archive_source"].eqNullSafe(named)
    first = F.when(unchanged & valid_ms(old["archived_ms"], now_ms), old["archived_ms"]).otherwise(F.lit(now_ms).cast("bigint"))
    was = F.coalesce(old["archived"], F.lit(False))
    null = F.lit(None)
    return {
        "archived": F.when(flag, True).when(~flag, False).otherwise(F.when(was, True)),
        "archive_source": F.when(flag, named).when(~flag, null).otherwise(F.when(was, old["archive_source"])),
        "archived_ms": F.when(flag, first).when(~flag, null).otherwise(F.when(was & valid_ms(old["archived_ms"], now_ms), old["archived_ms"])),
    }


def latest_rows(batch: DataFrame) -> DataFrame:
    """One row per id of a list batch: best clock, a real title before a generic one, earliest created.

    ``batch``: id, arrival and the observation columns. Folded by partial aggregation, so
    an id repeated in much of the batch is never gathered.
    """
    rank = clock.clock_class(F.col("updated_source"))
    by_clock = F.struct(rank, F.coalesce("updated_ms", F.lit(0)), -F.col("arrival"))
    by_title = F.struct(~links.is_generic_title(F.col("title")), by_clock)
    keep = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), by_clock)).alias(c)
    return batch.groupBy("id").agg(
        keep("platform"), keep("platform_id"), keep("url"),
        F.max_by("title", by_title).alias("title"),
        F.max_by("updated_ms", by_clock).alias("updated_ms"),
        F.max_by("updated_source", by_clock).alias("updated_source"),
        F.min_by("created_ms", F.when(F.col("created_ms").isNotNull(), F.col("arrival"))).alias("created_ms"),
        keep("archived"), keep("archive_source"),
    )


def upsert_conversations(stored: DataFrame, batch: DataFrame, tombstones: DataFrame, now_ms: int, reopened: bool = False) -> DataFrame:
    """Headers after a batch; stored values stay unless the new observation is better.

    Removed conversations are not re-added by list rescans, only by an open page.
    """
    new = latest_rows(batch)
    if not reopened:
        gone = tombstones.select(F.col("conversation_id").alias("id")).join(stored.select("id"), "id", "left_anti")
        new = new.join(gone, "id", "left_anti")
    o = {c: F.col(f"s.{c}") for c in stored.columns}
    n = {c: F.col(f"n.{c}") for c in new.columns}
    both = stored.alias("s").join(new.alias("n"), F.col("s.id") == F.col("n.id"), "full_outer")
    seen, known = n["id"].isNotNull(), o["id"].isNotNull()
    first_seen = F.coalesce(
        F.when(valid_ms(o["first_seen_ms"], now_ms), o["first_seen_ms"]), F.when(valid_ms(o["created_ms"], now_ms), o["created_ms"]),
        F.lit(now_ms).cast("bigint"),
    )
    at = F.least(clock.page_ms(n["updated_ms"], now_ms), F.when(n["updated_ms"].isNotNull(), F.lit(now_ms).cast("bigint")))
    at = F.when(clock.page_ms(n["updated_ms"], now_ms).isNotNull(), at)
    new_class = F.when(at.isNotNull(), clock.clock_class(F.coalesce(n["updated_source"], F.lit("page-exact")))).otherwise(0)
    old_class = F.when(valid_ms(o["updated_ms"], now_ms), clock.clock_class(F.coalesce(o["updated_source"], F.lit("legacy")))).otherwise(0)
    newer = (new_class > 0) & ((new_class > old_class) | ((new_class == old_class) & (at >= o["updated_ms"])))
    fallback_ms = F.when(~known, F.lit(1577836800001)).when(valid_ms(o["updated_ms"], now_ms), o["updated_ms"]).otherwise(F.lit(now_ms))
    kept_source = F.when(
        known & valid_ms(o["updated_ms"], now_ms),
        F.when(F.coalesce(o["updated_source"], F.lit("legacy")) == "legacy", "first-seen").otherwise(o["updated_source"]),
    ).otherwise("first-seen")
    archive = archive_state(o, n["archived"], n["archive_source"], now_ms)
    created = F.coalesce(F.when(valid_ms(o["created_ms"], now_ms), o["created_ms"]), clock.page_ms(n["created_ms"], now_ms), first_seen)
    changed = {
        "platform": n["platform"], "platform_id": n["platform_id"], "url": F.coalesce(n["url"], o["url"]),
        "title": links.best_title(n["title"], o["title"], n["platform_id"]),
        "created_ms": created,
        "updated_ms": F.when(newer, at).otherwise(fallback_ms).cast("bigint"),
        "updated_source": F.when(newer, F.coalesce(n["updated_source"], F.lit("page-exact"))).otherwise(kept_source),
        "first_seen_ms": first_seen,
        "message_count": F.coalesce(o["message_count"], F.lit(0)),
        **archive,
    }
    columns = [F.coalesce(n["id"], o["id"]).alias("id")]
    columns += [F.when(seen, value).otherwise(o[name]).alias(name) for name, value in changed.items()]
    columns += [o[c] for c in stored.columns if c not in changed and c != "id"]
    return both.select(*columns)


def upsert_messages(stored: DataFrame, batch: DataFrame, now_ms: int, complete: bool = False) -> DataFrame:
    """Messages after a batch: same body is a no-op, first capture time and place stay.

    A shorter opening of the stored body never replaces it, unless the page is proved
    complete. Adds ``change``: new, rewritten or none.
    """
    o = {c: F.col(f"s.{c}") for c in ("id", "conversation_id", "role", "body", "captured_ms", "capture_index", "turn_id")}
    n = {c: F.col(f"n.{c}") for c in ("id", "conversation_id", "role", "body", "capture_index", "turn_id")}
    usable = batch.where(F.coalesce(F.col("body"), F.lit("")) != "")
    both = stored.alias("s").join(usable.alias("n"), F.col("s.id") == F.col("n.id"), "full_outer")
    fresh = o["id"].isNull()
    worse = F.lit(False) if complete else identity.poorer(o["body"], n["body"])
    takes = n["id"].isNotNull() & (fresh | ((o["body"] != n["body"]) & ~worse))
    role = F.when(n["role"].isin("assistant", "unknown"), "assistant").otherwise("user")
    return both.select(
        F.coalesce(o["id"], n["id"]).alias("id"),
        F.coalesce(o["conversation_id"], n["conversation_id"]).alias("conversation_id"),
        F.when(takes, role).otherwise(o["role"]).alias("role"),
        F.when(takes, n["body"]).otherwise(o["body"]).alias("body"),
        F.coalesce(o["captured_ms"], F.lit(now_ms)).cast("bigint").alias("captured_ms"),
        F.coalesce(o["capture_index"], n["capture_index"]).alias("capture_index"),
        F.coalesce(F.nullif(o["turn_id"], F.lit("")), F.when(takes, F.nullif(n["turn_id"], F.lit("")))).alias("turn_id"),
        F.when(takes, F.when(fresh, "new").otherwise("rewritten")).otherwise("none").alias("change"),
    )


def fragments(batch: DataFrame, stored: DataFrame, windows: DataFrame) -> DataFrame:
    """Batch rows that are the opening of a stored turn with the same role and turn id.

    ``windows``: conversation_id, page_count. Only windows shorter than what is stored count.
    """
    totals = stored.groupBy("conversation_id").agg(F.count("*").alias("total"))
    short = windows.join(totals, "conversation_id").where("total > page_count and page_count > 0").select("conversation_id")
    fresh = batch.join(stored.select("id"), "id", "left_anti").join(short, "conversation_id", "left_semi")
    fresh = fresh.withColumn("needle", F.trim("body")).where(F.length("needle") >= 12)
    bodies = stored.where(F.coalesce(F.col("turn_id"), F.lit("")) != "").select("conversation_id", "role", "turn_id", F.col("body").alias("whole"))
    same = ["conversation_id", "role", "turn_id"]
    hit = [fresh[c] == bodies[c] for c in same] + [F.startswith(bodies["whole"], fresh["needle"]), F.length(bodies["whole"]) > F.length(fresh["needle"])]
    return fresh.join(bodies, hit, "left_semi").select("id")


def remove_conversations(ids: DataFrame, now_ms: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the removed conversations, with their tombstones added.

    ``tables`` may hold headers, messages, postings, page_order, images, tombstones.
    """
    gone = ids.select("conversation_id").distinct()
    out = {}
    for name, frame in tables.items():
        if name == "headers":
            out[name] = frame.join(gone.withColumnRenamed("conversation_id", "id"), "id", "left_anti")
        elif name == "tombstones":
            stones = gone.withColumn("removed_ms", F.lit(now_ms).cast("bigint"))
            out[name] = frame.join(gone, "conversation_id", "left_anti").unionByName(stones)
        else:
            out[name] = frame.join(gone, "conversation_id", "left_anti")
    return out


def site_deleted(headers: DataFrame, verdicts: DataFrame, now_ms: int) -> DataFrame:
    """Archive as deleted on the site, or restore the archive source held before.

    ``verdicts``: id, deleted. Only a source the site itself gave (``chatgpt:…``) is kept.
    """
    both = headers.join(verdicts, "id", "left")
    marked = F.coalesce(F.col("archive_source") == "site-deleted", F.lit(False))
    deleting, restoring = F.coalesce("deleted", F.lit(False)), F.coalesce(~F.col("deleted"), F.lit(False)) & marked
    earlier, none = F.col("prev_archive_source"), F.lit(None)
    held = F.coalesce(F.col("archived"), F.lit(False)) & F.coalesce(F.col("archive_source").startswith("chatgpt:"), F.lit(False))
    changed = ("archived", "archive_source", "archived_ms", "prev_archive_source")
    return both.select(
        *[c for c in headers.columns if c not in changed],
        F.when(deleting, True).when(restoring, earlier.isNotNull()).otherwise(F.col("archived")).alias("archived"),
        F.when(deleting, "site-deleted").when(restoring, earlier).otherwise(F.col("archive_source")).alias("archive_source"),
        F.when(deleting & ~marked, F.lit(now_ms).cast("bigint")).when(restoring & earlier.isNull(), none).otherwise(F.col("archived_ms")).alias("archived_ms"),
        F.when(deleting & held, F.col("archive_source")).when(restoring, none).otherwise(earlier).alias("prev_archive_source"),
    )


def restore(headers: DataFrame, ids: DataFrame) -> DataFrame:
    """Manual restore: archived rows of ``ids`` become active, everything else stays."""
    both = headers.join(ids.select("id").distinct().withColumn("wanted", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("wanted"), F.lit(False)) & F.coalesce(F.col("archived"), F.lit(False))
    clear = lambda c: F.when(~hit, F.col(c)).alias(c)
    return both.select(
        *[clear(c) if c in ("archive_source", "archived_ms", "prev_archive_source") else F.when(hit, False).otherwise(F.col(c)).alias(c) if c == "archived" else F.col(c) for c in headers.columns]
    )
