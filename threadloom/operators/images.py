"""Image metadata tables: normalising, upserting, moving, listing. Bytes stay in their own table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import chunk_of, ordinals

# --- fixed values -----------------------------------------------------------------
MAX_EDGE, MIN_EDGE = 512, 48
PLACEHOLDERS = ["uncached", "oversized", "timeout", "not-loaded", "cleared"]
MIMES = ["image/jpeg", "image/webp"]
DECORATION = r"avatar|profile|logo|emoji|\bicon\b|artifact"
NAMES = ["user", "assistant", "chatgpt", "claude", "grok", "gemini"]
PICTURE_URL = r"(?i)blob:[^\s)]+|data:image/[^\s)]+"
WEB_URL = r"(?i)https?://\S+"
PICTURE_LINK = r"(?i)https?://\S*(?:\.(?:png|jpe?g|gif|webp|svg|avif|bmp)(?:[?#]\S*)?(?:\s|$)|oaiusercontent\S*|googleusercontent\S*|ggpht\.com\S*)"
# ----------------------------------------------------------------------------------


def scrub(text: Column, drop_links: bool, limit: int | None = None) -> Column:
    """Alt or prompt without picture addresses."""
    cut = tx.flatten_spaces(text)
    cut = cut if limit is None else F.substring(cut, 1, limit)
    bare = F.regexp_replace(F.regexp_replace(cut, PICTURE_URL, ""), WEB_URL if drop_links else PICTURE_LINK, " ")
    return tx.flatten_spaces(bare)


def normalise_images(raw: DataFrame, per_message: int | None = None, max_bytes: int | None = None, chars: int | None = None) -> DataFrame:
    """Valid records; everything else is dropped. Limits apply only where a caller gives them."""
    own = F.startswith(F.col("message_id"), F.concat(F.col("conversation_id"), F.lit(":")))
    placed = (F.col("idx") >= 0) & (F.lit(True) if per_message is None else F.col("idx") < per_message)
    cached = (F.col("status") == "cached") & (F.col("bytes") >= 1) & (F.lit(True) if max_bytes is None else F.col("bytes") <= max_bytes) & F.col("mime").isin(MIMES)
    side = lambda c: F.when(cached, F.least(F.greatest(F.coalesce(F.round(c), F.lit(0)), F.lit(0)), F.lit(MAX_EDGE))).otherwise(0).cast("int").alias(c)
    return raw.where(own & placed & (cached | F.col("status").isin(PLACEHOLDERS))).select(
        "message_id", "idx", "conversation_id", "status",
        scrub(F.col("alt"), True, chars).alias("alt"), scrub(F.col("prompt"), False, chars).alias("prompt"),
        F.greatest(F.coalesce("off", F.lit(0)), F.lit(0)).cast("bigint").alias("off"),
        F.when(cached, F.col("bytes")).otherwise(0).cast("int").alias("bytes"),
        F.when(cached, F.col("mime")).otherwise("").alias("mime"), side("width"), side("height"),
        *[c for c in raw.columns if c == "arrival"],
    )


def upsert_images(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Last record per slot wins; ``delta`` is the change of cached bytes it causes."""
    keys = ["message_id", "idx"]
    fields = [c for c in stored.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*fields), "arrival").alias("n"))
    both = stored.select(*keys, F.struct(*fields).alias("o")).join(last, keys, "full_outer")
    row = F.coalesce("n", "o")
    delta = F.when(F.col("n").isNotNull(), F.coalesce(F.col("n.bytes"), F.lit(0)) - F.coalesce(F.col("o.bytes"), F.lit(0))).otherwise(0)
    return both.select(*keys, *[row[c].alias(c) for c in fields], delta.cast("bigint").alias("delta"))


def clear_images(images: DataFrame) -> DataFrame:
    """Bytes go, slots stay; rows that hold no bytes are untouched."""
    hit = (F.col("status") != "cleared") & ((F.col("status") == "cached") | (F.coalesce("bytes", F.lit(0)) > 0))
    zero = lambda c: F.when(hit, 0).otherwise(F.col(c)).cast("int").alias(c)
    changed = {"status": F.when(hit, "cleared").otherwise(F.col("status")).alias("status"), "mime": F.when(hit, "").otherwise(F.col("mime")).alias("mime"), **{c: zero(c) for c in ("bytes", "width", "height")}}
    return images.select(*[changed.get(c, F.col(c)) for c in images.columns])


def image_bytes(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """Bytes by (message, index), only of cached rows that really have some."""
    held = blobs.where(F.length("blob") > 0)
    return images.where(F.col("status") == "cached").select("message_id", "idx", "mime").join(held, ["message_id", "idx"])


def usage(images: DataFrame) -> DataFrame:
    """Cached bytes (never below zero) and outcome counts."""
    counted = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("cached", *PLACEHOLDERS)]
    return images.agg(F.greatest(F.sum(F.col("bytes").cast("bigint")), F.lit(0)).alias("bytes"), F.count("*").alias("detected"), *counted)


def image_cards(images: DataFrame, headers: DataFrame, page_order: DataFrame) -> DataFrame:
    """Cards with their header and the place of their message; rank is null when unknown."""
    heads = headers.select(F.col("id").alias("conversation_id"), "platform", "title", "updated_ms")
    ranks = page_order.groupBy("conversation_id", "message_id").agg(F.min("pos").alias("message_rank"))
    return images.join(heads, "conversation_id", "left").join(ranks, ["conversation_id", "message_id"], "left")


def filter_cards(cards: DataFrame, platform: str = "", placeholders: bool = False) -> DataFrame:
    keep = (F.col("status") == "cached") & (F.col("bytes") > 0)
    if placeholders:
        keep = keep | F.col("status").isin(PLACEHOLDERS)
    rows = cards.where(F.coalesce(keep, F.lit(False)))
    return rows.where(F.col("platform") == platform) if platform else rows


def card_order() -> list[Column]:
    """Newest conversation first, then page order, offset and index."""
    rank = F.coalesce("message_rank", F.lit(1000000000))
    return [F.coalesce("updated_ms", F.lit(0)).desc(), F.col("conversation_id").asc(), rank.asc(), F.coalesce("off", F.lit(0)).asc(), F.col("idx").asc(), F.col("message_id").asc()]


def content_images(found: DataFrame, per_message: int | None = None) -> DataFrame:
    """Content pictures of a page: no decoration, long enough once loaded, one per source; ``per_message`` keeps the first ones.

    ``found``: message_id, pos, src_hash, classes, alt, loaded, width, height.
    """
    marks = F.lower(F.coalesce("classes", F.lit("")))
    named = F.lower(F.trim(F.coalesce("alt", F.lit("")))).isin(NAMES)
    large = ~F.col("loaded") | (F.least("width", "height") > 0) & (F.greatest("width", "height") >= MIN_EDGE)
    rows = found.where(~marks.rlike(DECORATION) & ~named & large)
    first = rows.groupBy("message_id", "src_hash").agg(F.min("pos").alias("pos"))
    numbered = ordinals(first, ["message_id"], ["pos"], chunk_of("pos"), "nth")
    return numbered if per_message is None else numbered.where(F.col("nth") <= per_message)


def move_images(images: DataFrame, folds: DataFrame) -> DataFrame:
    """Images of folded turns on the turn that stays: message_id, keep_id, idx, new_idx.

    ``folds``: drop_id, keep_id. Movers come in order of their turn and number. A mover keeps its
    number if neither the kept turn nor an earlier mover has it, and else takes the lowest number
    that is free and was not given out before. All pictures of one turn meet in one short array.
    """
    pair = F.struct("message_id", F.col("idx").cast("int").alias("idx"))
    moved = images.join(folds.select(F.col("drop_id").alias("message_id"), "keep_id"), "message_id").groupBy("keep_id").agg(F.sort_array(F.collect_set(pair)).alias("movers"))
    own = images.join(folds.select(F.col("keep_id").alias("message_id")).distinct(), "message_id", "left_semi").groupBy(F.col("message_id").alias("keep_id")).agg(F.collect_set(F.col("idx").cast("int")).alias("own"))
    rows = moved.join(own, "keep_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))

    def place(state, mover):
        met = F.array_contains(state["taken"], mover["idx"])
        free = F.filter(F.sequence(state["next"], state["next"] + F.size(state["taken"])), lambda i: ~F.array_contains(state["taken"], i))[0]
        slot = F.when(met, free).otherwise(mover["idx"])
        return F.struct(
            F.array_append(state["taken"], slot).alias("taken"), F.when(met, free + 1).otherwise(state["next"]).alias("next"), F.array_append(state["slots"], slot).alias("slots"))

    start = F.struct(F.col("own").alias("taken"), F.lit(0).alias("next"), F.array().cast("array<int>").alias("slots"))
    slots = F.aggregate("movers", start, place, lambda state: state["slots"])
    placed = rows.select("keep_id", F.explode(F.arrays_zip("movers", slots.alias("slots"))).alias("x"))
    return placed.select(F.col("x.movers.message_id").alias("message_id"), "keep_id", F.col("x.movers.idx").alias("idx"), F.col("x.slots").alias("new_idx"))


def move_blobs(blobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Blobs (message_id, idx, ...) under the turn and number that ``move_images`` gave them; others stay."""
    found = blobs.join(moves, ["message_id", "idx"], "left")
    return found.withColumns({"message_id": F.coalesce("keep_id", "message_id"), "idx": F.coalesce("new_idx", "idx")}).select(*blobs.columns)

