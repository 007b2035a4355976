"""Order of turns: capture order, page order, and merging the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunk_of, ordinals, running

NO_INDEX = 2**31 - 1
CHUNK_MS = 4096 * 60000


def message_order(messages: DataFrame, page_order: DataFrame) -> DataFrame:
    """(conversation_id, id, pos): capture order, known ids in page order within their own slots."""
    base = messages.select(
        "conversation_id", "id",
        F.coalesce("captured_ms", F.lit(0)).alias("at"),
        F.coalesce("capture_index", F.lit(NO_INDEX)).alias("idx"),
    )
    base = ordinals(base, ["conversation_id"], ["at", "idx", "id"], chunk_of("at", CHUNK_MS), "slot").select("conversation_id", "id", "slot")
    known = base.join(page_order.select("conversation_id", F.col("message_id").alias("id"), F.col("pos").alias("page_pos")), ["conversation_id", "id"])
    slots = ordinals(known, ["conversation_id"], ["slot"], chunk_of("slot"), "k").select("conversation_id", "k", "slot")
    movers = ordinals(known, ["conversation_id"], ["page_pos"], chunk_of("page_pos"), "k").select("conversation_id", "k", "id")
    moved = movers.join(slots, ["conversation_id", "k"]).select("conversation_id", "id", F.col("slot").alias("given"))
    placed = base.join(moved, ["conversation_id", "id"], "left")
    return placed.select("conversation_id", "id", F.coalesce("given", "slot").alias("pos"))


def merge_page_order(stored: DataFrame, page: DataFrame) -> DataFrame:
    """Stored head, then the page from the first shared id, then the rest of the stored order.

    Both inputs: conversation_id, pos, message_id. Without a shared id the page follows.
    """
    keys = ["conversation_id", "message_id"]
    old = stored.groupBy(*keys).agg(F.min("pos").alias("old_pos"))
    new = page.groupBy(*keys).agg(F.min("pos").alias("new_pos"))
    both = old.join(new, keys, "full_outer")
    shared = F.col("old_pos").isNotNull() & F.col("new_pos").isNotNull()
    anchor = both.where(shared).groupBy("conversation_id").agg(F.min_by("old_pos", "new_pos").alias("anchor"))
    rows = both.join(anchor, "conversation_id", "left")
    head = F.col("old_pos") < F.col("anchor")
    group = (
        F.when(F.col("anchor").isNull(), F.when(F.col("old_pos").isNotNull(), 0).otherwise(2))
        .when(head, 0)
        .when(F.col("new_pos").isNotNull(), 1)
        .otherwise(2)
    )
    index = F.when((group == 1) | F.col("old_pos").isNull(), F.col("new_pos")).otherwise(F.col("old_pos"))
    rows = rows.select(*keys, group.alias("part"), index.alias("idx"))
    chunk = F.col("part").cast("bigint") * 2**40 + chunk_of("idx")
    return ordinals(rows, ["conversation_id"], ["part", "idx", "message_id"], chunk, "pos").select("conversation_id", "pos", "message_id")


def fill_roles(turns: DataFrame) -> DataFrame:
    """Unknown roles alternate from the last known turn, else follow the parity of the index.

    ``turns``: conversation_id, idx (from 0), role.
    """
    known = F.when(F.col("role").isin("user", "assistant"), F.struct(F.col("idx").alias("at"), F.col("role").alias("as_role")))
    rows = running(turns, ["conversation_id"], ["idx"], chunk_of("idx"), seen=("near", known, "before"))
    gap = F.col("idx") - F.col("seen.at")
    other = F.when(F.col("seen.as_role") == "user", "assistant").otherwise("user")
    guess = F.when(gap % 2 == 1, other).otherwise(F.col("seen.as_role"))
    parity = F.when(F.col("idx") % 2 == 0, "user").otherwise("assistant")
    filled = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise(F.coalesce(guess, parity))
    return rows.withColumn("role", filled).drop("seen")


def distinct_ids(turns: DataFrame) -> DataFrame:
    """Repeated ids of a page get ``#2``, ``#3`` in page order (conversation_id, idx, id)."""
    rows = ordinals(turns, ["conversation_id", "id"], ["idx"], chunk_of("idx"), "nth")
    named = F.when(F.col("nth") > 1, F.concat(F.col("id"), F.lit("#"), F.col("nth").cast("string"))).otherwise(F.col("id"))
    return rows.withColumn("id", named).drop("nth")


def carry_headings(rows: DataFrame) -> DataFrame:
    """List rows under their section heading; pinned rows leave the numbering.

    ``rows``: list_id, line, heading (null on conversation rows), item, pinned heading text 'Pinned'.
    """
    held = running(rows, ["list_id"], ["line"], chunk_of("line"), section=("near", F.col("heading"), "before"))
    items = held.where(F.col("heading").isNull())
    pinned = F.coalesce(F.lower("section") == "pinned", F.lit(False))
    kept = ordinals(items.where(~pinned), ["list_id"], ["line"], chunk_of("line"), "slot")
    return kept.select("list_id", "line", "item", "section", (F.col("slot") - 1).alias("list_index"))
