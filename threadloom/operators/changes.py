"""Effects of folds, removals and image writes on every stored table.

A fold replaces one turn by another: (conversation_id, drop_id, keep_id). A kept turn is never dropped itself. Every
table is changed by an equi-join with the folds or the removed ids; those of one conversation may be many, so nothing
is broadcast by hint and no conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import identity, images, upsert


def fold_headers(headers: DataFrame, messages: DataFrame, folds: DataFrame) -> DataFrame:
    """Headers of conversations with folds: turns recounted, tail led to the kept turn, preview of that turn.

    The preview changes only if the tail was dropped and the kept turn says something that is no status. Times stay.
    """
    folded = folds.select(F.col("conversation_id").alias("id")).distinct()
    left = identity.apply_folds(messages, folds).groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    counts = folded.join(left, "id", "left").select("id", F.coalesce("_n", F.lit(0)).alias("_n"))
    tails = headers.select("id", F.col("tail_message_id").alias("drop_id")).join(folds.select("drop_id", "keep_id"), "drop_id")
    kept = messages.select(F.col("id").alias("keep_id"), "role", "body")
    tails = tails.join(kept, "keep_id", "left").select("id", F.col("keep_id").alias("_tail"), F.when((F.trim("body") != "") & ~identity.is_progress(F.col("body")), F.struct(tx.preview_source("body").alias("p"), "role")).alias("_said"))
    both = headers.join(counts, "id", "left").join(tails, "id", "left")
    now = {
        "message_count": F.coalesce("_n", "message_count"), "tail_message_id": F.coalesce("_tail", "tail_message_id"),
        "last_preview": F.coalesce("_said.p", "last_preview"), "last_preview_role": F.coalesce("_said.role", "last_preview_role"),
    }
    return both.select(*(now[c].alias(c) if c in now else c for c in headers.columns))


def fold_images(stored: DataFrame, moves: DataFrame) -> DataFrame:
    """Image rows under the turn and number of ``moves``; a moved row starts its turn (offset 0), others stay."""
    found = stored.join(moves, ["message_id", "idx"], "left")
    off = F.when(F.col("keep_id").isNotNull(), 0).otherwise(F.col("off")).cast(stored.schema["off"].dataType)
    return found.withColumns({"message_id": F.coalesce("keep_id", "message_id"), "idx": F.coalesce("new_idx", "idx"), "off": off}).select(*stored.columns)


def apply_fold_plan(tables: dict[str, DataFrame], folds: DataFrame) -> dict[str, DataFrame]:
    """Every given table after the folds: headers, messages, postings, page_order, images, blobs.

    ``messages`` must be given with ``headers``, ``images`` with ``blobs``. Postings and order rows of dropped turns go;
    images of dropped turns move to the kept one on free numbers, their bytes with them.
    """
    out = dict(tables)
    dropped = folds.select("conversation_id", "drop_id")
    if "images" in tables:
        moves = images.move_images(tables["images"], folds)
        out["images"] = fold_images(tables["images"], moves)
        if "blobs" in tables:
            out["blobs"] = images.move_blobs(tables["blobs"], moves)
    if "headers" in tables:
        out["headers"] = fold_headers(tables["headers"], tables["messages"], folds)
    if "messages" in tables:
        out["messages"] = identity.apply_folds(tables["messages"], folds)
    for name, column in (("postings", "source"), ("page_order", "message_id")):
        if name in tables:
            out[name] = tables[name].join(dropped.withColumnRenamed("drop_id", column), ["conversation_id", column], "left_anti")
    return out


def freed_bytes(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: images of the removed conversations and the cached bytes that go with them."""
    gone = stored.join(ids.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum(F.col("bytes").cast("bigint")), F.lit(0)).alias("bytes"))


def remove_conversations(tables: dict[str, DataFrame], ids: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """``upsert.remove_conversations`` with image bytes: blobs go with their images, and ``freed`` counts both."""
    plain = {name: frame for name, frame in tables.items() if name != "blobs"}
    out = upsert.remove_conversations(ids, now_ms, plain)
    if "images" in tables:
        out["freed"] = freed_bytes(tables["images"], ids)
        if "blobs" in tables:
            gone = tables["images"].join(ids.select("conversation_id").distinct(), "conversation_id", "left_semi")
            out["blobs"] = tables["blobs"].join(gone.select("message_id", "idx").distinct(), ["message_id", "idx"], "left_anti")
    return out


def write_blobs(blobs: DataFrame, batch: DataFrame) -> DataFrame:
    """Blobs (message_id, idx, blob) after a batch of normalised image records with ``arrival`` and ``blob``.

    The last record of a slot decides: its bytes stay if it is cached and has some, and else the slot has none.
    """
    keys = ["message_id", "idx"]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct("status", "blob"), "arrival").alias("n"))
    fresh = last.where((F.col("n.status") == "cached") & (F.length("n.blob") > 0)).select(*keys, F.col("n.blob").alias("blob"))
    return blobs.select(*keys, "blob").join(last.select(*keys), keys, "left_anti").unionByName(fresh)
