"""Alignment of a page with what is stored: parent chains, re-keyed turns, reused ids, chunks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx
from ..session import cut_lineage
from . import identity

HOT_PAIRS = 10000
BLOCK = 65536
CHUNK_MESSAGES, CHUNK_CHARS, ROW_CHARS = 20, 350000, 80


def ancestor_chain(nodes: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(conversation_id, node, depth) from each start up its parents, whole unless ``max_depth`` ends it.

    A loop ends where its conversation has no more nodes; it then has nodes more than once.

    Jumps double every round, so a chain of n nodes takes log2(n) rounds of equi-joins
    instead of n, and a conversation of any size is spread by node.
    ``nodes``: conversation_id, node, parent. ``starts``: conversation_id, node.
    """
    longest = nodes.groupBy("conversation_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    rounds = max(1, math.ceil(math.log2(longest + 1 if max_depth is None else min(longest + 1, max_depth))))
    jump = nodes.where(F.col("parent").isNotNull()).select("conversation_id", "node", "parent")
    reached = starts.select("conversation_id", "node", F.lit(0).cast("bigint").alias("depth"))
    for step in range(rounds):
        up = reached.join(jump, ["conversation_id", "node"]).select("conversation_id", F.col("parent").alias("node"), (F.col("depth") + 2**step).alias("depth"))
        reached = cut_lineage(reached.unionByName(up))
        if step + 1 < rounds:
            over = jump.select("conversation_id", F.col("node").alias("parent"), F.col("parent").alias("next"))
            jump = cut_lineage(jump.join(over, ["conversation_id", "parent"]).select("conversation_id", "node", F.col("next").alias("parent")))
    return reached if max_depth is None else reached.where(F.col("depth") < max_depth)


def proved_transcripts(tree: DataFrame, current: DataFrame, shown: DataFrame) -> DataFrame:
    """Conversations whose current branch reads exactly like the captured turns.

    ``tree``: conversation_id, node, parent, role, body. ``current``: conversation_id, node.
    ``shown``: conversation_id, idx (from 0), body.
    """
    keep = tree.select("conversation_id", "node", "parent", "role", F.md5(tx.flatten_spaces("body")).alias("h"), (tx.flatten_spaces("body") == "").alias("blank"))
    chain = ancestor_chain(tree.select("conversation_id", "node", "parent"), current).join(keep, ["conversation_id", "node"])
    ends = chain.groupBy("conversation_id").agg(
        F.count_if(F.col("parent").isNull()).alias("roots"), F.count("*").alias("n"), F.count_distinct("node").alias("distinct_nodes"))
    whole = ends.where("roots = 1 and n = distinct_nodes").select("conversation_id")
    said = chain.where(F.col("role").isin("user", "assistant") & ~F.col("blank")).join(whole, "conversation_id", "left_semi")
    from .ordered import chunk_of, ordinals

    said = said.withColumn("order", -F.col("depth"))
    said = ordinals(said, ["conversation_id"], ["order"], chunk_of("order"), "ord").select("conversation_id", (F.col("ord") - 1).alias("idx"), "h")
    seen = shown.select("conversation_id", "idx", F.md5(tx.flatten_spaces("body")).alias("shown_h"))
    both = said.join(seen, ["conversation_id", "idx"], "full_outer")
    same = F.bool_and(F.coalesce(F.col("h") == F.col("shown_h"), F.lit(False)))
    return both.groupBy("conversation_id").agg(same.alias("proved")).where("proved").select("conversation_id")


def _diagonals(rows: pd.DataFrame) -> pd.DataFrame:
    """Matching pairs per diagonal for one stamp that repeats often, by correlation.

    The rows are one block of stored positions and one block of page positions.
    """
    stored, page = rows[rows["side"] == "s"], rows[rows["side"] == "p"]
    if not len(stored) or not len(page):
        return pd.DataFrame({"conversation_id": [], "d": [], "pairs": [], "tail": []})
    low, base = int(stored["idx"].min()), int(page["idx"].max())
    reach = max(int(stored["idx"].max()) - low, base - int(page["idx"].min())) + 1

    def correlate(s: pd.DataFrame, p: pd.DataFrame) -> np.ndarray:
        size = 1 << (2 * reach).bit_length()
        a, b = np.zeros(size), np.zeros(size)
        a[s["idx"].to_numpy() - low] = 1
        b[base - p["idx"].to_numpy()] = 1
        return np.rint(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), size)).astype(np.int64)

    def same_turn(s: pd.DataFrame, p: pd.DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size, dtype=np.int64)
        both = s.groupby("turn_id")["idx"].apply(np.asarray).to_dict()
        for turn, at in p.groupby("turn_id")["idx"]:
            for place in both.get(turn, ()):
                np.add.at(out, place - low - at.to_numpy() + base, 1)
        return out

    total = correlate(stored, page)
    s_named, p_named = stored[stored["turn_id"] != ""], page[page["turn_id"] != ""]
    s_loose, p_loose = s_named[s_named["synthetic"]], p_named[p_named["synthetic"]]
    conflicts = correlate(s_named, p_named) - correlate(s_loose, p_loose)
    conflicts -= same_turn(s_named, p_named, len(total)) - same_turn(s_loose, p_loose, len(total))
    counts = total - conflicts
    found = np.nonzero(counts > 0)[0]
    last = stored[stored["idx"] == stored["last_idx"]]
    ends = pd.Series(dtype="int64")
    if len(last):
        row = last.iloc[0]
        loose = (page["turn_id"] == "") | (page["turn_id"] == row["turn_id"]) | (row["turn_id"] == "") | (page["synthetic"] & row["synthetic"])
        ends = row["idx"] - page.loc[loose, "idx"]
    offsets = found + low - base
    return pd.DataFrame({"conversation_id": rows["conversation_id"].iloc[0], "d": offsets, "pairs": counts[found], "tail": np.isin(offsets, ends.to_numpy())})


def rekeyed_turns(stored: DataFrame, page: DataFrame) -> DataFrame:
    """(conversation_id, page_id, stored_id) of turns that are the same under another id.

    ``stored`` and ``page``: conversation_id, idx (from 0), id, role, body, turn_id. Turns
    with equal role and wording are paired on the one diagonal with the best score (4 per
    pair, 2 for reaching the stored tail, the larger offset on ties). What is left at the
    same index is paired when one body grows or trims the other within the same turn id.
    Stamps that repeat often are counted by correlation of their positions, so their pairs
    are never written out.
    """
    shape = lambda f: f.select(
        "conversation_id", "idx", "id", "role", "body", F.coalesce("turn_id", F.lit("")).alias("turn_id"), F.col("id").rlike(identity.SYNTHETIC_ID).alias("synthetic"),
        F.md5(identity.turn_stamp(F.col("role"), F.col("body"))).alias("stamp"), (markup.turn_text("body") == "").alias("blank"))
    # Read many times, so written once without their bodies, which only the last join needs.
    s, p = (cut_lineage(shape(f).drop("body")) for f in (stored, page))
    known = s.select("conversation_id", "id").join(p.select("conversation_id", "id"), ["conversation_id", "id"], "left_semi")
    s_free, p_free = s.join(known, ["conversation_id", "id"], "left_anti"), p.join(known, ["conversation_id", "id"], "left_anti")
    lasts = s.groupBy("conversation_id").agg(F.max("idx").alias("last_idx"))
    thin = ["conversation_id", "stamp", "idx", "turn_id", "synthetic"]
    a = s_free.where("not blank").select(*thin).join(lasts, "conversation_id")
    b = p_free.where("not blank").select(*thin)
    sizes = a.groupBy("conversation_id", "stamp").agg(F.count("*").alias("n_s")).join(b.groupBy("conversation_id", "stamp").agg(F.count("*").alias("n_p")), ["conversation_id", "stamp"])
    hot = sizes.where(F.col("n_s") * F.col("n_p") > HOT_PAIRS).select("conversation_id", "stamp")
    cold = sizes.where(F.col("n_s") * F.col("n_p") <= HOT_PAIRS).select("conversation_id", "stamp")
    clash = lambda x, y: (x["turn_id"] != "") & (y["turn_id"] != "") & (x["turn_id"] != y["turn_id"]) & ~(x["synthetic"] & y["synthetic"])
    x, y = a.join(cold, ["conversation_id", "stamp"], "left_semi").alias("x"), b.alias("y")
    pairs = x.join(y, (F.col("x.conversation_id") == F.col("y.conversation_id")) & (F.col("x.stamp") == F.col("y.stamp")))
    xs, ys = {c: F.col(f"x.{c}") for c in thin}, {c: F.col(f"y.{c}") for c in thin}
    counted = pairs.where(~clash(xs, ys)).groupBy(F.col("x.conversation_id").alias("conversation_id"), (F.col("x.idx") - F.col("y.idx")).alias("d")).agg(
        F.count("*").alias("pairs"), F.bool_or(F.col("x.idx") == F.col("x.last_idx")).alias("tail"))
    # Positions are cut into blocks and every pair of blocks is one bounded group.
    block = F.floor(F.col("idx") / BLOCK)
    hot_a = a.join(hot, ["conversation_id", "stamp"], "left_semi").withColumn("s_block", block)
    hot_b = b.join(hot, ["conversation_id", "stamp"], "left_semi").withColumn("p_block", block)
    s_blocks = hot_a.select("conversation_id", "stamp", "s_block").distinct()
    p_blocks = hot_b.select("conversation_id", "stamp", "p_block").distinct()
    s_rows = hot_a.join(p_blocks, ["conversation_id", "stamp"]).withColumn("side", F.lit("s"))
    p_rows = hot_b.join(s_blocks, ["conversation_id", "stamp"]).withColumn("side", F.lit("p")).withColumn("last_idx", F.lit(-1).cast("bigint"))
    packed = s_rows.unionByName(p_rows)
    dense = packed.groupBy("conversation_id", "stamp", "s_block", "p_block").applyInPandas(_diagonals, "conversation_id STRING, d BIGINT, pairs BIGINT, tail BOOLEAN")
    scores = counted.unionByName(dense).groupBy("conversation_id", "d").agg(F.sum("pairs").alias("pairs"), F.bool_or("tail").alias("tail"))
    score = F.col("pairs") * 4 + F.when(F.col("tail"), 2).otherwise(0)
    best = scores.groupBy("conversation_id").agg(F.max_by("d", F.struct(score, F.col("d"))).alias("d"))

    sx = s_free.select(*[F.col(c).alias(f"s_{c}") for c in s_free.columns])
    moved = p_free.join(best, "conversation_id").withColumn("want", F.col("idx") + F.col("d"))
    sides = {c: F.col(f"s_{c}") for c in thin}, {c: F.col(c) for c in thin}
    on = (F.col("conversation_id") == F.col("s_conversation_id")) & (F.col("want") == F.col("s_idx")) & (F.col("stamp") == F.col("s_stamp")) & ~F.col("blank")
    aligned = moved.join(sx, on).where(~clash(*sides)).select("conversation_id", F.col("id").alias("page_id"), F.col("s_id").alias("stored_id"))

    done = aligned.select("conversation_id", F.col("page_id").alias("id"))
    used = aligned.select("conversation_id", F.col("stored_id").alias("id"))
    texts = lambda f, gone: f.where("turn_id <> ''").select("conversation_id", "idx", "id", "role", "body", "turn_id").join(known.unionByName(gone), ["conversation_id", "id"], "left_anti")
    rest_p, rest_s = texts(page, done), texts(stored, used)
    rest_s = rest_s.select(*[F.col(c).alias(f"s_{c}") for c in rest_s.columns])
    at = (F.col("conversation_id") == F.col("s_conversation_id")) & (F.col("idx") == F.col("s_idx")) & (identity.canonical_role(F.col("role")) == identity.canonical_role(F.col("s_role")))
    same = F.col("turn_id") == F.col("s_turn_id")
    grown = identity.grows(F.col("s_body"), F.col("body")) | identity.shrinks(F.col("s_body"), F.col("body"))
    followed = rest_p.join(rest_s, at).where(same & grown).select("conversation_id", F.col("id").alias("page_id"), F.col("s_id").alias("stored_id"))
    return aligned.unionByName(followed)


def reused_ids(captures: DataFrame) -> DataFrame:
    """Ids of a capture with earlier synthetic ids kept where the window did not move.

    ``captures``: conversation_id, capture_no, position, id, role. A position keeps the id
    of the previous capture when both windows have one size, the role is the same and some
    position kept its id by itself.
    """
    sizes = captures.groupBy("conversation_id", "capture_no").agg(F.count("*").alias("size"))
    rows = captures.join(sizes, ["conversation_id", "capture_no"])
    before = rows.select("conversation_id", (F.col("capture_no") + 1).alias("capture_no"), "position", F.col("id").alias("old_id"), F.col("role").alias("old_role"), F.col("size").alias("old_size"))
    both = rows.join(before, ["conversation_id", "capture_no", "position"], "left")
    anchors = both.where("id = old_id and size = old_size").select("conversation_id", "capture_no").distinct().withColumn("anchored", F.lit(True))
    both = both.join(anchors, ["conversation_id", "capture_no"], "left")
    keeps = F.col("anchored") & (F.col("role") == F.col("old_role")) & (F.col("size") == F.col("old_size")) & F.col("old_id").rlike(identity.SYNTHETIC_ID) & F.col("id").rlike(identity.SYNTHETIC_ID)
    return both.select("conversation_id", "capture_no", "position", F.when(F.coalesce(keeps, F.lit(False)), F.col("old_id")).otherwise(F.col("id")).alias("id"))


def send_chunks(messages: DataFrame) -> DataFrame:
    """Greedy chunks of at most 20 messages and 350 000 characters, in order.

    ``messages``: conversation_id, idx, body. Only ids and lengths pass through Python; rows
    arrive sorted and are read as a stream, so a task holds one Arrow batch at a time.
    """
    thin = messages.select("conversation_id", "idx", (F.length("body") + ROW_CHARS).cast("bigint").alias("size"))
    ready = thin.repartition("conversation_id").sortWithinPartitions("conversation_id", "idx")

    def number(batches):
        current, chunk, count, size = None, 0, 0, 0
        for batch in batches:
            out = []
            for conversation, n in zip(batch["conversation_id"], batch["size"]):
                if conversation != current:
                    current, chunk, count, size = conversation, 0, 0, 0
                elif count >= CHUNK_MESSAGES or size + n > CHUNK_CHARS:
                    chunk, count, size = chunk + 1, 0, 0
                count, size = count + 1, size + n
                out.append(chunk)
            yield batch[["conversation_id", "idx"]].assign(chunk=out)

    return ready.mapInPandas(number, "conversation_id STRING, idx BIGINT, chunk BIGINT")


def next_previews(headers: DataFrame, page: DataFrame) -> DataFrame:
    """First prompt and last turn of a header after a page was captured.

    ``headers``: conversation_id, first_id, first_preview, last_preview, last_role.
    ``page``: conversation_id, idx (from 0), id, role, body, fresh. Short excerpts are cut
    before aggregation, so only they travel.
    """
    rows = page.select("conversation_id", "idx", "id", "role", "fresh", tx.preview_source("body").alias("p"), (F.trim("body") != "").alias("some"))
    prompt = F.when(F.col("some") & ~F.col("role").isin("assistant", "system", "tool"), F.col("idx"))
    seen = rows.join(headers.select("conversation_id", "first_id"), "conversation_id", "left")
    stored = F.when(F.col("id") == F.col("first_id"), F.col("idx"))
    found = seen.groupBy("conversation_id").agg(
        F.min_by(F.struct("id", "p", "fresh", "idx"), prompt).alias("top"),
        F.min(stored).alias("at"), F.min_by("p", F.when(stored.isNotNull() & prompt.isNotNull(), stored)).alias("again"),
        F.max_by(F.struct("p", "role", "some"), "idx").alias("tail"),
    )
    both = headers.join(found, "conversation_id", "left")
    base = F.coalesce("again", "first_preview", F.lit(""))
    takes = F.col("top").isNotNull() & (
        (base == "") | (F.coalesce("first_id", F.lit("")) == "") | F.coalesce(F.col("top.idx") < F.col("at"), F.lit(False))
        | (F.col("at").isNull() & (F.col("top.idx") == 0) & F.col("top.fresh")))
    ends = F.coalesce(F.col("tail.some"), F.lit(False))
    return both.select(
        "conversation_id",
        F.when(takes, F.col("top.id")).otherwise(F.col("first_id")).alias("first_id"), F.when(takes, F.col("top.p")).otherwise(base).alias("first_preview"),
        F.when(ends, F.col("tail.p")).otherwise(F.col("last_preview")).alias("last_preview"),
        F.when(ends, F.when(F.col("tail.role") == "assistant", "assistant").otherwise("user")).otherwise(F.col("last_role")).alias("last_role"),
    )
