"""Keyed rules on streams: duplicate gates, throttles, evidence runs, baselines.

Every rule is a small step function over (state, row). Spark partitions the rows by key
and keeps the state; within one micro-batch the rows of a key are taken in event order.
Memory per key is one micro-batch slice of the columns a rule reads, never its history.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- fixed values -----------------------------------------------------------------
DUPLICATE_MS = 5000
BURST_MS = 800
GRACE_MS = 8000
HEARTBEAT_MS = 60000
VISIT_MS = 60000
EVIDENCE_GAP_MS, EVIDENCE_STEP_MS, EVIDENCE_COUNT = 6000, 1000, 3
EMPTY_LIMIT = 3
BASELINE_SLOTS = 1024
# ----------------------------------------------------------------------------------


def keyed_rule(rows: DataFrame, keys: list[str], step: Callable, out: str, state: str, ttl_ms: int | None = None) -> DataFrame:
    """Run ``step(state, row) -> (state, output tuple or None)`` per key in order of (at_ms, event_id).

    With ``ttl_ms`` the state of a key is dropped once the watermark is that far past its
    last row.
    """
    names = [part.split(" ")[0] for part in out.split(", ")]

    def run(key: tuple, chunks, store: GroupState):
        if store.hasTimedOut:
            store.remove()
            return
        held = tuple(store.get) if store.exists else None
        batch = pd.concat(list(chunks), ignore_index=True).sort_values(["at_ms", "event_id"], kind="stable")
        produced = []
        for row in batch.itertuples(index=False):
            held, made = step(held, row)
            if made is not None:
                produced.append(made)
        if held is None:
            if store.exists:
                store.remove()
        else:
            store.update(held)
            if ttl_ms is not None:
                last = int(batch["at_ms"].iloc[-1])
                store.setTimeoutTimestamp(max(last + ttl_ms, store.getCurrentWatermarkMs() + 1))
        if produced:
            yield pd.DataFrame(produced, columns=names)

    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, out, state, "append", timeout)


def _duplicate_step(held, row):
    if held is not None and held[0] != row.conversation and row.at_ms - held[1] < DUPLICATE_MS:
        return held, (row.event_id, True)
    return (row.conversation, row.at_ms), (row.event_id, False)


def duplicate_gate(captures: DataFrame) -> DataFrame:
    """Same body hash under another conversation within five seconds is held.

    ``captures``: event_id, at (watermarked), at_ms, body_hash, conversation.
    """
    return keyed_rule(captures, ["body_hash"], _duplicate_step, "event_id BIGINT, held BOOLEAN", "conversation BIGINT, at_ms BIGINT", DUPLICATE_MS)


def _owner_step(held, row):
    owners = list(held[0]) if held is not None else []
    if owners and row.conversation not in owners:
        return (owners,), (row.event_id, True)
    if row.conversation not in owners:
        owners = owners + [row.conversation]
    return (owners,), (row.event_id, False)


def ownership_gate(captures: DataFrame) -> DataFrame:
    """A transcript owned only by other conversations is held; ownership never expires."""
    return keyed_rule(captures, ["body_hash"], _owner_step, "event_id BIGINT, held BOOLEAN", "owners ARRAY<BIGINT>")


def collapse_bursts(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes less than 800 ms apart become one capture holding the last snapshot."""
    # Windows that only touch are merged, so the gap stops one microsecond short of 800 ms.
    burst = F.session_window("at", f"{BURST_MS * 1000 - 1} microseconds")
    return (
        changes.groupBy(burst, *keys)
        .agg(F.count("*").alias("changes"), F.max_by("value", F.struct("at_ms", "event_id")).alias("value"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))
        .drop("session_window")
    )


def _empty_step(held, row):
    if row.message_count > 0 or row.new_chat:
        return None, None
    first, told = (row.at_ms, False) if held is None else held
    if not told and row.at_ms - first >= GRACE_MS:
        return (first, True), (row.conversation, first, row.at_ms)
    return (first, told), None


def empty_alerts(probes: DataFrame) -> DataFrame:
    """One alert per run of empty observations lasting at least eight seconds.

    ``probes``: event_id, at_ms, conversation, message_count, new_chat.
    """
    return keyed_rule(probes, ["conversation"], _empty_step, "conversation BIGINT, since_ms BIGINT, at_ms BIGINT", "first_ms BIGINT, told BOOLEAN")


def _heartbeat_step(held, row):
    if held is None or held[0] != row.fingerprint or row.at_ms - held[1] >= HEARTBEAT_MS:
        return (row.fingerprint, row.at_ms), (row.event_id,)
    return held, None


def heartbeats(health: DataFrame) -> DataFrame:
    """Health rows to send: on a changed fingerprint, else at most once a minute."""
    return keyed_rule(health, ["platform"], _heartbeat_step, "event_id BIGINT", "fingerprint STRING, sent_ms BIGINT")


def visit_pairs(homes: DataFrame, visits: DataFrame) -> DataFrame:
    """Home observations with every visit of the same tab and origin in the minute before.

    ``homes``: home_id, home_at, tab, origin. ``visits``: visit_id, visit_at, tab_v, origin_v.
    Both sides carry watermarks, so the join keeps one minute of visits. The minute is part of its key, and a home
    observation asks for its own and the one before, so that a tab is not compared with its whole history in a batch.
    """
    minute = lambda at: F.floor(F.unix_millis(at) / VISIT_MS)
    homes = homes.withColumn("minute", F.explode(F.array(minute("home_at"), minute("home_at") - 1)))
    visits = visits.withColumn("minute_v", minute("visit_at"))
    same = (F.col("tab") == F.col("tab_v")) & (F.col("origin") == F.col("origin_v")) & (F.col("minute") == F.col("minute_v"))
    near = (F.col("home_at") >= F.col("visit_at")) & (F.col("home_at") <= F.col("visit_at") + F.expr(f"INTERVAL {VISIT_MS // 1000} SECONDS"))
    return homes.join(visits, same & near).drop("minute", "minute_v")


def latest_visit(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("home_id").agg(F.max_by("visit_id", F.struct("visit_at", "visit_id")).alias("visit_id"))


def _evidence_step(held, row):
    if row.blocked or row.hits <= 0:
        return None, None
    key = f"{row.conversation}|{row.url}"
    if held is None or held[0] != key or row.at_ms - held[2] > EVIDENCE_GAP_MS:
        held = (key, row.at_ms, row.at_ms, 1)
    elif row.at_ms - held[2] >= EVIDENCE_STEP_MS:
        held = (key, held[1], row.at_ms, held[3] + 1)
    proved = held[3] >= EVIDENCE_COUNT and row.at_ms - held[1] >= GRACE_MS
    return held, ((row.event_id, row.conversation) if proved else None)


def evidence_runs(probes: DataFrame) -> DataFrame:
    """Observations that complete the evidence: three a second apart, over eight seconds, no gap above six.

    ``probes``: event_id, at_ms, tab, conversation, url, hits, blocked.
    """
    return keyed_rule(probes, ["tab"], _evidence_step, "event_id BIGINT, conversation BIGINT", "key STRING, first_ms BIGINT, last_ms BIGINT, n INT")


def stream_clocks(observations: DataFrame, now_ms: int) -> DataFrame:
    """The activity clock as a streaming aggregate; late rows can never move it back."""
    from ..operators import clock

    return clock.merged_clocks(observations, now_ms)


def capture_baselines(chunks: DataFrame, slots: int = BASELINE_SLOTS) -> DataFrame:
    """The first row of a capture fixes tail and count for its later chunks.

    Captures are many and short, so they share ``slots`` keys of state: a slot keeps the baselines of its captures in
    arrays and a micro-batch settles all of them at once.
    """
    names, held = ["conversation", "capture"], ["conversation", "capture", "tail", "message_count"]
    types = dict(chunks.dtypes)

    def run(key: tuple, parts, store: GroupState):
        batch = pd.concat(list(parts), ignore_index=True).sort_values(["at_ms", "event_id"], kind="stable").astype({"message_count": "Int64"})
        first = batch.drop_duplicates(names)[held]
        if store.exists:
            known = pd.DataFrame(dict(zip(held, store.get))).astype(first.dtypes.to_dict())
            first = pd.concat([known, first], ignore_index=True).drop_duplicates(names)
        store.update(tuple([None if pd.isna(v) else v for v in first[c].tolist()] for c in held))
        made = batch[["event_id", *names]].merge(first, on=names)
        yield made[["event_id", "tail", "message_count"]].set_axis(["event_id", "baseline_tail", "baseline_count"], axis=1)

    slot = F.pmod(F.xxhash64(*names), F.lit(slots)).alias("slot")
    rows = chunks.select("event_id", "at_ms", *held, slot)
    state = ", ".join(f"{c} ARRAY<{types[c]}>" for c in held)
    return rows.groupBy("slot").applyInPandasWithState(
        run, "event_id BIGINT, baseline_tail STRING, baseline_count BIGINT", state, "append", GroupStateTimeout.NoTimeout
    )


def _streak_step(held, row):
    streak, stopped = held or (0, False)
    if stopped:
        return held, None
    streak = 0 if row.captured > 0 else streak + 1
    if streak >= EMPTY_LIMIT:
        return (streak, True), (row.run_id, row.event_id)
    return (streak, False), None


def failure_stops(results: DataFrame) -> DataFrame:
    """The event at which three empty results in a row stop a run."""
    return keyed_rule(results, ["run_id"], _streak_step, "run_id BIGINT, stopped_at BIGINT", "streak INT, stopped BOOLEAN")


def _settle_step(held, row):
    if row.progress:
        return (row.at_ms, (held[1] if held else 0) + 1), None
    return None, (row.event_id, row.turn_id, held[1] if held else 0)


def settled_turns(turns: DataFrame, ttl_ms: int = 3600000) -> DataFrame:
    """Status turns are withheld; the settled turn with the same id comes out with their number."""
    return keyed_rule(turns, ["turn_id"], _settle_step, "event_id BIGINT, turn_id STRING, withheld BIGINT", "last_ms BIGINT, n BIGINT", ttl_ms)
