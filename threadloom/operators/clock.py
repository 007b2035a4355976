"""Activity clocks: normalising, merging, interpolating along a list, labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import DAY_MS, MIN_PAGE_MS
from .ordered import chunk_of, running
from .sorting import valid_ms

HIGH = ["page-exact", "observed"]
ANCHOR = [*HIGH, "page-bucket"]


def page_ms(value: Column, now_ms: int) -> Column:
    """Epoch milliseconds in the plausible range; seconds are scaled, anything else is null."""
    top = now_ms + 366 * DAY_MS
    scaled = F.when((value >= 1000000000) & (value < 100000000000), value * 1000)
    return F.when(value.between(MIN_PAGE_MS, top), value).when(scaled.between(MIN_PAGE_MS, top), scaled)


def clock_class(source: Column) -> Column:
    return F.when(source.isin(HIGH), 2).when(source == "page-bucket", 1).otherwise(0)


def merge_clock(ms: Column, source: Column, arrival: Column, now_ms: int) -> Column:
    """Aggregate: the clock after all observations as struct(ms, source).

    Exact and observed times form one tier above coarse ones; within a tier the newest
    wins, and on equal times the later arrival names the source. The result does not
    depend on the order in which rows are folded.
    """
    shown = page_ms(ms, now_ms)
    at = F.when(shown > now_ms, F.lit(now_ms).cast("bigint")).otherwise(shown)
    usable = at.isNotNull() & (clock_class(source) > 0)
    best = F.max_by(
        F.struct(at.alias("ms"), source.alias("source")), F.when(usable, F.struct(clock_class(source).alias("c"), at.alias("m"), arrival.alias("a")))
    )
    return F.coalesce(best, F.struct(F.lit(MIN_PAGE_MS + 1).cast("bigint").alias("ms"), F.lit("first-seen").alias("source")))


def merged_clocks(observations: DataFrame, now_ms: int) -> DataFrame:
    """``observations``: conversation_id, ms, source, arrival."""
    clock = merge_clock(F.col("ms"), F.col("source"), F.col("arrival"), now_ms)
    merged = observations.groupBy("conversation_id").agg(clock.alias("c"))
    return merged.select("conversation_id", F.col("c.ms").alias("updated_ms"), F.col("c.source").alias("updated_source"))


def list_estimates(items: DataFrame, now_ms: int) -> DataFrame:
    """Times for list rows without one, from the known times above and below them.

    ``items``: list_id, idx (0 = most recent), id, updated_ms, updated_source. Adds
    older_than_ms: the nearest exact time above that nothing below contradicts.
    """
    ms = F.col("updated_ms")
    rank = F.when(F.col("updated_source") == "sidebar-rank", 1).otherwise(0)
    valid = valid_ms("updated_ms", now_ms)
    anchor = valid & F.col("updated_source").isin(ANCHOR)
    anchor = F.coalesce(anchor, F.lit(False))
    exact = F.coalesce(valid & F.col("updated_source").isin(HIGH), F.lit(False))
    point = F.when(anchor, F.struct(F.col("idx").alias("i"), ms.alias("m")))
    sizes = items.groupBy("list_id").agg(F.count("*").alias("n"), F.bool_or(anchor).alias("anchored"))
    rows = running(
        items, ["list_id"], ["idx"], chunk_of("idx"),
        above=("near", point, "before"), below=("near", point, "after"), latest=("max", F.when(anchor, ms), "after"),
    )
    clock = F.when(exact & (ms >= F.coalesce(F.col("latest"), F.lit(-1))), ms)
    rows = running(rows.withColumn("clock", clock), ["list_id"], ["idx"], chunk_of("idx"), bound=("near", F.col("clock"), "before"))
    rows = rows.join(sizes, "list_id")
    i, up, down = F.col("idx"), F.col("above"), F.col("below")
    half_up = lambda x: F.floor(x + 0.5).cast("bigint")
    between = half_up(up["m"] - ((up["m"] - down["m"]) * (i - up["i"])).cast("double") / (down["i"] - up["i"]))
    high = F.greatest(up["m"], down["m"]) - 1
    low = F.least(up["m"], down["m"]) + 1
    between = F.when(high > low, F.least(high, F.greatest(low, between))).otherwise(between)
    gap = down["i"] - i
    room = F.greatest(F.lit(now_ms) - down["m"], down["i"])
    rising = half_up(down["m"] + room.cast("double") / (down["i"] + 1) * gap)
    rising = F.when(rising > now_ms, F.lit(now_ms) - i).otherwise(rising)
    rising = F.when(rising <= down["m"], F.least(F.lit(now_ms), down["m"] + gap)).otherwise(rising)
    falling = up["m"] - (i - up["i"]) * 3600000
    floor_ms = F.lit(MIN_PAGE_MS) + (F.col("n") - i) * 1000
    guess = F.when(up.isNotNull() & down.isNotNull(), between).when(down.isNotNull(), rising).otherwise(falling)
    guess = F.least(guess, F.lit(now_ms))
    guess = F.when(valid_ms(guess, now_ms), guess).otherwise(floor_ms)
    fixed = anchor | F.coalesce(F.col("updated_source").isin(ANCHOR), F.lit(False)) | (~F.col("anchored") & (rank > 0))
    estimated = ~fixed & F.col("anchored")
    return rows.select(
        "list_id", "idx", "id",
        F.when(fixed, ms).when(F.col("anchored"), guess).otherwise(floor_ms).cast("bigint").alias("updated_ms"),
        F.when(fixed, F.col("updated_source")).when(F.col("anchored"), "sidebar-rank").otherwise("first-seen").alias("updated_source"),
        F.when(estimated, F.col("bound")).alias("older_than_ms"),
    )


def activity_label(now_ms: int) -> list[Column]:
    """Columns kind, stamp_ms, unit and amount describing a header's activity time."""
    source = F.coalesce("updated_source", F.lit("legacy"))
    saved = F.coalesce(*[F.when(valid_ms(c, now_ms), F.col(c)) for c in ("first_seen_ms", "created_ms", "updated_ms")])
    exact, coarse = source.isin(HIGH), source == "page-bucket"
    before = (source == "sidebar-rank") & valid_ms("older_than_ms", now_ms)
    kind = F.when(exact, "exact").when(coarse, "approx").when(before, "before").otherwise("unknown")
    stamp = F.when(exact | coarse, F.when(valid_ms("updated_ms", now_ms), F.col("updated_ms"))).when(before, F.col("older_than_ms")).otherwise(saved)
    minutes = F.floor((F.lit(now_ms) - F.col("updated_ms")) / 60000)
    timed = exact & valid_ms("updated_ms", now_ms)
    unit = F.when(timed, F.when(minutes < 1, "now").when(minutes < 60, "minute").when(minutes < 2880, "hour").when(minutes < 10080, "day").otherwise("date"))
    amount = F.when(
        timed, F.when(minutes < 1, 0).when(minutes < 60, minutes).when(minutes < 2880, F.floor(minutes / 60)).when(minutes < 10080, F.floor(minutes / 1440))
    )
    return [kind.alias("kind"), stamp.cast("bigint").alias("stamp_ms"), unit.alias("unit"), amount.cast("bigint").alias("amount")]


def new_ending(pages: DataFrame, key) -> DataFrame:
    """Whether a page ends later than the stored tail.

    ``pages``: one row per conversation with baseline_count, baseline_tail, stored_body,
    tail_on_page, page_tail, ending (null when not carried), tail_changed, tail_seen.
    """
    stored, ending = key(F.col("stored_body")), key(F.coalesce("ending", F.lit("")))
    same = (ending == stored) | (F.startswith(stored, ending) & (F.length(ending) < F.length(stored)))
    has = F.col("ending").isNotNull()
    known = F.when(F.col("page_tail") == F.col("baseline_tail"), F.col("tail_changed")).when(~has, False).when((stored != "") & (ending != "") & same, False).otherwise(True)
    longer = F.startswith(ending, stored) & (F.length(ending) > F.length(stored))
    gone = F.when((stored == "") | ~has | (ending == "") | same, False).when(longer, True).otherwise(F.col("tail_seen"))
    verdict = F.when(F.col("baseline_count") <= 0, False).when(F.col("tail_on_page"), known).otherwise(gone)
    return pages.withColumn("new_ending", F.coalesce(verdict, F.lit(False)))


def tail_text_seen(stored: Column, page: Column, key) -> Column:
    """The page turn is the stored tail or a short trim of it."""
    a, b = key(stored), key(page)
    trim = F.startswith(a, b) & (F.length(b) >= F.least(F.length(a), F.lit(80))) & (F.length(b) >= F.length(a) * 0.8)
    return (a != "") & (b != "") & ((a == b) | trim)
