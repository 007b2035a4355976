"""Stable list orders. Each returns ORDER BY columns; with ``limit`` they plan as a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import DAY_MS, MIN_PAGE_MS


def valid_ms(col: Column | str, now_ms: int) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.coalesce(value.between(MIN_PAGE_MS, now_ms + 366 * DAY_MS), F.lit(False))


def activity_tier(now_ms: int) -> Column:
    """0 exact, 1 coarse, 2 only an upper bound is known, 3 unknown."""
    source = F.col("updated_source")
    return (
        F.when(source.isin("page-exact", "observed"), 0)
        .when(source == "page-bucket", 1)
        .when((source == "sidebar-rank") & valid_ms("older_than_ms", now_ms), 2)
        .otherwise(3)
    )


def captured_ms(now_ms: int) -> Column:
    return F.coalesce(
        F.when(valid_ms("first_seen_ms", now_ms), F.col("first_seen_ms")),
        F.when(valid_ms("created_ms", now_ms), F.col("created_ms")),
        F.lit(0).cast("bigint"),
    )


def stored_count() -> Column:
    return F.greatest(F.coalesce("message_count", F.lit(0)), F.lit(0))


def title_key() -> Column:
    """Visible title under the Unicode collation, digit runs by value: their length, then their digits."""
    visible = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("platform_id"), F.lit(""))
    pieces = F.regexp_extract_all(visible, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(
        pieces, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(p, F.lit("0")))).otherwise(p)
    )
    return F.collate(F.array_join(padded, ""), "UNICODE")


def order_columns(field: str, direction: str, now_ms: int, id_col: str = "id") -> list[Column]:
    turn = (lambda c: c.asc()) if direction == "asc" else (lambda c: c.desc())
    updated = F.coalesce(F.col("updated_ms"), F.lit(0))
    keys = {
        "activity": [activity_tier(now_ms).asc(), turn(updated)],
        "title": [turn(title_key())],
        "captured": [turn(captured_ms(now_ms))],
        "count": [turn(stored_count())],
        "recent": [turn(updated)],
    }
    if field == "relevance":
        first = [turn(F.coalesce("relevance", F.lit(0.0))), updated.desc()]
    else:
        first = keys[field]
    return [*first, F.col(id_col).asc()]


def sorted_list(headers: DataFrame, field: str, direction: str, now_ms: int, limit: int = 80, id_col: str = "id") -> DataFrame:
    return headers.orderBy(*order_columns(field, direction, now_ms, id_col)).limit(limit)
