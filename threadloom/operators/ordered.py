"""Running values over ordered groups that may be larger than one task.

A group (one conversation, one list) can hold a large share of all rows. It is cut into
chunks along its order: windows run inside a chunk, one short row per chunk is carried
along the group, and the two are put together. No task ever sees a whole group of rows,
and the rows are shuffled once, by (group, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_of(position: Column | str, size: int = CHUNK) -> Column:
    """Chunk number of an integer position; it must never decrease along the order."""
    value = F.col(position) if isinstance(position, str) else position
    return F.floor(F.coalesce(value, F.lit(0)) / size).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, **specs) -> DataFrame:
    """Add running columns; each spec is ``name=(kind, value, side)``.

    ``kind``: ``near`` (closest non-null value), ``max`` or ``sum``. ``side``: ``before`` or
    ``after`` the row, the row itself never included.
    """
    rows = df.withColumn("_chunk", chunk)
    at = F.struct(*order)
    totals = []
    for name, (kind, value, side) in specs.items():
        if kind == "near":
            pick = F.max_by if side == "before" else F.min_by
            total = pick(value, F.when(value.isNotNull(), at))
        else:
            total = F.max(value) if kind == "max" else F.sum(value)
        totals.append(total.alias(f"_t_{name}"))
    summary = rows.groupBy(*keys, "_chunk").agg(*totals)
    up = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, (kind, _, side) in specs.items():
        total, frame = F.col(f"_t_{name}"), up if side == "before" else down
        fold = F.last(total, True) if kind == "near" else F.max(total) if kind == "max" else F.sum(total)
        carried.append(fold.over(frame).alias(f"_g_{name}"))
    rows = rows.join(summary.select(*keys, "_chunk", *carried), [*keys, "_chunk"])
    near = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    added = []
    for name, (kind, value, side) in specs.items():
        frame, given = near if side == "before" else back, F.col(f"_g_{name}")
        if kind == "near":
            added.append(F.coalesce(F.last(value, True).over(frame), given).alias(name))
        elif kind == "max":
            added.append(F.greatest(F.max(value).over(frame), given).alias(name))
        else:
            added.append((F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.coalesce(given, F.lit(0))).alias(name))
    return rows.select(*df.columns, *added)


def ordinals(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "ord") -> DataFrame:
    """1-based position of every row within its group."""
    numbered = running(df, keys, order, chunk, _n=("sum", F.lit(1).cast("bigint"), "before"))
    return numbered.withColumn(name, F.col("_n") + 1).drop("_n")
