"""Small helpers shared by the operators: columns computed from texts, held-out folds, bounded samples."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lexer


#: Documents in an Arrow batch: at ten kilobytes a text, ten megabytes on both sides of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than the default of 10,000, which whole texts and sets would swell; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has the remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def append(docs: DataFrame, text_col: str, fn: Callable[[lexer.Chunk], dict[str, np.ndarray]], fields: dict[str, str]) -> DataFrame:
    """``docs`` with columns that ``fn`` makes from chunks of whole texts; columns of the same names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in fields))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join(f"{k} {v}" for k, v in fields.items())
    names, types = [*docs.columns, *fields], {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in lexer.chunks(batch.column(at)):
                made = fn(chunk)
                own = [pa.array(made[k], types[v]) for k, v in fields.items()]
                yield pa.RecordBatch.from_arrays([*batch.slice(chunk.first, len(chunk)).columns, *own], names=names)

    return docs.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, held: int, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled rows outside the held-out fold, half of each label where there are enough.

    The rows are the first by a hash of their id. ``rows`` bounds what is broadcast and what a fit sees.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    usable = usable.where(fold_of("__id", folds) != held).distinct()
    order = F.xxhash64("__id", F.lit(7))
    chosen = usable.where("__y = 1").orderBy(order, "__id").limit(rows // 2).unionByName(usable.where("__y = 0").orderBy(order, "__id").limit(rows // 2))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", F.col("__y").alias("y"))


def base_rate(labels: DataFrame, label: str, folds: int, held: int) -> float:
    """Share of label 1 among the usable labels, kept inside (0, 1)."""
    row = labels.where(F.col(label).isin(0, 1) & (fold_of("doc_id", folds) != held)).agg(F.sum(F.col(label)).alias("a"), F.count(F.lit(1)).alias("n")).first()
    return ((row["a"] or 0) + 0.5) / (row["n"] + 1.0)


def free_prefix(docs: DataFrame) -> str:
    """A beginning of names that no column of ``docs`` has, in any case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def like(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``frame``, which has more."""
    return frame.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


#: Rows of a side that may be broadcast once they have been counted; ids and pairs take under 50 bytes each.
BROADCAST_ROWS = 100_000


def small_side(rows: DataFrame) -> DataFrame:
    """``rows``, materialised; marked for broadcast if counting shows at most ``BROADCAST_ROWS``, else joined by shuffle."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle and checkpoint files of frames that nothing refers to any more.

    The cleaner acts when the driver collects its garbage, which a driver with spare memory seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
