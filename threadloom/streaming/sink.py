"""Idempotent keyed upserts from a stream, copy-on-write by conversation bucket.

A batch rewrites only the buckets it touches, into a folder of its own, and then publishes
a manifest that names the current folder of every bucket. A batch that runs again after a
failure rewrites the same folder from the same earlier manifest, so nothing doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert
from ..sources.model import MESSAGE_SCHEMA

BUCKETS = 64


class MessageTable:
    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _manifest(self, batch_id: int) -> dict[int, int]:
        """Current folder per bucket after ``batch_id``: at most one entry per bucket."""
        if batch_id < 0:
            return {}
        frame = self.spark.read.schema("bucket INT, version BIGINT").json(f"{self.base}/manifest/batch={batch_id}")
        return {r.bucket: r.version for r in frame.collect()}

    def _read(self, folders: dict[int, int]) -> DataFrame:
        paths = [f"{self.base}/data/version={v}/bucket={b}" for b, v in sorted(folders.items())]
        if not paths:
            return self.spark.createDataFrame([], MESSAGE_SCHEMA)
        return self.spark.read.schema(MESSAGE_SCHEMA).parquet(*paths)

    def read(self, batch_id: int) -> DataFrame:
        """The table as it is after ``batch_id``."""
        return self._read(self._manifest(batch_id))

    def apply(self, batch: DataFrame, batch_id: int, now_ms: int, tombstones: DataFrame | None = None) -> None:
        """``foreachBatch`` body. ``batch``: message columns, one latest row per id kept."""
        if tombstones is not None:
            batch = batch.join(tombstones.select("conversation_id"), "conversation_id", "left_anti")
        latest = F.max_by(F.struct("conversation_id", "role", "body", "capture_index", "turn_id"), F.struct("at_ms", "capture_index"))
        rows = batch.groupBy("id").agg(latest.alias("r")).select("id", "r.*")
        bucket = F.pmod(F.xxhash64("conversation_id"), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]
            before = self._manifest(batch_id - 1)
            stored = self._read({b: v for b, v in before.items() if b in touched})
            after = upsert.upsert_messages(stored, rows.drop("bucket"), now_ms).drop("change")
            (
                after.withColumn("bucket", bucket)
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/data/version={batch_id}")
            )
            now = {**before, **{b: batch_id for b in touched}}
            entries = self.spark.createDataFrame(sorted(now.items()), "bucket INT, version BIGINT")
            entries.coalesce(1).write.mode("overwrite").json(f"{self.base}/manifest/batch={batch_id}")
        finally:
            rows.unpersist()
