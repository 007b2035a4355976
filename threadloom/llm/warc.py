"""Fixity audit of WARC replicas by Merkle trees.

Pages are records of WARC archives: a header and the page, laid out one after another, so each record has an offset. A record's
leaf is the SHA-256 of its bytes. Leaves are grouped into ranges of ``FANOUT`` neighbouring record numbers, whose node is the
SHA-256 of the members' numbers, offsets within the range and hashes in offset order; ranges are grouped again up to one root for
each archive. Ranges follow record numbers, not ranks, so a lost record changes its own ranges only.

An audit compares the roots of two replicas, then only the nodes under roots that differ, and so down to the records. Each level is
a join on (archive, range), whose rows are the mismatching branches of the level above and nothing else.

Built from grouped aggregates over groups of ``FANOUT`` and window sums inside an archive; nothing is collected.

Defined results: a null page is an empty one; a null url is written as ``-``; records with a null number are numbered by a hash of
their url; several records of one number stand after each other in url order and are compared as one leaf list; an archive that only
one replica has is reported record by record; equal replicas give no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FANOUT = 16
#: Record numbers in an archive: three levels of ranges.
ARCHIVE = FANOUT**3


def record_bytes(id_col: str, url_col: str, html_col: str) -> Column:
    """A page as the bytes of a WARC resource record."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("-")), F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records in archive order with their bytes: archive, number, url, offset, length, hash, record."""
    raw = pages.select(F.coalesce(F.col(id_col).cast("long"), F.pmod(F.xxhash64(url_col), F.lit(1 << 40))).alias("number"), F.col(url_col).alias("url"), record_bytes(id_col, url_col, html_col).alias("record"))
    return _laid_out(raw.withColumn("length", F.octet_length("record").cast("long")).withColumn("hash", F.sha2("record", 256)))


def _laid_out(raw: DataFrame) -> DataFrame:
    placed = raw.withColumn("archive", F.floor(F.col("number") / ARCHIVE))
    order = Window.partitionBy("archive").orderBy("number", "url", "hash").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``records`` without their bytes: only hashes and lengths are shuffled."""
    raw = pages.select(F.coalesce(F.col(id_col).cast("long"), F.pmod(F.xxhash64(url_col), F.lit(1 << 40))).alias("number"), F.col(url_col).alias("url"), record_bytes(id_col, url_col, html_col).alias("record"))
    return _laid_out(raw.select("number", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash")))


def tree(found: DataFrame) -> list[DataFrame]:
    """Levels of (archive, range, hash) from single record numbers (level 0) to the root (the last)."""
    part = F.sort_array(F.collect_list(F.struct("offset", "hash", "length")))
    level = found.groupBy("archive", F.col("number").alias("range")).agg(F.sha2(F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["hash"], x["length"].cast("string"))), ","), 256).alias("hash"))
    levels = [cut_lineage(level)]
    for _ in range(3):
        part = F.sort_array(F.collect_list(F.struct("range", "hash")))
        up = levels[-1].groupBy("archive", F.floor(F.col("range") / FANOUT).alias("up")).agg(F.sha2(F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["range"].cast("string"), x["hash"])), ","), 256).alias("hash"))
        levels.append(cut_lineage(up.withColumnRenamed("up", "range")))
    return levels


def _differ(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.withColumnRenamed("hash", "a"), right.withColumnRenamed("hash", "b")
    return a.join(b, ["archive", "range"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def mismatches(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """Record numbers whose leaves differ: archive, range, a, b (null where a replica lacks the record)."""
    found = cut_lineage(_differ(left[-1], right[-1]))
    for a, b in zip(left[-2::-1], right[-2::-1]):
        parents = found.select("archive", F.col("range").alias("up"))
        below = lambda level: level.withColumn("up", F.floor(F.col("range") / FANOUT)).join(parents, ["archive", "up"], "left_semi").drop("up")  # noqa: E731, B023
        found = cut_lineage(_differ(below(a), below(b)))
    return found


def audit(left: DataFrame, right: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Corrupted records of ``right`` against ``left``: archive, number, fault, and where the record lies in each replica."""
    a, b = (cut_lineage(leaves(x, id_col, url_col, html_col)) for x in (left, right))
    found = mismatches(tree(a), tree(b)).withColumn("fault", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")).select("archive", F.col("range").alias("number"), "fault")
    for name, side in (("left", a), ("right", b)):
        place = side.groupBy("archive", "number").agg(F.min("offset").alias(f"{name}_offset"), F.sum("length").alias(f"{name}_length"))
        found = found.join(place, ["archive", "number"], "left")
    return found


def damaged(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A second replica with faults to find: by number, every 89th page is cut, every 97th lost and every 101st has one byte more."""
    number = F.col(id_col)
    half = F.substring(F.col(html_col), 1, F.floor(F.length(html_col) / 2).cast("int"))
    out = pages.where(~F.coalesce(number % 97 == 5, F.lit(False)))
    return out.withColumn(html_col, F.when(number % 89 == 3, half).when(number % 101 == 7, F.concat(html_col, F.lit("x"))).otherwise(F.col(html_col)))


ORACLE = f"""
WITH replica AS (
  SELECT 'left' AS side, page_id, url, coalesce(html, '') AS html FROM pages
  UNION ALL
  SELECT 'right', page_id, url, CASE WHEN page_id % 89 = 3 THEN substr(coalesce(html, ''), 1, length(html) // 2) WHEN page_id % 101 = 7 THEN html || 'x' ELSE coalesce(html, '') END
  FROM pages WHERE page_id % 97 <> 5
), raw AS (
  SELECT side, page_id, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '-') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10)
    || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM replica
), leaves AS (
  SELECT side, page_id // {ARCHIVE} AS archive, page_id AS number, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS hash,
    coalesce(CAST(sum(strlen(record)) OVER (PARTITION BY side, page_id // {ARCHIVE} ORDER BY page_id, url, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS offs
  FROM raw
), grouped AS (
  SELECT side, archive, number, list(hash ORDER BY offs) AS hashes, min(offs) AS offs, CAST(sum(length) AS BIGINT) AS length FROM leaves GROUP BY ALL
), a AS (SELECT * FROM grouped WHERE side = 'left'), b AS (SELECT * FROM grouped WHERE side = 'right')
SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.number, b.number) AS number,
  CASE WHEN b.number IS NULL THEN 'missing' WHEN a.number IS NULL THEN 'extra' ELSE 'altered' END AS fault,
  a.offs AS left_offset, a.length AS left_length, b.offs AS right_offset, b.length AS right_length
FROM a FULL JOIN b ON a.archive = b.archive AND a.number = b.number
WHERE a.hashes IS DISTINCT FROM b.hashes
"""
