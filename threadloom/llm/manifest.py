"""Merkle manifest of a dataset as a persistent tree: tampered leaves make versions that copy only their ancestors.

Leaves are hashes of rows. Per source they ascend by id; every ``ARITY`` consecutive nodes become the hash of their
digests until one is left, the subroot; the subroots in order of their sources likewise give the root.

*Places.* A leaf's place in its source is its place in a range partition of (source, id, leaf, row) plus the counts of the
partitions before. So a source that has a third of all rows lies in many partitions.

*Aligned blocks.* ``ARITY ** LEVELS`` leaves whose places begin at a multiple of that number are a subtree; one group of a
grouped job builds it and passes its top on. The tops are the leaves of the next pass, until every source has one node.

*Versions.* A version of a block shares all nodes of its levels but the ancestors of one leaf, which are copied with new
digests. Above its block it goes on through the upper levels: passes run back from the root and give each block the
digests beside its ancestors up to the root, so a leaf's task needs its block and one row more, however large the tree is.

Defined results: a null field is ``-``, so null and empty text differ; null sources come first, null ids first in their
source (their remainder is that of the empty text); rows of one id ascend by leaf, and equal rows each are a leaf; a single
leaf is its subroot, a single subroot the root, and a leaf without siblings at all has the hash of nothing as proof. No
rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rows

ARITY = 3
#: Levels of a block: 243 leaves.
LEVELS = 5
#: Fields of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(_field(v) for v in values)).cast("binary"), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """grp (orders sources, null first), row, doc_id, leaf, and ``changed``: the leaf after tampering, which deletes newlines where ``tampered`` holds."""
    values = {c: F.col(f"`{c}`") for c in FIELDS}
    own = _digest(list(values.values()))
    broken = _digest([F.translate(v, "\n", "") if c == "text" else v for c, v in values.items()])
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    source = values["source"].cast("string")
    return docs.select(
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source)).alias("grp"), F.monotonically_increasing_id().alias("row"), values["doc_id"].cast("long").alias("doc_id"),
        own.alias("leaf"), F.when(hit, broken).alias("changed"),
    )


def placed(frame: DataFrame, order: list[str]) -> DataFrame:
    """``frame`` (materialised) with ``pos``, its place by ``order`` (unique) in its ``grp``, and ``n``, the rows of the group."""
    names = frame.columns
    at = names.index("grp")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            grp = batch.column(at)
            if not len(grp):
                continue
            new = np.append(grp[0].as_py() != last, pc.not_equal(grp.slice(1), grp.slice(0, len(grp) - 1)).to_numpy(zero_copy_only=False)).astype(bool)
            index = np.arange(len(grp))
            # A group that began in an earlier batch goes on from its count.
            first = np.maximum.accumulate(np.where(new, index, -carried))
            own = index - first
            last, carried = grp[len(grp) - 1].as_py(), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(grp), part), pa.int32()), pa.array(own, pa.int64())], names=[*names, "part", "own"])

    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = ", ".join(f"{c} {t}" for c, t in frame.dtypes)
    numbered = cut_lineage(dealt.mapInArrow(count, f"{schema}, part int, own long"))
    # One row for each partition that a group touches.
    sizes = numbered.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("grp")
    sizes = sizes.select("grp", "part", (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    return numbered.join(rows.small_side(sizes), ["grp", "part"]).select(*names, (F.col("before") + F.col("own")).alias("pos"), "n")


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Block:
    """An aligned subtree: its levels of digests, shared by all versions."""

    def __init__(self, digests: list[str], levels: int) -> None:
        self.levels = [digests]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([_hash("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])

    def beside(self, place: int) -> list[tuple[str, str]]:
        """Digests left and right of the leaf at ``place`` and of its ancestors below the top."""
        out = []
        for level in self.levels[:-1]:
            low = place - place % ARITY
            out.append(("".join(level[low:place]), "".join(level[place + 1 : low + ARITY])))
            place //= ARITY
        return out


def copied(digest: str, beside: list[tuple[str, str]]) -> list[str]:
    """The nodes of a version: the new leaf and the copies of its ancestors; every other node is shared."""
    out = [digest]
    for left, right in beside:
        out.append(_hash(left + out[-1] + right))
    return out


def _packed(beside: list[tuple[str, str]]) -> bytes:
    return b"".join(bytes([len(a) // HEX, len(b) // HEX]) + bytes.fromhex(a + b) for a, b in beside)


def _unpacked(raw: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(raw):
        a, b = raw[at], raw[at + 1]
        digests = raw[at + 2 : at + 2 + (a + b) * HEX // 2].hex()
        out.append((digests[: a * HEX], digests[a * HEX :]))
        at += 2 + (a + b) * HEX // 2
    return out


def _block_of(part: pa.Table, levels: int) -> Block:
    """The block of a group's rows, which are sorted by place."""
    return Block([d.hex() for d in part.column("digest").to_pylist()], min(levels, depth(part.column("n")[0].as_py())))


def _tops(levels: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        top = _block_of(part, levels).levels[-1][0]
        n = -(-part.column("n")[0].as_py() // ARITY**levels)
        return pa.table({"grp": part.column("grp").slice(0, 1), "pos": pa.array([part.column("block")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "digest": pa.array([bytes.fromhex(top)], pa.binary())})

    return run


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels).cast("long"))


def passes(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` (grp, pos, n, digest) and the tops of their blocks, pass by pass, until every group has one node."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most:
        out.append(cut_lineage(_with_block(out[-1].select("grp", "pos", "n", "digest"), levels).groupBy("grp", "block").applyInArrow(_tops(levels), "grp string, pos long, n long, digest binary")))
        most = -(-most // ARITY**levels) if most > ARITY**levels else 0
    return out


_BESIDE = "grp string, pos long, beside binary, subroot binary, root binary"


def _paths(levels: int):
    """Each node's digests up to the root: those of its block, then those of the block's top."""

    def run(part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        block, upper = _block_of(part, levels), above.column("beside")[0].as_py()
        n = part.num_rows
        same = [pa.array([above.column(c)[0].as_py()] * n, pa.binary()) for c in ("subroot", "root")]
        return pa.table([part.column("grp"), part.column("pos"), pa.array([_packed(block.beside(i)) + upper for i in range(n)], pa.binary()), *same], names=["grp", "pos", "beside", "subroot", "root"])

    return run


def _down(nodes: DataFrame, above: DataFrame, levels: int, fn, schema: str) -> DataFrame:
    """``fn`` for each block of ``nodes`` with the row of its top in ``above``."""
    left = _with_block(nodes, levels).groupBy("grp", "block")
    return left.cogroup(above.withColumn("block", F.col("pos")).groupBy("grp", "block")).applyInArrow(fn, schema)


def _above(placed_leaves: DataFrame, levels: int) -> DataFrame:
    """For each leaf block the digests beside its ancestors, the subroot of its source and the root."""
    by_source = passes(placed_leaves.withColumnRenamed("leaf", "digest"), levels)
    tops = by_source[-1].select("grp", "digest")
    named = cut_lineage(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"))
    ranked = cut_lineage(placed(named, ["name"]))
    sources = passes(ranked, levels)
    found = sources[-1].select("grp", "pos", F.lit(b"").alias("beside"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(sources[:-1]):
        found = _down(nodes.select("grp", "pos", "n", "digest"), found, levels, _paths(levels), _BESIDE)
    # From here on groups are sources, and what stood at a place of the upper tree stands at the source's only node.
    found = ranked.select("pos", "name", "digest").join(found.drop("grp", "subroot"), "pos")
    found = cut_lineage(found.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "beside", F.col("digest").alias("subroot"), "root"))
    for nodes in reversed(by_source[1:-1]):
        found = _down(nodes.select("grp", "pos", "n", "digest"), found, levels, _paths(levels), _BESIDE)
    return found


_CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_COPIES = "doc_id long, grp string, pos long, level int, digest string"


def _checked(levels: int):
    def run(part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        block, upper = _block_of(part, levels), _unpacked(above.column("beside")[0].as_py())
        rest = "".join(a + b for a, b in upper)
        subroot, root = above.column("subroot")[0].as_py().hex(), above.column("root")[0].as_py().hex()
        proofs, roots = [], []
        for i, changed in enumerate(part.column("changed").to_pylist()):
            own = block.beside(i)
            proofs.append(_hash("".join(a + b for a, b in own) + rest))
            roots.append(copied(changed.hex() if changed else block.levels[0][i], own + upper)[-1])
        n = len(proofs)
        return pa.table([part.column("doc_id"), pa.array(block.levels[0]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])], names=[x.split()[0] for x in _CHECKED.split(", ")])

    return run


def _copies(levels: int):
    def run(part: pa.Table, above: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        block, upper = _block_of(part, levels), _unpacked(above.column("beside")[0].as_py())
        out = []
        grp = part.column("grp")[0].as_py()
        for i, (doc, pos, changed) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "pos", "changed")))):
            if changed:
                out += [(doc, grp, pos, level, digest) for level, digest in enumerate(copied(changed.hex(), block.beside(i) + upper))]
        doc, grps, pos, level, digest = zip(*out) if out else [()] * 5
        return pa.table([pa.array(doc, pa.int64()), pa.array(grps, pa.string()), pa.array(pos, pa.int64()), pa.array(level, pa.int32()), pa.array(digest, pa.string())], names=[x.split()[0] for x in _COPIES.split(", ")])

    return run


def _settled(docs: DataFrame, tampered: Column | None, levels: int, fn, schema: str) -> DataFrame:
    found = cut_lineage(placed(cut_lineage(leaves(docs, tampered)), ["doc_id", "leaf", "row"]))
    return _down(found.withColumnRenamed("leaf", "digest").drop("row"), _above(found.drop("row", "changed", "doc_id"), levels), levels, fn, schema)


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row a document: its leaf, subroot, root, the hash of its proof, and the root that its version folds to."""
    return _settled(docs, tampered, levels, _checked(levels), _CHECKED)


def versions(docs: DataFrame, tampered: Column, levels: int = LEVELS) -> DataFrame:
    """The copied nodes of each tampered leaf's version, from the leaf (level 0) to the new root; ``grp`` and ``pos`` name the leaf."""
    return _settled(docs, tampered, levels, _copies(levels), _COPIES)


ORACLE = """
WITH RECURSIVE raw AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS grp, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ord(c) AS BIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), leafed AS (
  SELECT doc_id, grp, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) END AS changed
  FROM raw
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leafed
), tree AS (
  SELECT grp, 0 AS level, pos, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, p, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, pos // 3 AS p, count(*) OVER (PARTITION BY grp) AS c FROM tree) WHERE c > 1 GROUP BY grp, level, p
), tops AS (
  SELECT grp, arg_max(h, level) AS subroot, max(level) AS top FROM tree GROUP BY grp
), placed AS (
  SELECT *, row_number() OVER (ORDER BY grp) - 1 AS pos FROM tops
), upper_tree AS (
  SELECT 0 AS level, pos, subroot AS h FROM placed
  UNION ALL
  SELECT level + 1, p, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, pos // 3 AS p, count(*) OVER () AS c FROM upper_tree) WHERE c > 1 GROUP BY level, p
), root AS (
  SELECT arg_max(h, level) AS root, max(level) AS top FROM upper_tree
), sides AS (
  SELECT grp, level, pos,
    coalesce(string_agg(h, '') OVER (PARTITION BY grp, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (PARTITION BY grp, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT grp, level, pos, h FROM tree UNION ALL SELECT NULL, level, pos, h FROM upper_tree)
), folded AS (
  SELECT x.grp, x.pos AS leaf_pos, 0 AS level, x.pos, coalesce(changed, leaf) AS h, '' AS beside FROM leaves x
  UNION ALL
  SELECT f.grp, f.leaf_pos, f.level + 1, f.pos // 3, sha256(l || f.h || r), f.beside || l || r
  FROM folded f JOIN tops t ON f.grp = t.grp AND f.level < t.top JOIN sides s ON s.grp = f.grp AND s.level = f.level AND s.pos = f.pos
), risen AS (
  SELECT f.grp, f.leaf_pos, 0 AS level, p.pos, f.h, f.beside FROM folded f JOIN placed p ON f.grp = p.grp AND f.level = p.top
  UNION ALL
  SELECT f.grp, f.leaf_pos, f.level + 1, f.pos // 3, sha256(l || f.h || r), f.beside || l || r
  FROM risen f JOIN root t ON f.level < t.top JOIN sides s ON s.grp IS NULL AND s.level = f.level AND s.pos = f.pos
)
SELECT x.doc_id, x.leaf, t.subroot, root.root, sha256(f.beside) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM leaves x JOIN tops t USING (grp) CROSS JOIN root JOIN risen f ON f.grp = x.grp AND f.leaf_pos = x.pos AND f.level = root.top
"""
