"""Exact self-join of word-shingle sets at a Jaccard threshold, with set-relation skipping.

Two documents link when ``10 * |x & y| >= 8 * |x | y|`` on their sets of 5-word shingles. The join
returns one row per document with its set size and the smallest id reachable by links.

1. *Equal sets* fall together by a 128-bit digest; one representative of each goes on.
2. *Prefixes.* Shingles are ordered by a bounded count sketch (rare first), then by key. Any order gives
   right results; this one keeps passages that many documents share out of the prefixes. Two sets that
   link share a shingle among their first ``n - ceil(0.8 n) + 1``.
3. *Index lists.* One list per prefix shingle. Lists whose sketched length is bounded by ``HOT_LIST`` are
   built in one window; longer ones by a pre-aggregated head and a join that Spark may split.
4. *Answers from a similar set.* Each set is attached to one list head and compared with it. Sets that link with
   their head make a star: no pair inside it needs to be looked at again. Sets that do not are probed against all
   sets of the same head in blocks, inside tasks, where a counter over a local index gives all answers of a set at
   once; a block returns only the links that connect something.
5. *What is left.* Pairs under different heads. Lists that hold several components give pairs across them. A list is cut into blocks by
   set size; a probe visits the blocks that its size admits. A pair goes on only if it shares as many prefix
   shingles as the places of the rest leave necessary. Such pairs are first compared between star heads: if those link, all pairs between their components are answered; if
   not, ``|x & y| <= |hx & hy| + |x \\ hx| + |y \\ hy|`` answers most without reading the sets, and the rest
   are compared in full.

Comparisons move sets to (head, salt) and stream over sorted rows, so a head with any number of partners
is spread over many tasks. No pair list of a group of copies is ever written out.

Defined results: a null or wordless text has an empty set and links with nothing; where ids repeat
every text is linked for itself and an id joins the components of all its texts; a null ``doc_id`` takes no part and has a null
component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lexer
from .rows import free_prefix, release, small_batches, small_side

SKETCH_BITS = 20
#: Shingles counted into the sketch at a time.
SKETCH_KEYS = 1 << 20
#: Lists whose counted bound is above this go through the path that splits hot keys.
HOT_LIST = 8192
#: Partners of one head that share a task's group.
PER_SALT = 512
#: Shingles in a chunk of the sets under one head.
PER_CHUNK = 1 << 20


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """ceil(0.8 n)."""
    return (4 * n + 4) // 5


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    waiting: list[np.ndarray] = []

    def count() -> None:
        sketch[:] += np.bincount(np.concatenate(waiting), minlength=len(sketch)).astype(np.uint32)
        waiting.clear()

    for batch in batches:
        ids = batch.column(0)
        for chunk in lexer.chunks(batch.column(1)):
            doc, keys, bounds = lexer.shingle_sets(chunk)
            waiting.append((keys >> lexer.U64(64 - SKETCH_BITS)).astype(np.int32))
            if sum(map(len, waiting)) >= SKETCH_KEYS:
                count()
            a, b = (lexer.sums(lexer.mix(keys ^ lexer.U64(salt)), bounds) for salt in (0x1234567, 0x89ABCDEF01))
            n = np.diff(bounds)
            yield pa.record_batch({
                "doc_id": ids.slice(chunk.first, len(chunk)), "n": pa.array(n, pa.int64()), "d1": pa.array(a.view(np.int64)), "d2": pa.array(b.view(np.int64)),
                "block": pa.nulls(len(chunk), pa.int32()), "counts": pa.nulls(len(chunk), pa.binary()),
            })
    if waiting:
        count()
    blocks = sketch.reshape(-1, 4096)
    yield pa.record_batch({
        "doc_id": pa.nulls(len(blocks), pa.int64()), "n": pa.nulls(len(blocks), pa.int64()), "d1": pa.nulls(len(blocks), pa.int64()), "d2": pa.nulls(len(blocks), pa.int64()),
        "block": pa.array(np.arange(len(blocks)), pa.int32()), "counts": pa.array([x.tobytes() for x in blocks], pa.binary()),
    })


def _add_blocks(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in rows.column("counts"))
    # Only the magnitude matters for the order: a byte for each counter.
    classes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "classes": pa.array([classes.tobytes()], pa.binary())})


def _prefixes(classes) -> object:
    hot = int(np.ceil(np.log2(HOT_LIST))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            for chunk in lexer.chunks(batch.column(1)):
                doc, keys, bounds = lexer.shingle_sets(chunk)
                rank = table[(keys >> lexer.U64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")
                order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
                keys, rank = keys[order], rank[order]
                n = np.diff(bounds)
                take = np.where(n > 0, n - needed(n) + 1, 0)
                at = np.repeat(bounds[:-1] - np.append(0, np.cumsum(take)[:-1]), take) + np.arange(int(take.sum()))
                cold = lexer.sums((rank[at] < hot).astype(np.int64), np.append(0, np.cumsum(take)))
                offs = pa.array(np.append(0, np.cumsum(take)), pa.int32())
                yield pa.record_batch({
                    "id": ids.slice(chunk.first, len(chunk)), "n": pa.array(n, pa.int32()), "cold": pa.array(cold, pa.int32()),
                    "prefix": pa.ListArray.from_arrays(offs, pa.array(keys[at].view(np.int64))),
                })

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for chunk in lexer.chunks(batch.column(1)):
            _, keys, bounds = lexer.shingle_sets(chunk)
            raw = keys.tobytes()
            offs = pa.array(bounds * 8, pa.int32())
            yield pa.record_batch({"id": ids.slice(chunk.first, len(chunk)), "keys": pa.Array.from_buffers(pa.binary(), len(chunk), [None, offs.buffers()[1], pa.py_buffer(raw)])})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, spoke first null): the hub's set, then its partners' sets."""
    key, hub_set = None, None
    for batch in batches:
        hubs, salts, ids, sets = (batch.column(i) for i in range(4))
        out_hub, out_id, out_n = [], [], []
        for i in range(batch.num_rows):
            own = np.frombuffer(sets[i].as_buffer(), np.uint64)
            at = (hubs[i].as_py(), salts[i].as_py())
            other = ids[i].as_py()
            if other is None:
                key, hub_set = at, own.copy()
            elif key == at:
                out_hub.append(at[0])
                out_id.append(other)
                out_n.append(common(hub_set, own))
        yield pa.record_batch({"a": pa.array(out_id, pa.int64()), "b": pa.array(out_hub, pa.int64()), "both": pa.array(out_n, pa.int64())})


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending key arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact ``|a & b|`` of each distinct pair (a, b): columns a, b, both."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    spokes = salted.select(F.col("a").alias("id"), F.col("b").alias("hub"), "salt", F.col("a").alias("spoke"))
    hubs = sizes.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("spoke"))
    routed = sets.join(small_side(spokes.unionByName(hubs)), "id").select("hub", "salt", "spoke", "keys")
    dealt = routed.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("spoke").asc_nulls_first())
    return dealt.mapInArrow(_compare, "a long, b long, both long")


def linked(both, a, b):
    """The link rule for an overlap and two set sizes, as a column."""
    return 180 * both >= 80 * (a + b)


def may_link(n1, pos1, n2, pos2):
    """Upper bound of an overlap whose first common shingle stands at these places, against the need."""
    return 180 * (1 + F.least(n1 - pos1 - 1, n2 - pos2 - 1)) >= 80 * (n1 + n2)


def enough_shared(shared, n1, n2):
    """Whether two sets can link that share so many of their first shingles.

    What they share beyond lies behind the prefix that ends first, so it is at most ``ceil(0.8 n) - 1`` of that set.
    """
    beyond = F.greatest(F.ceil(0.8 * n1), F.ceil(0.8 * n2))
    return 180 * (shared + beyond - 1) >= 80 * (n1 + n2)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable by ``edges`` (u, v): columns node, component.

    Alternating large and small stars; each step is two grouped minima and joins, and its edges are
    written to the checkpoint folder. Nodes without an edge are absent.
    """
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        # One round each of large and small stars.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        # Done when every node has one edge, to a node without any.
        uses = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not uses.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _component_of(rows: DataFrame, comps: DataFrame, id_col: str, name: str) -> DataFrame:
    return rows.join(comps.select(F.col("node").alias(id_col), F.col("component").alias("__c")), id_col, "left").withColumn(name, F.coalesce("__c", id_col)).drop("__c")


def _class_counters(stats: DataFrame) -> bytes:
    """The sketch as one byte per counter: 2**SKETCH_BITS bytes whatever the input."""
    rows = stats.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_add_blocks, "block int, classes binary").collect()
    table = bytearray(1 << SKETCH_BITS)
    for block, classes in rows:
        table[block * 4096 : (block + 1) * 4096] = classes
    return bytes(table)


def _class_order(texts: DataFrame) -> tuple[DataFrame, object]:
    """Set digests of all rows, and the broadcast shingle order."""
    stats = cut_lineage(texts.mapInArrow(_digests, "doc_id long, n long, d1 long, d2 long, block int, counts binary"))
    order = texts.sparkSession.sparkContext.broadcast(_class_counters(stats))
    return stats.where("block IS NULL").select("doc_id", "n", "d1", "d2"), order


def _lists(texts: DataFrame, reps: DataFrame, order) -> DataFrame:
    """Index entries (h, id, n, pos) of shingles that two prefixes share, with the smallest entry of the list as hid, hn, hpos."""
    firsts = texts.where("doc_id IS NOT NULL").mapInArrow(_prefixes(order), "id long, n int, cold int, prefix array<long>")
    firsts = firsts.where("n > 0").join(reps, "id", "left_semi")
    entries = firsts.select("id", "n", "cold", F.posexplode("prefix").alias("pos", "h"))
    head = F.min(F.struct("id", "n", "pos"))
    listed = Window.partitionBy("h")
    cold = entries.where("pos < cold").select("h", "id", "n", "pos", F.count(F.lit(1)).over(listed).alias("many"), head.over(listed).alias("head"))
    hot = entries.where("pos >= cold").select("h", "id", "n", "pos")
    hot = hot.join(hot.groupBy("h").agg(F.count(F.lit(1)).alias("many"), head.alias("head")).where("many > 1"), "h").select("h", "id", "n", "pos", "many", "head")
    both = cold.where("many > 1").unionByName(hot)
    return cut_lineage(both.select("h", "id", "n", "pos", F.col("head.id").alias("hid"), F.col("head.n").alias("hn"), F.col("head.pos").alias("hpos")))


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole sets (id, keys) of the given documents."""
    wanted = small_side(ids.withColumnRenamed("id", "doc_id"))
    return cut_lineage(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "id long, keys binary"))


def _attach(texts: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each set with one list head, the one it shares most prefix shingles with: (a, b, na, nb, both), and the sets read for that."""
    offered = lists.where("id <> hid").where(may_link(F.col("n"), F.col("pos"), F.col("hn"), F.col("hpos")))
    offered = offered.groupBy("id", "hid", "n", "hn").agg(F.count(F.lit(1)).alias("shared"))
    best = F.max_by(F.struct("hid", "n", "hn"), F.struct("shared", -F.col("hid"))).alias("x")
    tried = cut_lineage(offered.groupBy("id").agg(best).select(F.col("id").alias("a"), F.col("x.hid").alias("b"), F.col("x.n").alias("na"), F.col("x.hn").alias("nb")))
    sets = _sets_of(texts, _ends(tried))
    return cut_lineage(overlaps(sets, tried.select("a", "b")).join(tried, ["a", "b"])), sets


def _join_block(part: pa.Table) -> pa.Table:
    """Links between the probing sets of a block and its other sets, as few as connect what they connect."""
    role, ids, n = (part.column(c).to_numpy() for c in ("role", "id", "n"))
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("keys").combine_chunks()]
    probes, others = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    links: list[tuple[int, int]] = []
    if len(probes) and len(others):
        flat = np.concatenate([keys[i] for i in others])
        owner = np.repeat(np.arange(len(others)), [len(keys[i]) for i in others])
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        root = {int(i): int(i) for i in ids}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        other_ids, other_n = ids[others], n[others]
        for i in probes:
            low, high = np.searchsorted(flat, keys[i], "left"), np.searchsorted(flat, keys[i], "right")
            count = high - low
            at = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
            both = np.bincount(owner[at], minlength=len(others))
            for j in np.flatnonzero((180 * both >= 80 * (n[i] + other_n)) & (other_ids != ids[i])):
                x, y = find(int(ids[i])), find(int(other_ids[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(ids[i]), int(other_ids[j])))
    u, v = zip(*links) if links else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _links_under_head(attached: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of sets that do not link with their head to sets of the same head.

    A head's sets are cut into chunks of about ``PER_CHUNK`` shingles; each chunk of unlinked sets meets each chunk of all.
    Sets that link with the head are connected already and are not compared with each other.
    """
    far = ~linked(F.col("both"), F.col("na"), F.col("nb"))
    weighed = attached.groupBy("b").agg(F.count(F.lit(1)).alias("members"), *(F.greatest(F.ceil(F.sum(x) / PER_CHUNK), F.lit(1)).cast("int").alias(y) for x, y in ((F.col("na"), "parts"), (F.when(far, F.col("na")), "far_parts"))), F.max(far).alias("some"))
    weighed = weighed.where("members > 1 AND some")
    member = attached.join(small_side(weighed.select("b", "parts", "far_parts")), "b").select("b", F.col("a").alias("id"), F.col("na").alias("n"), "parts", "far_parts", far.alias("far"))
    chunk = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    probes = member.where("far").select("b", "id", "n", F.lit(0).alias("role"), chunk("far_parts").alias("i"), every("parts").alias("j"))
    others = member.select("b", "id", "n", F.lit(1).alias("role"), every("far_parts").alias("i"), chunk("parts").alias("j"))
    routed = sets.join(small_side(probes.unionByName(others)), "id")
    return cut_lineage(routed.groupBy("b", "i", "j").applyInArrow(_join_block, "u long, v long"))


def _ends(*pairs: DataFrame) -> DataFrame:
    out = None
    for pair in pairs:
        for side in ("a", "b"):
            part = pair.select(F.col(side).alias("id"))
            out = part if out is None else out.unionByName(part)
    return cut_lineage(out.distinct())


def _across(lists: DataFrame, comps: DataFrame, attached: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of different components and heads that a list and its bounds leave open."""
    # Linked sizes differ by a factor of 1.25 at most: by one block of 1.26, rounding included.
    block = F.floor(F.log(1.26, F.col("n"))).cast("int")
    placed = _component_of(lists.select("h", "id", "n", "pos"), comps, "id", "comp").withColumn("blk", block)
    placed = placed.join(attached.select(F.col("a").alias("id"), F.col("b").alias("own")), "id", "left").withColumn("own", F.coalesce("own", "id"))
    shares = placed.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = shares.groupBy("h").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("comps > 1").select("h", "main")
    several = cut_lineage(placed.join(mixed, "h"))
    minor = F.col("comp") != F.col("main")
    probe = several.where(minor).select("h", F.explode(F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1)).alias("blk"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"), F.col("own").alias("ox"))
    other = several.select("h", "blk", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"), F.col("own").alias("oy"), minor.alias("both_ways"))
    found = probe.join(other, ["h", "blk"]).where("cx <> cy AND ox <> oy AND (x < y OR NOT both_ways)").where(may_link(F.col("nx"), F.col("px"), F.col("ny"), F.col("py")))
    smaller = F.col("x") < F.col("y")
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(smaller, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(smaller, F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()
    failed = attached.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = cut_lineage(found.join(failed, ["a", "b"], "left_anti"))
    # All shingles that both prefixes hold, counted for these pairs only; a prefix is a short array.
    held = cut_lineage(several.groupBy("id").agg(F.collect_set("h").alias("held")))
    shared = found.join(held.select(F.col("id").alias("a"), F.col("held").alias("held_a")), "a").join(held.select(F.col("id").alias("b"), F.col("held").alias("held_b")), "b")
    counted = F.size(F.array_intersect("held_a", "held_b"))
    return cut_lineage(shared.where(enough_shared(counted, F.col("na"), F.col("nb"))).select("a", "b", "na", "nb"))


def _links_across(texts: DataFrame, across: DataFrame, attached: DataFrame, known: DataFrame) -> DataFrame:
    """Links (u, v) among the open pairs that components still need.

    Heads answer for their stars: with them alone first, then the pairs they leave open.
    """
    star = attached.where(linked(F.col("both"), F.col("na"), F.col("nb"))).select(F.col("a").alias("id"), F.col("b").alias("head"), F.col("nb").alias("head_n"), (F.col("na") - F.col("both")).alias("off"))
    for side in ("a", "b"):
        across = across.join(star.select(*(F.col(c).alias(f"{c}_{side}") for c in star.columns)), F.col(side) == F.col(f"id_{side}"), "left")
        across = across.withColumns({f"head_{side}": F.coalesce(f"head_{side}", side), f"head_n_{side}": F.coalesce(f"head_n_{side}", f"n{side}"), f"off_{side}": F.coalesce(f"off_{side}", F.lit(0))}).drop(f"id_{side}")
    turned = F.col("head_a") > F.col("head_b")
    top = {"ta": F.least("head_a", "head_b"), "tb": F.greatest("head_a", "head_b"), "tna": F.when(turned, F.col("head_n_b")).otherwise(F.col("head_n_a")), "tnb": F.when(turned, F.col("head_n_a")).otherwise(F.col("head_n_b"))}
    across = cut_lineage(across.withColumns(top))
    tops = cut_lineage(across.select(F.col("ta").alias("a"), F.col("tb").alias("b"), F.col("tna").alias("na"), F.col("tnb").alias("nb")).distinct())
    sets = _sets_of(texts, _ends(tops, across))
    answers = cut_lineage(overlaps(sets, tops.select("a", "b")).join(tops, ["a", "b"]))
    by_heads = answers.where(linked(F.col("both"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = known.unionByName(by_heads)
    comps = components(known)
    left = _component_of(_component_of(across, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb AND NOT (a = ta AND b = tb)")
    left = left.join(answers.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "both"), ["ta", "tb"])
    left = cut_lineage(left.where(linked(F.col("both") + F.col("off_a") + F.col("off_b"), F.col("na"), F.col("nb"))).select("a", "b", "na", "nb"))
    more = overlaps(sets, left.select("a", "b")).join(left, ["a", "b"]).where(linked(F.col("both"), F.col("na"), F.col("nb")))
    return by_heads.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (long) and ``component_id`` (long)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, order = _class_order(texts)
    if _repeats(rows):
        return _by_text(docs, id_col, text_col)
    classes = cut_lineage(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")))
    lists = _lists(texts, classes.select(F.col("rep").alias("id")), order)
    release(spark)
    attached, sets = _attach(texts, lists)
    release(spark)
    links = cut_lineage(attached.where(linked(F.col("both"), F.col("na"), F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(_links_under_head(attached, sets)))
    del sets
    release(spark)
    across = _across(lists, components(links), attached)
    del lists
    release(spark)
    if across.limit(1).count():
        links = cut_lineage(links.unionByName(_links_across(texts, across, attached, links)))
    # Equal sets meet their representative here.
    same = rows.join(classes, ["d1", "d2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(links.unionByName(same))
    del links, attached, across
    release(spark)
    return _component_of(rows, final, "doc_id", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _repeats(rows: DataFrame) -> bool:
    return rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, digest), and each text of each id with a number of its own and the component of that number."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest, F.col(text_col).alias("text"))
    each = cut_lineage(own.where("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.first("text").alias("text")).withColumn("number", F.monotonically_increasing_id()))
    found = similar_components(each, "number", "text").withColumnsRenamed({"doc_id": "number", "component_id": "component"})
    return own.drop("text"), cut_lineage(each.drop("text").join(found, "number").select("doc_id", "digest", "n_shingles", "component"))


def _by_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Components where ids repeat: every text is linked for itself, and an id joins the components of all its texts."""
    own, found = _texts(docs, id_col, text_col)
    first = found.groupBy("component").agg(F.min("doc_id").alias("v"))
    roots = components(cut_lineage(found.join(first, "component").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()))
    known = own.where("doc_id IS NOT NULL").join(found.drop("component"), ["doc_id", "digest"]).withColumn("n", F.col("n_shingles")).drop("digest", "n_shingles")
    nameless = _class_order(docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))[0].select("doc_id", "n")
    return _component_of(known.unionByName(nameless), roots, "doc_id", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _one_of_each_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each component of texts the row with the smallest id, then digest, then hash of the row."""
    _, found = _texts(docs, id_col, text_col)
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("s")).select("s.*")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.struct(*names).alias("row"), F.xxhash64(*names).alias("hash"))
    one = rows.join(stays, ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.min_by("row", "hash").alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a similar one of smaller id; where ids repeat, each text counts for itself. Rows with a null id stay."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    if _repeats(texts):
        return _one_of_each_text(docs, id_col, text_col)
    found = cut_lineage(similar_components(docs, id_col, text_col).select("doc_id", "component_id"))
    name = f"{free_prefix(docs)}other"
    others = small_side(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(others, F.col(id_col).cast("long") == F.col(name), "left_anti")
