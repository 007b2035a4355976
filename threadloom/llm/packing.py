"""Packs tokenised documents into as few sequences of ``capacity`` tokens as it can, by bin completion.

Only the number of pieces of each length decides a packing, and there are ``capacity`` lengths at most. So the
search runs on a histogram on the driver, and its result is a list of fillings with multiplicities; pieces are
then dealt to places by their rank among pieces of the same length, which is distributed work.

*Bin completion.* The largest remaining length opens a bin, and the search branches over the undominated fillings of
the rest of it, least waste and longest pieces first. A filling is dominated if a piece that is left over could take
the place of one or more of its pieces. A branch is pruned when its waste cannot beat the incumbent any more, or when
the same pieces were left before. A filling is repeated as often as the counts and the waste allow, which places whole
blocks of equal bins at once; on the way back it is repeated half as often, down to once, so that nothing is left out.
The first incumbent is a best-fit packing; the search ends when the number of bins meets the lower bound, when all
branches are done, or after ``BASE_NODES + NODES`` steps a length.

*Ranks.* Pieces are numbered within (length, salt) and salts within a length by their counts, so a length that a
third of all pieces has is spread over many tasks.

Defined results: a null or empty text is the end id alone; a document longer than a sequence is cut into pieces of
``capacity``, of which the first may be shorter; shorter documents are never cut; repeated rows are packed as often as
they stand there; no rows give no sequence; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import rows

CAPACITY = 1024
END_ID = 2
#: Steps of the search: so many, and so many more for each length that occurs.
BASE_NODES = 50_000
NODES = 50

#: Texts of these characters are cut alike by both tokenizer libraries; all others go to the defining one.
_PLAIN = re.compile(r"[^\t-\r -~ -ɏ‐-‧€]")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids as ``tokenizers`` gives them for ``path``; where a file of the same ranks lies beside it, most texts take the faster library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        if path.endswith("byte_bpe_50k.json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _SPECIAL in text or _PLAIN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and path."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``capacity`` but the first."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        for batch in batches:
            which, starts, lengths, number, crcs, raws = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "")
                ids.append(end_id)
                raw = memoryview(array("I", ids).tobytes())
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = raw[4 * start : 4 * (start + length)]
                    which.append(i)
                    number.append(k)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(own))
                    if with_ids:
                        raws.append(bytes(own))
            made = {"doc_id": batch.column(0).take(pa.array(which, pa.int32())), "piece": pa.array(number, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
            yield pa.record_batch(made | ({"ids": pa.array(raws, pa.binary())} if with_ids else {}))

    rows.small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that any packing needs: of the total, or of pieces too long to share a bin with the room they leave."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    many, load = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * sizes))
    best = -(-int(load[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        alone = int(many[-1] - many[capacity - k + 1])
        large = int(many[capacity - k + 1] - many[capacity // 2 + 1])
        small = int(load[capacity // 2 + 1] - load[k]) if k <= capacity // 2 else 0
        room = large * capacity - int(load[capacity - k + 1] - load[capacity // 2 + 1])
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def _reach(counts: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """For each place in ``lengths`` (descending) the sums up to ``room`` that the lengths from there on can make, as bits."""
    mask = (1 << (room + 1)) - 1
    out = [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        d, bits, left, step = lengths[i], out[i + 1], min(int(counts[lengths[i]]), room // lengths[i]), 1
        while left > 0 and bits != mask:
            step = min(step, left)
            bits |= (bits << (d * step)) & mask
            left -= step
            step *= 2
        out[i] = bits
    return out


def _dominated(left: int, filled: list[tuple[int, int]], slack: int) -> bool:
    """Whether one of the lengths ``left`` over (as bits) fits into ``slack`` or could stand for pieces of the filling that are no longer together."""
    one, many = 0, 0
    for d, k in filled:
        for _ in range(k):
            many |= (one | many) << d
            one |= 1 << d
    # A single piece is only given up for a longer one, none at all for any.
    wide, longer = many, (one | 1) << 1 if slack else 0
    for s in range(1, slack + 1):
        wide |= many << s
        longer |= (one | 1) << s
    return bool(left & (wide | longer))


def fillings(counts: np.ndarray, room: int, waste: int) -> Iterator[list[tuple[int, int]] | None]:
    """The undominated fillings of ``room`` that leave ``waste`` at most, least waste and longest pieces first; None for each dominated one passed over."""
    lengths = [int(d) for d in np.flatnonzero(counts[: room + 1])[::-1]]
    reach = _reach(counts, lengths, room)
    every = sum(1 << d for d in lengths)

    def exactly(i: int, left: int) -> Iterator[list[tuple[int, int]]]:
        if not left:
            yield []
            return
        for at in range(i, len(lengths)):
            d = lengths[at]
            for take in range(min(int(counts[d]), left // d), 0, -1):
                if reach[at + 1] >> (left - take * d) & 1:
                    for rest in exactly(at + 1, left - take * d):
                        yield [(d, take), *rest]
            if not reach[at + 1] >> left & 1:
                return

    for total in range(room, max(room - waste, 0) - 1, -1):
        if reach[0] >> total & 1:
            for filled in exactly(0, total):
                gone = sum(1 << d for d, k in filled if counts[d] == k)
                yield None if _dominated(every & ~gone, filled, room - total) else filled


def _best_fit(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The longest pieces that fit, one after another."""
    out: list[tuple[int, int]] = []
    at = room
    while at > 0 and room > 0:
        at = min(at, room)
        while at > 0 and not counts[at]:
            at -= 1
        if at > 0:
            take = min(int(counts[at]), room // at)
            out.append((at, take))
            room -= take * at
            at -= 1
    return out


Packing = list[tuple[list[tuple[int, int]], int]]


def _greedy(counts: np.ndarray) -> Packing:
    """The best-fit packing: fillings with multiplicities."""
    counts, capacity = counts.copy(), len(counts) - 1
    out: Packing = []
    top = capacity
    while True:
        while top > 0 and not counts[top]:
            top -= 1
        if not top:
            return out
        counts[top] -= 1
        filled = _best_fit(counts, capacity - top)
        counts[top] += 1
        need = _with(top, filled)
        times = min(int(counts[d]) // k for d, k in need.items())
        for d, k in need.items():
            counts[d] -= k * times
        out.append((sorted(need.items(), reverse=True), times))


def _with(top: int, filled: list[tuple[int, int]]) -> dict[int, int]:
    need: dict[int, int] = {top: 1}
    for d, k in filled:
        need[d] = need.get(d, 0) + k
    return need


def bins(packing: Packing) -> int:
    return sum(times for _, times in packing)


def complete(counts: np.ndarray, nodes: int | None = None) -> Packing:
    """The packing with fewest bins found for ``counts[length]`` pieces of each length."""
    capacity, total = len(counts) - 1, int((counts * np.arange(len(counts))).sum())
    bound, best = lower_bound(counts), _greedy(counts)
    nodes = BASE_NODES + NODES * int(np.count_nonzero(counts)) if nodes is None else nodes
    rest, path, waste = counts.copy(), [], 0
    seen: dict[bytes, int] = {}
    allowed = lambda: (bins(best) - 1) * capacity - total - waste  # noqa: E731  waste that a better packing may still have

    def branches() -> Iterator[tuple[dict[int, int], int, int] | None]:
        """Blocks of equal bins for the largest length left: pieces, times, waste of one bin."""
        top = int(np.flatnonzero(rest)[-1])
        others = rest.copy()
        others[top] -= 1
        for filled in fillings(others, capacity - top, allowed()):
            if filled is None:
                yield None
                continue
            need = _with(top, filled)
            lost = capacity - sum(d * k for d, k in need.items())
            times = min(int(rest[d]) // k for d, k in need.items())
            while times:
                times = min(times, max(allowed(), 0) // lost) if lost else times
                if times:
                    yield need, times, lost
                times //= 2

    open_ = [branches()] if bins(best) > bound else []
    while open_ and nodes > 0 and bins(best) > bound:
        block = next(open_[-1], False)
        nodes -= 1
        if block is None:
            continue
        if block:
            need, times, lost = block
            for d, k in need.items():
                rest[d] -= k * times
            waste += lost * times
            path.append(block)
            if not rest.any():
                if allowed() >= 0:
                    best = [(sorted(n.items(), reverse=True), t) for n, t, _ in path]
            else:
                state = hashlib.blake2b(rest.tobytes(), digest_size=16).digest()
                if seen.get(state, waste + 1) > waste and allowed() >= 0:
                    seen[state] = waste
                    open_.append(branches())
                    continue
        else:
            open_.pop()
        if path:
            need, times, lost = path.pop()
            for d, k in need.items():
                rest[d] += k * times
            waste -= lost * times
    return best


def places(packing: Packing) -> dict[str, np.ndarray]:
    """Blocks of places ordered by (length, rank): ``low`` first rank, ``seq`` first sequence, ``offset`` in it; one row for each piece of a filling."""
    out, used, seq = [], {}, 0
    for filled, times in packing:
        offset = 0
        for length, copies in filled:
            for _ in range(copies):
                low = used.get(length, 0)
                out.append((length, low, seq, offset))
                used[length] = low + times
                offset += length
        seq += times
    table = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "low": table[:, 1], "seq": table[:, 2], "offset": table[:, 3]}


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with the rank (from 0) of each piece among those of its length."""
    salts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start"))
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces, materialised) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in found.groupBy("length").count().collect():
        counts[length] = n
    table = places(complete(counts))
    # At most a few fillings for each length, so its size is bounded by the capacity alone.
    shared = spark.sparkContext.broadcast(table)
    kept = list(found.columns)
    names = [*kept, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        key = blocks["length"] << 44 | blocks["low"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            seq = blocks["seq"][at] + rank - blocks["low"][at]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(blocks["offset"][at])], names=names)

    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes)
    return ranked(found).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    found = cut_lineage(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids))
    rows.release(docs.sparkSession)
    return packed(found, capacity)


def sequences(docs: DataFrame, path: str, **options) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int, ``capacity`` at most) and the documents in them."""
    made = pack(docs, path, with_ids=True, **options)
    parts = made.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in row), np.uint32).astype(np.int32) for row in batch.column(1).to_pylist()]
            docs_in = [[p["doc_id"] for p in row] for row in batch.column(1).to_pylist()]
            yield pa.record_batch({"sequence_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32())), "doc_ids": pa.array(docs_in, pa.list_(pa.int64()))})

    return parts.mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>")
