"""Language-model scoring by prediction by partial matching, with a unigram score beside it.

*Byte model.* Contexts of up to ``ORDER`` bytes form a trie; every context and symbol of the training documents is kept,
so the model grows with the corpus. A symbol that a context has not seen costs an
escape (half the number of symbols seen over the positions), and the next shorter context is asked without the symbols already excluded; at the end all other
bytes are equally likely. Symbols seen after a context are also seen after its suffix, so each context's
exclusion is known in advance. Texts are lower-cased in A-Z; byte 0 stands for start and end of a text.

The trie is dealt to buckets by the last ``SUFFIX`` bytes of a context, so a bucket has all longer contexts of its
suffixes. Shorter contexts, whose number the alphabet bounds, are broadcast. Sequences of ``ORDER + 1`` bytes that make up
``1 / HEAVY_GRAMS`` of the positions or more are broadcast with their log probabilities and scored where the text is read;
all others are sent to their bucket, which returns partial sums.

*Unigrams.* Words and one end token for each text, with add-one smoothing over the training vocabulary. Counts are
held by 64-bit word keys. Tokens that make up ``1 / HEAVY`` of the training tokens or more (``HEAVY`` at most) are
scored where the text is read. All others are sent, packed, to a bucket of their key, where their counts are
found beside them; a bucket returns one partial sum for each document, packed by block of documents. No vocabulary is
broadcast.

Training counts cover all training documents: each task sends its distinct keys, packed by bucket, and each
bucket adds them up. What is gathered grows with the corpus.

Defined results: a null text is an empty one, which has the end token only; without training documents the
unigram score is that of an empty vocabulary and bytes are equally likely; rows are scored each for itself, so
repeated rows and ids get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lexer, rows

ORDER = 5
#: Bytes of a context by which the trie is dealt; shorter contexts are broadcast.
SUFFIX = 3
#: Share of positions from which a sequence is scored where the text is read; 12 bytes each.
HEAVY_GRAMS = 1 << 22
HEAVY = 65_536
#: Light tokens that one bucket should receive, about.
PER_BUCKET = 4_000_000
END = lexer.U64(0x5851F42D4C957F2D)
#: Kind of the rows that count words; the others count n-grams of so many context bytes.
WORDS = 9
_PACKED = "kind int, bucket int, total long, keys binary, counts binary"


def _text_bytes(chunk: lexer.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one 0 after each document, and the bounds of documents in them."""
    n = len(chunk)
    out = np.zeros(len(chunk.data) + n, dtype=np.uint8)
    doc = np.repeat(np.arange(n), np.diff(chunk.offs))
    out[np.arange(len(chunk.data)) + doc] = np.maximum(lexer.FOLD[chunk.data], 1)
    return out, chunk.offs + np.arange(n + 1)


def _contexts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each distance 1 to ``ORDER`` the byte that stands so far before; 0 before a document's start."""
    back = []
    for d in range(1, ORDER + 1):
        shifted = np.zeros_like(data)
        shifted[d:] = data[:-d]
        for i in range(d):
            at = bounds[:-1] + i
            shifted[at[at < bounds[1:]]] = 0
        back.append(shifted)
    return back


def _codes(chunk: lexer.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each byte below the ``ORDER`` bytes before it, the nearest lowest, and the bounds of documents."""
    data, bounds = _text_bytes(chunk)
    code = data.astype(lexer.U64)
    for d, shifted in enumerate(_contexts(data, bounds)):
        code |= shifted.astype(lexer.U64) << lexer.U64(8 * (d + 1))
    return code, bounds


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of context and the symbol."""
    return keys & lexer.U64((1 << (8 * (order + 1))) - 1)


def _gram_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    spread = lexer.mix(_suffix(keys, SUFFIX) >> lexer.U64(8)) & lexer.U64(0xFFFFFFFF)
    return (spread % lexer.U64(buckets)).astype(np.int64)


def _tokens(chunk: lexer.Chunk) -> lexer.Words:
    return lexer.words(chunk)


class _Counter:
    """Distinct keys with counts, folded together now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2_000_000 and len(self.parts) > 1:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, lexer.U64)
        counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
        folded = lexer.totals(keys, counts)
        self.parts, self.size = [folded], len(folded[0]) // 2
        return folded


def _by_bucket(kind: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    found, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(keys))
    return pa.record_batch({
        "kind": pa.array(np.full(len(found), kind), pa.int32()), "bucket": pa.array(found, pa.int32()), "total": pa.array([int(counts[a:b].sum()) for a, b in zip(first, ends)], pa.int64()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()), "counts": pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(first, ends)], pa.binary()),
    })


def _count(buckets: int, orders: tuple[int, ...] = tuple(range(ORDER, -1, -1))):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, grams = _Counter(), _Counter()
        texts = 0
        for batch in batches:
            for chunk in lexer.chunks(batch.column(0)):
                texts += len(chunk)
                keys = np.sort(_tokens(chunk).keys)
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                tokens.add(keys[first], np.diff(np.append(first, len(keys))))
                code = np.sort(_codes(chunk)[0])
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                grams.add(code[first], np.diff(np.append(first, len(code))))
        if texts:
            tokens.add(np.array([END]), np.array([texts]))
            keys, counts = tokens.fold()
            yield _by_bucket(WORDS, keys, counts, ((keys >> lexer.U64(32)) % lexer.U64(buckets)).astype(np.int64))
            keys, counts = grams.fold()
            for order in orders:
                keys, counts = lexer.totals(_suffix(keys, order), counts)
                yield _by_bucket(order, keys, counts, _gram_bucket(keys, buckets))

    return run


def _read(part: pa.Table, **kinds: type) -> list[np.ndarray]:
    """The packed arrays of each column, one after another."""
    return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in part.column(name))]) for name, kind in kinds.items()]


def _keep(limits: dict[int, int]):
    """Adds up a bucket and keeps keys that reach the limit of their kind; ``total`` is the number of distinct keys."""

    def run(part: pa.Table) -> pa.Table:
        kind, bucket = part.column("kind")[0].as_py(), part.column("bucket")[0].as_py()
        keys, counts = lexer.totals(*_read(part, keys=np.uint64, counts=np.int64))
        kept = counts >= limits[kind]
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "total": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys[kept].tobytes()], pa.binary()), "counts": pa.array([counts[kept].tobytes()], pa.binary())})

    return run


class Level:
    """Contexts of one order: their symbols with counts, positions, kinds of symbols, and the positions that these symbols have in the suffix."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: Level | None) -> None:
        self.keys, self.counts = keys, counts
        self.order = 0 if below is None else below.order + 1
        context = keys >> lexer.U64(8)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts, self.kinds = context[first], np.diff(np.append(first, len(keys)))
        self.positions = np.add.reduceat(counts, first) if len(keys) else counts
        self.shared = np.zeros(len(first), np.int64)
        if below is not None and len(keys):
            # The suffix has every symbol of the context.
            self.shared = np.add.reduceat(below.counts[np.searchsorted(below.keys, _suffix(keys, below.order))], first)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``keys``, -1 for none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def levels(keys: np.ndarray, counts: np.ndarray, orders: range, below: list[Level]) -> list[Level]:
    """``below`` and the levels of ``orders`` over it, from counts of the longest contexts."""
    out = list(below)
    for order in orders:
        out.append(Level(*lexer.totals(_suffix(keys, order), counts), out[-1] if out else None))
    return out


def log10_of(trie: list[Level], keys: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol after its ``ORDER`` bytes, by escape and exclusion."""
    lead, out = np.zeros(len(keys)), np.full(len(keys), np.nan)
    shared, seen = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    for level in reversed(trie):
        own = _suffix(keys[todo], level.order)
        context = _find(level.contexts, own >> lexer.U64(8))
        has = np.flatnonzero(context >= 0)
        context, at, rows_ = context[has], _find(level.keys, own[has]), todo[has]
        positions, kinds = level.positions[context] - shared[rows_], level.kinds[context] - seen[rows_]
        full = level.kinds[context] == 256
        every = np.maximum(positions, 1)
        known = at >= 0
        hit = rows_[known]
        out[hit] = lead[hit] + np.log10((level.counts[at[known]] - np.where(full | (kinds == 0), 0, 0.5)[known]) / every[known])
        lead[rows_] += np.where((kinds > 0) & ~full, np.log10(np.maximum(kinds, 1) / 2 / every), 0)
        shared[rows_], seen[rows_] = level.shared[context], level.kinds[context]
        todo = todo[np.isnan(out[todo])]
    out[todo] = lead[todo] - np.log10(np.maximum(256 - seen[todo], 1))
    return out.astype(np.float32)


_GRAMS = "bucket int, keys binary, counts binary, heavy binary, logs binary"


def _add_grams(low, limit: int):
    """Adds up a bucket of the trie; sequences that reach the limit stand beside it with their log probabilities."""

    def run(part: pa.Table) -> pa.Table:
        keys, counts = lexer.totals(*_read(part, keys=np.uint64, counts=np.int64))
        heavy = keys[counts >= limit]
        logs = log10_of(levels(keys, counts, range(SUFFIX, ORDER + 1), low.value), heavy)
        pack = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"bucket": pa.array([part.column("bucket")[0].as_py()], pa.int32()), "keys": pack(keys), "counts": pack(counts), "heavy": pack(heavy), "logs": pack(logs)})

    return run


class Model:
    """A small trie flattened into one row of all 256 log probabilities for each context, the heavy tokens and the corpus totals."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], heavy: tuple[np.ndarray, np.ndarray], tokens: int, vocabulary: int) -> None:
        self.heavy_keys, self.heavy_counts = heavy
        self.tokens, self.vocabulary = tokens, vocabulary
        self._flatten(grams)

    def _flatten(self, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        root = np.zeros((1, 256))
        if 0 in grams:
            root[0, grams[0][0].astype(np.int64)] = grams[0][1]
        counts, codes, starts = [root], [np.zeros(1, lexer.U64)], [0]
        total = 1
        for order in range(1, ORDER + 1):
            keys, n = grams.get(order, (np.zeros(0, lexer.U64), np.zeros(0, np.int64)))
            context = np.unique(keys >> lexer.U64(8))
            table = np.zeros((len(context), 256), dtype=np.float32)
            table[np.searchsorted(context, keys >> lexer.U64(8)), (keys & lexer.U64(255)).astype(np.int64)] = n
            counts.append(table)
            codes.append(context)
            starts.append(total)
            total += len(context)
        self.sink = total
        self.child = np.full((total + 1, 256), total, dtype=np.int32)
        self.log10 = np.empty((total, 256), dtype=np.float32)
        parents = [np.zeros(1, np.int64)]
        for order in range(1, ORDER + 1):
            # A context's suffix lacks its first, highest byte.
            suffix = codes[order] & lexer.U64((1 << (8 * (order - 1))) - 1)
            parent = np.searchsorted(codes[order - 1], suffix)
            parents.append(parent)
            self.child[starts[order - 1] + parent, (codes[order] >> lexer.U64(8 * (order - 1))).astype(np.int64)] = starts[order] + np.arange(len(codes[order]))
        for order in range(ORDER + 1):
            for low in range(0, len(codes[order]), 2048):
                some = slice(low, min(low + 2048, len(codes[order])))
                self.log10[starts[order] + some.start : starts[order] + some.stop] = self._rows(order, some, counts, parents)

    @staticmethod
    def _rows(order: int, some: slice, counts: list[np.ndarray], parents: list[np.ndarray]) -> np.ndarray:
        table = counts[order][some]
        out = np.full(table.shape, np.nan)
        lead = np.zeros((len(table), 1))
        excluded = np.zeros(table.shape, dtype=bool)
        at = np.arange(some.start, some.stop)
        for level in range(order, -1, -1):
            here = np.where(excluded, 0, counts[level][at])
            positions, kinds = here.sum(axis=1, keepdims=True), (here > 0).sum(axis=1, keepdims=True)
            seen = (counts[level][at] > 0) | excluded
            # With every byte seen there is nothing to escape to.
            escape = np.where(seen.all(axis=1, keepdims=True), 0, kinds / 2)
            every = np.maximum(positions, 1)
            known = here > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                out[known] = (lead + np.log10((here - (escape > 0) / 2) / every))[known]
            lead = lead + np.where(kinds > 0, np.log10(np.where(escape > 0, escape, 1) / every), 0)
            excluded = seen
            at = parents[level][at]
        rest = ~excluded
        out[rest] = np.broadcast_to(lead - np.log10(np.maximum(rest.sum(axis=1, keepdims=True), 1)), out.shape)[rest]
        return out


class Known:
    """What is broadcast for scoring: the heavy sequences with their log probabilities, the heavy tokens and the corpus totals."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], heavy: tuple[np.ndarray, np.ndarray], tokens: int, vocabulary: int) -> None:
        order = np.argsort(grams[0])
        self.grams, self.logs = grams[0][order], grams[1][order]
        self.heavy_keys, self.heavy_counts = heavy
        self.tokens, self.vocabulary = tokens, vocabulary

    def score(self, chunk: lexer.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text without its light sequences; these and their documents, in order of the sequences."""
        code, bounds = _codes(chunk)
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        at = _find(self.grams, code[first])
        logs = np.zeros(len(first))
        logs[at >= 0] = self.logs[at[at >= 0]]
        times = np.diff(np.append(first, len(code)))
        spread = np.empty(len(code))
        spread[order] = np.repeat(logs, times)
        light = np.repeat(at < 0, times)
        return lexer.sums(spread, bounds), code[light], np.searchsorted(bounds, order[light], side="right") - 1

    def heavy(self, keys: np.ndarray) -> np.ndarray:
        """Counts of heavy tokens, 0 for others."""
        at = _find(self.heavy_keys, keys)
        return np.where(at >= 0, self.heavy_counts[at], 0) if len(self.heavy_keys) else np.zeros(len(keys), np.int64)


def train(texts: DataFrame, buckets: int) -> tuple[Known, Broadcast, DataFrame]:
    """Counts of all ``texts`` (one string column): what scoring broadcasts, the short contexts, and the trie by bucket."""
    spark = texts.sparkSession
    packed = cut_lineage(texts.mapInArrow(_count(buckets, (ORDER, SUFFIX - 1)), _PACKED))
    totals = dict(packed.groupBy("kind").agg(F.sum("total")).collect())
    got = packed.where(F.col("kind") != ORDER).groupBy("kind", "bucket").applyInArrow(_keep({WORDS: -(-totals.get(WORDS, 0) // HEAVY), SUFFIX - 1: 0}), _PACKED)
    parts: dict[int, list] = {WORDS: [], SUFFIX - 1: []}
    vocabulary = 0
    for kind, _, distinct, keys, counts in got.collect():
        vocabulary += distinct if kind == WORDS else 0
        parts[kind].append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
    merged = {kind: lexer.totals(*(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(list(zip(*some)) or [(), ()], (np.uint64, np.int64)))) for kind, some in parts.items()}
    low = spark.sparkContext.broadcast(levels(*merged[SUFFIX - 1], range(SUFFIX), []))
    trie = cut_lineage(packed.where(F.col("kind") == ORDER).groupBy("bucket").applyInArrow(_add_grams(low, -(-totals.get(ORDER, 0) // HEAVY_GRAMS)), _GRAMS))
    heavy = [(np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32)) for k, v in trie.where(F.length("heavy") > 0).select("heavy", "logs").collect()]
    grams = tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(list(zip(*heavy)) or [(), ()], (np.uint64, np.float32)))
    return Known(grams, merged[WORDS], totals.get(WORDS, 0), vocabulary), low, trie


_SENT = "bucket int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, keys binary, rows binary, counts binary"


def _send(model, buckets: int, gram_buckets: int):
    """Each text as a row with the share of its heavy tokens and sequences; the light ones packed by bucket, those of sequences below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        know = model.value
        next_row = TaskContext.get().partitionId() << 33
        log_all = np.log10(know.tokens + know.vocabulary + 1)
        end = know.heavy(np.array([END]))
        for batch in batches:
            ids, held = batch.column(0), batch.column(1)
            light: list[tuple[np.ndarray, ...]] = []
            light_grams: list[tuple[np.ndarray, ...]] = []
            for chunk in lexer.chunks(batch.column(2)):
                n = len(chunk)
                found = _tokens(chunk)
                heavy = know.heavy(found.keys)
                is_light = heavy == 0
                n_tokens = np.diff(found.bounds) + 1
                row = next_row + np.arange(n)
                next_row += n
                # Ends are light only if there are no training documents or hardly any.
                base = lexer.sums(np.where(is_light, 0, np.log10(heavy + 1)), found.bounds) + np.log10(end + 1) - n_tokens * log_all
                known = lexer.sums((~is_light).astype(np.int64), found.bounds) + (end > 0)
                if is_light.any() or not end[0]:
                    keys, doc = found.keys[is_light], found.doc[is_light]
                    if not end[0]:
                        keys, doc = np.append(keys, np.full(n, END)), np.append(doc, np.arange(n))
                    order = lexer.sort_in_docs(doc, keys)
                    keys, doc = keys[order], doc[order]
                    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))
                    times = np.diff(np.append(first, len(keys)))
                    # The held-out mark travels in the count's lowest bit.
                    mark = held.slice(chunk.first, n).to_numpy(zero_copy_only=False).astype(np.int64)
                    light.append((keys[first], row[doc[first]], 2 * times + mark[doc[first]]))
                score, codes, at = know.score(chunk)
                light_grams.append((codes, row[at]))
                yield _sent(pa.array(row % buckets, pa.int32()), pa.array(row), ids.slice(chunk.first, n), held.slice(chunk.first, n), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score), *(pa.nulls(n, pa.binary()) for _ in range(3)))
            codes, row = (np.concatenate(x) for x in zip(*light_grams)) if light_grams else (np.zeros(0, lexer.U64), np.zeros(0, np.int64))
            if len(codes):
                order = np.argsort(codes)
                codes, row = codes[order], row[order]
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                bucket = _gram_bucket(codes[first], gram_buckets)
                by_bucket = np.argsort(bucket, kind="stable")
                times = np.diff(np.append(first, len(codes)))
                # Rows stand in the order of their sequences, which go bucket by bucket.
                row = row[np.argsort(np.repeat(bucket, times), kind="stable")]
                keys, times, bucket = codes[first][by_bucket], times[by_bucket], bucket[by_bucket]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(first[1:], len(keys))
                upto = np.append(0, np.cumsum(times))
                n, low = len(first), row.min()
                cut = lambda x, a, b, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(a, b)], pa.binary())
                yield _sent(pa.array(-1 - bucket[first], pa.int32()), pa.array(np.full(n, low)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), cut(keys, first, ends, np.uint64), cut(row - low, upto[first], upto[ends], np.uint32), cut(times, first, ends, np.uint32))
            if light:
                keys, row, times = (np.concatenate(x) for x in zip(*light))
                bucket = ((keys >> lexer.U64(32)) % lexer.U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                keys, row, times, bucket = keys[order], row[order], times[order], bucket[order]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(first[1:], len(keys))
                pack = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(first, ends)], pa.binary())
                n = len(first)
                low = row.min()
                base_row = pa.array(np.full(n, low))
                yield _sent(pa.array(bucket[first]), base_row, pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pack(keys, np.uint64), pack(row - low, np.uint32), pack(times, np.uint32))

    return run


def _sent(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in _SENT.split(", ")])


#: Documents whose partial sums travel in one row.
BLOCK = 1 << 14
_PARTIAL = "block long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rows binary, sums binary, knowns binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _packed_sums(row: np.ndarray, base: np.ndarray, known: np.ndarray | None) -> pa.Table:
    """Sums of documents (ascending) packed by block; those of sequences have no ``knowns``."""
    block = row // BLOCK
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    ends = np.append(first[1:], len(row))
    pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
    n = len(first)
    knowns = pa.nulls(n, pa.binary()) if known is None else pack(known.astype(np.uint32))
    return pa.table([pa.array(block[first]), pa.array(row[first]), *(pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), pack((row % BLOCK).astype(np.uint16)), pack(base), knowns], names=[x.split()[0] for x in _PARTIAL.split(", ")])


def _settle_grams(part: pa.Table, low: list[Level]) -> pa.Table:
    """The shares of the sequences that fell into a bucket of the trie, which stands in the rows without documents."""
    sent = part.filter(pc.is_valid(part.column("row")))
    if not sent.num_rows:
        return _packed_sums(np.zeros(1, np.int64), np.zeros(1), None).slice(0, 0)
    trie = levels(*_read(part.filter(pc.is_null(part.column("row"))), keys=np.uint64, counts=np.int64), range(SUFFIX, ORDER + 1), low)
    keys, times = _read(sent, keys=np.uint64, counts=np.uint32)
    row = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) + first.as_py() for x, first in zip(sent.column("rows"), sent.column("row"))])
    wanted, at = np.unique(keys, return_inverse=True)
    at = np.repeat(at, times)
    # In one order whatever the order of arrival.
    order = np.lexsort((at, row))
    found, own = np.unique(row[order], return_inverse=True)
    return _packed_sums(found, np.bincount(own, log10_of(trie, wanted).astype(np.float64)[at[order]]), None)


def _settle(low):
    """A bucket's partial sums; buckets below 0 are those of the trie."""

    def run(part: pa.Table) -> pa.Table:
        return _settle_grams(part, low.value) if part.column("bucket")[0].as_py() < 0 else _settle_tokens(part)

    return run


def _settle_tokens(part: pa.Table) -> pa.Table:
    """A bucket's documents as they are, and the shares of the tokens that fell into the bucket, packed by block of documents."""
    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    packs = part.filter(pc.is_valid(part.column("keys")))
    plain = part.filter(pc.is_null(part.column("keys")))
    n = plain.num_rows
    block = pa.array(plain.column("row").to_numpy() // BLOCK, pa.int64())
    out = pa.table([block, *(plain.column(c) for c in names[1:8]), *(pa.nulls(n, pa.binary()) for _ in range(3))], names=names)
    if not packs.num_rows:
        return out
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in packs.column(name)]
    keys, times = np.concatenate(read("keys", np.uint64)), np.concatenate(read("counts", np.uint32)).astype(np.int64)
    row = np.concatenate([x.astype(np.int64) + low.as_py() for x, low in zip(read("rows", np.uint32), packs.column("row"))])
    held, times = times & 1, times >> 1
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    trained = np.add.reduceat(np.where(held == 0, times, 0)[order], first)
    count = np.empty(len(keys), np.int64)
    count[order] = np.repeat(trained, np.diff(np.append(first, len(keys))))
    found, at = np.unique(row, return_inverse=True)
    base = np.bincount(at, times * np.log10(count + 1))
    known = np.bincount(at, times * (count > 0)).astype(np.int64)
    return pa.concat_tables([out, _packed_sums(found, base, known)])


def _sum_block(part: pa.Table) -> pa.Table:
    """A block's documents with all their shares added."""
    plain, packs = part.filter(pc.is_null(part.column("rows"))), part.filter(pc.is_valid(part.column("rows")))
    base, known, score = np.zeros(BLOCK), np.zeros(BLOCK, np.int64), np.zeros(BLOCK)
    # In one order whatever the order of arrival, so that sums repeat to the last bit.
    for rows_, sums, knowns in sorted(zip(*(packs.column(c).to_pylist() for c in ("rows", "sums", "knowns"))), key=lambda x: (x[0], x[1], x[2] or b"")):
        at = np.frombuffer(rows_, np.uint16)
        if knowns is None:
            score[at] += np.frombuffer(sums, np.float64)
        else:
            base[at] += np.frombuffer(sums, np.float64)
            known[at] += np.frombuffer(knowns, np.uint32)
    at = plain.column("row").to_numpy() % BLOCK
    return pa.table({
        "doc_id": plain.column("doc_id"), "held_out": plain.column("held_out"), "n_tokens": plain.column("n_tokens"), "n_known": pa.array(plain.column("n_known").to_numpy() + known[at]),
        "base_score": pa.array(plain.column("base").to_numpy() + base[at]), "score": pa.array(plain.column("score").to_numpy() + score[at]),
    })


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    rows.small_batches(spark)
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), (rows.fold_of(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text"))
    gram_buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    model, low, trie = train(marked.where(~F.col("held_out")).select("text"), gram_buckets)
    rows.release(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.tokens // PER_BUCKET))
    sent = marked.mapInArrow(_send(spark.sparkContext.broadcast(model), buckets, gram_buckets), _SENT)
    counted = trie.select((-1 - F.col("bucket")).alias("bucket"), "keys", "counts")
    partial = sent.unionByName(counted, allowMissingColumns=True).groupBy("bucket").applyInArrow(_settle(low), _PARTIAL)
    added = partial.groupBy("block").applyInArrow(_sum_block, _SCORED)
    return added.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
