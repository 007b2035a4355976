"""Token-id files: canonical length-limited Huffman codes of the ids of a tokenised corpus.

*Encoding.* Every text is cut into ids once; ids go to a table in the shared folder. Their counts over the whole corpus
(one row an id and task, added up by Spark; the vocabulary bounds what the driver sees) give code lengths of at most
``LIMIT`` bits by package-merge, and the lengths alone give the canonical codes. Documents are dealt by ranges of their
order, one range a file, and each task packs its ids into bits.

*File.* ``MAGIC``, sizes, the deflated code lengths, for each document its id, null mark and number of ids, for each block
of ``BLOCK`` ids the bit at which it starts, the bits as big-endian 32-bit words, and the crc32 of all that. A file
explains itself, and any block can be decoded without those before it: ``read_ids`` does so for a range of ids.

*Decoding.* A table of ``2**LIMIT`` entries maps the next bits to an id and its length. Blocks are independent, so all
blocks of a slab advance together, one id a step, as numpy vectors.

*Tokens.* Whole texts are encoded by default. For tokenizers that drop white space, lower-case, and never join ASCII letters or
digits with other ASCII signs than the apostrophe (``word_bpe_49k.json`` is one), ``words_apart`` has a task encode every
distinct run (by 64-bit key) of either kind once and put texts together from these; texts with the string of an added token stay whole.

A task that is run again writes the same bytes under the same name, first beside it, then moved: ranges come from a
written table and rows are ordered by unique keys. The list of files is a checkpoint; other files in the folder are ignored.

Defined results: documents ascend by doc_id, null ids first; rows of one id ascend by number of ids, then by crc32; equal
rows each stand there. A null or empty text has the end id only. No documents make no file. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from . import lexer, rows

END_ID = 2
#: Longest code in bits; more only if the ids that occur need more.
LIMIT = 16
#: Ids between two checkpoints.
BLOCK = 1024
#: Ids that one file should hold, about.
PER_FILE = 1 << 22
#: Blocks that are decoded together.
SLAB = 4096
#: Words and bytes of words that a worker remembers before it starts anew.
WORDS, WORD_BYTES = 400_000, 1 << 24

MAGIC = b"IDHUF01\n"
_HEAD = "<8sIIQQQI"


#: White space 0, ASCII signs but the apostrophe 1, all other bytes 2.
_KIND = np.full(256, 2, np.uint8)
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 1
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
#: Letters that normalising leaves as they are.
_LATIN = re.compile("[a-zß-öø-ÿ]+")


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of one kind inside documents and the bounds of each document's runs; beside an apostrophe or a byte that is not ASCII no run ends but at white space."""
    kind, ascii_ = _KIND[data], (data < 128) & (data != ord("'"))
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] == 0) | (kind[:-1] == 0) | ((kind[1:] != kind[:-1]) & ascii_[1:] & ascii_[:-1])
    cut[offs] = True
    edges = np.flatnonzero(cut)
    keep = kind[edges[:-1]] > 0
    starts = edges[:-1][keep]
    return starts, edges[1:][keep], np.searchsorted(starts, offs)


class WordEncoder:
    """Ids of texts, put together from the ids of their runs."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: plain.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._forget()

    def _forget(self) -> None:
        self.bytes = 0
        #: Keys of known runs in ascending order, and where the ids of each begin in ``flat`` and how many they are.
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, new: list[str]) -> None:
        """Adds runs, given by ascending new keys."""
        tokenize, latin, letters = self.tokenizer.model.tokenize, _LATIN.fullmatch, self.letters
        # One word for the model, in the model's spelling of bytes; all else goes the whole way.
        found = [[t.id for t in tokenize(run if run.isascii() else run.translate(letters))] if latin(run) else None for run in new]
        others = [i for i, ids in enumerate(found) if ids is None]
        if others:
            for i, made in zip(others, self.tokenizer.encode_batch_fast([new[i] for i in others], add_special_tokens=False)):
                found[i] = made.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.sizes = np.insert(self.keys, at, keys), np.insert(self.sizes, at, sizes)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))
        self.bytes += sum(map(len, new))

    def apart(self, chunk: lexer.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of documents and the bounds of each document's ids."""
        data = lexer.FOLD[chunk.data]
        starts, ends, bounds = _runs(data, chunk.offs) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk) + 1, np.int64))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(chunk) + 1, np.int64)
        keys, first, at = np.unique(chunk.keys_of(starts, ends, fold=True), return_index=True, return_inverse=True)
        if len(self.keys) > WORDS or self.bytes > WORD_BYTES:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self.keys, keys)
        slot = place[at]
        size = self.sizes[slot]
        upto = np.append(0, np.cumsum(size))
        source = np.repeat(self.starts[slot] - upto[:-1], size) + np.arange(upto[-1])
        return self.flat[source], upto[bounds]

    def documents(self, chunk: lexer.Chunk, words_apart: bool) -> list[np.ndarray]:
        """The ids of each document of a chunk."""
        texts = [chunk.data[a:b].tobytes() for a, b in zip(chunk.offs, chunk.offs[1:])]
        if not words_apart:
            return [self.whole(t.decode()) for t in texts]
        ids, bounds = self.apart(chunk)
        return [self.whole(t.decode()) if any(x in t for x in self.added) else ids[a:b] for t, a, b in zip(texts, bounds, bounds[1:])]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", words_apart: bool = False) -> DataFrame:
    """One row a document: doc_id, row (unique), n_tokens, crc (of little-endian 32-bit ids), ids (packed in 16 bits if they fit, else 32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for chunk in lexer.chunks(batch.column(1)):
                own = [np.append(ids, np.uint32(end_id)) for ids in coder.documents(chunk, words_apart)]
                n = len(own)
                made = {
                    "doc_id": batch.column(0).slice(chunk.first, n), "row": pa.array(row + np.arange(n)), "n_tokens": pa.array([len(x) for x in own], pa.int64()),
                    "crc": pa.array([zlib.crc32(x) for x in own], pa.int64()), "ids": pa.array([(x.astype(np.uint16) if x.max() < 1 << 16 else x).tobytes() for x in own], pa.binary()),
                }
                row += n
                yield pa.record_batch(made)

    rows.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, row long, n_tokens long, crc long, ids binary")


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32)


def id_counts(table: DataFrame) -> np.ndarray:
    """How often each id stands in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for packed, n in zip(batch.column(0), batch.column(1).to_pylist()):
                own = np.bincount(_unpacked(packed.as_buffer(), n))
                if len(own) > len(counts):
                    counts = np.append(counts, np.zeros(len(own) - len(counts), np.int64))
                counts[: len(own)] += own
        ids = np.flatnonzero(counts)
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(counts[ids], pa.int64())})

    found = table.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    out = np.zeros(max((i for i, _ in found), default=-1) + 1, np.int64)
    for i, n in found:
        out[i] = n
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (or what the ids need), by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    merged, leaves = weights, []
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        every = np.concatenate([weights, pairs])
        order = np.argsort(every, kind="stable")
        merged = every[order]
        leaves.append(order < n)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for leaf in reversed(leaves):
        own = int(np.count_nonzero(leaf[:take]))
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    if len(used):
        own = lengths[used].astype(np.int64)
        top = int(own[-1])
        # Each code starts where the share of those before it ends.
        share = np.left_shift(1, top - own)
        codes[used] = (np.cumsum(share) - share) >> (top - own)
    return codes


class Decoder:
    """The table of a code: the next ``width`` bits give an id and its length."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.width = max(int(lengths.max(initial=1)), 1)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        times = np.left_shift(1, self.width - lengths[used].astype(np.int64))
        self.ids, self.lengths = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        self.ids[: times.sum()], self.lengths[: times.sum()] = np.repeat(used, times), np.repeat(lengths[used], times)

    def blocks(self, words: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Ids of blocks of ``n`` ids that start at the bits ``at``; only the last block may be short."""
        out = np.zeros((len(at), int(n.max(initial=0))), np.uint32)
        at = at.astype(np.int64)
        shift, mask = 64 - self.width, np.uint64((1 << self.width) - 1)
        for step in range(out.shape[1]):
            if step == n[-1]:
                at = at[:-1]
            word = at >> 5
            bits = (words[word] << np.uint64(32) | words[word + 1]) >> (shift - (at & 31)).astype(np.uint64) & mask
            out[: len(at), step] = self.ids[bits]
            at = at + self.lengths[bits]
        return out.reshape(-1)[: int(n.sum())]


def pack(ids: np.ndarray, lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids as big-endian 32-bit words, the starting bit of each block, and the number of bits."""
    codes = canonical(lengths)
    size = lengths[ids].astype(np.int64)
    start = np.cumsum(size) - size
    bits = int(size.sum())
    out = np.zeros(bits // 32 + 3, np.uint64)
    for low in range(0, len(ids), 1 << 18):
        some = slice(low, low + (1 << 18))
        word = start[some] >> 5
        window = codes[ids[some]] << (64 - (start[some] & 31) - size[some]).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] |= np.bitwise_or.reduceat(window >> np.uint64(32), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(window & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4"), start[::block].astype("<u8"), bits


def file_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], sizes: list[int], block: int = BLOCK) -> bytes:
    words, marks, bits = pack(ids, lengths, block)
    table = zlib.compress(lengths.tobytes())
    body = b"".join([
        struct.pack(_HEAD, MAGIC, len(lengths), block, len(sizes), len(ids), bits, len(table)), table, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], np.uint8).tobytes(),
        np.array(sizes, "<u8").tobytes(), marks.tobytes(), words.tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class IdFile:
    """One file: its documents and any range of its ids."""

    def __init__(self, raw: bytes) -> None:
        magic, alphabet, self.block, n_docs, self.n_ids, bits, table = struct.unpack_from(_HEAD, raw)
        if magic != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("not an id file, or a damaged one")
        at = struct.calcsize(_HEAD)
        self.lengths = np.frombuffer(zlib.decompress(raw[at : at + table]), np.uint8, alphabet)
        self.decoder = Decoder(self.lengths)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        at += table
        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if null else i for i, null in zip(ids.tolist(), nulls.tolist())]
        self.sizes = take("<u8", n_docs).astype(np.int64)
        self.marks = take("<u8", -(-self.n_ids // self.block))
        self.words = take(">u4", bits // 32 + 3).astype(np.uint64)

    def slabs(self, first: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first id, ids) of the blocks that hold the ids from ``first`` to before ``stop``."""
        stop = self.n_ids if stop is None else stop
        last = -(-stop // self.block)
        for low in range(first // self.block, last, SLAB):
            high = min(low + SLAB, last)
            n = np.minimum(self.n_ids - np.arange(low, high) * self.block, self.block)
            yield low * self.block, self.decoder.blocks(self.words, self.marks[low:high], n)

    def ids(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``first`` to before ``stop``, decoded from the checkpoint before them."""
        stop = self.n_ids if stop is None else stop
        parts = list(self.slabs(first, stop))
        return np.concatenate([p for _, p in parts])[first - parts[0][0] :][: stop - first] if parts and stop > first else np.zeros(0, np.uint32)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(docs: DataFrame, path: str, folder: str, per_file: int = PER_FILE, block: int = BLOCK, limit: int = LIMIT, **options) -> DataFrame:
    """Writes the id files of ``docs`` to ``folder``; returns their list: name, start (ids before the file), n_docs, n_ids, n_bits."""
    spark = docs.sparkSession
    ids_at, files_at = f"{folder}/tokenised", f"{folder}/files"
    tokenised(docs, path, **options).write.option("compression", "zstd").parquet(ids_at)
    table = spark.read.schema("doc_id long, row long, n_tokens long, crc long, ids binary").parquet(ids_at)
    counts = id_counts(table)
    lengths = code_lengths(counts, limit)
    shared = spark.sparkContext.broadcast(lengths)
    store, place = _store(files_at)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sizes, parts = [], [], []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            own = batch.column(1).to_pylist()
            sizes += own
            parts += [_unpacked(x.as_buffer(), n).copy() for x, n in zip(batch.column(2), own)]
        if not sizes:
            return
        part = TaskContext.get().partitionId()
        ids = np.concatenate(parts)
        raw = file_bytes(ids, shared.value, doc_ids, sizes, block)
        name, (store, place) = f"ids-{part:06d}.huf", _store(files_at)
        beside = f"{place}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as out:
            out.write(raw)
        store.move(beside, f"{place}/{name}")
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": pa.array([len(sizes)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "n_bits": pa.array([int(shared.value[ids].astype(np.int64).sum())], pa.int64())})

    files = max(int(counts.sum()) // per_file, 1)
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("crc"), F.col("row")]
    dealt = table.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    # One row a file; the sums before them are made on the driver.
    made = cut_lineage(dealt.mapInArrow(run, "part int, name string, n_docs long, n_ids long, n_bits long"))
    found = sorted(tuple(r) for r in made.collect())
    starts = np.cumsum([0, *(r[3] for r in found)]).tolist()
    return spark.createDataFrame([(r[1], s, *r[2:]) for r, s in zip(found, starts)], "name string, start long, n_docs long, n_ids long, n_bits long")


def read(spark: SparkSession, folder: str, listed: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the listed files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array of int)."""
    files_at = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(files_at)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{place}/{name}") as stored:
                    file = IdFile(stored.read())
                ends = np.cumsum(file.sizes)
                starts = ends - file.sizes
                crcs = np.zeros(len(ends), np.int64)
                whole: list[list[np.ndarray]] = [[] for _ in ends] if with_ids else []
                for first, ids in file.slabs():
                    # Documents may begin in one slab and end in another, so their sums are carried on.
                    for i in range(int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(starts, first + len(ids)))):
                        own = ids[max(starts[i] - first, 0) : ends[i] - first]
                        crcs[i] = zlib.crc32(own, int(crcs[i]))
                        if with_ids:
                            whole[i].append(own.astype(np.int32))
                made = {"doc_id": pa.array(file.doc_ids, pa.int64()), "start": pa.array(starts + before, pa.int64()), "n_tokens": pa.array(file.sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                yield pa.record_batch(made | ({"ids": pa.array([np.concatenate(x) for x in whole], pa.list_(pa.int32()))} if with_ids else {}))

    n = max(listed.count(), 1)
    return listed.select("name", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the files of ``docs`` and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    return read(spark, folder, write(docs, path, folder, **options))
