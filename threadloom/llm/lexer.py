"""Whole texts of an Arrow column as numpy arrays: words, lines, 64-bit keys and shingles.

Texts are cut into words without a Python loop: a byte table says which bytes belong to words,
and prefix sums of ``value[byte] * P**position`` give the key of any byte range. Chunks hold whole
documents, about ``CHUNK_BYTES`` at a time, so the temporary arrays stay small whatever the batch.
A null text counts as an empty one. Keys are 64 bits wide; equal keys are taken as equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
CHUNK_DOCS = 60_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PRIME = 0xD6E8FEB86659FD93


def mix(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys that spreads every bit (splitmix finaliser)."""
    keys = (keys ^ (keys >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> U64(27))) * U64(0x94D049BB133111EB)
    return keys ^ (keys >> U64(31))


def byte_mask(members: bytes, inverse: bool = False) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(members)] = True
    return ~mask if inverse else mask


#: Bytes of words ``[^\x20\x09-\x0D]+``; bytes of one UTF-8 character are all inside or all outside.
SPACED = byte_mask(b"\x20\x09\x0a\x0b\x0c\x0d", inverse=True)
#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)


@lru_cache(maxsize=4)
def _byte_values(fold: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_BASE))
    return values[FOLD] if fold else values


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P**i`` and ``P**-i`` modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            grown = np.full(size, base, dtype=U64)
            grown[0] = 1
            _powers[name] = np.cumprod(grown, dtype=U64)
    return _powers["up"], _powers["down"]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges between neighbouring ``bounds``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype == bool else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class Chunk:
    """Documents ``first`` to ``last`` of a batch; ``offs`` are their byte bounds inside ``data``."""

    first: int
    last: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def keys_of(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """A key for each byte range."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(_byte_values(fold)[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))

    def ranges(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in ``mask`` that stay inside a document: starts, ends, and the bounds of each document's runs."""
        inside = mask[self.data]
        edges = self.offs[:-1][self.offs[:-1] < self.offs[1:]]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[np.append(edges[1:], len(inside)) - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)


@dataclass
class Words:
    """Words of a chunk: byte ranges, keys, the bounds of each document's words, and each word's document."""

    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[Chunk]:
    """Whole documents, about ``CHUNK_BYTES`` at a time (one longer document makes a chunk of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, raw_offs, raw = column.buffers()
    offs = np.frombuffer(raw_offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n, first + CHUNK_DOCS)
        yield Chunk(first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last


def words(chunk: Chunk, mask: np.ndarray = SPACED, fold: bool = True) -> Words:
    if not len(chunk.data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none.astype(U64), np.zeros(len(chunk) + 1, np.int64), none)
    starts, ends, bounds = chunk.ranges(mask)
    return Words(starts, ends, chunk.keys_of(starts, ends, fold), bounds, np.repeat(np.arange(len(chunk)), np.diff(bounds)))


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces between newlines: starts, ends and the document of each; every document has one at least."""
    cuts = np.flatnonzero(chunk.data == 10)
    doc_of_cut = np.searchsorted(chunk.offs, cuts, side="right") - 1
    starts = np.concatenate([chunk.offs[:-1], cuts + 1])
    ends = np.concatenate([chunk.offs[1:], cuts])
    doc = np.concatenate([np.arange(len(chunk)), doc_of_cut])
    order = np.lexsort((starts, doc))
    return starts[order], np.sort(ends[np.lexsort((ends, doc))]), doc[order]


def grams(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of ``k`` words inside a document and the index of each window's first word."""
    m = len(found.keys) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(found.doc[:m] == found.doc[k - 1 :])
    total = np.zeros(len(at), dtype=U64)
    for i in range(k):
        total = total * U64(_BASE) + found.keys[at + i]
    return mix(total), at


def sort_in_docs(doc: np.ndarray, *levels: np.ndarray) -> np.ndarray:
    """An order by document, then by ``levels`` from first to last; all but the last level are small integers."""
    order = np.argsort(levels[-1])
    for level in levels[-2::-1]:
        order = order[np.argsort(level[order], kind="stable")]
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def shingle_sets(chunk: Chunk, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each document: document, key (ascending inside a document), bounds.

    A document of one to ``k - 1`` words has its whole word sequence as the only shingle; one without words has none.
    """
    found = words(chunk)
    keys, at = grams(found, k)
    doc = found.doc[at]
    count = np.diff(found.bounds)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first, own = found.bounds[short], count[short]
        total = own.astype(U64) * U64(0xA0761D6478BD642F)
        for i in range(k - 1):
            has = own > i
            total[has] = total[has] * U64(_BASE) + found.keys[first[has] + i]
        keys, doc = np.concatenate([keys, mix(total)]), np.concatenate([doc, short])
    order = sort_in_docs(doc, keys)
    keys, doc = keys[order], doc[order]
    if len(keys):
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        keys, doc = keys[new], doc[new]
    return doc, keys, np.searchsorted(doc, np.arange(len(chunk) + 1))


def totals(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the summed weight of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)
