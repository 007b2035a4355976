"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are ratios of whole texts, computed in numpy for chunks of documents. The trees are fitted on the
driver to the statistics of a bounded sample of labelled rows (``FIT_ROWS``); all have the same depth and are
flattened into arrays, so that scoring walks all trees of all documents of a chunk with one gather a level.

Defined results: a null or empty text has statistics of 0 and gets a score as any other; labels other than 0
and 1 are ignored; with no usable label every score is 0.5, with labels of one kind the smoothed share of it;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hostrules, lexer, rows

FIT_ROWS = 20_000
BINS = 64

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "symbol": b"#*$%&|<>", "pipe": b"|", "bang": b"!?",
    "stop": b".", "pause": b",;:", "quote": b"\"'`", "bracket": b"()[]{}", "link": b"@/\\_=+~^",
}


def statistics(chunk: lexer.Chunk) -> np.ndarray:
    """One row of float64 ratios for each document."""
    found = lexer.words(chunk, fold=False)
    counted = hostrules.counts(chunk)
    size = np.diff(chunk.offs).astype(float)
    n = np.diff(found.bounds).astype(float)
    some, bytes_ = np.maximum(n, 1), np.maximum(size, 1)
    lengths = (found.ends - found.starts).astype(np.int64)
    mean = lexer.sums(lengths, found.bounds) / some
    square = lexer.sums(lengths * lengths, found.bounds) / some
    adjacent = np.zeros(len(found.keys), dtype=bool)
    if len(adjacent):
        adjacent[1:] = (found.keys[1:] == found.keys[:-1]) & (found.doc[1:] == found.doc[:-1])
    order = lexer.sort_in_docs(found.doc, found.keys) if len(adjacent) else np.zeros(0, np.int64)
    keys, doc = found.keys[order], found.doc[order]
    again = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    repeated = np.bincount(doc[1:][again], minlength=len(chunk)) / some
    line_count = np.maximum(counted["n_lines"], 1)
    loud = np.zeros(len(lengths), dtype=np.int64)
    if len(loud):
        upper = np.append(0, np.cumsum(lexer.byte_mask(_CLASSES["upper"])[chunk.data]))
        loud = ((upper[found.ends] - upper[found.starts]) * 2 > lengths).astype(np.int64)
    columns = [np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(square - mean * mean, 0)), repeated, lexer.sums(adjacent, found.bounds) / some]
    columns += [counted["n_repeat_words"] / some, counted["n_dup_lines"] / line_count, n / line_count, lexer.sums(loud, found.bounds) / some]
    columns += [lexer.sums((lengths <= 3).astype(np.int64), found.bounds) / some, lexer.sums((lengths >= 12).astype(np.int64), found.bounds) / some]
    columns += [lexer.sums(lexer.byte_mask(x)[chunk.data], chunk.offs) / bytes_ for x in _CLASSES.values()]
    columns.append(lexer.sums(chunk.data >= 128, chunk.offs) / bytes_)
    return np.column_stack(columns)


@dataclass
class Forest:
    """``trees`` complete trees of one depth: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margins(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(stats), self.start)
        trees, inner = self.feature.shape
        node = np.zeros((len(stats), trees), dtype=np.int64)
        at, row = np.arange(trees) * inner, np.arange(len(stats))[:, None]
        while node.size and node[0, 0] < inner:
            flat = at + node
            node = 2 * node + 1 + (stats[row, self.feature.ravel()[flat]] > self.threshold.ravel()[flat])
        return self.start + self.leaf[np.arange(trees), node - inner].sum(axis=1)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(stats)))


def fit(stats: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Boosts trees on histograms of ``BINS`` quantile bins by the gradient and curvature of the log loss."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Forest(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(p / (1 - p))))
    n, k = stats.shape
    cuts = [np.unique(np.quantile(stats[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(c, stats[:, j], side="left") for j, c in enumerate(cuts)])
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, start)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    columns = np.arange(k) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            cell = ((node - first)[:, None] * (k * BINS) + columns + binned).ravel()
            gs, hs = (np.bincount(cell, np.repeat(x, k), minlength=width * k * BINS).reshape(width, k, BINS).cumsum(axis=2) for x in (g, h))
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[t, first + i], threshold[t, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (stats[np.arange(n), feature[t, node]] > threshold[t, node])
        sum_g, sum_h = (np.bincount(node - inner, x, minlength=inner + 1) for x in (g, h))
        leaf[t] = -rate * sum_g / (sum_h + l2)
        margin += leaf[t, node - inner]
    return Forest(feature, threshold, leaf, start)


def _sample_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for chunk in lexer.chunks(batch.column(0)):
            stats = statistics(chunk)
            flat = pa.array(stats.ravel())
            yield pa.record_batch({"stats": pa.ListArray.from_arrays(pa.array(np.arange(len(chunk) + 1) * stats.shape[1], pa.int32()), flat), "y": batch.column(1).slice(chunk.first, len(chunk))})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, fit_rows: int = FIT_ROWS) -> Forest:
    """Trees fitted to at most ``fit_rows`` labelled documents outside the held-out fold.

    The sample is balanced where it can be; the start margin is moved back to the labels' own base rate.
    """
    got = rows.labelled_sample(docs, labels, label, id_col, text_col, folds, held, fit_rows).mapInArrow(_sample_rows, "stats array<double>, y int").collect()
    stats, y = np.array([x[0] for x in got]), np.array([x[1] for x in got], dtype=float)
    order = np.lexsort((*stats.T, y)) if len(y) else []
    model = fit(stats[order], y[order])
    if len(model.leaf):
        p, share = rows.base_rate(labels, label, folds, held), y.mean()
        model.start += float(np.log(p / (1 - p)) - np.log(share / (1 - share)))
    return model


def score(docs: DataFrame, model: Forest, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    return rows.append(docs, text_col, lambda chunk: {name: model.scores(statistics(chunk))}, {name: "double"})


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    out = score(docs.select(F.col(id_col), (rows.fold_of(id_col, 3) == 1).alias("held_out"), F.col(text_col)), model, text_col)
    return out.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; its columns stay as they are."""
    model = train(docs, labels, text_col=text_col)
    name = f"{rows.free_prefix(docs)}score"
    return rows.like(score(docs, model, text_col, name).where(F.col(name) >= 0.5), docs)
