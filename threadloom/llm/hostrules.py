"""Rules on document statistics, judged by host: failure rates shrunk by an empirical beta prior.

Each rule has a strict limit, which rejects a document wherever it stands, and a watch limit, which rejects
it only on a host whose shrunk rate of documents over that limit is ``HOST_RATE`` or more. Rates are
shrunk to the mean of all hosts by a beta prior fitted to the hosts' rates by moments, so that a host of few
documents is judged by the prior, not by chance.

Texts are read once; what is shuffled is one row of counts per document and host. Hosts are counted with
pre-aggregation, so one host may hold any share of the rows, and only hosts under watch are joined back.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated rows
count as often as they stand there; without documents there is no host and no row; extra columns are kept by ``keep_good``,
whatever their names, and ignored by ``document_verdicts``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lexer, rows

SYMBOLS = lexer.byte_mask(b"#*$%&|<>")
HOST_RATE = 0.3
COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_lines": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def _repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where a document has the same key elsewhere too."""
    order = lexer.sort_in_docs(doc, keys)
    keys, doc = keys[order], doc[order]
    same = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    flags = np.zeros(len(order), dtype=bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return flags


def _extra(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, how many keys are equal to an earlier one."""
    order = lexer.sort_in_docs(doc, keys)
    keys, doc = keys[order], doc[order]
    return np.bincount(doc[1:][(keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])], minlength=n_docs)


def counts(chunk: lexer.Chunk) -> dict[str, np.ndarray]:
    """The statistics in ``COUNTS`` of each document of a chunk."""
    found = lexer.words(chunk, fold=False)
    n = len(chunk)
    if not len(found.keys):
        zero = np.zeros(n, np.int64)
        return {k: zero for k in COUNTS} | {"n_symbols": lexer.sums(SYMBOLS[chunk.data], chunk.offs)}
    chars = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))
    starts, ends, doc = lexer.lines(chunk)
    worded = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    keys, at = lexer.grams(found, 3)
    covered = np.zeros(len(found.keys) + 3, dtype=bool)
    hit = at[_repeats(keys, found.doc[at])]
    for i in range(3):
        covered[hit + i] = True
    return {
        "n_words": np.diff(found.bounds), "word_chars": lexer.sums(chars[found.ends] - chars[found.starts], found.bounds), "n_symbols": lexer.sums(SYMBOLS[chunk.data], chunk.offs),
        "n_lines": np.bincount(doc, minlength=n), "n_dup_lines": _extra(chunk.keys_of(starts, ends), doc, n), "n_repeat_words": lexer.sums(covered[: len(found.keys)], found.bounds),
    }


def rules(prefix: str = "") -> dict[str, tuple[Column, Column]]:
    """Name: (strict limit passed, watch limit passed); the counts' columns may carry a prefix."""
    c = lambda name: F.col(prefix + name)
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "symbols": (2 * c("n_symbols") > words, 10 * c("n_symbols") > words),
        "dup_lines": (2 * c("n_dup_lines") > c("n_lines"), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "word_length": (c("word_chars") < 2 * words, (c("word_chars") < 3 * words) | (c("word_chars") > 12 * words)),
    }


def base_failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))


def _host(host_col: str) -> Column:
    """The host as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))


def host_rates(counted: DataFrame, host_col: str) -> DataFrame:
    """One row per (host, rule): documents, failures of the watch limit, the rate shrunk by the rule's beta prior.

    The prior's mean is the rate of all documents; its strength comes from the variance of the hosts' rates
    beyond what chance alone would give.
    """
    limits = rules()
    per_host = counted.groupBy(_host(host_col).alias("host_key")).agg(F.count(F.lit(1)).alias("docs"), *(F.sum(watch.cast("long")).alias(x) for x, (_, watch) in limits.items()))
    long = cut_lineage(per_host.select("host_key", "docs", F.explode(F.create_map(*(y for x in limits for y in (F.lit(x), F.col(x))))).alias("rule", "failures")))
    # A row for each rule: the only thing that comes to the driver.
    means = long.groupBy("rule").agg(F.sum("failures").alias("f"), F.sum("docs").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("sq")).collect()
    rate = F.lit(None).cast("double")
    for rule, f, n, hosts, sq in means:
        p = f / n
        between = max(sq / n - p * p - p * (1 - p) * (hosts - 1) / n, 1e-9)
        strength = min(max(p * (1 - p) / between - 1, 1.0), 1e6)
        rate = F.when(F.col("rule") == rule, (F.col("failures") + p * strength) / (F.col("docs") + strength)).otherwise(rate)
    return long.withColumn("rate", rate)


def watched_hosts(counted: DataFrame, host_col: str, host_rate: float = HOST_RATE) -> DataFrame:
    """Hosts with a shrunk rate of ``host_rate`` or more, and the rules that they fail."""
    return cut_lineage(host_rates(counted, host_col).where(F.col("rate") >= host_rate).groupBy("host_key").agg(F.collect_set("rule").alias("host_rules")))


def judge(counted: DataFrame, watched: DataFrame, host_col: str, prefix: str = "") -> DataFrame:
    """``counted`` with ``base_failed`` and ``kept`` after the verdicts of ``watched`` hosts (names with the prefix)."""
    own = rows.free_prefix(counted)
    verdicts = watched.select(F.col("host_key").alias(f"{own}host"), F.col("host_rules").alias(f"{own}rules"))
    out = counted.withColumn(f"{own}key", _host(host_col)).join(rows.small_side(verdicts), F.col(f"{own}key") == F.col(f"{own}host"), "left")
    strict = F.lit(False)
    for name, (limit, watch) in rules(prefix).items():
        strict = strict | limit | (watch & F.coalesce(F.array_contains(f"{own}rules", name), F.lit(False)))
    return out.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}kept", ~base_failed(prefix) & ~strict).drop(f"{own}key", f"{own}host", f"{own}rules")


def document_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, counts, ``base_failed``, ``kept``."""
    counted = cut_lineage(rows.append(docs.select(id_col, host_col, text_col), text_col, counts, COUNTS).drop(text_col))
    return judge(counted, watched_hosts(counted, host_col), host_col)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules and their hosts' verdicts keep; its columns stay as they are.

    Texts are counted twice, once for the hosts and once beside the rows, rather than moved.
    """
    light = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    watched = watched_hosts(rows.append(light, "text", counts, COUNTS).drop("text"), "host")
    own = rows.free_prefix(docs)
    fields = {f"{own}{k}": v for k, v in COUNTS.items()}
    beside = rows.append(docs, text_col, lambda chunk: {f"{own}{k}": v for k, v in counts(chunk).items()}, fields)
    return rows.like(judge(beside, watched, host_col, own).where(f"{own}kept"), docs)
