"""One thin query for each operator: it reads a whole table, calls the operator and shapes the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, hostrules, idfiles, jaccard, knn, licenses, manifest, mixing, packing, ppm, quality, rows, toxicity, warc

#: Name of the vocabulary file, looked up where the public tokenizers are installed.
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


@query
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hostrules.document_verdicts(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


@query
def op2_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


@query
def op9_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLES["op9_voronoi_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op1_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


ORACLES["op6_license_diagonals"] = licenses.ORACLE


@query
def op4_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 9))


ORACLES["op4_raked_mixture"] = mixing.ORACLE


@query
def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.audit(pages, warc.damaged(pages))


ORACLES["op7_merkle_audit"] = warc.ORACLE


#: Vocabulary whose ids are written to files.
WORD_VOCABULARY = "word_bpe_49k.json"


def word_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(WORD_VOCABULARY))


@query
def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(_table(spark, sf_dir, "documents"), word_vocabulary(), words_apart=True)


@query
def op12_persistent_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"), rows.fold_of("doc_id", 2) == 0)


ORACLES["op12_persistent_manifest"] = manifest.ORACLE


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = collocations.ORACLE
