"""Mixing to target weights: iterative proportional fitting of tokens by source, language and topic, then sampling.

Documents are counted by cell (source, language, topic). Raking finds a factor for each source, language and topic such that
the cells' tokens, multiplied by their three factors, add up to the target shares on all three marginals. A round adjusts
sources, then languages, then topics. Sources may be many: they stay distributed, one row each with its cells. Languages and
topics mostly are small vocabularies: a round brings one sum for each (language, topic) pair to the driver, at most ``MAX_PAIRS``;
where there are more, all three stay distributed and a round is three grouped sums with joins, with equal results.

A document stays with probability ``min(1, scale * factors)``, where the scale makes the expected tokens ``budget`` times all
tokens before the minimum; whether it stays is decided by a hash of its id, so a run repeats and a document's fate does not
depend on others' ids. Cells that would need more than all they have give all they have.

Targets default to tempered shares, ``tokens ** alpha``, which raise small sources against one that holds a third of the rows.
Everything is built-in functions. Text moves nowhere: it is counted where it is read.

Defined results: null sources and languages are a source and a language of their own; a null or empty text has 0 tokens and the
topic ``empty`` and stays with the probability of its cell's factors (0 tokens count as one for factors' sake); a null id hashes
as the empty text; rows of one id share their fate if they share their cell; no rows give no rows; extra columns are kept by
``sample`` and ignored by ``weights``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rows import free_prefix, like, small_side

BUDGET = 0.6
ROUNDS = 8
ALPHA = {"source": 0.7, "lang": 0.8, "topic": 0.9}
MAX_PAIRS = 100_000
_NULL = "\\N"


def tokens_of(text: Column) -> Column:
    """White-space words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by form: tables, marked-up text, and prose by size."""
    text = F.coalesce(text, F.lit(""))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&!", ""))
    return F.when(tokens == 0, "empty").when(8 * bars > tokens, "table").when(4 * marks > tokens, "marked").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("book")


def counted(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, prefix: str = "__") -> DataFrame:
    """``docs`` with its cell and tokens as ``__source``, ``__lang``, ``__topic``, ``__tokens``, or with another prefix."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NULL))
    out = docs.withColumns({f"{prefix}source": key(source_col), f"{prefix}lang": key(lang_col), f"{prefix}tokens": tokens_of(F.col(text_col))})
    return out.withColumn(f"{prefix}topic", topic_of(F.col(text_col), F.col(f"{prefix}tokens")) if topic is None else topic)


def _shares(of: dict[str, float], alpha: float) -> dict[str, float]:
    raised = {k: v**alpha for k, v in of.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def weights(cells: DataFrame, alpha: dict[str, float] = ALPHA, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells (__source, __lang, __topic, n tokens) with the probability of their documents."""
    pairs = [(x[0], x[1], x[2]) for x in cells.groupBy("__lang", "__topic").agg(F.sum("n")).orderBy("__lang", "__topic").limit(MAX_PAIRS + 1).collect()]
    if not pairs:
        return cells.withColumn("probability", F.lit(1.0))
    if len(pairs) > MAX_PAIRS:
        return _weights_of_many(cells, alpha, budget, rounds)
    langs, topics = ({k: sum(n for *key, n in pairs if key[i] == k) for k in sorted({p[i] for p in pairs})} for i in (0, 1))
    lang_share, topic_share = _shares(langs, alpha["lang"]), _shares(topics, alpha["topic"])
    at = F.create_map(*(x for i, (a, b, _) in enumerate(pairs) for x in (F.concat(F.lit(a), F.lit("\t"), F.lit(b)), F.lit(i))))
    placed = cells.withColumn("pair", at[F.concat("__lang", F.lit("\t"), "__topic")])
    rows = cut_lineage(placed.groupBy("__source").agg(F.collect_list(F.struct("pair", "n")).alias("cells"), F.sum("n").cast("double").alias("all")))
    power = rows.agg(F.sum(F.pow("all", F.lit(alpha["source"])))).first()[0]
    target = F.pow("all", F.lit(alpha["source"])) / power
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)
    fitted, sums = rows, {}
    for _ in range(rounds):
        others = F.array(*(F.lit(b[x] * c[y]) for x, y, _ in pairs))
        fitted = rows.withColumn("a", target / F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["n"] * F.get(others, x["pair"])))
        sums = dict(fitted.select("a", F.explode("cells").alias("x")).groupBy("x.pair").agg(F.sum(F.col("a") * F.col("x.n"))).collect())
        for x in b:
            b[x] = lang_share[x] / sum(sums[i] * c[p[1]] for i, p in enumerate(pairs) if p[0] == x)
        for y in c:
            c[y] = topic_share[y] / sum(sums[i] * b[p[0]] for i, p in enumerate(pairs) if p[1] == y)
    # Shares add up to 1, so the budget is the scale.
    total = sum(n for *_, n in pairs) * budget
    scale = total / sum(sums[i] * b[x] * c[y] for i, (x, y, _) in enumerate(pairs))
    factor = F.array(*(F.lit(b[x] * c[y] * scale) for x, y, _ in pairs))
    chance = fitted.select("__source", "a", F.explode("cells").alias("x")).select("__source", F.col("x.pair").alias("pair"), F.least(F.lit(1.0), F.col("a") * F.get(factor, F.col("x.pair"))).alias("probability"))
    return placed.join(chance, ["__source", "pair"]).drop("pair")


def _weights_of_many(cells: DataFrame, alpha: dict[str, float], budget: float, rounds: int) -> DataFrame:
    """``weights`` with all three vocabularies as tables: each step of a round is a grouped sum, joined back by its key."""
    names = {f"__{d}": a for d, a in alpha.items()}
    fitted = cells.withColumn("w", F.col("n").cast("double"))
    shares = {}
    for name, power in names.items():
        raised = cells.groupBy(name).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("share"))
        total = raised.agg(F.sum("share")).first()[0]
        shares[name] = cut_lineage(raised.select(name, (F.col("share") / F.lit(total)).alias("share")))
    for _ in range(rounds):
        for name, share in shares.items():
            factor = fitted.groupBy(name).agg(F.sum("w").alias("now")).join(share, name).select(name, (F.col("share") / F.col("now")).alias("factor"))
            fitted = fitted.join(factor, name).withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        fitted = cut_lineage(fitted)
    n, w = fitted.agg(F.sum("n").cast("double"), F.sum("w")).first()
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("w") * (budget * n / w) / F.col("n"))).select(*cells.columns, "probability")


def draw(id_col: str, salt: str = "mix") -> Column:
    """A number in [0, 1) from the id."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(16**13)


def _cells(with_cells: DataFrame, prefix: str = "__") -> DataFrame:
    names = [F.col(f"{prefix}{d}").alias(f"__{d}") for d in ALPHA]
    return cut_lineage(with_cells.groupBy(*names).agg(F.sum(F.greatest(f"{prefix}tokens", F.lit(1))).alias("n")))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, source, lang, topic, tokens, probability, kept."""
    light = cut_lineage(counted(docs).select(id_col, "__source", "__lang", "__topic", "__tokens"))
    chance = small_side(weights(_cells(light), **options).drop("n"))
    out = light.join(chance, ["__source", "__lang", "__topic"])
    return out.select(id_col, F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), "probability", (draw(id_col) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay; its columns stay as they are."""
    own = free_prefix(docs)
    with_cells = counted(docs, prefix=own)
    chance = small_side(weights(_cells(with_cells, own), **options).select(*(F.col(f"__{d}").alias(f"{own}{d}") for d in ALPHA), F.col("probability").alias(f"{own}chance")))
    return like(with_cells.join(chance, [f"{own}{d}" for d in ALPHA]).where(draw(id_col) < F.col(f"{own}chance")), docs)


def _oracle() -> str:
    text = "coalesce(text, '')"
    rounds = []
    before = "start"
    for i in range(ROUNDS):
        for dim in ("source", "lang", "topic"):
            name = f"r{i}_{dim}"
            rounds.append(f"{name} AS MATERIALIZED (SELECT c.* REPLACE (w * s.share / sum(w) OVER (PARTITION BY c.{dim}) AS w) FROM {before} c JOIN share_{dim} s USING ({dim}))")
            before = name
    shares = [f"share_{d} AS (SELECT {d}, pow(sum(n), {a}) / sum(pow(sum(n), {a})) OVER () AS share FROM cells GROUP BY {d})" for d, a in ALPHA.items()]
    return rf"""
WITH light AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{_NULL}') AS source, coalesce(lang, '{_NULL}') AS lang, CAST(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
    length({text}) - length(replace({text}, '|', '')) AS bars, length({text}) - length(translate({text}, '#*$%&!', '')) AS marks
  FROM documents
), placed AS MATERIALIZED (
  SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'empty' WHEN 8 * bars > tokens THEN 'table' WHEN 4 * marks > tokens THEN 'marked' WHEN tokens < 100 THEN 'note' WHEN tokens < 1000 THEN 'article' ELSE 'book' END AS topic
  FROM light
), cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(greatest(tokens, 1)) AS DOUBLE) AS n FROM placed GROUP BY ALL),
{', '.join(shares)},
start AS (SELECT *, n AS w FROM cells),
{', '.join(rounds)},
chance AS (SELECT source, lang, topic, least(1.0::DOUBLE, w * {BUDGET}::DOUBLE * (SELECT sum(n) FROM cells) / (SELECT sum(w) FROM {before}) / n) AS probability FROM {before})
SELECT doc_id, source, lang, topic, tokens, round(probability, 9) AS probability,
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / {float(16**13)} < probability AS kept
FROM placed JOIN chance USING (source, lang, topic)
"""


ORACLE = _oracle()
