"""Search, ranking and sort orders over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx
from ..operators import index, search, sorting, stored
from ..session import cut_lineage
from ..sources import model
from .registry import query, with_ctes
from .sqltext import OCC, SRC, STOP, TOK, occurrences, values, visible, whole

NOW = model.NOW_MS
SAVED = {1: "tion erth", 2: "the thin ing", 3: "erin onbleea", 4: "of that", 5: "the"}
CLAUSED = {
    11: '"in thatin"',
    12: "the*ing",
    13: "tion erth -title:the",
    14: "title:the",
    15: '"of that" th*ble -title:and',
    16: 'ertion -"the this" -*zzz*',
}


def _frames(spark, sf_dir, big=True):
    turns = model.document_messages(spark, sf_dir) if big else model.messages(spark, sf_dir)
    return model.headers(turns), turns


def _index(spark, sf_dir, big=True, tokens=None):
    heads, turns = _frames(spark, sf_dir, big)
    return heads, turns, index.build_postings(heads, turns, tokens)


def _wanted(clauses):
    return sorted({t for c in clauses for t in c.tokens})


def _plain():
    return search.Queries(SAVED).plain


BASE = (model.DOC_MSG, model.HDR, SRC)
QTOK = "qtok AS " + values([(c.query_id, t, len(c.tokens)) for c in _plain() for t in c.tokens], "query_id, token, n_tokens")
QSPAN = "qspan AS " + values(
    [(c.query_id, t, s, len(tx.literal_spans(c.value))) for c in _plain() for t, s in tx.literal_spans(c.value)],
    "query_id, token, qstart, n_spans",
)
AND = """anded AS (
  SELECT query_id, conversation_id FROM tok JOIN qtok USING (token)
  GROUP BY query_id, conversation_id HAVING count(DISTINCT token) = max(n_tokens))"""
WHOLE = "whole AS (" + " UNION ALL ".join(
    f"SELECT {q} AS query_id, id AS conversation_id FROM hdr WHERE {whole('lower(title)', text)}" for q, text in SAVED.items()
) + ")"


def _covers(text):
    terms = text.split()
    need = [t for t in terms if t not in tx.STOPWORDS] or terms
    return f"({whole('lower(title)', text)} OR (" + " AND ".join(whole("lower(title)", t) for t in need) + "))"


COVERS = "covers AS (" + " UNION ALL ".join(
    f"SELECT {q} AS query_id, id AS conversation_id FROM hdr WHERE {_covers(text)}" for q, text in SAVED.items()
) + ")"
ALIGNED = """aligned AS (
  SELECT DISTINCT query_id, conversation_id, source FROM (
    SELECT query_id, conversation_id, source FROM (
      SELECT conversation_id, source, token, start, row_number() OVER (PARTITION BY conversation_id, source, token ORDER BY start) AS nth
      FROM occ WHERE source <> 'title') JOIN qspan USING (token)
    GROUP BY query_id, conversation_id, source, start - qstart HAVING count(*) = max(n_spans)))"""
HITS = """hits AS (
  SELECT query_id, conversation_id, sum(v) / max(n_tokens) AS body FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY v DESC, source) AS r FROM (
      SELECT query_id, conversation_id, source, max(n_tokens) AS n_tokens,
        max(CASE WHEN role = 'user' THEN 100 ELSE 10 END) * count(DISTINCT token) AS v
      FROM tok JOIN qtok USING (token) WHERE source <> 'title' GROUP BY query_id, conversation_id, source)) WHERE r <= 8
  GROUP BY query_id, conversation_id)"""
RANKED = """ranked AS (
  SELECT m.query_id, m.conversation_id, floor((
      CASE WHEN c.query_id IS NOT NULL THEN 10000 ELSE 0 END
      + CASE WHEN w.query_id IS NOT NULL OR a.query_id IS NOT NULL THEN 1000 ELSE 0 END + coalesce(body, 0)) * 100 + 0.5) / 100 AS relevance
  FROM (SELECT query_id, conversation_id FROM anded UNION SELECT query_id, conversation_id FROM whole) m
  LEFT JOIN covers c USING (query_id, conversation_id) LEFT JOIN whole w USING (query_id, conversation_id)
  LEFT JOIN (SELECT DISTINCT query_id, conversation_id FROM aligned) a USING (query_id, conversation_id)
  LEFT JOIN hits USING (query_id, conversation_id))"""
PLAIN = (*BASE, TOK, OCC, QTOK, QSPAN, AND, WHOLE, COVERS, ALIGNED, HITS, RANKED)


# --- scans and the index ------------------------------------------------------------


@query("s01_typed_load", sql="""
  SELECT 'conversations' AS table_name, count(*) AS n_rows, count(DISTINCT conv_id) AS n_keys FROM conversations
  UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id) FROM documents
  UNION ALL SELECT 'pages', count(*), count(DISTINCT page_id) FROM pages
  UNION ALL SELECT 'events', count(*), count(DISTINCT event_id) FROM events
  UNION ALL SELECT 'benchmark', count(*), count(DISTINCT item_id) FROM benchmark""")
def typed_load(spark, sf_dir):
    keys = {"conversations": "conv_id", "documents": "doc_id", "pages": "page_id", "events": "event_id", "benchmark": "item_id"}
    parts = [
        model.load(spark, sf_dir, t).agg(F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys"))
        .select(F.lit(t).alias("table_name"), "n_rows", "n_keys")
        for t, k in keys.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s08_table_counts", sql=with_ctes(model.MSG, body="""
  SELECT (SELECT count(DISTINCT conversation_id) FROM msg) AS conversations, (SELECT count(*) FROM msg) AS messages"""))
def table_counts(spark, sf_dir):
    heads, turns = _frames(spark, sf_dir, big=False)
    return heads.agg(F.count("*").alias("conversations")).crossJoin(turns.agg(F.count("*").alias("messages")))


_POSTINGS_SQL = """
  SELECT token, conversation_id, source, role, string_agg(start::VARCHAR, ',' ORDER BY start) AS positions FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id, source, token ORDER BY start) AS nth FROM occ)
  GROUP BY token, conversation_id, source, role"""


@query("a01_posting_build", sql=with_ctes(*BASE, OCC, body=_POSTINGS_SQL))
def posting_build(spark, sf_dir):
    _, _, postings = _index(spark, sf_dir)
    return postings.withColumn("positions", F.array_join("positions", ","))


@query("s04_posting_table", sql=with_ctes(model.MSG, model.HDR, SRC, TOK, body="""
  SELECT role, count(*) AS postings, count(DISTINCT token) AS tokens, count(DISTINCT conversation_id) AS conversations
  FROM tok GROUP BY role"""))
def posting_table(spark, sf_dir):
    from ..session import checkpoint_dir
    import uuid

    _, _, postings = _index(spark, sf_dir, big=False)
    path = f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    index.write_postings(postings, path)
    stored = spark.read.parquet(path)
    return stored.groupBy("role").agg(
        F.count("*").alias("postings"), F.count_distinct("token").alias("tokens"),
        F.count_distinct("conversation_id").alias("conversations"),
    )


@query("x01_tokens_function", sql=with_ctes(*BASE, OCC, body="""
  SELECT token, count(*) AS n, sum(start)::BIGINT AS starts FROM occ WHERE source <> 'title' GROUP BY token"""))
def tokens_function(spark, sf_dir):
    tx.register_functions(spark)
    turns = model.document_messages(spark, sf_dir)
    turns.select(markup.visible_text("body").alias("body")).createOrReplaceTempView("threadloom_turns")
    return spark.sql(
        "SELECT t.token, count(*) AS n, sum(t.start) AS starts FROM threadloom_turns, LATERAL tokens(body) AS t GROUP BY t.token"
    )


@query("p01_normalise", sql=with_ctes(model.DOC_MSG, body="SELECT id, md5(lower(body)) AS h, length(lower(body)) AS n FROM msg"))
def normalised(spark, sf_dir):
    norm = F.col("norm")
    return tx.with_normalised(model.document_messages(spark, sf_dir), "norm", F.col("body")).select("id", F.md5(norm).alias("h"), F.length(norm).cast("bigint").alias("n"))


@query("x02_nfkc", sql=with_ctes(model.MSG, body="SELECT id, md5(nfc_normalize(body)) AS h FROM msg"))
def nfkc(spark, sf_dir):
    return model.messages(spark, sf_dir).select("id", F.md5(tx.nfkc("body")).alias("h"))


@query("p02_token_spans", sql=with_ctes(*BASE, OCC, body="""
  SELECT source AS id, count(*) AS n_spans, sum(start * (length(token) + 1))::BIGINT AS weight
  FROM occ WHERE source <> 'title' GROUP BY source"""))
def spans(spark, sf_dir):
    turns = model.document_messages(spark, sf_dir)
    held = turns.select("id", F.inline(tx.token_spans(markup.visible_text("body"))))
    return held.groupBy("id").agg(
        F.count("*").alias("n_spans"),
        F.sum(F.col("start").cast("bigint") * (F.length("token") + 1)).alias("weight"),
    )


@query("p03_distinct_tokens", sql=with_ctes(*BASE, TOK, body="""
  SELECT source AS id, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY token)) AS h
  FROM tok WHERE source <> 'title' GROUP BY source"""))
def distinct(spark, sf_dir):
    turns = model.document_messages(spark, sf_dir)
    turns = tx.with_normalised(turns, "norm", markup.visible_text("body"))
    return turns.select("id", tx.distinct_tokens("norm").alias("t")).where(F.size("t") > 0).select(
        "id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("h")
    )


_QT = f"""
  qt AS (SELECT id, list_distinct(regexp_extract_all(lower(title), '[a-z][a-z0-9]{{1,47}}') || regexp_extract_all(lower(title), '[0-9]{{2,24}}')) AS every FROM hdr),
  kept AS (SELECT id, every, list_filter(every, lambda w: NOT list_contains({STOP}, w)) AS k FROM qt)"""


@query("p04_query_tokens", sql=with_ctes(model.MSG, model.HDR, _QT.strip(), body="""
  SELECT id, array_to_string(list_sort(CASE WHEN len(k) > 0 THEN k ELSE every END), ' ') AS tokens FROM kept"""))
def query_tokens(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir, big=False)
    tokens = tx.drop_stopwords(tx.distinct_tokens(tx.normalise("title")))
    return heads.select("id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


_TSRC = "tsrc AS (SELECT id, lower(title) AS t FROM hdr)"


@query("p05_query_spans", sql=with_ctes(model.MSG, model.HDR, _QT.strip(), _TSRC,
    occurrences("o1", "tsrc", "[a-z][a-z0-9]{1,47}", "id"),
    occurrences("o2", "tsrc", "[0-9]{2,24}", "id"),
    body="""
  SELECT id, token, start FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) JOIN kept USING (id)
  WHERE list_contains(CASE WHEN len(k) > 0 THEN k ELSE every END, token)"""))
def query_spans(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir, big=False)
    saved = heads.select(F.col("id").alias("query_id"), F.col("title").alias("raw"))
    return search.table_spans(saved).select(F.col("query_id").alias("id"), "token", "start")


@query("p06_whole_words", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, {whole('lower(body)', 'the this')} AS phrase, {whole('lower(body)', 'thin')} AS word FROM msg"""))
def whole_words(spark, sf_dir):
    norm = F.col("norm")
    turns = tx.with_normalised(model.document_messages(spark, sf_dir), "norm", F.col("body"))
    return turns.select("id", tx.contains_whole(norm, F.lit("the this")).alias("phrase"), tx.contains_whole(norm, F.lit("thin")).alias("word"))


@query("p20_visible_text", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, md5(v) AS h, length(v) AS n FROM (SELECT id, {visible('body')} AS v FROM msg)"""))
def visible_text(spark, sf_dir):
    text = markup.visible_text("body")
    return model.document_messages(spark, sf_dir).select("id", F.md5(text).alias("h"), F.length(text).cast("bigint").alias("n"))


# --- matching -----------------------------------------------------------------------


@query("j01_and_search", sql=with_ctes(*BASE, TOK, QTOK, AND, body="SELECT query_id, conversation_id FROM anded"))
def and_search(spark, sf_dir):
    clauses = _plain()
    _, _, found = _index(spark, sf_dir, tokens=_wanted(clauses))
    return search.and_matches(found, search.token_frame(spark, clauses)).select("query_id", "conversation_id")


@query("j02_title_hits", sql=with_ctes(model.DOC_MSG, model.HDR, WHOLE, body="SELECT query_id, conversation_id FROM whole"))
def title_hits(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir)
    return search.whole_title_matches(heads, _plain()).select("query_id", "conversation_id")


@query("u01_index_or_title", sql=with_ctes(*BASE, TOK, QTOK, AND, WHOLE, body="""
  SELECT query_id, conversation_id FROM anded UNION SELECT query_id, conversation_id FROM whole"""))
def index_or_title(spark, sf_dir):
    return and_search(spark, sf_dir).unionByName(title_hits(spark, sf_dir)).distinct()


@query("u02_token_intersection", sql=with_ctes(*BASE, TOK, body="""
  SELECT conversation_id FROM tok WHERE token = 'tion' INTERSECT SELECT conversation_id FROM tok WHERE token = 'erth'"""))
def token_intersection(spark, sf_dir):
    _, _, postings = _index(spark, sf_dir, tokens=["tion", "erth"])
    ids = lambda t: index.lookup(postings, [t]).select("conversation_id")
    return ids("tion").intersect(ids("erth"))


@query("f01_scope", sql=with_ctes(model.DOC_MSG, model.HDR, body="""
  SELECT id, 'active' AS scope FROM hdr WHERE archived IS NOT TRUE
  UNION ALL SELECT id, 'archived' FROM hdr WHERE archived IS TRUE
  UNION ALL SELECT id, 'claude' FROM hdr WHERE platform = 'claude' AND archived IS NOT TRUE"""))
def scoped(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir)
    part = lambda frame, name: frame.select("id", F.lit(name).alias("scope"))
    return (
        part(search.scope(heads, archive="active"), "active")
        .unionByName(part(search.scope(heads, archive="archived"), "archived"))
        .unionByName(part(search.scope(heads, "claude", "active"), "claude"))
    )


@query("j03_hits_with_header", sql=with_ctes(*BASE, TOK, QTOK, AND, body="""
  SELECT query_id, conversation_id, title, updated_ms FROM anded JOIN hdr ON hdr.id = conversation_id WHERE archived IS NOT TRUE"""))
def hits_with_header(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir)
    inside = search.scope(heads, archive="active").select(F.col("id").alias("conversation_id"), "title", "updated_ms")
    return and_search(spark, sf_dir).join(inside, "conversation_id")


def _claused(*ids):
    return search.Queries({q: CLAUSED[q] for q in ids}).clauses


_NORM = f"norm AS (SELECT conversation_id, id AS source, role, lower({visible('body')}) AS t FROM msg)"
_WORDS = "list_filter(regexp_extract_all({t}, '[a-z0-9]+'), lambda w: w LIKE '{p}')"


def _glob(t, p):
    return f"len({_WORDS.format(t=t, p=p)}) > 0"


@query("j04_exact_phrase", sql=with_ctes(model.DOC_MSG, _NORM, model.HDR, body="""
  SELECT conversation_id, source FROM norm WHERE contains(t, 'in thatin')
  UNION ALL SELECT id, 'title' FROM hdr WHERE contains(lower(title), 'in thatin')"""))
def exact_phrase(spark, sf_dir):
    heads, turns = _frames(spark, sf_dir)
    clauses = _claused(11)
    return search.body_matches(turns, clauses).select("conversation_id", "source").unionByName(
        search.title_matches(heads, clauses).select("conversation_id", F.lit("title").alias("source"))
    )


@query("j05_wildcard", sql=with_ctes(model.DOC_MSG, _NORM, model.HDR, body=f"""
  SELECT conversation_id, source FROM norm WHERE {_glob('t', 'the%ing')}
  UNION ALL SELECT id, 'title' FROM hdr WHERE {_glob('lower(title)', 'the%ing')}"""))
def wildcard(spark, sf_dir):
    heads, turns = _frames(spark, sf_dir)
    clauses = _claused(12)
    return search.body_matches(turns, clauses).select("conversation_id", "source").unionByName(
        search.title_matches(heads, clauses).select("conversation_id", F.lit("title").alias("source"))
    )


@query("j07_prefix_candidates", sql=with_ctes(*BASE, TOK, body="""
  SELECT DISTINCT source AS id FROM tok WHERE token LIKE 'thatin%' OR token LIKE 'the%'"""))
def prefix_candidates(spark, sf_dir):
    _, _, postings = _index(spark, sf_dir)
    return search.candidates(postings, _claused(11, 12))


_T = "lower(title)"
_CL_SQL = f"""
  titled AS (
    SELECT 11 AS query_id, 0 AS clause_no, id AS conversation_id FROM hdr WHERE contains({_T}, 'in thatin')
    UNION ALL SELECT 12, 0, id FROM hdr WHERE {_glob(_T, 'the%ing')}
    UNION ALL SELECT 13, 0, id FROM hdr WHERE {whole(_T, 'tion erth')} OR ({whole(_T, 'tion')} AND {whole(_T, 'erth')})
    UNION ALL SELECT 13, 1, id FROM hdr WHERE {whole(_T, 'the')}
    UNION ALL SELECT 14, 0, id FROM hdr WHERE {whole(_T, 'the')}
    UNION ALL SELECT 15, 0, id FROM hdr WHERE contains({_T}, 'of that')
    UNION ALL SELECT 15, 1, id FROM hdr WHERE {_glob(_T, 'th%ble')}
    UNION ALL SELECT 15, 2, id FROM hdr WHERE {whole(_T, 'and')}
    UNION ALL SELECT 16, 0, id FROM hdr WHERE {whole(_T, 'ertion')}
    UNION ALL SELECT 16, 1, id FROM hdr WHERE contains({_T}, 'the this')
    UNION ALL SELECT 16, 2, id FROM hdr WHERE {_glob(_T, '%zzz%')}),
  lit AS (
    SELECT 11 AS query_id, 0 AS clause_no, conversation_id, source, role FROM norm WHERE contains(t, 'in thatin')
    UNION ALL SELECT 12, 0, conversation_id, source, role FROM norm WHERE {_glob('t', 'the%ing')}
    UNION ALL SELECT 15, 0, conversation_id, source, role FROM norm WHERE contains(t, 'of that')
    UNION ALL SELECT 15, 1, conversation_id, source, role FROM norm WHERE {_glob('t', 'th%ble')}
    UNION ALL SELECT 16, 1, conversation_id, source, role FROM norm WHERE contains(t, 'the this')
    UNION ALL SELECT 16, 2, conversation_id, source, role FROM norm WHERE {_glob('t', '%zzz%')}),
  wtok AS {values([(13, 0, 'tion', 2), (13, 0, 'erth', 2), (16, 0, 'ertion', 1)], 'query_id, clause_no, token, n_tokens')},
  wand AS (SELECT query_id, clause_no, conversation_id FROM tok JOIN wtok USING (token) GROUP BY ALL HAVING count(DISTINCT token) = max(n_tokens)),
  matched AS (SELECT query_id, clause_no, conversation_id FROM titled UNION SELECT query_id, clause_no, conversation_id FROM lit UNION SELECT * FROM wand),
  kinds AS {values([(11, 0, 'phrase', 0, 1), (12, 0, 'glob', 0, 1), (13, 0, 'words', 0, 1), (13, 1, 'words', 1, 1), (14, 0, 'words', 0, 1), (15, 0, 'phrase', 0, 2), (15, 1, 'glob', 0, 2), (15, 2, 'words', 1, 2), (16, 0, 'words', 0, 1), (16, 1, 'phrase', 1, 1), (16, 2, 'glob', 1, 1)], 'query_id, clause_no, kind, bar, positives')},
  accepted AS (SELECT query_id, conversation_id, max(positives) AS positives, max(CASE WHEN bar = 0 AND kind = 'phrase' THEN 1 ELSE 0 END) AS phrased
    FROM matched JOIN kinds USING (query_id, clause_no) GROUP BY ALL
    HAVING sum(1 - bar) = max(positives) AND max(bar) = 0)"""
_CL_SQL = _CL_SQL.strip()
CLAUSE_CTES = (*BASE, _NORM, TOK, _CL_SQL)


def _accepted_sql(*ids):
    return with_ctes(*CLAUSE_CTES, body=f"SELECT query_id, conversation_id FROM accepted WHERE query_id IN {ids + (0,)}")


def _clause_search(spark, sf_dir, *ids):
    clauses = _claused(*ids)
    heads, turns = _frames(spark, sf_dir)
    heads = cut_lineage(heads.select("id", "title"))
    return search.search_clauses(heads, turns, index.build_postings(heads, turns, _wanted(clauses)), clauses)


@query("j06_exclude", sql=_accepted_sql(13, 16))
def exclude(spark, sf_dir):
    return _clause_search(spark, sf_dir, 13, 16).select("query_id", "conversation_id")


@query("j08_title_clause", sql=_accepted_sql(14))
def title_clause(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir)
    return search.title_matches(heads, _claused(14)).select("query_id", "conversation_id")


@query("j09_multi_clause", sql=_accepted_sql(11, 12, 13, 14, 15, 16))
def multi_clause(spark, sf_dir):
    return _clause_search(spark, sf_dir, *CLAUSED).select("query_id", "conversation_id")


@query("a04_clause_relevance", sql=with_ctes(*CLAUSE_CTES, OCC, f"""
  wspan AS {values([(13, 'tion', 0, 2), (13, 'erth', 5, 2), (16, 'ertion', 0, 1)], 'query_id, token, qstart, n_spans')},
  worded AS (
    SELECT query_id, conversation_id FROM (
      SELECT conversation_id, source, token, start, row_number() OVER (PARTITION BY conversation_id, source, token ORDER BY start) AS nth
      FROM occ WHERE source <> 'title') JOIN wspan USING (token)
      GROUP BY query_id, conversation_id, source, start - qstart HAVING count(*) = max(n_spans)
    UNION SELECT 13, id FROM hdr WHERE {whole(_T, 'tion erth')} UNION SELECT 16, id FROM hdr WHERE {whole(_T, 'ertion')}),
  shares AS (
    SELECT query_id, conversation_id, source, role, count(DISTINCT token)::DOUBLE / max(n_tokens) AS share FROM tok JOIN wtok USING (token)
      WHERE source <> 'title' GROUP BY ALL
    UNION ALL SELECT query_id, conversation_id, source, role, 1.0::DOUBLE FROM lit JOIN kinds USING (query_id, clause_no) WHERE bar = 0),
  src_score AS (
    SELECT query_id, conversation_id, source, max(CASE WHEN role = 'user' THEN 100 ELSE 10 END) * least(1.0, sum(share / positives)) AS v
    FROM shares JOIN (SELECT DISTINCT query_id, positives FROM kinds) USING (query_id) GROUP BY query_id, conversation_id, source),
  best AS (
    SELECT query_id, conversation_id, sum(v) AS body FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY v DESC, source) AS r FROM src_score) WHERE r <= 8 GROUP BY ALL),
  tcount AS (SELECT query_id, conversation_id, count(*) AS n FROM titled JOIN kinds USING (query_id, clause_no) WHERE bar = 0 GROUP BY ALL)""".strip(), body="""
  SELECT a.query_id, a.conversation_id, floor((CASE WHEN t.n = a.positives THEN 10000 ELSE 0 END
    + CASE WHEN a.phrased = 1 OR w.query_id IS NOT NULL THEN 1000 ELSE 0 END + coalesce(b.body, 0)) * 100 + 0.5) / 100 AS relevance
  FROM accepted a LEFT JOIN tcount t USING (query_id, conversation_id) LEFT JOIN best b USING (query_id, conversation_id)
  LEFT JOIN (SELECT DISTINCT query_id, conversation_id FROM worded) w USING (query_id, conversation_id)"""))
def clause_relevance(spark, sf_dir):
    return _clause_search(spark, sf_dir, *CLAUSED)


@query("a03_aligned_phrase", sql=with_ctes(*BASE, OCC, QSPAN, ALIGNED, body="SELECT query_id, conversation_id, source FROM aligned"))
def aligned_phrase(spark, sf_dir):
    clauses = _plain()
    _, _, found = _index(spark, sf_dir, tokens=_wanted(clauses))
    return search.aligned_phrases(found, search.span_frame(spark, clauses)).drop("clause_no")


@query("a05_title_coverage", sql=with_ctes(model.DOC_MSG, model.HDR, COVERS, body="SELECT query_id, conversation_id FROM covers"))
def title_coverage(spark, sf_dir):
    heads, _ = _frames(spark, sf_dir)
    rows = heads.select(F.col("id").alias("conversation_id"), tx.normalise("title").alias("norm"))
    tests = [(c, search.title_covers(F.col("norm"), c.value)) for c in _plain()]
    return search._literal_matches(rows, ["conversation_id"], tests).select("query_id", "conversation_id")


@query("a02_relevance", sql=with_ctes(*PLAIN, body="SELECT query_id, conversation_id, relevance FROM ranked"))
def relevance(spark, sf_dir):
    clauses = _plain()
    heads, _, postings = _index(spark, sf_dir, tokens=_wanted(clauses))
    return search.search_plain(heads, postings, clauses)


@query("o08_top_sources", sql=with_ctes(*BASE, TOK, QTOK, body="""
  SELECT query_id, conversation_id, source, v AS value, r AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY v DESC, source) AS r FROM (
      SELECT query_id, conversation_id, source, max(CASE WHEN role = 'user' THEN 100 ELSE 10 END) * count(DISTINCT token) AS v
      FROM tok JOIN qtok USING (token) WHERE source <> 'title' GROUP BY query_id, conversation_id, source)) WHERE r <= 2"""))
def top_two(spark, sf_dir):
    clauses = _plain()
    _, _, found = _index(spark, sf_dir, tokens=_wanted(clauses))
    hits = search.source_hits(found, search.token_frame(spark, clauses))
    best = search.top_sources(hits, F.col("weight") * F.col("found"), ["query_id", "conversation_id"], 2)
    return best.select("query_id", "conversation_id", "source", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("bigint").alias("rank"))


# Saved queries that are a table: the first three words of every benchmark passage.
_BQ = r"""
  bq AS (SELECT item_id AS query_id, regexp_replace(regexp_extract(lower(text), '^\s*(\S+(?:\s+\S+){0,2})', 1), '\s+', ' ', 'g') AS q FROM benchmark),
  ball AS (SELECT query_id, list_distinct(regexp_extract_all(q, '[a-z][a-z0-9]{1,47}') || regexp_extract_all(q, '[0-9]{2,24}')) AS every FROM bq),
  bkeep AS (SELECT query_id, every, list_filter(every, lambda w: NOT list_contains({stop}, w)) AS k FROM ball),
  bset AS (SELECT query_id, CASE WHEN len(k) > 0 THEN k ELSE every END AS ts FROM bkeep),
  btok AS (SELECT query_id, unnest(ts) AS token, len(ts) AS n_tokens FROM bset)""".strip().replace("{stop}", STOP)


@query("j10_saved_query_table", sql=with_ctes(*BASE, TOK, _BQ, body="""
  SELECT query_id, conversation_id FROM tok JOIN btok USING (token) GROUP BY query_id, conversation_id
  HAVING count(DISTINCT token) = max(n_tokens)"""))
def saved_query_table(spark, sf_dir):
    _, _, postings = _index(spark, sf_dir)
    saved = model.load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), model.opening_words(F.col("text"), 3).alias("raw")
    )
    return search.and_matches(postings, search.table_tokens(saved)).select("query_id", "conversation_id")


# Stored queries of all kinds: which clauses a row has depends on its id, their words come from the passage.
_STORED = r"""
  bw AS (SELECT item_id AS query_id, item_id % 5 AS kind, regexp_extract_all(lower(text), '[a-z]{2,12}') AS w FROM benchmark),
  bc AS (
    SELECT query_id, 0 AS clause_no, 'phrase' AS kind, w[1] || ' ' || w[2] AS v, FALSE AS title, FALSE AS no FROM bw WHERE kind = 0
    UNION ALL SELECT query_id, 1, 'has', w[4], FALSE, TRUE FROM bw WHERE kind = 0
    UNION ALL SELECT query_id, 0, 'has', w[2], FALSE, FALSE FROM bw WHERE kind = 1
    UNION ALL SELECT query_id, 1, 'glob', left(w[1], 2) || '%', FALSE, FALSE FROM bw WHERE kind = 1
    UNION ALL SELECT query_id, 0, 'has', w[1], TRUE, FALSE FROM bw WHERE kind = 2
    UNION ALL SELECT query_id, 1, 'phrase', w[3] || ' ' || w[4], FALSE, TRUE FROM bw WHERE kind = 2
    UNION ALL SELECT query_id, 0, 'glob', '%' || left(w[1], 3) || '%', FALSE, FALSE FROM bw WHERE kind = 3
    UNION ALL SELECT query_id, 1, 'glob', left(w[2], 1) || '%' || right(w[2], 1), TRUE, TRUE FROM bw WHERE kind = 3
    UNION ALL SELECT query_id, 0, 'has', w[1], FALSE, FALSE FROM bw WHERE kind = 4
    UNION ALL SELECT query_id, 1, 'phrase', w[2], TRUE, TRUE FROM bw WHERE kind = 4),
  wsrc AS (SELECT conversation_id, source, t, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS ws FROM src),
  wds AS (SELECT DISTINCT conversation_id, source = 'title' AS in_title, unnest(ws) AS word FROM wsrc),
  bm AS (
    SELECT DISTINCT query_id, clause_no, no, conversation_id FROM bc JOIN wsrc ON (NOT title OR source = 'title') AND contains(t, v) WHERE kind = 'phrase'
    UNION ALL SELECT DISTINCT query_id, clause_no, no, conversation_id FROM bc JOIN wds ON (NOT title OR in_title) AND word LIKE v WHERE kind = 'glob'
    UNION ALL SELECT DISTINCT query_id, clause_no, no, conversation_id FROM bc JOIN tok ON token = v AND (NOT title OR source = 'title') WHERE kind = 'has')""".strip()


@query("j10_stored_clauses", sql=with_ctes(*BASE, TOK, _STORED, body="""
  SELECT query_id, conversation_id FROM bm GROUP BY query_id, conversation_id
  HAVING count(*) FILTER (NOT no) = (SELECT count(*) FROM bc c WHERE c.query_id = bm.query_id AND NOT c.no) AND count(*) FILTER (no) = 0"""))
def stored_clause_table(spark, sf_dir):
    headers, messages = _frames(spark, sf_dir)
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,12})"), F.lit(1))
    rows = model.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w"))
    first, second, third, fourth = (F.get("w", F.lit(i)) for i in range(4))
    raw = (
        F.when(F.col("query_id") % 5 == 0, F.concat(F.lit('"'), first, F.lit(" "), second, F.lit('" -'), fourth))
        .when(F.col("query_id") % 5 == 1, F.concat(second, F.lit(" "), F.left(first, F.lit(2)), F.lit("*")))
        .when(F.col("query_id") % 5 == 2, F.concat(F.lit("title:"), first, F.lit(' -"'), third, F.lit(" "), fourth, F.lit('"')))
        .when(F.col("query_id") % 5 == 3, F.concat(F.lit("*"), F.left(first, F.lit(3)), F.lit("* -title:"), F.left(second, F.lit(1)), F.lit("*"), F.right(second, F.lit(1))))
        .otherwise(F.concat(first, F.lit(' -title:"'), second, F.lit('"')))
    )
    return stored.matches(headers, messages, None, rows.select("query_id", raw.alias("raw")))


@query("o09_snippet_tokens", sql=with_ctes(_BQ, body="""
  SELECT query_id, token, r AS rank FROM (
    SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY length(token) DESC, token) AS r FROM (
      SELECT query_id, token, max(CASE WHEN length(token) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS longer FROM btok)
    WHERE length(token) >= 2 OR longer = 0) WHERE r <= 3"""))
def snippet_tokens(spark, sf_dir):
    from ..operators import snippets

    saved = model.load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), model.opening_words(F.col("text"), 3).alias("raw")
    )
    return snippets.snippet_tokens(search.table_tokens(saved)).select(
        "query_id", "token", F.col("rank").cast("bigint").alias("rank")
    )


# --- orders -------------------------------------------------------------------------

_TIER = f"""CASE WHEN updated_source IN ('page-exact', 'observed') THEN 0 WHEN updated_source = 'page-bucket' THEN 1
  WHEN updated_source = 'sidebar-rank' AND older_than_ms BETWEEN {model.MIN_PAGE_MS} AND {NOW + 366 * model.DAY_MS} THEN 2 ELSE 3 END"""
_CAPTURED = "coalesce(first_seen_ms, created_ms, 0)"


def _order_sql(order, extra="", limit=80):
    return with_ctes(model.DOC_MSG, model.HDR, body=f"SELECT id, title, updated_ms, row_number() OVER (ORDER BY {order}) AS pos FROM hdr {extra} ORDER BY {order} LIMIT {limit}")


def _ordered(spark, sf_dir, field, direction, archive="all", platform="", limit=80):
    heads, _ = _frames(spark, sf_dir)
    top = sorting.sorted_list(search.scope(heads, platform, archive), field, direction, NOW, limit)
    return number_rows(top, sorting.order_columns(field, direction, NOW)).select("id", "title", "updated_ms", "pos")


def number_rows(top, order):
    """Positions of an already limited list."""
    from pyspark.sql import Window

    return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


@query("o01_activity_sort", sql=_order_sql(f"{_TIER}, updated_ms DESC, id"))
def activity_sort(spark, sf_dir):
    return _ordered(spark, sf_dir, "activity", "desc")


@query("o02_title_sort")
def title_sort(spark, sf_dir):
    return _ordered(spark, sf_dir, "title", "asc")


@query("o03_captured_sort", sql=_order_sql(f"{_CAPTURED} DESC, id"))
def captured_sort(spark, sf_dir):
    return _ordered(spark, sf_dir, "captured", "desc")


@query("o04_count_sort", sql=_order_sql("message_count DESC, id"))
def count_sort(spark, sf_dir):
    return _ordered(spark, sf_dir, "count", "desc")


@query("o06_recent_list", sql=_order_sql("updated_ms DESC, id", "WHERE archived IS NOT TRUE"))
def recent_list(spark, sf_dir):
    return _ordered(spark, sf_dir, "recent", "desc", archive="active")


@query("o07_sorted_headers", sql=_order_sql(f"{_CAPTURED}, id", "WHERE platform = 'grok'", 50))
def sorted_headers(spark, sf_dir):
    return _ordered(spark, sf_dir, "captured", "asc", platform="grok", limit=50)


@query("o05_relevance_sort", sql=with_ctes(*PLAIN, body="""
  SELECT query_id, conversation_id, title, relevance, row_number() OVER (ORDER BY relevance DESC, updated_ms DESC, conversation_id) AS pos
  FROM ranked JOIN hdr ON hdr.id = conversation_id WHERE query_id = 2 ORDER BY pos LIMIT 80"""))
def relevance_sort(spark, sf_dir):
    saved = {2: SAVED[2]}
    heads, turns, postings = _index(spark, sf_dir, tokens=_wanted(search.Queries(saved).plain))
    found = search.search(heads, turns, postings, saved)
    top = sorting.sorted_list(found, "relevance", "desc", NOW, 80, "conversation_id")
    order = sorting.order_columns("relevance", "desc", NOW, "conversation_id")
    return number_rows(top, order).select("query_id", "conversation_id", "title", "relevance", "pos")
