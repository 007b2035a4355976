"""Alignment operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import align, clock, identity
from ..sources import model
from .registry import query, with_ctes
from .sqltext import flat, quote, turn_text

NOW = model.NOW_MS


def _turns(spark, sf_dir):
    return model.document_messages(spark, sf_dir)


@query("j16_transcript_proof", sql=with_ctes(model.DOC_MSG, body="""
  SELECT DISTINCT conversation_id FROM msg WHERE conv_no % 4 <> 1 AND conv_no % 5 <> 2"""))
def transcript_proof(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    node = F.concat(F.lit("n"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))).when(F.col("conv_no") % 4 == 1, F.lit("n0"))
    main = turns.select("conversation_id", node.alias("node"), parent.alias("parent"), "role", "body")
    branch = turns.where("turn = 3").select("conversation_id", F.lit("b1").alias("node"), F.lit("n1").alias("parent"), F.lit("user").alias("role"), F.lit("another way").alias("body"))
    tree = main.unionByName(branch)
    current = turns.groupBy("conversation_id").agg(F.max("turn").alias("t")).select("conversation_id", F.concat(F.lit("n"), F.col("t").cast("string")).alias("node"))
    shown = turns.select("conversation_id", F.col("turn").alias("idx"), F.when((F.col("conv_no") % 5 == 2) & (F.col("turn") == 6), "edited").otherwise(F.concat(F.lit(" "), "body")).alias("body"))
    return align.proved_transcripts(tree, current, shown)


_SPLIT = """
  stored AS (SELECT conversation_id, turn AS idx, 's' || id AS id, role, CASE WHEN turn = 8 THEN left(body, length(body) * 9 // 10) ELSE body END AS body, CASE WHEN turn % 2 = 0 THEN 't' || turn END AS turn_id FROM msg WHERE turn < 9),
  page AS (SELECT conversation_id, turn - sh AS idx, CASE WHEN turn = 5 THEN 's' || id ELSE 'p' || id END AS id, role, body, CASE WHEN turn = 4 AND sh = 0 THEN 'other' WHEN turn % 2 = 0 THEN 't' || turn END AS turn_id FROM (SELECT *, conv_no % 3 AS sh FROM msg) WHERE turn >= sh)""".strip()


@query("j17_rekeyed_turns", sql=with_ctes(model.DOC_MSG, _SPLIT, f"""
  st AS (SELECT *, role || chr(10) || {turn_text('body')} AS stamp, {turn_text('body')} AS w FROM stored WHERE id NOT IN (SELECT id FROM page)),
  pg AS (SELECT *, role || chr(10) || {turn_text('body')} AS stamp, {turn_text('body')} AS w FROM page WHERE id NOT IN (SELECT id FROM stored)),
  las AS (SELECT conversation_id, max(idx) AS l FROM stored GROUP BY 1),
  pr AS (SELECT s.conversation_id, s.idx - p.idx AS d, s.idx AS si, s.id AS stored_id, p.id AS page_id FROM st s JOIN pg p ON s.conversation_id = p.conversation_id AND s.stamp = p.stamp AND s.w <> '' AND NOT coalesce(s.turn_id <> p.turn_id, false)),
  sc AS (SELECT conversation_id, d, count(*) * 4 + max(CASE WHEN si = l THEN 2 ELSE 0 END) AS score FROM pr JOIN las USING (conversation_id) GROUP BY 1, 2),
  bs AS (SELECT conversation_id, d FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, d DESC) AS r FROM sc) WHERE r = 1),
  al AS (SELECT conversation_id, page_id, stored_id FROM pr JOIN bs USING (conversation_id, d))""".strip(), body="""
  FROM al UNION ALL SELECT p.conversation_id, p.id, s.id FROM pg p JOIN st s ON s.conversation_id = p.conversation_id AND s.idx = p.idx AND s.role = p.role AND s.turn_id = p.turn_id
  WHERE p.id NOT IN (SELECT page_id FROM al) AND s.id NOT IN (SELECT stored_id FROM al) AND p.w <> '' AND s.w <> '' AND
    (length(p.w) > length(s.w) AND starts_with(p.w, s.w) OR length(p.w) < length(s.w) AND starts_with(s.w, p.w) AND length(p.w) >= 24 AND length(p.w) >= length(s.w) * 0.8)"""))
def rekeyed_turns(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    stored = turns.where("turn < 9").selectExpr("conversation_id", "turn as idx", "concat('s', id) as id", "role", "case when turn = 8 then left(body, cast(length(body) * 9 div 10 as int)) else body end as body", "case when turn % 2 = 0 then concat('t', turn) end as turn_id")
    page = turns.withColumn("sh", F.col("conv_no") % 3).where("turn >= sh").selectExpr(
        "conversation_id", "turn - sh as idx", "case when turn = 5 then concat('s', id) else concat('p', id) end as id", "role", "body", "case when turn = 4 and sh = 0 then 'other' when turn % 2 = 0 then concat('t', turn) end as turn_id")
    return align.rekeyed_turns(stored, page)


_REUSE = """cap AS (SELECT conversation_id, c AS capture_no, turn AS position, role, conversation_id || ':' || left(md5(body || CASE WHEN turn % 3 = c % 3 OR conv_no % 4 = 0 THEN c ELSE 0 END), 7) || ':dom' || turn AS id
  FROM msg, (SELECT unnest([0, 1, 2]) AS c) WHERE NOT (c = 2 AND conv_no % 5 = 0 AND turn = 9))"""


@query("j19_reused_ids", sql=with_ctes(model.DOC_MSG, _REUSE, """
  sized AS (SELECT *, count(*) OVER (PARTITION BY conversation_id, capture_no) AS n FROM cap),
  j AS (SELECT a.*, b.id AS old_id, b.role AS old_role, b.n AS old_n FROM sized a LEFT JOIN sized b ON a.conversation_id = b.conversation_id AND a.position = b.position AND a.capture_no = b.capture_no + 1),
  k AS (SELECT *, bool_or(coalesce(id = old_id AND n = old_n, false)) OVER (PARTITION BY conversation_id, capture_no) AS anchored FROM j)""".strip(), body="""
  SELECT conversation_id, capture_no, position, CASE WHEN anchored AND role = old_role AND n = old_n THEN old_id ELSE id END AS id FROM k"""))
def reused_ids(spark, sf_dir):
    rows = _turns(spark, sf_dir).selectExpr("*", "explode(sequence(0, 2)) as c").where("not (c = 2 and conv_no % 5 = 0 and turn = 9)")
    captures = rows.selectExpr("conversation_id", "c as capture_no", "turn as position", "role",
                               "concat(conversation_id, ':', left(md5(concat(body, case when turn % 3 = c % 3 or conv_no % 4 = 0 then c else 0 end)), 7), ':dom', turn) as id")
    return align.reused_ids(captures)


@query("w15_send_chunks")
def send_chunks(spark, sf_dir):
    rows = _turns(spark, sf_dir).selectExpr("platform as conversation_id", "conv_no * 10 + turn as idx", "body")
    return align.send_chunks(rows)


_KEYS = flat("regexp_replace(regexp_replace(" + flat('{}') + ", '[hH][tT][tT][pP][sS]?://[^ ]+', ' ', 'g'), '[*_`#\\[\\]()>~]+', '', 'g')")


def _key(expr):
    return _KEYS.replace("{}", expr)


_END = """pgs AS (SELECT conversation_id, conv_no, arg_max(body, turn) AS b, arg_min(body, turn) AS f, count(*) AS n FROM msg GROUP BY ALL),
  ed AS (SELECT *, CASE WHEN conv_no % 6 = 0 THEN 0 ELSE n END AS baseline_count, CASE conv_no % 5 WHEN 0 THEN b WHEN 1 THEN f WHEN 2 THEN left(b, 40) WHEN 3 THEN left(b, 20) ELSE b END AS stored_body,
    CASE WHEN conv_no % 7 < 6 THEN CASE conv_no % 5 WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN b WHEN 3 THEN f ELSE left(b, 30) END END AS ending FROM pgs)"""


@query("w09_new_ending", sql=with_ctes(model.DOC_MSG, _END, f"""
  ks AS (SELECT *, {_key('stored_body')} AS s, {_key('ending')} AS e FROM ed),
  sm AS (SELECT *, e = s OR (starts_with(s, e) AND length(e) < length(s)) AS same FROM ks)""".strip(), body="""
  SELECT conversation_id, CASE WHEN baseline_count <= 0 THEN false WHEN conv_no % 3 = 0 THEN
      CASE WHEN conv_no % 2 = 0 THEN conv_no % 4 = 0 WHEN ending IS NULL THEN false WHEN s <> '' AND e <> '' AND same THEN false ELSE true END
    WHEN s = '' OR ending IS NULL OR e = '' OR same THEN false WHEN starts_with(e, s) AND length(e) > length(s) THEN true ELSE conv_no % 8 < 4 END AS new_ending FROM sm"""))
def new_ending(spark, sf_dir):
    heads = _turns(spark, sf_dir).select("conversation_id", "conv_no", "turn", "body").groupBy("conversation_id", "conv_no").agg(
        F.max_by("body", "turn").alias("b"), F.min_by("body", "turn").alias("f"), F.count("*").alias("n"))
    rows = heads.selectExpr(
        "conversation_id", "case when conv_no % 6 = 0 then 0 else n end as baseline_count", "case conv_no % 5 when 0 then b when 1 then f when 2 then left(b, 40) when 3 then left(b, 20) else b end as stored_body",
        "case when conv_no % 7 < 6 then case conv_no % 5 when 0 then b when 1 then b when 2 then b when 3 then f else left(b, 30) end end as ending",
        "conv_no % 3 = 0 as tail_on_page", "'t' as baseline_tail", "case when conv_no % 2 = 0 then 't' else 'u' end as page_tail", "conv_no % 4 = 0 as tail_changed", "conv_no % 8 < 4 as tail_seen")
    return clock.new_ending(rows, markup.activity_key).select("conversation_id", "new_ending")


_SRC_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\\r\\n?', chr(10), 'g'), '[\\t\\f\\v\\x{a0}\\x{3000} ]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\n ]+|[\\n ]+$', '', 'g')"
_PV = f"prev AS (SELECT *, CASE WHEN length(c) <= 360 THEN c ELSE regexp_replace(left(c, 360), '[\\n ]+$', '') || '…' END AS p FROM (SELECT *, {_SRC_TEXT} AS c FROM msg))"


@query("w10_next_previews", sql=with_ctes(model.DOC_MSG, _PV, """
  pgv AS (SELECT *, turn - conv_no % 4 AS idx, turn % 2 = 0 AS fresh FROM prev WHERE turn >= conv_no % 4),
  hd AS (SELECT conversation_id, conv_no, CASE WHEN conv_no % 3 = 0 THEN NULL WHEN conv_no % 3 = 1 THEN 'gone' ELSE conversation_id || ':4' END AS first_id, CASE WHEN conv_no % 3 > 0 THEN 'old' END AS first_preview FROM msg GROUP BY ALL),
  tp AS (SELECT conversation_id, arg_min({'id': id, 'p': p, 'fresh': fresh, 'idx': idx}, idx) FILTER (role = 'user') AS t, arg_max(p, idx) AS lp, arg_max(role, idx) AS lr FROM pgv GROUP BY 1),
  ag AS (SELECT h.conversation_id, p.idx AS ix, CASE WHEN p.role = 'user' THEN p.p END AS again FROM hd h JOIN pgv p ON p.id = h.first_id),
  al AS (SELECT h.*, t, lp, lr, ix, coalesce(again, first_preview, '') AS base FROM hd h LEFT JOIN tp USING (conversation_id) LEFT JOIN ag USING (conversation_id)),
  tk AS (SELECT *, t IS NOT NULL AND (base = '' OR first_id IS NULL OR coalesce(t.idx < ix, false) OR (ix IS NULL AND t.idx = 0 AND t.fresh)) AS takes FROM al)""".strip(), body="""
  SELECT conversation_id, CASE WHEN takes THEN t.id ELSE first_id END AS first_id, CASE WHEN takes THEN t.p ELSE base END AS first_preview, coalesce(lp, 'none') AS last_preview, coalesce(lr, 'user') AS last_role FROM tk"""))
def next_previews(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    page = turns.where("turn >= conv_no % 4").selectExpr("conversation_id", "turn - conv_no % 4 as idx", "id", "role", "body", "turn % 2 = 0 as fresh")
    heads = turns.select("conversation_id", "conv_no").distinct().selectExpr(
        "conversation_id", "case when conv_no % 3 = 0 then null when conv_no % 3 = 1 then 'gone' else concat(conversation_id, ':4') end as first_id",
        "case when conv_no % 3 > 0 then 'old' end as first_preview", "'none' as last_preview", "'user' as last_role")
    return align.next_previews(heads, page)


@query("x03_merge_clock", sql=f"""
  SELECT user_id, coalesce(b.m, {model.MIN_PAGE_MS + 1}) AS ms, coalesce(b.s, 'first-seen') AS source FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (
    SELECT user_id, {{'m': m, 's': s}} AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (s <> 'page-bucket') DESC, m DESC, event_id DESC) AS r FROM (
      SELECT user_id, event_id, least(1700000000000 + event_id * 50000000, {NOW}) AS m, CASE event_type WHEN 'view' THEN 'page-bucket' WHEN 'click' THEN 'observed' ELSE 'page-exact' END AS s FROM events
      WHERE 1700000000000 + event_id * 50000000 <= {NOW + 366 * model.DAY_MS} AND event_type <> 'error')) WHERE r = 1) USING (user_id)""")
def merge_clock(spark, sf_dir):
    rows = model.load(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "1700000000000 + event_id * 50000000 as ms", "case event_type when 'view' then 'page-bucket' when 'click' then 'observed' when 'error' then 'sidebar-rank' else 'page-exact' end as source")
    out = rows.groupBy("user_id").agg(clock.merge_clock(F.col("ms"), F.col("source"), F.col("event_id"), NOW).alias("c"))
    return out.select("user_id", "c.ms", "c.source")
