"""Identity, order, folding and clocks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx
from ..operators import clock, identity, order
from ..operators.ordered import chunk_of, ordinals, running
from ..sources import model
from .registry import query, with_ctes
from .sqltext import flat, quote, turn_text

NOW = model.NOW_MS
DAY = model.DAY_MS
TOP = NOW + 366 * DAY


def _turns(spark, sf_dir):
    return model.document_messages(spark, sf_dir)


# --- scalar text rules --------------------------------------------------------------


@query("p12_turn_stamp", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, md5(CASE WHEN t = '' THEN '' ELSE role || chr(10) || t END) AS stamp, length(t) AS n
  FROM (SELECT id, role, {turn_text('body')} AS t FROM msg)"""))
def turn_stamp(spark, sf_dir):
    return _turns(spark, sf_dir).select(
        "id", F.md5(identity.turn_stamp(F.col("role"), F.col("body"))).alias("stamp"),
        F.length(markup.turn_text("body")).cast("bigint").alias("n"),
    )


_PAIR = f"""
  pair AS (SELECT id, {turn_text('body')} AS a, {turn_text("CASE conv_no % 4 WHEN 0 THEN '**' || body WHEN 1 THEN left(body, (length(body) * 9) // 10) WHEN 2 THEN body || ' more' ELSE reverse(body) END")} AS b FROM msg)""".strip()


@query("p12_turn_changes", sql=with_ctes(model.DOC_MSG, _PAIR, body="""
  SELECT id, b <> '' AND a <> b AND NOT (a <> '' AND starts_with(a, b) AND length(b) < length(a)) AS changed,
    a <> '' AND length(b) > length(a) AND starts_with(b, a) AS grown,
    b <> '' AND length(b) < length(a) AND starts_with(a, b) AND length(b) >= 24 AND length(b) >= length(a) * 0.8 AS trimmed FROM pair"""))
def turn_changes(spark, sf_dir):
    body, size = F.col("body"), F.length("body")
    kind = F.col("conv_no") % 4
    new = F.when(kind == 0, F.concat(F.lit("**"), body)).when(kind == 1, F.left(body, F.floor(size * 9 / 10).cast("int"))).when(kind == 2, F.concat(body, F.lit(" more"))).otherwise(F.reverse(body))
    rows = _turns(spark, sf_dir).select("id", "body", new.alias("new"))
    old, new = F.col("body"), F.col("new")
    return rows.select("id", identity.wording_changed(old, new).alias("changed"), identity.grows(old, new).alias("grown"), identity.shrinks(old, new).alias("trimmed"))


@query("p13_activity_key", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, {flat("regexp_replace(regexp_replace(" + flat('body') + ", '[hH][tT][tT][pP][sS]?://[^ ]+', ' ', 'g'), '[*_`#\\[\\]()>~]+', '', 'g')")} AS activity_key FROM msg"""))
def activity_key(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", markup.activity_key("body").alias("activity_key"))


@query("p11_preview_text", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, CASE WHEN length(f) <= 360 THEN f ELSE rtrim(left(f, 360)) || '…' END AS preview, length(f) AS n FROM (SELECT id, {flat('body')} AS f FROM msg)"""))
def preview_text(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", tx.preview_text("body").alias("preview"), F.length(tx.flatten_spaces("body")).cast("bigint").alias("n"))


@query("p14_page_ms", sql=f"""
  SELECT event_id, CASE WHEN v BETWEEN {model.MIN_PAGE_MS} AND {TOP} THEN v
    WHEN v >= 1000000000 AND v < 100000000000 AND v * 1000 BETWEEN {model.MIN_PAGE_MS} AND {TOP} THEN v * 1000 END AS ms
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000000 ELSE event_id * 37 END AS v FROM events)""")
def page_ms(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 3
    value = F.when(kind == 0, ms).when(kind == 1, F.expr("unix_millis(cast(ts as timestamp)) div 1000")).otherwise(F.col("event_id") * 37)
    return model.load(spark, sf_dir, "events").select("event_id", clock.page_ms(value, NOW).alias("ms"))


_BUTTON_ROW = "CASE WHEN turn = 9 AND conv_no % 3 = 0 THEN ' Copy ' WHEN turn = 8 AND conv_no % 3 = 1 THEN 'You said:' WHEN turn = 7 AND conv_no % 3 = 2 THEN '**ChatGPT**' ELSE body END"


@query("f06_substantive", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, NOT (label = '' OR label IN ({', '.join(quote(b) for b in identity.BUTTON_LABELS)}) OR name = ''
    OR name IN ({', '.join(quote(b) for b in identity.SPEAKER_LABELS)}) OR regexp_matches(name, {quote(identity.SPEAKER_SAID)})) AS kept
  FROM (SELECT id, lower({flat('b')}) AS label, lower({flat("regexp_replace(b, '[#>*_`~\\[\\]()]', ' ', 'g')")}) AS name
    FROM (SELECT id, {_BUTTON_ROW} AS b FROM msg))"""))
def substantive(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("id", F.expr(_BUTTON_ROW).alias("b"))
    return rows.select("id", identity.is_substantive(F.col("b")).alias("kept"))


_STATUS = """CASE WHEN conv_no % 3 = 0 AND turn IN (2, 3, 4) THEN '• Creating image ' || (turn * 20) || '%'
    WHEN conv_no % 3 = 1 AND turn IN (5, 6) THEN 'Sketching' WHEN conv_no % 3 = 2 AND turn = 7 THEN 'Drawing 80%…' ELSE body END"""


def _core(expr):
    x = flat(expr)
    x = f"regexp_replace({x}, '^[\\s\\-–—_•·*※…‥.。]+', '')"
    x = f"regexp_replace({x}, '[0-9]{{1,3}}\\s*[%％]', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+[0-9]{{1,3}}\\s*$', '')"
    x = f"regexp_replace({x}, '[\\s\\-–—_•·*※…‥.。!！?？~～、,，:：;；]+$', '')"
    return f"lower({flat(x)})"


_PHRASES = ", ".join(quote(p) for p in identity.PROGRESS_PHRASES)
_PROGRESS = f"({_core('b')} IN ({_PHRASES}) AND ({_core('b')} NOT IN ({', '.join(quote(w) for w in identity.ONE_WORD_STATUS)}) OR regexp_matches(b, '[0-9]{{1,3}}\\s*[%％]')))"


@query("f07_progress_status", sql=with_ctes(model.DOC_MSG, body=f"SELECT id, {_PROGRESS} AS progress FROM (SELECT id, {_STATUS} AS b FROM msg)"))
def progress_status(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("id", F.expr(_STATUS).alias("b"))
    return rows.select("id", identity.is_progress(F.col("b")).alias("progress"))


@query("p31_turn_id", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT id, CASE WHEN turn % 3 = 0 THEN 'n' || turn WHEN turn % 3 = 1 THEN 'box' || conv_no || ':' || role
    ELSE md5(role || ':' || {flat('body')}) END AS derived FROM msg"""))
def turn_id(spark, sf_dir):
    turn = F.col("turn")
    native = F.when(turn % 3 == 0, F.concat(F.lit("n"), turn.cast("string")))
    box = F.when(turn % 3 == 1, F.concat(F.lit("box"), F.col("conv_no").cast("string"))).otherwise(F.lit(""))
    return _turns(spark, sf_dir).select("id", identity.turn_id_of(native, box, F.col("role"), F.col("body")).alias("derived"))


# --- conversation profiles ----------------------------------------------------------


@query("a06_message_count", sql=with_ctes(model.DOC_MSG, body="SELECT conversation_id, count(*) AS n FROM msg GROUP BY ALL"))
def message_count(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("a07_role_profile", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT conversation_id, count(*) FILTER (role = 'user') AS user_count, count(*) FILTER (role <> 'user') AS assistant_count, sum(length(b))::BIGINT AS chars
  FROM (SELECT *, {_STATUS} AS b FROM msg) WHERE NOT {_PROGRESS} GROUP BY conversation_id"""))
def role_profile(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conversation_id", "role", F.expr(_STATUS).alias("b")).where(~identity.is_progress(F.col("b")))
    return rows.groupBy("conversation_id").agg(
        F.count_if(F.col("role") == "user").alias("user_count"), F.count_if(F.col("role") != "user").alias("assistant_count"),
        F.sum(F.length("b").cast("bigint")).alias("chars"),
    )


@query("a08_size_histogram", sql=with_ctes(model.DOC_MSG, body="""
  SELECT role, CASE WHEN length(body) <= 0 THEN '0' WHEN length(body) <= 40 THEN '1-40' WHEN length(body) <= 160 THEN '41-160'
    WHEN length(body) <= 640 THEN '161-640' WHEN length(body) <= 2560 THEN '641-2560' ELSE '2560+' END AS bucket, count(*) AS n FROM msg GROUP BY ALL"""))
def size_histogram(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("role", identity.size_bucket(F.length("body")).alias("bucket")).agg(F.count("*").alias("n"))


_FLAT360 = f"CASE WHEN length({flat('body')}) <= 360 THEN {flat('body')} ELSE rtrim(left({flat('body')}, 360)) || '…' END"


@query("a09_previews", sql=with_ctes(model.DOC_MSG, body=f"""
  SELECT conversation_id, arg_min(p, turn) FILTER (role = 'user') AS first_user_preview,
    arg_min(id, turn) FILTER (role = 'user') AS first_user_message_id,
    arg_max(p, turn) AS last_preview, arg_max(role, turn) AS last_preview_role
  FROM (SELECT *, {_FLAT360} AS p FROM msg) GROUP BY conversation_id"""))
def previews(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conversation_id", "id", "role", "turn", tx.preview_text("body").alias("p"))
    early = F.when(F.col("role") == "user", F.col("turn"))
    return rows.groupBy("conversation_id").agg(
        F.min_by("p", early).alias("first_user_preview"), F.min_by("id", early).alias("first_user_message_id"),
        F.max_by("p", "turn").alias("last_preview"), F.max_by("role", "turn").alias("last_preview_role"),
    )


# Transcripts: every third conversation is a copy of the one numbered below it.
_COPY = "CASE WHEN conv_no % 3 = 1 THEN conv_no - 1 ELSE conv_no END"
_PRINT = """prints AS (
  SELECT conversation_id, count(*) || '-' || sum(('0x' || substr(x, 1, 12))::BIGINT) || '-' || sum(('0x' || substr(x, 13, 12))::BIGINT) AS fingerprint
  FROM (SELECT conversation_id, md5(row_number() OVER (PARTITION BY conversation_id ORDER BY turn) || ':' || md5(body)) AS x FROM docs) GROUP BY conversation_id)"""
_COPIES = "docs AS (SELECT * FROM msg UNION ALL SELECT 'copy' || id, 'copy' || conversation_id, conv_no, platform, role, body, turn + 3, captured_ms, capture_index, turn_id FROM msg WHERE conv_no % 3 = 1)"


def _with_copies(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    copies = turns.where("conv_no % 3 = 1").withColumns({
        "id": F.concat(F.lit("copy"), "id"), "conversation_id": F.concat(F.lit("copy"), "conversation_id"), "turn": F.col("turn") + 3})
    return turns.unionByName(copies)


@query("a16_transcript_fingerprint", sql=with_ctes(model.DOC_MSG, _COPIES, _PRINT, body="SELECT * FROM prints"))
def transcript_fingerprint(spark, sf_dir):
    return identity.fingerprints(_with_copies(spark, sf_dir))


@query("a17_identical_transcripts", sql=with_ctes(model.DOC_MSG, _COPIES, _PRINT, body="""
  SELECT fingerprint, count(*) AS copies, min(conversation_id) AS first_id FROM prints GROUP BY fingerprint HAVING count(*) > 1"""))
def identical(spark, sf_dir):
    return identity.identical_transcripts(identity.fingerprints(_with_copies(spark, sf_dir)))


@query("a18_complete_window", sql=with_ctes(model.DOC_MSG, body="""
  SELECT conversation_id, bool_and(setsize = n AND posinset = rn) AS complete FROM (
    SELECT conversation_id, CASE WHEN conv_no % 5 = 0 THEN 11 ELSE count(*) OVER (PARTITION BY conversation_id) END AS setsize, count(*) OVER (PARTITION BY conversation_id) AS n,
      CASE WHEN conv_no % 5 = 1 AND turn = 4 THEN 40 ELSE turn + 1 END AS posinset, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS rn FROM msg)
  GROUP BY conversation_id"""))
def complete_window(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    sizes = turns.groupBy("conversation_id").agg(F.count("*").alias("n"))
    rows = ordinals(turns.select("conversation_id", "conv_no", "turn"), ["conversation_id"], ["turn"], chunk_of("turn"), "rn").join(sizes, "conversation_id")
    size = F.when(F.col("conv_no") % 5 == 0, 11).otherwise(F.col("n"))
    pos = F.when((F.col("conv_no") % 5 == 1) & (F.col("turn") == 4), 40).otherwise(F.col("turn") + 1)
    return rows.groupBy("conversation_id").agg(F.bool_and((size == F.col("n")) & (pos == F.col("rn"))).alias("complete"))


@query("j14_ownership_gate", sql=with_ctes(model.DOC_MSG, """
  keyed AS (SELECT conversation_id, conv_no, platform, md5(role || ':' || n || ':' || left(body, n)) AS key FROM msg, (SELECT unnest([40, 80, 160]) AS n) WHERE length(body) >= n),
  asked AS (SELECT 'copy' AS kind, platform || ':x' || conv_no AS conversation_id, platform, key FROM keyed WHERE conv_no % 3 = 1
    UNION ALL SELECT 'own', conversation_id, platform, key FROM keyed WHERE conv_no % 3 = 2)""".strip(), body="""
  SELECT DISTINCT conversation_id FROM (
    SELECT a.conversation_id, a.key, bool_or(o.conversation_id = a.conversation_id) AS own
    FROM asked a JOIN keyed o ON o.key = a.key AND o.platform = a.platform GROUP BY ALL) WHERE NOT own"""))
def ownership_gate(spark, sf_dir):
    keys = identity.body_keys(_turns(spark, sf_dir))
    owners = keys.select("key", F.col("conversation_id").alias("owner"))
    no = F.regexp_extract("conversation_id", ":c([0-9]+)$", 1).cast("bigint")
    copies = keys.where(no % 3 == 1).select(F.concat(F.substring_index("conversation_id", ":", 1), F.lit(":x"), no.cast("string")).alias("conversation_id"), "key")
    return identity.held_captures(copies.unionByName(keys.where(no % 3 == 2)), owners)


# --- order --------------------------------------------------------------------------

_STORED = "stored AS (SELECT conversation_id, turn * 3 AS pos, id AS message_id FROM msg WHERE turn % 2 = 0 OR turn < 4)"
_PAGE = "page AS (SELECT conversation_id, turn * 7 % 11 AS pos, id AS message_id FROM msg WHERE turn >= CASE WHEN conv_no % 4 = 3 THEN 9 ELSE 2 END AND conv_no % 5 <> 4)"


def _stored_page(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    stored = turns.where("turn % 2 = 0 or turn < 4").selectExpr("conversation_id", "turn * 3 as pos", "id as message_id")
    page = turns.where("turn >= case when conv_no % 4 = 3 then 9 else 2 end and conv_no % 5 <> 4").selectExpr("conversation_id", "turn * 7 % 11 as pos", "id as message_id")
    return turns, stored, page


@query("w01_message_order", sql=with_ctes(model.DOC_MSG, _PAGE, """
  base AS (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY captured_ms, capture_index, id) AS slot FROM msg),
  ranked AS (SELECT base.*, row_number() OVER (PARTITION BY conversation_id ORDER BY slot) AS k, row_number() OVER (PARTITION BY conversation_id ORDER BY pos) AS r
    FROM base JOIN page USING (conversation_id) WHERE message_id = id)""".strip(), body="""
  SELECT b.conversation_id, b.id, coalesce(s.slot, b.slot) AS pos FROM base b
  LEFT JOIN ranked m ON m.id = b.id LEFT JOIN ranked s ON s.conversation_id = m.conversation_id AND s.k = m.r"""))
def message_order(spark, sf_dir):
    turns, _, page = _stored_page(spark, sf_dir)
    return order.message_order(turns, page)


@query("s09_read_in_order", sql=with_ctes(model.DOC_MSG, body="""
  SELECT conversation_id, id, role, length(body) AS chars, row_number() OVER (PARTITION BY conversation_id ORDER BY captured_ms, capture_index, id) AS pos
  FROM msg WHERE conversation_id IN (SELECT platform || ':c' || conv_no FROM msg WHERE conv_no % 10 = 3)"""))
def read_in_order(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    wanted = turns.where("conv_no % 10 = 3").select("conversation_id").distinct()
    rows = turns.join(wanted, "conversation_id", "left_semi")
    placed = order.message_order(rows, rows.where("false").selectExpr("conversation_id", "turn as pos", "id as message_id"))
    return rows.select("conversation_id", "id", "role", F.length("body").cast("bigint").alias("chars")).join(placed, ["conversation_id", "id"])


@query("w02_merge_page_order", sql=with_ctes(model.DOC_MSG, _STORED, _PAGE, """
  anchor AS (SELECT conversation_id, arg_min(s.pos, p.pos) AS a FROM stored s JOIN page p USING (conversation_id, message_id) GROUP BY conversation_id),
  tagged AS (
    SELECT s.conversation_id, s.message_id, CASE WHEN a IS NULL OR s.pos < a THEN 0 ELSE 2 END AS g, s.pos AS i FROM stored s LEFT JOIN anchor USING (conversation_id)
    UNION ALL SELECT p.conversation_id, p.message_id, CASE WHEN a IS NULL THEN 2 ELSE 1 END, p.pos FROM page p LEFT JOIN anchor USING (conversation_id)),
  firsts AS (SELECT conversation_id, message_id, min((g, i)) AS t FROM tagged GROUP BY ALL)""".strip(), body="""
  SELECT conversation_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY t, message_id) AS pos FROM firsts"""))
def merge_page_order(spark, sf_dir):
    _, stored, page = _stored_page(spark, sf_dir)
    return order.merge_page_order(stored, page)


@query("w13_fill_roles", sql=with_ctes(model.DOC_MSG, body="""
  SELECT id, CASE WHEN role2 <> 'unknown' THEN role2 WHEN s IS NULL THEN CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END
    WHEN (turn - s.t) % 2 = 1 THEN CASE WHEN s.r = 'user' THEN 'assistant' ELSE 'user' END ELSE s.r END AS role
  FROM (SELECT *, last_value(CASE WHEN role2 <> 'unknown' THEN {'t': turn, 'r': role2} END IGNORE NULLS)
      OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
    FROM (SELECT *, CASE WHEN (conv_no + turn) % 3 = 0 THEN role ELSE 'unknown' END AS role2 FROM msg))"""))
def fill_roles(spark, sf_dir):
    turns = _turns(spark, sf_dir).selectExpr("conversation_id", "id", "turn as idx", "case when (conv_no + turn) % 3 = 0 then role else 'unknown' end as role")
    return order.fill_roles(turns).select("id", "role")


@query("w14_repeat_ids", sql=with_ctes(model.DOC_MSG, body="""
  SELECT conversation_id, turn AS idx, h || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS id FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id, h ORDER BY turn) AS n FROM (SELECT *, left(md5(role || (turn % 3)), 8) AS h FROM msg))"""))
def repeat_ids(spark, sf_dir):
    turns = _turns(spark, sf_dir).selectExpr("conversation_id", "turn as idx", "left(md5(concat(role, cast(turn % 3 as string))), 8) as id")
    return order.distinct_ids(turns)


_LIST = """lst AS (
  SELECT lang AS list_id, doc_id AS line, CASE WHEN doc_id % 13 < 4 AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 26 < 13 THEN 'Today' ELSE 'Pinned' END END AS heading, source || ':' || doc_id AS item FROM documents)"""


@query("w05_section_headings", sql=with_ctes(_LIST, """
  held AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY list_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM lst)""".strip(), body="""
  SELECT list_id, line, item, section, row_number() OVER (PARTITION BY list_id ORDER BY line) - 1 AS list_index FROM held WHERE heading IS NULL AND coalesce(section, '') <> 'Pinned'"""))
def section_headings(spark, sf_dir):
    rows = model.load(spark, sf_dir, "documents").selectExpr(
        "lang as list_id", "doc_id as line",
        "case when doc_id % 13 < 4 and doc_id % 2 = 0 then case when doc_id % 26 < 13 then 'Today' else 'Pinned' end end as heading",
        "concat_ws(':', source, doc_id) as item",
    )
    return order.carry_headings(rows)


# --- folds and clones ---------------------------------------------------------------

_RUNS = f"""runs AS (
  SELECT conversation_id, turn + 1 AS ord, id, CASE WHEN turn IN (0, 8) THEN 'user' ELSE 'assistant' END AS role,
    {_STATUS} AS b, CASE WHEN conv_no % 4 = 3 THEN turn ELSE 2 END AS capture_index, CASE WHEN turn <= 5 THEN 'a' WHEN conv_no % 2 = 0 THEN 'b' END AS turn_id FROM msg)"""


def _fold_rows(spark, sf_dir):
    return _turns(spark, sf_dir).selectExpr(
        "conversation_id", "turn + 1 as ord", "id", "case when turn in (0, 8) then 'user' else 'assistant' end as role", f"{_STATUS} as body",
        "cast(case when conv_no % 4 = 3 then turn else 2 end as int) as capture_index", "case when turn <= 5 then 'a' when conv_no % 2 = 0 then 'b' end as turn_id",
    )


_FOLD = f"""
  st AS (SELECT *, role = 'assistant' AND {_PROGRESS} AS s FROM runs),
  nb AS (SELECT *, lag(s) OVER w AS ps, lag(capture_index) OVER w AS pc, lag(turn_id) OVER w AS pt FROM st WINDOW w AS (PARTITION BY conversation_id ORDER BY ord)),
  isl AS (SELECT *, sum(CASE WHEN s AND NOT coalesce(ps AND pc = capture_index AND pt = turn_id, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ord) AS g FROM nb),
  ends AS (SELECT conversation_id, g, max(ord) AS last_ord, arg_max(id, ord) AS last_id, any_value(capture_index) AS c, any_value(turn_id) AS t FROM isl WHERE s GROUP BY conversation_id, g),
  keeps AS (SELECT e.*, n.id AS next_id FROM ends e LEFT JOIN st n ON n.conversation_id = e.conversation_id AND n.ord = e.last_ord + 1 AND NOT n.s AND n.role = 'assistant' AND n.capture_index = e.c AND n.turn_id = e.t),
  folds AS (SELECT i.conversation_id, i.id AS drop_id, coalesce(k.next_id, k.last_id) AS keep_id FROM isl i JOIN keeps k ON k.conversation_id = i.conversation_id AND k.g = i.g
    WHERE i.s AND i.id <> coalesce(k.next_id, k.last_id))""".strip()


@query("w06_progress_fold", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, body="SELECT * FROM folds"))
def progress_fold(spark, sf_dir):
    return identity.progress_folds(_fold_rows(spark, sf_dir))


@query("s14_apply_folds", sql=with_ctes(model.DOC_MSG, _RUNS, _FOLD, body="""
  SELECT conversation_id, count(*) AS message_count, arg_max(id, ord) AS tail_message_id FROM runs WHERE id NOT IN (SELECT drop_id FROM folds) GROUP BY conversation_id"""))
def apply_folds(spark, sf_dir):
    rows = _fold_rows(spark, sf_dir)
    left = identity.apply_folds(rows, identity.progress_folds(rows))
    return left.groupBy("conversation_id").agg(F.count("*").alias("message_count"), F.max_by("id", "ord").alias("tail_message_id"))


_CLONES = """
  blocks AS (SELECT conversation_id, conv_no, platform, role, turn, c, CASE WHEN conv_no % 7 = 6 AND c = 1 AND turn = 3 THEN 'other' ELSE body END AS body, turn_id2 AS turn_id,
      CASE WHEN conv_no % 11 = 10 AND c = 0 THEN id ELSE conversation_id || ':' || left(md5(body), 6) || c || ':dom' || turn END AS id
    FROM (SELECT *, 't' || turn AS turn_id2 FROM msg), (SELECT unnest([0, 1, 2]) AS c) WHERE c <= conv_no % 3),
  stored AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY c, turn) AS ord FROM blocks),
  page AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) - 1 AS idx, role, body,
    CASE WHEN conv_no % 2 = 0 THEN conversation_id || ':' || left(md5(body), 6) || 0 || ':dom' || turn ELSE 'new' || id END AS id FROM msg)""".strip()


@query("w07_clone_drops", sql=with_ctes(model.DOC_MSG, _CLONES, f"""
  sz AS (SELECT p.conversation_id, l, n FROM (SELECT conversation_id, count(*) AS l FROM page GROUP BY 1) p JOIN (SELECT conversation_id, count(*) AS n FROM stored GROUP BY 1) s USING (conversation_id)
    WHERE l >= 2 AND n >= 2 * l AND n % l = 0),
  r AS (SELECT conversation_id, id, (ord - 1) % l AS idx, (ord - 1) // l AS block, n // l AS copies, turn_id, CASE WHEN {turn_text('body')} = '' THEN '' ELSE role || {turn_text('body')} END AS stamp FROM stored JOIN sz USING (conversation_id)),
  ok AS (SELECT r.conversation_id, coalesce(min(block) FILTER (r.id IN (SELECT id FROM page)), any_value(copies) - 1) AS keep FROM r
    JOIN (SELECT conversation_id, idx, CASE WHEN {turn_text('body')} = '' THEN '' ELSE role || {turn_text('body')} END AS ps FROM page) p USING (conversation_id, idx)
    GROUP BY r.conversation_id HAVING bool_and(stamp = ps AND stamp <> '' AND turn_id = 't' || turn_id[2:])),
  bad AS (SELECT DISTINCT conversation_id FROM r JOIN ok USING (conversation_id) WHERE block <> keep AND NOT regexp_matches(id, {quote(identity.SYNTHETIC_ID)}))""".strip(), body="""
  SELECT d.conversation_id, d.id AS drop_id, k.id AS keep_id FROM r d JOIN ok USING (conversation_id) JOIN r k ON k.conversation_id = d.conversation_id AND k.idx = d.idx AND k.block = keep
  WHERE d.block <> keep AND d.conversation_id NOT IN (SELECT conversation_id FROM bad)"""))
def clone_drops(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    synthetic = "concat(conversation_id, ':', left(md5(body), 6), cast(c as string), ':dom', turn)"
    blocks = turns.selectExpr("*", "explode(sequence(0, cast(conv_no % 3 as int))) as c").selectExpr(
        "conversation_id", "turn", "c", "role", "case when conv_no % 7 = 6 and c = 1 and turn = 3 then 'other' else body end as body",
        "concat('t', turn) as turn_id", f"case when conv_no % 11 = 10 and c = 0 then id else {synthetic} end as id",
    )
    stored = ordinals(blocks, ["conversation_id"], ["c", "turn"], F.col("c") * 2**40 + chunk_of("turn"))
    page = turns.withColumn("c", F.lit(0)).selectExpr("conversation_id", "turn", "role", "body", f"case when conv_no % 2 = 0 then {synthetic} else concat('new', id) end as id")
    page = ordinals(page, ["conversation_id"], ["turn"], chunk_of("turn")).withColumn("idx", F.col("ord") - 1)
    return identity.clone_drops(stored, page)


@query("j18_snapshot_absence", sql=with_ctes(model.DOC_MSG, """
  stored AS (SELECT conversation_id, body, CASE WHEN turn % 3 = 0 THEN id ELSE conversation_id || ':' || left(md5(body), 7) || ':dom' || turn END AS id FROM msg),
  page AS (SELECT conversation_id, body, CASE WHEN turn % 3 = 0 THEN id ELSE conversation_id || ':' || left(md5(body), 7) || ':dom' || turn END AS id FROM msg WHERE conv_no % 2 = 0 AND turn NOT IN (3, 4, 5))""".strip(), body=f"""
  SELECT conversation_id, id FROM stored s WHERE conversation_id IN (SELECT conversation_id FROM page) AND regexp_matches(id, {quote(identity.SYNTHETIC_ID)})
    AND NOT EXISTS (FROM page p WHERE p.conversation_id = s.conversation_id AND (p.id = s.id OR p.body = s.body))"""))
def snapshot_absence(spark, sf_dir):
    sid = "case when turn % 3 = 0 then id else concat(conversation_id, ':', left(md5(body), 7), ':dom', turn) end as id"
    turns = _turns(spark, sf_dir)
    stored = turns.selectExpr("conversation_id", "body", sid)
    page = turns.where("conv_no % 2 = 0 and turn not in (3, 4, 5)").selectExpr("conversation_id", "body", sid)
    return identity.snapshot_drops(stored, page)


# --- clocks -------------------------------------------------------------------------

_OBS = f"""obs AS (
  SELECT conversation_id, turn AS arrival, ['page-exact','observed','page-bucket','other','page-bucket'][((conv_no + turn * 3) % 5 + 1)::INT] AS source,
    CASE WHEN turn = 7 THEN 12 ELSE 1700000000000 + (conv_no * 31 + turn * 17) % 23 * 3600000 + CASE WHEN (conv_no + turn) % 29 = 0 THEN 60000000000 ELSE 0 END END AS ms FROM msg WHERE turn < conv_no % 12)"""


@query("a11_clock_merge", sql=with_ctes(model.DOC_MSG, _OBS, f"""
  best AS (SELECT conversation_id, {{'m': m, 's': source}} AS b FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY c DESC, m DESC, arrival DESC) AS r
    FROM (SELECT *, least(ms, {NOW}) AS m, CASE WHEN source = 'page-bucket' THEN 1 ELSE 2 END AS c
    FROM obs WHERE source <> 'other' AND ms BETWEEN {model.MIN_PAGE_MS} AND {TOP})) WHERE r = 1)""".strip(), body=f"""
  SELECT o.conversation_id, coalesce(b.m, {model.MIN_PAGE_MS + 1}) AS updated_ms, coalesce(b.s, 'first-seen') AS updated_source
  FROM (SELECT DISTINCT conversation_id FROM obs) o LEFT JOIN best USING (conversation_id)"""))
def clock_merge(spark, sf_dir):
    return clock.merged_clocks(_observations(spark, sf_dir), NOW)


def _observations(spark, sf_dir):
    return _turns(spark, sf_dir).where("turn < conv_no % 12").selectExpr(
        "conversation_id", "turn as arrival",
        "element_at(array('page-exact','observed','page-bucket','other','page-bucket'), cast((conv_no + turn * 3) % 5 + 1 as int)) as source",
        "case when turn = 7 then 12 else 1700000000000 + (conv_no * 31 + turn * 17) % 23 * 3600000 + case when (conv_no + turn) % 29 = 0 then 60000000000 else 0 end end as ms",
    )


_ITEMS = f"""items AS (
  SELECT lang AS list_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, doc_id AS id,
    CASE WHEN doc_id % 5 = 3 THEN NULL ELSE 1730000000000 - doc_id * 1800000 + (doc_id * 7919 % 40) * 3600000 END AS updated_ms,
    CASE WHEN lang = 'fr' THEN 'first-seen' WHEN doc_id % 7 < 2 THEN 'page-exact' WHEN doc_id % 7 = 2 THEN 'page-bucket' WHEN doc_id % 7 = 3 THEN 'sidebar-rank' END AS updated_source FROM documents)"""
_EST = f"""
  anc AS (SELECT *, updated_source IN ('page-exact', 'page-bucket') AND updated_ms BETWEEN {model.MIN_PAGE_MS} AND {TOP} AS a FROM items),
  anb AS (SELECT *, coalesce(a, false) AS an, count(*) OVER (PARTITION BY list_id) AS n, coalesce(bool_or(a) OVER (PARTITION BY list_id), false) AS anchored,
    last_value(CASE WHEN a THEN {{'i': idx, 'm': updated_ms}} END IGNORE NULLS) OVER (PARTITION BY list_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
    first_value(CASE WHEN a THEN {{'i': idx, 'm': updated_ms}} END IGNORE NULLS) OVER (PARTITION BY list_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS dn,
    max(CASE WHEN a THEN updated_ms END) OVER (PARTITION BY list_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM anc),
  bnd AS (SELECT *, last_value(CASE WHEN an AND updated_source = 'page-exact' AND updated_ms >= coalesce(later, -1) THEN updated_ms END IGNORE NULLS)
    OVER (PARTITION BY list_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM anb),
  g1 AS (SELECT *, an OR updated_source IN ('page-exact', 'page-bucket') OR (NOT anchored AND updated_source = 'sidebar-rank') AS fx,
    floor(up.m - ((up.m - dn.m) * (idx - up.i))::DOUBLE / (dn.i - up.i) + 0.5)::BIGINT AS mid,
    floor(dn.m + greatest({NOW} - dn.m, dn.i)::DOUBLE / (dn.i + 1) * (dn.i - idx) + 0.5)::BIGINT AS rise0 FROM bnd),
  g2 AS (SELECT *, CASE WHEN rise0 > {NOW} THEN {NOW} - idx ELSE rise0 END AS rise1 FROM g1),
  g3 AS (SELECT *, CASE WHEN up IS NOT NULL AND dn IS NOT NULL THEN
      CASE WHEN greatest(up.m, dn.m) - 1 > least(up.m, dn.m) + 1 THEN least(greatest(up.m, dn.m) - 1, greatest(least(up.m, dn.m) + 1, mid)) ELSE mid END
    WHEN dn IS NOT NULL THEN CASE WHEN rise1 <= dn.m THEN least({NOW}, dn.m + dn.i - idx) ELSE rise1 END ELSE up.m - (idx - up.i) * 3600000 END AS guess FROM g2)""".strip()


@query("w03_list_interpolation", sql=with_ctes(_ITEMS, _EST, body=f"""
  SELECT list_id, idx, id, CASE WHEN coalesce(fx, false) THEN updated_ms WHEN anchored THEN
      CASE WHEN least(guess, {NOW}) BETWEEN {model.MIN_PAGE_MS} AND {TOP} THEN least(guess, {NOW}) ELSE {model.MIN_PAGE_MS} + (n - idx) * 1000 END
      ELSE {model.MIN_PAGE_MS} + (n - idx) * 1000 END AS updated_ms,
    CASE WHEN coalesce(fx, false) THEN updated_source WHEN anchored THEN 'sidebar-rank' ELSE 'first-seen' END AS updated_source FROM g3"""))
def list_interpolation(spark, sf_dir):
    return clock.list_estimates(_list_items(spark, sf_dir), NOW).drop("older_than_ms")


def _list_items(spark, sf_dir):
    rows = model.load(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = ordinals(rows, ["lang"], ["doc_id"], chunk_of("doc_id"))
    return rows.selectExpr(
        "lang as list_id", "ord - 1 as idx", "doc_id as id",
        "case when doc_id % 5 = 3 then null else 1730000000000 - doc_id * 1800000 + (doc_id * 7919 % 40) * 3600000 end as updated_ms",
        "case when lang = 'fr' then 'first-seen' when doc_id % 7 < 2 then 'page-exact' when doc_id % 7 = 2 then 'page-bucket' when doc_id % 7 = 3 then 'sidebar-rank' end as updated_source",
    )


@query("w04_older_than", sql=with_ctes(_ITEMS, _EST, body="""
  SELECT list_id, idx, id, CASE WHEN NOT coalesce(fx, false) AND anchored THEN bound END AS older_than_ms FROM g3"""))
def older_than(spark, sf_dir):
    return clock.list_estimates(_list_items(spark, sf_dir), NOW).select("list_id", "idx", "id", "older_than_ms")


def _ok(c):
    return f"{c} BETWEEN {model.MIN_PAGE_MS} AND {TOP}"


@query("p25_activity_label", sql=with_ctes(model.DOC_MSG, model.HDR, body=f"""
  SELECT id, kind, CASE WHEN kind IN ('exact', 'approx') THEN CASE WHEN {_ok('updated_ms')} THEN updated_ms END WHEN kind = 'before' THEN older_than_ms
      ELSE coalesce(CASE WHEN {_ok('first_seen_ms')} THEN first_seen_ms END, CASE WHEN {_ok('created_ms')} THEN created_ms END, updated_ms) END AS stamp_ms,
    CASE WHEN kind = 'exact' AND {_ok('updated_ms')} THEN CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN 'minute' WHEN m < 2880 THEN 'hour' WHEN m < 10080 THEN 'day' ELSE 'date' END END AS unit,
    CASE WHEN kind = 'exact' AND {_ok('updated_ms')} THEN CASE WHEN m < 1 THEN 0 WHEN m < 60 THEN m WHEN m < 2880 THEN m // 60 WHEN m < 10080 THEN m // 1440 END END AS amount
  FROM (SELECT *, ({NOW} - updated_ms) // 60000 AS m, CASE WHEN updated_source IN ('page-exact', 'observed') THEN 'exact' WHEN updated_source = 'page-bucket' THEN 'approx'
    WHEN updated_source = 'sidebar-rank' AND {_ok('older_than_ms')} THEN 'before' ELSE 'unknown' END AS kind
    FROM (SELECT * REPLACE ({NOW} - conv_no * conv_no * 60000 AS updated_ms) FROM hdr))"""))
def activity_label(spark, sf_dir):
    heads = model.headers(_turns(spark, sf_dir)).withColumn("updated_ms", F.lit(NOW) - F.col("conv_no") * F.col("conv_no") * 60000)
    return heads.select("id", *clock.activity_label(NOW))
