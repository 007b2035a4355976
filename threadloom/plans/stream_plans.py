"""Streaming operators run to completion over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import identity
from ..session import checkpoint_dir
from ..sources import capture, model
from ..streaming import rules, sink
from .registry import query, with_ctes

NOW = model.NOW_MS
START = 1704067200000


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    """``events`` as a stream on a denser clock: 700 ms between events, some out of order."""
    rows = spark.readStream.schema(model.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at_ms = F.lit(START) + F.col("event_id") * 700 - F.col("user_id") % 5 * 300
    return rows.withColumn("at_ms", at_ms).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "1 minute")


def _drain(spark, frame, mode="append"):
    """Run a stream over everything available into a table and read it."""
    out = _folder(spark, "stream")
    frame.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")


def _replayed(rows: str, first: str, steps: str, body: str) -> str:
    """A keyed rule as recursive SQL: ``rows`` (key, rn, ...) one after another, each from the state that the row before left."""
    return f"""WITH RECURSIVE {EV}, k AS ({rows}), s AS (
      SELECT key, rn, event_id, {first} FROM k WHERE rn = 1
      UNION ALL SELECT key, rn, event_id, {steps}
    ) {body}"""


EV = f"ev AS (SELECT *, {START} + event_id * 700 - user_id % 5 * 300 AS at_ms FROM events)"


@query("st01_duplicate_gate", sql=_replayed(
    "SELECT user_id % 40 AS key, row_number() OVER (PARTITION BY user_id % 40 ORDER BY at_ms, event_id) AS rn, event_id, at_ms, user_id % 3 AS conversation FROM ev",
    "conversation AS owner, at_ms AS since, FALSE AS held",
    """CASE WHEN h THEN owner ELSE conversation END, CASE WHEN h THEN since ELSE at_ms END, h FROM (
        SELECT k.*, s.owner, s.since, s.owner <> k.conversation AND k.at_ms - s.since < 5000 AS h FROM s JOIN k ON k.key = s.key AND k.rn = s.rn + 1)""",
    "SELECT event_id, held FROM s"))
def duplicate_gate(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr("event_id", "at", "at_ms", "cast(user_id % 40 as string) as body_hash", "user_id % 3 as conversation")
    return _drain(spark, rules.duplicate_gate(rows))


@query("st02_ownership_gate", sql=with_ctes(EV, body="""
  SELECT event_id, user_id % 3 <> first_value(user_id % 3) OVER (PARTITION BY user_id % 40 ORDER BY at_ms, event_id) AS held FROM ev"""))
def ownership_gate(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr("event_id", "at_ms", "cast(user_id % 40 as string) as body_hash", "user_id % 3 as conversation")
    return _drain(spark, rules.ownership_gate(rows))


@query("st03_burst_collapse", sql=with_ctes(EV, """
  k AS (SELECT *, user_id % 4 AS tab, at_ms - lag(at_ms) OVER (PARTITION BY user_id % 4 ORDER BY at_ms, event_id) AS gap FROM ev),
  g AS (SELECT *, sum(CASE WHEN gap < 800 THEN 0 ELSE 1 END) OVER (PARTITION BY tab ORDER BY at_ms, event_id) AS burst FROM k),
  b AS (SELECT tab, count(*) AS changes, last(value ORDER BY at_ms, event_id) AS value, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM g GROUP BY tab, burst)""".strip(), body="""
  SELECT * FROM b WHERE last_ms + 800 <= (SELECT max(at_ms) FROM ev) - 60000"""))
def burst_collapse(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).withColumn("tab", F.col("user_id") % 4)
    out = _drain(spark, rules.collapse_bursts(rows, ["tab"]))
    edge = model.load(spark, sf_dir, "events").agg(F.max(F.lit(START) + F.col("event_id") * 700 - F.col("user_id") % 5 * 300).alias("edge"))
    return out.crossJoin(F.broadcast(edge)).where("last_ms + 800 <= edge - 60000").drop("edge")


@query("st04_empty_alert", sql=with_ctes(EV, """
  k AS (SELECT *, user_id % 6 AS conversation, event_type <> 'view' AND event_id % 19 <> 0 AS empty FROM ev),
  g AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER (PARTITION BY conversation ORDER BY at_ms, event_id) AS run FROM k),
  f AS (SELECT *, min(at_ms) OVER (PARTITION BY conversation, run) AS since_ms FROM g WHERE empty)""".strip(), body="""
  SELECT conversation, since_ms, min(at_ms) AS at_ms FROM f WHERE at_ms - since_ms >= 8000 GROUP BY conversation, run, since_ms"""))
def empty_alert(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr("event_id", "at_ms", "user_id % 6 as conversation", "case when event_type = 'view' then 1 else 0 end as message_count", "event_id % 19 = 0 as new_chat")
    return _drain(spark, rules.empty_alerts(rows))


@query("st05_heartbeat_throttle", sql=_replayed(
    "SELECT user_id % 4 AS key, row_number() OVER (PARTITION BY user_id % 4 ORDER BY at_ms, event_id) AS rn, event_id, at_ms, event_id // 300 AS print FROM ev",
    "print AS told, at_ms AS told_at, TRUE AS sent",
    """CASE WHEN h THEN print ELSE told END, CASE WHEN h THEN at_ms ELSE told_at END, h FROM (
        SELECT k.*, s.told, s.told_at, s.told <> k.print OR k.at_ms - s.told_at >= 60000 AS h FROM s JOIN k ON k.key = s.key AND k.rn = s.rn + 1)""",
    "SELECT event_id FROM s WHERE sent"))
def heartbeat_throttle(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr("event_id", "at_ms", "user_id % 4 as platform", "cast(event_id div 300 as string) as fingerprint")
    return _drain(spark, rules.heartbeats(rows))


@query("st06_visit_context", sql=with_ctes(EV, """
  v AS (SELECT event_id AS visit_id, at_ms AS vms, user_id % 50 AS tab, user_id % 2 AS origin FROM ev WHERE event_type <> 'error'),
  h AS (SELECT event_id AS home_id, at_ms AS hms, user_id % 50 AS tab, user_id % 2 AS origin FROM ev WHERE event_type = 'error')""".strip(), body="""
  SELECT home_id, first(visit_id ORDER BY vms DESC, visit_id DESC) AS visit_id FROM h JOIN v USING (tab, origin) WHERE hms BETWEEN vms AND vms + 60000 GROUP BY home_id"""))
def visit_context(spark, sf_dir):
    visits = _event_stream(spark, sf_dir).where("event_type <> 'error'").selectExpr("event_id as visit_id", "at as visit_at", "user_id % 50 as tab_v", "user_id % 2 as origin_v")
    homes = _event_stream(spark, sf_dir).where("event_type = 'error'").selectExpr("event_id as home_id", "at as home_at", "user_id % 50 as tab", "user_id % 2 as origin")
    return rules.latest_visit(_drain(spark, rules.visit_pairs(homes, visits)))


@query("st07_evidence_run", sql=_replayed(
    "SELECT user_id % 3 AS key, row_number() OVER (PARTITION BY user_id % 3 ORDER BY at_ms, event_id) AS rn, event_id, at_ms, event_id // 60 AS conversation, event_id % 37 = 0 AS blocked FROM ev",
    "CASE WHEN NOT blocked THEN conversation END AS seen, conversation, at_ms AS since, at_ms AS last, 1 AS n",
    """CASE WHEN NOT blocked THEN conversation END, conversation, CASE WHEN goes_on THEN since ELSE at_ms END,
        CASE WHEN goes_on AND at_ms - last < 1000 THEN last ELSE at_ms END, CASE WHEN NOT goes_on THEN 1 WHEN at_ms - last >= 1000 THEN n + 1 ELSE n END FROM (
        SELECT k.*, s.since, s.last, s.n, coalesce(s.seen = k.conversation AND k.at_ms - s.last <= 6000, FALSE) AS goes_on FROM s JOIN k ON k.key = s.key AND k.rn = s.rn + 1)""",
    "SELECT s.event_id, s.conversation FROM s JOIN k ON k.event_id = s.event_id WHERE s.seen IS NOT NULL AND s.n >= 3 AND k.at_ms - s.since >= 8000"))
def evidence_run(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr(
        "event_id", "at_ms", "user_id % 3 as tab", "event_id div 60 as conversation", "concat('u', event_id div 60) as url", "case when event_type = 'error' then 1 else 2 end as hits", "event_id % 37 = 0 as blocked")
    return _drain(spark, rules.evidence_runs(rows))


@query("st08_activity_clock", sql=with_ctes(EV, f"""
  o AS (SELECT user_id AS conversation_id, at_ms AS ms, event_id, CASE event_type WHEN 'view' THEN 'page-bucket' WHEN 'click' THEN 'observed' ELSE 'page-exact' END AS source FROM ev)""".strip(), body="""
  SELECT conversation_id, first(ms ORDER BY (source <> 'page-bucket') DESC, ms DESC, event_id DESC) AS updated_ms, first(source ORDER BY (source <> 'page-bucket') DESC, ms DESC, event_id DESC) AS updated_source FROM o GROUP BY conversation_id"""))
def activity_clock(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr(
        "user_id as conversation_id", "at_ms as ms", "event_id as arrival", "case event_type when 'view' then 'page-bucket' when 'click' then 'observed' else 'page-exact' end as source")
    out = _folder(spark, "clock")
    clocks = rules.stream_clocks(rows, NOW)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/rows/b={batch_id}")

    clocks.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.schema("conversation_id BIGINT, updated_ms BIGINT, updated_source STRING, batch INT").parquet(f"{out}/rows")
    last = stored.groupBy("conversation_id").agg(F.max_by(F.struct("updated_ms", "updated_source"), "batch").alias("c"))
    return last.select("conversation_id", "c.*")


@query("st09_capture_baseline", sql=with_ctes(EV, body="""
  SELECT event_id, first_value('t' || event_id) OVER w AS baseline_tail, first_value(event_id % 90) OVER w AS baseline_count FROM ev WINDOW w AS (PARTITION BY user_id % 9, event_id // 50 ORDER BY at_ms, event_id)"""))
def capture_baseline(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr("event_id", "at_ms", "user_id % 9 as conversation", "event_id div 50 as capture", "concat('t', event_id) as tail", "event_id % 90 as message_count")
    return _drain(spark, rules.capture_baselines(rows))


@query("st10_failure_streak_stream", sql=with_ctes(EV, body="""
  SELECT run_id, first(event_id ORDER BY at_ms, event_id) AS stopped_at FROM (SELECT user_id AS run_id, event_id, at_ms, sum(e) OVER (PARTITION BY user_id ORDER BY at_ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s
    FROM (SELECT *, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS e FROM ev)) WHERE s = 3 GROUP BY run_id"""))
def failure_streak_stream(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).selectExpr("event_id", "at_ms", "user_id as run_id", "case when event_type = 'view' then 1 else 0 end as captured")
    return _drain(spark, rules.failure_stops(rows))


@query("st12_settled_turns", sql=with_ctes(EV, """
  k AS (SELECT event_id, 'x' || user_id % 80 AS turn_id, at_ms, event_type = 'view' AS progress FROM ev),
  g AS (SELECT *, sum(CASE WHEN progress THEN 0 ELSE 1 END) OVER (PARTITION BY turn_id ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM k)""".strip(), body="""
  SELECT max(event_id) FILTER (NOT progress) AS event_id, turn_id, count(*) FILTER (progress) AS withheld FROM g GROUP BY turn_id, coalesce(run, 0) HAVING count_if(NOT progress) > 0"""))
def settled_turns(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).withColumn("body", F.expr("case when event_type = 'view' then concat('Creating image ', event_id % 100, '%') else 'done' end"))
    rows = rows.select("event_id", "at", "at_ms", F.expr("concat('x', user_id % 80)").alias("turn_id"), identity.is_progress(F.col("body")).alias("progress"))
    return _drain(spark, rules.settled_turns(rows))


def _capture_table(spark, sf_dir):
    """Stored turns of a conversation as one nested capture message."""
    turns = model.messages(spark, sf_dir)
    uuid_of = F.expr("concat_ws('-', left(md5(conversation_id), 8), substr(md5(conversation_id), 9, 4), substr(md5(conversation_id), 13, 4), substr(md5(conversation_id), 17, 4), substr(md5(conversation_id), 21, 12))")
    grouped = turns.withColumn("slice", F.expr("turn div 20")).groupBy("conversation_id", "conv_no", "slice").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "body", "turn_id"))).alias("m"))
    rows = grouped.withColumn("pid", uuid_of).withColumn("cid", F.concat(F.lit("chatgpt:"), "pid"))
    page = F.concat(F.lit("https://chatgpt.com/c/"), F.when(F.col("conv_no") % 5 == 0, "other").otherwise(F.col("pid")))
    conversation = F.struct(
        F.col("cid").alias("id"), F.lit("chatgpt").alias("platform"), F.col("pid").alias("platform_id"), F.concat(F.lit("https://chatgpt.com/c/"), "pid").alias("url"),
        F.col("conversation_id").alias("title"))
    messages = F.transform("m", lambda x: F.struct(F.concat_ws(":", "cid", x["turn"].cast("string")).alias("id"), x["role"].alias("role"), x["body"].alias("body"), x["turn_id"].alias("turn_id"), F.lit(False).alias("progress")))
    return rows.select(
        F.lit("CAPTURE_MESSAGES").alias("type"), F.lit("chatgpt").alias("platform"), page.alias("page_url"),
        F.timestamp_millis(F.lit(START) + F.col("conv_no") * 1000).alias("at"), conversation.alias("conversation"), messages.alias("messages"),
        F.concat(F.lit("cap"), F.col("slice").cast("string")).alias("capture_id"), F.lit(True).alias("complete_page"))


def _capture_stream(spark, sf_dir):
    path = _folder(spark, "captures")
    _capture_table(spark, sf_dir).write.json(path)
    return capture.read_captures(spark, path)


@query("s02_capture_stream", sql=with_ctes(model.MSG, body="""
  SELECT title, count(*) AS messages, sum(length(body))::BIGINT AS chars FROM (SELECT conversation_id AS title, body FROM msg WHERE conv_no % 5 <> 0) GROUP BY title"""))
def capture_stream(spark, sf_dir):
    parts = capture.split_captures(_capture_stream(spark, sf_dir))
    rows = _drain(spark, parts["messages"].select("conversation_id", "id", "role", "body"))
    titles = _capture_table(spark, sf_dir).select(F.col("conversation.id").alias("conversation_id"), F.col("conversation.title").alias("title")).distinct()
    return rows.join(titles, "conversation_id").groupBy("title").agg(F.count("*").alias("messages"), F.sum(F.length("body").cast("bigint")).alias("chars"))


@query("st11_upsert_sink", sql=with_ctes(model.MSG, body="""
  SELECT count(*) AS messages, count(DISTINCT conversation_id) AS conversations, sum(length(body))::BIGINT AS chars FROM msg WHERE conv_no % 5 <> 0"""))
def upsert_sink(spark, sf_dir):
    parts = capture.split_captures(_capture_stream(spark, sf_dir))
    rows = parts["messages"].select("id", "conversation_id", "role", "body", "capture_index", "turn_id", F.unix_millis("at").alias("at_ms"))
    out = _folder(spark, "table")
    table, seen = sink.MessageTable(spark, out, 8), []

    def apply(batch, batch_id):
        table.apply(batch, batch_id, NOW)
        table.apply(batch, batch_id, NOW)  # a replay after a failure must change nothing
        seen.append(batch_id)

    rows.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read(max(seen)).agg(F.count("*").alias("messages"), F.count_distinct("conversation_id").alias("conversations"), F.sum(F.length("body").cast("bigint")).alias("chars"))


@query("s03_observation_stream", sql="""
  SELECT page_id AS tab_id, t AS title, greatest(page_id % 7 - 3, 0) AS message_count, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END AS n_links
  FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || html AS t FROM pages)""")
def observation_stream(spark, sf_dir):
    path = _folder(spark, "probes")
    url = F.expr("concat('https://claude.ai/chat/', left(md5(url), 8), '-', substr(md5(url), 9, 4), '-', substr(md5(url), 13, 4), '-', substr(md5(url), 17, 4), '-', substr(md5(url), 21, 12), '?x')")
    link = F.struct(F.when(F.col("page_id") % 2 == 0, url).otherwise(F.col("url")).alias("url"), F.lit("17").alias("updated_ms"), F.lit("x").alias("message_count"), F.col("page_id").cast("string").alias("copies"))
    model.load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("tab_id"), F.timestamp_millis(F.lit(START)).alias("at"), "url", F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "html").alias("title"),
        F.expr("cast(page_id % 7 - 3 as string)").alias("message_count"), F.array(link).alias("links")).write.json(path)
    rows = capture.clean_observations(spark.readStream.schema(capture.OBSERVATION_SCHEMA).json(path), "claude")
    return _drain(spark, rows).select("tab_id", "title", "message_count", "n_links")


@query("f04_health_rows", sql="""
  SELECT event_id, (event_id % 50)::BIGINT AS sidebar_count, (event_id % 3)::BIGINT AS message_count, event_id % 3 = 0 AS warn, 'see [url] now' AS diag, 2 AS hits FROM events WHERE event_type <> 'error'""")
def health_rows(spark, sf_dir):
    rows = model.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("platform"), "ts",
        F.create_map(
            F.lit("sidebarCount"), F.expr("cast(event_id % 50 as string)"), F.lit("messageCount"), F.expr("case when event_type = 'error' then 'n/a' else cast(event_id % 3 as string) end"),
            F.lit("warn"), F.expr("case when event_id % 3 = 0 then 'true' else 'false' end"), F.lit("diag"), F.lit("see https://a.b/c now"), F.lit("hit:a"), F.lit("3"), F.lit("hit:b"), F.lit("-2"), F.lit("selector"), F.lit("main")).alias("health"),
    ).withColumnRenamed("ts", "at")
    return capture.fit_health(rows).select(F.col("platform").alias("event_id"), "sidebar_count", "message_count", "warn", "diag", F.size("selector_hits").alias("hits"))


@query("a14_health_rollup", sql="""
  SELECT user_id % 4 AS platform, arg_max(event_id, event_id) AS latest, bool_or(event_type = 'error') AS any_warn, last(event_type = 'error' ORDER BY event_id) AS warn FROM events GROUP BY 1""")
def health_rollup(spark, sf_dir):
    rows = model.load(spark, sf_dir, "events").selectExpr("user_id % 4 as platform", "event_id", "event_type = 'error' as warn")
    return rows.groupBy("platform").agg(F.max_by("event_id", "event_id").alias("latest"), F.bool_or("warn").alias("any_warn"), F.max_by("warn", "event_id").alias("warn"))
