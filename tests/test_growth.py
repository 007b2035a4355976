"""Steps that once grew faster than their input, and inputs that only larger tables hold."""

import duckdb

from threadloom.plans import load_all
from threadloom.sources import capture
from threadloom.streaming import rules

QUERIES, ORACLES = load_all()


def test_visit_pairs_meet_by_minute(spark):
    """Pairs up to a minute apart across minute borders, and a join key that holds the minute."""
    seconds = [0, 1, 59, 60, 61, 119, 120, 180, 181, 3600]
    rows = spark.createDataFrame([(i, s, i % 2) for i, s in enumerate(s for s in seconds for _ in range(2))], "id INT, s INT, origin INT")
    homes = rows.selectExpr("id as home_id", "timestamp_seconds(s) as home_at", "1 as tab", "origin")
    visits = rows.selectExpr("id as visit_id", "timestamp_seconds(s) as visit_at", "1 as tab_v", "origin as origin_v")
    pairs = rules.visit_pairs(homes, visits)
    facts = [(r.id, r.s, r.origin) for r in rows.collect()]
    want = sorted((h, v) for h, hs, ho in facts for v, vs, vo in facts if ho == vo and 0 <= hs - vs <= 60)
    assert sorted((r.home_id, r.visit_id) for r in pairs.collect()) == want
    join = next(n for n in pairs._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in n)
    assert "minute" in join


def test_queue_holds_every_listed_link(spark, tmp_path):
    """Two pages with one address: the queries list every link, as their SQL does; the operator folds them unless told otherwise."""
    path = str(tmp_path)
    rows = [(i, f"http://a.b/{i % 96}", "<p>") for i in range(192)]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    whole = "SELECT id, url, stored_ms, stored_count, list_ms, list_count, skip, count(*) OVER (PARTITION BY platform, part, o, id) AS tie, pos FROM q"
    sql = ORACLES["j13_refresh_queue"]
    sql = sql[:sql.rindex("SELECT platform, pos")] + whole
    want = con.execute(sql).fetchall()
    assert len({r[0] for r in want}) < len(want)
    got = QUERIES["j13_refresh_queue"](spark, path).collect()
    named = "id url stored_ms stored_count list_ms list_count skip".split()
    assert sorted((tuple(r[n] for n in named) for r in got), key=repr) == sorted((r[:7] for r in want), key=repr)
    settled = {(r[0], r[8]) for r in want if r[7] == 1}
    assert settled <= {(r.id, r.pos) for r in got}


def test_equal_links_are_held_once(spark):
    """A link with a number of copies counts as that many; unsafe links and counts below one do not."""
    url = "https://claude.ai/chat/11111111-2222-3333-4444-555555555555"
    links = [(url, "17", "x", "1000000"), (url, None, None, None), ("http://evil.example/x", "1", "1", "5"), (url, "1", "1", "0")]
    rows = spark.createDataFrame([(1, None, url, "t", "2", links), (2, None, None, None, None, None)], capture.OBSERVATION_SCHEMA)
    got = {r.tab_id: r for r in capture.clean_observations(rows, "claude").collect()}
    assert (got[1].n_links, len(got[1].links)) == (1000001, 2)
    assert (got[2].n_links, len(got[2].links)) == (0, 0)


def test_baselines_share_slots_of_state(spark, tmp_path):
    """Later micro-batches keep the first one's baseline, nulls too, and state has no more rows than slots."""
    schema = "event_id BIGINT, at_ms BIGINT, conversation BIGINT, capture BIGINT, tail STRING, message_count BIGINT"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(2):
        rows = [(part * 1000 + i, 5000 - part * 1000 - i, i % 3, i // 5, f"t{part}-{i}", None if i % 4 == 0 else i) for i in range(200)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = rules.capture_baselines(stream, 7).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress.stateOperators[0].numRowsTotal <= 7
    first = {}
    for i in range(200):
        first[i % 3, i // 5] = (f"t0-{i}", None if i % 4 == 0 else i)
    want = sorted((part * 1000 + i, *first[i % 3, i // 5]) for part in range(2) for i in range(200))
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/rows").select("event_id", "baseline_tail", "baseline_count").collect()) == want


def test_postings_leave_in_parts():
    """One Arrow batch of many texts comes out as several, each little more than the limit, with nothing lost."""
    import pyarrow as pa

    from threadloom.functions import text as tx

    texts = [" ".join(f"w{i % 50}x{j}" for j in range(3000)) for i in range(100)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(102)], "text": texts})
    out = list(tx.posting_rows(["id"])([batch]))
    sizes = [len(b.column("positions").flatten()) for b in out]
    assert max(sizes) <= tx.PLACES_AT_ONCE + 9000 and len(out) > 1
    want = sorted((t, str(i), p) for i, text in enumerate(texts) for t, p in tx._grouped(tx.fold(text)))
    assert sorted((r["token"], r["id"], r["positions"]) for b in out for r in b.to_pylist()) == want


def test_aligned_phrases_are_found_without_a_row_for_every_place(spark):
    """A token that stands twice in the query counts at both starts; far tokens do not; places stay in their arrays."""
    from threadloom.operators import search

    postings = spark.createDataFrame(
        [("ab", "c", "s1", "user", [0, 10, 40]), ("cd", "c", "s1", "user", [13, 43]), ("ab", "c", "s2", "user", [0, 7]), ("cd", "c", "s2", "user", [4]),
         ("ab", "c", "s3", "user", [0]), ("ab", "c", "title", "title", [0, 6]), ("cd", "c", "title", "title", [3])],
        "token STRING, conversation_id STRING, source STRING, role STRING, positions ARRAY<INT>")
    spans = spark.createDataFrame([(1, 0, "ab", 0, 2), (1, 0, "cd", 3, 2), (2, 0, "ab", 0, 2), (2, 0, "ab", 30, 2)], "query_id INT, clause_no INT, token STRING, start INT, n_spans INT")
    found = search.aligned_phrases(postings, spans)
    assert sorted((r.query_id, r.source) for r in found.collect()) == [(1, "s1"), (2, "s1")]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_literals_are_searched_before_their_edges_are_tested(spark):
    """Patterns begin with their literal; the matches are those of the tests of both edges in any order."""
    import re

    from pyspark.sql import functions as F

    from threadloom.functions import ranges

    texts = ["erth 12erth xerth erth9 erth", "12" * 30 + "erth " + "7" * 48 + "erth a" + "7" * 3 + "erth", "thble xthble th9ble thxble7 th ble", "12 112 12a", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    old = {
        ranges.token_pattern("erth"): lambda t: [m.span() for m in re.finditer("erth(?![a-z0-9])", t) if re.search(r"(?<![a-z0-9])[0-9]{0,48}\Z", t[:m.start()])],
        ranges.token_pattern("12"): lambda t: [m.span() for m in re.finditer("(?<![0-9])12(?![0-9])", t)],
        ranges.word_pattern("erth"): lambda t: [m.span() for m in re.finditer("(?<![a-z0-9])erth(?![a-z0-9])", t)],
        ranges.glob_pattern("th*ble"): lambda t: [m.span() for m in re.finditer("(?<![a-z0-9])th[a-z0-9]*ble(?![a-z0-9])", t)],
        ranges.glob_pattern("*ble"): lambda t: [m.span() for m in re.finditer("(?<![a-z0-9])[a-z0-9]*ble(?![a-z0-9])", t)],
    }
    for pattern, want in old.items():
        assert not pattern.startswith("(?<") or pattern.startswith("(?<![a-z0-9])[a-z0-9]*"), pattern
        got = {r.t: [(x["start"], x["end"]) for x in r.r] for r in rows.select("t", ranges.find_ranges(F.col("t"), pattern).alias("r")).collect()}
        assert got == {t: want(t) for t in texts}, pattern


def test_many_ranges_of_a_long_text_lead_back_at_once(spark):
    """30,000 wide letters and 3,000 links in one text: clusters and runs are searched, not read once for every range."""
    import time

    from pyspark.sql import functions as F

    from threadloom.functions import offsets, ranges

    body = "ｔｈｉｎ *of* [that](http://a.b/thin) é xx " * 3000
    rows = spark.createDataFrame([(body,), (None,), ("plain",)], "b STRING")
    finds = {"wide": lambda n: ranges.find_ranges(n, "thin"), "linked": lambda n: ranges.find_ranges(n, "of that")}
    began = time.time()
    got = {r.b: r for r in offsets.with_stored_ranges(rows, F.col("b"), finds).collect()}
    assert time.time() - began < 60
    cut = lambda k: {body[x["start"]:x["end"]] for x in got[body][k]}
    assert (cut("wide"), cut("linked")) == ({"ｔｈｉｎ"}, {"of* [that"})
    assert (len(got[body].wide), len(got[body].linked)) == (3000, 3000)
    assert got[None].wide == [] and got["plain"].linked == []


def test_clause_search_reads_texts_once(spark):
    """Titles, postings and matching turns are written before they are read several times: no text is left in the plan."""
    from threadloom.operators import index, search

    clauses = search.clauses_of(13, "tion erth -title:the") + search.clauses_of(15, '"of that" th*ble -and')
    turns = spark.createDataFrame([("c:0", "c", "user", "tion and erth of that thimble"), ("d:0", "d", "assistant", "erth tion of that thable")], "id STRING, conversation_id STRING, role STRING, body STRING")
    heads = spark.createDataFrame([("c", "one"), ("d", "two")], "id STRING, title STRING")
    found = search.search_clauses(heads, turns, index.build_postings(heads, turns, ["tion", "erth", "and"]), clauses)
    assert sorted((r.query_id, r.conversation_id) for r in found.collect()) == [(13, "c"), (13, "d"), (15, "d")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_rekeyed_turns_make_their_stamps_once(spark):
    """Stamps of whole bodies are written with thin rows; the plan that reads them many times has none left to make."""
    from threadloom.operators import align

    kind = "conversation_id STRING, idx BIGINT, id STRING, role STRING, body STRING, turn_id STRING"
    stored = spark.createDataFrame([("c", 0, "s0", "user", "alpha", None), ("c", 1, "s1", "assistant", "beta " * 8, "t1"), ("c", 2, "s2", "user", "beta", None)], kind)
    page = spark.createDataFrame([("c", 0, "p0", "user", "alpha", None), ("c", 1, "p1", "assistant", "beta " * 9, "t1"), ("c", 2, "p2", "user", "gamma", None)], kind)
    found = align.rekeyed_turns(stored, page)
    assert sorted(tuple(r) for r in found.collect()) == [("c", "p0", "s0"), ("c", "p1", "s1")]
    assert "md5(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_flat_steps_run_only_on_marks():
    """A text without ``FLAT_MARKS`` has nothing that one of the steps could change."""
    import itertools
    import re

    from threadloom.functions import markup

    for parts in itertools.product(["", " ", "a"], ["`", "```", "|", "#", "##", "-", "--", "---", "|-|", ":---|", "**", "***", "__", "___", "a"], ["", " ", "|"]):
        text = "".join(parts)
        if not re.search(markup.FLAT_MARKS, text):
            assert not any(re.search(pattern, text) for pattern, _ in markup.FLAT_STEPS), text
