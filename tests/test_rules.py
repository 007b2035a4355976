"""Rules checked against brute force or plain values on small fixtures."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from threadloom.functions import links, ranges, times
from threadloom.functions import text as tx
from threadloom.operators import align, clock, identity, images, index, ordered, search, sorting
from threadloom.plans import load_all, stream_plans
from threadloom.sources import model
from threadloom.streaming import rules

SF = "/root/testdata/sf0.001"
NOW = model.NOW_MS


def col(spark, value, make):
    return spark.createDataFrame([(value,)], "v STRING").select(make(F.col("v")).alias("o")).first()["o"]


# --- queries ------------------------------------------------------------------------


@pytest.mark.parametrize("raw", ['"open phrase', '""', "*", "--a", '"a"b', "-only", "plain words", "x" * 5000, "a" * 200 + "*"])
def test_malformed_or_plain_queries_have_no_clauses(raw):
    assert search.clauses_of(1, raw, max_chars=4096, max_clauses=32, max_glob=128) == []


def test_clauses_have_no_limits_unless_asked_for():
    assert [c.kind for c in search.clauses_of(1, "a" * 200 + "*")] == ["glob"]
    assert len(search.clauses_of(1, " ".join(f'"phrase {i}"' for i in range(900)))) == 900


def test_clauses():
    found = search.clauses_of(7, 'blue the orchid -title:draft "exact words" chat*')
    assert [(c.kind, c.value, c.title_only, c.exclude) for c in found] == [
        ("words", "blue the orchid", False, False), ("words", "draft", True, True), ("phrase", "exact words", False, False), ("glob", "chat*", False, False)]
    assert found[0].tokens == ["blue", "orchid"]


@pytest.mark.parametrize("word,glob,want", [
    ("chatting", "chat*", True), ("chat", "chat*", True), ("xchat", "chat*", False), ("abc", "a*c", True), ("ac", "a*c", True), ("aba", "ab*ba", False), ("a_c", "a*c", False), ("x100y", "*100*", True)])
def test_glob(spark, word, glob, want):
    clause = search.clauses_of(1, glob)[0]
    assert col(spark, word, lambda v: search.text_test(v, clause)) is want
    assert (col(spark, word, lambda v: F.size(ranges.find_ranges(v, ranges.glob_pattern(glob)))) > 0) is want


def test_whole_words_never_act_as_a_pattern(spark):
    assert col(spark, "a starship", lambda v: tx.contains_whole(v, F.lit("star"))) is False
    assert col(spark, "a star ship", lambda v: tx.contains_whole(v, F.lit("star"))) is True
    assert col(spark, "cost 1+1 (x)", lambda v: tx.contains_whole(v, F.lit("1+1"))) is True
    assert col(spark, "在咖啡馆里", lambda v: tx.contains_whole(v, F.lit("咖啡"))) is True


def test_tokens(spark):
    text = "Abc １２３ x y2z 咖啡馆 99"
    norm = col(spark, text, tx.normalise)
    assert norm == unicodedata.normalize("NFKC", text.lower())
    got = set(col(spark, text, lambda v: tx.distinct_tokens(tx.normalise(v))))
    assert got == {"abc", "123", "y2z", "咖", "啡", "馆", "咖啡", "啡馆", "99"}
    spans = {(s.token, s.start) for s in col(spark, text, tx.token_spans)}
    assert {t for t, _ in spans} == got and all(norm[s : s + len(t)] == t for t, s in spans)


def test_stable_characters_do_not_change_under_nfkc(spark):
    import re

    risky = re.compile(f"[^\x00-\x7f{tx.NFKC_STABLE}]")
    chars = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not risky.match(chr(c))]
    assert len(chars) > 20000
    assert all(unicodedata.normalize("NFKC", c) == c for c in chars)


def test_index_prefilter_changes_nothing(spark):
    turns = model.document_messages(spark, SF)
    postings = index.build_postings(model.headers(turns), turns)
    clauses = search.clauses_of(1, '"of that" th*ble')
    rows = lambda p: {tuple(r) for r in search.body_matches(turns, clauses, p).collect()}
    assert rows(None) == rows(postings) != set()


def test_weights_keep_the_order_of_kinds():
    assert search.TITLE > search.PHRASE + search.USER * search.HIT_CAP
    assert search.PHRASE > search.USER * search.HIT_CAP
    assert search.USER > search.ASSISTANT * search.HIT_CAP


def test_ranking(spark):
    heads = spark.createDataFrame([("t", "blue orchid"), ("p", "x"), ("s", "y"), ("u", "z")], "id STRING, title STRING")
    msgs = spark.createDataFrame(
        [("p", "p1", "user", "a blue orchid here"), ("s", "s1", "user", "orchid then blue"), ("u", "u1", "assistant", "blue"), ("u", "u2", "assistant", "orchid")],
        "conversation_id STRING, id STRING, role STRING, body STRING")
    got = {r.conversation_id: r.relevance for r in search.search_plain(heads, index.build_postings(heads, msgs), search.Queries({1: "blue orchid"}).plain).collect()}
    assert got == {"t": 11000.0, "p": 1100.0, "s": 100.0, "u": 10.0}


def test_title_sort_is_numeric(spark):
    rows = spark.createDataFrame([("a", "Chat 10"), ("b", "chat 9"), ("c", "Éclair")], "id STRING, title STRING").withColumn("platform_id", F.lit("p"))
    assert [r.id for r in rows.orderBy(*sorting.order_columns("title", "asc", NOW)).collect()] == ["b", "a", "c"]


# --- ordered groups -----------------------------------------------------------------


def test_running_values_across_chunks(spark):
    rng = random.Random(3)
    data = [("g", i, rng.choice([None, rng.randint(0, 99)])) for i in range(200)] + [("h", i, i) for i in range(7)]
    rows = spark.createDataFrame(data, "g STRING, i BIGINT, v INT")
    got = ordered.running(
        rows, ["g"], ["i"], ordered.chunk_of("i", 16), before=("near", F.col("v"), "before"), after=("near", F.col("v"), "after"),
        top=("max", F.col("v"), "after"), total=("sum", F.coalesce("v", F.lit(0)), "before")).collect()
    by = {}
    for g, i, v in data:
        by.setdefault(g, []).append(v)
    for r in got:
        seen, rest = by[r.g][: r.i], by[r.g][r.i + 1 :]
        known = lambda vs: [v for v in vs if v is not None]
        assert r.before == (known(seen)[-1] if known(seen) else None)
        assert r.after == (known(rest)[0] if known(rest) else None)
        assert r.top == (max(known(rest)) if known(rest) else None)
        assert r.total == sum(known(seen))


def test_clock_does_not_depend_on_order(spark):
    rng = random.Random(5)
    base = [("c", 1700000000000 + rng.randint(0, 9) * 1000, rng.choice(["page-exact", "observed", "page-bucket", "other"]), i) for i in range(30)]
    once = clock.merged_clocks(spark.createDataFrame(base, "conversation_id STRING, ms BIGINT, source STRING, arrival INT"), NOW).first()
    rng.shuffle(base)
    again = clock.merged_clocks(spark.createDataFrame(base, "conversation_id STRING, ms BIGINT, source STRING, arrival INT"), NOW).first()
    assert once == again


def test_stamps_that_repeat_often_are_counted_without_pairs(spark, monkeypatch):
    rows = [("c", i, f"s{i}", "user", "ok" if i % 3 else f"text {i}", None) for i in range(40)]
    page = [("c", i - 7, f"p{i}", r[3], r[4], None) for i, r in enumerate(rows) if i >= 7]
    shape = "conversation_id STRING, idx BIGINT, id STRING, role STRING, body STRING, turn_id STRING"
    s, p = spark.createDataFrame(rows, shape), spark.createDataFrame(page, shape)
    want = {(f"p{i}", f"s{i}") for i in range(7, 40)}
    assert {(r.page_id, r.stored_id) for r in align.rekeyed_turns(s, p).collect()} == want
    monkeypatch.setattr(align, "HOT_PAIRS", 10)
    monkeypatch.setattr(align, "BLOCK", 8)
    assert {(r.page_id, r.stored_id) for r in align.rekeyed_turns(s, p).collect()} == want


def test_send_chunks(spark):
    sizes = [100] * 25 + [200000, 200000, 100]
    rows = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate(sizes)], "conversation_id STRING, idx BIGINT, body STRING")
    got = [r.chunk for r in align.send_chunks(rows).orderBy("idx").collect()]
    assert got == [0] * 20 + [1] * 6 + [2] * 2


def test_moved_images_never_share_a_slot(spark):
    rows = load_all()[0]["w08_free_slots"](spark, SF).collect()
    assert rows and len({(r.keep_id, r.new_idx) for r in rows}) == len(rows)


def test_moved_images_follow_the_sequential_rule(spark):
    rng = random.Random(9)
    have = {(f"m{m:02}", i) for m in range(12) for i in rng.sample(range(6), rng.randint(0, 4))}
    folds = [(f"m{m:02}", f"m{m - m % 4 + 3:02}") for m in range(12) if m % 4 != 3]
    want = set()
    for keep in {k for _, k in folds}:
        taken, following = {i for m, i in have if m == keep}, 0
        for drop, idx in sorted((m, i) for m, i in have if (m, keep) in folds):
            slot = idx
            if idx in taken:
                while following in taken:
                    following += 1
                slot, following = following, following + 1
            taken.add(slot)
            want.add((drop, keep, idx, slot))
    moves = images.move_images(spark.createDataFrame(sorted(have), "message_id string, idx int"), spark.createDataFrame(folds, "drop_id string, keep_id string"))
    assert {tuple(r) for r in moves.select("message_id", "keep_id", "idx", "new_idx").collect()} == want
    blobs = spark.createDataFrame([(m, i, bytes([i])) for m, i in sorted(have)], "message_id string, idx int, blob binary")
    assert images.move_blobs(blobs, moves).count() == len(have)


def test_progress_and_noise(spark):
    yes = ["Creating image 25%", "• Sketching 38%", "正在生成图片…", "Adding details"]
    no = ["Sketching", "I was creating image lists", "", "50%"]
    assert [col(spark, t, identity.is_progress) for t in yes] == [True] * 4
    assert [col(spark, t, identity.is_progress) for t in no] == [False] * 4
    assert [col(spark, t, identity.is_substantive) for t in ["Copy", "You said:", "**ChatGPT**", "Hello"]] == [False, False, False, True]


def test_addresses(spark):
    uuid = "0a1b2c3d-0000-1111-2222-333344445555"
    assert col(spark, f"https://chatgpt.com/g/{uuid[:-1]}9/c/{uuid.upper()}?x", links.conversation_id) == f"chatgpt:{uuid}"
    assert col(spark, "http://chatgpt.com/c/" + uuid, links.conversation_id) is None
    assert col(spark, "https://gemini.google.com/u/3/app/abcdef012345/", links.conversation_id) == "gemini:abcdef012345"
    assert col(spark, "https://a:b@claude.ai/chat/" + uuid, links.safe_url) == ""


@pytest.mark.parametrize("label,ok", [("Step 1", False), ("Chapter 3", False), ("Sep 12, 2025", True), ("3 hours ago", True), ("昨天", True), ("", False)])
def test_time_labels(spark, label, ok):
    assert (col(spark, label, lambda v: times.page_time(v, NOW)) is not None) is ok


# --- streams equal their sequential rule ----------------------------------------------


def _sequential(rows, key, step):
    held, out = {}, []
    for row in sorted(rows, key=lambda r: (r.at_ms, r.event_id)):
        held[row[key]], made = step(held.get(row[key]), row)
        if made is not None:
            out.append(made)
    return sorted(out)


@pytest.mark.parametrize("name,key,step,columns", [
    ("st01_duplicate_gate", "body_hash", rules._duplicate_step, ["user_id % 40 as body_hash", "user_id % 3 as conversation"]),
    ("st05_heartbeat_throttle", "platform", rules._heartbeat_step, ["user_id % 4 as platform", "cast(event_id div 300 as string) as fingerprint"]),
    ("st07_evidence_run", "tab", rules._evidence_step, [
        "user_id % 3 as tab", "event_id div 60 as conversation", "concat('u', event_id div 60) as url", "case when event_type = 'error' then 1 else 2 end as hits", "event_id % 37 = 0 as blocked"]),
])
def test_stream_equals_sequential(spark, name, key, step, columns):
    rows = model.load(spark, SF, "events").selectExpr("event_id", f"{stream_plans.START} + event_id * 700 - user_id % 5 * 300 as at_ms", *columns).collect()
    got = sorted(tuple(r) for r in load_all()[0][name](spark, SF).collect())
    assert got == _sequential(rows, key, step)


def test_many_micro_batches_equal_one(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = model.load(spark, SF, "events").selectExpr("event_id", "event_id * 700 as at_ms", "user_id % 9 as conversation", "event_id div 50 as capture", "concat('t', event_id) as tail", "event_id % 90 as message_count")
    for part in range(3):
        rows.where(f"event_id div 400 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = stream_plans._drain(spark, rules.capture_baselines(stream)).count()
    assert got == rows.where("event_id < 1200").count()


def test_visible_text_keeps_code_and_drops_marks(spark):
    from threadloom.functions import markup

    cases = {
        "use `__init__` and `a*b*c`": "use __init__ and a*b*c",
        "see:\n```py\n# setup\ndef __init__(self):\n- item\n```\nafter **that**": "see:\n# setup\ndef __init__(self):\n- item\n\nafter that",
        "~~~\n*raw*\n~~~": "*raw*",
        "foo__bar__baz and a_b_c [x]": "foo__bar__baz and a_b_c [x]",
        "_one_ and __two words__ [x]": "one and two words [x]",
        "[a](http://x/(b)c) end": "a end",
        "\\*not\\* emphasis, *this* is": "*not* emphasis, this is",
        "`` a ` b `` c": "a ` b c",
        "# Title\n> quoted\n- item https://x.y/z more": "Title\nquoted\nitem more",
        "| a | b |\n|---|---|\n| c | d |": "a b\nc d",
        "open `code": "open `code",
        "plain prose": "plain prose",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "body string")
    got = {r.body: r.v for r in rows.select("body", markup.visible_text("body").alias("v")).collect()}
    assert got == cases


def test_search_lists_everything_for_an_empty_query_and_reads_no_bodies_for_titles(spark):
    from threadloom.operators import index, search
    from threadloom.sources import model

    turns = model.document_messages(spark, "/root/testdata/sf0.001")
    heads = model.headers(turns)
    postings = index.build_postings(heads, turns)
    assert search.search(heads, turns, postings, {}).count() == 0
    assert search.search(heads, turns, postings, {7: "  "}).where("relevance = 0 and query_id = 7").count() == heads.count()
    nowhere = turns.withColumn("body", F.expr("raise_error('bodies were read')").cast("string"))
    assert search.search(heads, nowhere, postings, {1: "title:the"}).count() == search.search(heads, turns, postings, {1: "title:the"}).count()
