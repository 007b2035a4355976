"""Tables of saved queries against the search that takes its queries as literals."""

from __future__ import annotations

import random

from threadloom.operators import index, search, stored

WORDS = ["chat", "chatseek", "blue", "orchid", "camera", "draft", "star", "starship", "the", "相機", "舊相機", "哈", "a", "ab12", "#x", "c++", "1999", "ﬂower", "it's"]


def library(spark, rng):
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    heads = [(f"c{i}", "chatgpt", pick(rng.randint(0, 3)), False) for i in range(40)]
    turns = [(f"c{i}:{k}", f"c{i}", rng.choice(["user", "assistant"]), rng.choice(["", "**", "# "]) + pick(rng.randint(0, 9)) + rng.choice(["", "**", " `chat`", " [camera](http://a.b/star)"])) for i in range(40) for k in range(3)]
    turns.append(("c0:9", "c0", "user", None))
    headers = spark.createDataFrame(heads, "id string, platform string, title string, archived boolean")
    return headers, spark.createDataFrame(turns, "id string, conversation_id string, role string, body string")


def test_a_table_of_queries_finds_what_literal_queries_find(spark):
    rng = random.Random(11)
    headers, messages = library(spark, rng)
    postings = index.build_postings(headers, messages).cache()
    forms = ['"{0} {1}"', "{0} -{1}", "title:{0} -\"{1}\"", "{0}*", "*{0}", "*{0}* -title:{1}", "{0} {1}", "title:\"{0}\" {1}", "{0}*{1}", "-{0} {1} \"{2}\"", "title:*{0}* -*{1}", "{0}", '"{0}" -{1}*']
    saved = {i: rng.choice(forms).format(*(rng.choice(WORDS) for _ in range(3))) for i in range(60)}
    saved |= {100: '"#"', 101: '"++" -blue', 102: "-draft", 103: '"', 104: "title:the", 105: "a*a -zz", 106: '"e o"', 107: "zzz*", 108: "*"}
    want = {(r.query_id, r.conversation_id) for r in search.search(headers, messages, postings, saved).select("query_id", "conversation_id").collect()}
    table = spark.createDataFrame([*saved.items(), (200, None), (201, "  ")], "query_id long, raw string")
    got = [tuple(r) for r in stored.matches(headers, messages, postings, table).collect()]
    assert len(got) == len(set(got)) and len(want) > 100
    assert {(q, saved[q]) for q, _ in set(got) ^ want} == set() and set(got) == want
    assert stored.matches(headers.limit(0), messages.limit(0), postings.limit(0), table).count() == 0
    assert stored.matches(headers, messages, postings, table.limit(0)).count() == 0


def test_clauses_of_a_table_are_those_of_the_driver(spark):
    raws = ['title:"old camera" chat* -draft -"red orchid" -title:archive', "", "orchid", '"unclosed', 'orchid "unclosed', "-", "*", "***", "title:", "-title:", 'title:""', '-""', "-draft", '-"blue orchid"', '"blue"orchid', "chat* title:", "--draft", 'title:foo"bar', "a  -b\tc", "TITLE:x y", " the orchid -draft ", "相*機 -哈", "ﬁne* -ＡＢ"]
    got = {}
    for r in stored.stored_clauses(spark.createDataFrame(list(enumerate(raws)), "query_id long, raw string")).collect():
        got.setdefault(r.query_id, []).append((r.clause_no, r.kind, r.value, r.title_only, r.exclude, sorted(r.tokens)))
    for i, raw in enumerate(raws):
        queries = search.Queries({i: raw})
        want = [(c.clause_no, c.kind, c.folded, c.title_only, c.exclude, sorted(c.tokens)) for c in queries.clauses or queries.plain if c.value]
        assert sorted(got.get(i, [])) == sorted(want), raw


def test_texts_are_neither_moved_nor_read_for_every_clause(spark, monkeypatch):
    """Clauses meet the grams of a text where it stands; parts of the clause table, and texts without an index, give the same rows."""
    rng = random.Random(12)
    headers, messages = library(spark, rng)
    messages = messages.unionByName(spark.createDataFrame([("c1:9", "c1", "user", "a々b 々 c++\n\tx, naïve\u2028end It’s C™ 相a2機")], messages.schema))
    forms = ['" {0}"', '"{0} "', '"{0}" -" {1} "', "{0}*{1}*{2}", "*{0}*{1}", "title:*{0}", '"{0} {1} {2}"', '"{0}"', "title:{0} -{1}*", "-*{0} {1}"]
    saved = {i: rng.choice(forms).format(*(rng.choice(WORDS) for _ in range(3))) for i in range(80)}
    saved |= {100: '"々"', 101: '"々b"', 102: '"+\n\tx"', 103: '"x, na"', 104: '"e e"', 105: "c+* blue", 106: "*m*", 107: '"a2機"', 108: '"相a"', 109: "々* a", 110: "t*", 111: "*ve", 112: '"e\u2028e"', 113: '"t’s c"'}
    want = {(r.query_id, r.conversation_id) for r in search.search(headers, messages, index.build_postings(headers, messages), saved).select("query_id", "conversation_id").collect()}
    table = spark.createDataFrame(list(saved.items()), "query_id long, raw string")
    found = lambda: [tuple(r) for r in stored.matches(headers, messages, None, table).collect()]
    got = found()
    assert len(got) == len(set(got)) and {(q, saved[q], c) for q, c in set(got) ^ want} == set()
    held = stored.held_in_texts(stored.texts_of(headers, messages).localCheckpoint(), stored.stored_clauses(table))
    plan = held._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastHashJoin") == 1 and "SortMerge" not in plan
    monkeypatch.setattr(stored, "CLAUSES_AT_ONCE", 40)
    assert sorted(found()) == sorted(got)
