"""Ranges on stored text: marks, links, code, and characters that NFKC changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadloom.functions import markup, offsets, ranges
from threadloom.functions import text as tx
from threadloom.operators.search import clauses_of

BODIES = [
    "plain text", "", "Walk to **blue** orchid with `chatseek`; [blue orchid](https://example.com/hidden).", "# Head one\n\n> quoted *deep* text\n\n- item __two__ words\n2. item _three_",
    "```js\nlet chat = 1;\n```\nafter chat", "a \\* b \\# chat", "| blue | orchid |\n| --- | --- |\n| x | y |\n", "  \n *lead* and tail \n ", "see <https://a.b/chat> and http://chat.example/x end", "`` a`chat `` and ***both***",
    "~~~\nchat *kept* `raw`\n", "![alt chat](http://a/b(c).png) chat", "snake_case_word and _it_ [l_i_n](u)", "\n\n\n# chat\n\n\n\nchat", "*a* `b` **c** `d` \\_ [e](f) chat", "**", "[]()", "xy *z*",
]


def test_the_traced_text_is_the_visible_text(spark):
    frame = spark.createDataFrame([(b,) for b in BODIES], "body string")
    for r in offsets.with_trace(frame, F.col("body"), "t").select("body", F.col("t.text").alias("traced"), markup.visible_text("body").alias("shown")).collect():
        assert r.traced == r.shown, r.body


def test_every_visible_character_leads_to_its_own_in_the_body(spark):
    frame = spark.createDataFrame([(b,) for b in BODIES], "body string")
    traced = offsets.with_trace(frame, F.col("body"), "t")
    places = traced.select("body", "t.text", F.when(F.length("t.text") > 0, F.transform(F.sequence(F.lit(0), F.length("t.text") - 1), lambda p: offsets.stored_place(p, F.col("t.maps")))).alias("places"))
    for r in places.collect():
        body = r.body.replace("", " ") if any(x in r.body for x in "*_`#|[]>") else r.body
        known = [(c, p) for c, p in zip(r.text, r.places or []) if p >= 0]
        assert all(body[p] == c for c, p in known), r.body
        assert [p for _, p in known] == sorted({p for _, p in known}), r.body
        assert all(c.isspace() for c, p in zip(r.text, r.places or []) if p < 0), r.body


CASES = {
    'chat* "blue orchid" "blue flower" -draft': [
        ("ＣＨＡＴＳＥＥＫ blue ﬂower", ["ＣＨＡＴＳＥＥＫ", "blue ﬂower"]), ("Blue orchid, blue  orchid", ["Blue orchid"]), ("Chat chatseek chatter achat", ["Chat", "chatseek", "chatter"]),
        ("draft camera chatting", ["chatting"]), ("Walk to **blue** orchid with `chatseek`; [blue orchid](https://example.com/hidden).", ["blue** orchid", "chatseek", "blue orchid"]),
        ("```\nchat code\n``` and *blue*", ["chat"]), ("| blue | orchid |", ["blue | orchid"]), ("", []), (None, []),
    ],
    '"가" "ΟΣ" "hidden" "example.com" *相機 相*機 title:chat': [
        ("가", ["가"]), ("ΟΣ", ["ΟΣ"]), ("舊相機 新相機", ["舊相機", "新相機"]), ("舊相機新相機", ["舊相機新相機"]), ("see [x](https://example.com/hidden) chat", []), ("`https://example.com/hello` x", []),
    ],
    '12 哈哈 *hat "flower of fine" -zz': [
        ("ﬁrst **ﬂower** of [ﬁne](u) oﬃce", ["ﬂower** of [ﬁne"]), ("１２ abc123 x12 12 #", ["１２", "12", "12"]), ("哈哈哈 *哈哈*", ["哈哈哈", "哈哈"]), ("hat chatseek chat", ["hat", "chat"]),
    ],
}


@pytest.mark.parametrize("query", CASES)
def test_ranges_cut_the_matched_text_out_of_the_body(spark, query):
    frame = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(CASES[query])], "shown int, body string")
    out = offsets.with_stored_ranges(frame, F.col("body"), lambda norm: ranges.query_ranges(norm, clauses_of(1, query)))
    assert out.columns == ["shown", "body", "ranges"]
    for r in out.collect():
        assert [r.body[x.start : x.end] for x in r.ranges] == CASES[query][r.shown][1]


def test_titles_are_painted_by_title_clauses(spark):
    frame = spark.createDataFrame([("the ｏｌｄ camera",)], "title string")
    out = offsets.with_stored_ranges(frame, F.col("title"), lambda norm: ranges.query_ranges(norm, clauses_of(1, 'title:"old camera"'), "title"), marked=False)
    assert [tuple(r) for r in out.first().ranges] == [(4, 14)]


def test_token_ranges_equal_the_tokeniser(spark):
    texts = ["ab1 1ab a1b2 12ab ab12ab " + "x" * 60 + " abab " + "9" * 30, "x" * 48 + "ab", "x" * 49 + "ab 1234567", "哈哈哈哈ab中文中文 12", "ab_ab-ab.ab 012 12a 1 2 12", "9" * 24 + "12"]
    tokens = ["ab", "12", "a1b2", "x" * 48, "x" * 12, "哈哈", "中文", "文", "9" * 24, "9" * 6]
    frame = tx.with_normalised(spark.createDataFrame([(t,) for t in texts], "t string"), "norm", F.col("t"))
    found = frame.select("t", *(ranges.token_ranges(F.col("norm"), [t]).alias(f"r{i}") for i, t in enumerate(tokens))).collect()
    for i, token in enumerate(tokens):
        for r in found:
            want = []
            for t, s in sorted((t, s) for t, s in tx._spans_of(tx.fold(r.t)) if t == token):
                if want and s <= want[-1][1]:
                    want[-1][1] = max(want[-1][1], s + len(t))
                else:
                    want.append([s, s + len(t)])
            assert [[x.start, x.end] for x in r[f"r{i}"]] == want, (token, r.t)


def test_folded_blanks_of_plain_text_lead_back(spark):
    bodies = [*BODIES, "of  that", " \t of \t that  \n\n  of that ", "plain  text  é ﬁ  of   that", "of\tthat"]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    traced = offsets.with_trace(frame, F.col("body"), "t", folded=True)
    for r in traced.select("body", "t.text", markup.visible_text("body", folded=True).alias("shown")).collect():
        assert r.text == r.shown, r.body
    finds = {"apart": lambda norm: ranges.find_ranges(norm, "of that")}
    out = offsets.with_stored_ranges(frame, F.col("body"), finds, folded=True)
    got = {r.body: [r.body[x.start : x.end] for x in r.apart] for r in out.collect()}
    want = {"of  that": ["of  that"], " \t of \t that  \n\n  of that ": ["of \t that", "of that"], "plain  text  é ﬁ  of   that": ["of   that"]}
    assert got == {b: want.get(b, []) for b in bodies}


def test_stored_ranges_equal_their_sql_on_plain_and_touching_text(spark, tmp_path):
    """Blanks left by dropped marks in a body without other marks; matches that touch, beside wide letters or not."""
    import duckdb
    from oracle import compare

    from threadloom.plans import load_all

    texts = ["Of | thattheaingor ens", "h | thinha of  that", "of # that erth", "of thatof that x", "of  thatof that x thin é", "erth of that of thatOF THAT", "a thin b 12thin xthin", "of\tthat", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    queries, oracles = load_all()
    n, problem = compare(spark, con, str(tmp_path), queries["p07_stored_ranges"], oracles["p07_stored_ranges"])
    assert problem is None and n == 15
