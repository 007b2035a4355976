"""Times in embedded JSON against written-out values."""

from __future__ import annotations

import json

from threadloom.sources import embedded

NOW = 1735689600000
A, B, C = (f"0a1b2c3d-0000-1111-2222-33334444555{i}" for i in "abc")


def found(spark, *texts):
    frame = spark.createDataFrame([(t if t is None or isinstance(t, str) else json.dumps(t),) for t in texts], "json string")
    return {r.id: r.ms for r in embedded.embedded_times(frame, NOW).collect()}


def deep(n, inner):
    for _ in range(n):
        inner = {"a": inner}
    return inner


def test_keys_types_and_newest(spark):
    assert found(spark, {"id": A, "update_time": 1700000000000}, [{"x": [{"chatId": f"/c/{A.upper()}?q", "createdAt": 1710000000.5}]}]) == {A: 1710000000500}
    assert found(spark, {"id": "", "uuid": B, "update_time": None, "modifyTime": "1700000000", "created_at": 1720000000}) == {B: 1700000000000}
    assert found(spark, {"id": B, "updated_at": "2024-05-01T10:00:00Z", "kids": {"id": C, "last_updated": "2024-05-01"}}) == {B: 1714557600000, C: 1714521600000}
    assert found(spark, {"id": 0, "chat_id": C, "update_time": 1700000000}, {"id": False, "chat_id": B, "update_time": 1700000001}) == {C: 1700000000000, B: 1700000001000}


def test_what_says_nothing(spark):
    assert found(spark, None, "", "{broken", "7", "null", {"id": 7, "uuid": A, "update_time": 1700000000}, {"id": "short", "update_time": 1700000000}, {"id": A}, {"id": A, "update_time": 12}, {"id": A, "update_time": {"x": 1700000000}}, {"id": A, "update_time": True}) == {}
    assert found(spark, deep(6, {"id": A, "update_time": 1700000000}), deep(7, {"id": B, "update_time": 1700000000})) == {A: 1700000000000}


def test_scripts_of_a_page(spark):
    html = f'<script>var a={{"id":"{C}"}}</script><SCRIPT id="__NEXT_DATA__" type="x">{{"id":"{A}"}}</SCRIPT >\n<script data-a="b" type="application/ld+json">[1,\n2]</script><script type="text/json">[3]</script>'
    frame = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert [tuple(r) for r in embedded.json_scripts(frame).collect()] == [(1, f'{{"id":"{A}"}}'), (1, "[1,\n2]")]
