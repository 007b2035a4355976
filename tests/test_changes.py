"""Folds, removals and image writes on small tables, against written-out values."""

from __future__ import annotations

from threadloom.operators import changes

IMAGES = "message_id string, idx int, conversation_id string, off bigint, bytes int, status string"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_images_and_their_bytes_move_together(spark):
    stored = spark.createDataFrame([("a", 0, "c", 5, 10, "cached"), ("b", 0, "c", 6, 20, "cached"), ("b", 1, "c", 7, 30, "cached"), ("k", 0, "c", 8, 40, "cached"), ("z", 0, "d", 9, 50, "cached")], IMAGES)
    blobs = stored.selectExpr("message_id", "idx", "cast(concat(message_id, idx) as binary) as blob")
    folds = spark.createDataFrame([("c", "a", "k"), ("c", "b", "k")], "conversation_id string, drop_id string, keep_id string")
    out = changes.apply_fold_plan({"images": stored, "blobs": blobs}, folds)
    assert rows_of(out["images"].select("message_id", "idx", "off", "bytes")) == [("k", 0, 8, 40), ("k", 1, 0, 10), ("k", 2, 0, 20), ("k", 3, 0, 30), ("z", 0, 9, 50)]
    assert rows_of(out["blobs"].selectExpr("message_id", "idx", "cast(blob as string)")) == [("k", 0, "k0"), ("k", 1, "a0"), ("k", 2, "b0"), ("k", 3, "b1"), ("z", 0, "z0")]
    assert out["images"].schema == stored.schema


def test_headers_after_folds(spark):
    messages = spark.createDataFrame([("1", "c", "user", "hi"), ("2", "c", "assistant", "Sketching 10%"), ("3", "c", "assistant", " the\n\n\n\nanswer "), ("4", "d", "assistant", "Sketching 1%"), ("5", "d", "assistant", "Sketching 2%"), ("6", "e", "user", "x")], "id string, conversation_id string, role string, body string")
    heads = spark.createDataFrame([("c", 3, "2", "p", "user"), ("d", 2, "4", "p", "user"), ("e", 7, "6", None, None), ("f", 1, None, "p", None)], "id string, message_count int, tail_message_id string, last_preview string, last_preview_role string")
    folds = spark.createDataFrame([("c", "2", "3"), ("d", "4", "5")], "conversation_id string, drop_id string, keep_id string")
    out = changes.apply_fold_plan({"headers": heads, "messages": messages}, folds)
    # A kept status is no preview; headers without folds keep their count, right or not.
    assert rows_of(out["headers"].fillna("-")) == [("c", 2, "3", "the\n\nanswer", "assistant"), ("d", 1, "5", "p", "user"), ("e", 7, "6", "-", "-"), ("f", 1, "-", "p", "-")]
    assert rows_of(out["messages"].select("id")) == [("1",), ("3",), ("5",), ("6",)]
    assert rows_of(changes.apply_fold_plan({"headers": heads, "messages": messages}, folds.limit(0))["headers"].select("message_count")) == [(1,), (2,), (3,), (7,)]


def test_removal_counts_what_it_frees(spark):
    stored = spark.createDataFrame([("a", 0, "c", 5, 10, "cached"), ("b", 0, "c", 6, None, "timeout"), ("z", 0, "d", 9, 50, "cached")], IMAGES)
    blobs = stored.selectExpr("message_id", "idx", "cast('x' as binary) as blob")
    ids = spark.createDataFrame([("c",), ("c",), (None,), ("unknown",)], "conversation_id string")
    out = changes.remove_conversations({"images": stored, "blobs": blobs}, ids, 1)
    assert rows_of(out["freed"]) == [(2, 10)] and rows_of(out["images"].select("message_id")) == rows_of(out["blobs"].select("message_id")) == [("z",)]
    assert rows_of(changes.remove_conversations({"images": stored}, ids.limit(0), 1)["freed"]) == [(0, 0)]


def test_last_record_of_a_slot_decides_its_bytes(spark):
    blobs = spark.createDataFrame([("a", 0, b"old"), ("b", 0, b"old"), ("c", 0, b"old")], "message_id string, idx int, blob binary")
    batch = spark.createDataFrame([("a", 0, "cached", b"new", 2), ("a", 0, "cleared", None, 1), ("b", 0, "timeout", b"x", 1), ("n", 1, "cached", b"", 1), ("m", 1, "cached", b"m", 1)], "message_id string, idx int, status string, blob binary, arrival int")
    assert rows_of(changes.write_blobs(blobs, batch)) == [("a", 0, b"new"), ("c", 0, b"old"), ("m", 1, b"m")]
