"""Times that pages state for conversations in the JSON they embed.

Scripts are parsed as VARIANT. All objects down to ``DEPTH`` are gathered level by level inside one expression, so a page
is read once and only (id, time) pairs are shuffled.

Defined results: text that is no JSON, objects without an id that holds a UUID or without a plausible time say nothing; the
first key with a value counts, and an id of another type than text ends the search for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.let import let
from ..functions.links import UUID
from ..operators.clock import page_ms

# --- fixed values -----------------------------------------------------------------
ID_KEYS = ["id", "conversation_id", "conversationId", "uuid", "chat_id", "chatId"]
TIME_KEYS = ["update_time", "updated_at", "updatedAt", "modifyTime", "modify_time", "last_updated", "create_time", "created_at", "createdAt"]
DEPTH = 6
SCRIPT = r"""(?is)<script\b(?=[^>]*(?:type\s*=\s*["']application/(?:ld\+)?json["']|id\s*=\s*["']__NEXT_DATA__["']))[^>]*>(.*?)</script\s*>"""
# ----------------------------------------------------------------------------------


def json_scripts(pages: DataFrame, html_col: str = "html", name: str = "json") -> DataFrame:
    """``pages`` without their HTML, one row for each script that holds JSON."""
    others = [c for c in pages.columns if c != html_col]
    return pages.select(*others, F.explode(F.regexp_extract_all(html_col, F.lit(SCRIPT), 1)).alias(name))


def _children(value: Column) -> Column:
    kids = F.coalesce(value.try_cast("array<variant>"), F.map_values(value.try_cast("map<string, variant>")), F.array().cast("array<variant>"))
    return F.filter(kids, lambda kid: F.schema_of_variant(kid).rlike("^(?:ARRAY|OBJECT)"))


def nodes(value: Column, depth: int = DEPTH) -> Column:
    """Array of a VARIANT and all arrays and objects within it, ``depth`` levels down."""
    root = F.array(value)

    def deeper(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["level"], _children))
        return F.struct(below.alias("level"), F.concat(state["seen"], below).alias("seen"))

    start = F.struct(root.alias("level"), root.alias("seen"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, deeper, lambda state: state["seen"])


def _fields(value: Column, keys: list[str]) -> Column:
    """(kind, text) of each key that has a value other than null, in the order of ``keys``."""
    found = [let(F.try_variant_get(value, f"$.{k}", "variant"), lambda x: F.struct(F.schema_of_variant(x).alias("kind"), x.try_cast("string").alias("text"))) for k in keys]
    return F.filter(F.array(*found), lambda f: f["text"].isNotNull() & (f["kind"] != "VOID"))


def stated_id(value: Column) -> Column:
    """The UUID of an object's id, in small letters, or null."""
    numeric = lambda f: ~f["kind"].isin("STRING", "BOOLEAN") & (f["text"].try_cast("double") == 0)
    blank = lambda f: F.coalesce((f["kind"] == "STRING") & (f["text"] == "") | (f["kind"] == "BOOLEAN") & (f["text"] == "false") | numeric(f), F.lit(False))
    first = F.get(F.filter(_fields(value, ID_KEYS), lambda f: ~blank(f)), F.lit(0))
    return let(first, lambda f: F.when(f["kind"] == "STRING", F.nullif(F.lower(F.regexp_extract(f["text"], f"(?i)({UUID})", 1)), F.lit(""))))


def stated_ms(value: Column, now_ms: int) -> Column:
    """The time of an object: epoch numbers and labels, or null."""
    first = F.get(_fields(value, TIME_KEYS), F.lit(0))
    number = lambda f: F.floor(page_ms(f["text"].try_cast("double"), now_ms)).cast("bigint")
    return let(first, lambda f: F.when(f["kind"] == "STRING", times.page_time(f["text"], now_ms)).when(~f["kind"].rlike("^(?:ARRAY|OBJECT|BOOLEAN)"), number(f)))


def embedded_times(scripts: DataFrame, now_ms: int, json_col: str = "json") -> DataFrame:
    """(id, ms): the newest time that any object of any script states for a conversation."""
    parsed = scripts.select(F.try_parse_json(json_col).alias("v")).where("v is not null")
    objects = parsed.select(F.explode(nodes(F.col("v"))).alias("o")).where(F.schema_of_variant("o").startswith("OBJECT"))
    said = objects.select(stated_id(F.col("o")).alias("id"), "o").where("id is not null").select("id", stated_ms(F.col("o"), now_ms).alias("ms"))
    return said.where("ms is not null").groupBy("id").agg(F.max("ms").alias("ms"))
