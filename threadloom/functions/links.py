"""Conversation identity and safety of page addresses, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# --- fixed values -----------------------------------------------------------------
HOSTS = {
    "chatgpt": ["chatgpt.com", "chat.openai.com"],
    "claude": ["claude.ai"],
    "grok": ["grok.com", "www.grok.com", "grok.x.com", "x.ai"],
    "gemini": ["gemini.google.com"],
}
HOME_PATHS = {
    "chatgpt": "^/$",
    "claude": "^/(?:new|recents|chats)?$",
    "grok": "^/(?:chat|c)?$",
    "gemini": "^/(?:app|u/[0-9]+/app)?$",
}
VISIT_HOME_PATHS = {
    "chatgpt": "^/(?:new|chat)?$",
    "claude": "^/(?:new)?$",
    "grok": "^/(?:new|chat)?$",
    "gemini": "^(?:/u/[0-9]+)?/app$",
}
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
LONG_ID = "[A-Za-z0-9_-]{8,128}"
RESERVED = ["edit", "create", "view", "new"]
# ----------------------------------------------------------------------------------

def _text(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def authority(url: Column) -> Column:
    """Everything between the scheme and the path of an https address; empty otherwise."""
    return F.regexp_extract(_text(url), "^https://([^/?#]*)", 1)


def path(url: Column) -> Column:
    found = F.regexp_extract(_text(url), "^https://[^/?#]*([^?#]*)", 1)
    return let(found, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _platform_of(host: Column) -> Column:
    out = F.lit(None).cast("string")
    for platform, hosts in HOSTS.items():
        out = F.when(host.isin(hosts), platform).otherwise(out)
    return out


def platform_of(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(authority(url), "^[^@]*@", ""), ":[0-9]*$", "")
    return let(F.lower(bare), _platform_of)


def plain_authority(url: Column) -> Column:
    """Neither credentials nor a port."""
    return ~authority(url).rlike("[@:]")


def _gemini_id(place: Column) -> Column:
    app = F.regexp_extract(place, f"(?i)^(?:/u/[0-9]+)?/app/({LONG_ID})$", 1)
    gem = F.lower(F.regexp_extract(place, f"(?i)^(?:/u/[0-9]+)?/gem/([A-Za-z0-9_-]+)/{LONG_ID}$", 1))
    inner = F.regexp_extract(place, f"(?i)^(?:/u/[0-9]+)?/gem/[A-Za-z0-9_-]+/({LONG_ID})$", 1)
    found = F.when(app != "", app).when(~gem.isin("", *RESERVED) & ~F.lower(inner).isin(RESERVED), inner)
    shaped = lambda i: F.when(i.rlike("[0-9]|^(?i:[0-9a-f]{12,})$"), i)
    return F.when(~place.rlike("(?i)/share(?:/|$)"), let(found, shaped))


def _id_in(platform: Column, place: Column) -> Column:
    uuid = F.lower(F.regexp_extract(place, f"(?i)({UUID})", 1))
    own = F.lower(F.regexp_extract(place, f"(?i)/c/({UUID})", 1))
    long = F.lower(F.regexp_extract(place, "(?i)/(?:c|chat)/([A-Za-z0-9_-]{16,128})(?:/|$)", 1))
    some = lambda c: F.nullif(c, F.lit(""))
    return (
        F.when(platform == "chatgpt", some(own))
        .when((platform == "claude") & place.rlike("(?i)/chat/"), some(uuid))
        .when((platform == "grok") & place.rlike("(?i)/(?:c|chat)/"), F.coalesce(some(uuid), some(long)))
        .when(platform == "gemini", let(F.regexp_replace(place, "/+$", ""), _gemini_id))
    )


def address(url: Column) -> Column:
    """struct(platform, place, platform_id): all that is known about an address."""
    seen = F.struct(platform_of(url).alias("platform"), path(url).alias("place"))
    return let(seen, lambda s: F.struct(s["platform"].alias("platform"), s["place"].alias("place"), _id_in(s["platform"], s["place"]).alias("platform_id")))


def platform_id(url: Column) -> Column:
    """Id of the conversation an address shows, or null."""
    return address(url)["platform_id"]


def conversation_id(url: Column) -> Column:
    return let(address(url), lambda a: F.concat(a["platform"], F.lit(":"), a["platform_id"]))


def safe_url(url: Column) -> Column:
    """An https address on a listed host without credentials or port, else empty."""
    return F.when(plain_authority(url) & platform_of(url).isNotNull(), url).otherwise(F.lit(""))


def canonical_url(url: Column, platform: Column) -> Column:
    """Conversation address on its platform without query and hash, else empty."""
    own = let(address(url), lambda a: F.coalesce((a["platform"] == platform) & a["platform_id"].isNotNull(), F.lit(False)))
    return F.when(own, F.regexp_replace(url, "[?#].*$", "")).otherwise(F.lit(""))


def _on_path(a: Column, platform: Column, patterns: dict[str, str]) -> Column:
    bare = F.regexp_replace(a["place"], "/+$", "")
    place = F.when(bare == "", F.lit("/")).otherwise(bare)
    out = F.lit(False)
    for name, pattern in patterns.items():
        out = F.when((platform == name) & (a["platform"] == name), place.rlike(pattern)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_home(url: Column, platform: Column) -> Column:
    return let(address(url), lambda a: _on_path(a, platform, HOME_PATHS) & a["platform_id"].isNull())


def is_visit_home(url: Column, platform: Column) -> Column:
    """Pages a removed conversation redirects to."""
    return let(address(url), lambda a: _on_path(a, platform, VISIT_HOME_PATHS))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(_text(url), "^(https://[^/?#]*)", 1))


def page_kind(url: Column) -> Column:
    """temporary, conversation, home or other."""
    kind = lambda a: F.when(a["platform_id"].isNotNull(), "conversation").when(a["place"] == "/", "home").otherwise("other")
    return F.when(url.rlike(r"[?&]temporary-chat=true(?:&|#|$)"), "temporary").otherwise(let(address(url), kind))


# --- titles -------------------------------------------------------------------------
GENERIC_TITLES = ["new chat", "chatgpt", "claude", "grok", "gemini", "google gemini", "untitled", "无标题", "新对话", "新對話", "新聊天"]
SITE_NAMES = ["ChatGPT", "Claude", "Grok", "Gemini", "Google Gemini"]


def is_generic_title(title: Column) -> Column:
    flat = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (flat == "") | flat.isin(GENERIC_TITLES)


def strip_site(title: Column, names: list[str] = SITE_NAMES) -> Column:
    """Title without closing ``- Site`` parts, however often they repeat."""
    ending = r"(?i)(?:\s*[|·—–-]\s*(?:" + "|".join(sorted(names, key=len, reverse=True)) + r")\s*)+$"
    return F.trim(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), ending, ""))


def best_title(new: Column, old: Column, platform_id: Column) -> Column:
    """A real title replaces anything, a generic one only a generic one; else the platform id."""
    takes = ~is_generic_title(new) | is_generic_title(old)
    pick = F.when(takes, F.coalesce(F.nullif(F.trim(F.coalesce(new, F.lit(""))), F.lit("")), old)).otherwise(old)
    return F.coalesce(F.nullif(pick, F.lit("")), platform_id)


def redact(text: Column, limit: int | None = None) -> Column:
    """Addresses, ids and line breaks removed from diagnostics; ``limit`` keeps so many characters."""
    out = F.regexp_replace(text, r"(?i)https?://\S+", "[url]")
    out = F.regexp_replace(out, f"(?i){UUID}", "[id]")
    out = F.trim(F.regexp_replace(out, r"[\r\n]+", " "))
    return out if limit is None else F.substring(out, 1, limit)
