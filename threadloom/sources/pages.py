"""Raw HTML pages as text blocks, links and list rows; replacements and extraction only, no DOM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as tx
from ..functions.let import let

# --- fixed values -----------------------------------------------------------------
DROPPED = ["script", "style", "noscript", "nav", "footer", "header", "aside", "button", "svg", "textarea", "select"]
BLOCK_EDGE = r"(?i)</?(?:p|div|article|section|li|ul|ol|h[1-6]|br|tr|table|pre|blockquote|body|html|head|title)\b[^>]*>"
HINTS = r"(?i)can make mistakes|check important info|we use cookies|upgrade to|subscribe to|accept all|privacy policy|僅供參考|可能出錯"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]
LINK = r"""(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>"""
MIN_PROSE, MANY_LINKS, HINT_CHARS = 24, 3, 180
# ----------------------------------------------------------------------------------


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return tx.flatten_spaces(text)


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, idx, text, chat_links): blocks of visible text in page order."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    parts = pages.select("page_id", F.posexplode(F.split(html, BLOCK_EDGE)).alias("idx", "part"))
    chat = F.regexp_count("part", F.lit(r"""(?i)<a\b[^>]*href="[^"]*/c/"""))
    rows = parts.select("page_id", "idx", chat.alias("chat_links"), plain_text(F.col("part")).alias("text"))
    return rows.where("text <> ''")


def prose_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that can be turns: enough prose, not link lists, not notices."""
    notice = (F.length("text") <= HINT_CHARS) & F.col("text").rlike(HINTS)
    return blocks.where((F.length("text") >= MIN_PROSE) & (F.col("chat_links") < MANY_LINKS) & ~notice)


def role_of(author: Column, turn: Column) -> Column:
    """Role from attributes; empty when they say nothing."""
    a, t = F.lower(F.coalesce(author, F.lit(""))), F.lower(F.coalesce(turn, F.lit("")))
    return (
        F.when(a.isin("assistant", "user", "system", "tool"), a)
        .when(t.isin("assistant", "ai", "model"), "assistant")
        .when(t.isin("user", "human"), "user")
        .when(t.isin("system", "tool"), t)
        .otherwise("")
    )


def list_rows(pages: DataFrame) -> DataFrame:
    """Chat links of a page with identity, title and list index; one row per conversation."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("label")
    )
    rows = pages.select("page_id", F.posexplode(pairs).alias("idx", "p")).select("page_id", "idx", F.col("p.href").alias("href"), plain_text(F.col("p.label")).alias("label"))
    seen = rows.withColumn("a", links.address(F.col("href"))).where(F.col("a.platform_id").isNotNull())
    title = let(links.strip_site(F.col("label")), lambda t: F.when(~links.is_generic_title(t), t))
    kept = seen.groupBy("page_id", F.concat_ws(":", "a.platform", "a.platform_id").alias("id")).agg(
        F.min("idx").alias("idx"), F.min_by(title, F.when(title.isNotNull(), F.col("idx"))).alias("title"))
    return kept


def best_time(now_ms: int, near_ms: Column, near_source: Column, embedded_ms: Column, section_ms: Column) -> Column:
    """struct(ms, source): exact on the row, embedded exact, coarse on the row, section heading."""
    from ..operators.clock import page_ms

    at = lambda c: F.when(page_ms(c, now_ms).isNotNull(), F.least(c, F.lit(now_ms)))
    take = lambda c, source, when=F.lit(True): F.when(when & at(c).isNotNull(), F.struct(at(c).alias("ms"), F.lit(source).alias("source")))
    return F.coalesce(
        take(near_ms, "page-exact", near_source == "page-exact"), take(embedded_ms, "page-exact"),
        take(near_ms, "page-bucket", near_source == "page-bucket"), take(section_ms, "page-bucket"),
    )
