"""Identity of turns and transcripts: stamps, fingerprints, owners, clones, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as tx
from ..functions.let import let
from ..session import cut_lineage
from .ordered import chunk_of, ordinals, running

# --- fixed values -----------------------------------------------------------------
SYNTHETIC_ID = "^(?:chatgpt|claude|grok|gemini):[^:]+:[0-9a-f]{1,8}:dom[0-9]+$"
BODY_PREFIXES = (40, 80, 160)
ONE_WORD_STATUS = ["drawing", "painting", "sketching", "dibujando", "esboçando"]
PROGRESS_PHRASES = [
    "正在建立圖像", "正在建立影像", "正在勾勒草圖", "正在生成初稿", "正在打磨細節", "正在生成圖片", "正在繪製", "正在生成圖像",
    "正在修飾細節", "正在創建圖像", "正在創建影像", "正在創建圖片", "正在描繪", "正在创建图像", "正在创建影像", "正在勾勒草图",
    "正在打磨细节", "正在生成图片", "正在绘制", "正在生成图像", "正在修饰细节", "正在创建图片", "正在描绘",
    "creating image", "creating your image", "creating an image", "sketching", "adding details", "generating image",
    "generating an image", "refining details", "drawing", "painting", "generating draft", "starting image generation",
    "creating the image", "画像を作成しています", "画像を生成しています", "スケッチを作成しています", "詳細を追加しています",
    "下書きを生成しています", "画像を描いています", "画像を作成中", "画像を生成中", "スケッチ中", "詳細を追加中",
    "이미지 생성 중", "이미지를 생성하는 중", "이미지 만들기 중", "이미지를 만드는 중", "스케치 중", "스케치하는 중",
    "세부 사항 추가 중", "세부 정보 추가 중", "초안 생성 중", "초안을 생성하는 중", "이미지 그리는 중",
    "creando imagen", "generando imagen", "dibujando", "agregando detalles", "añadiendo detalles", "creando la imagen",
    "generando la imagen", "creando borrador", "perfeccionando detalles", "création de l'image", "génération de l'image",
    "esquisse en cours", "ajout des détails", "ajout de détails", "création d'image", "génération d'image",
    "affinage des détails", "dessin en cours", "bild wird erstellt", "bild wird generiert", "skizze wird erstellt",
    "details werden hinzugefügt", "bild erstellen", "bild generieren", "entwurf wird erstellt", "details werden verfeinert",
    "criando imagem", "gerando imagem", "esboçando", "adicionando detalhes", "criando a imagem", "gerando a imagem",
    "criando rascunho", "refinando detalhes",
]
BUTTON_LABELS = [
    "copy", "copied", "retry", "regenerate", "share", "edit", "more", "like", "dislike", "复制", "已复制", "重试", "重新生成", "分享", "编辑", "更多",
]
SPEAKER_LABELS = ["chatgpt", "you", "user", "assistant", "claude", "grok", "gemini", "gpt-4o", "gpt-4", "gpt-5", "o1", "o3", "4o"]
SPEAKER_SAID = r"^(?:chatgpt|you|claude|gemini|grok)\s+said\s*:?$"
SIZE_BUCKETS = [(0, "0"), (40, "1-40"), (160, "41-160"), (640, "161-640"), (2560, "641-2560")]
# ----------------------------------------------------------------------------------


def canonical_role(role: Column) -> Column:
    return F.when(role == "user", "user").otherwise("assistant")


def turn_stamp(role: Column, body: Column) -> Column:
    """Role and wording; empty when nothing is left of the body."""
    return F.transform(
        F.array(markup.turn_text(body)), lambda t: F.when(t == "", F.lit("")).otherwise(F.concat(canonical_role(role), F.lit("\n"), t))
    )[0]


def wording_changed(old: Column, new: Column) -> Column:
    """The page shows other words; restyling and a shorter repaint are not a change."""
    a, b = markup.turn_text(old), markup.turn_text(new)
    repaint = (a != "") & F.startswith(a, b) & (F.length(b) < F.length(a))
    return (b != "") & (a != b) & ~repaint


def grows(old: Column, new: Column) -> Column:
    a, b = markup.turn_text(old), markup.turn_text(new)
    return (a != "") & (F.length(b) > F.length(a)) & F.startswith(b, a)


def shrinks(old: Column, new: Column) -> Column:
    a, b = markup.turn_text(old), markup.turn_text(new)
    size = F.length(b)
    return (b != "") & (size < F.length(a)) & F.startswith(a, b) & (size >= 24) & (size >= F.length(a) * 0.8)


def poorer(old: Column, new: Column) -> Column:
    """The new text is a shorter opening of the stored one: half painted, keep what is stored."""
    a, b = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    return (a != "") & (b != "") & (F.length(b) < F.length(a)) & F.startswith(a, b)


def progress_core(body: Column) -> Column:
    """A status line without bullets, percentages and closing marks, in lower case."""
    text = tx.flatten_spaces(body)
    text = F.regexp_replace(text, r"^[\s\-–—_•·*※…‥.。]+", "")
    text = F.regexp_replace(text, r"[0-9]{1,3}\s*[%％]", " ")
    text = F.regexp_replace(text, r"\s+[0-9]{1,3}\s*$", "")
    text = F.regexp_replace(text, r"[\s\-–—_•·*※…‥.。!！?？~～、,，:：;；]+$", "")
    return F.lower(tx.flatten_spaces(text))


def is_progress(body: Column) -> Column:
    """The whole body is one known status phrase; a lone word needs a percentage next to it."""
    bare = F.coalesce(body, F.lit(""))
    return F.transform(
        F.array(progress_core(bare)),
        lambda core: core.isin(PROGRESS_PHRASES) & (~core.isin(ONE_WORD_STATUS) | bare.rlike(r"[0-9]{1,3}\s*[%％]")),
    )[0]


def is_substantive(body: Column) -> Column:
    """Neither empty nor a button label nor a bare speaker label."""
    label = F.lower(tx.flatten_spaces(body))
    name = F.lower(tx.flatten_spaces(F.regexp_replace(F.coalesce(body, F.lit("")), r"[#>*_`~\[\]()]", " ")))
    return ~((label == "") | label.isin(BUTTON_LABELS) | (name == "") | name.isin(SPEAKER_LABELS) | name.rlike(SPEAKER_SAID))


def size_bucket(chars: Column) -> Column:
    out = None
    for top, label in SIZE_BUCKETS:
        out = F.when(chars <= top, label) if out is None else out.when(chars <= top, label)
    return out.otherwise("2560+")


def fingerprints(turns: DataFrame) -> DataFrame:
    """Order-sensitive fingerprint of a transcript, blind to ids and roles.

    ``turns``: conversation_id, turn, body. Every turn adds a hash of its position and its
    body, so a conversation of any length is folded by partial sums.
    """
    placed = ordinals(turns.select("conversation_id", "turn", F.md5("body").alias("h")), ["conversation_id"], ["turn"], chunk_of("turn"), "pos")
    mixed = placed.withColumn("x", F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("h"))))
    part = lambda at: F.sum(F.conv(F.substring("x", at, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return mixed.groupBy("conversation_id").agg(F.concat_ws("-", F.count("*").cast("string"), part(1), part(13)).alias("fingerprint"))


def identical_transcripts(prints: DataFrame) -> DataFrame:
    """Fingerprints shared by conversations: how many and the first of them."""
    return (
        prints.groupBy("fingerprint")
        .agg(F.count("*").alias("copies"), F.min("conversation_id").alias("first_id"))
        .where(F.col("copies") > 1)
    )


def body_keys(turns: DataFrame) -> DataFrame:
    """Prefix keys of bodies at 40, 80 and 160 characters (conversation_id, key)."""
    options = [
        F.when(
            F.length("body") >= n,
            F.md5(F.concat_ws(":", F.col("role"), F.lit(str(n)), F.substring("body", 1, n))),
        )
        for n in BODY_PREFIXES
    ]
    return turns.select("conversation_id", F.explode(F.array_compact(F.array(*options))).alias("key"))


def held_captures(captures: DataFrame, owners: DataFrame) -> DataFrame:
    """Captures that carry a key owned on their platform only by other conversations.

    ``captures``: conversation_id, key. ``owners``: key, owner. Owners are folded to at most
    one row per (platform, key) before the join: how many there are and, so that ownership
    by the capture itself can be told apart, matched pairs in a second equi-join.
    """
    platform = lambda c: F.substring_index(c, ":", 1)
    asked = captures.select("conversation_id", "key", platform("conversation_id").alias("platform")).distinct()
    owned = owners.select("key", "owner", platform("owner").alias("platform")).distinct()
    any_owner = owned.select("platform", "key").distinct()
    own = owned.select("key", F.col("owner").alias("conversation_id"))
    foreign = asked.join(any_owner, ["platform", "key"], "left_semi").join(own, ["conversation_id", "key"], "left_anti")
    return foreign.select("conversation_id").distinct()


def progress_folds(rows: DataFrame) -> DataFrame:
    """(drop_id, keep_id): status turns folded into the settled turn right after their run.

    ``rows``: conversation_id, ord, id, role, body, capture_index, turn_id. A run is made of
    neighbours with the same slot and the same non-empty turn id.
    """
    status = (F.col("role") == "assistant") & is_progress(F.col("body"))
    slot = F.when((F.col("capture_index") >= 0) & (F.col("turn_id") != ""), F.struct("capture_index", "turn_id"))
    rows = rows.select("conversation_id", "ord", "id", "role", F.coalesce(status, F.lit(False)).alias("status"), slot.alias("slot"))
    rows = cut_lineage(rows)  # short rows, read several times below; bodies are read once
    here = F.struct("id", "role", "status", "slot")
    rows = running(rows, ["conversation_id"], ["ord"], chunk_of("ord"), nxt=("near", here, "after"))
    joined = F.coalesce(F.col("slot") == F.col("nxt.slot"), F.lit(False))
    goes_on = joined & F.col("nxt.status")
    settles = joined & ~F.col("nxt.status") & (F.col("nxt.role") == "assistant")
    rows = rows.withColumn("ends", F.col("status") & ~F.coalesce(goes_on, F.lit(False)))
    target = F.struct(
        F.when(settles, F.col("nxt.id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce(settles, F.lit(False)).alias("settled"),
    )
    rows = rows.withColumn("target", F.when(F.col("ends"), target))
    rows = running(rows, ["conversation_id"], ["ord"], chunk_of("ord"), later=("near", F.col("target"), "after"))
    end = F.coalesce("target", "later")
    folds = rows.where("status").select("conversation_id", F.col("id").alias("drop_id"), end["keep_id"].alias("keep_id"), end["settled"].alias("settled"))
    return folds.where((F.col("drop_id") != F.col("keep_id"))).drop("settled")


def clone_drops(stored: DataFrame, page: DataFrame) -> DataFrame:
    """(conversation_id, drop_id, keep_id) of transcripts stored as two or more copies of a page.

    ``stored``: conversation_id, ord (from 1), id, role, body, turn_id. ``page``:
    conversation_id, idx (from 0), id, role, body of a proved complete page.
    """
    hashed = lambda c: let(c, lambda v: F.when(v == "", v).otherwise(F.md5(v)))
    sizes = page.groupBy("conversation_id").agg(F.count("*").alias("size")).where("size >= 2")
    totals = stored.groupBy("conversation_id").agg(F.count("*").alias("total"))
    fits = sizes.join(totals, "conversation_id").where("total >= size * 2 and total % size = 0")
    rows = stored.join(fits, "conversation_id").select(
        "conversation_id", "id", "size", "total",
        ((F.col("ord") - 1) % F.col("size")).alias("idx"),
        F.floor((F.col("ord") - 1) / F.col("size")).alias("block"),
        hashed(turn_stamp(F.col("role"), F.col("body"))).alias("stamp"),
        "turn_id",
        (~F.col("id").rlike(SYNTHETIC_ID)).alias("native"),
    )
    rows = cut_lineage(rows)  # short rows, read several times below
    shown = page.select("conversation_id", "idx", F.col("id").alias("page_id"), hashed(turn_stamp(F.col("role"), F.col("body"))).alias("page_stamp"))
    on_page = page.select("conversation_id", "id").distinct()
    anchored = (
        rows.join(on_page, ["conversation_id", "id"], "left_semi").groupBy("conversation_id").agg(F.min("block").alias("keep_block"))
    )
    same = (
        rows.groupBy("conversation_id", "idx")
        .agg(
            F.min("stamp").alias("lo"), F.max("stamp").alias("hi"), F.min("turn_id").alias("t_lo"), F.max("turn_id").alias("t_hi"),
            F.count_if(F.coalesce(F.col("turn_id"), F.lit("")) == "").alias("bare"),
        )
        .join(shown, ["conversation_id", "idx"], "left")
        .groupBy("conversation_id")
        .agg(
            F.bool_and(
                (F.col("lo") == F.col("hi")) & (F.col("lo") != "") & (F.col("t_lo") == F.col("t_hi")) & (F.col("bare") == 0)
                & (F.col("page_stamp").isNull() | (F.col("page_stamp") == F.col("lo")))
            ).alias("ok")
        )
        .where("ok")
        .select("conversation_id")
    )
    rows = rows.join(same, "conversation_id", "left_semi").join(anchored, "conversation_id", "left")
    keep = F.coalesce("keep_block", F.expr("total div size - 1"))
    rows = rows.withColumn("keep", keep)
    unsafe = rows.where("native and block <> keep").select("conversation_id").distinct()
    rows = rows.join(unsafe, "conversation_id", "left_anti")
    kept = rows.where("block = keep").select("conversation_id", "idx", F.col("id").alias("keep_id"))
    return rows.where("block <> keep").select("conversation_id", "idx", F.col("id").alias("drop_id")).join(kept, ["conversation_id", "idx"]).drop("idx")


def snapshot_drops(stored: DataFrame, page: DataFrame) -> DataFrame:
    """Synthetic stored turns that a proved complete page shows neither by id nor by body."""
    proved = page.select("conversation_id").distinct()
    rows = stored.where(F.col("id").rlike(SYNTHETIC_ID)).join(proved, "conversation_id", "left_semi")
    rows = rows.join(page.select("conversation_id", "id").distinct(), ["conversation_id", "id"], "left_anti")
    shown = page.select("conversation_id", F.md5("body").alias("h")).distinct()
    return rows.withColumn("h", F.md5("body")).join(shown, ["conversation_id", "h"], "left_anti").select("conversation_id", "id")


def apply_folds(messages: DataFrame, folds: DataFrame) -> DataFrame:
    """Messages without the folded turns."""
    return messages.join(folds.select(F.col("drop_id").alias("id")), "id", "left_anti")


def turn_id_of(native: Column, container: Column, role: Column, body: Column) -> Column:
    """Native id, else container and role, else a hash of role and wording."""
    hashed = F.md5(F.concat_ws(":", role, tx.flatten_spaces(body)))
    return F.coalesce(F.nullif(native, F.lit("")), F.when(container != "", F.concat_ws(":", container, role)), hashed)
