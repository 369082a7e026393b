"""Caption files: choosing one per medium and turning it into a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.provenance import pending_markdown, source_markdown
from lorebank.functions.text import col_of, or_default, trim_ws
from lorebank.functions.urls import platform_of


def transcript_of(vtt: Column | str) -> Column:
    """Spoken lines of a caption file: cue furniture and tags dropped, adjacent repeats once.

    Stays inside the row, in file order; no sort or shuffle of lines.
    """
    lines = F.transform(F.split(F.replace(col_of(vtt), F.lit("\r"), F.lit("")), "\n"), trim_ws)
    spoken = F.filter(
        lines,
        lambda x: (x != "") & (x != "WEBVTT") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^\d+$") & ~F.startswith(x, F.lit("NOTE")),
    )
    plain = F.filter(F.transform(spoken, lambda x: trim_ws(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")

    def once(all_lines: Column) -> Column:
        return F.filter(all_lines, lambda x, i: (i == 0) | (x != F.get(all_lines, i - 1)))

    return F.array_join(F.element_at(F.transform(F.array(plain), once), 1), "\n")


def best_captions(captions: DataFrame) -> DataFrame:
    """One caption per medium: language order, manual before automatic, VTT only.

    ``captions``: media_id, lang, kind (manual/automatic), ext, pos, text.
    """
    langs = F.array(*[F.lit(x) for x in K.CAPTION_LANGUAGES])
    usable = captions.where((F.col("ext") == "vtt") & F.col("lang").isin(*K.CAPTION_LANGUAGES))
    order = Window.partitionBy("media_id").orderBy(
        F.array_position(langs, F.col("lang")), F.when(F.col("kind") == "manual", 0).otherwise(1), "pos"
    )
    return usable.withColumn("choice", F.row_number().over(order)).where(F.col("choice") == 1).drop("choice")


def caption_imports(media: DataFrame, captions: DataFrame, imported_at: Column) -> DataFrame:
    """Videos as imports: ready with a usable caption, else a card that needs action. ``media``: import_id, user_id, url, title, uploader."""
    chosen = best_captions(captions).select(F.col("media_id").alias("import_id"), transcript_of("text").alias("caption"))
    rows = media.join(chosen, "import_id", "left").withColumns({"caption": F.coalesce("caption", F.lit("")), "platform": platform_of("url")})
    spoken = F.col("caption") != ""
    title = or_default("title", F.concat("platform", F.lit(K.VIDEO_TITLE_SUFFIX)))
    body = F.concat(
        F.lit(f"{K.VIDEO_FACTS}\n\n{K.FACT_PLATFORM}"), "platform", F.lit(f"\n{K.FACT_AUTHOR}"), or_default("uploader", K.VIDEO_UNKNOWN_AUTHOR),
        F.lit(f"\n{K.FACT_LINK}"), "url", F.lit(f"\n\n{K.VIDEO_BODY}\n\n"), "caption",
    )
    kind = F.lit("video")
    return rows.select(
        "import_id",
        "user_id",
        F.when(spoken, "ready").otherwise("needs-action").alias("status"),
        kind.alias("source_type"),
        "platform",
        title.alias("title"),
        F.col("url").alias("source_url"),
        F.when(spoken, source_markdown(title, body, F.col("platform"), F.col("url"), F.lit(K.VIDEO_CAPTION_METHOD), kind, imported_at))
        .otherwise(pending_markdown(title, F.col("platform"), F.col("url"), kind, F.lit(K.VIDEO_REASON), F.lit(K.VIDEO_DESCRIPTION), imported_at))
        .alias("markdown"),
        F.col("caption").alias("extracted_text"),
        F.array(F.when(spoken, K.VIDEO_CAPTION_WARNING).otherwise(K.VIDEO_WARNING)).alias("warnings"),
    )
