"""Feeds: channel and items of an RSS document, and its newest item as an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.provenance import source_markdown
from lorebank.functions.text import or_default, plain_text, squash_ws, trim_ws
from lorebank.functions.urls import platform_of
from lorebank.sources.web import to_markdown

ITEM = "title string, link string, description string, `content:encoded` string, enclosure struct<_url string, _VALUE string>"
FEED = f"channel struct<title string, item array<struct<{ITEM}>>>".replace(" string", ": string").replace(
    "channel struct", "channel: struct"
).replace("item array", "item: array").replace("enclosure struct", "enclosure: struct")


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed files, one row each, read in parallel by row tag."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)


def feed_items(feeds: DataFrame) -> DataFrame:
    """All items of ``feeds(import_id, user_id, url, xml)`` in document order; each text is parsed once."""
    parsed = feeds.select("import_id", "user_id", "url", F.from_xml("xml", f"struct<{FEED}>", {"rowTag": "rss"}).alias("feed"))
    return parsed.select(
        "import_id",
        "user_id",
        "url",
        or_default(_clean(F.col("feed.channel.title")), K.FEED_TITLE).alias("channel"),
        F.posexplode_outer("feed.channel.item").alias("pos", "item"),
    ).select(
        "import_id",
        "user_id",
        "url",
        "channel",
        "pos",
        or_default(_clean(F.col("item.title")), F.col("channel")).alias("title"),
        F.coalesce("item.description", "item.`content:encoded`", F.lit("")).alias("description"),
        or_default(F.col("item.enclosure._url"), or_default(_clean(F.col("item.link")), F.col("url"))).alias("audio"),
    )


def _clean(c: Column) -> Column:
    return trim_ws(squash_ws(F.coalesce(c, F.lit(""))))


def feed_imports(feeds: DataFrame, imported_at: Column) -> DataFrame:
    """The first item of every feed as an import; feeds without items need action."""
    rows = feed_items(feeds).where(F.coalesce("pos", F.lit(0)) == 0)
    empty = F.col("pos").isNull()
    described = rows.withColumn("about", to_markdown(squash_ws("description"))).withColumn("platform", platform_of("url"))
    is_audio = F.col("audio").rlike(K.AUDIO_URL)
    kind = F.lit("podcast")
    body = F.concat(
        F.lit("## 播客信息\n\n- 播客："), "channel", F.lit("\n- 音频："), "audio", F.lit("\n- RSS："), "url",
        F.lit("\n\n## 节目简介\n\n"), or_default("about", K.FEED_NO_DESCRIPTION), F.lit("\n\n"),
        F.when(is_audio, K.FEED_AUDIO_HINT).otherwise(""),
    )
    platform, url = F.col("platform"), F.col("url")
    title = F.when(empty, F.col("channel")).otherwise(F.col("title"))
    return described.select(
        "import_id",
        "user_id",
        F.when(empty | is_audio, "needs-action").otherwise("ready").alias("status"),
        kind.alias("source_type"),
        "platform",
        title.alias("title"),
        url.alias("source_url"),
        F.when(
            empty,
            source_markdown(title, F.lit(f"> {K.WARN_NO_FEED_ITEM}"), platform, url, F.lit(K.PENDING_METHOD), kind, imported_at),
        )
        .otherwise(source_markdown(title, body, platform, url, F.lit(K.FEED_METHOD), kind, imported_at))
        .alias("markdown"),
        F.when(empty, "").otherwise(plain_text("about")).alias("extracted_text"),
        F.array_compact(
            F.array(F.when(empty, F.lit(K.WARN_NO_FEED_ITEM)), F.when(~empty & is_audio, F.lit(K.WARN_FEED_AUDIO)))
        ).alias("warnings"),
    )
