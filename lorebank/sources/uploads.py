"""Uploaded files: kind by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebank.functions.text import col_of


def file_kind(content: Column | str) -> Column:
    """image (jpeg, png, gif, webp), media (mp3, wav, ogg, flac, mp4, mkv) or empty."""
    c = col_of(content)
    h = F.hex(F.substring(c, 1, 12))
    second = F.conv(F.substring(h, 3, 2), 16, 10).cast("int")
    riff = F.startswith(h, F.lit("52494646"))
    form = F.substring(h, 17, 8)
    image = (
        F.startswith(h, F.lit("FFD8FF"))
        | F.startswith(h, F.lit("89504E470D0A1A0A"))
        | F.startswith(h, F.lit("474946383761"))
        | F.startswith(h, F.lit("474946383961"))
        | (riff & (form == "57454250"))
    )
    media = (
        F.startswith(h, F.lit("494433"))
        | (F.startswith(h, F.lit("FF")) & (second >= 224))
        | (riff & (form == "57415645"))
        | F.startswith(h, F.lit("4F676753"))
        | F.startswith(h, F.lit("664C6143"))
        | (F.substring(h, 9, 8) == "66747970")
        | F.startswith(h, F.lit("1A45DFA3"))
    )
    return F.when(F.coalesce(F.length(c), F.lit(0)) < 12, "").when(image, "image").when(media, "media").otherwise("")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their kind; the bytes themselves are not kept."""
    return spark.read.format("binaryFile").load(path).select("path", "length", file_kind("content").alias("kind"))


def check_uploads(uploads: DataFrame) -> DataFrame:
    """Accept uploads whose kind is the wanted one (``wanted``: image or media)."""
    return uploads.withColumn("accepted", (F.col("kind") != "") & (F.col("kind") == F.col("wanted")))
