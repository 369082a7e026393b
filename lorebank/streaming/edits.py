"""Edit coalescing: patches of a note that follow each other closely become one write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebank import constants as K


GAP_US = 700_000
SPLIT_US = 60_000_000


def coalesce_edit_stream(edits: DataFrame, fields: list[str], watermark: str, gap: str = K.EDIT_QUIET_GAP) -> DataFrame:
    """One merged patch per note and burst of a stream; in a burst the latest non-null value of each field wins.

    ``edits``: user_id, note_id, ts, seq and the nullable fields. Equal times order by ``seq``. Edits
    later than the watermark start a burst of their own.
    """
    order = F.struct("ts", "seq")
    return (
        edits.withWatermark("ts", watermark)
        .groupBy("user_id", "note_id", F.session_window("ts", gap).alias("burst"))
        .agg(
            F.count(F.lit(1)).alias("n_edits"),
            *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields],
        )
        .select("user_id", "note_id", F.col("burst.start").alias("first_edit"), F.col("burst.end").alias("due"), "n_edits", *fields)
    )


def coalesce_edits(edits: DataFrame, fields: list[str], gap_us: int = GAP_US, split_us: int = SPLIT_US) -> DataFrame:
    """The same for a table, with the edits of a note cut by the minute.

    Bursts are found inside each (note, minute). Only the first and last burst of a minute can continue
    in a neighbouring one; these few rows meet per note, all others are final. A note with a third of
    all edits is thus sorted minute by minute, in parallel.
    """
    note = ["user_id", "note_id"]
    us = F.unix_micros("ts")
    cut = edits.withColumns({"_us": us, "_part": F.floor(us / split_us)})
    part = [*note, "_part"]
    order = F.struct("_us", "seq")

    def numbered(df: DataFrame, keys: list[str], start: str, stop: str, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*by)
        apart = F.coalesce(F.col(start) - F.lag(stop).over(w) > gap_us, F.lit(True))
        return df.withColumn("_new", apart.cast("int")).withColumn("_burst", F.sum("_new").over(w))

    inside = (
        numbered(cut, part, "_us", "_us", ["_us", "seq"])
        .groupBy(*part, "_burst")
        .agg(
            F.min("_us").alias("_first"),
            F.max("_us").alias("_last"),
            F.count(F.lit(1)).alias("n_edits"),
            *[F.max(F.when(F.col(f).isNotNull(), F.struct(order.alias("o"), F.col(f).alias("v")))).alias(f) for f in fields],
        )
        .withColumn("_most", F.max("_burst").over(Window.partitionBy(*part)))
    )
    edge = (F.col("_burst") == 1) | (F.col("_burst") == F.col("_most"))
    met = (
        numbered(inside.where(edge).drop("_burst"), note, "_first", "_last", ["_first"])
        .groupBy(*note, "_burst")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("n_edits").alias("n_edits"), *[F.max(f).alias(f) for f in fields])
    )
    columns = [*note, "_first", "_last", "n_edits", *fields]
    return inside.where(~edge).select(*columns).unionByName(met.select(*columns)).select(
        *note,
        F.timestamp_micros("_first").alias("first_edit"),
        F.timestamp_micros(F.col("_last") + gap_us).alias("due"),
        "n_edits",
        *[F.col(f"{f}.v").alias(f) for f in fields],
    )
