"""Shards of near equal bytes by sampled splitters.

Every record has a key (MD5 of its text, then doc_id, then row locator). A size-weighted sample of keys gives
quantile splitters; records are ranged by them, ranges that turn out overfull are drawn and split again.
Range totals are a table of a few thousand rows, from which every range knows how many bytes and records lie before
it; inside its range a record finds its own offset. Offsets are exact, so the sample decides how even the tasks are, never
the result: the shard of a record is its byte offset in key order, over the bytes per shard.

Equal texts are neighbours in key order. A group of equal texts goes whole to the shard in which it begins, unless
it holds over ``GROUP_SHARE`` of a shard's bytes: such a group is cut where a shard is full.

Defined cases: null text has size 1 and the checksum of the empty text; null ids sort last; repeated rows are separate
records; a very long text is one record, whatever its share of a shard; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebank.llm.common import stored

#: Ranges per shard, and sampled keys per range.
RANGES = 64
SAMPLES = 8
#: Largest share of a shard that a group of equal texts may hold and still stay whole.
GROUP_SHARE = 0.01
#: A range is overfull above so many times the mean.
OVERFULL = 4

Key = tuple[str, int, int, int]


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _sample(rows: DataFrame, keep: float) -> list[Key]:
    """Sorted keys, each drawn with probability size * ``keep`` (once at most), by a hash of the row."""
    draw = F.pmod(F.xxhash64("rid", "key", F.lit(keep)), F.lit(2**40)) < F.col("size") * keep * 2**40
    return sorted(tuple(r) for r in rows.where(draw).select("key", "unknown", "ident", "rid").collect())


def _ranged(rows: DataFrame, splitters: list[Key], name: str) -> DataFrame:
    """Add ``name``: the number of splitters at or below the row's key."""

    @F.pandas_udf("int")
    def find(key: pd.Series, unknown: pd.Series, ident: pd.Series, rid: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splitters, k) for k in zip(key, unknown, ident, rid)], dtype="int32")

    return rows.withColumn(name, find("key", "unknown", "ident", "rid"))


def _splitters(rows: DataFrame, total: int, parts: int) -> list[Key]:
    """``parts - 1`` quantiles at most of a size-weighted sample of about ``parts * SAMPLES`` keys."""
    drawn = _sample(rows, parts * SAMPLES / total)
    return sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []


def split_ranges(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``range``, an integer in key order, such that no range is much above the mean.

    The driver sees the sample (about ``shards * RANGES * SAMPLES`` keys) and the totals per range, both bounded by
    parameters. Overfull ranges get splitters of their own from a second sample, as many as their size asks for.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = shards * RANGES
    splitters = _splitters(rows, total, parts) if total else []
    sums = {r["range"]: r["bytes"] for r in _ranged(rows, splitters, "range").groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    mean = total / parts
    over = {k: b for k, b in sums.items() if b > OVERFULL * mean}
    if over:
        hot = _ranged(rows, splitters, "range").where(F.col("range").isin(list(over)))
        again = _sample(hot, SAMPLES / mean)
        inside: dict[int, list[Key]] = {}
        for k in again:
            inside.setdefault(bisect_right(splitters, k), []).append(k)
        for r, keys in inside.items():
            n = max(1, round(over[r] / mean))
            splitters = splitters + [keys[i * len(keys) // n] for i in range(1, n)]
        splitters = sorted(set(splitters))
    return _ranged(rows, splitters, "range")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        record_size(F.col("text")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("key"),
    )
    rows = stored(rows, "shard-keys").withColumns({"unknown": F.col("doc_id").isNull().cast("int"), "ident": F.coalesce("doc_id", F.lit(0))})
    ranged = stored(split_ranges(rows, shards), "shard-ranges")

    # per range: what lies before it; the table has a bounded number of rows
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("range").alias("at")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = Window.partitionBy()
    totals = totals.select("at", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("bytes").over(whole).alias("total"))

    order = Window.partitionBy("range").orderBy("key", "unknown", "ident", "rid")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({"inner": F.coalesce(F.sum("size").over(running), F.lit(0)), "nth": F.row_number().over(order) - 1})
    placed = placed.join(F.broadcast(totals), placed["range"] == totals["at"]).withColumns({"offset": F.col("base") + F.col("inner"), "position": F.col("first") + F.col("nth")})
    placed = stored(placed.select("doc_id", "rid", "size", "text_crc32", "key", "offset", "position", "total"), "shard-offsets")

    # where each group of equal texts begins, if it stays whole; other records count from their own offset
    groups = placed.groupBy(F.col("key").alias("group")).agg(F.min("offset").alias("begin"), F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("total").alias("all"))
    groups = stored(groups.where((F.col("n") > 1) & (F.col("bytes") * shards <= F.col("all") * GROUP_SHARE)).select("group", "begin"), "shard-groups")
    placed = placed.join(groups, placed["key"] == groups["group"], "left")
    at = F.coalesce(F.col("begin"), F.col("offset"))
    number = F.floor(at * shards / F.col("total")).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", F.least(number, F.lit(shards - 1)).alias("shard"), "position"), "shard-numbers")
    firsts = placed.groupBy(F.col("shard").alias("of")).agg(F.min("position").alias("start"))  # one row per shard
    out = placed.join(F.broadcast(firsts), placed["shard"] == firsts["of"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("start")).alias("slot"))

