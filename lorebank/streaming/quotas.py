"""Request quotas audited from a request log or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K

_UNITS = {"second": 1, "minute": 60, "hour": 3600}


def _seconds(window: str) -> int:
    n, unit = window.split()
    return int(n) * _UNITS[unit.removesuffix("s")]


def _by_kind(values: dict, kind: Column) -> Column:
    """The kind's value; null for an unknown kind."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.coalesce(kind, F.lit("")))


def quota_windows(requests: DataFrame, quotas=None, watermark: str | None = None) -> DataFrame:
    """Requests per key, kind and window with their limit. ``requests``: key, kind, ts.

    Windows are tumbling and of the length of the kind's quota. Requests of unknown kinds are counted too, in the longest
    window, without a quota and never over it. A log is read once and grouped once: each row is given its own window, so
    counts combine before the shuffle even for a very busy key. On a stream (``watermark``) there is one event-time aggregation
    per window length instead, because only such windows let their state expire.
    """
    quotas = quotas or K.QUOTAS
    limits, lengths = {k: n for k, (n, _) in quotas.items()}, {k: _seconds(w) for k, (_, w) in quotas.items()}
    longest = max(lengths.values())
    length = F.coalesce(_by_kind(lengths, F.col("kind")), F.lit(longest))
    if watermark:
        source, parts = requests.withWatermark("ts", watermark), []
        for n in sorted(set(lengths.values())):
            grouped = source.where(length == n).groupBy("key", "kind", F.window("ts", f"{n} seconds").alias("w"))
            parts.append(grouped.agg(F.count(F.lit(1)).alias("n")).select("key", "kind", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    else:
        size = length * 1_000_000
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        rows = requests.select("key", "kind", (us - F.pmod(us, size)).alias("begin"), size.alias("size"))
        counts = rows.groupBy("key", "kind", "begin", "size").agg(F.count(F.lit(1)).alias("n"))
        out = counts.select("key", "kind", F.timestamp_micros("begin").alias("window_start"), F.timestamp_micros(F.col("begin") + F.col("size")).alias("window_end"), "n")
    quota = _by_kind(limits, F.col("kind"))
    return out.withColumns({"quota": quota, "over": F.coalesce(F.col("n") > quota, F.lit(False))})
