"""Exact dedup against a history: minimal perfect hash over the history's distinct digests.

The digest of a document is the SHA-256 of its text with each run of ASCII white space made one
space. History digests are dealt to buckets by digest; each bucket gets one minimal perfect hash (levels
of collision-free bits, slot = rank of the bit) and slots that hold the full digest, the locator of the winning
row and the number of rows. A batch is first reduced to its distinct digests; each looks up its slot and
compares all 32 bytes, because a minimal perfect hash sends foreign digests to some slot too. Members
join the group of the history; all others form groups of their own.

Defined cases: null text counts as empty. The winner is the row with the smallest doc_id, null ids last;
of repeated rows with that id exactly one is kept. Groups whose ids are all null have a null keep_id. An empty
history, batch or table gives an index or result without rows. Texts of any length are digested whole. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import SPACE, keep_rows, stored

#: Distinct digests per bucket, so that a bucket's slots are a few megabytes.
BUCKET = 50_000
#: Bits per key on each level; more bits, fewer levels.
GAMMA = 2.0

INDEX = "bucket long, level_sizes array<int>, bits binary, digests binary, ids array<long>, rids array<long>, sizes array<long>"
GROUP = "digest binary, keep_id long, keep_rid long, group_size long"


# -- minimal perfect hash over 32-byte digests -------------------------------------------------


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the digests (n x 4 unsigned 64-bit) fall on a level of ``size`` bits."""
    h = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def mph_build(words: np.ndarray) -> list[np.ndarray]:
    """Levels of bits; a set bit belongs to exactly one of the distinct keys."""
    levels, rest = [], words
    while len(rest):
        size = max(8, int(GAMMA * len(rest)))
        at = _positions(rest, len(levels), size)
        single = np.bincount(at, minlength=size) == 1
        levels.append(single)
        rest = rest[~single[at]]
    return levels


def mph_slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Slot of each key, 0 to n-1; any slot or -1 for a key that was not built in."""
    slots, rest, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        if not len(rest):
            break
        at = _positions(words[rest], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        slots[rest[hit]] = base + rank[at[hit]]
        base += int(rank[-1]) + 1
        rest = rest[~hit]
    return slots


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    """Column of 32-byte digests as n x 4 unsigned integers."""
    raw = b"".join(digests.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 4)


# -- tables ------------------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, rid, digest`` per row, stored; ``rid`` is unique and fixed by the stored table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), digest(F.col("text")).alias("digest"))
    return stored(rows, "digests")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: winner and count, combined before the shuffle, so that hot texts collapse."""
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")
    g = rows.groupBy("digest").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    return g.select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.rid").alias("rid"), "n")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with its hash function and slots; ``history`` as ``distinct_digests`` gives it."""

    def build(t: pa.Table) -> pa.Table:
        words = _words(t["digest"])
        levels = mph_build(words)
        order = np.argsort(mph_slots(levels, words))
        t = t.take(order)
        bits = np.packbits(np.concatenate([*levels, np.zeros(0, bool)])).tobytes()
        row = {"bucket": t["bucket"][0].as_py(), "level_sizes": [len(x) for x in levels], "bits": bits, "digests": words[order].tobytes()}
        row |= {"ids": t["doc_id"].to_pylist(), "rids": t["rid"].to_pylist(), "sizes": t["n"].to_pylist()}
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(row.items(), kinds)})

    keyed = history.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(build, INDEX)


def look_up(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """All groups of history and batch together; ``batch`` as ``distinct_digests`` gives it."""

    def match(slots: pa.Table, new: pa.Table) -> pa.Table:
        words = _words(new["digest"])
        ids, rids, sizes, digests = [], [], np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
        member = np.zeros(len(words), bool)
        if len(slots):
            row = slots.to_pylist()[0]
            cuts = np.cumsum(row["level_sizes"])
            flat = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(cuts[-1])).astype(bool)
            at = mph_slots(np.split(flat, cuts[:-1]), words)
            digests = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
            member = (at >= 0) & (digests[at] == words).all(axis=1)  # all 32 bytes
            ids, rids, sizes = row["ids"], row["rids"], np.array(row["sizes"], np.int64)
            for s, i, r, n in zip(at[member].tolist(), *(new[c].filter(pa.array(member)).to_pylist() for c in ("doc_id", "rid", "n"))):
                sizes[s] += n
                if (i is None, i or 0, r) < (ids[s] is None, ids[s] or 0, rids[s]):
                    ids[s], rids[s] = i, r
        alone = new.filter(pa.array(~member))
        return pa.table({
            "digest": pa.array([d.tobytes() for d in digests] + alone["digest"].to_pylist(), pa.binary()),
            "keep_id": pa.array(ids + alone["doc_id"].to_pylist(), pa.int64()),
            "keep_rid": pa.array(rids + alone["rid"].to_pylist(), pa.int64()),
            "group_size": pa.array(sizes.tolist() + alone["n"].to_pylist(), pa.int64()),
        })

    keyed = batch.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return index.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(match, GROUP)


def exact_groups(rows: DataFrame, is_history: Column) -> DataFrame:
    """``doc_id, rid, digest, keep_id, group_size, kept`` per row of ``digest_rows``.

    ``is_history`` tells which rows are the known past, on whose digests the index is built; the others are the new
    batch. The split changes the route of a row, never the result. Only groups of several rows are joined
    back, so unique texts meet nothing; the rows of a hot text are split by adaptive execution.
    """
    known = F.coalesce(is_history, F.lit(False))
    past = stored(distinct_digests(rows.where(known)), "history")
    buckets = max(1, -(-max(past.count(), 1) // BUCKET), -(-rows.count() // (4 * BUCKET)))
    index = stored(build_index(past, buckets), "mph-index")
    groups = look_up(index, distinct_digests(rows.where(~known)), buckets)
    several = stored(groups.where("group_size > 1"), "groups")
    out = rows.join(several.withColumn("grouped", F.lit(True)), "digest", "left")
    return out.select(
        "doc_id",
        "rid",
        "digest",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"),
    )


def earlier_half(rows: DataFrame) -> Column:
    """Rows whose id lies in the lower half of the id range: the older snapshot of a growing corpus."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.col("doc_id") <= (low + high) // 2


def dedup(docs: DataFrame) -> DataFrame:
    """Decision per row of ``docs``, the earlier half of the id range being the history."""
    rows = digest_rows(docs)
    return exact_groups(rows, earlier_half(rows))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    judged = dedup(docs)
    kept = judged.groupBy("doc_id", F.col("digest").alias("key")).agg(F.max("kept").alias("kept"), F.count("*").alias("n_same")).where("kept")
    return keep_rows(docs, stored(kept.drop("kept"), "kept"), digest(F.col("text")))
