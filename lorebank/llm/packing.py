"""Packing documents into fixed-length sequences by minimum bin slack.

Only lengths matter for packing, and there are at most ``capacity`` of them. One distributed count gives the histogram; on it the
plan is made bin by bin: the longest remaining piece opens the bin, a bitset subset-sum over the available lengths finds the
fullest feasible combination for the rest, and the combination is removed, as many times as the counts allow at once. The
plan is a few thousand (length, first rank, sequence, offset) entries whatever the number of documents. Every
piece then learns its rank among pieces of its length and from it its sequence and offset; equal lengths are ranked in salted groups, so that no
length is one task.

Token ids are those of the byte-level BPE vocabulary, computed by the ``tiktoken`` library from the same vocabulary as ranks;
they equal the ``tokenizers`` library's and cost a fifth (the README has figures). A document is its ids and
an end id. Longer documents are cut into full pieces, the first piece takes the remainder.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorebank.llm.common import stored

CAPACITY = 2048
END = 0
#: Pieces of one length that are ranked together in one task.
RANKED = 200_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file; special strings are ids of their own, as the vocabulary has them."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_ids(enc, text: str | None) -> np.ndarray:
    ids = enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
    return np.append(ids, END).astype("<u4")


def cut_points(n: int, capacity: int) -> list[int]:
    """Begin of each piece: one if it fits, else full pieces behind a first one that may be shorter."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, rid, piece, start, length, ids_crc32`` (and ``ids``) of every document."""
    names = ["doc_id", "rid", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, rid, text in zip(*(batch.column(c) for c in ("doc_id", "rid", "text"))):
                ids = token_ids(enc, text.as_py())
                at = cut_points(len(ids), capacity)
                for n, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
                    part = ids[a:b]
                    row = [doc.as_py(), rid.as_py(), n, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int32)]
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), "text")
    schema = "doc_id long, rid long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return stored(rows.mapInArrow(run, schema), "pieces")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, how many) of the fullest combination in ``room``; ``lengths`` descend.

    Bit r of ``reach`` says that r can be filled exactly. Counts are added by doubling, one shift each; the bitsets
    after every step are kept to walk back.
    """
    reach, mask, steps, full = 1, (1 << (room + 1)) - 1, [], 1 << room
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            grown = (reach | reach << (n * k)) & mask
            if grown != reach:
                steps.append((reach, n, k))
                reach = grown
            left, k = left - k, k * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for before, n, k in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= n * k
    return list(used.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, pieces per sequence, offset) that place every piece."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts, reverse=True)
    taken = dict.fromkeys(lengths, 0)
    entries, sequence = [], 0
    while lengths:
        lead = lengths[0]
        counts[lead] -= 1
        combo = dict(fullest(counts, lengths, capacity - lead))
        counts[lead] += 1
        combo[lead] = combo.get(lead, 0) + 1
        times = min(counts[n] // k for n, k in combo.items())
        offset = 0
        for n in sorted(combo, reverse=True):
            k = combo[n]
            entries.append((n, taken[n], times, sequence, k, offset))
            taken[n] += k * times
            counts[n] -= k * times
            offset += n * k
        sequence += times
        lengths = [n for n in lengths if counts[n]]
    return np.array(sorted(entries), np.int64).reshape(-1, 6)


def ranked(parts: DataFrame, most: int) -> DataFrame:
    """``parts`` with ``rank``, gapless from 0 within each length; ``most`` is the largest count of a length."""
    salts = 1 + most // RANKED
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("rid", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("of"), F.col("salt").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("rid", "piece")
    nth = salted.withColumn("nth", F.row_number().over(order) - 1)
    return nth.join(starts, (nth["length"] == starts["of"]) & (nth["salt"] == starts["in"])).withColumn("rank", F.col("base") + F.col("nth"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece."""
    parts = pieces(docs, path, capacity, with_ids)
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    entries = plan(histogram, capacity)
    keys = (entries[:, 0] << 44) | entries[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = entries[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            turn, nth = np.divmod(rank - at[:, 1], at[:, 4])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at[:, 3] + turn), pa.array(at[:, 5] + nth * length)], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked(parts, max(histogram.values(), default=0)).select(*names, "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids`` from ``pack(..., with_ids=True)``; a sequence holds ``capacity`` ids at most."""
    piece = F.struct("offset", "ids", "doc_id")
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("all"))
    return grouped.select("sequence_id", F.flatten("all.ids").alias("ids"), F.col("all.doc_id").alias("doc_ids"))
