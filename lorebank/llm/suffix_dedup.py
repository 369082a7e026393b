"""Removal of repeated substrings by suffix arrays.

A byte is removed if it lies in a string of ``length`` bytes that also starts at another place of the corpus. Strings never cross
documents; all are judged on the input. The work goes in shards whose suffix arrays are small enough for one task:

* Anchors. In every window of ``length`` bytes the k-gram with the smallest hash is its anchor (k = ``length`` * 8 / 25), so
  equal windows have equal anchors at equal places. Consecutive windows with one anchor are a run; its bytes
  are the run's context. Windows whose anchor occurs once in the corpus cannot repeat.
* Equal contexts are counted before anything is sorted: of hot passages and exact copies one context is left. All windows
  of a context that occurs twice repeat. Contexts that share their anchor with a different context go on to the shards.
* Shards hold all contexts of their anchors. A shard's suffix array is refined by Larsson-Sadakane doubling in numpy (only groups
  that are still equal are sorted again, until all are apart or at their contexts' ends). Kasai's pass over it gives the bytes that neighbours share. A window
  repeats if it shares ``length`` bytes with a neighbour.
* An anchor with more contexts than a shard may hold is cut into several shards; each pair of them is merged by binary search of
  the windows of one in the suffix array of the other.

Contexts count as equal when two hashes of 64 bits (of the anchor by a polynomial, of the context by a mixing permutation) and their lengths agree; a context has
less than two times ``length`` bytes. Very long texts are cut into overlapping stretches; a text that repeats one byte has a context at every byte.

Defined cases: null text is empty; texts under ``length`` bytes keep everything; repeated rows remove each other; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import stored
from lorebank.llm.words import CHUNK, _BYTE, _powers, mix64, text_slices, word_codes
from lorebank.session import shared_dir

LENGTH = 200
#: Bytes of context in a shard, and contexts of one anchor that stay together.
SHARD = 2 << 20
TOGETHER = 4096
_PLACE = np.uint64((1 << 22) - 1)


def gram(length: int) -> int:
    return length * 8 // 25


# -- anchors -----------------------------------------------------------------------------------


def runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``document, start, windows, anchor hash, context hash`` of each run, over the documents of one piece of text."""
    k, out = gram(length), []
    w = length - k + 1
    for a in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[a : a + CHUNK + length - 1]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:], dtype=np.uint64)
        n = len(part) - k + 1
        value = mix64((sums[k:] - sums[:-k]) * down[:n])
        low, span = (value & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while span * 2 <= w:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        where = (low & _PLACE).astype(np.int64)
        doc = np.searchsorted(offs, a + np.arange(len(where)), "right") - 1
        good = a + np.arange(len(where)) + length <= offs[doc + 1]
        first = good.copy()
        first[1:] &= ~good[:-1] | (where[1:] != where[:-1])
        begin = np.flatnonzero(first)
        last = np.flatnonzero(good & np.append(~good[1:] | first[1:], True)) + 1
        end = last - 1 + length
        context = word_codes(part, begin, end, lower=False, long=4 * length)
        out.append((doc[begin], a + begin - offs[doc[begin]], last - begin, value[where[begin]].view(np.int64), context.view(np.int64)))
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate(kinds))


# -- suffix arrays -----------------------------------------------------------------------------


class Suffixes:
    """Contexts laid end to end, each closed by a zero; bytes are raised by one so that ends sort first."""

    def __init__(self, contexts: list[bytes], length: int):
        size = np.array([len(c) for c in contexts], np.int64)
        self.length, self.begin = length, np.concatenate([[0], np.cumsum(size + 1)])
        self.text = np.zeros(int(self.begin[-1]) + length + 8, np.uint16)
        body = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8).astype(np.uint16) + 1
        self.text[: len(body)] = body
        self.text[self.begin[1:] - 1] = 0
        self.stop = np.repeat(self.begin[1:] - 1, size + 1)  # the closing zero of each position's context
        raw = np.zeros(len(self.text) + 8, np.uint8)
        raw[: len(body)] = body - 1
        self.eight = np.ndarray((len(self.text),), "<u8", raw, 0, (1,))  # the eight bytes from each position
        self.order = self._refine()

    def _refine(self) -> np.ndarray:
        """Positions in the order of their whole suffixes; what is equal up to the contexts' ends stays in the order of the contexts."""
        n = int(self.begin[-1])
        key = np.zeros(n, np.uint64)
        alive = np.ones(n, bool)
        h = 7
        for j in range(h):  # seven symbols of nine bits; nothing counts behind a context's end
            symbol = self.text[j : j + n].astype(np.uint64)
            alive &= symbol > 0
            key = key << np.uint64(9) | np.where(alive, symbol, 0)
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            # places of the order in groups that are not yet split and whose members have symbols left
            at = np.flatnonzero(~(new & np.append(new[1:], True)))
            at = at[order[at] + h <= self.stop[order[at]]]
            if not len(at):
                return order
            p = order[at]
            pair = rank[p] * (n + 1) + rank[p + h] + 1
            turn = np.argsort(pair, kind="stable")
            order[at], pair = p[turn], pair[turn]
            split = np.ones(len(at), bool)
            split[1:] = pair[1:] != pair[:-1]
            new[at] |= split
            rank[order[at]] = at[np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))]
            h *= 2

    def common_prefixes(self) -> np.ndarray:
        """How many bytes each position shares with its predecessor in the order, by Kasai's rule: a position shares at least one byte less than the position
        in front of it. Contexts are walked side by side, from their first positions on, and compared eight bytes at a time."""
        n = len(self.order)
        before = np.full(n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        prefix = np.zeros(n, np.int64)
        size = np.diff(self.begin) - 1
        turn = np.argsort(-size, kind="stable")
        begin, size = self.begin[:-1][turn], size[turn]
        walking = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        shared = np.zeros(len(begin), np.int64)
        for j, m in enumerate(walking.tolist()):  # the contexts that have a position j
            p = begin[:m] + j
            q = before[p]
            room = np.where(q >= 0, np.minimum(self.stop[p] - p, self.stop[q] - q), 0)
            shared = np.minimum(np.maximum(shared[:m] - 1, 0), room)
            live = np.flatnonzero(shared < room)
            while len(live):
                differ = self.eight[p[live] + shared[live]] ^ self.eight[q[live] + shared[live]]
                equal = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3  # whole bytes below the lowest different bit
                shared[live] = np.minimum(shared[live] + equal, room[live])
                live = live[(differ == 0) & (shared[live] < room[live])]
            prefix[p] = shared
        return prefix

    def repeats(self, windows: np.ndarray) -> list[np.ndarray]:
        """Per context which of its first ``windows`` positions share ``length`` bytes with a neighbour in the order, hence with any other position."""
        far = self.common_prefixes() >= self.length
        flags = far.copy()
        flags[self.order[:-1]] |= far[self.order[1:]]
        return [flags[b : b + w] for b, w in zip(self.begin[:-1].tolist(), windows.tolist())]

    def find(self, other: Suffixes, windows: np.ndarray) -> list[np.ndarray]:
        """Which windows of ``other`` occur here, by binary search of all of them at once."""
        starts = np.concatenate([b + np.arange(w) for b, w in zip(other.begin[:-1], windows)]) if len(windows) else np.zeros(0, np.int64)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        found = np.zeros(len(starts), bool)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            p, q = starts[open_], self.order[mid]
            live, less = np.arange(len(open_)), np.zeros(len(open_), bool)
            for j in range(self.length):
                a, b = other.text[p[live] + j], self.text[q[live] + j]
                less[live[b < a]] = True
                live = live[(a == b) & (a > 0)]
                if not len(live):
                    break
            found[open_[live]] = True
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            low[open_[live]] = high[open_[live]]
        return np.split(found, np.cumsum(windows)[:-1]) if len(windows) else []


def _covers(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Begin and end of the bytes covered by the flagged windows, in ascending order."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge > 0).tolist(), (np.flatnonzero(edge < 0) - 1 + length).tolist()


# -- the job -----------------------------------------------------------------------------------

COVER = "anchor long, context long, windows int, begins array<int>, ends array<int>"


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """``rid, doc_id, text`` bucketed and sorted by ``rid``: one shuffle of the texts, none for the later joins; and the table's name."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = f"lb_suffix_{uuid.uuid4().hex}"
    out = rows.repartition(parts, "rid").write.bucketBy(parts, "rid").sortBy("rid").option("compression", "zstd")
    out.option("path", shared_dir(spark, "llm-suffix-texts")).saveAsTable(name)
    return spark.table(name), name


def _find_runs(texts: DataFrame, length: int) -> DataFrame:
    names = ["rid", "starts", "windows", "anchors", "contexts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column("text")):
                doc, *columns = runs(data, offs, length)
                cut = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
                lists = [pa.ListArray.from_arrays(cut, pa.array(c).cast(kind)) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("rid")[a:b], *lists], names)

    return texts.select("rid", "text").mapInArrow(run, "rid long, starts array<int>, windows array<int>, anchors array<long>, contexts array<long>")


def _context_bytes(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (anchor, context, windows, rid, start, ...) with ``bytes``; a text's list is bounded by its length."""
    keys = [c for c in wanted.columns if c not in ("rid", "start")]
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", *keys)).alias("cuts"))
    joined = texts.select("rid", "text").join(lists, "rid")
    schema = wanted.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (text, cuts) in enumerate(zip(batch.column("text"), batch.column("cuts"))):
                raw, flat = text.as_py().encode(), cuts.values
                spans = zip(flat.field("start").to_pylist(), flat.field("windows").to_pylist())
                parts = pa.array([raw[s : s + w + length - 1] for s, w in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in keys), parts], [*keys, "bytes"])

    return joined.select("text", "cuts").mapInArrow(run, schema.add("bytes", "binary"))


def _cover_table(t: pa.Table, flags: list[np.ndarray], length: int) -> pa.Table:
    keep = np.array([f.any() for f in flags], bool)
    spans = [_covers(f, length) for f in flags if f.any()]
    rows = t.select(["anchor", "context", "windows"]).filter(pa.array(keep))
    begins, ends = (pa.array([s[i] for s in spans], pa.list_(pa.int32())) for i in (0, 1))
    return rows.append_column("begins", begins).append_column("ends", ends)


def repeated_windows(contexts: DataFrame, shards: int, length: int) -> DataFrame:
    """Covers of the windows that repeat within or across ``contexts`` (anchor, context, windows, pieces, bytes), all different.

    ``pieces`` is the number of shards that the context's anchor is cut into.
    """

    def within(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flags = Suffixes(t["bytes"].to_pylist(), length).repeats(np.array(t["windows"], np.int64))
        return _cover_table(t, flags, length)

    def across(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not len(left) or not len(right):
            return _cover_table(left.slice(0, 0), [], length)
        a, b = (Suffixes(t["bytes"].to_pylist(), length) for t in (left, right))
        found = _cover_table(left, b.find(a, np.array(left["windows"], np.int64)), length)
        return pa.concat_tables([found, _cover_table(right, a.find(b, np.array(right["windows"], np.int64)), length)])

    piece = F.pmod(F.xxhash64("context", "windows"), F.col("pieces")).cast("int")
    dealt = contexts.withColumn("piece", F.when(F.col("pieces") > 1, piece).otherwise(0))
    shard = F.when(F.col("pieces") > 1, F.xxhash64("anchor", "piece")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    own = dealt.withColumns({"large": F.col("pieces") > 1, "shard": shard}).groupBy("large", "shard").applyInArrow(within, COVER)
    # pairs of shards of one anchor: each context meets every other shard of its anchor
    large = dealt.where("pieces > 1").withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int")))).where("other <> piece")
    large = large.withColumns({"lo": F.least("piece", "other"), "hi": F.greatest("piece", "other")})
    keys = ["anchor", "lo", "hi"]
    merged = large.where("piece = lo").groupBy(*keys).cogroup(large.where("piece = hi").groupBy(*keys)).applyInArrow(across, COVER)
    return own.unionByName(merged)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, str]:
    """Texts (rid, doc_id, text), ``rid, spans``: per text the covers of its repeated windows, not yet merged, and the table of the texts, to be dropped."""
    texts, name = _texts(docs)
    found = stored(_find_runs(texts, length), "suffix-runs")
    often = found.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    each = found.select("rid", F.inline(F.arrays_zip("starts", "windows", "anchors", "contexts"))).withColumnsRenamed({"starts": "start", "anchors": "anchor", "contexts": "context"})
    places = stored(each.join(often, "anchor", "left_semi"), "suffix-places")

    kinds = places.groupBy("anchor", "context", "windows").agg(F.count("*").alias("n"), F.min(F.struct("rid", "start")).alias("at"))
    kinds = stored(kinds.select("anchor", "context", "windows", "n", "at.rid", "at.start"), "suffix-contexts")
    contested = kinds.groupBy("anchor").agg(F.count("*").alias("different")).where("different > 1")
    pieces = F.ceil(F.col("different") / TOGETHER).cast("int")
    wanted = kinds.join(contested.select("anchor", pieces.alias("pieces")), "anchor").drop("n")
    contexts = stored(_context_bytes(texts, wanted, length), "suffix-bytes")
    size = contexts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    partly = repeated_windows(contexts, max(1, size // SHARD), length)
    wholly = kinds.where("n > 1").select("anchor", "context", "windows", F.array(F.lit(0)).alias("begins"), F.array((F.col("windows") + length - 1).cast("int")).alias("ends"))
    covers = partly.unionByName(wholly).groupBy("anchor", "context", "windows")
    covers = stored(covers.agg(F.flatten(F.collect_list(F.arrays_zip("begins", "ends"))).alias("covers")), "suffix-covers")
    hit = places.join(covers, ["anchor", "context", "windows"])
    moved = F.transform("covers", lambda c: F.struct((c["begins"] + F.col("start")).alias("a"), (c["ends"] + F.col("start")).alias("b")))
    spans = hit.groupBy("rid").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    return texts, spans, name


def deduplicate(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, with the kept bytes and removed spans if ``with_text``."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
    names = names + ["kept", "removed"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                raw, merged = text.as_py().encode(), []
                if spans.is_valid:
                    a, b = (spans.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                    turn = np.argsort(a, kind="stable")
                    a, b = a[turn], np.maximum.accumulate(b[turn])
                    new = np.append(True, a[1:] > b[:-1])
                    merged = list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)].tolist()))
                at, kept = 0, []
                for x, y in merged:
                    kept.append(raw[at:x])
                    at = y
                body = b"".join([*kept, raw[at:]])
                row = [doc.as_py(), len(raw), len(raw) - len(body), len(merged), hashlib.sha256(body).hexdigest(), body, [z for s in merged for z in s]]
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    texts, spans, name = repeated_spans(docs, length)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<long>" * with_text
    out = stored(texts.join(stored(spans, "suffix-spans"), "rid", "left").select("doc_id", "text", "spans").mapInArrow(run, schema), "suffix-result")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out
