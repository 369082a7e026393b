"""Near-duplicate documents by circulant MinHash, banding and exact verification on full shingle sets.

Shingles are five consecutive words, A-Z lower-cased; a shorter document is one sequence. Shingle hashes go through a first
permutation; a second permutation, shifted by k, gives signature coordinate k, so two permutations generate all
coordinates. Coordinates are banded; documents that share a band meet. All similarities that count are computed on
the full sets: ``100 * |A n B| >= 75 * |A u B|``.

Documents with equal sets are one node. Nodes that share bands are compared in rounds, and pairs whose ends are already
connected are never compared, so a group of thousands of near copies costs a few stars, not all its pairs. A node's weight is the number of
nodes that it meets over all bands: the original of many edited copies is heavier than the copies.

1. every node against the heaviest node that it shares any band with;
2. in each band bucket that holds several components, every node against the bucket's heaviest node;
3. the same against a random node of the bucket's largest component;
4. in each bucket that still holds several components, all nodes against all nodes of other components. Buckets of up to ``SMALL`` nodes are
   joined with themselves. Larger ones (texts that share a passage, copies edited too much) are compared inside tasks, block against
   block: pairs whose signatures agree in a share of ``AGREE``, one byte a coordinate, are verified on their full sets right there, and a
   task returns a spanning forest of the links that it finds, never more rows than it was given.

The banding misses a pair of similarity 0.75 with probability ``(1 - 0.75^ROWS)^BANDS`` (5e-5 in the worst case, nothing above 0.85), the
comparison of signatures with less than 1e-8; links between other members of a group usually mend such a miss. Nothing else is approximate.

Defined cases: null or empty texts and texts of white space have the empty set, no links, and are their own component;
repeated rows and equal sets are one component; null ids never name a component unless all its ids are null. Very long texts are hashed
whole. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import keep_rows, stored
from lorebank.llm.graph import components
from lorebank.llm.words import SLICE, find_words, mix64, shingle_sets, text_slices, word_codes

WIDTH = 5
ROWS = 6
BANDS = 50
PERCENT = 75
#: Buckets that are joined with themselves; rows and shingles of a block in larger ones, and the share of coordinates that must agree there.
SMALL = 32
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
AGREE = 0.6

_SHIFT = np.uint32(0x9E3779B1)
#: Shingles hashed at once, so that the working arrays stay in a core's cache.
_STEP = 1024


def text_key(text: Column) -> Column:
    """128 bits that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def first_permutation(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes to the 32-bit universe of the second permutation."""
    return (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit numbers; the high bits, which decide a minimum, depend on all bits."""
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = ROWS * BANDS) -> np.ndarray:
    """One row of coordinates per set: the minimum of the second permutation after a circular shift by the coordinate's amount."""
    out = np.full((len(sets), coordinates), np.uint32(0xFFFFFFFF), np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32) * _SHIFT
    for i, s in enumerate(sets):
        place = first_permutation(s)
        for a in range(0, len(place), _STEP):
            part = second_permutation(place[None, a : a + _STEP] - shifts[:, None])
            np.minimum(out[i], part.min(axis=1), out=out[i])
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit key per band, different for equal values in different bands."""
    bands = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1), bands.shape[:2])
    for j in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for a, b, data, offs in text_slices(batch.column("text"), SLICE):
        starts, ends, first = find_words(data, offs)
        yield a, b, shingle_sets(word_codes(data, starts, ends), first, WIDTH)


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    return np.array([np.sum(mix64(s + place), dtype=np.uint64), np.sum(mix64(s ^ (place << np.uint64(20))) * (place | np.uint64(1)), dtype=np.uint64)]).tobytes()


def signature_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, rid, text_key, n_shingles, digest, bands`` per row, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch):
                bands = band_keys(signatures(sets))
                size = np.array([len(s) for s in sets], np.int64)
                cut = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
                flat = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bands[size > 0].ravel(), pa.int64()))
                kept = [batch.column(c)[a:b] for c in ("doc_id", "rid", "text_key")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array([_digest(s) for s in sets], pa.binary()), flat], ["doc_id", "rid", "text_key", "n_shingles", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text_key(F.col("text")).alias("text_key"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, rid long, text_key binary, n_shingles long, digest binary, bands array<long>"), "signatures")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles, sketch`` for ``wanted`` (node, text_key): sets and signature bytes rebuilt from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets in _sets(batch):
                cut = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                flat = np.concatenate(sets).view(np.int64)
                sketch = pa.array([row.tobytes() for row in signatures(sets).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node")[a:b], pa.ListArray.from_arrays(cut, pa.array(flat)), sketch], ["node", "shingles", "sketch"])

    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(wanted.select("node", "text_key"), F.col("key") == F.col("text_key"))
    return texts.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node long, shingles array<long>, sketch binary")


def linked_in_blocks(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect different components within large buckets, verified on full sets.

    ``large`` has band, node, root, n, m and ``all_n``, the rows and shingles of the whole bucket. A bucket is cut into blocks; every
    pair of blocks is one group of bounded size. Within a group pairs of one component are skipped as components grow.
    """

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, block = t["node"].to_numpy(), t["block"].to_numpy()
        label = np.unique(t["root"].to_numpy(), return_inverse=True)[1]
        bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(t), -1)
        lists = t["shingles"].chunk(0)
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        token = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        size, one = np.diff(at), t["lo"][0].as_py() == t["hi"][0].as_py()
        place, top = np.arange(len(t)), np.bincount(label).argmax()
        rest, marked, found = label != top, np.zeros(len(token) + 1, bool), []
        for i in np.flatnonzero(rest).tolist():
            # two nodes outside the largest component meet once, in their order
            other = np.flatnonzero((label != label[i]) & ((block == block[i]) == one) & (~rest | (place > i)))
            other = other[PERCENT * np.maximum(size[i], size[other]) <= 100 * np.minimum(size[i], size[other])]
            other = other[(bits[other] == bits[i]).mean(axis=1) >= AGREE] if len(other) else other
            if not len(other):
                continue
            marked[token[at[i] : at[i + 1]]] = True
            flat = np.repeat(at[other] - np.concatenate([[0], np.cumsum(size[other])[:-1]]), size[other]) + np.arange(size[other].sum())
            both = np.add.reduceat(marked[token[flat]].astype(np.int64), np.concatenate([[0], np.cumsum(size[other])[:-1]]))
            marked[token[at[i] : at[i + 1]]] = False
            for j in other[100 * both >= PERCENT * (size[i] + size[other] - both)].tolist():
                if label[j] != label[i]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    label[label == label[i]] = label[j]
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    rows = large.join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return rows.select("band", "lo", "hi", "block", "node", "root", "sketch", "shingles").groupBy("band", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Each side is a plain join; hot nodes are split by AQE."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * inter >= PERCENT * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def _fits(a: str, b: str) -> Column:
    """Sets of such sizes can reach the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, rid, text_key, n_shingles, component_id, kept`` per row of ``docs``."""
    rows = signature_rows(docs)
    known = rows.where("n_shingles > 0")
    same = known.groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    same = stored(same, "set-classes")
    member = same.select("node", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("all_n")).where("m > 1")
    buckets = stored(member.join(shared, "band"), "buckets")
    weight = stored(buckets.groupBy("node").agg(F.sum("m").alias("weight")), "weights")
    buckets = stored(buckets.join(weight, "node"), "weighted")
    # the sets of all nodes that meet another one, rebuilt once
    sets = stored(full_sets(docs, same.join(weight, "node", "left_semi")), "shingle-sets")
    size = same.select(F.col("node").alias("p"), F.col("n").alias("np"))
    ordered = [F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")]

    heaviest = F.max(F.struct("weight", "node"))
    pivots = buckets.groupBy("band").agg(heaviest.alias("top"))
    best = buckets.join(pivots, "band").where(F.col("top.node") != F.col("node")).groupBy("node", "n").agg(F.max("top").alias("top"))
    pairs = stored(best.select("node", "n", F.col("top.node").alias("p")).join(size, "p").where(_fits("np", "n")).select(*ordered).distinct(), "pairs-1")
    links = stored(similar(pairs, sets), "links-1")
    tried = pairs
    for step in (2, 3, 4):
        placed = buckets.join(components(links, "a", "b"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
        placed = stored(placed.join(several, "band"), f"open-{step}")
        if step < 4:
            if step == 3:
                parts = placed.groupBy("band", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("band", "node"), "node", "weight")).alias("any"))
                pivots = parts.groupBy("band").agg(F.max_by("any", F.struct("c", "root")).alias("top"), F.max_by("root", F.struct("c", "root")).alias("top_root"))
            else:
                pivots = placed.groupBy("band").agg(heaviest.alias("top"), F.max_by("root", F.struct("weight", "node")).alias("top_root"))
            star = placed.join(pivots, "band").where(F.col("top_root") != F.col("root")).select("node", "n", F.col("top.node").alias("p")).distinct()
            fresh_pairs = star.join(size, "p").where(_fits("np", "n")).select(*ordered).distinct()
        else:
            few, many = placed.where(F.col("m") <= SMALL), placed.where(F.col("m") > SMALL)
            other = few.select("band", F.col("node").alias("p"), F.col("root").alias("rp"), F.col("n").alias("np"))
            near = few.join(other, "band").where((F.col("p") < F.col("node")) & (F.col("rp") != F.col("root")) & _fits("np", "n"))
            fresh_pairs = near.select(*ordered).distinct()
            links = links.unionByName(stored(linked_in_blocks(many, sets), "links-large"))
        pairs = stored(fresh_pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{step}")
        more = stored(similar(pairs, sets), f"links-{step}")
        links, tried = links.unionByName(more), tried.unionByName(pairs)

    roots = components(links, "a", "b")
    ends = same.select("digest", "node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = ends.groupBy("root").agg(F.min("low").alias("component_id"))
    ends = stored(ends.join(names, "root").select("digest", "root", "component_id"), "components")
    out = rows.select("doc_id", "rid", "text_key", "n_shingles", "digest").join(ends, "digest", "left")
    # the empty set is one digest of many components
    lone = F.col("n_shingles") == 0
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("component_id"))
    root = F.when(lone, F.col("rid")).otherwise(F.col("root"))
    return out.select("doc_id", "rid", "text_key", "n_shingles", root.alias("root"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays per component, with all columns."""
    judged = stored(near_groups(docs), "near-groups")
    first = judged.where("kept").groupBy("root").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    rows = judged.join(first, "rid", "left").groupBy("doc_id", F.col("text_key").alias("key"))
    kept = rows.agg(F.max("first").alias("first"), F.count("*").alias("n_same")).where("first").drop("first")
    return keep_rows(docs, stored(kept, "near-kept"), text_key(F.col("text")))
