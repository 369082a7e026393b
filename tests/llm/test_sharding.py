import hashlib
import random
import zlib

import pytest

from lorebank.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size double, `range` int"


def brute(rows, shards):
    """Offsets in key order, by sorting everything in one place."""
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    order = sorted(((hashlib.md5((t or "").encode()).hexdigest(), i is None, i or 0, t or "") for i, t in rows))
    group = {}
    at = 0
    for k, _, _, t in order:
        begin, size = group.setdefault(k, (at, 0))
        group[k] = (begin, size + len(t.encode()) + 1)
        at += len(t.encode()) + 1
    out, at, slots = [], 0, [0] * shards
    n = {}
    for k, *_ in order:
        n[k] = n.get(k, 0) + 1
    for k, unknown, i, t in order:
        begin, size = group[k]
        place = begin if n[k] > 1 and size * shards <= total * sharding.GROUP_SHARE else at
        s = min(shards - 1, place * shards // total)
        out.append((None if unknown else i, len(t.encode()) + 1, zlib.crc32(t.encode()), s, slots[s]))
        slots[s] += 1
        at += len(t.encode()) + 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1.0, 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("hot", [0, 700])
def test_equals_a_full_sort(spark, hot, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 4)
    rng = random.Random(hot)
    words = ["wörd", "b", "cc", "ddd"]
    rows = [(i, " ".join(rng.choices(words, k=min(3000, int(rng.paretovariate(0.8) * 8))))) for i in range(1200)]
    rows += [(5000 + i, "the same text again and again " * 3) for i in range(hot)]
    rows += [(9000 + i, "few copies") for i in range(3)] + [(1, None), (1, None), (2, ""), (None, "x"), (None, "x"), (7, "q"), (7, "q")]
    rng.shuffle(rows)
    got = sorted(map(tuple, sharding.shard(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows, 16), key=str)
    bytes_of = {}
    for _, size, _, s, _ in got:
        bytes_of[s] = bytes_of.get(s, 0) + size
    mean = sum(bytes_of.values()) / 16
    most = max(len(t or "") for _, t in rows) + mean * sharding.GROUP_SHARE
    assert len(bytes_of) == 16 and all(abs(b - mean) <= 2 * most for b in bytes_of.values())


def test_ranges_are_even_and_split_when_overfull(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 4)
    rows = [(i, "same") for i in range(3000)] + [(10_000 + i, f"text {i}") for i in range(1500)]
    made = []
    keep = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    sharding.shard(frame(spark, rows)).count()
    ranged = dict(made)["shard-ranges"]
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 8 * len(rows) / 64


def test_empty_and_tiny(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    assert [tuple(r) for r in sharding.shard(frame(spark, [(1, None)])).collect()] == [(1, 1, 0, 0, 0)]
