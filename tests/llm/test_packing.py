import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorebank.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
REAL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, length int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t\r'sabtre.,!1é中<|endoftext|>", max_size=80))
def test_ids_equal_the_tokenizers_library(text):
    assert packing.token_ids(packing.encoder(PATH), text).tolist() == [*REAL.encode(text, add_special_tokens=False).ids, 0]


def best_fill(counts, room):
    """Largest sum of a sub-multiset, by trying all."""
    items = [n for n, c in counts.items() for _ in range(c)]
    return max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_fullest_combination(items, room):
    counts = {n: items.count(n) for n in items}
    combo = packing.fullest(counts, sorted(counts, reverse=True), room)
    assert all(0 < k <= counts[n] for n, k in combo)
    assert sum(n * k for n, k in combo) == best_fill(counts, room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plan_places_every_rank_once(histogram):
    seen, fill = {}, {}
    for n, first, times, seq, k, offset in packing.plan(histogram, 64).tolist():
        for t in range(times):
            for j in range(k):
                r = first + t * k + j
                assert (n, r) not in seen
                seen[n, r] = True
                fill.setdefault(seq + t, []).append((offset + j * n, n))
    assert sorted(seen) == sorted((n, r) for n, c in histogram.items() for r in range(c))
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64


def test_plan_wastes_little_and_stays_small():
    rng = np.random.default_rng(0)
    n = np.minimum(2048, (rng.lognormal(6, 1, 2_000_000)).astype(int) + 1)
    values, counts = np.unique(n, return_counts=True)
    entries = packing.plan(dict(zip(values.tolist(), counts.tolist())))
    bins = (entries[:, 3] + entries[:, 2]).max()
    assert bins <= 1.001 * n.sum() / 2048 + 1 and len(entries) < 60_000


@pytest.mark.parametrize("salted", [False, True])
def test_round_trip(spark, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(packing, "RANKED", 10)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta,", "gamma-ray", "ü", "12"], k=rng.choice([0, 1, 5, 60, 400])))) for i in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "long text " * 4000), (1003, "x <|endoftext|> y"), (5, rows[5][1]), (5, rows[5][1]), (None, "no id")] + [(2000 + i, "same") for i in range(80)]
    packed = packing.pack(frame(spark, rows), PATH, with_ids=True)
    got = packed.collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*REAL.encode(t or "", add_special_tokens=False).ids, 0])
    whole = {}
    for r in got:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for i, copies in want.items():
        assert sum(len(x[2]) for x in whole[i]) == sum(map(len, copies))
        if len(copies) == 1:
            parts = sorted(whole[i])
            assert [p for p, _, _ in parts] == list(range(len(parts))) and sum((x[2] for x in parts), []) == copies[0]
            assert all(len(x[2]) == 2048 for x in parts[1:]) and [x[1] for x in parts] == [sum(len(y[2]) for y in parts[:n]) for n in range(len(parts))]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    large, middle = sum(r.length > 1024 for r in got), sum(683 <= r.length <= 1024 for r in got)
    fewest = max(-(-sum(r.length for r in got) // 2048), large + -(-middle // 2))  # no two large, no three middle ones fit together
    assert len(bins) <= fewest + 1
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(joined[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)


def test_empty(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0
