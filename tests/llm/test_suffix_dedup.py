import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from lorebank.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, rid int, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def brute(rows, length):
    """Every window in one dictionary."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + (len(t) > 0 and gone[0]))
        body = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(body).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length, docs=60):
    rng = random.Random(seed)
    letters = "abcdé \n"
    fresh = lambda n: "".join(rng.choices(letters, k=n))
    passages = [fresh(rng.randrange(length // 2, length * 3)) for _ in range(6)] + ["z" * (length * 2), "ab" * length]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            parts += [fresh(rng.randrange(0, length * 2)), p[rng.randrange(0, 5) :] if rng.random() < 0.5 else p[: rng.randrange(1, len(p))]]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "short"), (105, "short"), (106, "q" * (length - 1)), (107, "q" * (length - 1)), (None, rows[5][1]), (7, rows[9][1])]
    return rows


def got_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_like_all_windows(spark):
    rows = corpus(1, 200, docs=40)
    assert got_rows(sd.deduplicate(frame(spark, rows))) == brute(rows, 200)


def test_short_strings_and_cut_anchors(spark, monkeypatch):
    """Anchors cut into many shards are merged by binary search; the result stays."""
    rows = corpus(2, 25, docs=50)
    want = brute(rows, 25)
    monkeypatch.setattr(sd, "TOGETHER", 3)
    monkeypatch.setattr(sd, "SHARD", 500)
    assert got_rows(sd.deduplicate(frame(spark, rows), 25)) == want


def test_kept_text_and_empty_table(spark):
    rows = [(1, "head " + "p" * 300 + " tail"), (2, "p" * 250)]
    got = {r.doc_id: r for r in sd.deduplicate(frame(spark, rows), with_text=True).collect()}
    assert bytes(got[1].kept) == b"head  tail" and got[1].removed == [5, 305] and bytes(got[2].kept) == b""
    assert sd.deduplicate(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [8, 20, 64])
def test_suffix_array_and_common_prefixes(length):
    rng = random.Random(length)
    contexts = [bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(length, length * 3))) for _ in range(30)]
    contexts += [contexts[0][:length] + b"x", b"a" * (length * 2)]
    s = sd.Suffixes(contexts, length)
    rest = lambda p: bytes(s.text[p : s.stop[p]].astype(np.uint8) - 1)
    ordered = [(rest(p), p) for p in s.order]
    assert ordered == sorted(ordered) and sorted(s.order) == list(range(len(s.order)))
    naive = [0] + [len(os.path.commonprefix([a, b])) for (a, _), (b, _) in zip(ordered, ordered[1:])]
    assert s.common_prefixes()[s.order].tolist() == naive
    windows = np.array([len(c) - length + 1 for c in contexts])
    seen = Counter(c[p : p + length] for c in contexts for p in range(len(c) - length + 1))
    for c, flags in zip(contexts, s.repeats(windows)):
        assert flags.tolist() == [seen[c[p : p + length]] > 1 for p in range(len(c) - length + 1)]
    a, b = contexts[:15], contexts[10:]
    inside = {c[p : p + length] for c in b for p in range(len(c) - length + 1)}
    for c, flags in zip(a, sd.Suffixes(b, length).find(sd.Suffixes(a, length), windows[:15])):
        assert flags.tolist() == [c[p : p + length] in inside for p in range(len(c) - length + 1)]


def test_prefixes_like_naive_ones_over_many_seeds():
    """Equal contexts, contexts inside others, empty ones, runs of one byte, zero bytes."""
    for seed in range(120):
        rng = random.Random(seed)
        contexts = [bytes(rng.choices(b"a\x00\xffb"[: rng.randrange(1, 5)], k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 12))]
        contexts += [contexts[0], contexts[-1][3:]]
        s = sd.Suffixes(contexts, 8)
        ordered = [(bytes(s.text[p : s.stop[p]].astype(np.uint8) - 1), p) for p in s.order.tolist()]
        assert ordered == sorted(ordered), seed
        assert s.common_prefixes()[s.order].tolist() == [0] + [len(os.path.commonprefix([a, b])) for (a, _), (b, _) in zip(ordered, ordered[1:])], seed


def test_low_entropy_text_and_tables_dropped(spark):
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(1, "a" * 3000), (2, "ab" * 700 + "c"), (3, "x" + "ab" * 99 + "y")]
    assert got_rows(sd.deduplicate(frame(spark, rows))) == brute(rows, 200)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_window_after_a_tie_is_not_taken_for_a_repeat():
    """The neighbours of MNOPQRST's successors differ: NOPQRSTb and NOPQRSTc occur once each."""
    flags = sd.Suffixes([b"xMNOPQRSTc", b"yMNOPQRSTb", b"NAAAAAAb"], 8).repeats(np.array([3, 3, 1]))
    assert [f.tolist() for f in flags] == [[False, True, False], [False, True, False], [False]]


@pytest.mark.parametrize("length", [4, 8, 25])
def test_repeats_like_a_dictionary_over_many_seeds(length):
    """Passages that end in different bytes, over a small alphabet; the first seeds alone do not show every tie."""
    for seed in range(150):
        rng = random.Random(seed)
        passages = [bytes(rng.choices(b"abcd", k=rng.randrange(length, length * 3))) for _ in range(4)]
        contexts = [bytes(rng.choices(b"abcd", k=rng.randrange(0, 4))) + rng.choice(passages) + bytes(rng.choices(b"abcd", k=rng.randrange(0, length))) for _ in range(25)]
        seen = Counter(c[p : p + length] for c in contexts for p in range(len(c) - length + 1))
        flags = sd.Suffixes(contexts, length).repeats(np.array([len(c) - length + 1 for c in contexts]))
        assert [f.tolist() for f in flags] == [[seen[c[p : p + length]] > 1 for p in range(len(c) - length + 1)] for c in contexts], seed


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    text = bytes(rng.choices(b"abc", k=3000))
    data = np.frombuffer(text[:2000] + b"|" + text[500:1500] + b"?", np.uint8)
    doc, start, windows, anchor, _ = sd.runs(data, np.array([0, 2000, len(data)]), 100)
    by = {}
    for d, s, w, h in zip(doc, start, windows, anchor):
        for p in range(s, s + w):
            by[d, p] = h
    assert all(by[1, p + 1 - 500] == by[0, p] for p in range(500, 1400)) and len(by) == 1901 + len(data) - 2000 - 99
