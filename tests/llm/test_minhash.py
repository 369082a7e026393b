import random
import re

import numpy as np
import pytest

from lorebank.llm import minhash
from lorebank.llm.words import shingle_sets

SCHEMA = "doc_id long, text string, band string, node int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], SCHEMA)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """All pairs, union-find."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            low[find(i)] = min(low.get(find(i), ident), ident)
    return sorted(((ident, len(sets[i]), ident if not sets[i] else low.get(find(i))) for i, (ident, _) in enumerate(rows)), key=str)


def near_corpus(seed, groups=25, singles=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, ident = [], 0
    passage = rng.choices(vocab, k=60)
    for g in range(groups + singles):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 150, 600]))
        if g % 4 == 0:
            base = base + passage
        for _ in range(rng.choice([2, 3, 8, 30]) if g < groups else 1):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 18)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((ident, " ".join(w.upper() if rng.random() < 0.1 else w for w in t)))
            ident += 1
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark):
    rows = near_corpus(1)
    rows += [(9001, None), (9002, ""), (9003, " \t "), (9004, "a b"), (9005, "A  b"), (9006, "b a"), (5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "only null")]
    got = minhash.near_groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_large_group_is_not_expanded(spark):
    """Hundreds of copies with different edits: random copies are just below the threshold, yet few of the 244 650 pairs are compared."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(700):
        t = list(base)
        for p in rng.sample(range(120), 2):
            t[p] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    compared = []
    keep = minhash.similar
    try:
        minhash.similar = lambda pairs, sets: compared.append(pairs.count()) or keep(pairs, sets)
        got = minhash.near_groups(frame(spark, rows)).collect()
    finally:
        minhash.similar = keep
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert sum(compared) < len(rows) * (len(rows) - 1) / 2 / 20


@pytest.mark.parametrize("small, block", [(0, 2048), (3, 7)])
def test_blocks_equal_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices([f"q{j}" for j in range(4000)], k=rng.randrange(5, 30)) + passage)) for i in range(150)]
    rows += [(1000 + i, " ".join(w if rng.random() > 0.02 else f"x{i}{j}" for j, w in enumerate([f"o{k}" for k in range(100)]))) for i in range(100)]
    got = minhash.near_groups(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_one_of_each_and_long_text(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(3, long), (4, long + " end"), (7, "q r s t u v"), (7, "q r s t u v"), (None, "n n n n n n"), (None, "N n n n n n"), (8, None), (9, "")]
    df = frame(spark, rows)
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id) for r in out.collect())) == ["3", "7", "8", "9", "None"]
    assert minhash.one_of_each(frame(spark, [])).count() == 0 and minhash.near_groups(frame(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    """Agreeing coordinates come near the Jaccard similarity, and one shift differs from another."""
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for share in (0.3, 0.75, 0.95):
        n = int(len(a) * share)
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        sig = minhash.signatures([a, b], 2048)
        true = n / (2 * len(a) - n)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    x = np.arange(100_000, dtype=np.uint32)
    assert len(np.unique(minhash.second_permutation(x))) == len(x)
    assert len(set(minhash.signatures([a], 128)[0].tolist())) > 120


def test_short_sequences():
    h = np.arange(1, 8, dtype=np.uint64)
    sets = shingle_sets(h, np.array([0, 2, 2, 7]), 5)
    assert [len(s) for s in sets] == [1, 0, 1]


def test_words_in_thue_morse_order_are_not_taken_for_each_other(spark):
    """A polynomial modulo a power of two has one value for such a word and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word[:100]), (4, word[:100].translate(str.maketrans("ab", "ba")))]
    got = minhash.near_groups(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(1, 5)]


def test_word_codes_see_every_byte():
    from lorebank.llm.words import find_words, text_slices, word_codes

    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 700] for _ in range(20)}
    words = sorted(words) + [w.upper() for w in ("abab", "b" * 300)] + ["abab", "b" * 300]
    ((_, _, data, offs),) = text_slices(minhash.pa.array([" ".join(words)]))
    starts, ends, _ = find_words(data, offs)
    codes = dict(zip(words, word_codes(data, starts, ends).tolist()))
    assert codes["ABAB"] == codes["abab"] and codes["B" * 300] == codes["b" * 300]
    assert len(set(codes.values())) == len({"".join(c.lower() if c < "\x7f" else c for c in w) for w in words})
