import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lorebank.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, A int, n int, fp int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, t, lang in rows], SCHEMA)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least=100, top=2000):
    """The contract read literally."""
    out = []
    for lang, f in (found := counted(rows))[0].items():
        n = found[1][lang]
        cand = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        ranked = []
        for p, a in cand.items():
            if inside[p] < a:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, docs=150):
    rng = random.Random(seed)
    vocab = ["the", "New", "new", "York", "city", "of", "é", "Été", "日本", "a", "b", "c d", "x'y", "of", "the"]
    fixed = ["new york city of", "a b a b a b", "b\tc d the", "the  the the the"]
    rows = []
    for i in range(docs):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(vocab, k=rng.randrange(1, 8))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, rng.choice([". ", "\n", " ", ";", "\x0b", "! "]).join(parts), rng.choice(["en", "de", None, "und", ""])))
    return rows + [(9001, None, "en"), (9002, "", "en"), (9003, " \t\n.. ", None), (None, "new york", "en"), (5, "new york", "en"), (5, "new york", "en")]


def result(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_collocations_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = phrases.collocations(frame(spark, rows), least=5, top=40)
    assert result(got) == brute(rows, 5, 40) and len(result(got)) > 40


def test_small_slices_and_several_bitmaps_change_nothing(spark):
    """Texts cut inside pieces, bitmaps with collisions in every cell, levels dealt into many rounds."""
    rows = corpus(7, 60) + [(8000, "a b a b c " * 300, "en"), (8001, "w" * 500 + " a b" * 50, "en")]
    found = phrases.frequent(frame(spark, rows), least=5, size=64, cells=64, per_bitmap=40)
    got = sorted((r.lang, r.phrase, r.f) for r in found.where("k > 0").collect())
    f, n = counted(rows)
    assert got == sorted((lang, " ".join(p), a) for lang in f for p, a in f[lang].items() if a >= 5)
    assert {r.lang: r.f for r in found.where("k = 0").collect()} == {lang: n[lang] for lang in n}


def test_pointers_lead_to_the_phrase(spark):
    rows = corpus(4)[:-3]
    texts = {i: t for i, t, _ in rows}
    for r in phrases.frequent(frame(spark, rows), least=5, size=256).where("k > 0 AND doc_id IS NOT NULL").collect():
        behind = low(texts[r.doc_id].encode()[r.at :].decode())
        assert re.match(r"[ \t]+".join(map(re.escape, r.phrase.split(" "))) + r"(?=[ \t.,;:!?\x0A-\x0D]|$)", behind)


def test_equal_fingerprints_part_by_their_words(spark, monkeypatch):
    """With all fingerprints and word codes of a length alike only the comparison of texts tells phrases apart."""
    rows = corpus(6, 80)
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": t, "doc_id": i} for i, t, lang in rows])
    monkeypatch.setattr(phrases, "word_codes", lambda data, starts, ends: (ends - starts).astype("uint64") % 2)
    monkeypatch.setattr(phrases.Slice, "prints", lambda self, at, k: (self.sums[at + k] - self.sums[at]) * self.down[at] % 3)
    f, _ = counted(rows)
    for part, langs, _ in phrases.slices(iter([batch]), 1 << 20):
        ids = part.word_ids()
        codes = phrases.np.unique(phrases.np.array(langs, object), return_inverse=True)[1]
        names = sorted(set(langs))
        for k in (1, 2, 3):
            at = part.grams(k)
            heads, n = phrases._groups(part, at, part.prints(at, k), ids, codes, k)
            got = {(names[codes[part.owner[part.text[w]]]], part.phrase(w, k).decode()): m for w, m in zip(heads.tolist(), n.tolist())}
            assert got == {(lang, " ".join(p)): a for lang in f for p, a in f[lang].items() if len(p) == k}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_001
    table = spark.createDataFrame(
        [("en", 0, "", 3 * big, None, None), ("en", 1, "a", big, 1, 0), ("en", 1, "b", big - 7, 1, 0), ("en", 2, "a b", big - 9, 1, 0)],
        "lang string, k int, phrase string, f long, doc_id long, at long",
    )
    (row,) = phrases.scored(table).collect()
    assert row.score == 1000 * (big - 9) * 3 * big // (big * (big - 7))


def test_nothing_frequent_and_empty_table(spark):
    assert phrases.collocations(frame(spark, [(1, "a b", "en")])).collect() == []
    assert phrases.collocations(frame(spark, [])).collect() == []
