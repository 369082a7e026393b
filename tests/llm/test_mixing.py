import random

from pyspark.sql import functions as F

from lorebank.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "b") for i, t, s in rows], SCHEMA)


def shared_again(sizes, weights=(1, 2, 3)):
    """Targets by literal repetition: share, cut at the ceiling, share the excess among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else rest * w[s] / free for s in order}
        over = {s for s in order if s not in full and t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        s = rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é", "tiny"] if i % 50 else ["rare"])
        n = min(4000, int(rng.paretovariate(0.9) * 20)) if s != "tiny" else 1
        rows.append((i, " ".join(["w"] * n) if i % 97 else None, s))
    return rows


def test_targets_and_whole_mix(spark):
    rows = corpus(3)
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shared_again(sizes)
    assert len(got) == len(rows)
    largest = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size and abs(r.times - r.copies) < 1
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(str, mixing.mix(docs(spark, rows)).collect())) == sorted(map(str, got))
    # the expected copies of a source add up to its target
    for s in sizes:
        assert abs(sum(r.copies * r.size for r in got if r.source == s) - want[s]) < 1e-6 * max(1, want[s])


def test_inclusion_follows_its_odds(spark):
    """Over many seeds a document is taken as often as its expected copies say."""
    rows = [(i, " ".join(["w"] * (1 + i % 40)), "a" if i % 3 else "b") for i in range(120)]
    df = docs(spark, rows)
    total, n = {}, 4
    for seed in range(n):
        for r in mixing.mix(df, seed=str(seed)).collect():
            total.setdefault(r.doc_id, [r.copies, 0])[1] += r.times
    assert abs(sum(t / n - c for c, t in total.values())) / len(total) < 0.08


def test_ties_repeats_nulls_and_empty(spark):
    rows = [(1, "a b", "x")] * 40 + [(1, "a b c", "x")] * 3 + [(None, "a", None), (2, None, None), (3, "", "y"), (4, "\x1f z", "z")]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 40 * 2 + 9 + 1 + 0 + 0 + 2
    assert all(r.target == 0 for r in got if r.source == "y")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.times for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "x")])).first().target == 0


def test_documents_come_as_often_as_taken(spark):
    rows = corpus(5)[:400]
    times = {r.doc_id: r.times for r in mixing.mix(docs(spark, rows)).collect()}
    out = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs(spark, rows)).groupBy("doc_id").count().collect()}
    assert out == {i: t for i, t in times.items() if t}


def test_uniform_is_in_the_open_interval(spark):
    low, high = spark.range(20000).select(mixing.uniform(F.col("id")).alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0 < low < 0.001 and 0.999 < high < 1
