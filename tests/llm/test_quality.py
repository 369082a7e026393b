import zlib

import numpy as np
import pyarrow as pa
import pytest

from lorebank.llm import quality as q
from lorebank.llm.words import find_words, hash_words, text_slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], SCHEMA)


def test_words_like_a_regex():
    import re

    texts = ["Ab ab\tAB", None, "", "  x\x0b\x0cy ", "é b c", "\x1f", "one", " ", "a" * 50]
    (_, _, data, offs), = text_slices(pa.array(texts))
    starts, ends, first = find_words(data, offs)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(ws) for ws in want]
    h = dict(zip([w.lower() for ws in want for w in ws], hash_words(data, starts, ends)))
    assert len(set(h.values())) == len(h) and hash_words(data, starts, ends)[0] == hash_words(data, starts, ends)[2]


def test_interactions_like_the_double_sum():
    rng = np.random.default_rng(0)
    m = q.Model(0.3, rng.normal(size=q.DIMS), rng.normal(size=(q.DIMS, q.RANK)))
    sizes = [3, 1, 5]
    index = rng.integers(0, q.DIMS, sum(sizes))
    value = rng.normal(size=sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = m.logits(index, value, first)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        z = 0.3 + sum(m.w[index[i]] * value[i] for i in range(a, b))
        z += sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b))
        assert abs(got[d] - z) < 1e-9


def test_gradients_lower_the_loss_and_sampling_is_bounded(spark):
    docs = frame(spark, [(i, ("junk%%% more$$$ " if i % 2 else "plain words here ") * 5) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.training_rows(docs, labels, sample=50).count() == 50
    got = q.classify(docs, labels).collect()
    assert len(got) == 300
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) == int(r.doc_id % 2 == 0)
    assert sorted(map(str, q.classify(docs, labels).collect())) == sorted(map(str, got))


def test_an_id_with_a_third_of_all_rows_stays_within_the_sample(spark):
    rows = [(i, "plain words here") for i in range(600)] + [(1, f"other text {i}") for i in range(150)] + [(1, "one text")] * 150
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)] + [(1, 1, 0)] * 5 + [(2, 0, 0)], "doc_id long, quality int, toxic int")
    assert 120 <= q.training_rows(frame(spark, rows), labels, sample=200).count() <= 280
    assert len(q.classify(frame(spark, rows), labels, sample=200).collect()) == len(rows)


def test_only_text_and_length_count(spark):
    rows = [(1, "a text"), (2, "a text"), (None, "a text"), (3, None), (4, ""), (5, "w " * 200_000)]
    m = q.Model(0.1, np.arange(q.DIMS, dtype=np.float32) / q.DIMS, np.full((q.DIMS, q.RANK), 0.01, np.float32))
    got = q.score(frame(spark, rows), m).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.score)
    assert by[1] == by[2] == by[None]
    assert q.good_documents(frame(spark, rows), m, 0.0).count() == 6
    kept = {r.doc_id for r in q.good_documents(frame(spark, rows), m, by[1]).collect()}
    assert kept == {r.doc_id for r in got if r.score >= by[1]}


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in q.classify(frame(spark, [(1, "x"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert q.classify(frame(spark, []), none).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4


def test_words_become_numbers_in_short_slices_with_the_same_features():
    texts = [f"word{i} other{i % 7} " * (40 + i) for i in range(1_500)] + ["x " * 400_000, None, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([None] * len(texts), pa.int64())], ["text", "n_chars"])
    alone = [next(q.featurise(batch.slice(i, 1))) for i in (0, 700, 1_499, 1_500, 1_501, 1_502)]
    parts = list(q.featurise(batch))
    assert [a for a, *_ in parts] == [0, *(b for _, b, *_ in parts)][:-1] and parts[-1][1] == len(texts)
    assert all(b == a + 1 or sum(len(t or "") for t in texts[a:b]) <= 1 << 19 for a, b, *_ in parts)
    for i, (_, _, index, value, _) in zip((0, 700, 1_499, 1_500, 1_501, 1_502), alone):
        a, _, indices, values, first = next(p for p in parts if p[0] <= i < p[1])
        at = slice(first[i - a], first[i - a + 1])
        assert indices[at].tolist() == index.tolist() and values[at].tolist() == value.tolist()
