import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lorebank.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, kept int"
ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (4, " a b"), (1, None), (2, ""), (7, "x" * 100_000), (8, "x" * 100_000),
    (3, "a b"), (None, "n"), (None, "n"), (None, "a b"), (10, "é b"), (11, "é b"), (0, "z"), (12, "z"), (12, "z"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "d", 1) for i, t in rows], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_like_a_dictionary(spark):
    got = exact_dedup.dedup(frame(spark)).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(
        ((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_split_does_not_change_the_result(spark):
    rows = exact_dedup.digest_rows(frame(spark))
    results = [sorted(map(str, exact_dedup.exact_groups(rows, h).collect())) for h in (F.lit(True), F.lit(False), F.col("doc_id") > 5, F.col("doc_id").isNull())]
    assert all(r == results[0] for r in results)


def test_kept_texts_have_all_columns_once(spark):
    df = frame(spark)
    out = exact_dedup.dedup_texts(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted((norm(r.text) for r in got)) == sorted({norm(t) for _, t in ROWS})


def test_empty(spark):
    df = frame(spark, [])
    assert exact_dedup.dedup(df).count() == 0 and exact_dedup.dedup_texts(df).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (20_000, 4), dtype=np.int64).astype(np.uint64)
    levels = exact_dedup.mph_build(keys)
    assert sorted(exact_dedup.mph_slots(levels, keys)) == list(range(len(keys)))
    foreign = rng.integers(0, 2**63, (5_000, 4), dtype=np.int64).astype(np.uint64)
    slots = exact_dedup.mph_slots(levels, foreign)
    assert slots.min() >= -1 and slots.max() < len(keys)
    assert len(exact_dedup.mph_slots(levels, keys[:0])) == 0
