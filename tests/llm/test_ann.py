import math

import numpy as np
import pytest

from lorebank.llm import ann
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)


def brute(rows, k=10):
    ok = {(i, tuple(np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for qi, q in ok:
        if qi % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v))), i) for i, v in ok if i != qi and len(v) == len(q))
            out.setdefault(qi, []).append(near[:k])
    return out


def recall(got, want):
    hits = total = 0
    for qi, lists in want.items():
        for near in lists:
            found = {(r.vec_id) for r in got if r.query_id == qi}
            total += len(near)
            hits += sum(i in found for _, i in near)
    return hits / max(1, total)


@pytest.mark.parametrize("blocks", [1, 4])
def test_recall_and_order(spark, blocks, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 3000 // blocks)
    monkeypatch.setattr(ann, "ASKED", 40 // blocks)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    want = brute(rows)
    assert len(got) == 300 and recall(got, want) >= 0.9
    exact = {(q, i): d for q, lists in brute(rows, 3000).items() for near in lists for d, i in near}
    for r in got:
        assert abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, ann.BYTES)).astype(np.uint8)
    codes[::7] = codes[0] ^ np.packbits(rng.random((72, ann.BITS)) < 0.2, axis=1)
    tables = ann.Tables(codes)
    for radius in (0, 1, 31, 32, 40, 63, 64, 97, 130, 256):
        for q in (codes[0], codes[3], rng.integers(0, 256, ann.BYTES).astype(np.uint8)):
            want = [i for i, c in enumerate(codes) if sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(c, q)) <= radius]
            assert tables.within(q, radius).tolist() == want


def test_small_and_odd_tables_are_exact(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]),
            (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, [1.0, 2.0, 3.0]), (301, [3.0, 2.0, 1.0]), (None, [1.0, 0.0]), (400, [5.0]), (-100, [1.0, 1.0])]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    want = sorted((q, n + 1, i, d) for q, lists in brute(rows).items() for near in lists for n, (d, i) in enumerate(near))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_one_vector_shared_by_many_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 16) for i in range(0, 900, 3)] + [(i, rng.normal(size=16).tolist()) for i in range(900) if i % 3]
    df = frame(spark, rows)
    assert ann.points(df.selectExpr("vec_id", "embedding vec"), 10).agg(F.max(F.size("ids"))).first()[0] == 11
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(r.vec_id for r in got if r.query_id == 300) == list(range(0, 30, 3))
    assert recall(got, brute(rows)) >= 0.9


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = ann.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert recall(got, brute(rows)) >= 0.95
