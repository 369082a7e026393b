"""Rows that travel to places, shuffles without texts, and rankings that are worked out once."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions import text as X
from lorebank.functions.embed import _lists, embed_column
from lorebank.operators import answers as A
from lorebank.operators import blocks, overlap
from lorebank.operators import index as I
from lorebank.operators import retrieval as R
from lorebank.plans import retrieval_queries as Q


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_packed_without_loss():
    rng = np.random.default_rng(1)
    rows = [
        list(map(float, rng.integers(0, 3, 300))), list(map(float, rng.normal(size=300).astype(np.float32))), list(rng.normal(size=300)),
        [1e300] * 300, [0.0] * 300, [1.0] * 299, None, [float("nan")] * 300, [1.0] * 299 + [float("inf")], [1.0] * 299 + [None],
    ]
    packed = blocks._pack(pa.array(rows, pa.list_(pa.float64())), 300)
    assert [x[:1] if x else None for x in packed.to_pylist()] == [b"c", b"f", b"d", b"d", b"c", *[None] * 5]
    assert len(packed[0].as_py()) == 2 + 3 * 4 + 300
    got, ok = blocks._matrix(pa.chunked_array([packed]), 300)
    assert ok.tolist() == [True] * 5 + [False] * 5
    assert all((got[i] == rows[i]).all() for i in range(5))


@pytest.mark.parametrize("kind", ["close", "copies", "double", "huge", "tiny"])
def test_bounds_in_single_precision_find_the_exact_best(spark, kind, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 16))
    if kind == "close":  # scores that single precision cannot tell apart
        base = np.ones((400, 16)) + rng.normal(size=(400, 16)) * 1e-5
    if kind == "copies":
        base[50:350] = base[0]
    if kind != "double":
        base = base.astype(np.float32).astype(np.float64)
    base *= {"huge": 1e25, "tiny": 1e-25}.get(kind, 1.0)
    base[3] = 0
    ids = [f"c{i:03d}" for i in range(400)]
    monkeypatch.setattr(blocks, "_TILE_ROWS", 32)
    monkeypatch.setattr(blocks, "_SLICE_ROWS", 64)
    monkeypatch.setattr(blocks, "_SLICES", 2)
    table = pa.table({"user_id": ["u"] * 400, "id": ids, "vector": blocks._pack(pa.array(list(base), pa.list_(pa.float64())), 16)})
    schema = spark.createDataFrame([], "user_id string, left_id string, right_id string, score double").schema
    got = {}
    for r in blocks._pair_scorer(["user_id"], 9, 16, 12, schema)(table, table).to_pylist():
        got.setdefault(r["left_id"], []).append((-r["score"], r["right_id"]))
    n = np.sqrt((base * base).sum(axis=1))
    for i, one in enumerate(ids):
        norm = n[i] * n
        s = np.round(np.where(norm > 0, (base @ base[i]) / np.where(norm > 0, norm, 1), -2.0), 12)
        want = sorted(zip(-s, ids))[:9]
        assert len(got[one]) == 9
        # sums in another order may differ in the last digit that is kept
        assert np.abs(np.array([x for x, _ in sorted(got[one])]) - [x for x, _ in want]).max() < 2e-12
        if kind in ("copies", "huge"):
            assert [c for _, c in sorted(got[one])] == [c for _, c in want]


def test_packed_vectors_and_joined_tokens_are_what_places_get(spark):
    rows = spark.createDataFrame([("u", "a", [1.0, 2.0], ["x"])], "user_id string, id string, vector array<double>, tokens array<string>")
    shuffled = [line for line in plan(blocks.vector_topk(rows.drop("tokens"), rows.drop("tokens"), ["user_id"], 3, 2, 12)).split("\n") if "FlatMapCoGroupsInArrow" in line]
    assert shuffled
    left, _ = blocks.placed(rows.select("user_id", "id", blocks._packed("vector", 2).alias("vector")), rows, ["user_id"], 4, 4)
    assert left.schema["vector"].dataType.simpleString() == "binary"
    assert rows.select(overlap._joined("tokens")).schema["tokens"].dataType.simpleString() == "string"


def test_tokens_are_joined_without_loss(spark):
    lists = [["a", "b"], [], None, [""], ["", ""], ["a", None, "b"], ["\x1f"], ["\x1e1"], ["a\x1fb", "c"], ["a", "b\x1fc"], ["\x1e", "\x1e0"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, tokens array<string>").coalesce(1)
    back = overlap._listed(df.orderBy("i").select("i", overlap._joined("tokens")).toArrow()).column("tokens").to_pylist()
    written = lambda t: t.replace("\x1e", "\x1e0").replace("\x1f", "\x1e1")
    want = [None if x is None else [t for t in x if t is not None] for x in lists]
    marked = [x is not None and any(c in "".join(x) for c in "\x1e\x1f") for x in want]
    assert back == [[written(t) for t in x] if m else x for x, m in zip(want, marked)]
    left = spark.createDataFrame([("u", "q", ["\x1f", "\x1e1", "a\x1fb", "a"])], "user_id string, id string, tokens array<string>")
    right = spark.createDataFrame([("u", str(i), x) for i, x in enumerate(lists)], "user_id string, id string, tokens array<string>")
    got = {int(r.right_id): r.score for r in overlap.overlap_topk(left, right, ["user_id"], 20).collect()}
    assert got == {i: n for i, x in enumerate(lists) if x and (n := len({"\x1f", "\x1e1", "a\x1fb", "a"} & set(x)))}


def test_summaries_and_trims_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["#", "## ", " ", "\n", "\r\n", "\x85", " ", "　", "﻿", "word", "é", "中文", "x" * 40, "long text " * 4, "\n# "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 9, 40, 150]))) for _ in range(1500)] + [None, "a" * 95 + " # " + "b" * 900, "\n" * 500 + "late"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    blank = f"^[{K.WS}]+|[{K.WS}]+$"
    squashed = F.regexp_replace(F.regexp_replace("t", rf"(?m)^#+[{K.WS}]+", ""), f"[{K.WS}]+", " ")
    odd = df.select(
        "t", X.trim_ws("t").alias("a"), F.regexp_replace("t", blank, "").alias("b"), X.summary_of("t").alias("c"), F.left(F.regexp_replace(squashed, blank, ""), F.lit(96)).alias("d")
    ).where("NOT (a <=> b) OR NOT (c <=> d)")
    assert odd.collect() == []
    assert "left(t#" in plan(df.select(X.summary_of("t"))).lower() or "substring(t#" in plan(df.select(X.summary_of("t"))).lower()


def test_whole_vectors_become_lists_in_one_piece(spark):
    a, b = np.arange(3, dtype=np.float32), np.array([np.float32(0.1), 5], np.float32)
    assert _lists(pd.Series([a, b])).to_pylist() == [a.tolist(), b.tolist()]
    assert _lists(pd.Series([a, None, [1, 2.5]], dtype=object)).to_pylist() == [a.tolist(), None, [1.0, 2.5]]
    assert _lists(pd.Series([], dtype=object)).to_pylist() == []
    df = spark.createDataFrame([("x",), (None,), ("yy",)], "t string")
    sized = embed_column("t", lambda texts: pd.Series([None if t is None else np.full(2, len(t), np.float32) for t in texts]))
    assert {(r.t, tuple(r.v) if r.v else None) for r in df.select("t", sized.alias("v")).collect()} == {("x", (1.0, 1.0)), (None, None), ("yy", (2.0, 2.0))}


def test_searchable_prunes_before_the_join_with_the_same_rows(spark, monkeypatch):
    chunks = spark.createDataFrame(
        [(f"n{i}#0", "u", f"n{i}", "h" if i % 3 else "old", i % 2) for i in range(40)] * 2 + [("x", "u", None, "h", 1)],
        "chunk_id string, user_id string, note_id string, content_hash string, index_version int",
    )
    ledger = spark.createDataFrame([("u", f"n{i}", "h" if i % 4 else None, "ready" if i % 5 else "failed") for i in range(30)] + [("u", "n1", "h", "ready"), ("u", None, "h", "ready")], "user_id string, note_id string, content_hash string, status string")
    notes = spark.createDataFrame([("u", f"n{i}", "t") for i in range(25)], "user_id string, note_id string, topic string")
    want = sorted((f"n{i}#0", "t") for i in range(25) if i % 2 and i % 3 and i % 4 and i % 5 for _ in range(4 if i == 1 else 2))
    pruned = I.searchable(chunks, ledger, notes, ("topic",))
    assert "LeftSemi" in plan(pruned)
    assert sorted((r.chunk_id, r.topic) for r in pruned.collect()) == want
    monkeypatch.setattr(I, "KNOWN_KEYS", 0)
    whole = I.searchable(chunks, ledger, notes, ("topic",))
    assert "LeftSemi" not in plan(whole) and sorted((r.chunk_id, r.topic) for r in whole.collect()) == want


def test_texts_stay_out_of_later_shuffles(spark):
    keys = "user_id string, question_id string"
    expected = spark.createDataFrame([("u", "q", "n", 0, "ab")], f"{keys}, expected_note string, expected_ordinal int, expected_quote string")
    cited = spark.createDataFrame([("u", "q", 1, "n", "u", 0, "abc", "xabcx"), ("u", "q", 2, "m", "v", 0, "zz", "y"), ("u", "q", 3, "m", "u", 0, "zz", None)], f"{keys}, position int, note_id string, note_owner string, ordinal int, quote string, content string")
    out = A.retrieval_quality(expected, cited)
    lines = plan(out).split("\n")
    assert next(i for i, x in enumerate(lines) if "Contains(content" in x) > next(i for i, x in enumerate(lines) if "Join Inner" in x)
    r = out.first()
    assert (r.questions, r.hits, r.leaks) == (1, 1, 1) and r.verbatim_rate == pytest.approx(1 / 3)

    context = spark.createDataFrame([("u", "q", 1, "c1", "n", "T", "s", " body "), ("u", "q", 2, "c2", "m", None, None, "other"), ("u", "q", 3, "c3", "m", "", "s", "last")], f"{keys}, position int, chunk_id string, note_id string, title string, source string, content string")
    said = A.fallback_answers(expected.select("user_id", "question_id"), context)
    assert said.first().answer == "T: body\n\n: last" and [c.quote for c in said.first().citations] == ["body", "other", "last"]
    cut = A.fallback_answers(expected.select("user_id", "question_id"), context.withColumn("quote", A.answer_quote("content")).drop("content"))
    assert cut.collect() == said.collect()
    grouped = [x for x in plan(said).split("\n") if "collect_list" in x]
    assert grouped and " line" not in grouped[0]

    chosen = context.select("user_id", "question_id", "chunk_id", "note_id")
    stored = context.select("user_id", "chunk_id", F.lit(0).alias("ordinal"), F.lit(None).cast("array<string>").alias("heading_path"), "content", F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"))
    notes = context.select("user_id", "note_id", "title", "source").dropDuplicates(["note_id"])
    payload = R.with_payload(chosen, stored, notes)
    assert payload.count() == 3
    top = payload._jdf.queryExecution().optimizedPlan()
    while "Join" not in top.nodeName():
        top = top.children().apply(0)
    assert "content" not in top.children().apply(0).output().toString()


@pytest.mark.parametrize("query", [Q.citation_verify_q, Q.model_judgement_q, Q.answer_metrics_q])
def test_questions_are_ranked_once(spark, sf, query):
    assert "CoGroupsInArrow" not in plan(query(spark, sf))
