"""Block scoring against brute force, with blocks far smaller than the groups."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebank.operators import blocks, overlap, scopes
from lorebank.operators import retrieval as R
from lorebank.operators.blocks import hot_keys
from lorebank.operators.lookback import preceding_rows
from lorebank.operators.overlap import overlap_topk
from lorebank.operators.quotes import find_quotes


@pytest.fixture(scope="module")
def tokens():
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(20_000)]
    # one user owns most rows on both sides
    users = ["big"] * 8 + ["s1", "s2"]
    left = [(rng.choice(users), f"q{i}", rng.sample(words, rng.randint(0, 12))) for i in range(60)]
    right = [(rng.choice(users), f"c{i:04d}", rng.sample(words, rng.randint(0, 30))) for i in range(300)]
    return left, right


def brute(left, right, k, above=0, not_self=False):
    out = {}
    for u, q, lt in left:
        scored = []
        for v, c, rt in right:
            if u == v and not (not_self and q == c):
                s = sum(n for t, n in Counter(lt).items() if t in set(rt))
                if s > above:
                    scored.append((-s, c))
        for rank, (s, c) in enumerate(sorted(scored)[:k], 1):
            out[(q, c)] = (-s, rank)
    return out


def sides(spark, left, right):
    schema = "user_id string, id string, tokens array<string>"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def top(df):
    return {(r.left_id, r.right_id): (r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize(("lb", "rb"), [(7, 11), (4096, 4096), (1000, 40)])
def test_token_topk_equals_brute_force(spark, tokens, lb, rb):
    left, right = tokens
    assert top(overlap_topk(*sides(spark, left, right), ["user_id"], 5, left_block=lb, right_block=rb)) == brute(left, right, 5)


def test_token_topk_against_itself(spark, tokens):
    _, right = tokens
    df, _ = sides(spark, right, right)
    got = overlap_topk(df, df.withColumn("own", F.col("id")), ["user_id"], 3, above=1, left_block=13, right_block=17)
    assert top(got) == brute(right, right, 3, above=1, not_self=True)


def test_a_stop_word_in_every_row_and_a_user_with_most_rows(spark):
    rng = random.Random(8)
    users = ["big"] * 3 + [f"s{i}" for i in range(6)]
    left = [(rng.choice(users), f"q{i}", ["the", "the", f"w{rng.randrange(50)}"]) for i in range(90)] + [("big", "stop", ["the"]), ("none", "x", ["the"])]
    right = [(rng.choice(users), f"c{i:04d}", ["the", f"w{rng.randrange(50)}", f"w{rng.randrange(50)}"]) for i in range(900)]
    ldf, rdf = sides(spark, [*left, ("big", "empty", []), ("big", "null", None)], [*right, ("big", "c9", []), ("big", "c8", None)])
    assert top(overlap_topk(ldf, rdf, ["user_id"], 30, left_block=16, right_block=32)) == brute(left, right, 30)


def test_few_tokens_at_a_time_change_nothing(spark, tokens, monkeypatch):
    from lorebank.operators import overlap

    monkeypatch.setattr(overlap, "TOKENS", 10)
    left, right = tokens
    count = overlap._counter(["user_id"], 4, 0, False, spark.createDataFrame([], "user_id string, left_id string, right_id string, score long").schema)
    lt, rt = (overlap.pa.table({"user_id": ["u"] * len(x), "id": [r[1] for r in x], "tokens": [r[2] for r in x]}) for x in (left, right))
    got = {(r["left_id"], r["right_id"]): r["score"] for r in count(lt, rt).to_pylist()}
    want = brute([("u", *r[1:]) for r in left], [("u", *r[1:]) for r in right], 4)
    assert got == {pair: score for pair, (score, _) in want.items()}


def test_many_distinct_tokens(spark):
    left = [("u", f"q{i}", [f"t{(i * 7 + j) % 3000}" for j in range(400)]) for i in range(20)]
    right = [("u", f"c{i:03d}", [f"t{(i * 31 + j * 3) % 3000}" for j in range(300)]) for i in range(80)]
    ldf = spark.createDataFrame(left, "user_id string, question_id string, search_terms array<string>")
    rdf = spark.createDataFrame(right, "user_id string, chunk_id string, search_terms array<string>")
    got = {(r.question_id, r.chunk_id): (r.hits, r["rank"]) for r in R.keyword_topk(ldf, rdf, 10).collect()}
    assert got == brute(left, right, 10)


def test_vector_topk_with_ties_zero_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    base[7] = base[3]  # equal vectors tie and order by id
    base[9] = 0
    rows = [("u", f"c{i:02d}", [float(x) for x in v]) for i, v in enumerate(base)]
    asked = [("u", "q1", rows[3][2]), ("u", "q2", rows[5][2]), ("u", "short", [1.0]), ("u", "nan", [float("nan")] * 8), ("u", "none", None)]
    ldf = spark.createDataFrame(asked, "user_id string, question_id string, embedding array<float>")
    rdf = spark.createDataFrame(rows, "user_id string, chunk_id string, embedding array<float>")
    got = R.dense_topk(ldf, rdf, dim=8, k=40).orderBy("question_id", "rank").collect()
    assert {r.question_id for r in got} == {"q1", "q2"}
    first = [r.chunk_id for r in got if r.question_id == "q1"]
    assert first[:2] == ["c03", "c07"] and first[-1] == "c09" and len(first) == 40
    unit = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-30)
    want = unit.astype(np.float64) @ unit[5].astype(np.float64)
    for r in got:
        if r.question_id == "q2" and r.chunk_id != "c09":
            assert abs(r.score - want[int(r.chunk_id[1:])]) < 1e-6


def test_places_are_scored_in_slices_with_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(-1, 2, size=(90, 3)).astype(np.float64)  # many equal scores, over the edges of slices
    ids = [f"c{i:02d}" for i in rng.permutation(90)]
    left, right = (blocks.pa.table({"user_id": ["u"] * len(x), "id": x, "vector": [list(map(float, base[i])) for i in range(len(x))]}) for x in (ids[:50], ids))
    schema = spark.createDataFrame([], "user_id string, left_id string, right_id string, score double").schema
    score = blocks._pair_scorer(["user_id"], 7, 3, 12, schema)
    rows = lambda t: sorted(tuple(r.values()) for r in t.to_pylist())
    whole = rows(score(left, right))
    monkeypatch.setattr(blocks, "_SLICE_ROWS", 11)
    monkeypatch.setattr(blocks, "_TILE_ROWS", 8)
    monkeypatch.setattr(blocks, "_matrix", lambda column, dim, real=blocks._matrix: real(column, dim) if len(column) <= 11 else pytest.fail("more rows at once than a slice"))
    assert rows(score(left, right)) == whole and len(whole) == 350


@pytest.mark.parametrize(("share", "cells", "rows"), [(0.0, 50, 7), (2.0, 50, 300), (0.05, 100_000, 7)])
def test_counts_by_product_and_by_lists_agree(spark, tokens, monkeypatch, share, cells, rows):
    monkeypatch.setattr(overlap, "DENSE_SHARE", share)
    monkeypatch.setattr(overlap, "CELLS", cells)
    monkeypatch.setattr(overlap, "RIGHT_ROWS", rows)
    _, right = tokens
    schema = spark.createDataFrame([], "user_id string, left_id string, right_id string, score long").schema
    table = overlap.pa.table({"user_id": ["u"] * len(right), "id": [r[1] for r in right], "tokens": [r[2] for r in right]})
    met = overlap._counter(["user_id"], 3, 1, True, schema)(table, table.append_column("own", table.column("id")))
    one = [("u", *r[1:]) for r in right]
    assert {(r["left_id"], r["right_id"]): r["score"] for r in met.to_pylist()} == {p: s for p, (s, _) in brute(one, one, 3, above=1, not_self=True).items()}


def test_scopes_are_applied_before_the_cut(spark):
    chunks = [("u", f"n{i}#0", f"n{i}", "even" if i % 2 == 0 else "odd", ["t3"] if i % 3 == 0 else [], ["x"]) for i in range(90)]
    rdf = spark.createDataFrame(
        chunks, "user_id string, chunk_id string, note_id string, topic string, tags array<string>, search_terms array<string>"
    )
    asked = [
        ("u", "all", ["x"], [], [], []),
        ("u", "ids", ["x"], ["n88", "n1", "zz"], [], []),
        ("u", "both", ["x"], [], ["odd"], ["t3", "no"]),
        ("other", "foreign", ["x"], [], [], []),
    ]
    ldf = spark.createDataFrame(
        asked,
        "user_id string, question_id string, search_terms array<string>, scope_note_ids array<string>, "
        "scope_topics array<string>, scope_tags array<string>",
    )
    got = {}
    for r in R.keyword_topk(ldf, rdf, 30).collect():
        got.setdefault(r.question_id, set()).add(r.chunk_id)
    assert len(got["all"]) == 30
    assert got["ids"] == {"n88#0", "n1#0"}
    assert got["both"] == {f"n{i}#0" for i in range(90) if i % 2 and i % 3 == 0}
    assert "foreign" not in got


def scoped_rows(spark, seed=4):
    """Chunks, questions with every kind of scope, and which notes each question may see, read off one by one."""
    rng = random.Random(seed)
    notes = [(rng.choice("uv"), f"n{i}", rng.choice(["a", "b", None]), rng.sample(["t1", "t2", "t3"], rng.randrange(0, 4))) for i in range(60)]
    chunks = [(u, f"{n}#{j}", n, topic, tags, ["x", f"w{rng.randrange(9)}"], [rng.random() for _ in range(4)]) for u, n, topic, tags in notes for j in range(2)]
    pick = lambda items, n: rng.sample(items, rng.randrange(0, n))
    asked = [
        (rng.choice("uvw"), f"q{i}", ["x", f"w{i % 9}"], [rng.random() for _ in range(4)], *((pick([f"n{j}" for j in range(60)], 9), pick(["a", "b", "z"], 3), pick(["t1", "t2", "t9"], 3)) if i % 5 else ([], None, [])))
        for i in range(40)
    ]
    asked.append(("u", "twice", ["x"], [1.0, 0.0, 0.0, 0.0], ["n1", "n1"], ["a", "a"], ["t1", "t2"]))
    sees = {}
    for u, q, _, _, ids, topics, tags in asked:
        sees[q] = {n for v, n, topic, have in notes if u == v and (not ids or n in ids) and (not topics or topic in topics) and (not tags or set(tags) & set(have))}
    cdf = spark.createDataFrame(chunks, "user_id string, chunk_id string, note_id string, topic string, tags array<string>, search_terms array<string>, embedding array<double>")
    qdf = spark.createDataFrame(asked, "user_id string, question_id string, search_terms array<string>, embedding array<double>, scope_note_ids array<string>, scope_topics array<string>, scope_tags array<string>")
    return chunks, cdf, asked, qdf, sees


def test_scopes_hold_on_both_channels(spark):
    chunks, cdf, asked, qdf, sees = scoped_rows(spark)
    note = {c[1]: c[2] for c in chunks}
    owner = {c[1]: c[0] for c in chunks}
    for got in (R.keyword_topk(qdf, cdf, 200), R.dense_topk(qdf, cdf, 4, 200), R.hybrid(qdf, cdf, 4, 200)):
        found = {}
        for r in got.collect():
            found.setdefault(r.question_id, []).append(r.chunk_id)
            assert owner[r.chunk_id] == r.user_id
        assert {q: sorted(c) for q, c in found.items()} == {q: sorted(c for c in note if note[c] in may) for q, may in sees.items() if may}


def test_equal_scopes_are_one_set(spark):
    _, cdf, asked, qdf, _ = scoped_rows(spark)
    members = scopes.scope_members(qdf.unionByName(qdf), cdf.select("user_id", "note_id", "topic", "tags").distinct())
    assert members.count() == members.distinct().count()
    rows = scopes.with_scope_id(qdf.where("question_id IN ('twice')").unionByName(qdf.where("question_id = 'twice'").withColumn("scope_note_ids", F.array(F.lit("n1"))))).select("scope_id").distinct()
    assert rows.count() == 1


def test_hot_keys_are_few(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    rows = hot_keys(df, ["k"], 100, "n").collect()
    assert [(r.k, r.n) for r in rows] == [("hot", 7)]


def test_preceding_rows_over_ranges(spark):
    rng = random.Random(5)
    turns = {"a": sorted(rng.sample(range(5000), 300)), "b": [0, 1, 2], "c": [17, 4999]}
    df = spark.createDataFrame([(g, t, f"{g}{t}") for g, ts in turns.items() for t in ts], "g string, t long, v string")
    got = {(r.g, r.t): r.prev for r in preceding_rows(df, ["g"], "t", F.col("v"), 6, "prev", bucket=64).collect()}
    for g, ts in turns.items():
        for i, t in enumerate(ts):
            assert got[(g, t)] == [f"{g}{x}" for x in ts[max(0, i - 6) : i]]
    assert len(got) == 305


def test_find_quotes_equals_contains(spark):
    notes = [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "xalpha betay, the end"), (3, "知识库 检索 a-b"), (4, "one two three four five six")]
    quotes = [(1, "ta gamma delta epsilon zeta e"), (2, "pha bet"), (3, "beta gamma delta"), (4, "识"), (5, "-"), (6, "e t"), (7, "absent words here now and then"), (8, "two three fou")]
    ndf = spark.createDataFrame(notes, "note_id long, content string")
    qdf = spark.createDataFrame(quotes, "quote_id long, quote string")
    got = {(r.quote_id, r.note_id, r.start, r.stop) for r in find_quotes(ndf, qdf).collect()}
    assert got == {(q, n, c.index(t), c.index(t) + len(t)) for n, c in notes for q, t in quotes if t in c}


def test_find_quotes_within_users(spark):
    ndf = spark.createDataFrame([("u", 1, "alpha beta gamma delta epsilon zeta"), ("v", 1, "alpha beta gamma delta epsilon zeta"), ("w", 2, "other")], "user_id string, note_id long, content string")
    qdf = spark.createDataFrame([("u", 1, "beta gamma"), ("w", 2, "beta gamma"), ("v", 3, "alpha beta gamma delta epsilon zeta")], "user_id string, quote_id long, quote string")
    assert {(r.user_id, r.quote_id, r.note_id) for r in find_quotes(ndf, qdf, within=("user_id",)).collect()} == {("u", 1, 1), ("v", 3, 1)}


def fused(spark, dense, keyword):
    def ranked(ids):
        rows = [("u", "q", c, i) for i, c in enumerate(ids, 1)]
        return spark.createDataFrame(rows, "user_id string, question_id string, chunk_id string, rank int")

    return R.fuse(ranked(dense), ranked(keyword))


def test_fusion_order_and_score(spark):
    rows = fused(spark, ["d1", "both"], ["k1", "both"]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["both", "d1", "k1"]
    assert rows[0].score == pytest.approx(2 / 62)


def greedy(ids):
    out, per = [], Counter()
    for c in ids:
        n = c[0]
        if per[n] < 2 and (n in per or len(per) < 5):
            out.append(c)
            per[n] += 1
        if len(out) == 8:
            break
    return out


def test_context_equals_greedy(spark):
    rng = random.Random(2)
    cases = {f"q{i}": [rng.choice("abcdefghij") + str(j) for j in range(rng.randint(0, 40))] for i in range(60)}
    cases["fixed"] = ["a1", "a2", "a3", "b1", "b2", "c1", "d1", "e1", "f1", "g1"]
    rows = [("u", q, c, c[0], i) for q, ids in cases.items() for i, c in enumerate(ids, 1)]
    df = spark.createDataFrame(rows, "user_id string, question_id string, chunk_id string, note_id string, rank int")
    got = {}
    for r in R.select_context(df).orderBy("question_id", "position").collect():
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == {q: greedy(ids) for q, ids in cases.items() if ids}
    assert got["fixed"] == ["a1", "a2", "b1", "b2", "c1", "d1", "e1"]
