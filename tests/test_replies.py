"""Replies held against the rules of the reply contract, read field by field in plain Python."""

import json

import pytest

from lorebank.operators import replies as P

ODD = [None, False, True, 0, 1, -0.0, 2.5, "", " ", "text", "false", [], [1], {}, {"a": 1}]


def text(x):
    if isinstance(x, (list, dict)) or not x:
        return ""
    return "true" if x is True else str(x)


def truth(x):
    return isinstance(x, (list, dict)) or bool(x)


def read(reply):
    """knowledge answer, supplement, insufficient, citations, bad."""
    start, stop = reply.find("{"), reply.rfind("}")
    try:
        got = json.loads(reply[start : stop + 1] if 0 <= start < stop else reply.strip())
    except ValueError:
        return "", "", False, [], True
    got = got if isinstance(got, dict) else {}
    cites = got.get("citations")
    found = [(i, *(text(c.get(k)) if isinstance(c, dict) else "" for k in ("chunkId", "noteId")), c["quote"] if isinstance(c, dict) and isinstance(c.get("quote"), str) else "") for i, c in enumerate(cites)] if isinstance(cites, list) else []
    return text(got.get("knowledgeAnswer")), text(got.get("generalSupplement")), truth(got.get("insufficient")), found, False


def cases():
    out = [json.dumps({"knowledgeAnswer": a, "generalSupplement": b, "insufficient": c}) for a, b, c in zip(ODD, ODD[3:] + ODD[:3], ODD[7:] + ODD[:7])]
    out += [json.dumps({"citations": c}) for c in (ODD, [{"chunkId": x, "noteId": y, "quote": z} for x, y, z in zip(ODD, ODD[1:], ODD[2:])], {"chunkId": "c"}, "c", None)]
    good = json.dumps({"knowledgeAnswer": 'a "b" {c} \n 知识', "citations": [{"chunkId": "n#0", "noteId": "n", "quote": "q"}]})
    out += [good, f"Sure:\n```json\n{good}\n```\nbye", good[:-1], "{" + good, good + good, "", " ", "no json", "[1, 2]", "null", "3", '"text"', "{}", "{]}", "}{"]
    return out


@pytest.mark.parametrize("cut", [0, 1])
def test_replies_are_read_by_their_contract(spark, cut):
    texts = cases()[cut::2]
    df = spark.createDataFrame([("u", f"q{i}", t) for i, t in enumerate(texts)], "user_id string, question_id string, reply string")
    got = {r.question_id: (r.knowledge_answer, r.general_supplement, r.insufficient, [tuple(c) for c in r.citations], r.bad) for r in P.parse_replies(df).collect()}
    for i, t in enumerate(texts):
        assert got[f"q{i}"] == read(t), t


def test_a_missing_reply_is_bad_and_metrics_fall_back(spark):
    df = spark.createDataFrame([("u", "a", "{}"), ("u", "b", None), ("u", "c", "x")], "user_id string, question_id string, reply string")
    parsed = P.parse_replies(df)
    assert {r.question_id: r.bad for r in parsed.collect()} == {"a": False, "b": True, "c": True}
    rows = [("u", "a", "hybrid", 1, 2, 3), ("u", "b", "hybrid", 1, 0, 1), ("u", "c", "keyword", 0, 0, 0), ("u", "d", "basic", 0, 5, 5), ("u", "e", "dense", 1, 1, 1)]
    counts = spark.createDataFrame(rows, "user_id string, question_id string, retrieval_mode string, dense_count long, keyword_count long, context_count long")
    got = {tuple(r)[:5] for r in P.answer_metrics(counts, parsed).collect() if r.event == "answer_generation"}
    event, why = "answer_generation", "answer_generation_failed"
    assert got == {(event, "model", "hybrid", None, 1), (event, "fallback", "hybrid", why, 1), (event, "fallback", "keyword", None, 1), (event, "model", "basic", None, 1), (event, "fallback", "dense", why, 1)}
