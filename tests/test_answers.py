import pytest
from pyspark.sql import functions as F

from lorebank.functions.embed import embed_column, hash_embedder
from lorebank.functions.tokens import search_terms
from lorebank.operators import answers as A
from lorebank.operators import edits as ED
from lorebank.operators import gates as G
from lorebank.operators import index as I
from lorebank.operators import organise as O
from lorebank.operators import retrieval as R

CTX = "user_id string, question_id string, position int, chunk_id string, note_id string, title string, source string, content string"
PROP = "user_id string, question_id string, pos int, chunk_id string, note_id string, quote string"
NOTES = "user_id string, note_id string, title string, content string, summary string, tags array<string>, topic string, source string, updated_at string"


def notes_df(spark, rows):
    return spark.createDataFrame(rows, NOTES).withColumn("updated_at", F.col("updated_at").cast("timestamp"))


def test_history_is_cut_before_roles_are_filtered(spark):
    said = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(8)] + [(1, 8, "user", " ask ")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.query for r in A.history_queries(df).collect()}
    assert got[8] == "m2\nm4\nm6\nask"
    assert got[0] == "m0" and 1 not in got


def test_chunk_citations(spark):
    ctx = spark.createDataFrame([("u", "q", 1, "c1", "n1", "T", "https://x", "alpha beta gamma" + "z" * 600), ("u", "q", 2, "c2", "n2", "S", "src", "delta")], CTX)
    props = [("u", "q", 0, "c1", "n1", "alpha beta"), ("u", "q", 1, "c1", "n2", "alpha"), ("u", "q", 2, "c1", "n1", "nope"), ("u", "q", 3, "c1", "n1", "z" * 501),
             ("u", "q", 4, "c1", "n1", "alpha beta"), ("u", "q", 5, "c2", "n2", "  "), ("u", "q", 6, "c2", "n2", "delta"), ("u", "other", 0, "c1", "n1", "alpha")]
    got = A.check_chunk_citations(spark.createDataFrame(props, PROP), ctx).orderBy("position").collect()
    assert [(r.chunk_id, r.quote, r.source_url) for r in got] == [("c1", "alpha beta", "https://x"), ("c2", "delta", "")]


def test_chunk_citations_stop_at_twelve_valid(spark):
    ctx = spark.createDataFrame([("u", "q", 1, "c", "n", "T", "", "".join(chr(97 + i) for i in range(20)))], CTX)
    props = [("u", "q", i, "c", "n", "!" if i % 2 else chr(97 + i // 2)) for i in range(40)]
    got = A.check_chunk_citations(spark.createDataFrame(props, PROP), ctx)
    assert got.count() == 12


def test_note_citations_cut_first(spark):
    ranked = spark.createDataFrame([("u", "q", "n", "T", "s", "abc " + "y" * 600)], "user_id string, question_id string, note_id string, title string, source string, content string")
    props = [("u", "q", i, "", "n", "bad") for i in range(11)] + [("u", "q", 11, "", "n", " " + "y" * 501), ("u", "q", 12, "", "n", "abc")]
    got = A.check_note_citations(spark.createDataFrame(props, PROP), ranked).collect()
    assert [len(r.quote) for r in got] == [500]


def test_fallback_answers(spark):
    ctx = spark.createDataFrame([("u", "q", 2, "c2", "n1", "B", "", " two "), ("u", "q", 1, "c1", "n1", "A", "http://a", "one" * 300)], CTX)
    qs = spark.createDataFrame([("u", "q"), ("u", "none")], "user_id string, question_id string")
    got = {r.question_id: r for r in A.fallback_answers(qs, ctx).collect()}
    assert got["q"].answer == "A: " + ("one" * 300)[:500] + "\n\nB: two"
    assert got["q"].source_ids == ["n1"] and not got["q"].insufficient
    assert [c.source_url for c in got["q"].citations] == ["http://a", ""]
    assert got["none"].insufficient and got["none"].citations == [] and got["none"].answer.startswith("The current knowledge library")


def test_model_judgement(spark):
    outs = spark.createDataFrame([("u", "a", " ok ", "extra", False), ("u", "b", "ok", "extra", False), ("u", "c", "", "extra", False), ("u", "d", "ok", None, True)],
                                 "user_id string, question_id string, knowledge_answer string, general_supplement string, insufficient boolean")
    cites = spark.createDataFrame([("u", q, 1, "c", "n", "T", "x", "") for q in "acd"], "user_id string, question_id string, position int, chunk_id string, note_id string, title string, quote string, source_url string")
    got = {r.question_id: r for r in A.judge_model_outputs(outs, cites).collect()}
    assert (got["a"].insufficient, got["a"].general_supplement, got["a"].knowledge_answer) == (False, "", "ok")
    assert (got["b"].insufficient, got["b"].general_supplement) == (True, "extra")
    assert got["c"].insufficient and got["c"].knowledge_answer.startswith("The selected knowledge")
    assert got["d"].insufficient and got["d"].general_supplement == ""


def test_basic_mode_looks_at_twenty_newest_only(spark):
    rows = [("u", f"n{i:02d}", f"title {i}", "cherry apple" if i in (0, 24) else "nothing here", "", ["t"], "x", "", f"2024-01-{i + 1:02d}") for i in range(25)]
    lib = notes_df(spark, rows)
    qs = spark.createDataFrame([("u", "q", "apple cherry?")], "user_id string, question_id string, query string")
    ranked = A.rank_notes(qs, lib)
    got = ranked.orderBy("position").collect()
    assert len(got) == 8 and got[0].note_id == "n24" and got[0].score == 2 and got[1].note_id == "n23"
    answer = A.basic_answers(qs.select("user_id", "question_id"), ranked, lib).first()
    assert answer.source_ids == ["n24"] and answer.answer == "从「title 24」看：cherry apple" and not answer.insufficient


def test_budget(spark):
    rows = [("u", "q", f"n{i}", i, "x" * 6000) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "user_id string, question_id string, note_id string, position int, content string")
    assert [r.chars for r in A.context_budget(df).orderBy("position").collect()] == [5000, 5000, 5000, 5000, 0, 0]


def test_related_and_organise(spark):
    lib = notes_df(spark, [
        ("u", "a", "AI 产品", "river boat river", "", ["water"], "x", "", "2024-01-01"),
        ("u", "b", "boat river", "other", "", [], "x", "", "2024-01-02"),
        ("u", "c", "river", "other", "", ["boat"], "x", "", "2024-01-03"),
        ("v", "d", "river boat", "river", "", [], "x", "", "2024-01-04")])
    got = {r.note_id: r for r in O.organise(lib).collect()}
    # score 3 (river twice, boat once) for both, the newer note first; never another user's note
    assert [r.id for r in got["a"].related_notes] == ["c", "b"]
    assert got["a"].tags == ["AI", "产品思考"] and got["b"].tags == ["待整理"] and got["a"].topic == "素材库"
    assert got["d"].related_notes == []


def test_generated_document(spark):
    lib = notes_df(spark, [("u", "a", "One", "# One\n\ntext", "sum", [], "x", "https://s", "2024-01-01"), ("u", "b", "Two", "body", "", [], "x", "", "2024-01-02")])
    req = spark.createDataFrame([("u", "r", "outline", []), ("u", "s", "zzz", ["a"])], "user_id string, request_id string, output_type string, scope_note_ids array<string>")
    got = {r.request_id: r.markdown for r in O.generated_documents(req, lib).collect()}
    assert got["r"] == "# 文章大纲\n\n## 关键素材\n1. Two\n   - body\n2. One\n   - sum\n\n## 来源引用\n- Two\n- One：https://s\n"
    assert got["s"].startswith("# 内容输出\n\n## 关键素材\n1. One")


def test_gates(spark):
    rows = [("n1", "ok", "c", "s", [" a ", "a", ""], "t", "", []), ("n2", "x" * 201, "c", "s" * 2001, ["y" * 51], "t" * 101, "", ["r"] * 51), ("n3", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "note_id string, title string, content string, summary string, tags array<string>, topic string, source string, related_note_ids array<string>")
    got = {r.note_id: r for r in G.check_notes(df).collect()}
    assert got["n1"].accepted and got["n1"].tags == ["a"]
    assert got["n2"].reasons == ["title", "summary", "tags", "topic", "related_note_ids"]
    assert got["n3"].accepted and got["n3"].title == "未命名素材" and got["n3"].topic == "Inbox" and got["n3"].tags == []


def test_patches(spark):
    lib = spark.createDataFrame([("u", "a", "T", "c", "x"), ("u", "b", "T", "c", "x")], "user_id string, note_id string, title string, content string, topic string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    patch = spark.createDataFrame([("u", "a", "", None, "y")], "user_id string, note_id string, title string, content string, topic string")
    got = {r.note_id: r for r in ED.apply_patches(lib, patch, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert (got["a"].title, got["a"].content, got["a"].topic, got["a"].content_changed, got["a"].updated_at.month) == ("未命名素材", "c", "y", False, 2)
    assert (got["b"].title, got["b"].updated_at.month) == ("T", 1)


def test_tag_edits(spark):
    lib = spark.createDataFrame([("u", "a", ["x", "y"])], "user_id string, note_id string, tags array<string>")
    ops = [("u", "a", 1, "add", "#z"), ("u", "a", 2, "remove", "x"), ("u", "a", 3, "add", "w"), ("u", "a", 4, "add", "x"), ("u", "a", 5, "remove", "w"), ("u", "a", 6, "add", " ")]
    edits = spark.createDataFrame(ops, "user_id string, note_id string, seq long, op string, tag string")
    assert ED.apply_tag_edits(lib, edits).first().tags == ["y", "z", "x"]


GARDEN = [
    ("soil", "土壤酸碱 Soil pH", "番茄喜欢弱酸性土壤，test kit 显示 pH 六点五最合适。"),
    ("water", "浇水节奏 Watering", "夏天清晨浇水，drip irrigation 每次二十分钟即可。"),
    ("frost", "霜冻保护 Frost", "第一次 frost 之前给幼苗盖上 fleece 并搬进温室。"),
    ("compost", "堆肥比例 Compost", "Compost 的 carbon 与 nitrogen 比例大约三十比一。"),
    ("prune", "修剪时间 Pruning", "苹果树在 late winter 修剪，避开结冰的日子。"),
    ("bees", "蜜蜂访花 Bees", "Lavender 与 borage 最吸引 bees，六月开花最多。"),
    ("seeds", "种子保存 Seed saving", "种子要放在 airtight jar 里，加一包 silica gel。"),
    ("rotation", "轮作计划 Rotation", "同一块地三年内不要重复种 brassica，否则 clubroot 会累积。"),
    ("tools", "工具保养 Tools", "Secateurs 用完擦干，每月 sharpen 一次刀刃。"),
    ("mulch", "覆盖物 Mulch", "厚五厘米的 straw mulch 能减少 evaporation。"),
]
ASKED = [
    ("番茄需要怎样的土壤 pH？", "soil"), ("drip irrigation 浇水多久？", "water"), ("frost 来之前怎么保护幼苗？", "frost"), ("compost 的 carbon nitrogen 比例？", "compost"),
    ("苹果树什么时候修剪？", "prune"), ("哪些花吸引 bees？", "bees"), ("种子怎样保存在 jar 里？", "seeds"), ("为什么 brassica 要轮作？", "rotation"), ("多久 sharpen 一次刀刃？", "tools"), ("straw mulch 有多厚？", "mulch"),
]


def test_retrieval_quality_on_bilingual_notes(spark):
    notes = spark.createDataFrame([("u", k, t, c, "") for k, t, c in GARDEN] + [("other", "private", "copy", GARDEN[0][2], "")], "user_id string, note_id string, title string, content string, source string")
    chunks = I.index_rows(notes, hash_embedder())
    qs = spark.createDataFrame([("u", str(i), q) for i, (q, _) in enumerate(ASKED)], "user_id string, question_id string, query string")
    qs = qs.withColumn("search_terms", search_terms("query")).withColumn("embedding", embed_column("query", hash_embedder()))
    context = R.with_payload(R.select_context(R.hybrid(qs, chunks, 1536)), chunks, notes)
    cited = context.select("user_id", "question_id", "position", "note_id", F.col("user_id").alias("note_owner"), "ordinal", F.left("content", F.lit(500)).alias("quote"), "content")
    body = {k: c for k, _, c in GARDEN}
    expected = spark.createDataFrame([("u", str(i), k, 0, body[k]) for i, (_, k) in enumerate(ASKED)], "user_id string, question_id string, expected_note string, expected_ordinal int, expected_quote string")
    r = A.retrieval_quality(expected, cited).first()
    assert r.questions == 10 and r.hit_rate >= 0.9 and r.verbatim_rate == 1 and r.leaks == 0
    assert "private" not in {x.note_id for x in context.collect()}


def test_whole_texts_ask_and_answers_are_quoted(spark):
    """Notes that differ only behind their first 160 characters find themselves; a stored chunk that left its note shows."""
    from lorebank.plans.retrieval_queries import whole_text_quality

    same = "every note of this user begins with one and the same words " * 4
    rows = [("u", f"n{i}", f"t{i}", same + f"and closes alone with marker{i} zebra{i * 7} quill{i * 13}", "") for i in range(12)]
    notes = spark.createDataFrame(rows, "user_id string, note_id string, title string, content string, source string")
    chunks = I.index_rows(notes, hash_embedder())
    r = whole_text_quality(chunks, chunks, notes, 1536).first()
    assert (r.questions, r.hits, r.verbatim_rate, r.leaks) == (12, 12, 1, 0)
    moved = notes.withColumn("user_id", F.when(F.col("note_id") == "n3", "v").otherwise(F.col("user_id")))
    broken = chunks.withColumn("content", F.when(F.col("note_id") == "n5", F.concat(F.lit("altered "), "content")).otherwise(F.col("content")))
    r = whole_text_quality(chunks, broken, moved, 1536).first()
    assert r.hits == 12 and r.verbatim_rate < 1 and r.leaks > 0


def test_quality_counts_leaks_and_broken_quotes(spark):
    """A citation of another user's note and one that is not verbatim show in the figures."""
    asked = spark.createDataFrame([("u", "q", "n", 0, "word")], "user_id string, question_id string, expected_note string, expected_ordinal int, expected_quote string")
    schema = "user_id string, question_id string, position int, note_id string, note_owner string, ordinal int, quote string, content string"
    cited = [("u", "q", 1, "n", "u", 0, "a word", "a word here"), ("u", "q", 2, "private", "v", 0, "a word", "a word here"), ("u", "q", 3, "n", "u", 1, "changed", "a word here")]
    r = A.retrieval_quality(asked, spark.createDataFrame(cited, schema)).first()
    assert (r.questions, r.hits, r.leaks) == (1, 1, 1) and abs(r.verbatim_rate - 2 / 3) < 1e-9
