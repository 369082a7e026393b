import os

import pytest
from pyspark.sql import functions as F

from lorebank.operators import facets as FA
from lorebank.sources import captions, feeds, library, uploads, vault, web

LONG = "word " * 40


@pytest.fixture(scope="module")
def imported(spark):
    pages = [
        ("article", "https://a.org/x", f"<html><head><title>T &amp; U</title><script>var x='<p>';</script></head><body><nav>menu</nav><article><h1>Head</h1><p>{LONG}<a href=\"/l\">link</a></p></article></body></html>"),
        ("short", "https://a.org/y", "<html><title>S</title><body><p>tiny</p></body></html>"),
        ("platform", "https://mp.weixin.qq.com/s/1", f"<html><h1 id='activity-name'> Name </h1><span id=\"js_name\">Ann</span><em id='publish_time'>2024-01-01</em><div id='js_content'><p>{LONG}</p><div>in <div>deep</div></div>tail<script>bad()</script></div><div>noise</div></html>"),
        ("video", "https://youtu.be/1", "<title>Clip</title>"),
        ("podcast", "https://pod.org/feed", "<head><meta content='Show' property='og:title'></head><body><audio src='/a.mp3'></audio><main>About us</main></body>"),
        ("bad", "nothing", "<p>x</p>"),
    ]
    df = spark.createDataFrame([(i, "u", u, h) for i, u, h in pages], "import_id string, user_id string, url string, html string")
    out = web.import_pages(df, F.lit("2024-01-01T00:00:00.000Z"))
    return out, {r.import_id: r for r in out.collect()}


def test_article(imported):
    r = imported[1]["article"]
    assert (r.status, r.title, r.platform, r.source_type, r.warnings) == ("ready", "T & U", "a.org", "article", [])
    assert "# Head" in r.markdown and "[link](/l)" in r.markdown and "menu" not in r.markdown and "- 来源可信度：原文链接" in r.markdown


def test_short_page_needs_action(imported):
    r = imported[1]["short"]
    assert r.status == "needs-action" and r.extracted_text == "" and len(r.warnings) == 1 and "链接卡片待补全" in r.markdown


def test_platform_layout(imported):
    r = imported[1]["platform"]
    assert (r.status, r.title, r.platform, r.warnings) == ("ready", "Name", "微信公众号", ["作者：Ann"])
    assert "deep" in r.markdown and "tail" in r.markdown and "noise" not in r.markdown and "bad()" not in r.markdown
    assert "- 发布时间：2024-01-01" in r.markdown


def test_other_routes(imported):
    rows = imported[1]
    assert rows["video"].status == "needs-action" and "## 待补全素材" in rows["video"].markdown
    assert rows["podcast"].title == "Show" and rows["podcast"].status == "needs-action" and "音频链接：/a.mp3" in rows["podcast"].markdown
    assert rows["bad"].status == "failed" and rows["bad"].markdown == ""


def test_imports_become_notes(imported):
    rows = {r.note_id: r for r in library.imports_to_notes(imported[0], F.current_timestamp()).collect()}
    assert "bad" not in rows and rows["article"].tags == ["文章", "a.org", "外部素材"] and rows["article"].topic == "文章素材"
    assert rows["video"].topic == "视频素材" and rows["platform"].source == "https://mp.weixin.qq.com/s/1"


VTT = "WEBVTT\r\n\r\nNOTE x\r\n\r\n1\r\n00:00.000 --> 00:01.000\r\n<c.a>Hello</c> there\r\nHello there\r\n\r\n2\r\n00:01.000 --> 00:02.000\r\n<00:01>\r\nbye\r\n"


def test_captions(spark):
    df = spark.createDataFrame([(VTT,)], "v string")
    assert df.select(captions.transcript_of("v").alias("t")).first().t == "Hello there\nbye"
    rows = [("m", "en", "manual", "vtt", 0, VTT), ("m", "zh", "automatic", "vtt", 1, VTT), ("m", "zh-Hans", "manual", "srv", 2, VTT), ("m", "zh", "manual", "vtt", 3, VTT), ("k", "de", "manual", "vtt", 0, VTT)]
    table = spark.createDataFrame(rows, "media_id string, lang string, kind string, ext string, pos int, text string")
    got = captions.best_captions(table).collect()
    assert [(r.media_id, r.pos) for r in got] == [("m", 3)]
    media = spark.createDataFrame([("m", "u", "https://youtu.be/1", "", "")], "import_id string, user_id string, url string, title string, uploader string")
    note = captions.caption_imports(media, table, F.lit("now")).first()
    assert note.title == "YouTube 视频" and note.status == "ready" and note.extracted_text == "Hello there\nbye"
    silent = captions.caption_imports(media.withColumn("import_id", F.lit("k")), table, F.lit("now")).first()
    assert (silent.status, silent.extracted_text, silent.warnings) == ("needs-action", "", ["未找到字幕。"]) and "## 待补全素材" in silent.markdown


def test_gate_audio_feeds_and_other_body_nodes(spark):
    pages = [
        ("audio", "https://a.org/My%20show.mp3?x=1", "<p>x</p>"),
        ("feed", "https://a.org/feed/1", RSS),
        ("private", "http://192.168.1.4/x", f"<article><p>{LONG}</p></article>"),
        ("login", "https://me:pw@a.org/", f"<article><p>{LONG}</p></article>"),
        ("section", "https://mp.weixin.qq.com/s/2", f"<b class='rich_media_meta_nickname'>Bo</b><section id='js_content'><section>{LONG}</section>tail</section><p>noise</p>"),
    ]
    df = spark.createDataFrame([(i, "u", u, h) for i, u, h in pages], "import_id string, user_id string, url string, html string")
    got = {r.import_id: r for r in web.import_pages(df, F.lit("now")).collect()}
    assert (got["audio"].status, got["audio"].source_type, got["audio"].title) == ("needs-action", "podcast", "My show.mp3") and got["audio"].extracted_text == ""
    assert got["feed"].title == "New" and got["feed"].status == "needs-action" and "https://a.org/1.mp3" in got["feed"].markdown
    assert [got[k].status for k in ("private", "login")] == ["failed", "failed"] and got["private"].source_url == ""
    assert "tail" in got["section"].markdown and "noise" not in got["section"].markdown and got["section"].warnings == ["作者：Bo"]


RSS = '<rss><channel><title> My  show </title><item><title>New</title><description>&lt;b&gt;Bold&lt;/b&gt; words</description><enclosure url="https://a.org/1.mp3" length="1"/></item><item><title>Old</title></item></channel></rss>'


def test_feeds(spark, tmp_path):
    df = spark.createDataFrame([("f", "u", "https://a.org/rss", RSS), ("e", "u", "https://a.org/rss", "<rss><channel><title>E</title></channel></rss>")], "import_id string, user_id string, url string, xml string")
    items = [(r.channel, r.title, r.audio) for r in feeds.feed_items(df).where("pos is not null").orderBy("pos").collect()]
    assert items == [("My show", "New", "https://a.org/1.mp3"), ("My show", "Old", "https://a.org/rss")]
    got = {r.import_id: r for r in feeds.feed_imports(df, F.lit("now")).collect()}
    assert (got["f"].title, got["f"].status, got["f"].extracted_text) == ("New", "needs-action", "Bold words")
    assert got["e"].status == "needs-action" and got["e"].title == "E"
    (tmp_path / "feed.xml").write_text(RSS)
    assert [r.title for r in feeds.read_feed_items(spark, str(tmp_path)).collect()] == ["New", "Old"]


def test_vault_files_round_trip(spark, tmp_path):
    rows = [("u", "1", 'A/B: "q"', "body one", "s", ["x", "y"], "T", "src", ["2"]), ("u", "2", "Same", "body two", "", [], "", "", []), ("u", "3", "Same", "body three", "", [], "T", "", [])]
    notes = spark.createDataFrame(rows, "user_id string, note_id string, title string, content string, summary string, tags array<string>, topic string, source string, related_note_ids array<string>")
    notes = notes.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    written = vault.write_vault(vault.vault_files(notes), str(tmp_path)).collect()
    assert {r.file_name for r in written} == {"A-B- -q-.md", "Same-2.md", "Same-3.md"}
    assert sorted(os.listdir(tmp_path / "u")) == sorted(r.file_name for r in written)
    (tmp_path / "u" / "skip.txt").write_text("no")
    back = {r.source: r for r in vault.read_vault(spark, str(tmp_path / "u"), "u").collect()}
    first = back["A-B- -q-.md"]
    assert len(back) == 3 and first.content == "body one" and first.tags == ["x", "y"] and first.related_note_ids == ["2"]
    assert first.created_at == "2024-01-01T00:00:00.000Z" and first.title == 'A/B: \\"q\\"'
    assert back["Same-2.md"].topic == ""


def test_json_library(spark, tmp_path):
    (tmp_path / "lib.json").write_text('[{"id": "1", "title": "", "createdAt": "c"}, {"title": "no id"}, {"id": "2", "tags": ["a"], "topic": "t", "content": "x"}]')
    got = {r.note_id: r for r in library.read_json_library(spark, str(tmp_path), "u").collect()}
    assert set(got) == {"1", "2"} and got["1"].title == "未命名笔记" and got["1"].updated_at == "c" and got["1"].source == "本地笔记"
    assert got["2"].tags == ["a"] and got["1"].tags == []


def test_append_is_gated_and_partitioned(spark, tmp_path):
    rows = [("1", "u", "t", "c", "", [], "x", "", []), ("2", "u", "t" * 201, "c", "", [], "x", "", []), ("3", "v", "", "c", "", ["a", "a"], "", "", [])]
    df = spark.createDataFrame(rows, "note_id string, user_id string, title string, content string, summary string, tags array<string>, topic string, source string, related_note_ids array<string>")
    df = df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    path = str(tmp_path / "notes")
    rejected = library.append_notes(df, path)
    assert [(r.note_id, r.reasons) for r in rejected.collect()] == [("2", ["title"])]
    assert {r.note_id for r in library.read_notes(spark, path).collect()} == {"1", "3"}
    own = library.read_notes(spark, path, "v")
    assert own.first().tags == ["a"] and "PartitionFilters: [isnotnull(user_bucket" in own._jdf.queryExecution().executedPlan().toString()


def test_uploads_source(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"0" * 10)
    (tmp_path / "b.txt").write_bytes(b"just some text here")
    got = {os.path.basename(r.path): r.kind for r in uploads.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.png": "image", "b.txt": ""}


def test_views(spark):
    rows = [("u", "a", "Alpha", "s", "Text One", ["x", "y", "x"], "T", ["b", "zz", "c"], "2024-01-01"), ("u", "b", "Beta", "", "other", ["y"], "", [], "2024-01-02"), ("v", "c", "Gamma", "", "one", [], "T", [], "2024-01-03")]
    n = spark.createDataFrame(rows, "user_id string, note_id string, title string, summary string, content string, tags array<string>, topic string, related_note_ids array<string>, updated_at string")
    assert [r.note_id for r in FA.list_notes(n, "u").collect()] == ["b", "a"]
    assert {r.note_id for r in FA.search_library(n, " ONE ").collect()} == {"a", "c"}
    assert {r.note_id for r in FA.search_library(n, "", "y").collect()} == {"a", "b"}
    assert {r.note_id for r in FA.search_library(n, "text", "全部标签").collect()} == {"a"}
    assert {(r.user_id, r.tag, r.n) for r in FA.tag_facets(n).collect()} == {("u", "全部标签", 2), ("v", "全部标签", 1), ("u", "x", 1), ("u", "y", 2)}
    assert {(r.kind, r.value) for r in FA.filter_options(n).where("user_id = 'u'").collect()} == {("topic", "T"), ("tag", "x"), ("tag", "y")}
    assert [(r.from_note, r.to_note) for r in FA.relation_edges(n).collect()] == [("a", "b")]
    assert {r.note_id for r in n.where(FA.in_scope(note_ids=["a", "c"], tags=["y"])).collect()} == {"a"}
    names = spark.createDataFrame([("b",), ("A",), ("á",), ("B",)], "v string")
    assert [r.v for r in FA.by_locale(names, "v").collect()] == ["A", "á", "b", "B"]
