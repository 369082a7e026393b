import pytest
from pyspark.sql import functions as F

from lorebank.functions import provenance as P
from lorebank.functions import text as X
from lorebank.functions import tokens as T
from lorebank.functions import urls as U
from lorebank.sources import uploads, vault


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("body", "title"),
    [
        ("intro\n# Real title \ntext", "Real title"),
        ("\n  \n first line here \nmore", "first line here"),
        ("x" * 60, "x" * 48),
        (" \n　\n", "未命名笔记"),
        ("## Not level one\ntext", "## Not level one"),
    ],
)
def test_title_from_body(spark, body, title):
    assert one(spark, body, X.title_from_body) == title


def test_title_with_fallback(spark):
    assert one(spark, "no heading", lambda c: X.title_with_fallback(c, F.lit("given"))) == "given"
    assert one(spark, "no heading", lambda c: X.title_with_fallback(c, F.lit(""))) == "未命名素材"
    assert one(spark, "a\n# H\nb", lambda c: X.title_with_fallback(c, F.lit("given"))) == "H"


def test_summary_plain_and_quote(spark):
    assert one(spark, "# Head\n\nsome   text\nhere", X.summary_of) == "Head some text here"
    assert len(one(spark, "word " * 50, X.summary_of)) == 96
    assert one(spark, "a ```js\ncode\n``` **b** [c](d)", X.plain_text) == "a b cd"
    assert one(spark, "# T\n\nbody text", X.default_quote) == "body text"
    assert one(spark, "# T", X.default_quote) == "# T"


def test_unicode_whitespace_counts_as_blank(spark):
    for ch in "\t\n\x0b\f\r       　﻿":
        assert one(spark, ch * 2, X.is_blank) is True
    assert one(spark, "​", X.is_blank) is False
    assert one(spark, "　a ", X.trim_ws) == "a"


def test_search_terms(spark):
    assert one(spark, "Word WORD, 知识库检索", T.search_terms) == ["word", "知识", "识库", "库检", "检索"]
    assert one(spark, "café Привет 知", T.search_terms) == ["caf"]
    assert one(spark, None, T.search_terms) == []


def test_overlap_tokens_keep_duplicates(spark):
    assert one(spark, "The the a 知识", T.overlap_tokens) == ["the", "the", "知识", "知识"]


def test_segments_rebuild_the_text(spark):
    text = "abc知识, 你好! (x) -- ok"
    assert "".join(one(spark, text, T.segments)) == text


def test_redaction(spark):
    line = "at postgres://a:b@c/d and Bearer abc.def-1 end"
    assert one(spark, line, X.redact_log) == "at [database-url-redacted] and Bearer [redacted] end"


def test_first_json_object(spark):
    assert one(spark, 'Sure: {"a": {"b": 1}} bye', X.first_json_object) == '{"a": {"b": 1}}'
    assert one(spark, " none ", X.first_json_object) == "none"


@pytest.mark.parametrize(
    ("url", "verdict"),
    [
        ("https://example.org/a?b#c", "ok"),
        ("ftp://example.org", "bad_scheme"),
        ("https://u:p@example.org", "credentials"),
        ("http://localhost:3000", "blocked_host"),
        ("http://printer.local/", "blocked_host"),
        ("http://metadata.google.internal./", "blocked_host"),
        ("http://127.0.0.1", "private_address"),
        ("http://172.31.0.1", "private_address"),
        ("http://172.32.0.1", "ok"),
        ("http://169.254.169.254/latest", "private_address"),
        ("http://2130706433/", "private_address"),
        ("http://0177.1/", "private_address"),
        ("http://[::1]/", "private_address"),
        ("http://[fe80::1]/", "private_address"),
        ("http://[::ffff:10.0.0.1]/", "private_address"),
        ("http://[2606:4700::1111]/", "ok"),
        ("http://[2001:db8::1]/", "private_address"),
        ("no url", "bad_format"),
        (None, "bad_format"),
    ],
)
def test_url_verdict(spark, url, verdict):
    assert one(spark, url, U.url_verdict) == verdict


def test_url_routing(spark):
    assert one(spark, "https://www.youtube.com/watch?v=1", U.media_route) == "video"
    assert one(spark, "https://a.org/x.mp3?y", U.media_route) == "podcast"
    assert one(spark, "https://a.org/?utm_source=feed", U.media_route) == "podcast"
    assert one(spark, "https://a.org/", U.media_route) == "article"
    assert one(spark, "https://www.a.org/", U.platform_of) == "a.org"
    assert one(spark, "see https://b23.tv/x，ok", U.embedded_url) == "https://b23.tv/x"
    assert one(spark, "https://a.org/x/%E4%BD%A0.pdf?q", U.file_name_from_url) == "你.pdf"


def test_provenance_round_trip(spark):
    block = lambda c: P.source_markdown(
        F.lit("T"), c, F.lit("a.org"), F.lit("https://a.org/1"), F.lit("公开网页正文提取"), F.lit("article"), F.lit("now")
    )
    md = one(spark, " body ", block)
    assert md.startswith("# T\n\n## 来源追踪\n\n- 平台：a.org\n") and md.endswith("\n\nbody\n")
    got = one(spark, md, lambda c: P.parse_trace(c, F.lit("")))
    assert (got.platform, got.reliability, got.source_url) == ("a.org", "原文链接", "https://a.org/1")
    plain = one(spark, "text", lambda c: P.parse_trace(c, F.lit("")))
    assert (plain.platform, plain.import_method, plain.reliability, plain.source_url) == ("未知来源", "手动创建", "手动创建", "")


def test_reliability_order(spark):
    def rel(url, method, kind="article"):
        return one(spark, url, lambda c: P.reliability(c, F.lit(method), F.lit(kind)))

    assert rel("https://a", "自动字幕转写") == "自动字幕"
    assert rel("", "上传图片", "image") == "上传图片"
    assert rel("", "上传", "video") == "上传文件"
    assert rel("手动粘贴", "x") == "手动粘贴"
    assert rel("", "x") == "链接卡片"


def test_front_matter(spark):
    md = '---\ntitle: "A: b"\ntags: ["x", \'y\', ]\ntopic: T\ntitle: Last\nnoise\n---\n\n Body \n'
    got = one(spark, md, lambda c: vault.note_fields(c, F.lit("f.md")))
    assert (got.title, got.tags, got.topic, got.content, got.source) == ("Last", ["x", "y"], "T", "Body", "f.md")
    bare = one(spark, "# Head\ntext", lambda c: vault.note_fields(c, F.lit("g.md")))
    assert (bare.title, bare.tags, bare.topic, bare.summary) == ("Head", [], "Inbox", "")


@pytest.mark.parametrize(
    ("data", "kind"),
    [
        (b"\xff\xd8\xff" + b"0" * 20, "image"),
        (b"RIFF0000WEBP" + b"0" * 9, "image"),
        (b"RIFF0000WAVE" + b"0" * 9, "media"),
        (b"0000ftypisom0000", "media"),
        (b"\xff\xe3" + b"0" * 20, "media"),
        (b"%PDF-1.7 and more", ""),
        (b"\xff\xd8\xff", ""),
    ],
)
def test_file_kind(spark, data, kind):
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    assert df.select(uploads.file_kind("c").alias("k")).first()["k"] == kind
