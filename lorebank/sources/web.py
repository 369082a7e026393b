"""Web pages as imports: routing, text extraction, acceptance and provenance.

Works on a ``pages(import_id, user_id, url, html)`` table; fetching is somebody else's job. Extraction
is a chain of built-in regex expressions in the row, so the job is one scan without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank import constants as K
from lorebank.functions.columns import compute_once
from lorebank.functions.provenance import pending_markdown, source_markdown
from lorebank.functions.text import or_default, plain_text, squash_ws, trim_ws
from lorebank.functions.urls import embedded_url, file_name_from_url, media_route, platform_of, url_verdict


def _chain(text: Column, steps) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", replacement))
    return text


def to_markdown(html: Column) -> Column:
    """Block structure as Markdown, tags dropped, common entities decoded."""
    return trim_ws(_chain(_chain(html, K.HTML_NOISE), K.HTML_TO_MARKDOWN))


def node_text(html: Column) -> Column:
    """Visible text with whitespace collapsed."""
    bare = F.regexp_replace(_chain(html, K.HTML_NOISE), "<[^>]*>", " ")
    for pattern, replacement in K.HTML_TO_MARKDOWN[15:21]:
        bare = F.regexp_replace(bare, pattern, replacement)
    return trim_ws(squash_ws(bare))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag by property or name, either attribute order."""
    after = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    before = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content=["']([^"']*)["'][^>]*(?:property|name)=["']{name}["']""", 1)
    return trim_ws(or_default(after, before))


def document_title(html: Column) -> Column:
    return node_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def by_id(html: Column, name: str) -> Column:
    """Text of a small element by id, up to its next tag end."""
    return node_text(F.regexp_extract(html, rf"""(?is)<[a-z0-9]+\s[^>]*id=["']{name}["'][^>]*>(.*?)</""", 1))


def main_node(html: Column) -> Column:
    """Inner html of the article, else main, else body."""
    parts = [F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}\s*>", 1) for tag in ("article", "main", "body")]
    # cut-off pages: a body that never ends
    parts.append(F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*)$", 1))
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], html)


def by_class(html: Column, name: str) -> Column:
    """Text of a small element by one of its classes, up to its next tag end."""
    return node_text(F.regexp_extract(html, rf"""(?is)<[a-z0-9]+\s[^>]*class=["'][^"']*\b{name}\b[^"']*["'][^>]*>(.*?)</""", 1))


def node_by_id(html: Column, name: str) -> Column:
    """Inner html of an element of any kind by id, with nested elements of its kind balanced."""
    opening = rf"""(?is)<([a-z0-9]+)\s[^>]*id=["']{name}["'][^>]*>(.*)$"""
    tag, rest = F.lower(F.regexp_extract(html, opening, 1)), F.regexp_extract(html, opening, 2)
    # Every piece starts with such a tag (but the first), so the depth only changes between pieces.
    pieces = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)")))
    start = F.struct(F.lit(1).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, piece: Column) -> Column:
        begins = F.lower(F.left(piece, F.length(tag) + 2))
        change = F.when(F.startswith(begins, F.concat(F.lit("</"), tag)), -1).when(F.startswith(begins, F.concat(F.lit("<"), tag)), 1).otherwise(0)
        depth = F.when(a["depth"] <= 0, 0).otherwise(a["depth"] + change)
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.array_append(a["kept"], piece)).otherwise(a["kept"]).alias("kept"))

    return F.array_join(F.aggregate(pieces, start, step, lambda a: a["kept"]), "")


def layout_of(url: Column, html: Column) -> Column:
    """platform (own body node), podcast, audio (a file), feed (an XML body), video or article."""
    route = media_route(url)
    is_platform = F.contains(url, F.lit("mp.weixin.qq.com")) | html.rlike(r"""id=["']js_content["']""")
    is_feed = F.startswith(trim_ws(html), F.lit("<?xml")) | F.contains(html, F.lit("<rss"))
    route = F.when((route == "podcast") & url.rlike(K.AUDIO_URL), "audio").when((route == "podcast") & is_feed, "feed").otherwise(route)
    return F.when(route != "article", route).when(is_platform, "platform").otherwise("article")


def audio_of(html: Column) -> Column:
    """Audio address of a page: meta tags, then the audio element."""
    element = F.regexp_extract(html, r"""(?is)<audio\b[^>]*?\bsrc=["']([^"']*)["']""", 1)
    source = F.regexp_extract(html, r"""(?is)<audio\b.*?<source\b[^>]*\bsrc=["']([^"']*)["']""", 1)
    return or_default(meta(html, "og:audio"), or_default(meta(html, "og:audio:url"), or_default(element, source)))


def import_pages(pages: DataFrame, imported_at: Column) -> DataFrame:
    """Import results: status, source_type, platform, title, markdown, source_url, extracted_text, warnings.

    The url gate comes first: what it refuses fails with its reason, whatever the body. XML bodies under a podcast url are feeds.
    """
    from lorebank.sources.feeds import feed_imports  # feeds use the text rules of this module

    raw = pages.withColumn("url", embedded_url("url"))
    html = F.coalesce("html", F.lit(""))
    gated = compute_once(raw, {"verdict": url_verdict("url")})
    layout = F.when(F.col("verdict") == "ok", layout_of(F.col("url"), html)).otherwise("refused")
    laid = compute_once(gated, {"layout": layout, "html": html, "platform": platform_of("url")})
    feeds = feed_imports(laid.where(F.col("layout") == "feed").select("import_id", "user_id", "url", F.col("html").alias("xml")), imported_at)
    return _pages(laid.where(F.col("layout") != "feed"), imported_at).unionByName(feeds.withColumn("layout", F.lit("feed")))


def _pages(laid: DataFrame, imported_at: Column) -> DataFrame:
    # Only the branch of a row's layout is evaluated; others are null and cost nothing.
    parsed = compute_once(
        laid,
        {
            "body": F.when(F.col("layout") == "platform", node_by_id(F.col("html"), "js_content"))
            .when(F.col("layout").isin("article", "podcast"), main_node(F.col("html"))),
            "doc_title": document_title(F.col("html")),
        },
    )
    parsed = compute_once(
        parsed,
        {
            "text": F.when(F.col("layout").isin("platform", "article"), to_markdown(F.col("body"))),
            "author": F.when(
                F.col("layout") == "platform", or_default(by_id(F.col("html"), "js_name"), by_class(F.col("html"), "rich_media_meta_nickname"))
            ).when(F.col("layout") == "article", meta(F.col("html"), "author")).otherwise(""),
            "og_title": meta(F.col("html"), "og:title"),
        },
    )
    return _outcomes(parsed, imported_at)


def _outcomes(parsed: DataFrame, at: Column) -> DataFrame:
    url, layout, platform, text = (F.col(c) for c in ("url", "layout", "platform", "text"))
    doc_title, og_title, author = F.col("doc_title"), F.col("og_title"), F.col("author")
    valid = F.col("verdict") == "ok"
    refusal = (
        F.when(F.col("verdict") == "credentials", K.WARN_URL_CREDENTIALS)
        .when(F.col("verdict") == "blocked_host", K.WARN_URL_BLOCKED)
        .when(F.col("verdict") == "private_address", K.WARN_URL_PRIVATE)
        .otherwise(K.WARN_BAD_URL)
    )

    platform_title = or_default(
        by_id(F.col("html"), "activity-name"),
        or_default(og_title, or_default(trim_ws(F.regexp_replace(doc_title, f"{K.WECHAT_TITLE_SUFFIX}$", "")), K.WECHAT_TITLE)),
    )
    title = (
        F.when(layout == "platform", platform_title)
        .when(layout == "podcast", or_default(og_title, or_default(doc_title, K.PODCAST_PAGE_TITLE)))
        .when(layout == "audio", or_default(file_name_from_url(url), K.AUDIO_TITLE))
        .when(layout == "video", or_default(og_title, or_default(doc_title, F.concat(platform, F.lit(K.VIDEO_TITLE_SUFFIX)))))
        .otherwise(or_default(doc_title, or_default(og_title, K.EXTERNAL_ARTICLE)))
    )
    audio = F.when(layout == "podcast", audio_of(F.col("html"))).otherwise("")
    about = F.when(
        layout == "podcast",
        or_default(meta(F.col("html"), "og:description"), F.left(node_text(F.col("body")), F.lit(K.PODCAST_DESCRIPTION_LIMIT))),
    ).when(layout == "video", meta(F.col("html"), "og:description"))
    staged = compute_once(
        parsed,
        {"title": title, "audio": audio, "about": about, "published": F.when(layout == "platform", by_id(F.col("html"), "publish_time"))},
    )

    title, audio, about = F.col("title"), F.col("audio"), F.col("about")
    short = (
        F.when((layout == "platform") & ~F.col("html").rlike(r"""id=["']js_content["']"""), K.WARN_NO_WECHAT_BODY)
        .when((layout == "platform") & (F.length(text) < K.WECHAT_MIN_CHARS), K.WARN_SHORT_WECHAT)
        .when((layout == "article") & (F.length(text) < K.ARTICLE_MIN_CHARS), K.WARN_SHORT_ARTICLE)
    )
    status = (
        F.when(~valid, "failed")
        .when(short.isNotNull() | layout.isin("video", "audio") | ((layout == "podcast") & (audio != "")), "needs-action")
        .otherwise("ready")
    )
    source_type = F.when(layout == "audio", "podcast").when(layout.isin("podcast", "video"), layout).otherwise("article")
    method = (
        F.when(short.isNotNull(), K.PENDING_METHOD)
        .when(layout == "platform", K.WECHAT_METHOD)
        .when(layout == "audio", K.AUDIO_METHOD)
        .when(layout == "podcast", F.when(audio != "", K.PODCAST_AUDIO_METHOD).otherwise(K.PODCAST_PAGE_METHOD))
        .otherwise(K.ARTICLE_METHOD)
    )
    facts = F.concat_ws(
        "\n",
        F.lit(K.ARTICLE_FACTS),
        F.lit(f"{K.FACT_PLATFORM}{K.WECHAT_PLATFORM}"),
        F.when(author != "", F.concat(F.lit(K.FACT_AUTHOR), author)),
        F.when(F.col("published") != "", F.concat(F.lit(K.FACT_PUBLISHED), F.col("published"))),
        F.concat(F.lit(K.FACT_LINK), url),
    )
    podcast = F.concat(
        F.lit(f"{K.PODCAST_INTRO}\n\n"),
        or_default(about, K.PODCAST_NO_INTRO),
        F.lit("\n\n"),
        F.when(audio != "", F.concat(F.lit(K.PODCAST_AUDIO_LINE), audio, F.lit(f"\n\n{K.PODCAST_AUDIO_NEXT}"))).otherwise(
            K.PODCAST_NO_AUDIO_NEXT
        ),
    )
    body = (
        F.when(short.isNotNull(), F.concat(F.lit("> "), short))
        .when(layout == "platform", F.concat(facts, F.lit(f"\n\n{K.ARTICLE_BODY}\n\n"), text))
        .when(layout == "podcast", podcast)
        .when(layout == "audio", K.AUDIO_BODY)
        .otherwise(text)
    )
    shown = F.when(layout == "platform", F.when(short.isNull(), K.WECHAT_PLATFORM).otherwise(F.col("platform"))).otherwise(F.col("platform"))
    markdown = (
        F.when(~valid, "")
        .when(
            layout == "video",
            pending_markdown(title, shown, url, source_type, F.lit(K.VIDEO_REASON), or_default(about, K.VIDEO_DESCRIPTION), at),
        )
        .otherwise(source_markdown(title, body, shown, url, method, source_type, at))
    )
    warnings = F.array_compact(
        F.array(
            F.when(~valid, refusal),
            F.when(valid, short),
            F.when(valid & (layout == "video"), F.lit(K.VIDEO_WARNING)),
            F.when(valid & (layout == "audio"), F.lit(K.AUDIO_WARNING)),
            F.when(
                valid & (layout == "podcast"),
                F.when(audio != "", K.PODCAST_WARN_AUDIO).otherwise(K.PODCAST_WARN_NO_AUDIO),
            ),
            F.when(valid & short.isNull() & (author != ""), F.concat(F.lit(K.AUTHOR_PREFIX), author)),
        )
    )
    extracted = (
        F.when(~valid | short.isNotNull() | (layout == "audio"), "").when(layout.isin("podcast", "video"), F.coalesce(about, F.lit(""))).otherwise(plain_text(text))
    )
    result = {
        "status": status,
        "source_type": source_type,
        "platform": F.when(valid, shown).otherwise(K.EXTERNAL_PLATFORM),
        "title": F.when(valid, title).otherwise(K.FAILED_TITLE),
        "source_url": F.when(valid, url).otherwise(""),
        "markdown": markdown,
        "extracted_text": extracted,
        "warnings": warnings,
    }
    return compute_once(staged, result).select("import_id", "user_id", "layout", *result)
