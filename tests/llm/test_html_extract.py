import re
from html import unescape

import pytest

from lorebank.llm import html_extract as h

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
LONG = "This is the text of the article and it is long enough to be decided by the rules for the words that are in it. "
ALSO = "Of the many things that were said on that day, this was the one that he and all of us would not have to hear again. "


def frame(spark, pages):
    return spark.createDataFrame([(i, f"http://x/{i}", p, "t", 1) for i, p in enumerate(pages)], SCHEMA)


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>{LONG}</p>';</script></head><body>{body}</body></html>"


CASES = {
    "boilerplate": (
        f"<header><p>{LONG}</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>{LONG}</div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p>"
        f"<aside>{LONG}</aside><form><p>{LONG}</p></form><div id=comments><p>{LONG}</p></div></article><div class='cookie-notice'>{ALSO}</div><footer>{LONG}</footer>",
        ["Title", LONG, "Short."],
    ),
    "no article element": (
        f"<div class=menu><a href=1>one</a></div><div><h2>Head</h2><p>{LONG}</p><p>tiny</p><p>{ALSO}</p></div><ul><li><a href=1>Some link here</a></li><li><a href=2>Other link</a></li></ul><div class='sidebar'><p>{LONG}</p></div>",
        ["Head", LONG, "tiny", ALSO],
    ),
    "unclosed": (f"<article><p><b>One &amp; two<br><p>{LONG}<p>&lt;b&gt; &#8364; &am", [f"One & two", LONG, "<b> € &am"]),
    "comments and hidden": (f"<main><!-- {LONG} --><p>{LONG}</p><p hidden>{ALSO}</p><p style='display: none'>{ALSO}</p><div role=navigation>{ALSO}</div></main>", [LONG]),
    "page class hint": (f"<div class='page has-sidebar'><article><p>{LONG}</p></article></div>", [LONG]),
    "only hinted": (f"<div class='sidebar'><p>{LONG}</p></div><div id=cookie-notice>{ALSO}</div>", []),
    "comment articles": (f"<article><p>{LONG}</p><section id='comments'><article class='comment-body'><p>{ALSO}</p></article><article><p>{ALSO}</p></article></section></article>", [LONG]),
    "teaser articles": (f"<main><p>{LONG}</p><article class='related'><p>{ALSO}</p></article><article class='teaser relatedItem'><p>{ALSO}</p></article></main>", [LONG]),
    "hints inside longer names": (f"<article><div class='social-history'><p>{LONG}</p></div><div class='banner-year'><p>{ALSO}</p></div><div class='content-with-sidebar'><p>{LONG}</p></div></article>", [LONG, ALSO, LONG]),
    "boxes": (f"<div class='comment-list'><p>{LONG}</p></div><div class='siteFooter'>{LONG}</div><div id='main-nav'>{LONG}</div><div class='adSlot'>{LONG}</div><p>{ALSO}</p>", [ALSO]),
    "formulas and objects": (f"<article><p>{LONG}Let <math><mi>x</mi><annotation>\\x</annotation></math> be real.</p><object data=a><p>{ALSO}</p></object></article>", [LONG + "Let x be real.", ALSO]),
    "deep heading": (f"<article><p>{LONG}</p><h2>{'<span>' * 9}{ALSO}{'</span>' * 9}</h2><ul><li><a href=1>link</a></li></ul></article>", [LONG]),
    "white space": (f"<article><p>  a\n\t b&nbsp;c  </p><p>{LONG}</p></article>", ["a b c", LONG]),
    "short article": ("<nav><a href=/>x</a></nav><article><h1>Hi</h1><p>All short.</p></article>", ["Hi", "All short."]),
    "unknown language": ("<article><p>" + "学习用中文写的文章" * 30 + "</p><p>短</p></article>", ["学习用中文写的文章" * 30, "短"]),
    "article header": (f"<article><header><h1>Name</h1></header><p>{LONG}</p></article>", ["Name", LONG]),
    "links in text": (f"<article><p>{LONG}<a href=1>with a link</a> {ALSO}</p></article>", [LONG + "with a link " + ALSO]),
    "link list in article": (f"<article><p>{LONG}</p><ul><li><a href=1>Other one</a></li></ul></article>", [LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    body, want = CASES[name]
    assert h.main_text(page(body)) == "\n".join(" ".join(w.split()) for w in want)


KEPT = ["title='The hidden cost'", "data-state='hidden'", "data-id='sidebar'", "data-role=navigation", "data-class='menu'", 'title="id=comments class=ad"', "data-style='display:none'", "x-aria-hidden=true", "class=lead class=menu", "href=/a?hidden", "title='it is hidden"]
GONE = ["hidden", "HIDDEN=''", 'title="a"hidden', "data-id=x id = 'sidebar'", "title='x > y' role=navigation", "class=menu/", "/hidden", "data-x= hidden aria-hidden=true", 'style="color:red; display : none"']


@pytest.mark.parametrize("attributes", KEPT)
def test_only_exact_attribute_names_exclude(attributes):
    assert not h._excluded("p", f" {attributes}>", True)


@pytest.mark.parametrize("attributes", GONE)
def test_excluding_attributes(attributes):
    assert h._excluded("p", f" {attributes}>", True)


def test_title_with_the_word_hidden_keeps_its_paragraph():
    body = f"<article><p>{LONG}</p><p title='The hidden cost'>{ALSO}</p><div data-state='hidden'><p>{LONG}</p></div><p hidden>{ALSO}</p></article>"
    assert h.main_text(page(body)) == "\n".join(w.strip() for w in (LONG, ALSO, LONG))


def test_time_is_linear_in_tags():
    import time

    begin = time.process_time()
    for body in ("<i>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "</p></a>" * 50_000, "<b><p>" * 50_000, "<div><b>" * 50_000 + "</i>" * 50_000, "<article>" * 50_000):
        assert h.main_text(f"{body}<p>{LONG}").endswith(LONG.strip())
    assert time.process_time() - begin < 20


def test_first_pass_like_its_rules_read_one_by_one():
    """Every mix of structure, length, stop words and links around the thresholds, one page per known or unknown language."""
    from itertools import product

    for known in (True, False):
        page = [
            h.Block("x" * size, region, out, heading, links, stop)
            for size, region, out, heading, links, stop in product((69, 70, 139, 140), (0, 1), (True, False), (True, False), (0.4, 0.41, 0.9), (0.0, 0.074, 0.075, 0.149, 0.15, 0.299, 0.3))
            if known or out or size < 70 or stop < 0.3
        ]
        for b, label in zip(page, h.decide(page)):
            rules = [
                (b.out, False),
                (b.link_share > 0.4, len(b.text) >= 140 and b.stop_share >= 0.3 and b.link_share < 0.9),
                (b.heading or len(b.text) < 70, None),
                (not known, True if len(b.text) >= 140 else None),
                (b.stop_share >= 0.3, True),
                (b.stop_share >= 0.15 and len(b.text) >= 140, True),
                (b.region == 0 and b.stop_share < 0.075 and len(b.text) < 140, False),
                (True, None),
            ]
            assert label == next(out for rule, out in rules if rule), b


def test_inheritance_like_a_search_for_the_nearest():
    import random

    rng = random.Random(0)
    for _ in range(200):
        blocks = [h.Block("x", rng.randrange(2), rng.random() < 0.2, rng.random() < 0.2, 0, 0) for _ in range(rng.randrange(12))]
        labels = [False if b.out else rng.choice([True, False, None, None]) for b in blocks]
        want = []
        for i, (b, label) in enumerate(zip(blocks, labels)):
            near = [(j, labels[j]) for j, o in enumerate(blocks) if o.region == b.region and not o.out and labels[j] is not None]
            if label is None:
                later = [x for x in near if x[0] > i]
                best = min(near, key=lambda x: (abs(x[0] - i), -x[0]), default=(0, True))
                label = later[0][1] if b.heading and later else best[1]
            want.append(label)
        assert h.inherit(blocks, labels) == want


def test_query_on_odd_rows(spark):
    pages = [None, "", "plain text", "<article><p>" + LONG * 3000 + "</p></article>", "<p", "<!--", "<a href='", "<script>x", "</p></div>", "<p>" * 3000 + "deep"]
    got = {r.page_id: r for r in h.extract(frame(spark, pages)).collect()}
    assert [got[0].text, got[1].text, got[2].text] == ["", "", "plain text"] and got[2].url == "http://x/2"
    assert got[3].text == " ".join((LONG * 3000).split()) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[9].text == "deep"
    assert h.extract(frame(spark, [])).count() == 0
    rows = h.labelled_blocks(frame(spark, [page(CASES["boilerplate"][0]), None])).collect()
    assert [r.text for r in rows if r.is_text] == ["Title", LONG.strip(), "Short."] and len(rows) > 5


def test_given_pages_keep_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        lines = (" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts)
        assert got[r.page_id] == "\n".join(x for x in lines if x)
