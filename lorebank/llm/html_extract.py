"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides blocks on their own: blocks inside menus, headers, footers,
sidebars, notices, adverts, forms, comments or hidden parts (by tag, role, class or id) are out; the others by link
density, length and the share of stop words: long and rich in stop words is text, mostly links is not. Pass 2 gives each
undecided block the label of the nearest decided block of its region, the later one on ties and headings' own following block first. A region is
the innermost article or main element, or else the page. Blocks that structure excludes are no neighbours: an advert
above a short paragraph says nothing about it. A region where nothing is decided is text.

Stop words are short lists of four languages; where no long block of a page is rich in any of them, the language is unknown and
length alone decides.

A class or id excludes by a hint word that is the whole name, its last part (``main-nav``), or its first part with words for a box behind it
(``comment-list``); ``social-history`` or ``has-sidebar`` do not. Article elements are judged like all others, and inside an excluded
element they stay excluded: comments and teasers are often articles of their own.

Defined cases: null or empty html, and pages of which structure excludes everything, give an empty text; very long pages are read whole, in time linear in their tags; unclosed tags and comments end with their parent or the page; a
cut-off character reference stays as it is; repeated rows are extracted each; null ids and urls pass through; an empty table gives no rows. Other
columns of the table, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below SHORT characters a block is ambiguous; from LONG on a block rich in stop words is text.
SHORT = 70
LONG = 140
#: Share of stop words from which a block is rich, and below which it is poor.
RICH = 0.30
POOR = 0.15
#: Share of characters inside links above which a block is navigation.
LINKS = 0.4

STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can for from had has have he her his if in into is it its more
    no not of on one or other our out she so some than that the their them there they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im in ist ja kann
    mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui
    sa se ses son sont sur un une vous à
    al como con cuando del desde donde el ella ellos era es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero
    por porque que se ser si sin sobre son su sus también te tiene un una uno y ya
    """.split()
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
#: One attribute with its whole value; a quote left open holds the rest of the tag.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*))?""")
#: Parts of a class or id: runs of letters, capitals begin a part.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Their contents are not text of the page at all.
_RAW = frozenset("script style title textarea noscript template iframe svg annotation annotation-xml select xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img
    math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mfenced mpadded mphantom semantics annotation annotation-xml""".split())
_OUT_TAGS = frozenset("nav footer aside form menu dialog button head fieldset".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_OUT_HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo
    promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget
    """.split()
)
#: With these a header is the article's own.
_OWN_HEADER = frozenset("article post entry content story title".split())
#: What may follow a hint in a name that still names the thing itself, and what in front of a hint says that something else only has it.
_OF_A_BOX = frozenset(
    """
    area bar block body bottom box button buttons card col column container content form frame group holder icon inner item items label left link links list
    main menu meta module outer overlay panel region right row section slot text thread title top unit wrap wrapper zone
    """.split()
)
_HAVING = frozenset("has have with no not without".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _hinted(names: str) -> bool:
    """Whether a class or id names a part that is not of the article: a hint alone, as the last part, or followed by words for a box."""
    for name in names.split():
        parts = [x.lower() for x in _PART.findall(name)]
        if not parts or _HAVING & set(parts[:-1]):
            continue
        hint = parts[-1] if parts[-1] in _OUT_HINTS else parts[0] if parts[0] in _OUT_HINTS and all(x in _OF_A_BOX or x in _OUT_HINTS for x in parts[1:]) else None
        if hint and not (hint == "header" and _OWN_HEADER & set(parts)):
            return True
    return False


class Block(NamedTuple):
    """A block of a page; ``region`` 0 is the page itself, ``out`` tells that structure excludes it."""

    text: str
    region: int
    out: bool
    heading: bool
    link_share: float
    stop_share: float


def _excluded(name: str, attributes: str, in_region: bool) -> bool:
    """Whether an element is no part of the article, by its tag or attributes."""
    if name in _OUT_TAGS or (name == "header" and not in_region):
        return True
    # of attributes with one name the first counts
    parsed = {key.lower(): value for key, value in reversed(_ATTRIBUTE.findall(attributes))} if attributes.strip("> /") else {}
    for key, value in parsed.items():
        named = value.strip("\"'")
        value = named.lower()
        if key == "hidden" and value in ("", "hidden", "true") or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in _OUT_ROLES or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and _hinted(html.unescape(named)):
            return True
    return False


def _stop_share(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


class _Open(NamedTuple):
    """An open element: its name, whether it is excluded, its region, the place of the innermost block element down to here (-1: none)."""

    name: str
    out: bool
    region: int
    block: int


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space collapsed and references decoded; one pass over the tags, linear in them."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # where in the stack the elements of a name are
    regions, at = 0, 0
    top = _Open("", False, 0, -1)

    def inside(names) -> bool:
        return any(places.get(n) for n in names)

    def flush() -> None:
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            here = stack[-1] if stack else top
            size = sum(len(p.strip()) for p, _ in parts)
            linked = sum(len(p.strip()) for p, in_link in parts if in_link)
            found.append(Block(text, here.region, here.out, inside(_HEADINGS), linked / max(1, size), 0.0 if here.out else _stop_share(text)))
        parts.clear()

    def close(down_to: int) -> None:
        for e in stack[down_to:]:
            places[e.name].pop()
        del stack[down_to:]

    while True:
        tag = _TOKEN.search(page, at)
        raw = page[at : tag.start() if tag else len(page)]
        if raw:
            parts.append((html.unescape(raw) if "&" in raw else raw, inside("a")))
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            if tag[0].startswith("<![CDATA["):
                parts.append((tag[0][9:].removesuffix("]]>"), inside("a")))
            continue
        name = tag[2].lower()
        if name == "br":
            parts.append((" ", inside("a")))
        if name not in _INLINE and name != "br":
            flush()
        if tag[1]:
            # an inline end tag does not close blocks around it
            if places.get(name) and not (name in _INLINE and stack[-1].block > places[name][-1]):
                close(places[name][-1])
        elif name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in _VOID:
            if name not in _INLINE and stack and stack[-1].block >= 0:
                # a block start ends an open paragraph, and an item its earlier sibling
                around = stack[stack[-1].block].name
                if around == "p" or around == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                    close(stack[-1].block)
            here = stack[-1] if stack else top
            out, region = here.out, here.region
            if name in ("article", "main") and not out:
                regions += 1
                region = regions
            if name not in ("html", "body"):
                out = out or _excluded(name, tag[3], region > 0)
            places.setdefault(name, []).append(len(stack))
            stack.append(_Open(name, out, region, here.block if name in _INLINE else len(stack)))
    flush()
    return found


def decide(page: list[Block]) -> list[bool | None]:
    """Pass 1: text, no text, or None for an ambiguous block."""
    known = any(b.stop_share >= RICH and len(b.text) >= SHORT and not b.out for b in page)
    labels: list[bool | None] = []
    for b in page:
        if b.out:
            label = False
        elif b.link_share > LINKS:
            label = len(b.text) >= LONG and b.stop_share >= RICH and b.link_share < 0.9
        elif len(b.text) < SHORT or b.heading:
            label = None
        elif not known:
            label = True if len(b.text) >= LONG else None
        elif b.stop_share >= RICH or b.stop_share >= POOR and len(b.text) >= LONG:
            label = True
        else:
            label = False if b.region == 0 and b.stop_share < POOR / 2 and len(b.text) < LONG else None
        labels.append(label)
    return labels


def inherit(page: list[Block], labels: list[bool | None]) -> list[bool]:
    """Pass 2: ambiguous blocks take the label of the nearest decided block of their region, in two sweeps."""
    before: list[tuple[int, bool] | None] = []
    seen: dict[int, tuple[int, bool]] = {}
    for i, (b, label) in enumerate(zip(page, labels)):
        before.append(seen.get(b.region))
        if label is not None and not b.out:
            seen[b.region] = (i, label)
    final, seen = [False] * len(page), {}
    for i in range(len(page) - 1, -1, -1):
        b, label, after, earlier = page[i], labels[i], seen.get(page[i].region), before[i]
        if label is not None:
            final[i] = label
            if not b.out:
                seen[b.region] = (i, label)
        elif after and (b.heading or not earlier or after[0] - i <= i - earlier[0]):
            final[i] = after[1]
        else:
            final[i] = earlier[1] if earlier else True
    return final


def main_text(page: str | None) -> str:
    """The blocks of the article, one line each; empty if structure excludes all."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, inherit(found, decide(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row: row-local work on whole pages, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def labelled_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, block, text, is_text, link_share, stop_share`` for every block: what the rules saw and decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, page in zip(batch.column("page_id"), batch.column("html")):
                found = blocks(page.as_py() or "")
                final = inherit(found, decide(found))
                rows += [(ident.as_py(), i, b.text, keep, b.link_share, b.stop_share) for i, (b, keep) in enumerate(zip(found, final))]
            names = ["page_id", "block", "text", "is_text", "link_share", "stop_share"]
            kinds = [batch.schema.field("page_id").type, pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, block int, text string, is_text boolean, link_share double, stop_share double")
