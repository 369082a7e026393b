"""Url rules with redirect equivalence, in DataFrame operations only.

A rule is (host, path prefix, allow or block). It fits its host and all subdomains; the longest
fitting rule decides. Pages without a rule are judged by equivalence: canonical links and
redirects between urls are edges of a graph, and a url whose connected component holds a url
blocked by a rule is blocked too. An explicit allow rule always keeps its own url.

Links in comments and scripts do not count; relative ones are resolved by the standard rules, against ``base`` if there is one.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule, takes
part in no edge and is allowed. Null html has no links. Repeated rows are judged alike. Rules of
equal length prefer the longer host. Pages of any length are read whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebank.llm.common import ascii_lower, stored
from lorebank.llm.graph import components

Rule = tuple[str, str, str]

#: What a page holds but does not declare: comments, and the contents of scripts and the like.
UNSEEN = r"(?si)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<textarea\b.*?(?:</textarea\b|\z)|<template\b.*?(?:</template\b|\z)"
_VALUE = r"""\s*=\s*["']?\s*([^"'\s>]+)"""
_NEXT = r"""[\s"'/]"""
_REL = _NEXT + r"""rel\s*=\s*(?:["'](?:[^"'<>]*\s)?)?canonical"""
_EQUIV = _NEXT + r"""http-equiv\s*=\s*["']?refresh"""
_CONTENT = _NEXT + r"""content\s*=\s*["']?[0-9.\s]*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)"""
_REST, _END = r"""(?:["'\s/][^<>]*)?""", r"""["'\s/>]"""
#: Links in tags, their attributes in either order. The patterns keep to what SQL engines know as well.
LINKS = (
    rf"(?i)<link[^<>]*{_REL}{_REST}{_NEXT}href{_VALUE}",
    rf"(?i)<link[^<>]*{_NEXT}href{_VALUE}[^<>]*{_REL}{_END}",
    rf"(?i)<meta[^<>]*{_EQUIV}{_REST}{_CONTENT}",
    rf"(?i)<meta[^<>]*{_CONTENT}[^<>]*{_EQUIV}{_END}",
)
BASE = rf"(?i)<base[^<>]*{_NEXT}href{_VALUE}"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    rest = F.when(F.instr(url, "://") > 0, rest)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` carried out."""
    parts = F.split(path, "/")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    walked = F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    )
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(walked, "/"), folder)).otherwise(path)


def url_node(url: Column) -> Column:
    """What makes two urls the same place: host, path without dots, and query, without scheme and fragment."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"^[^#]*?(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(without_dots(path)), query))


def resolve(link: Column, base: Column) -> Column:
    """A link resolved against a base url by the standard rules; null where it leads to no place (empty, fragments alone, ``mailto:`` and the like)."""
    host, path = split_url(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    at = F.concat(F.lit("http://"), host)
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(SCHEME + "//"), link)
        .when(link.rlike(SCHEME), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(host == "", F.lit(None))
        .when(link.startswith("/"), F.concat(at, link))
        .when(link.startswith("?"), F.concat(at, F.when(path == "", F.lit("/")).otherwise(path), link))
        .otherwise(F.concat(at, folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``url, target`` for all canonical links and redirects that a page declares; a ``base`` element moves relative ones."""
    held = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.regexp_replace("html", UNSEEN, " ").alias("html"))
    plain = lambda link: F.replace(link, F.lit("&amp;"), F.lit("&"))
    found = F.flatten(F.array(*[F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in LINKS]))
    links = held.select("url", plain(F.regexp_extract("html", BASE, 1)).alias("base"), F.explode(found).alias("link")).where("url is not null")
    links = links.withColumn("base", F.coalesce(resolve(F.col("base"), F.col("url")), "url"))
    return links.select("url", resolve(plain(F.col("link")), F.col("base")).alias("target")).where("target is not null")


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that fit each distinct host, longest first: the host's suffixes meet the rules."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    long = hosts.where("host != ''").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    ranked = F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("order"), (-F.length("rule_host")).alias("order2"), "rule_host", "rule_path", "rule_verdict")
    return long.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(ranked)).alias("fits"))


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` (null where no rule fits) to rows with ``host`` and ``path``.

    Only distinct hosts meet the rules; the list per host holds at most its own rules.
    """
    fits = stored(_host_rules(urls.select("host"), rules), "host-rules")
    hit = F.element_at(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"])), 1)
    hit = F.when(F.size(F.filter("fits", lambda r: F.startswith(F.col("path"), r["rule_path"]))) > 0, hit)
    out = urls.join(fits, "host", "left").withColumn("hit", hit)
    return out.withColumns({"rule": F.concat("hit.rule_host", "hit.rule_path"), "rule_verdict": F.col("hit.rule_verdict")}).drop("fits", "hit")


def judge(pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, reason`` per row of ``pages``.

    ``links`` (url, target) holds redirects known from elsewhere; by default those that pages
    declare. ``reason`` is rule, alias or default. The html is read once, by ``page_links``.
    """
    spark = pages.sparkSession
    known = spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")
    edges = page_links(pages) if links is None else links.select("url", "target")
    edges = stored(edges.where("url is not null and target is not null").distinct(), "links")

    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), url_node(F.col("url")).alias("node"))
    rows = apply_rules(rows, known)
    ends = edges.select(F.explode(F.array("url", "target")).alias("url")).distinct()
    ends = ends.select(*[c.alias(n) for c, n in zip(split_url(F.col("url")), ("host", "path"))], url_node(F.col("url")).alias("node"))
    linked = components(edges.select(url_node(F.col("url")).alias("a"), url_node(F.col("target")).alias("b")), "a", "b")
    blocked = apply_rules(ends.where("node is not null").distinct(), known).where("rule_verdict = 'block'").select("node").distinct()
    roots = linked.join(blocked, "node", "left_semi").select("root").distinct()
    tainted = linked.join(roots, "root", "left_semi").select("node", F.lit(True).alias("tainted"))

    out = rows.join(tainted, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("tainted"), F.lit("block")), F.lit("allow"))
    reason = F.when(F.col("rule").isNotNull(), "rule").when(F.col("tainted"), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), reason.alias("reason"))
