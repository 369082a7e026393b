import pytest

from lorebank.llm import url_filter
from lorebank.llm.queries import URL_RULES

HTML = "<html><head>{}</head><body>x</body></html>"


def canonical(u):
    return HTML.format(f'<link rel="canonical" href="{u}">')


def refresh(u):
    return HTML.format(f"<meta http-equiv='refresh' content='0; url={u}'>")


def brute(pages, rules):
    """Plain Python: rules by scanning, aliases by union-find over all links."""
    import re

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    def node(url):
        host, path = split(url)
        q = re.match(r"[^#]*?(\?[^#]*)", url or "")
        return host + (path or "/") + (q.group(1) if q else "") if host else None

    def rule(url):
        host, path = split(url)
        fits = [r for r in rules if host and ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    urls = set()
    for _, url, html in pages:
        m = re.search(r"""canonical" href="([^"]+)|url=([^']+)'""", html or "")
        if m and url and node(url):
            to = m.group(1) or m.group(2)
            if to.startswith("/"):
                to = "http://" + split(url)[0] + to
            urls |= {url, to}
            parent[find(node(url))] = find(node(to))
    bad = {find(node(u)) for u in urls if rule(u) and rule(u)[2] == "block"}
    out = []
    for i, url, _ in pages:
        r = rule(url)
        tainted = node(url) is not None and find(node(url)) in bad
        out.append((i, *split(url), r[0] + r[1] if r else None, r[2] if r else "block" if tainted else "allow"))
    return sorted(out, key=str)


def test_rules_aliases_and_odd_rows(spark):
    pages = [
        (1, "http://a.example.com/en/x", None),
        (2, "https://WWW.Example.com/en/x?q#f", "<p>"),
        (3, "http://b.net/es/1", ""),
        (4, "http://c.org/1", canonical("http://b.net/es/1")),
        (5, "http://d.org/2", refresh("http://c.org/1#top")),
        (6, "http://www.example.com/en/free", canonical("http://c.org/1")),
        (7, "http://e.org/", canonical("/home")),
        (8, "http://e.org/home", None),
        (9, None, canonical("http://b.net/es/1")),
        (10, "no scheme", refresh("http://b.net/es/1")),
        (11, "http://example.com", None),
        (12, "x://y?z", None),
        (13, "http://c.org/1", canonical("http://b.net/es/1")),
        (13, "http://c.org/1", canonical("http://b.net/es/1")),
        (None, "http://notexample.com/en/", None),
        (14, "http://z.net/fr/1?u=http://q/", None),
        (15, "http://f.org/old", refresh("http://uncrawled.net/fr/9")),
        (16, "", "<link rel=canonical>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as rule")
    got = url_filter.judge(df, URL_RULES).drop("reason").collect()
    assert sorted(map(tuple, got), key=str) == brute(pages, URL_RULES)
    assert {r.page_id: r.verdict for r in got}[5] == "block" and {r.page_id: r.verdict for r in got}[6] == "allow"


BAD = "http://bad.net/fr/"


@pytest.mark.parametrize(
    "head",
    [
        f"<meta content='0; url={BAD}' http-equiv='refresh'>",
        f'<META CONTENT="5;URL={BAD}" name=x HTTP-EQUIV="Refresh" />',
        f'<link rel="canonical" href="http://good.org/"><link rel="canonical" href="{BAD}">',
        f'<link href="http://good.org/" rel="canonical"><link href="{BAD}" rel="canonical">',
        f"<meta http-equiv=refresh content='9; url=http://good.org/'><meta http-equiv=refresh content='0; url={BAD}'>",
        f"<meta content='9; url=http://good.org/' http-equiv=refresh><meta content='0; url={BAD}' http-equiv=refresh>",
    ],
)
def test_every_link_of_a_page_in_both_orders(spark, head):
    df = spark.createDataFrame([(1, "http://a.org/", HTML.format(head))], "page_id long, url string, html string")
    assert [(r.verdict, r.reason) for r in url_filter.judge(df, URL_RULES).collect()] == [("block", "alias")]


@pytest.mark.parametrize("head", [f"<!-- <link rel=canonical href={BAD}> -->", f"<script>var a = '<link rel=canonical href={BAD}>'</script>", f"<link data-rel=canonical href={BAD}>", f"<link rel=canonical-x href={BAD}>", f"<link rel=canonical><a href={BAD}>x</a>", "<link rel=canonical href='mailto:a@b.c'><link rel=canonical href='#x'>", f"<!-- <meta http-equiv=refresh content='0; url={BAD}'>", f"<meta content='0; url={BAD}' name='x'>", f"<meta content='0; url={BAD}'><meta http-equiv='refresh' content='5'>"])
def test_no_redirect(spark, head):
    df = spark.createDataFrame([(1, "http://a.org/", HTML.format(head))], "page_id long, url string, html string")
    assert url_filter.page_links(df).count() == 0


STANDARD = [
    # page, base element, link, target
    ("http://a.org/b/c/d?q", None, "g", "a.org/b/c/g"),
    ("http://a.org/b/c/d?q", None, "./g", "a.org/b/c/g"),
    ("http://a.org/b/c/d?q", None, "g/", "a.org/b/c/g/"),
    ("http://a.org/b/c/d?q", None, "/g", "a.org/g"),
    ("http://a.org/b/c/d?q", None, "//g.org", "g.org/"),
    ("http://a.org/b/c/d?q", None, "?y", "a.org/b/c/d?y"),
    ("http://a.org/b/c/d?q", None, "g?y#s", "a.org/b/c/g?y"),
    ("http://a.org/b/c/d?q", None, "..", "a.org/b/"),
    ("http://a.org/b/c/d?q", None, "../g", "a.org/b/g"),
    ("http://a.org/b/c/d?q", None, "../../../g", "a.org/g"),
    ("http://a.org/b/c/d?q", None, "/./g/../h/.", "a.org/h/"),
    ("http://a.org/b/c/d?q", None, "/r?u=http://z.org/", "a.org/r?u=http://z.org/"),
    ("http://a.org", None, "g", "a.org/g"),
    ("http://a.org", None, "?y", "a.org/?y"),
    ("http://a.org/b/c", "http://z.org/x/y", "g", "z.org/x/g"),
    ("http://a.org/b/c", "/k/", "g?a=1&amp;b=2", "a.org/k/g?a=1&b=2"),
    ("http://a.org/b/c", "../k/", "../g", "a.org/g"),
]


def standard_pages():
    forms = ["<link rel='canonical' href='{}'>", "<link href={} rel=canonical />", '<link rel="alternate canonical" title=x href="{}">', "<meta http-equiv=refresh content='1; URL={}'>", '<META content="0;url={}" http-equiv="Refresh">']
    return [(i, url, HTML.format((f"<base target=x href='{base}'>" if base else "") + forms[i % 5].format(link))) for i, (url, base, link, _) in enumerate(STANDARD)]


def test_links_are_resolved_by_the_standard_rules(spark):
    df = spark.createDataFrame(standard_pages(), "page_id long, url string, html string")
    links = url_filter.page_links(df.repartition(1)).select("url", url_filter.url_node(url_filter.F.col("target")).alias("node"))
    assert sorted(map(tuple, links.collect())) == sorted((url, node) for url, _, _, node in STANDARD)


def test_chain_and_hub(spark):
    chain = [(i, f"http://h{i}.org/", canonical(f"http://h{i + 1}.org/")) for i in range(60)]
    hub = [(1000 + i, f"http://s{i}.org/", canonical("http://hub.net/es/")) for i in range(200)]
    pages = chain + hub + [(999, "http://h60.org/", canonical("http://bad.net/fr/"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge(df, URL_RULES).collect()} == {"block"}


@pytest.mark.parametrize("rules", [URL_RULES, []])
def test_empty_table(spark, rules):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    if rules:
        assert url_filter.judge(df, rules).count() == 0
    else:
        one = spark.createDataFrame([(1, "http://a.b/", None)], df.schema)
        assert [r.verdict for r in url_filter.judge(one, [("x.y", "/", "block")]).collect()] == ["allow"]


def test_sql_twin_on_aliases(spark):
    """The twin knows links too: it gives the rows of the Spark query on pages that have them."""
    import duckdb
    import pandas as pd

    from lorebank.llm.queries import OP2_SQL

    pages = [(i, f"http://h{i}.org/p?q={i}", canonical(f"http://h{i + 1}.org/p?q={i + 1}#x")) for i in range(6)]
    pages += [(6, "http://h6.org/p?q=6", refresh("//bad.net/fr/")), (7, "http://k.org/a/b", canonical("c")), (8, "http://k.org/a/c", refresh("/es")), (9, None, "x"), (10, "no", canonical("http://bad.net/es/"))]
    pages += [(100 + i, u.replace("a.org", f"a{i}.org"), h) for i, u, h in standard_pages()]
    pages += [(200 + i, f"http://{node.replace('a.org', f'a{i}.org')}", canonical("http://bad.net/es/")) for i, (_, _, _, node) in enumerate(STANDARD) if i % 2]
    pages += [(300, "http://m.org/", f"<!-- {canonical(BAD)} -->"), (301, "http://n.org/", f"<script>{canonical(BAD)}</script>"), (302, "http://o.org/a/../b", canonical("http://bad.net/fr/../fr/1"))]
    frame = pd.DataFrame(pages, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", frame)
    got = con.execute(OP2_SQL).fetchall()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in url_filter.judge(df, URL_RULES).collect())
