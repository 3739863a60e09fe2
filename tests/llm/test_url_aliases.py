"""Spellings of urls, links of pages, and alias components against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter as U


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://B.com", "http://b.com/"), ("http://b.com/#x", "http://b.com/"), ("HTTP://b.com:80/A?Q#f", "http://b.com/A?Q"), ("https://b.com:443", "https://b.com/"), ("https://b.com:80/", "https://b.com:80/"),
        ("http://b.com:/x", "http://b.com/x"), ("http://b.com/a/../b/./c", "http://b.com/b/c"), ("http://b.com/a/..", "http://b.com/"), ("http://b.com/../..", "http://b.com/"), ("http://b.com/a/.", "http://b.com/a/"),
        ("http://b.com/a..b/.c", "http://b.com/a..b/.c"), ("http://u:P@B.com/", "http://u:P@b.com/"), (" http://b.com/x ", "http://b.com/x"), ("ftp://b.com:21/x", "ftp://b.com:21/x"), ("nothing", None), (None, None), ("", None),
    ],
)
def test_normal_url(spark, url, want):
    assert spark.range(1).select(U.normal_url(F.lit(url).cast("string")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("x", "http://h.com/d/x"), ("?v=2", "http://h.com/d/q?v=2"), ("../x", "http://h.com/x"), ("./", "http://h.com/d/"), ("/x", "http://h.com/x"), ("//o.com", "http://o.com/"), ("http://O.com/a#f", "http://o.com/a"),
        ("/go?u=http://o.com/", "http://h.com/go?u=http://o.com/"), ("mailto:a@b.c", None), ("javascript:x()", None), ("#f", None), ("", None), ("x/../../y", "http://h.com/y"),
    ],
)
def test_resolved(spark, link, want):
    assert spark.range(1).select(U.resolved(F.lit(link), F.lit("http://h.com/d/q?a=1")).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<link rel="canonical" href="/a?x=1&amp;y=2">', ["http://h.com/a?x=1&y=2"]),
        ("<link href=/a rel=canonical>", ["http://h.com/a"]),
        ('<link rel="alternate canonical" href="/a">', ["http://h.com/a"]),
        ("<LINK\nREL='CANONICAL'\nHREF='/a'/>", ["http://h.com/a"]),
        ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="/a">', ["http://h.com/a"]),
        ('<script>var t = \'<link rel="canonical" href="/no">\';</script>', []),
        ('<link rel="canonical" data-href="/no">', []),
        ('<link rel="stylesheet" href="/no"><link rel="icon" href="/canonical">', []),
        ('<link title="a > b" rel="canonical" href="/a">', ["http://h.com/a"]),
        ('<link rel="canonical" href=""><link rel="canonical" href="/b">', ["http://h.com/b"]),
        ('<meta http-equiv="refresh" content="0; url=/r">', ["http://h.com/r"]),
        ("<meta content=\"5;URL='r?a=1'\" http-equiv='Refresh'>", ["http://h.com/d/r?a=1"]),
        ('<meta name="refresh" content="0; url=/no">', []),
        ('<base href="http://o.com/x/"><link rel="canonical" href="y">', ["http://o.com/x/y"]),
        ('<link rel="canonical" href="/a"><meta http-equiv=refresh content="0;url=/b">', ["http://h.com/a", "http://h.com/b"]),
        ("<p>none</p>", []), ("", []), (None, []),
    ],
)
def test_page_links(spark, html, want):
    pages = spark.createDataFrame([("http://H.com/d/q", html, 1, 2)], "url string, html string, tags int, base int")
    assert sorted((r.from_url, r.to_url) for r in U.page_links(pages).collect()) == sorted(("http://h.com/d/q", x) for x in want)


HOSTS = ["a.com", "b.com", "www.bad.net", "example.net", "x.org", "example.com", "c.io:80"]
RULES = [*U.RULES, U.Rule.of("block", "c.io/"), U.Rule.of("allow", "c.io/7"), U.Rule.of("allow", "x.org/hub")]


def spelled(rng, url):
    """The url in another spelling."""
    scheme, rest = url.split("://")
    host, _, path = rest.partition("/")
    return rng.choice([url, f"{scheme.upper()}://{host}/{path}", f"{scheme}://{host.upper()}/{path}#f{rng.randint(0, 9)}", f"{scheme}://{host}/./{path}", f" {scheme}://{host}/z/../{path}"])


def crawl(seed):
    """Pages that link to each other in chains, cycles and hubs, and a log of redirects."""
    rng = random.Random(seed)
    urls = [f"http://{rng.choice(HOSTS)}/{p}{i}" for i, p in enumerate(rng.choice(["", "en/", "de/", "fr/", "7"]) for _ in range(900))]
    hub = "http://x.org/hub"
    rows, edges, log = [], [], []
    for i, u in enumerate(urls):
        kind, other = rng.random(), rng.choice(urls)
        html = "<p>text</p>"
        if kind < 0.25:
            edges.append((u, other))
            html = f'<link rel="canonical" href="{spelled(rng, other).strip()}">'
        elif kind < 0.35:
            edges.append((u, other))
            html = f'<META http-equiv="refresh" content="0; url={spelled(rng, other).strip()}">'
        elif kind < 0.4:
            edges.append((u, hub))
            log.append((spelled(rng, u), hub))
        elif kind < 0.5:
            edges.append((u, urls[(i + 1) % 900]))
            log.append((u, spelled(rng, urls[(i + 1) % 900])))
        rows.append((i, spelled(rng, u), html))
    return urls, rows, edges, log


def plain(url):
    scheme, rest = url.split("://")
    host, _, path = rest.partition("/")
    return f"{scheme}://{host.removesuffix(':80')}/{path}"


def ruled(url):
    host, _, path = url.split("://")[1].partition("#")[0].partition("/")
    host = host.lower()
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)).verdict if fits else None


@pytest.mark.parametrize("seed", [0, 1, 2, 3, 107])
def test_components_against_union_find(spark, seed):
    urls, rows, edges, log = crawl(seed)
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if plain(a) == plain(b):  # a link to itself joins nothing
            continue
        a, b = find(plain(a)), find(plain(b))
        parent[max(a, b)] = min(a, b)
    by_root: dict[str, set] = {}
    for x in list(parent):
        by_root.setdefault(find(x), set()).add(ruled(x))
    want = {}
    for i, u in enumerate(urls):
        said = by_root.get(find(plain(u)), set())
        # a page's own rule is that of its url as it is spelled
        want[i] = ruled(rows[i][1]) or ("allow" if "allow" in said else "block" if "block" in said else "allow")
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5)
    redirects = spark.createDataFrame(log, "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in U.filter_urls(pages, RULES, redirects).collect()}
    assert got == want
