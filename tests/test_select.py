"""Selectors over tokens against a tree built by the standard library's parser."""

import random
import re
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import select as S

SF = "/root/testdata/sf0.001"


class Tree(HTMLParser):
    """Elements (place of the token, tag, attributes, parent's index) of well-formed pages; entities stay in texts."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.nodes, self.stack = [], []
        self.places = {m.start(): i for i, m in enumerate(re.finditer(S.TOKEN, html))}
        self.lines = [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        line, column = self.getpos()
        self.nodes.append((self.places[self.lines[line - 1] + column], tag, dict(attrs), self.stack[-1] if self.stack else None))
        if tag not in S.VOID:
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag not in S.VOID:
            self.stack.pop()

    def above(self, i):
        while (i := self.nodes[i][3]) is not None:
            yield i

    def holds(self, i, step):
        _, tag, attrs, _ = self.nodes[i]
        for m in S._PART.finditer(step):
            if m["tag"]:
                ok = m["tag"] in ("*", tag)
            elif m["id"]:
                ok = attrs.get("id") == m["id"]
            elif m["cls"]:
                ok = m["cls"] in (attrs.get("class") or "").split()
            else:
                v = attrs.get(m["name"])
                ok = m["name"] in attrs and {None: lambda: True, "=": lambda: v == m["value"], "*=": lambda: m["value"] in (v or ""), "^=": lambda: (v or "").startswith(m["value"]), "$=": lambda: (v or "").endswith(m["value"]), "~=": lambda: m["value"] in (v or "").split()}[m["op"]]()  # noqa: B023
            if not ok:
                return False
        return True

    def matches(self, i, steps):
        if not self.holds(i, steps[-1][1]):
            return False
        if len(steps) == 1:
            return True
        others = list(self.above(i))
        others = others[:1] if steps[-1][0] else others
        return any(self.matches(j, steps[:-1]) for j in others)

    def select(self, selector):
        return sorted({self.nodes[i][0] for steps in S.steps_of(selector) for i in range(len(self.nodes)) if self.matches(i, steps)})


def made(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4) if depth else 6):
        kind = rng.random()
        if kind < 0.3 or depth > 5:
            out.append(rng.choice(["text", " a < b ", "", "x\ny", "&amp;"]))
        elif kind < 0.4:
            out.append(rng.choice(["<br>", "<img src='i.png'>", '<input type="text" id=q>']))
        else:
            tag = rng.choice(["div", "ul", "li", "a", "p", "table", "tr", "td", "span"])
            attrs = rng.choice(["", ' class="item"', ' class="a item b"', " class='other' id=\"x1\"", ' href="/n/1.html" title="t"', " data-url='/d/2'", " hidden"])
            out.append(f"<{tag}{attrs}>{made(rng, depth + 1)}</{tag}>")
    return "".join(out)


SELECTORS = ["div", "*", "a[href]", ".item", "li.item a", "div > a", "ul li > a, td .item", "div div div", "#x1", "p > .item > *", "[class~=item]", "a[href$='.html']", "div [data-url^=/d]", "table td", "span[hidden]", "li[class*=the]", "input#q"]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows = [(i, made(rng)) for i in range(40)] + [(40, ""), (41, None), (42, "only text"), (43, "</div></p>")]
    return spark.createDataFrame(rows, "k int, html string"), dict(rows)


@pytest.mark.parametrize("selector", SELECTORS)
def test_against_a_tree(pages, selector):
    df, html = pages
    got = {}
    for r in S.select(S.parsed(df, ["k"], "html"), selector).collect():
        got.setdefault(r.k, []).append(r["at"])
    want = {k: found for k, h in html.items() if k != 43 and (found := Tree(h or "").select(selector))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_html_of_elements(pages):
    df, html = pages
    page = S.parsed(df, ["k"], "html")
    for r in S.with_html(page, S.select(page, "div")).collect():
        tokens = re.findall(S.TOKEN, html[r.k])
        assert r.html == "".join(tokens[r["at"] : r["end"]]) and r.html.endswith("</div>")


def test_unknown_selectors_are_refused():
    for bad in ("", "a:first-child", "a + b", "> a", "a,,b", "a ~ b"):
        with pytest.raises(ValueError, match="selector"):
            for steps in S.steps_of(bad):
                for _, step in steps:
                    S._holds(step)


def test_left_open_and_broken(spark):
    html = "<ul><li>a<li class=x>b <i>c</i><li>d</ul><p>one<p>two<div><b>bold</div><table><tr><td>1<td>2<tr><td>3</table>"
    page = S.parsed(spark.createDataFrame([(1, html)], "k int, html string"), ["k"], "html")
    found = lambda s: [r.html for r in S.with_html(page, S.select(page, s)).orderBy("at").collect()]
    assert found("li") == ["<li>a", "<li class=x>b <i>c</i>", "<li>d</ul><p>one<p>two<div><b>bold</div><table><tr><td>1<td>2<tr><td>3</table>"]
    assert found("li.x i") == ["<i>c</i>"]
    assert found("td") == ["<td>1", "<td>2<tr>", "<td>3</table>"] and found("div b")[0].startswith("<b>bold")


LIST = """<div class="menu"><a href="/x">menu</a></div><ul class="news">
<li class="item"><a title="Full title one" href="notice/1.html?a=1&amp;b=2">Short</a><span class="date">2026-03-05</span></li>
<li class="item"><h3>No link</h3></li><li class="item"><a href="javascript:urlOpen('id-7')">Seven</a> <span class="date">2026年4月1日</span></li>
<li class="item"><a href="/notice/2.html"><b>Two</b> words</a><ul><li>inner</li></ul></li></ul>"""


def listed(spark, where):
    df = spark.createDataFrame([("p", "https://h.cn/list/index.html", LIST), ("q", "https://h.cn/", None)], "page string, url string, body string")
    return [(r.url, r.title, str(r.published_at or "")[:10]) for r in S.list_items(df, "page", "url", "body", where, 2026).orderBy("at").collect()]


def test_items_of_list_pages(spark):
    items = listed(spark, S.Items("ul.news > li.item", "a", "a", ".date", title_attribute="title"))
    assert items == [("https://h.cn/list/notice/1.html?a=1&b=2", "Full title one", "2026-03-05"), ("javascript:urlOpen('id-7')", "Seven", "2026-04-01"), ("https://h.cn/notice/2.html", "Two words", "")]
    anchors = listed(spark, S.Items("a[href]", around="parent", link_like=r"/notice/\d+\.html"))
    assert anchors == [("https://h.cn/list/notice/1.html?a=1&b=2", "Short", "2026-03-05"), ("https://h.cn/notice/2.html", "Two words", "")]
    ids = listed(spark, S.Items("a[href*=urlOpen]", around="li", id_pattern=r"urlOpen\(['\"]([^'\"]+)", detail="https://h.cn/#/detail?uuid={}"))
    assert ids == [("https://h.cn/#/detail?uuid=id-7", "Seven", "2026-04-01")]
    assert listed(spark, S.Items(".nothing")) == []


@pytest.mark.skipif(not Path(SF).exists(), reason="the test data isn't here")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    page = S.parsed(pages, ["page_id"], "html")
    got = {(r.page_id, r.html) for r in S.with_html(page, S.select(page, "nav li > a[href]")).collect()}
    want = {(r.page_id, a) for r in pages.collect() for nav in re.findall(r"(?s)<nav>.*?</nav>", r.html or "") for a in re.findall(r"<a href=[^>]*>[^<]*</a>", nav)}
    assert got == want and len(want) > 100
    assert S.select(page, "h1").groupBy("page_id").count().where(F.col("count") > 1).count() == 0
