"""Selectors over landed html, as windows and joins of tokens: no page is parsed by a task of its own.

A page is cut into tokens (tags and texts). Elements are pairs of an opening and a closing tag of one kind at one level of it; levels are running sums. An element
that isn't closed ends where the page does, or, for kinds that may be left open (``OPEN``) on pages that leave some open, where the next of its kind begins or
closes. So a page with broken markup loses single elements, not all that follows.

A selector has steps joined by blanks (within) or ``>`` (directly within), each a tag or ``*``, ``#id``, ``.class`` and ``[name]``, ``[name=v]``, ``[name*=v]``, ``[name^=v]``,
``[name$=v]``, ``[name~=v]``; commas join alternatives. An element is within another if it begins before that ends: the farthest end so far, one window, tells.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import parse_datetime
from tidemark.sources.html import absolute_url, cleaned, unescaped, visible
from tidemark.sources.store import saved

#: Tags without an end, and tags whose end may be left out.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
OPEN = ("li", "p", "td", "th", "tr", "dt", "dd", "option", "thead", "tbody")
TOKEN = r"<[A-Za-z/!][^<>]*>|[^<]+|<"

_STEP = re.compile(r"\s*(>?)\s*((?:[\w*-]+|\#[\w-]+|\.[\w-]+|\[[^\]]*\])+)")
_PART = re.compile(r"(?P<tag>^(?:\*|[\w-]+))|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*[\"']?(?P<value>[^\"'\]]*)[\"']?\s*)?\]")


@dataclass(frozen=True)
class Page:
    """Pages (keys, _html) and their elements (keys, at, end, tag, raw): places count tokens, ``end`` is the place behind an element."""

    keys: tuple[str, ...]
    pages: DataFrame
    elements: DataFrame


def attribute(raw: Column, name: str) -> Column:
    """An attribute of an opening tag, without quotes, as it is written; null if it has none, empty without a value."""
    value = F.regexp_replace(F.regexp_extract(raw, rf"(?is)[\s\"']{re.escape(name)}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")
    return F.when(F.regexp_like(raw, F.lit(rf"(?is)[\s\"']{re.escape(name)}(?=[\s=/>])")), value)


def _tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def parsed(pages: DataFrame, keys: Sequence[str], html: str) -> Page:
    """Elements of pages, one page for each value of ``keys``. Null pages have none."""
    keys = tuple(keys)
    whole = pages.select(*keys, cleaned(F.col(html)).alias("_html"))
    tokens = whole.select(*keys, F.posexplode(_tokens(F.col("_html"))).alias("at", "raw"))
    # one exchange, by page, serves all windows
    tags = tokens.where(F.regexp_like("raw", F.lit("^</?[A-Za-z]"))).withColumn("last", F.max("at").over(Window.partitionBy(*keys)))
    tags = tags.withColumn("tag", F.lower(F.regexp_extract("raw", r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1)))
    closes = F.startswith("raw", F.lit("</"))
    tags = tags.withColumns({"closes": closes, "step": F.when(closes, -1).otherwise(1), "void": F.col("tag").isin(*VOID)}).where("not (void and closes)")
    kind = Window.partitionBy(*keys, "tag")
    running = F.sum("step").over(kind.orderBy("at"))
    left_open = F.col("tag").isin(*OPEN) & (F.sum("step").over(kind) != 0)
    level = F.when(left_open, 0).otherwise(running + F.when(closes, 1).otherwise(0))
    leveled = tags.withColumn("level", level)
    same = Window.partitionBy(*keys, "tag", "level").orderBy("at")
    behind = F.lead("at").over(same) + F.when(F.lead("closes").over(same), 1).otherwise(0)
    ended = leveled.withColumn("end", F.when(F.col("void"), F.col("at") + 1).otherwise(F.coalesce(behind, F.col("last") + 1)))
    return Page(keys, whole, ended.where(~F.col("closes")).select(*keys, "at", "end", "tag", "raw"))


def innermost(page: Page, which: Column) -> DataFrame:
    """All elements with ``up``, (at, end) of the innermost element around each that ``which`` holds for; null if there is none.

    The number of such elements around an element is a running sum over beginnings and ends; of those at that level the last one begun is the innermost.
    """
    keys = page.keys
    flagged = page.elements.withColumn("_is", F.coalesce(which, F.lit(False)).cast("int"))
    event = F.explode(F.array(F.struct(F.col("at").alias("pos"), F.lit(1).alias("begins"), F.col("_is").alias("step")), F.struct(F.col("end").alias("pos"), F.lit(0).alias("begins"), (-F.col("_is")).alias("step"))))
    events = flagged.select("*", event.alias("_e")).select("*", F.col("_e.pos").alias("_pos"), F.col("_e.begins").alias("_begins"), F.col("_e.step").alias("_step"))
    order = Window.partitionBy(*keys).orderBy("_pos", "_begins", "at").rowsBetween(Window.unboundedPreceding, -1)
    begun = events.withColumn("_around", F.coalesce(F.sum("_step").over(order), F.lit(0))).where("_begins = 1")
    as_ = F.explode(F.array_compact(F.array(F.struct(F.col("_around").alias("level"), F.lit(0).alias("up")), F.when(F.col("_is") == 1, F.struct((F.col("_around") + 1).alias("level"), F.lit(1).alias("up"))))))
    both = begun.select(*page.elements.columns, as_.alias("_a")).select(*page.elements.columns, F.col("_a.level").alias("_level"), F.col("_a.up").alias("_up"))
    of = Window.partitionBy(*keys, "_level").orderBy("at", F.desc("_up")).rowsBetween(Window.unboundedPreceding, -1)
    up = F.last(F.when(F.col("_up") == 1, F.struct("at", "end")), ignorenulls=True).over(of)
    return both.withColumn("up", up).where("_up = 0").select(*page.elements.columns, "up")


def _renamed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_{k}") for k in keys]


def _same(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]


def _holds(step: str) -> Column:
    """Whether an element is what one step names."""
    found, rest = [], step
    for m in _PART.finditer(step):
        rest = rest.replace(m[0], "", 1)
        if m["tag"]:
            found.append(F.lit(True) if m["tag"] == "*" else F.col("tag") == m["tag"].lower())
        elif m["id"]:
            found.append(attribute(F.col("raw"), "id") == m["id"])
        elif m["cls"]:
            found.append(F.array_contains(F.split(attribute(F.col("raw"), "class"), r"\s+"), m["cls"]))
        else:
            value, wanted = attribute(F.col("raw"), m["name"]), F.lit(m["value"])
            by = {None: lambda: value.isNotNull(), "=": lambda: value == wanted, "*=": lambda: F.contains(value, wanted), "^=": lambda: F.startswith(value, wanted), "$=": lambda: F.endswith(value, wanted), "~=": lambda: F.array_contains(F.split(value, r"\s+"), wanted)}  # noqa: B023
            found.append(by[m["op"]]())
    if rest or not found:
        raise ValueError(f"no selector that is known here: {step}")
    return F.coalesce(reduce(and_, found), F.lit(False))


def steps_of(selector: str) -> list[list[tuple[str, str]]]:
    """Each alternative as its steps: (``>`` or nothing, what the element is)."""
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        steps, at = [], 0
        for m in _STEP.finditer(one):
            if m.start() != at:
                break
            steps.append((m[1], m[2]))
            at = m.end()
        if one[at:].strip() or not steps or steps[0][0]:
            raise ValueError(f"no selector that is known here: {selector}")
        out.append(steps)
    return out


def select(page: Page, selector: str) -> DataFrame:
    """The elements that a selector names."""
    keys, alternatives = page.keys, []
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    for steps in steps_of(selector):
        elements = innermost(page, F.lit(True)) if any(direct for direct, _ in steps) else page.elements
        marked = elements.withColumn("_in", _holds(steps[0][1]))
        for direct, step in steps[1:]:
            if direct:
                above = marked.where("_in").select(*_renamed(keys), F.col("at").alias("_above"), F.lit(True).alias("_hit"))
                marked = marked.join(above, [*_same(keys), F.col("up.at") == F.col("_above")], "left")
                marked = marked.withColumn("_in", _holds(step) & F.coalesce("_hit", F.lit(False))).select(*elements.columns, "_in")
            else:
                reach = F.max(F.when(F.col("_in"), F.col("end"))).over(order)
                marked = marked.withColumn("_reach", reach).withColumn("_in", _holds(step) & F.coalesce(F.col("_reach") > F.col("at"), F.lit(False))).drop("_reach")
        alternatives.append(marked.where("_in").select(*page.elements.columns))
    out = reduce(DataFrame.unionByName, alternatives)
    return out.dropDuplicates([*keys, "at"]) if len(alternatives) > 1 else out


def with_html(page: Page, nodes: DataFrame, begin: str = "at", end: str = "end", name: str = "html") -> DataFrame:
    """``nodes`` with what their page has from ``begin`` up to ``end``; null if these are. The nodes of a page meet it once, as a list, and are cut from its tokens there."""
    keys = page.keys
    of_page = nodes.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in nodes.columns if c not in keys])).alias("_nodes"))
    met = of_page.join(page.pages.select(*_renamed(keys), "_html"), _same(keys)).select(*keys, "_nodes", _tokens(F.col("_html")).alias("_tokens"))
    cut = F.transform("_nodes", lambda n: F.struct(n.alias("_node"), F.array_join(F.slice("_tokens", n[begin] + 1, n[end] - n[begin]), "").alias(name)))
    each = met.select(*keys, F.explode(cut).alias("_x"))
    return each.select(*[F.col(c) if c in keys else F.col(f"_x._node.{c}") for c in nodes.columns], f"_x.{name}")


@dataclass(frozen=True)
class Items:
    """Where a list page keeps its items. ``title``, ``link`` and ``date`` are selectors within an item, which stands for them where they are empty.

    ``around``: the text that says date and content is that of the element directly around the item (``parent``), or of the nearest one of a tag; else the item's. ``title_attribute`` goes
    before the title's text. ``link_like``: a pattern that urls must have. ``id_pattern``, ``detail``: a link's id, and the url with ``{}`` for it; other links are none.
    """

    item: str = "a[href]"
    title: str = ""
    link: str = ""
    date: str = ""
    around: str = ""
    title_attribute: str = ""
    link_like: str = ""
    id_pattern: str = ""
    detail: str = ""


def _first(items: DataFrame, keys: Sequence[str], selector: str) -> DataFrame:
    """keys, _at, raw, html of the first element of each item that a selector names."""
    inner = parsed(items, [*keys, "_at"], "html")
    found = select(inner, selector).where("at > 0").groupBy(*keys, "_at").agg(F.min(F.struct("at", "end", "raw")).alias("x")).select(*keys, "_at", "x.*")
    return with_html(inner, found).drop("at", "end")


def list_items(pages: DataFrame, key: str, url: str, html: str, where: Items, year: int) -> DataFrame:
    """key, at, url, title, published_at, content of the items of list pages (one a ``key``), in the order of the page; items without a title or a link are none."""
    page = parsed(pages, [key], html)
    nodes = select(page, where.item)
    if where.around:
        around = innermost(page, F.lit(True) if where.around == "parent" else F.col("tag") == where.around).select(*_renamed([key]), F.col("at").alias("_of"), F.col("up").alias("_around"))
        nodes = nodes.join(around, [*_same([key]), F.col("at") == F.col("_of")], "left").select(*nodes.columns, F.col("_around.at").alias("up_at"), F.col("_around.end").alias("up_end"))
        nodes = with_html(page, nodes, "up_at", "up_end", "around")
    items = with_html(page, nodes).withColumnRenamed("at", "_at")
    items = items.withColumn("around", F.coalesce("around", "html")) if where.around else items.withColumn("around", F.col("html"))
    # parts are looked for in the items' own html: these are written, so that a page isn't cut again for each
    items = saved(items.select(key, "_at", "raw", "html", "around"), "items")
    wanted = {"title": where.title, "link": where.link, "date": where.date}
    for selector in sorted(set(wanted.values()) - {""}):
        found = _first(items.select(key, "_at", "html"), [key], selector).select(*_renamed([key]), F.col("_at").alias("_of"), F.struct("raw", "html").alias("_found"))
        items = items.join(found, [*_same([key]), F.col("_at") == F.col("_of")], "left").select(*items.columns, *[F.col("_found").alias(n) for n, s in wanted.items() if s == selector])
    for name in [n for n, s in wanted.items() if not s]:
        items = items.withColumn(name, F.struct("raw", F.col("around" if name == "date" else "html").alias("html")))
    raw = F.col("link.raw")
    link = F.coalesce(*[F.nullif(F.trim(attribute(raw, a)), F.lit("")) for a in ("href", "data-url", "data-href")])
    items = items.withColumns({"link": link, "title": F.struct(attribute(F.col("title.raw"), where.title_attribute).alias("named") if where.title_attribute else F.lit(None).cast("string").alias("named"), F.col("title.html").alias("html"))})
    items = saved(items.select(key, "_at", "link", "title", F.col("date.html").alias("date"), "around"), "items")
    link = unescaped(F.col("link"))
    if where.id_pattern:
        link = F.replace(F.lit(where.detail), F.lit("{}"), F.nullif(F.regexp_extract(link, where.id_pattern, 1), F.lit("")))
    said = F.nullif(visible(F.col("title.html")), F.lit(""))
    title = F.coalesce(F.nullif(visible(F.col("title.named")), F.lit("")), said) if where.title_attribute else said
    date = F.regexp_extract(visible(F.col("date")), r"20\d{2}\s*[年/\-.]\s*\d{1,2}\s*[月/\-.]\s*\d{1,2}", 0)
    bases = pages.select(*_renamed([key]), F.col(url).alias("_base"))
    out = items.join(bases, _same([key])).select(
        key, F.col("_at").alias("at"), absolute_url(link, F.col("_base")).alias("url"), title.alias("title"), parse_datetime(F.nullif(date, F.lit("")), year).alias("published_at"), visible(F.col("around")).alias("content")
    ).where("title is not null and url is not null")
    return out.where(F.regexp_like("url", F.lit(where.link_like))) if where.link_like else out
