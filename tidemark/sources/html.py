"""Landed pages: main text, title, tables, metadata, list items and links, all as Columns over the html. Regular expressions read tags; none of them recurses."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.rules import first_match
from tidemark.functions.text import bind, blank_to_null, collapse, parse_datetime

# Parts of a page that hold no text, where its main text stands, and titles that say nothing.
UNREAD = ("script", "style", "noscript", "template", "svg", "canvas")
MAIN_TAGS, MAIN_CLASSES = ("article", "main"), ("article", "article-content", "notice-content", "detail-content", "content", "正文", "内容")
TITLE_CLASSES, EMPTY_TITLES = ("article-title", "detail-title", "title"), ("首页", "详情", "公告")
#: Names of table cells that name a field.
CELL_FIELDS = {
    "项目名称": "projectname", "采购项目名称": "projectname", "项目编号": "projectnum", "采购项目编号": "projectnum", "招标编号": "tendercode", "采购人": "purchaser", "采购单位": "purchaser",
    "招标人": "tenderer", "招标单位": "tenderer", "招标代理机构": "agency", "代理机构": "agency", "发布时间": "published_at", "公告日期": "published_at", "预算金额": "budget", "采购预算": "budget",
}
SUFFIX_OF = {
    "text/html": ".html", "application/json": ".json", "text/json": ".json", "application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "application/zip": ".zip",
}
KNOWN_SUFFIXES = (".html", ".htm", ".json", ".pdf", ".doc", ".docx", ".xls", ".xlsx")
FILES, DOWNLOADS = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "7z"), ("/attach/", "downloadztbattach", "/download/", "attachment")
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


# Named entities of text.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "laquo": "«", "raquo": "»", "mdash": "—", "ndash": "–", "hellip": "…", "middot": "·", "bull": "•",
    "copy": "©", "reg": "®", "trade": "™", "times": "×", "divide": "÷", "plusmn": "±", "deg": "°", "micro": "µ", "sup2": "²", "sup3": "³", "frac12": "½", "yen": "¥", "euro": "€", "pound": "£", "cent": "¢", "sect": "§", "para": "¶",
}


def unescaped(c: Column) -> Column:
    """A text with its entities read: the named ones above, and numbers; ``&amp;`` last, so that nothing is read twice."""

    def numbered(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))
        hexa = lambda e: F.when(F.lower(F.substring(e, 3, 1)) == "x", F.regexp_extract(e, "[xX]([0-9A-Fa-f]+)", 1)).otherwise(F.hex(F.regexp_extract(e, "[0-9]+", 0).cast("long")))
        valid = lambda h: F.conv(h, 16, 10).cast("long").between(1, 0xD7FF) | F.conv(h, 16, 10).cast("long").between(0xE000, 0x10FFFF)
        point = lambda e: F.when(valid(hexa(e)), F.decode(F.unhex(F.lpad(hexa(e), 8, "0")), "UTF-32")).otherwise(e)
        return F.aggregate(found, text, lambda t, e: F.replace(t, e, point(e)))

    for name, plain in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(plain))
    return bind(c, lambda t: F.replace(F.when(F.contains(t, F.lit("&#")), numbered(t)).otherwise(t), F.lit("&amp;"), F.lit("&")))


def cleaned(html: Column) -> Column:
    """Html without what isn't read."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<!--.*?-->|<({'|'.join(UNREAD)})\b[^>]*>.*?</\1\s*>", " ")


def visible(html: Column) -> Column:
    """The text between tags, collapsed, without separators at the ends."""
    text = unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " "))
    return F.regexp_replace(collapse(text), r"^[ :：;；,，]+|[ :：;；,，]+$", "")


def lines_of(html: Column) -> Column:
    """The text between tags with a line for each block, lines collapsed and at most one blank line between them."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6]|/table|/section)\b[^>]*>", "\n"), r"(?s)<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(unescaped(broken), r"[^\S\n]+", " "), r" ?\n ?(?:\n ?){2,}", "\n\n"), r"^\s+|\s+$", "")


def _of_tag(tag: str) -> str:
    return rf"(?is)<{tag}\b{_ATTRIBUTES}>(.*?)</{tag}\s*>"


def _of_class(name: str) -> str:
    return rf"(?is)<(\w+)\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*(?<![\w-]){re.escape(name)}(?![\w-])[^\"']*[\"'][^>]*>(.*?)</\1\s*>"


def main_text(html: Column) -> Column:
    """The longest of a page's articles and content blocks as lines; the whole page if it has none."""

    def longest(page: Column) -> Column:
        blocks = F.concat(*[F.regexp_extract_all(page, F.lit(_of_tag(t)), F.lit(1)) for t in MAIN_TAGS], *[F.regexp_extract_all(page, F.lit(_of_class(c)), F.lit(2)) for c in MAIN_CLASSES])
        best = F.array_max(F.transform(F.transform(blocks, lines_of), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
        return F.coalesce(blank_to_null(best), lines_of(page))

    return bind(cleaned(html), longest)


def page_title(html: Column, otherwise: Column | None = None) -> Column:
    """The first heading, title block or title of a page that says something."""

    def first(page: Column) -> Column:
        found = [F.regexp_extract(page, _of_tag("h1"), 1), *[F.regexp_extract(page, _of_class(c), 2) for c in TITLE_CLASSES], F.regexp_extract(page, _of_tag("title"), 1)]
        titles = F.filter(F.transform(F.array(*found), visible), lambda t: (t != "") & ~t.isin(*EMPTY_TITLES))
        return F.coalesce(F.get(titles, F.lit(0)), visible(otherwise) if otherwise is not None else F.lit(""))

    return bind(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", " "), first)


def table_rows(html: Column) -> Column:
    """The rows of a page's tables that have any text, each an array of its cells."""
    rows = F.regexp_extract_all(cleaned(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|\z)"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?:</t[hd]\s*>|(?=<t[hd]\b)|\z)"), F.lit(1)), visible))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def table_metadata(html: Column) -> Column:
    """A map from the labels of a page's tables, and the fields they name, to the cells beside them; the first of a label counts."""
    pairs = F.flatten(F.transform(table_rows(html), lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(r) - 2), F.lit(2)), lambda i: F.struct(F.get(r, i).alias("key"), F.get(r, i + 1).alias("value")))))
    good = F.filter(pairs, lambda p: (F.coalesce(p.key, F.lit("")) != "") & (F.coalesce(p.value, F.lit("")) != "") & (F.length(p.key) <= 80))
    field_of = F.create_map(*[F.lit(x) for kv in CELL_FIELDS.items() for x in kv])
    both = F.flatten(F.transform(good, lambda p: F.filter(F.array(p, F.struct(F.try_element_at(field_of, p.key).alias("key"), p.value.alias("value"))), lambda q: q.key.isNotNull())))
    return F.aggregate(both, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p.key), m).otherwise(F.map_concat(m, F.create_map(p.key, p.value))))


def absolute_url(link: Column, base: Column) -> Column:
    """A link as an absolute url, dot steps left as they are."""
    root, folder, page = (F.regexp_extract(base, p, 0) for p in (r"^[^/?#]*//[^/?#]*", r"^[^/?#]*//[^/?#]*(?:/[^?#]*/|/)?", r"^[^?#]*"))
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return first_match(
        [
            (F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link),
            (F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^[^/?#]*", 0), link)),
            (F.startswith(link, F.lit("/")), F.concat(root, link)),
            (F.startswith(link, F.lit("?")), F.concat(page, link)),
        ],
        F.concat(folder, link),
    )


def attachment_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, file_name of a page's links to documents and downloads, from href and onclick; of equal urls one stays."""
    anchors = pages.select(key, F.col(url).alias("base"), F.explode(F.regexp_extract_all(cleaned(F.col(html)), F.lit(rf"(?is)(<a\b{_ATTRIBUTES}>.*?)</a\s*>"), F.lit(1))).alias("a"))
    head = F.regexp_extract("a", rf"(?is)^<a\b{_ATTRIBUTES}>", 0)
    value = lambda name: F.regexp_replace(F.regexp_extract(head, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")
    called = F.regexp_extract_all(value("onclick"), F.lit(r"(https?://[^'\"\s)]+|/[^'\"\s)]+\.[A-Za-z0-9]{2,5}(?:\?[^'\"\s)]*)?)"), F.lit(1))
    links = anchors.select(key, "base", visible(F.col("a")).alias("label"), F.explode(F.concat(F.array(value("href")), called)).alias("link"))
    links = links.withColumn("link", F.trim(unescaped(F.col("link")))).where("link <> ''").where(~F.regexp_like("link", F.lit(r"(?i)^(?:javascript:|mailto:|#)")))
    full = links.withColumn("url", absolute_url(F.col("link"), F.col("base")))
    path = F.lower(F.regexp_extract("url", r"^[^/?#]*//[^/?#]*([^#]*)", 1))
    kept = full.where(F.regexp_like(path, F.lit(rf"\.(?:{'|'.join(FILES)})(?:$|\?)")) | F.regexp_like(path, F.lit("|".join(re.escape(d) for d in DOWNLOADS))))
    name = F.coalesce(F.nullif(F.try_url_decode(F.regexp_extract("url", r"/([^/?#]*)(?:[?#]|$)", 1)), F.lit("")), F.nullif("label", F.lit("")))
    return kept.select(key, "url", name.alias("file_name")).groupBy(key, "url").agg(F.max("file_name").alias("file_name"))


@dataclass(frozen=True)
class ListPage:
    """Where a list page keeps its items, by tag or class: an item, and in it the title, the link and the date."""

    item_tag: str = "li"
    item_class: str = ""
    title_class: str = ""
    date_class: str = ""
    link_attributes: Sequence[str] = field(default=("href", "data-url", "data-href"))


def list_items(pages: DataFrame, key: str, url: str, html: str, where: ListPage, year: int) -> DataFrame:
    """key, url, title, published_at, content of the items of landed list pages, each url once a key (the first on the page).

    Items of the same tag must not be nested.
    """
    named = rf"[^>]*\bclass\s*=\s*[\"'][^\"']*(?<![\w-]){re.escape(where.item_class)}(?![\w-])" if where.item_class else ""
    items = pages.select(key, F.col(url).alias("base"), F.posexplode(F.regexp_extract_all(cleaned(F.col(html)), F.lit(rf"(?is)<{where.item_tag}\b{named}[^>]*>.*?</{where.item_tag}\s*>"), F.lit(0))).alias("at", "item"))
    part = lambda name: F.regexp_extract("item", _of_class(name), 2) if name else F.col("item")
    link = F.coalesce(*[F.nullif(F.regexp_extract("item", rf"(?is)\s{a}\s*=\s*[\"']([^\"']+)", 1), F.lit("")) for a in where.link_attributes])
    date = F.regexp_extract(visible(part(where.date_class)), r"20\d{2}\s*[年/\-.]\s*\d{1,2}\s*[月/\-.]\s*\d{1,2}", 0)
    read = items.select(key, "at", absolute_url(F.trim(unescaped(link)), F.col("base")).alias("url"), visible(part(where.title_class)).alias("title"), parse_datetime(F.nullif(date, F.lit("")), year).alias("published_at"), visible(F.col("item")).alias("content"))
    first = read.where("title <> '' and url is not null").groupBy(key, "url").agg(F.min(F.struct("at", "title", "published_at", "content")).alias("x"))
    return first.select(key, "url", "x.title", "x.published_at", "x.content")


def suffix_of(mime: Column, url: Column, names_first: bool = False) -> Column:
    """A file's suffix by its type, else by its url (``.bin`` if unknown); with ``names_first`` by the url, else by the type (empty if unknown)."""
    media = F.lower(F.trim(F.regexp_extract(mime, "^[^;]*", 0)))
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_OF.items() for x in kv]), media)
    by_name = F.nullif(F.lower(F.regexp_extract(F.regexp_extract(url, "^[^?]*", 0), r"(\.[A-Za-z0-9]+)$", 1)), F.lit(""))
    return F.coalesce(by_name, by_type, F.lit("")) if names_first else F.coalesce(by_type, F.when(by_name.isin(*KNOWN_SUFFIXES), by_name), F.lit(".bin"))


@F.pandas_udf(StringType())
def safe_filename(names: pd.Series) -> pd.Series:
    """Names in normal form KC without characters that file systems refuse, of at most 180; ``attachment`` for none. Nothing in the JVM normalises so."""

    def safe(name: str | None) -> str:
        plain = re.sub(r'[<>:"|?*\x00-\x1f\\/]', "_", unicodedata.normalize("NFKC", name or "").strip())
        return re.sub(r"\s+", " ", plain).strip(" .")[:180] or "attachment"

    return names.map(safe)


def json_lines(text: Column, depth: int = 4) -> Column:
    """``path: value`` lines of a JSON object or list, depth first, down to ``depth`` levels; what lies deeper stays JSON. Null if it isn't JSON."""
    kind = "variant"
    start = F.array(F.struct(F.lit("").alias("path"), F.try_parse_json(text).alias("v"), F.array().cast("array<int>").alias("at")))

    def children(x: Column) -> Column:
        whole = F.to_json(x.v)
        as_map = F.from_json(F.when(F.startswith(whole, F.lit("{")), whole), f"map<string,{kind}>")
        as_list = F.from_json(F.when(F.startswith(whole, F.lit("[")), whole), f"array<{kind}>")
        of_map = F.transform(F.map_entries(as_map), lambda e, i: F.struct(F.concat(x.path, F.when(x.path != "", ".").otherwise(""), e.key).alias("path"), e.value.alias("v"), F.concat(x["at"], F.array(i)).alias("at")))
        of_list = F.transform(as_list, lambda v, i: F.struct(F.concat(x.path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("v"), F.concat(x["at"], F.array(i)).alias("at")))
        return F.coalesce(of_map, of_list, F.array(x))

    level = start
    for _ in range(depth):
        level = F.flatten(F.transform(level, children))
    said = F.transform(level, lambda x: F.concat(x.path, F.lit(": "), F.coalesce(F.try_variant_get(x.v, "$", "string"), F.to_json(x.v), F.lit("None"))))
    return F.when(F.try_parse_json(text).isNotNull(), said)
