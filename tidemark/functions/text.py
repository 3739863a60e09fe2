"""Text, url, amount and date functions as Columns; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that never identify a page.
TRACKING = ("fbclid", "from", "gclid", "msclkid", "ref", "referrer", "share_token", "spm")
PAGINATION = ("limit", "offset", "page", "page_index", "page_no", "page_size", "pageindex", "pageno", "pagesize", "pn", "rn", "size")


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it, also within higher-order functions."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def normalize_identity(c: Column) -> Column:
    """Lower case without white space, dashes, brackets and separators; empty for null."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\-—_()（）【】\[\]，。,.;；:：/\\]+", ""))


def normalize_region(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s，。、；：:（）()【】\[\]「」《》/\\_\-]+", ""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def domain(url: Column, strip_www: bool = True) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", "") if strip_www else host, F.lit(""))


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonicalize_url(url: Column, strip_pagination: bool = True) -> Column:
    """One spelling for each page: https, host in lower case, no default port, tracking, fragment or trailing slash, sorted query."""
    u = F.trim(url)
    part = lambda k: F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    scheme, place, path, query = F.lower(part(1)), F.lower(F.regexp_replace(part(2), "^.*@", "")), part(3), part(4)
    local = F.regexp_extract(place, r"^([^:]*)", 1).isin("localhost", "127.0.0.1")
    upgraded = F.when((scheme == "http") & ~local, "https").otherwise(scheme)
    port = F.regexp_extract(place, r":(\d+)$", 1)
    default = ((upgraded == "https") & (port == "443")) | ((upgraded == "http") & (port == "80"))
    place = F.when(default, F.regexp_replace(place, r":\d+$", "")).otherwise(place)
    path = F.regexp_replace(path, "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(F.coalesce(F.try_url_decode(F.regexp_extract(p, "^[^=]*", 0)), p).alias("k"), F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")).alias("v")),
    )
    dropped = [*TRACKING, *(PAGINATION if strip_pagination else ())]
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.startswith(F.lower(p.k), F.lit("utm_")) & ~F.lower(p.k).isin(*dropped)))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p.k), F.lit("="), _quoted(p.v))), "&")
    whole = F.concat(upgraded, F.lit("://"), place, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(u.isNull() | (u == ""), F.lit("")).when(part(2) == "", u).otherwise(whole)


def content_hash(*parts: Column) -> Column:
    """Hexadecimal SHA-256 of the parts, joined by unit separators; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


#: Characters of a name that are compared as the bits of one number.
BITS = 61


def candidate_id(key: Column) -> Column:
    """The id of a candidate, which follows from its key."""
    return F.concat(F.lit("candidate_"), F.left(F.sha2(key, 256), F.lit(40)))


def places_of(chars: Column) -> Column:
    """A map from each character of an array of at most ``BITS`` to its places, as bits."""
    bits = lambda c: F.aggregate(F.transform(chars, lambda y, j: F.when(y == c, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("key"), bits(c).alias("value"))))


def common_by_bits(xs: Column, places: Column, size: Column) -> Column:
    """Length of the longest common subsequence of an array of characters and a name of ``size`` characters, given by its ``places_of``.

    Bit j of the state is 0 where a row of the dynamic program rises at j; a character changes the whole row by one addition.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size) - F.lit(1).cast("long")

    def step(v: Column, x: Column) -> Column:
        here = F.coalesce(F.try_element_at(places, x), F.lit(0).cast("long"))
        return (v + v.bitwiseAND(here)).bitwiseOR(v.bitwiseAND(F.bitwise_not(here))).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(xs, full, step))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 times the longest common subsequence over both lengths; 0 if either is empty. By the bits of a number where the shorter text allows, else one row of the table at a time."""
    first = F.length(a) >= F.length(b)
    xs, ys = (F.filter(F.split(c, ""), lambda x: x != "") for c in (F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)))
    zero = F.transform(F.sequence(F.lit(0), F.size(ys)), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        step = lambda acc, j: F.concat(acc, F.array(F.when(F.get(ys, j) == x, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(acc, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.size(ys) - 1), F.array(F.lit(0)), step)

    by_bits = bind(places_of(ys), lambda places: common_by_bits(xs, places, F.size(ys)))
    lcs = F.when(F.least(F.length(a), F.length(b)) <= BITS, by_bits).otherwise(F.element_at(F.aggregate(xs, zero, row), -1))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 200.0 * lcs / (F.length(a) + F.length(b))).otherwise(0.0)


def money(c: Column) -> Column:
    """Yuan of an amount with 元, 万元 or 亿元; a bare number is yuan; else null."""
    text = F.regexp_replace(c, "[,，]", "")
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(亿元|万元|元)", 1)
    unit = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(亿元|万元|元)", 2)
    scale = F.when(unit == "亿元", 100_000_000).when(unit == "万元", 10_000).otherwise(1)
    value = F.when(number != "", number).otherwise(F.trim(text)).try_cast("decimal(28,8)") * scale
    return value.try_cast("decimal(18,2)")


def capacity_mw(c: Column) -> Column:
    """The largest power in a text, in MW; energy units aren't power."""
    hits = F.regexp_extract_all(c, F.lit(r"(?i)\d+(?:\.\d+)?\s*(?:GWp?|MWp?|kWp?|吉瓦|兆瓦|千瓦)(?!h|时)"), F.lit(0))
    scale = lambda u: F.when(u.isin("gw", "gwp", "吉瓦"), 1000.0).when(u.isin("kw", "kwp", "千瓦"), 0.001).otherwise(1.0)
    return F.array_max(F.transform(hits, lambda h: F.regexp_extract(h, r"^[\d.]+", 0).cast("double") * scale(F.lower(F.regexp_extract(h, r"[^\d.\s]+$", 0)))))


def parse_datetime(c: Column, year: int, default_hour: int = 17) -> Column:
    """Local time of a Chinese or ISO date; without a clock at ``default_hour``, without a year in ``year``, null if invalid."""
    plain = F.replace(F.regexp_replace(F.trim(c), "(星期|周)[一二三四五六日天]|^DATE ", " "), F.lit("半"), F.lit("30分"))
    return bind(plain, lambda t: _datetime(t, year, default_hour))


def _datetime(text: Column, year: int, default_hour: int) -> Column:
    iso = F.regexp_like(text, F.lit(r"\dT\d.*(Z|[+-]\d{2}:?\d{2})$"))
    # one replacement writes all parts of the date, one those of the clock behind it; a text without them stays as it is
    sep = "\x1f"
    date = r"(?s)^.*?(?:(\d{4})\s*[年/\-.])?\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})\s*日?(.*)$"
    clock = r"(?s)^.*?日?\s*(上午|下午|晚上|傍晚|AM|PM)?\s*(\d{1,2})(?:[:：]|[点时]\s*)(\d{1,2})?.*$"
    parts = F.split(F.regexp_replace(text, date, f"{sep}$1{sep}$2{sep}$3{sep}$4"), sep)

    def timed(p: Column) -> Column:
        hands = F.split(F.regexp_replace(F.coalesce(F.get(p, 4), F.lit("")), clock, f"{sep}$1{sep}$2{sep}$3"), sep)
        named = lambda h: F.struct(F.get(p, 1).alias("y"), F.get(p, 2).alias("m"), F.get(p, 3).alias("d"), *[F.coalesce(F.get(h, k), F.lit("")).alias(n) for k, n in ((1, "period"), (2, "hour"), (3, "minute"))])
        return bind(hands, named)

    bound = bind(parts, timed)

    def local(x: Column) -> Column:
        h = F.when(x.hour == "", default_hour).otherwise(x.hour.try_cast("int"))
        h = F.when(x.period.isin("下午", "晚上", "傍晚", "PM") & (h < 12), h + 12).when(x.period.isin("上午", "AM") & (h == 12), 0).otherwise(h)
        base = F.try_make_timestamp_ntz(F.when(x.y == "", year).otherwise(x.y.try_cast("int")), x.m.try_cast("int"), x.d.try_cast("int"), F.when(h == 24, 0).otherwise(h), F.coalesce(x.minute.try_cast("int"), F.lit(0)), F.lit(0).cast("decimal(16,6)"))
        return base + F.make_dt_interval(F.when(h == 24, 1).otherwise(0))

    zoned = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz"))
    return F.when(iso, zoned).otherwise(bind(bound, local))


def document_quality(text: Column, terms: Sequence[str]) -> Column:
    """0 to 10,000: share of printable characters, length up to 400 without spaces, and terms found of three."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    printable = F.length(F.regexp_replace(t, r"[\x00-\x08\x0E-\x1F\x7F]", "")) / F.when(n > 0, n)
    solid = F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]", ""))
    found = sum((F.when(F.contains(t, F.lit(x)), 1).otherwise(0) for x in terms), F.lit(0))
    whole = printable * (F.lit(0.25) + F.lit(0.75) * F.least(F.lit(1.0), solid / F.lit(400.0))) * F.least(F.lit(1.0), found / F.lit(float(min(3, len(terms)))))
    return F.coalesce(F.floor(whole * 10000 + 0.5), F.lit(0)).cast("long")


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """Terms that the text contains, whatever their case, in the order given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array_distinct(F.array(*[F.lit(t) for t in terms])), lambda t: F.contains(low, F.lower(t)))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """One of the terms occurs, whatever its case: a search of bytes for each, which is cheaper than one alternation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return bind(low, lambda t: reduce(or_, [F.contains(t, F.lit(x.lower())) for x in terms])) if terms else F.lit(False)


def contains_all(text: Column, query: str) -> Column:
    """Every blank-separated term occurs; no term: false."""
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(bool(query.split()))
    for t in query.lower().split():
        hit = hit & F.contains(low, F.lit(t))
    return hit


def source_level(url: Column) -> Column:
    """A to E by who publishes: government, messaging accounts, agencies, press, others."""
    host = domain(url)
    return (
        F.when(host.rlike(r"(^|\.)(gov|mil)(\.cn)?$"), "A").when(F.endswith(host, F.lit("weixin.qq.com")), "B").when(host.rlike("(zhaobiao|bidding|tender)"), "C").when(host.rlike("(news|bjx|solar)"), "D").otherwise("E")
    )


def level_rank(level: Column) -> Column:
    """1 to 5 for A to E; null counts as E, others 9."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in zip("ABCDE", range(1, 6), strict=True) for x in (F.lit(k), F.lit(v))]), F.coalesce(level, F.lit("E"))), F.lit(9))


def change_type(title: Column) -> Column:
    """What kind of follow-up a notice's title announces; ``original`` if none."""
    t = F.coalesce(title, F.lit(""))
    out = F.when(F.contains(t, F.lit("延期")), "extension")
    for word, kind in (("澄清", "clarification"), ("更正", "correction"), ("补充", "supplement"), ("变更", "change"), ("调整", "change")):
        out = out.when(F.contains(t, F.lit(word)), kind)
    return out.otherwise("original")


def time_precision(raw: Column) -> Column:
    """RANGE, DATETIME or DATE_ONLY of a raw date; 截至 doesn't make a range."""
    clock = r"\d{1,2}\s*[:：点时]"
    return F.when(raw.rlike(r"(?<!截)至|到|~|～|\s-\s"), "RANGE").when(raw.rlike(clock), "DATETIME").otherwise("DATE_ONLY")


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First and last microsecond of a day in local time."""
    start = F.date_trunc("day", day).cast("timestamp_ntz")
    return start, start + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.000001 SECOND")


def page_for(pages: Column, fragment: Column) -> Column:
    """Number of the first page, of an array of (page_number, text), that holds a fragment whatever its white space."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.get(F.filter(pages, lambda p: F.contains(bare(p.text), bare(fragment))), F.lit(0)).page_number


def missing_fields(columns: dict[str, Column]) -> Column:
    """Names of the columns that are null or blank, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in columns.items()]))


def http_status_note(note: Column) -> Column:
    """The status that a note names as ``HTTP nnn``."""
    return F.regexp_extract(note, r"\bHTTP\s+(\d{3})\b", 1).try_cast("int")
