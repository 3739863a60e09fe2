"""URL filter with redirect equivalence, in DataFrame functions alone.

A rule names a host and a path prefix and fits that host and its subdomains; the longest fitting rule decides.
A url that no rule fits takes the decision of its aliases: urls tied by redirects (given, or a page's meta
refresh) and canonical links form components, found by distributed label contraction. In a component an
explicit allow takes precedence over any block; a block without an allow blocks all; else urls are allowed. Aliases are
compared in one normal form (``normal_url``), links resolved as RFC 3986 has it.

Defined cases. Null url or one without ``://``: host and path empty, no rule, no links, allowed. Null html: no
links. Repeated pages: each is judged. Equally long rules: the longer host, then allow. No pages or no rules:
no rows, or all allowed. Further columns are ignored. Very long html is read whole, by regular expressions that don't
recurse; it is held once or twice by a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_broadcast, table, written
from tidemark.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are compiled into one expression; more are joined by host suffix.
COMPILED = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule.of("block", "net/"), Rule.of("allow", "example.net/en/"), Rule.of("block", "example.com/de/"), Rule.of("allow", "org/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judged(urls: DataFrame, rules: Sequence[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with ``rule`` and ``verdict`` of the longest fitting rule, both null where none fits."""
    order = sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.verdict, r.text))
    if len(order) <= COMPILED:
        fits = lambda r: ((F.col(host) == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule = verdict = F.lit(None).cast("string")
        for r in reversed(order):
            rule, verdict = F.when(fits(r), r.text).otherwise(rule), F.when(fits(r), r.verdict).otherwise(verdict)
        return urls.withColumns({"rule": rule, "verdict": verdict})
    spark = urls.sparkSession
    ranked = spark.createDataFrame([(r.host, r.path, r.text, r.verdict, -i) for i, r in enumerate(order)], "rule_host string, rule_path string, rule string, verdict string, rank int")
    pairs = urls.select(host, path).distinct()
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = pairs.withColumn("rule_host", F.explode(suffixes)).join(maybe_broadcast(ranked, len(order), 100_000), "rule_host").where(F.startswith(path, F.col("rule_path")))
    best = written(hits.groupBy(host, path).agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("best")).select(host, path, "best.*"), "judged")
    return urls.join(best, [host, path], "left")


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its ``.`` and ``..`` steps (RFC 3986, 5.2.4)."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    # a path that ends in such a step ends in a slash
    bare = F.concat(F.array_join(kept, "/"), F.when(F.regexp_like(path, F.lit(r"/\.{1,2}$")), "/").otherwise(""))
    return F.when(F.regexp_like(path, F.lit(r"/\.{1,2}(/|$)")), bare).otherwise(path)


def normal_url(url: Column) -> Column:
    """The spelling in which urls are compared: no white space around, no fragment, scheme and host in lower case, no default or empty port, a path without dot steps that is ``/`` at least. Null without ``://``."""
    part = lambda k: F.regexp_extract(url, r"^[\x00-\x20]*([^:/?#]*)://([^/?#\s]*)([^?#\s]*)(\?[^#\s]*)?", k)
    scheme, place = F.translate(part(1), UPPER, LOWER), part(2)
    user = F.regexp_extract(place, "^.*@", 0)
    host = F.translate(F.substring(place, F.length(user) + 1, F.length(place)), UPPER, LOWER)
    default = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(F.regexp_replace(host, ":$", ""))
    path = F.when(part(3) == "", "/").otherwise(_without_dots(part(3)))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), user, default, path, part(4)))


def _bare(c: Column) -> Column:
    """Without white space around."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _decoded(value: Column) -> Column:
    """An attribute without the entities that urls need, and without white space around."""
    out = F.regexp_replace(value, "(?i)&(quot|#34|#x22);", '"')
    for pattern, plain in (("&(apos|#39|#x27);", "'"), ("&(lt|#60|#x3c);", "<"), ("&(gt|#62|#x3e);", ">"), ("&(amp|#38|#x26);", "&")):
        out = F.regexp_replace(out, "(?i)" + pattern, plain)
    return _bare(out)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare; empty without it. Others that end in ``name`` (``data-href``) don't count."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute url in normal form (RFC 3986, 5.2.2), from a base in normal form; null for other schemes and for links within the page."""
    link = _bare(link)
    root, folder, page = (F.regexp_extract(base, p, 0) for p in ("^[^/?#]*//[^/?#]*", "^[^?#]*/", "^[^?#]*"))
    whole = (
        F.when((link == "") | F.startswith(link, F.lit("#")), None)
        .when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), link)
        .when(F.regexp_like(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), None)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^[^/?#]*", 0), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )
    return normal_url(whole)


#: A tag with its attributes, whose quoted values may hold ``>``.
_TAG = r"(?is)<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """from_url, to_url (both in normal form) of the canonical link and of the meta refresh that whole pages declare.

    The first of each counts. Comments and scripts declare nothing. Links are relative to the page, or to its first ``base``.
    """
    read = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = pages.select(normal_url(F.col(url)).alias("from_url"), F.regexp_extract_all(read, F.lit(_TAG), F.lit(0)).alias("tags")).where("from_url is not null and size(tags) > 0")
    is_a = lambda t, name: F.startswith(F.lower(t), F.lit("<" + name))
    href = lambda t: _decoded(_attribute(t, "href"))
    base = F.get(F.filter(F.transform(F.filter("tags", lambda t: is_a(t, "base")), href), lambda x: x != ""), 0)
    based = tags.select("from_url", "tags", F.coalesce(resolved(base, F.col("from_url")), F.col("from_url")).alias("base"))
    canonical = F.filter("tags", lambda t: is_a(t, "link") & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical") & (href(t) != ""))
    # the url of a refresh may be quoted within the attribute
    target = lambda t: F.regexp_replace(F.regexp_extract(_decoded(_attribute(t, "content")), r"(?is)^[\d.\s]*[;,]?\s*url\s*=\s*(\"[^\"]*|'[^']*|\S+)", 1), "^[\"']", "")
    refresh = F.filter("tags", lambda t: is_a(t, "meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh") & (target(t) != ""))
    links = F.array_compact(F.array(href(F.get(canonical, 0)), target(F.get(refresh, 0))))
    return based.select("from_url", "base", F.explode(links).alias("link")).select("from_url", resolved(F.col("link"), F.col("base")).alias("to_url")).where("to_url is not null")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and component (the url that stands for the page's aliases, null if it has none).

    ``redirects``: from_url, to_url of a crawl log.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        source = normal_url(F.col("from_url"))
        links = links.unionByName(redirects.select(source.alias("from_url"), resolved(F.col("to_url"), source).alias("to_url")))
    member = written(components(links, "from_url", "to_url"), "aliases")
    host, path = url_parts(F.col("node"))
    ruled = judged(member.withColumns({"host": host, "path": path}), rules)
    decided = ruled.groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.bool_or(F.col("verdict") == "block").alias("blocked"))
    decided = written(decided.select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("inherited")), "decided")
    alias = written(member.join(decided, "component"), "inherited")
    host, path = url_parts(F.col("url"))
    bare = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path, "node": normal_url(F.col("url"))})
    out = judged(bare, rules).join(alias, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "inherited", F.lit("allow")).alias("verdict"), "component")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES).drop("component")


#: For pages whose html declares no canonical link or refresh: there the method allows what no rule fits.
SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT u.page_id, u.host, u.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(r.verdict, length(rhost || rpath)) AS verdict
  FROM urls u LEFT JOIN rules r
    ON (u.host = r.rhost OR suffix(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
