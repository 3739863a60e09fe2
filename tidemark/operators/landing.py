"""Sources whose answers and pages have landed: connectors as configuration, details, incremental cuts, and the runs that use them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match, yes
from tidemark.functions.text import contains_all, domain, parse_datetime
from tidemark.operators import runs
from tidemark.operators.core import conflicts
from tidemark.operators.notices import evidence_of, extract_notices
from tidemark.sources import html as H
from tidemark.sources.select import Items
from tidemark.sources.select import list_items as selected_items

#: Keys below which search answers keep their records, and the usual names of a record's fields.
ENVELOPE = ("records", "data", "items", "rows", "list", "result", "content")
USUAL = {"title": ("title", "noticeTitle", "name", "projectname"), "url": ("linkurl", "url", "detailUrl", "href"), "published_at": ("webdate", "infodate", "showdate", "publishdate", "published_at", "noticeTime")}
WECHAT = "mp.weixin.qq.com"
ITEM = "source_id string, url string, title string, published_at timestamp_ntz, content string"


@dataclass(frozen=True)
class Connector:
    """How a source's landed answers are read: ``kind`` json or html; ``fields``: its names for the usual ones; ``detail``: a url with ``{}`` for a
    record's id; ``rewrite``: a path's beginning and what takes its place; ``page``: by tags and classes, or by selectors; ``lists``: paths of its list pages; ``metadata``: its names for
    what records say beside the usual; ``filtered``: the site doesn't search by all terms, so its items are filtered by them."""

    source_id: str
    kind: str = "json"
    base_url: str = ""
    fields: Mapping[str, Sequence[str]] = field(default_factory=dict)
    detail: str = ""
    rewrite: tuple[str, str] = ("", "")
    page: H.ListPage | Items = field(default_factory=H.ListPage)
    lists: Sequence[str] = ()
    metadata: Mapping[str, Sequence[str]] = field(default_factory=dict)
    filtered: bool = False


def json_records(body: Column, depth: int = 4) -> Column:
    """The objects of an answer as JSON texts, wherever its envelope keeps them, also in a text that is JSON itself; empty for broken answers."""
    level = F.array(F.trim(body))
    is_list = lambda x: F.startswith(x, F.lit("["))
    for _ in range(depth):
        inner = lambda x: F.filter(F.array(*[F.trim(F.get_json_object(x, f"$.{k}")) for k in ENVELOPE]), lambda y: y.isNotNull())
        level = F.flatten(F.transform(level, lambda x: F.when(is_list(x), F.array(x)).otherwise(inner(x))))
    found = F.get(F.filter(level, lambda x: is_list(x) & F.contains(x, F.lit("{"))), F.lit(0))
    return F.coalesce(F.filter(F.from_json(found, "array<string>"), lambda x: F.startswith(x, F.lit("{"))), F.array().cast("array<string>"))


def listed_items(answers: DataFrame, c: Connector, year: int, terms: str = "") -> DataFrame:
    """source_id, url, title, published_at, content of landed answers (page, url, body), each url once, the first page's first; only items that hold all ``terms``."""
    spark = answers.sparkSession
    if c.kind == "html" and isinstance(c.page, Items):
        rows = selected_items(answers, "page", "url", "body", c.page, year)
    elif c.kind == "html":
        rows = H.list_items(answers, "page", "url", "body", c.page, year)
        rows = rows.select("page", F.lit(0).alias("at"), "url", "title", "published_at", "content")
    elif c.kind == "json":
        one = answers.select("page", F.posexplode(json_records(F.col("body"))).alias("at", "r"))
        named = lambda n: F.coalesce(*[F.nullif(F.trim(F.get_json_object("r", f"$.{k}")), F.lit("")) for k in c.fields.get(n, USUAL[n])])
        link = F.replace(F.lit(c.detail), F.lit("{}"), F.url_encode(named("url"))) if c.detail else named("url")
        link = F.when(F.startswith(link, F.lit(c.rewrite[0])), F.concat(F.lit(c.rewrite[1]), F.substring(link, len(c.rewrite[0]) + 1, 10_000))).otherwise(link) if c.rewrite[0] else link
        rows = one.select("page", "at", H.absolute_url(link, F.lit(c.base_url)).alias("url"), H.visible(named("title")).alias("title"), parse_datetime(named("published_at"), year).alias("published_at"), F.col("r").alias("content"))
    else:
        return spark.createDataFrame([], ITEM)
    rows = rows.where("title <> '' and url is not null")
    if terms.split():
        rows = rows.where(contains_all(F.concat_ws(" ", "title", "content"), terms))
    first = rows.groupBy("url").agg(F.min(F.struct("page", "at", "title", "published_at", "content")).alias("x"))
    return first.select(F.lit(c.source_id).alias("source_id"), "url", "x.title", "x.published_at", "x.content")


def metadata_of(content: Column, c: Connector) -> Column:
    """What a record says under a site's own names, by the usual names; a name without a value isn't in the map."""
    named = lambda keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object(content, f"$.{k}")), F.lit("")) for k in keys])
    every = F.array(*[F.struct(F.lit(n).alias("key"), named(keys).alias("value")) for n, keys in c.metadata.items()])
    return F.map_from_entries(F.filter(every, lambda e: e.value.isNotNull())) if c.metadata else F.create_map().cast("map<string,string>")


def connector_of(definition: Mapping, known: Mapping[str, Connector]) -> Connector:
    """The connector of a registered source: one that its adapter names, a configured page, or one that reads nothing (browser and catalogue sources)."""
    if definition.get("adapter_level") == "CUSTOM_BROWSER":
        return Connector(definition["source_id"], kind="none")
    adapter = str(definition.get("adapter") or "")
    if adapter.startswith("generic"):
        return Connector(definition["source_id"], kind="html", base_url=str(definition.get("base_url") or ""))
    found = known.get(adapter)
    return replace(found, source_id=definition["source_id"], base_url=str(definition.get("base_url") or found.base_url)) if found else Connector(definition["source_id"], kind="none")


def since(items: DataFrame, state: DataFrame, now: Column, days: int, asked: int | None = None) -> DataFrame:
    """Items that a run takes: those of the last days, or since a day before the source's last success if that is later and no days are asked for. Undated items always pass.

    ``state``: source_id, last_success_at.
    """
    from_ = now - F.make_dt_interval(F.lit(asked if asked is not None else days))
    j = items.join(state.select("source_id", "last_success_at"), "source_id", "left")
    cutoff = from_ if asked is not None else F.greatest(from_, F.col("last_success_at") - F.expr("INTERVAL 1 DAY"))
    return j.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff)).drop("last_success_at")


def details(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with their landed page's title, text, tables' metadata and attachments. ``pages``: url, html, final_url; a page that another host answered is none.

    Items without a page keep nulls.
    """
    own = pages.select(F.col("url"), F.coalesce("final_url", "url").alias("landed_url"), "html").where(domain(F.col("landed_url")).eqNullSafe(domain(F.col("url"))))
    read = own.select("url", "landed_url", H.page_title(F.col("html")).alias("page_title"), H.main_text(F.col("html")).alias("text"), H.table_metadata(F.col("html")).alias("metadata"))
    j = items.join(read, "url", "left").join(_attachments(own), "url", "left")
    return j.withColumn("title", F.coalesce(F.nullif("page_title", F.lit("")), "title")).drop("page_title")


def _attachments(pages: DataFrame) -> DataFrame:
    """url and the (url, file_name) of its page's attachments, in order."""
    keyed = pages.select(F.col("url").alias("page_url"), "landed_url", "html")
    links = H.attachment_links(keyed, "page_url", "landed_url", "html")
    return links.groupBy(F.col("page_url").alias("url")).agg(F.array_sort(F.collect_set(F.struct(F.col("url"), "file_name"))).alias("attachments"))


def provider_results(results: DataFrame, wechat: bool = False) -> DataFrame:
    """Search results (url, title, ...) that can be used: with a url and a title, and, of a search for accounts, from there."""
    kept = results.where((F.coalesce(F.trim("url"), F.lit("")) != "") & (F.coalesce(F.trim("title"), F.lit("")) != ""))
    return kept.where(domain(F.col("url"), strip_www=False) == WECHAT) if wechat else kept


def token_table(projects: DataFrame, announcements: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(token, project_id): each word of a project's fields and of its announcements once, for searches by hash join."""
    from tidemark.operators.recall import present, with_texts

    whole = with_texts(projects, announcements)
    text = F.lower(F.concat_ws(" ", *present(whole, *fields), "announced_text"))
    return whole.select("project_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("token")).select("token", "project_id")


def find_by_tokens(tokens: DataFrame, text: str, most: int = 50) -> DataFrame:
    """The first projects, by id, that have every word of a text; none for a blank one."""
    words = sorted(set(text.lower().split()))
    if not words:
        return tokens.select("project_id").limit(0)
    hits = tokens.where(F.col("token").isin(*words)).groupBy("project_id").agg(F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") == len(words)).select("project_id").orderBy("project_id").limit(most)


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, if there is one; a filter that reaches the files."""
    return df.where(F.col(key) == F.lit(value))


def project_list(projects: DataFrame, day: Column, text: str = "", status: str = "", view: str = "all", most: int = 500) -> DataFrame:
    """Projects of a list page: of a text the first ``most`` found, of a status, in a view (today-new, today-changed, reopened, favorite, ignored); ignored ones only in their own view."""
    from tidemark.operators.recall import find_projects

    out = projects
    if status.upper() in ("OPEN", "UNKNOWN", "CLOSED"):
        out = out.where(F.col("status") == status.upper())
    views = {"today-new": (F.col("lifecycle_state") == "NEW") & (F.col("created_at") >= day), "today-changed": F.col("last_change_at") >= day, "reopened": F.col("lifecycle_state") == "REOPENED", "favorite": F.col("favorite")}
    if view in views:
        out = out.where(views[view])
    ignored = yes(F.col("ignored"))
    out = out.where(ignored if view == "ignored" else ~ignored)
    # what a text finds is limited last, so that a filtered list lacks nothing
    return find_projects(out, text, most) if text.strip() else out


def missing_tables(spark: SparkSession, required: Sequence[str]) -> list[str]:
    """Names of the required tables that the catalogue lacks, in order."""
    return [t for t in required if not spark.catalog.tableExists(t)]


@dataclass(frozen=True)
class Extraction:
    """What an extraction run makes: records, their evidence, conflicts of values, the timeline's events, and the notices that failed, with the reason."""

    records: DataFrame
    evidence: DataFrame
    conflicts: DataFrame
    events: DataFrame
    failed: DataFrame


def extraction_run(notices: DataFrame, parses: DataFrame, attachments: DataFrame, old_events: DataFrame, year: int, now: Column, version: str, parser: str) -> Extraction:
    """Extracts the notices that aren't current (``cached``). ``notices``: what ``cached`` asks for, and url, title, text, error, kind, published_at.

    A notice with an error is a row of ``failed`` and stops no other. Conflicts are those of the codes and deadlines that several notices give a project.
    """
    due = notices.join(runs.cached(notices, parses, attachments, version, parser), "id", "left_anti")
    bad = F.col("error").isNotNull() | (F.coalesce(F.trim("text"), F.lit("")) == "")
    records = extract_notices(due.where(~bad).drop("content_hash", "snapshot_hash"), year, now)
    proof = evidence_of(records)
    values = proof.where(F.col("field_name").isin("project_code", *runs.SNAPSHOT_FIELDS)).select("project_id", "field_name", F.col("normalized_value").alias("value"))
    ids = with_ids(proof)
    events = runs.timeline_events(old_events, records.select("id", "project_id", "published_at", "kind", "title"), records.groupBy("project_id").agg(*[F.max(f).alias(f) for f in runs.SNAPSHOT_FIELDS]), ids.join(records.select("id", "url").withColumnRenamed("id", "announcement_id"), "url").select("id", "announcement_id"))
    return Extraction(records, ids, conflicts(values, ["project_id", "field_name"], "value"), events, due.where(bad).select("id", F.coalesce("error", F.lit("EMPTY_TEXT")).alias("reason")))


def with_ids(evidence: DataFrame) -> DataFrame:
    """Evidence with an id that follows from its project, field, url and value, so that reruns agree."""
    return evidence.withColumn("id", F.xxhash64("project_id", "field_name", "url", "normalized_value"))


def document_closure(candidates: DataFrame, documents: DataFrame, facts: DataFrame, year: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, facts) after the documents that enrichment found: their fields become facts, fill what a candidate lacks, and rescore it.

    ``candidates``: candidate_id, candidate_values, blocker. ``documents``: candidate_id, url, title, text, error. A candidate none of whose documents could be read is blocked.
    """
    from tidemark.operators.metrics import WEIGHTS, completeness

    good = documents.where("error is null")
    records = extract_notices(good, year, now)
    names = {"project_name": "project_name", "owner": "owner", "agency": "agency", "project_code": "project_code", "bid_deadline": "bid_deadline", "document_deadline": "document_deadline", "open_time": "open_time", "participation_method": "participation_method"}
    said = records.select("candidate_id", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(c).cast("string") for c in names.values()]))).alias("field_name", "value")).where("value is not null")
    every = runs.facts_added(facts, said.select(*facts.columns))
    first = every.groupBy("candidate_id", "field_name").agg(F.min("value").alias("value")).groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("learnt"))
    tried = documents.groupBy("candidate_id").agg(F.count_if(F.col("error").isNull()).alias("read"), F.count("*").alias("tried"))
    j = candidates.join(first, "candidate_id", "left").join(tried, "candidate_id", "left")
    none = F.create_map().cast("map<string,string>")
    values = F.map_zip_with(F.coalesce("candidate_values", none), F.coalesce("learnt", none), lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    j = j.withColumn("candidate_values", values)
    score = completeness({n: F.try_element_at("candidate_values", F.lit(n)) for n in WEIGHTS}, yes(F.col("read") > 0), yes(F.col("read") > 0))
    blocked = yes((F.col("tried") > 0) & (F.col("read") == 0))
    out = j.withColumns({"completeness_score": score, "blocker": F.when(blocked, F.coalesce("blocker", F.lit("EXTRACTION_FAILED"))).otherwise(F.col("blocker"))})
    state = first_match([(blocked, "BLOCKED"), (F.col("completeness_score") >= 85, "COMPLETE"), (F.col("completeness_score") >= 60, "USABLE")], "PARTIAL")
    return out.withColumn("enrichment_state", state).drop("learnt", "read", "tried"), every
