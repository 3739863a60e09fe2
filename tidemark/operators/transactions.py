"""Runs that write several tables at once, to a store (``sources.store``): batches of projects, and the closure of candidates' documents in stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import TIME_FIELDS, first_match, status_of, status_reason, yes
from tidemark.functions.text import canonicalize_url, contains_any, parse_datetime
from tidemark.operators import runs
from tidemark.operators.core import upsert_evidence
from tidemark.operators.merge import upsert_projects
from tidemark.operators.metrics import WEIGHTS, completeness
from tidemark.operators.notices import CONFIDENCE, MARKERS, evidence_of, extract_notices
from tidemark.sources import html as H
from tidemark.sources.files import landed_texts
from tidemark.sources.store import Change, Snapshot, Store, bucket_of

#: The kinds of a change.
CHANGE_TYPES = ("original", "extension", "clarification", "change", "correction", "supplement")
OVERRIDES = "field_name string, automatic_value string, manual_value string, active boolean"
#: What makes evidence the same, and what it may learn later.
EVIDENCE_KEYS, EVIDENCE_FILL = ("project_id", "field_name", "url", "normalized_value"), ("raw_value", "source_text", "confidence")


def _touched(base: Snapshot, name: str, rows: DataFrame, key: str) -> DataFrame | None:
    """The rows of a table that have a key of ``rows``, from the buckets of these keys only; None if there is no such table."""
    table = base.tables.get(name)
    if table is None:
        return None
    buckets = sorted(r["b"] for r in rows.select(bucket_of([key], table.buckets).alias("b")).distinct().collect())  # at most a row a bucket
    return base.table(name, buckets).join(rows.select(key).distinct(), key, "left_semi")


def commit_projects(store: Store, records: DataFrame, deadlines: Sequence[str], at: Column, kind: str = "change", evidence: DataFrame | None = None, key: str = "project_id") -> Snapshot:
    """Commits a batch of records, one row a ``key``: projects behind their overrides, the automatic values that overrides learn, a row of ``changes`` for each deadline
    that moved, of ``statuses`` for each new status, and evidence. All is seen, or nothing. Only the key ranges of the batch are read and rewritten, histories are appended to.

    The store's tables are projects, overrides (key, field_name, automatic_value, manual_value, active), changes, statuses and evidence. A batch that is committed again adds nothing to the histories.
    """
    if kind not in CHANGE_TYPES:
        raise ValueError(f"{kind} is no kind of a change: {', '.join(CHANGE_TYPES)}")
    spark, kinds = records.sparkSession, dict(records.dtypes)

    def change(base: Snapshot):
        old = _touched(base, "projects", records, key)
        if old is None:
            old = spark.createDataFrame([], records.schema).withColumns({"lifecycle_state": F.lit(None).cast("string"), "last_change_at": F.lit(None).cast("timestamp_ntz")})
        held = _touched(base, "overrides", records, key)
        overrides = held if held is not None else spark.createDataFrame([], f"{key} {kinds[key]}, {OVERRIDES}")
        projects, learnt, changes, statuses = upsert_projects(old, records, overrides, key, deadlines, at, kind)
        out = [Change("projects", projects, (key,)), Change("changes", changes.withColumn("changed_at", at), (key,), "append")]
        if held is not None:
            out.append(Change("overrides", learnt, (key,)))
        if statuses is not None:
            out.append(Change("statuses", statuses.withColumn("changed_at", at), (key,), "append"))
        if evidence is not None:
            seen = _touched(base, "evidence", evidence, key)
            fresh = evidence.select(*EVIDENCE_KEYS, *EVIDENCE_FILL)
            merged = upsert_evidence(seen if seen is not None else fresh.limit(0), fresh, EVIDENCE_KEYS, EVIDENCE_FILL).select(*fresh.columns)
            out.append(Change("evidence", merged, (key,)))
        return out, None

    return store.retried(change)


#: Attachments of one result that are read, in the order of their urls; more are kept as discovered.
MOST_ATTACHMENTS = 10
STAGES = ("snapshots", "attachments", "parses", "evidence", "candidates")
_SUPPORTED = ("pdf", "docx", "xlsx", "zip", "html", "htm", "json", "txt", "xml")


def _new(rows: DataFrame, base: Snapshot, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys, nulls being equal, the table lacks."""
    if table not in base.tables:
        return rows
    held = base.table(table).select(*[F.col(k).alias(f"_{k}") for k in keys])
    return rows.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def closure_run(store: Store, candidates: DataFrame, results: DataFrame, landed: DataFrame, year: int, now: Column, most: int = MOST_ATTACHMENTS, until: str = STAGES[-1]) -> Snapshot:
    """Closes candidates over the documents that their enrichment results lead to, in stages up to ``until``, each committed when it is done.

    ``candidates``: candidate_id, candidate_values, blocker. ``results``: candidate_id, result_id, url. ``landed``: url, content, content_type, error, a row for each url that was fetched: pages and files.
    The stages' tables: ``snapshots`` (the landed page of each result by its content), ``attachments`` (what a page links to, and whether it has landed), ``parses`` (texts by
    content, members of archives apart), ``evidence`` and ``extracted`` (fields found in each candidate's text, and which were looked at), ``facts`` and ``candidates`` (values, score, status, state, blocker).
    A stage skips what its table has by content, so a run that was stopped, or is started again with more landed, does the rest only.
    """
    stages = {"snapshots": _snapshots, "attachments": _attachments, "parses": _parses, "evidence": _evidence, "candidates": _candidates}
    hashed = landed.withColumn("content_hash", F.sha2("content", 256))
    suffix = F.ltrim(H.suffix_of(F.coalesce("content_type", F.lit("")), F.col("url"), names_first=True), F.lit("."))
    files = hashed.withColumn("suffix", F.when(F.lower("content_type").contains("html") | (suffix == ""), "html").otherwise(suffix))
    for name in STAGES[: STAGES.index(until) + 1]:
        store.retried(lambda base, stage=stages[name]: (stage(base, candidates, results, files, year, now, most), None))
    return store.snapshot()


def _snapshots(base: Snapshot, candidates: DataFrame, results: DataFrame, files: DataFrame, year: int, now: Column, most: int) -> list[Change]:
    known = results.join(candidates.select("candidate_id").distinct(), "candidate_id", "left_semi")
    found = known.join(files.select("url", "content_hash", "suffix", "error"), "url").select("candidate_id", "result_id", "url", "content_hash", "suffix", "error").distinct()
    return [Change("snapshots", _new(found, base, "snapshots", found.columns), ("candidate_id",), "append")]


def _attachments(base: Snapshot, candidates: DataFrame, results: DataFrame, files: DataFrame, year: int, now: Column, most: int) -> list[Change]:
    pages = base.table("snapshots").where("suffix in ('html', 'htm') and content_hash is not null").select("content_hash", "url").distinct()
    bodies = pages.join(files.select("content_hash", "content").dropDuplicates(["content_hash"]), "content_hash").withColumn("html", F.decode("content", "UTF-8"))
    keyed = bodies.select(F.struct("content_hash", "url").alias("page"), "url", "html")
    links = H.attachment_links(keyed, "page", "url", "html").select("page.content_hash", F.col("page.url").alias("page_url"), "url", "file_name")
    suffix = F.ltrim(H.suffix_of(F.lit(""), F.coalesce("file_name", "url"), names_first=True), F.lit("."))
    links = links.withColumns({"canonical_url": canonicalize_url(F.col("url")), "named": F.when(suffix.isin(*_SUPPORTED), suffix)})
    place = F.row_number().over(Window.partitionBy("candidate_id", "result_id").orderBy("url"))
    own = base.table("snapshots").select("candidate_id", "result_id", "content_hash", F.col("url").alias("page_url")).join(links.withColumnRenamed("url", "link"), ["content_hash", "page_url"]).drop("content_hash", "page_url").withColumnRenamed("link", "url")
    own = own.withColumn("place", place)
    got = files.select("url", F.col("content_hash").alias("file_hash"), F.col("suffix").alias("landed_as"), F.col("error").alias("fault"))
    state = first_match([(F.col("place") > most, "DISCOVERED"), (F.col("fault").isNotNull(), "FAILED"), (F.col("file_hash").isNotNull(), "DOWNLOADED")], "DISCOVERED")
    rows = own.join(got, "url", "left").withColumn("download_status", state)
    read = F.col("download_status") == "DOWNLOADED"
    rows = rows.select("candidate_id", "canonical_url", "url", "file_name", F.coalesce("named", "landed_as").alias("suffix"), "download_status", F.when(read, F.col("file_hash")).alias("content_hash"), F.col("fault").alias("error"))
    first = rows.groupBy("candidate_id", "canonical_url").agg(F.min(F.struct(F.when(read, 0).otherwise(1).alias("at"), *[c for c in rows.columns if c not in ("candidate_id", "canonical_url")])).alias("x"))
    rows = first.select("candidate_id", "canonical_url", *[f"x.{c}" for c in rows.columns if c not in ("candidate_id", "canonical_url")])
    return [Change("attachments", _new(rows, base, "attachments", ["candidate_id", "canonical_url", "content_hash", "download_status"]), ("candidate_id", "canonical_url"))]


def _documents(base: Snapshot) -> DataFrame:
    """(candidate_id, url, content_hash, suffix) of all that was read for candidates: pages and attachments."""
    pages = base.table("snapshots").where("content_hash is not null and error is null").select("candidate_id", "url", "content_hash", "suffix")
    return pages.unionByName(base.table("attachments").where("content_hash is not null").select("candidate_id", "url", "content_hash", "suffix")).distinct()


def _parses(base: Snapshot, candidates: DataFrame, results: DataFrame, files: DataFrame, year: int, now: Column, most: int) -> list[Change]:
    wanted = _documents(base).groupBy("content_hash").agg(F.min("suffix").alias("suffix"))
    due = _new(wanted, base, "parses", ["content_hash"]).join(files.select("content_hash", "content").dropDuplicates(["content_hash"]), "content_hash")
    read = landed_texts(due)
    page = F.col("suffix").isin("html", "htm") & F.col("text").isNotNull()
    texts = read.withColumns({"title": F.when(page, H.page_title(F.col("text"))), "text": F.when(page, H.main_text(F.col("text"))).otherwise(F.col("text"))})
    return [Change("parses", texts.withColumn("parse_status", F.when(F.col("error").isNull(), "SUCCESS").otherwise("FAILED")), ("content_hash",), "append")]


def _evidence(base: Snapshot, candidates: DataFrame, results: DataFrame, files: DataFrame, year: int, now: Column, most: int) -> list[Change]:
    due = _new(_documents(base).select("candidate_id", "content_hash", "url"), base, "extracted", ["candidate_id", "content_hash", "url"])
    texts = base.table("parses").where("parse_status = 'SUCCESS' and trim(text) <> ''").select("content_hash", "member", "title", "text")
    notices = due.join(texts, "content_hash").withColumn("title", F.coalesce("title", F.lit("")))
    records = extract_notices(notices, year, now)
    ids = records.select(F.struct("candidate_id", "content_hash", "member").alias("project_id"), *[c for c in records.columns if c != "project_id"])
    found = evidence_of(ids).select("project_id.*", "url", "field_name", "normalized_value", "raw_value", "source_text", "confidence")
    return [Change("evidence", found, ("candidate_id",), "append"), Change("extracted", due, ("candidate_id",), "append")]


def _candidates(base: Snapshot, candidates: DataFrame, results: DataFrame, files: DataFrame, year: int, now: Column, most: int) -> list[Change]:
    evidence, attachments = base.table("evidence"), base.table("attachments")
    said = evidence.select("candidate_id", "field_name", F.col("normalized_value").alias("value"))
    facts = runs.facts_added(base.table("facts") if "facts" in base.tables else said.limit(0), said)
    # of several values the most trusted counts, then the least
    best = evidence.groupBy("candidate_id", "field_name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("normalized_value").alias("value")))["value"].alias("value"))
    learnt = best.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("learnt"))  # a field an entry
    states = _documents(base).join(base.table("parses").groupBy("content_hash").agg(F.count_if(F.col("parse_status") == "SUCCESS").alias("good")), "content_hash", "left")
    read = states.groupBy("candidate_id").agg(F.count_if(F.coalesce("good", F.lit(0)) > 0).alias("read"), F.count("*").alias("tried"))
    linked = attachments.where("suffix is not null").groupBy("candidate_id").agg(F.count("*").alias("attachments"), F.count_if(F.col("download_status") == "FAILED").alias("failed"))
    j = candidates.join(learnt, "candidate_id", "left").join(read, "candidate_id", "left").join(linked, "candidate_id", "left")
    none = F.create_map().cast("map<string,string>")
    values = F.map_zip_with(F.coalesce("candidate_values", none), F.coalesce("learnt", none), lambda k, a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    value = lambda n: F.try_element_at("candidate_values", F.lit(n))
    j = j.withColumn("candidate_values", values)
    times = {f: F.coalesce(value(f).try_cast("timestamp_ntz"), parse_datetime(F.nullif(value(f), F.lit("")), year)) for f in TIME_FIELDS}
    timed = j.withColumns(times)
    reason = status_reason(now, F.lit(False), contains_any(F.coalesce(value("participation_method"), F.lit("")), MARKERS))
    score = completeness({n: value(n) for n in WEIGHTS}, yes(F.col("read") > 0), yes(F.col("read") > 0))
    out = timed.withColumns({"reason_code": reason, "completeness_score": score}).drop(*TIME_FIELDS)
    tried, got = F.coalesce("tried", F.lit(0)), F.coalesce("read", F.lit(0))
    blocker = first_match([((tried > 0) & (got == 0), "EXTRACTION_FAILED"), ((tried > 0) & (F.coalesce("attachments", F.lit(0)) == 0), "MISSING_ATTACHMENT"), (F.coalesce("failed", F.lit(0)) > 0, "ATTACHMENT_FAILED")])
    out = out.withColumns({"status": status_of(F.col("reason_code")), "blocker": F.coalesce("blocker", blocker), "documents_read": got.cast("long")})
    state = first_match([((tried > 0) & (got == 0), "BLOCKED"), (F.col("completeness_score") >= 85, "COMPLETE"), (F.col("completeness_score") >= 60, "USABLE")], "PARTIAL")
    out = out.withColumn("enrichment_state", state).drop("learnt", "read", "tried", "attachments", "failed")
    return [Change("facts", facts, ("candidate_id",), "replace"), Change("candidates", out, ("candidate_id",))]


#: The fields that evidence can be of.
FIELDS = tuple(CONFIDENCE)
