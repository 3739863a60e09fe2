"""What a request recalls and delivers: one plan from projects, announcements and evidence to the rows that a user sees.

Recall doesn't gate by status, source level or missing dates; delivery does. Every step is a filter, an aggregation by
project, or a join by project, so the plan has one shuffle for each table that is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import DEADLINES, STRONG, first_match, relevance, status_of, status_reason, yes
from tidemark.functions.text import bind, collapse, level_rank, matched_terms, normalize_identity
from tidemark.operators.core import next_deadline, with_gate
from tidemark.operators.places import region_passes

#: The fields that a request's terms are looked for in, beside the newest announcement's text.
SEARCHED = (
    "project_name", "raw_project_name", "owner", "purchaser", "tenderer", "agency", "industry", "project_type", "project_scale", "project_code", "tender_code",
    "qualification_summary", "participation_method", "project_location", "tenderer_location", "agency_location", "source_location", "location",
)
NATIONWIDE = ("全国", "全国性", "全网")
EXCLUDED = "EXCLUDED:"


@dataclass(frozen=True)
class Criteria:
    """A request, ready for a plan. ``low`` and ``high``: timestamps; ``labels``: names of the places selected by code; ``profile_labels``: those of a profile."""

    low: str
    high: str
    province: str = ""
    city: str = ""
    county: str = ""
    labels: tuple[str, ...] = ()
    profile_labels: tuple[str, ...] = ()
    announcement_types: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    exact: bool = False
    only_open: bool = False
    delta: bool = False
    source_level: str = "E"
    relevance: Callable[[Column], Column] = field(default=relevance, compare=False)


def present(df: DataFrame, *names: str) -> list[Column]:
    """The named columns that a table has; a table needn't have them all."""
    return [F.col(n) for n in names if n in df.columns]


def search_text(projects: DataFrame, extra: Column | None = None) -> Column:
    """A project's searched fields and the text of its newest announcement, in lower case."""
    return F.lower(F.concat_ws(" ", *[collapse(c) for c in present(projects, *SEARCHED)], *([collapse(extra)] if extra is not None else [])))


def _place_text(df: DataFrame) -> Column:
    return normalize_identity(F.concat_ws(" ", *present(df, "province", "city", "county", "project_location", "location")))


def _any_label(text: Column, labels: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, normalize_identity(F.lit(x))) for x in labels])


def region_condition(df: DataFrame, c: Criteria) -> Column:
    """The requested place, or the places of codes, or those of a profile, fit a project. A project without any place fits, unless exactly searched."""
    wanted = {"province": c.province, "city": c.city, "county": c.county}
    if "".join(wanted.values()) in NATIONWIDE:
        return F.lit(True)
    if any(wanted.values()):
        levels = {n: (F.col(n) if n in df.columns else F.lit("")) for n in wanted}
        return reduce(and_, [region_passes(F.lit(w), levels[n], F.concat_ws(" ", *present(df, "province", "city", "county", "project_location", "location")), c.exact) for n, w in wanted.items() if w])
    fits = lambda labels: bind(_place_text(df), lambda t: F.when(t == "", not c.exact).otherwise(_any_label(t, labels)))
    return reduce(and_, [fits(labels) for labels in (c.labels, c.profile_labels) if labels], F.lit(True))


def announced(announcements: DataFrame, low: Column, high: Column) -> DataFrame:
    """project_id, its newest announcement, whether one lies in the window, and how many are dated: one aggregation."""
    values = [c for c in announcements.columns if c not in ("project_id", "published_at", "id")]
    return announcements.groupBy("project_id").agg(
        F.max(F.struct("published_at", "id", *values)).alias("newest"), F.bool_or(F.col("published_at").between(low, high)).alias("in_window"), F.count("published_at").alias("dated")
    )


def recall(projects: DataFrame, announcements: DataFrame, evidence: DataFrame, c: Criteria, now: Column, prior: DataFrame | None = None) -> DataFrame:
    """The recall pool: ``projects`` with announcement_id, matched (terms, and marks of excluded ones), relevance_class, status and reason_code.

    ``prior``: candidates (project_id, relevance_class, updated_at); the newest of a project keeps it though nothing matches now.
    """
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (c.low, c.high))
    kept = projects.where(~yes(F.col("ignored")) if "ignored" in projects.columns else F.lit(True)).where(region_condition(projects, c))
    joined = kept.join(announced(announcements, low, high), "project_id", "left")
    undated = F.col("publish_time").isNull() & (F.coalesce("dated", F.lit(0)) == 0)
    joined = joined.where(undated | yes(F.col("publish_time").between(low, high)) | yes(F.col("in_window")))
    newest = set(announcements.columns)
    if c.announcement_types:
        own = present(projects, "announcement_type")
        kind = F.coalesce(*([F.col("newest.announcement_type")] if "announcement_type" in newest else []), *own, F.lit(""))
        joined = joined.where(_any_label(normalize_identity(kind), c.announcement_types))
    if prior is not None:
        seen = prior.where("project_id is not null").groupBy("project_id").agg(F.max(F.struct("updated_at", "relevance_class"))["relevance_class"].alias("prior_class"))
        joined = joined.join(seen, "project_id", "left")
    else:
        joined = joined.withColumn("prior_class", F.lit(None).cast("string"))
    read = joined.withColumn("haystack", search_text(projects, F.col("newest.clean_text") if "clean_text" in newest else None))
    read = read.withColumns({"found": matched_terms(F.col("haystack"), c.terms), "relevance_class": c.relevance(F.col("haystack")), "marks": F.transform(matched_terms(F.col("haystack"), c.excluded), lambda t: F.concat(F.lit(EXCLUDED), t))})
    hit, relevant = F.size("found") > 0, F.col("relevance_class") != "IRRELEVANT"
    before = yes(F.col("prior_class") != "IRRELEVANT")
    gate = relevant if not c.terms else hit if c.exact else hit | relevant | before
    pool = read.where(gate).withColumns({"matched": F.concat("found", "marks"), "announcement_id": F.col("newest.id")}).drop("haystack", "found", "marks", "newest", "in_window", "dated", "prior_class")
    gated = with_gate(pool, evidence)
    reason = status_reason(now, (F.size("missing") > 0) | (F.size("weak") > 0), F.col("has_marker"))
    return gated.withColumn("reason_code", reason).withColumn("status", status_of(F.col("reason_code"))).select(*pool.columns, "status", "reason_code")


def evidence_with_overrides(evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Evidence (project_id, field_name, strength) and that of active manual values, which is strong."""
    manual = overrides.where("active and manual_value is not null").select("project_id", "field_name", F.lit(STRONG).alias("strength"))
    return evidence.select("project_id", "field_name", "strength").unionByName(manual)


def last_reports(sessions: DataFrame, links: DataFrame, scope_key: str, current: object) -> DataFrame:
    """project_id, reported_at, status_at_search and announcement ids of each project's last delivery within the same scope.

    ``sessions``: session_id, scope_key, status, started_at, finished_at. Of deliveries at the same time the first session by id gives the status, all give announcements.
    """
    done = sessions.where(F.col("status").isin("COMPLETED", "PARTIAL") & (F.col("scope_key") == scope_key) & (F.col("session_id") != current))
    done = done.select("session_id", F.coalesce("finished_at", "started_at").alias("reported_at")).where("reported_at is not null")
    rows = links.join(done, "session_id")
    # all of a project's reports are one small group: it is delivered once a session
    at = rows.groupBy("project_id").agg(F.max("reported_at").alias("reported_at"))
    last = rows.join(at, ["project_id", "reported_at"])
    return last.groupBy("project_id", "reported_at").agg(F.min(F.struct("session_id", "status_at_search"))["status_at_search"].alias("status_at_search"), F.collect_set("announcement_id").alias("announcement_ids"))


def unchanged(pool: DataFrame, reports: DataFrame, sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """project_id of rows that were reported and haven't changed since: no change time, status, announcement, source or manual value is newer."""
    linked = sources.groupBy("project_id").agg(F.max("first_seen_at").alias("last_link"))
    manual = overrides.groupBy("project_id").agg(F.max("changed_at").alias("last_override"))
    j = pool.join(reports, "project_id").join(linked, "project_id", "left").join(manual, "project_id", "left")
    at = F.col("reported_at")
    changed = reduce(or_, [yes(x) for x in (
        F.col("last_change_at") > at, F.col("status") != F.col("status_at_search"), F.col("announcement_id").isNotNull() & ~F.array_contains("announcement_ids", F.col("announcement_id")),
        F.col("last_link") > at, F.col("last_override") > at,
    )])
    return j.where(~changed).select("project_id")


def deliver(pool: DataFrame, c: Criteria, suppressed: DataFrame | None = None) -> DataFrame:
    """The rows of the pool that are shown: of a source level at least as good, open ones only if asked, none excluded, none suppressed."""
    shown = pool.where((level_rank(F.upper("source_level")) <= level_rank(F.lit(c.source_level))) & ~F.exists("matched", lambda m: F.startswith(m, F.lit(EXCLUDED))))
    if c.only_open:
        shown = shown.where("status = 'OPEN'")
    return shown.join(suppressed, "project_id", "left_anti") if c.delta and suppressed is not None else shown


def delivered_candidates(candidates: DataFrame, started_at: Column, delta: bool) -> DataFrame:
    """Candidates without a project, which are delivered on their own; in a delta only those first seen or changed since the session began."""
    lone = candidates.where("project_id is null")
    return lone.where(yes(F.col("first_seen_at") >= started_at) | yes(F.col("last_change_at") >= started_at)) if delta else lone


def compact(pool: DataFrame, links: DataFrame, sources: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """Result rows: the pool with its sources, evidence, next deadline and what follows from them.

    ``links``: project_id, source_id, source_url. ``evidence``: id, project_id, field_name, strength.
    """
    named = links.join(sources.select("source_id", "source_name", "base_url"), "source_id", "left")
    of = named.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "source_name", F.coalesce("source_url", "base_url").alias("source_url")))).alias("sources"))
    critical = F.when(F.col("field_name").isin(*DEADLINES) & (F.col("strength") == STRONG), F.col("field_name"))
    proof = evidence.groupBy("project_id").agg(F.array_sort(F.collect_list("id")).alias("evidence_ids"), F.array_sort(F.collect_set(critical)).alias("critical_evidence_fields"))
    j = pool.join(of, "project_id", "left").join(proof, "project_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    own = F.col("source_url") if "source_url" in pool.columns else F.lit(None).cast("string")
    lifecycle = F.col("lifecycle_state") if "lifecycle_state" in pool.columns else F.lit(None).cast("string")
    j = j.withColumns({"sources": none(F.col("sources"), "array<struct<source_id:string,source_name:string,source_url:string>>"), "evidence_ids": none(F.col("evidence_ids"), dict(proof.dtypes)["evidence_ids"]), "critical_evidence_fields": none(F.col("critical_evidence_fields"), "array<string>"), "next_deadline": next_deadline()})
    hours = F.timestamp_diff("SECOND", now, F.col("next_deadline")) / 3600
    return j.withColumns(
        {
            "remaining_hours": F.round(hours, 2),
            "source_count": F.when(F.size("sources") > 0, F.size("sources")).when(own.isNotNull(), 1).otherwise(0),
            "best_source_url": F.coalesce(F.get("sources", F.lit(0)).source_url, own),
            "matched_region": F.concat_ws(" / ", *present(pool, "province", "city", "county")),
            **{f"is_{x.lower()}": yes(lifecycle == x) for x in ("NEW", "UPDATED", "REOPENED")},
        }
    )


def candidate_values(projects: DataFrame) -> Column:
    """A project's facts as a candidate keeps them: of several fields the first that is set."""
    has = lambda *names: present(projects, *names) or [F.lit(None).cast("string")]
    place = F.nullif(F.concat_ws(" / ", *present(projects, "province", "city", "county")), F.lit(""))
    facts = {
        "owner": has("owner", "purchaser", "tenderer"), "project_location": [*present(projects, "project_location", "location"), place], "scope": has("project_scale", "project_type", "industry"), "source": has("source_url"),
        **{n: has(n) for n in ("project_name", "project_code", "tender_code", "agency", "publish_time", "document_deadline", "bid_deadline", "open_time", "participation_method")},
    }
    return F.map_filter(F.create_map(*[x for n, cs in facts.items() for x in (F.lit(n), F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs]))]), lambda k, v: v.isNotNull())


def presentation_order() -> list[Column]:
    """Open first, then by the next deadline, the better source, the newer and the more complete; the id makes it total."""
    rank = first_match([(F.col("status") == s, i) for i, s in enumerate(("OPEN", "UNKNOWN", "CLOSED"))], 9)
    return [rank, next_deadline().asc_nulls_last(), level_rank(F.upper("source_level")), F.col("publish_time").desc_nulls_last(), F.col("completeness_score").desc_nulls_last(), F.col("project_id")]


def pool_order() -> list[Column]:
    return [F.col("rank_score").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("candidate_id")]


def queue_order() -> list[Column]:
    """Candidates in the order in which they are enriched."""
    return [F.col("review_priority").asc_nulls_last(), F.col("rank_score").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("candidate_id")]


def session_rows(session_id: str, links: DataFrame, projects: DataFrame, announcements: DataFrame, open_only: bool = True, skip_ignored: bool = True) -> DataFrame:
    """A session's rows as it saw them: project, announcement and the status at the time."""
    own = links.where(F.col("session_id") == session_id).select("project_id", F.col("announcement_id").alias("link_announcement"), "status_at_search")
    own = own.where("status_at_search = 'OPEN'") if open_only else own.where("status_at_search in ('OPEN', 'UNKNOWN')")
    kept = projects.where(~yes(F.col("ignored"))) if skip_ignored and "ignored" in projects.columns else projects
    notes = announcements.select(F.col("id").alias("link_announcement"), F.col("title").alias("announcement_title"), F.col("published_at"))
    return own.join(kept, "project_id").join(notes, "link_announcement", "left").withColumnRenamed("link_announcement", "announcement_id")


#: The fields that a typed query is looked for in.
TYPED = ("project_name", "raw_project_name", "owner", "agency", "qualification_summary")


def find_projects(projects: DataFrame, text: str, most: int = 50, fields: Sequence[str] = TYPED) -> DataFrame:
    """The first projects, by id, that hold every word of a text in one of the fields, whatever its case; none for a blank text."""
    words = text.lower().split()
    if not words:
        return projects.limit(0)
    columns = [F.lower(F.coalesce(c, F.lit(""))) for c in present(projects, *fields)]
    return projects.where(reduce(and_, [reduce(or_, [F.contains(c, F.lit(w)) for c in columns]) for w in words])).orderBy("project_id").limit(most)


def with_texts(projects: DataFrame, announcements: DataFrame) -> DataFrame:
    """Every project with the texts of its announcements, in their order, as one."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("published_at", "id", "clean_text"))), lambda x: x.clean_text), " ")
    return projects.join(announcements.groupBy("project_id").agg(texts.alias("announced_text")), "project_id", "left").withColumn("announced_text", F.coalesce("announced_text", F.lit("")))
