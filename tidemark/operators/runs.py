"""Steps of extraction, review, verification and crawling runs, each from tables to new tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import TIME_FIELDS, first_match, status_of, status_reason, yes
from tidemark.functions.text import contains_any, normalize_identity, parse_datetime
from tidemark.operators.merge import insert_if_absent

#: Fields that a correction may not set, states of a review, kinds of changes.
DERIVED = ("status", "status_reason", "status_evaluated_at", "lifecycle_state")
REVIEW_STATES = ("PENDING", "RESOLVED", "SKIPPED")
CHANGE_KINDS = ("original", "extension", "clarification", "correction", "supplement", "change")
SNAPSHOT_FIELDS = ("registration_deadline", "document_deadline", "bid_deadline", "open_time")
MANUAL = ("LOGIN_REQUIRED", "LOGIN_EXPIRED", "CAPTCHA", "VERIFICATION_REQUIRED")
#: Words of errors that need a person.
CAPTCHA_WORDS = ("验证码", "captcha")
LOGIN_WORDS = ("请登录", "登录后", "login required", "sign in", "session expired")
CHALLENGE_WORDS = ("412", "challenge", "verify you are human", "人机验证", "安全验证")
#: The event that each kind of notice makes.
EVENTS = {"extension": "DEADLINE_CHANGED", "change": "DEADLINE_CHANGED", "correction": "CLARIFICATION_PUBLISHED", "clarification": "CLARIFICATION_PUBLISHED", "supplement": "CLARIFICATION_PUBLISHED"}


def health_reason(message: Column, status: Column, given: Column | None = None, manual: Column | None = None) -> Column:
    """Why a source's run failed, from its error. ``given``: a reason that the error names; ``manual``: the action that it asks for."""
    none = F.lit(None).cast("string")
    given, manual = given if given is not None else none, manual if manual is not None else none
    http = status.isNotNull()
    return first_match(
        [
            (given.isNotNull(), given),
            (contains_any(message, CAPTCHA_WORDS), "CAPTCHA"),
            (manual.isNotNull(), manual),
            (http & (status.isin(403, 429) | contains_any(message, ["rate"])), "RATE_LIMITED"),
            (http, "HTTP_ERROR"),
            (contains_any(message, ("selector", "解析", "json")), "PARSER_ERROR"),
        ],
        "HTTP_ERROR",
    )


def manual_action(reason: Column, action: Column) -> Column:
    """Struct of the action that a person must take and its state; nulls where none is needed."""
    kind = F.coalesce(action, F.when(reason.isin(*MANUAL), reason))
    return F.struct(kind.alias("action"), F.when(kind.isNotNull(), "PENDING_USER").alias("state"))


def configured_action(requires_login: Column, status: Column, notes: Column) -> Column:
    """What a source's configuration says a person must do; null if nothing."""
    return first_match(
        [
            (yes(requires_login), "LOGIN_REQUIRED"),
            (~yes(status == "NEEDS_ATTENTION"), F.lit(None).cast("string")),
            (contains_any(notes, ("captcha", "验证码", "人机")), "CAPTCHA"),
            (contains_any(notes, ("login", "登录")), "LOGIN_REQUIRED"),
        ],
        "VERIFICATION_REQUIRED",
    )


def provider_action(message: Column, status: Column) -> Column:
    """What a search provider's error asks of a person; null if nothing."""
    return first_match([(contains_any(message, CAPTCHA_WORDS), "CAPTCHA"), (contains_any(message, LOGIN_WORDS), "LOGIN_REQUIRED"), (yes(status == 412) | contains_any(message, CHALLENGE_WORDS), "VERIFICATION_REQUIRED")])


def timeline_type(kind: Column) -> Column:
    """The event of a notice of a kind (``change_type``)."""
    return first_match([(kind == k, v) for k, v in EVENTS.items()], "ANNOUNCEMENT_PUBLISHED")


def coerced(field: Column, value: Column, year: int) -> Column:
    """A corrected value as its field spells it: a time, a number without separators, or the text; null for blanks and what can't be read."""
    text = F.nullif(F.trim(value), F.lit(""))
    return (
        F.when(field.isin("publish_time", *TIME_FIELDS), F.date_format(parse_datetime(text, year), "yyyy-MM-dd HH:mm:ss"))
        .when(field.isin("capacity_mw", "capacity_mwh"), text.try_cast("double").cast("string"))
        .when(field == "budget", F.regexp_replace(text, ",", "").try_cast("decimal(18,2)").cast("string"))
        .otherwise(text)
    )


def merged_extractions(base: DataFrame, supplement: DataFrame, fields: Sequence[str], required: Sequence[str], now: Column) -> DataFrame:
    """Records of a notice with their empty fields filled from its attachments (the first by ``document_id``), the better quality, and the status and gaps that follow.

    Both: notice_id, quality, the fields, and for ``supplement`` document_id.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    pick = [F.min(F.when(~blank(f), F.struct("document_id", f)))[f].alias(f"_{f}") for f in fields]
    more = supplement.groupBy("notice_id").agg(*pick, F.max("quality").alias("_quality"), F.count("*").alias("_n"))
    j = base.join(more, "notice_id", "left")
    out = j.withColumns({**{f: F.when(blank(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}, "quality": F.greatest("quality", "_quality"), "merged_documents": F.coalesce("_n", F.lit(0))})
    out = out.drop(*[f"_{f}" for f in fields], "_quality", "_n")
    reason = status_reason(now, F.lit(False), yes(F.col("has_marker")) if "has_marker" in base.columns else F.lit(False))
    missing = F.array_compact(F.array(*[F.when(blank(f), F.lit(f)) for f in required]))
    out = out.withColumns({"reason_code": reason, "missing": missing})
    return out.withColumns({"status": status_of(F.col("reason_code")), "needs_review": (F.size("missing") > 0) | (F.col("reason_code") == "UNKNOWN_CONFLICTING_DATES")})


def merged_evidence(base: DataFrame, supplement: DataFrame) -> DataFrame:
    """Evidence of merged notices: all of a notice's own, and all of its attachments', whose ``document_id`` it keeps (null: the notice's own). Attachments of other notices add nothing."""
    more = supplement.join(base.select("notice_id").distinct(), "notice_id", "left_semi")
    return base.withColumn("document_id", F.lit(None).cast(dict(supplement.dtypes)["document_id"])).unionByName(more)


def merged_reasons(base: Column, supplement: Column) -> Column:
    """Reasons for review of a merged notice: its own, then those of its attachments that are new."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(base, none), F.coalesce(supplement, none)))


def cached(announcements: DataFrame, parses: DataFrame, attachments: DataFrame, version: str, parser: str) -> DataFrame:
    """id of announcements that needn't be extracted again: extracted by this version, the body parsed by this parser with the same content, and every supported local attachment too.

    ``announcements``: id, content_hash, snapshot_hash, extraction_status, extraction_version. ``parses``: announcement_id, attachment_id, content_hash, source_file,
    parser_version, parse_status. ``attachments``: id, announcement_id, content_hash, local_path.
    """
    good = parses.where((F.col("parser_version") == parser) & (F.col("parse_status") == "SUCCESS"))
    done = announcements.where((F.col("extraction_status") == "SUCCESS") & (F.col("extraction_version") == version) & F.coalesce(F.col("content_hash") == F.col("snapshot_hash"), F.lit(True)))
    bodies = good.where("attachment_id is null and content_hash is not null").select(F.col("announcement_id").alias("id"), F.col("content_hash").alias("parsed"))
    body = done.join(bodies, "id").where(F.coalesce(F.col("parsed") == F.col("snapshot_hash"), F.lit(True))).select("id").distinct()
    local = attachments.where(F.lower("local_path").rlike(r"\.(pdf|docx|xlsx|html?|json|txt)$")).select(F.col("id").alias("attachment_id"), "announcement_id", F.col("content_hash").alias("bytes"), "local_path")
    seen = good.where("attachment_id is not null").select("announcement_id", "attachment_id", F.col("content_hash").alias("parsed"), "source_file")
    match = F.when(F.col("bytes").isNotNull(), F.col("bytes") == F.col("parsed")).otherwise(F.col("local_path") == F.col("source_file"))
    stale = local.join(seen.where("parsed is not null or source_file is not null"), ["announcement_id", "attachment_id"], "left").groupBy("announcement_id", "attachment_id").agg(F.bool_or(yes(match)).alias("ok")).where("not ok")
    return body.join(stale.select(F.col("announcement_id").alias("id")), "id", "left_anti")


def review_items(old: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """The review queue after a run. ``found``: project_id, announcement_id, reasons, priority, content_hash; rows without reasons only clear a project's flag.

    An item is one of a project and announcement; new content opens it again. ``old`` has review_id, status, resolution, resolved_at, created_at beside these.
    """
    key = lambda a, b: F.col(f"{a}.project_id").eqNullSafe(F.col(f"{b}.project_id")) & F.col(f"{a}.announcement_id").eqNullSafe(F.col(f"{b}.announcement_id"))
    fresh = found.where(F.size("reasons") > 0)
    j = old.alias("o").join(fresh.alias("n"), key("o", "n"), "full")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    absent, touched = o("review_id").isNull(), n("reasons").isNotNull()
    changed = ~absent & touched & ~o("content_hash").eqNullSafe(n("content_hash"))
    project, note = F.coalesce(o("project_id"), n("project_id")), F.coalesce(o("announcement_id"), n("announcement_id"))
    made = F.substring(F.sha2(F.concat_ws("\x1f", project.cast("string"), F.coalesce(note.cast("string"), F.lit(""))), 256), 1, 32)
    return j.select(
        F.coalesce(o("review_id"), made).alias("review_id"), project.alias("project_id"), note.alias("announcement_id"), F.when(touched, F.get(n("reasons"), F.lit(0))).otherwise(o("reason")).alias("reason"),
        F.when(touched, n("priority")).otherwise(o("priority")).alias("priority"), F.when(touched, n("content_hash")).otherwise(o("content_hash")).alias("content_hash"),
        F.when(absent | changed, "PENDING").otherwise(o("status")).alias("status"), F.when(changed, "CONTENT_CHANGED_REQUIRES_REVIEW").otherwise(o("resolution")).alias("resolution"),
        F.when(~changed, o("resolved_at")).alias("resolved_at"), F.coalesce(o("created_at"), now).alias("created_at"),
    )


def resolve_reviews(items: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Items after decisions (review_id, decision, note). Unknown states are an error; a pending one has no time of resolution."""
    j = items.join(decisions, "review_id", "left")
    decided = F.col("decision").isNotNull()
    checked = F.when(~decided | F.col("decision").isin(*REVIEW_STATES), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("unknown review state: "), F.col("decision"))).cast("string"))
    return j.withColumn("_d", checked).select(
        *[c for c in items.columns if c not in ("status", "resolution", "resolved_at")], F.coalesce("_d", "status").alias("status"), F.when(decided, F.col("note")).otherwise(F.col("resolution")).alias("resolution"),
        F.when(decided, F.when(F.col("_d") != "PENDING", now)).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def latest_review(items: DataFrame) -> DataFrame:
    """The newest item of each project and announcement, nulls being equal."""
    rest = [c for c in items.columns if c not in ("project_id", "announcement_id")]
    newest = F.max(F.struct("created_at", *[c for c in rest if c != "created_at"])).alias("x")
    return items.groupBy("project_id", "announcement_id").agg(newest).select("project_id", "announcement_id", *[F.col("x")[c].alias(c) for c in rest])


def corrections(overrides: DataFrame, asked: DataFrame, conflicts: DataFrame, year: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overrides, evidence, conflicts) after corrections that carry their proof. ``asked``: project_id, field_name, value, evidence_text, source_url.

    Derived fields, and corrections without text or url, are an error. Earlier overrides of the field end, and its open conflicts are resolved.
    """
    c = F.col
    wrong = c("field_name").isin(*DERIVED) | (F.coalesce(F.trim("evidence_text"), F.lit("")) == "") | (F.coalesce(F.trim("source_url"), F.lit("")) == "")
    valid = asked.withColumn("value", F.when(wrong, F.raise_error(F.concat(F.lit("a correction needs a fact, a text and a url: "), c("field_name"))).cast("string")).otherwise(coerced(c("field_name"), c("value"), year)))
    one = valid.groupBy("project_id", "field_name").agg(F.max(F.struct("value", "evidence_text", "source_url")).alias("x")).select("project_id", "field_name", "x.*")
    keys = ["project_id", "field_name"]
    ended = overrides.join(one.select(*keys, F.lit(True).alias("_hit")), keys, "left").withColumn("active", c("active") & ~yes(c("_hit"))).drop("_hit")
    first = overrides.groupBy(*keys).agg(F.min_by("automatic_value", "changed_at").alias("automatic_value"))
    fresh = one.join(first, keys, "left").select(*keys, "automatic_value", c("value").alias("manual_value"), now.alias("changed_at"), F.lit(True).alias("active"))
    proof = one.select(*keys, c("value").alias("normalized_value"), F.trim("evidence_text").alias("source_text"), "source_url", F.lit("CODEX_REVIEW").alias("extractor_type"), F.lit(1.0).alias("confidence"))
    settled = conflicts.join(one.select(*keys, F.lit(True).alias("_hit")), keys, "left").withColumn("resolution_status", F.when(yes(c("_hit")) & (c("resolution_status") == "PENDING"), "RESOLVED").otherwise(c("resolution_status"))).drop("_hit")
    return ended.unionByName(fresh.select(*overrides.columns)), proof, settled


def cleared(overrides: DataFrame, keys: DataFrame) -> DataFrame:
    """Overrides of the given project_id and field_name end; the automatic value is what counts then."""
    return overrides.join(keys.select("project_id", "field_name", F.lit(True).alias("_hit")), ["project_id", "field_name"], "left").withColumn("active", F.col("active") & ~yes(F.col("_hit"))).drop("_hit")


def history(old: DataFrame, events: DataFrame, kind: str = "change_type") -> DataFrame:
    """A history with events appended; an unknown kind of change is an error."""
    checked = F.when(F.col(kind).isin(*CHANGE_KINDS), F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null")))).cast("string"))
    return old.unionByName(events.withColumn(kind, checked))


def timeline_events(old: DataFrame, announcements: DataFrame, records: DataFrame, evidence: DataFrame) -> DataFrame:
    """One event an announcement, new ones replacing old: its kind, time, title, the record's deadlines as JSON and the ids of its evidence in order.

    ``announcements``: id, project_id, kind, published_at, title. ``records``: project_id and the deadlines. ``evidence``: id, announcement_id.
    """
    ids = evidence.groupBy(F.col("announcement_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("evidence_ids"))
    deadlines = records.select("project_id", F.to_json(F.struct(*SNAPSHOT_FIELDS)).alias("deadlines"))
    new = announcements.join(deadlines, "project_id", "left").join(ids, "id", "left").select(
        F.col("id").alias("announcement_id"), "project_id", timeline_type(F.col("kind")).alias("event_type"), F.col("published_at").alias("event_at"), "title", "deadlines", F.coalesce("evidence_ids", F.array().cast("array<bigint>")).alias("evidence_ids")
    )
    j = old.select("announcement_id", F.col("event_at").alias("_at")).join(new, "announcement_id", "right").withColumn("event_at", F.coalesce("event_at", "_at")).drop("_at")
    return old.join(new.select("announcement_id"), "announcement_id", "left_anti").unionByName(j.select(*old.columns), allowMissingColumns=True)


def merged_notes(old: Column, new: Column) -> Column:
    """Two JSON objects as one, later keys winning; a note that is no object becomes the ``snippet``."""
    kind = "map<string,string>"
    plain = lambda c: F.map_from_entries(F.array(F.struct(F.lit("snippet"), c))).cast(kind)
    read = lambda c: F.coalesce(F.from_json(F.when(F.startswith(F.trim(c), F.lit("{")), c), kind), F.when(F.coalesce(F.trim(c), F.lit("")) != "", plain(c)), F.create_map().cast(kind))
    return F.to_json(F.map_zip_with(read(old), read(new), lambda k, a, b: F.coalesce(b, a)))


def discovered(old: DataFrame, results: DataFrame, known: DataFrame, at: Column) -> DataFrame:
    """Discovered urls after a batch of results (source_url, domain, is_candidate): each once, refreshed if seen again; domains with three projects that aren't known are recommended.

    ``old``: source_url, domain, projects_found, first_seen_at, last_seen_at. ``known``: domain.
    """
    new = results.groupBy("source_url").agg(F.min("domain").alias("domain"), F.max(F.when(F.col("is_candidate"), 1).otherwise(0)).alias("projects_found"), F.lit(None).cast("timestamp_ntz").alias("first_seen_at"), F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    one = both.groupBy("source_url").agg(
        F.coalesce(F.min(F.when(F.col("_old") == 1, F.col("domain"))), F.min("domain")).alias("domain"), F.max("projects_found").alias("projects_found"), F.min("first_seen_at").alias("_first"), F.max(F.when(F.col("_old") == 1, F.col("last_seen_at"))).alias("_last"), F.min("_old").alias("_m")
    )
    seen = one.select("source_url", "domain", "projects_found", F.coalesce("_first", at).alias("first_seen_at"), F.when(F.col("_m") == 0, at).otherwise(F.col("_last")).alias("last_seen_at"))
    totals = seen.where("domain is not null").groupBy("domain").agg(F.sum("projects_found").alias("total")).where("total >= 3").join(known, "domain", "left_anti").select("domain", F.lit("RECOMMENDED_NEW_SOURCE").alias("status"))
    return seen.join(totals, "domain", "left").withColumn("status", F.coalesce("status", F.lit("DISCOVERED")))


def document_parses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parses after a run: one of an announcement, attachment, candidate and content, nulls being equal, the new one in place of the old; a success if there is text or no error."""
    keys = ["announcement_id", "attachment_id", "candidate_id", "content_hash"]
    state = F.when((F.coalesce(F.trim("text"), F.lit("")) != "") | F.col("error").isNull(), "SUCCESS").otherwise("FAILED")
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("parse_status", state).select(*old.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("x")).select(*[F.col(c) if c in keys else F.col("x")[c].alias(c) for c in old.columns])


def latest_parse(evidence: DataFrame, parses: DataFrame) -> DataFrame:
    """Evidence with the newest parse of its announcement and file, or, without a file, of the announcement's body."""
    of = parses.groupBy("announcement_id", F.when(F.col("attachment_id").isNotNull(), F.col("source_file")).alias("file")).agg(F.max("document_id").alias("document_id"))
    return evidence.alias("e").join(of.alias("d"), (F.col("e.announcement_id") == F.col("d.announcement_id")) & F.col("e.source_file").eqNullSafe(F.col("d.file")), "left").select("e.*", F.col("d.document_id").alias("document_id"))


def seeded_sources(old: DataFrame, configured: DataFrame) -> DataFrame:
    """Sources with what the configuration says; columns that runs keep stay as they were, and sources no longer configured stay whole."""
    j = old.alias("o").join(configured.withColumn("_c", F.lit(True)).alias("n"), "source_id", "full")
    pick = lambda c: F.when(yes(F.col("_c")), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in configured.columns else F.col(f"o.{c}")
    return j.select("source_id", *[pick(c).alias(c) for c in old.columns if c != "source_id"])


def verification_run(tasks: DataFrame, index: DataFrame, most_results: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tasks, results): each task's queries asked of an index; a result once for task, url and query; a task with a failed query is completed with errors.

    ``tasks``: task_id, project_id, queries. ``index``: query_text, place, url, title, error.
    """
    asked = tasks.select("task_id", "project_id", F.explode(F.array_distinct("queries")).alias("query_text"))
    hits = asked.join(index.where(F.col("place") <= most_results), "query_text")
    found = hits.where("error is null").groupBy("task_id", "project_id", "query_text", "url").agg(F.min("title").alias("title")).withColumn("confidence", F.lit(0.5))
    n, bad = found.groupBy("task_id").agg(F.count("*").alias("n")), hits.where("error is not null").groupBy("task_id").agg(F.count("*").alias("bad"))
    done = tasks.join(n, "task_id", "left").join(bad, "task_id", "left").select("task_id", "project_id", F.coalesce("n", F.lit(0)).alias("result_count"), F.when(F.col("bad") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED").alias("status"))
    return done, found


def verification_evidence(results: DataFrame) -> DataFrame:
    """What a verification found, as weak evidence of a project: a row for each url."""
    return results.groupBy("project_id", "url").agg(F.min("title").alias("raw_value")).select("project_id", F.lit("verification_candidate").alias("field_name"), F.col("url").alias("normalized_value"), F.col("url").alias("source_url"), "raw_value", F.lit(0.5).alias("confidence"))


def verification_tasks(pending: DataFrame, projects: DataFrame) -> DataFrame:
    """Tasks after a run: one for each project and reason that has none pending or running. ``pending``: project_id, reason, status; ``projects``: project_id, reasons."""
    open_ = pending.where("status in ('PENDING', 'RUNNING')").select("project_id", "reason")
    wanted = projects.select("project_id", F.explode(F.array_distinct("reasons")).alias("reason")).join(open_, ["project_id", "reason"], "left_anti")
    return pending.unionByName(wanted.withColumn("status", F.lit("PENDING")))


def verification_order(projects: DataFrame, most: int) -> DataFrame:
    """The unknown projects with reasons that are verified next, the latest changed first."""
    return projects.where((F.col("status") == "UNKNOWN") & (F.size("reasons") > 0)).orderBy(F.col("updated_at").desc_nulls_last(), "project_id").limit(most)


def facts_added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of candidates, each once for its field and its value without white space and case."""
    key = F.lower(F.regexp_replace(F.coalesce("value", F.lit("")), r"(?U)\s+", ""))
    keyed = [df.withColumn("_k", key) for df in (old, new.where(F.coalesce(F.trim("value"), F.lit("")) != ""))]
    return insert_if_absent(keyed[0], keyed[1], ["candidate_id", "field_name", "_k"]).drop("_k")


def merged_codes(projects: DataFrame, key: str = "project_id", codes: Sequence[str] = ("tender_code", "project_code")) -> DataFrame:
    """(key, canonical_id): projects tied by equal codes of any kind, in the end under the smallest id; a chain of codes is one project.

    Ids go to the least that shares a code, in rounds until nothing moves; each round is one aggregation and one join for each code.
    """
    ids = projects.select(F.col(key).alias("id"), *[F.nullif(normalize_identity(F.col(c)), F.lit("")).alias(c) for c in codes])
    held = ids.withColumn("root", F.col("id"))
    from tidemark.operators.enrich import cut

    while True:
        step = held
        for c in codes:
            least = step.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("root").alias("_least"))
            step = step.join(least, c, "left").withColumn("root", F.least("root", "_least")).drop("_least")
        # a root's own root, so that chains shorten
        up = step.select(F.col("id").alias("root"), F.col("root").alias("_up"))
        step = cut(step.join(up, "root", "left").withColumn("root", F.coalesce("_up", "root")).select("id", *codes, "root"))
        moved = step.join(held.select("id", F.col("root").alias("_was")), "id").where("root <> _was").limit(1).count()
        held = step
        if not moved:
            return held.select(F.col("id").alias(key), F.col("root").alias("canonical_id"))


def rotation(df: DataFrame, order: str, day: int) -> DataFrame:
    """Rows with their place when the order is turned by the day. A table of configuration."""
    n = max(1, df.count())
    return df.withColumn("place", F.pmod(F.row_number().over(Window.orderBy(order)) - 1 - F.lit(day % n), F.lit(n)))
