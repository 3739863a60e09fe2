"""From landed notices to records and evidence, and from a registry to a plan of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import extract as X
from tidemark.functions.rules import first_match, status_of, status_reason, yes
from tidemark.functions.text import canonicalize_url, capacity_mw, collapse, contains_any, content_hash, money, normalize_identity

REQUIRED = ("owner", "agency", "project_code", "registration_deadline", "document_deadline", "bid_deadline")
#: How far each extracted field is trusted.
CONFIDENCE = {
    "project_name": 0.92, "owner": 0.82, "agency": 0.82, "project_code": 0.9, "project_type": 0.78, "budget": 0.82, "qualification_deadline": 0.84, "registration_start": 0.82, "registration_deadline": 0.86,
    "document_start": 0.82, "document_deadline": 0.8, "bid_deadline": 0.86, "open_time": 0.86, "capacity_mw": 0.75, "capacity_mwh": 0.75, "participation_method": 0.65,
}
MARKERS = ("投标截止时间前", "开标前", "截止前下载", "自行下载")


def with_schedules(notices: DataFrame, year: int) -> DataFrame:
    """Adds start, deadline and raw text of each schedule in the column ``_cut``; a lone date with 截止 is a deadline only.

    Step by step, each a projection of its own, so that no text is scanned and no date parsed twice.
    """
    kinds = X.SCHEDULE_LABELS
    out = notices.withColumns({f"_{k}1": X.schedule_window(F.col("_cut"), labels) for k, labels in kinds.items()})
    out = out.withColumns({f"_{k}2": X.dates_in(F.col(f"_{k}1"), year) for k in kinds})
    c, ends = F.col, {}
    for k in kinds:
        window, dates = c(f"_{k}1"), c(f"_{k}2")
        ends |= {
            f"{k}_start": F.when(~X.lone_deadline(window, dates), F.get(dates, F.lit(0))),
            f"{k}_deadline": F.try_element_at(dates, F.lit(-1)),
            f"{k}_raw": F.when(F.size(dates) > 0, collapse(window)),
        }
    return out.withColumns(ends).drop(*[f"_{k}{i}" for k in kinds for i in (1, 2)])


def extract_notices(notices: DataFrame, year: int, now: Column) -> DataFrame:
    """``notices`` (url, title, text) with the fields, the status at ``now`` without a gate, and the required fields missing."""
    text, title = F.coalesce("text", F.lit("")), F.coalesce(collapse(F.col("title")), F.lit(""))
    both, cut = F.concat_ws(" ", title, text), F.col("_cut")
    out = notices.withColumn("_cut", X.cut_at_labels(text)).withColumns(
        {
            "project_name": F.coalesce(X.label_value(cut, X.NAME_LABELS), title),
            "owner": X.label_value(cut, X.OWNER_LABELS),
            "agency": X.label_value(cut, X.AGENCY_LABELS),
            "project_code": X.label_value(cut, X.CODE_LABELS, 100),
            "budget_raw": X.label_value(cut, X.BUDGET_LABELS, 100),
            "participation_method": X.participation_method(text, cut),
            "project_type": X.project_type(both),
            "announcement_type": X.notice_type(title),
            "capacity_mw": capacity_mw(both),
            "capacity_mwh": X.capacity_mwh(both),
        }
    )
    out = with_schedules(out, year)
    out = out.withColumns(
        {
            "budget": money(F.col("budget_raw")),
            "open_time": F.coalesce("open_deadline", "open_start"),
            "project_id": X.stable_project_id(F.col("project_code"), F.col("project_name"), F.col("url")),
            "canonical_name": normalize_identity(F.col("project_name")),
            "canonical_url": canonicalize_url(F.col("url")),
            "content_hash": content_hash(text),
        }
    ).drop("bid_start", "open_start", "open_deadline", "_cut")
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED]))
    reason = status_reason(now, F.lit(False), contains_any(F.col("participation_method"), MARKERS))
    out = out.withColumns({"missing": missing, "reason_code": reason})
    return out.withColumns({"status": status_of(F.col("reason_code")), "needs_review": (F.size("missing") > 0) | (F.col("reason_code") == "UNKNOWN_CONFLICTING_DATES")})


def evidence_of(records: DataFrame) -> DataFrame:
    """project_id, url and, for each field found, its normalised and raw value, surroundings and confidence."""
    raws = {"budget": "budget_raw", "bid_deadline": "bid_raw", "open_time": "open_raw", "qualification_deadline": "qualification_raw"} | {f"{k}_{end}": f"{k}_raw" for k in ("registration", "document") for end in ("start", "deadline")}
    rows = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("normalized_value"), F.coalesce(F.col(raws.get(f, f)).cast("string"), F.col(f).cast("string")).alias("raw_value"), F.lit(c).alias("confidence")) for f, c in CONFIDENCE.items()]
    found = records.select("project_id", "url", "text", F.explode(F.array(*rows)).alias("e")).select("project_id", "url", "text", "e.*").where("normalized_value <> ''")
    at = F.expr("locate(raw_value, text)")
    around = F.when(at > 0, F.substring(F.col("text"), F.greatest(F.lit(1), at - 80), at + 240 - F.greatest(F.lit(1), at - 80))).otherwise(F.substring(F.col("text"), 1, 320))
    return found.withColumn("source_text", around).drop("text")


def source_plan(sources: DataFrame, wanted: Column) -> DataFrame:
    """Sources that a request may use (``wanted``), whether each can run, and why; those that run come first by ``plan_rank``."""
    catalog = (F.upper("adapter_level") == "CATALOG") | (F.col("access_method") == "catalog_discovery")
    idle = ~yes(F.col("crawl_enabled")) | F.col("adapter").isin("configured", "registry_catalog")
    reason = first_match([(~yes(F.col("enabled")), "DISABLED"), (F.col("manual_action").isNotNull(), "MANUAL_ACTION_REQUIRED"), (yes(catalog), "CATALOG_ONLY"), (yes(idle), "ADAPTER_NOT_CONFIGURED")], "READY")
    planned = sources.where(wanted).withColumn("reason", reason).withColumn("selected", F.col("reason") == "READY")
    return planned.withColumn("plan_rank", F.struct(~F.col("selected"), "priority", "source_id"))
