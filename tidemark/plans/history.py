"""Replay with history and projects as candidates, bound to the driver's tables: orders are projects, captured three times; what proves a field comes later for later fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.rules import TIME_FIELDS
from tidemark.functions.text import candidate_id
from tidemark.operators.core import recalculate_status
from tidemark.operators.history import replay
from tidemark.plans.bindings import PROJECTS, evidence, projects
from tidemark.plans.catalog import now, query

CAPTURED = ("1996-01-01 00:00:00", "1997-06-01 00:00:00", "1998-08-01 12:00:00")


def _replay_sql() -> str:
    columns = list(zip(("qs", "qd", "rs", "rd", "ds", "dd", "bid", "opened"), TIME_FIELDS, strict=True))
    seen = lambda i: f"publish_time + to_days({30 * i}) <= now"
    missing = ", ".join(f"CASE WHEN {c} IS NOT NULL AND (NOT {seen(i)} OR ((project_id + {i}) % 61 <> 0 AND (project_id + {i}) % 67 = 0)) THEN '{f}' END" for i, (c, f) in enumerate(columns))
    weak = ", ".join(f"CASE WHEN {c} IS NOT NULL AND {seen(i)} AND (project_id + {i}) % 61 = 0 THEN '{f}' END" for i, (c, f) in enumerate(columns))
    rules = PROJECTS[PROJECTS.index("  SELECT *, CASE") : PROJECTS.index("AS reason_code")]
    return f"""WITH {PROJECTS[: PROJECTS.index("gated AS")].rstrip().rstrip(",")},
snaps AS (SELECT * FROM projects, (SELECT unnest([{", ".join(f"TIMESTAMP '{t}'" for t in CAPTURED)}]) AS now)),
gated AS (SELECT *, list_filter([{missing}, CASE WHEN marker AND publish_time > now THEN 'participation_method' END], lambda x: x IS NOT NULL) AS missing, list_filter([{weak}], lambda x: x IS NOT NULL) AS weak FROM snaps),
reasons AS ({rules} AS reason_code FROM gated),
states AS (SELECT project_id, now AS captured_at, split_part(reason_code, '_', 1) AS status, reason_code, lag(split_part(reason_code, '_', 1)) OVER (PARTITION BY project_id ORDER BY now) AS old_status FROM reasons)
SELECT project_id, captured_at, status, reason_code, old_status, coalesce(old_status <> status, false) AS changed FROM states"""


@query(_replay_sql())
def replayed_history(spark: SparkSession, sf: str) -> DataFrame:
    p = projects(spark, sf)
    at = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in CAPTURED]))
    states = p.select("project_id", at.alias("captured_at"), *TIME_FIELDS, "has_marker")
    place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in TIME_FIELDS]), F.col("field_name")) - 1, F.lit(0))
    days = F.when(place < 0, 0).otherwise(place) * 30
    # dates come with the evidence: a join would broadcast the projects where their compressed file is small
    proofs = evidence(spark, sf, "o_orderdate").select("project_id", "field_name", "strength", (F.col("o_orderdate") + F.make_dt_interval(days.cast("int"))).alias("seen_at"))
    return replay(states, proofs)


@query(f"""WITH {PROJECTS}, judged AS (SELECT *, split_part(reason_code, '_', 1) AS status, substr('ABCDE', CAST(substr(o_orderpriority, 1, 1) AS INT), 1) AS level FROM reasons)
SELECT project_id, 'candidate_' || left(sha256('project:' || project_id), 40) AS candidate_id,
  CASE WHEN reason_code = 'UNKNOWN_CONFLICTING_DATES' THEN 'DATE_CONFLICT' WHEN reason_code = 'UNKNOWN_NEEDS_CODEX_REVIEW' THEN 'SOURCE_INCOMPLETE' WHEN status = 'UNKNOWN' AND coalesce(qd, rd, dd) IS NULL THEN 'MISSING_PARTICIPATION_DEADLINE' WHEN status = 'UNKNOWN' THEN 'SOURCE_INCOMPLETE' WHEN level IN ('D', 'E') THEN 'SECONDARY_ONLY' END AS blocker,
  CASE WHEN level IN ('A', 'B') AND project_id % 4 <> 0 THEN 'OFFICIAL_VERIFIED' WHEN level IN ('A', 'B') THEN 'OFFICIAL_PARTIAL' ELSE 'SECONDARY_ONLY' END AS verification,
  CASE WHEN o_custkey % 100 >= 85 THEN 'COMPLETE' WHEN o_custkey % 100 >= 60 THEN 'USABLE' WHEN o_custkey % 100 >= 30 THEN 'PARTIAL' ELSE 'NEW' END AS state FROM judged""")
def project_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every project as a candidate: its id, what blocks it, who speaks for it, and how complete it is."""
    p = projects(spark, sf).join(recalculate_status(projects(spark, sf), evidence(spark, sf), now()), "project_id")
    level = F.substring(F.lit("ABCDE"), F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(1))
    window = F.coalesce("qualification_deadline", "registration_deadline", "document_deadline").isNotNull()
    return p.select(
        "project_id", candidate_id(F.concat(F.lit("project:"), "project_id")).alias("candidate_id"), rules.project_blocker(F.col("reason_code"), F.col("status"), level, window).alias("blocker"),
        rules.project_verification(level, F.col("project_id") % 4 != 0).alias("verification"), rules.project_state(F.col("o_custkey") % 100).alias("state"),
    )
