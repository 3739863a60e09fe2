"""Replay with history: the status of a project at each of its snapshots, behind the evidence known by then, and the transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import TIME_FIELDS, WEAK, gate_fields, status_of, status_reason

FIELDS = (*TIME_FIELDS, "participation")


def replay(snapshots: DataFrame, evidence: DataFrame) -> DataFrame:
    """project_id, captured_at, status, reason_code, old_status, changed: of every snapshot, with the one before of its project.

    ``snapshots``: project_id, captured_at, the time fields and has_marker as they were then. ``evidence``: project_id, field_name, strength, seen_at. At a snapshot the best strength
    of each field seen up to it counts, and its time is "now": a point-in-time join, by one window over both in the order of time. ``changed`` is false for the first snapshot.
    Snapshots of equal time are in the order of their reason codes. Evidence without a time was always there; a snapshot without a time comes before all others and knows only such evidence.
    """
    kinds = dict(snapshots.dtypes)
    strength = dict(evidence.dtypes)["strength"]
    states = snapshots.select("project_id", F.col("captured_at").alias("at"), F.lit(1).alias("is_state"), F.struct(*TIME_FIELDS, "has_marker").alias("state"), F.lit(None).cast("string").alias("field_name"), F.lit(None).cast(strength).alias("strength"))
    shape = "struct<" + ",".join(f"{f}:{kinds[f]}" for f in (*TIME_FIELDS, "has_marker")) + ">"
    proofs = evidence.select("project_id", F.col("seen_at").alias("at"), F.lit(0).alias("is_state"), F.lit(None).cast(shape).alias("state"), "field_name", "strength")
    so_far = Window.partitionBy("project_id").orderBy(F.col("at").asc_nulls_first(), "is_state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = [F.max(F.when(F.col("field_name") == f, F.col("strength"))).over(so_far).alias(f"{f}_evidence") for f in FIELDS]
    at = states.unionByName(proofs).select("project_id", "at", "is_state", "state", *known).where("is_state = 1").select("project_id", "at", "state.*", *[f"{f}_evidence" for f in FIELDS])
    blocked = (F.size(gate_fields(None, F.col("has_marker"))) > 0) | (F.size(gate_fields(WEAK)) > 0)
    judged = at.select("project_id", F.col("at").alias("captured_at"), status_reason(F.col("at"), blocked, F.col("has_marker")).alias("reason_code"))
    judged = judged.withColumn("status", status_of(F.col("reason_code")))
    before = F.lag("status").over(Window.partitionBy("project_id").orderBy(F.col("captured_at").asc_nulls_first(), "reason_code"))
    out = judged.withColumn("old_status", before)
    return out.select("project_id", "captured_at", "status", "reason_code", "old_status", F.coalesce(F.col("old_status") != F.col("status"), F.lit(False)).alias("changed"))


def transitions(history: DataFrame) -> DataFrame:
    """project_id, changed_at, old_status, new_status of each change of a replayed history; the first status isn't one."""
    return history.where("changed").select("project_id", F.col("captured_at").alias("changed_at"), "old_status", F.col("status").alias("new_status"))
