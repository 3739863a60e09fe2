"""Upserts and merges: each builds the new state of a table from the old one and what has landed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match, yes

IDENTITY_FIELDS = ("project_name", "project_code", "tender_code", "owner", "agency", "project_location")
# Best first.
RELEVANCE = ("DIRECT", "EMBEDDED", "STRUCTURAL_RELATED", "ADJACENT", "PARENT_PROJECT", "POSSIBLE", "IRRELEVANT")
IDENTITY = ("RESOLVED", "PARTIAL", "AMBIGUOUS")
LEVELS = ("A", "B", "C", "D", "E")


def _best(a: Column, b: Column, order: Sequence[str]) -> Column:
    """The one that comes first in ``order``; unknown values and nulls come last."""
    rank = lambda c: F.when(c.isNull(), len(order) + 1).otherwise(first_match([(c == v, i) for i, v in enumerate(order)], len(order)))
    return F.when(rank(b) < rank(a), b).otherwise(F.coalesce(a, b))


def merged_values(old: Column, new: Column, ambiguous: Column) -> Column:
    """The later value of each key that isn't blank; identity fields keep the earlier one if the newcomer is ambiguous."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.map_zip_with(
        F.coalesce(old, F.create_map().cast("map<string,string>")),
        F.coalesce(new, F.create_map().cast("map<string,string>")),
        lambda k, a, b: F.when(~filled(b) | (filled(a) & ambiguous & k.isin(*IDENTITY_FIELDS)), a).otherwise(b),
    )


def upsert_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates after a batch of search results with one row a ``candidate_key``.

    Facts accumulate; level, relevance and identity keep the best seen; ``official_found`` never falls back. Only new
    content starts enrichment anew. Columns: candidate_key, candidate_values (map), source_level, relevance_class,
    identity_status, identity_confidence, official_found, content_hash, enrichment_state, first_seen_at, last_seen_at, last_change_at.
    """
    j = old.alias("o").join(new.alias("n"), "candidate_key", "full")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    fresh, absent = o("first_seen_at").isNull(), n("last_seen_at").isNull()
    changed = ~absent & ~fresh & ~o("content_hash").eqNullSafe(n("content_hash"))
    return j.select(
        "candidate_key",
        merged_values(o("candidate_values"), n("candidate_values"), yes(n("identity_status") == "AMBIGUOUS")).alias("candidate_values"),
        _best(o("source_level"), n("source_level"), LEVELS).alias("source_level"),
        _best(o("relevance_class"), n("relevance_class"), RELEVANCE).alias("relevance_class"),
        _best(o("identity_status"), n("identity_status"), IDENTITY).alias("identity_status"),
        F.greatest(o("identity_confidence"), n("identity_confidence")).alias("identity_confidence"),
        (yes(o("official_found")) | yes(n("official_found"))).alias("official_found"),
        F.when(absent, o("content_hash")).otherwise(n("content_hash")).alias("content_hash"),
        F.when(fresh | changed, F.when(n("identity_status") == "AMBIGUOUS", "AMBIGUOUS").otherwise("PARTIAL")).otherwise(o("enrichment_state")).alias("enrichment_state"),
        F.coalesce(o("first_seen_at"), n("first_seen_at"), n("last_seen_at")).alias("first_seen_at"),
        F.greatest(o("last_seen_at"), n("last_seen_at")).alias("last_seen_at"),
        F.when(fresh | changed, n("last_seen_at")).otherwise(o("last_change_at")).alias("last_change_at"),
    )


def linked_sources(links: DataFrame) -> DataFrame:
    """One row for each candidate and canonical url: flags joined by or, the best level, the first and last time seen."""
    return links.groupBy("candidate_id", "canonical_url").agg(
        F.bool_or("is_official").alias("is_official"), F.bool_or("is_secondary").alias("is_secondary"), F.min("source_level").alias("source_level"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    )


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys, compared with nulls equal, it lacks; of equal new keys one row stays."""
    match = [old[k].eqNullSafe(new[k]) for k in keys]
    first = new.join(old, match, "left_anti").groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("_r")) if len(keys) < len(new.columns) else new.join(old, match, "left_anti").distinct()
    rows = first.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in new.columns])
    return old.unionByName(rows)


def merge_projects(projects: DataFrame, members: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each canonical id of ``members`` (key, canonical_id): the survivor's values, its empty ones filled from the others in ``order``."""
    joined = projects.join(members, key)
    place = F.struct((F.col(key) != F.col("canonical_id")).alias("other"), *order, key)
    full = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    # a struct of place and value has its least place where the value is set
    pick = [F.min(F.when(full(c), F.struct(place.alias("p"), F.col(c).alias("v"))))["v"].alias(c) for c in projects.columns if c != key]
    return joined.groupBy(F.col("canonical_id").alias(key)).agg(*pick, F.count("*").alias("n_merged"))


def repoint(children: DataFrame, members: DataFrame, key: str, unique: Sequence[str] = ()) -> DataFrame:
    """Child rows under their project's canonical id; with ``unique``, equal rows of a merged project become one, values filled."""
    moved = children.join(members, key, "left").withColumn(key, F.coalesce("canonical_id", key)).select(*children.columns)
    if not unique:
        return moved
    rest = [c for c in children.columns if c not in (key, *unique)]
    return moved.groupBy(key, *unique).agg(*[F.min(F.when(F.col(c).cast("string") != "", F.col(c))).alias(c) for c in rest]).select(*children.columns) if rest else moved.distinct()


def effective_values(automatic: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``automatic`` values behind manual ones: of each key the last override event counts, unless it clears (null ``manual_value``)."""
    last = overrides.groupBy(*keys).agg(F.max(F.struct("changed_at", "manual_value"))["manual_value"].alias("manual_value"))
    return automatic.join(last, [*keys], "left").withColumn("effective", F.coalesce("manual_value", "value"))


def project_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field_name, old_value, new_value for each field that differs between two states of a table."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"o.{f}").cast("string").alias("old_value"), F.col(f"n.{f}").cast("string").alias("new_value")) for f in fields])
    differs = F.filter(pairs, lambda x: ~x.old_value.eqNullSafe(x.new_value))
    return old.alias("o").join(new.alias("n"), key).select(key, F.explode(differs).alias("x")).select(key, "x.*")


#: Columns whose change isn't a change of the project.
BOOKKEEPING = ("lifecycle_state", "last_change_at", "last_seen_at", "status_evaluated_at")


def upsert_projects(old: DataFrame, new: DataFrame, overrides: DataFrame, key: str, deadlines: Sequence[str], at: Column, kind: str = "change") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(projects, overrides, changes, statuses) after a batch of records with one row a ``key``.

    Fields with an active override keep their value, and the override learns the new automatic one; other fields take the record's, also where it is
    null. ``changes``: a row for each deadline that moved; ``statuses``: one for each new status. ``old`` has the columns of ``new`` and lifecycle_state, last_change_at.
    """
    fields = [c for c in new.columns if c != key]
    held = overrides.where("active").groupBy(key).agg(F.collect_set("field_name").alias("_held"))
    j = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full").join(held, key, "left")
    o, n, fresh, landed = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}")), F.col("o.lifecycle_state").isNull(), yes(F.col("_new"))
    kept = lambda c: yes(F.array_contains("_held", c))
    value = lambda c: F.when(~landed | (kept(c) & ~fresh), o(c)).otherwise(n(c))
    changed = F.lit(False)
    for c in fields:
        if c not in BOOKKEEPING:
            changed = changed | ~o(c).eqNullSafe(value(c))
    reopened = yes((o("status") == "CLOSED") & (value("status") == "OPEN")) if "status" in fields else F.lit(False)
    state = first_match([(~landed, o("lifecycle_state")), (fresh, "NEW"), (reopened, "REOPENED"), (changed, "UPDATED")], "UNCHANGED")
    touched = landed & (fresh | changed)
    projects = j.select(key, *[value(c).alias(c) for c in fields], state.alias("lifecycle_state"), F.when(touched, at).otherwise(o("last_change_at")).alias("last_change_at"))
    both = j.where(landed & ~fresh)
    moved = F.array(*[F.struct(F.lit(c).alias("field_name"), o(c).cast("string").alias("old_value"), n(c).cast("string").alias("new_value"), kept(c).alias("held")) for c in deadlines])
    changes = both.select(key, F.explode(F.filter(moved, lambda x: ~x.held & ~x.old_value.eqNullSafe(x.new_value))).alias("x")).select(key, F.lit(kind).alias("change_type"), "x.field_name", "x.old_value", "x.new_value")
    statuses = j.where(landed & ~o("status").eqNullSafe(value("status"))).select(key, o("status").alias("old_status"), value("status").alias("new_status")) if "status" in fields else None
    said = F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c).cast("string") for c in fields]))
    learnt = overrides.join(new.select(key, said.alias("_said")), key, "left")
    automatic = F.when(F.col("active") & F.col("_said").isNotNull() & F.map_contains_key("_said", F.col("field_name")), F.try_element_at("_said", F.col("field_name"))).otherwise(F.col("automatic_value"))
    return projects, learnt.withColumn("automatic_value", automatic).select(*overrides.columns), changes, statuses
