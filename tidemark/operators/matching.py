"""Records that are the same project: by codes, or probably by name and signals. Matches are pairs, never all pairs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match, yes
from tidemark.functions.text import normalize_identity
from tidemark.operators.core import fuzzy_pairs

#: The least name ratio, and how near times and capacities of one project are.
RATIO, DAYS, SHARE, LEAST_MW = 85.0, 3, 0.01, 0.1
PLACES = ("province", "city", "county")


def supporting_signals(a: str = "a", b: str = "b") -> Column:
    """How many of owner, place, capacity and publication agree for two records, classes of the aliases ``a`` and ``b``."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = lambda p, q: (normalize_identity(p) != "") & (normalize_identity(p) == normalize_identity(q))
    place = reduce(lambda p, q: p | q, [same(x(c), y(c)) for c in PLACES])
    power = yes(F.abs(x("capacity_mw") - y("capacity_mw")) <= F.greatest(F.lit(LEAST_MW), F.greatest(x("capacity_mw"), y("capacity_mw")) * SHARE))
    near = yes(F.abs(F.timestamp_diff("SECOND", x("publish_time"), y("publish_time"))) <= DAYS * 86_400)
    return reduce(add, [F.when(s, 1).otherwise(0) for s in (same(x("party"), y("party")), place, power, near)])


_SIGNATURE = ("n", "party", *PLACES, "capacity_mw", "publish_time")


def classes(records: DataFrame, key: str = "project_id") -> DataFrame:
    """Each record's id and class: the smallest id of those that no rule of names and signals tells apart, and that class's values."""
    party = F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.col("purchaser"))
    rows = records.select(F.col(key).alias("id"), normalize_identity(F.col("project_name")).alias("n"), party.alias("party"), *PLACES, "capacity_mw", "publish_time")
    least = rows.groupBy(*_SIGNATURE).agg(F.min("id").alias("class_id"))
    return rows.alias("r").join(least.alias("c"), [F.col(f"r.{x}").eqNullSafe(F.col(f"c.{x}")) for x in _SIGNATURE]).select("id", "class_id", *[f"r.{x}" for x in _SIGNATURE])


def _coded(records: DataFrame, key: str, code: str) -> DataFrame:
    return records.select(F.col(key).alias("id"), F.nullif(normalize_identity(F.col(code)), F.lit("")).alias("code")).where("code is not null")


def _by_code(left: DataFrame, right: DataFrame, key: str, code: str, score: float) -> DataFrame:
    """Each left record with the smallest other id of its code: a pair a record, however many share a code."""
    a, b = _coded(left, key, code), _coded(right, key, code)
    first = b.groupBy("code").agg(F.min("id").alias("first"))
    second = b.join(first, "code").where("id > first").groupBy("code").agg(F.min("id").alias("second"))
    other = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    pairs = a.join(first, "code").join(second, "code", "left").select(F.col("id").alias("left_id"), other.alias("right_id")).where("right_id is not null")
    return pairs.select("left_id", "right_id", F.lit("EXACT").alias("outcome"), F.lit(score).alias("score"), F.lit(None).cast("int").alias("signals"))


def match_records(left: DataFrame, right: DataFrame, key: str = "project_id", ratio: float = RATIO) -> DataFrame:
    """(left_id, right_id, outcome, score, signals) of exact and probable matches between two tables of records.

    Equal tender codes score 100, equal project codes 99: each left record meets the smallest other id of its code. Names at the ratio or
    above with a signal are probable: these are pairs of classes (``classes``), each by its smallest id. A pair of equal ids is none.
    """
    sides = [classes(df, key).where("id = class_id").drop("class_id") for df in (left, right)]
    names = sides[0].select("n").unionByName(sides[1].select("n")).where("n <> ''").distinct()
    pairs = fuzzy_pairs(names, "n", ratio)
    alike = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")).unionByName(names.select(F.col("n").alias("a"), F.col("n").alias("b"), F.lit(100.0).alias("ratio")))
    named = sides[0].alias("a").join(alike.alias("p"), F.col("a.n") == F.col("p.a")).join(sides[1].alias("b"), F.col("b.n") == F.col("p.b")).where(F.col("a.id") != F.col("b.id")).withColumn("signals", supporting_signals())
    probable = named.where("signals >= 1").select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.lit("PROBABLE").alias("outcome"), F.col("ratio").alias("score"), "signals")
    found = _by_code(left, right, key, "tender_code", 100.0).unionByName(_by_code(left, right, key, "project_code", 99.0)).unionByName(probable)
    best = F.max(F.struct(F.col("outcome") == "EXACT", "score", "outcome", "signals"))
    return found.groupBy("left_id", "right_id").agg(best.alias("x")).select("left_id", "right_id", "x.outcome", "x.score", "x.signals")


def best_match(matches: DataFrame) -> DataFrame:
    """Of each left record the best match: exact before probable, then the score, then the smaller id."""
    order = F.struct(F.when(F.col("outcome") == "EXACT", 0).otherwise(1), -F.col("score"), "right_id")
    return matches.groupBy("left_id").agg(F.min_by(F.struct("right_id", "outcome", "score"), order).alias("x")).select("left_id", "x.*")


def actions(matches: DataFrame) -> DataFrame:
    """What a match leads to: an exact one moves the record to the other's project, a probable one is a conflict for review."""
    return matches.withColumn("action", first_match([(F.col("outcome") == "EXACT", "MERGE")], "REVIEW_CONFLICT"))
