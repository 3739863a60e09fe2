"""Relational operators. Each is one declarative plan; no operator collects rows to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import DEADLINES, TIME_FIELDS, WEAK, gate_fields, status_of, status_reason
from tidemark.functions.text import BITS, common_by_bits, indel_ratio, normalize_identity, places_of
from tidemark.sources.store import saved


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order`` (nulls last), by one partial aggregation instead of a window."""
    best = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("best")[v].alias(v) for v in values])


def first_seen(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The smallest ``order`` of each key and the number of rows."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("n_seen"))


def gate_evidence(evidence: DataFrame) -> DataFrame:
    """project_id and the best strength of each time field and of the participation text, one row a project."""
    fields = [*TIME_FIELDS, "participation"]
    return evidence.groupBy("project_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("strength"))).alias(f"{f}_evidence") for f in fields])


def with_gate(projects: DataFrame, evidence: DataFrame) -> DataFrame:
    """Projects with ``missing`` and ``weak``: the populated time fields that lack evidence, or have weak evidence only."""
    joined = projects.join(gate_evidence(evidence), "project_id", "left")
    return joined.withColumns({"missing": gate_fields(None, F.col("has_marker")), "weak": gate_fields(WEAK)})


def recalculate_status(projects: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """project_id, status, reason_code at ``now`` behind the evidence gate."""
    gated = with_gate(projects, evidence)
    blocked = (F.size("missing") > 0) | (F.size("weak") > 0)
    reason = status_reason(now, blocked, F.col("has_marker"))
    return gated.withColumn("reason_code", reason).select("project_id", status_of(F.col("reason_code")).alias("status"), "reason_code")


def in_window(projects: DataFrame, announcements: DataFrame, low: Column, high: Column) -> DataFrame:
    """Projects without any date, or published, or announced, in the window. Announcements in it are first reduced to keys."""
    stats = announcements.groupBy("project_id").agg(F.bool_or(F.col("published_at").between(low, high)).alias("hit"), F.count("published_at").alias("dated"))
    joined = projects.join(stats, "project_id", "left")
    undated = F.col("publish_time").isNull() & (F.coalesce("dated", F.lit(0)) == 0)
    return joined.where(undated | F.coalesce(F.col("publish_time").between(low, high), F.lit(False)) | F.coalesce("hit", F.lit(False))).drop("hit", "dated")


def previous(df: DataFrame, key: str, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Adds the former value of columns in each key's order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({name: F.lag(c).over(w) for name, c in columns.items()})


def code_groups(df: DataFrame, row_id: str, code: Column) -> DataFrame:
    """row_id, canonical_id: the smallest id with an equal normalised code; rows without a code stand alone."""
    coded = df.select(row_id, F.nullif(normalize_identity(code), F.lit("")).alias("code"))
    least = coded.where("code is not null").groupBy("code").agg(F.min(row_id).alias("canonical_id"))
    return coded.join(least, "code", "left").select(row_id, F.coalesce("canonical_id", row_id).alias("canonical_id"))


#: Names that share a segment beyond which they must share another to meet.
HOT = 16


def _edits(shorter: Column, longer: Column, threshold: float) -> Column:
    """The most insertions and deletions between names of two lengths with a ratio at the threshold."""
    return F.floor((shorter + longer) * ((100.0 - threshold) / 100.0) + 1e-9).cast("int")


def _cut(low: Column, high: Column, pieces: Column, first: int | Column = 0) -> Column:
    """(at, begin, end) of ``pieces`` about equal pieces of a stretch, numbered from ``first``; none for none."""
    of = lambda i: (low + F.floor(i * (high - low) / pieces)).cast("int")
    made = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct((i + first).cast("int").alias("at"), of(i).alias("begin"), of(i + 1).alias("end")))
    return F.when(pieces > 0, made).otherwise(F.array().cast("array<struct<at:int,begin:int,end:int>>"))


def _rest(size: Column, pieces: Column, segment: Column) -> Column:
    """The pieces of what a segment leaves to its left and right, in proportion; a single empty one if there are more pieces than characters."""
    left, right = segment["begin"], size - segment["end"]
    share = F.round(pieces * left / F.greatest(left + right, F.lit(1))).cast("int")
    share = F.least(F.greatest(share, F.when(left > 0, 1).otherwise(0), pieces - right), left, pieces)
    both = F.concat(_cut(F.lit(0), left, share), _cut(segment["end"], size, pieces - share, share))
    return F.when(left + right >= pieces, both).otherwise(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("begin"), F.lit(0).alias("end"))))


def _shared_segments(norm: DataFrame, threshold: float) -> DataFrame:
    """(a, b): names that may reach the threshold, the first of a pair being the shorter one.

    At the threshold at most ``_edits`` characters are inserted or deleted, so of that many segments and one more of the shorter name one is in the longer name
    as it is, moved by what was inserted and deleted before it. Names meet by hash at (length, number of segments, segment, text). Where more than ``HOT`` shorter
    names have a segment, those that meet there must share a piece of the rest of the name too, which is cut in the same way.
    """
    t = min(threshold, 100.0)
    size = F.length("n")
    pieces = lambda ls, ll: _edits(ls, ll, t) + 1
    longest, shortest = F.floor(size * ((200.0 - t) / t) + 1e-9).cast("int"), F.ceil(size * (t / (200.0 - t)) - 1e-9).cast("int")
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("begin"), F.lit(0).alias("end")))
    segments = lambda ls, m: F.when(m <= ls, _cut(F.lit(0), ls, m)).otherwise(whole)
    text = lambda n, begin, end: F.substring(n, begin + 1, end - begin)

    cut = norm.select("n", size.alias("ls"), F.explode(F.array_distinct(F.transform(F.sequence(size, longest), lambda ll: pieces(size, ll)))).alias("m"))
    held = cut.select(F.col("n").alias("a"), "ls", "m", F.explode(segments(F.col("ls"), F.col("m"))).alias("s")).withColumn("text", text(F.col("a"), F.col("s.begin"), F.col("s.end")))

    other = norm.select("n", size.alias("ll"), F.explode(F.sequence(F.greatest(shortest, F.lit(1)), size)).alias("ls"))
    other = other.withColumns({"m": pieces(F.col("ls"), F.col("ll")), "more": F.col("ll") - F.col("ls")}).where("m - 1 >= more")
    other = other.withColumns({"lost": F.floor((F.col("m") - 1 - F.col("more")) / 2).cast("int"), "won": F.floor((F.col("m") - 1 + F.col("more")) / 2).cast("int")})
    other = other.withColumn("s", F.explode(segments(F.col("ls"), F.col("m"))))
    moved = F.explode(F.when(F.col("s.at") < 0, F.array(F.lit(0))).otherwise(F.sequence(-F.col("lost"), F.col("won"))))
    other = other.select(F.col("n").alias("b"), "ll", "ls", "m", "lost", "won", "s", moved.alias("move")).where("s.begin + move >= 0 and s.end + move <= ll")
    other = other.withColumn("text", text(F.col("b"), F.col("s.begin") + F.col("move"), F.col("s.end") + F.col("move")))

    key = ["ls", "m", "s", "text"]
    hot = held.groupBy(*key).agg(F.count("*").alias("names")).where(F.col("names") > HOT).select(*key)
    few = held.join(hot, key, "left_anti").join(other, key).select("a", "b", "ll", "ls")
    rest = F.explode(_rest(F.col("ls"), F.col("m"), F.col("s"))).alias("r")
    held2 = held.join(hot, key, "left_semi").select("a", *key, rest).withColumn("also", text(F.col("a"), F.col("r.begin"), F.col("r.end")))
    moved2 = F.explode(F.when(F.col("r.at") < 0, F.array(F.lit(0))).otherwise(F.sequence(-F.col("lost"), F.col("won"))))
    other2 = other.join(hot, key, "left_semi").select("*", rest).select("*", moved2.alias("move2"))
    # what is left of the segment stays left of it
    begin, end = F.col("r.begin") + F.col("move2"), F.col("r.end") + F.col("move2")
    beside = F.when(F.col("r.end") <= F.col("s.begin"), (begin >= 0) & (end <= F.col("s.begin") + F.col("move"))).otherwise((begin >= F.col("s.end") + F.col("move")) & (end <= F.col("ll")))
    other2 = other2.where((F.col("r.at") < 0) | beside).withColumn("also", text(F.col("b"), begin, end)).select("b", "ll", *key, "r", "also")
    many = held2.join(other2, [*key, "r", "also"]).select("a", "b", "ll", "ls")
    return few.unionByName(many).where("ls < ll or a < b").select("a", "b").distinct()


def fuzzy_pairs(names: DataFrame, name: str, threshold: float = 85.0) -> DataFrame:
    """(a, b, ratio): all distinct normalised names with a ratio at the threshold (over 0) or above, a before b.

    Names that share a segment (``_shared_segments``) are compared by their letters, whose common number is a bound, and then by their longest common subsequence.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    norm = names.select(normalize_identity(F.col(name)).alias("n")).where("n <> ''").distinct()
    chars = F.filter(F.split("n", ""), lambda c: c != "")
    counted = F.map_from_entries(F.transform(F.array_distinct("chars"), lambda c: F.struct(c.alias("key"), F.size(F.filter("chars", lambda x: x == c)).alias("value"))))
    short = F.length("n") <= BITS
    # what a comparison needs of a name is worked out once for it, not for each pair
    known = saved(norm.select("n", chars.alias("chars")).select("n", "chars", counted.alias("letters"), F.when(short, places_of(F.col("chars"))).alias("places")), "names")
    met = _shared_segments(known.select("n"), threshold).join(known.select(F.col("n").alias("a"), F.col("letters").alias("x"), "places"), "a").join(known.select(F.col("n").alias("b"), F.col("letters").alias("y"), F.col("chars").alias("of_b")), "b")
    common = F.aggregate(F.map_entries("x"), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.try_element_at("y", e["key"]), F.lit(0))))
    near = met.where(200.0 * common >= threshold * (F.length("a") + F.length("b")))
    by_bits = 200.0 * common_by_bits(F.col("of_b"), F.col("places"), F.length("a")) / (F.length("a") + F.length("b"))
    ratio = F.when(F.col("places").isNotNull(), by_bits).otherwise(indel_ratio(F.col("a"), F.col("b")))
    good = near.withColumn("ratio", ratio).where(F.col("ratio") >= threshold)
    return good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ratio")


def conflicts(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with two or more distinct trimmed values."""
    v = F.trim(value)
    return values.where(v != "").groupBy(*keys).agg(F.count_distinct(v).alias("n_values"), F.array_join(F.array_sort(F.collect_set(v)), "|").alias("found")).where("n_values >= 2")


def unchanged_suppressed(rows: DataFrame, reports: DataFrame, key: str, changed: Column) -> DataFrame:
    """Rows never reported, or changed since their last report (``changed`` may use ``reported_at``)."""
    last = reports.groupBy(key).agg(F.max("reported_at").alias("reported_at"))
    return rows.join(last, key, "left").where(F.col("reported_at").isNull() | changed)


def upsert_evidence(old: DataFrame, new: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Idempotent merge by a null-safe natural key: old locators stay, empty ones are filled. One aggregation, which groups nulls together."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # the old value if there is one, else the least of the new ones
    pick = lambda c: F.coalesce(F.min(F.when(F.col("_new") == 0, F.col(c))), F.min(F.when(F.col("_new") == 1, F.col(c)))).alias(c)
    return both.groupBy(*keys).agg(*[pick(c) for c in fill], F.min("_new").alias("inserted"))


def zero_filled_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each value, with its count or 0. One aggregation of all counts, no join."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values])).alias("x")).select("x.*")


def next_deadline() -> Column:
    """The earliest of the five deadlines that are set."""
    return F.least(*[F.col(f) for f in DEADLINES])


