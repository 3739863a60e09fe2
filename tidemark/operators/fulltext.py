"""Ranked full-text search over projects: an inverted index that is refreshed for changed projects only.

The index is a store (``sources.store``) with two tables. ``postings`` (token, project_id, segment) has a row for each place of a token; every file holds some
of the texts, sorted by token, so building shuffles nothing, a frequent token is spread over all files, and a search skips the parts of files that its words
aren't in. ``sizes`` (project_id, segment, length) has a project's number of tokens, and tells which segment of it is the newest. A refresh adds a segment
with the new texts of the projects given; what older segments hold of them isn't counted any more. ``compacted`` makes one segment of all.

Texts are never joined: each field and announcement is cut into tokens (runs of letters and digits, lower case) where it is, and a
project's counts are sums. Scores are BM25 over all projects of the index, in whole millionths, so they don't depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.recall import find_projects, present
from tidemark.sources.store import Change, Snapshot, Store

#: The fields that are indexed, and the constants of the ranking.
FIELDS = ("canonical_project_name", "raw_project_name", "project_name", "owner", "agency", "qualification_summary")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"
#: Words of all queries that are looked up in sorted files; more are joined with the whole index. Changed projects that are broadcast to their announcements.
WORDS, BROADCAST = 10_000, 200_000


def _tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def texts_of(projects: DataFrame, announcements: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(project_id, text): a row for each project and field, and for each announcement. Null texts are empty."""
    own = projects.select("project_id", F.explode(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in present(projects, *fields)])).alias("text"))
    return own.unionByName(announcements.select("project_id", F.coalesce("clean_text", F.lit("")).alias("text")))


def postings_of(texts: DataFrame) -> DataFrame:
    """(token, project_id): a row for each place of a token."""
    return texts.select(F.explode(_tokens(F.col("text"))).alias("token"), "project_id")


def _newest(sizes: DataFrame) -> DataFrame:
    best = F.max(F.struct("segment", "length"))
    return sizes.groupBy("project_id").agg(best.alias("x")).select("project_id", "x.segment", "x.length")


def refresh(store: Store, projects: DataFrame, announcements: DataFrame, fields: Sequence[str] = FIELDS, removed: DataFrame | None = None) -> Snapshot:
    """Indexes all the given projects anew, with all their announcements, and forgets the ``removed`` (project_id).

    Work grows with the given projects and, by a number each, with all; the postings of the others aren't read. Projects without a token are in the index
    with length 0. A project given several times is one with the texts of all its rows.
    """

    def change(base: Snapshot):
        segment = base.version + 1
        ids = projects.select("project_id").distinct()
        said = announcements
        if base.version:  # else texts of other projects are without effect, as these have no size
            said = said.join(F.broadcast(ids) if projects.count() <= BROADCAST else ids, "project_id", "left_semi")
        texts = texts_of(projects, said, fields)
        postings = postings_of(texts).withColumn("segment", F.lit(segment))
        lengths = texts.groupBy("project_id").agg(F.sum(F.size(_tokens(F.col("text")))).alias("length")).join(ids, "project_id", "left_semi")
        if removed is not None:
            gone = removed.select("project_id").distinct().join(ids, "project_id", "left_anti")
            lengths = lengths.unionByName(gone.withColumn("length", F.lit(None).cast("long")))
        sizes = lengths.select("project_id", F.lit(segment).alias("segment"), "length")
        return [
            Change("postings", postings, ("token",), "append", ("token", "project_id"), buckets=1, as_dealt=True),
            Change("sizes", sizes, ("project_id",), "append", ("project_id",)),
        ], lambda after: _numbers(after, base.facts.get("first_segment", segment))

    return store.retried(change)


def _numbers(after: Snapshot, first_segment: int) -> dict[str, int]:
    """Projects and tokens of the index, which the ranking needs, and projects that were refreshed since its first segment."""
    live = _newest(after.table("sizes")).where("length is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    fresh = after.table("sizes").where(F.col("segment") > first_segment).count()
    return {"first_segment": first_segment, "projects": live["n"], "tokens": live["tokens"], "refreshed": fresh}


def _live(index: Snapshot) -> DataFrame:
    """The newest (project_id, segment, length) of each project of the index."""
    sizes = index.table("sizes")
    return (_newest(sizes) if index.facts["refreshed"] else sizes).where("length is not null")


def compacted(store: Store) -> Snapshot:
    """The same index with one segment."""
    index = store.snapshot()
    segment = index.version + 1
    postings = index.table("postings").join(_live(index), ["project_id", "segment"], "left_semi").select("token", "project_id", F.lit(segment).alias("segment"))
    sizes = _live(index).select("project_id", F.lit(segment).alias("segment"), "length")
    return store.commit(
        index,
        [Change("postings", postings, ("token",), "replace", ("token", "project_id"), buckets=1, as_dealt=True), Change("sizes", sizes, ("project_id",), "replace", ("project_id",))],
        lambda after: _numbers(after, segment),
    )


def rank(index: Snapshot, queries: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, place, project_id, score): for each of ``queries`` (query_id, query) the best projects that have all its words, ties by id.

    A query without a word finds nothing; a word that it repeats counts once.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(_tokens(F.coalesce("query", F.lit(""))))).alias("token"))
    needed = words.groupBy("query_id").agg(F.count("*").alias("needed"))
    looked_up = words.select("token").distinct()
    some = [r["token"] for r in looked_up.limit(WORDS + 1).collect()]
    few = len(some) <= WORDS
    postings = index.table("postings")
    places = postings.where(F.col("token").isin(some)) if few else postings.join(looked_up, "token", "left_semi")
    counted = places.groupBy("project_id", "segment", "token").agg(F.count("*").alias("tf"))
    hits = counted.join(_live(index), ["project_id", "segment"])
    n, mean = index.facts["projects"], index.facts["tokens"] / max(1, index.facts["projects"])
    frequency = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = words.join(frequency, "token").select("query_id", "token", idf.alias("idf"))
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0)))
    scored = hits.join(weighed, "token").select("query_id", "project_id", F.round(gain * 1_000_000).cast("long").alias("gain"))
    found = scored.groupBy("query_id", "project_id").agg(F.sum("gain").alias("score"), F.count("*").alias("n")).join(F.broadcast(needed) if few else needed, "query_id").where("n = needed")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "project_id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("query_id", "place", "project_id", (F.col("score") / 1_000_000).alias("score"))


def search(index: Snapshot | None, projects: DataFrame, text: str, most: int = 50) -> DataFrame:
    """(project_id, place, score) of the best projects of the index that have all words of a text, or, if there are none or no index, of
    the first projects by id that hold every part of the text in a field, whatever its case, without a score. A blank text finds nothing.
    """
    spark = projects.sparkSession
    kind = dict(projects.dtypes)["project_id"]
    if index is not None and index.version and text.strip():
        found = rank(index, spark.createDataFrame([(0, text)], "query_id int, query string"), most).select("project_id", "place", "score").collect()  # at most ``most`` rows
        if found:
            return spark.createDataFrame(found, f"project_id {kind}, place int, score double")
    scanned = find_projects(projects, text, most)
    return scanned.select("project_id", F.row_number().over(Window.orderBy("project_id")).alias("place"), F.lit(None).cast("double").alias("score"))
