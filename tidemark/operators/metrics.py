"""Measures of a run: quality, coverage, recall, completeness, confidence and samples for review. Each is one aggregation or two."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import pieces
from tidemark.functions.rules import first_match, yes
from tidemark.functions.text import normalize_identity
from tidemark.sources.store import saved

#: What each fact adds to completeness, and what attachments and evidence add.
WEIGHTS = {
    "project_name": 15, "project_code": 5, "tender_code": 5, "owner": 10, "project_location": 10, "scope": 10, "publish_time": 5, "document_deadline": 10,
    "bid_deadline": 10, "open_time": 5, "participation_method": 5, "source": 5,
}
ATTACHED, PROVEN = 3, 2
#: How far a source's level, and a code, are trusted; the shares of field, source and match in the whole.
SOURCE_TRUST, OTHER_TRUST = {"A": 1.0, "B": 0.85, "C": 0.7, "D": 0.45, "E": 0.25}, 0.4
CODED, UNCODED = 1.0, 0.65
BLEND = (0.55, 0.3, 0.15)
OFFICIAL = ("OFFICIAL_VERIFIED", "OFFICIAL_PARTIAL", "MULTI_SOURCE_CONFIRMED")
BLOCKING = ("CAPTCHA", "LOGIN_REQUIRED", "VERIFICATION_REQUIRED", "HTTP_412", "HTTP_419", "HTTP_403", "HTTP_429")
SAMPLE_TAGS = ("OPEN", "UNKNOWN", "CLOSED", "PDF", "CHANGE", "MULTI_SOURCE", "SECONDARY_SOURCE")


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def completeness(values: Mapping[str, Column], attached: Column, proven: Column) -> Column:
    """0 to 100: the weights of the facts that are set, and of attachments and evidence."""
    score = sum((F.when(filled(values[n]), w).otherwise(0) for n, w in WEIGHTS.items() if n in values), F.lit(0))
    return F.least(F.lit(100), score + F.when(yes(attached), ATTACHED).otherwise(0) + F.when(yes(proven), PROVEN).otherwise(0))


def key_fields_share(fields: Sequence[Column]) -> Column:
    """Percentage of the fields that are set."""
    return F.round(sum((F.when(filled(f), 1).otherwise(0) for f in fields), F.lit(0)) * 100 / float(len(fields)), 2)


def confidences(projects: DataFrame, evidence: DataFrame) -> DataFrame:
    """project_id with the confidence of fields (the mean of its evidence), source, match, and the whole of them."""
    field = evidence.groupBy("project_id").agg(F.round(F.avg("confidence"), 4).alias("field_confidence"))
    level = F.upper("source_level")
    source = first_match([(level == k, v) for k, v in SOURCE_TRUST.items()], OTHER_TRUST)
    match = F.when(filled(F.col("tender_code")) | filled(F.col("project_code")), CODED).otherwise(UNCODED)
    j = projects.select("project_id", source.alias("source_confidence"), match.alias("match_confidence")).join(field, "project_id", "left").withColumn("field_confidence", F.coalesce("field_confidence", F.lit(0.0)))
    whole = F.col("field_confidence") * BLEND[0] + F.col("source_confidence") * BLEND[1] + F.col("match_confidence") * BLEND[2]
    return j.withColumn("overall_confidence", F.round(whole, 4))


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    """A share rounded; 0 of nothing."""
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)), places), F.lit(0.0))


def quality_metrics(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of counts and rates over all candidates and sources. Rates of secondary candidates are null where there are none.

    ``candidates``: verification_status, official_found, candidate_class, source_count, enrichment_state, relevance_class, completeness_score, tender_status,
    critical (boolean: a critical field is proven). ``sources``: selected, status, error.
    """
    state = F.upper(F.coalesce("enrichment_state", F.lit("")))
    seen = F.upper(F.coalesce("verification_status", F.lit("")))
    official = seen.isin(*OFFICIAL) | yes(F.col("official_found"))
    secondary = yes(F.upper("candidate_class") == "SECONDARY_LEAD") | (seen == "SECONDARY_ONLY")
    usable, score = state.isin("USABLE", "COMPLETE"), F.coalesce("completeness_score", F.lit(0))
    n = F.count(F.lit(1))
    counts = candidates.agg(
        n.alias("candidate_recall"), F.count_if(secondary).alias("secondary_candidates"), F.count_if(official).alias("official_verified_count"),
        F.count_if((seen == "MULTI_SOURCE_CONFIRMED") | yes(F.col("source_count") >= 2)).alias("multi_source_confirmed_count"), F.count_if(usable).alias("usable_count"),
        *[F.count_if(state == s.upper()).alias(f"{s}_count") for s in ("partial", "blocked", "exhausted")],
        rate(F.count_if(~F.coalesce("relevance_class", F.lit("")).isin("IRRELEVANT", "")), n).alias("candidate_precision"), rate(F.count_if(official), n).alias("official_verification_rate"), rate(F.count_if(usable), n).alias("enrichment_success_rate"),
        F.coalesce(F.round(F.avg(score), 2), F.lit(0.0)).alias("completeness_average"), F.count_if(score >= 85).alias("complete_ge_85"), F.count_if((score >= 60) & (score < 85)).alias("usable_60_84"),
        F.count_if((score >= 30) & (score < 60)).alias("partial_30_59"), F.count_if(score < 30).alias("lead_lt_30"), rate(F.count_if(yes(F.col("critical"))), n).alias("critical_fact_coverage"),
        F.count_if(secondary & official).alias("secondary_official_verified_count"), F.count_if(secondary & usable).alias("secondary_usable_count"),
        F.round(F.count_if(secondary & official) / F.nullif(F.count_if(secondary), F.lit(0)), 4).alias("secondary_to_official_conversion_rate"), F.round(F.count_if(secondary & usable) / F.nullif(F.count_if(secondary), F.lit(0)), 4).alias("secondary_to_usable_rate"),
        *[F.count_if(F.coalesce("tender_status", F.lit("UNKNOWN")) == s).alias(f"n_{s.lower()}") for s in ("OPEN", "UNKNOWN", "CLOSED")],
    )
    runs = F.col("status").isin("ACTIVE", "READY", "COMPLETED")
    good = F.count_if(yes(runs) & ~filled(F.col("error")))
    ran = sources.agg(n.alias("source_target"), F.count_if(yes(F.col("selected")) | yes(runs)).alias("source_attempted"), good.alias("source_successful"), rate(good, n).alias("source_rate"))
    return counts.join(F.broadcast(ran))  # one row each


def coverage(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Every planned source and every result without a plan, each with what became of it and whether it counts as attempted, successful or suspicious.

    ``plan``: source_id, selected, reason. ``results``: source_id, error, failures, health_reason, manual_action_required; of several results of a source the last by ``at`` counts.
    """
    last = results.groupBy("source_id").agg(F.max(F.struct("at", "error", "failures", "health_reason", "manual_action_required")).alias("r"))
    j = plan.select("source_id", "selected", "reason", F.lit(True).alias("planned")).join(last, "source_id", "full")
    r, planned = (lambda c: F.col(f"r.{c}")), yes(F.col("planned"))
    blocked = yes(r("manual_action_required")) | (planned & yes(r("health_reason").isin(*BLOCKING)))
    failed = filled(r("error")) | (planned & yes(r("failures") > 0))
    state = first_match(
        [
            (planned & (F.col("reason") == "ADAPTER_NOT_CONFIGURED"), "ADAPTER_NOT_CONFIGURED"),
            (planned & (F.col("reason") == "MANUAL_ACTION_REQUIRED"), "BLOCKED_BEFORE"),
            (planned & ~yes(F.col("selected")), "SKIPPED"),
            (planned & F.col("r").isNull(), "NOT_RETURNED"),
            (blocked, "BLOCKED"),
            (failed, "FAILED"),
            (planned & yes(r("health_reason") == "SUSPECT_ZERO_RESULTS"), "SUSPECT_ZERO"),
        ],
        "SUCCESSFUL",
    )
    out = j.withColumn("coverage", state)
    attempted = F.col("coverage").isin("BLOCKED", "FAILED", "SUSPECT_ZERO", "SUCCESSFUL")
    return out.select("source_id", "coverage", (planned & yes(F.col("selected")) | ~planned).alias("targeted"), attempted.alias("attempted"), F.col("coverage").isin("SUSPECT_ZERO", "SUCCESSFUL").alias("successful"))


def coverage_rates(covered: DataFrame) -> DataFrame:
    """One row: targets, attempts and successes, and both as shares of the targets."""
    least = F.greatest(F.lit(1), F.count_if("targeted"))
    return covered.agg(
        F.count_if("targeted").alias("target"), F.count_if("attempted").alias("attempted"), F.count_if("successful").alias("successful"), F.count_if(F.col("coverage") == "SUSPECT_ZERO").alias("suspicious"),
        F.round(F.count_if("successful") / least, 4).alias("coverage_rate"), F.round(F.count_if("attempted") / least, 4).alias("execution_rate"),
    )


def recall_cases(cases: DataFrame, rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each case with its status, the least id that matches it, and how: by id, url, all its terms in a row, or all in its artifact.

    ``cases``: case_id, region, title_terms, availability, project_id, source_url, source_artifact. ``rows``: project_id, source_url, text. ``artifacts``: name, text.
    Ids and urls meet by hash join, terms as in ``containing``.
    """
    by_id = cases.select("case_id", "project_id").where("project_id is not null").join(rows.select("project_id"), "project_id").select("case_id", "project_id")
    by_url = cases.select("case_id", F.col("source_url").alias("u")).where("u is not null").join(rows.select("project_id", F.col("source_url").alias("u")), "u").select("case_id", "project_id")
    termed = cases.select("case_id", F.transform("title_terms", normalize_identity).alias("terms")).where(F.size("terms") > 0)
    plain = rows.select("project_id", F.col("text").alias("raw"), normalize_identity(F.col("text")).alias("text"))
    hits = by_id.unionByName(by_url).unionByName(least_containing(termed, plain, "case_id", "terms", "project_id", "text", "raw"))
    first = hits.groupBy("case_id").agg(F.min("project_id").alias("matched_project_id"))
    read = artifacts.select(F.col("name").alias("source_artifact"), normalize_identity(F.col("text")).alias("artifact_text"))
    j = cases.join(first, "case_id", "left").join(read, "source_artifact", "left")
    in_artifact = (F.size("title_terms") > 0) & F.forall("title_terms", lambda t: yes(F.contains(F.col("artifact_text"), normalize_identity(t))))
    by = F.when(F.col("matched_project_id").isNotNull(), "database").when(yes(in_artifact), "artifact")
    absent = F.startswith(F.upper("availability"), F.lit("UNAVAILABLE"))
    status = first_match([(by.isNotNull(), "MATCHED"), (absent, "UNAVAILABLE_IN_LOCAL_CORPUS")], "NOT_RECALLED")
    return j.select("case_id", "region", "availability", status.alias("status"), by.alias("matched_by"), "matched_project_id", (~absent).alias("observable"))


#: Characters by which cases and texts meet, at most (a power of two); stretches of cases (and ids of rows that met) that are broadcast, and hashes of pieces.
GRAM, BROADCAST, HASHES = 16, 200_000, 2_000_000


def least_containing(cases: DataFrame, rows: DataFrame, case_id: str, terms: str, row_id: str, text: str, raw: str | None = None) -> DataFrame:
    """(case_id, row_id) of the least row that holds all terms of a case. Cases of equal terms are looked for once, so their rows aren't paired with each of them."""
    listed = cases.select(case_id, terms, F.sha2(F.to_json(terms), 256).alias("_list"))
    hits = containing(listed.select("_list", terms).distinct(), rows, "_list", terms, row_id, text, raw=raw)
    return listed.select(case_id, "_list").join(hits.groupBy("_list").agg(F.min(row_id).alias(row_id)), "_list").select(case_id, row_id)


def containing(cases: DataFrame, rows: DataFrame, case_id: str, terms: str, row_id: str, text: str, gram: int = GRAM, raw: str | None = None) -> DataFrame:
    """(case_id, row_id) of each row whose text holds all terms of a case, of any number of cases.

    ``raw``: a column of ``rows`` of which ``text`` is made by lower-casing and by dropping spaces and signs; it is read in place of ``text`` until rows have met.

    Texts are folded and cut to pieces of a size, one after another (functions/pieces.py). A folded term of at least twice that size less one character holds one of them whole wherever it
    stands, and it is one of the ``size`` stretches at the beginnings of the term's first characters (and of those at its end). Each case takes part with the terms that allow the largest size,
    a power of two up to ``gram``; of these ends the one that the fewest rows hold stands for it. Hashes of pieces are held against those of the cases, which tasks have up to a count, before
    anything is shuffled; whole terms are looked for in what has met, and only rows that have met are read again. Cases of which folding leaves nothing meet texts by ``_met_unfolded``.
    """
    kept = [cases.schema[case_id], cases.schema[terms]]
    shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("_n", T.IntegerType()), T.StructField("_end", T.IntegerType()), T.StructField("g", T.LongType())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.fold_table()
        for b in batches:
            made = []
            for k, listed in enumerate(b.column(1).to_pylist()):
                n, found = pieces.ends_of([t for t in listed if t], gram, table)
                made += [(k, n, e, g) for e, of in enumerate(found) for g in of.tolist()] or [(k, 0, None, None)]
            k, n, e, g = zip(*made, strict=True) if made else ((), (), (), ())
            at = pa.array(k, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int32()), pa.array(e, pa.int32()), pa.array(g, pa.int64())], [case_id, terms, "_n", "_end", "g"])

    some = cases.where(F.size(F.filter(terms, lambda t: t != "")) > 0).select(case_id, terms)
    every = saved(some.mapInArrow(ends, shape), "ends")
    sizes = sorted(r[0] for r in every.select("_n").distinct().collect())  # powers of two up to ``gram``, and 0
    if not sizes:
        return cases.join(rows, F.lit(False)).select(case_id, row_id)
    met = [_met_folded(every.where("_n > 0"), rows, case_id, terms, row_id, raw or text, [n for n in sizes if n])] if sizes != [0] else []
    if sizes[0] == 0:
        met.append(_met_unfolded(every.where("_n = 0").select(case_id, terms), rows, case_id, terms, row_id, text, gram))
    hits = []
    for m in met:
        ids = m.select(row_id).distinct()
        texts = rows.select(row_id, text).join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, row_id, "left_semi")
        hits.append(m.join(texts, row_id).where(F.forall(terms, lambda t: F.contains(F.col(text), t))).select(case_id, row_id))
    return reduce(DataFrame.unionByName, hits)


def _met_folded(wanted: DataFrame, rows: DataFrame, case_id: str, terms: str, row_id: str, text: str, sizes: list[int]) -> DataFrame:
    """(case_id, terms, row_id) where the folded text has a piece of the case's rarest end. ``wanted``: case_id, terms, _end, g (hash of a piece)."""
    distinct = wanted.select("g").distinct()
    few = distinct.count() <= HASHES
    known = wanted.sparkSession.sparkContext.broadcast(np.sort(distinct.toArrow().column("g").to_numpy().view(np.uint64))) if few else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, among = pieces.fold_table(), None if known is None else pieces.Known(known.value)
        for b in batches:
            for row, g in pieces.pieces_of(b.column(1), sizes, among, table):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(g)], [row_id, "g"])

    made = rows.select(row_id, text).mapInArrow(cut, T.StructType([T.StructField(row_id, rows.schema[row_id].dataType), T.StructField("g", T.LongType())]))
    known_rows = saved((made if few else made.join(distinct, "g", "left_semi").select(row_id, "g")).distinct(), "pieces")
    return saved(_by_rarest(wanted, known_rows, case_id, terms, row_id), "met")


def _by_rarest(wanted: DataFrame, known: DataFrame, case_id: str, terms: str, row_id: str) -> DataFrame:
    """Cases meet the rows that have a piece of that of their ends which the fewest rows have."""
    often = known.groupBy("g").agg(F.count("*").alias("n_rows"))
    # an end that no row has rules its case out
    held = wanted.join(often, "g", "left").groupBy(case_id, terms, "_end").agg(F.sum(F.coalesce("n_rows", F.lit(0))).alias("n"))
    rarest = held.groupBy(case_id, terms).agg(F.min(F.struct("n", "_end")).alias("r")).select(case_id, terms, F.col("r._end").alias("_end"))
    return wanted.join(rarest, [case_id, terms, "_end"]).select(case_id, terms, "g").join(known, "g").select(case_id, terms, row_id).distinct()


def _met_unfolded(cases: DataFrame, rows: DataFrame, case_id: str, terms: str, row_id: str, text: str, gram: int) -> DataFrame:
    """(case_id, terms, row_id) by pieces of the texts as they are: the same as ``_met_folded`` in Spark's expressions, for terms of letters beyond those that folding keeps."""
    some = F.filter(terms, lambda t: t != "")
    powers = [2**k for k in range(gram.bit_length()) if 2**k <= gram]
    size = lambda t: F.greatest(*[F.when(F.length(t) >= 2 * n - 1, n) for n in powers], F.lit(1))
    sized = cases.select(case_id, terms, some.alias("_some"), F.array_max(F.transform(some, size)).alias("_n"))
    ends = F.array_distinct(F.flatten(F.transform(F.filter("_some", lambda t: size(t) == F.col("_n")), lambda t: F.array(F.left(t, 2 * F.col("_n") - 1), F.right(t, 2 * F.col("_n") - 1)))))
    cut = sized.select(case_id, terms, "_n", F.explode(ends).alias("_end"))
    wanted = cut.select(case_id, terms, "_end", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.substring(F.col("_end"), i, F.col("_n"))))).alias("g"))
    sizes = sorted(r[0] for r in sized.select("_n").distinct().collect())  # powers of two up to ``gram``
    distinct = wanted.select("g").distinct()
    n = distinct.count()
    made = rows.select(row_id, F.explode(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s).{{{k}}}"), F.lit(0)) for k in sizes])).alias("g"))
    if BROADCAST < n <= HASHES:
        made = made.withColumn("_h", F.xxhash64("g")).join(F.broadcast(distinct.select(F.xxhash64("g").alias("_h")).distinct()), "_h", "left_semi").drop("_h")
    known = saved(made.join(F.broadcast(distinct) if n <= BROADCAST else distinct, "g", "left_semi").select(row_id, "g").distinct(), "unfolded-pieces")
    return saved(_by_rarest(wanted, known, case_id, terms, row_id), "unfolded-met")


def recall_by_region(cases: DataFrame) -> DataFrame:
    """Counts of each region, and the share of its observable cases that matched (null if none is observable)."""
    hit, seen = F.col("status") == "MATCHED", F.col("observable")
    return cases.groupBy("region").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matched"), F.count_if(seen).alias("observable"), F.count_if(F.col("status") == "UNAVAILABLE_IN_LOCAL_CORPUS").alias("unavailable"),
        F.round(F.count_if(hit & seen) / F.nullif(F.count_if(seen), F.lit(0)), 4).alias("observable_recall"),
    )


def review_sample(tagged: DataFrame, row_id: str, tags: str, n: int, required: Sequence[str] = SAMPLE_TAGS) -> DataFrame:
    """``n`` rows: for each required tag in turn the first row by id that none before took, then the first of the others; with ``place``.

    Each tag's first rows, as many as there are tags, are enough to choose from.
    """
    k = len(required)
    of = tagged.select(row_id, F.explode(F.array_distinct(F.col(tags))).alias("tag")).where(F.col("tag").isin(*required))
    # ranks beyond k are dropped before rows are exchanged, so no tag gathers in a task
    least = of.withColumn("k", F.row_number().over(Window.partitionBy("tag").orderBy(row_id))).where(F.col("k") <= k)
    chosen: list = []
    candidates: dict = {}
    for r in sorted(least.collect(), key=lambda r: r["k"]):  # at most k ids for each of k tags
        candidates.setdefault(r["tag"], []).append(r[row_id])
    for tag in required:
        fresh = [i for i in candidates.get(tag, []) if i not in chosen]
        if fresh and len(chosen) < n:
            chosen.append(fresh[0])
    first = F.array_position(F.array(*[F.lit(i) for i in chosen]), F.col(row_id)) if chosen else F.lit(0)
    placed = tagged.withColumn("_first", F.when(first > 0, first))
    order = [F.col("_first").asc_nulls_last(), F.col(row_id)]
    return placed.orderBy(*order).limit(n).drop("_first")


def summary_rates(summaries: DataFrame) -> DataFrame:
    """Shares of the fields found, the evidence covered and the items reviewed, over all summaries."""
    return summaries.agg(
        rate(F.sum("fields_found"), F.sum("fields_expected")).alias("rule_success_rate"), rate(F.sum("evidence_covered"), F.sum("evidence_total")).alias("evidence_coverage_rate"), rate(F.sum("review_items"), F.sum("processed")).alias("review_rate")
    )


def region_counts(regions: DataFrame) -> DataFrame:
    """Places of each level in a catalogue."""
    level = first_match([(F.col("level").isin("province", "special_region"), "province"), (F.col("level").isin("city", "prefecture"), "city")], "county")
    return regions.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
