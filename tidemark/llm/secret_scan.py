"""Secret scans, in DataFrame functions alone: spans by fixed patterns, and further ones by character Markov models.

Patterns name three kinds of spans: assigned values, access keys and long hexadecimal strings. What else may be a secret is a run of 16 or more characters of
``[A-Za-z0-9+/_-]`` with a letter, which touches no span of the patterns. Two models of first order, one of random strings and one of ordinary
identifiers, give it a log-likelihood ratio; at ``THRESHOLD`` or more a character it is a span of kind ``markov``. They are trained from labelled
samples: random are values that the patterns found, and strings drawn by a hash over the alphabet of base 64; ordinary are other
words, numbers and identifiers of the documents (long runs with both letters and digits, which are what is to be judged, are in neither sample). Samples are bounded (``SAMPLE`` distinct values of each origin, of least hash; ordinary
ones from about ``SAMPLE_DOCUMENTS`` documents of least hash), whole texts of all rows are scanned.

Patterns are evaluated once for the matches and once for what lies between them; places follow by running sums of their lengths, so a text with any
number of matches costs in proportion. Only spans are shuffled, by document and hash of its text, never texts.

Defined cases. Null or empty text: no spans. Null id: as any id. Repeated rows (equal id and text) are found once and returned as often as they are given; rows of
equal id and other texts are apart. Very long texts are scanned whole. Spans of patterns may overlap each other, of one kind they don't. Without any value that
the patterns find, the random sample is the drawn one; without words, ordinary transitions are all equally likely. No rows: no rows. Further columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Kinds of the patterns in their order, their patterns, the group that holds the value, and its least length. Only ASCII letters have two cases here.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
MARKOV = "markov"
CANDIDATE, ORDINARY = r"[A-Za-z0-9+/_-]{16,}", r"[A-Za-z0-9+/_-]{6,}"
#: Values of each origin that the models are trained on, at most; documents that ordinary ones are taken from, about.
SAMPLE, SAMPLE_DOCUMENTS = 5000, 20_000
#: Symbols of the models, counts added to each, counts by which a transition leans on its symbol, and the least mean ratio of a secret's characters, in nats.
SYMBOLS, ADDED, LEAN, THRESHOLD = 66, 0.5, 4.0, 2.0
#: Ratios are integers of this part of a nat, so sums don't depend on their order.
UNIT = 1_000_000
_CODES = 128


def _found(text: Column, kind: int, pattern: str) -> Column:
    """For each match, the characters between the one before and it, and the match; at last what follows, with no match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), match.alias("match")))


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table (doc_id, text_hash, kind, start, end, value): spans of the patterns, and as kind 3 the runs that may be secrets.

    Places count code points, the end is exclusive. A span holds all that its pattern matched; its value may be less.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    every = [*(pattern for _, pattern, _, _ in PATTERNS), CANDIDATE]
    # a run of 32 or more digits is found as such: shorter ones are many, and fail
    found = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.concat(*[_found(whole, k, p.replace("f]+", "f]{32,}")) for k, p in enumerate(every)])).alias("at", "x"))
    flat = found.select("doc_id", "text_hash", "at", "x.kind", "x.gap", "x.match").where("match is not null")
    once = flat.groupBy("doc_id", "text_hash", "kind", "at").agg(F.any_value("gap").alias("gap"), F.any_value("match").alias("match"))
    placed = once.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at")))
    value, least = F.col("match"), F.lit(0)
    for k, (_, pattern, group, length) in enumerate(PATTERNS):
        at = F.col("kind") == k
        least = F.when(at, length).otherwise(least)
        value = F.when(at, F.regexp_extract("match", pattern, group)).otherwise(value) if group else value
    long_enough = (F.length("value") >= least) & ((F.col("kind") < len(PATTERNS)) | F.col("value").rlike("[A-Za-z]"))
    return written(placed.select("doc_id", "text_hash", "kind", (F.col("end") - F.length("match")).alias("start"), "end", value.alias("value")).where(long_enough), "spans")


def drawn_strings(spark: SparkSession, n: int = SAMPLE // 5) -> DataFrame:
    """``n`` strings of 43 characters over the alphabet of base 64, by a hash."""
    return spark.range(n).select(F.rtrim(F.base64(F.unhex(F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256))), F.lit("=")).alias("value"))


def labelled_samples(docs: DataFrame, spans: DataFrame, sample: int = SAMPLE, documents: int = SAMPLE_DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(value, random): what the models are trained on."""
    known = spans.where(F.col("kind") < len(PATTERNS)).select("value").distinct()
    # a share of the documents by their hash, so the sample is spread over the whole table
    share = max(1, docs.count() // documents)
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    some = docs.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % share == 0) if share > 1 else docs
    words = some.select(F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("value"))
    doubtful = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") & (F.length("value") >= 16)
    words = words.where(~doubtful).distinct().join(known, "value", "left_anti")
    least = [F.md5(F.col("value").cast("binary")), F.col("value")]
    random = known.orderBy(*least).limit(sample).unionByName(drawn_strings(docs.sparkSession, sample // 5))
    return random.withColumn("random", F.lit(True)).unionByName(words.orderBy(*least).limit(sample).withColumn("random", F.lit(False)))


def trained(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios of all transitions, from labelled (value, random): at 128 * before + after, by ASCII codes; a value begins after code 0.

    Transitions are counted by the engine; at most two for each pair of symbols reach the driver.
    """
    codes = F.transform(F.split("value", ""), lambda c: F.ascii(c))
    pairs = F.explode(F.zip_with(F.concat(F.array(F.lit(0)), codes), codes, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    within = samples.where("value <> ''").select("random", pairs.alias("p")).where(F.col("p.b").isNotNull() & (F.col("p.a") < _CODES) & (F.col("p.b") < _CODES))
    counts: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in within.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect():
        counts[r["random"]][r["a"], r["b"]] = r["n"]
    # a transition's chance leans on that of its symbol as far as its context is rare
    contexts, symbols = ({kind: Counter() for kind in counts} for _ in range(2))
    for kind, seen in counts.items():
        for (a, b), n in seen.items():
            contexts[kind][a] += n
            symbols[kind][b] += n

    def chance(kind: bool, a: int, b: int) -> float:
        alone = (symbols[kind][b] + ADDED) / (symbols[kind].total() + ADDED * SYMBOLS)
        return math.log((counts[kind].get((a, b), 0) + LEAN * alone) / (contexts[kind][a] + LEAN))

    return [round(UNIT * (chance(True, a, b) - chance(False, a, b))) for a in range(_CODES) for b in range(_CODES)]


def log_ratio(value: Column, ratios: list[int]) -> Column:
    """The summed log-likelihood ratio of a value, in ``UNIT`` parts of a nat."""
    held = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    start = F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("sum"))
    step = lambda s, c: F.struct(F.ascii(c).alias("before"), (s["sum"] + F.get(held, s["before"] * _CODES + F.ascii(c))).alias("sum"))
    return F.aggregate(F.split(value, ""), start, step, lambda s: s["sum"])


def secrets(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, start, end): spans of the patterns (0 to 2) and of the models (3), which touch none of the patterns."""
    spans = matches(docs, doc_id, text)
    ratios = trained(labelled_samples(docs, spans, sample, doc_id=doc_id, text=text))
    is_base = F.col("kind") < len(PATTERNS)
    likely = spans.where(is_base | (log_ratio(F.col("value"), ratios) >= F.length("value") * int(threshold * UNIT)))
    of = Window.partitionBy("doc_id", "text_hash").orderBy("start", "kind")
    before = F.max(F.when(is_base, F.col("end"))).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(is_base, F.col("start"))).over(of.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    touched = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return likely.select("doc_id", "text_hash", "kind", "start", "end", before.alias("before"), after.alias("after")).where(is_base | ~touched).drop("before", "after")


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(name) for name, *_ in PATTERNS], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None, **options) -> DataFrame:
    """Every row of ``docs`` as ``row`` (all its columns, or those of ``keep``), and ``spans``, an array of (start, kind, end) by start, then kind.

    Rows and spans are joined: columns that aren't wanted, texts above all, should not be kept.
    """
    found = secrets(docs, doc_id=doc_id, text=text, **options).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    found = found.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "spans")
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left").select("row", F.coalesce("spans", none).alias("spans"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [n(k).alias(f"n_{name}") for k, (name, *_) in enumerate(PATTERNS)]
    base = F.sha2(_named(F.filter("spans", lambda s: s["kind"] < len(PATTERNS))), 256)
    return rows.select("row.doc_id", *counts, base.alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in SQL: places by running sums, samples by least md5, ratios in integers."""
    spelled = re.sub(r"[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", "password|passwd|secret|token|api_?key")
    patterns = [p.replace("?i:password|passwd|secret|token|api_?key", f"?:{spelled}") for _, p, _, _ in PATTERNS] + [CANDIDATE]
    quoted = ["'" + p.replace("'", "''") + "'" for p in patterns]
    kinds = "\n  UNION ALL ".join(f"SELECT n, {k} AS kind, unnest(string_split_regex(text, {p})) AS gap, unnest(regexp_extract_all(text, {p})) AS match, generate_subscripts(string_split_regex(text, {p}), 1) AS nth FROM docs" for k, p in enumerate(quoted))
    names = "[" + ", ".join(f"'{name}'" for name, *_ in PATTERNS) + f", '{MARKOV}']"
    joined = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  {kinds}),
placed AS MATERIALIZED (
  SELECT n, kind, match, sum(length(gap) + length(match)) OVER (PARTITION BY n, kind ORDER BY nth) AS stop FROM found WHERE match IS NOT NULL),
spans AS MATERIALIZED (
  SELECT n, kind, (stop - length(match))::BIGINT AS start, stop::BIGINT AS stop, CASE kind WHEN 0 THEN regexp_extract(match, {quoted[0]}, 1) ELSE match END AS value
  FROM placed WHERE length(CASE kind WHEN 0 THEN regexp_extract(match, {quoted[0]}, 1) ELSE match END) >= [{", ".join(str(x[3]) for x in PATTERNS)}, 0][kind + 1] AND (kind < 3 OR regexp_matches(match, '[A-Za-z]'))),
known AS MATERIALIZED (SELECT DISTINCT value FROM spans WHERE kind < 3),
share AS (SELECT greatest(1, count(*) // {SAMPLE_DOCUMENTS}) AS share FROM docs),
words AS (
  SELECT DISTINCT value FROM (
    SELECT unnest(regexp_extract_all(text, '{ORDINARY}')) AS value FROM docs, share
    WHERE ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 8))::BIGINT % share = 0)
  WHERE NOT (length(value) >= 16 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]'))),
samples AS MATERIALIZED (
  (SELECT value, true AS random FROM known ORDER BY md5(value), value LIMIT {SAMPLE})
  UNION ALL SELECT rtrim(to_base64(unhex(sha256('random:' || i))), '='), true FROM range({SAMPLE // 5}) r(i)
  UNION ALL (SELECT value, false FROM words WHERE value NOT IN (SELECT value FROM known) ORDER BY md5(value), value LIMIT {SAMPLE})),
steps AS (SELECT random, unnest(list_concat([0], list_transform(string_split(value, ''), lambda c: ascii(c)))) AS a, unnest(list_transform(string_split(value, ''), lambda c: ascii(c))) AS b FROM samples),
counts AS MATERIALIZED (SELECT random, a, b, count(*) AS c FROM steps WHERE b IS NOT NULL AND a < {_CODES} AND b < {_CODES} GROUP BY ALL),
contexts AS (SELECT random, a, sum(c) AS c FROM counts GROUP BY ALL),
codes AS (SELECT unnest(range({_CODES})) AS code),
symbols AS (
  SELECT random, code AS b, (coalesce(c, 0) + {ADDED})::DOUBLE / (sum(coalesce(c, 0)) OVER (PARTITION BY random) + {ADDED * SYMBOLS})::DOUBLE AS alone
  FROM (SELECT unnest([true, false]) AS random), codes LEFT JOIN (SELECT random AS r, b, sum(c) AS c FROM counts GROUP BY ALL) s ON s.r = random AND s.b = code),
chances AS (
  SELECT s.random, x.code AS a, s.b, ln((coalesce(n.c, 0) + {LEAN} * s.alone)::DOUBLE / (coalesce(t.c, 0) + {LEAN})::DOUBLE) AS chance
  FROM symbols s CROSS JOIN codes x LEFT JOIN counts n ON n.random = s.random AND n.a = x.code AND n.b = s.b LEFT JOIN contexts t ON t.random = s.random AND t.a = x.code),
ratios AS MATERIALIZED (SELECT a, b, round({UNIT} * (max(chance) FILTER (random) - max(chance) FILTER (NOT random)))::BIGINT AS ratio FROM chances GROUP BY a, b),
letters AS (
  SELECT n, start, unnest(list_concat([0], list_transform(string_split(value, ''), lambda c: ascii(c)))) AS a, unnest(list_transform(string_split(value, ''), lambda c: ascii(c))) AS b
  FROM spans WHERE kind = 3),
likely AS (SELECT n, start FROM letters JOIN ratios USING (a, b) GROUP BY n, start HAVING sum(ratio) >= {int(THRESHOLD * UNIT)} * count(*) FILTER (b IS NOT NULL)),
kept AS (
  SELECT n, kind, start, stop FROM spans WHERE kind < 3 UNION ALL
  SELECT n, kind, start, stop FROM spans s JOIN likely USING (n, start)
  WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.n = s.n AND b.kind < 3 AND b.start < s.stop AND b.stop > s.start)),
joined AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         {joined} FILTER (kind < 3) AS base, {joined} AS spans
  FROM kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (n)
"""


SQL = _sql()
