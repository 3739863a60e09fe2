"""Queries of full-text search and of dictionaries of places, bound to the driver's tables: documents are projects, their texts announcements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fulltext, places
from tidemark.operators.paging import page_of
from tidemark.plans.bindings import load
from tidemark.sources.select import Items, list_items, parsed, select, with_html
from tidemark.plans.catalog import query
from tidemark.sources.store import Store, new_folder, saved

#: Typed queries: frequent words of several languages, a repeated one, a name of a source, one that nothing has.
TYPED = {1: "the thing", 2: "Die und, die!", 3: "src1 de la", 4: "que", 5: "of nothing-like-this"}


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf, "documents")
    projects = docs.select(F.col("doc_id").alias("project_id"), F.col("source").alias("owner"), F.col("lang").alias("agency"))
    return projects, docs.select(F.col("doc_id").alias("project_id"), F.col("text").alias("clean_text"))


def _typed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPED.items()), "query_id int, query string")


def _ranked_sql(text: str) -> str:
    typed = ", ".join(f"({i}, '{q}')" for i, q in TYPED.items())
    return rf"""
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(concat_ws(' ', source, lang, {text})), '[\p{{L}}\p{{N}}]+')) AS token FROM documents),
counts AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS MATERIALIZED (SELECT doc_id, coalesce(n, 0) AS length FROM documents LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM counts GROUP BY 1) USING (doc_id)),
words AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+')) AS token FROM (VALUES {typed}) t(query_id, q)),
needed AS (SELECT query_id, count(*) AS needed FROM words GROUP BY 1),
totals AS (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS mean FROM lengths),
weighed AS (SELECT query_id, token, greatest({fulltext.LEAST_IDF}::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS idf FROM words JOIN (SELECT token, count(*) AS df FROM counts GROUP BY 1) USING (token), totals),
scored AS (
  SELECT query_id, doc_id, sum(round(1000000 * (idf * tf * {fulltext.K1 + 1}::DOUBLE / (tf + {fulltext.K1}::DOUBLE * ({1 - fulltext.B}::DOUBLE + {fulltext.B}::DOUBLE * length / mean))))::BIGINT) AS score, count(*) AS n
  FROM counts JOIN weighed USING (token) JOIN lengths USING (doc_id), totals GROUP BY 1, 2),
found AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored JOIN needed USING (query_id) WHERE scored.n = needed.needed)
SELECT query_id, place::INT AS place, doc_id, score / 1000000.0::DOUBLE AS score FROM found WHERE place <= 50"""


@query(_ranked_sql("text"))
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best documents of each typed query, from an index of all texts."""
    index = fulltext.refresh(Store(spark, new_folder(spark, "fulltext")), *_indexed(spark, sf))
    return fulltext.rank(index, _typed(spark)).select("query_id", "place", F.col("project_id").alias("doc_id"), "score")


@query(_ranked_sql("CASE lang WHEN 'de' THEN text || ' the thing' ELSE text END"))
def refreshed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same after the documents of one language were changed and indexed anew."""
    store = Store(spark, new_folder(spark, "fulltext"))
    projects, texts = _indexed(spark, sf)
    fulltext.refresh(store, projects, texts)
    changed = projects.where("agency = 'de'")
    index = fulltext.refresh(store, changed, texts.withColumn("clean_text", F.concat("clean_text", F.lit(" the thing"))))
    return fulltext.rank(index, _typed(spark)).select("query_id", "place", F.col("project_id").alias("doc_id"), "score")


#: Two and three words of a benchmark passage are a city and a county of it; every part has a name and ten aliases.
_DICTIONARY = r"""items AS (SELECT item_id, regexp_extract_all(text, '[^ ]+') AS w FROM benchmark),
entries AS MATERIALIZED (
  SELECT 'b' || item_id AS code, array_to_string(w[1:4], ' ') AS name, 0 AS level, NULL AS parent, item_id * 100000 AS place FROM items
  UNION ALL SELECT 'b' || item_id || '-' || i, w[i] || ' ' || w[i + 1], 1, 'b' || item_id, item_id * 100000 + i * 10 + 2 FROM items, range(1, 1000) r(i) WHERE i < len(w)
  UNION ALL SELECT 'b' || item_id || '-' || i || '+', array_to_string(w[i:i + 2], ' '), 2, 'b' || item_id || '-' || i, item_id * 100000 + i * 10 + 3 FROM items, range(1, 1000) r(i) WHERE i + 1 < len(w)
  UNION ALL SELECT 'p' || p_partkey, p_name || ' ' || p_partkey, 2, NULL, 1000000000000 + p_partkey FROM part),
names AS (SELECT * FROM entries UNION ALL SELECT code, name || ' ' || chr((97 + k)::INT), level, parent, place FROM entries, range(10) r(k) WHERE code LIKE 'p%'),
plain AS MATERIALIZED (SELECT code, level, place, lower(regexp_replace(name, '[\s，。、；：:（）()【】\[\]「」《》/\\_\-]+', '', 'g')) AS label FROM names),
texts AS MATERIALIZED (SELECT doc_id, lower(regexp_replace(text, '[\s，。、；：:（）()【】\[\]「」《》/\\_\-]+', '', 'g')) AS t FROM documents),
best AS (SELECT doc_id, arg_max(code, (level, length(label), -place)) AS code FROM texts JOIN plain ON contains(t, label) GROUP BY 1)"""


@query(f"""WITH {_DICTIONARY} SELECT doc_id, b.code, concat_ws('/', gg.name, g.name, e.name) AS path
  FROM best b JOIN entries e ON e.code = b.code LEFT JOIN entries g ON g.code = e.parent LEFT JOIN entries gg ON gg.code = g.parent""")
def place_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest place that a whole text names, by a dictionary of more labels than a plan could carry."""
    items = load(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w"))
    none = F.array().cast("array<string>")
    roots = items.select(F.concat(F.lit("b"), "item_id").alias("code"), F.array_join(F.slice("w", 1, 4), " ").alias("name"), none.alias("aliases"), F.lit("province").alias("level"), F.lit(None).cast("string").alias("parent"), (F.col("item_id") * 100000).alias("place"))
    at = items.select("item_id", "w", F.posexplode("w").alias("i", "first"))
    code = F.concat(F.lit("b"), "item_id", F.lit("-"), F.col("i") + 1)
    words = lambda n: F.array_join(F.slice("w", F.col("i") + 1, F.lit(n)), " ")
    place = F.col("item_id") * 100000 + (F.col("i") + 1) * 10
    cities = at.where(F.col("i") + 1 < F.size("w")).select(code.alias("code"), words(2).alias("name"), none, F.lit("city"), F.concat(F.lit("b"), "item_id"), place + 2)
    counties = at.where(F.col("i") + 2 < F.size("w")).select(F.concat(code, F.lit("+")).alias("code"), words(3).alias("name"), none, F.lit("county"), code, place + 3)
    name = F.concat("p_name", F.lit(" "), "p_partkey")
    parts = load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey"), name, F.array(*[F.concat(name, F.lit(f" {chr(97 + k)}")) for k in range(10)]), F.lit("district"), F.lit(None).cast("string"), F.lit(1000000000000) + F.col("p_partkey"))
    labels = saved(places.label_table(roots.union(cities).union(counties).union(parts)), "labels")
    return places.matched(load(spark, sf, "documents"), ["doc_id"], "text", labels).select("doc_id", "code", F.array_join("path", "/").alias("path"))


@query(r"""WITH navs AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>(<a href="[^"]*">[^<]*</a>)', 1)) AS a FROM pages),
read AS (SELECT page_id, regexp_extract(url, '^[^/?#]*//[^/?#]*', 0) || regexp_extract(a, 'href="([^"]*)"', 1) AS url, trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&'), ' :：;；,，') AS title FROM navs)
SELECT page_id, url, title, count(*) AS n FROM read WHERE title <> '' GROUP BY ALL""")
def navigation_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links of each page's navigation, as items that selectors name; how often the page has each."""
    items = list_items(load(spark, sf, "pages"), "page_id", "url", "html", Items("nav ul > li", "a[href]", "a[href]"), 2026)
    return items.groupBy("page_id", "url", "title").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, len(regexp_extract_all(a, '<p[ >]')) AS n_paragraphs, length(a) AS size FROM (SELECT page_id, regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<(script|style|noscript|template|svg|canvas)\b[^>]*>.*?</(script|style|noscript|template|svg|canvas)\s*>', ' ', 'g'), '(?s)<article>.*?</article>', 0) AS a FROM pages) WHERE a <> ''""")
def article_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The article of each page and its paragraphs, whether they are closed or not."""
    page = parsed(load(spark, sf, "pages"), ["page_id"], "html")
    articles = with_html(page, select(page, "article")).select("page_id", F.length("html").cast("long").alias("size"))
    inner = select(page, "article p").groupBy("page_id").agg(F.count("*").alias("n"))
    return articles.join(inner, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), "size")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS updated_at FROM orders),
placed AS (SELECT *, row_number() OVER (ORDER BY o_orderstatus, updated_at DESC NULLS LAST, o_orderkey) - 1 AS place, count(*) OVER () AS total FROM o)
SELECT (place // 40 + 1)::INT AS page, o_orderkey AS project_id, total FROM placed WHERE place < 120""")
def project_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first three pages of a list of projects, each begun where the one before ended, with the number of all."""
    rows = load(spark, sf, "orders").selectExpr("o_orderkey AS project_id", "o_orderstatus AS status", "IF(o_orderkey % 7 = 0, NULL, o_orderdate) AS updated_at")
    order, after, out = [("status", False), ("updated_at", True), ("project_id", False)], None, []
    for n in range(1, 4):
        page = page_of(rows, order, 40, after)
        out.append(page.rows.select(F.lit(n).alias("page"), "project_id", F.lit(page.total).cast("long").alias("total")))
        after = page.after
        if after is None:
            break
    return reduce(DataFrame.unionByName, out)
