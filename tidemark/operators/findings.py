"""Search results as leads and candidates: what a result is, what it names, and what a candidate looks like as a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import leads as L
from tidemark.functions.extract import _any
from tidemark.functions.rules import yes
from tidemark.functions.text import blank_to_null, canonicalize_url, collapse, contains_any, domain

# Words of actions and energies, domains that are official, where snippets name codes and parties.
ACTION_WORDS, ENERGY_WORDS = ("招标", "采购", "询比", "资格预审", "EPC", "中标"), ("光伏", "风电", "储能", "新能源")
OFFICIAL_SUFFIXES, WECHAT = (".gov.cn", ".gov", ".mil.cn"), "mp.weixin.qq.com"
PRESS = ("bjx", "北极星", "能源界", "索比")
AGENCY_WORDS = ("招标代理", "代理机构")
SNIPPET_FIELDS = ((("项目名称", "项目名", "工程名称"), r"[^，。；;]{4,100}"), (("项目编号", "招标编号", "采购编号"), r"[A-Za-z0-9][A-Za-z0-9_-]{3,50}"), (("招标人", "采购人", "建设单位", "业主单位"), r"[^，。；;]{3,80}"), (("招标代理机构", "代理机构"), r"[^，。；;]{3,80}"))
ALIASES = {"project_code": ("project_code", "projectnum", "项目编号"), "tender_code": ("tender_code", "tendercode", "message_no", "招标编号"), "owner": ("owner", "purchaser", "tenderer", "招标人", "采购人")}


def looks_like_project(text: Column) -> Column:
    return contains_any(text, ACTION_WORDS) & contains_any(text, ENERGY_WORDS)


def official_domain(host: Column, known: Sequence[str] = ()) -> Column:
    """A host, without ``www.``, that is known or a government's."""
    bare = F.regexp_replace(host, r"^www\.", "")
    out = bare.isin(*known) if known else F.lit(False)
    for s in OFFICIAL_SUFFIXES:
        out = out | F.endswith(bare, F.lit(s))
    return yes(out)


def guessed_level(host: Column, text: Column) -> Column:
    """A to E of a result by its host and what it says; the order counts."""
    return F.when(F.endswith(host, F.lit(".gov.cn")) | F.endswith(host, F.lit(".gov")), "A").when(host == WECHAT, "B").when(contains_any(text, AGENCY_WORDS), "C").when(contains_any(host, PRESS), "D").otherwise("E")


def configured_level(given: Column, url: Column, text: Column) -> Column:
    """A to E of a result as its metadata say, else by its host and what it says."""
    host = domain(url, strip_www=False)
    official = F.endswith(host, F.lit(".gov.cn")) | F.endswith(host, F.lit(".gov")) | F.endswith(host, F.lit(".mil.cn"))
    return F.when(F.upper(given).isin(*"ABCDE"), F.upper(given)).when(official, "A").when(host == WECHAT, "B").when(contains_any(text, AGENCY_WORDS), "C").otherwise("E")


def category_level(category: Column) -> Column:
    """A to E by the category of a registered source."""
    return F.when(category.isin("national", "regional"), "A").when(category == "enterprise", "B").otherwise("D")


def snippet_queries(text: Column) -> Column:
    """At most four distinct names, codes and parties that a snippet's labels announce."""
    found = [F.trim(F.regexp_extract(text, rf"(?i){_any(labels)}\s*[：:]\s*({what})", 1)) for labels, what in SNIPPET_FIELDS]
    return F.slice(F.array_distinct(F.filter(F.array(*found), lambda x: x != "")), 1, 4)


def findings(results: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Search results (url, title, snippet, metadata) once for each canonical url, with domain, level, lead type, codes and owner, and what kind of finding each is.

    A candidate looks like a project or is a lead; a secondary lead is a candidate that no official page states.
    """
    keyed = results.withColumn("canonical_url", canonicalize_url(F.col("url"))).where("canonical_url <> ''")
    rest = [c for c in keyed.columns if c not in ("canonical_url", "metadata")]
    one = keyed.groupBy("canonical_url").agg(F.min_by(F.struct(*rest, "metadata"), F.struct(*rest)).alias("x")).select("canonical_url", "x.*")
    text = F.concat_ws(" ", "title", "snippet")
    given = lambda names: F.coalesce(*[F.nullif(F.try_element_at("metadata", F.lit(n)), F.lit("")) for n in names])
    read = one.withColumns({"domain": domain(F.col("canonical_url"), strip_www=False), "lead_type": L.lead_type(text), "looks": looks_like_project(text)})
    read = read.withColumns({"source_level": guessed_level(F.col("domain"), text), **{k: F.substring(given(names), 1, 256) for k, names in ALIASES.items()}})
    candidate = F.col("looks") | F.col("lead_type").isNotNull()
    official = official_domain(F.col("domain"), known)
    read = read.withColumns({"is_candidate": candidate, "is_official": official, "is_secondary": candidate & ((F.col("domain") == WECHAT) | ~official)})
    return read.withColumn("finding_key", F.concat_ws("|", F.coalesce("lead_type", F.lit("")), "canonical_url")).drop("looks")


def search_identity(name: Column, title: Column, text: Column) -> Column:
    """What a result is traced by: a name in its metadata of four characters or more, one that a label announces, else its cleaned headline."""
    labelled = blank_to_null(collapse(F.regexp_extract(text, rf"{_any(SNIPPET_FIELDS[0][0])}\s*[：:]\s*([^，。；;]{{4,160}})", 1)))
    return F.coalesce(F.when(F.length(F.trim(name)) >= 4, F.trim(name)), labelled, L.lead_identity(title))


JSON_COLUMNS: Mapping[str, str] = {"relation_types": "array<string>", "matched_concepts": "array<string>", "missing_fields": "array<string>", "candidate_values": "map<string,string>", "evidence_ids": "array<bigint>", "source_ids": "array<string>"}


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """Stored candidates with their ``*_json`` columns read; what can't be read is empty."""

    def read(name: str, kind: str) -> Column:
        empty = F.create_map().cast(kind) if kind.startswith("map") else F.array().cast(kind)
        return F.coalesce(F.from_json(f"{name}_json", kind), empty)

    known = {n: k for n, k in JSON_COLUMNS.items() if f"{n}_json" in candidates.columns}
    return candidates.withColumns({n: read(n, k) for n, k in known.items()}).drop(*[f"{n}_json" for n in known])


def new_rows(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose key wasn't there before."""
    return after.join(before.select(key), key, "left_anti")


def with_presence(projects: DataFrame, attachments: DataFrame, evidence: DataFrame) -> DataFrame:
    """Projects with whether they have any attachment and any evidence."""
    flag = lambda df, name: df.select("project_id").distinct().withColumn(name, F.lit(True))
    j = projects.join(flag(attachments, "has_attachment"), "project_id", "left").join(flag(evidence, "has_evidence"), "project_id", "left")
    return j.withColumns({c: yes(F.col(c)) for c in ("has_attachment", "has_evidence")})


def inspection(projects: DataFrame, children: Mapping[str, tuple[DataFrame, Sequence[str]]], project_id: object) -> DataFrame:
    """One project with each of its child tables as an ordered array of structs. ``children``: name to (table, order); only the project's own rows are read."""
    out = projects.where(F.col("project_id") == F.lit(project_id))
    for name, (df, order) in children.items():
        rest = [c for c in df.columns if c not in ("project_id", *order)]
        own = df.where(F.col("project_id") == F.lit(project_id)).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(own, "project_id", "left")
    return out


def as_records(projects: DataFrame, schema: Sequence[str]) -> DataFrame:
    """The columns that a project's row and a record share."""
    return projects.select(*[c for c in projects.columns if c in schema])


def review_payload(projects: DataFrame, announcements: DataFrame, parses: DataFrame, attachments: DataFrame, evidence: DataFrame, required: Sequence[str], critical: Sequence[str], strong: int) -> DataFrame:
    """project_id with the ids of its documents (its own and those of its announcements), their paths and the attachments', the required fields missing, and critical fields without strong evidence."""
    notes = announcements.select("project_id", F.col("id").alias("announcement_id"))
    own = parses.where("project_id is not null").select("project_id", "document_id", "file_path")
    of = parses.join(notes.withColumnRenamed("project_id", "of_project"), "announcement_id").select(F.col("of_project").alias("project_id"), "document_id", "file_path")
    documents = own.unionByName(of).distinct()
    files = documents.select("project_id", F.col("file_path").alias("path")).unionByName(attachments.select("project_id", F.col("local_path").alias("path"))).where("path is not null").distinct()
    d = documents.groupBy("project_id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids"))
    p = files.groupBy("project_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    proven = evidence.where(F.col("strength") == strong).groupBy("project_id").agg(F.collect_set("field_name").alias("proven"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    j = projects.join(d, "project_id", "left").join(p, "project_id", "left").join(proven, "project_id", "left")
    return j.select(
        "project_id", none(F.col("document_ids"), dict(d.dtypes)["document_ids"]).alias("document_ids"), none(F.col("paths"), "array<string>").alias("paths"),
        F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required])).alias("missing_fields"),
        F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & ~F.array_contains(none(F.col("proven"), "array<string>"), f), F.lit(f)) for f in critical])).alias("missing_evidence_fields"),
    )
