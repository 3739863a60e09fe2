"""Configuration as tables: keyword groups, profiles, places, sources, concepts, recall cases. Files are YAML (or JSON) and small; they are read on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.concepts import Budget
from tidemark.operators.places import Places

PLACE = "region_code string, name string, short_name string, aliases array<string>, level string, parent_code string"
GROUP = "group_id string, name string, terms array<string>, excluded array<string>, priority int"
SOURCE = (
    "source_id string, source_name string, category string, base_url string, region string, enabled boolean, priority int, access_method string, requires_login boolean, adapter string, "
    "adapter_level string, adapter_config string, status string, crawl_enabled boolean, max_pages int, request_delay_seconds double, lookback_days int, notes string"
)
SOURCE_DEFAULTS = {
    "enabled": True, "priority": 3, "access_method": "http_public", "requires_login": False, "adapter": "configured", "adapter_level": "CUSTOM_HTTP", "status": "registry_only",
    "crawl_enabled": False, "max_pages": 2, "request_delay_seconds": 0.2, "lookback_days": 30,
}
#: Keys of a source that are known but aren't columns; any other key is an error.
SOURCE_OTHER = ("crawl_interval", "rate_limit", "browser_profile_path")
CASE = "case_id string, region string, title_terms array<string>, expected_class string, availability string, source_artifact string, project_id string, source_url string, notes string"
CONCEPT = "group_id string, priority int, terms array<string>, relations array<string>"
MATRIX = "row int, groups array<string>, terms array<string>, relations array<string>, priority int"


def read_config(path: str | Path) -> dict[str, Any]:
    """A configuration file, whose root is an object."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise ValueError("YAML needs a library that isn't here; write the file as JSON") from error
        found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError(f"the root of {path} isn't an object")
    return found


def _words(value: Any) -> list[str]:
    given = [value] if isinstance(value, str) else value or []
    return [str(x).strip() for x in given if str(x).strip()]


def _once(rows: Iterable[Mapping], key: str) -> list[Mapping]:
    rows = list(rows)
    if len({r[key] for r in rows}) < len(rows):
        raise ValueError(f"a {key} occurs twice")
    return rows


def catalogue(path: str | Path) -> list[dict]:
    """Entries of a catalogue of places (``regions``), each code once."""
    entries = [
        {"region_code": str(r["region_code"]), "name": str(r["name"]), "short_name": str(r.get("short_name") or r["name"]), "aliases": _words(r.get("aliases")), "level": str(r.get("level") or "province"), "parent_code": r.get("parent_code") and str(r["parent_code"])}
        for r in read_config(path).get("regions") or []
    ]
    return _once(entries, "region_code")  # type: ignore[return-value]


def region_catalogue(spark: SparkSession, path: str | Path) -> DataFrame:
    return spark.createDataFrame(catalogue(path), PLACE)


def places(path: str | Path) -> Places:
    """A catalogue as a dictionary that matches texts."""
    return Places({"code": r["region_code"], "name": r["name"], "aliases": (r["short_name"], *r["aliases"]), "level": r["level"], "parent": r["parent_code"]} for r in catalogue(path))


def _named(node: Any) -> tuple[str, list[str]]:
    if isinstance(node, str):
        return node, []
    return str(node["name"]), _words(node.get("aliases"))


def _branches(nodes: Iterable[Any], below: tuple[str, ...], above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, bool]]:
    """(path, label, leaf) of every name and alias below the nodes."""
    for node in nodes:
        name, aliases = _named(node)
        children = (node.get(below[0]) or []) if below and isinstance(node, dict) else []
        for label in (name, *aliases):
            yield (*above, name), label, not children
        yield from _branches(children, below[1:], (*above, name))


def region_tree(spark: SparkSession, path: str | Path) -> DataFrame:
    """province, city, county, label, leaf: a row for every name and alias of a nested tree of places."""
    found = read_config(path)
    rows = [(*p, *[None] * (3 - len(p)), label, leaf) for p, label, leaf in _branches([*(found.get("provinces") or []), *(found.get("special_regions") or [])], ("cities", "counties"))]
    return spark.createDataFrame(rows, "province string, city string, county string, label string, leaf boolean")


def keywords(spark: SparkSession, path: str | Path) -> DataFrame:
    """category, term: the terms of each category, and of all of them as ``all``."""
    found = {str(c): _words(terms) for c, terms in (read_config(path).get("categories") or {}).items()}
    rows = [(c, t) for c, terms in found.items() for t in terms] + [("all", t) for t in sorted({t for terms in found.values() for t in terms})]
    return spark.createDataFrame(rows, "category string, term string")


def industry_groups(spark: SparkSession, path: str | Path, more: str | Path | None = None) -> DataFrame:
    """Groups of terms; files of the folder ``more``, in the order of their names, replace groups of equal id."""
    files = [path, *(sorted(Path(more).glob("*.yaml")) + sorted(Path(more).glob("*.json")) if more and Path(more).is_dir() else [])]
    by_id: dict[str, tuple] = {}
    for f in files:
        found = read_config(f)
        for g in found.get("industry_groups") or found.get("profiles") or []:
            terms = list(dict.fromkeys(w for k in ("include", "synonyms", "aliases") for w in _words(g.get(k))))
            excluded = _words(g.get("exclude"))
            by_id[str(g["group_id"])] = (str(g["group_id"]), str(g.get("name") or g["group_id"]), [t for t in terms if t not in excluded], excluded, int(g.get("priority", 5)))
    return spark.createDataFrame(list(by_id.values()), GROUP)


def source_registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """The registered sources with defaults filled, each id once; an unknown key is an error."""
    names = [c.split()[0] for c in SOURCE.split(", ")]
    rows = []
    for r in _once(read_config(path).get("sources") or [], "source_id"):
        unknown = set(r) - set(names) - set(SOURCE_OTHER)
        if unknown:
            raise ValueError(f"{r['source_id']}: unknown {', '.join(sorted(unknown))}")
        whole = SOURCE_DEFAULTS | r
        rows.append(tuple(float(whole[n]) if n == "request_delay_seconds" else whole.get(n) for n in names))
    return spark.createDataFrame(rows, SOURCE)


def search_profiles(path: str | Path) -> dict[str, dict]:
    """Profiles by id, their lists as tuples; keys that a profile doesn't know are kept aside, not read."""
    lists = ("regions", "excluded_regions", "industry_groups", "include_keywords", "exclude_keywords", "source_categories", "included_sources", "excluded_sources", "announcement_types")
    return {str(p["profile_id"]): p | {k: tuple(_words(p.get(k))) for k in lists} for p in _once(read_config(path).get("profiles") or [], "profile_id")}


def budget(profile: Mapping) -> Budget:
    """A profile's limits; coverage falls back to its queries a run."""
    run = profile.get("max_queries_per_run") or profile.get("max_search_queries_per_run") or 48
    return Budget(int(profile.get("max_queries_per_day", 200)), int(profile.get("coverage_budget") or run), int(profile.get("discovery_budget", 12)), int(profile.get("enrichment_budget", 24)), int(profile.get("verification_budget", 12)))


def concepts(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(groups, matrix) of a concept."""
    found = read_config(path)
    groups = [(str(g["group_id"]), int(g.get("priority", 5)), list(dict.fromkeys(w for k in ("terms", "include", "synonyms", "aliases") for w in _words(g.get(k)))), _words(g.get("relations") or g.get("relation_types"))) for g in found.get("groups") or found.get("concept_groups") or []]
    rows = [(i, _words(r.get("groups") or r.get("concept_groups")), _words(r.get("terms") or r.get("with")), _words(r.get("relations") or r.get("relation") or "parent_project"), int(r.get("priority", 3))) for i, r in enumerate(found.get("query_matrix") or [])]
    return spark.createDataFrame(groups, CONCEPT), spark.createDataFrame(rows, MATRIX)


def recall_cases(spark: SparkSession, path: str | Path, root: str | Path = ".") -> tuple[DataFrame, DataFrame]:
    """(cases, artifacts) of a recall benchmark; an artifact that isn't there is empty."""
    found = read_config(path)
    names = [c.split()[0] for c in CASE.split(", ")]
    defaults = {"region": "", "expected_class": "UNCLASSIFIED", "availability": "UNKNOWN"}
    rows = [tuple(_words(c.get(n)) if n == "title_terms" else str(c[n]) if c.get(n) else defaults.get(n) for n in names) for c in _once(found.get("cases") or [], "case_id")]
    files = sorted({*_words(found.get("source_artifacts")), *(r[names.index("source_artifact")] for r in rows if r[names.index("source_artifact")])})
    texts = [(f, (Path(root) / f).read_text(encoding="utf-8", errors="replace") if (Path(root) / f).is_file() else "") for f in files]
    return spark.createDataFrame(rows, CASE), spark.createDataFrame(texts, "name string, text string")


def requests(payload: Mapping[str, Any]) -> dict[str, Any]:
    """A stored request under today's names: old ones are aliases, single values are lists, unknown keys fall away."""
    from tidemark.functions.request import LIST_FIELDS, OLD_NAMES, PLAIN_FIELDS, result_mode_of, search_mode_of

    given = dict(payload or {})
    for name, old in OLD_NAMES.items():
        given.setdefault(name, next((given[o] for o in old if o in given), None))
    out = {n: tuple(_words(given.get(n))) for n in LIST_FIELDS} | {n: given[n] for n in PLAIN_FIELDS if given.get(n) is not None}
    return out | {"search_mode": search_mode_of(given.get("search_mode")), "result_mode": result_mode_of(given.get("result_mode"))}
