"""Reports of a run as Markdown and JSON. What is rendered is bounded: counts, and the first rows of each section."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a section that a report shows; the files of a session hold all.
SHOWN = 200
LAYER_TITLES = {
    "A": "可参与项目", "B": "官方候选", "C": "包内与上级项目", "D": "结构相关", "E": "结果与历史", "F": "仅二手来源", "G": "待核验线索", "H": "已截止", "I": "已排除", "J": "受阻来源",
}


def _cell(value: object) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def table(columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    """A Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(_cell(v) for v in r) + " |" for r in rows)])


def section(title: str, df: DataFrame, columns: Sequence[str], order: Sequence, most: int = SHOWN) -> str:
    """A titled table of the first rows; it says how many there are in all."""
    total = df.count()
    rows = [tuple(r) for r in df.orderBy(*order).select(*columns).limit(most).collect()]
    more = f"\n\n({total - len(rows)} more)" if total > len(rows) else ""
    return f"## {title} ({total})\n\n" + (table(columns, rows) + more if rows else "-")


def search_report(summary: Mapping[str, object], layers: DataFrame, open_rows: DataFrame, unknown_rows: DataFrame, coverage: DataFrame) -> str:
    """A session's report: its figures, the count of each layer, what is open or unknown, and the sources."""
    columns = ("project_id", "project_name", "status", "source_level", "next_deadline")
    figures = table(("figure", "value"), summary.items())
    counts = {r["layer"]: r["n"] for r in layers.collect()}  # ten rows
    parts = [figures, "## Layers\n\n" + table(("layer", "title", "n"), [(k, t, counts.get(k, 0)) for k, t in LAYER_TITLES.items()])]
    parts += [section(t, df, [c for c in columns if c in df.columns], [F.col("next_deadline").asc_nulls_last(), "project_id"]) for t, df in (("Open", open_rows), ("Unknown", unknown_rows))]
    parts.append(section("Sources", coverage, ("source_id", "coverage"), ["coverage", "source_id"]))
    return "# Search\n\n" + "\n\n".join(parts) + "\n"


def review_report(items: DataFrame, evidence: DataFrame, most_evidence: int = 12) -> str:
    """The review queue by priority and time, each item with the first pieces of its evidence (project_id, field_name, source_text, id)."""
    shown = items.orderBy("priority", "created_at", "review_id").limit(SHOWN)
    of = F.slice(F.array_sort(F.collect_list(F.struct("id", "field_name", "source_text"))), 1, most_evidence)
    proof = evidence.join(shown.select("project_id").distinct(), "project_id").groupBy("project_id").agg(of.alias("evidence"))
    rows = shown.join(proof, "project_id", "left").orderBy("priority", "created_at", "review_id").collect()
    parts = []
    for r in rows:
        lines = [f"- {e['field_name']}: {_cell(e['source_text'])}" for e in r["evidence"] or []]
        parts.append(f"## {r['review_id']}\n\nPriority {r['priority']}, {r['reason']}, project {r['project_id']}\n\n" + "\n".join(lines))
    return "# Review\n\n" + "\n\n".join(parts) + "\n"


def write_reviews(items: DataFrame, path: str) -> None:
    """The queue as JSON lines in its order: ranges of it are files, whose names follow the order."""
    items.orderBy("priority", "created_at", "review_id").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def recall_report(cases: DataFrame, regions: DataFrame) -> str:
    """The recall of a benchmark, by region and case by case."""
    totals = cases.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MATCHED").alias("hit"), F.count_if(F.col("observable")).alias("seen")).first()
    head = table(("cases", "matched", "observable"), [(totals["n"], totals["hit"], totals["seen"])])
    return "# Recall\n\n" + "\n\n".join([head, section("Regions", regions, regions.columns, ["region"]), section("Cases", cases, ("case_id", "region", "status", "matched_by", "matched_project_id"), ["case_id"])]) + "\n"


def run_report(title: str, summary: Mapping[str, object], sources: DataFrame, sample: DataFrame | None = None) -> str:
    """A crawl's or an extraction's report: figures, sources by health, and the sample for review."""
    parts = [table(("figure", "value"), summary.items()), section("Sources", sources, sources.columns, [sources.columns[0]])]
    if sample is not None:
        parts.append(section("Sample", sample, sample.columns, [sample.columns[0]]))
    return f"# {title}\n\n" + "\n\n".join(parts) + "\n"


def write_text(text: str, path: str) -> None:
    """A report as a file of the driver, replaced at once."""
    import os
    import tempfile
    from pathlib import Path

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, target)
