"""Pages by key with totals, and documents of a session in order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.paging import page_of, read_document, write_documents


@pytest.mark.parametrize("size", [1, 7, 50, 200])
def test_pages_of_any_size_are_one_list(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice(["OPEN", "CLOSED", None]), rng.choice([None, *range(9)])) for i in range(60 if size == 1 else 150)]
    df = spark.createDataFrame(rows, "id int, status string, updated int").repartition(5)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))]
    got, after = [], None
    while True:
        page = page_of(df, [("status", False), ("updated", True), ("id", False)], size, after)
        assert page.total == len(rows)
        got += [r.id for r in page.rows.collect()]
        after = page.after
        if after is None or (size == 1 and len(got) == 12):
            break
    assert got == want[: len(got)] and (size == 1 or len(got) == len(want))


def test_page_of_nothing(spark):
    page = page_of(spark.createDataFrame([], "id int"), [("id", False)], 5)
    assert page.rows.count() == 0 and page.total == 0 and page.after is None


def test_documents_of_a_session(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["OPEN", "UNKNOWN", "CLOSED"]), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "project_id int, status string, rank double").repartition(4)
    member = {"results": F.col("status") != "CLOSED", "open_projects": F.col("status") == "OPEN", "unknown_projects": F.col("status") == "UNKNOWN", "candidate_pool": F.lit(True), "errors": F.lit(False)}
    write_documents(df, f"{tmp_path}/s", member, [F.desc("rank"), F.col("project_id")])
    for document, keep in (("results", ("OPEN", "UNKNOWN")), ("open_projects", ("OPEN",)), ("unknown_projects", ("UNKNOWN",)), ("candidate_pool", ("OPEN", "UNKNOWN", "CLOSED"))):
        got = [json.loads(r["value"])["project_id"] for r in read_document(spark, f"{tmp_path}/s", document).orderBy("place").collect()]
        assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0])) if r[1] in keep]
    assert not (tmp_path / "s" / "document=errors").exists()
    with pytest.raises(ValueError, match="no documents"):
        write_documents(df, f"{tmp_path}/t", {"other": F.lit(True)}, [F.col("project_id")])
