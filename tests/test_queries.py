"""Every bound query against its SQL in DuckDB: on the smallest data, and the quick ones on ten times as much."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.catalog.QUERIES, entry.catalog.SQL

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose run, or whose SQL, takes long on the larger data.
SLOW = (
    "notice_fields", "notice_evidence", "notice_gaps", "identity_resolution", "lead_classes", "place_match", "place_dictionary", "enrichment_rounds", "enrichment_queries", "timeline", "closed_documents", "html_main_text", "fuzzy_dedupe", "record_matches",
    "recall_cases", "recall_by_region", "recall_benchmark", "ranked_search", "refreshed_search", "navigation_links", "code_chains", "official_trace", "merged_codes",
)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test data isn't here")


@pytest.fixture(scope="module")
def dbs():
    out = {}
    for sf in (SF, LARGER):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else str(value) if value is not None and not isinstance(value, (str, bool)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, dbs, name):
    sf = SF if name in SLOW or not Path(LARGER).exists() else LARGER
    df, db = QUERIES[name](spark, sf), dbs[sf]
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["project_id", "status", "reason_code"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
