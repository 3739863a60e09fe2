"""Archives, replays and workbooks."""

import datetime as dt
import zipfile

import pytest

from tidemark.sources import files


def test_rejected_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z, pytest.warns(UserWarning, match="Duplicate"):
        for name, body in (("docs/a.html", "one"), ("../out.html", "x"), ("/abs.html", "x"), ("c:/d.html", "x"), ("docs/A.html", "two"), ("docs/a.html", "three"), ("e.exe", "x")):
            z.writestr(name, body)
        link = zipfile.ZipInfo("l.html")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "docs/a.html")
    got = {r.member: (r.text, r.error) for r in files.zip_members(spark, f"file://{tmp_path}").collect()}
    assert got == {"docs/a.html": ("one", None)}
    why = sorted((r.member, r.error) for r in files.zip_members(spark, f"file://{tmp_path}", rejected=True).collect())
    assert why == [("../out.html", "UNSAFE_MEMBER"), ("/abs.html", "UNSAFE_MEMBER"), ("c:/d.html", "UNSAFE_MEMBER"), ("docs/A.html", "DUPLICATE_MEMBER"), ("docs/a.html", "DUPLICATE_MEMBER"), ("e.exe", "UNSUPPORTED_TYPE"), ("l.html", "UNSAFE_MEMBER")]


def test_replay(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>甲</p>", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    at = dt.datetime(2026, 8, 1)
    rows = [(1, f"{tmp_path}/a.html", 7, "s", "u", at), (2, f"file://{tmp_path}/b.pdf", 7, "t", "u", at), (3, f"{tmp_path}/gone.html", 8, "s", "u", at)]
    snaps = spark.createDataFrame(rows, "snapshot_id int, file_path string, announcement_id int, source_id string, url string, captured_at timestamp_ntz")
    got = {r.snapshot_id: (r.text, r.error) for r in files.replayed(spark, f"file://{tmp_path}", snaps).collect()}
    assert got == {1: ("<p>甲</p>", None), 2: (None, "UNSUPPORTED_TYPE"), 3: (None, "MISSING_FILE")}
    assert [r.snapshot_id for r in files.replayed(spark, f"file://{tmp_path}", snaps, announcement_id=7, source_id="s").collect()] == [1]


def test_workbook(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "甲 <&>", dt.datetime(2026, 9, 5, 17), None)], "n int, project_name string, bid_deadline timestamp_ntz, owner string")
    path = str(tmp_path / "out.xlsx")
    assert files.write_workbook(df, path) == 1
    lines = files.office_text("xlsx", open(path, "rb").read()).split("\n")
    assert lines[0].split("\t") == list(files.EXPORTED.values()) and len(files.EXPORTED) == 18
    assert lines[1].split("\t")[3] == "甲 <&>" and "2026-09-05 17:00:00" in lines[1]
    monkeypatch.setattr(files, "SHEET_ROWS", 0)
    with pytest.raises(ValueError, match="sheet holds"):
        files.write_workbook(df, path)
