"""Configuration readers, stored requests and reports."""

import json

import pytest

from tidemark.functions import request
from tidemark.operators.concepts import Budget
from tidemark.sources import config, reports


def write(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return path


def test_catalogue(spark, tmp_path):
    p = write(tmp_path / "regions.json", {"regions": [{"region_code": "61", "name": "陕西省", "short_name": "陕西", "aliases": "秦", "level": "province"}, {"region_code": 6101, "name": "西安市", "level": "city", "parent_code": 61}]})
    rows = {r.region_code: r for r in config.region_catalogue(spark, p).collect()}
    assert rows["61"].aliases == ["秦"] and rows["6101"].parent_code == "61" and rows["6101"].short_name == "西安市"
    places = config.places(p)
    assert {e["code"] for e in places.selected(["61"])} == {"61", "6101"}
    twice = write(tmp_path / "twice.json", {"regions": [{"region_code": "1", "name": "a"}, {"region_code": "1", "name": "b"}]})
    with pytest.raises(ValueError, match="twice"):
        config.region_catalogue(spark, twice)


def test_region_tree(spark, tmp_path):
    p = write(tmp_path / "tree.json", {"provinces": [{"name": "陕西", "aliases": ["陕西省"], "cities": [{"name": "西安", "counties": ["雁塔区", {"name": "碑林区", "aliases": ["碑林"]}]}, "铜川"]}], "special_regions": [{"name": "兵团"}]})
    rows = sorted((r.province, r.city or "", r.county or "", r.label, r.leaf) for r in config.region_tree(spark, p).collect())
    assert rows == [
        ("兵团", "", "", "兵团", True), ("陕西", "", "", "陕西", False), ("陕西", "", "", "陕西省", False), ("陕西", "西安", "", "西安", False), ("陕西", "西安", "碑林区", "碑林", True), ("陕西", "西安", "碑林区", "碑林区", True),
        ("陕西", "西安", "雁塔区", "雁塔区", True), ("陕西", "铜川", "", "铜川", True),
    ]


def test_groups_and_keywords(spark, tmp_path):
    p = write(tmp_path / "groups.json", {"industry_groups": [{"group_id": "solar", "include": ["光伏", "PV"], "exclude": "PV", "synonyms": ["太阳能", "光伏"]}, {"group_id": "wind", "include": ["风电"]}]})
    (tmp_path / "more").mkdir()
    write(tmp_path / "more" / "b.json", {"profiles": [{"group_id": "wind", "include": ["风机"], "priority": 1}]})
    rows = {r.group_id: r for r in config.industry_groups(spark, p, tmp_path / "more").collect()}
    assert rows["solar"].terms == ["光伏", "太阳能"] and rows["wind"].terms == ["风机"] and rows["wind"].priority == 1
    k = write(tmp_path / "keywords.json", {"categories": {"a": ["x", " y "], "b": ["x"]}})
    assert sorted(tuple(r) for r in config.keywords(spark, k).collect()) == [("a", "x"), ("a", "y"), ("all", "x"), ("all", "y"), ("b", "x")]


def test_sources_and_profiles(spark, tmp_path):
    p = write(tmp_path / "sources.json", {"sources": [{"source_id": "a", "source_name": "A", "category": "national", "base_url": "http://a/", "rate_limit": 1, "priority": 1}, {"source_id": "b", "source_name": "B", "category": "enterprise", "base_url": "http://b/", "crawl_enabled": True}]})
    rows = {r.source_id: r for r in config.source_registry(spark, p).collect()}
    assert rows["a"].status == "registry_only" and rows["a"].priority == 1 and rows["b"].crawl_enabled and rows["b"].lookback_days == 30 and rows["a"].region is None
    with pytest.raises(ValueError, match="unknown colour"):
        config.source_registry(spark, write(tmp_path / "bad.json", {"sources": [{"source_id": "a", "colour": 1}]}))
    f = config.search_profiles(write(tmp_path / "profiles.json", {"profiles": [{"profile_id": "p", "regions": "61", "max_queries_per_run": 30, "max_queries_per_day": 90}]}))
    assert f["p"]["regions"] == ("61",) and config.budget(f["p"]) == Budget(per_day=90, coverage=30)


def test_cases_and_concepts(spark, tmp_path):
    write(tmp_path / "cases.json", {"cases": [{"case_id": "c1", "title_terms": "甲", "source_artifact": "a.txt"}, {"case_id": "c2", "availability": "UNAVAILABLE_X"}], "source_artifacts": ["gone.txt"]})
    (tmp_path / "a.txt").write_text("甲乙", encoding="utf-8")
    cases, artifacts = config.recall_cases(spark, tmp_path / "cases.json", tmp_path)
    assert {r.case_id: (r.title_terms, r.availability) for r in cases.collect()} == {"c1": (["甲"], "UNKNOWN"), "c2": ([], "UNAVAILABLE_X")}
    assert {r.name: r.text for r in artifacts.collect()} == {"a.txt": "甲乙", "gone.txt": ""}
    groups, matrix = config.concepts(spark, write(tmp_path / "concept.json", {"groups": [{"group_id": "g", "terms": ["t"], "relations": ["r"]}], "query_matrix": [{"groups": "g", "with": ["x", "y"]}]}))
    assert groups.first().terms == ["t"] and matrix.first().relations == ["parent_project"] and matrix.first().terms == ["x", "y"]


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("regions:\n  - {region_code: CN-11, name: 北京市, aliases: [京]}\n", encoding="utf-8")
    assert config.catalogue(tmp_path / "c.yaml")[0]["aliases"] == ["京"]
    (tmp_path / "list.yaml").write_text("- a\n", encoding="utf-8")
    with pytest.raises(ValueError, match="object"):
        config.read_config(tmp_path / "list.yaml")


def test_stored_requests():
    got = config.requests({"industry": "solar", "keyword": ["a", " "], "mode": "EXACT", "output_mode": "full", "colour": 1, "days": 7, "relation": ["direct"]})
    assert got["industries"] == ("solar",) and got["keywords"] == ("a",) and got["relations"] == ("direct",) and got["search_mode"] == "exact" and got["result_mode"] == "FULL_RESULT" and got["days"] == 7 and "colour" not in got
    assert config.requests({})["search_mode"] == "opportunity" and config.requests({"result_mode": "delta-result"})["result_mode"] == "DELTA_RESULT" and config.requests({"result_mode": "x"})["result_mode"] == "AUTO"


def test_requests_merge():
    got = request.merged({"regions": (), "days": None, "deep": False, "keywords": ("a", "a")}, {"regions": ("甘肃",), "days": 30, "deep": True}, {"days": 7, "industries": ("solar",), "deep": True, "wechat": True})
    assert got == {"regions": ("甘肃",), "days": 30, "deep": True, "keywords": ("a",), "industries": ("solar",), "wechat": True}


@pytest.mark.parametrize(
    ("phrase", "want"),
    [
        ("甘肃最近7天 EPC 项目", {"regions": ("甘肃省",), "days": 7, "project_types": ("EPC", "PC")}),
        ("全国最近一个月光伏支架精确", {"regions": ("全国",), "days": 30, "equipment": ("光伏支架",), "search_mode": "exact"}),
        ("最近一周储能 逆变器 张掖水库", {"days": 7, "industries": ("storage", "equipment"), "equipment": ("逆变器",), "keywords": ("张掖水库",)}),
        ("公众号里不要漏的风电", {"wechat": True, "deep": True, "discovery": True, "search_mode": "broad", "result_mode": "FULL_RESULT"}),
        ("", {"days": 30, "keywords": (), "regions": ()}),
    ],
)
def test_phrases(phrase, want):
    got = request.parse(phrase, {"甘肃": "甘肃省", "甘肃省": "甘肃省"})
    assert {k: getattr(got, k) for k in want} == want


def test_reports(spark, tmp_path):
    items = spark.createDataFrame([("r2", 2, 1, "B", "p2"), ("r1", 1, 2, "A | x", "p1")], "review_id string, priority int, created_at int, reason string, project_id string")
    proof = spark.createDataFrame([(i, "p1", "owner", f"t{i}") for i in range(20)], "id int, project_id string, field_name string, source_text string")
    text = reports.review_report(items, proof)
    assert text.index("## r1") < text.index("## r2") and text.count("- owner") == 12
    reports.write_reviews(items, f"{tmp_path}/reviews")
    assert [json.loads(r.value)["review_id"] for r in spark.read.text(f"{tmp_path}/reviews").collect()] == ["r1", "r2"]
    layers = spark.createDataFrame([("A", 3)], "layer string, n int")
    rows = spark.createDataFrame([(i, f"n{i}", "OPEN", None) for i in range(300)], "project_id int, project_name string, status string, next_deadline timestamp_ntz")
    covered = spark.createDataFrame([("s", "FAILED")], "source_id string, coverage string")
    out = reports.search_report({"found": 3}, layers, rows, rows.limit(0), covered)
    assert "| A | 可参与项目 | 3 |" in out and "## Open (300)" in out and "(100 more)" in out and "## Unknown (0)" in out and "| s | FAILED |" in out
    reports.write_text(out, str(tmp_path / "x" / "report.md"))
    assert (tmp_path / "x" / "report.md").read_text(encoding="utf-8") == out
    cases = spark.createDataFrame([("c", "r", "MATCHED", "database", 1, True)], "case_id string, region string, status string, matched_by string, matched_project_id int, observable boolean")
    regions = spark.createDataFrame([("r", 1)], "region string, total int")
    assert "| c | r | MATCHED | database | 1 |" in reports.recall_report(cases, regions)
    assert "## Sample (1)" in reports.run_report("Crawl", {"n": 1}, covered, layers)
