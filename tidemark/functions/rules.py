"""Rule classifiers: ordered (condition, value) tables compiled to one conditional each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import contains_any

DEADLINES = ("qualification_deadline", "registration_deadline", "document_deadline", "bid_deadline", "open_time")
TIME_FIELDS = ("qualification_start", "qualification_deadline", "registration_start", "registration_deadline", "document_start", "document_deadline", "bid_deadline", "open_time")
CLOSED = ("CLOSED_QUALIFICATION_EXPIRED", "CLOSED_REGISTRATION_EXPIRED", "CLOSED_DOCUMENT_DEADLINE_EXPIRED", "CLOSED_BID_DEADLINE_EXPIRED", "CLOSED_OPENED")
#: Strength of one evidence row as a number; null: none at all.
NONE, WEAK, STRONG = 0, 1, 2
#: Terms of the relevance classes.
DIRECT = ("光伏支架", "支架系统", "支架采购", "支架安装", "组件支架", "柔性支架", "固定支架", "水面光伏支架")
COMPONENT = ("支架基础", "预埋件", "檩条", "连接件", "支架螺栓", "支架防腐")
STRUCTURE = ("光伏车棚", "光伏雨棚", "钢结构", "支架加固", "支架防风改造")
PARENT = ("光伏", "太阳能", "分布式", "屋顶光伏", "农光互补", "光伏电站", "光伏项目", "新能源")
CONTRACT = ("EPC", "PC", "施工总承包", "专业分包", "设备材料")
PROCUREMENT = ("招标", "采购", "询比", "资格预审", "中标", "项目", "工程", "公告", "公示")
LAYERS = tuple("ABCDEFGHIJ")


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds; null conditions don't."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def evidence_strength(kind: Column, text: Column, locator: Column) -> Column:
    """Strength of an evidence row by its type, else by its text and place."""
    k = F.upper(F.coalesce(kind, F.lit("")))
    strong = ("DIRECT", "CODEX_REVIEW", "SOURCE_FIELD", "API_FIELD", "JSON_FIELD", "HTML_SELECTOR", "REGEX", "TABLE", "RULE", "MANUAL", "STRUCTURED")
    return first_match(
        [
            (k.isin("INFERRED", "SECONDARY_ONLY", "NO_EVIDENCE") | F.contains(k, F.lit("SECONDARY")) | F.contains(k, F.lit("INFERRED")), WEAK),
            (contains_any(k, strong), STRONG),
            ((F.coalesce(text, F.lit("")) != "") & (F.coalesce(locator, F.lit("")) != ""), STRONG),
        ],
        NONE,
    )


def gate_fields(level: int | None, has_marker: Column | None = None) -> Column:
    """Populated time fields whose evidence is at a level: WEAK, or missing (``None``), from columns ``<field>_evidence``."""
    hit = lambda f: F.col(f).isNotNull() & ((F.coalesce(F.col(f"{f}_evidence"), F.lit(NONE)) == WEAK) if level == WEAK else (F.coalesce(F.col(f"{f}_evidence"), F.lit(NONE)) == NONE))
    parts = [F.when(hit(f), F.lit(f)) for f in TIME_FIELDS]
    if has_marker is not None and level is None:
        parts.append(F.when(has_marker & (F.coalesce(F.col("participation_evidence"), F.lit(NONE)) != STRONG), F.lit("participation_method")))
    return F.array_compact(F.array(*parts))


def status_reason(now: Column, blocked: Column, marker: Column) -> Column:
    """The reason code of a project at ``now``; its prefix up to the first ``_`` is the status."""
    c = F.col
    late = [yes(c(f) <= now) for f in DEADLINES]
    conflict = yes(c("qualification_start") > c("qualification_deadline")) | yes(c("registration_start") > c("registration_deadline")) | yes(c("document_start") > c("document_deadline"))
    active = lambda f: yes(c(f"{f}_deadline") > now) & (c(f"{f}_start").isNull() | (c(f"{f}_start") <= now))
    bid = yes(c("bid_deadline") > now)
    bidding = bid & (c("open_time").isNull() | yes(c("open_time") > now))
    windows = c("qualification_deadline").isNotNull() | c("registration_deadline").isNotNull() | c("document_deadline").isNotNull()
    return first_match(
        [
            (conflict, "UNKNOWN_CONFLICTING_DATES"),
            (yes(blocked), "UNKNOWN_NEEDS_CODEX_REVIEW"),
            *zip(late, CLOSED, strict=True),
            (bidding & active("registration"), "OPEN_REGISTRATION_ACTIVE"),
            (bidding & active("document"), "OPEN_DOCUMENT_DOWNLOAD_ACTIVE"),
            (bidding & yes(marker), "OPEN_PARTICIPATION_ACTIVE"),
            (~bid & windows, "UNKNOWN_NO_BID_DEADLINE"),
            (bid & ~windows & ~yes(marker), "UNKNOWN_NO_PARTICIPATION_DEADLINE"),
            (F.coalesce(*[c(f) for f in DEADLINES]).isNotNull(), "UNKNOWN_SOURCE_INCOMPLETE"),
        ],
        "UNKNOWN_NO_PARTICIPATION_DEADLINE",
    )


def status_of(reason: Column) -> Column:
    return F.regexp_extract(reason, "^[^_]*", 0)


def relevance(text: Column, lead: Column | None = None, direct: Sequence[str] = DIRECT, component: Sequence[str] = COMPONENT, structure: Sequence[str] = STRUCTURE, parent: Sequence[str] = PARENT, contract: Sequence[str] = CONTRACT, procurement: Sequence[str] = PROCUREMENT) -> Column:
    lead = F.coalesce(lead, F.lit("")) if lead is not None else F.lit("")
    has = lambda terms: contains_any(text, terms)
    return first_match(
        [
            (has(direct) & has(procurement), "DIRECT"),
            ((lead == "PROJECT_LEVEL_EPC") | (has(parent) & has(contract)), "EMBEDDED"),
            (lead == "ADJACENT_STRUCTURE", "ADJACENT"),
            (has(structure) | has(component), "STRUCTURAL_RELATED"),
            (has(parent), "PARENT_PROJECT"),
            (has(procurement), "POSSIBLE"),
        ],
        "IRRELEVANT",
    )


def result_layer(excluded: Column, blocked: Column, historic: Column, status: Column, verification: Column, relevance_class: Column, official: Column) -> Column:
    """The presentation layer A to J."""
    core = relevance_class.isin("DIRECT", "POSSIBLE", "PARENT_PROJECT")
    return first_match(
        [
            (excluded, "I"),
            (blocked, "J"),
            (historic, "E"),
            (status == "CLOSED", "H"),
            (verification == "SECONDARY_ONLY", "F"),
            (verification.isin("DISCOVERY_LEAD", "UNVERIFIED"), "G"),
            (relevance_class == "EMBEDDED", "C"),
            (relevance_class.isin("STRUCTURAL_RELATED", "ADJACENT"), "D"),
            ((relevance_class == "PARENT_PROJECT") & official, "C"),
            (core & verification.isin("VERIFIED", "MULTI") & (status == "OPEN"), "A"),
            (official, "B"),
        ],
        "G",
    )


def completeness_state(score: Column) -> Column:
    return first_match([(score >= 85, "COMPLETE"), (score >= 60, "USABLE"), (score >= 30, "PARTIAL")], "LEAD_ONLY")


def source_health(items: Column, previous: Column, failures: Column, manual: Column) -> Column:
    return first_match([(yes(manual), "NEEDS_ATTENTION"), (yes(failures > 0), "DEGRADED"), (yes((items == 0) & (previous > 0)), "SUSPECT_ZERO_RESULTS")], "ACTIVE")


def response_action(status: Column, body: Column) -> Column:
    """What keeps a fetched page from being read, null if nothing does."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return first_match(
        [
            (status == 412, "VERIFICATION_REQUIRED"),
            ((status == 401) | contains_any(low, ("请登录", "login required")), "LOGIN_REQUIRED"),
            (contains_any(low, ("验证码", "captcha")), "CAPTCHA"),
            (contains_any(low, ("安全验证", "access verification")), "VERIFICATION_REQUIRED"),
        ]
    )


def result_mode(explicit: Column, phrase: Column) -> Column:
    return F.coalesce(explicit, F.when(contains_any(phrase, ("完整结果", "全部结果", "完整")), "FULL"), F.lit("DELTA"))


#: The levels of official sources.
OFFICIAL_LEVELS = ("A", "B")


def project_blocker(reason: Column, status: Column, source_level: Column, has_window: Column) -> Column:
    """What keeps a project's candidate from being taken up; null if nothing. ``has_window``: a qualification, registration or document deadline is known."""
    unknown = status == "UNKNOWN"
    return first_match(
        [
            (reason == "UNKNOWN_CONFLICTING_DATES", "DATE_CONFLICT"),
            (reason == "UNKNOWN_NEEDS_CODEX_REVIEW", "SOURCE_INCOMPLETE"),
            (unknown & ~yes(has_window), "MISSING_PARTICIPATION_DEADLINE"),
            (unknown, "SOURCE_INCOMPLETE"),
            (F.upper(source_level).isin("D", "E"), "SECONDARY_ONLY"),
        ]
    )


def project_verification(source_level: Column, has_text: Column) -> Column:
    """Whether an official source speaks for a project, and with a text; no level counts as the lowest."""
    official = F.upper(F.coalesce(source_level, F.lit("E"))).isin(*OFFICIAL_LEVELS)
    return first_match([(official & yes(has_text), "OFFICIAL_VERIFIED"), (official, "OFFICIAL_PARTIAL")], "SECONDARY_ONLY")


def project_state(score: Column) -> Column:
    """The state of a project's candidate by its completeness."""
    return first_match([(score >= 85, "COMPLETE"), (score >= 60, "USABLE"), (score >= 30, "PARTIAL")], "NEW")
