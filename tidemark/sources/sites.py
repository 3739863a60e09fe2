"""The sites that are known, as configuration: how their landed answers are read. Nothing here asks a site for anything."""

from __future__ import annotations

from tidemark.operators.landing import Connector
from tidemark.sources.select import Items

# Fixed values, in the order in which the sites are registered: base urls, paths of lists, names of record fields, urls of details and shapes of links.
_POWERCHINA = {
    "projectname": ("projectName", "projectname"), "projectnum": ("projectNumber", "projectNum"), "tendercode": ("tenderCode", "tenderNumber"), "owner": ("procuringEntity", "tenderer"),
    "purchaser": ("procuringEntity", "purchaser"), "published_at": ("publishTime", "createTime"), "registration_deadline": ("registrationDeadline",), "bid_deadline": ("submissionDeadline",),
    "open_time": ("bidOpenTime",), "powerchina_id": ("id",),
}
_DATANG = {
    "projectname": ("projectname", "project_name", "message_title"), "projectnum": ("projectnum", "project_no", "message_no"), "tendercode": ("tendercode", "tender_no", "message_no"),
    "owner": ("bid_tenderer", "tenderer", "owner"), "purchaser": ("bid_tenderer", "purchaser"), "tenderer": ("bid_tenderer", "tenderer"), "published_at": ("publish_time", "published_at"),
    "bid_deadline": ("deadline", "bid_deadline"), "open_time": ("open_time",),
}
SITES = {
    "ccgp": Connector("ccgp", "html", lists=("/cggg/dfgg/gkzb/", "/cggg/dfgg/jzxcs/"), page=Items(around="parent", link_like=r"/cggg/.*\.[hH][tT][mM][lL]?$")),
    "ggzy_national": Connector("ggzy_national", lists=("/deal/dealList.html?HEADER_DEAL_TYPE=01",), filtered=True),
    "cebpubservice": Connector(
        "cebpubservice", "html", page=Items(item="a[href*=urlOpen]", around="parent", id_pattern=r"urlOpen\(['\"]([^'\"]+)", detail="https://ctbpsp.com/#/bulletinDetail?uuid={}&inpvalue=&dataSource=0&tenderAgency=")
    ),
    "shaanxi_ggzy": Connector("shaanxi_ggzy", lists=("/jydt/001001/001001001/001001001001/subPage.html", "/jydt/001001/001001004/001001004001/subPage.html")),
    "gansu_ggzy": Connector("gansu_ggzy", "html", page=Items(around="parent")),
    "gsei": Connector("gsei", "html", lists=("/html/1336/", "/html/1662/", "/html/1657/"), page=Items(around="parent", link_like=r"(?i)/html/\d+/\d{4}-\d{2}-\d{2}/content-\d+\.html")),
    "qinghai_ggzy": Connector("qinghai_ggzy", lists=("/ggzy/jyxx/001001/001001001/transinfo_list.html", "/ggzy/jyxx/001002/001002001/transinfo_list.html")),
    "ningxia_ggzy": Connector("ningxia_ggzy", lists=("/dzjy/001001/001001001/trade_infomation.html", "/dzjy/001001/001001002/trade_infomation.html")),
    "ccgp_ningxia": Connector(
        "ccgp_ningxia", "html", lists=("contents/CGGG/ZBGG/index.jsp?cid=2028&sid=2000", "contents/CGGG/ZHBGG/index.jsp?cid=2029&sid=2000", "contents/CGGG/GZGG/index.jsp?cid=2027&sid=2000"), page=Items(item="a[href*=content.jsp]", around="parent")
    ),
    "xinjiang_ggzy": Connector("xinjiang_ggzy", lists=("/xinjiangggzy_new/jyxx/001001/trade_info.html",), rewrite=("https://ggzy.xinjiang.gov.cn/jyxx/", "https://ggzy.xinjiang.gov.cn/xinjiangggzy_new/jyxx/")),
    "bingtuan_ggzy": Connector("bingtuan_ggzy", lists=("/jygk/004001/construction_project.html", "/jygk/004002/construction_project.html")),
    "powerchina": Connector(
        "powerchina", lists=("/consult/notice",), fields={"title": ("title", "projectName"), "url": ("id", "systemId"), "published_at": ("publishTime", "createTime")}, detail="https://bid.powerchina.cn/notice/detail?id={}", metadata=_POWERCHINA, filtered=True
    ),
    "chnenergy_e_zhao": Connector(
        "chnenergy_e_zhao", "html", lists=tuple(f"/bidweb/001/00100{a}/00100{a}00{b}/moreinfo.html" for a in (1, 2, 3, 4) for b in (1, 2, 3)), page=Items(item="a.infolink", around="li", title_attribute="title", link_like="(?i)/bidweb/"), filtered=True
    ),
    "datang": Connector(
        "datang", fields={"title": ("message_title", "title"), "url": ("id", "gg_id"), "published_at": ("publish_time", "published_at")}, detail="https://www.cweme.cn/cweme-index/webpage/jsp/zbggDetail.jsp?id={}", metadata=_DATANG, filtered=True
    ),
    "shanxi_changzhi_ggzy": Connector("shanxi_changzhi_ggzy", "html", lists=("/front/notice/list?type=ZBGG&xmlx=JSGC", "/front/notice/list?type=ZBGG&xmlx=ZFCG"), page=Items(item="a[href*='/front/notice/detail']", around="li", title_attribute="title"), filtered=True),
}
