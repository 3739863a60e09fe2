"""File sources and sinks: binary documents, JSON listings, sessions, content-addressed snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an archive that is expanded; members beyond make it an error row, never a silent cut.
ZIP_FILES, ZIP_BYTES = 50, 100 << 20
PARSEABLE = ("html", "htm", "json", "txt", "xml")
OFFICE = ("docx", "xlsx")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def office_text(suffix: str, data: bytes) -> str:
    """Text of a DOCX (a line for each paragraph, table cells included) or XLSX (a line for each row with any value, cells by tabs).

    Raises ValueError for archives beyond the limits, broken ones, and XML with a document type.
    """

    def part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
        body = z.read(name)
        if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
            raise ValueError("UNSAFE_XML")
        return ElementTree.fromstring(body)

    whole = lambda e, tag: "".join(t.text or "" for t in e.iter(tag))
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            if sum(i.file_size for i in z.infolist()) > ZIP_BYTES:
                raise ValueError("ARCHIVE_TOO_LARGE")
            if suffix == "docx":
                return "\n".join(t for t in (whole(p, _WORD + "t") for p in part(z, "word/document.xml").iter(_WORD + "p")) if t.strip())
            shared = [whole(e, _SHEET + "t") for e in part(z, "xl/sharedStrings.xml").iter(_SHEET + "si")] if "xl/sharedStrings.xml" in names else []
            sheets = sorted((n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n))
            lines = []
            for name in sheets:
                for row in part(z, name).iter(_SHEET + "row"):
                    cells = []
                    for c in row.iter(_SHEET + "c"):
                        value = c.findtext(_SHEET + "v")
                        cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else whole(c, _SHEET + "t") if c.get("t") == "inlineStr" else value or "")
                    if any(x.strip() for x in cells):
                        lines.append("\t".join(cells))
            return "\n".join(lines)
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError, NotImplementedError, RuntimeError) as error:
        raise ValueError("BROKEN_DOCUMENT") from error


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, content_hash, text, error of files below a path. Text is decoded as UTF-8, else GB18030, else Big5; DOCX and XLSX are unpacked. Empty files give no row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), F.sha2("content", 256).alias("content_hash"), "content")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, errors = [], []
            for suffix, data in zip(p["suffix"], p["content"], strict=True):
                text, error = None, None if suffix in (*PARSEABLE, *OFFICE) else "UNSUPPORTED_TYPE"
                if suffix in OFFICE:
                    try:
                        text = office_text(suffix, bytes(data))
                    except ValueError as broken:
                        error = str(broken)
                    texts.append(text)
                    errors.append(error)
                    continue
                for code in ("utf-8-sig", "gb18030", "big5") if error is None else ():
                    try:
                        text = bytes(data).decode(code)
                        break
                    except UnicodeDecodeError:
                        continue
                if error is None and text is None:
                    text = bytes(data).decode("utf-8", "replace")
                texts.append(text)
                errors.append(error)
            yield p[["path", "suffix", "content_hash"]].assign(text=texts, error=errors)

    return named.mapInPandas(decode, "path string, suffix string, content_hash string, text string, error string")


def texts_of(suffix: str, data: bytes) -> list[tuple[str | None, str | None, str | None]]:
    """(member, text, error) of a file's bytes: one without a member, or one for each member of an archive that is expanded; a fault of the whole file is one row."""
    if suffix == "zip":
        return [(member, text, error) for _, member, _, text, error in _expanded("", data, False)]
    if suffix in OFFICE:
        try:
            return [(None, office_text(suffix, data), None)]
        except ValueError as broken:
            return [(None, None, str(broken))]
    if suffix not in PARSEABLE:
        return [(None, None, "UNSUPPORTED_TYPE")]
    for code in ("utf-8-sig", "gb18030", "big5"):
        try:
            return [(None, data.decode(code), None)]
        except UnicodeDecodeError:
            continue
    return [(None, data.decode("utf-8", "replace"), None)]


def landed_texts(files: DataFrame) -> DataFrame:
    """content_hash, suffix, member, text, error of landed files (content_hash, suffix, content), read on the executors."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for key, suffix, data in zip(p["content_hash"], p["suffix"], p["content"], strict=True):
                yield pd.DataFrame([(key, suffix, *row) for row in texts_of(suffix or "", bytes(data))], columns=["content_hash", "suffix", "member", "text", "error"])

    return files.select("content_hash", "suffix", "content").mapInPandas(read, "content_hash string, suffix string, member string, text string, error string")


def member_fault(info: zipfile.ZipInfo, seen: set[str]) -> str | None:
    """Why a member of an archive isn't expanded; None if it may be. ``seen``: names taken before."""
    steps = info.filename.replace("\\", "/").split("/")
    if info.filename.startswith(("/", "\\")) or ".." in steps or ":" in steps[0] or (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "UNSAFE_MEMBER"
    if "/".join(steps).lower() in seen:
        return "DUPLICATE_MEMBER"
    return None if steps[-1].rpartition(".")[2].lower() in (*PARSEABLE, "pdf", "docx", "xlsx") else "UNSUPPORTED_TYPE"


def _expanded(archive: str, data: bytes, rejected: bool) -> list[tuple]:
    rows: list[tuple] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = [i for i in z.infolist() if not i.is_dir()]
            if len(entries) > ZIP_FILES or sum(i.file_size for i in entries) > ZIP_BYTES:
                raise ValueError("ARCHIVE_TOO_LARGE")
            seen: set[str] = set()
            for i in entries:
                fault = member_fault(i, seen)
                seen.add(i.filename.replace("\\", "/").lower())
                if rejected or fault:
                    rows += [(archive, i.filename, None, None, fault)] if rejected and fault else []
                    continue
                body, suffix, text, error = z.read(i), i.filename.rpartition(".")[2].lower(), None, None
                try:
                    text = body.decode("utf-8", "replace") if suffix in PARSEABLE else office_text(suffix, body) if suffix in OFFICE else None
                except ValueError as broken:
                    error = str(broken)
                rows.append((archive, i.filename, len(body), text, error))
    except (zipfile.BadZipFile, ValueError, RuntimeError) as error:
        return [(archive, None, None, None, str(error))]
    return rows


def zip_members(spark: SparkSession, path: str, rejected: bool = False) -> DataFrame:
    """archive, member, size, text, error of the parseable members of zip files; broken or oversized archives give an error row.

    With ``rejected`` the members that weren't expanded instead, and why: unsafe names and links, repeated names, other types.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for archive, data in zip(p["path"], p["content"], strict=True):
                yield pd.DataFrame(_expanded(archive, bytes(data), rejected), columns=["archive", "member", "size", "text", "error"]).astype({"size": "Int64"})

    return raw.mapInPandas(members, "archive string, member string, size long, text string, error string")


def replayed(spark: SparkSession, path: str, snapshots: DataFrame, announcement_id: object = None, source_id: object = None) -> DataFrame:
    """Snapshots (snapshot_id, file_path, announcement_id, source_id, url, captured_at) with the text of their files, for extraction without the network.

    All, or those of an announcement or a source; a file that is gone or can't be read is a row with an error. ``place``: the order of capture.
    """
    wanted = snapshots
    for column, value in (("announcement_id", announcement_id), ("source_id", source_id)):
        if value is not None:
            wanted = wanted.where(F.col(column) == F.lit(value))
    read = documents(spark, path).select(F.regexp_replace("path", "^file:/+", "/").alias("file_path"), "content_hash", "text", "error")
    joined = wanted.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/")).join(read, "file_path", "left")
    missing = F.when(F.col("content_hash").isNull(), "MISSING_FILE").otherwise(F.col("error"))
    return joined.withColumn("error", missing).withColumn("place", F.struct("captured_at", "snapshot_id"))


def json_listing(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """Items of JSON search answers, wherever the envelope keeps them; broken answers give no items."""
    envelope = ("$.data.records", "$.records", "$.data.items", "$.items", "$.rows", "$.list", "$.data", "$.result", "$.content", "$")
    found = F.coalesce(*[F.when(F.startswith(F.get_json_object(column, p), F.lit("[")), F.get_json_object(column, p)) for p in envelope])
    items = raw.withColumn("_items", F.from_json(found, f"array<struct<{schema}>>"))
    return items.select(*[c for c in raw.columns if c != column], F.explode("_items").alias("item")).select(*[c for c in raw.columns if c != column], "item.*")


def attachment_links(html: DataFrame, key: str, column: str) -> DataFrame:
    """key, href, label of links to documents; of equal hrefs one label stays, the greatest."""
    pattern = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+\.(?:pdf|docx?|xlsx?|zip|rar)(?:\?[^\"']*)?)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(column, F.lit(pattern), F.lit(2)).alias("label"))
    links = html.select(key, F.explode(pairs).alias("x")).select(key, "x.href", F.trim(F.regexp_replace("x.label", "<[^>]*>", "")).alias("label"))
    return links.groupBy(key, "href").agg(F.max("label").alias("label"))


def provider_fallback(results: DataFrame, key: str, provider: str, priority: str, failed: str) -> DataFrame:
    """The rows of the first provider of each key, by priority, that didn't fail, even if it found nothing (rows with null ``url``)."""
    first = results.where(f"not {failed}").groupBy(key).agg(F.min(F.struct(priority, provider)).alias("best"))
    return results.join(first, key).where(F.col(provider) == F.col("best")[provider]).where("url is not null").drop("best")


def snapshots(pages: DataFrame, body: str, order: str) -> DataFrame:
    """One row for each content hash: the first in order; later urls with the same bytes point to it."""
    return pages.groupBy(F.sha2(body, 256).alias("content_hash")).agg(F.min_by(F.struct(*[c for c in pages.columns if c != body]), order).alias("first")).select("content_hash", "first.*")


def write_version(df: DataFrame, path: str, version: int) -> str:
    """A new version of a table beside the old ones; readers of an old one are never disturbed."""
    target = f"{path.rstrip('/')}/v={version:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_session(results: DataFrame, path: str) -> None:
    """Results as JSON lines, in parallel."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_report(results: DataFrame, path: str, columns: list[str]) -> None:
    """Results as CSV with a header."""
    results.select(*columns).write.mode("overwrite").option("header", True).csv(path)


#: The columns of an export and their headings.
EXPORTED = {
    "province": "省", "city": "市", "county": "县/旗", "project_name": "项目名称", "owner": "招标人", "project_type": "项目类型", "scale": "规模", "budget": "预算", "registration_deadline": "报名截止", "document_deadline": "文件截止",
    "bid_deadline": "投标截止", "open_time": "开标", "remaining_hours": "剩余小时", "status": "状态", "status_reason": "状态原因", "source_level": "来源等级", "source_name": "来源", "source_url": "原始链接",
}
#: Rows of a worksheet below its headings.
SHEET_ROWS = 1_048_575


def write_workbook(results: DataFrame, path: str, columns: dict[str, str] | None = None) -> int:
    """Results as a workbook of one sheet, streamed row by row; returns the rows written. Columns that the results lack are empty.

    A result of more rows than a sheet holds is an error, before anything is written.
    """
    from xml.sax.saxutils import escape

    columns = columns or EXPORTED
    if results.count() > SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows; write a table instead")
    rows = results.select(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if dict(results.dtypes)[c].startswith("timestamp") else F.col(c).cast("string")).alias(c) if c in results.columns else F.lit(None).cast("string").alias(c) for c in columns])
    line = lambda cells: "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x or "")}</t></is></c>' for x in cells) + "</row>"
    kind, n = "http://schemas.openxmlformats.org", 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{main}.worksheet+xml"/></Types>')
        relation = f"{kind}/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="r1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{kind}/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets><sheet name="projects" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{kind}/spreadsheetml/2006/main"><sheetData>{line(columns.values())}'.encode())
            for r in rows.toLocalIterator():
                sheet.write(line(r).encode())
                n += 1
            sheet.write(b"</sheetData></worksheet>")
    return n
