"""Office documents from archives built here."""

import zipfile

from tidemark.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_office(spark, tmp_path):
    archive(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>项目</w:t></w:r><w:r><w:t>名称</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>"})
    sheet = f'<worksheet {S}><sheetData><row><c t="s"><v>1</v></c><c><v>3.5</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'
    archive(tmp_path / "b.xlsx", {"xl/sharedStrings.xml": f"<sst {S}><si><t>a</t></si><si><r><t>预</t></r><r><t>算</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    archive(tmp_path / "c.docx", {"word/document.xml": "<!DOCTYPE x [<!ENTITY y 'z'>]><x>&y;</x>"})
    (tmp_path / "d.xlsx").write_bytes(b"no archive")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(b"")  # Spark lists no empty files
    got = {r["path"][-6:]: (r["text"], r["error"]) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {
        "a.docx": ("项目名称\n甲", None), "b.xlsx": ("预算\t3.5\nx", None), "c.docx": (None, "UNSAFE_XML"), "d.xlsx": (None, "BROKEN_DOCUMENT"),
        "/e.pdf": (None, "UNSUPPORTED_TYPE"),
    }
    archive(tmp_path / "z.zip", {"in/a.docx": (tmp_path / "a.docx").read_bytes(), "../b.docx": b"", "n.txt": "hi", "g.xlsx": b"bad"})
    rows = {r["member"]: (r["text"], r["error"]) for r in files.zip_members(spark, str(tmp_path)).collect()}
    assert rows == {"in/a.docx": ("项目名称\n甲", None), "n.txt": ("hi", None), "g.xlsx": (None, "BROKEN_DOCUMENT")}
