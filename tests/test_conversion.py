"""Files to packages in one run: office, text and broken files made here."""

import io
import json
import zipfile

import pytest

from lexmill.config import Limits
from lexmill.plans import conversion

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = '<Types><Default Extension="jpeg" ContentType="image/jpeg"/><Default Extension="xml" ContentType="application/xml"/></Types>'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in {"[Content_Types].xml": TYPES, **parts}.items():
            z.writestr(name, data)
    return out.getvalue()


def links(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{R}/{kind}" Target="{t}"/>' for i, (kind, t) in enumerate(rows, 1)) + "</Relationships>"


def word_file():
    run = lambda t, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{t}</w:t></w:r>"
    item = lambda t, level=0, num=1: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>{run(t)}</w:p>'
    cell = lambda *ps: "<w:tc>" + "".join(f"<w:p>{p}</w:p>" for p in ps) + "</w:tc>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("Part", "<w:b/>")}</w:p><w:p/>'
        f'<w:p>{run("a ")}{run("b", "<w:bCs/>")}<w:hyperlink r:id="r1">{run("x", "<w:b/>")}{run("y")}</w:hyperlink><w:hyperlink r:id="none">{run("z", "<w:i/>")}</w:hyperlink></w:p>'
        + item("one") + item("deep", 1) + item("bullet", 0, 2) + item("two") + item("again", 1)
        + f'<w:tbl><w:tr>{cell(run("h|", "<w:b/>"), run("i"))}{cell(run("k"))}</w:tr><w:tr>{cell(run("1"))}</w:tr></w:tbl>'
        + item("three") + f"<w:p>{run('text')}</w:p>" + item("new") + "<w:p><w:pPr><w:pPrChange/></w:pPr></w:p>"
    )
    level = lambda n, kind: f'<w:lvl w:ilvl="{n}"><w:numFmt w:val="{kind}"/></w:lvl>'
    numbers = f'<w:abstractNum w:abstractNumId="7">{level(0, "decimal")}{level(1, "lowerLetter")}</w:abstractNum><w:abstractNum w:abstractNumId="8">{level(0, "bullet")}</w:abstractNum>'
    numbers += "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{a}"/></w:num>' for n, a in ((1, 7), (2, 8)))
    return packed(
        {
            "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>',
            "word/numbering.xml": f'<w:numbering xmlns:w="{W}">{numbers}</w:numbering>',
            "word/_rels/document.xml.rels": links(("hyperlink", "http://a.b/(c)"), ("image", "media/p.jpeg"), ("image", "media/q.xml"), ("footnotes", "footnotes.xml"), ("package", "embeddings/e.xlsx")),
            "word/media/p.jpeg": b"\xff\xd8p",
            "word/media/q.xml": b"q",
        }
    )


WORD = """# doc

## Part
a **b**[xy](http://a.b/%28c%29)*z*
1. one
1. deep
- bullet
2. two
1. again
| **h\\|** i | k |
| --- | --- |
| 1 |  |

3. three
text
1. new

![图片 1](assets/image_001.jpg)
![图片 2](assets/image_002.png)
"""


def sheet_file():
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row hidden="1"><c r="B2" s="1"><f>1+1</f><v>45000.75</v></c></row><row/>'
    many = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 52))
    sheet = lambda data, more="": f'<worksheet xmlns="{S}"><sheetData>{data}</sheetData>{more}</worksheet>'
    names = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(("One", "Gone", "A/B", "Empty"), 1))
    return packed(
        {
            "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": links(*[("worksheet", f"worksheets/s{i}.xml") for i in range(1, 5)]),
            "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><r><t>h</t></r><r><t>i</t></r></si></sst>',
            "xl/styles.xml": f'<styleSheet xmlns="{S}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/s1.xml": sheet(rows, '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>'),
            "xl/worksheets/_rels/s1.xml.rels": links(("drawing", "../drawings/d.xml")),
            "xl/drawings/_rels/d.xml.rels": links(("chart", "../charts/c.xml")),
            "xl/worksheets/s3.xml": sheet(many),
            "xl/worksheets/s4.xml": sheet(""),
        }
    )


def sheet_text():
    rows = "| 1 |\n| --- |\n" + "".join(f"| {i} |\n" for i in range(2, 51))
    return (
        "# book\n\n<!-- SHEET_START: One -->\n## One\n\n| hi |  | TRUE |\n| --- | --- | --- |\n|  | 2023-03-15 |  |\n<!-- SHEET_END -->\n"
        "<!-- SHEET_START: Gone -->\n\n---\n\n## Gone\n\n"
        f"<!-- SHEET_START: A/B -->\n\n---\n\n## A/B\n\n{rows}\n<!-- TABLE_TRUNCATED: 工作表「A/B」共有 51 行，仅展示前 50 行预览，完整数据见 tables/ 目录 -->\n> *表格已截断：共 51 行，仅展示前 50 行*\n<!-- SHEET_END -->\n"
        "<!-- SHEET_START: Empty -->\n\n---\n\n## Empty\n\n<!-- SHEET_END -->\n"
    )


def slide_file():
    shape = lambda *ps: "<p:sp><p:txBody>" + "".join(f"<a:p><a:r><a:t>{p}</a:t></a:r></a:p>" for p in ps) + "</p:txBody></p:sp>"
    tree = lambda tag, *shapes: f'<p:{tag} xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:{tag}>'
    return packed(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst>' + "".join(f'<p:sldId r:id="r{i}"/>' for i in (1, 2, 3)) + "</p:sldIdLst></p:presentation>",
            "ppt/_rels/presentation.xml.rels": links(("slide", "slides/s1.xml"), ("slide", "slides/missing.xml"), ("slide", "slides/s3.xml")),
            "ppt/slides/s1.xml": tree("sld", shape(" a ", "  ", ""), shape("b")),
            "ppt/slides/_rels/s1.xml.rels": links(("image", "../media/i.jpeg"), ("notesSlide", "../notesSlides/n.xml"), ("chart", "../charts/c.xml")),
            "ppt/notesSlides/n.xml": tree("notes", shape("note", " ")),
            "ppt/slides/s3.xml": tree("sld"),
            "ppt/slides/_rels/s3.xml.rels": links(("image", "../media/i.jpeg"), ("oleObject", "../embeddings/o.bin")),
            "ppt/media/i.jpeg": b"\xff\xd8i",
        }
    )


SLIDES = """# show

<!-- SLIDE_START: 1 -->
## 第 1 页

![幻灯片 1 图片](assets/image_001.jpg)
a

b

> **备注**
> note
<!-- SLIDE_END: 1 -->

<!-- SLIDE_START: 2 -->
## 第 2 页

![幻灯片 2 图片](assets/image_002.jpg)
<!-- SLIDE_END: 2 -->

"""


@pytest.fixture(scope="module")
def rows(spark):
    files = {"/in/doc.docx": word_file(), "/in/d/book.xlsx": sheet_file(), "/in/show.pptx": slide_file(), "/in/t.txt": "中文".encode("gb18030"), "/in/bad.docx": b"junk", "/in/old.xls": b"x", "/in/scan.pdf": b"x", "/in/x.zip": b"x", "/in/empty.txt": b""}
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def test_each_parser(rows):
    got = {r["path"]: r for r in conversion.default_parsers().parse(rows).collect()}
    assert len(got) == 9
    assert got["/in/doc.docx"]["raw_md"] == WORD
    assert got["/in/d/book.xlsx"]["raw_md"] == sheet_text()
    assert got["/in/show.pptx"]["raw_md"] == SLIDES
    assert got["/in/t.txt"]["raw_md"] == "# t\n\n中文"
    codes = {p: [w["code"] for w in r["warnings"]] for p, r in got.items()}
    assert codes["/in/doc.docx"] == ["W_FOOTNOTE_LOST", "W_REVISION_LOST", "W_EMBEDDED_OBJECT_LOST"]
    assert codes["/in/d/book.xlsx"] == ["W_MERGED_CELLS", "W_FORMULA_LOST", "W_HIDDEN_ROW", "W_CHART_LOST", "W_TABLE_TRUNCATED"]
    assert codes["/in/show.pptx"] == ["W_CHART_LOST", "W_EMBEDDED_OBJECT_LOST"]
    assert [(a["name"], bytes(a["data"])) for a in got["/in/doc.docx"]["assets"]] == [("image_001.jpg", b"\xff\xd8p"), ("image_002.png", b"q")]
    assert [t["name"] for t in got["/in/d/book.xlsx"]["tables"]] == ["A_B.csv"]
    assert got["/in/d/book.xlsx"]["tables"][0]["csv"] == "".join(f"{i}\n" for i in range(1, 52))
    assert (got["/in/d/book.xlsx"]["sheet_count"], got["/in/show.pptx"]["slide_count"]) == (4, 2)
    assert {p for p, r in got.items() if r["error"]} == {"/in/bad.docx", "/in/old.xls", "/in/scan.pdf", "/in/x.zip"}


def test_run(spark, rows, tmp_path):
    state, written = conversion.run(rows, str(tmp_path), Limits(package_mode="HybridPackage"), root="/in", at="2024-01-01T00:00:00+00:00")
    names = {r["path"] for r in written.collect()}
    assert {r["path"] for r in state.where("status = 'Failed' and error is not null").collect()} == {"/in/bad.docx", "/in/old.xls", "/in/scan.pdf", "/in/x.zip"}
    assert {"doc/document.md", "doc/assets/image_001.jpg", "d/book/tables/A_B.csv", "show/.meta.json", "t/.quality_report.json", "empty/document.md"} <= names
    assert len(names) == 5 * 3 + 2 + 1 + 2 and all((tmp_path / n).exists() for n in names)
    meta = json.loads((tmp_path / "d/book/.meta.json").read_text())
    assert (meta["sheetCount"], meta["sourceFile"], meta["convertedAt"]) == (4, "book.xlsx", "2024-01-01T00:00:00+00:00") and "pageCount" not in meta
    report = json.loads((tmp_path / "d/book/.quality_report.json").read_text())
    assert report["overallScore"] == pytest.approx(1 - 0.03 - 0.02 - 0.02 - 0.05 - 0.05) and report["warnings"][2] == {"code": "W_HIDDEN_ROW", "severity": "low", "message": "工作表「One」包含 1 个隐藏行，未提取", "location": "One"}
    md = (tmp_path / "d/book/document.md").read_text("utf-8-sig")
    assert "sheet_count: 4\nocr_used: false\nconverted_at:" in md and "<!-- WARNING: [W_MERGED_CELLS] 工作表「One」包含合并单元格，仅保留首个单元格的值 @ One -->" in md


def test_stop_at_the_first_error_and_no_files(spark, rows, tmp_path):
    with pytest.raises(RuntimeError):
        conversion.run(rows, str(tmp_path), Limits(continue_on_error=False))
    assert not list(tmp_path.glob("*.md"))
    assert conversion.convert(rows.limit(0)).count() == 0
