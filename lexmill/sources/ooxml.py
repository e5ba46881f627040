"""Office Open XML parts as rows, with the standard library's zip and XML readers.

Only what is inside the container needs Python; rendering is left to Catalyst.  A file is opened once: the
rows of its body are followed or led by one row that tells what it loses and holds its images (``FILE``).
Legacy files are brought to the new format first.  A broken file gives a row with an error and never ends the job.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexmill.sources.external import modern

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _links(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (type's last word, target) of a part."""
    root = _xml(z, posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels"))
    return {} if root is None else {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], r.get("Target", "")) for r in root}


def _target(part: str, target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))


#: Columns of the one row per file that holds what is not text.
FILE = "warnings array<struct<code:string,message:string,location:string>>, assets array<struct<name:string,data:binary>>, source_size bigint, source_sha256 string, error string"

#: Image types and the extensions of their files; other types: .png.
IMAGE_EXTENSIONS = {"image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/svg+xml": ".svg"}

#: What a file's warnings say.
FOOTNOTES = "Word 文档包含脚注/尾注，暂不支持提取"
COMMENTS = "Word 文档包含批注，暂不支持提取"
REVISIONS = "Word 文档包含 {} 处修订标记，暂不支持提取修订信息"
WORD_EMBEDDED = "Word 文档包含嵌入对象（OLE/包），暂不支持提取"
WORD_IMAGES = "Word 文档包含嵌入式图片，但提取失败"
MERGED = "工作表「{}」包含合并单元格，仅保留首个单元格的值"
FORMULAS = "工作表「{}」包含 {} 个公式单元格，仅提取计算结果"
HIDDEN = "工作表「{}」包含 {} 个隐藏行，未提取"
SHEET_CHART = "工作表「{}」包含图表，暂不支持提取"
SLIDE_CHART = "PPT 演示文稿包含图表，暂不支持提取"
SLIDE_EMBEDDED = "PPT 演示文稿包含嵌入对象，暂不支持提取"
SLIDE_IMAGES = "PPT 演示文稿包含图片，但提取失败"


def _warning(code: str, message: str, location: str | None = None) -> dict:
    return {"code": code, "message": message, "location": location}


def _content_type(z: zipfile.ZipFile, part: str) -> str:
    root = _xml(z, "[Content_Types].xml")
    for e in () if root is None else root:
        if e.get("PartName", "").lstrip("/") == part:
            return e.get("ContentType", "")
    tail = part.rsplit(".", 1)[-1].lower()
    return next((e.get("ContentType", "") for e in (() if root is None else root) if e.get("Extension", "").lower() == tail), "")


def _images(z: zipfile.ZipFile, part: str, first: int) -> tuple[list[dict], int]:
    """The images that a part refers to, named from number ``first`` on, and how many there are; an unreadable one is left out."""
    parts = list(dict.fromkeys(_target(part, t) for kind, t in _links(z, part).values() if kind == "image"))
    parts = [p for p in parts if p in z.namelist()]  # others are links to the outside
    out = []
    for n, p in enumerate(parts, first):
        try:
            out.append({"name": f"image_{n:03d}{IMAGE_EXTENSIONS.get(_content_type(z, p), '.png')}", "data": z.read(p)})
        except (zipfile.BadZipFile, OSError, ValueError):
            continue
    return out, len(parts)


# ---- word processor -------------------------------------------------------------------------

RUNS = "array<struct<text:string,bold:boolean,italic:boolean,strike:boolean,link:string>>"
WORD_SCHEMA = f"path string, elem_no int, style string, num_id string, level int, ordered boolean, runs {RUNS}, rows array<array<array<{RUNS}>>>, {FILE}"
CHANGES = ("rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange")


def _on(properties: ET.Element | None, name: str) -> bool:
    e = None if properties is None else properties.find(W + name)
    return e is not None and e.get(W + "val", "true") not in ("0", "false", "none")


def _formats(z: zipfile.ZipFile) -> dict[tuple[str, int], str]:
    root = _xml(z, "word/numbering.xml")
    if root is None:
        return {}
    abstract = {a.get(W + "abstractNumId"): {int(n.get(W + "ilvl", 0)): n.find(W + "numFmt").get(W + "val") for n in a.iter(W + "lvl") if n.find(W + "numFmt") is not None} for a in root.iter(W + "abstractNum")}
    out = {}
    for n in root.iter(W + "num"):
        ref = n.find(W + "abstractNumId")
        for level, kind in abstract.get(ref.get(W + "val") if ref is not None else None, {}).items():
            out[n.get(W + "numId"), level] = kind
    return out


def _run(r: ET.Element, link: str | None) -> dict | None:
    if any(r.find(W + k) is not None for k in ("footnoteReference", "endnoteReference", "commentReference")):
        return None
    text = "".join(t.text or "" if t.tag == W + "t" else "\t" if t.tag == W + "tab" else "\n" if t.tag == W + "br" else "" for t in r)
    props = r.find(W + "rPr")
    return {"text": text, "bold": _on(props, "b") or _on(props, "bCs"), "italic": _on(props, "i") or _on(props, "iCs"), "strike": _on(props, "strike"), "link": link}


def _runs(p: ET.Element, links: dict[str, tuple[str, str]]) -> list[dict]:
    """The runs of a paragraph; a link that leads somewhere is one plain run."""
    out: list[dict | None] = []
    for c in p:
        if c.tag == W + "r":
            out.append(_run(c, None))
        elif c.tag == W + "hyperlink":
            ref, anchor = c.get(R + "id"), c.get(W + "anchor")
            url = links.get(ref, ("", None))[1] if ref else f"#{anchor}" if anchor else None
            inside = [r for r in (_run(r, None) for r in c.findall(W + "r")) if r]
            text = "".join(r["text"] for r in inside)
            out += [{"text": text, "bold": False, "italic": False, "strike": False, "link": url}] if url and text else inside
    return [r for r in out if r and r["text"]]


def word_rows(path: str, content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z, "word/document.xml").find(W + "body")
        links, formats = _links(z, "word/document.xml"), _formats(z)
        kinds = {kind for kind, _ in links.values()}
        assets, images = _images(z, "word/document.xml", 1)
    changes = sum(1 for e in body.iter() if e.tag in {W + c for c in CHANGES})
    lost = [
        _warning("W_FOOTNOTE_LOST", FOOTNOTES) if kinds & {"footnotes", "endnotes"} else None,
        _warning("W_COMMENT_LOST", COMMENTS) if "comments" in kinds else None,
        _warning("W_REVISION_LOST", REVISIONS.format(changes)) if changes else None,
        _warning("W_EMBEDDED_OBJECT_LOST", WORD_EMBEDDED) if kinds & {"oleObject", "package"} else None,
        _warning("W_IMG_LOST", WORD_IMAGES) if images and not assets else None,
    ]
    yield {"elem_no": -1, "warnings": [w for w in lost if w], "assets": assets}
    for at, e in enumerate(x for x in body if x.tag in (W + "p", W + "tbl")):
        row: dict = {"elem_no": at, "runs": []}
        if e.tag == W + "tbl":
            row["rows"] = [[[_runs(p, links) for p in c.findall(W + "p")] for c in r.findall(W + "tc")] for r in e.findall(W + "tr")]
        else:
            props = e.find(W + "pPr")
            if props is not None:
                style, number = props.find(W + "pStyle"), props.find(W + "numPr")
                row["style"] = None if style is None else style.get(W + "val")
                if number is not None:
                    ref, level = number.find(W + "numId"), number.find(W + "ilvl")
                    row["num_id"] = "0" if ref is None else ref.get(W + "val", "0")  # 0: an item of no list
                    row["level"] = 0 if level is None else int(level.get(W + "val", 0))
                    row["ordered"] = formats.get((row["num_id"], row["level"]), "").lower() not in ("", "bullet", "none")
            row["runs"] = _runs(e, links)
        yield row


# ---- sheets ---------------------------------------------------------------------------------

CELL_SCHEMA = f"path string, sheet_no int, sheet string, seq int, row int, ref string, kind string, raw string, format_id int, format_code string, {FILE}"


def _sheet_losses(z: zipfile.ZipFile, name: str, part: str, root: ET.Element) -> list[dict]:
    formulas = sum(1 for c in root.iter(S + "c") if c.find(S + "f") is not None)
    hidden = sum(1 for r in root.iter(S + "row") if r.get("hidden") in ("1", "true"))
    drawings = [_target(part, t) for kind, t in _links(z, part).values() if kind == "drawing"]
    chart = any(kind == "chart" for d in drawings for kind, _ in _links(z, d).values())
    lost = [
        _warning("W_MERGED_CELLS", MERGED.format(name), name) if root.find(f"{S}mergeCells/{S}mergeCell") is not None else None,
        _warning("W_FORMULA_LOST", FORMULAS.format(name, formulas), name) if formulas else None,
        _warning("W_HIDDEN_ROW", HIDDEN.format(name, hidden), name) if hidden else None,
        _warning("W_CHART_LOST", SHEET_CHART.format(name), name) if chart else None,
    ]
    return [w for w in lost if w]


def sheet_rows(path: str, content: bytes) -> Iterator[dict]:
    """A row per sheet (kind ``sheet``, or ``none`` if its part is missing), row (``row``) and cell; then the file's row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, links = _xml(z, "xl/workbook.xml"), _links(z, "xl/workbook.xml")
        strings, styles = _xml(z, "xl/sharedStrings.xml"), _xml(z, "xl/styles.xml")
        shared = [] if strings is None else ["".join(t.text or "" for t in si.iter(S + "t")) for si in strings.iter(S + "si")]
        codes = {} if styles is None else {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(S + "numFmt")}
        formats = [] if styles is None or styles.find(S + "cellXfs") is None else [int(x.get("numFmtId", 0)) for x in styles.find(S + "cellXfs")]
        for no, sheet in enumerate(book.iter(S + "sheet")):
            target = links.get(sheet.get(R + "id"))
            part = _target("xl/workbook.xml", target[1]) if target else ""
            root = _xml(z, part)
            here = {"sheet_no": no, "sheet": sheet.get("name") or "工作表"}
            data = None if root is None else root.find(S + "sheetData")
            yield {**here, "seq": -1, "kind": "none" if data is None else "sheet", "warnings": [] if data is None else _sheet_losses(z, here["sheet"], part, root)}
            last, seq = -1, 0
            for r in () if data is None else data.findall(S + "row"):
                at = int(r.get("r")) - 1 if r.get("r") else last + 1
                last = max(last, at)
                yield {**here, "seq": seq, "row": at, "kind": "row"}
                for seq, c in enumerate(r.findall(S + "c"), seq + 1):  # noqa: B020  numbers go on from row to row
                    v, kind, style = c.find(S + "v"), c.get("t"), int(c.get("s", 0))
                    number = formats[style] if style < len(formats) else None
                    raw = "".join(t.text or "" for t in c.iter(S + "t")) if kind == "inlineStr" else None if v is None else v.text
                    if kind == "s" and raw is not None:
                        i = int(raw) if raw.isdecimal() else 0
                        kind, raw = "inlineStr", shared[i] if i < len(shared) else ""
                    yield {**here, "seq": seq, "row": at, "ref": c.get("r") or "", "kind": kind or "n", "raw": raw, "format_id": number, "format_code": codes.get(number)}
    yield {"sheet_no": -1, "seq": -1, "kind": "file"}


# ---- slides ---------------------------------------------------------------------------------

SLIDE_SCHEMA = f"path string, slide_no int, para_no int, kind string, text string, {FILE}"


def slide_rows(path: str, content: bytes) -> Iterator[dict]:
    """A row per slide (kind ``slide``), image (its name), paragraph and line of notes; then the file's row."""
    assets: list[dict] = []
    kinds: set[str] = set()
    images = 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        show, links = _xml(z, "ppt/presentation.xml"), _links(z, "ppt/presentation.xml")
        for no, ref in enumerate(show.iter(P + "sldId")):
            part = links.get(ref.get(R + "id"))
            name = _target("ppt/presentation.xml", part[1]) if part else ""
            root = _xml(z, name)
            if root is None:
                continue
            own = _links(z, name).values()
            kinds |= {kind for kind, _ in own}
            yield {"slide_no": no, "para_no": -1, "kind": "slide"}
            found, n = _images(z, name, images + 1)
            images, at = images + n, 0
            for at, asset in enumerate(found, 1):
                yield {"slide_no": no, "para_no": at, "kind": "image", "text": asset["name"]}
            assets += found
            sources = [("text", root)] + [("notes", n) for kind, t in own if kind == "notesSlide" and (n := _xml(z, _target(name, t))) is not None]
            for kind, tree in sources:
                for p in (p for shape in tree.iter(P + "sp") for b in shape.iter(P + "txBody") for p in b.findall(A + "p")):
                    text = "".join(t.text or "" for r in p.findall(A + "r") for t in r.findall(A + "t"))
                    for line in [text] if kind == "text" else text.strip().split("\n"):
                        if line if kind == "text" else line.strip():
                            at += 1
                            yield {"slide_no": no, "para_no": at, "kind": kind, "text": line.strip()}
    lost = [
        _warning("W_IMG_LOST", SLIDE_IMAGES) if images and not assets else None,
        _warning("W_CHART_LOST", SLIDE_CHART) if "chart" in kinds else None,
        _warning("W_EMBEDDED_OBJECT_LOST", SLIDE_EMBEDDED) if kinds & {"oleObject", "package"} else None,
    ]
    yield {"slide_no": -1, "para_no": -1, "kind": "file", "warnings": [w for w in lost if w], "assets": assets}


#: Rows of a file that are sent at once.
ROWS = 4096
#: Columns that the row for the whole file has, by the column that marks it.
MARKS = {"elem_no": -1, "sheet_no": -1, "slide_no": -1}


def file_rows(path: str, content: bytes, rows, mark: str) -> list[dict]:
    """The rows of one file; if it can't be read whole only the file's row, with an error."""
    facts = {"path": path, "source_size": len(content), "source_sha256": hashlib.sha256(content).hexdigest() if content else None}
    try:
        new, error = modern(path, content)
        out = [{**r, "path": path} for r in rows(path, new)] if error is None else [{mark: -1, "kind": "file", "error": error}]
    except Exception as e:  # noqa: BLE001  one file's failure is its own row
        out = [{mark: -1, "kind": "file", "error": f"{type(e).__name__}: {e}"}]
    for r in out:
        if r[mark] == -1:
            r.update(facts)
    return out


def extract(files: DataFrame, rows, schema: str) -> DataFrame:
    """The rows of each file of ``files`` (path, content)."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    mark = next(c for c in MARKS if c in arrow.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = file_rows(path, held.as_py() or b"", rows, mark)
                for at in range(0, len(out), ROWS):
                    yield pa.RecordBatch.from_pylist(out[at : at + ROWS], schema=arrow)

    return files.select("path", "content").mapInArrow(work, schema)


def word_elements(files: DataFrame) -> DataFrame:
    return extract(files, word_rows, WORD_SCHEMA)


def sheet_cells(files: DataFrame) -> DataFrame:
    return extract(files, sheet_rows, CELL_SCHEMA)


def slide_paragraphs(files: DataFrame) -> DataFrame:
    return extract(files, slide_rows, SLIDE_SCHEMA)
