"""Marks, metadata, blocks, semantic structure, pages, word-processor files, files and batches."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.config import ENTERPRISE, Formatting, Limits, template
from lexmill.operators import batch, blocks, compliance, docx, govmeta, page_text, quality, semantic, sheets, slides, watermark, word
from lexmill.plans.documents import process
from lexmill.sources import external, files, ooxml, sinks
from lexmill.streaming import files as stream


def one(spark, md, name=None):
    return spark.createDataFrame([(1, md, name)], "doc_id long, md string, file_name string")


Z, UUID = watermark.ZERO_WIDTH, "12345678-1234-1234-1234-123456789abc"


@pytest.mark.parametrize(
    ("md", "want", "removed"),
    [
        ("a" * 200 + Z[0] * 15, "a" * 200, 1),
        ("a" * 100 + Z[0] * 5, "a" * 100 + Z[0] * 5, 0),
        ("a" * 10000 + Z[0] * 15, "a" * 10000 + Z[0] * 15, 0),
        ("---\ntitle: T\nAIGC:\n  Label: 1\n  ProduceID: 2\nauthor: A\n---\nbody", "---\ntitle: T\nauthor: A\n---\nbody", 1),
        ("---\ntitle: T\n---\nbody", "---\ntitle: T\n---\nbody", 0),
        ("x\nAIGC标识：abc\ny", "x\n\ny", 1),
        (f"AIGC: {UUID}\nz", "\nz", 1),
        ("ContentProducer: 'abc'", " 'abc'", 1),
        (f"t\n{UUID}\n", f"t\n{UUID}\n", 0),
        (f"AIGC标识: x\n{UUID}\nt", "\n\nt", 2),
        ("", "", 0),
        (None, None, 0),
    ],
)
def test_watermark(spark, md, want, removed):
    r = watermark.clean(one(spark, md)).first()
    assert (r["clean_md"], r["removed_blocks"], r["has_watermark"]) == (want, removed, removed > 0)


@pytest.mark.parametrize(
    ("md", "name", "field", "want"),
    [
        ("# 标题一\n", "a.docx", "gov_title", "标题一"),
        ("text", "工作方案.docx", "gov_title", "工作方案"),
        ("# 目录\n", "工作方案.docx", "gov_title", "工作方案"),
        ("# 1. 总体\n", None, "gov_title", "总体"),
        ("文 巡办发〔2022〕8号 x", None, "gov_number", "巡办发〔2022〕8号"),
        ("文 [2024]12号 x", None, "gov_number", "[2024]12号"),
        ("none", None, "gov_number", None),
        ("公司办公室和纪委", None, "gov_authority", "公司办公室"),
        ("于2024年3月15日", None, "gov_date", "2024-03-15"),
        ("于2024-03-15", None, "gov_date", "2024-03-15"),
        ("---\ncreated_at: 2024-01-01\n---\n于 2024-06-20", None, "gov_date", "2024-06-20"),
        ("1900年1月1日", None, "gov_date", None),
        ("# 关于培训的请示报告\n", None, "gov_type", "request"),
        ("# 会议纪要\n", None, "gov_type", "minutes"),
        ("# Something\n", None, "gov_confidence", 0.3),
        ("", None, "gov_confidence", 0.0),
    ],
)
def test_metadata(spark, md, name, field, want):
    assert govmeta.extract(one(spark, md, name)).first()[field] == want


def test_block_ids(spark):
    md = "# T\n\n| a |\n|---|\n| 1 |\ntext\n<!-- c -->\n- x\n1. y\n---"
    r = blocks.with_block_ids(one(spark, md)).first()
    assert r["block_count"] == 5
    assert "| 1 |\n<!-- block_id=b0002 type=table -->\ntext\n<!-- block_id=b0003 type=paragraph -->" in r["marked_md"]


@pytest.mark.parametrize(("codes", "score", "level", "advice"), [([], 1.0, "high", "recommended"), (["W_IMG_LOST"], 0.85, "medium", "review"), (["W_CHART_LOST"] * 2, 0.9, "medium", "recommended"), (["W_REVISION_LOST"] * 30, 0.4, "poor", "review")])
def test_quality(spark, codes, score, level, advice):
    df = spark.createDataFrame([(codes, True, False, False)], "codes array<string>, success boolean, ocr_used boolean, numbered_official boolean")
    r = quality.with_quality(df).first()
    assert (r["quality_score"], r["quality_level"], r["import_recommendation"]) == (score, level, advice)


def test_semantic_blocks(spark):
    md = "# T\n\np **b**\nq\n- a\n\n- b\n1. x\n<!-- one\ntwo -->\n> q\n> r\n| a | b |\n|---|---|\n| 1 | |\n---\nend"
    got = [(r["block_type"], r["items"], r["rows"]) for r in semantic.blocks(one(spark, md)).orderBy("block").collect()]
    assert got == [
        ("heading", ["T"], None),
        ("paragraph", ["p **b**\nq"], None),
        ("bullet", ["a", "b"], None),
        ("numbered", ["x"], None),
        ("quote", ["q\nr"], None),
        ("table", None, [["a", "b"], ["1", ""]]),
        ("rule", None, None),
        ("paragraph", ["end"], None),
    ]


def test_comment_does_not_break_a_paragraph_and_open_front_matter_swallows(spark):
    assert [r["items"] for r in semantic.blocks(one(spark, "a\n<!-- c -->\nb")).collect()] == [["a\nb"]]
    assert semantic.blocks(one(spark, "---\na\nb")).count() == 0


def test_inline(spark):
    r = one(spark, "a **b** *c* ~~d~~ `e` ***f*** [l](u)").select(semantic.inline_runs(F.col("md")).alias("r"), semantic.clean_inline(F.col("md")).alias("c")).first()
    assert [(x["text"], x["style"]) for x in r["r"] if x["style"] != "plain"] == [("b", "bold"), ("c", "italic"), ("d", "strike"), ("e", "code"), ("f", "bold_italic")]
    assert r["c"] == "a b c d e f l"


def test_list_numbers_against_a_model(spark):
    rows = [(1, i, None if i % 7 == 6 else str(i % 2), (i * 5) % 3) for i in range(40)]
    got = {r["elem_no"]: r["number"] for r in word.list_numbers(spark.createDataFrame(rows, "doc_id long, elem_no int, num_id string, level int")).collect()}
    counts = {}
    for _, i, num, level in rows:
        if num is None:
            counts = {}
            continue
        counts[num, level] = counts.get((num, level), 0) + 1
        counts = {k: v for k, v in counts.items() if not (k[0] == num and k[1] > level)}
        assert got[i] == counts[num, level]


def test_sheet_preview_and_csv(spark):
    cells = spark.createDataFrame([(1, 0, "S", 1, 1, "X")], "doc_id long, sheet_no int, sheet string, row long, col int, value string")
    assert sheets.csv_texts(cells).first()["csv"] == ",\n,X"
    r = sheets.previews(cells).first()
    assert r["preview"] == "|  | X |" and not r["truncated"]  # no rule, as row 0 is empty
    long = spark.createDataFrame([(1, 0, "S", i, 0, str(i)) for i in range(51)], cells.schema)
    assert sheets.previews(long).first()["truncated"]


def test_slides(spark):
    rows = [(1, 3, 0, "text", " a "), (1, 3, 1, "notes", "n"), (1, 9, 0, "text", "b")]
    md = slides.slides_markdown(spark.createDataFrame(rows, "doc_id long, slide_no int, para_no int, kind string, text string")).first()["body"]
    assert md == "<!-- SLIDE_START: 1 -->\n## 第 1 页\n\na\n\n> **备注**\n> n\n<!-- SLIDE_END: 1 -->\n\n<!-- SLIDE_START: 2 -->\n## 第 2 页\n\nb\n<!-- SLIDE_END: 2 -->\n\n"


def page_words(spark, rows):
    full = [(1, 1, 600.0, t, x, x + 10.0 * len(t), y, 12.0, size, font) for t, x, y, size, font in rows]
    return spark.createDataFrame(full, "doc_id long, page int, page_width double, text string, left double, right double, top double, height double, font_size double, font_name string")


def test_pages(spark):
    rows = [("第一章", 50.0, 700.0, 12.0, "X"), ("body", 50.0, 660.0, 12.0, "X"), ("goes", 95.0, 660.0, 12.0, "X"), ("on.", 50.0, 640.0, 12.0, "X"), ("（二）item", 50.0, 600.0, 12.0, "X")]
    for i, y in enumerate((500.0, 480.0, 460.0, 440.0)):
        rows += [(f"a{i}", 50.0, y, 12.0, "X"), (f"b{i}", 250.0, y, 12.0, "X"), (f"c{i}", 450.0, y, 12.0, "X")]
    md = page_text.page_markdown(page_words(spark, rows)).first()["raw_md"]
    assert "### 第一章" in md and "2. item" in md and "| a0 | b0 | c0 |\n| --- | --- | --- |\n| a1 | b1 | c1 |" in md
    kinds = {r["text"]: r["kind"] for r in page_text.page_lines(page_words(spark, rows)).collect()}
    assert kinds["（二）item"] == "ordered"


def test_words_of_a_line_and_list_numbers(spark):
    words = [("中a", 0.0, 20.0), ("b文", 60.0, 80.0), ("x", 84.0, 90.0), ("y", 100.0, 110.0)]
    rows = [(1, 1, 600.0, t, a, b, 700.0, 12.0, 12.0, "X") for t, a, b in words]
    numbers = (("12345678901. item", 1), ("2147483648. item", 1), ("2147483647. item", 2147483647), ("（１２）item", 1), ("7、 item", 7))
    rows += [(2, 1, 600.0, t, 10.0, 200.0, 700.0 - 40 * i, 12.0, 12.0, "X") for i, (t, _) in enumerate(numbers)]
    df = spark.createDataFrame(rows, "doc_id long, page int, page_width double, text string, left double, right double, top double, height double, font_size double, font_name string")
    got = [tuple(r) for r in page_text.page_lines(df).orderBy("doc_id", "line_no").select("text", "kind", "number").collect()]
    assert got == [("中ab文x y", "body", -1), *[(t, "ordered", n) for t, n in numbers]]


def test_documents_that_share_an_id(spark):
    from lexmill.plans.documents import process

    rows = [(1, "# A\n\none"), (1, "# B\n\ntwo\n\nthree"), (None, "# C"), (2, None), (3, " ")]
    df = spark.createDataFrame([(d, "a.docx", "Word", md, [], False) for d, md in rows], "doc_id long, file_name string, source_type string, md string, codes array<string>, ocr_used boolean")
    got = process(df).collect()
    assert sorted((str(r["doc_id"]), r["block_count"]) for r in got) == [("1", 2), ("1", 3), ("2", 0), ("3", 0), ("None", 1)]
    assert all((r["markdown"] in (None, " ")) == (r["doc_id"] in (2, 3)) for r in got)
    (two,) = [r["markdown"] for r in got if r["markdown"] and "three" in r["markdown"]]
    assert "# B" in two and "# A" not in two and 'type=paragraph' in two


def test_word_processor_round_trip(spark):
    md = "# 报告\n\n正文 **重点** 内容\n\n## 一、部分\n\n- a\n- b\n\n1. x\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n> q\n\n---"
    made = docx.render(one(spark, md))
    content = bytes(made.first()["docx"])
    assert zipfile.ZipFile(io.BytesIO(content)).testzip() is None
    rows = list(ooxml.word_rows("a.docx", content))
    cells = [[["".join(x["text"] for p in c for x in p) for c in line] for line in r["rows"]] for r in rows if r.get("rows")]
    assert cells == [[["h", "k"], ["1", "2"]]]
    back = ooxml.word_elements(spark.createDataFrame([("a.docx", bytearray(content)), ("b.docx", bytearray(b"junk"))], "path string, content binary"))
    assert back.where("error is not null").count() == 1
    parts = docx.extract_properties(made)
    issues = compliance.check(*parts)
    assert compliance.reports(parts[0], issues).first()["passed"]
    again = docx.reformat_all(made).first()
    assert again["error"] is None and docx.properties(bytes(again["docx"]))["top"] == int(3.7 * 567)
    assert docx.reformat_all(spark.createDataFrame([(1, bytearray(b"x"))], "doc_id long, docx binary")).first()["error"]
    roles = {r["role"] for r in compliance.target_format(parts[1]).collect()}
    assert {"title", "heading2", "body"} <= roles


def test_word_files_stay_within_a_worker(spark):
    """Workers get pieces and give batches of bounded size; the files are those of whole values, in any order of rows."""
    texts = {1: "# T\n\n" + "a <b> & **c** `d` 中 " * 6000, 2: "", 3: "\n\n".join(f"{n}. x\n\n> q *i*\n\n| a | |\n|---|---|\n| 1 | 2 |" for n in range(300)), 4: "---\nx: 1\n---\n", 5: "- a\n- ***b***"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, md string").repartition(2)
    made = {r["doc_id"]: bytes(r["docx"]) for r in docx.render(docs).collect()}
    assert made.keys() == texts.keys()
    files = spark.createDataFrame([(k, bytearray(c)) for k, c in made.items()] + [(9, None), (10, bytearray(b""))], "doc_id long, docx binary").coalesce(1)
    cut = docx.in_pieces(files, "doc_id", "docx")
    assert cut.agg(F.max(F.octet_length("piece"))).first()[0] <= docx.PIECE < len(made[3])
    again = {r["doc_id"]: r for r in docx.reformat_all(files).collect()}
    assert {k: bytes(again[k]["docx"]) for k in made} == {k: docx.reformat(c) for k, c in made.items()}
    assert again[9]["error"].startswith("TypeError") and again[10]["error"].startswith("BadZipFile")
    sections, paragraphs, tables = docx.extract_properties(files.where("doc_id < 9"))
    assert all("Python" not in f._jdf.queryExecution().executedPlan().toString() and "InArrow" not in f._jdf.queryExecution().executedPlan().toString() for f in (sections, paragraphs, tables))
    got = {k: [] for k in made}
    for r in paragraphs.orderBy("doc_id", "para_no").collect():
        got[r["doc_id"]].append(r.asDict())
    want = {k: [{"doc_id": k} | p for p in docx.properties(c)["paragraphs"]] for k, c in made.items()}
    assert got == want and got[1][1]["text"].startswith("a <b> & c d 中")


def test_empty_document_fails_the_check(spark):
    parts = docx.extract_properties(docx.render(one(spark, "")))
    assert not compliance.reports(parts[0], compliance.check(*parts)).first()["passed"]


def test_sheet_and_slide_files():
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r1" Type="{r}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>hi</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row></sheetData></worksheet>')
    rows = list(ooxml.sheet_rows("x.xlsx", out.getvalue()))
    assert [(x["row"], x["ref"], x["raw"]) for x in rows if x.get("ref")] == [(0, "A1", "hi"), (0, "B1", "5")]


def test_scan_and_decode(spark, tmp_path):
    for name, data in {"a.docx": b"x", "b.txt": "中文".encode("gb18030"), "c.txt": b"\xef\xbb\xbfok", ".hidden.docx": b"x", "d/e.PDF": b"x"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    found, summary = files.scan(spark, str(tmp_path))
    assert {r["file_name"] for r in found.collect()} == {"a.docx", "b.txt", "c.txt", "e.PDF"}
    assert tuple(summary.first()) == (4, 2, 2, False)
    assert files.scan(spark, str(tmp_path), limit=2)[1].first()["truncated"]
    texts = files.text_documents(spark.read.format("binaryFile").load(str(tmp_path / "*.txt")))
    assert {r["raw_md"] for r in texts.collect()} == {"# b\n\n中文", "# c\n\nok"}
    registry = files.Parsers()
    registry.register("Text", files.text_documents)
    out = registry.parse(spark.read.format("binaryFile").load(str(tmp_path / "*.*"))).collect()
    assert sum(r["error"] is None for r in out) == 2


def test_paths_and_names(spark):
    df = spark.createDataFrame([("/A/b.md",), ("/a/B.md",), ("/a/c.md",)], "path string")
    assert {r["path"] for r in files.new_paths(df, df.where("path = '/a/c.md'")).collect()} == {"/A/b.md"}
    names = spark.createDataFrame([(1, "x"), (2, "X"), (3, "y")], "file_id int, name string")
    assert [r["out_name"] for r in batch.suffixed_names(names).orderBy("file_id").collect()] == ["x", "X_1", "y"]
    roots = spark.createDataFrame([("/in/a/b",), ("/IN/a/c",)], "folder string")
    assert batch.common_root(roots).first()["root"].lower() == "/in/a"
    r = spark.range(1).select(batch.output_folder(F.lit("/in/a/b"), F.lit("/in"), F.lit("/out")).alias("o"), batch.isolated(F.lit("/in"), F.lit("/in/x")).alias("i")).first()
    assert (r["o"], r["i"]) == ("/out/a/b", False)


def test_whole_plan_and_packages(spark, tmp_path):
    df = one(spark, "# 关于培训的通知\n\n巡办发〔2022〕8号\n\nAIGC标识：x\n", "n.docx").withColumn("source_type", F.lit("Word"))
    df = df.withColumn("codes", F.array(F.lit("W_CHART_LOST"))).withColumn("ocr_used", F.lit(False))
    r = process(df).first()
    assert 'gov_doc_number: "巡办发〔2022〕8号"' in r["markdown"] and "[W_AIGC_WATERMARK]" in r["markdown"] and r["import_recommendation"] == "review"
    none = "array<struct<name:string,data:binary>>", "array<struct<name:string,csv:string>>"
    packed = spark.createDataFrame([("n", "text", "{}", "{}")], "stem string, markdown string, meta_json string, quality_json string")
    packed = packed.withColumn("assets", F.array().cast(none[0])).withColumn("tables", F.array(F.struct(F.lit("t.csv").alias("name"), F.lit("1,2").alias("csv"))))
    assert sinks.write_packages(packed, str(tmp_path)).count() == 2
    assert (tmp_path / "n.md").read_bytes() == b"\xef\xbb\xbftext" and (tmp_path / "tables/t.csv").exists()
    assert {x["path"] for x in sinks.package_files(packed, "HybridPackage").collect()} == {"n/document.md", "n/.meta.json", "n/.quality_report.json", "n/tables/t.csv"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# 会议纪要\n\nAIGC标识：x")
    q = stream.write(stream.cleaned_stream(stream.markdown_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["gov_type"] == "minutes"


def test_settings(tmp_path):
    assert template("OFFICIAL-BASIC")[0] == "official-report" and template("x")[0] == "official-report"
    assert Formatting.from_json(ENTERPRISE.to_json()) == ENTERPRISE and Formatting.from_json("{") is None
    p = tmp_path / "c.json"
    p.write_text('{"scan_limit": -1, "package_mode": "?"}')
    assert Limits.load(str(p)) == Limits() == Limits.load("/nowhere")
    assert external.modern("a.docx", b"x") == (b"x", None)
