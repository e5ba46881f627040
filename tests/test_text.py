"""Column functions against the fixture cases."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import compliance, quality, word


def values(spark, column, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {'double' if isinstance(rows[0], float) else 'binary' if isinstance(rows[0], bytes) else 'string'}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "column_index": (T.column_index, ["A1", "Z9", "AA1", "AB7", "B12", "", "123"], [0, 25, 26, 27, 1, 0, 0]),
    "md_cell": (T.md_cell, ["a|b", "a\nb", "a\rb"], ["a\\|b", "a b", "ab"]),
    "csv_field": (T.csv_field, ["a,b", 'c"d', "plain", "x\ny"], ['"a,b"', '"c""d"', "plain", '"x\ny"']),
    "is_date_format": (T.is_date_format, ["yyyy-mm-dd", "m/d/yy", "yyyy年m月d日", "hh:mm", "h:mm:ss", "m/d/yy h:mm", "", " ", "0.00", "General0", "mm", "hh", "ss", "yyyy", "d"], [True, True, True, False, False, True, False, False, False, False, True, False, False, True, True]),
    "heading_level": (word.heading_level, ["Heading1", "Heading2", "Heading3", "Heading6", "Heading", "Title", "Heading7", ""], [1, 2, 3, 6, 1, 1, 1, 1]),
    "ordered": (word.is_ordered_format, ["decimal", "upperRoman", "lowerLetter", "chineseCounting", "bullet", "none", ""], [True, True, True, True, False, False, False]),
    "heading_of": (lambda c: compliance.heading_of(F.lit(None).cast("string"), c), ["一、总则", "（一）基本要求", "1.1 背景", "1、第一条", "第一条", "body", ""], [1, 2, 3, 3, 0, 0, 0]),
    "sanitised": (T.sanitised_file_name, ["CON", "con.txt", "LPT9.docx", "CONFIDENTIAL.txt", "committee.md", "/a/b/x.md "], ["_CON", "_con.txt", "_LPT9.docx", "CONFIDENTIAL.txt", "committee.md", "x.md"]),
    "file_type": (T.file_type, ["a.DOCX", "b.xls", "c.pptx", "d.txt", "e.pdf", "f.md", "g", "h.zip"], ["Word", "Excel", "PowerPoint", "Text", "PDF", "Markdown", "Unknown", "Unknown"]),
    "chinese_number": (T.chinese_number, ["一", "九", "十", "十一", "二十", "九十九", "零", "三五"], [1, 9, 10, 11, 20, 99, 1, 35]),
    "version": (T.version_parts, ["v2.1.0", "2.1.0", "release-3.0.1", "v1.0", "", "latest"], [[2, 1, 0, -1], [2, 1, 0, -1], [3, 0, 1, -1], [1, 0, -1, -1], None, None]),
    "artifacts": (T.without_page_artifacts, ["— 3 —", "第 2 页", "共10页", "  12 ", "text 7 text"], ["", "", "", "", "text 7 text"]),
    "spaces": (T.normal_spaces, ["a  b ，c", " x . ", "一 。"], ["a b，c", "x.", "一。"]),
    "type_size": (T.type_size_name, [16.0, 10.5, 16.2, 42.0], ["三号", "五号", "三号(≈16.2pt)", "初号"]),
    "serial_date": (T.serial_date, [45000.75, 1.0], ["2023-03-15", "1899-12-31"]),
    "mime": (T.image_mime, [b"\xff\xd8\xff\xe0", b"\x89PNG", b"GIF8", b"BMxx", b"II*\x00", b"MM\x00*", b"x", b"????"], ["image/jpeg", "image/png", "image/gif", "image/bmp", "image/tiff", "image/tiff", "image/png", "image/png"]),
    "severity": (quality.severity, ["W_IMG_LOST", "W_CHART_LOST", "W_REVISION_LOST", "W_NEW"], ["high", "medium", "low", "low"]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    column, rows, want = CASES[name]
    assert values(spark, column, rows) == want


@pytest.mark.parametrize(("remote", "local", "newer"), [("v2.0.0", "1.9.9", True), ("1.10.0", "1.9.0", True), ("1.0.1", "1.0", True), ("1.0.0", "1.0.0", False), ("1.0", "2.0", False), ("", "1.0", False), ("latest", "1.0", False), ("1.0", "x", False)])
def test_versions(spark, remote, local, newer):
    assert spark.range(1).select(T.is_newer(F.lit(remote), F.lit(local)).alias("n")).first()["n"] is newer


@pytest.mark.parametrize(("chars", "points", "twips"), [(2, 16, 640), (2, 18, 720), (0, 22, 0), (1, 10.5, 210)])
def test_twips(spark, chars, points, twips):
    assert spark.range(1).select(T.indent_twips(F.lit(chars), F.lit(points)).alias("t")).first()["t"] == twips
