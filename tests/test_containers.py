"""Containers as a data source: kinds, wanted columns, partitions and plug-ins."""

import io
import zipfile

import pytest
from pyspark import cloudpickle

import test_conversion as made
from lexmill.sources import containers, ooxml


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "sub").mkdir()
    (at / ".hidden").mkdir()
    for name, data in {"a.docx": made.word_file(), "sub/B.XLSX": made.sheet_file(), "s.pptx": made.slide_file(), "bad.xlsx": b"junk", ".hidden/c.xlsx": made.sheet_file(), "t.txt": b"x"}.items():
        (at / name).write_bytes(data)
    return str(at)


def test_kinds_give_what_the_parsers_get(spark, folder):
    containers.register(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).selectExpr("replace(path, 'file:', '') as path", "content")
    for kind, rows, suffix in (("paragraphs", ooxml.word_elements, "docx"), ("cells", ooxml.sheet_cells, "xlsx"), ("slides", ooxml.slide_paragraphs, "pptx")):
        got = spark.read.format("lexmill").option("kind", kind).load(f"file://{folder}")
        want = rows(files.where(f"lower(path) like '%.{suffix}' and path not like '%hidden%'"))
        assert got.schema == want.schema and got.count() > 0
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("lexmill").option("kind", "none").load(folder).count()


def test_a_schema_makes_its_columns_only(spark, folder):
    containers.register(spark)
    got = spark.read.format("lexmill").option("kind", "cells").schema("ref string, raw string, error string").load(folder)
    assert got.columns == ["ref", "raw", "error"]
    rows = got.collect()
    assert sum(r["error"] is not None for r in rows) == 1 and any(r["ref"] == "A1" for r in rows)
    assert spark.read.format("lexmill").option("kind", "slides").load(f"{folder}/sub").count() == 0


def test_files_are_dealt_by_bytes():
    sizes = {f"f{i}": s for i, s in enumerate([100, 60, 40, 30, 30, 5, 0])}
    groups = containers.dealt(sizes, 100)
    assert sorted(p for g in groups for p in g) == sorted(sizes) and all(sum(sizes[p] for p in g) <= 100 for g in groups) and len(groups) == 3
    assert containers.dealt({"large": 500, "b": 1}, 100) == [("large",), ("b",)] and containers.dealt({}, 100) == []


def note_rows(path, content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for at, line in enumerate(z.read("notes").decode().split("\n")):
            yield {"line_no": at, "text": line}
    yield {"line_no": -1, "kind": "file"}


class Notes(containers.Containers):
    readers = {"notes": containers.Reader((".notes",), note_rows, "path string, line_no int, text string, error string", "line_no")}

    @classmethod
    def name(cls):
        return "notes"


def test_a_plug_in_registers_its_own(spark, tmp_path):
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests' folder
    with zipfile.ZipFile(tmp_path / "x.notes", "w") as z:
        z.writestr("notes", "one\ntwo")
    (tmp_path / "y.notes").write_bytes(b"junk")
    containers.register(spark, Notes)
    got = spark.read.format("notes").load(str(tmp_path)).orderBy("path", "line_no").collect()
    assert [(r["line_no"], r["text"]) for r in got if r["path"].endswith("x.notes")] == [(-1, None), (0, "one"), (1, "two")]
    assert [r["error"] is not None for r in got if r["path"].endswith("y.notes")] == [True]
