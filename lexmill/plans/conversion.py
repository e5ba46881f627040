"""Files to packages in one run: parsers by type, the document plan, JSON facts, and files out.

A file that can't be read is a row with an error and never ends the run; ``run`` with ``continue_on_error``
off ends it before anything is written, ``run_in_waves`` after the wave in which the error was met.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import Limits
from lexmill.functions.text import column_index, file_name, file_stem, file_type, safe_file_name
from lexmill.operators import batch, quality, sheets, slides, word
from lexmill.plans.documents import COUNTS, process
from lexmill.sources import files, ooxml, sinks
from lexmill.sources.external import recognise

FACTS = ("warnings", "assets", "tables", *COUNTS, "source_size", "source_sha256", "error")
KEPT = ("path", "file_name", "source_type", "warnings", "assets", "tables", "ocr_used", *COUNTS, "source_size", "source_sha256")

#: What stands for images that can't be read.
WORD_IMAGES_LOST = "<!-- IMAGE_PLACEHOLDER: Word 文档包含嵌入式图片，提取失败 -->"
SLIDE_IMAGES_LOST = "<!-- IMAGE_PLACEHOLDER: PPT 演示文稿包含嵌入式图片，提取失败 -->"


def _titled(path: Column, *parts: Column) -> Column:
    return F.concat(F.lit("# "), file_stem(path), F.lit("\n\n"), *parts)


def _text_facts() -> list[Column]:
    size = F.length("content").cast("bigint")
    return [size.alias("source_size"), F.when(size > 0, F.sha2("content", 256)).alias("source_sha256")]


def _lost(text: str) -> Column:
    has = F.exists(F.coalesce("warnings", F.array().cast(sheets.WARNINGS)), lambda w: w["code"] == "W_IMG_LOST")
    return F.when(has, F.lit(text)).otherwise(F.lit(""))


def word_parser(rows: DataFrame) -> DataFrame:
    """Word files; images are named at the end."""
    df = word.word_markdown(ooxml.word_elements(rows))
    named = F.transform("assets", lambda a: F.concat(F.lit("![图片 "), F.regexp_extract(a["name"], r"_0*(\d+)\.", 1), F.lit("](assets/"), a["name"], F.lit(")\n")))
    images = F.when(F.size("assets") > 0, F.concat(F.lit("\n"), F.array_join(named, ""))).otherwise(_lost(f"\n{WORD_IMAGES_LOST}\n"))
    return df.withColumn("raw_md", F.when(F.col("error").isNull(), _titled(F.col("path"), F.col("body"), images)))


def sheet_parser(rows: DataFrame) -> DataFrame:
    """Workbooks: previews, and whole CSV texts of sheets that are longer."""
    cells = ooxml.sheet_cells(rows).withColumnRenamed("path", "doc_id")
    is_cell = F.col("ref").isNotNull()
    value = F.when(is_cell, sheets.cell_value(F.col("kind"), F.col("raw"), F.col("format_id"), F.col("format_code")))
    df = sheets.sheet_markdown(cells.withColumn("value", value).withColumn("col", F.when(is_cell, column_index(F.col("ref")))))
    return df.withColumnRenamed("doc_id", "path").withColumn("raw_md", F.when(F.col("error").isNull(), _titled(F.col("path"), F.col("body"))))


def slide_parser(rows: DataFrame) -> DataFrame:
    """Presentations; images are named on their slides."""
    df = slides.slides_markdown(ooxml.slide_paragraphs(rows).withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
    return df.withColumn("raw_md", F.when(F.col("error").isNull(), _titled(F.col("path"), F.col("body"), _lost(f"{SLIDE_IMAGES_LOST}\n"))))


def text_parser(rows: DataFrame) -> DataFrame:
    return rows.select("path", _titled(F.col("path"), files.decoded(F.coalesce("content", F.lit(b"")))).alias("raw_md"), *_text_facts())


def page_parser(rows: DataFrame) -> DataFrame:
    """Page files: by the recognition tool, as their bytes have no reader here; without it a row with the error."""
    return recognise(rows)


def default_parsers() -> files.Parsers:
    made = files.Parsers()
    for kind, parser in (("Word", word_parser), ("Excel", sheet_parser), ("PowerPoint", slide_parser), ("Text", text_parser), ("PDF", page_parser)):
        made.register(kind, parser)
    return made


def each_path_once(rows: DataFrame) -> DataFrame:
    """``rows`` (path, content) with one row for each path: of a repeated one the content of least digest, a null last.

    Paths are counted alone; contents are only shuffled where a path comes twice.
    """
    again = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    if again.isEmpty():
        return rows.select("path", "content")
    same = rows["path"].eqNullSafe(again["path"])
    first = F.min_by(F.struct("content"), F.struct(F.col("content").isNull(), F.sha2("content", 256)))["content"]
    return rows.join(again, same, "left_anti").select("path", "content").union(rows.join(again, same, "left_semi").groupBy("path").agg(first.alias("content")).select("path", "content"))


def convert(rows: DataFrame, parsers: files.Parsers | None = None, limits: Limits | None = None, root: str | None = None, at: str | None = None) -> DataFrame:
    """Rows (path, content) to documents: path, status, error, folder, stem, markdown, meta_json, quality_json, assets, tables.

    ``folder`` is the file's place under ``root``.  ``at`` is the time that the facts name (now, if none is given).
    A repeated path is one document; a null path or content gives an error or an empty file; an empty table gives no rows.
    """
    limits, at = limits or Limits(), at or datetime.now().astimezone().isoformat()
    read = (parsers or default_parsers()).parse(each_path_once(rows))
    path = F.col("path")
    read = read.withColumn("file_name", file_name(path)).withColumn("source_type", file_type(path)).withColumn("doc_id", path).withColumnRenamed("raw_md", "md")
    failed = F.col("error").isNotNull() | F.col("md").isNull()
    made = process(read, limits.converter, converted_at=at, keep=(*KEPT, "error", "md"))
    fields = {"sourceFile": F.col("file_name"), "sourceType": F.col("source_type")}
    after = {"ocrUsed": F.col("ocr_used"), "blockCount": F.col("block_count"), "unsupportedObjectCount": F.col("unsupported_count"), "convertedAt": F.lit(at), "converter": F.lit(limits.converter)}
    size = {"sourceSizeBytes": F.col("source_size")}
    meta = quality.meta_json(fields | {"sourceSha256": F.col("source_sha256")} | after, size | {"pageCount": F.col("page_count"), "sheetCount": F.col("sheet_count"), "slideCount": F.col("slide_count")})
    report = quality.report_json(
        F.col("warnings"), F.col("quality_score"), F.col("quality_level"), F.col("import_recommendation"), F.col("gov_document"), F.col("gov_confidence"), F.lit(at), F.col("file_name"), F.col("source_type")
    )
    ok = lambda c: F.when(~failed, c)
    inside = batch.output_folder(F.regexp_replace(path, r"/[^/]*$", ""), F.lit(root), F.lit("")) if root else F.lit("")
    return made.select(
        "path",
        F.when(failed, F.lit("Failed")).otherwise(F.lit("Done")).alias("status"),
        F.when(failed, F.coalesce("error", F.lit("no text"))).alias("error"),
        F.regexp_replace(inside, "^/+", "").alias("folder"),
        safe_file_name(file_stem(path)).alias("stem"),
        ok(F.col("markdown")).alias("markdown"),
        ok(meta).alias("meta_json"),
        ok(report).alias("quality_json"),
        "assets",
        "tables",
        ok(F.col("quality_score")).alias("quality_score"),
        F.transform("warnings", lambda w: w["code"]).alias("codes"),
    )


def run(rows: DataFrame, out: str, limits: Limits | None = None, root: str | None = None, at: str | None = None, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Convert and write packages under ``out``, a folder or URI that all executors reach: (path, status, error), and (path, bytes) written.

    Documents are written once as Parquet beside the packages, so neither result reads the files again.  A run of a ``name`` that was
    committed before writes nothing (``sinks.write_packages``).
    """
    limits, name = limits or Limits(), name or uuid.uuid4().hex
    held = f"{out.rstrip('/')}/.runs/{name}/documents"
    store, root_path = sinks.file_system(out)
    if not store.get_file_info(f"{root_path}/.runs/{name}/documents/_SUCCESS").is_file:
        sinks.write_table(convert(rows, limits=limits, root=root, at=at), held, "overwrite")
    docs = rows.sparkSession.read.parquet(held)
    if not limits.continue_on_error:
        bad = docs.where("status = 'Failed'").select("path", "error").first()
        if bad is not None:
            raise RuntimeError(f"{bad['path']}: {bad['error']}")
    return docs.select("path", "status", "error"), sinks.write_packages(docs.where("status = 'Done'"), out, limits.package_mode, name)


def cancel(spark: SparkSession, out: str, name: str) -> None:
    """End the run of that name: its running jobs are cancelled, waves that haven't begun don't begin."""
    store, at = sinks.file_system(out)
    store.create_dir(f"{at}/.runs/{name}", recursive=True)
    with store.open_output_stream(f"{at}/.runs/{name}/cancelled") as mark:
        mark.write(b"")
    spark.interruptTag(name)


def run_in_waves(rows: DataFrame, out: str, name: str, limits: Limits | None = None, root: str | None = None, at: str | None = None, files_at_once: int = 1000) -> DataFrame:
    """Convert and write about ``files_at_once`` files at a time: (path, status, error) of all files, Pending for those not begun.

    With ``continue_on_error`` off the first error ends the run after its wave, whose good files are written; so does ``cancel``.  What
    was written stays.  A run of the same ``name`` goes on with the waves that aren't done, so long as the files are the same.
    """
    spark, limits = rows.sparkSession, limits or Limits()
    store, folder = sinks.file_system(out)
    waves = max(1, -(-rows.select("path").count() // files_at_once))
    wave = F.pmod(F.xxhash64("path"), F.lit(waves))
    anyway = replace(limits, continue_on_error=True)
    states = []
    spark.addTag(name)
    try:
        for k in range(waves):
            if store.get_file_info(f"{folder}/.runs/{name}/cancelled").is_file:
                break
            try:
                states.append(run(rows.where(wave == k), out, anyway, root, at, f"{name}-{k}")[0])
            except Exception:
                if store.get_file_info(f"{folder}/.runs/{name}/cancelled").is_file:
                    break
                raise
            if not limits.continue_on_error and not states[-1].where("status = 'Failed'").isEmpty():
                break
    finally:
        spark.removeTag(name)
    left = rows.where(wave >= len(states)).select("path").distinct().select("path", F.lit("Pending").alias("status"), F.lit(None).cast("string").alias("error"))
    return reduce(DataFrame.union, states, left)
