"""Files as rows: scanning, routing by type, decoding, the registry of parsers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import TYPE_OF_EXTENSION, extension, file_name, file_stem, file_type

#: The modes and the extensions that each takes.
MODES = {
    "to_markdown": (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"),
    "markdown_to_docx": (".md", ".markdown"),
    "format_doc": (".doc", ".docx"),
}


def is_hidden(path: Column) -> Column:
    """Any folder or file of the path whose name starts with a dot."""
    return F.exists(F.split(F.regexp_replace(path, r"^[a-z]+:/+", ""), r"[/\\]"), lambda p: p.startswith(".") & (p != ".") & (p != ".."))


def is_supported(path: Column, mode: str) -> Column:
    return extension(path).isin(*MODES[mode])


def describe(paths: DataFrame, mode: str = "to_markdown", path: str = "path") -> DataFrame:
    """``paths`` with file_name, extension, file_type, supported and status."""
    p = F.col(path)
    ok = is_supported(p, mode)
    return (
        paths.withColumn("file_name", file_name(p))
        .withColumn("extension", extension(p))
        .withColumn("file_type", file_type(p))
        .withColumn("supported", ok)
        .withColumn("status", F.when(ok, F.lit("Pending")).otherwise(F.lit("Unsupported")))
    )


def scan(spark: SparkSession, folder: str, mode: str = "to_markdown", recursive: bool = True, limit: int | None = 5000) -> tuple[DataFrame, DataFrame]:
    """(files, summary): the first ``limit`` entries by path, supported or not; contents are not read.

    ``limit`` is the scan's own feature; None takes all.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "modificationTime", "length")
    rows = describe(rows.where(~is_hidden(F.col("path"))), mode)
    found = rows if limit is None else rows.orderBy("path").limit(limit)
    total = rows.agg(F.count("*").alias("all"))
    summary = found.agg(F.count("*").alias("found"), F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("unsupported"))
    return found, summary.crossJoin(total).select("found", "supported", "unsupported", (F.col("all") > F.col("found")).alias("truncated"))  # one row each


def new_paths(paths: DataFrame, listed: DataFrame, path: str = "path") -> DataFrame:
    """Paths not yet listed, each once whatever its case; the smallest spelling stays."""
    low = F.lower(F.col(path)).alias("_low")
    once = paths.groupBy(low).agg(F.min(path).alias(path))
    return once.join(listed.select(low).distinct(), "_low", "left_anti").select(path)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """UTF-8 (a byte-order mark goes) or, where the bytes are not valid, GB18030 through an Arrow function."""

    @F.pandas_udf("string")
    def gb18030(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode("gb18030", "replace"))

    text = F.regexp_replace(content.cast("string"), r"\A\x{FEFF}", "")
    return F.when(is_utf8(content), text).otherwise(gb18030(F.when(~is_utf8(content), content)))


def text_documents(files: DataFrame) -> DataFrame:
    """Rows (path, content) of text files as (path, raw_md): the stem as title, then the text."""
    return files.select("path", F.concat(F.lit("# "), file_stem(F.col("path")), F.lit("\n\n"), decoded(F.col("content"))).alias("raw_md"))


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, md) of Markdown files, each whole."""
    rows = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").load(folder)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("md"))


#: What a parser may give of a file, besides its path; what it leaves out is null, empty or false.
PARSED = {
    "raw_md": "string",
    "warnings": "array<struct<code:string,message:string,location:string>>",
    "assets": "array<struct<name:string,data:binary>>",
    "tables": "array<struct<name:string,csv:string>>",
    "page_count": "int",
    "sheet_count": "int",
    "slide_count": "int",
    "ocr_used": "boolean",
    "source_size": "bigint",
    "source_sha256": "string",
    "error": "string",
}

Parser = Callable[[DataFrame], DataFrame]


def parsed(df: DataFrame) -> DataFrame:
    """``df`` (path and some of the columns of ``PARSED``) with all of them."""
    empty = {"warnings": F.array(), "assets": F.array(), "tables": F.array(), "ocr_used": F.lit(False)}
    held = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in PARSED.items()}
    return df.select("path", *[(F.coalesce(v, empty[c].cast(PARSED[c])) if c in empty else v).alias(c) for c, v in held.items()])


class Parsers:
    """Parsers by file type: each takes rows (path, content) and returns (path, and columns of ``PARSED``)."""

    def __init__(self) -> None:
        self.by_type: dict[str, Parser] = {}

    def register(self, kind: str, parser: Parser) -> None:
        if kind not in set(TYPE_OF_EXTENSION.values()):
            raise ValueError(kind)
        self.by_type.setdefault(kind, parser)  # the first one registered is used

    def parse(self, files: DataFrame) -> DataFrame:
        """All files, each by its type's parser; a type without one gives a row with an error."""
        typed = files.withColumn("_type", file_type(F.col("path")))
        none = typed.where(~F.col("_type").isin(*self.by_type)) if self.by_type else typed
        out = parsed(none.select("path", F.concat(F.lit("不支持的文件格式: "), extension(F.col("path"))).alias("error")))
        for kind, parser in self.by_type.items():
            out = out.unionByName(parsed(parser(typed.where(F.col("_type") == kind).drop("_type"))))
        return out
