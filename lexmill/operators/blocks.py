"""Lines and blocks of Markdown: classification, numbering, marks in the text, counts.

One exchange by document feeds every window; the text is put together again from its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, trimmed_start

#: Comments that stand for what could not be converted.
UNSUPPORTED = ("IMAGE_PLACEHOLDER", "FOOTNOTE_PLACEHOLDER", "COMMENT_PLACEHOLDER", "TABLE_TRUNCATED", "TABLE_DEGRADED")


def lines(df: DataFrame, md: str = "md", key: str = "doc_id", carry: str | None = None) -> DataFrame:
    """(key, line_no from 0, line); a final carriage return of a line goes.  The column ``carry`` stands on line 0 alone."""
    kept = [carry] if carry else []
    each = df.select(F.col(key), *kept, F.posexplode(F.split(F.coalesce(F.col(md), F.lit("")), "\n", -1)).alias("line_no", "line"))
    if carry:
        each = each.withColumn(carry, F.when(F.col("line_no") == 0, F.col(carry)))
    return each.withColumn("line", F.regexp_replace("line", r"\r\z", ""))


def block_type(line: Column) -> Column:
    """The type of a line that is a block or begins one, else null."""
    t = trimmed_start(line)
    out = F.when(is_blank(line), F.lit(None)).when(t.startswith("#"), F.lit("heading")).when(t.startswith("|"), F.lit("table"))
    out = out.when(t.startswith("- ") | t.startswith("* ") | t.startswith("+ ") | t.rlike(r"(?U)^\d+\.\s"), F.lit("list_item"))
    out = out.when(t.startswith("![") | t.contains("<!-- IMAGE_PLACEHOLDER"), F.lit("image_placeholder"))
    out = out.when(t.contains("<!-- FOOTNOTE_PLACEHOLDER"), F.lit("footnote_placeholder")).when(t.contains("<!-- COMMENT_PLACEHOLDER"), F.lit("comment_placeholder"))
    return out.when(~t.startswith("<!--") & ~t.startswith("---"), F.lit("paragraph"))


def numbered_lines(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``lines`` with kind, starts (a block begins here) and block_no (running count in the document)."""
    t = trimmed_start(F.col("line"))
    goes_on = t.startswith("|") | t.startswith("<!-- block_id=")
    order = Window.partitionBy(key).orderBy("line_no")
    df = line_rows.withColumn("kind", block_type(F.col("line"))).withColumn("_on", goes_on)
    # a table goes on while each line is a row or a mark; its run is found from the last line that is neither
    df = df.withColumn("_run", F.sum(F.when(F.col("_on"), F.lit(0)).otherwise(F.lit(1))).over(order))
    first_row = F.min(F.when(F.col("kind") == "table", F.col("line_no"))).over(Window.partitionBy(key, "_run").orderBy("line_no"))
    df = df.withColumn("_first", F.when(F.col("_on"), first_row))
    inside = F.coalesce(F.col("_on") & (F.col("line_no") > F.col("_first")), F.lit(False))
    df = df.withColumn("starts", F.col("kind").isNotNull() & ~inside)
    df = df.withColumn("block_no", F.sum(F.col("starts").cast("int")).over(order))
    return df.withColumn("_inside", inside).drop("_run", "_first", "_on")


def with_block_ids(df: DataFrame, md: str = "md", key: str = "doc_id", carry: str | None = None) -> DataFrame:
    """(key, marked_md, block_count, ``carry``): a mark follows each block, after a table's last row.

    ``carry`` goes through the exchange once, so that a document's other columns need no join afterwards.
    """
    rows = numbered_lines(lines(df, md, key, carry), key)
    order = Window.partitionBy(key).orderBy("line_no")
    # a mark is due at the block's last line: for a table where the next line is outside it
    rows = rows.withColumn("_next", F.coalesce(F.lead("_inside").over(order), F.lit(False)))
    opener = F.last(F.when(F.col("starts"), F.col("kind")), ignorenulls=True).over(order)
    due = (F.col("starts") | F.col("_inside")) & ~F.col("_next")
    mark = F.concat(F.lit("\n<!-- block_id=b"), F.lpad(F.col("block_no").cast("string"), 4, "0"), F.lit(" type="), opener, F.lit(" -->"))
    wide = F.when(F.col("block_no") > 9999, F.concat(F.lit("\n<!-- block_id=b"), F.col("block_no").cast("string"), F.lit(" type="), opener, F.lit(" -->"))).otherwise(mark)
    rows = rows.withColumn("_out", F.concat("line", F.when(due, wide).otherwise(F.lit(""))))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_out"))), lambda x: x["_out"]), "\n")
    kept = [F.first(carry, ignorenulls=True).alias(carry)] if carry else []
    return rows.groupBy(key).agg(whole.alias("marked_md"), F.max("block_no").alias("block_count"), *kept)


def block_counts(df: DataFrame, md: str = "md", key: str = "doc_id") -> DataFrame:
    """(key, block_type, n)."""
    rows = numbered_lines(lines(df, md, key), key).where("starts")
    return rows.groupBy(key, F.col("kind").alias("block_type")).agg(F.count("*").alias("n"))


def unsupported_count(md: Column) -> Column:
    return F.regexp_count(md, F.lit("<!-- (?:" + "|".join(UNSUPPORTED) + ")"))


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """A YAML block of the fields that are not null, in order, and a blank line."""
    rows = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields]
    return F.concat_ws("\n", F.lit("---"), *rows, F.lit("---"), F.lit(""), F.lit(""))


def quoted(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"')))


def positive(value: Column) -> Column:
    return F.when(value > 0, value.cast("string"))


def agent_notice(warnings: Column, ocr_used: Column) -> Column:
    """A comment for each warning (array of code, message, location); empty without warnings and OCR."""

    def one(w: Column) -> Column:
        place = F.when(F.coalesce(w["location"], F.lit("")) != "", F.concat(F.lit(" @ "), w["location"])).otherwise(F.lit(""))
        return F.concat(F.lit("<!-- WARNING: ["), w["code"], F.lit("] "), w["message"], place, F.lit(" -->"))

    rows = F.concat(
        F.array(F.lit("<!-- AI_AGENT_NOTICE: START -->"), F.lit("<!-- 此文档由机器自动转换生成，部分内容可能存在丢失或降级，请参阅 .quality_report.json 获取详情 -->")),
        F.when(ocr_used, F.array(F.lit("<!-- OCR_MODE: 原文档无可提取文字，已使用 OCR 识别，结果可能不够准确 -->"))).otherwise(F.array().cast("array<string>")),
        F.transform(warnings, one),
        F.array(F.lit("<!-- AI_AGENT_NOTICE: END -->"), F.lit(""), F.lit("")),
    )
    return F.when((F.size(warnings) == 0) & ~ocr_used, F.lit("")).otherwise(F.array_join(rows, "\n"))
