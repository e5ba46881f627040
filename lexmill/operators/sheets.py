"""Sheets: sparse cells to Markdown previews, CSV texts and warnings.

Input rows: doc_id, sheet_no, sheet, row, col (from 0), value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import csv_field, is_date_style, md_cell, safe_file_name, serial_date

PREVIEW_ROWS = 50
KEY = ["doc_id", "sheet_no", "sheet"]
WARNINGS = "array<struct<code:string,message:string,location:string>>"


def cell_value(kind: Column, raw: Column, format_id: Column, format_code: Column) -> Column:
    """The text of a cell by its kind (inlineStr: also of shared strings, b, e, else a number)."""
    text = F.coalesce(raw, F.lit(""))
    out = F.when(text == "", F.lit("")).when(kind == "b", F.when(text == "1", F.lit("TRUE")).otherwise(F.lit("FALSE"))).when(kind == "e", F.concat(F.lit("#"), text))
    number = text.try_cast("double")
    is_date = F.coalesce(kind, F.lit("n")).isin("n", "") & number.isNotNull() & is_date_style(format_id, format_code)
    return out.when(is_date, serial_date(number)).otherwise(text)


def _gap(items: Column, place: str, fill: str, text: str) -> Column:
    """``text`` of each item in order of ``place``, after as many ``fill`` as places from the item before (from 0 at first)."""

    def one(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(items, i - 1)[place], F.lit(0))
        return F.concat(F.repeat(F.lit(fill), (x[place] - before).cast("int")), x[text])

    return F.transform(items, one)


def grids(cells: DataFrame, facts: tuple[str, ...] = ()) -> DataFrame:
    """(key, rows, cols, lines, facts): a sheet's last row and column, and its rows in order with their cells' texts.

    A line has row, last (its last column), filled, md and csv, both with the gaps between its cells but not
    after them.  A cell without ``col`` only says that its row exists, one without ``row`` its sheet; rows
    before the first (0) are not shown.  With a column ``seq`` the last write of a cell wins.  ``facts`` are columns of which a sheet's first value is kept.
    Cells, rows and sheets are gathered in turn, so a large sheet is spread until its lines are made.
    """
    some = cells.withColumn("col", F.col("col").cast("int")).withColumn("row", F.col("row").cast("long"))
    kept = [F.first(c, ignorenulls=True).alias(c) for c in facts]
    if "seq" in cells.columns:
        some = some.groupBy(*KEY, "row", "col").agg(F.max_by("value", "seq").alias("value"), *kept)
    text = F.coalesce("value", F.lit(""))
    held = F.when(F.col("col").isNotNull(), F.struct("col", (text != "").alias("filled"), md_cell(text).alias("md"), csv_field(text).alias("csv")))
    row = some.groupBy(*KEY, "row").agg(F.sort_array(F.collect_list(held)).alias("at"), *kept)
    joined = lambda fill, kind: F.array_join(_gap(F.col("at"), "col", fill, kind), "")
    last = F.coalesce(F.array_max(F.transform("at", lambda x: x["col"])), F.lit(0))
    row = row.select(*KEY, "row", last.alias("last"), F.exists("at", lambda x: x["filled"]).alias("filled"), joined(" | ", "md").alias("md"), joined(",", "csv").alias("csv"), *facts)
    line = F.when(F.col("row") >= 0, F.struct("row", "last", "filled", "md", "csv"))
    return row.groupBy(*KEY).agg(F.max("row").alias("rows"), F.max("last").alias("cols"), F.sort_array(F.collect_list(line)).alias("lines"), *kept)


def _preview(limit: int) -> Column:
    """The first rows of a grid as a table; empty rows are left out, the rule follows row 0 only."""
    rule = F.concat(F.lit("\n| "), F.repeat(F.lit("--- | "), F.col("cols")), F.lit("--- |"))
    shown = F.filter("lines", lambda x: (x["row"] < limit) & x["filled"])
    one = lambda x: F.concat(
        F.lit("| "), x["md"], F.repeat(F.lit(" | "), F.col("cols") - x["last"]), F.lit(" |"), F.when(x["row"] == 0, rule).otherwise(F.lit(""))
    )
    return F.array_join(F.transform(shown, one), "\n")


def _csv() -> Column:
    """Every row of a grid, empty ones too."""
    empty = F.concat(F.repeat(F.lit(","), F.col("cols")), F.lit("\n"))

    def one(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("lines"), i - 1)["row"], F.lit(-1).cast("long"))
        return F.concat(F.repeat(empty, (x["row"] - before - 1).cast("int")), x["csv"], F.repeat(F.lit(","), F.col("cols") - x["last"]))

    return F.array_join(F.transform("lines", one), "\n")


def previews(cells: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """(key, preview, truncated)."""
    return grids(cells).select(*KEY, _preview(limit).alias("preview"), (F.col("rows") + 1 > limit).alias("truncated"))


def csv_texts(cells: DataFrame) -> DataFrame:
    """(key, csv)."""
    return grids(cells).select(*KEY, _csv().alias("csv"))


#: What is said of a sheet that is shown in part.
TRUNCATED = "<!-- TABLE_TRUNCATED: 工作表「%s」共有 %d 行，仅展示前 {0} 行预览，完整数据见 tables/ 目录 -->"
TRUNCATED_NOTE = "> *表格已截断：共 %d 行，仅展示前 {0} 行*"
TRUNCATED_WARNING = "工作表「%s」共 %d 行，仅展示前 {0} 行"


def sheet_markdown(cells: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """(doc_id, body, warnings, tables, sheet_count): the sheets between their marks, a rule before all but the first.

    ``cells`` may have the columns of a file's rows (``kind`` and what it loses): then a sheet without rows has no
    table, one of kind ``none`` neither table nor end mark, and the row of sheet -1 gives warnings, source_size,
    source_sha256 and error.  Sheets with more rows than the preview are given whole as CSV texts in ``tables``.
    """
    whole = "kind" in cells.columns
    facts = ("source_size", "source_sha256", "error") if whole else ()
    if whole:
        grid = grids(cells.withColumn("there", F.when(F.col("row").isNull(), F.col("kind") != "none")), ("there", "warnings", *facts))
    else:
        grid = grids(cells).withColumn("there", F.lit(True)).withColumn("warnings", F.array().cast(WARNINGS))
    n, cut = F.col("rows") + 1, F.coalesce(F.col("rows") + 1 > limit, F.lit(False))
    say = lambda text, *values: F.format_string(text.format(limit), *values)
    name = F.col("sheet")
    note = F.when(cut, F.concat(F.lit("\n"), say(TRUNCATED, name, n), F.lit("\n"), say(TRUNCATED_NOTE, n), F.lit("\n"))).otherwise(F.lit(""))
    preview = _preview(limit)
    table = F.when(F.col("rows").isNull(), F.lit("")).otherwise(F.concat(preview, F.when(preview == "", F.lit("")).otherwise(F.lit("\n")), note))
    ends = F.when(F.col("there"), F.concat(table, F.lit("<!-- SHEET_END -->\n"))).otherwise(F.lit(""))
    warning = F.struct(F.lit("W_TABLE_TRUNCATED").alias("code"), say(TRUNCATED_WARNING, name, n).alias("message"), name.alias("location"))
    known = F.coalesce("warnings", F.array().cast(WARNINGS))
    sheet = F.struct(
        "sheet_no",
        name.alias("name"),
        F.col("there"),
        F.concat(F.lit("## "), name, F.lit("\n\n"), ends).alias("text"),
        F.when(cut, F.concat(known, F.array(warning))).otherwise(known).alias("warnings"),
        F.when(cut, F.array(F.struct(F.concat(safe_file_name(name), F.lit(".csv")).alias("name"), F.concat(_csv(), F.lit("\n")).alias("csv")))).otherwise(F.array().cast("array<struct<name:string,csv:string>>")).alias("tables"),
    )
    own = F.col("sheet_no") >= 0
    kept = [F.first(c, ignorenulls=True).alias(c) for c in facts]
    out = grid.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(own, F.struct("sheet_no", sheet.alias("s"))))).alias("all"), *kept)
    first = F.array_min(F.transform(F.filter("all", lambda x: x["s"]["there"]), lambda x: x["sheet_no"]))  # a sheet without a part leaves the next one first
    rule = lambda x: F.when(F.coalesce(x["sheet_no"] <= first, F.lit(True)), F.lit("")).otherwise(F.lit("\n---\n\n"))
    body = F.transform("all", lambda x: F.concat(F.lit("<!-- SHEET_START: "), x["s"]["name"], F.lit(" -->\n"), rule(x), x["s"]["text"]))
    flat = lambda c: F.flatten(F.transform("all", lambda x: x["s"][c]))
    return out.select("doc_id", F.array_join(body, "").alias("body"), flat("warnings").alias("warnings"), flat("tables").alias("tables"), F.size("all").alias("sheet_count"), *facts)
