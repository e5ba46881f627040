"""Word-processor paragraphs and tables to Markdown.

Input rows: path, elem_no, style, num_id, level, ordered, runs (array of text, bold, italic, strike,
link), rows (of a table: cells of paragraphs of runs).  List numbers are counters with resets across levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, md_cell, trimmed


def heading_level(style: Column) -> Column:
    digits = F.regexp_extract(style, r"(\d+)", 1).try_cast("int")
    return F.when(digits.between(1, 6), digits).otherwise(F.lit(1))


def is_ordered_format(number_format: Column) -> Column:
    low = F.lower(F.coalesce(number_format, F.lit("")))
    return (low != "") & ~low.isin("bullet", "none")


def run_text(run: Column) -> Column:
    """Bold and italic as stars; a strike shows only on a run that is neither."""
    t = F.coalesce(run["text"], F.lit(""))
    b, i, s = (F.coalesce(run[k], F.lit(False)) for k in ("bold", "italic", "strike"))
    wrap = lambda m: F.concat(F.lit(m), t, F.lit(m))
    shown = F.when(t == "", t).when(b & i, wrap("***")).when(b, wrap("**")).when(i, wrap("*")).when(s, wrap("~~")).otherwise(t)
    url = F.replace(F.replace(run["link"], F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.when(F.coalesce(run["link"], F.lit("")) != "", F.concat(F.lit("["), t, F.lit("]("), url, F.lit(")"))).otherwise(shown)


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, run_text), "")


#: Levels of a list, as the format has them; deeper ones reset nothing further.
LEVELS = 9


def with_list_numbers(df: DataFrame, item: Column, leaves: Column, key: str = "doc_id", order: str = "elem_no") -> DataFrame:
    """``df`` with the number of each ``item``, null elsewhere: counters per list (num_id) and level.

    A row that ``leaves`` the lists resets all; an item resets the deeper levels of its list.  All windows
    have the document as leading key, so one exchange feeds them.
    """
    rows = df.withColumn("_item", F.coalesce(item, F.lit(False))).withColumn("_part", F.sum(leaves.cast("int")).over(Window.partitionBy(key).orderBy(order)))
    level = F.least(F.coalesce(F.col("level"), F.lit(0)), F.lit(LEVELS - 1))
    inside = Window.partitionBy(key, "_part", "num_id", "_item").orderBy(order)
    resets = F.array(*[F.max(F.when(level < deeper, F.col(order))).over(inside) for deeper in range(1, LEVELS)])
    rows = rows.withColumn("_since", F.when(level > 0, F.get(resets, level - 1)))
    number = F.row_number().over(Window.partitionBy(key, "_part", "num_id", "_item", "level", "_since").orderBy(order))
    return rows.withColumn("number", F.when(F.col("_item"), number)).drop("_item", "_part", "_since")


def list_numbers(df: DataFrame, key: str = "doc_id", order: str = "elem_no") -> DataFrame:
    """(key, order, number) of the list items; a paragraph outside any list resets all counters."""
    listed = F.col("num_id").isNotNull()
    return with_list_numbers(df, listed, ~listed, key, order).where(listed).select(key, order, "number")


def paragraph_line(style: Column, num_id: Column, ordered: Column, number: Column, runs: Column) -> Column:
    plain = F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")
    style = F.coalesce(style, F.lit(""))
    in_list = num_id.isNotNull() | style.contains("List") | style.contains("列表")
    bullet = F.when(F.coalesce(ordered, F.lit(False)), F.concat(F.coalesce(number, F.lit(1)).cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    out = F.when(is_blank(plain), F.lit(None))
    out = out.when(style.startswith("Heading") | style.startswith("标题"), F.concat(F.repeat(F.lit("#"), heading_level(style)), F.lit(" "), trimmed(plain)))
    return out.when(in_list, F.concat(bullet, runs_text(runs))).otherwise(runs_text(runs))


def table_markdown(rows: Column) -> Column:
    """A table (array of rows of cells): as wide as its first row; short rows are filled, long ones kept."""
    width = F.size(F.get(rows, F.lit(0)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    filled = F.transform(rows, lambda r: F.concat(F.transform(r, md_cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
    lines = F.transform(filled, line)
    rule = F.array(line(F.array_repeat(F.lit("---"), width)))
    return F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def cell_text(paragraphs: Column) -> Column:
    """The paragraphs of a cell, each an array of runs, apart by a blank where text stands before."""
    joined = F.aggregate(paragraphs, F.lit(""), lambda a, p: F.concat(a, F.when(a != "", F.lit(" ")).otherwise(F.lit("")), runs_text(p)))
    return trimmed(joined)


def word_markdown(elements: DataFrame, key: str = "path") -> DataFrame:
    """(key, body, and facts) from the elements of each document, which have an order ``elem_no``.

    body: a line for what isn't blank, a blank line after a table.  Of the row with elem_no -1 (the file's)
    the columns warnings, assets, source_size, source_sha256 and error are kept.  One exchange by document.
    """
    plain = F.array_join(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))), "")
    paragraph = (F.col("elem_no") >= 0) & F.col("rows").isNull()
    none = F.coalesce(F.col("num_id"), F.lit("0")) == "0"
    item = paragraph & ~none & F.coalesce(F.col("ordered"), F.lit(False)) & ~is_blank(plain)
    e = with_list_numbers(elements, item, paragraph & none, key)
    cells = F.transform("rows", lambda r: F.transform(r, cell_text))
    table = F.when(F.size("rows") > 0, F.concat(table_markdown(cells), F.lit("\n")))
    line = F.when(F.col("rows").isNotNull(), table).otherwise(paragraph_line(F.col("style"), F.col("num_id"), F.col("ordered"), F.col("number"), F.col("runs")))
    shown = F.when((F.col("elem_no") >= 0) & (line != ""), F.struct("elem_no", line.alias("line")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    kept = [F.first(F.when(F.col("elem_no") == -1, F.col(c)), ignorenulls=True).alias(c) for c in ("warnings", "assets", "source_size", "source_sha256", "error")]
    return e.groupBy(key).agg(body.alias("body"), *kept)
