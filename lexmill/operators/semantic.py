"""The semantic blocks of Markdown: headings, paragraphs, tables, lists, quotes, rules, inline runs.

Lines are classified one by one; blocks are runs of lines, found by comparing a line's kind with that of
the line before it among all lines (tables), among lines that are no comment (paragraphs), or among those
that are neither comment nor blank (lists and quotes, which so go on across blanks).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import trimmed
from lexmill.operators.blocks import lines

HEADING, BULLET, NUMBERED, QUOTE = r"^(#{1,6})\s+(.+)", r"^(\s*)([-*+])\s+(.+)", r"^(\s*)(\d+)\.\s+(.+)", r"^>\s*(.*)"
RULE, SEPARATOR = r"^(-{3,}|\*{3,}|_{3,})$", r"^\|[\s\-:|]+\|$"
RUNS_OF = ("table", "paragraph", "bullet", "numbered", "quote")


def edge_trimmed(line: Column) -> Column:
    """``trimmed`` of a plain column: a line whose first and last characters show isn't searched for blanks."""
    edges = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
    return F.when(edges.rlike(r"(?U)\s"), trimmed(line)).otherwise(line)


def line_kind(line: Column, t: Column | None = None) -> Column:
    """The kind of a line; ``t`` is the line trimmed, if it is at hand."""
    t = trimmed(line) if t is None else t
    out = F.when(t == "", F.lit("blank")).when(t.startswith("<!--"), F.lit("comment")).when(line.rlike(HEADING), F.lit("heading"))
    out = out.when(t.startswith("|"), F.lit("table")).when(line.rlike(BULLET), F.lit("bullet")).when(line.rlike(NUMBERED), F.lit("numbered"))
    return out.when(t.rlike(RULE), F.lit("rule")).when(t.rlike(QUOTE), F.lit("quote")).otherwise(F.lit("paragraph"))


def body_lines(df: DataFrame, md: str = "md", key: str = "doc_id") -> DataFrame:
    """``lines`` without the front matter and with comments of several lines marked as such."""
    rows = lines(df, md, key).withColumn("_t", edge_trimmed(F.col("line")))  # once for all that follows
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("line_no")
    # a comment that opens without closing on its line runs to the first line that has the end mark
    opened = F.col("_t").startswith("<!--") & ~F.col("_t").endswith("-->")
    rows = rows.select(
        key, "line_no", "line", (F.col("_t") == "---").alias("_dashes"), line_kind(F.col("line"), F.col("_t")).alias("kind"),
        F.when(opened, F.lit(True)).when(F.col("line").contains("-->"), F.lit(False)).alias("_opens"),
    )
    opens = F.max(F.when((F.col("line_no") == 0) & F.col("_dashes"), 1).otherwise(0)).over(whole) == 1
    close = F.min(F.when((F.col("line_no") > 0) & F.col("_dashes"), F.col("line_no"))).over(whole)
    rows = rows.withColumn("_skip", opens & (F.col("line_no") <= F.coalesce(close, F.lit(1 << 30)))).where("not _skip").drop("_skip", "_dashes")
    before = F.last("_opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("kind", F.when(F.coalesce(before, F.lit(False)), F.lit("comment")).otherwise(F.col("kind"))).drop("_opens")


def numbered(df: DataFrame, md: str = "md", key: str = "doc_id") -> DataFrame:
    """Lines with kind and block (running number from 1); blank and comment lines are left out."""
    rows = body_lines(df, md, key)
    order = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("_a", F.lag("kind").over(order))
    seen = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_b", F.last(F.when(F.col("kind") != "comment", F.col("kind")), ignorenulls=True).over(seen))
    rows = rows.withColumn("_c", F.last(F.when(~F.col("kind").isin("comment", "blank"), F.col("kind")), ignorenulls=True).over(seen))
    rows = rows.where(~F.col("kind").isin("comment", "blank"))
    before = F.when(F.col("kind") == "table", F.col("_a")).when(F.col("kind") == "paragraph", F.col("_b")).otherwise(F.col("_c"))
    new = ~F.col("kind").isin(*RUNS_OF) | F.coalesce(before != F.col("kind"), F.lit(True))
    return rows.withColumn("block", F.sum(new.cast("int")).over(order)).drop("_a", "_b", "_c")


def table_cells(line: Column) -> Column:
    """The cells between the first and the last bar, trimmed."""
    parts = F.split(trimmed(line), r"\|", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), trimmed)


def inner(kind: Column, line: Column) -> Column:
    """What a line says without its mark."""
    out = F.when(kind == "heading", trimmed(F.regexp_extract(line, HEADING, 2))).when(kind == "bullet", trimmed(F.regexp_extract(line, BULLET, 3)))
    out = out.when(kind == "numbered", trimmed(F.regexp_extract(line, NUMBERED, 3))).when(kind == "quote", F.regexp_extract(trimmed(line), QUOTE, 1))
    return out.otherwise(line)


def blocks(df: DataFrame, md: str = "md", key: str = "doc_id") -> DataFrame:
    """(key, block, block_type, level, items, rows): items are a list's entries or the block's one text."""
    rows = numbered(df, md, key)
    is_sep = (F.col("kind") == "table") & trimmed(F.col("line")).rlike(SEPARATOR)
    cells = F.when((F.col("kind") == "table") & ~is_sep, table_cells(F.col("line")))
    rows = rows.withColumn("text", inner(F.col("kind"), F.col("line"))).withColumn("cells", F.when(F.exists(cells, lambda c: c != ""), cells))
    each = F.sort_array(F.collect_list(F.struct("line_no", "text", "cells")))
    made = rows.groupBy(key, "block").agg(F.first("kind").alias("block_type"), F.max(F.length(F.regexp_extract("line", HEADING, 1))).alias("level"), each.alias("e"))
    texts = F.transform("e", lambda x: x["text"])
    one = F.array(trimmed(F.array_join(texts, "\n")))
    items = F.when(F.col("block_type").isin("bullet", "numbered"), texts).when(F.col("block_type").isin("heading", "paragraph", "quote"), one)
    table = F.when(F.col("block_type") == "table", F.filter(F.transform("e", lambda x: x["cells"]), lambda c: c.isNotNull()))
    return made.select(key, "block", "block_type", F.when(F.col("block_type") == "heading", F.col("level")).alias("level"), items.alias("items"), table.alias("rows"))


#: Inline marks, the longest first.
MARKS = ((r"\*\*\*", "bold_italic"), (r"\*\*", "bold"), (r"\*", "italic"), ("~~", "strike"), ("`", "code"))
_TOKEN = "|".join(f"{m}(.+?){m}" for m, _ in MARKS)


def without_links(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")


def inline_runs(text: Column) -> Column:
    """array of (text, style): the leftmost mark first, without nesting; plain runs between."""
    plain = without_links(text)
    found = F.regexp_extract_all(plain, F.lit(f"(?:{_TOKEN})"), F.lit(0))
    gaps = F.split(plain, f"(?:{_TOKEN})", -1)
    style = reduce(lambda rest, m: lambda x: F.when(x.rlike(f"^{m[0]}.+?{m[0]}$"), F.lit(m[1])).otherwise(rest(x)), reversed(MARKS), lambda x: F.lit("plain"))
    bare = reduce(lambda rest, m: lambda x: F.when(x.rlike(f"^{m[0]}.+?{m[0]}$"), F.regexp_replace(x, f"^{m[0]}|{m[0]}$", "")).otherwise(rest(x)), reversed(MARKS), lambda x: x)
    marked = F.transform(found, lambda x: F.struct(bare(x).alias("text"), style(x).alias("style")))
    between = F.transform(gaps, lambda g: F.struct(g.alias("text"), F.lit("plain").alias("style")))
    woven = F.flatten(F.transform(F.arrays_zip(between.alias("g"), marked.alias("m")), lambda z: F.array(z["g"], z["m"])))
    return F.filter(woven, lambda r: r.isNotNull() & (r["text"] != ""))


def clean_inline(text: Column) -> Column:
    out = reduce(lambda c, m: F.regexp_replace(c, f"{m[0]}(.+?){m[0]}", "$1"), MARKS, without_links(text))
    return trimmed(out)
