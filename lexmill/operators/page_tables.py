"""Rows, lines and tables of pages as plans over positioned words.

Input: the words of ``layout.font_facts`` (doc_id, page, text, left, right, top, size, bold; page y grows upward) and, where a page
has ruling lines, their number in ``paths``.  The page is the unit: nothing here is gathered by document.

A row's limit counts from its first word, so where rows begin is a fold; it runs over the distinct tops of a page, not its words, and
keeps one number for each row, of which a page has no more than its height over the limit.  Columns are a fold over the distinct
lefts of a region with their counts.  All else is windows, aggregates and equi-joins: rows meet regions and lines meet rows by bins.

Words without a visible character, or without a place, are left out.  Words at one place are ordered by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.layout import cell_gaps
from lexmill.operators.ranges import range_join

PAGE = ["doc_id", "page"]
ORDER = ["left", "right", "text"]
#: Points of a bin of the range joins.
BIN = 24.0


def begins(tops: Column, limit: Column) -> Column:
    """The tops, from the highest down, at which a row begins: those further than ``limit`` below the row's first."""
    def step(found: Column, top: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        return F.when(last.isNull() | (last - top > limit), F.concat(found, F.array(top))).otherwise(found)

    return F.aggregate(F.sort_array(tops, asc=False), F.array().cast("array<double>"), step)


def upper_median(sizes: Column) -> Column:
    """Of an array of (size, n) sorted by size: the element at half the count, from 0."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda c, x: c + x["n"])
    state = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("m"))
    return F.aggregate(
        sizes, state, lambda s, x: F.struct((s["c"] + x["n"]).alias("c"), F.coalesce(s["m"], F.when(s["c"] + x["n"] > F.floor(total / 2), x["size"])).alias("m"))
    )["m"]


def page_facts(words: DataFrame) -> DataFrame:
    """(doc_id, page, median, paths, lines, rows): the upper median size, and where lines and loose rows begin."""
    paths = F.max("paths") if "paths" in words.columns else F.lit(0)
    sizes = words.groupBy(*PAGE, "size").agg(F.count("*").alias("n"), F.collect_set("top").alias("tops"), paths.alias("paths"))
    pages = sizes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("size", "n"))).alias("sizes"), F.array_distinct(F.flatten(F.collect_list("tops"))).alias("tops"), F.max("paths").alias("paths"))
    pages = pages.withColumn("median", upper_median(F.col("sizes")))
    lines = begins(F.col("tops"), F.greatest(F.lit(3.0), F.col("median") * 0.6))
    return pages.select(*PAGE, "median", "paths", lines.alias("lines"), begins(F.col("tops"), F.greatest("median", F.lit(10.0))).alias("rows"))


def visible(words: DataFrame) -> DataFrame:
    placed = F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull()
    return words.where(placed & F.col("text").rlike(r"(?U)\S"))


def numbered_words(words: DataFrame) -> DataFrame:
    """The visible words with the page's ``median`` and ``paths``, and their ``line_no`` and ``row_no`` from 0, top down."""
    words = visible(words)
    at = lambda c: (F.size(F.filter(c, lambda a: a >= F.col("top"))) - 1).alias({"lines": "line_no", "rows": "row_no"}[c])
    own = [c for c in words.columns if c != "paths"]
    return words.drop("paths").join(page_facts(words), PAGE).select(*own, "median", F.coalesce("paths", F.lit(0)).alias("paths"), at("lines"), at("rows"))


def text_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, left, top, size, bold) of ``numbered_words``; text is empty where nothing but page furniture stood.

    No blank stands between words with wide characters, nor where the gap is at most half a character of the word before.
    """
    order = Window.partitionBy(*PAGE, "line_no").orderBy(*ORDER)
    before = {c: F.lag(c).over(order) for c in ("text", "left", "right")}
    wide = before["text"].rlike(T.CJK) & F.col("text").rlike(T.CJK)
    mean = (before["right"] - before["left"]) / F.length(before["text"])
    glued = before["text"].isNull() | wide | ((mean > 0) & ((F.col("left") - before["right"]) / F.when(mean > 0, mean) <= 0.5))
    pieces = words.withColumn("piece", F.concat(F.when(glued, F.lit("")).otherwise(F.lit(" ")), "text")).withColumn("nth", F.row_number().over(order))
    lines = pieces.groupBy(*PAGE, "line_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "piece"))), lambda x: x["piece"]), "").alias("text"),
        F.min("left").alias("left"), F.avg("top").alias("top"), F.avg("size").alias("size"), F.bool_or("bold").alias("bold"),
    )
    return lines.withColumn("text", T.normal_spaces(T.without_page_artifacts(F.col("text"))))


def loose_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page, row_no, y, n_words, clusters, lefts, median, paths) of ``numbered_words``: the rows and their word clusters' lefts."""
    rows = words.groupBy(*PAGE, "row_no").agg(F.avg("top").alias("y"), F.count("*").alias("n_words"), F.max("median").alias("median"), F.max("paths").alias("paths"))
    cells = cell_gaps(words, [*PAGE, "row_no"]).groupBy(*PAGE, "row_no").agg(F.count("*").alias("clusters"), F.collect_list("left").alias("lefts"))
    return rows.join(cells, [*PAGE, "row_no"], "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))


def columns_of(lefts: Column, tolerance: float = 20.0) -> Column:
    """Greedy groups of an array of (left, n), sorted, around their running means: the means."""
    none = F.struct(F.array().cast("array<double>").alias("done"), F.lit(None).cast("double").alias("sum"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        near = F.abs(x["left"] - s["sum"] / F.when(s["n"] > 0, s["n"])) <= tolerance
        done = F.when(s["n"] > 0, F.concat(s["done"], F.array(s["sum"] / F.when(s["n"] > 0, s["n"])))).otherwise(s["done"])
        joined = F.struct(s["done"].alias("done"), (s["sum"] + x["left"] * x["n"]).alias("sum"), (s["n"] + x["n"]).alias("n"))
        return F.when(F.coalesce(near, F.lit(False)), joined).otherwise(F.struct(done.alias("done"), (x["left"] * x["n"]).alias("sum"), x["n"].alias("n")))

    return F.aggregate(lefts, none, step, lambda s: F.sort_array(F.when(s["n"] > 0, F.concat(s["done"], F.array(s["sum"] / F.when(s["n"] > 0, s["n"])))).otherwise(s["done"])))


def table_regions(rows: DataFrame) -> DataFrame:
    """(doc_id, page, region, n_rows, columns, low, high, median) of ``loose_rows``.

    Rows of several clusters belong together while each is near enough to the one of them before, whatever rows stand
    between; three make a region, if its clusters begin at two columns or more.
    """
    several = rows.where("clusters > 1")
    order = Window.partitionBy(*PAGE).orderBy("row_no")
    spread = F.col("median") * 1.5 * F.when(F.col("paths") > 5, 4.0).otherwise(2.5)
    apart = F.coalesce(F.lag("y").over(order) - F.col("y") > spread, F.lit(False))
    several = several.withColumn("apart", apart).withColumn("region", F.sum(F.col("apart").cast("long")).over(order))
    sizes = several.groupBy(*PAGE, "region").agg(F.count("*").alias("n_rows"), F.max("y").alias("highest"), F.min("y").alias("lowest"), F.max("median").alias("median"))
    lefts = several.select(*PAGE, "region", F.explode("lefts").alias("left")).groupBy(*PAGE, "region", "left").agg(F.count("*").alias("n"))
    lefts = lefts.groupBy(*PAGE, "region").agg(columns_of(F.sort_array(F.collect_list(F.struct("left", "n")))).alias("columns"))
    found = sizes.where("n_rows >= 3").join(lefts, [*PAGE, "region"]).where(F.size("columns") >= 2)
    return found.select(*PAGE, "region", "n_rows", "columns", (F.col("lowest") - F.col("median")).alias("low"), (F.col("highest") + F.col("median")).alias("high"), "median")


def table_cells(words: DataFrame, rows: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, region, row_no, cell_no, column, text): words of a region's rows by the column that holds their centre.

    Words of one column that follow each other make a cell.
    """
    inside = range_join(rows.select(*PAGE, "row_no", "y"), regions.select(*PAGE, "region", "columns", "low", "high"), PAGE, "y", "low", "high", BIN)
    splits = F.zip_with(F.slice("columns", 1, F.size("columns") - 1), F.slice("columns", 2, F.size("columns") - 1), lambda a, b: (a + b) / 2)
    inside = inside.select(*PAGE, "row_no", "region", splits.alias("splits"))
    centre = (F.col("left") + F.col("right")) / 2
    dealt = words.select(*PAGE, "row_no", *ORDER).join(inside, [*PAGE, "row_no"])
    dealt = dealt.withColumn("column", F.size(F.filter("splits", lambda s: centre > s)))
    order = Window.partitionBy(*PAGE, "row_no").orderBy(*ORDER)
    dealt = dealt.withColumn("nth", F.row_number().over(order)).withColumn("new", F.coalesce((F.col("column") != F.lag("column").over(order)).cast("int"), F.lit(0)))
    dealt = dealt.withColumn("cell_no", F.sum("new").over(order))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "")
    return dealt.groupBy(*PAGE, "region", "row_no", "cell_no").agg(F.max("column").alias("column"), T.trimmed(whole).alias("text"))


def table_rows(rows: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page, region, row_no, y, low, high, median, cells, text) of the regions in which two rows in five have several cells."""
    cell = F.struct("cell_no", "column", "text")
    made = cells.groupBy(*PAGE, "region", "row_no").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    made = made.withColumn("filled", F.size(F.filter("cells", lambda x: x["text"] != "")))
    good = made.where("filled > 0").groupBy(*PAGE, "region").agg(F.count("*").alias("n"), F.count_if(F.col("filled") >= 2).alias("full"))
    good = good.where("n >= 2 and full / n >= 0.4").select(*PAGE, "region")
    made = made.where("filled > 0").join(good, [*PAGE, "region"]).join(regions.select(*PAGE, "region", "low", "high", "median"), [*PAGE, "region"]).join(rows.select(*PAGE, "row_no", "y"), [*PAGE, "row_no"])
    plain = F.array_join(F.transform(F.filter("cells", lambda x: x["text"] != ""), lambda x: x["text"]), " ")
    kept = F.transform("cells", lambda x: F.struct(x["column"].alias("column"), x["text"].alias("text")))
    return made.select(*PAGE, "region", "row_no", "y", "low", "high", "median", kept.alias("cells"), plain.alias("text"))


def marked_lines(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """``text_lines`` with ``kind`` (body, table or empty), ``merged`` and ``cells``, by ``table_rows``.

    A line belongs to the first row that stands within 0.6 of the median size of it: a row's first line becomes the table's row and
    the others are merged into it.  Other short lines of a region that don't end a sentence are rows of one cell.
    """
    seen = lines.where("text <> ''").select(*PAGE, "line_no", "top")
    reach = F.col("median") * 0.6
    bands = rows.select(*PAGE, "row_no", (F.col("y") - reach).alias("below"), (F.col("y") + reach).alias("above"))
    met = range_join(seen, bands, PAGE, "top", "below", "above", BIN).groupBy(*PAGE, "line_no").agg(F.min("row_no").alias("row_no"))
    first = F.row_number().over(Window.partitionBy(*PAGE, "row_no").orderBy("line_no")) == 1
    met = met.withColumn("first", first).join(rows.select(*PAGE, "row_no", "cells", F.col("text").alias("row_text")), [*PAGE, "row_no"])
    areas = rows.select(*PAGE, "low", "high").distinct()
    within = range_join(seen, areas, PAGE, "top", "low", "high", BIN).select(*PAGE, "line_no", F.lit(True).alias("within")).distinct()
    out = lines.join(met.select(*PAGE, "line_no", "first", "cells", "row_text"), [*PAGE, "line_no"], "left").join(within, [*PAGE, "line_no"], "left")
    alone = F.col("within") & F.col("first").isNull() & (F.length("text") < 60) & ~T.ends_paragraph(F.col("text"))
    kind = F.when(F.col("text") == "", F.lit("empty")).when(F.col("first") | alone, F.lit("table")).otherwise(F.lit("body"))
    single = F.array(F.struct(F.lit(0).alias("column"), F.col("text").alias("text")))
    found = F.when(F.col("first"), F.col("cells")).when(F.coalesce(alone, F.lit(False)), single)
    text = F.when(F.col("first"), F.col("row_text")).otherwise(F.col("text"))
    merged = F.coalesce(~F.col("first"), F.lit(False))
    return out.select(*PAGE, "line_no", text.alias("text"), "left", "top", "size", "bold", kind.alias("kind"), merged.alias("merged"), found.alias("cells"))


def page_lines(words: DataFrame) -> DataFrame:
    """The lines of all pages, tables marked, from the words of ``layout.font_facts``."""
    own = numbered_words(words)
    rows = loose_rows(own)
    regions = table_regions(rows)
    return marked_lines(text_lines(own), table_rows(rows, regions, table_cells(own, rows, regions)))
