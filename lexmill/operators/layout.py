"""Positioned words: sizes and weights, clusters of a row's words, pages of two columns.

Input rows: doc_id, page, text, left, right, top, height, font_size, font_name (page y grows upward).  Rows, lines and tables
are in ``page_tables``, kinds and paragraphs in ``page_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOLD_NAMES = ("bold", "bd", "black", "heavy")


def font_facts(words: DataFrame) -> DataFrame:
    """``words`` with size (letter size if at least 5, else the height, else 10) and bold."""
    size = F.when(F.col("font_size") >= 5, F.col("font_size")).when(F.col("height") > 0, F.col("height")).otherwise(F.lit(10.0))
    low = F.lower(F.coalesce("font_name", F.lit("")))
    bold = F.greatest(*[low.contains(n).cast("int") for n in BOLD_NAMES]) == 1
    return words.withColumn("size", size).withColumn("bold", bold)


def cell_gaps(words: DataFrame, row: list[str]) -> DataFrame:
    """Clusters of the words of each row (named by the columns ``row``): cluster no., left, right, text.

    A new cluster begins where the gap to the word before exceeds 3 mean character widths, 15 at least;
    rows of a single word have none.
    """
    order = Window.partitionBy(*row).orderBy("left", "right", "text")
    whole = Window.partitionBy(*row)
    width = F.avg((F.col("right") - F.col("left")) / F.greatest(F.length("text"), F.lit(1))).over(whole)
    df = words.withColumn("_gap", F.col("left") - F.lag("right").over(order)).withColumn("_limit", F.greatest(width * 3, F.lit(15.0)))
    df = df.withColumn("cluster", F.sum(F.when(F.col("_gap") > F.col("_limit"), 1).otherwise(0)).over(order)).withColumn("_n", F.count("*").over(whole))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "right", "text"))), lambda x: x["text"]), "")
    return df.where("_n > 1").groupBy(*row, "cluster").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.trim(text).alias("text"))


def two_column_pages(words: DataFrame) -> DataFrame:
    """(doc_id, checked, two_column, warns): over the first ten pages of at least ten words."""
    mid = F.col("page_width") / 2
    pages = words.where("page <= 10").groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.count_if(F.col("right") < mid).alias("l"), F.count_if(F.col("left") >= mid).alias("r")
    )
    pages = pages.where("n >= 10").withColumn("two", (F.col("l") > F.col("n") * 0.3) & (F.col("r") > F.col("n") * 0.3))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("checked"), F.count_if("two").alias("two_column"))
    return out.withColumn("warns", F.col("two_column") > F.floor(F.col("checked") / 2))


def pdf_error(message: Column) -> Column:
    """The kind of failure that a reader's message tells of."""
    low = F.lower(F.coalesce(message, F.lit("")))
    locked = low.contains("encrypt") | low.contains("password")
    return F.when(locked, F.lit("encrypted")).when(low.contains("corrupt") | low.contains("invalid"), F.lit("corrupted")).otherwise(F.lit("other"))
