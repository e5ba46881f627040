"""Slides to Markdown.  Input rows: doc_id, slide_no, para_no, kind (slide, image, text or notes), text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, trimmed


def slides_markdown(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, body, slide_count): each slide between its marks; slides are counted as they come, without holes.

    A slide is there with any row, so an empty one needs a row of kind ``slide``; blank text is an empty line,
    blank notes go.  The row of slide -1 (the file's) gives warnings, assets, source_size, source_sha256 and error.
    """
    rows = paragraphs.where((F.col("kind") != "notes") | ~is_blank(F.col("text"))).withColumn("text", trimmed(F.col("text")))
    n = F.col("n")

    def texts(kind: str) -> Column:
        held = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("para_no", "text"))))
        return F.transform(held, lambda x: x["text"])

    def lines(texts: str, before: str) -> Column:
        return F.array_join(F.transform(texts, lambda t: F.concat(F.lit(before), t, F.lit("\n"))), "")

    facts = [c for c in ("warnings", "assets", "source_size", "source_sha256", "error") if c in paragraphs.columns]
    kept = lambda cs: [F.first(c, ignorenulls=True).alias(c) for c in cs]
    slides = rows.groupBy("doc_id", "slide_no").agg(*[texts(k).alias(k) for k in ("image", "text", "notes")], *kept(facts))
    own = F.col("slide_no") >= 0
    slides = slides.withColumn("n", F.sum(own.cast("int")).over(Window.partitionBy("doc_id").orderBy("slide_no")).cast("string"))
    notes = F.when(F.size("notes") > 0, F.concat(F.lit("\n> **备注**\n"), lines("notes", "> "))).otherwise(F.lit(""))
    images = F.array_join(F.transform("image", lambda x: F.concat(F.lit("![幻灯片 "), n, F.lit(" 图片](assets/"), x, F.lit(")\n"))), "")
    text = F.concat(F.lit("<!-- SLIDE_START: "), n, F.lit(" -->\n## 第 "), n, F.lit(" 页\n\n"), images, lines("text", ""), notes, F.lit("<!-- SLIDE_END: "), n, F.lit(" -->\n\n"))
    parts = F.transform(F.sort_array(F.collect_list(F.when(own, F.struct("slide_no", text.alias("text"))))), lambda x: x["text"])
    return slides.groupBy("doc_id").agg(F.array_join(parts, "").alias("body"), F.count_if(own).cast("int").alias("slide_count"), *kept(facts))
