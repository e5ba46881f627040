"""Format checks and target formats of word-processor documents, over extracted properties.

Input of the checks: ``sections`` (doc_id, width, height, top, bottom, left, right, grid_pitch in twips, all
null where missing), ``paragraphs`` (doc_id, para_no, text, style, centred, fonts and sizes of runs, line,
line_rule, first_indent) and ``tables`` (doc_id, table_no, cells: the most in a row).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.config import OFFICIAL, Formatting
from lexmill.functions.text import centimetre_twips, is_blank, trimmed_start

A4 = (11906, 16838)
ISSUE = "struct<code:string,severity:string,message:string>"


def heading_of(style: Column, text: Column) -> Column:
    """1 to 3, or 0: by the style's name, else by how the text begins."""
    s, t = F.coalesce(style, F.lit("")), trimmed_start(F.coalesce(text, F.lit("")))
    by_style = [(s.contains(f"Heading{n}") | s.contains(f"标题{n}"), n) for n in (1, 2, 3)]
    by_text = [(t.rlike("^[一二三四五六七八九十]+、"), 1), (t.rlike("^（[一二三四五六七八九十]+）"), 2), (t.rlike(r"^\d+[.、]"), 3)]
    return reduce(lambda rest, c: F.when(c[0], F.lit(c[1])).otherwise(rest), reversed(by_style + by_text), F.lit(0))


def paragraph_roles(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with role: title (the first that isn't blank, if centred), heading1 to 3, body or blank."""
    order = Window.partitionBy("doc_id").orderBy("para_no")
    filled = ~is_blank(F.col("text"))
    nth = F.sum(filled.cast("int")).over(order)
    level = heading_of(F.col("style"), F.col("text"))
    role = F.when(~filled, F.lit("blank")).when((nth == 1) & F.coalesce("centred", F.lit(False)), F.lit("title"))
    role = role.when(level > 0, F.concat(F.lit("heading"), level.cast("string"))).otherwise(F.lit("body"))
    return paragraphs.withColumn("nth", nth).withColumn("role", role)


def target_format(paragraphs: DataFrame, options: Formatting = OFFICIAL) -> DataFrame:
    """Roles with the font, size, bold, indent (twips, characters x 280) and spacing that each is to get."""
    pick = lambda values, other: reduce(
        lambda rest, i: F.when(F.col("role") == f"heading{i + 1}", F.lit(values[i])).otherwise(rest), range(3), F.when(F.col("role") == "title", F.lit(other[0])).otherwise(F.lit(other[1]))
    )
    df = paragraph_roles(paragraphs).where("role <> 'blank'")
    indent = F.when(F.col("role") == "title", F.lit(0)).otherwise((pick(options.heading_indents, (0.0, options.first_indent)) * 280).cast("int"))
    return df.select(
        "doc_id",
        "para_no",
        "role",
        pick(options.heading_fonts, (options.title_font, options.body_font)).alias("font"),
        pick(options.heading_sizes, (options.title_size, options.body_size)).alias("size"),
        pick(options.heading_bolds, (options.title_bold, False)).alias("bold"),
        indent.alias("indent"),
        F.lit(int(options.line_spacing * 20)).alias("line"),
    )


def _issue(code: str, level: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"), F.lit(message).alias("message"))


def check(sections: DataFrame, paragraphs: DataFrame, tables: DataFrame, options: Formatting = OFFICIAL) -> DataFrame:
    """(doc_id, code, severity, message): every finding."""
    o = options
    margins = {"top": o.margin_top, "bottom": o.margin_bottom, "left": o.margin_left, "right": o.margin_right}
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in margins])
    pitch = F.floor((F.col("height") - F.col("top") - F.col("bottom")) / o.lines_per_page)
    page = F.array(
        F.when((F.col("width") != A4[0]) | (F.col("height") != A4[1]), _issue("F_PAGE_SIZE", "medium", "not A4")),
        F.when(missing, _issue("F_MARGIN_MISSING", "medium", "no margins")),
        *[F.when(F.abs(F.col(k) / 567 - v) > 0.2, _issue(f"F_MARGIN_{k.upper()}", "low", f"{k} margin is not {v} cm")) for k, v in margins.items()],
        F.when(F.abs(F.col("grid_pitch") - pitch) > 20, _issue("F_DOC_GRID", "low", "line grid")),
    )
    found = [sections.select("doc_id", F.explode(F.filter(page, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")]
    bad = lambda c, wrong: F.size(F.filter(F.coalesce(c, F.array()), wrong))
    p = paragraphs.where(~is_blank(F.col("text"))).select(  # numbers only, so that texts aren't sorted
        "doc_id", "para_no", F.struct(F.get("fonts", F.lit(0)).alias("font"), F.get("sizes", F.lit(0)).alias("size")).alias("lead"),
        bad(F.col("fonts"), lambda f: f.isNotNull() & (f != o.body_font)).alias("fonts"), bad(F.col("sizes"), lambda s: s.isNotNull() & (F.abs(s - o.body_size) > 1)).alias("sizes"),
        ((F.col("line_rule") == "exact") & (F.abs(F.col("line").try_cast("double") / 20 - o.line_spacing) > 1)).alias("lines"), (F.coalesce("first_indent", F.lit(0)) <= 0).alias("indents"),
    )
    p = p.withColumn("nth", F.count("*").over(Window.partitionBy("doc_id").orderBy("para_no")))
    early, later = F.col("nth").between(2, 21), F.col("nth") > 1
    facts = p.groupBy("doc_id").agg(
        F.first(F.when(F.col("nth") == 1, F.col("lead")), ignorenulls=True).alias("title"), F.sum(F.when(early, F.col("fonts"))).alias("fonts"), F.sum(F.when(early, F.col("sizes"))).alias("sizes"),
        F.count_if(later & F.col("lines")).alias("lines"), F.count_if(later & F.col("indents")).alias("indents"),
    )
    font, size = F.col("title.font"), F.col("title.size")
    each = F.array(
        F.when(F.col("title").isNotNull() & font.isNull(), _issue("F_TITLE_FONT_MISSING", "medium", "title without a font")),
        F.when(font != o.title_font, _issue("F_TITLE_FONT", "medium", f"title font is not {o.title_font}")),
        F.when(F.abs(size - o.title_size) > 1, _issue("F_TITLE_SIZE", "low", f"title size is not {o.title_size}")),
        F.when(F.col("fonts") > 3, _issue("F_BODY_FONT", "medium", f"body font is not {o.body_font}")),
        F.when(F.col("sizes") > 3, _issue("F_BODY_SIZE", "low", f"body size is not {o.body_size}")),
        F.when(F.col("lines") > 3, _issue("F_LINE_SPACING", "low", f"line spacing is not {o.line_spacing}")),
        F.when(F.col("indents") > 5, _issue("F_FIRST_INDENT", "low", "no first-line indent")),
    )
    found.append(facts.select("doc_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*"))
    usable = sections.select("doc_id", (F.col("width") - F.col("left") - F.col("right")).alias("usable"))
    wide = tables.join(usable, "doc_id").where(F.col("cells") * 600 > F.col("usable"))
    found.append(wide.select("doc_id", _issue("F_TABLE_WIDTH", "low", "table too wide").alias("x")).select("doc_id", "x.*"))
    empty = sections.select("doc_id").distinct().join(facts.select("doc_id"), "doc_id", "left_anti")
    found.append(empty.select("doc_id", _issue("F_EMPTY_DOCUMENT", "high", "empty document").alias("x")).select("doc_id", "x.*"))
    return reduce(DataFrame.unionByName, found)


def reports(sections: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, passed, issues): passed without a high finding."""
    each = issues.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("code", "severity", "message"))).alias("issues"), (F.count_if(F.col("severity") == "high") == 0).alias("passed"))
    out = sections.select("doc_id").distinct().join(each, "doc_id", "left")
    return out.select("doc_id", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("issues", F.array().cast(f"array<{ISSUE}>")).alias("issues"))


def page_settings(options: Formatting = OFFICIAL) -> dict[str, int]:
    """Twips of the margins, cut as the formatter does."""
    return {k: int(v * 567) for k, v in {"top": options.margin_top, "bottom": options.margin_bottom, "left": options.margin_left, "right": options.margin_right}.items()}


def margin_columns(cm: dict[str, Column]) -> dict[str, Column]:
    return {k: centimetre_twips(v) for k, v in cm.items()}
