"""From the lines of pages to Markdown: kinds, headings over several lines, tables, paragraphs.

All rules compare a line with what came before it in the document, over page breaks too.  They are scans that go page by page
(``scans``), so a long document isn't one group.  Only the continuation of headings follows a state from line to line; a line that no
heading can take ends it whatever came before, and what stands between two such lines (of a page, and the next one's first) is folded on its own.

Input: the lines of ``page_tables.page_lines``.  Pages are numbered from 1; a page without lines has its mark all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import page_tables
from lexmill.operators.layout import font_facts
from lexmill.operators.scans import scanned
from lexmill.sources.staging import scratch, settle

DOC = ["doc_id"]
#: The numerals and marks that the rules name.
HAN = "一二三四五六七八九十"
MARKED = rf"第[{HAN}百千零\p{{Nd}}]+[章节条]"
COUNTED = f"[{HAN}]+、"
TOO_NARROW, TOO_EMPTY = "表格列数不足2列", "空单元格超过40%"


def with_page_marks(lines: DataFrame) -> DataFrame:
    """``lines`` and a line ``breaks`` ahead of every page, from the first to the document's last."""
    pages = lines.select(*DOC, "page").distinct()
    above = F.coalesce(F.lag("page").over(Window.partitionBy(*DOC).orderBy("page")), F.lit(0))  # over a row for each page
    marks = pages.withColumn("above", above).where("page > above").select(*DOC, F.explode(F.sequence(F.col("above") + 1, F.col("page"))).alias("page"))
    marks = marks.select(*DOC, F.col("page").cast("int").alias("page"), F.lit(-1).cast("int").alias("line_no"), F.lit("").alias("text"), F.lit("empty").alias("kind"), F.lit(False).alias("merged"), F.lit(True).alias("breaks"))
    return lines.withColumns({"breaks": F.lit(False), "page": F.col("page").cast("int"), "line_no": F.col("line_no").cast("int")}).unionByName(marks, allowMissingColumns=True)


def _number(digits: Column) -> Column:
    """A list number; 1 where it is no 32-bit number in ASCII digits."""
    value = F.when(digits.rlike("^[0-9]{1,10}$"), digits).cast("long")
    return F.when(value < 1 << 31, value).otherwise(1).cast("int")


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` with ``kind`` by what each begins with, else by weight and size, ``level`` and ``number``."""
    plain = ~F.col("kind").isin("empty", "table")
    seen = scanned(lines, DOC, "page", "line_no", last={"size_before": F.when(plain, F.col("size"))})
    text = T.trimmed(F.col("text"))
    begins = lambda p: text.rlike("^" + p)
    part = lambda p: F.regexp_extract(text, "^" + p, 1)
    in_han, in_digits, point = rf"（([{HAN}零]+)）", r"（(\p{Nd}+)）", r"(\p{Nd}+)(?:、|[.．](?!\p{Nd}))"
    heavy = (F.coalesce("bold", F.lit(False)) & (F.length(text) <= 30)) | F.coalesce((F.length(text) < 30) & (F.col("size") > F.col("size_before") * 1.3), F.lit(False))
    kinds = F.when(text == "", F.struct(F.lit("empty"), F.lit(0), F.lit(-1)))
    for test, kind, level, number in (
        (begins(rf"第[{HAN}百千零\p{{Nd}}]+[章节]"), "heading", 3, F.lit(-1)),
        (begins(rf"第[{HAN}百千零\p{{Nd}}]+条"), "heading", 4, F.lit(-1)),
        (begins(COUNTED), "heading", 4, F.lit(-1)),
        (begins(in_han), "ordered", 0, T.chinese_number(part(in_han)).cast("int")),
        (begins(in_digits), "ordered", 0, _number(part(in_digits))),
        (begins(point), "ordered", 0, _number(part(point))),
        (begins("[•●○◆▪]"), "bullet", 0, F.lit(-1)),
        (heavy, "heading", 4, F.lit(-1)),
    ):
        kinds = kinds.when(test, F.struct(F.lit(kind), F.lit(level), number))
    kinds = kinds.otherwise(F.struct(F.lit("body"), F.lit(0), F.lit(-1))).cast("struct<kind:string,level:int,number:int>")
    found = F.when(plain, kinds).otherwise(F.struct(F.col("kind"), F.lit(0).alias("level"), F.lit(-1).alias("number")))
    return seen.withColumn("_k", found).withColumns({c: F.col(f"_k.{c}") for c in ("kind", "level", "number")}).drop("_k", "size_before")


def _fold(lines: Column) -> Column:
    """For each line of an array the place of the heading that takes it, or null."""
    none = F.struct(
        F.array().cast("array<int>").alias("owners"), F.lit(-1).alias("head"), F.lit(0).alias("level"), F.lit("").alias("prefix"), F.lit(0.0).alias("size"), F.lit(False).alias("taken")
    )

    def step(s: Column, x: Column) -> Column:
        at = F.size(s["owners"])
        clean = ~x["counted"] & F.forall(x["marks"], lambda m: m == s["prefix"])
        alike = (s["size"] <= 0) | (x["size"] <= 0) | (F.abs(s["size"] - x["size"]) / F.when(s["size"] > 0, s["size"]) <= 0.15)
        goes_on = ((x["kind"] == "loose") & (x["level"] == s["level"]) | (x["kind"] == "body") & ~x["starts"] & F.coalesce(alike, F.lit(True))) & clean
        takes, waits = (s["head"] >= 0) & goes_on, (s["head"] >= 0) & (x["kind"] == "empty") & ~s["taken"]
        make = lambda owner, head, level, prefix, size, taken: F.struct(
            F.concat(s["owners"], F.array(owner.cast("int"))).alias("owners"), head.cast("int").alias("head"), level.alias("level"), prefix.alias("prefix"), size.alias("size"), taken.alias("taken")
        )
        goes = make(s["head"], s["head"], s["level"], s["prefix"], s["size"], F.lit(True))
        stays = make(F.lit(None), s["head"], s["level"], s["prefix"], s["size"], s["taken"])
        begins = make(F.lit(None), F.when(x["heads"], at).otherwise(F.lit(-1)), x["level"], x["prefix"], x["size"], F.lit(False))
        return F.when(takes, goes).when(waits, stays).otherwise(begins)

    return F.aggregate(lines, none, step)["owners"]


def heading_owners(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, head_page, head_line) of the lines that go on with a heading."""
    text, heading = F.col("text"), F.col("kind") == "heading"
    prefix = F.coalesce(F.nullif(F.regexp_extract(text, f"^({MARKED})", 1), F.lit("")), F.regexp_extract(text, f"^({COUNTED})", 1))
    kind = F.when(heading & (prefix == ""), F.lit("loose")).when(heading, F.lit("marked")).when(F.col("kind").isin("empty", "body"), F.col("kind")).otherwise(F.lit("other"))
    start = T.trimmed(text).rlike(rf"^(?:第[{HAN}百千零\p{{Nd}}]+|{COUNTED}|（[{HAN}零\p{{Nd}}]+）|\p{{Nd}}+[.．、](?U:\s))")
    facts = lines.select(
        *DOC, "page", "line_no", "level", F.coalesce("size", F.lit(0.0)).alias("size"), F.when(heading, prefix).otherwise(F.lit("")).alias("prefix"), kind.alias("what"),
        F.regexp_extract_all(text, F.lit(f"({MARKED})"), F.lit(1)).alias("marks"), text.rlike(COUNTED).alias("counted"), (start | (text == "")).alias("starts"), (heading & ~F.col("merged")).alias("heads"),
    )
    facts = settle(facts)
    seen = scanned(facts, DOC, "page", "line_no", last={"before": F.when(F.col("what") != "empty", F.col("what"))})
    after_text = (F.col("what") == "empty") & ~F.coalesce(F.col("before"), F.lit("other")).isin("loose", "marked")
    cut = F.col("what").isin("other", "marked") | F.col("counted") | ((F.col("what") == "body") & F.col("starts")) | after_text
    cuts = settle(seen.withColumn("cut", cut.cast("long")))
    parts = scanned(cuts, DOC, "page", "line_no", sums={"part": F.col("cut")}).withColumn("part", F.col("part") + F.col("cut"))
    line = F.struct("page", "line_no", F.col("what").alias("kind"), "level", "prefix", "size", "marks", "counted", "starts", "heads")
    parts = parts.groupBy(*DOC, "part").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.bool_or("heads").alias("any")).where("any and size(lines) > 1")
    owned = parts.select(*DOC, "lines", F.posexplode(_fold(F.col("lines"))).alias("at", "owner")).where("owner is not null")
    own, head = F.get("lines", F.col("at")), F.get("lines", F.col("owner"))
    return owned.select(*DOC, own["page"].alias("page"), own["line_no"].alias("line_no"), head["page"].alias("head_page"), head["line_no"].alias("head_line"))


def with_headings_joined(lines: DataFrame) -> DataFrame:
    """``lines`` with each heading's text going on over the lines that it takes, which are ``merged``."""
    owners = settle(heading_owners(lines))
    heads = owners.select(*DOC, "head_page", "head_line").distinct()
    members = owners.unionByName(heads.select(*DOC, F.col("head_page").alias("page"), F.col("head_line").alias("line_no"), "head_page", "head_line"))
    members = members.join(lines.select(*DOC, "page", "line_no", "text"), [*DOC, "page", "line_no"])
    order = Window.partitionBy(*DOC, "head_page", "head_line").orderBy("page", "line_no")
    before = F.lag("text").over(order)
    glue = F.when(before.isNull() | T.ends_cjk(before) | T.starts_cjk(F.col("text")), F.lit("")).otherwise(F.lit(" "))
    members = members.withColumn("piece", F.concat(glue, "text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", "piece"))), lambda x: x["piece"]), "")
    whole = members.groupBy(*DOC, "head_page", "head_line").agg(whole.alias("whole")).withColumnsRenamed({"head_page": "page", "head_line": "line_no"})
    gone = owners.select(*DOC, "page", "line_no", F.lit(True).alias("gone"))
    out = lines.join(whole, [*DOC, "page", "line_no"], "left").join(gone, [*DOC, "page", "line_no"], "left")
    return out.withColumns({"text": F.coalesce("whole", "text"), "merged": F.col("merged") | F.coalesce("gone", F.lit(False))}).drop("whole", "gone")


def rendered_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, table, degraded): the Markdown of each run of table lines, at the first of them.

    Too few columns or over 40 % empty cells give plain text.  A row of few cells goes on with the header.
    """
    order = Window.partitionBy(*DOC, "page").orderBy("line_no")
    opens = (F.col("kind") == "table") & (F.coalesce(F.lag("kind").over(order), F.lit("")) != "table")
    rows = lines.select(*DOC, "page", "line_no", "kind", "text", "cells").withColumn("run", F.sum(opens.cast("int")).over(order)).where("kind = 'table'")
    runs = rows.groupBy(*DOC, "page", "run").agg(F.sort_array(F.collect_list(F.struct("line_no", "text", "cells"))).alias("rows"))
    width = F.array_max(F.transform("rows", lambda r: F.coalesce(F.array_max(F.transform(r["cells"], lambda c: c["column"])), F.lit(0)))) + 1
    runs = runs.withColumn("width", width)
    at = lambda r, k: T.trimmed(F.array_join(F.transform(F.filter(r["cells"], lambda c: c["column"] == k), lambda c: c["text"]), " "))
    runs = runs.withColumn("grid", F.transform("rows", lambda r: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: at(r, k))))
    filled = lambda r: F.size(F.filter(r, lambda c: c != ""))
    empty = F.aggregate("grid", F.lit(0), lambda n, r: n + F.size(r) - filled(r))
    runs = runs.withColumn("why", F.when(F.col("width") < 2, F.lit(TOO_NARROW)).when(empty > F.col("width") * F.size("grid") * 0.4, F.lit(TOO_EMPTY)))
    body = F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))
    whole = F.array_position(F.transform(body, lambda r: (filled(r) > 0) & (filled(r) <= F.floor(F.col("width") / 2) + 1)), False)
    header = F.when(whole > 0, whole).otherwise(F.size("grid")).cast("int")  # rows of the header
    runs = runs.withColumn("header", header)
    head = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.array_join(F.transform(F.slice("grid", F.lit(1), F.col("header")), lambda r: F.get(r, k)), ""))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    rest = F.array_join(F.transform(F.slice("grid", F.col("header") + 1, F.size("grid")), line), "")
    table = F.concat(line(head), line(F.array_repeat(F.lit("---"), F.col("width"))), rest, F.lit("\n"))
    plain = F.array_join(F.transform(F.filter("rows", lambda r: T.trimmed(r["text"]) != ""), lambda r: F.concat(r["text"], F.lit("\n"))), "")
    degraded = F.concat(F.lit("<!-- TABLE_DEGRADED: "), "why", F.lit("，退化为纯文本 -->\n"), plain, F.lit("\n"))
    first = F.get("rows", F.lit(0))["line_no"]
    return runs.select(*DOC, "page", first.alias("line_no"), F.when(F.col("why").isNull(), table).otherwise(degraded).alias("table"), F.col("why").isNotNull().alias("degraded"))


def base_margins(lines: DataFrame) -> DataFrame:
    """(doc_id, base): the most frequent left edge of body lines in whole points; the first seen of equally frequent ones."""
    body = lines.where("not merged and kind = 'body' and text <> ''").select(*DOC, F.bround("left").alias("margin"), F.struct("page", "line_no").alias("place"))
    counts = body.groupBy(*DOC, "margin").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return counts.groupBy(*DOC).agg(F.min_by("margin", F.struct(-F.col("n"), "first")).alias("base"))


def pieces(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, piece, degraded): what each line adds to its document's Markdown.

    A paragraph goes on over one empty line, not over two or a page's mark.  A run of empty lines that begins before a page
    break takes the break with it, so that page has no mark.
    """
    rows = lines.join(rendered_tables(lines), [*DOC, "page", "line_no"], "left").where("not merged and (kind <> 'table' or table is not null)")
    rows = settle(rows.select(*DOC, "page", "line_no", "kind", "level", "number", "text", "left", "breaks", "table", "degraded"))
    said = F.when(F.col("kind") != "empty", F.struct("kind", T.ends_paragraph(F.col("text")).alias("ends"), T.ends_cjk(F.col("text")).alias("wide")))
    rows = settle(scanned(rows, DOC, "page", "line_no", last={"before": said}, sums={"nth": (F.col("kind") != "empty").cast("long")}))
    gaps = rows.where("kind = 'empty'").select(*DOC, "nth", "page", "line_no", "breaks", F.col("before.kind").alias("was"))
    order = Window.partitionBy(*DOC, "nth").orderBy("page", "line_no")  # a run of empty lines
    blank = F.coalesce(F.sum((~F.col("breaks")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = gaps.withColumn("blank", blank).withColumn("mark", F.col("breaks") & (F.col("blank") == 0)).withColumn("first", F.row_number().over(order) == 1)
    gaps = settle(gaps)
    between = gaps.groupBy(*DOC, "nth").agg(F.count_if("mark").alias("marks"), F.count_if(~F.col("mark")).alias("blanks"))

    marks = scanned(gaps.where("mark"), DOC, "page", "line_no", sums={"number": F.lit(1).cast("long")}).withColumn("number", F.col("number") + 1)
    closes = F.when(F.col("first") & (F.col("was") == "body"), F.lit("\n\n")).otherwise(F.lit(""))
    marks = marks.select(*DOC, "page", "line_no", F.concat(closes, F.when(F.col("number") > 1, "\n").otherwise(""), F.lit("<!-- PAGE_START: "), F.col("number").cast("string"), F.lit(" -->\n")).alias("piece"), F.lit(False).alias("degraded"))

    events = rows.where("kind <> 'empty'").join(between, [*DOC, "nth"], "left").join(base_margins(lines), DOC, "left")
    none = F.lit(0)
    open_ = F.coalesce(F.col("before.kind") == "body", F.lit(False)) & (F.coalesce("marks", none) == 0)
    held = open_ & (F.coalesce("blanks", none) < 2)
    body = F.col("kind") == "body"
    apart = F.coalesce(F.col("before.ends"), F.lit(False)) | (F.col("left") > F.coalesce("base", F.lit(0.0)) + 10)
    goes_on = held & body & ~apart
    close = F.when(open_ & ~goes_on, F.lit("\n\n")).otherwise(F.lit(""))
    glue = F.when(goes_on & ~(F.col("before.wide") & T.starts_cjk(F.col("text"))), F.lit(" ")).otherwise(F.lit(""))
    item = lambda *marks: F.regexp_replace(F.regexp_replace(F.col("text"), marks[0], ""), marks[-1], "")
    block = (
        F.when(F.col("kind") == "table", F.col("table"))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text", F.lit("\n")))
        .when(F.col("kind") == "ordered", F.concat(F.col("number").cast("string"), F.lit(". "), item(rf"^（[{HAN}零\p{{Nd}}]+）(?U:\s*)", r"^\p{Nd}+[.．、](?U:\s*)"), F.lit("\n")))
        .otherwise(F.concat(F.lit("- "), item(r"^[•●○◆▪](?U:\s*)"), F.lit("\n")))
    )
    piece = F.when(body, F.concat(close, glue, "text")).otherwise(F.concat(close, F.lit("\n"), block))
    events = events.select(*DOC, "page", "line_no", piece.alias("piece"), F.coalesce("degraded", F.lit(False)).alias("degraded"))
    return events.unionByName(marks)


def joined_lines(words: DataFrame) -> DataFrame:
    """All lines of the documents of positioned words, in their kinds, headings joined; a written table."""
    lines = settle(page_tables.page_lines(font_facts(words)))
    kinds = settle(classified(with_page_marks(lines)))
    return settle(with_headings_joined(kinds))


def page_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, kind, level, number, merged) of the documents of positioned words; a written table."""
    with scratch(words.sparkSession):
        lines = joined_lines(words).where("not breaks")
        return settle(lines.select(*DOC, "page", "line_no", "text", "kind", "level", "number", "merged"), outer=True)


def page_markdown(words: DataFrame) -> DataFrame:
    """(doc_id, raw_md, degraded_tables) of the documents of positioned words; a written table.

    Pages are put together first, then documents, whose text is one value.
    """
    with scratch(words.sparkSession):
        found = pieces(joined_lines(words))
        text = lambda *by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, "piece"))), lambda x: x["piece"]), "")
        pages = found.groupBy(*DOC, "page").agg(text("line_no").alias("piece"), F.count_if("degraded").alias("degraded"))
        whole = pages.groupBy(*DOC).agg(text("page").alias("text"), F.sum("degraded").cast("int").alias("degraded_tables"))
        clean = F.concat(T.trimmed(F.regexp_replace("text", "\n{3,}", "\n\n")), F.lit("\n"))
        return settle(whole.select(*DOC, clean.alias("raw_md"), "degraded_tables"), outer=True)
