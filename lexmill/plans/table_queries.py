"""Queries over tables as sheets, conversations as slides, positions as pages, and batches; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.config import Limits
from lexmill.functions import text as T
from lexmill.operators import batch, compliance, docx, layout, semantic, settings, sheets, slides, word
from lexmill.plans.documents import process
from lexmill.plans.registry import query, table
from lexmill.plans.text_queries import BLOCKS, LINES, composed  # noqa: F401
from lexmill.sources import files

# ---- sheets: nation (25 rows), supplier and part (more than a preview) -----------------------

SHEETS = (
    ("nation", "n_nationkey", ("CAST(n_nationkey AS STRING)", "CASE WHEN n_nationkey % 4 = 0 THEN 'a|' || n_name ELSE n_name END", "CASE WHEN n_nationkey % 5 > 0 THEN CAST(n_regionkey AS STRING) END")),
    ("supplier", "s_suppkey - 1", ("CAST(s_suppkey AS STRING)", "s_name || ',\"x\"'", "CAST(s_nationkey AS STRING)")),
    ("part", "p_partkey - 1", ("CAST(p_partkey AS STRING)", "p_name", "CASE WHEN p_size % 3 > 0 THEN p_brand END")),
)


def _cells_sql(view: str = "{}") -> str:
    parts = [
        f"SELECT CAST(1 AS BIGINT) AS doc_id, {n} AS sheet_no, '{name}' AS sheet, CAST({key} AS BIGINT) AS row, {c} AS col, {value} AS value FROM {view.format(name)}"
        for n, (name, key, values) in enumerate(SHEETS)
        for c, value in enumerate(values)
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


def cells(spark, sf):
    for name, _, _ in SHEETS:
        table(spark, sf, name).createOrReplaceTempView(f"lexmill_{name}")
    return spark.sql(_cells_sql("lexmill_{}"))


GRID = f"""x AS ({_cells_sql()}), z AS (SELECT doc_id, sheet_no, sheet, max(row) AS rows, max(col) AS cols FROM x GROUP BY ALL),
  p AS (SELECT doc_id, sheet_no, sheet, rows, unnest(range(0, rows + 1)) AS row, cols FROM z), g AS (SELECT *, unnest(range(0, cols + 1)) AS col FROM p),
  d AS (SELECT g.doc_id, g.sheet_no, g.sheet, g.rows, g.row, g.col, coalesce(x.value, '') AS value FROM g LEFT JOIN x ON x.sheet_no = g.sheet_no AND x.row = g.row AND x.col = g.col)"""


@query(
    f"""WITH {GRID}, r AS (SELECT sheet_no, sheet, rows, row, bool_or(value <> '') AS filled, '| ' || string_agg(replace(replace(replace(value, '|', chr(92) || '|'), chr(10), ' '), chr(13), ''), ' | ' ORDER BY col) || ' |'
    || CASE WHEN row = 0 THEN chr(10) || '| ' || string_agg('---', ' | ' ORDER BY col) || ' |' ELSE '' END AS line FROM d GROUP BY sheet_no, sheet, rows, row)
    SELECT sheet, string_agg(line, chr(10) ORDER BY row) FILTER (row < 50 AND filled) AS preview, max(rows) + 1 > 50 AS truncated FROM r GROUP BY sheet"""
)
def sheet_previews(spark, sf):
    return sheets.previews(cells(spark, sf)).select("sheet", "preview", "truncated")


@query(
    f"""WITH {GRID}, r AS (SELECT sheet, row, string_agg(CASE WHEN regexp_matches(value, '[,"\\n\\r]') THEN '"' || replace(value, '"', '""') || '"' ELSE value END, ',' ORDER BY col) AS line FROM d GROUP BY ALL)
    SELECT sheet, md5(string_agg(line, chr(10) ORDER BY row)) AS csv_md5 FROM r GROUP BY sheet"""
)
def sheet_csv(spark, sf):
    return sheets.csv_texts(cells(spark, sf)).select("sheet", F.md5(F.col("csv").cast("binary")).alias("csv_md5"))


@query(
    f"""WITH {GRID}, r AS (SELECT sheet_no, sheet, rows, row, bool_or(value <> '') AS filled, '| ' || string_agg(replace(replace(replace(value, '|', chr(92) || '|'), chr(10), ' '), chr(13), ''), ' | ' ORDER BY col) || ' |' || chr(10)
    || CASE WHEN row = 0 THEN '| ' || string_agg('---', ' | ' ORDER BY col) || ' |' || chr(10) ELSE '' END AS line FROM d GROUP BY sheet_no, sheet, rows, row),
    s AS (SELECT sheet_no, sheet, max(rows) + 1 AS n, coalesce(string_agg(line, '' ORDER BY row) FILTER (row < 50 AND filled), '') AS body FROM r GROUP BY sheet_no, sheet)
    SELECT CAST(1 AS BIGINT) AS doc_id, count(*) FILTER (n > 50) AS n_tables, md5(string_agg('<!-- SHEET_START: ' || sheet || ' -->' || chr(10) || CASE WHEN sheet_no > 0 THEN chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '## ' || sheet || chr(10) || chr(10) || body
    || CASE WHEN n > 50 THEN chr(10) || '<!-- TABLE_TRUNCATED: 工作表「' || sheet || '」共有 ' || n || ' 行，仅展示前 50 行预览，完整数据见 tables/ 目录 -->' || chr(10) || '> *表格已截断：共 ' || n || ' 行，仅展示前 50 行*' || chr(10) ELSE '' END
    || '<!-- SHEET_END -->' || chr(10), '' ORDER BY sheet_no)) AS md5 FROM s"""
)
def sheet_markdown(spark, sf):
    out = sheets.sheet_markdown(cells(spark, sf))
    return out.select("doc_id", F.size("tables").cast("long").alias("n_tables"), F.md5(F.col("body").cast("binary")).alias("md5"))


@query(
    """SELECT l_orderkey, l_linenumber, strftime(DATE '1899-12-30' + CAST(floor(40000 + l_quantity * 37 + l_discount) AS INT), '%Y-%m-%d') AS day,
    CASE CAST(l_linenumber % 7 AS INT) WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN true ELSE true END AS is_date,
    CASE CAST(l_linenumber % 7 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 26 WHEN 3 THEN 27 WHEN 4 THEN 1 WHEN 5 THEN 701 ELSE 0 END AS col FROM lineitem"""
)
def serial_dates(spark, sf):
    df = table(spark, sf, "lineitem")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("l_linenumber") % 7).cast("int"))
    code = pick(["yyyy-mm-dd", "hh:mm", "m/d/yy h:mm", "", "0.00", "yyyy年", "mm"])
    ref = pick(["A1", "Z9", "AA1", "AB7", "B12", "ZZ3", "123"])
    day = T.serial_date(40000 + F.col("l_quantity") * 37 + F.col("l_discount"))
    return df.select("l_orderkey", "l_linenumber", day.alias("day"), T.is_date_format(code).alias("is_date"), T.column_index(ref).cast("int").alias("col"))


# ---- conversations as lists and slides -------------------------------------------------------

@query(
    """SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS BIGINT) AS number FROM (
    SELECT conv_id, turn, turn % 4 = 3 AS cut, sum(CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) WHERE NOT cut"""
)
def list_numbering(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 != 3, F.lit("1")).alias("num_id"), F.lit(0).alias("level"))
    return word.list_numbers(df, "conv_id", "turn").select("conv_id", "turn", F.col("number").cast("long").alias("number"))


@query(
    r"""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS body,
    CASE WHEN turn % 2 = 1 THEN chr(10) || '> **备注**' || chr(10) || '> ' || role || chr(10) ELSE '' END AS notes FROM conversations WHERE trim(coalesce(text, '')) <> '')
    SELECT conv_id, md5(string_agg('<!-- SLIDE_START: ' || n || ' -->' || chr(10) || '## 第 ' || n || ' 页' || chr(10) || chr(10) || body || chr(10) || notes || '<!-- SLIDE_END: ' || n || ' -->' || chr(10) || chr(10), '' ORDER BY turn)) AS md5 FROM p GROUP BY conv_id"""
)
def slides_markdown(spark, sf):
    df = table(spark, sf, "conversations").where("trim(coalesce(text, '')) <> ''")
    text = df.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("slide_no"), F.lit(0).alias("para_no"), F.lit("text").alias("kind"), "text")
    notes = df.where("turn % 2 = 1").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("slide_no"), F.lit(1).alias("para_no"), F.lit("notes").alias("kind"), F.col("role").alias("text"))
    out = slides.slides_markdown(text.unionByName(notes))
    return out.select(F.col("doc_id").alias("conv_id"), F.md5(F.col("body").cast("binary")).alias("md5"))


# ---- semantic blocks -------------------------------------------------------------------------

SEM = f"""{LINES}, a AS (SELECT *, trim(regexp_replace(line, '\\s+$', '')) AS t FROM ln),
  k AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN starts_with(t, '<!--') THEN 'comment' WHEN regexp_matches(line, '^(#{{1,6}})\\s+(.+)') THEN 'heading' WHEN starts_with(t, '|') THEN 'table'
    WHEN regexp_matches(line, '^(\\s*)([-*+])\\s+(.+)') THEN 'bullet' WHEN regexp_matches(line, '^(\\s*)(\\d+)\\.\\s+(.+)') THEN 'numbered' WHEN regexp_matches(t, '^(-{{3,}}|\\*{{3,}}|_{{3,}})$') THEN 'rule'
    WHEN starts_with(t, '>') THEN 'quote' ELSE 'paragraph' END AS kind FROM a),
  u AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS p1 FROM k),
  v AS (SELECT doc_id, line_no, line, kind, p1, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS p2 FROM u WHERE kind <> 'comment'),
  w AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS p3 FROM v WHERE kind <> 'blank'),
  s2 AS (SELECT *, CASE WHEN kind IN ('heading', 'rule') THEN 1 WHEN kind = 'table' THEN CASE WHEN coalesce(p1, '') <> kind THEN 1 ELSE 0 END WHEN kind = 'paragraph' THEN CASE WHEN coalesce(p2, '') <> kind THEN 1 ELSE 0 END
    ELSE CASE WHEN coalesce(p3, '') <> kind THEN 1 ELSE 0 END END AS new FROM w),
  b2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s2)"""


@query(f"WITH {SEM} SELECT doc_id, CAST(block AS BIGINT) AS block, min(kind) AS block_type, count(*) AS n_lines FROM b2 GROUP BY doc_id, block")
def semantic_blocks(spark, sf):
    rows = semantic.numbered(composed(spark, sf))
    return rows.groupBy("doc_id", F.col("block").cast("long").alias("block")).agg(F.min("kind").alias("block_type"), F.count("*").alias("n_lines"))


@query(
    f"""WITH {SEM} SELECT doc_id, CAST(block AS BIGINT) AS block, string_agg(trim(CASE kind WHEN 'bullet' THEN regexp_extract(line, '^(\\s*)([-*+])\\s+(.+)', 3) ELSE regexp_extract(line, '^(\\s*)(\\d+)\\.\\s+(.+)', 3) END), chr(10) ORDER BY line_no) AS items
    FROM b2 WHERE kind IN ('bullet', 'numbered') GROUP BY doc_id, block"""
)
def semantic_lists(spark, sf):
    found = semantic.blocks(composed(spark, sf)).where("block_type in ('bullet', 'numbered')")
    return found.select("doc_id", F.col("block").cast("long").alias("block"), F.array_join("items", "\n").alias("items"))


@query(
    f"""WITH {SEM}, cut AS (SELECT doc_id, block, line_no, regexp_matches(t, '{semantic.SEPARATOR}') AS sep, list_transform(string_split(t, '|')[2:-2], lambda x: trim(x)) AS cells
    FROM (SELECT doc_id, block, line_no, trim(regexp_replace(line, '\\s+$', '')) AS t FROM b2 WHERE kind = 'table'))
    SELECT doc_id, CAST(block AS BIGINT) AS block, coalesce(string_agg(array_to_string(cells, chr(9)), chr(10) ORDER BY line_no) FILTER (NOT sep AND len(list_filter(cells, lambda x: x <> '')) > 0), '') AS "rows" FROM cut GROUP BY doc_id, block"""
)
def semantic_tables(spark, sf):
    found = semantic.blocks(composed(spark, sf)).where("block_type = 'table'")
    return found.select("doc_id", "block", F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n").alias("rows"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*\*(.+?)\*\*\*', '\1', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '~~(.+?)~~', '\1', 'g'), '`(.+?)`', '\1', 'g')) AS plain
    FROM documents"""
)
def inline_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", semantic.clean_inline(F.col("text")).alias("plain"))


@query(None)
def inline_runs(spark, sf):
    runs = table(spark, sf, "documents").select("doc_id", F.posexplode(semantic.inline_runs(F.col("text"))).alias("run_no", "run"))
    return runs.select("doc_id", "run_no", "run.*")


# ---- pages: orders as documents of positioned words ------------------------------------------

WORDS = """SELECT l_orderkey % 500 AS doc_id, CAST(1 + l_orderkey % 3 AS INT) AS page, 600.0 AS page_width, l_returnflag || l_linestatus || CAST(l_linenumber AS STRING) AS text,
  40.0 + (l_linenumber % 3) * 150.0 + (l_suppkey % 5) AS left, 40.0 + (l_linenumber % 3) * 150.0 + (l_suppkey % 5) + 20.0 AS right,
  700.0 - CAST(l_quantity AS DOUBLE) * 12.0 AS top, 12.0 AS height, CASE WHEN l_partkey % 11 = 0 THEN 18.0 ELSE 12.0 END AS font_size, CASE WHEN l_partkey % 13 = 0 THEN 'X-Bold' ELSE 'X' END AS font_name FROM {}"""


def words(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lexmill_lineitem")
    return spark.sql(WORDS.format("lexmill_lineitem")).withColumns({c: F.col(c).cast("double") for c in ("page_width", "left", "right", "top", "height", "font_size")})


@query(
    f"""WITH w AS (SELECT * FROM ({WORDS.format('lineitem')})), p AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER ("right" < page_width / 2) AS l, count(*) FILTER ("left" >= page_width / 2) AS r FROM w WHERE page <= 10 GROUP BY ALL)
    SELECT doc_id, count(*) AS checked, count(*) FILTER (l > n * 0.3 AND r > n * 0.3) AS two_column, count(*) FILTER (l > n * 0.3 AND r > n * 0.3) > count(*) // 2 AS warns FROM p WHERE n >= 10 GROUP BY doc_id""".replace(
        "AS left,", 'AS "left",'
    ).replace("AS right,", 'AS "right",')
)
def two_column_pages(spark, sf):
    return layout.two_column_pages(words(spark, sf))


@query(
    f"""WITH w AS (SELECT * FROM ({WORDS.format('lineitem')})), g AS (SELECT doc_id, page, top, text, "left", "right", count(*) OVER q AS n, avg(("right" - "left") / greatest(length(text), 1)) OVER q AS width,
    "left" - lag("right") OVER (PARTITION BY doc_id, page, top ORDER BY "left", "right", text) AS gap FROM w WINDOW q AS (PARTITION BY doc_id, page, top)),
    c AS (SELECT *, sum(CASE WHEN gap > greatest(width * 3, 15.0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, top ORDER BY "left", "right", text ROWS UNBOUNDED PRECEDING) AS cluster FROM g WHERE n > 1)
    SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(top AS DOUBLE) AS top, CAST(cluster AS BIGINT) AS cluster, CAST(min("left") AS DOUBLE) AS left_edge, CAST(max("right") AS DOUBLE) AS right_edge, trim(string_agg(text, '' ORDER BY "left", "right", text)) AS text FROM c GROUP BY doc_id, page, top, cluster""".replace(
        "AS left,", 'AS "left",'
    ).replace("AS right,", 'AS "right",')
)
def cell_clusters(spark, sf):
    df = layout.cell_gaps(words(spark, sf), ["doc_id", "page", "top"])
    return df.select(
        "doc_id", F.col("page").cast("long").alias("page"), "top", F.col("cluster").cast("long").alias("cluster"), F.col("left").alias("left_edge"), F.col("right").alias("right_edge"), "text"
    )


# ---- files and batches -----------------------------------------------------------------------

PATHS = "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '/in/.hidden/' ELSE '/in/d' || CAST(page_id % 7 AS STRING) || '/' END || CAST(page_id % 40 AS STRING) || CASE CAST(page_id % 8 AS INT) WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.html' WHEN 5 THEN '' WHEN 6 THEN '.md' ELSE '.pptx' END AS path FROM {}"


def paths(spark, sf):
    table(spark, sf, "pages").createOrReplaceTempView("lexmill_pages")
    return spark.sql(PATHS.format("lexmill_pages"))


@query(
    f"""WITH p AS ({PATHS.format('pages')}), e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./\\\\]*)$', 1)) AS ext FROM p WHERE NOT contains(path, '/.'))
    SELECT CASE ext WHEN '.docx' THEN 'Word' WHEN '.pdf' THEN 'PDF' WHEN '.txt' THEN 'Text' WHEN '.xlsx' THEN 'Excel' WHEN '.md' THEN 'Markdown' WHEN '.pptx' THEN 'PowerPoint' ELSE 'Unknown' END AS file_type,
    CASE WHEN ext IN ('.pdf', '.docx', '.xlsx', '.pptx') THEN 'Pending' ELSE 'Unsupported' END AS status, count(*) AS n FROM e GROUP BY ALL"""
)
def file_scan_summary(spark, sf):
    rows = files.describe(paths(spark, sf).where(~files.is_hidden(F.col("path"))))
    return rows.groupBy("file_type", "status").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({PATHS.format('pages')}), l AS (SELECT DISTINCT lower(path) AS low FROM p WHERE page_id % 5 = 0) SELECT min(path) AS path FROM p WHERE lower(path) NOT IN (SELECT low FROM l) GROUP BY lower(path)")
def dedup_paths(spark, sf):
    rows = paths(spark, sf)
    return files.new_paths(rows, rows.where("page_id % 5 = 0"))


@query(f"WITH p AS ({PATHS.format('pages')}) SELECT CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'Failed' WHEN 1 THEN 'Pending' ELSE 'Completed' END AS status, count(*) AS n FROM p GROUP BY ALL")
def status_counts(spark, sf):
    state = F.when(F.col("page_id") % 5 == 0, "Failed").when(F.col("page_id") % 5 == 1, "Pending").otherwise("Completed")
    return batch.status_counts(paths(spark, sf).withColumn("status", state))


@query(
    "SELECT doc_id, source || '.docx' AS name, source || '.docx' || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS out_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(source || '.docx') ORDER BY doc_id) - 1 AS n FROM documents)"
)
def output_name_suffix(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(".docx")).alias("name"))
    return batch.suffixed_names(df, "name", "doc_id")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id, event_type LIMIT 20")
def history_top20(spark, sf):
    return batch.history(table(spark, sf, "events").select("event_id", "ts", "event_type"))


@query("SELECT event_type, max(ts) AS ts FROM events GROUP BY event_type ORDER BY ts DESC, event_type LIMIT 10")
def recent_distinct(spark, sf):
    return batch.recent(table(spark, sf, "events"), "event_type", "ts")


@query("SELECT '/in' AS root")
def common_root(spark, sf):
    return batch.common_root(paths(spark, sf).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")))


@query(
    f"""WITH p AS ({PATHS.format('pages')}), n AS (SELECT page_id, path, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '/x/CON.txt' WHEN 1 THEN '/x/aux' WHEN 2 THEN '/x/committee.md' WHEN 3 THEN '/x/ a.b. ' WHEN 4 THEN '/x/COM7.docx' ELSE '/x/CONFIDENTIAL.txt' END AS name FROM p)
    SELECT page_id, starts_with(lower(path), '/in/d1/') OR starts_with(lower(path), '/in/d2/') AS in_allowed_directory, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.pdf', '.docx') AS type_allowed,
    CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '_CON.txt' WHEN 1 THEN '_aux' WHEN 2 THEN 'committee.md' WHEN 3 THEN 'a.b' WHEN 4 THEN '_COM7.docx' ELSE 'CONFIDENTIAL.txt' END AS safe_name,
    replace(replace('a:b/c?', ':', '_'), '/', '_') || 'x' AS forbidden FROM n"""
)
def security_predicates(spark, sf):
    limits = Limits(allowed_directories=("/in/d1", "/in/d2/"), allowed_types=(".PDF", ".docx"))
    df = batch.allowed(paths(spark, sf).withColumn("length", F.lit(1)), limits)
    name = F.get(F.array(*[F.lit(v) for v in ("/x/CON.txt", "/x/aux", "/x/committee.md", "/x/ a.b. ", "/x/COM7.docx", "/x/CONFIDENTIAL.txt")]), (F.col("page_id") % 6).cast("int"))
    forbidden = F.concat(F.regexp_replace(T.safe_file_name(F.lit("a:b/c?")), "_$", "?"), F.lit("x"))
    return df.select("page_id", "in_allowed_directory", "type_allowed", T.sanitised_file_name(name).alias("safe_name"), forbidden.alias("forbidden"))


@query(
    """SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN false ELSE false END AS newer,
    CAST(round_even((event_id % 5) * (10 + event_id % 9) * 20.0, 0) AS INT) AS twips FROM events"""
)
def versions_and_units(spark, sf):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 8).cast("int"))
    remote = pick(["v2.1.0", "2.1.0", "release-3.0.1", "v1.0", "latest", "1.2.10", "1.2.3", ""])
    local = pick(["2.0.9", "2.1.0", "v3.0.0", "V1.0.1", "1.0", "1.2.9", "1.10.0", "1.0"])
    return table(spark, sf, "events").select(
        "event_id", T.is_newer(remote, local).alias("newer"), T.indent_twips(F.col("event_id") % 5, 10 + F.col("event_id") % 9).alias("twips")
    )


@query(
    """SELECT event_id, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN '三号' WHEN 1 THEN '五号' WHEN 2 THEN '三号(≈16.2pt)' WHEN 3 THEN '初号' WHEN 4 THEN '初号(≈60.0pt)' WHEN 5 THEN '八号' WHEN 6 THEN '小五(≈9.4pt)' ELSE '小四' END AS name,
    CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 20 WHEN 4 THEN 99 WHEN 5 THEN 1 WHEN 6 THEN 35 ELSE 12 END AS number,
    CASE CAST(event_id % 8 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 2 ELSE 0 END AS level FROM events"""
)
def numerals_and_names(spark, sf):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 8).cast("int"))
    number = T.chinese_number(pick(["一", "十", "十二", "二十", "九十九", "零", "三五", "一二"]))
    size = T.type_size_name(pick([16.0, 10.5, 16.2, 42.0, 60.0, 5.0, 9.4, 12.0]))
    level = compliance.heading_of(pick([None, None, None, None, None, "", "标题2", None]), pick(["一、总则", "（一）基本要求", "1.1 背景", "1、第一条", "第一条", "", "x", "body"]))
    return table(spark, sf, "events").select("event_id", size.alias("name"), number.cast("int").alias("number"), level.alias("level"))


# ---- whole documents -------------------------------------------------------------------------


@query(None)
def processed_documents(spark, sf):
    df = composed(spark, sf).withColumn("file_name", F.lit("a.docx")).withColumn("source_type", F.lit("Word"))
    return process(df.withColumn("codes", F.array().cast("array<string>")).withColumn("ocr_used", F.lit(False)))


@query(None)
def docx_render(spark, sf):
    return docx.render(composed(spark, sf)).select("doc_id", F.sha2("docx", 256).alias("sha256"), F.length("docx").alias("bytes"))


@query(None)
def docx_format_check(spark, sf):
    parts = docx.extract_properties(docx.render(composed(spark, sf)))
    return compliance.reports(parts[0], compliance.check(*parts)).select("doc_id", "passed", F.to_json("issues").alias("issues"))


@query(None)
def docx_reformat(spark, sf):
    made = docx.reformat_all(docx.render(composed(spark, sf)))
    return made.select("doc_id", F.sha2("docx", 256).alias("sha256"), "error")


@query(None)
def format_targets(spark, sf):
    _, paragraphs, _ = docx.extract_properties(docx.render(composed(spark, sf)))
    return compliance.target_format(paragraphs)


# ---- settings files: one of each version for the customers --------------------------------------

SETTINGS = """SELECT c_custkey, CASE CAST(c_custkey % 7 AS INT)
    WHEN 0 THEN '{"OutputDirectory": "/out/' || c_mktsegment || '", "IncludeSubfolders": false, "PreserveStructure": ' || CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || '}'
    WHEN 1 THEN '{"General": {"DefaultOutputDir": "' || c_mktsegment || '"}, "Conversion": {"MaxConcurrentTasks": ' || CAST(c_nationkey - 5 AS STRING) || ', "MaxScanFileCount": ' || CAST(c_nationkey - 12 AS STRING) || '}}'
    WHEN 2 THEN '{"General": {"HasCompletedOnboarding": ' || CASE WHEN c_nationkey % 3 = 0 THEN 'true' ELSE 'false' END || ', "Language": "en"}, "Conversion": {"OutputPackageMode": "' || CASE WHEN c_nationkey % 2 = 0 THEN 'HybridPackage' ELSE 'Other' END || '"}, "More": 1}'
    WHEN 3 THEN '{"General": ' || c_name WHEN 4 THEN '{"Conversion": {"MaxConcurrentTasks": "' || c_mktsegment || '"}}' WHEN 5 THEN '{}' ELSE '' END AS content FROM {}"""


@query(
    f"""WITH f AS (SELECT c_custkey, content, json_valid(content) AS good, CASE WHEN json_valid(content) THEN content ELSE '{{}}' END AS j FROM ({SETTINGS.replace('FROM {}', 'FROM customer')})),
    g AS (SELECT *, NOT good OR coalesce(json_type(j, '$.Conversion.MaxConcurrentTasks') = 'VARCHAR', FALSE) AS corrupted, CASE WHEN json_exists(j, '$.OutputDirectory') THEN 0 WHEN json_exists(j, '$.General.HasCompletedOnboarding') THEN 2 ELSE 1 END AS v FROM f),
    h AS (SELECT c_custkey, corrupted, CASE WHEN corrupted THEN 2 ELSE v END AS version, CASE WHEN corrupted THEN '{{}}' ELSE j END AS j FROM g)
    SELECT c_custkey, corrupted, version, coalesce(j->>'$.OutputDirectory', j->>'$.General.DefaultOutputDir', '') AS output_dir, coalesce(CAST(j->>'$.IncludeSubfolders' AS BOOLEAN), TRUE) AS recursive_scan,
    coalesce(CAST(j->>'$.PreserveStructure' AS BOOLEAN), TRUE) AS preserve_structure, greatest(coalesce(CAST(j->>'$.Conversion.MaxConcurrentTasks' AS INT), 2), 1) AS tasks,
    CASE WHEN coalesce(CAST(j->>'$.Conversion.MaxScanFileCount' AS INT), 5000) < 1 THEN 5000 ELSE coalesce(CAST(j->>'$.Conversion.MaxScanFileCount' AS INT), 5000) END AS scans,
    CASE WHEN j->>'$.Conversion.OutputPackageMode' = 'HybridPackage' THEN 'HybridPackage' ELSE 'SingleMd' END AS package_mode, coalesce(j->>'$.General.Language', 'zh-CN') AS language,
    CASE version WHEN 1 THEN TRUE ELSE coalesce(CAST(j->>'$.General.HasCompletedOnboarding' AS BOOLEAN), FALSE) END AS introduced FROM h"""
)
def settings_migrated(spark, sf):
    """Settings files of all versions, some broken, as settings of today."""
    table(spark, sf, "customer").createOrReplaceTempView("lexmill_customer")
    files = spark.sql(SETTINGS.replace("FROM {}", "FROM lexmill_customer")).withColumn("path", F.col("c_custkey"))
    names = {"DefaultOutputDir": "output_dir", "RecursiveScan": "recursive_scan", "PreserveFolderStructure": "preserve_structure", "MaxConcurrentTasks": "tasks", "MaxScanFileCount": "scans", "OutputPackageMode": "package_mode", "Language": "language", "HasCompletedOnboarding": "introduced"}
    return settings.migrated(files).select(F.col("path").alias("c_custkey"), "corrupted", "version", *[F.col(k).alias(v) for k, v in names.items()])
