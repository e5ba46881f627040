"""Queries over pages of positioned words: rows, lines, columns and tables; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import layout
from lexmill.operators import page_tables as P
from lexmill.operators import page_text
from lexmill.plans.registry import query, table
from lexmill.plans.table_queries import WORDS

#: Every third page has nine ruling lines.
RULED = WORDS.replace(" FROM {}", ", CASE WHEN l_orderkey % 3 = 2 THEN 9 ELSE 0 END AS paths FROM {}")
_DOUBLES = ("page_width", "left", "right", "top", "height", "font_size")


def words(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lexmill_lineitem")
    return layout.font_facts(spark.sql(RULED.format("lexmill_lineitem")).withColumns({c: F.col(c).cast("double") for c in _DOUBLES}))


def _page(df):
    return df.withColumn("page", F.col("page").cast("long"))


# ---- the same in SQL: tables that stand on each other ------------------------------------------

_WORDS = """WITH RECURSIVE w AS (
  SELECT doc_id, CAST(page AS BIGINT) AS page, text, CAST(l AS DOUBLE) AS l, CAST(r AS DOUBLE) AS r, CAST(top AS DOUBLE) AS top, CAST(font_size AS DOUBLE) AS size, font_name = 'X-Bold' AS bold, paths FROM ({})
), s AS (SELECT doc_id, page, list_sort(list(size))[count(*) // 2 + 1] AS median, max(paths) AS paths FROM w GROUP BY ALL
), t AS (SELECT DISTINCT doc_id, page, top FROM w
), k AS (SELECT doc_id, page, kind, CASE kind WHEN 'line' THEN greatest(3.0::DOUBLE, 0.6::DOUBLE * median) ELSE greatest(median, 10.0::DOUBLE) END AS reach FROM s, (VALUES ('line'), ('row')) v(kind)
), a AS (
  SELECT t.doc_id, t.page, kind, reach, 0 AS no, max(top) AS top FROM t JOIN k ON t.doc_id = k.doc_id AND t.page = k.page GROUP BY ALL
  UNION ALL SELECT a.doc_id, a.page, a.kind, a.reach, a.no + 1, max(t.top) FROM a JOIN t ON a.doc_id = t.doc_id AND a.page = t.page AND a.top - t.top > a.reach GROUP BY ALL
), r AS (
  SELECT t.doc_id, t.page, t.top, max(CASE WHEN kind = 'line' THEN no END) AS line_no, max(CASE WHEN kind = 'row' THEN no END) AS row_no
  FROM t JOIN a ON t.doc_id = a.doc_id AND t.page = a.page AND a.top >= t.top GROUP BY ALL
), x AS (SELECT w.* EXCLUDE (paths), line_no, row_no, median, s.paths FROM w JOIN r USING (doc_id, page, top) JOIN s USING (doc_id, page))""".format(
    RULED.format("lineitem").replace(" AS left,", " AS l,").replace(" AS right,", " AS r,")
)

_LINES = """, p AS (
  SELECT *, lag(text) OVER o AS bt, lag(l) OVER o AS bl, lag(r) OVER o AS br FROM x WINDOW o AS (PARTITION BY doc_id, page, line_no ORDER BY l, r, text)
), tl AS (
  SELECT doc_id, page, line_no, string_agg(CASE WHEN bt IS NULL OR (br > bl AND (l - br) / ((br - bl) / length(bt)) <= 0.5) THEN '' ELSE ' ' END || text, '' ORDER BY l, r, text) AS text,
    min(l) AS left_edge, avg(top) AS top, avg(size) AS size, bool_or(bold) AS bold FROM p GROUP BY ALL
)"""

_ROWS = """, cg AS (
  SELECT *, count(*) OVER q AS n, avg((r - l) / length(text)) OVER q AS width, l - lag(r) OVER (PARTITION BY doc_id, page, row_no ORDER BY l, r, text) AS gap FROM x WINDOW q AS (PARTITION BY doc_id, page, row_no)
), cc AS (
  SELECT *, sum(CASE WHEN gap > greatest(width * 3, 15.0::DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, row_no ORDER BY l, r, text ROWS UNBOUNDED PRECEDING) AS cluster FROM cg WHERE n > 1
), cl AS (SELECT doc_id, page, row_no, cluster, min(l) AS l FROM cc GROUP BY ALL
), lr AS (
  SELECT x.doc_id, x.page, x.row_no, avg(top) AS y, count(*) AS n_words, max(median) AS median, max(paths) AS paths, max(coalesce(c.n, 0)) AS clusters
  FROM x LEFT JOIN (SELECT doc_id, page, row_no, count(*) AS n FROM cl GROUP BY ALL) c ON x.doc_id = c.doc_id AND x.page = c.page AND x.row_no = c.row_no GROUP BY ALL
)"""

_REGIONS = """, m AS (
  SELECT *, sum(CASE WHEN up - y > median * 1.5 * CASE WHEN paths > 5 THEN 4.0 ELSE 2.5 END THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS region
  FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY row_no) AS up FROM lr WHERE clusters > 1)
), lo AS (
  SELECT m.doc_id, m.page, region, cl.l, row_number() OVER (PARTITION BY m.doc_id, m.page, region ORDER BY cl.l) AS i FROM m JOIN cl ON m.doc_id = cl.doc_id AND m.page = cl.page AND m.row_no = cl.row_no
), cr AS (
  SELECT doc_id, page, region, i, 0 AS c, l AS s, 1 AS n FROM lo WHERE i = 1
  UNION ALL SELECT lo.doc_id, lo.page, lo.region, lo.i, CASE WHEN abs(lo.l - s / n) <= 20 THEN c ELSE c + 1 END, CASE WHEN abs(lo.l - s / n) <= 20 THEN s + lo.l ELSE lo.l END, CASE WHEN abs(lo.l - s / n) <= 20 THEN n + 1 ELSE 1 END
  FROM cr JOIN lo ON cr.doc_id = lo.doc_id AND cr.page = lo.page AND cr.region = lo.region AND lo.i = cr.i + 1
), co AS (
  SELECT doc_id, page, region, list(mean ORDER BY mean) AS columns FROM (SELECT doc_id, page, region, c, arg_max(s / n, n) AS mean FROM cr GROUP BY ALL) GROUP BY ALL
), g AS (
  SELECT z.*, columns, list_transform(range(1, len(columns)), lambda i: (columns[i] + columns[i + 1]) / 2) AS splits FROM (
    SELECT doc_id, page, region, count(*) AS n_rows, min(y) - max(median) AS low, max(y) + max(median) AS high, max(median) AS median FROM m GROUP BY ALL HAVING count(*) >= 3
  ) z JOIN co ON z.doc_id = co.doc_id AND z.page = co.page AND z.region = co.region WHERE len(columns) >= 2
)"""

_CELLS = """, d AS (
  SELECT x.doc_id, x.page, region, x.row_no, l, r, text, len(list_filter(splits, lambda v: (l + r) / 2 > v)) AS col
  FROM x JOIN lr ON x.doc_id = lr.doc_id AND x.page = lr.page AND x.row_no = lr.row_no JOIN g ON lr.doc_id = g.doc_id AND lr.page = g.page AND y BETWEEN low AND high
), e AS (
  SELECT *, sum(CASE WHEN col <> was THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, row_no ORDER BY l, r, text ROWS UNBOUNDED PRECEDING) AS cell_no
  FROM (SELECT *, lag(col) OVER (PARTITION BY doc_id, page, row_no ORDER BY l, r, text) AS was FROM d)
), f AS (SELECT doc_id, page, region, row_no, CAST(cell_no AS BIGINT) AS cell_no, max(col) AS col, trim(string_agg(text, '' ORDER BY l, r, text)) AS text FROM e GROUP BY ALL)"""

_MARKED = """, u AS (
  SELECT doc_id, page, region, row_no, count(*) AS filled, string_agg(text, ' ' ORDER BY cell_no) AS text, string_agg(col || ':' || text, '|' ORDER BY cell_no) AS cells FROM f GROUP BY ALL
), v AS (
  SELECT u.*, y, low, high, g.median FROM u JOIN (SELECT doc_id, page, region FROM u GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (filled >= 2) / count(*) >= 0.4) o USING (doc_id, page, region)
  JOIN g USING (doc_id, page, region) JOIN lr ON u.doc_id = lr.doc_id AND u.page = lr.page AND u.row_no = lr.row_no
), h AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, row_no ORDER BY line_no) = 1 AS first FROM (
    SELECT tl.doc_id, tl.page, tl.line_no, min(row_no) AS row_no FROM tl JOIN v ON tl.doc_id = v.doc_id AND tl.page = v.page AND tl.top BETWEEN y - median * 0.6 AND y + median * 0.6 GROUP BY ALL)
), i AS (SELECT DISTINCT tl.doc_id, tl.page, tl.line_no FROM tl JOIN v ON tl.doc_id = v.doc_id AND tl.page = v.page AND tl.top BETWEEN low AND high
), j AS (
  SELECT tl.doc_id, tl.page, tl.line_no, tl.text, h.row_no, first, v.text AS row_text, v.cells, i.line_no IS NOT NULL AND first IS NULL AND length(tl.text) < 60 AND NOT regexp_matches(tl.text, '[。！？.?!」』】…；;]$') AS alone
  FROM tl LEFT JOIN h USING (doc_id, page, line_no) LEFT JOIN v ON h.doc_id = v.doc_id AND h.page = v.page AND h.row_no = v.row_no LEFT JOIN i ON i.doc_id = tl.doc_id AND i.page = tl.page AND i.line_no = tl.line_no
)"""


# Here no word begins like a heading or a list, and no line is empty but the pages' marks: the SQL leaves these rules out.
_KINDS = """, seq AS (
  SELECT j.doc_id, j.page, j.line_no, CASE WHEN first THEN row_text ELSE j.text END AS text, CASE WHEN first OR alone THEN 'table' ELSE 'body' END AS kind, coalesce(NOT first, FALSE) AS merged, left_edge, size, bold
  FROM j JOIN tl USING (doc_id, page, line_no)
  UNION ALL SELECT doc_id, unnest(range(above + 1, page + 1)), -1, '', 'empty', FALSE, 0, 0, FALSE FROM (SELECT doc_id, page, lag(page, 1, 0) OVER (PARTITION BY doc_id ORDER BY page) AS above FROM s)
), ki AS (
  SELECT doc_id, page, line_no, text, merged, left_edge, size, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) AS i,
    CASE WHEN kind <> 'body' THEN kind WHEN (bold AND length(text) <= 30) OR (length(text) < 30 AND size > was * 1.3) THEN 'heading' ELSE 'body' END AS kind
  FROM (SELECT *, last_value(CASE WHEN kind = 'body' THEN size END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM seq)
), st AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS head, FALSE AS taken, CAST(0 AS DOUBLE) AS head_size, CAST(NULL AS BIGINT) AS owner FROM ki
  UNION ALL SELECT doc_id, i, CASE WHEN goes OR waits THEN head WHEN begins THEN i ELSE 0 END, goes OR (waits AND taken), CASE WHEN goes OR waits THEN head_size WHEN begins THEN size ELSE 0 END, CASE WHEN goes THEN head END FROM (
    SELECT ki.doc_id, ki.i, head, taken, head_size, size, head > 0 AND kind = 'empty' AND NOT taken AS waits, kind = 'heading' AND NOT merged AS begins,
      head > 0 AND (kind = 'heading' OR (kind = 'body' AND (head_size <= 0 OR size <= 0 OR abs(head_size - size) / head_size <= 0.15))) AS goes
    FROM st JOIN ki ON ki.doc_id = st.doc_id AND ki.i = st.i + 1)
), fl AS (
  SELECT ki.* EXCLUDE (text, merged), coalesce(whole, text) AS text, merged OR owner IS NOT NULL AS merged FROM ki JOIN st USING (doc_id, i)
  LEFT JOIN (SELECT ki.doc_id, coalesce(owner, i) AS i, string_agg(text, ' ' ORDER BY i) AS whole FROM ki JOIN st USING (doc_id, i) WHERE owner IS NOT NULL OR (kind = 'heading' AND NOT merged) GROUP BY ALL) USING (doc_id, i)
)"""

_TABLES = """, tr AS (
  SELECT doc_id, page, line_no, i, text, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), '') <> 'table' AS opens FROM fl) WHERE kind = 'table'
), tc AS (
  SELECT doc_id, run, i, col, trim(string_agg(text, ' ' ORDER BY cell_no)) AS text FROM (
    SELECT tr.doc_id, run, i, col, cell_no, f.text FROM tr JOIN j USING (doc_id, page, line_no) JOIN f ON f.doc_id = j.doc_id AND f.page = j.page AND f.row_no = j.row_no WHERE first
    UNION ALL SELECT doc_id, run, i, 0, 0, tr.text FROM tr JOIN j USING (doc_id, page, line_no) WHERE first IS NULL) GROUP BY ALL
), tn AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS nth FROM (SELECT doc_id, run, i, count(*) FILTER (text <> '') AS filled, max(col) + 1 AS w FROM tc GROUP BY ALL)
), tw AS (SELECT doc_id, run, max(w) AS width, count(*) AS n, sum(filled) AS filled, min(i) AS i FROM tn GROUP BY ALL
), th AS (SELECT tw.doc_id, tw.run, coalesce(min(CASE WHEN nth > 1 AND NOT (tn.filled > 0 AND tn.filled <= width // 2 + 1) THEN nth END) - 1, max(n)) AS header FROM tn JOIN tw USING (doc_id, run) GROUP BY ALL
), tg AS (
  SELECT q.doc_id, q.run, greatest(nth, header) AS line, c, string_agg(coalesce(tc.text, ''), '' ORDER BY nth) AS text
  FROM (SELECT tn.doc_id, tn.run, tn.i, nth, header, unnest(range(width)) AS c FROM tn JOIN tw USING (doc_id, run) JOIN th USING (doc_id, run)) q LEFT JOIN tc ON tc.doc_id = q.doc_id AND tc.run = q.run AND tc.i = q.i AND tc.col = q.c
  GROUP BY ALL
), tx AS (
  SELECT tw.doc_id, tw.i, width < 2 OR width * n - filled > 0.4 * width * n AS degraded, width < 2 AS narrow, plain,
    head || chr(10) || '| ' || array_to_string(list_transform(range(width), lambda z: '---'), ' | ') || ' |' || chr(10) || coalesce(rest || chr(10), '') || chr(10) AS whole
  FROM tw JOIN (SELECT doc_id, run, string_agg(text || chr(10), '' ORDER BY i) AS plain FROM tr GROUP BY ALL) USING (doc_id, run) JOIN (
    SELECT doc_id, run, string_agg(said, chr(10) ORDER BY line) FILTER (line = header) AS head, string_agg(said, chr(10) ORDER BY line) FILTER (line > header) AS rest
    FROM (SELECT doc_id, run, line, '| ' || string_agg(text, ' | ' ORDER BY c) || ' |' AS said FROM tg GROUP BY ALL) JOIN th USING (doc_id, run) GROUP BY ALL) USING (doc_id, run)
), bm AS (
  SELECT doc_id, arg_min(margin, (-n, first)) AS base FROM (SELECT doc_id, round_even(left_edge, 0) AS margin, count(*) AS n, min(i) AS first FROM fl WHERE NOT merged AND kind = 'body' GROUP BY ALL) GROUP BY ALL
), ev AS (
  SELECT fl.doc_id, fl.i, kind, was, degraded, CASE WHEN degraded THEN '<!-- TABLE_DEGRADED: ' || CASE WHEN narrow THEN '表格列数不足2列' ELSE '空单元格超过40%' END || '，退化为纯文本 -->' || chr(10) || plain || chr(10) ELSE whole END AS said, text,
    row_number() OVER (PARTITION BY fl.doc_id, kind ORDER BY fl.i) AS nth, was = 'body' AND kind = 'body' AND NOT (ends OR left_edge > coalesce(base, 0) + 10) AS goes_on
  FROM (SELECT *, coalesce(lag(kind) OVER o, '') AS was, coalesce(regexp_matches(lag(text) OVER o, '[。！？.?!」』】…；;]$'), FALSE) AS ends FROM fl WHERE NOT merged WINDOW o AS (PARTITION BY doc_id ORDER BY i)) fl
  LEFT JOIN tx ON tx.doc_id = fl.doc_id AND tx.i = fl.i LEFT JOIN bm ON bm.doc_id = fl.doc_id WHERE kind <> 'table' OR whole IS NOT NULL
)"""


@query(_WORDS + _LINES + " SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, text, left_edge, top AS top_mean, size AS size_mean, bold FROM tl")
def page_text_lines(spark, sf):
    """Words into lines by the first word's limit, with what each line says and where it stands."""
    lines = _page(P.text_lines(P.numbered_words(words(spark, sf))))
    return lines.select("doc_id", "page", F.col("line_no").cast("long").alias("line_no"), "text", F.col("left").alias("left_edge"), F.col("top").alias("top_mean"), F.col("size").alias("size_mean"), "bold")


@query(_WORDS + _ROWS + " SELECT doc_id, page, CAST(row_no AS BIGINT) AS row_no, y, n_words, clusters FROM lr")
def page_loose_rows(spark, sf):
    """Words into the looser rows of tables, and how many word clusters each has."""
    rows = _page(P.loose_rows(P.numbered_words(words(spark, sf))))
    return rows.select("doc_id", "page", F.col("row_no").cast("long").alias("row_no"), "y", "n_words", "clusters")


@query(
    _WORDS + _ROWS + _REGIONS
    + " SELECT doc_id, page, CAST(region AS BIGINT) AS region, n_rows, low, high, array_to_string(list_transform(columns, lambda c: CAST(CAST(floor(c * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS columns_milli FROM g"
)
def page_table_regions(spark, sf):
    """Where tables stand on pages, and the columns of each."""
    found = _page(P.table_regions(P.loose_rows(P.numbered_words(words(spark, sf)))))
    milli = F.array_join(F.transform("columns", lambda c: F.floor(c * 1000 + 0.5).cast("string")), ",")
    return found.select("doc_id", "page", "region", "n_rows", "low", "high", milli.alias("columns_milli"))


@query(_WORDS + _ROWS + _REGIONS + _CELLS + " SELECT doc_id, page, CAST(region AS BIGINT) AS region, CAST(row_no AS BIGINT) AS row_no, cell_no, CAST(col AS BIGINT) AS col, text FROM f")
def page_table_cells(spark, sf):
    """The words of tables' rows by column."""
    own = P.numbered_words(words(spark, sf))
    rows = P.loose_rows(own)
    cells = _page(P.table_cells(own, rows, P.table_regions(rows)))
    return cells.select("doc_id", "page", "region", F.col("row_no").cast("long").alias("row_no"), "cell_no", F.col("column").cast("long").alias("col"), "text")


@query(
    _WORDS + _LINES + _ROWS + _REGIONS + _CELLS + _MARKED
    + """ SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, CASE WHEN first THEN row_text ELSE text END AS text, CASE WHEN first OR alone THEN 'table' ELSE 'body' END AS kind,
    coalesce(NOT first, FALSE) AS merged, CASE WHEN first THEN cells WHEN alone THEN '0:' || text END AS cells FROM j"""
)
def page_table_lines(spark, sf):
    """The lines of pages with those of tables marked, their cells beside them."""
    lines = _page(P.page_lines(words(spark, sf)))
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["column"].cast("string"), c["text"])), "|")
    return lines.select("doc_id", "page", F.col("line_no").cast("long").alias("line_no"), "text", "kind", "merged", cells.alias("cells"))


@query(_WORDS + _LINES + _ROWS + _REGIONS + _CELLS + _MARKED + _KINDS + """ SELECT doc_id, page, CAST(line_no AS BIGINT) AS line_no, text, kind, CASE WHEN kind = 'heading' THEN 4 ELSE 0 END AS level, -1 AS number, merged FROM fl WHERE line_no >= 0""")
def page_lines(spark, sf):
    """The lines of documents in their kinds, headings with the lines that go on with them."""
    lines = page_text.page_lines(words(spark, sf))
    return lines.withColumns({"page": F.col("page").cast("long"), "line_no": F.col("line_no").cast("long")})


@query(
    _WORDS + _LINES + _ROWS + _REGIONS + _CELLS + _MARKED + _KINDS + _TABLES
    + r""" SELECT doc_id, trim(regexp_replace(string_agg(CASE WHEN was = 'body' AND NOT goes_on THEN chr(10) || chr(10) ELSE '' END || CASE kind WHEN 'body' THEN CASE WHEN goes_on THEN ' ' ELSE '' END || text
      WHEN 'empty' THEN CASE WHEN nth > 1 THEN chr(10) ELSE '' END || '<!-- PAGE_START: ' || nth || ' -->' || chr(10) WHEN 'table' THEN chr(10) || said ELSE chr(10) || '#### ' || text || chr(10) END, '' ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) || chr(10) AS raw_md,
    CAST(count(*) FILTER (degraded) AS INT) AS degraded_tables FROM ev GROUP BY doc_id"""
)
def page_markdown(spark, sf):
    """Documents of positioned words as Markdown."""
    return page_text.page_markdown(words(spark, sf))
