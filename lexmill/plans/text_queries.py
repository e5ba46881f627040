"""Queries over composed Markdown: blocks, marks, metadata, quality; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import blocks, govmeta, quality, watermark
from lexmill.plans.compose import compose
from lexmill.plans.registry import query, table

COMPOSED = f"SELECT doc_id, {compose()} AS md FROM documents"
NAME = "CASE WHEN doc_id % 3 = 0 THEN 'report_' || CAST(doc_id AS VARCHAR) || '.docx' WHEN doc_id % 3 = 1 THEN '封面.pdf' END"
LINES = f"c AS ({COMPOSED}), s AS (SELECT doc_id, string_split(md, chr(10)) AS l FROM c), ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM s)"


def composed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{compose()} AS md")


KIND = r"""CASE WHEN regexp_matches(line, '^\s*$') THEN NULL WHEN starts_with(t, '#') THEN 'heading' WHEN starts_with(t, '|') THEN 'table'
  WHEN starts_with(t, '- ') OR starts_with(t, '* ') OR starts_with(t, '+ ') OR regexp_matches(t, '^\d+\.\s') THEN 'list_item'
  WHEN starts_with(t, '![') OR contains(t, '<!-- IMAGE_PLACEHOLDER') THEN 'image_placeholder'
  WHEN contains(t, '<!-- FOOTNOTE_PLACEHOLDER') THEN 'footnote_placeholder' WHEN contains(t, '<!-- COMMENT_PLACEHOLDER') THEN 'comment_placeholder'
  WHEN NOT starts_with(t, '<!--') AND NOT starts_with(t, '---') THEN 'paragraph' END"""
BLOCKS = f"""{LINES}, k AS (SELECT *, {KIND} AS kind FROM (SELECT *, regexp_replace(line, '^\\s+', '') AS t FROM ln)),
  b AS (SELECT *, kind IS NOT NULL AND NOT (kind = 'table' AND coalesce(lag(kind) OVER w, '') = 'table') AS starts,
    kind = 'table' AND coalesce(lead(kind) OVER w, '') = 'table' AS goes_on FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  n AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM b)"""


@query(f"WITH {BLOCKS} SELECT doc_id, kind AS block_type, count(*) AS n FROM n WHERE starts GROUP BY doc_id, kind")
def block_counts(spark, sf):
    return blocks.block_counts(composed(spark, sf))


@query(
    f"""WITH {BLOCKS} SELECT doc_id, md5(string_agg(line || CASE WHEN kind IS NOT NULL AND NOT coalesce(goes_on, false) THEN chr(10) || '<!-- block_id=b' || lpad(CAST(block_no AS VARCHAR), 4, '0')
    || ' type=' || kind || ' -->' ELSE '' END, chr(10) ORDER BY line_no)) AS marked_md5, CAST(max(block_no) AS BIGINT) AS block_count FROM n GROUP BY doc_id"""
)
def block_ids(spark, sf):
    out = blocks.with_block_ids(composed(spark, sf))
    return out.select("doc_id", F.md5(F.col("marked_md").cast("binary")).alias("marked_md5"), F.col("block_count").cast("long").alias("block_count"))


@query(
    f"WITH c AS ({COMPOSED}) SELECT doc_id, CAST(len(regexp_extract_all(md, '<!-- (?:IMAGE_PLACEHOLDER|FOOTNOTE_PLACEHOLDER|COMMENT_PLACEHOLDER|TABLE_TRUNCATED|TABLE_DEGRADED)')) AS BIGINT) AS n FROM c"
)
def unsupported_objects(spark, sf):
    return composed(spark, sf).select("doc_id", blocks.unsupported_count(F.col("md")).cast("long").alias("n"))


def _steps_sql() -> str:
    """The watermark steps as nested CTEs: (doc_id, md, n) after each."""
    parts = [f"w0 AS (SELECT doc_id, {compose()} AS md, 0 AS n FROM documents)"]
    re2 = lambda p: p.replace("(?md)", "(?m)").replace("'", "''")
    at = 0
    for step in watermark.STEPS:
        if step is None:
            parts.append(f"w{at + 1} AS (SELECT doc_id, regexp_replace(md, '\\n{{3,}}', chr(10) || chr(10), 'g') AS md, n FROM w{at})")
        else:
            p = re2(step[1])
            parts.append(f"w{at + 1} AS (SELECT doc_id, regexp_replace(md, '{p}', '', 'g') AS md, n + len(regexp_extract_all(md, '{p}')) AS n FROM w{at})")
        at += 1
    p = re2(watermark.UUID_LINE)
    parts.append(
        f"wz AS (SELECT doc_id, CASE WHEN n > 0 THEN regexp_replace(regexp_replace(md, '{p}', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE md END AS md,"
        f" n + CASE WHEN n > 0 THEN len(regexp_extract_all(md, '{p}')) ELSE 0 END AS n FROM w{at})"
    )
    return ", ".join(parts)


@query(f"WITH {_steps_sql()} SELECT doc_id, md5(md) AS clean_md5, CAST(n AS BIGINT) AS removed_blocks, n > 0 AS has_watermark FROM wz")
def watermark_clean(spark, sf):
    out = watermark.clean(composed(spark, sf))
    return out.select("doc_id", F.md5(F.col("clean_md").cast("binary")).alias("clean_md5"), F.col("removed_blocks").cast("long").alias("removed_blocks"), "has_watermark")


#: Every second document gets zero-width characters, some too few to count as a mark.
MARKED = f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN repeat('{watermark.ZERO_WIDTH[0]}{watermark.ZERO_WIDTH[6]}', CAST(doc_id % 23 AS INT)) ELSE '' END || coalesce(text, '') AS md FROM documents"


@query(
    f"""WITH m AS ({MARKED}), z AS (SELECT doc_id, md, translate(md, '{watermark.ZERO_WIDTH}', '') AS bare FROM m),
  d AS (SELECT *, length(md) - length(bare) AS zw, length(regexp_replace(bare, '\\s', '', 'g')) AS visible FROM z)
  SELECT doc_id, CAST(zw AS BIGINT) AS zero_width, CAST(visible AS BIGINT) AS visible, zw >= 10 AND CAST(zw AS DOUBLE) / greatest(zw + visible, 1) >= 0.005 AS is_mark,
  md5(CASE WHEN zw >= 10 AND CAST(zw AS DOUBLE) / greatest(zw + visible, 1) >= 0.005 THEN bare ELSE md END) AS stripped_md5 FROM d"""
)
def zero_width_marks(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("lexmill_documents")
    df = spark.sql(MARKED.replace("FROM documents", "FROM lexmill_documents"))
    n, visible = watermark.zero_width_counts(F.col("md"))
    mark = watermark.is_zero_width_mark(F.col("md"))
    bare = F.when(mark, F.translate("md", watermark.ZERO_WIDTH, "")).otherwise(F.col("md"))
    return df.select("doc_id", n.cast("long").alias("zero_width"), visible.cast("long").alias("visible"), mark.alias("is_mark"), F.md5(bare.cast("binary")).alias("stripped_md5"))


def _keywords_sql() -> dict[str, str]:
    any_of = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    ranked = sorted(govmeta.AUTHORITIES, key=lambda w: -len(w))
    best = lambda area: "CASE " + " ".join(f"WHEN contains({area}, '{w}') THEN '{w}'" for w in ranked) + " END"
    types = "CASE WHEN title IS NULL THEN NULL " + " ".join(f"WHEN {any_of('title', w)} THEN '{t}'" for t, w in govmeta.TYPES) + " ELSE 'other' END"
    topics = "concat_ws(',', " + ", ".join(f"CASE WHEN {any_of('area', w)} THEN '{t}' END" for t, w in govmeta.TOPICS) + ")"
    invalid = lambda c: f"({c} IS NULL OR length({c}) < 2 OR {any_of(f'lower({c})', govmeta.INVALID_TITLES)})"
    return {"best500": best("substr(md, 1, 500)"), "best2000": best("substr(md, 1, 2000)"), "tail": best("right(md, 1000)"), "types": types, "topics": topics, "bad_h": invalid("heading"), "bad_s": invalid("stem")}


_k = _keywords_sql()
_bracket = govmeta.BRACKETED.replace("\\s", "[\\s]").replace("'", "''")
GOV = f"""c AS (SELECT doc_id, md, {NAME} AS file_name FROM ({COMPOSED})),
  h AS (SELECT *, trim(substr(list_filter(list_transform(string_split(md, chr(10)), lambda x: ltrim(x)), lambda x: starts_with(x, '# '))[1], 3)) AS heading,
    regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM c),
  t AS (SELECT *, CASE WHEN NOT {_k['bad_h']} THEN trim(regexp_replace(heading, '^\\d+[.、\\s]+', '')) WHEN NOT {_k['bad_s']} THEN trim(regexp_replace(stem, '^\\d+[.、\\s]+', '')) END AS title FROM h),
  g AS (SELECT *, nullif(coalesce(nullif(regexp_extract(md, '(?:^|[^a-zA-Z\\x{{4E00}}-\\x{{9FFF}}])([a-zA-Z\\x{{4E00}}-\\x{{9FFF}}]{{2,10}}{_bracket})', 1), ''), regexp_extract(md, '{_bracket}', 0)), '') AS number,
    coalesce({_k['best500']}, {_k['best2000']}, CASE WHEN length(md) > 2000 THEN {_k['tail']} END) AS authority,
    regexp_extract(md, '(\\d{{4}})\\s*年\\s*(\\d{{1,2}})\\s*月\\s*(\\d{{1,2}})\\s*日', ['y', 'm', 'd']) AS cn,
    list_filter(list_transform(regexp_extract_all(md, '(?s)(?:.{{0,30}})\\d{{4}}[-.]\\d{{1,2}}[-.]\\d{{1,2}}'), lambda x: x), lambda x: NOT contains(lower(x), 'created_at') AND NOT contains(lower(x), 'updated_at')) AS iso,
    coalesce(title, '') || chr(10) || substr(md, 1, 3000) AS area FROM t),
  f AS (SELECT doc_id, title, number, authority, {_k['types']} AS type, {_k['topics']} AS topics,
    CASE WHEN try_cast(cn.y AS INT) BETWEEN 1980 AND 2100 THEN cn.y || '-' || lpad(cn.m, 2, '0') || '-' || lpad(cn.d, 2, '0') END AS cn_date FROM g)"""


@query(f"WITH {GOV} SELECT doc_id, title, number, authority, type, topics, cn_date FROM f")
def gov_metadata(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", f"{compose()} AS md", f"{NAME.replace('VARCHAR', 'STRING')} AS file_name")
    out = govmeta.extract(df)
    cn = F.when(F.regexp_extract("md", govmeta.CHINESE_DATE, 1).try_cast("int").between(1980, 2100), F.col("gov_date"))
    return out.select("doc_id", F.col("gov_title").alias("title"), F.col("gov_number").alias("number"), F.col("gov_authority").alias("authority"), F.col("gov_type").alias("type"), F.concat_ws(",", "gov_topics").alias("topics"), cn.alias("cn_date"))


@query(
    f"""WITH {GOV} SELECT doc_id, title IS NOT NULL AND (number IS NOT NULL OR authority IS NOT NULL) AS gov_document,
    round_even(CAST(least(CASE WHEN title IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN number IS NOT NULL THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN authority IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN d THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(type <> 'other', false) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN topics <> '' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS DOUBLE), 2) AS confidence
    FROM (SELECT f.*, cn_date IS NOT NULL OR doc_id % 6 = 3 AS d FROM f)"""
)
def gov_confidence(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", f"{compose()} AS md", f"{NAME.replace('VARCHAR', 'STRING')} AS file_name")
    return govmeta.extract(df).select("doc_id", "gov_document", F.col("gov_confidence").alias("confidence"))


CODES = list(quality.WARNINGS) + ["W_UNHEARD_OF"]
WARNING_ROWS = f"SELECT user_id, event_id, {'CASE CAST(event_id % ' + str(len(CODES)) + ' AS INT) ' + ' '.join(f'WHEN {i} THEN ' + chr(39) + c + chr(39) for i, c in enumerate(CODES)) + ' END'} AS code FROM events"
SEVERITY = "CASE " + " ".join(f"WHEN code = '{c}' THEN '{s}'" for c, (s, _) in quality.WARNINGS.items()) + " ELSE 'low' END"
PENALTY = "CASE " + " ".join(f"WHEN code = '{c}' THEN {p}::DOUBLE" for c, (_, p) in quality.WARNINGS.items()) + " ELSE 0.01::DOUBLE END"


def warnings(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("lexmill_events")
    return spark.sql(WARNING_ROWS.replace("FROM events", "FROM lexmill_events"))


@query(
    f"WITH w AS (SELECT user_id, {SEVERITY} AS s FROM ({WARNING_ROWS})) SELECT user_id, count(*) FILTER (s = 'high') AS n_high, count(*) FILTER (s = 'medium') AS n_medium, count(*) FILTER (s = 'low') AS n_low, count(*) AS n_warnings FROM w GROUP BY user_id"
)
def severity_counts(spark, sf):
    return quality.severity_counts(warnings(spark, sf), "user_id")


QUALITY = f"""w AS (SELECT user_id, event_id, {PENALTY} AS p, {SEVERITY} AS s FROM ({WARNING_ROWS})),
  q AS (SELECT user_id, list_reduce(list(p ORDER BY event_id), lambda a, x: a - x, 1.0::DOUBLE) AS r, bool_or(s = 'high') AS high FROM w GROUP BY user_id),
  r AS (SELECT user_id, high, greatest(least(r - CASE WHEN user_id % 5 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN user_id % 7 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 0.0::DOUBLE) AS raw FROM q)"""


@query(
    f"""WITH {QUALITY} SELECT user_id, CAST(round_even(raw, 2) AS DOUBLE) AS quality_score, CASE WHEN raw >= 0.9 THEN 'high' WHEN raw >= 0.7 THEN 'medium' WHEN raw >= 0.5 THEN 'low' ELSE 'poor' END AS quality_level,
    CASE WHEN user_id % 11 = 0 THEN 'not_recommended' WHEN high OR round_even(raw, 2) < 0.7 THEN 'review' ELSE 'recommended' END AS import_recommendation FROM r"""
)
def quality_scores(spark, sf):
    codes = quality.ordered_codes(warnings(spark, sf), "user_id", "event_id")
    df = codes.withColumn("success", F.col("user_id") % 11 != 0).withColumn("ocr_used", F.col("user_id") % 5 == 0).withColumn("numbered_official", F.col("user_id") % 7 == 0)
    return quality.with_quality(df).select("user_id", "quality_score", "quality_level", "import_recommendation")


@query(
    f"""WITH w AS (SELECT user_id, event_id, code, {PENALTY} AS p, {SEVERITY} AS s FROM ({WARNING_ROWS})),
    q AS (SELECT user_id, greatest(least(list_reduce(list(p ORDER BY event_id, code), lambda a, x: a - x, 1.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS raw, count(*) AS n, count(*) FILTER (s = 'high') AS n_high,
    count(*) FILTER (s = 'medium') AS n_medium, count(*) FILTER (s = 'low') AS n_low, string_agg('{{"code":"' || code || '","severity":"' || s || '","message":"' || code || '"}}', ',' ORDER BY event_id, code) AS told FROM w GROUP BY user_id)
    SELECT user_id, '{{"overallScore":' || CAST(CAST(round_even(raw, 2) AS DOUBLE) AS VARCHAR) || ',"overallLevel":"' || CASE WHEN raw >= 0.9 THEN 'high' WHEN raw >= 0.7 THEN 'medium' WHEN raw >= 0.5 THEN 'low' ELSE 'poor' END
    || '","importRecommendation":"' || CASE WHEN n_high > 0 OR round_even(raw, 2) < 0.7 THEN 'review' ELSE 'recommended' END || '","govDocument":false,"govConfidence":0.0,"totalWarnings":' || n
    || ',"highSeverityCount":' || n_high || ',"mediumSeverityCount":' || n_medium || ',"lowSeverityCount":' || n_low || ',"warnings":[' || told || ']}}' AS report FROM q"""
)
def quality_report_json(spark, sf):
    codes = quality.ordered_codes(warnings(spark, sf), "user_id", "event_id")
    df = codes.withColumn("success", F.lit(True)).withColumn("ocr_used", F.lit(False)).withColumn("numbered_official", F.lit(False))
    df = quality.with_quality(df)
    none = F.lit(None).cast("string")
    told = F.transform("codes", lambda c: F.struct(c.alias("code"), c.alias("message"), none.alias("location")))
    report = quality.report_json(told, F.col("quality_score"), F.col("quality_level"), F.col("import_recommendation"), F.lit(False), F.lit(0.0), none)
    return df.select("user_id", report.alias("report"))


@query("SELECT doc_id, lower(sha256(coalesce(text, ''))) AS sha256 FROM documents")
def source_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\s+([，。、；：！？）】》」』,.;:!?)\]])', '\1', 'g')) AS spaced,
    regexp_matches(regexp_replace(text, '\s+$', ''), '[。！？.?!」』】…；;]$') AS ends FROM documents WHERE text IS NOT NULL"""
)
def page_spaces(spark, sf):
    df = table(spark, sf, "documents").where("text is not null")
    return df.select("doc_id", T.normal_spaces(F.col("text")).alias("spaced"), T.ends_paragraph(F.regexp_replace("text", r"\s+\z", "")).alias("ends"))
