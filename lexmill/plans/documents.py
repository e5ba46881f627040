"""The whole way from raw Markdown to processed documents, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import blocks, govmeta, quality, watermark

CODES = "array<string>"
KEPT = ("removed_blocks", "gov_title", "gov_confidence", "gov_document", "quality_score", "quality_level", "import_recommendation", "codes")


#: What the warning of a mark says, and where.
MARKED, WHERE = "检测到 AIGC 水印污染，已过滤 %d 处（类型: %s）", "全文"
COUNTS = ("page_count", "sheet_count", "slide_count")


def process(docs: DataFrame, converter: str = "lexmill", latest: int = 2100, converted_at: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, file_name, source_type, md, codes, ocr_used) -> markdown, metadata, quality.

    ``docs`` may have ``warnings`` (array of code, message, location) in place of ``codes``, and source_size,
    source_sha256 (else the text's), page_count, sheet_count and slide_count.  ``keep`` names columns that are
    passed on.  Blank documents pass through unchanged.  One exchange by row (for the block marks): lines go through it
    with the row's number, the other columns on the first line, so ids may repeat or be null.
    """
    warning = lambda code, message, place: F.struct(code.alias("code"), message.alias("message"), place.alias("location"))
    told = F.col("warnings") if "warnings" in docs.columns else F.transform(F.coalesce("codes", F.array().cast(CODES)), lambda c: warning(c, c, F.lit(None).cast("string")))
    df = docs.withColumn("warnings", told).withColumn("ocr_used", F.coalesce("ocr_used", F.lit(False)))
    df = watermark.clean(df)
    mark = warning(F.lit("W_AIGC_WATERMARK"), F.format_string(MARKED, F.col("removed_blocks"), F.array_join(F.array_distinct("detected_types"), ", ")), F.lit(WHERE))
    df = df.withColumn("warnings", F.when(F.col("has_watermark"), F.concat("warnings", F.array(mark))).otherwise(F.col("warnings")))
    df = df.withColumn("codes", F.transform("warnings", lambda w: w["code"]))
    df = govmeta.extract(df, "clean_md", latest=latest)
    df = df.withColumn("numbered_official", F.col("gov_document") & F.col("gov_number").isNotNull()).withColumn("success", F.lit(True))
    df = quality.with_quality(df)
    q = blocks.quoted
    topics = F.when(F.size("gov_topics") > 0, F.concat(F.lit('["'), F.array_join("gov_topics", '", "'), F.lit('"]')))
    nothing = F.lit(None).cast("string")
    front = blocks.front_matter(
        [
            ("source_file", q(F.col("file_name"))),
            ("source_type", q(F.col("source_type"))),
            ("source_size", blocks.positive(F.col("source_size")) if "source_size" in docs.columns else nothing),
            ("source_sha256", q(F.col("source_sha256") if "source_sha256" in docs.columns else F.sha2(F.coalesce("md", F.lit("")).cast("binary"), 256))),
            *[(c, blocks.positive(F.col(c))) for c in COUNTS if c in docs.columns],
            ("ocr_used", F.col("ocr_used").cast("string")),
            ("converted_at", q(F.lit(converted_at).cast("string"))),
            ("converter", q(F.lit(converter))),
            ("gov_title", q(F.col("gov_title"))),
            ("gov_doc_number", q(F.col("gov_number"))),
            ("gov_issuing_authority", q(F.col("gov_authority"))),
            ("gov_publish_date", q(F.col("gov_date"))),
            ("gov_document_type", q(F.col("gov_type"))),
            ("gov_keywords", topics),
            ("gov_confidence", F.when(F.col("gov_confidence") > 0, F.format_string("%.2f", F.col("gov_confidence")))),
            ("gov_document", F.when(F.col("gov_document"), F.lit("true"))),
        ]
    )
    blank = F.trim(F.coalesce("md", F.lit(""))) == ""
    made = F.struct(
        "doc_id",
        blank.alias("blank"),
        F.when(blank, F.col("md")).otherwise(F.concat(front, blocks.agent_notice(F.col("warnings"), F.col("ocr_used")))).alias("before"),
        blocks.unsupported_count(F.coalesce("clean_md", F.lit(""))).alias("unsupported_count"),
        *KEPT,
        *keep,
    )
    numbered = df.select(F.monotonically_increasing_id().alias("row_no"), "clean_md", made.alias("made"))
    out = blocks.with_block_ids(numbered, "clean_md", "row_no", "made")
    return out.select(
        "made.doc_id",
        F.when(F.col("made.blank"), F.col("made.before")).otherwise(F.concat("made.before", "marked_md")).alias("markdown"),
        "block_count",
        "made.unsupported_count",
        *[F.col(f"made.{c}") for c in (*KEPT, *keep)],
    )
