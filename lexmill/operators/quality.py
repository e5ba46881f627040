"""Warnings, severities, quality score, recommendation and the JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Warning code -> (severity, penalty).  Other codes: low, 0.01.
WARNINGS = {
    "W_IMG_LOST": ("high", 0.15),
    "W_TABLE_DEGRADE": ("high", 0.12),
    "W_OCR_FAILED": ("high", 0.15),
    "W_AIGC_WATERMARK": ("high", 0.10),
    "W_TABLE_TRUNCATED": ("medium", 0.05),
    "W_MERGED_CELLS": ("medium", 0.03),
    "W_FOOTNOTE_LOST": ("medium", 0.05),
    "W_COMMENT_LOST": ("medium", 0.05),
    "W_OCR_LOW_CONFIDENCE": ("medium", 0.05),
    "W_CHART_LOST": ("medium", 0.05),
    "W_EMBEDDED_OBJECT_LOST": ("medium", 0.05),
    "W_TWO_COLUMN_PDF": ("medium", 0.05),
    "W_LEGACY_FALLBACK": ("medium", 0.08),
    "W_HYPERLINK_URL_LOST": ("low", 0.01),
    "W_ORDERED_LIST_FLAT": ("low", 0.02),
    "W_REVISION_LOST": ("low", 0.02),
    "W_FORMULA_LOST": ("low", 0.02),
    "W_HIDDEN_ROW": ("low", 0.02),
}


def _lookup(code: Column, at: int, other: object) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in WARNINGS.items() for x in (k, v[at])])
    return F.coalesce(F.element_at(table, code), F.lit(other))


def severity(code: Column) -> Column:
    return _lookup(code, 0, "low")


def penalty(code: Column) -> Column:
    return _lookup(code, 1, 0.01)


def raw_score(codes: Column, ocr_used: Column, numbered_official: Column) -> Column:
    """1 less the penalties in the warnings' order, -0.05 for OCR, +0.05 for a numbered official document."""
    score = F.aggregate(F.transform(codes, penalty), F.lit(1.0), lambda a, p: a - p)
    score = score - F.when(ocr_used, F.lit(0.05)).otherwise(F.lit(0.0)) + F.when(numbered_official, F.lit(0.05)).otherwise(F.lit(0.0))
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def level(raw: Column) -> Column:
    return F.when(raw >= 0.9, F.lit("high")).when(raw >= 0.7, F.lit("medium")).when(raw >= 0.5, F.lit("low")).otherwise(F.lit("poor"))


def recommendation(success: Column, codes: Column, score: Column) -> Column:
    high = F.exists(codes, lambda c: severity(c) == "high")
    return F.when(~success, F.lit("not_recommended")).when(high | (score < 0.7), F.lit("review")).otherwise(F.lit("recommended"))


def with_quality(df: DataFrame, codes: str = "codes", success: str = "success", ocr: str = "ocr_used", official: str = "numbered_official") -> DataFrame:
    raw = raw_score(F.col(codes), F.col(ocr), F.col(official))
    df = df.withColumn("_raw", raw).withColumn("quality_score", F.bround("_raw", 2)).withColumn("quality_level", level(F.col("_raw"))).drop("_raw")
    return df.withColumn("import_recommendation", recommendation(F.col(success), F.col(codes), F.col("quality_score")))


def ordered_codes(warnings: DataFrame, key: str, seq: str, code: str = "code") -> DataFrame:
    """(key, codes): a document's warning codes in order."""
    pairs = F.sort_array(F.collect_list(F.struct(seq, code)))
    return warnings.groupBy(key).agg(F.transform(pairs, lambda x: x[code]).alias("codes"))


def severity_counts(warnings: DataFrame, key: str, code: str = "code") -> DataFrame:
    kinds = [F.count_if(severity(F.col(code)) == s).alias(f"n_{s}") for s in ("high", "medium", "low")]
    return warnings.groupBy(key).agg(*kinds, F.count("*").alias("n_warnings"))


def report_json(
    warnings: Column, score: Column, quality_level: Column, recommended: Column, official: Column, confidence: Column, checked_at: Column, source_file: Column | None = None, source_type: Column | None = None
) -> Column:
    """The quality report of ``warnings`` (array of code, message, location); fields that are null are left out."""
    count = lambda s: F.size(F.filter(warnings, lambda w: severity(w["code"]) == s))
    none = F.lit(None).cast("string")
    entry = lambda w: F.struct(w["code"].alias("code"), severity(w["code"]).alias("severity"), w["message"].alias("message"), w["location"].alias("location"))
    return F.to_json(
        F.struct(
            (none if source_file is None else source_file).alias("sourceFile"),
            (none if source_type is None else source_type).alias("sourceType"),
            score.alias("overallScore"),
            quality_level.alias("overallLevel"),
            recommended.alias("importRecommendation"),
            official.alias("govDocument"),
            confidence.alias("govConfidence"),
            F.size(warnings).alias("totalWarnings"),
            *[count(s).alias(f"{s}SeverityCount") for s in ("high", "medium", "low")],
            F.transform(warnings, entry).alias("warnings"),
            checked_at.alias("checkedAt"),
        )
    )


def meta_json(fields: dict[str, Column], counts: dict[str, Column]) -> Column:
    """Metadata as JSON: nulls are left out, and of ``counts`` the zeros."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in (fields | {k: F.when(v > 0, v) for k, v in counts.items()}).items()]))
