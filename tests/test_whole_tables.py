"""Queries without SQL take every row of their table."""

from lexmill.plans import queries

SF = "/root/testdata/sf0.001"


def ids(df, column="doc_id"):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_word_files_of_all_documents(spark):
    docs = ids(spark.read.parquet(f"{SF}/documents.parquet"))
    for name in ("docx_render", "docx_format_check", "docx_reformat", "format_targets"):
        assert ids(queries.QUERIES[name](spark, SF)) == docs, name


def test_runs_of_all_texts(spark):
    docs = ids(spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''"))
    assert ids(queries.QUERIES["inline_runs"](spark, SF)) >= docs


def test_reports_of_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = queries.QUERIES["quality_report_json"](spark, SF)
    assert ids(got, "user_id") == ids(events, "user_id")
    codes = got.selectExpr("sum(size(regexp_extract_all(report, '\"code\"', 0)))").first()[0]
    assert codes == events.count()
