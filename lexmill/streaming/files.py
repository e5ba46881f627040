"""Documents as they arrive: the row-wise stages over a folder that is watched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.text import file_name
from lexmill.operators import govmeta, watermark


def markdown_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(path, file_name, md) of Markdown files as they are added."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.md").load(folder)
    path = F.input_file_name()
    return rows.select(path.alias("path"), file_name(path).alias("file_name"), F.col("value").alias("md"))


def cleaned_stream(stream: DataFrame, latest: int = 2100) -> DataFrame:
    """The stages that need one row only: marks go, metadata comes."""
    return govmeta.extract(watermark.clean(stream), "clean_md", latest=latest)


def write(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
