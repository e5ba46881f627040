"""Files to packages as they arrive: new paths by state, each batch a named run that isn't written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.config import Limits
from lexmill.plans import conversion


def new_paths(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(path) of files as they are added, each path once whatever its case; contents aren't read here."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.lower("path").alias("low")).dropDuplicates(["low"]).select("path")


def package_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, limits: Limits | None = None, name: str = "arrivals", files_at_once: int = 1000, once: bool = False) -> StreamingQuery:
    """Convert the files of ``folder`` as they come into packages under ``out``.

    A batch's paths, ``files_at_once`` at most, are read as one table of files and written as the run ``name-<batch>``: a batch that is
    repeated after a restart finds its run and writes nothing, or takes it up where it broke off.
    """

    def batch(paths: DataFrame, number: int) -> None:
        held = [r["path"] for r in paths.collect()]  # files_at_once at most
        if held:
            files = spark.read.format("binaryFile").load(held).select("path", "content")
            conversion.run(files, out, limits, root=None, name=f"{name}-{number}")

    writer = new_paths(spark, folder, files_at_once).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
