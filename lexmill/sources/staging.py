"""Tables between two plans: written once in the folder that driver and executors share, deleted when their block ends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written in the open ``scratch`` blocks of this thread, the innermost block last.
_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the cluster's ``spark.checkpoint.dir``.

    Where the session names none, a session whose executors are the driver itself gets a temporary
    folder; on a cluster that is an error, as executors can't read each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="lexmill-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path``, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settle(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what stands above) and, unlike
    ``checkpoint()``, keeps column pruning and file statistics for the next plan.  The table goes when the
    innermost ``scratch`` block ends (``outer``: the one around it), at the latest when the driver does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    files, at = hadoop_path(spark, path)
    files.deleteOnExit(at)
    blocks = _blocks.get()
    if len(blocks) > outer:
        blocks[-1 - outer].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block at whose end the tables settled in it are deleted, but those settled for the block around it."""
    mine: list[str] = []
    opened = _blocks.set((*_blocks.get(), mine))
    try:
        yield
    finally:
        _blocks.reset(opened)
        for path in mine:
            files, at = hadoop_path(spark, path)
            files.delete(at, True)
