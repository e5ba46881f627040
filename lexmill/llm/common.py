"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.staging import scratch, settle, shared_dir  # noqa: F401  operators take them from here

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Plans in which a row of a file is one row at most.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _reads_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a Parquet file, so that the file numbers it."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROWWISE and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in df.columns and " parquet" in plan.toString().split("\n")[0]


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as the struct ``name``, with ``rid``: what names a row in every plan that reads the result.

    Rows of Parquet files are named by file (64 bits of hash) and place in it; others are written once, numbered.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)
    if _reads_files(docs):
        return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("rid"), whole)
    return settle(docs.select(F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")).alias("rid"), whole))


#: Row names that are broadcast at most (some 60 MB in memory); more are joined by a shuffle.
FEW_ROWS = 1_000_000


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose ``rid`` isn't in ``gone``, a written table; ``gone`` is broadcast if counted to be small."""
    return rows.join(F.broadcast(gone) if gone.count() <= FEW_ROWS else gone, "rid", "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(column: str = "doc_id", modulus: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a document; a null id counts as the empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")
