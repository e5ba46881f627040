"""Sharding, in DataFrame operations only: contiguous shards of nearly equal bytes by global prefix sums.

Documents are taken in the order of their ids.  Their sizes (UTF-8 bytes of the text, and 1 for its end) are
summed by partition, the partitions' totals are summed up, and so each document knows how many bytes stand
before it.  Shard k of n holds the documents whose middle byte lies in the k-th of n equal parts of all
bytes; a cut is off its target by half a document at most.  The law is ``bytes``.

Only ids, sizes and digests are sorted (some 40 bytes a row), never texts; rows with one id, null or not, are
spread over the sort's ranges by digest and place, so no id is a hot key.  ``write_shards`` moves each text once.

Edge cases: null text has no bytes, so size 1; null ids stand first; rows with one id follow each other by
size, then by the text's digest; repeated rows are told apart by their place in the table and may change
places with each other; a document larger than a part leaves shards empty; an empty table gives an empty result;
columns of ``docs`` may have any names, but in ``sharded`` those for shard and slot are named anew where they clash.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import numbered, scratch, settle, whole_text
from lexmill.llm.ordering import in_order

SHARDS = 16


def _cut(rows: DataFrame, shards: int) -> DataFrame:
    """(rid, doc_id, size, text_crc32, shard, slot) of numbered rows (rid, shard_doc); a written table."""
    text = whole_text("shard_doc.text")
    size = F.octet_length(text).cast("long") + 1
    narrow = rows.select("rid", F.col("shard_doc.doc_id").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"))
    with scratch(rows.sparkSession):
        seen = in_order(settle(narrow), ["doc_id", "size", "text_crc32", "mark", "rid"], ["size"])
        total = seen.agg(F.coalesce(F.sum("size"), F.lit(1)).cast("decimal(20,0)").alias("total"))
        shard = F.expr(f"cast((cast(2 * size_before + size as decimal(20,0)) * {shards}) div (2 * total) as int)")
        placed = seen.crossJoin(F.broadcast(total)).select("rid", "doc_id", "size", "text_crc32", "at", shard.alias("shard"))  # one row
        firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
        done = placed.join(F.broadcast(firsts), "shard")
        return settle(done.select("rid", "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")), outer=True)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    found = _cut(numbered(docs.select("doc_id", "text"), "shard_doc"), shards)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or with a number where ``docs`` has such a column."""
    names = {c.lower() for c in docs.columns}
    return next(c for c in (f"{name}_{k}" if k > 1 else name for k in count(1)) if c not in names)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with their columns, ``shard`` and ``slot`` (``shard_2`` and so on where ``docs`` has such a column)."""
    rows = numbered(docs, "shard_doc")
    found = _cut(rows, shards).select("rid", F.col("shard").alias("to_shard"), F.col("slot").alias("to_slot"))
    own = [F.col(f"shard_doc.`{c}`") for c in docs.columns]
    return rows.join(found, "rid").select(*own, F.col("to_shard").alias(_free(docs, "shard")), F.col("to_slot").alias(_free(docs, "slot")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int | None = None) -> None:
    """The shards as Parquet in folders under ``path``, rows in order; a shard may be of several files, cut by slot."""
    name, slot = _free(docs, "shard"), _free(docs, "slot")
    spread = sharded(docs, shards).repartitionByRange(files or shards, name, slot).sortWithinPartitions(name, slot)
    spread.drop(slot).write.partitionBy(name).mode("error").parquet(path)


#: The 256 remainders of CRC-32 are made from its polynomial; the sum is folded over the bytes of a text.
CRC_SQL = r"""crc_steps(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS remainders FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text expression's UTF-8 bytes, where ``crc_table`` is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, remainders[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


SQL = f"""
WITH RECURSIVE {CRC_SQL}, sizes AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table
), sums AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS place FROM sizes
), cut AS (
  SELECT *, CAST((2 * upto - size) * {SHARDS} // (2 * total) AS INT) AS shard FROM sums
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM cut
"""
