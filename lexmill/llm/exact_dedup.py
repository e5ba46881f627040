"""Exact dedup: static filters per immutable snapshot screen the digests of later batches.

A ``Snapshot`` is built once, stored and only read afterwards: its classes (one row for each text, with the
row that stays and its normalised text) and, by shards of at most about ``SHARD_KEYS`` distinct digests,
static 3-wise binary-fuse filters.  A batch's equal texts are grouped on their own first (one pre-aggregated
pass, so a hot group of copies is never gathered); its distinct digests are co-partitioned with the shards
and screened there.  What a filter lets through joins the snapshot's exact bucket (the whole digest), and the
two normalised texts are compared byte by byte; only then do the two groups become one.

``screen_batch`` holds a batch against stored snapshots.  ``exact_groups`` and ``drop_copies`` take one table:
half of it (by the id's crc32, or ``old``) is made the snapshot, the other half is the batch that meets it.

Texts are equal when identical after every ASCII blank is deleted.  Of a group the row with most code
points stays, then the one with the smallest doc_id.

Edge cases: null text counts as empty, so null, empty and blank texts are one group; a null doc_id
comes last among ties; of rows that agree in doc_id and length too the one whose text has the least XXH64 stays,
so only rows that are the same in all that are told apart by their place; an empty table or snapshot gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import BLANK, numbered, scratch, settle, whole_text, without

#: Keys for which one shard of a filter is meant; shards are dealt by digest, so they are even.
SHARD_KEYS = 400_000

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h ^= h >> _S33
        h *= _M1
        h ^= h >> _S33
        h *= _M2
        h ^= h >> _S33
    return h


class FuseFilter:
    """A static 3-wise binary-fuse filter of 8-bit fingerprints over 64-bit keys (false positives: 1 in 256)."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    def _slots(self, h: np.ndarray) -> np.ndarray:
        # high 32 bits choose the segment window, the low ones the place inside
        window = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        mask = np.uint64(self.segment - 1)
        start = (window * np.uint64(self.segment)).astype(np.int64)
        inside = [(h & mask), ((h >> np.uint64(11)) & mask), ((h >> np.uint64(18)) & mask)]
        return np.stack([start + k * self.segment + part.astype(np.int64) for k, part in enumerate(inside)])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = max(2, len(keys))
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n)))
        segments = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, 200):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._peel(keys):
                return made
        raise RuntimeError("no seed peels")

    def _peel(self, keys: np.ndarray) -> bool:
        """Fill the prints by rounds: all slots that hold a single key are taken at once."""
        h = _mixed(keys, self.seed)
        slots, size = self._slots(h), len(self.prints)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # the xor of the keys' numbers in each slot
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(len(keys)))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        front, left = np.flatnonzero(count == 1), len(keys)
        while len(front):
            taken, first = np.unique(held[front], return_index=True)
            rounds.append((taken, front[first]))
            left -= len(taken)
            gone = slots[:, taken]
            np.subtract.at(count, gone.ravel(), 1)
            for row in gone:
                np.bitwise_xor.at(held, row, taken)
            near = np.unique(gone)
            front = near[count[near] == 1]
        if left:
            return False
        prints = self._print(h)
        for taken, own in reversed(rounds):
            value = prints[taken].copy()
            for row in slots[:, taken]:
                value ^= np.where(row == own, np.uint8(0), self.prints[row])
            self.prints[own] = value
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(np.asarray(keys, dtype=np.uint64), self.seed)
        a, b, c = self._slots(h)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == self._print(h)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[:8]) for d in digests), dtype=">u8").astype(np.uint64)


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), BLANK, "")


def _shard(shards: int) -> Column:
    """By bytes of the digest that the filter's keys don't use."""
    return F.pmod(F.conv(F.hex(F.substring("sha", 9, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_filters(classes: DataFrame, shards: int) -> DataFrame:
    """(shards, shard, seed, segment, segments, prints): the filters of a snapshot's distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(_keys(pdf["sha"]))
        row = (shards, int(pdf["shard"].iloc[0]), f.seed, f.segment, f.segments, f.prints.tobytes())
        return pd.DataFrame([row], columns=["shards", "shard", "seed", "segment", "segments", "prints"])

    keyed = classes.select("sha", _shard(shards).alias("shard"))
    return keyed.groupBy("shard").applyInPandas(build, "shards int, shard int, seed int, segment int, segments int, prints binary")


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(sha): the digests that a snapshot's filters may hold."""

    def work(filters: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(batch), bool)
        for row in filters.itertuples(index=False) if len(batch) else ():
            hit |= FuseFilter(row.seed, row.segment, row.segments, np.frombuffer(row.prints, np.uint8)).holds(_keys(batch["sha"]))
        return batch.loc[hit, ["sha"]]

    keyed = digests.select("sha", _shard(shards).alias("shard"))
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(work, "sha binary")


def digests(rows: DataFrame) -> DataFrame:
    """(rid, doc_id, n_cp, mark, sha) of numbered rows (rid, dup_doc)."""
    return rows.select(
        "rid",
        F.col("dup_doc.doc_id").alias("doc_id"),
        F.length(whole_text("dup_doc.text")).alias("n_cp"),
        F.xxhash64(whole_text("dup_doc.text")).alias("mark"),
        F.unhex(F.sha2(normalised("dup_doc.text").cast("binary"), 256)).alias("sha"),
    )


def _best() -> Column:
    """Sorts the row that stays first."""
    return F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"), F.col("rid").alias("rid"))


def _classes(keys: DataFrame) -> DataFrame:
    """(sha, n, best): equal digests grouped on their own, pre-aggregated."""
    return keys.groupBy("sha").agg(F.count("*").alias("n"), F.min(_best()).alias("best"))


def _bodies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, body): the normalised texts of the wanted rows."""
    return rows.select("rid", "dup_doc.text").join(wanted, "rid", "left_semi").select("rid", normalised().cast("binary").alias("body"))


class Snapshot:
    """An immutable set of texts: its classes, its filters and the kept rows' texts.

    ``store`` writes them once under a path; later batches, in this session or another, only read them.
    """

    def __init__(self, classes: DataFrame, filters: DataFrame, bodies: Callable[[DataFrame], DataFrame]):
        """``classes``: (sha, n, best); ``filters``: of ``build_filters``; ``bodies``: from (rid) to (rid, body)."""
        self.classes, self.filters, self.bodies = classes, filters, bodies
        self.shards = filters.agg(F.max("shards")).first()[0] or 1

    @staticmethod
    def build(rows: DataFrame, keys: DataFrame) -> Snapshot:
        """Of a table's numbered rows and their digests; texts are read from the table, so it must not change."""
        classes = settle(_classes(keys))
        filters = settle(build_filters(classes, max(1, math.ceil(classes.count() / SHARD_KEYS))))
        return Snapshot(classes, filters, lambda wanted: _bodies(rows, wanted))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Snapshot:
        texts = spark.read.parquet(f"{path}/texts")
        return Snapshot(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/filters"), lambda wanted: texts.join(wanted, "rid", "left_semi"))

    @staticmethod
    def store(docs: DataFrame, path: str) -> Snapshot:
        """A snapshot of ``docs`` (doc_id, text) under a new path, with the texts."""
        with scratch(docs.sparkSession):
            rows = numbered(docs.select("doc_id", "text"), "dup_doc")
            made = Snapshot.build(rows, settle(digests(rows)))
            texts = made.bodies(made.classes.select(F.col("best.rid").alias("rid")))
            for name, df in (("classes", made.classes), ("filters", made.filters), ("texts", texts)):
                df.write.mode("error").parquet(f"{path}/{name}")
        return Snapshot.load(docs.sparkSession, path)

    def matches(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """(sha, old_n, old_best) of a batch's classes whose text the snapshot holds, byte by byte."""
        known = self.classes.select("sha", F.col("n").alias("old_n"), F.col("best").alias("old_best"))
        positive = screen(classes, self.filters, self.shards).join(known, "sha")
        positive = settle(positive.join(classes.select("sha", F.col("best.rid").alias("rid")), "sha"))
        own = _bodies(rows, positive.select("rid"))
        old = self.bodies(positive.select(F.col("old_best.rid").alias("rid"))).select(F.col("rid").alias("old_rid"), F.col("body").alias("old_body"))
        both = positive.join(own, "rid").join(old, F.col("old_best.rid") == F.col("old_rid"))
        return both.where("body = old_body").select("sha", "old_n", "old_best")


def screen_batch(docs: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """One row per row of a new batch: doc_id, snapshot, known_id, group_size, first.

    ``snapshot`` is the number of the first snapshot that holds the text and ``known_id`` the doc_id of its row there
    (both null for a new text); ``group_size`` and ``first`` (true for the row that stays) are of the batch alone.
    """
    with scratch(docs.sparkSession):
        rows = numbered(docs, "dup_doc")
        keys = settle(digests(rows), outer=True)
        classes = settle(_classes(keys))
        none = classes.select("sha", F.lit(0).alias("snapshot"), F.col("best.id").alias("known_id")).where(F.lit(False))
        met = [s.matches(rows, classes).select("sha", F.lit(k).alias("snapshot"), F.col("old_best.id").alias("known_id")) for k, s in enumerate(snapshots)]
        known = reduce(DataFrame.union, met, none).groupBy("sha").agg(F.min(F.struct("snapshot", "known_id")).alias("known"))
        groups = settle(classes.join(known, "sha", "left").select("sha", "n", F.col("best.rid").alias("keep_rid"), "known.*"), outer=True)
    return keys.join(groups, "sha").select("doc_id", "snapshot", "known_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("first"))


def in_snapshot() -> Column:
    """The half of a table that stands for its first immutable snapshot; the other half is the batch that meets it."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0


def group_rows(rows: DataFrame, keys: DataFrame, old: Column | None = None) -> DataFrame:
    """(sha, in_batch, keep_id, keep_rid, group_size) of the groups over snapshot and batch."""
    held = F.coalesce(in_snapshot() if old is None else old, F.lit(False))
    keys = keys.withColumn("old", held)
    snapshot = Snapshot.build(rows, keys.where("old"))
    batch = settle(_classes(keys.where("not old")))
    met = batch.join(snapshot.matches(rows, batch), "sha", "left")
    met = settle(met.select("sha", "n", "best", "old_n", "old_best"))
    joined = met.select("sha", F.least("best", "old_best").alias("best"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("size"), F.col("old_n").isNotNull().alias("both"))
    alone = snapshot.classes.select("sha", "best", "n").join(met.where("old_n is not null").select("sha"), "sha", "left_anti")
    whole = joined.select("sha", F.lit(True).alias("in_batch"), "both", "best", "size").union(alone.select("sha", F.lit(False), F.lit(False), "best", "n"))
    return whole.select("sha", "in_batch", "both", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("size").alias("group_size"))


def _grouped(docs: DataFrame, old: Column | None) -> tuple[DataFrame, DataFrame]:
    """The numbered rows, and (rid, doc_id, sha, keep_id, keep_rid, group_size) of each (a written table)."""
    rows = numbered(docs, "dup_doc")
    with scratch(docs.sparkSession):
        keys = settle(digests(rows))
        held = F.coalesce(in_snapshot() if old is None else old, F.lit(False))
        groups = settle(group_rows(rows, keys, old))
        # a digest is the same text in snapshot and batch, unless the bytes differed: then each side has a group of its own
        keyed = keys.withColumn("in_batch", ~held)
        sides = groups.where("both").withColumn("in_batch", F.lit(False)).unionByName(groups)
        found = settle(keyed.join(sides, ["sha", "in_batch"]).select("rid", "doc_id", "sha", "keep_id", "keep_rid", "group_size"), outer=True)
    return rows, found


def exact_groups(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    _, found = _grouped(docs.select("doc_id", "text"), old)
    return found.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    rows, found = _grouped(docs, old)
    return without(rows, found.where("rid <> keep_rid").select("rid")).select("dup_doc.*")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id NULLS LAST) AS keep_id FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
