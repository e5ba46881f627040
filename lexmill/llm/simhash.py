"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints: 64 bits over word shingles; a bit is 1 if more than half of the shingles' XXH64 (seed
42) have it.  Equal fingerprints are one node.  The distinct ones are sorted by Gray rank (ranges
over all executors) and cut into leaves of ``FAN``; ``FAN`` neighbours make a node of the next
level, and so on.  A node keeps the AND and the OR of what stands below: where they agree, the bit
is shared by all (the masked pattern).  The index is joined with itself from the root down: of two
nodes, the bits that both share and that differ are already so many differences for every pair
below, so a pair of nodes over the limit is dropped whole.  All that survives reaches leaf pairs
and is compared bit by bit: the search is exact.

Links are reduced to a spanning forest in each Arrow batch, so a dense group yields about as many
rows as it has members and batches, never all its pairs; components come from those edges.

Edge cases: null text counts as empty; texts without a word have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; an empty table gives an empty result; a null
doc_id never is a component's id unless the component has none else; very long texts are hashed in
pieces of ``PIECE`` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import scratch, settle, whole_text
from lexmill.llm.components import connected_components

FAN = 64
PIECE = 1 << 15
#: Pairs of leaves or nodes that numpy compares at once.
BLOCK = 256


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """The XXH64 (seed 42) of a UTF-8 text's shingles, repeats included, piece by piece; none for a text without a word."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if found and len(found) <= words:
        yield np.array([xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    for at in range(0, len(found) - words + 1 if len(found) > words else 0, PIECE):
        part = found[at : at + PIECE + words - 1]
        yield np.array([xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(words)), strict=False)], np.uint64)


class Bits:
    """How many hashes have each bit, and the fingerprint of those that have it in over half."""

    def __init__(self):
        self.total, self.counts = 0, np.zeros(64, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.total += len(hashes)
        self.counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    def fingerprint(self) -> int:
        return int(np.packbits(self.counts * 2 > self.total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number."""
    bits = Bits()
    for hashes in shingle_hashes(text, words):
        bits.add(hashes)
    return bits.fingerprint()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(work, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, as a signed long that sorts like it."""
    rank = fp
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of ``FAN`` neighbours in Gray order, numbered inside the partition."""
    part, at, held = TaskContext.get().partitionId(), 0, np.empty(0, np.int64)

    def rows(groups: list[np.ndarray], first: int) -> pa.RecordBatch:
        n = len(groups)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(groups, pa.list_(pa.int64()))],
            ["part", "seq", "members"],
        )

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False)])
        full = len(held) // FAN
        if full:
            yield rows(list(held[: full * FAN].reshape(full, FAN)), at)
            at, held = at + full, held[full * FAN :]
    if len(held):
        yield rows([held], at)


class GrayIndex:
    """The levels of the index: level k has (node, members); a member is (id, all, any), in leaves the fingerprint itself."""

    def __init__(self, prints: DataFrame, fp: str = "fp"):
        """``prints``: distinct fingerprints."""
        ranked = prints.select(F.col(fp).alias("fp"), gray_rank(F.col(fp)).alias("rank"))
        n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranked = ranked.repartitionByRange(n, "rank").sortWithinPartitions("rank").select("fp")
        cut = settle(ranked.mapInArrow(_leaves, "part bigint, seq bigint, members array<bigint>"))
        counts = sorted((r["part"], r["count"]) for r in cut.groupBy("part").count().collect())  # a row for each partition
        starts, total = [], 0
        for part, count in counts:
            starts.append((part, total))
            total += count
        starts = prints.sparkSession.createDataFrame(starts, "part bigint, start bigint")
        leaf = cut.join(F.broadcast(starts), "part").select((F.col("start") + F.col("seq")).alias("node"), "members")  # as many rows as partitions
        self.levels, size = [settle(leaf)], total
        while size > 1:
            every, some = ("members", "members") if len(self.levels) == 1 else ("members.all", "members.any")
            below = self.levels[-1].select(
                "node",
                F.aggregate(every, F.lit(-1).cast("bigint"), lambda a, x: a.bitwiseAND(x)).alias("all"),
                F.aggregate(some, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x)).alias("any"),
            )
            above = below.groupBy(F.shiftright("node", FAN.bit_length() - 1).alias("node")).agg(
                F.collect_list(F.struct(F.col("node").alias("id"), "all", "any")).alias("members")  # at most FAN
            )
            self.levels.append(settle(above))
            size = -(-size // FAN)
        self.size = total

    def links(self, distance: int) -> DataFrame:
        """(u, v): a spanning forest, batch by batch, of the pairs within ``distance`` bits."""
        spark = self.levels[0].sparkSession
        pairs = spark.createDataFrame([(0, 0)] if self.size else [], "a bigint, b bigint")
        for level in reversed(range(len(self.levels))):
            nodes = self.levels[level]
            sides = pairs.join(nodes.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(
                nodes.select(F.col("node").alias("b"), F.col("members").alias("y")), "b"
            )
            own = (F.col("a") == F.col("b")).alias("own")
            if not level:
                return sides.select("x", "y", own).mapInArrow(_compare(distance), "u bigint, v bigint")
            sides = sides.select(*[F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "xy" for k in ("id", "all", "any")], own)
            pairs = sides.mapInArrow(_expand(distance), "a bigint, b bigint").repartition("a", "b")
        raise AssertionError("an index has leaves")


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix of ``FAN`` columns, and which cells are filled."""
    sizes = np.diff(column.offsets.to_numpy())
    there = np.arange(FAN)[None, :] < sizes[:, None]
    out = np.zeros(there.shape, np.int64)
    out[there] = column.flatten().to_numpy(zero_copy_only=False)
    return out, there


def _close(batch: pa.RecordBatch, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of members that may be within the distance, block by block; of a pair with itself each once.

    ``batch``: ids, AND and OR of both sides' members and whether the sides are one; of leaves the members alone.
    """
    leaves = batch.num_columns == 3
    own = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        (xi, xt), (yi, yt) = (_padded(part.column(i)) for i in ((0, 1) if leaves else (0, 3)))
        if leaves:
            apart = xi[:, :, None] ^ yi[:, None, :]
        else:
            x_all, x_any, y_all, y_any = (_padded(part.column(i))[0] for i in (1, 2, 4, 5))
            apart = (x_all[:, :, None] ^ y_all[:, None, :]) & ~(x_all ^ x_any)[:, :, None] & ~(y_all ^ y_any)[:, None, :]
        near = np.bitwise_count(apart.view(np.uint64)) <= distance
        near &= xt[:, :, None] & yt[:, None, :]
        i, j, k = np.nonzero(near)
        kept = ~own[at : at + BLOCK][i] | (j <= k)
        i, j, k = i[kept], j[kept], k[kept]
        yield xi[i, j], yi[i, k]


def _expand(distance: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _close(batch, distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return work


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) that connect just what the edges (u, v) connect."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(distance: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in _close(batch, distance):
                apart = x != y
                u, v = forest(x[apart], y[apart])
                us.append(u)
                vs.append(v)
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return work


def group_prints(prints: DataFrame, id_col: str, distance: int) -> DataFrame:
    """(id, fp, component_id) of every row of ``prints`` (id, fp), a written table."""
    with scratch(prints.sparkSession):
        nodes = settle(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
        roots = connected_components(GrayIndex(nodes).links(distance))
        rooted = settle(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = settle(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), outer=True)
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row of ``docs``."""
    return group_prints(settle(fingerprints(docs, id_col, text_col, words)), id_col, distance)


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
