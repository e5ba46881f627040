"""Connected components of an edge table by alternating large and small stars, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.llm.common import scratch, settle


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, and their number and digests, taken as they were written."""
    seen = Observation()
    each = F.xxhash64("u", "v")
    held = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(each).alias("x"), F.sum(each.cast("decimal(38,0)")).alias("s")))
    return held, tuple(seen.get[k] for k in ("n", "x", "s"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's smallest node.

    Self-loops and repeated edges change nothing; an empty table gives an empty result.  Each round
    is written to the shared folder, so a lost executor costs at most one round.
    """
    with scratch(edges.sparkSession):
        now, state = _settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        while state[0]:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            before = state
            now, state = _settled(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
            if state == before:
                break
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return settle(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), outer=True)
