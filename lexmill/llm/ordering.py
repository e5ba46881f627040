"""Places and running sums in a total order, by per-partition totals: no key and no table is gathered in one task.

A table is range-sorted; each partition sums what it holds, the totals' prefix sums (a row for each partition)
are the partitions' starts, and a row's place is its partition's start plus its place in the partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import settle


def in_order(rows: DataFrame, order: Sequence[str], sums: Sequence[str] = (), prev: Sequence[str] = ()) -> DataFrame:
    """``rows`` sorted by the columns ``order`` (nulls first), with ``at``, the place from 0; a written table.

    For each column c of ``sums`` comes ``c_before``, its sum over the rows before, and with ``prev`` the struct
    ``prev`` of these columns in the row before (null in the first row).  Rows that agree in ``order`` stand in
    any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number holds the partition's in the high bits and the row's in the low ones: it follows the sort
    held = settle(ranked.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    last = F.max_by(F.struct(*prev), "_m") if prev else F.lit(None)
    totals = held.groupBy(part).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums], last.alias("_last"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = totals.select("_part", start("_n").alias("_start"), *[start(f"_{c}").alias(f"_{c}_start") for c in sums], F.last("_last").over(earlier).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_m")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in sums]
    local += [F.lag(F.struct(*prev)).over(inside).alias("prev")] if prev else []
    seen = held.withColumn("_part", part).select("*", (F.row_number().over(inside) - 1).alias("at"), *local)
    seen = seen.join(F.broadcast(starts), "_part").withColumn("at", F.col("at") + F.col("_start"))
    seen = seen.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}_start") for c in sums} | ({"prev": F.coalesce("prev", "_before")} if prev else {}))
    return settle(seen.select(*rows.columns, "at", *[f"{c}_before" for c in sums], *["prev"] * bool(prev)))


def in_groups(rows: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``place`` from 0 in their group, ``many``, its rows, and ``c_before`` summed in the group; a written table.

    Groups are runs of the whole order, so a group of any size is spread over partitions.  Keys aren't null.
    """
    seen = in_order(rows, [key, *order], sums)
    firsts = seen.groupBy(key).agg(F.min("at").alias("_first"), F.count("*").alias("many"), *[F.min(f"{c}_before").alias(f"_{c}") for c in sums])
    less: dict[str, Column] = {f"{c}_before": F.col(f"{c}_before") - F.col(f"_{c}") for c in sums}
    placed = seen.join(firsts, key).withColumns(less | {"place": F.col("at") - F.col("_first")})
    return settle(placed.select(*rows.columns, "place", "many", *less))
