"""Scans in the order of long sequences, chunk by chunk, so that no sequence is one group.

A chunk is scanned by a window of its own; what it passes on (its last values, its sums) is one row, and the rows of a
sequence's chunks are scanned in turn.  A row's result is its chunk's, composed with what came before the chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(rows: DataFrame, keys: Sequence[str], chunk: str, order: str, last: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` with, for each name in ``last``, the last value before the row that isn't null and, for each in ``sums``, the sum before it.

    The order is that of ``chunk``, then ``order``, in each sequence named by ``keys``; it has no ties.  Rows are read twice.
    """
    last, sums = last or {}, sums or {}
    before = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each chunk
    ends = rows.groupBy(*keys, chunk).agg(
        *[F.max(F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v"))))["v"].alias(f"_{n}") for n, v in last.items()],
        *[F.sum(v).alias(f"_{n}") for n, v in sums.items()],
    )
    passed = ends.select(
        *keys, chunk,
        *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_{n}") for n in last],
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums],
    )
    inside = rows.withColumns(
        {n: F.last(v, ignorenulls=True).over(before) for n, v in last.items()} | {n: F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in sums.items()}
    )
    both = inside.join(passed, [*keys, chunk])
    return both.withColumns({n: F.coalesce(n, f"_{n}") for n in last} | {n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*[f"_{n}" for n in (*last, *sums)])
