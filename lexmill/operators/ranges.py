"""Joins of points with ranges, as equi-joins on bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(float(width)))


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], value: str, low: str, high: str, width: float) -> DataFrame:
    """``points`` joined with the ``ranges`` of the same keys that hold their value: low <= value <= high.

    A range stands in every bin of ``width`` that it touches and a point in its own, so only pairs of one bin are
    compared.  Besides the keys the two tables have no column in common; null values and bounds join nothing.
    """
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(_bin(F.col(low), width), _bin(F.col(high), width))))
    placed = points.withColumn("_bin", _bin(F.col(value), width))
    held = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    return placed.join(spread, [*keys, "_bin"]).where(held).drop("_bin")
