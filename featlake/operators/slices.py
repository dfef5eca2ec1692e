"""Cutting a table into ranges of about equal size along an ordered column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a slice, and slices that a row is compared with at most: a stored index has no such bound.
ROWS, MOST = 500_000, 4096


def rows_of(df: DataFrame) -> int:
    """The number of rows, by a scan that reads no column."""
    return df.agg(F.count(F.lit(1))).first()[0]


def default_slices(df: DataFrame) -> int:
    """Slices in proportion to the rows of a table."""
    return min(MOST, math.ceil(rows_of(df) / ROWS)) or 1


def with_slice(df: DataFrame, key: Column, slices: int, name: str = "_slice") -> DataFrame:
    """Add the number of the slice a row lies in, by percentiles of a numeric key.

    The cuts are one small array, computed by a mergeable sketch and read as a scalar subquery. A
    row is compared with every ``stride``-th cut and then with the cuts up to the next of those,
    so the work per row grows with the root of the number of slices. Equal keys share a slice, and
    slices are ordered like the key.
    """
    if slices < 2:
        return df.withColumn(name, F.lit(0))
    stride = math.isqrt(slices - 1) + 1
    shares = [i / slices for i in range(1, slices)]
    found = F.percentile_approx(key, shares, F.lit(max(10000, 10 * slices)))
    cuts = df.agg(found.alias("cuts")).scalar()

    def below(array: Column) -> Column:
        return F.coalesce(F.size(F.filter(array, lambda c: c < key)), F.lit(0))

    coarse = F.filter("_cuts", lambda _, i: i % stride == stride - 1)
    placed = df.withColumn("_cuts", cuts).withColumn("_block", below(coarse))
    fine = F.slice("_cuts", F.col("_block") * stride + 1, F.lit(stride))
    return placed.withColumn(name, F.col("_block") * stride + below(fine)).drop("_cuts", "_block")
