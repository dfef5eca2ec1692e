"""Joins whose hot keys adaptive execution splits, also where it would leave them alone.

Adaptive execution measures the partitions of a shuffle and deals an oversized one out to several
tasks by its map outputs, whatever its rows hold, equal rows included. It does so for joins of two
plain shuffles. An aggregate or a join is partitioned by its keys already and takes part as it
lies, so a hot key on the other side stays in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(df: DataFrame, leave_out: Sequence[str] = ()) -> Column:
    """A stable hash of a row, the same when a lost task runs again."""
    plain = [
        f.name
        for f in df.schema.fields
        if f.name not in leave_out and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.xxhash64(*plain) if plain else F.lit(0)


def split_join(many: DataFrame, few: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that may have hot keys with a derived table of few rows per key.

    A hash of the keys is joined on as well. It is equal wherever the keys are, so the result is that
    of the plain join; but no earlier partitioning is one by keys and hash, so Spark shuffles both
    sides for this join, and adaptive execution splits the partitions of hot keys by their measured
    sizes. ``few`` is small, and nothing is copied but what meets a split partition.
    """
    own = F.xxhash64(*on).alias("_own")
    joined = many.select("*", own).join(few.select("*", own), [*on, "_own"], how)
    return joined.drop("_own")
