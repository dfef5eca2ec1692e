"""Listings stored with their positions, so that a page at any depth reads the slices it lies in.

The rows are range-partitioned by their order, whatever its types: Spark cuts at quantiles of a
sample of the keys. Each partition is a slice, written in order, and every row keeps its rank in its
slice. Beside the rows lies an index with one row per slice: its rows, the rows before it, and its
last key. A page is then a filter on slices, which are folders, and on stored ranks, which Parquet
footers prune by.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.operators.slices import rows_of

#: Rows of a slice, and slices of a small table.
ROWS, LEAST = 1_000_000, 8
_SLICE, _RANK = "_slice", "_rank"
# Row numbers inside a partition are the low 33 bits of Spark's increasing ids.
_OF_PARTITION = (1 << 33) - 1


def write_positions(df: DataFrame, order: Sequence[str], path: str, rows: int = ROWS) -> PositionIndex:
    """Store ``df`` in the order of some columns, nulls first, and the index of its slices.

    The number of slices follows the number of rows. Rows with equal keys share a slice and keep one
    order among themselves, the one that they are stored in.
    """
    slices = max(LEAST, math.ceil(rows_of(df) / rows))
    ranged = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    rank = F.monotonically_increasing_id().bitwiseAND(_OF_PARTITION)
    placed = ranged.withColumns({_SLICE: F.spark_partition_id(), _RANK: rank})
    placed.write.partitionBy(_SLICE).parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    last = F.max(F.struct(*order)).alias("last")
    found = stored.groupBy(_SLICE).agg(F.count("*").alias("n"), last)
    # One row per slice, so this window is over a bounded table.
    before = Window.partitionBy(F.lit(0)).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    index = found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    index.coalesce(1).write.parquet(f"{path}/index")
    # Tables without rows have no files that tell their columns.
    kinds = [(placed.schema.json(), index.schema.json())]
    df.sparkSession.createDataFrame(kinds, "rows string, index string").write.json(f"{path}/schema")
    return PositionIndex(df.sparkSession, path)


class PositionIndex:
    """A listing stored by :func:`write_positions`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        kinds = spark.read.schema("rows string, index string").json(f"{path}/schema").first()
        self.schema, of_index = (T.StructType.fromJson(json.loads(k)) for k in kinds)
        self.index = spark.read.schema(of_index).parquet(f"{path}/index")
        self.order = of_index["last"].dataType.names

    def _read(self, slices: Sequence[int] | None = None) -> DataFrame:
        """The stored rows, or only the folders of some slices."""
        base = f"{self.path}/rows"
        paths = [base] if slices is None else [f"{base}/{_SLICE}={s}" for s in slices]
        return self.spark.read.schema(self.schema).option("basePath", base).parquet(*paths)

    def _nothing(self) -> DataFrame:
        return self._read().where("false")

    def total(self) -> DataFrame:
        """The number of rows, read from the index alone."""
        return self.index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows at positions from ``offset`` on, with their ``position``, in order."""
        first, end = F.col("before"), F.col("before") + F.col("n")
        here = self.index.where((first < offset + limit) & (end > offset)).orderBy(_SLICE).collect()
        wanted = F.lit(False)
        for r in here:
            low, high = max(0, offset - r["before"]), offset + limit - r["before"] - 1
            wanted |= (F.col(_SLICE) == r[_SLICE]) & F.col(_RANK).between(low, high)
        rows = self._read([r[_SLICE] for r in here]).where(wanted) if here else self._nothing()
        shift = F.lit(0)
        for r in here:
            shift = F.when(F.col(_SLICE) == r[_SLICE], r["before"]).otherwise(shift)
        rows = rows.withColumn("position", (F.col(_RANK) + shift).cast("bigint"))
        return rows.drop(_SLICE, _RANK).orderBy("position").limit(limit)

    def after(self, last: Sequence, limit: int) -> DataFrame:
        """The page behind the row with these key values, in order, of as few slices as hold it."""
        behind = self._behind(last)
        # No slice is empty, so so many are enough.
        candidates = self.index.where(F.col("last") > F.struct(*self._key(last))).orderBy(_SLICE).limit(limit + 1).collect()
        chosen, held = [], 0
        for k, r in enumerate(candidates):
            chosen.append(r[_SLICE])
            held += r["n"] if k else 0
            if held >= limit:
                break
        rows = self._read(chosen).where(behind) if chosen else self._nothing()
        return rows.orderBy(_SLICE, _RANK).drop(_SLICE, _RANK).limit(limit)

    def _key(self, values: Sequence) -> list:
        fields = self.index.schema["last"].dataType.fields
        return [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, fields, strict=True)]

    def _behind(self, last: Sequence):
        own = F.struct(*[F.col(c) for c in self.order])
        return own > F.struct(*self._key(last))

    def numbered(self, size: int) -> DataFrame:
        """All rows with ``position`` (from 0) and ``page_number`` (from 1): no sort, the index is joined."""
        rows = self._read().join(self.index.select(_SLICE, "before"), _SLICE)
        position = (F.col(_RANK) + F.col("before")).cast("bigint")
        rows = rows.withColumn("position", position).drop(_SLICE, _RANK, "before")
        return rows.withColumn("page_number", (F.floor(F.col("position") / size) + 1).cast("bigint"))
