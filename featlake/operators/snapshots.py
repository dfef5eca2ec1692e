"""A large catalogue stored in buckets of its key, of which changes rewrite only those they touch.

A manifest names the folder that holds each bucket. Changes are applied to the buckets of their keys;
the new buckets are written beside the old ones, and then a new manifest takes the old one's place.
Files of other buckets stay as they are, a reader sees all changes of a log or none, and a job that
is lost leaves the last state in force.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.operators.catalog import apply_changes
from featlake.operators.slices import rows_of
from featlake.sources import generations

#: Records of a bucket, and buckets of a small table.
ROWS, LEAST = 1_000_000, 16
_BUCKET = "_bucket"


class Snapshot:
    """The newest state below ``path``, made by :func:`store`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.generation, manifest = generations.latest(spark, f"{path}/manifest")
        if manifest is None:
            raise ValueError(f"no snapshot at {path!r}")
        # One row per bucket.
        self.folders = {r["bucket"]: r["generation"] for r in manifest.where("bucket >= 0").collect()}
        about = manifest.where("bucket < 0").first()
        self.key, self.buckets = about["key"], about["buckets"]
        self.schema = T.StructType.fromJson(json.loads(about["schema"]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All records, or those of some buckets."""
        base = f"{self.path}/data"
        wanted = self.folders if buckets is None else {b: self.folders[b] for b in buckets if b in self.folders}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{base}/generation={g}/{_BUCKET}={b}" for b, g in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def apply(self, changes: DataFrame, defaults: dict[str, Column] | None = None) -> Snapshot:
        """The next state: :func:`apply_changes` on the buckets that a log of changes touches.

        The log has a column for each column of the records.
        """
        fields = [c for c in self.schema.names if c != self.key]
        touched = [r[0] for r in changes.select(self._bucket()).distinct().collect()]
        if not touched:
            return self
        new = apply_changes(self.read(touched), changes, fields, self.key, defaults)
        _write(self.spark, self.path, self.generation + 1, new.select(*self.schema.names), self, touched)
        return Snapshot(self.spark, self.path)


def store(df: DataFrame, key: str, path: str, rows: int = ROWS) -> Snapshot:
    """Store a table by its key, in as many buckets as its size asks for."""
    first = Snapshot.__new__(Snapshot)
    first.key, first.folders, first.schema = key, {}, df.schema
    first.buckets = max(LEAST, math.ceil(rows_of(df) / rows))
    _write(df.sparkSession, path, 1, df, first, [])
    return Snapshot(df.sparkSession, path)


def _write(spark: SparkSession, path: str, number: int, records: DataFrame, old: Snapshot, touched: Sequence[int]) -> None:
    """Write records as buckets, then the manifest that names them in place of the touched ones."""
    target = f"{path}/data/generation={number}"
    placed = records.withColumn(_BUCKET, old._bucket())
    placed.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(target)
    written = spark.read.schema(placed.schema).parquet(target).select(_BUCKET).distinct()
    kept = {b: g for b, g in old.folders.items() if b not in set(touched)}
    kept |= {r[0]: number for r in written.collect()}
    rows = [(b, g, None, None, None) for b, g in kept.items()] + [(-1, number, old.key, old.buckets, old.schema.json())]
    manifest = spark.createDataFrame(rows, "bucket int, generation int, key string, buckets int, schema string")
    generations.add(manifest, f"{path}/manifest", number)
