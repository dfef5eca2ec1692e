"""Descriptions of collections without a scan: what is known of each file, kept beside the table.

A map has one row for each file and collection in it: the number of features, their box, their times
and their geometry type. All of these merge, so the description of any collection is an aggregate of
the map. A refresh reads the files that are new or have changed, and forgets those that are gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.functions.text import iso_text
from featlake.operators import describe as D
from featlake.operators import geometry as G
from featlake.sources import generations

_MIXED = "several"


class ZoneMap:
    """The map at ``path`` of the Parquet table at ``table``.

    ``by`` names a collection, ``box`` its features' bounds, ``time`` their time, ``time_end`` its end
    if that is another column, ``type_name`` the type of their geometry, null without one.
    """

    def __init__(
        self, spark: SparkSession, table: str, path: str, by: Column, box: dict[str, Column], time: Column, type_name: Column,
        time_end: Column | None = None,
    ):
        self.spark, self.table, self.path = spark, table, path
        self.by, self.box, self.type_name = by, box, type_name
        self.time, self.time_end = time, time if time_end is None else time_end

    def _files(self) -> DataFrame:
        """Name, place, time of change and size of each file, from listings alone."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        return reader.load(self.table).select(
            F.col("_metadata.file_path").alias("path"), F.col("path").alias("location"), F.col("modificationTime").alias("changed"),
            F.col("length").alias("bytes"),
        )

    def _zones(self, files: list[str]) -> DataFrame:
        """The rows of the map for some files: one aggregate that is reduced before its shuffle."""
        rows = self.spark.read.option("basePath", self.table).parquet(*files)
        upper = F.upper(self.type_name)
        only = F.when(F.min(upper) == F.max(upper), F.min(upper)).when(F.count(upper) > 0, _MIXED)
        return rows.groupBy(F.col("_metadata.file_path").alias("path"), self.by.alias("collection")).agg(
            F.count("*").alias("n_features"), *D.extent(self.box), F.min(self.time).alias("first"), F.max(self.time_end).alias("last"),
            only.alias("type_name"),
        )

    def refresh(self) -> int:
        """Bring the map up to date; the number of files that were read for it."""
        number, known = generations.latest(self.spark, self.path)
        files = self._files()
        identity = ["path", "changed", "bytes"]
        new = files if known is None else files.join(known.select(*identity).distinct(), identity, "left_anti")
        paths = [r["location"] for r in new.select("location").collect()]
        gone = known is not None and known.select("path").distinct().join(files.select("path"), "path", "left_anti").count() > 0
        if not paths and not gone:
            return 0
        kept = None if known is None else known.join(files, identity, "left_semi")
        if paths:
            read = self._zones(paths).join(new.drop("location"), "path")
            kept = read if kept is None else kept.unionByName(read)
        generations.add(kept, self.path, number + 1)
        return len(paths)

    def zones(self) -> DataFrame:
        known = generations.latest(self.spark, self.path)[1]
        if known is None:
            raise ValueError(f"no map at {self.path!r}; refresh it first")
        return known

    def total(self) -> DataFrame:
        return self.zones().agg(F.coalesce(F.sum("n_features"), F.lit(0)).alias("total"))

    def describe(self) -> DataFrame:
        """Number, extents and geometry type of each collection, as :func:`featlake.operators.describe.describe` finds them."""
        box = {b: F.col(b) for b in G.BOUNDS}
        return self.zones().groupBy("collection").agg(
            F.sum("n_features").alias("n_features"), *D.extent(box),
            iso_text(F.min("first")).alias("temporal_begin"), iso_text(F.max("last")).alias("temporal_end"),
            G.schema_format(F.coalesce(D.single_type(F.col("type_name")), F.lit("GEOMETRY"))).alias("geometry_format"),
        )

    def overlapping(self, box: tuple[float, float, float, float]) -> list[str]:
        """The files that may hold features in a box: all others need not be opened."""
        asked = G.box_columns(*box)
        near = self.zones().where(G.bounds_overlap({b: F.col(b) for b in G.BOUNDS}, asked))
        return [r["path"] for r in near.select("path").distinct().orderBy("path").collect()]
