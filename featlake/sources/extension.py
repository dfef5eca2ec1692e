"""Sources of further kinds as Spark data sources that see a request's box and time.

A source says which tiles it has and what values their columns can take, and reads one tile at a
time. Spark pushes the comparisons of a request down to it; tiles that they rule out are not read,
and each of the others is a partition. Spark tests all rows once more, so a source may be as coarse
as it likes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

# Sources travel to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The least and the largest value of columns; None where there is no bound.
Ranges = dict[str, tuple[Any, Any]]


@dataclass
class Tile(InputPartition):
    """A part of a source that is read at once, and what its columns are known to hold."""

    name: str
    ranges: Ranges = field(default_factory=dict)

    def __post_init__(self):
        super().__init__(self.name)

    def may_hold(self, asked: Ranges) -> bool:
        """Whether some row of the tile may lie in the ranges asked for."""

        def apart(a, b) -> bool:
            return a is not None and b is not None and a > b

        return not any(
            apart(low, self.ranges[c][1]) or apart(self.ranges[c][0], high) for c, (low, high) in asked.items() if c in self.ranges
        )


def ranges_of(filters: list[Filter]) -> Ranges:
    """What comparisons with literals ask of columns, as closed ranges."""
    found: dict[str, list] = {}
    for f in filters:
        at_least = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual))
        at_most = isinstance(f, (EqualTo, LessThan, LessThanOrEqual))
        if not (at_least or at_most) or len(f.attribute) != 1:
            continue
        bounds = found.setdefault(f.attribute[0], [None, None])
        if at_least:
            bounds[0] = f.value if bounds[0] is None else max(bounds[0], f.value)
        if at_most:
            bounds[1] = f.value if bounds[1] is None else min(bounds[1], f.value)
    return {c: (low, high) for c, (low, high) in found.items()}


class FeatureSource(DataSource):
    """A kind of source: give it a ``name``, a ``schema``, ``tiles`` and ``read_tile``."""

    def tiles(self) -> list[Tile]:
        raise NotImplementedError

    def read_tile(self, tile: Tile, asked: Ranges) -> Iterator[pa.RecordBatch]:
        """The rows of a tile; those outside ``asked`` may be left out."""
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TileReader(self)


class _TileReader(DataSourceReader):
    def __init__(self, source: FeatureSource):
        self.source, self.asked = source, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.asked = ranges_of(filters)
        yield from filters  # Spark tests them again

    def partitions(self) -> list[Tile]:
        return [t for t in self.source.tiles() if t.may_hold(self.asked)]

    def read(self, partition: Tile) -> Iterator[pa.RecordBatch]:
        yield from self.source.read_tile(partition, self.asked)


class TileFolder(FeatureSource):
    """Parquet files in folders ``tile_x=…/tile_y=…`` of a regular grid of points.

    Options: ``path``, a folder that pyarrow can open from driver and executors; ``size``, the edge of
    a tile; ``x`` and ``y``, the coordinate columns. The columns are those of the first file.
    """

    @classmethod
    def name(cls) -> str:
        return "featlake_tiles"

    def _files(self) -> list[str]:
        from pyarrow import fs

        store, at = self._store()
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))

    def _store(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)

    def schema(self) -> T.StructType:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = self._files()
        if not files:
            raise ValueError(f"no tiles in {self.options['path']!r}")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=self._store()[0]))

    def tiles(self) -> list[Tile]:
        size, axes = float(self.options.get("size", "1")), {"tile_x": self.options.get("x", "x"), "tile_y": self.options.get("y", "y")}
        out = []
        for file in self._files():
            place = dict(p.split("=", 1) for p in file.split("/") if "=" in p)
            low = {axes[a]: float(v) * size for a, v in place.items() if a in axes and v.lstrip("-").isdigit()}
            out.append(Tile(file, {c: (v, v + size) for c, v in low.items()}))
        return out

    def read_tile(self, tile: Tile, asked: Ranges) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        yield from pq.ParquetFile(tile.name, filesystem=self._store()[0]).iter_batches()
