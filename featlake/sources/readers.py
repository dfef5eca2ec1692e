"""Sources of features: files, SQL, relational tables and rows given inline."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from featlake.functions.wkb import decode_wkb, from_wkb, to_wkb, wkb_bounds
from featlake.operators import crs as C
from featlake.operators import geometry as G
from featlake.operators.projections import with_file_row_id
from featlake.operators.skew import row_hash
from featlake.sources.documents import split_features
from featlake.sources.extension import TileFolder
from featlake.table import FeatureTable

# Names of CSV separators.
SEPARATORS = {"COMMA": ",", "SEMICOLON": ";", "TAB": "\t", "SPACE": " ", "PIPE": "|"}
# Members of a GeoJSON feature, and further ones of a catalogue item.
_STANDARD = ("type", "id", "geometry", "properties", "bbox")
_STAC = ("stac_version", "stac_extensions", "collection", "assets", "links")


class SourceError(ValueError):
    """A source is configured in a way that cannot work."""


# --- Parquet --------------------------------------------------------------------------------


def read_parquet(
    spark: SparkSession, path: str | Sequence[str], wkb: str | None = None, base_path: str | None = None
) -> DataFrame:
    """Parquet files, globs and hive partitions; a binary geometry column is decoded in place."""
    reader = spark.read if base_path is None else spark.read.option("basePath", base_path)
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.parquet(*paths)
    return df if wkb is None else G.with_bounds(df.withColumn(wkb, from_wkb(F.col(wkb))), wkb)


def read_geoparquet(
    spark: SparkSession, path: str | Sequence[str], id: str, geometry: str = "geometry", bbox: str = "bbox",
    error: str = "geometry_error", base_path: str | None = None, **roles,
) -> FeatureTable:
    """Parquet files with binary geometries as a table whose box filters come before decoding.

    Where files carry a ``bbox`` struct, its fields are the bounds: a filter by box is pushed to the
    scan, prunes by footers, and only the blobs of the rows that are left are decoded. Covering boxes
    are often rounded outwards, so they only rule rows out. Without the struct, bounds are read from
    the blobs first, which is cheaper than making geometries. A blob that is no geometry gives a null
    geometry and a reason in the column ``error``. ``roles`` are further columns of the table.
    """
    reader = spark.read if base_path is None else spark.read.option("basePath", base_path)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    if id not in df.columns or geometry not in df.columns:
        raise SourceError(f"columns {id!r} and {geometry!r} are needed; available: {', '.join(df.columns)}")
    covering = bbox in df.columns and isinstance(df.schema[bbox].dataType, T.StructType)
    covering = covering and set(G.BOUNDS) <= set(df.schema[bbox].dataType.names)
    box = F.col(bbox) if covering else wkb_bounds(F.col(geometry))
    rest = [c for c in df.columns if c not in (geometry, error, *G.BOUNDS) and not (covering and c == bbox)]
    found = decode_wkb(F.col(geometry))
    rows = df.select(
        *rest, *[box[b].cast("double").alias(b) for b in G.BOUNDS], found["geometry"].alias(geometry), found["error"].alias(error)
    )
    return FeatureTable(rows, id=id, geom=geometry, loose_bounds=covering, **roles)


def write_geoparquet(df: DataFrame, path: str, geom: str = "geom", geometry: str = "geometry", bbox: str = "bbox", cell: float = 1.0) -> None:
    """Store features with binary geometries and a ``bbox`` struct, in the order of a curve of grid cells.

    The box is that of the geometry, so a reader prunes by it. Key-value metadata of Parquet footers,
    which names the columns to other readers, is beyond Spark's writer.
    """
    bounded = df if set(G.BOUNDS) <= set(df.columns) else G.with_bounds(df, geom)
    placed = _along_curve(bounded, cell)
    kept = [c for c in df.columns if c not in (geom, geometry, bbox, *G.BOUNDS)]
    placed.select(*kept, to_wkb(F.col(geom)).alias(geometry), F.struct(*G.BOUNDS).alias(bbox)).write.parquet(path)


def _along_curve(bounded: DataFrame, cell: float) -> DataFrame:
    placed = bounded.withColumns({"_cell": _curve_position(cell), "_spread": row_hash(bounded)})
    return placed.repartitionByRange("_cell", "_spread").sortWithinPartitions("_cell").drop("_cell", "_spread")


def write_feature_parquet(df: DataFrame, path: str, geom: str = "geom", cell: float = 1.0) -> None:
    """Store features with flat bounds, sorted by grid cell, so that footers prune box filters.

    Cells are numbered along a Z-shaped curve, which keeps neighbours in both directions close. The
    range partitioning is by cell and a hash of the row, so one crowded cell spans many files.
    """
    bounded = df if set(G.BOUNDS) <= set(df.columns) else G.with_bounds(df, geom)
    _along_curve(bounded, cell).write.parquet(path)


def _curve_position(cell: float) -> Column:
    """The bits of the column and row number of a feature's cell, interleaved."""

    def spaced(value: Column) -> Column:
        # Sixteen bits, each followed by a gap of one.
        bits = (F.floor(value / cell).cast("bigint") + 32768).bitwiseAND(0xFFFF)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(mask)
        return bits

    return spaced(F.col("xmin")).bitwiseOR(F.shiftleft(spaced(F.col("ymin")), 1))


def extract(
    source: DataFrame, box: tuple[float, float, float, float], target: str, bbox: str = "bbox"
) -> tuple[DataFrame, int]:
    """Write the rows whose box starts inside a window, and report their number.

    The filters are on nested fields, which Parquet prunes by its footers; the rows are counted
    while they are written.
    """
    from pyspark.sql import Observation

    xmin, ymin, xmax, ymax = box
    seen = Observation("extract")
    rows = source.where(
        F.col(f"{bbox}.xmin").between(xmin, xmax) & F.col(f"{bbox}.ymin").between(ymin, ymax)
    )
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(target)
    return source.sparkSession.read.schema(rows.schema).parquet(target), seen.get["rows"]


# --- CSV ------------------------------------------------------------------------------------


# Whole words that a pattern for a coordinate stands for.
_SPELLED_OUT = {"lon": ("lon", "long", "lng", "longitude"), "lat": ("lat", "latitude")}


def _matching(columns: Sequence[str], patterns: Sequence[str] | None) -> str | None:
    """The column that fits the first pattern that any fits: by its whole name before others."""
    for pattern in patterns or ():
        stem = pattern.lower().rstrip("*")
        for exact in _SPELLED_OUT.get(stem, (stem,)):
            for c in columns:
                if c.lower() == exact:
                    return c
        for c in columns:
            if fnmatch.fnmatchcase(c.lower(), pattern.lower()):
                return c
    return None


def _separator(spark: SparkSession, path: str, name: str) -> str:
    if name != "AUTO":
        return SEPARATORS[name]
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(SEPARATORS.values(), key=line.count) if line else ","


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    separator: str = "AUTO",
    autodetect_type: bool = True,
    x_names: Sequence[str] | None = ("lon*",),
    y_names: Sequence[str] | None = ("lat*",),
    z_names: Sequence[str] | None = None,
    geom_names: Sequence[str] | None = ("wkt*",),
    keep_source_columns: bool = False,
    keep_geom_columns: bool = False,
) -> DataFrame:
    """CSV with a header; geometry from a WKT column or from coordinate columns found by name.

    Give a schema for large data: detecting types reads the files once more.
    """
    reader = spark.read.option("header", True).option("sep", _separator(spark, path, separator))
    if schema is not None:
        reader = reader.schema(schema)
    elif autodetect_type:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    text = _matching(df.columns, geom_names)
    if text is not None:
        made = df.withColumn("geom", G.from_wkt(F.col(text)))
        return made if keep_geom_columns else made.drop(text)
    # Coordinates are numbers; where types are not known, any text may be one.
    typed = schema is not None or autodetect_type
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) or not typed]
    x, y, z = (_matching(numbers, names) for names in (x_names, y_names, z_names))
    if x is None or y is None:
        return df
    lon, lat, height = (F.col(c).try_cast("double") if c else None for c in (x, y, z))
    made = df.withColumn("geom", G.point(lon, lat, height))
    return made if keep_source_columns else made.drop(*[c for c in (x, y, z) if c])


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """JSON rows, one per line, or whole documents; give a schema for large data."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader if schema is None else reader.schema(schema)).json(path)


# --- GeoJSON --------------------------------------------------------------------------------


def read_geojson(
    spark: SparkSession,
    path: str,
    lines: bool = True,
    flatten: bool = True,
    separator: str = "__",
    foreign_members: str = "AUTO",
) -> DataFrame:
    """GeoJSON files to id, geometry and typed property columns.

    One feature per line splits over tasks, and so does a feature collection document, however
    large. Property types are found by a mergeable aggregate over all features.
    """
    if lines:
        features = spark.read.text(path).select(F.col("value").alias("feature"))
        features = features.where(F.length(F.trim("feature")) > 0)
    else:
        features = split_features(spark, path)
    return explode_features(features, "feature", flatten, separator, foreign_members)


def explode_features(
    features: DataFrame, text: str, flatten: bool = True, separator: str = "__", foreign_members: str = "AUTO"
) -> DataFrame:
    """Feature texts to id, geometry and property columns; a null geometry stays null."""
    document = F.try_parse_json(F.col(text))
    rows = features.select(
        F.get_json_object(text, "$.id").alias("id"),
        G.from_geojson(F.get_json_object(text, "$.geometry")).alias("geom"),
        F.get_json_object(text, "$.properties").alias("_properties"),
        F.col(text).alias("_feature"),
    )
    # One small row: the merged types of the properties and of the feature's own members.
    found = features.agg(
        F.schema_of_variant_agg(F.try_variant_get(document, "$.properties", "variant")).alias("properties"),
        F.schema_of_variant_agg(document).alias("feature"),
    ).head()
    properties, members = _struct_of(found["properties"]), _struct_of(found["feature"])
    rows = rows.withColumn("_p", F.from_json("_properties", properties))
    columns = [c for name in properties.names for c in _leaves(F.col("_p")[name], properties[name], name, flatten, separator)]
    foreign = _foreign_names(members, foreign_members)
    if foreign:
        kept = T.StructType([members[n] for n in foreign])
        rows = rows.withColumn("_f", F.from_json("_feature", kept))
        for name in foreign:
            columns += _leaves(F.col("_f")[name], members[name], name, flatten, separator)
    return rows.select("id", "geom", *columns)


_TYPE_WORD = re.compile(r"(^|: |ARRAY<)(OBJECT|VOID|VARIANT)(?:(?=(<))|(?=[,>]|$))")


def _struct_of(variant_type: str | None) -> T.StructType:
    """The text form of a merged variant type as a struct type."""
    text = variant_type or ""
    if not text.startswith("OBJECT<"):
        return T.StructType([])
    # Types follow a colon or open an array; names, also those in backquotes, stay as they are.
    parts = re.split(r"(`(?:[^`]|``)*`)", text)
    parts[::2] = [_TYPE_WORD.sub(lambda m: m[1] + ("STRUCT" if m[3] else "STRING"), p) for p in parts[::2]]
    return T._parse_datatype_string("".join(parts))


def _foreign_names(members: T.StructType, mode: str) -> list[str]:
    others = [n for n in members.names if n not in _STANDARD]
    if mode == "AUTO":
        mode = "STAC" if "stac_version" in others else "NONE"
    if mode == "ALL":
        return others
    return [n for n in others if n in _STAC] if mode == "STAC" else []


def _leaves(value: Column, field: T.StructField, name: str, flatten: bool, separator: str) -> list[Column]:
    kind = field.dataType
    if flatten and isinstance(kind, T.StructType):
        return [
            c for f in kind.fields for c in _leaves(value[f.name], f, f"{name}{separator}{f.name}", flatten, separator)
        ]
    return [value.alias(name)]


# --- rows given inline ----------------------------------------------------------------------


def inline_wkt(rows: DataFrame, wkt: str = "geometry") -> DataFrame:
    """Rows with a WKT column to features with geometry and bounds."""
    return G.with_bounds(rows.withColumn("geom", G.from_wkt(F.col(wkt))).drop(wkt))


def inline_geojson(documents: DataFrame, text: str, properties: str) -> DataFrame:
    """Documents ``{"features": [...], "crs": ...}`` to one row per feature.

    ``properties`` is the schema of the properties as DDL, known from the configuration.
    """
    shape = (
        "crs string, features array<struct<id:string, geometry:string, wkt:string,"
        f" properties:struct<{properties}>>>"
    )
    parsed = documents.withColumn("_d", F.from_json(text, shape))
    each = parsed.select(
        *[c for c in documents.columns if c != text],
        F.coalesce(F.col("_d.crs"), F.lit(C.CRS84)).alias("crs"),
        F.explode("_d.features").alias("_f"),
    )
    geom = F.coalesce(G.from_geojson(F.col("_f.geometry")), G.from_wkt(F.col("_f.wkt")))
    return each.withColumns({"id": F.col("_f.id"), "geom": geom}).select("*", "_f.properties.*").drop("_f")


# --- SQL and relational tables --------------------------------------------------------------


def read_sql(spark: SparkSession, source: str) -> DataFrame:
    """A statement (SELECT, WITH, VALUES) or the name of a table, view or file relation."""
    first = source.strip().split(None, 1)[0].upper() if source.strip() else ""
    if first in ("SELECT", "WITH", "VALUES"):
        return spark.sql(source)
    return spark.sql(f"SELECT * FROM {source}")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    id_column: str | None = None,
    key_columns: Sequence[str] = (),
    geometry: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """A relational table or view, read in parallel over ranges of its numeric id.

    The id column may be left out only when the table has a single key column. A geometry column
    must arrive as well-known binary (``ST_AsBinary`` in a view or subquery).
    """
    if id_column is None:
        if len(key_columns) != 1:
            raise SourceError("name an id column: the table does not have exactly one key column")
        id_column = key_columns[0]
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds is not None:
        reader = (
            reader.option("partitionColumn", id_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    df = reader.load()
    return df if geometry is None else G.with_bounds(df.withColumn(geometry, from_wkb(F.col(geometry))), geometry)


def attach(
    spark: SparkSession, url: str, tables: Sequence[str], alias: str, **options: str
) -> dict[str, DataFrame]:
    """Make tables of another database readable as temporary views named ``alias_table``."""
    views = {}
    for table in tables:
        df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
        views[table] = df
        df.createOrReplaceTempView(f"{alias}_{table.replace('.', '_')}")
    return views


# --- named source types ---------------------------------------------------------------------

_SOURCES: dict[str, Callable[..., DataFrame]] = {
    "parquet": read_parquet,
    "csv": read_csv,
    "json": read_json,
    "geojson": read_geojson,
    "sql": read_sql,
    "jdbc": read_jdbc,
}


def register_source(name: str, read: Callable[..., DataFrame] | type[DataSource]) -> None:
    """Make a source type available by name: a function of a session and options, or a Spark data source.

    A data source that is a :class:`featlake.sources.extension.FeatureSource` sees the box and time of
    requests before it reads.
    """
    if isinstance(read, type) and issubclass(read, DataSource):
        kind = read

        def read(spark: SparkSession, **options: str) -> DataFrame:
            spark.dataSource.register(kind)
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
            return spark.read.format(kind.name()).options(**options).load()

    _SOURCES[name] = read


register_source("tiles", TileFolder)


def open_table(spark: SparkSession, kind: str, options: dict, **roles) -> FeatureTable:
    """A feature table over a named source type; ``roles`` are those of :class:`FeatureTable`.

    Without an id column, file rows are identified by file and position.
    """
    if kind not in _SOURCES:
        raise SourceError(f"unknown source type {kind!r}; available: {', '.join(sorted(_SOURCES))}")
    df = _SOURCES[kind](spark, **options)
    if "id" not in roles:
        df, roles = with_file_row_id(df, "row_id", options.get("path")), {**roles, "id": "row_id"}
    return FeatureTable(df, **roles)
