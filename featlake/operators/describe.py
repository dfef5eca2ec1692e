"""Descriptions of feature tables: counts, extents, geometry types, schema documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.functions.text import iso_text, json_text
from featlake.operators import crs as C
from featlake.operators import geometry as G

SCHEMA_DIALECT = "https://json-schema.org/draft/2020-12/schema"

# --- types ----------------------------------------------------------------------------------


def type_schema(data_type: T.DataType, metadata: dict | None = None) -> dict:
    """A Spark type as a JSON-Schema fragment."""
    metadata = metadata or {}
    if isinstance(data_type, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(data_type, T.IntegralType):
        return {"type": "integer"}
    # Of the decimals only the one that holds 128-bit integers is one.
    if isinstance(data_type, T.DecimalType) and (data_type.precision, data_type.scale) == (38, 0):
        return {"type": "integer"}
    if isinstance(data_type, T.NumericType):
        return {"type": "number"}
    if isinstance(data_type, (T.VarcharType, T.CharType)):
        return {"type": "string", "maxLength": data_type.length}
    if isinstance(data_type, T.StringType):
        return {"type": "string", **({"format": metadata["format"]} if "format" in metadata else {})}
    if isinstance(data_type, T.DateType):
        return {"type": "string", "format": "date"}
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    if isinstance(data_type, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return {"type": "string"}
    if isinstance(data_type, T.BinaryType):
        return {"type": "string", "contentEncoding": "base64"}
    if isinstance(data_type, T.ArrayType):
        return {"type": "array", "items": type_schema(data_type.elementType)}
    if isinstance(data_type, T.StructType):
        return {
            "type": "object",
            "properties": {f.name: type_schema(f.dataType, f.metadata) for f in data_type.fields},
        }
    if isinstance(data_type, T.MapType):
        return {"type": "object", "additionalProperties": type_schema(data_type.valueType)}
    return {}


# SQL type names, and beginnings of type names, by the JSON-Schema fragment they stand for.
_NAMES = {
    '{"type":"integer"}': (
        "TINYINT", "INT1", "SMALLINT", "INT2", "SHORT", "INTEGER", "INT4", "INT", "SIGNED", "BIGINT",
        "INT8", "LONG", "HUGEINT", "UHUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT",
    ),
    '{"type":"number"}': ("FLOAT", "FLOAT4", "REAL", "DOUBLE", "FLOAT8", "DOUBLE PRECISION"),
    '{"type":"string"}': ("VARCHAR", "TEXT", "STRING", "CHAR", "BPCHAR", "INTERVAL"),
    '{"type":"boolean"}': ("BOOLEAN", "BOOL", "LOGICAL"),
    '{"type":"string","format":"uuid"}': ("UUID",),
    '{"type":"string","format":"date"}': ("DATE",),
    '{"type":"string","contentEncoding":"base64"}': ("BLOB", "BYTEA", "BINARY", "VARBINARY"),
}
_BEGINNINGS = (
    ("STRUCT(", '{"type":"object"}'),
    ("MAP(", '{"type":"object"}'),
    ("DECIMAL", '{"type":"number"}'),
    ("NUMERIC", '{"type":"number"}'),
    ("VARCHAR(", '{"type":"string"}'),
    ("CHAR(", '{"type":"string"}'),
    ("TIMESTAMP", '{"type":"string","format":"date-time"}'),
    ("TIME", '{"type":"string","format":"time"}'),
)


def _plain_type(t: Column) -> Column:
    """The fragment of a type that wraps no other; of several beginnings the first in the list counts."""
    by_name = [F.when(t.isin(*names), fragment) for fragment, names in _NAMES.items()]
    by_beginning = [F.when(t.startswith(text), fragment) for text, fragment in _BEGINNINGS]
    return F.coalesce(*by_name, *by_beginning, F.lit("{}"))


def type_name_schema(type_name: Column) -> Column:
    """SQL type names in a column to JSON-Schema text; lists and maps nest to any depth."""

    def peel(state: Column, _: Column) -> Column:
        """Take one list or map wrapper off a type name."""
        t, head, tail = state["t"], state["head"], state["tail"]
        is_list = t.rlike(r"\[\d*\]$") | t.rlike(r"^LIST\(.*\)$")
        is_map = ~is_list & t.rlike(r"^MAP\([^,]*,.*\)$")
        inner = F.regexp_replace(t, r"^LIST\((.*)\)$|^MAP\([^,]*,(.*)\)$|\[\d*\]$", "$1$2")
        opening = F.when(is_list, '{"type":"array","items":').when(
            is_map, '{"type":"object","additionalProperties":'
        )
        wrapped = is_list | is_map
        return F.struct(
            F.when(wrapped, F.trim(inner)).otherwise(t).alias("t"),
            F.concat(head, F.coalesce(opening, F.lit(""))).alias("head"),
            F.concat(tail, F.when(wrapped, "}").otherwise("")).alias("tail"),
        )

    name = F.upper(F.trim(type_name))
    start = F.struct(name.alias("t"), F.lit("").alias("head"), F.lit("").alias("tail"))
    # Every wrapper has a bracket of its own, so there are no more steps than brackets.
    steps = F.sequence(F.lit(0), F.regexp_count(name, F.lit(r"[\[(]")))
    return F.aggregate(steps, start, peel, lambda s: F.concat(s["head"], _plain_type(s["t"]), s["tail"]))


# --- aggregates -----------------------------------------------------------------------------


def counts(df: DataFrame, predicate: Column | None) -> DataFrame:
    """Matched and total rows in one pass; the scan reads only the predicate's columns."""
    matched = F.count("*") if predicate is None else F.count_if(F.coalesce(predicate, F.lit(False)))
    return df.agg(matched.alias("matched"), F.count("*").alias("total"))


def extent(box: dict[str, Column]) -> list[Column]:
    """Envelope aggregate; null over no geometries."""
    return [
        F.min(box["xmin"]).alias("xmin"),
        F.min(box["ymin"]).alias("ymin"),
        F.max(box["xmax"]).alias("xmax"),
        F.max(box["ymax"]).alias("ymax"),
    ]


def extent_in_crs84(corners: DataFrame, srid: int) -> DataFrame:
    """One native envelope row to native and CRS84 boxes (exact where axes are separable)."""
    west, south = C.transform_xy(F.col("xmin"), F.col("ymin"), srid, 4326)
    east, north = C.transform_xy(F.col("xmax"), F.col("ymax"), srid, 4326)
    return corners.withColumns({"west": west, "south": south, "east": east, "north": north})


def temporal_extent(start: Column, end: Column | None = None) -> list[Column]:
    """Begin and end as ISO text; a side with no value at all is open (null)."""
    end = start if end is None else end
    return [
        iso_text(F.min(start)).alias("temporal_begin"),
        iso_text(F.max(end)).alias("temporal_end"),
    ]


def additional_extent(name: str, column: Column, unit: str | None = None) -> list[Column]:
    return [
        F.lit(name).alias("name"),
        F.min(column).alias("begin"),
        F.max(column).alias("end"),
        F.lit(unit).cast("string").alias("unit_name"),
    ]


def single_type(type_name: Column) -> Column:
    """The geometry type shared by all rows, null when there are several or none."""
    # Two mergeable extremes decide it; no distinct set is kept.
    low, high = F.min(F.upper(type_name)), F.max(F.upper(type_name))
    return F.when(low == high, low)


def describe(
    df: DataFrame, by: str, box: dict[str, Column], time: Column, type_name: Column
) -> DataFrame:
    """All metrics of many collections in one pass and one partial aggregation."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_features"),
        *extent(box),
        *temporal_extent(time),
        G.schema_format(F.coalesce(single_type(type_name), F.lit("GEOMETRY"))).alias("geometry_format"),
    )


# Names of inferred JSON types and the JSON-Schema fragments they stand for.
_INFERRED = {
    "BOOLEAN": '{"type":"boolean"}',
    "BIGINT": '{"type":"integer"}',
    "DOUBLE": '{"type":"number"}',
    "FLOAT": '{"type":"number"}',
    "DATE": '{"type":"string","format":"date"}',
    "TIMESTAMP": '{"type":"string","format":"date-time"}',
    "TIMESTAMP_NTZ": '{"type":"string","format":"date-time"}',
}


def infer_properties(df: DataFrame, bag: str, sequence: str) -> DataFrame:
    """Property types of a property bag: the first non-null value of each name decides.

    A bag is JSON text, which has no times, or a variant, whose values may be dates and times.
    """
    spark = df.sparkSession
    typed = isinstance(df.schema[bag].dataType, T.VariantType)
    whole = f"b.`{bag}`" if typed else f"try_parse_json(b.`{bag}`)"
    entries = spark.sql(
        f"SELECT b.`{sequence}` AS seq, e.key AS property, schema_of_variant(e.value) AS kind"
        f" FROM {{bags}} b, LATERAL variant_explode({whole}) e",
        bags=df,
    )
    fragment = F.when(F.col("kind").startswith("DECIMAL"), '{"type":"number"}')
    for kind, text in _INFERRED.items():
        fragment = fragment.when(F.col("kind") == kind, text)
    return (
        entries.where(F.col("kind") != "VOID")
        .groupBy("property")
        .agg(F.min_by("kind", "seq").alias("kind"))
        .select("property", fragment.otherwise('{"type":"string"}').alias("schema"))
    )


# --- documents ------------------------------------------------------------------------------


def schema_document(
    title: Column, properties: Column, identifier: Column | None = None
) -> Column:
    """A schema document from an array of (property, json fragment) pairs in their order."""
    body = F.array_join(
        F.transform(properties, lambda p: F.concat(json_text(p["property"]), F.lit(":"), p["schema"])), ","
    )
    head = F.lit('{"$schema":"' + SCHEMA_DIALECT + '",')
    if identifier is not None:
        head = F.concat(head, F.lit('"$id":'), json_text(identifier), F.lit(","))
    return F.concat(
        head, F.lit('"type":"object","title":'), json_text(title), F.lit(',"properties":{'), body, F.lit("}}")
    )


def with_role(fragment: Column, role: str) -> Column:
    """Add the role marker to a non-empty fragment."""
    return F.concat(fragment.substr(F.lit(1), F.length(fragment) - 1), F.lit(f',"x-ogc-role":"{role}"}}'))


def geometry_fragment(type_name: Column, srid: Column) -> Column:
    """The schema fragment of the primary geometry; the CRS shows only when it is not CRS84."""
    fmt = G.schema_format(F.coalesce(type_name, F.lit("GEOMETRY")))
    srs = F.when(
        F.coalesce(srid, F.lit(4326)) != 4326, F.concat(F.lit(',"x-ogc-srs":"'), C.uri_column(srid), F.lit('"'))
    ).otherwise("")
    return F.concat(F.lit('{"format":"'), fmt, F.lit('","x-ogc-role":"primary-geometry"'), srs, F.lit("}"))
