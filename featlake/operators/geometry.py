"""Geometry as a plain struct, handled by column expressions only.

A geometry is ``struct(type, parts)``. Each part has a topological dimension
(0 point, 1 line, 2 polygon) and rings of vertices: a point is one ring with one vertex, a line is
one ring, a polygon is its shell followed by its holes. Every test below is exact on closed
geometries: touching counts as intersecting and an empty geometry never intersects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.functions.binding import let, pipe

VERTEX = T.StructType(
    [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType())]
)
PART = T.StructType(
    [T.StructField("dim", T.IntegerType()), T.StructField("rings", T.ArrayType(T.ArrayType(VERTEX)))]
)
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(PART))])

# Geometry type names and their JSON-Schema formats.
TYPE_FORMATS = {
    "POINT": "geometry-point",
    "MULTIPOINT": "geometry-multipoint",
    "LINESTRING": "geometry-linestring",
    "MULTILINESTRING": "geometry-multilinestring",
    "POLYGON": "geometry-polygon",
    "MULTIPOLYGON": "geometry-multipolygon",
    "GEOMETRYCOLLECTION": "geometry-geometrycollection",
    "GEOMETRY": "geometry-any",
}
_TYPE_NAMES = (
    "Point",
    "MultiPoint",
    "LineString",
    "MultiLineString",
    "Polygon",
    "MultiPolygon",
    "GeometryCollection",
)
BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("double")


# --- construction ---------------------------------------------------------------------------


def vertex(x, y, z=None) -> Column:
    return F.struct(
        _num(x).cast("double").alias("x"),
        _num(y).cast("double").alias("y"),
        (F.lit(None).cast("double") if z is None else _num(z).cast("double")).alias("z"),
    )


def part(dim: int, rings: Column) -> Column:
    return F.struct(F.lit(dim).alias("dim"), rings.alias("rings"))


def geometry(type_name, parts: Column) -> Column:
    name = type_name if isinstance(type_name, Column) else F.lit(type_name)
    return F.struct(name.alias("type"), parts.alias("parts"))


def point(x, y, z=None) -> Column:
    """A point, or null when a coordinate is null."""
    return F.when(
        _num(x).isNotNull() & _num(y).isNotNull(),
        geometry("Point", F.array(part(0, F.array(F.array(vertex(x, y, z)))))),
    )


def segment(x1, y1, x2, y2) -> Column:
    ring = F.array(vertex(x1, y1), vertex(x2, y2))
    return geometry("LineString", F.array(part(1, F.array(ring))))


def box(xmin, ymin, xmax, ymax) -> Column:
    ring = F.array(
        vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax), vertex(xmin, ymin)
    )
    return geometry("Polygon", F.array(part(2, F.array(ring))))


# --- text forms -----------------------------------------------------------------------------

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TUPLE = rf"({_NUMBER})\s+({_NUMBER})(?:\s+({_NUMBER}))?(?:\s+{_NUMBER})?"
# Possessive: a repeated choice that may be undone needs a deeper stack for each repetition.
_NESTED = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_MEMBER = rf"(?i)((?:MULTI)?(?:POINT|LINESTRING|POLYGON)\s*(?:ZM|Z|M)?\s*(?:{_NESTED}|EMPTY))"
_HEADER = r"(?s)^\s*(?:SRID=\d+;)?\s*([A-Za-z]+?)\s*(?:\b(Z|M|ZM)\b)?\s*(\(.*\)|EMPTY)\s*$"
_DEEP_TEXT = "array<array<array<array<string>>>>"


def _vertices(nested: Column, keep_z: Column | None = None) -> Column:
    """Text coordinates nested as parts > rings > tuples become parts > rings > vertices."""

    def to_vertex(c: Column) -> Column:
        # An absent third number is empty text; casting that would cost an exception per vertex.
        third = F.get(c, F.lit(2))
        z = F.when(third != "", third.try_cast("double"))
        return F.struct(
            F.get(c, F.lit(0)).try_cast("double").alias("x"),
            F.get(c, F.lit(1)).try_cast("double").alias("y"),
            (z if keep_z is None else F.when(keep_z, z)).alias("z"),
        )

    return F.transform(nested, lambda p: F.transform(p, lambda r: F.transform(r, to_vertex)))


def _parts_by_type(upper_type: Column, nested: Column) -> Column:
    """Turn parts > rings > vertices into typed parts, splitting multi points and multi lines."""
    no_rings = F.array().cast(T.ArrayType(T.ArrayType(VERTEX)))
    no_vertices = F.array().cast(T.ArrayType(VERTEX))

    def typed(kind: Column, parts: Column) -> Column:
        rings = F.coalesce(F.get(parts, F.lit(0)), no_rings)
        return (
            F.when(kind == "POINT", F.transform(parts, lambda p: part(0, p)))
            .when(kind == "LINESTRING", F.transform(parts, lambda p: part(1, p)))
            .when(
                kind == "MULTIPOINT",
                F.transform(
                    F.coalesce(F.get(rings, F.lit(0)), no_vertices), lambda v: part(0, F.array(F.array(v)))
                ),
            )
            .when(kind == "MULTILINESTRING", F.transform(rings, lambda r: part(1, F.array(r))))
            .when(kind.isin("POLYGON", "MULTIPOLYGON"), F.transform(parts, lambda p: part(2, p)))
        )

    return let(typed, upper_type, nested)


def _deepen(upper_type: Column, text: Column) -> Column:
    """Wrap JSON coordinates so that every type is nested as parts > rings > tuples."""
    return (
        F.when(upper_type.isin("LINESTRING", "MULTIPOINT"), F.concat(F.lit("[["), text, F.lit("]]")))
        .when(upper_type.isin("POLYGON", "MULTILINESTRING"), F.concat(F.lit("["), text, F.lit("]")))
        .when(upper_type == "MULTIPOLYGON", text)
    )


def _type_name(upper_type: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name in _TYPE_NAMES:
        chain = F.when(upper_type == name.upper(), name).otherwise(chain)
    return chain


def _wkt_match(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _HEADER, "$1\u0001$2\u0001$3"), "\u0001")


def _wkt_pieces(found: Column) -> tuple[Column, Column, Column]:
    """Upper-case type, Z/M tag and body of well-known text, from one match."""
    return F.upper(F.get(found, F.lit(0))), F.upper(F.get(found, F.lit(1))), F.get(found, F.lit(2))


def _wkt_parts(kind: Column, tag: Column, body: Column) -> Column:
    # MULTIPOINT allows both (1 2, 3 4) and ((1 2), (3 4)).
    flat = F.when(
        kind == "MULTIPOINT", F.concat(F.lit("("), F.regexp_replace(body, "[()]", ""), F.lit(")"))
    ).otherwise(body)
    tuples = F.translate(F.regexp_replace(flat, _TUPLE, '["$1","$2","$3"]'), "()", "[]")
    deep = let(_deepen, F.when(kind == "POINT", "LINESTRING").otherwise(kind), tuples)
    nested = F.when(F.upper(body) == "EMPTY", F.array().cast(_DEEP_TEXT)).otherwise(
        F.from_json(deep, _DEEP_TEXT)
    )
    return _parts_by_type(kind, _vertices(nested, tag != "M"))


def _finished(kind: Column, parts: Column) -> Column:
    """The geometry, or null if the text was malformed."""
    return F.when(parts.isNotNull() & _all_finite(parts), geometry(_type_name(kind), parts))


def from_wkt(text: Column) -> Column:
    """WKT (or EWKT) to a geometry; null for text that is not WKT."""

    def piece(kind: Column, tag: Column, body: Column) -> Column:
        return F.struct(kind.alias("kind"), tag.alias("tag"), body.alias("body"))

    def members(kind: Column, tag: Column, body: Column) -> tuple[Column, Column]:
        # The single geometries of a collection, and of the collections in it; or the one there is.
        texts = F.regexp_extract_all(body, F.lit(_MEMBER), F.lit(1))
        each = F.transform(texts, lambda m: piece(*pipe((_wkt_match(m),), _wkt_pieces)))
        return kind, F.when(kind == "GEOMETRYCOLLECTION", each).otherwise(F.array(piece(kind, tag, body)))

    def parse(kind: Column, pieces: Column) -> Column:
        parts = F.flatten(F.transform(pieces, lambda p: _wkt_parts(p["kind"], p["tag"], p["body"])))
        return let(_finished, kind, parts)

    return pipe((_wkt_match(text),), _wkt_pieces, members, parse)


def _geojson_parts(kind: Column, coordinates: Column) -> Column:
    deep = F.when(kind == "POINT", F.concat(F.lit("[[["), coordinates, F.lit("]]]"))).otherwise(
        _deepen(kind, coordinates)
    )
    # "coordinates": [] is an empty geometry.
    empty = F.regexp_replace(coordinates, r"\s", "") == "[]"
    nested = F.when(empty, F.array().cast(_DEEP_TEXT)).otherwise(F.from_json(deep, _DEEP_TEXT))
    return _parts_by_type(kind, _vertices(nested))


def from_geojson(text: Column) -> Column:
    """GeoJSON geometry text to a geometry; null for null, ``null`` and malformed text."""
    shape = "type string, coordinates string, geometries array<string>"
    collection = "GEOMETRYCOLLECTION"

    def opened(texts: Column, _: Column) -> Column:
        """Collections in an array of geometry texts replaced by what they hold."""

        def one(t: Column) -> Column:
            found = F.from_json(t, shape)
            inner = F.coalesce(found["geometries"], F.array().cast("array<string>"))
            return F.when(F.upper(found["type"]) == collection, inner).otherwise(F.array(t))

        return F.flatten(F.transform(texts, one))

    def parse(found: Column) -> Column:
        # A text has no more collections in each other than it names.
        steps = F.sequence(F.lit(0), F.regexp_count(text, F.lit("(?i)GeometryCollection")))
        single = F.when(
            F.upper(found["type"]) == collection, F.aggregate(steps, found["geometries"], opened)
        )
        each = F.transform(single, lambda t: F.from_json(t, shape))
        return let(members, F.upper(found["type"]), found["coordinates"], each)

    def members(kind: Column, coordinates: Column, geometries: Column) -> Column:
        parts = F.when(
            kind == "GEOMETRYCOLLECTION",
            F.flatten(
                F.transform(geometries, lambda m: let(_geojson_parts, F.upper(m["type"]), m["coordinates"]))
            ),
        ).otherwise(let(_geojson_parts, kind, coordinates))
        return let(_finished, kind, parts)

    return let(parse, F.from_json(text, shape))


def _all_finite(parts: Column) -> Column:
    """True unless some vertex lacks a coordinate (a sign of malformed text)."""
    return ~F.exists(
        parts,
        lambda p: F.coalesce(
            F.exists(p["rings"], lambda r: F.exists(r, lambda v: v["x"].isNull() | v["y"].isNull())),
            F.lit(True),
        ),
    )


def number_text(value: Column, digits: int | None) -> Column:
    """A number as text: fixed digits without trailing zeros, or the full double."""
    if digits is None:
        return F.regexp_replace(value.cast("string"), r"\.0$", "")
    fixed = value.cast(f"decimal(38,{digits})").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit(".")) if digits else fixed


def _ring_text(ring: Column, digits: int | None, joiner: str, opening: str, closing: str) -> Column:
    def one(v: Column) -> Column:
        return F.concat(
            F.lit(opening),
            F.concat_ws(
                joiner, number_text(v["x"], digits), number_text(v["y"], digits), number_text(v["z"], digits)
            ),
            F.lit(closing),
        )

    return F.array_join(F.transform(ring, one), "," if opening else ", ")


def to_wkt(geom: Column, digits: int | None = 6) -> Column:
    """Geometry to WKT, by default with six decimals and no trailing zeros."""
    return let(lambda g: _wkt_of(g, digits), geom)


def _wkt_of(geom: Column, digits: int | None) -> Column:

    def ring(r: Column) -> Column:
        return F.concat(F.lit("("), _ring_text(r, digits, " ", "", ""), F.lit(")"))

    def rings(p: Column) -> Column:
        return F.array_join(F.transform(p["rings"], ring), ", ")

    def poly(p: Column) -> Column:
        return F.concat(F.lit("("), rings(p), F.lit(")"))

    def tagged(p: Column) -> Column:
        return (
            F.when(p["dim"] == 0, F.concat(F.lit("POINT "), rings(p)))
            .when(p["dim"] == 1, F.concat(F.lit("LINESTRING "), rings(p)))
            .otherwise(F.concat(F.lit("POLYGON "), poly(p)))
        )

    def joined(fn: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(geom["parts"], fn), ", ")

    kind = F.upper(geom["type"])
    body = (
        F.when(F.size(geom["parts"]) == 0, F.lit("EMPTY"))
        .when(kind.isin("POINT", "LINESTRING"), joined(rings))
        .when(kind == "POLYGON", joined(poly))
        .when(kind.isin("MULTIPOINT", "MULTILINESTRING"), F.concat(F.lit("("), joined(rings), F.lit(")")))
        .when(kind == "MULTIPOLYGON", F.concat(F.lit("("), joined(poly), F.lit(")")))
        .otherwise(F.concat(F.lit("("), joined(tagged), F.lit(")")))
    )
    z = F.exists(vertices(geom), lambda v: v["z"].isNotNull())
    return F.concat(kind, F.when(z, " Z ").otherwise(" "), body)


def to_ewkt(geom: Column, srid, digits: int | None = 6) -> Column:
    return F.concat(F.lit("SRID="), _num(srid).cast("int").cast("string"), F.lit(";"), to_wkt(geom, digits))


def to_geojson(geom: Column, digits: int | None = None) -> Column:
    """Geometry to GeoJSON text; null geometry gives null."""
    return let(lambda g: _geojson_of(g, digits), geom)


def _geojson_of(geom: Column, digits: int | None) -> Column:

    def ring(r: Column) -> Column:
        return _ring_text(r, digits, ",", "[", "]")

    def rings(p: Column) -> Column:
        return F.array_join(F.transform(p["rings"], lambda r: F.concat(F.lit("["), ring(r), F.lit("]"))), ",")

    def bare(p: Column) -> Column:
        return F.array_join(F.transform(p["rings"], ring), ",")

    def boxed(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda p: F.concat(F.lit("["), fn(p), F.lit("]"))

    def joined(fn: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(geom["parts"], fn), ",")

    def document(name: Column, key: str, value: Column) -> Column:
        return F.concat(F.lit('{"type":"'), name, F.lit(f'","{key}":'), value, F.lit("}"))

    def member(p: Column) -> Column:
        name = F.when(p["dim"] == 0, "Point").when(p["dim"] == 1, "LineString").otherwise("Polygon")
        value = F.when(p["dim"] == 0, bare(p)).when(p["dim"] == 1, boxed(bare)(p)).otherwise(boxed(rings)(p))
        return document(name, "coordinates", value)

    kind = F.upper(geom["type"])

    def array_of(fn: Callable[[Column], Column]) -> Column:
        return F.concat(F.lit("["), joined(fn), F.lit("]"))

    value = (
        F.when(F.size(geom["parts"]) == 0, F.lit("[]"))
        .when(kind == "POINT", joined(bare))
        .when(kind.isin("LINESTRING", "MULTIPOINT"), array_of(bare))
        .when(kind == "POLYGON", joined(boxed(rings)))
        .when(kind == "MULTILINESTRING", array_of(boxed(bare)))
        .when(kind == "MULTIPOLYGON", array_of(boxed(rings)))
    )
    return F.when(
        kind == "GEOMETRYCOLLECTION", document(geom["type"], "geometries", array_of(member))
    ).otherwise(document(geom["type"], "coordinates", value))


# --- measures -------------------------------------------------------------------------------


def vertices(geom: Column) -> Column:
    return F.flatten(F.transform(geom["parts"], lambda p: F.flatten(p["rings"])))


def map_vertices(geom: Column, fn: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Rebuild a geometry with every (x, y) replaced; null if any new coordinate is null."""
    return let(lambda g: _mapped(g, fn), geom)


def _mapped(geom: Column, fn: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    def moved(v: Column) -> Column:
        x, y = fn(v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"), v["z"].alias("z"))

    parts = F.transform(
        geom["parts"],
        lambda p: F.struct(
            p["dim"].alias("dim"),
            F.transform(p["rings"], lambda r: F.transform(r, moved)).alias("rings"),
        ),
    )
    return let(lambda ps: F.when(_all_finite(ps), geometry(geom["type"], ps)), parts)


def bounds(geom: Column) -> dict[str, Column]:
    """The bounds of a geometry as four columns, null for a null or empty geometry."""
    vs = vertices(geom)
    xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
    return {
        "xmin": F.array_min(xs),
        "ymin": F.array_min(ys),
        "xmax": F.array_max(xs),
        "ymax": F.array_max(ys),
    }


def with_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add the flat bounds columns that let Parquet footers prune a stored feature table."""
    return df.withColumns(bounds(F.col(geom)))


def schema_format(type_name: Column) -> Column:
    """Geometry type name (any Z/M suffix ignored) to its JSON-Schema format."""
    upper = F.upper(F.split(F.trim(type_name), r"\s+")[0])
    chain = F.lit("geometry-any")
    for name, fmt in TYPE_FORMATS.items():
        chain = F.when(upper == name, fmt).otherwise(chain)
    return chain


# --- intersection tests ---------------------------------------------------------------------


def bounds_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed overlap of two boxes: four plain comparisons that a Parquet scan can use."""
    return (
        (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])
    )


def box_columns(xmin, ymin, xmax, ymax) -> dict[str, Column]:
    return dict(zip(BOUNDS, (_num(xmin), _num(ymin), _num(xmax), _num(ymax))))


def _any_edge(ring: Column, test: Callable[[Column, Column], Column]) -> Column:
    """True if any edge passes the test; a one-vertex ring is one edge of zero length."""
    last = F.size(ring) - 1
    return (last >= 0) & F.exists(
        F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
        lambda i: test(F.get(ring, i), F.get(ring, F.least(i + 1, last))),
    )


def _inside(part_: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings of a polygon part, so holes turn the answer around."""

    def crosses(p: Column, q: Column) -> Column:
        return ((p["y"] > y) != (q["y"] > y)) & (
            x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        )

    def odd(ring: Column) -> Column:
        last = F.size(ring) - 1
        steps = F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))
        return F.aggregate(
            steps,
            F.lit(False),
            lambda acc, i: acc
            != F.coalesce(crosses(F.get(ring, i), F.get(ring, F.least(i + 1, last))), F.lit(False)),
        )

    return (part_["dim"] == 2) & F.aggregate(part_["rings"], F.lit(False), lambda acc, r: acc != odd(r))


def _edge_meets_box(p: Column | dict[str, Column], q: Column | dict[str, Column], b: dict[str, Column]) -> Column:
    """Separating axes: the extents overlap and the box corners are not all on one side."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    sides = [
        dx * (cy - p["y"]) - dy * (cx - p["x"])
        for cx in (b["xmin"], b["xmax"])
        for cy in (b["ymin"], b["ymax"])
    ]
    return (
        (F.least(p["x"], q["x"]) <= b["xmax"])
        & (F.greatest(p["x"], q["x"]) >= b["xmin"])
        & (F.least(p["y"], q["y"]) <= b["ymax"])
        & (F.greatest(p["y"], q["y"]) >= b["ymin"])
        & (F.least(*sides) <= 0)
        & (F.greatest(*sides) >= 0)
    )


def intersects_box(geom: Column, xmin, ymin, xmax, ymax) -> Column:
    """Exact test of a geometry against a closed box given as literals or columns."""
    b = box_columns(xmin, ymin, xmax, ymax)
    return F.exists(
        geom["parts"],
        lambda p: F.exists(p["rings"], lambda r: _any_edge(r, lambda u, v: _edge_meets_box(u, v, b)))
        | _inside(p, b["xmin"], b["ymin"]),
    )


def meets_box(geom: Column, own: dict[str, Column], b: dict[str, Column]) -> Column:
    """Exact test for a geometry with known bounds: most rows are decided by comparisons alone."""
    inside = (
        (own["xmin"] >= b["xmin"])
        & (own["xmax"] <= b["xmax"])
        & (own["ymin"] >= b["ymin"])
        & (own["ymax"] <= b["ymax"])
    )
    exact = intersects_box(geom, *[b[n] for n in BOUNDS])
    return bounds_overlap(own, b) & (inside | (geom["type"] == "Point") | exact)


def bounds_form(geom: Column, own: dict[str, Column]) -> Column:
    """How the bounds of a geometry alone decide whether it meets a box; null if they do not.

    0: it is a point or fills its bounds. 1 or 2: it is the segment between two corners of them, to
    the upper or to the lower right.
    """
    x1, y1, x2, y2 = (own[n] for n in BOUNDS)
    parts = geom["parts"]
    return (
        F.when((geom["type"] == "Point") | (parts == box(x1, y1, x2, y2)["parts"]), 0)
        .when(parts == segment(x1, y1, x2, y2)["parts"], 1)
        .when(parts == segment(x1, y2, x2, y1)["parts"], 2)
        .cast("tinyint")
    )


def bounds_meet_box(form: Column, own: dict[str, Column], b: dict[str, Column]) -> Column:
    """The test of ``meets_box`` for geometries with a ``bounds_form``, without their vertices."""
    x1, y1, x2, y2 = (own[n] for n in BOUNDS)
    rising = _edge_meets_box({"x": x1, "y": y1}, {"x": x2, "y": y2}, b)
    falling = _edge_meets_box({"x": x1, "y": y2}, {"x": x2, "y": y1}, b)
    return bounds_overlap(own, b) & F.when(form == 0, True).when(form == 1, rising).when(form == 2, falling)


def _edges_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    def turn(p: Column, q: Column, r: Column) -> Column:
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    d1, d2, d3, d4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return (
        (F.least(a["x"], b["x"]) <= F.greatest(c["x"], d["x"]))
        & (F.greatest(a["x"], b["x"]) >= F.least(c["x"], d["x"]))
        & (F.least(a["y"], b["y"]) <= F.greatest(c["y"], d["y"]))
        & (F.greatest(a["y"], b["y"]) >= F.least(c["y"], d["y"]))
        & (F.least(d1, d2) <= 0)
        & (F.greatest(d1, d2) >= 0)
        & (F.least(d3, d4) <= 0)
        & (F.greatest(d3, d4) >= 0)
    )


def intersects(a: Column, b: Column) -> Column:
    """Exact test of two geometries. Put a bounds test in front of it."""

    def first_vertex(p: Column) -> Column:
        return F.get(F.get(p["rings"], F.lit(0)), F.lit(0))

    def parts_meet(p: Column, q: Column) -> Column:
        edges = F.exists(
            p["rings"],
            lambda r: _any_edge(
                r,
                lambda u, v: F.exists(
                    q["rings"], lambda s: _any_edge(s, lambda m, n: _edges_meet(u, v, m, n))
                ),
            ),
        )
        pv, qv = first_vertex(p), first_vertex(q)
        return edges | _inside(q, pv["x"], pv["y"]) | _inside(p, qv["x"], qv["y"])

    return let(
        lambda ps, qs: F.exists(ps, lambda p: F.exists(qs, lambda q: parts_meet(p, q))), a["parts"], b["parts"]
    )
