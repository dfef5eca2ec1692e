"""Text and binary forms, exact intersection against an independent check, projections."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from featlake.functions.wkb import from_wkb
from featlake.operators import crs as C
from featlake.operators import geometry as G

TEXTS = [
    "POINT (10 20)", "POINT Z (1 2 3)", "LINESTRING (0 0, 10 0.5, 2 -3.25)",
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))", "MULTIPOINT ((1 2), (3 4))",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
    "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1), POLYGON ((0 0, 1 0, 1 1, 0 0)))", "POINT EMPTY",
    "POLYGON EMPTY",
]


def test_text_round_trips(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("g", G.from_wkt(F.col("t")))
    df = df.select("t", G.to_wkt(F.col("g")).alias("w"), G.to_geojson(F.col("g")).alias("j"), "g")
    for r in df.withColumn("again", G.from_geojson(F.col("j"))).collect():
        assert r.w == r.t
        assert r.again == r.g


@pytest.mark.parametrize("text", ["garbage", "POINT (1)", "POLYGON 1 2", "", None, "CIRCLE (1 2)"])
def test_malformed_text_is_null(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(G.from_wkt(F.col("t")), G.from_geojson(F.col("t"))).first()
    assert tuple(row) == (None, None)


def test_spellings(spark):
    texts = ["multipoint (1 2, 3 4)", "SRID=4326;POINT(.5 +2e1)", "  Point  M (1 2 9) ", "POINT ZM (1 2 3 4)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(G.to_wkt(G.from_wkt(F.col("t")))).collect()]
    assert got == ["MULTIPOINT ((1 2), (3 4))", "POINT (0.5 20)", "POINT (1 2)", "POINT Z (1 2 3)"]


def _blob(order, code, *body):
    return (b"\x01" if order == "<" else b"\x00") + struct.pack(order + "I", code) + b"".join(body)


def _coords(order, *values):
    return struct.pack(f"{order}{len(values)}d", *values)


def _count(order, n):
    return struct.pack(order + "I", n)


def test_binary_forms(spark):
    ring = _count("<", 4) + _coords("<", 0, 0, 1, 0, 1, 1, 0, 0)
    polygon = _blob("<", 3, _count("<", 1), ring)
    cases = {
        "POINT (10 20)": _blob("<", 1, _coords("<", 10, 20)),
        "POINT (30 40)": _blob(">", 1, _coords(">", 30, 40)),
        "POINT Z (1 2 3)": _blob("<", 1001, _coords("<", 1, 2, 3)),
        "POINT Z (4 5 6)": _blob("<", 0x80000001, _coords("<", 4, 5, 6)),
        "POINT (7 8)": _blob("<", 0x20000001, struct.pack("<I", 4326), _coords("<", 7, 8)),
        "LINESTRING (0 0, 2 3)": _blob("<", 2, _count("<", 2), _coords("<", 0, 0, 2, 3)),
        "POLYGON ((0 0, 1 0, 1 1, 0 0))": polygon,
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))": _blob("<", 6, _count("<", 1), polygon),
        "POINT EMPTY": _blob("<", 1, _coords("<", math.nan, math.nan)),
    }
    rows = [(k, bytearray(v)) for k, v in cases.items()] + [(None, None)]
    df = spark.createDataFrame(rows, "t string, b binary")
    for r in df.select("t", G.to_wkt(from_wkb(F.col("b"))).alias("w")).collect():
        assert r.w == r.t
    points = spark.range(1000).select(F.lit(bytearray(cases["POINT (10 20)"])).alias("b"))
    assert points.select(G.to_wkt(from_wkb(F.col("b"))).alias("w")).distinct().first()[0] == "POINT (10 20)"


# --- intersection ---------------------------------------------------------------------------


def _orient(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _on(a, b, p):
    return (
        _orient(a, b, p) == 0
        and min(a[0], b[0]) <= p[0] <= max(a[0], b[0])
        and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    )


def _cross(a, b, c, d):
    d1, d2, d3, d4 = _orient(a, b, c), _orient(a, b, d), _orient(c, d, a), _orient(c, d, b)
    if ((d1 > 0) != (d2 > 0)) and ((d3 > 0) != (d4 > 0)) and 0 not in (d1, d2, d3, d4):
        return True
    return _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def _edges(rings):
    return [(r[i], r[min(i + 1, len(r) - 1)]) for r in rings for i in range(max(1, len(r) - 1))]


def _in_polygon(rings, p):
    inside = False
    for (x1, y1), (x2, y2) in _edges(rings):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def _meet(a, b):
    (da, ra), (db, rb) = a, b
    if any(_cross(*e, *f) for e in _edges(ra) for f in _edges(rb)):
        return True
    return (db == 2 and _in_polygon(rb, ra[0][0])) or (da == 2 and _in_polygon(ra, rb[0][0]))


def _shape(rng):
    """Whole-number shapes, so that touching happens and arithmetic is exact."""
    dim = rng.randrange(3)
    if dim == 0:
        return 0, [[(rng.randint(0, 20), rng.randint(0, 20))]]
    if dim == 1:
        return 1, [[(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(rng.randint(2, 4))]]
    x, y, w, h = rng.randint(0, 12), rng.randint(0, 12), rng.randint(4, 9), rng.randint(4, 9)
    shell = [(x, y), (x + w, y + rng.randint(0, 2)), (x + w, y + h), (x, y + h), (x, y)]
    if rng.random() < 0.5:
        return 2, [shell]
    return 2, [shell, [(x + 1, y + 3), (x + w - 1, y + 3), (x + w - 1, y + h - 1), (x + 1, y + h - 1), (x + 1, y + 3)]]


def _wkt(shape):
    dim, rings = shape
    texts = ["(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings]
    return (
        f"POINT {texts[0]}" if dim == 0 else f"LINESTRING {texts[0]}" if dim == 1 else f"POLYGON ({', '.join(texts)})"
    )


def test_intersects_agrees_with_plain_python(spark):
    rng = random.Random(11)
    pairs = [(_shape(rng), _shape(rng)) for _ in range(1500)]
    df = spark.createDataFrame([(i, _wkt(a), _wkt(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = df.select("i", G.intersects(G.from_wkt(F.col("a")), G.from_wkt(F.col("b"))).alias("hit"))
    got = {r.i: r.hit for r in df.collect()}
    expected = {i: _meet(a, b) for i, (a, b) in enumerate(pairs)}
    assert got == expected
    assert 300 < sum(expected.values()) < 1300


def test_intersects_box_agrees_with_plain_python(spark):
    rng = random.Random(12)
    cases = []
    for i in range(1500):
        x, y = rng.randint(0, 18), rng.randint(0, 18)
        cases.append((i, _shape(rng), x, y, x + rng.randint(0, 6), y + rng.randint(0, 6)))
    rows = [(i, _wkt(s), float(a), float(b), float(c), float(d)) for i, s, a, b, c, d in cases]
    df = spark.createDataFrame(rows, "i int, t string, a double, b double, c double, d double")
    hit = G.intersects_box(G.from_wkt(F.col("t")), F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = {r.i: r.hit for r in df.select("i", hit.alias("hit")).collect()}
    for i, shape, a, b, c, d in cases:
        box = (2, [[(a, b), (c, b), (c, d), (a, d), (a, b)]])
        expected = _meet(shape, box) if (c > a or d > b) else _meet(shape, (0, [[(a, b)]]))
        assert got[i] == expected, (shape, a, b, c, d)


def test_empty_geometry_never_meets(spark):
    df = spark.createDataFrame([("POLYGON EMPTY",)], "t string")
    g = G.from_wkt(F.col("t"))
    row = df.select(G.intersects_box(g, -180, -90, 180, 90), G.intersects(g, G.box(-9, -9, 9, 9))).first()
    assert tuple(row) == (False, False)


# --- reference systems ----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("uri", "srid"),
    [
        ("http://www.opengis.net/def/crs/OGC/1.3/CRS84", 4326), ("http://www.opengis.net/def/crs/OGC/0/CRS84h", 4326),
        ("http://www.opengis.net/def/crs/EPSG/0/3857", 3857), ("http://www.opengis.net/def/crs/EPSG/0/25832/", 25832),
        ("32633", 32633),
    ],
)
def test_crs_identifiers(spark, uri, srid):
    assert C.parse_srid(uri) == srid
    assert spark.range(1).select(C.srid_column(F.lit(uri))).first()[0] == srid
    assert C.parse_srid(C.format_srid(srid)) == srid


def test_unsupported_crs():
    with pytest.raises(C.UnsupportedCrs):
        C.parse_srid("http://example.org/crs/nothing")
    with pytest.raises(C.UnsupportedCrs):
        C.transform_point(1, 2, 4326, 2154)


def test_projections(spark):
    x, y = C.transform_point(10, 20, 4326, 3857)
    assert (x, y) == pytest.approx((1113194.9079327357, 2273030.926987689), abs=1e-6)
    # A published position: the tower in Toronto, 43.642567 N 79.387139 W, is 630084 m E 4833439 m N.
    assert C.transform_point(-79.387139, 43.642567, 4326, 32617) == pytest.approx((630084.3, 4833438.6), abs=0.1)
    # The central meridian maps to the false easting, and the equator to zero.
    assert C.transform_point(9, 0, 4326, 32632) == pytest.approx((500000, 0), abs=1e-6)
    assert C.transform_point(9, 0, 4326, 32732) == pytest.approx((500000, 10000000), abs=1e-6)


@pytest.mark.parametrize("srid", [3857, 32632, 32732, 25832])
def test_round_trip_on_columns_and_floats(spark, srid):
    df = spark.range(200).selectExpr("6 + (id % 60) / 10.0D AS lon", "(id % 160) - 79.95D AS lat")
    x, y = C.transform_xy(F.col("lon"), F.col("lat"), 4326, srid)
    df = df.withColumns({"x": x, "y": y})
    lon, lat = C.transform_xy(F.col("x"), F.col("y"), srid, 4326)
    for r in df.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-10)
        assert C.transform_point(r.lon, r.lat, 4326, srid) == pytest.approx((r.x, r.y), abs=1e-6)


def test_poles_have_no_image(spark):
    g = G.point(F.lit(10.0), F.lit(90.0))
    assert spark.range(1).select(C.reproject(g, 4326, 3857)).first()[0] is None
