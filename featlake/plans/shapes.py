"""Queries over lines, polygons and points: text forms, intersection, projection, bulk joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators import crs as C
from featlake.operators import geometry as G
from featlake.operators import spatial_join as S
from featlake.operators.filters import FeatureFilter
from featlake.plans.registry import Tables, query
from featlake.table import FeatureTable


def parcel_geometry() -> Column:
    xmin, ymin, xmax, ymax = (F.col(b) for b in G.BOUNDS)
    return (
        F.when(F.col("geom_type") == "Polygon", G.box(xmin, ymin, xmax, ymax))
        .when(F.col("geom_type") == "LineString", G.segment(xmin, ymin, xmax, ymax))
        .otherwise(G.point(xmin, ymin))
    )


def parcels(t: Tables) -> FeatureTable:
    return FeatureTable(
        t.parcels.withColumn("geom", parcel_geometry()), id="id", geom="geom", time="valid_from", title="parcels"
    )


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _pair(x: str, y: str) -> Column:
    return F.concat_ws(" ", _text(x), _text(y))


# --- exact intersection ---------------------------------------------------------------------


def _meets_box_sql(a: str, b: dict[str, str]) -> str:
    """Box, diagonal segment or point ``a`` meets box ``b``, in plain arithmetic."""
    sides = [
        f"(({a}xmax - {a}xmin) * (({cy}) - {a}ymin) - ({a}ymax - {a}ymin) * (({cx}) - {a}xmin))"
        for cx in (b["xmin"], b["xmax"])
        for cy in (b["ymin"], b["ymax"])
    ]
    return f"""({a}xmin <= {b["xmax"]} AND {a}xmax >= {b["xmin"]}
        AND {a}ymin <= {b["ymax"]} AND {a}ymax >= {b["ymin"]}
        AND ({a}geom_type <> 'LineString'
             OR (least({", ".join(sides)}) <= 0 AND greatest({", ".join(sides)}) >= 0)))"""


_DEG = "/ (pi() / 180 * 6378137)"
_LAT = "(atan(exp({} / 6378137.0)) * 2 - pi() / 2) * 180 / pi()"


@query(
    "bbox_filter",
    f"""
    SELECT id, geom_type FROM parcels WHERE {
        _meets_box_sql(
            "",
            {
                "xmin": f"(-5000000.5 {_DEG})",
                "ymin": _LAT.format("-3000000.5"),
                "xmax": f"(7000000.5 {_DEG})",
                "ymax": _LAT.format("6000000.5"),
            },
        )
    }
    """,
    uses=("parcels",),
)
def bbox_filter(t: Tables) -> DataFrame:
    """A box given in spherical Mercator against stored degrees: the box is projected, not the rows."""
    f = FeatureFilter(bbox=(-5000000.5, -3000000.5, 7000000.5, 6000000.5), bbox_crs="EPSG/0/3857")
    return parcels(t).select(f).select("id", "geom_type")


_ROW_BOX = {
    "xmin": "xmin + 0.5",
    "ymin": "ymin + CAST(id % 4 AS DOUBLE) - 1",
    "xmax": "xmin + 0.5 + CAST(id % 3 AS DOUBLE)",
    "ymax": "ymin + CAST(id % 4 AS DOUBLE) - 0.5",
}


@query(
    "intersects_box",
    f"SELECT id, {_meets_box_sql('', {k: f'({v})' for k, v in _ROW_BOX.items()})} AS hit FROM parcels",
    uses=("parcels",),
)
def intersects_box(t: Tables) -> DataFrame:
    """Every feature against a box of its own."""
    b = {k: F.expr(v) for k, v in _ROW_BOX.items()}
    return t.parcels.select("id", G.intersects_box(parcel_geometry(), **b).alias("hit"))


# A concave shell with a hole, and the literal edges of both rings for the SQL.
_SHELL = [(-60.25, -40.5), (70.75, -55.25), (20.5, 5.25), (90.25, 60.75), (-45.5, 50.25), (-60.25, -40.5)]
_HOLE = [(-20.25, -10.75), (10.5, -8.25), (5.25, 30.5), (-20.25, -10.75)]


def _polygon(*rings: list[tuple[float, float]]) -> Column:
    return G.geometry(
        "Polygon",
        F.array(G.part(2, F.array(*[F.array(*[G.vertex(x, y) for x, y in ring]) for ring in rings]))),
    )


def _meets_polygon_sql(source: str, key: str, *rings: list[tuple[float, float]]) -> str:
    """CTEs ending in ``hit(key)``: rows of ``source`` that meet a literal polygon, by brute force."""
    edges = ", ".join(
        f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))"
        for ring in rings
        for (a, b), (c, d) in zip(ring, ring[1:])
    )
    vx, vy = rings[0][0]

    def turn(px: str, py: str, qx: str, qy: str, rx: str, ry: str) -> str:
        return f"(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"

    d1 = turn("e.ax", "e.ay", "e.bx", "e.by", "cx", "cy")
    d2 = turn("e.ax", "e.ay", "e.bx", "e.by", "dx", "dy")
    d3 = turn("cx", "cy", "dx", "dy", "e.ax", "e.ay")
    d4 = turn("cx", "cy", "dx", "dy", "e.bx", "e.by")
    corner = "{{'ax': {}, 'ay': {}, 'bx': {}, 'by': {}}}"
    box = ", ".join(
        corner.format(*c)
        for c in (
            ("xmin", "ymin", "xmax", "ymin"),
            ("xmax", "ymin", "xmax", "ymax"),
            ("xmax", "ymax", "xmin", "ymax"),
            ("xmin", "ymax", "xmin", "ymin"),
        )
    )
    return f"""
    qe(cx, cy, dx, dy) AS (VALUES {edges}),
    fe AS (SELECT {key}, unnest(CASE geom_type WHEN 'Polygon' THEN [{box}]
        WHEN 'LineString' THEN [{corner.format("xmin", "ymin", "xmax", "ymax")}]
        ELSE [{corner.format("xmin", "ymin", "xmin", "ymin")}] END) AS e FROM {source}),
    hit AS (
      SELECT {key} FROM fe, qe
      WHERE least(e.ax, e.bx) <= greatest(cx, dx) AND greatest(e.ax, e.bx) >= least(cx, dx)
        AND least(e.ay, e.by) <= greatest(cy, dy) AND greatest(e.ay, e.by) >= least(cy, dy)
        AND least({d1}, {d2}) <= 0 AND greatest({d1}, {d2}) >= 0
        AND least({d3}, {d4}) <= 0 AND greatest({d3}, {d4}) >= 0
      UNION
      SELECT {key} FROM {source}, qe
      WHERE (cy > ymin) <> (dy > ymin) AND xmin < (dx - cx) * (ymin - cy) / (dy - cy) + cx
      GROUP BY {key} HAVING count(*) % 2 = 1
      UNION
      SELECT {key} FROM {source}
      WHERE geom_type = 'Polygon' AND {vx} BETWEEN xmin AND xmax AND {vy} BETWEEN ymin AND ymax)"""


@query(
    "intersects_geom",
    f"WITH {_meets_polygon_sql('parcels', 'id', _SHELL, _HOLE)} SELECT id FROM hit",
    uses=("parcels",),
)
def intersects_geom(t: Tables) -> DataFrame:
    """Every feature against a concave polygon with a hole; bounds first, then the exact test."""
    shape = _polygon(_SHELL, _HOLE)
    near = G.bounds_overlap(
        {b: F.col(b) for b in G.BOUNDS},
        G.box_columns(min(x for x, _ in _SHELL), min(y for _, y in _SHELL),
                      max(x for x, _ in _SHELL), max(y for _, y in _SHELL)),
    )
    return t.parcels.where(near & G.intersects(parcel_geometry(), shape)).select("id")


_AREA = [(-100.5, -30.25), (60.25, -45.75), (10.75, 55.5), (-100.5, -30.25)]


@query(
    "extent_intersects",
    f"""
    WITH bounded AS (SELECT *, 'Polygon' AS geom_type FROM collections WHERE xmin IS NOT NULL),
    {_meets_polygon_sql("bounded", "identifier", _AREA)}
    SELECT identifier, type FROM collections
    WHERE xmin IS NULL OR identifier IN (SELECT identifier FROM hit)
    """,
    uses=("collections",),
)
def extent_intersects(t: Tables) -> DataFrame:
    """Collections whose extent meets an area, or that have no extent at all."""
    xmin, ymin, xmax, ymax = (F.col(b) for b in G.BOUNDS)
    meets = G.intersects(G.box(xmin, ymin, xmax, ymax), _polygon(_AREA))
    return t.collections.where(xmin.isNull() | meets).select("identifier", "type")


# --- bulk joins -----------------------------------------------------------------------------


@query(
    "batch_bbox",
    """
    SELECT request_id, id FROM obs, boxes
    WHERE x BETWEEN q_xmin AND q_xmax AND y BETWEEN q_ymin AND q_ymax
    """,
    uses=("obs", "boxes"),
)
def batch_bbox(t: Tables) -> DataFrame:
    """All pairs of request boxes and points inside them, by a grid join."""
    points = t.obs.select(
        "id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax")
    )
    return S.join_boxes(points, t.boxes).select("request_id", "id")


@query(
    "batch_bbox_shapes",
    f"""
    SELECT request_id, id FROM parcels, boxes
    WHERE {_meets_box_sql("", {b: f"q_{b}" for b in G.BOUNDS})}
    """,
    uses=("parcels", "boxes"),
)
def batch_bbox_shapes(t: Tables) -> DataFrame:
    """The same for shapes, tested exactly; those that their bounds decide are joined without geometries."""
    own, asked = ({b: F.col(f"{p}{b}") for b in G.BOUNDS} for p in ("", "q_"))
    rows = t.parcels.select("id", "geom_type", *G.BOUNDS, parcel_geometry().alias("geom"))
    # As a row of its own: the optimizer would move filters by a plain column below it, and make each shape many times.
    rows = rows.withColumn("form", F.explode(F.array(G.bounds_form(F.col("geom"), own)))).drop("geom")
    plain = rows.where("form IS NOT NULL").drop("geom_type")
    decided = S.join_boxes(plain, t.boxes, G.bounds_meet_box(F.col("form"), own, asked))
    exact = G.meets_box(parcel_geometry(), own, asked)
    others = S.join_boxes(rows.where("form IS NULL").drop("form"), t.boxes, exact)
    return decided.select("request_id", "id").unionByName(others.select("request_id", "id"))


@query(
    "extent_intersects_batch",
    """
    SELECT request_id, identifier FROM collections, boxes
    WHERE xmin <= q_xmax AND xmax >= q_xmin AND ymin <= q_ymax AND ymax >= q_ymin
    UNION ALL SELECT NULL, identifier FROM collections WHERE xmin IS NULL
    """,
    uses=("collections", "boxes"),
)
def extent_intersects_batch(t: Tables) -> DataFrame:
    """Collections by query area. An unbounded collection meets every area: it is listed once,
    without a request, instead of once per request."""
    bounded = S.join_boxes(t.collections.select("identifier", *G.BOUNDS), t.boxes)
    unbounded = t.collections.where(F.col("xmin").isNull()).select(
        F.lit(None).cast("bigint").alias("request_id"), "identifier"
    )
    return bounded.select("request_id", "identifier").unionByName(unbounded)


# --- text forms -----------------------------------------------------------------------------


def _wkt_text() -> Column:
    """Well-known text of six kinds, one per row."""
    a, b, c, d = _pair("xmin", "ymin"), _pair("xmax", "ymin"), _pair("xmax", "ymax"), _pair("xmin", "ymax")
    ring = F.concat(F.lit("("), F.concat_ws(", ", a, b, c, d, a), F.lit(")"))
    line = F.concat(F.lit("("), F.concat_ws(",", a, c), F.lit(")"))
    kind = F.col("id") % 6
    return (
        F.when(kind == 0, F.concat(F.lit("POINT Z ("), a, F.lit(" 7.5)")))
        .when(kind == 1, F.concat(F.lit("LINESTRING"), line))
        .when(kind == 2, F.concat(F.lit("SRID=4326;POLYGON ("), ring, F.lit(")")))
        .when(kind == 3, F.concat(F.lit("MULTIPOINT (("), a, F.lit("), ("), c, F.lit("))")))
        .when(kind == 4, F.concat(F.lit("MULTILINESTRING ("), line, F.lit(", "), line, F.lit(")")))
        .otherwise(
            F.concat(F.lit("GEOMETRYCOLLECTION (POINT ("), a, F.lit("), POLYGON ("), ring, F.lit("), POINT EMPTY)"))
        )
    )


_SIX_SQL = """
SELECT id,
  CASE id % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'MultiPoint'
    WHEN 4 THEN 'MultiLineString' ELSE 'GeometryCollection' END AS kind,
  CASE id % 6 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END AS n_parts,
  CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 4 ELSE 6 END AS n_vertices,
  xmin, ymin, CASE WHEN id % 6 = 0 THEN xmin ELSE xmax END AS xmax,
  CASE WHEN id % 6 = 0 THEN ymin ELSE ymax END AS ymax
FROM parcels
"""


def _summary(rows: DataFrame) -> DataFrame:
    g = F.col("geom")
    return rows.select(
        "id",
        g["type"].alias("kind"),
        F.size(g["parts"]).alias("n_parts"),
        F.size(G.vertices(g)).alias("n_vertices"),
        *[c.alias(n) for n, c in G.bounds(g).items()],
    )


@query("wkt_parse", _SIX_SQL, uses=("parcels",))
def wkt_parse(t: Tables) -> DataFrame:
    """Load a table of well-known text: geometry plus the bounds columns to store with it."""
    return _summary(t.parcels.select("id", G.from_wkt(_wkt_text()).alias("geom")))


@query("geojson_parse", _SIX_SQL, uses=("parcels",))
def geojson_parse(t: Tables) -> DataFrame:
    """Load a table of GeoJSON geometries."""
    text = G.to_geojson(G.from_wkt(_wkt_text()))
    rows = t.parcels.select("id", text.alias("text"))
    return _summary(rows.select("id", G.from_geojson(F.col("text")).alias("geom")))


def _number_sql(c: str, digits: int = 6) -> str:
    return f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,{digits})) AS STRING), '\\.?0+$', '')"


_A, _B, _C, _D = (
    (_number_sql(x), _number_sql(y))
    for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))
)


def _joined_sql(opening: str, between: str, closing: str, *corners: tuple[str, str], sep: str) -> str:
    parts = [f"concat({x}, '{between}', {y})" for x, y in corners]
    return f"concat('{opening}', {f', {chr(39)}{sep}{chr(39)}, '.join(parts)}, '{closing}')"


@query(
    "wkt_write",
    f"""
    SELECT id, concat('SRID=4326;', CASE geom_type
      WHEN 'Polygon' THEN {_joined_sql("POLYGON ((", " ", "))", _A, _B, _C, _D, _A, sep=", ")}
      WHEN 'LineString' THEN {_joined_sql("LINESTRING (", " ", ")", _A, _C, sep=", ")}
      ELSE {_joined_sql("POINT (", " ", ")", _A, sep=", ")} END) AS wkt
    FROM parcels
    """,
    uses=("parcels",),
)
def wkt_write(t: Tables) -> DataFrame:
    return t.parcels.select("id", G.to_ewkt(parcel_geometry(), 4326).alias("wkt"))


@query(
    "geojson_write",
    f"""
    SELECT id, CASE geom_type
      WHEN 'Polygon' THEN {
        _joined_sql('{"type":"Polygon","coordinates":[[[', ",", "]]]}", _A, _B, _C, _D, _A, sep="],[")
    }
      WHEN 'LineString' THEN {_joined_sql('{"type":"LineString","coordinates":[[', ",", "]]}", _A, _C, sep="],[")}
      ELSE {_joined_sql('{"type":"Point","coordinates":[', ",", "]}", _A, sep="],[")} END AS geojson
    FROM parcels
    """,
    uses=("parcels",),
)
def geojson_write(t: Tables) -> DataFrame:
    return t.parcels.select("id", G.to_geojson(parcel_geometry(), digits=6).alias("geojson"))


@query("geom_bounds", "SELECT id, xmin, ymin, xmax, ymax FROM parcels", uses=("parcels",))
def geom_bounds(t: Tables) -> DataFrame:
    """Bounds out of the geometry, not out of the columns it was made from."""
    rows = t.parcels.select("id", parcel_geometry().alias("geom"))
    return G.with_bounds(rows).drop("geom")


# --- reference systems ----------------------------------------------------------------------


@query(
    "reproject",
    """
    SELECT id, CASE WHEN abs(y) < 90 THEN round(x * (pi() / 180 * 6378137), 3) END AS mx,
      CASE WHEN abs(y) < 90 THEN round(ln(tan(pi() / 4 + y * pi() / 360)) * 6378137, 3) END AS my,
      CASE WHEN abs(y) < 90 THEN round(x, 7) END AS lon, CASE WHEN abs(y) < 90 THEN round(y, 7) END AS lat
    FROM obs
    """,
    uses=("obs",),
)
def reproject(t: Tables) -> DataFrame:
    """Degrees to spherical Mercator and back; the poles have no image."""
    moved = t.obs.select("id", C.reproject(G.point(F.col("x"), F.col("y")), 4326, 3857).alias("m"))
    both = moved.withColumn("back", C.reproject(F.col("m"), 3857, 4326))
    m, b = (F.col(c)["parts"][0]["rings"][0][0] for c in ("m", "back"))
    return both.select(
        "id", F.round(m["x"], 3).alias("mx"), F.round(m["y"], 3).alias("my"),
        F.round(b["x"], 7).alias("lon"), F.round(b["y"], 7).alias("lat"),
    )


def _utm_sql() -> str:
    n = "(f / (2 - f))"

    def power(k: int) -> str:
        return f"pow({n}, {k})"

    a = [
        f"({n} / 2 - {power(2)} * 2 / 3 + {power(3)} * 5 / 16 + {power(4)} * 41 / 180)",
        f"({power(2)} * 13 / 48 - {power(3)} * 3 / 5 + {power(4)} * 557 / 1440)",
        f"({power(3)} * 61 / 240 - {power(4)} * 103 / 140)",
        f"({power(4)} * 49561 / 161280)",
    ]
    east = " + ".join(["eta", *[f"{c} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(a, 1)]])
    north = " + ".join(["xi", *[f"{c} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(a, 1)]])
    scale = f"0.9996 * 6378137 / (1 + {n}) * (1 + {power(2)} / 4 + {power(4)} / 64)"
    return f"""
    WITH placed AS (SELECT id, x, y, least(floor((x + 180) / 6) + 1, 60) AS zone,
        CAST(1 AS DOUBLE) / CAST(298.257223563 AS DOUBLE) AS f FROM obs),
    angles AS (SELECT *, tan(radians(y)) AS tau, radians(x - (zone * 6 - 183)) AS dl, sqrt(f * (2 - f)) AS e FROM placed),
    conf AS (SELECT *, sinh(e * atanh(e * tau / sqrt(1 + tau * tau))) AS s FROM angles),
    sphere AS (SELECT *, tau * sqrt(1 + s * s) - s * sqrt(1 + tau * tau) AS tp FROM conf),
    series AS (SELECT *, atan2(tp, cos(dl)) AS xi, asinh(sin(dl) / sqrt(tp * tp + cos(dl) * cos(dl))) AS eta FROM sphere)
    SELECT id, CAST(CASE WHEN y < 0 THEN 32700 ELSE 32600 END + zone AS INT) AS srid,
      CASE WHEN abs(y) < 90 THEN round({scale} * ({east}) + 500000, 3) END AS easting,
      CASE WHEN abs(y) < 90 THEN round({scale} * ({north}) + CASE WHEN y < 0 THEN 10000000 ELSE 0 END, 3) END AS northing
    FROM series
    """


@query("reproject_utm", _utm_sql(), uses=("obs",))
def reproject_utm(t: Tables) -> DataFrame:
    """Every point in the UTM zone it lies in."""
    utm = C.utm_of_own_zone(F.col("x"), F.col("y"))
    return t.obs.select(
        "id", utm["srid"].alias("srid"),
        F.round(utm["easting"], 3).alias("easting"), F.round(utm["northing"], 3).alias("northing"),
    )


@query(
    "crs_parse",
    """
    SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 4326 WHEN 1 THEN 4326 WHEN 2 THEN 32600 + p_size
      WHEN 3 THEN 3857 END AS INT) AS srid FROM part
    """,
)
def crs_parse(t: Tables) -> DataFrame:
    """CRS identifiers to codes: the two CRS84 spellings, numbered codes, a trailing slash, no code."""
    kind = F.col("p_partkey") % 5
    epsg = "http://www.opengis.net/def/crs/EPSG/0/"
    uri = (
        F.when(kind == 0, F.lit(C.CRS84))
        .when(kind == 1, F.lit(C.CRS84H))
        .when(kind == 2, F.concat(F.lit(epsg), (F.col("p_size") + 32600).cast("string")))
        .when(kind == 3, F.lit(f"{epsg}3857/"))
        .otherwise(F.concat(F.lit(epsg), F.col("p_brand")))
    )
    return t.part.select("p_partkey", C.srid_column(uri).alias("srid"))


@query(
    "crs_format",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'http://www.opengis.net/def/crs/OGC/1.3/CRS84'
      ELSE concat('http://www.opengis.net/def/crs/EPSG/0/', CAST(32600 + p_size AS STRING)) END AS uri,
      CASE WHEN p_partkey % 3 = 0 THEN 'http://www.opengis.net/def/crs/OGC/1.3/CRS84'
      ELSE concat('http://www.opengis.net/def/crs/ESRI/0/', CAST(32600 + p_size AS STRING)) END AS authority_uri
    FROM part
    """,
)
def crs_format(t: Tables) -> DataFrame:
    wgs84 = F.col("p_partkey") % 3 == 0
    srid = F.when(wgs84, 4326).otherwise(F.col("p_size") + 32600)
    authority = F.when(wgs84, "epsg").otherwise("esri")
    return t.part.select(
        "p_partkey",
        C.uri_column(srid).alias("uri"),
        C.authority_uri_column(authority, srid).alias("authority_uri"),
    )


@query(
    "storage_crs",
    """
    SELECT identifier, coalesce(storage_crs, 'http://www.opengis.net/def/crs/OGC/1.3/CRS84') AS storage_crs,
      CAST(CASE WHEN storage_crs LIKE '%3857' THEN 3857 ELSE 4326 END AS INT) AS srid
    FROM collections
    """,
    uses=("collections",),
)
def storage_crs(t: Tables) -> DataFrame:
    crs = F.coalesce(F.col("storage_crs"), F.lit(C.CRS84))
    return t.collections.select("identifier", crs.alias("storage_crs"), C.srid_column(crs).alias("srid"))
