"""Coordinate reference systems: identifiers and closed-form projections.

Supported codes: geographic 4326 / 4258 (and the CRS84 spellings), spherical Mercator 3857, and the
UTM zones 326zz, 327zz (WGS 84) and 258zz (ETRS89). Axis order is always x, y. The projection
formulas are written once and used on Columns (data) and on floats (a request's box).
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from featlake.functions.binding import pipe
from featlake.operators import geometry as G

CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
CRS84H = "http://www.opengis.net/def/crs/OGC/0/CRS84h"
_EPSG = "http://www.opengis.net/def/crs/EPSG/0/"
_GEOGRAPHIC = (4326, 4258)

# Ellipsoid axes and flattenings, Mercator sphere radius, UTM constants.
_WGS84 = (6378137.0, 1 / 298.257223563)
_GRS80 = (6378137.0, 1 / 298.257222101)
_SPHERE_RADIUS = 6378137.0
_UTM_SCALE = 0.9996
_FALSE_EASTING = 500000.0
_FALSE_NORTHING_SOUTH = 10000000.0


class UnsupportedCrs(ValueError):
    """The CRS identifier or code has no closed-form transformation here."""


# --- identifiers ----------------------------------------------------------------------------


def parse_srid(uri: str | int) -> int:
    """CRS identifier of one request to its code; raises when it is not understood."""
    tail = str(uri).rstrip("/").rsplit("/", 1)[-1]
    if tail in ("CRS84", "CRS84h"):
        return 4326
    if not tail.lstrip("+-").isdigit():
        raise UnsupportedCrs(f"unsupported CRS: {uri!r}")
    return int(tail)


def format_srid(srid: int) -> str:
    return CRS84 if srid == 4326 else f"{_EPSG}{srid}"


def srid_column(uri: Column) -> Column:
    """Bulk form of :func:`parse_srid`; null where the identifier is not understood."""
    tail = F.regexp_extract(F.regexp_replace(uri, "/+$", ""), "([^/]*)$", 1)
    return F.when(tail.isin("CRS84", "CRS84h"), F.lit(4326)).otherwise(tail.try_cast("int"))


def uri_column(srid: Column) -> Column:
    return F.when(srid == 4326, F.lit(CRS84)).otherwise(F.concat(F.lit(_EPSG), srid.cast("string")))


def authority_uri_column(authority: Column, code: Column) -> Column:
    """(authority, code) pair to a CRS identifier; CRS84 for EPSG 4326, null without a code."""
    plain = F.concat(
        F.lit("http://www.opengis.net/def/crs/"), F.upper(authority), F.lit("/0/"), code.cast("string")
    )
    is_wgs84 = (F.upper(authority) == "EPSG") & (code.cast("string") == "4326")
    return F.when(is_wgs84, F.lit(CRS84)).otherwise(plain)


# --- projections ----------------------------------------------------------------------------


class _FloatMath:
    """The few functions the formulas need, on floats, under the names of the column functions."""

    sin, cos, tan, atan, atan2 = math.sin, math.cos, math.tan, math.atan, math.atan2
    sinh, cosh, asinh, atanh = math.sinh, math.cosh, math.asinh, math.atanh
    exp, log, sqrt = math.exp, math.log, math.sqrt

    @staticmethod
    def pipe(values, *steps):
        for step in steps:
            values = step(*values)
            values = values if isinstance(values, tuple) else (values,)
        return values if len(values) > 1 else values[0]


class _ColumnMath:
    """The same on columns. ``pipe`` names intermediate values so that they are computed once."""

    sin, cos, tan, atan, atan2 = F.sin, F.cos, F.tan, F.atan, F.atan2
    sinh, cosh, asinh, atanh = F.sinh, F.cosh, F.asinh, F.atanh
    exp, log, sqrt = F.exp, F.log, F.sqrt

    pipe = staticmethod(pipe)


_RAD = math.pi / 180.0


def _to_mercator(x, y, m):
    return x * (_RAD * _SPHERE_RADIUS), m.log(m.tan(y * (_RAD / 2) + math.pi / 4)) * _SPHERE_RADIUS


def _from_mercator(x, y, m):
    lat = (m.atan(m.exp(y / _SPHERE_RADIUS)) * 2 - math.pi / 2) / _RAD
    return x / (_RAD * _SPHERE_RADIUS), lat


@dataclasses.dataclass(frozen=True)
class _Krueger:
    """Series coefficients in the third flattening n, to n**4 (well below 1e-6 m in a zone)."""

    radius: float
    eccentricity: float
    forward: tuple[float, ...]
    inverse: tuple[float, ...]

    @classmethod
    def of(cls, axis: float, flattening: float) -> _Krueger:
        n = flattening / (2 - flattening)
        radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        forward = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        inverse = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        return cls(radius, math.sqrt(flattening * (2 - flattening)), forward, inverse)


_UTM_WGS84 = _Krueger.of(*_WGS84)
_UTM_GRS80 = _Krueger.of(*_GRS80)


def _to_utm(x, y, m, meridian, south, series: _Krueger):
    """Geographic degrees to UTM metres about a central meridian (float or Column)."""
    e = series.eccentricity

    def conformal(tan_lat):
        def finish(t, root, sigma):
            return t * m.sqrt(sigma * sigma + 1) - sigma * root

        root = m.sqrt(tan_lat * tan_lat + 1)
        return m.pipe((tan_lat, root, m.sinh(m.atanh(tan_lat / root * e) * e)), finish)

    def angles(tan_conf, dlon):
        cos_dlon = m.cos(dlon)
        return m.atan2(tan_conf, cos_dlon), m.asinh(
            m.sin(dlon) / m.sqrt(tan_conf * tan_conf + cos_dlon * cos_dlon)
        )

    def plane(xi, eta):
        north, east = xi, eta
        for k, a in enumerate(series.forward, 1):
            north = north + m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * a
            east = east + m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * a
        scale = _UTM_SCALE * series.radius
        return east * scale + _FALSE_EASTING, north * scale

    def start(tan_lat, dlon):
        return conformal(tan_lat), dlon

    east, north = m.pipe((m.tan(y * _RAD), (x - meridian) * _RAD), start, angles, plane)
    return east, north + south


def _from_utm(x, y, m, meridian, south, series: _Krueger):
    e = series.eccentricity
    scale = _UTM_SCALE * series.radius

    def angles(xi, eta):
        north, east = xi, eta
        for k, b in enumerate(series.inverse, 1):
            north = north - m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * b
            east = east - m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * b
        return north, east

    def degrees(north, east):
        sinh_e, cos_n = m.sinh(east), m.cos(north)
        tan_conf = m.sin(north) / m.sqrt(sinh_e * sinh_e + cos_n * cos_n)
        return m.atan2(sinh_e, cos_n) / _RAD, m.pipe((tan_conf, tan_conf), step, step, step, last)

    # Three Newton steps from the conformal to the geographic latitude reach double precision.
    def step(tau, target):
        def move(tau, target, root, sigma):
            guess = tau * m.sqrt(sigma * sigma + 1) - sigma * root
            slope = (tau * tau * (1 - e * e) + 1) / (root * (1 - e * e))
            return tau + (target - guess) / m.sqrt(guess * guess + 1) * slope

        root = m.sqrt(tau * tau + 1)
        return m.pipe((tau, target, root, m.sinh(m.atanh(tau / root * e) * e)), move), target

    def last(tau, _):
        return m.atan(tau) / _RAD

    lon, lat = m.pipe(((y - south) / scale, (x - _FALSE_EASTING) / scale), angles, degrees)
    return lon + meridian, lat


def _utm_zone(srid: int) -> tuple[float, float, _Krueger] | None:
    base, zone = divmod(srid, 100)
    if base in (326, 327) and 1 <= zone <= 60:
        return zone * 6.0 - 183.0, _FALSE_NORTHING_SOUTH if base == 327 else 0.0, _UTM_WGS84
    if base == 258 and 28 <= zone <= 38:
        return zone * 6.0 - 183.0, 0.0, _UTM_GRS80
    return None


def check_srid(srid: int) -> None:
    if srid not in (*_GEOGRAPHIC, 3857) and _utm_zone(srid) is None:
        raise UnsupportedCrs(f"no transformation for EPSG:{srid}")


def _to_degrees(srid: int, m) -> Callable:
    if srid in _GEOGRAPHIC:
        return lambda x, y: (x, y)
    if srid == 3857:
        return lambda x, y: _from_mercator(x, y, m)
    return lambda x, y: _from_utm(x, y, m, *_utm_zone(srid))


def _from_degrees(srid: int, m) -> Callable:
    if srid in _GEOGRAPHIC:
        return lambda x, y: (x, y)
    if srid == 3857:
        return lambda x, y: _to_mercator(x, y, m)
    return lambda x, y: _to_utm(x, y, m, *_utm_zone(srid))


def transform_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Project coordinate columns. The poles have no image in a projected system: null."""
    check_srid(source)
    check_srid(target)
    if source == target or (source in _GEOGRAPHIC and target in _GEOGRAPHIC):
        return x, y
    lon, lat = _to_degrees(source, _ColumnMath)(x, y)
    if target in _GEOGRAPHIC:
        return lon, lat
    has_image = F.abs(lat) < 90
    px, py = _from_degrees(target, _ColumnMath)(lon, lat)
    return F.when(has_image, px), F.when(has_image, py)


def utm_of_own_zone(lon: Column, lat: Column) -> dict[str, Column]:
    """Every point in the UTM zone it lies in: zone number, code, easting, northing."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    south = F.when(lat < 0, _FALSE_NORTHING_SOUTH).otherwise(0.0)
    east, north = _to_utm(lon, lat, _ColumnMath, zone * 6.0 - 183.0, south, _UTM_WGS84)
    has_image = F.abs(lat) < 90
    return {
        "srid": F.when(lat < 0, 32700).otherwise(32600) + zone,
        "easting": F.when(has_image, east),
        "northing": F.when(has_image, north),
    }


def reproject(geom: Column, source: int, target: int) -> Column:
    """Project every vertex of a geometry."""
    check_srid(source)
    check_srid(target)
    if source == target:
        return geom
    return G.map_vertices(geom, lambda x, y: transform_xy(x, y, source, target))


def transform_point(x: float, y: float, source: int, target: int) -> tuple[float, float]:
    """Project one literal coordinate pair of a request."""
    check_srid(source)
    check_srid(target)
    if source == target:
        return x, y
    lon, lat = _to_degrees(source, _FloatMath)(x, y)
    return (lon, lat) if target in _GEOGRAPHIC else _from_degrees(target, _FloatMath)(lon, lat)


def transform_box(
    box: tuple[float, float, float, float], source: int, target: int
) -> tuple[float, float, float, float]:
    """Project a request's box, once, before the scan.

    Geographic and Mercator axes are separable, so there the image is exactly a box. Towards and
    from UTM the edges are curves: take the bounds of the densified outline, which is what the
    scan filters on.
    """
    check_srid(source)
    check_srid(target)
    if source == target or (source in _GEOGRAPHIC and target in _GEOGRAPHIC):
        return box
    xmin, ymin, xmax, ymax = box
    if source in _GEOGRAPHIC:
        # The poles have no image; any latitude this close keeps every projectable feature.
        limit = 90 - 1e-9
        ymin, ymax = max(ymin, -limit), min(ymax, limit)
    steps = 1 if {source, target} <= {*_GEOGRAPHIC, 3857} else 64
    fractions = [i / steps for i in range(steps + 1)]
    outline = [(xmin + (xmax - xmin) * f, y) for f in fractions for y in (ymin, ymax)]
    outline += [(x, ymin + (ymax - ymin) * f) for f in fractions for x in (xmin, xmax)]
    image = [transform_point(x, y, source, target) for x, y in outline]
    xs, ys = zip(*image)
    return min(xs), min(ys), max(xs), max(ys)


def box_outline(
    box: tuple[float, float, float, float], source: int, target: int, steps: int = 64
) -> list[tuple[float, float]] | None:
    """The projected outline as a closed ring, or None when the image is a box anyway."""
    if {source, target} <= {*_GEOGRAPHIC, 3857} or source == target:
        return None
    xmin, ymin, xmax, ymax = box
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    ring = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:]):
        ring += [(x1 + (x2 - x1) * i / steps, y1 + (y2 - y1) * i / steps) for i in range(steps)]
    return [transform_point(x, y, source, target) for x, y in [*ring, corners[0]]]
