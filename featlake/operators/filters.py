"""Request filters: parsing of their values and their compilation to predicates."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUTHY = ("true", "yes", "on", "t", "1")

# Request parameters that a listing of features understands.
KNOWN_PARAMETERS = (
    "bbox",
    "bbox-crs",
    "crs",
    "datetime",
    "filter",
    "filter-crs",
    "filter-lang",
    "limit",
    "offset",
    "properties",
    "q",
    "resulttype",
    "skipGeometry",
    "sortby",
)


class BadRequest(ValueError):
    """A request parameter has no valid reading."""


# --- values of one request ------------------------------------------------------------------


def parse_bbox(value: str | Sequence[str | float] | None) -> tuple[float, float, float, float] | None:
    """Four or six numbers, as comma-separated text or as a list; six lose their z pair."""
    if value is None:
        return None
    if not isinstance(value, str) and len(value) == 1 and isinstance(value[0], str):
        value = value[0]
    pieces = value.split(",") if isinstance(value, str) else list(value)
    try:
        numbers = [float(p) for p in pieces]
    except (TypeError, ValueError):
        raise BadRequest("bbox must hold numbers only") from None
    if len(numbers) not in (4, 6):
        raise BadRequest("bbox must have 4 or 6 numbers")
    return tuple(numbers) if len(numbers) == 4 else (numbers[0], numbers[1], numbers[3], numbers[4])


def parse_instant(text: str) -> dt.datetime:
    try:
        value = dt.datetime.fromisoformat(text)
    except ValueError:
        raise BadRequest(f"not an RFC 3339 date and time: {text!r}") from None
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def parse_interval(text: str) -> tuple[dt.datetime | None, dt.datetime | None]:
    """An instant is a closed interval with equal ends; ``..`` and nothing are open ends."""
    start, _, end = text.partition("/") if "/" in text else (text, "", text)
    return tuple(None if t in ("..", "") else parse_instant(t) for t in (start, end))


@dataclasses.dataclass(frozen=True)
class FeatureFilter:
    """One request for features, parsed once and compiled to Spark predicates."""

    bbox: tuple[float, float, float, float] | None = None
    bbox_crs: str | int = 4326
    crs: str | int | None = None
    datetime: str | None = None
    limit: int | None = None
    offset: int = 0
    filter: Mapping | str | None = None
    filter_crs: str | int | None = None
    properties: Mapping[str, object] = dataclasses.field(default_factory=dict)
    returned: Sequence[str] | None = None
    q: str | None = None
    sort_by: str | None = None
    skip_geometry: bool = False
    hits: bool = False
    keep_null_geometry: bool = False

    @classmethod
    def from_params(cls, params: Mapping[str, str | Sequence[str]]) -> FeatureFilter:
        unknown = sorted(set(params) - set(KNOWN_PARAMETERS))
        if unknown:
            raise BadRequest(f"unknown parameters: {', '.join(unknown)}")
        if str(params.get("filter-lang", "cql2-json")) != "cql2-json":
            raise BadRequest("only filter-lang=cql2-json is supported")
        try:
            limit = int(params["limit"]) if "limit" in params else None
            offset = int(params.get("offset", 0))
        except ValueError:
            raise BadRequest("limit and offset must be whole numbers") from None
        if offset < 0 or (limit is not None and limit < 1):
            raise BadRequest("limit must be at least 1 and offset at least 0")
        return cls(
            bbox=parse_bbox(params.get("bbox")),
            bbox_crs=params.get("bbox-crs", 4326),
            crs=params.get("crs"),
            datetime=params.get("datetime"),
            limit=limit,
            offset=offset,
            filter=params.get("filter"),
            filter_crs=params.get("filter-crs"),
            returned=params["properties"].split(",") if params.get("properties") else None,
            q=params.get("q"),
            sort_by=params.get("sortby"),
            skip_geometry=str(params.get("skipGeometry", "")).lower() in TRUTHY,
            hits=params.get("resulttype") == "hits",
        )


# --- predicates -----------------------------------------------------------------------------


def between_instants(column: Column, interval: str) -> Column:
    """Closed interval test with open ends; rows without a time never match."""
    start, end = parse_interval(interval)
    test = column.isNotNull()
    if start is not None:
        test &= column >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    if end is not None:
        test &= column <= F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    return test


def split_at_antimeridian(
    box: tuple[float, float, float, float],
) -> list[tuple[float, float, float, float]]:
    """A geographic box that runs over the antimeridian is the union of two boxes."""
    xmin, ymin, xmax, ymax = box
    if xmin <= xmax:
        return [box]
    return [(xmin, ymin, 180.0, ymax), (-180.0, ymin, xmax, ymax)]


def text_search(columns: Sequence[Column], q: str) -> Column:
    """True if any of the columns holds the text, ignoring case."""
    test = F.lit(False)
    for c in columns:
        test |= F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return test


# --- bulk forms over a table of requests ----------------------------------------------------


def bbox_columns(text: Column) -> dict[str, Column]:
    """Comma-separated boxes to four numbers and a validity flag; six numbers lose z."""
    numbers = F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("double"))
    n = F.size(numbers)
    valid = F.coalesce(n.isin(4, 6) & ~F.exists(numbers, lambda v: v.isNull()), F.lit(False))

    def pick(four: int, six: int) -> Column:
        return F.when(valid, F.when(n == 6, F.get(numbers, F.lit(six))).otherwise(F.get(numbers, F.lit(four))))

    return {
        "xmin": pick(0, 0),
        "ymin": pick(1, 1),
        "xmax": pick(2, 3),
        "ymax": pick(3, 4),
        "is_valid": valid,
    }


def interval_columns(text: Column) -> dict[str, Column]:
    """RFC 3339 instants and intervals to (start, end) and a validity flag."""
    halves = F.split(text, "/", 2)
    first = F.get(halves, F.lit(0))
    last = F.coalesce(F.get(halves, F.lit(1)), first)

    def instant(t: Column) -> Column:
        return F.when(~t.isin("..", ""), t.try_cast("timestamp")).cast("timestamp_ntz")

    def good(t: Column) -> Column:
        return t.isin("..", "") | t.try_cast("timestamp").isNotNull()

    return {
        "start": instant(first),
        "end": instant(last),
        "is_valid": F.coalesce(good(first) & good(last), F.lit(False)),
    }


def unknown_parameters(params: Column, known: Sequence[str] = KNOWN_PARAMETERS) -> Column:
    """The sorted names in a parameter map that are not understood."""
    return F.array_sort(F.array_except(F.map_keys(params), F.array(*[F.lit(k) for k in known])))
