"""Queries over point features: filters, lookups, projections and paging."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators import describe as D
from featlake.operators import filters as Fl
from featlake.operators import paging as P
from featlake.operators import projections as Pr
from featlake.operators.filters import FeatureFilter
from featlake.operators.positions import write_positions
from featlake.plans.registry import Tables, query
from featlake.session import scratch_dir
from featlake.sources import geojson as J
from featlake.table import FeatureTable

_R = "(pi() / 180 * 6378137)"


def points(t: Tables) -> FeatureTable:
    return FeatureTable(t.obs, id="seq", x="x", y="y", time="observed_at", title="obs")


def _flat(df: DataFrame, digits: int = 3) -> DataFrame:
    """Replace a point geometry by rounded coordinates, to compare them as plain columns."""
    v = F.col("geom")["parts"][0]["rings"][0][0]
    return df.withColumns({"gx": F.round(v["x"], digits), "gy": F.round(v["y"], digits)}).drop("geom")


_FLAGSHIP = FeatureFilter(
    bbox=(-120.0, -60.0, 120.0, 75.0),
    datetime="2024-01-05T00:00:00Z/2024-01-25T23:59:59Z",
    crs=3857,
    limit=100,
    offset=40,
    returned=["event_type", "value"],
)


@query(
    "list_features",
    f"""
    SELECT id, 'http://www.opengis.net/def/crs/EPSG/0/3857' AS crs, event_type, value,
           round(x * {_R}, 3) AS gx,
           round(ln(tan(pi() / 4 + y * pi() / 360)) * 6378137, 3) AS gy
    FROM obs
    WHERE x BETWEEN -120 AND 120 AND y BETWEEN -60 AND 75
      AND observed_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59'
    ORDER BY seq LIMIT 100 OFFSET 40
    """,
    uses=("obs",),
)
def list_features(t: Tables) -> DataFrame:
    """Filter by box and time, order by id, cut the page, reproject only the page."""
    return _flat(points(t).list_features(_FLAGSHIP))


@query(
    "bbox_datetime",
    """
    SELECT id, x AS gx, y AS gy, event_type FROM obs
    WHERE x BETWEEN -120 AND 120 AND y BETWEEN -60 AND 75
      AND observed_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59'
    """,
    uses=("obs",),
)
def bbox_datetime(t: Tables) -> DataFrame:
    f = FeatureFilter(bbox=_FLAGSHIP.bbox, datetime=_FLAGSHIP.datetime)
    return points(t).select(f).select("id", F.col("x").alias("gx"), F.col("y").alias("gy"), "event_type")


@query(
    "datetime_filter",
    "SELECT id, observed_at FROM obs WHERE observed_at >= TIMESTAMP '2024-01-20 12:00:00'",
    uses=("obs",),
)
def datetime_filter(t: Tables) -> DataFrame:
    """A half-open interval; features without a time never match."""
    return points(t).select(FeatureFilter(datetime="2024-01-20T12:00:00Z/..")).select("id", "observed_at")


@query(
    "bbox_antimeridian",
    "SELECT id, x, y FROM obs WHERE (x >= 170 OR x <= -165) AND y BETWEEN -20 AND 40",
    uses=("obs",),
)
def bbox_antimeridian(t: Tables) -> DataFrame:
    return points(t).select(FeatureFilter(bbox=(170, -20, -165, 40))).select("id", "x", "y")


@query(
    "bbox_keep_null",
    "SELECT id, x, y FROM obs WHERE x IS NULL OR (x BETWEEN 0 AND 30 AND y BETWEEN 0 AND 30)",
    uses=("obs",),
)
def bbox_keep_null(t: Tables) -> DataFrame:
    return points(t).select(FeatureFilter(bbox=(0, 0, 30, 30), keep_null_geometry=True)).select("id", "x", "y")


@query(
    "get_by_id",
    """
    SELECT id, event_type, value FROM obs
    WHERE seq IN (SELECT l_partkey FROM lineitem WHERE l_linenumber <> 7)
    """,
    uses=("obs",),
)
def get_by_id(t: Tables) -> DataFrame:
    """A table of ids as text; text that is no number finds nothing."""
    wanted = t.lineitem.select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x-"), F.col("l_partkey").cast("string")))
        .otherwise(F.col("l_partkey").cast("string"))
        .alias("feature_id")
    )
    f = FeatureFilter(skip_geometry=True, returned=["event_type", "value"])
    return points(t).get_features(wanted, "feature_id", f)


@query(
    "prop_equals",
    "SELECT id, value FROM obs WHERE event_type = 'click' AND stn_id = 17",
    uses=("obs",),
)
def prop_equals(t: Tables) -> DataFrame:
    f = FeatureFilter(properties={"event_type": "click", "stn_id": "17"})
    return points(t).select(f).select("id", "value")


@query(
    "q_search",
    """
    SELECT id, event_type, props FROM obs
    WHERE contains(lower(id), 'k": 9') OR contains(lower(event_type), 'k": 9')
       OR contains(lower(props), 'k": 9')
    """,
    uses=("obs",),
)
def q_search(t: Tables) -> DataFrame:
    return points(t).select(FeatureFilter(q='K": 9')).select("id", "event_type", "props")


@query(
    "sort_by",
    """
    SELECT id, event_type, value FROM obs
    ORDER BY event_type ASC NULLS LAST, value DESC NULLS LAST, seq ASC LIMIT 100 OFFSET 10
    """,
    uses=("obs",),
)
def sort_by(t: Tables) -> DataFrame:
    f = FeatureFilter(sort_by="+event_type,-value", limit=100, offset=10, skip_geometry=True)
    return points(t).list_features(f).select("id", "event_type", "value")


@query("select_props", "SELECT id, value, stn_id FROM obs", uses=("obs",))
def select_props(t: Tables) -> DataFrame:
    """Declared properties that exist; the scan reads nothing else."""
    p = points(t)
    return p.to_features(p.df, FeatureFilter(skip_geometry=True, returned=["value", "nothing", "stn_id"]))


@query(
    "skip_geometry",
    "SELECT id, observed_at, stn_id, event_type, value, props FROM obs",
    uses=("obs",),
)
def skip_geometry(t: Tables) -> DataFrame:
    p = points(t)
    return p.to_features(p.df, FeatureFilter(skip_geometry=True))


_CQL_SCALAR = {
    "op": "or",
    "args": [
        {
            "op": "and",
            "args": [
                {"op": "between", "args": [{"property": "value"}, 10, 60.5]},
                {"op": "in", "args": [{"property": "event_type"}, ["click", "view"]]},
                {"op": "not", "args": [{"op": "isNull", "args": [{"property": "observed_at"}]}]},
            ],
        },
        {"op": "like", "args": [{"property": "props"}, '%"k": 1%']},
        {"op": "=", "args": [{"property": "stn_id"}, "42"]},
    ],
}


@query(
    "cql_scalar",
    """
    SELECT id, value, event_type FROM obs
    WHERE (value BETWEEN 10 AND 60.5 AND event_type IN ('click', 'view') AND observed_at IS NOT NULL)
       OR props LIKE '%"k": 1%' OR stn_id = 42
    """,
    uses=("obs",),
)
def cql_scalar(t: Tables) -> DataFrame:
    return points(t).select(FeatureFilter(filter=_CQL_SCALAR)).select("id", "value", "event_type")


@query(
    "cql_s_intersects",
    "SELECT id, x, y FROM obs WHERE x BETWEEN -30 AND 45.5 AND y BETWEEN -10 AND 60 AND value > 20",
    uses=("obs",),
)
def cql_s_intersects(t: Tables) -> DataFrame:
    document = {
        "op": "and",
        "args": [
            {"op": "s_intersects", "args": [{"property": "geom"}, {"bbox": [-30, -10, 45.5, 60]}]},
            {"op": ">", "args": [{"property": "value"}, 20]},
        ],
    }
    return points(t).select(FeatureFilter(filter=document)).select("id", "x", "y")


@query(
    "cql_temporal",
    """
    SELECT id, observed_at FROM obs
    WHERE observed_at < TIMESTAMP '2024-01-03 00:00:00' OR observed_at > TIMESTAMP '2024-01-28 06:00:00'
       OR (observed_at > TIMESTAMP '2024-01-10 00:00:00' AND observed_at < TIMESTAMP '2024-01-11 00:00:00')
    """,
    uses=("obs",),
)
def cql_temporal(t: Tables) -> DataFrame:
    at = {"property": "observed_at"}
    document = {
        "op": "or",
        "args": [
            {"op": "t_before", "args": [at, {"timestamp": "2024-01-03T00:00:00Z"}]},
            {"op": "t_after", "args": [at, {"timestamp": "2024-01-28T06:00:00Z"}]},
            {"op": "t_during", "args": [at, {"interval": ["2024-01-10T00:00:00Z", "2024-01-11T00:00:00Z"]}]},
        ],
    }
    return points(t).select(FeatureFilter(filter=document)).select("id", "observed_at")


# --- projections ----------------------------------------------------------------------------


@query(
    "project_bag",
    """
    SELECT CAST(event_id AS STRING) AS id, user_id AS stn_id, value FROM events
    """,
)
def project_bag(t: Tables) -> DataFrame:
    """A bag property named like the id is dropped, the others stay."""
    bag = F.create_map(
        F.lit("id"), F.col("value"), F.lit("stn_id"), F.col("user_id").cast("double"), F.lit("value"), F.col("value")
    )
    rows = t.events.select(F.col("event_id").alias("key"), bag.alias("bag"))
    kept = Pr.feature_of_bag(rows, "key", "bag")
    return kept.select("id", F.col("properties")["stn_id"].cast("bigint").alias("stn_id"),
                       F.col("properties")["value"].alias("value")).where(
        ~F.map_contains_key("properties", "id"))


@query(
    "nan_to_null",
    """
    SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS reading FROM events
    """,
)
def nan_to_null(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("reading"),
    )
    return Pr.nan_to_null(rows)


@query(
    "surrogate_id",
    "SELECT concat('events.parquet:', CAST(event_id AS STRING)) AS id, event_type, value FROM events",
)
def surrogate_id(t: Tables) -> DataFrame:
    """An id for files without one: path in the table and row position, stable and without a shuffle."""
    return Pr.with_file_row_id(t.events, root=f"{t.folder}/events.parquet").select("id", "event_type", "value")


# --- counts and paging ----------------------------------------------------------------------


@query(
    "count_items",
    """
    SELECT count(*) FILTER (WHERE x BETWEEN -120 AND 120 AND y BETWEEN -60 AND 75
      AND observed_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59') AS matched,
      count(*) AS total FROM obs
    """,
    uses=("obs",),
)
def count_items(t: Tables) -> DataFrame:
    return points(t).count_items(_FLAGSHIP)


@query("hits", "SELECT count(*) AS matched FROM obs WHERE event_type = 'purchase'", uses=("obs",))
def hits(t: Tables) -> DataFrame:
    f = FeatureFilter.from_params({"resulttype": "hits"})
    f = dataclasses.replace(f, properties={"event_type": "purchase"})
    return points(t).count_items(f).select("matched")


@query(
    "list_total",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM orders",
)
def list_total(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count("*").alias("total"))
    return total.withColumn("pages", P.total_pages(F.col("total"), 20))


@query("page", "SELECT id, event_type FROM obs ORDER BY seq LIMIT 50 OFFSET 120", uses=("obs",))
def page(t: Tables) -> DataFrame:
    return P.page(t.obs, [F.asc("seq")], 50, 120).select("id", "event_type")


@query("page_number", "SELECT id, event_type FROM obs ORDER BY seq LIMIT 25 OFFSET 75", uses=("obs",))
def page_number(t: Tables) -> DataFrame:
    return P.page_number(t.obs, [F.asc("seq")], 4, 25).select("id", "event_type")


@query(
    "page_all",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
           (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 + 1 AS page_number
    FROM orders
    """,
)
def page_all(t: Tables) -> DataFrame:
    """The page of every row of a table, without a window over the whole table."""
    return P.number_pages(t.orders.select("o_orderkey"), "o_orderkey", 20)


@query(
    "page_deep",
    """
    WITH numbered AS (SELECT *, row_number() OVER (ORDER BY observed_at NULLS FIRST, seq) - 1 AS position, count(*) OVER () AS n FROM obs)
    SELECT id, event_type, observed_at, position FROM numbered WHERE position >= n * 9 // 10 AND position < n * 9 // 10 + 50
    """,
    uses=("obs",),
)
def page_deep(t: Tables) -> DataFrame:
    """A page near the end of a listing by time: its offset is looked up, and the slices it lies in are read."""
    stored = write_positions(t.obs.drop("props"), ["observed_at", "seq"], scratch_dir(t.spark, "positions"))
    total = stored.total().first()["total"]
    return stored.page(total * 9 // 10, 50).select("id", "event_type", "observed_at", "position")


@query(
    "page_all_text",
    """
    SELECT id, row_number() OVER (ORDER BY id) - 1 AS position, (row_number() OVER (ORDER BY id) - 1) // 20 + 1 AS page_number
    FROM obs
    """,
    uses=("obs",),
)
def page_all_text(t: Tables) -> DataFrame:
    """The page of every row in the order of its id as text."""
    return write_positions(t.obs.select("id"), ["id"], scratch_dir(t.spark, "positions")).numbered(20)


@query(
    "page_clamp",
    """
    SELECT identifier, CAST(least(coalesce(nullif(created_day * 9, 0), nullif(custom_page_size, 0), 20),
           coalesce(nullif(custom_page_size_max, 0), 100)) AS INT) AS page_limit
    FROM collections
    """,
    uses=("collections",),
)
def page_clamp(t: Tables) -> DataFrame:
    limit = P.clamp_limit_column(
        F.col("created_day").cast("int") * 9, F.col("custom_page_size"), F.col("custom_page_size_max")
    )
    return t.collections.select("identifier", limit.alias("page_limit"))


_LINKS_SQL = """
WITH sized AS (
  SELECT stn_id, count(*) AS matched, (stn_id % 4) * 20 AS off, 20 + stn_id % 3 AS lim FROM obs GROUP BY stn_id)
SELECT stn_id, matched,
  CASE WHEN off > 0 THEN concat('https://example.org/items?offset=', CAST(greatest(off - lim, 0) AS STRING),
    '&limit=', CAST(lim AS STRING)) END AS prev_href,
  CASE WHEN matched > off + lim THEN concat('https://example.org/items?offset=', CAST(off + lim AS STRING),
    '&limit=', CAST(lim AS STRING)) END AS next_href
FROM sized
"""


@query("page_links", _LINKS_SQL, uses=("obs",))
def page_links(t: Tables) -> DataFrame:
    sized = t.obs.groupBy("stn_id").agg(F.count("*").alias("matched"))
    offset, limit = F.col("stn_id") % 4 * 20, F.col("stn_id") % 3 + 20
    links = P.link_columns(
        F.col("matched"), offset, limit, F.lit("https://example.org/items"),
        F.concat(F.lit("limit="), limit.cast("string")),
    )
    return sized.withColumns(links)


# --- requests in bulk -----------------------------------------------------------------------


@query(
    "parse_bbox",
    """
    SELECT id, CASE WHEN id % 5 < 3 THEN xmin END AS xmin, CASE WHEN id % 5 < 3 THEN ymin END AS ymin,
           CASE WHEN id % 5 < 3 THEN xmax END AS xmax, CASE WHEN id % 5 < 3 THEN ymax END AS ymax,
           id % 5 < 3 AS is_valid
    FROM parcels
    """,
    uses=("parcels",),
)
def parse_bbox(t: Tables) -> DataFrame:
    """Boxes as request text: 4 numbers, spaced, 6 numbers, too few numbers, no numbers."""
    text = (
        F.when(F.col("id") % 5 == 0, F.concat_ws(",", "xmin", "ymin", "xmax", "ymax"))
        .when(F.col("id") % 5 == 1, F.concat_ws(" , ", "xmin", "ymin", "xmax", "ymax"))
        .when(F.col("id") % 5 == 2, F.concat_ws(",", "xmin", "ymin", F.lit("0"), "xmax", "ymax", F.lit("9")))
        .when(F.col("id") % 5 == 3, F.concat_ws(",", "xmin", "ymin", "xmax"))
        .otherwise(F.concat_ws(",", "xmin", "ymin", "xmax", F.lit("north")))
    )
    return t.parcels.select("id", text.alias("bbox")).select("id", *[
        c.alias(n) for n, c in Fl.bbox_columns(F.col("bbox")).items()])


@query(
    "parse_datetime",
    """
    SELECT event_id,
      CASE WHEN event_id % 5 IN (0, 1, 2) THEN date_trunc('second', ts) END AS start,
      CASE WHEN event_id % 5 = 0 THEN date_trunc('second', ts)
           WHEN event_id % 5 = 1 THEN date_trunc('second', ts) + INTERVAL 36 HOUR
           WHEN event_id % 5 = 3 THEN date_trunc('second', ts) END AS "end",
      event_id % 5 < 4 AS is_valid
    FROM events
    """,
)
def parse_datetime(t: Tables) -> DataFrame:
    """Instants, closed and half-open intervals, and text that is no time."""
    instant = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    later = F.concat(F.date_format(F.expr("ts + INTERVAL 36 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, instant)
        .when(kind == 1, F.concat_ws("/", instant, later))
        .when(kind == 2, F.concat(instant, F.lit("/..")))
        .when(kind == 3, F.concat(F.lit("../"), instant))
        .otherwise(F.concat(F.lit("soon-"), F.col("event_id").cast("string")))
    )
    parsed = Fl.interval_columns(F.col("text"))
    return t.events.select("event_id", text.alias("text")).select("event_id", *[
        c.alias(n) for n, c in parsed.items()])


@query(
    "unknown_params",
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'colour,' || 'size' WHEN 'view' THEN 'zoom' ELSE '' END AS unknown
    FROM events
    """,
)
def unknown_params(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    value = F.col("value").cast("string")
    params = (
        F.when(kind == "click", F.create_map(F.lit("size"), value, F.lit("bbox"), value, F.lit("colour"), value))
        .when(kind == "view", F.create_map(F.lit("zoom"), value, F.lit("limit"), value))
        .otherwise(F.create_map(F.lit("datetime"), value))
    )
    return t.events.select("event_id", F.array_join(Fl.unknown_parameters(params), ",").alias("unknown"))


# --- documents ------------------------------------------------------------------------------

_FEATURE_TEXT = """concat('{"id":"', id, '","type":"Feature","properties":{"event_type":"', event_type,
  '","stn_id":', CAST(stn_id AS STRING), '},"geometry":',
  CASE WHEN x IS NULL THEN 'null' ELSE concat('{"type":"Point","coordinates":[',
    CASE WHEN x = CAST(x AS BIGINT) THEN CAST(CAST(x AS BIGINT) AS STRING)
         ELSE CAST(CAST(x AS DECIMAL(8,1)) AS STRING) END, ',',
    CASE WHEN y = CAST(y AS BIGINT) THEN CAST(CAST(y AS BIGINT) AS STRING)
         ELSE CAST(CAST(y AS DECIMAL(8,1)) AS STRING) END, ']}') END,
  ',"links":[{"type":"application/geo+json","rel":"self","href":"https://example.org/collections/obs/items/', id,
  '","title":"Details about this feature"}"""
_COLLECTION_LINK = (
    ',{"type":"application/json","rel":"collection","href":"https://example.org/collections/obs",'
    '"title":"This feature\'\'s collection"}'
)


def _documents(t: Tables, rows: DataFrame, with_collection: bool) -> DataFrame:
    document = J.feature_json(
        F.col("id"),
        points(t).geometry,
        F.struct("event_type", "stn_id"),
        F.lit("https://example.org/collections/obs"),
        with_collection=with_collection,
        digits=7,
    )
    return rows.select("seq", "id", document.alias("document"))


@query(
    "geojson_feature",
    f"""SELECT id, {_FEATURE_TEXT}{_COLLECTION_LINK}]}}') AS document FROM obs""",
    uses=("obs",),
)
def geojson_feature(t: Tables) -> DataFrame:
    """One GeoJSON document per feature, over the whole table."""
    return _documents(t, t.obs, True).select("id", "document")


@query(
    "geojson_page",
    f"""
    WITH hit AS (SELECT * FROM obs WHERE x BETWEEN -120 AND 120 AND y BETWEEN -60 AND 75),
    shown AS (SELECT * FROM hit ORDER BY seq LIMIT 20 OFFSET 40)
    SELECT concat('{{"type":"FeatureCollection","features":[',
      (SELECT string_agg({_FEATURE_TEXT}]}}'), ',' ORDER BY seq) FROM shown),
      '],"links":[{{"type":"application/geo+json","rel":"self","href":"https://example.org/collections/obs/items",'
      '"title":"This document"}}],"numberMatched":', CAST((SELECT count(*) FROM hit) AS STRING),
      ',"numberReturned":', CAST((SELECT count(*) FROM shown) AS STRING),
      ',"timeStamp":"2024-01-01T00:00:00Z"}}') AS document
    """,
    uses=("obs",),
)
def geojson_page(t: Tables) -> DataFrame:
    """The document of one page; a page has at most 100 features, so it may meet in one row."""
    table = points(t)
    f = FeatureFilter(bbox=_FLAGSHIP.bbox)
    shown = P.page(table.select(f), [F.asc("seq")], P.clamp_limit(20), 40)
    links = F.array(
        J.link(J.GEOJSON, "self", F.lit("https://example.org/collections/obs/items"), "This document")
    )
    return J.page_json(
        _documents(t, shown, False), "document", "seq", D.counts(table.df, table.predicate(f)), links,
        F.lit("2024-01-01T00:00:00Z"),
    )
