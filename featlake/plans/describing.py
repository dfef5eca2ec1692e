"""Queries that describe collections: extents, types, schema documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.functions import text as X
from featlake.operators import crs as C
from featlake.operators import describe as D
from featlake.operators import geometry as G
from featlake.operators.zonemaps import ZoneMap
from featlake.plans.registry import Tables, query
from featlake.plans.shapes import parcels
from featlake.session import scratch_dir
from featlake.table import FeatureTable

_ISO = (
    "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
    " ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
)


@query(
    "spatial_extent",
    """
    WITH m AS (SELECT x, y, x * (pi() / 180 * 6378137) AS mx,
      ln(tan(pi() / 4 + y * pi() / 360)) * 6378137 AS my FROM obs WHERE abs(y) < 90)
    SELECT round(min(mx), 3) AS xmin, round(min(my), 3) AS ymin, round(max(mx), 3) AS xmax, round(max(my), 3) AS ymax,
      round(min(x), 6) AS west, round(min(y), 6) AS south, round(max(x), 6) AS east, round(max(y), 6) AS north
    FROM m
    """,
    uses=("obs",),
)
def spatial_extent(t: Tables) -> DataFrame:
    """Native and CRS84 extent of a table stored in spherical Mercator."""
    x, y = C.transform_xy(F.col("x"), F.col("y"), 4326, 3857)
    stored = t.obs.select("seq", x.alias("x"), y.alias("y"))
    extent = FeatureTable(stored, id="seq", x="x", y="y", srid=3857).get_spatial_extent()
    digits = {"xmin": 3, "ymin": 3, "xmax": 3, "ymax": 3, "west": 6, "south": 6, "east": 6, "north": 6}
    return extent.select(*[F.round(c, n).alias(c) for c, n in digits.items()])


@query(
    "temporal_extent",
    f"SELECT {_ISO.format('min(observed_at)')} AS temporal_begin, {_ISO.format('max(observed_at)')} AS temporal_end FROM obs",
    uses=("obs",),
)
def temporal_extent(t: Tables) -> DataFrame:
    return FeatureTable(t.obs, id="seq", x="x", y="y", time="observed_at").get_temporal_extent()


@query(
    "temporal_extent_interval",
    f"""
    SELECT {_ISO.format("min(o_orderdate)")} AS temporal_begin,
      {_ISO.format("max(o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)))")} AS temporal_end FROM orders
    """,
)
def temporal_extent_interval(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderdate", F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 400 AS INT))").alias("closed_at")
    )
    return rows.agg(*D.temporal_extent(F.col("o_orderdate"), F.col("closed_at")))


@query(
    "additional_extent",
    """
    SELECT 'stn_id' AS name, CAST(min(stn_id) AS STRING) AS "begin", CAST(max(stn_id) AS STRING) AS "end",
      CAST(NULL AS STRING) AS unit_name FROM obs
    UNION ALL SELECT 'event_type', min(event_type), max(event_type), 'kind' FROM obs
    """,
    uses=("obs",),
)
def additional_extent(t: Tables) -> DataFrame:
    table = FeatureTable(t.obs, id="seq", x="x", y="y")
    return table.get_additional_extents([("stn_id", None), ("event_type", "kind")])


@query(
    "geom_types",
    """
    SELECT grp, CASE count(DISTINCT geom_type) WHEN 1 THEN concat('geometry-', lower(max(geom_type)))
      ELSE 'geometry-any' END AS geometry_format
    FROM (SELECT *, CASE WHEN id % 2 = 0 THEN lower(geom_type) ELSE concat('mixed-', CAST(id % 7 AS STRING)) END AS grp
          FROM parcels) GROUP BY grp
    """,
    uses=("parcels",),
)
def geom_types(t: Tables) -> DataFrame:
    """The one geometry type of each group of features, or any."""
    group = F.when(F.col("id") % 2 == 0, F.lower("geom_type")).otherwise(
        F.concat(F.lit("mixed-"), (F.col("id") % 7).cast("string"))
    )
    kind = F.concat(F.col("geom")["type"], F.when(F.col("id") % 4 == 0, " Z").otherwise(""))
    rows = parcels(t).df.where(F.col("geom").isNotNull())
    name = F.split(kind, " ")[0]
    return rows.groupBy(group.alias("grp")).agg(
        G.schema_format(F.coalesce(D.single_type(name), F.lit("GEOMETRY"))).alias("geometry_format")
    )


_DESCRIBE_SQL = f"""
SELECT collection, count(*) AS n_features, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
  {_ISO.format("min(observed_at)")} AS temporal_begin, {_ISO.format("max(observed_at)")} AS temporal_end,
  CASE WHEN count(x) > 0 THEN 'geometry-point' ELSE 'geometry-any' END AS geometry_format
FROM (SELECT *, concat('col-', CAST(stn_id AS STRING)) AS collection FROM obs) GROUP BY collection
"""


def described(t: Tables) -> DataFrame:
    rows = t.obs.withColumn("collection", F.concat(F.lit("col-"), F.col("stn_id").cast("string")))
    box = {"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")}
    return D.describe(rows, "collection", box, F.col("observed_at"), F.when(F.col("x").isNotNull(), "Point"))


@query("describe_stored", _DESCRIBE_SQL, uses=("obs",))
def describe_stored(t: Tables) -> DataFrame:
    """The same from a map of the table's files, brought up to date when half of them are added."""
    target, at = scratch_dir(t.spark, "observations"), scratch_dir(t.spark, "zones")
    box = {"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")}
    by = F.concat(F.lit("col-"), F.col("stn_id").cast("string"))
    zones = ZoneMap(t.spark, target, at, by, box, F.col("observed_at"), F.when(F.col("x").isNotNull(), "Point"))
    for half in (0, 1):
        t.obs.where(F.col("seq") % 2 == half).write.mode("append").parquet(target)
        zones.refresh()
    return zones.describe()


@query("describe_all", _DESCRIBE_SQL, uses=("obs",))
def describe_all(t: Tables) -> DataFrame:
    """Count, extents and geometry type of every collection in one pass."""
    return described(t)


@query(
    "enrich",
    f"""
    WITH d AS ({_DESCRIBE_SQL})
    SELECT identifier, coalesce(storage_crs, 'http://www.opengis.net/def/crs/OGC/1.3/CRS84') AS storage_crs,
      CASE WHEN c.xmin IS NULL THEN d.xmin ELSE c.xmin END AS xmin,
      CASE WHEN c.xmin IS NULL THEN d.ymin ELSE c.ymin END AS ymin,
      CASE WHEN c.xmin IS NULL THEN d.xmax ELSE c.xmax END AS xmax,
      CASE WHEN c.xmin IS NULL THEN d.ymax ELSE c.ymax END AS ymax,
      CASE WHEN created_day % 2 = 0 THEN '2000-01-01T00:00:00Z' ELSE d.temporal_begin END AS temporal_begin,
      CASE WHEN created_day % 2 = 0 THEN NULL ELSE d.temporal_end END AS temporal_end
    FROM collections c LEFT JOIN d ON d.collection = c.identifier
    """,
    uses=("obs", "collections"),
)
def enrich(t: Tables) -> DataFrame:
    """Fill what the catalogue lacks from the data; what it has stays."""
    from featlake.operators import catalog as K

    begin = F.when(F.col("created_day") % 2 == 0, "2000-01-01T00:00:00Z")
    entries = t.collections.withColumns(
        {"temporal_begin": begin, "temporal_end": F.lit(None).cast("string")}
    )
    filled = K.enrich(entries, described(t).withColumnRenamed("collection", "identifier"))
    return filled.select("identifier", "storage_crs", *G.BOUNDS, "temporal_begin", "temporal_end")


# --- schemas --------------------------------------------------------------------------------


@query(
    "infer_schema",
    """
    WITH bag AS (
      SELECT event_id AS seq, 'k' AS property, 'integer' AS kind FROM events
      UNION ALL SELECT event_id, 'value', 'number' FROM events
      UNION ALL SELECT event_id, 'late', 'boolean' FROM events
      UNION ALL SELECT event_id, 'note', CASE WHEN event_id % 2 = 0 THEN 'string' ELSE 'integer' END FROM events
        WHERE event_type = 'view'
      UNION ALL SELECT event_id, concat('only_', event_type), 'string' FROM events)
    SELECT property, concat('{"type":"', arg_min(kind, seq), '"}') AS schema FROM bag GROUP BY property
    """,
)
def infer_schema(t: Tables) -> DataFrame:
    """Property types of JSON bags: the first value that is not null decides."""
    is_view = F.col("event_type") == "view"
    note = F.when(is_view & (F.col("event_id") % 2 == 0), F.lit('"seen"')).when(
        is_view, F.col("event_id").cast("string")
    )
    bag = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"),
        F.lit(',"value":'), F.col("value").cast("decimal(18,2)").cast("string"),
        F.lit(',"late":'), (F.col("value") > 100).cast("string"),
        F.lit(',"note":'), F.coalesce(note, F.lit("null")),
        F.lit(',"only_'), F.col("event_type"), F.lit('":"x"}'),
    )
    return D.infer_properties(t.events.select("event_id", bag.alias("bag")), "bag", "event_id")


@query(
    "infer_schema_typed",
    """
    SELECT DISTINCT property, schema FROM (
      SELECT 'ts' AS property, '{"type":"string","format":"date-time"}' AS schema FROM events
      UNION ALL SELECT 'day', '{"type":"string","format":"date"}' FROM events
      UNION ALL SELECT 'value', '{"type":"number"}' FROM events UNION ALL SELECT 'late', '{"type":"boolean"}' FROM events
      UNION ALL SELECT 'user_id', '{"type":"integer"}' FROM events UNION ALL SELECT 'event_type', '{"type":"string"}' FROM events
      UNION ALL SELECT 'seen', CASE WHEN (SELECT arg_min(event_id % 2, event_id) FROM events WHERE event_id % 3 <> 0) = 0
        THEN '{"type":"string","format":"date-time"}' ELSE '{"type":"string"}' END FROM events)
    """,
)
def infer_schema_typed(t: Tables) -> DataFrame:
    """Property types of typed bags, with dates and times; one property is a time or a text, whichever comes first."""
    n = F.col("event_id")

    def bag(seen: Column) -> Column:
        return F.to_variant_object(F.struct(
            "ts", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("value"), (F.col("value") > 100).alias("late"), "user_id",
            "event_type", seen.alias("seen"),
        ))

    none = F.lit(None).cast("string")
    rows = t.events.where(n % 2 == 0).select("event_id", bag(F.when(n % 3 != 0, F.col("ts"))).alias("bag"))
    rows = rows.unionByName(t.events.where(n % 2 == 1).select("event_id", bag(F.when(n % 3 != 0, "then").otherwise(none)).alias("bag")))
    return D.infer_properties(rows, "bag", "event_id")


_SPELLED = """
  CASE p_partkey % 16 WHEN 0 THEN 'integer' WHEN 1 THEN 'HUGEINT' WHEN 2 THEN 'Double'
    WHEN 3 THEN concat('DECIMAL(18,', CAST(p_size % 10 AS STRING), ')')
    WHEN 4 THEN concat('VARCHAR(', CAST(p_size AS STRING), ')') WHEN 5 THEN 'TIMESTAMP WITH TIME ZONE'
    WHEN 6 THEN 'TIME' WHEN 7 THEN 'DATE' WHEN 8 THEN 'UUID' WHEN 9 THEN 'BLOB' WHEN 10 THEN 'INTEGER[]'
    WHEN 11 THEN 'LIST(MAP(VARCHAR, DOUBLE))' WHEN 12 THEN 'STRUCT(a INTEGER, b INTEGER[])'
    WHEN 13 THEN 'MAP(VARCHAR, BOOLEAN)' WHEN 14 THEN 'INTERVAL' ELSE p_type END
"""
_FRAGMENT_SQL = """
  CASE p_partkey % 16 WHEN 0 THEN '{"type":"integer"}' WHEN 1 THEN '{"type":"integer"}'
    WHEN 2 THEN '{"type":"number"}' WHEN 3 THEN '{"type":"number"}' WHEN 4 THEN '{"type":"string"}'
    WHEN 5 THEN '{"type":"string","format":"date-time"}' WHEN 6 THEN '{"type":"string","format":"time"}'
    WHEN 7 THEN '{"type":"string","format":"date"}' WHEN 8 THEN '{"type":"string","format":"uuid"}'
    WHEN 9 THEN '{"type":"string","contentEncoding":"base64"}'
    WHEN 10 THEN '{"type":"array","items":{"type":"integer"}}'
    WHEN 11 THEN '{"type":"array","items":{"type":"object","additionalProperties":{"type":"number"}}}'
    WHEN 12 THEN '{"type":"object"}' WHEN 13 THEN '{"type":"object","additionalProperties":{"type":"boolean"}}'
    WHEN 14 THEN '{"type":"string"}' ELSE '{}' END
"""


@query("type_map", f"SELECT p_partkey, {_FRAGMENT_SQL} AS schema FROM part")
def type_map(t: Tables) -> DataFrame:
    """SQL type names of a column catalogue to JSON-Schema fragments."""
    return t.part.select("p_partkey", D.type_name_schema(F.expr(_SPELLED)).alias("schema"))


def _column_catalogue(t: Tables) -> DataFrame:
    """The columns of every collection: an id, a geometry and two parts it is made of."""
    kind = F.when(F.col("s_suppkey") % 2 == 0, "POLYGON Z").otherwise("POINT")
    srid = F.when(F.col("s_suppkey") % 3 == 0, 3857).otherwise(4326)

    def column(position: int, name: Column, type_name: Column, role: str | None = None) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            name.alias("property"),
            type_name.alias("type_name"),
            F.lit(role).cast("string").alias("role"),
        )

    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    columns = F.array(
        column(0, F.lit("id"), F.lit("BIGINT"), "id"),
        column(1, F.lit("name"), F.concat(F.lit("VARCHAR("), key, F.lit(")"))),
        column(2, F.concat(F.lit("m_"), nation), F.lit("DOUBLE[]")),
        column(3, F.lit("geom"), kind, "primary-geometry"),
    )
    return t.supplier.select("s_suppkey", "s_name", srid.alias("srid"), F.inline(columns))


_DOC_HEAD = '{"$schema":"https://json-schema.org/draft/2020-12/schema",'


@query(
    "schema_doc",
    f"""
    SELECT s_suppkey, concat('{_DOC_HEAD}"$id":"https://example.org/collections/', CAST(s_suppkey AS STRING),
      '/schema","type":"object","title":"', s_name,
      '","properties":{{"id":{{"type":"integer","x-ogc-role":"id"}},"name":{{"type":"string"}},"m_',
      CAST(s_nationkey AS STRING), '":{{"type":"array","items":{{"type":"number"}}}},"geom":{{"format":"',
      CASE WHEN s_suppkey % 2 = 0 THEN 'geometry-polygon' ELSE 'geometry-point' END,
      '","x-ogc-role":"primary-geometry"',
      CASE WHEN s_suppkey % 3 = 0 THEN ',"x-ogc-srs":"http://www.opengis.net/def/crs/EPSG/0/3857"' ELSE '' END,
      '}}}}}}') AS document
    FROM supplier
    """,
)
def schema_doc(t: Tables) -> DataFrame:
    """The schema document of every collection; a collection has few columns, so they may meet."""
    fragment = D.type_name_schema(F.col("type_name"))
    fragment = (
        F.when(F.col("role") == "id", D.with_role(fragment, "id"))
        .when(F.col("role") == "primary-geometry", D.geometry_fragment(F.col("type_name"), F.col("srid")))
        .otherwise(fragment)
    )
    return _documents(t, fragment, F.col("s_name"), F.lit(True), "/schema")


@query(
    "queryables",
    f"""
    SELECT s_suppkey, concat('{_DOC_HEAD}"$id":"https://example.org/collections/', CAST(s_suppkey AS STRING),
      '/queryables","type":"object","title":"Queryables',
      '","properties":{{"id":{{"type":"integer"}},"name":{{"type":"string"}},"m_',
      CAST(s_nationkey AS STRING), '":{{"type":"array","items":{{"type":"number"}}}}}}}}') AS document
    FROM supplier
    """,
)
def queryables(t: Tables) -> DataFrame:
    """The queryables document of every collection: all columns but the geometry."""
    is_geometry = F.coalesce(F.col("role") == "primary-geometry", F.lit(False))
    return _documents(t, D.type_name_schema(F.col("type_name")), F.lit("Queryables"), ~is_geometry, "/queryables")


def _documents(t: Tables, fragment: Column, title: Column, keep: Column, tail: str) -> DataFrame:
    rows = _column_catalogue(t).where(keep)
    gathered = rows.groupBy("s_suppkey").agg(
        F.array_sort(F.collect_list(F.struct("position", "property", fragment.alias("schema")))).alias("columns"),
        F.max(title).alias("title"),
    )
    address = F.concat(F.lit("https://example.org/collections/"), F.col("s_suppkey").cast("string"), F.lit(tail))
    return gathered.select(
        "s_suppkey", D.schema_document(F.col("title"), F.col("columns"), address).alias("document")
    )


# --- small values of catalogue rows ---------------------------------------------------------


@query(
    "extent_from_bbox",
    """
    SELECT identifier, CASE WHEN xmin IS NULL THEN NULL WHEN created_day % 2 = 0 THEN 6 ELSE 4 END AS n_numbers,
      CASE WHEN xmin IS NULL THEN NULL WHEN created_day % 2 = 0 THEN 'http://www.opengis.net/def/crs/OGC/0/CRS84h'
        ELSE 'http://www.opengis.net/def/crs/OGC/1.3/CRS84' END AS crs,
      xmin, xmax, CASE WHEN created_day % 2 = 0 AND xmin IS NOT NULL THEN CAST(created_day AS DOUBLE) END AS zmin
    FROM collections
    """,
    uses=("collections",),
)
def extent_from_bbox(t: Tables) -> DataFrame:
    """Bounds lists of four or six numbers to flat or solid extents."""
    from featlake.operators import catalog as K

    z = F.col("created_day").cast("double")
    numbers = F.when(
        F.col("created_day") % 2 == 0, F.array("xmin", "ymin", z, "xmax", "ymax", z + 1)
    ).otherwise(F.array(*G.BOUNDS))
    listed = t.collections.select("identifier", F.when(F.col("xmin").isNotNull(), numbers).alias("numbers"))
    e = K.extent_of_numbers(F.col("numbers"))
    return listed.select("identifier", e["n_numbers"].alias("n_numbers"), e["crs"].alias("crs"),
                         e["xmin"].alias("xmin"), e["xmax"].alias("xmax"), e["zmin"].alias("zmin"))


@query(
    "localized",
    """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('it ', p_name)
      WHEN 2 THEN concat('fr ', p_name) END AS title FROM part
    """,
)
def localized(t: Tables) -> DataFrame:
    """Titles in Italian, else in their first language, else as plain text."""

    def entry(lang: str):
        return F.struct(F.lit(lang).alias("lang"), F.concat(F.lit(f"{lang} "), F.col("p_name")).alias("text"))

    kind = F.col("p_partkey") % 4
    entries = F.when(kind == 1, F.array(entry("fr"), entry("it"))).when(kind == 2, F.array(entry("fr"), entry("en")))
    plain = F.when(kind == 0, F.col("p_name"))
    return t.part.select("p_partkey", X.localized(entries, plain, "it").alias("title"))


@query(
    "link_header",
    """
    SELECT page_id, concat('<', url, '>; rel="item"; type="text/html"',
      CASE WHEN page_id % 3 = 0 THEN concat('; title="page ', CAST(page_id AS STRING), '"') ELSE '' END,
      '; hreflang="', CASE WHEN page_id % 2 = 0 THEN 'en' ELSE 'fr' END, '"',
      CASE WHEN length(html) > 0 THEN concat('; length="', CAST(length(html) AS STRING), '"') ELSE '' END) AS header
    FROM pages
    """,
)
def link_header(t: Tables) -> DataFrame:
    title = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("page "), F.col("page_id").cast("string")))
    language = F.when(F.col("page_id") % 2 == 0, "en").otherwise("fr")
    header = X.link_header(
        F.col("url"), F.lit("item"), F.lit("text/html"), title=title, hreflang=language, length=F.length("html")
    )
    return t.pages.select("page_id", header.alias("header"))
