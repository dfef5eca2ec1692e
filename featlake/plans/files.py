"""Queries over sources: every table is written in a format and read back as features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators import geometry as G
from featlake.operators.filters import FeatureFilter
from featlake.plans.features import points
from featlake.plans.registry import Tables, query
from featlake.plans.shapes import _SIX_SQL, _summary, _wkt_text, parcel_geometry
from featlake.session import scratch_dir
from featlake.sources import readers as S
from featlake.table import FeatureTable


def _xy(df: DataFrame) -> DataFrame:
    v = F.col("geom")["parts"][0]["rings"][0][0]
    return df.withColumns({"gx": v["x"], "gy": v["y"]}).drop("geom")


@query("src_wkt", _SIX_SQL, uses=("parcels",))
def src_wkt(t: Tables) -> DataFrame:
    """Configured rows with well-known text."""
    return _summary(S.inline_wkt(t.parcels.select("id", _wkt_text().alias("geometry"))))


@query(
    "src_geojson_inline",
    """
    SELECT id, CASE WHEN stn_id % 2 = 0 THEN 'EPSG/0/4326' ELSE 'http://www.opengis.net/def/crs/OGC/1.3/CRS84' END AS crs,
      event_type, value, x AS gx, y AS gy FROM obs
    """,
    uses=("obs",),
)
def src_geojson_inline(t: Tables) -> DataFrame:
    """Documents with a list of features each; some features have no geometry, some use WKT."""
    geom = G.point(F.col("x"), F.col("y"))
    text = F.when(F.col("seq") % 2 == 0, G.to_geojson(geom))
    feature = F.concat(
        F.lit('{"id":"'), F.col("id"), F.lit('","geometry":'), F.coalesce(text, F.lit("null")),
        F.lit(',"wkt":'),
        F.coalesce(F.concat(F.lit('"'), F.when(F.col("seq") % 2 == 1, G.to_wkt(geom, None)), F.lit('"')), F.lit("null")),
        F.lit(',"properties":'), F.to_json(F.struct("event_type", "value")), F.lit("}"),
    )
    # One document per station and time slice keeps every document small.
    document = F.concat(
        F.lit('{"crs":'),
        F.when(F.col("stn_id") % 2 == 0, '"EPSG/0/4326"').otherwise("null"),
        F.lit(',"features":['), feature, F.lit("]}"),
    )
    rows = S.inline_geojson(t.obs.select(document.alias("document")), "document", "event_type:string,value:double")
    return _xy(rows)


@query(
    "src_parquet",
    "SELECT id, event_type, x, y FROM obs WHERE event_type IN ('click', 'view') AND x BETWEEN -60 AND 80 AND y BETWEEN -30 AND 30",
    uses=("obs",),
)
def src_parquet(t: Tables) -> DataFrame:
    """Hive partitions read by a glob; the partition and box filters prune files."""
    target = scratch_dir(t.spark, "parquet")
    t.obs.write.partitionBy("event_type").parquet(target)
    rows = S.read_parquet(t.spark, f"{target}/event_type=*", base_path=target)
    table = FeatureTable(rows, id="seq", x="x", y="y")
    f = FeatureFilter(bbox=(-60, -30, 80, 30), filter={"op": "in", "args": [{"property": "event_type"}, ["click", "view"]]})
    return table.select(f).select("id", "event_type", "x", "y")


@query(
    "src_parquet_stored",
    """
    SELECT id, geom_type FROM parcels
    WHERE xmin <= 20 AND xmax >= -20 AND ymin <= 10 AND ymax >= -10 AND (geom_type <> 'LineString'
      OR (least((xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (-20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (-20 - xmin),
                (xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (20 - xmin)) <= 0
      AND greatest((xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (-20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (-20 - xmin),
                (xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (20 - xmin)) >= 0))
    """,
    uses=("parcels",),
)
def src_parquet_stored(t: Tables) -> DataFrame:
    """Features stored with bounds in cell order, and a box filter on what is stored."""
    target = scratch_dir(t.spark, "stored")
    S.write_feature_parquet(t.parcels.withColumn("geom", parcel_geometry()), target)
    stored = FeatureTable(S.read_parquet(t.spark, target), id="id", geom="geom")
    return stored.select(FeatureFilter(bbox=(-20, -10, 20, 10))).select("id", "geom_type")


@query(
    "src_geoparquet",
    """
    SELECT id, geom_type, 'ok' AS state, xmin AS west, CASE geom_type WHEN 'Point' THEN ymin ELSE ymax END AS north FROM parcels
    WHERE xmin <= 20 AND xmax >= -20 AND ymin <= 10 AND ymax >= -10 AND (geom_type <> 'LineString'
      OR (least((xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (-20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (-20 - xmin),
                (xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (20 - xmin)) <= 0
      AND greatest((xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (-20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (-20 - xmin),
                (xmax - xmin) * (-10 - ymin) - (ymax - ymin) * (20 - xmin), (xmax - xmin) * (10 - ymin) - (ymax - ymin) * (20 - xmin)) >= 0))
    UNION ALL SELECT -id, geom_type, 'truncated', NULL, NULL FROM parcels WHERE id % 97 = 0
    """,
    uses=("parcels",),
)
def src_geoparquet(t: Tables) -> DataFrame:
    """Binary geometries with covering boxes: those in a box, decoded after the filter; and blobs that are cut off."""
    target, cut = scratch_dir(t.spark, "geoparquet"), scratch_dir(t.spark, "cut")
    S.write_geoparquet(t.parcels.withColumn("geom", parcel_geometry()), target)
    stored = S.read_geoparquet(t.spark, target, "id")
    found = stored.select(FeatureFilter(bbox=(-20, -10, 20, 10)))
    blobs = t.spark.read.parquet(target).where("id % 97 = 0")
    shorter = F.substring("geometry", 1, F.octet_length("geometry") - 3)
    blobs.select((-F.col("id")).alias("id"), "geom_type", shorter.alias("geometry")).write.parquet(cut)
    bad = S.read_geoparquet(t.spark, cut, "id").df
    box = G.bounds(F.col("geometry"))
    state = F.coalesce("geometry_error", F.lit("ok")).alias("state")
    columns = ["id", "geom_type", state, box["xmin"].alias("west"), box["ymax"].alias("north")]
    return found.select(*columns).unionByName(bad.select(*columns))


@query(
    "src_registered",
    "SELECT id, event_type, x, y FROM obs WHERE x BETWEEN -35 AND 50 AND y BETWEEN -10 AND 40",
    uses=("obs",),
)
def src_registered(t: Tables) -> DataFrame:
    """A source of another kind, opened by its name: the box reaches it, and it reads the tiles that meet it."""
    target = scratch_dir(t.spark, "tiles")
    grid = {"tile_x": F.floor(F.col("x") / 30), "tile_y": F.floor(F.col("y") / 30)}
    t.obs.drop("props", "observed_at").withColumns(grid).repartition("tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").parquet(target)
    table = S.open_table(t.spark, "tiles", {"path": target, "size": "30"}, id="seq", x="x", y="y")
    return table.select(FeatureFilter(bbox=(-35, -10, 50, 40))).select("id", "event_type", "x", "y")


@query("src_csv", "SELECT id, event_type, value FROM obs", uses=("obs",))
def src_csv(t: Tables) -> DataFrame:
    target = scratch_dir(t.spark, "csv")
    t.obs.select("id", "event_type", "value").write.option("header", True).csv(target)
    return S.read_csv(t.spark, target, schema="id string, event_type string, value double")


@query("src_csv_xy", "SELECT seq, event_type, x AS gx, y AS gy FROM obs", uses=("obs",))
def src_csv_xy(t: Tables) -> DataFrame:
    """Coordinate columns found by name pattern, separator and types detected."""
    target = scratch_dir(t.spark, "csv-xy")
    rows = t.obs.select("seq", F.col("x").alias("Longitude"), F.col("y").alias("latitude"), "event_type")
    rows.write.option("header", True).option("sep", "|").csv(target)
    read = S.read_csv(t.spark, target)
    return _xy(read.withColumn("seq", F.col("seq").cast("bigint"))).select("seq", "event_type", "gx", "gy")


@query(
    "src_geojson",
    """
    SELECT id, event_type, stn_id AS place__station, value AS place__reading__value, x AS gx, y AS gy FROM obs
    """,
    uses=("obs",),
)
def src_geojson(t: Tables) -> DataFrame:
    """Line-delimited GeoJSON with nested properties, flattened by a separator."""
    target = scratch_dir(t.spark, "geojson")
    from featlake.sources import geojson as J

    reading = F.struct(F.col("value").alias("value"))
    place = F.struct(F.col("stn_id").alias("station"), reading.alias("reading"))
    document = J.feature_json(
        F.col("id"), points(t).geometry, F.struct("event_type", place.alias("place")), F.lit("https://example.org/obs")
    )
    J.write_features(t.obs.select(document.alias("document")), "document", target)
    read = S.read_geojson(t.spark, target)
    return _xy(read).select(
        "id", "event_type", F.col("place__station").cast("bigint").alias("place__station"),
        F.col("place__reading__value").cast("double").alias("place__reading__value"), "gx", "gy",
    )


@query(
    "src_geojson_document",
    "SELECT id, event_type, stn_id AS station, x AS gx, y AS gy FROM obs",
    uses=("obs",),
)
def src_geojson_document(t: Tables) -> DataFrame:
    """One document with all features, read in byte ranges; other lists of objects are passed over."""
    target = scratch_dir(t.spark, "document")
    from featlake.sources import geojson as J

    note = F.when(F.col("seq") % 3 == 0, 'a "} , {\\" [').otherwise("plain")
    feature = J.feature_json(
        F.col("id"), points(t).geometry, F.struct("event_type", F.col("stn_id").alias("station"), note.alias("note")),
        F.lit("https://example.org/obs"),
    )
    last = t.obs.agg(F.max("seq")).scalar()
    lines = t.obs.select((F.col("seq") + 1).alias("at"), F.concat(feature, F.when(F.col("seq") < last, ",").otherwise("")).alias("value"))
    head, tail = '{"type":"FeatureCollection","links":[{"href":"x","features":[{}]}],"features":[', '],"note":"}]","features_of":[{"a":1}]}'
    frame = t.spark.createDataFrame([(-1, head), (2**62, tail)], "at long, value string")
    # A document is one file, and its lines are in order, with blanks for line feeds.
    whole = lines.unionByName(frame).coalesce(1).sortWithinPartitions("at").select("value")
    whole.write.option("lineSep", " ").text(target)
    read = S.read_geojson(t.spark, target, lines=False)
    return _xy(read).select("id", "event_type", F.col("station").cast("bigint").alias("station"), "gx", "gy")


@query(
    "src_sql",
    "SELECT id, x, y, value * 2 AS doubled FROM obs WHERE event_type = 'signup' AND x BETWEEN 0 AND 90 AND y BETWEEN 0 AND 45",
    uses=("obs",),
)
def src_sql(t: Tables) -> DataFrame:
    """Any statement as a source; the request's box is added to its own conditions."""
    t.obs.createOrReplaceTempView("featlake_obs")
    statement = "SELECT id, seq, x, y, value * 2 AS doubled FROM featlake_obs WHERE event_type = 'signup'"
    table = FeatureTable(S.read_sql(t.spark, statement), id="seq", x="x", y="y")
    return table.select(FeatureFilter(bbox=(0, 0, 90, 45))).select("id", "x", "y", "doubled")


@query(
    "extract_bbox",
    """
    SELECT id, status, (SELECT count(*) FROM parcels WHERE xmin BETWEEN -40 AND 60 AND ymin BETWEEN -20 AND 35) AS n_rows
    FROM parcels WHERE xmin BETWEEN -40 AND 60 AND ymin BETWEEN -20 AND 35
    """,
    uses=("parcels",),
)
def extract_bbox(t: Tables) -> DataFrame:
    """The part of a stored dataset inside a window, written as Parquet and counted on the way."""
    source = scratch_dir(t.spark, "dataset")
    nested = t.parcels.select("id", "status", F.struct(*G.BOUNDS).alias("bbox"))
    nested.write.partitionBy("status").parquet(source)
    kept, n = S.extract(t.spark.read.parquet(source), (-40, -20, 60, 35), scratch_dir(t.spark, "extract"))
    return kept.select("id", "status", F.lit(n).cast("bigint").alias("n_rows"))
