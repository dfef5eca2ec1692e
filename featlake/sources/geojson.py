"""Writing features, pages and collections as GeoJSON and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.functions.text import json_text
from featlake.operators import geometry as G
from featlake.operators.crs import CRS84

GEOJSON, JSON, SCHEMA_JSON = "application/geo+json", "application/json", "application/schema+json"
QUERYABLES_REL = "http://www.opengis.net/def/rel/ogc/1.0/queryables"
SCHEMA_REL = "http://www.opengis.net/def/rel/ogc/1.0/schema"


def link(media_type: str, rel: str, href: Column, title: str | Column | None = None) -> Column:
    """One link as a struct; to_json leaves its null members out."""
    title = title if isinstance(title, Column) else F.lit(title).cast("string")
    return F.struct(
        F.lit(media_type).alias("type"), F.lit(rel).alias("rel"), href.alias("href"), title.alias("title")
    )


def feature_json(
    identifier: Column,
    geom: Column,
    properties: Column,
    base: Column,
    with_collection: bool = True,
    digits: int | None = None,
) -> Column:
    """A feature document. ``base`` is the address of the collection."""
    links = [link(GEOJSON, "self", F.concat(base, F.lit("/items/"), identifier), "Details about this feature")]
    if with_collection:
        links.append(link(JSON, "collection", base, "This feature's collection"))
    return F.concat(
        F.lit('{"id":'),
        json_text(identifier),
        F.lit(',"type":"Feature","properties":'),
        F.to_json(properties, {"ignoreNullFields": "false"}),
        F.lit(',"geometry":'),
        F.coalesce(G.to_geojson(geom, digits), F.lit("null")),
        F.lit(',"links":'),
        F.to_json(F.array(*links)),
        F.lit("}"),
    )


def write_features(documents: DataFrame, column: str, path: str) -> None:
    """Line-delimited GeoJSON, one feature per line, written by all tasks."""
    documents.select(F.col(column).alias("value")).write.text(path)


def page_json(
    page: DataFrame, document: str, order: str, counts: DataFrame, links: Column, timestamp: Column
) -> DataFrame:
    """A feature collection document. Only for one page: its rows meet in a single document."""
    gathered = page.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, document))), lambda r: r[document]), ","
        ).alias("features"),
        F.count("*").alias("returned"),
    )
    return gathered.withColumn("matched", counts.select("matched").scalar()).select(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['),
            F.col("features"),
            F.lit('],"links":'),
            F.to_json(links),
            F.lit(',"numberMatched":'),
            F.col("matched").cast("string"),
            F.lit(',"numberReturned":'),
            F.col("returned").cast("string"),
            F.lit(',"timeStamp":'),
            json_text(timestamp),
            F.lit("}"),
        ).alias("document")
    )


def collection_links(root: Column, identifier: Column) -> Column:
    """The links of a collection document."""
    here = F.concat(root, F.lit("/collections/"), identifier)
    return F.array(
        link(JSON, "self", here, "Collection details"),
        link("text/html", "alternate", here, "Collection details"),
        link(GEOJSON, "items", F.concat(here, F.lit("/items"))),
        link(SCHEMA_JSON, SCHEMA_REL, F.concat(here, F.lit("/schema"))),
        link(SCHEMA_JSON, QUERYABLES_REL, F.concat(here, F.lit("/queryables"))),
    )


def collection_struct(
    root: Column,
    identifier: Column,
    title: Column,
    item_type: Column,
    box: dict[str, Column],
    begin: Column,
    end: Column,
    crs: Column,
    storage_crs: Column,
    description: Column | None = None,
    more_links: Column | None = None,
) -> Column:
    """A collection document as a struct; to_json leaves null members out."""
    links = collection_links(root, identifier)
    if more_links is not None:
        links = F.when(more_links.isNull(), links).otherwise(F.concat(links, more_links))
    spatial = F.when(
        box["xmin"].isNotNull(),
        F.struct(
            F.array(F.array(box["xmin"], box["ymin"], box["xmax"], box["ymax"])).alias("bbox"),
            F.lit(CRS84).alias("crs"),
        ),
    )
    temporal = F.when(
        begin.isNotNull() | end.isNotNull(),
        F.struct(
            F.array(F.array(begin, end)).alias("interval"),
            F.lit("http://www.opengis.net/def/uom/ISO-8601/0/Gregorian").alias("trs"),
        ),
    )
    return F.struct(
        identifier.alias("id"),
        title.alias("title"),
        (F.lit(None).cast("string") if description is None else description).alias("description"),
        links.alias("links"),
        F.struct(spatial.alias("spatial"), temporal.alias("temporal")).alias("extent"),
        item_type.alias("itemType"),
        crs.alias("crs"),
        storage_crs.alias("storageCrs"),
    )
