"""Catalogue tables from configuration entries: one JSON text each, checked and typed in bulk.

An entry that cannot be loaded keeps its row, with the reason in ``problem``. Of entries with the same
identifier the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators import crs as C
from featlake.operators import geometry as G
from featlake.operators.jobs import DEPLOYED, FAILED, IN_PROGRESS, QUEUED
from featlake.operators.skew import split_join

# Types of collections, kinds of data that providers give, and deployment statuses.
COLLECTION_TYPES = ("coverage", "feature", "record")
PROVIDED = ("coverage", "edr", "feature", "map", "record", "stac", "tile")
DEPLOYMENTS = (QUEUED, IN_PROGRESS, DEPLOYED, FAILED)

_COLLECTION = """
    identifier string, title string, description string, owner_id string, is_public boolean, type_ string, spatial_extent string,
    crs array<string>, storage_crs string, storage_crs_coordinate_epoch double, custom_page_size int, custom_page_size_max int,
    temporal_extent_begin string, temporal_extent_end string, providers map<string, struct<provider_name: string, config: string>>
"""
_PROCESS = """
    identifier string, title string, owner_id string, is_public boolean, inputs array<string>, outputs array<string>,
    execution_unit struct<type_: string, image: string, definition: string, bindings_inputs: map<string, string>,
    bindings_outputs: map<string, string>>, deployment_status struct<value: string, detail: string, definition_hash: string>
"""


def _read(entries: DataFrame, text: str, position: str, schema: str) -> DataFrame:
    """Parsed entries, of each identifier the last; entries that are no objects have an identifier of null and stay."""
    parsed = entries.select(F.col(position).alias("position"), F.col(text).alias("_text"), F.from_json(text, schema).alias("r"))
    alone = F.coalesce(F.col("r.identifier"), F.concat(F.lit("\u0000"), F.col("position").cast("string")))
    last = parsed.groupBy(alone.alias("_key")).agg(F.max_by(F.struct("position", "_text", "r"), "position").alias("_last"))
    return last.select("_last.position", "_last._text", "_last.r")


def _with_owner(rows: DataFrame, users: DataFrame) -> DataFrame:
    known = users.select(F.col("id").alias("_owner"), F.lit(True).alias("_known"))
    rows = rows.withColumn("_owner", F.col("r.owner_id"))
    return split_join(rows, known, ["_owner"], "left").drop("_owner")


def _common(r: Column) -> Column:
    """The reason why an entry of any kind cannot be loaded."""
    missing = r["identifier"].isNull() | r["title"].isNull() | r["is_public"].isNull() | r["owner_id"].isNull()
    return F.when(r.isNull() | F.try_parse_json("_text").isNull(), "not an entry").when(missing, "a required member is missing").when(
        F.col("_known").isNull(), "unknown owner"
    )


def load_collections(entries: DataFrame, users: DataFrame, text: str = "entry", position: str = "position") -> DataFrame:
    """Collections: identifier, type, owner, bounds of the extent's text, systems, page sizes, times, providers; and ``problem``."""
    r = F.col("r")
    rows = _with_owner(_read(entries, text, position, _COLLECTION), users)
    rows = rows.withColumn("_extent", G.from_wkt(F.col("r.spatial_extent")))
    providers = r["providers"]
    problem = (
        _common(r)
        .when(r["type_"].isNull() | ~r["type_"].isin(*COLLECTION_TYPES), "unknown type")
        .when(r["spatial_extent"].isNotNull() & F.col("_extent").isNull(), "extent is not well-known text")
        .when(F.exists(F.map_keys(providers), lambda k: ~k.isin(*PROVIDED)), "unknown kind of provider")
        .when(F.exists(F.map_values(providers), lambda p: p["provider_name"].isNull() | p["config"].isNull()), "incomplete provider")
    )
    box = G.bounds(F.col("_extent"))
    return rows.select(
        "position", r["identifier"].alias("identifier"), r["type_"].alias("type"), r["title"].alias("title"), r["description"].alias("description"),
        r["owner_id"].alias("owner_id"), r["is_public"].alias("is_public"), *[box[b].alias(b) for b in G.BOUNDS],
        F.coalesce(r["crs"], F.array(F.lit(C.CRS84))).alias("crs"), F.coalesce(r["storage_crs"], F.lit(C.CRS84)).alias("storage_crs"),
        r["storage_crs_coordinate_epoch"].alias("storage_crs_coordinate_epoch"), r["custom_page_size"].alias("custom_page_size"),
        r["custom_page_size_max"].alias("custom_page_size_max"), r["temporal_extent_begin"].try_cast("timestamp").alias("temporal_begin"),
        r["temporal_extent_end"].try_cast("timestamp").alias("temporal_end"), providers.alias("providers"), problem.alias("problem"),
    )


def load_processes(entries: DataFrame, users: DataFrame, text: str = "entry", position: str = "position") -> DataFrame:
    """Processes: identifier, owner, descriptions of inputs and outputs as JSON texts, execution unit, deployment; and ``problem``.

    A process without a recorded deployment counts as failed. An execution unit is of containers or of
    a workflow by its type, and anything else by any other; only the first has bindings.
    """
    r, unit = F.col("r"), F.col("r.execution_unit")
    rows = _with_owner(_read(entries, text, position, _PROCESS), users)
    status = r["deployment_status"]
    is_oci = unit["type_"] == "oci"
    problem = (
        _common(r)
        .when(unit.isNotNull() & unit["type_"].isNull(), "execution unit without a type")
        .when(is_oci & unit["image"].isNull(), "container without an image")
        .when(status.isNotNull() & (status["value"].isNull() | ~status["value"].isin(*DEPLOYMENTS)), "unknown deployment status")
    )
    none, nothing = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    return rows.select(
        "position", r["identifier"].alias("identifier"), r["title"].alias("title"), r["owner_id"].alias("owner_id"), r["is_public"].alias("is_public"),
        F.coalesce(r["inputs"], none).alias("inputs"), F.coalesce(r["outputs"], none).alias("outputs"), unit["type_"].alias("unit_type"),
        unit["image"].alias("image"), unit["definition"].alias("definition"),
        F.when(is_oci, F.coalesce(unit["bindings_inputs"], nothing)).alias("bindings_inputs"),
        F.when(is_oci, F.coalesce(unit["bindings_outputs"], nothing)).alias("bindings_outputs"),
        F.coalesce(status["value"], F.lit(FAILED)).alias("deployment"), status["definition_hash"].alias("definition_hash"),
        problem.alias("problem"),
    )
