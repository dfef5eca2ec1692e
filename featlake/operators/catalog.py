"""The catalogue of collections, processes, jobs and users as tables, and its changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.functions.binding import let
from featlake.functions.text import contains_ci
from featlake.operators import crs as C
from featlake.operators import geometry as G
from featlake.operators.skew import split_join

# Provider data types that decide the type of a collection.
COLLECTION_TYPES = {"feature": "feature", "record": "record", "coverage": "coverage", "map": "coverage"}

# Scopes without a resource, and the form of scopes with one.
FIXED_SCOPES = ("admin", "server-metadata:editor", "collection:creator", "process:creator")
SCOPE_PATTERN = r"^(collection|process|job)-(.+):(editor|viewer)$"


# --- rules on single rows -------------------------------------------------------------------


def valid_identifier(identifier: Column) -> Column:
    """3 to 100 characters: a letter, then letters, digits, underscores and hyphens."""
    return F.length(identifier).between(3, 100) & identifier.rlike(r"^[a-zA-Z][\w\-]*$")


def invalid_scopes(scopes: Column) -> Column:
    """The scopes that are neither fixed nor of the form type-identifier:role."""
    return F.filter(scopes, lambda s: ~(s.isin(*FIXED_SCOPES) | s.rlike(SCOPE_PATTERN)))


def with_defaults(df: DataFrame) -> DataFrame:
    """``updated_at`` falls back to ``created_at``, a missing deployment status reads as failed."""
    filled = {}
    if "updated_at" in df.columns:
        filled["updated_at"] = F.coalesce("updated_at", "created_at")
    if "deployment" in df.columns:
        filled["deployment"] = F.coalesce("deployment", F.lit("failed"))
    return df.withColumns(filled)


def extent_of_numbers(numbers: Column) -> Column:
    """A bounds list to an extent: more than five numbers are solid, others flat; null stays null."""
    solid = F.size(numbers) > 5

    def at(flat: int | None, deep: int) -> Column:
        low = F.lit(None).cast("double") if flat is None else F.get(numbers, F.lit(flat))
        return F.when(solid, F.get(numbers, F.lit(deep))).otherwise(low)

    return F.when(
        numbers.isNotNull(),
        F.struct(
            F.when(solid, 6).otherwise(4).alias("n_numbers"),
            at(0, 0).alias("xmin"),
            at(1, 1).alias("ymin"),
            at(None, 2).alias("zmin"),
            at(2, 3).alias("xmax"),
            at(3, 4).alias("ymax"),
            at(None, 5).alias("zmax"),
            F.when(solid, C.CRS84H).otherwise(C.CRS84).alias("crs"),
        ),
    )


# --- listings -------------------------------------------------------------------------------


def catalogue_order(created: str = "created_at") -> list[Column]:
    return [F.asc(created), F.desc_nulls_last("identifier")]


def list_catalogue(
    df: DataFrame,
    identifier_contains: str | None = None,
    identifiers_in: Sequence[str] | None = None,
    types_in: Sequence[str] | None = None,
) -> DataFrame:
    """The common filters of catalogue listings; empty filters do not filter."""
    if identifier_contains:
        df = df.where(contains_ci(F.col("identifier"), identifier_contains))
    if identifiers_in:
        df = df.where(F.col("identifier").isin(list(identifiers_in)))
    if types_in:
        df = df.where(F.col("type").isin(list(types_in)))
    return df


def list_users(
    users: DataFrame, name_contains: str | None = None, is_admin: bool | None = None
) -> DataFrame:
    if name_contains:
        users = users.where(contains_ci(F.col("username"), name_contains))
    if is_admin is not None:
        admin = F.array_contains("scopes", "admin")
        users = users.where(admin if is_admin else ~admin)
    return users.orderBy("username")


def with_owner(df: DataFrame, users: DataFrame, owner: str = "owner_id", prefix: str = "owner") -> DataFrame:
    """Add name and activity of the owner; rows without a known owner keep nulls."""
    names = users.select(
        F.col("id").alias(owner),
        F.col("username").alias(f"{prefix}_name"),
        F.col("is_active").alias(f"{prefix}_active"),
    )
    return df.join(names, owner, "left")


def orphans(df: DataFrame, users: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Rows with an unknown owner; must be empty before a catalogue is loaded."""
    return df.join(users.select(F.col("id").alias(owner)), owner, "left_anti")


def cascade(df: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent still exists; deleting a parent deletes the rows below it."""
    return split_join(df, parents.select(F.col(parent_key).alias(child_key)), [child_key], "left_semi")


def keep_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last record of each key, at the position of its first one.

    Both are mergeable aggregates, so a key with very many records is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(sequence)).alias("_last"), F.min(sequence).alias("position")
    )
    return last.select(key, "position", "_last.*")


# --- changes --------------------------------------------------------------------------------


def apply_changes(
    snapshot: DataFrame,
    changes: DataFrame,
    fields: Sequence[str],
    key: str = "identifier",
    defaults: dict[str, Column] | None = None,
) -> DataFrame:
    """The next snapshot after a log of creates, updates and deletes.

    ``changes`` has ``seq``, ``op``, the key, ``set_fields`` and one column per field. An update
    touches only the fields it sets. Creating what exists and changing what does not exist have no
    effect. ``defaults`` replace nulls that a change sets.

    Only what happens after the last delete of a key matters, and of that only what follows the
    first create if the key was not there. Each step is a mergeable aggregate per key.
    """
    is_delete, is_create = F.col("op") == "delete", F.col("op") == "create"
    deleted = changes.groupBy(key).agg(F.max(F.when(is_delete, F.col("seq"))).alias("_deleted"))
    known = snapshot.select(key, F.lit(True).alias("_known"))
    start = (
        deleted.join(known, key, "left")
        .withColumn("_present", F.col("_known").isNotNull() & F.col("_deleted").isNull())
        .drop("_known")
    )
    live = split_join(changes, start, [key]).where(F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted")))
    created = live.where(is_create & ~F.col("_present")).groupBy(key).agg(F.min("seq").alias("_created"))
    effective = split_join(live, created, [key], "left").where(
        (F.col("_present") & ~is_create)
        | (F.col("seq") == F.col("_created"))
        | (~is_create & (F.col("seq") > F.col("_created")))
    )

    def last_set(field: str) -> Column:
        # A creation sets every field, an update those it names.
        when_set = F.when(is_create | F.array_contains("set_fields", field), F.col("seq"))
        value = F.col(field)
        if defaults and field in defaults:
            value = F.coalesce(value, defaults[field])
        return F.max_by(F.struct(value.alias("value")), when_set).alias(f"_{field}")

    new = effective.groupBy(key).agg(F.max("_created").alias("_created"), *[last_set(f) for f in fields])
    old = snapshot.select(key, *fields, F.lit(True).alias("_old")).join(
        deleted.where(F.col("_deleted").isNotNull()), key, "left_anti"
    )
    merged = old.join(new, key, "full_outer").where(F.col("_old").isNotNull() | F.col("_created").isNotNull())
    return merged.select(
        key,
        *[F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["value"]).otherwise(F.col(f)).alias(f) for f in fields],
    )


def enrich(entries: DataFrame, metrics: DataFrame) -> DataFrame:
    """Fill missing storage CRS, extent and time range from described data; never overwrite."""
    own = set(entries.columns) - {"identifier"}
    renamed = metrics.select(
        "identifier", *[F.col(c).alias(f"_m_{c}") for c in metrics.columns if c != "identifier"]
    )
    joined = entries.join(renamed, "identifier", "left")
    unbounded = F.col("xmin").isNull()
    timeless = F.col("temporal_begin").isNull() & F.col("temporal_end").isNull()
    filled = {b: F.when(unbounded, F.col(f"_m_{b}")).otherwise(F.col(b)) for b in G.BOUNDS}
    for side in ("temporal_begin", "temporal_end"):
        filled[side] = F.when(timeless, F.col(f"_m_{side}")).otherwise(F.col(side))
    found = [F.col("_m_storage_crs")] if "storage_crs" in metrics.columns else []
    filled["storage_crs"] = F.coalesce("storage_crs", *found, F.lit(C.CRS84))
    return joined.withColumns(filled).select("identifier", *sorted(own))


def merge_unit(unit: Column, update: Column) -> Column:
    """An execution unit with the entries of an update put over its own, as flat maps."""
    nothing = F.create_map().cast("map<string,string>")
    base, over = F.coalesce(unit, nothing), F.coalesce(update, nothing)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def merge_documents(document: Column, update: Column) -> Column:
    """A JSON object with the members of an update put over its own; their values may be nested in any way.

    A member that the update names is replaced as a whole, also by null. Text that is no object counts
    as an empty one. Nested objects have their keys sorted.
    """
    kind = "map<string,variant>"

    def members(text: Column) -> Column:
        return F.coalesce(F.from_json(text, kind), F.create_map().cast(kind))

    def merged(base: Column, over: Column) -> Column:
        return F.to_json(F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over))

    return let(merged, members(document), members(update))


# What stands between separators of JSON text, strings whole, and the separator.
_UNTIL_SEPARATOR = r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])'


def canonical_json(fragment: Column) -> Column:
    """A JSON fragment with the keys of all its objects sorted; text that is not JSON stays as it is."""
    compact = F.to_json(F.try_parse_json(fragment))
    return F.coalesce(F.regexp_replace(compact, _UNTIL_SEPARATOR, "$1$2 "), fragment)


def sorted_json(entries: Column) -> Column:
    """A map of JSON fragments as JSON text with sorted keys, also inside the fragments."""
    pairs = F.array_sort(F.map_entries(entries))
    texts = F.transform(
        pairs, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), canonical_json(e["value"]))
    )
    return F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}"))


def definition_hash(unit: Column, inputs: Column, outputs: Column) -> Column:
    """SHA-256 of the parts of a process that decide its deployment (JSON fragments)."""
    return F.sha2(
        sorted_json(
            F.create_map(F.lit("execution_unit"), unit, F.lit("inputs"), inputs, F.lit("outputs"), outputs)
        ),
        256,
    )


def config_key(provider: Column, config: Column) -> Column:
    """The first 16 hex digits of the hash of a source configuration (a JSON fragment)."""
    return F.substring(
        F.sha2(sorted_json(F.create_map(F.lit("provider"), provider, F.lit("config"), config)), 256), 1, 16
    )


# --- import and export ----------------------------------------------------------------------

PROVIDER = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("crs", T.ArrayType(T.StringType())),
        T.StructField("storage_crs", T.StringType()),
        T.StructField("storage_crs_coordinate_epoch", T.DoubleType()),
    ]
)
RESOURCE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField(
            "extents",
            T.StructType(
                [
                    T.StructField(
                        "spatial",
                        T.StructType(
                            [T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("crs", T.StringType())]
                        ),
                    ),
                    T.StructField(
                        "temporal",
                        T.StructType([T.StructField("begin", T.StringType()), T.StructField("end", T.StringType())]),
                    ),
                ]
            ),
        ),
        T.StructField("links", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("providers", T.ArrayType(PROVIDER)),
    ]
)
_NO_PROVIDERS = T.ArrayType(PROVIDER)


def _crs_of_providers(providers: Column) -> Column:
    """Supported systems, storage system and epoch of the providers up to the first where both are known.

    Of several values the last one that is given counts.
    """

    def given(name: str, upto: Column) -> Column:
        values = F.transform(F.slice(providers, F.lit(1), upto), lambda p: p[name])
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))

    def known(upto: Column) -> Column:
        storage, epoch = given("storage_crs", upto), given("storage_crs_coordinate_epoch", upto)
        return (F.coalesce(storage, F.lit("")) != "") & (F.coalesce(epoch, F.lit(0.0)) != 0)

    count = F.size(providers)
    places = F.when(count > 0, F.sequence(F.lit(1), count))
    upto = F.coalesce(F.try_element_at(F.filter(places, known), F.lit(1)), count)
    none = F.array().cast("array<string>")
    listed = F.transform(F.slice(providers, F.lit(1), upto), lambda p: F.coalesce(p["crs"], none))
    found = F.struct(
        F.array_union(F.array(F.lit(C.CRS84)), F.flatten(listed)).alias("crs"),
        given("storage_crs", upto).alias("storage_crs"),
        given("storage_crs_coordinate_epoch", upto).alias("epoch"),
    )
    return F.when(providers.isNotNull(), found)


def import_resources(
    documents: DataFrame, existing: DataFrame, overwrite: bool, key: str = "identifier", text: str = "document"
) -> DataFrame:
    """Nested resource documents to catalogue rows, with what is to be done with each.

    ``action`` is create, update, or rejected for an identifier that exists (unless overwritten)
    and for resources whose providers fit no collection type.
    """
    r = F.col("_r")
    parsed = documents.withColumn("_r", F.from_json(text, RESOURCE))
    providers = F.coalesce(r["providers"], F.array().cast(_NO_PROVIDERS))
    # The first provider of each type wins.
    firsts = F.filter(
        providers,
        lambda p, i: ~F.exists(F.slice(providers, F.lit(1), i), lambda q: q["type"].eqNullSafe(p["type"])),
    )
    supported = F.filter(firsts, lambda p: p["type"].isin(*COLLECTION_TYPES))
    first_type = F.get(supported, F.lit(0))["type"]
    kind = F.lit(None).cast("string")
    for provider, collection in COLLECTION_TYPES.items():
        kind = F.when(first_type == provider, collection).otherwise(kind)
    extent = extent_of_numbers(r["extents"]["spatial"]["bbox"])
    found = F.when(extent.isNotNull(), _crs_of_providers(providers))
    known = existing.select(F.col("identifier").alias(key), F.lit(True).alias("_known"))
    rows = parsed.select(
        key,
        kind.alias("type"),
        F.coalesce(r["title"], F.lit("")).alias("title"),
        r["description"].alias("description"),
        *[extent[b].alias(b) for b in G.BOUNDS],
        F.when(extent.isNotNull(), F.coalesce(r["extents"]["spatial"]["crs"], extent["crs"])).alias("extent_crs"),
        r["extents"]["temporal"]["begin"].alias("temporal_begin"),
        r["extents"]["temporal"]["end"].alias("temporal_end"),
        found["crs"].alias("crs"),
        found["storage_crs"].alias("storage_crs"),
        found["epoch"].alias("storage_crs_coordinate_epoch"),
        r["links"].alias("links"),
        firsts.alias("providers"),
    ).join(known, key, "left")
    action = (
        F.when(F.col("type").isNull(), "rejected")
        .when(F.col("_known").isNotNull(), "update" if overwrite else "rejected")
        .otherwise("create")
    )
    return rows.withColumn("action", action).drop("_known")


def export_resource(
    title: Column,
    description: Column,
    keywords: Column,
    box: dict[str, Column],
    begin: Column,
    end: Column,
    links: Column,
    providers: Column,
    owner: Column,
    page_size: Column,
    page_size_max: Column,
) -> Column:
    """A catalogue row as a resource document, with the world as the extent of unbounded rows."""
    world = F.array(F.lit(-180.0), F.lit(-90.0), F.lit(180.0), F.lit(90.0))
    bbox = F.when(box["xmin"].isNull(), world).otherwise(F.array(*[box[b] for b in G.BOUNDS]))
    limits = F.when(
        page_size.isNotNull() | page_size_max.isNotNull(),
        F.struct(page_size.alias("default_items"), page_size_max.alias("max_items")),
    )
    return F.to_json(
        F.struct(
            F.lit("collection").alias("type"),
            title.alias("title"),
            F.coalesce(description, F.lit("")).alias("description"),
            F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"),
            links.alias("links"),
            F.struct(
                F.struct(bbox.alias("bbox"), F.lit(C.CRS84).alias("crs")).alias("spatial"),
                F.struct(begin.alias("begin"), end.alias("end")).alias("temporal"),
            ).alias("extents"),
            providers.alias("providers"),
            owner.alias("owner"),
            limits.alias("limits"),
        )
    )
