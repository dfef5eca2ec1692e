"""Queries on catalogue records: filters, joins, changes, import and export, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators import catalog as K
from featlake.operators import configuration as Cf
from featlake.operators import geometry as G
from featlake.operators import jobs as Jb
from featlake.operators import snapshots as Sn
from featlake.operators.skew import split_join
from featlake.plans import derived
from featlake.plans.access import _GRANTS_SQL, users
from featlake.plans.registry import Tables, query
from featlake.session import scratch_dir
from featlake.sources import geojson as J
from featlake.streaming import runs as R
from featlake.streaming.deployments import deployment_verdicts, last_verdicts

_CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"

# --- filters and lookups --------------------------------------------------------------------


@query(
    "ident_contains",
    "SELECT identifier, title FROM processes WHERE contains(lower(identifier), 'c-1')",
    uses=("processes",),
)
def ident_contains(t: Tables) -> DataFrame:
    return K.list_catalogue(t.processes, identifier_contains="C-1").select("identifier", "title")


@query(
    "ident_in",
    "SELECT identifier, status FROM jobs WHERE identifier IN ('job-1', 'job-77', 'job-1200', 'job-x')",
    uses=("jobs",),
)
def ident_in(t: Tables) -> DataFrame:
    wanted = ["job-1", "job-77", "job-1200", "job-x"]
    return K.list_catalogue(t.jobs, identifiers_in=wanted).select("identifier", "status")


@query(
    "type_in",
    "SELECT identifier, type FROM collections WHERE type IN ('coverage', 'record')",
    uses=("collections",),
)
def type_in(t: Tables) -> DataFrame:
    return K.list_catalogue(t.collections, types_in=["coverage", "record"]).select("identifier", "type")


@query(
    "valid_ident",
    "SELECT p_partkey, p_partkey % 5 IN (1, 4) AS is_valid FROM part",
)
def valid_ident(t: Tables) -> DataFrame:
    """Names with spaces, good ones, ones that start with a digit, short ones, ones with a hyphen."""
    key, n = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    name = (
        F.when(n == 0, F.col("p_name"))
        .when(n == 1, F.concat(F.lit("part_"), key))
        .when(n == 2, F.concat(key, F.lit("-part")))
        .when(n == 3, F.lit("p"))
        .otherwise(F.concat(F.col("p_type"), F.lit("-"), key))
    )
    return t.part.select("p_partkey", K.valid_identifier(name).alias("is_valid"))


@query(
    "with_owner",
    """
    SELECT j.identifier, jo.username AS owner_name, p.identifier AS process, po.username AS process_owner_name
    FROM jobs j LEFT JOIN processes p ON p.identifier = j.process_identifier
    LEFT JOIN accounts jo ON jo.id = j.owner_id LEFT JOIN accounts po ON po.id = p.owner_id
    """,
    uses=("jobs", "processes", "accounts"),
)
def with_owner(t: Tables) -> DataFrame:
    """Jobs with their owner, their process and the owner of the process."""
    owned = K.with_owner(t.processes.select("identifier", "owner_id"), users(t), prefix="process_owner")
    parents = owned.select(F.col("identifier").alias("process_identifier"), "process_owner_name")
    rows = split_join(K.with_owner(t.jobs, users(t)), parents, ["process_identifier"], "left")
    return rows.select(
        "identifier", "owner_name", F.col("process_identifier").alias("process"), "process_owner_name"
    )


@query(
    "collection_detail",
    f"""
    WITH {_GRANTS_SQL}
    SELECT c.identifier, a.username AS owner, c.is_public, c.title,
      CASE WHEN xmin IS NULL THEN NULL ELSE concat('POLYGON ((', {
        ", ', ', ".join(
            f"CAST(CAST({x} AS BIGINT) AS STRING), ' ', CAST(CAST({y} AS BIGINT) AS STRING)"
            for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))
        )
    }, '))') END AS extent,
      (SELECT count(*) FROM held h WHERE h.resource_type = 'collection' AND h.resource_id = c.identifier
        AND h.role = 'editor') AS n_editors,
      (SELECT count(*) FROM held h WHERE h.resource_type = 'collection' AND h.resource_id = c.identifier
        AND h.role = 'viewer') AS n_viewers
    FROM collections c LEFT JOIN accounts a ON a.id = c.owner_id
    """,
    uses=("collections", "accounts"),
)
def collection_detail(t: Tables) -> DataFrame:
    """Detail rows; members are counted here and listed by ``grants``."""
    from featlake.operators import access as A

    held = A.grants(users(t)).where(F.col("resource_type") == "collection")
    members = held.groupBy(F.col("resource_id").alias("identifier")).agg(
        F.count_if(F.col("role") == "editor").alias("n_editors"),
        F.count_if(F.col("role") == "viewer").alias("n_viewers"),
    )
    box = G.box(*[F.col(b) for b in G.BOUNDS])
    rows = K.with_owner(t.collections, users(t)).join(members, "identifier", "left")
    return rows.select(
        "identifier",
        F.col("owner_name").alias("owner"),
        "is_public",
        "title",
        F.when(F.col("xmin").isNotNull(), G.to_wkt(box)).alias("extent"),
        F.coalesce("n_editors", F.lit(0)).alias("n_editors"),
        F.coalesce("n_viewers", F.lit(0)).alias("n_viewers"),
    )


@query(
    "catalog_defaults",
    """
    SELECT identifier, coalesce(deployment, 'failed') AS deployment,
      CASE WHEN size % 3 = 0 THEN size ELSE 100 END AS updated_at FROM processes
    """,
    uses=("processes",),
)
def catalog_defaults(t: Tables) -> DataFrame:
    rows = t.processes.select(
        "identifier", "deployment", F.lit(100).alias("created_at"),
        F.when(F.col("size") % 3 == 0, F.col("size")).alias("updated_at"),
    )
    return K.with_defaults(rows).drop("created_at")


@query(
    "cat_orphan_owner",
    """
    SELECT identifier, owner_id FROM (SELECT identifier,
      concat('user-', CAST(seq AS STRING)) AS owner_id FROM jobs) WHERE owner_id NOT IN (SELECT id FROM accounts)
    """,
    uses=("jobs", "accounts"),
)
def cat_orphan_owner(t: Tables) -> DataFrame:
    """Rows that name an owner who is not there."""
    rows = t.jobs.select("identifier", F.concat(F.lit("user-"), F.col("seq").cast("string")).alias("owner_id"))
    return K.orphans(rows, users(t)).select("identifier", "owner_id")


@query(
    "cascade_delete",
    """
    WITH users_left AS (SELECT id FROM accounts WHERE is_active),
    processes_left AS (SELECT identifier FROM processes WHERE owner_id IN (SELECT id FROM users_left))
    SELECT identifier, status FROM jobs WHERE owner_id IN (SELECT id FROM users_left)
      AND process_identifier IN (SELECT identifier FROM processes_left)
    """,
    uses=("jobs", "processes", "accounts"),
)
def cascade_delete(t: Tables) -> DataFrame:
    """Removing users removes their processes and, below both, their jobs."""
    users_left = users(t).where("is_active")
    processes_left = K.cascade(t.processes, users_left, "owner_id", "id")
    jobs_left = K.cascade(t.jobs, users_left, "owner_id", "id")
    return K.cascade(jobs_left, processes_left, "process_identifier", "identifier").select("identifier", "status")


@query(
    "keep_last",
    """
    SELECT user_id, min(event_id) AS position, arg_max(event_type, event_id) AS event_type,
      arg_max(value, event_id) AS value FROM events GROUP BY user_id
    """,
)
def keep_last(t: Tables) -> DataFrame:
    """Repeated ids: the last record, at the position of the first."""
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    return K.keep_last(rows, "user_id", "event_id").drop("event_id")


@query(
    "latest_status",
    """
    SELECT job_identifier, to_status, ts FROM transitions
    QUALIFY row_number() OVER (PARTITION BY job_identifier ORDER BY ts DESC, seq DESC) = 1
    """,
    uses=("transitions",),
)
def latest_status(t: Tables) -> DataFrame:
    last = F.max_by(F.struct("to_status", "ts"), F.struct("ts", "seq")).alias("last")
    return t.transitions.groupBy("job_identifier").agg(last).select("job_identifier", "last.*")


# --- changes --------------------------------------------------------------------------------

_LOG = """
  SELECT o_orderkey AS seq, concat('col-', CAST(CAST(floor(o_custkey / 14) AS BIGINT) AS STRING)) AS identifier,
    CASE WHEN o_orderkey % 97 = 5 THEN 'delete' WHEN o_orderkey % 13 = 4 THEN 'create' ELSE 'update' END AS op,
    o_orderpriority AS title,
    CASE WHEN o_orderkey % 2 = 0 THEN 'record' ELSE 'feature' END AS type,
    CASE WHEN o_orderkey % 5 <> 0 THEN concat('http://www.opengis.net/def/crs/EPSG/0/', CAST(o_orderkey AS STRING))
    END AS storage_crs, o_orderkey % 4 AS mask FROM orders
"""


_APPLIED_SQL = f"""
    WITH log AS ({_LOG}),
    span AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY identifier) AS deleted FROM log),
    live AS (SELECT s.*, c.identifier IS NOT NULL AND deleted IS NULL AS present
      FROM span s LEFT JOIN collections c ON c.identifier = s.identifier WHERE deleted IS NULL OR seq > deleted),
    born AS (SELECT *, min(CASE WHEN op = 'create' AND NOT present THEN seq END) OVER (PARTITION BY identifier) AS created FROM live),
    eff AS (SELECT * FROM born WHERE (present AND op = 'update') OR seq = created OR (op = 'update' AND seq > created)),
    new AS (SELECT identifier, max(created) AS created,
      max(CASE WHEN op = 'create' OR mask IN (1, 3) THEN seq END) AS title_at,
      max(CASE WHEN op = 'create' OR mask >= 2 THEN seq END) AS crs_at,
      max(CASE WHEN op = 'create' OR mask = 0 THEN seq END) AS type_at FROM eff GROUP BY identifier),
    gone AS (SELECT DISTINCT identifier FROM log WHERE op = 'delete'),
    old AS (SELECT * FROM collections WHERE identifier NOT IN (SELECT identifier FROM gone))
    SELECT coalesce(o.identifier, n.identifier) AS identifier,
      CASE WHEN title_at IS NULL THEN o.title ELSE (SELECT title FROM log WHERE seq = title_at) END AS title,
      CASE WHEN type_at IS NULL THEN o.type ELSE (SELECT type FROM log WHERE seq = type_at) END AS type,
      CASE WHEN crs_at IS NULL THEN o.storage_crs
        ELSE coalesce((SELECT storage_crs FROM log WHERE seq = crs_at), '{_CRS84}') END AS storage_crs
    FROM old o FULL JOIN new n ON n.identifier = o.identifier WHERE o.identifier IS NOT NULL OR created IS NOT NULL
"""


@query("apply_changes", _APPLIED_SQL, uses=("collections",))
def apply_changes(t: Tables) -> DataFrame:
    """A log of creates, partial updates and deletes put over the catalogue."""
    return K.apply_changes(t.collections, _change_log(t), _CHANGED, defaults={"storage_crs": F.lit(_CRS84)})


_CHANGED = ["title", "type", "storage_crs"]


def _change_log(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("*", "o_orderkey % 4 AS mask")
    return rows.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("col-"), F.floor(F.col("o_custkey") / 14).cast("string")).alias("identifier"),
        F.when(F.col("o_orderkey") % 97 == 5, "delete").when(F.col("o_orderkey") % 13 == 4, "create")
        .otherwise("update").alias("op"),
        F.array_compact(F.array(
            F.when(F.col("mask").isin(1, 3), "title"),
            F.when(F.col("mask") >= 2, "storage_crs"),
            F.when(F.col("mask") == 0, "type"),
        )).alias("set_fields"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 2 == 0, "record").otherwise("feature").alias("type"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(
            F.lit("http://www.opengis.net/def/crs/EPSG/0/"), F.col("o_orderkey").cast("string"))).alias("storage_crs"),
    )


@query("apply_changes_stored", _APPLIED_SQL, uses=("collections",))
def apply_changes_stored(t: Tables) -> DataFrame:
    """The same over a stored catalogue: the buckets that the log touches are rewritten, the others stay."""
    target = scratch_dir(t.spark, "snapshot")
    stored = Sn.store(t.collections.select("identifier", *_CHANGED), "identifier", target)
    return stored.apply(_change_log(t), {"storage_crs": F.lit(_CRS84)}).read()


@query(
    "unit_merge",
    """
    SELECT identifier, CASE WHEN size % 4 = 0 THEN '' ELSE 'oci' END AS type_,
      CASE WHEN size % 3 = 0 THEN concat(image, ':new') WHEN size % 4 = 0 THEN '' ELSE image END AS image,
      CASE WHEN size % 2 = 0 THEN CAST(size AS STRING) WHEN size % 4 = 0 THEN '' ELSE '1' END AS config_cpus
    FROM processes
    """,
    uses=("processes",),
)
def unit_merge(t: Tables) -> DataFrame:
    """Execution units after updates that name some of their entries."""
    unit = F.when(
        F.col("size") % 4 != 0,
        F.create_map(F.lit("type_"), F.lit("oci"), F.lit("image"), F.col("image"), F.lit("config_cpus"), F.lit("1")),
    )
    update = F.map_filter(
        F.create_map(
            F.lit("image"),
            F.when(F.col("size") % 3 == 0, F.concat("image", F.lit(":new"))),
            F.lit("config_cpus"),
            F.when(F.col("size") % 2 == 0, F.col("size").cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    merged = t.processes.select("identifier", K.merge_unit(unit, update).alias("unit"))
    entries = ("type_", "image", "config_cpus")
    return merged.select("identifier", *[F.coalesce(F.col("unit")[e], F.lit("")).alias(e) for e in entries])


@query(
    "unit_merge_nested",
    """
    SELECT identifier, CASE WHEN size % 3 = 0 THEN concat(image, ':new') ELSE image END AS image,
      CASE size % 4 WHEN 0 THEN concat('{"y":{"position":', CAST(size AS STRING), ',"prefix":"--', identifier, '"}}')
        WHEN 1 THEN NULL ELSE '{"x":{"position":1,"shell_quote":true}}' END AS inputs,
      CASE size % 4 WHEN 1 THEN TRUE ELSE FALSE END AS unbound,
      CASE WHEN size % 5 = 0 THEN concat('[', CAST(size AS STRING), ',{"at":"}"}]') END AS volumes
    FROM processes
    """,
    uses=("processes",),
)
def unit_merge_nested(t: Tables) -> DataFrame:
    """Execution units with nested bindings: what an update names is replaced as a whole, also by null."""
    size, flag = F.col("size"), F.lit(True)
    binding = F.struct(F.lit(1).alias("position"), flag.alias("shell_quote"))
    unit = F.to_json(F.struct(F.lit("oci").alias("type_"), "image", F.struct(binding.alias("x")).alias("bindings_inputs")))
    other = F.struct(F.struct(F.concat(F.lit("--"), "identifier").alias("prefix"), size.alias("position")).alias("y"))
    parts = [
        F.when(size % 3 == 0, F.concat(F.lit('"image":"'), "image", F.lit(':new"'))),
        F.when(size % 4 == 0, F.concat(F.lit('"bindings_inputs":'), F.to_json(other))).when(size % 4 == 1, F.lit('"bindings_inputs":null')),
        F.when(size % 5 == 0, F.concat(F.lit('"volumes":['), size.cast("string"), F.lit(',{"at":"}"}]'))),
    ]
    update = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    merged = t.processes.select("identifier", K.merge_documents(unit, update).alias("unit"))
    at = lambda name: F.get_json_object("unit", f"$.{name}")
    return merged.select(
        "identifier", at("image").alias("image"), at("bindings_inputs").alias("inputs"), F.contains("unit", F.lit('"bindings_inputs":null')).alias("unbound"),
        at("volumes").alias("volumes"),
    )


def _unit_json() -> Column:
    return F.concat(F.lit('{"image": "'), F.col("image"), F.lit('", "type_": "oci"}'))


def _inputs_json() -> Column:
    return F.concat(F.lit('[{"identifier": "'), F.col("definition"), F.lit('"}]'))


_HASH_SQL = """sha256(concat('{"execution_unit": {"image": "', image, '", "type_": "oci"}, "inputs": [{"identifier": "',
  definition, '"}], "outputs": []}'))"""


@query("definition_hash", f"SELECT identifier, {_HASH_SQL} AS hash FROM processes", uses=("processes",))
def definition_hash(t: Tables) -> DataFrame:
    return t.processes.select(
        "identifier", K.definition_hash(_unit_json(), _inputs_json(), F.lit("[]")).alias("hash")
    )


@query(
    "config_hash",
    """
    SELECT page_id, substr(sha256(concat('{"config": {"source": "', url, '"}, "provider": "duckdb"}')), 1, 16) AS key
    FROM pages
    """,
)
def config_hash(t: Tables) -> DataFrame:
    config = F.concat(F.lit('{"source": "'), F.col("url"), F.lit('"}'))
    return t.pages.select("page_id", K.config_key(F.lit('"duckdb"'), config).alias("key"))


# --- import and export ----------------------------------------------------------------------


def _resource_documents(t: Tables) -> DataFrame:
    """Nested resource documents, one per customer, of which some are in the catalogue already."""
    key = F.col("c_custkey")

    def provider(kind: Column, name: str, crs: Column, storage: Column, epoch: Column) -> Column:
        return F.struct(
            kind.alias("type"), F.lit(name).alias("name"), F.col("c_name").alias("data"), crs.alias("crs"),
            storage.alias("storage_crs"), epoch.alias("storage_crs_coordinate_epoch"),
        )

    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    kind = F.when(key % 5 == 0, "tile").when(key % 5 == 1, "map").when(key % 5 == 2, "record").otherwise("feature")
    providers = F.array(
        provider(kind, "first", F.array(F.lit("crs-a"), F.lit("crs-b")), F.when(key % 2 == 0, "store-1"), F.lit(2020.5)),
        provider(kind, "second", F.array(F.lit("crs-b"), F.lit("crs-c")), F.lit("store-2"), F.lit(None).cast("double")),
        provider(F.lit("stac"), "third", no_list, none, F.lit(None).cast("double")),
    )
    box = F.when(key % 7 == 0, F.lit(None).cast("array<double>")).otherwise(
        F.array(*[(key % 50 + d).cast("double") for d in (0, 1, 10, 11)])
    )
    extents = F.struct(
        F.struct(box.alias("bbox")).alias("spatial"),
        F.struct(F.lit("2020-01-01T00:00:00Z").alias("begin")).alias("temporal"),
    )
    document = F.to_json(F.struct(F.col("c_name").alias("title"), extents.alias("extents"), providers.alias("providers")))
    return t.customer.select(
        F.concat(F.lit("col-"), key.cast("string")).alias("identifier"), document.alias("document")
    )


@query(
    "cat_import",
    f"""
    WITH c AS (SELECT c_custkey AS k, c_name, concat('col-', CAST(c_custkey AS STRING)) AS identifier FROM customer)
    SELECT identifier, c_name AS title,
      CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'coverage' WHEN 2 THEN 'record' ELSE 'feature' END AS type,
      CASE WHEN k % 7 <> 0 THEN CAST(k % 50 AS DOUBLE) END AS xmin,
      CASE WHEN k % 7 <> 0 THEN CAST(k % 50 + 11 AS DOUBLE) END AS ymax,
      CASE WHEN k % 7 = 0 THEN '' WHEN k % 2 = 0 THEN '{_CRS84},crs-a,crs-b' ELSE '{_CRS84},crs-a,crs-b,crs-c' END AS crs,
      CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 'store-1' ELSE 'store-2' END AS storage_crs,
      CASE WHEN k % 7 <> 0 THEN CAST(2020.5 AS DOUBLE) END AS epoch,
      CASE WHEN k % 5 = 0 THEN 'tile:first,stac:third' WHEN k % 5 = 1 THEN 'map:first,stac:third'
        WHEN k % 5 = 2 THEN 'record:first,stac:third' ELSE 'feature:first,stac:third' END AS providers,
      CASE WHEN k % 5 = 0 THEN 'rejected' WHEN identifier IN (SELECT identifier FROM collections) THEN 'update'
        ELSE 'create' END AS action
    FROM c
    """,
    uses=("collections",),
)
def cat_import(t: Tables) -> DataFrame:
    rows = K.import_resources(_resource_documents(t), t.collections, overwrite=True)
    names = F.transform("providers", lambda p: F.concat(p["type"], F.lit(":"), p["name"]))
    return rows.select(
        "identifier", "title", "type", "xmin", "ymax",
        F.coalesce(F.array_join("crs", ","), F.lit("")).alias("crs"), "storage_crs",
        F.col("storage_crs_coordinate_epoch").alias("epoch"), F.array_join(names, ",").alias("providers"), "action",
    )


def _number(c: str) -> str:
    return f"CAST(CAST({c} AS BIGINT) AS STRING), '.0'"


@query(
    "cat_export",
    f"""
    SELECT identifier, concat('{{"type":"collection","title":"', title, '","description":"","keywords":[],"links":[],',
      '"extents":{{"spatial":{{"bbox":[',
      CASE WHEN xmin IS NULL THEN '-180.0,-90.0,180.0,90.0' ELSE
        concat({", ',', ".join(_number(b) for b in G.BOUNDS)}) END,
      '],"crs":"{_CRS84}"}},"temporal":{{}}}},"providers":[{{"type":"', type,
      '","name":"GeoJSON","data":"', identifier, '.geojson"}}],"owner":"', owner_id, '"',
      CASE WHEN custom_page_size IS NULL AND custom_page_size_max IS NULL THEN '' ELSE concat(',"limits":{{',
        concat_ws(',', CASE WHEN custom_page_size IS NOT NULL THEN concat('"default_items":', CAST(custom_page_size AS STRING)) END,
          CASE WHEN custom_page_size_max IS NOT NULL THEN concat('"max_items":', CAST(custom_page_size_max AS STRING)) END), '}}') END,
      '}}') AS document
    FROM collections
    """,
    uses=("collections",),
)
def cat_export(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    provider = F.struct(
        F.col("type").alias("type"),
        F.lit("GeoJSON").alias("name"),
        F.concat("identifier", F.lit(".geojson")).alias("data"),
    )
    document = K.export_resource(
        title=F.col("title"), description=none, keywords=F.lit(None).cast("array<string>"),
        box={b: F.col(b) for b in G.BOUNDS}, begin=none, end=none, links=F.array().cast("array<string>"),
        providers=F.array(provider), owner=F.col("owner_id"),
        page_size=F.col("custom_page_size"), page_size_max=F.col("custom_page_size_max"),
    )
    return t.collections.select("identifier", document.alias("document"))


def _link_sql(media: str, rel: str, tail: str, title: str | None) -> str:
    shown = f',"title":"{title}"' if title else ""
    return (
        f"""'{{"type":"{media}","rel":"{rel}","href":"https://example.org/collections/', identifier, """
        f"""'{tail}"{shown}}}'"""
    )


_LINKS = ", ',', ".join(
    [
        _link_sql(J.JSON, "self", "", "Collection details"),
        _link_sql("text/html", "alternate", "", "Collection details"),
        _link_sql(J.GEOJSON, "items", "/items", None),
        _link_sql(J.SCHEMA_JSON, J.SCHEMA_REL, "/schema", None),
        _link_sql(J.SCHEMA_JSON, J.QUERYABLES_REL, "/queryables", None),
    ]
)


@query(
    "collection_json",
    f"""
    SELECT identifier, concat('{{"id":"', identifier, '","title":"', title, '","links":[', {_LINKS}, '],"extent":{{',
      concat_ws(',', CASE WHEN xmin IS NOT NULL THEN concat('"spatial":{{"bbox":[[',
        {", ',', ".join(_number(b) for b in G.BOUNDS)}, ']],"crs":"{_CRS84}"}}') END,
        CASE WHEN created_day > 10 THEN
          '"temporal":{{"interval":[["2024-01-01T00:00:00Z",null]],"trs":"http://www.opengis.net/def/uom/ISO-8601/0/Gregorian"}}' END),
      '}},"itemType":"', type, '","crs":["{_CRS84}"]',
      CASE WHEN storage_crs IS NULL THEN '' ELSE concat(',"storageCrs":"', storage_crs, '"') END, '}}') AS document
    FROM collections
    """,
    uses=("collections",),
)
def collection_json(t: Tables) -> DataFrame:
    """The JSON document of every collection; empty members are left out."""
    begin = F.when(F.col("created_day") > 10, "2024-01-01T00:00:00Z")
    document = J.collection_struct(
        F.lit("https://example.org"), F.col("identifier"), F.col("title"), F.col("type"),
        {b: F.col(b) for b in G.BOUNDS}, begin, F.lit(None).cast("string"),
        F.array(F.lit(_CRS84)), F.col("storage_crs"),
    )
    return t.collections.select("identifier", F.to_json(document).alias("document"))


# --- jobs and deployments -------------------------------------------------------------------


@query(
    "job_admission",
    f"""
    WITH {_GRANTS_SQL},
    checked AS (SELECT l_orderkey, l_linenumber, q.user_id, q.process, p.owner_id AS process_owner,
        CASE WHEN p.identifier IS NULL THEN 'not found'
          WHEN NOT coalesce(p.is_public OR a.user_id IS NOT NULL OR p.owner_id = q.user_id OR EXISTS (
            SELECT 1 FROM held h WHERE h.user_id = q.user_id AND h.resource_type = 'process'
              AND h.resource_id = q.process), FALSE) THEN 'not permitted'
          WHEN coalesce(p.deployment, 'failed') <> 'deployed' THEN 'not deployed' END AS reason
      FROM questions q LEFT JOIN processes p ON p.identifier = q.process LEFT JOIN admins a ON a.user_id = q.user_id)
    SELECT l_orderkey, l_linenumber, user_id, process, reason, CASE WHEN reason IS NULL THEN 'accepted' END AS status,
      CASE WHEN reason IS NULL THEN coalesce(user_id, process_owner) END AS owner_id,
      CASE WHEN reason IS NULL THEN user_id IS NULL END AS is_public
    FROM checked
    """,
    uses=("questions", "processes", "accounts"),
)
def job_admission(t: Tables) -> DataFrame:
    """Requests for jobs: the job row, or why there is none."""
    asked = t.questions.select("l_orderkey", "l_linenumber", "user_id", "process")
    return Jb.admit(asked, t.processes, users(t))


_RUN_SQL = """
WITH RECURSIVE ordered AS (
  SELECT *, row_number() OVER (PARTITION BY job_identifier ORDER BY ts, seq) AS n FROM transitions),
run AS (
  SELECT job_identifier, CAST(0 AS BIGINT) AS n, CAST(NULL AS STRING) AS status, CAST(NULL AS TIMESTAMP) AS created_at,
    CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at, CAST(NULL AS INT) AS progress,
    CAST(0 AS BIGINT) AS n_rejected, FALSE AS moved, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS seq
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT job_identifier, n, CASE WHEN ok THEN to_status ELSE status END,
    CASE WHEN ok AND to_status = 'accepted' THEN new_ts ELSE created_at END,
    CASE WHEN ok AND to_status = 'running' THEN new_ts ELSE started_at END,
    CASE WHEN ok AND to_status IN ('successful', 'failed', 'dismissed') THEN new_ts ELSE finished_at END,
    CASE WHEN ok THEN least(greatest(new_progress, 0), 100) ELSE progress END,
    n_rejected + CASE WHEN ok THEN 0 ELSE 1 END, ok, new_ts, new_seq
  FROM (SELECT r.job_identifier, o.n, r.status, r.created_at, r.started_at, r.finished_at, r.progress, r.n_rejected,
      o.to_status, o.ts AS new_ts, o.seq AS new_seq, o.progress AS new_progress,
      coalesce((o.to_status = 'accepted' AND r.status IS NULL) OR (o.to_status = 'running' AND r.status = 'accepted')
        OR (o.to_status IN ('successful', 'failed') AND r.status = 'running')
        OR (o.to_status = 'dismissed' AND r.status IN ('accepted', 'running')), FALSE) AS ok
    FROM run r JOIN ordered o ON o.job_identifier = r.job_identifier AND o.n = r.n + 1))
"""


@query(
    "job_transitions",
    _RUN_SQL
    + """
SELECT job_identifier, status, created_at, started_at, finished_at, progress, n_rejected FROM run
QUALIFY row_number() OVER (PARTITION BY job_identifier ORDER BY n DESC) = 1
""",
    uses=("transitions",),
)
def job_transitions(t: Tables) -> DataFrame:
    """Requested changes to the status of every job; the SQL replays them one by one."""
    return Jb.job_status(Jb.fold_job_changes(t.transitions))


_MESSAGED = {
    "message": "CASE event_id % 3 WHEN 0 THEN NULL ELSE concat('change ', CAST(event_id AS STRING)) END",
    "exception": "CASE WHEN event_type = 'purchase' THEN concat('{\"type\":\"error\",\"status\":', CAST(event_id AS STRING), '}') END",
}


@query(
    "job_messages",
    _RUN_SQL
    + f"""
, said AS (SELECT event_id, {", ".join(f"{text} AS {name}" for name, text in _MESSAGED.items())} FROM events)
SELECT r.job_identifier, arg_max(r.status, r.n) AS status, arg_max(message, r.n) FILTER (message IS NOT NULL) AS message,
  arg_max(exception, r.n) FILTER (exception IS NOT NULL) AS exception
FROM run r JOIN said ON said.event_id = r.seq WHERE r.moved GROUP BY r.job_identifier
""",
    uses=("transitions",),
)
def job_messages(t: Tables) -> DataFrame:
    """The message and the exception that jobs have after their steps; refused changes leave none."""
    columns = derived.DERIVED["transitions"][1]
    log = t.events.selectExpr(*columns, *[f"{text} AS {name}" for name, text in _MESSAGED.items()])
    found = Jb.job_status(Jb.fold_job_changes(log)).where("status IS NOT NULL")
    return found.select("job_identifier", "status", "message", "exception")


_N = "(l_orderkey * 7 + l_linenumber)"
_BODY = f"""CASE {_N} % 7 WHEN 0 THEN NULL
  WHEN 1 THEN concat('{{"inputs":{{"a":', CAST({_N} AS STRING), ',"b":"x"}},"outputs":{{"out":{{"transmissionMode":"reference"}}}},"response":"document"}}')
  WHEN 2 THEN concat('{{"outputs":{{"out":{{"format":"text/csv"}},"log":{{}}}},"subscriber":{{"successUri":"https://e.org/', CAST({_N} AS STRING), '","failedUri":"https://e.org/f"}}}}')
  WHEN 3 THEN '{{"response":"html"}}' WHEN 4 THEN '{{"subscriber":{{"failedUri":"x"}}}}'
  WHEN 5 THEN '{{"outputs":{{"out":{{"transmissionMode":"pigeon"}}}}}}' ELSE 'no json' END"""


@query(
    "job_rows",
    f"""
    WITH {_GRANTS_SQL},
    checked AS (SELECT l_orderkey, l_linenumber, q.user_id, q.process, p.owner_id AS process_owner, {_N} % 7 AS k, {_N} AS n,
        CASE {_N} % 7 WHEN 3 THEN 'unknown response' WHEN 4 THEN 'subscriber without success uri' WHEN 5 THEN 'unknown transmission mode'
          WHEN 6 THEN 'not a request' ELSE CASE WHEN p.identifier IS NULL THEN 'not found'
          WHEN NOT coalesce(p.is_public OR a.user_id IS NOT NULL OR p.owner_id = q.user_id OR EXISTS (
            SELECT 1 FROM held h WHERE h.user_id = q.user_id AND h.resource_type = 'process'
              AND h.resource_id = q.process), FALSE) THEN 'not permitted'
          WHEN coalesce(p.deployment, 'failed') <> 'deployed' THEN 'not deployed' END END AS reason
      FROM questions q LEFT JOIN processes p ON p.identifier = q.process LEFT JOIN admins a ON a.user_id = q.user_id)
    SELECT l_orderkey, l_linenumber, process, reason, CASE WHEN reason IS NULL THEN 'accepted' END AS status,
      CASE WHEN reason IS NULL THEN coalesce(user_id, process_owner) END AS owner_id,
      CASE WHEN reason IS NULL THEN 'ogc-api-processes' END AS processing_entity_type,
      CASE WHEN reason IS NULL THEN CASE k WHEN 1 THEN 'document' ELSE 'raw' END END AS response_type,
      CASE WHEN reason IS NULL THEN CASE k WHEN 1 THEN concat('{{"a":', CAST(n AS STRING), ',"b":"x"}}') ELSE '{{}}' END END AS inputs,
      CASE WHEN reason IS NULL THEN CASE k WHEN 1 THEN 'out:any:reference' WHEN 2 THEN 'log:any:value out:text/csv:value' ELSE '' END END AS outputs,
      CASE WHEN reason IS NULL AND k = 2 THEN concat('https://e.org/', CAST(n AS STRING)) END AS success_uri,
      CASE WHEN reason IS NULL AND k = 2 THEN 'https://e.org/f' END AS failed_uri
    FROM checked
    """,
    uses=("questions", "processes", "accounts"),
)
def job_rows(t: Tables) -> DataFrame:
    """Execute requests with bodies: whole job rows with inputs, outputs and callbacks, or why there is none."""
    rows = Jb.job_rows(t.questions.withColumn("body", F.expr(_BODY)), t.processes, users(t))
    one = F.transform(
        F.array_sort(F.map_entries("outputs")),
        lambda e: F.concat_ws(":", e["key"], F.coalesce(e["value"]["format"], F.lit("any")), e["value"]["transmission_mode"]),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "process", "reason", "status", "owner_id", "processing_entity_type", "response_type", "inputs",
        F.array_join(one, " ").alias("outputs"), F.col("callback_uris.success_uri").alias("success_uri"),
        F.col("callback_uris.failed_uri").alias("failed_uri"),
    )


@query(
    "job_status_changed",
    _RUN_SQL + "SELECT job_identifier, ts, seq, status FROM run WHERE moved",
    uses=("transitions",),
)
def job_status_changed(t: Tables) -> DataFrame:
    return Jb.status_changes(Jb.fold_job_changes(t.transitions))


_DEPLOY_LOG = """
  SELECT concat('proc-', CAST(user_id AS STRING)) AS process_identifier, event_id AS seq, ts,
    CASE WHEN event_type IN ('signup', 'click') THEN 'in-progress' WHEN event_type = 'view' THEN 'deployed'
      WHEN event_type = 'purchase' THEN 'failed' ELSE 'in-progress' END AS to_value,
    concat('h', CAST(CASE WHEN event_id % 9 = 0 THEN user_id + 1 ELSE user_id END AS STRING)) AS definition_hash
  FROM events
"""


_DEPLOY_RUN_SQL = f"""
WITH RECURSIVE log AS ({_DEPLOY_LOG}),
    ordered AS (SELECT l.*, coalesce(p.deployment, 'failed') AS start,
        concat('h', substr(l.process_identifier, 6)) AS hash,
        row_number() OVER (PARTITION BY l.process_identifier ORDER BY ts, seq) AS n
      FROM log l JOIN processes p ON p.identifier = l.process_identifier),
    run AS (
      SELECT process_identifier, CAST(0 AS BIGINT) AS n, start AS value, CAST(NULL AS TIMESTAMP) AS changed_at,
        CAST(0 AS BIGINT) AS n_applied, CAST(0 AS BIGINT) AS n_stale,
        CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS STRING) AS to_value, CAST(NULL AS STRING) AS verdict FROM ordered WHERE n = 1
      UNION ALL
      SELECT process_identifier, n, CASE WHEN ok THEN to_value ELSE value END, CASE WHEN ok THEN ts ELSE changed_at END,
        n_applied + CASE WHEN ok THEN 1 ELSE 0 END, n_stale + CASE WHEN stale THEN 1 ELSE 0 END,
        seq, ts, to_value, CASE WHEN ok THEN 'applied' WHEN stale THEN 'stale outcome' WHEN to_value = 'in-progress'
          THEN 'already in progress' ELSE 'not in progress' END
      FROM (SELECT r.process_identifier, o.n, o.seq, o.to_value, o.ts, r.value, r.changed_at, r.n_applied, r.n_stale,
          o.to_value <> 'in-progress' AND o.definition_hash <> o.hash AS stale,
          CASE WHEN o.to_value = 'in-progress' THEN r.value <> 'in-progress'
            ELSE r.value = 'in-progress' AND o.definition_hash = o.hash END AS ok
        FROM run r JOIN ordered o ON o.process_identifier = r.process_identifier AND o.n = r.n + 1))
"""


@query(
    "deploy_transitions",
    _DEPLOY_RUN_SQL
    + """
    SELECT process_identifier, value, changed_at, n_applied, n_stale, n AS n_changes FROM run
    QUALIFY row_number() OVER (PARTITION BY process_identifier ORDER BY n DESC) = 1
    """,
    uses=("processes",),
)
def deploy_transitions(t: Tables) -> DataFrame:
    """Claims and outcomes of deployments; the SQL replays them one by one."""
    return Jb.fold_deployments(_deploy_log(t.events), _deployed_processes(t))


def _deploy_log(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('proc-', CAST(user_id AS STRING)) AS process_identifier", "event_id AS seq", "ts",
        "CASE event_type WHEN 'view' THEN 'deployed' WHEN 'purchase' THEN 'failed' ELSE 'in-progress' END AS to_value",
        "concat('h', CAST(CASE WHEN event_id % 9 = 0 THEN user_id + 1 ELSE user_id END AS STRING)) AS definition_hash",
    )


def _deployed_processes(t: Tables) -> DataFrame:
    return t.processes.withColumn("definition_hash", F.concat(F.lit("h"), F.substring("identifier", 6, 20)))


@query(
    "deploy_steps_streamed",
    _DEPLOY_RUN_SQL
    + """
    SELECT process_identifier, ts, seq, to_value, verdict FROM run WHERE n > 0
    UNION ALL SELECT process_identifier, ts, seq, to_value, 'unknown process' FROM log
    WHERE process_identifier NOT IN (SELECT identifier FROM processes)
    """,
    uses=("processes",),
)
def deploy_steps_streamed(t: Tables) -> DataFrame:
    """The verdict on every claim and outcome, from a stateful stream operator; the SQL replays them one by one."""
    changes = _deploy_log(R.read_table_stream(t.spark, t.folder, "events"))
    given = R.run_to_end(deployment_verdicts(changes, _deployed_processes(t)), "deploy-verdicts")
    return last_verdicts(given).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "reconcile",
    f"""
    WITH current AS (SELECT identifier, coalesce(CASE WHEN size % 10 = 0 THEN 'in-progress' ELSE deployment END, 'failed') AS value,
      CASE WHEN size % 3 = 0 THEN 'old' ELSE {_HASH_SQL} END = {_HASH_SQL} AS same FROM processes)
    SELECT event_key, e.process_identifier, CASE WHEN c.identifier IS NULL THEN 'undeploy'
      WHEN same AND value IN ('deployed', 'failed') THEN 'none' WHEN value = 'in-progress' THEN 'wait'
      ELSE 'deploy' END AS action
    FROM (SELECT event_key, concat('proc-', CAST(event_id AS STRING)) AS process_identifier FROM process_events) e
    LEFT JOIN current c ON c.identifier = e.process_identifier
    """,
    uses=("process_events", "processes"),
)
def reconcile(t: Tables) -> DataFrame:
    """What every change event asks of the reconciler."""
    desired = K.definition_hash(_unit_json(), _inputs_json(), F.lit("[]"))
    current = t.processes.select(
        "identifier",
        F.when(F.col("size") % 10 == 0, "in-progress").otherwise(F.col("deployment")).alias("deployment"),
        F.when(F.col("size") % 3 == 0, "old").otherwise(desired).alias("definition_hash"),
        desired.alias("desired_hash"),
    )
    events = t.process_events.select(
        "event_key", F.concat(F.lit("proc-"), F.col("event_id").cast("string")).alias("process_identifier")
    )
    return Jb.reconcile(events, current)


# --- configuration entries ------------------------------------------------------------------

# Every ninth collection has an entry before the one that counts; others are wrong in one way each.
_ODD = "CAST(substr(identifier, 5) AS INT) % 9"


@query(
    "config_collections",
    f"""
    WITH odd AS (SELECT *, {_ODD} AS k FROM collections)
    SELECT identifier, CASE k WHEN 1 THEN 'picture' ELSE type END AS type, title, CASE k WHEN 2 THEN 'nobody' ELSE owner_id END AS owner_id,
      is_public, CASE WHEN k <> 3 THEN xmin END AS xmin, CASE WHEN k <> 3 THEN ymax END AS ymax, coalesce(storage_crs, '{_CRS84}') AS storage_crs,
      custom_page_size, CASE k WHEN 4 THEN 'film' WHEN 5 THEN 'tile' ELSE 'feature' END AS provider,
      CASE k WHEN 5 THEN NULL ELSE concat('{{"path":"', identifier, '"}}') END AS config,
      CASE k WHEN 1 THEN 'unknown type' WHEN 2 THEN 'unknown owner' WHEN 3 THEN CASE WHEN xmin IS NOT NULL THEN 'extent is not well-known text' END
        WHEN 4 THEN 'unknown kind of provider' WHEN 5 THEN 'incomplete provider' END AS problem
    FROM odd
    """,
    uses=("collections", "accounts"),
)
def config_collections(t: Tables) -> DataFrame:
    """Collections from configuration entries, or why an entry cannot be loaded."""
    k = F.expr(_ODD)
    ring = F.array_join(F.array(*[F.concat_ws(" ", x, y) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))]), ",")
    extent = F.when(F.col("xmin").isNotNull(), F.concat(F.lit("POLYGON(("), ring, F.lit("))")))
    extent = F.when(F.col("xmin").isNotNull() & (k == 3), "a box").otherwise(extent)
    config = F.struct(F.col("identifier").alias("path"))
    provider = F.struct(F.lit("files").alias("provider_name"), F.when(k != 5, config).alias("config"))
    kind = F.when(k == 4, "film").when(k == 5, "tile").otherwise("feature")
    entry = F.struct(
        "identifier", "title", F.when(k == 2, "nobody").otherwise(F.col("owner_id")).alias("owner_id"), "is_public",
        F.when(k == 1, "picture").otherwise(F.col("type")).alias("type_"), extent.alias("spatial_extent"), "storage_crs", "custom_page_size",
        F.create_map(kind, provider).alias("providers"),
    )
    n = F.substring("identifier", 5, 20).cast("int")
    last = t.collections.select((n * 2).alias("position"), F.to_json(entry).alias("entry"))
    first = t.collections.where(k == 0).select((n * 2 - 1).alias("position"), F.to_json(F.struct("identifier", F.lit("old").alias("title"))).alias("entry"))
    rows = Cf.load_collections(last.unionByName(first), users(t))
    one = F.get(F.map_entries("providers"), F.lit(0))
    return rows.select(
        "identifier", "type", "title", "owner_id", "is_public", "xmin", "ymax", "storage_crs", "custom_page_size", one["key"].alias("provider"),
        one["value"]["config"].alias("config"), "problem",
    )


@query(
    "config_processes",
    """
    WITH odd AS (SELECT *, CAST(substr(identifier, 6) AS INT) % 7 AS k FROM processes)
    SELECT identifier, title, owner_id, CASE k WHEN 1 THEN 'cwl' WHEN 2 THEN 'shell' WHEN 3 THEN NULL ELSE 'oci' END AS unit_type,
      CASE WHEN k IN (0, 5, 6) THEN image END AS image, CASE WHEN k IN (1, 2) THEN definition END AS definition,
      CASE WHEN k IN (1, 2, 3) THEN NULL WHEN k = 6 THEN 0 ELSE 1 END AS n_bindings, 2 AS n_inputs,
      CASE k WHEN 5 THEN 'asleep' ELSE coalesce(deployment, 'failed') END AS deployment,
      CASE k WHEN 4 THEN 'container without an image' WHEN 5 THEN 'unknown deployment status' END AS problem
    FROM odd
    """,
    uses=("processes", "accounts"),
)
def config_processes(t: Tables) -> DataFrame:
    """Processes from configuration entries: three kinds of execution units, deployments that count as failed."""
    k = F.substring("identifier", 6, 20).cast("int") % 7
    binding = F.when(k != 6, F.create_map(F.lit("a"), F.struct(F.lit("--a").alias("prefix"))))
    unit = F.when(k != 3, F.struct(
        F.when(k == 1, "cwl").when(k == 2, "shell").otherwise("oci").alias("type_"), F.when(k.isin(0, 5, 6), F.col("image")).alias("image"),
        F.when(k.isin(1, 2), F.col("definition")).alias("definition"), binding.alias("bindings_inputs"),
    ))
    status = F.when(k == 5, "asleep").otherwise(F.col("deployment"))
    described = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("a", "b")])
    entry = F.struct(
        "identifier", "title", "owner_id", "is_public", described.alias("inputs"), unit.alias("execution_unit"),
        F.when(status.isNotNull(), F.struct(status.alias("value"))).alias("deployment_status"),
    )
    entries = t.processes.select(F.substring("identifier", 6, 20).cast("int").alias("position"), F.to_json(entry).alias("entry"))
    rows = Cf.load_processes(entries, users(t))
    return rows.select(
        "identifier", "title", "owner_id", "unit_type", "image", "definition", F.size("bindings_inputs").alias("n_bindings"),
        F.size("inputs").alias("n_inputs"), "deployment", "problem",
    )
