"""Feature and catalogue tables derived from the given tables by plain expressions.

The expressions read the same in Spark and in ANSI SQL, so a query and the statement of its
expected result start from equal rows. Every derived table keeps all rows of its source.
"""

from __future__ import annotations

# The given tables.
GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_LON = "CAST((event_id*37)%3600 AS DOUBLE)/10 - 180"
_LAT = "CAST((event_id*17)%1800 AS DOUBLE)/10 - 90"
_PX = "CAST((o_orderkey*53)%3400 AS DOUBLE)/10 - 170"
_PY = "CAST((o_orderkey*29)%1600 AS DOUBLE)/10 - 80"

DERIVED: dict[str, tuple[str, list[str]]] = {
    # Point features with some missing geometries and times.
    "obs": (
        "events",
        [
            "CAST(event_id AS STRING) AS id",
            "event_id AS seq",
            f"CASE WHEN event_id % 50 = 0 THEN NULL ELSE {_LON} END AS x",
            f"CASE WHEN event_id % 50 = 0 THEN NULL ELSE {_LAT} END AS y",
            "CASE WHEN event_id % 40 = 0 THEN NULL ELSE ts END AS observed_at",
            "user_id AS stn_id",
            "event_type",
            "value",
            "props",
        ],
    ),
    # Boxes, diagonal segments and points.
    "parcels": (
        "orders",
        [
            "o_orderkey AS id",
            "CASE o_orderkey % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' ELSE 'Point' END AS geom_type",
            f"{_PX} AS xmin",
            f"{_PY} AS ymin",
            f"{_PX} + CASE WHEN o_orderkey % 3 = 2 THEN CAST(0 AS DOUBLE)"
            " ELSE CAST(o_orderkey % 7 AS DOUBLE) + 1 END AS xmax",
            f"{_PY} + CASE WHEN o_orderkey % 3 = 2 THEN CAST(0 AS DOUBLE)"
            " ELSE CAST(o_orderkey % 5 AS DOUBLE) + 1 END AS ymax",
            "o_orderdate AS valid_from",
            "o_orderstatus AS status",
        ],
    ),
    # Accounts with their scopes, one column each.
    "accounts": (
        "customer",
        [
            "concat('user-', CAST(c_custkey AS STRING)) AS id",
            "c_name AS username",
            "c_custkey % 10 <> 9 AS is_active",
            "c_custkey % 100 = 0 AS is_admin",
            "concat('collection-col-', CAST(c_custkey % 10 AS STRING),"
            " CASE WHEN c_custkey % 2 = 0 THEN ':viewer' ELSE ':editor' END) AS scope_1",
            "concat('process-proc-', CAST(c_custkey % 20 AS STRING),"
            " CASE WHEN c_custkey % 3 = 0 THEN ':editor' ELSE ':viewer' END) AS scope_2",
            "concat('process-proc-', CAST(c_custkey AS STRING), ':viewer') AS scope_3",
            "concat('job-job-', CAST(c_custkey * 10 + 1 AS STRING),"
            " CASE WHEN c_custkey % 2 = 0 THEN ':viewer' ELSE ':editor' END) AS scope_4",
            "CASE WHEN c_custkey % 100 = 0 THEN 'admin' WHEN c_custkey % 100 = 50 THEN 'wrong:scope'"
            " ELSE 'collection:creator' END AS scope_5",
        ],
    ),
    # Collections; without bounds the extent is unbounded.
    "collections": (
        "supplier",
        [
            "concat('col-', CAST(s_suppkey AS STRING)) AS identifier",
            "concat('user-', CAST(s_suppkey % 50 AS STRING)) AS owner_id",
            "s_suppkey % 3 = 0 AS is_public",
            "CASE s_suppkey % 4 WHEN 0 THEN 'coverage' WHEN 1 THEN 'record' ELSE 'feature' END AS type",
            "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST((s_suppkey*31)%300 AS DOUBLE) - 150 END AS xmin",
            "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST((s_suppkey*13)%140 AS DOUBLE) - 70 END AS ymin",
            "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST((s_suppkey*31)%300 AS DOUBLE) - 130 END AS xmax",
            "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST((s_suppkey*13)%140 AS DOUBLE) - 60 END AS ymax",
            "s_suppkey % 20 AS created_day",
            "s_name AS title",
            "CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1"
            " THEN 'http://www.opengis.net/def/crs/EPSG/0/3857'"
            " ELSE 'http://www.opengis.net/def/crs/OGC/1.3/CRS84' END AS storage_crs",
            "CASE WHEN s_suppkey % 6 = 0 THEN CAST(s_suppkey % 50 AS INT) ELSE NULL END AS custom_page_size",
            "CASE WHEN s_suppkey % 7 = 0 THEN CAST(s_suppkey % 30 AS INT) ELSE NULL END AS custom_page_size_max",
        ],
    ),
    # Processes; a missing deployment status counts as failed.
    "processes": (
        "part",
        [
            "concat('proc-', CAST(p_partkey AS STRING)) AS identifier",
            "concat('user-', CAST(p_partkey % 50 AS STRING)) AS owner_id",
            "p_partkey % 4 = 0 AS is_public",
            "CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'queued'"
            " ELSE 'deployed' END AS deployment",
            "p_type AS definition",
            "p_brand AS image",
            "p_name AS title",
            "p_size AS size",
        ],
    ),
    # Jobs; twenty processes hold all of them.
    "jobs": (
        "orders",
        [
            "concat('job-', CAST(o_orderkey AS STRING)) AS identifier",
            "concat('user-', CAST(o_custkey AS STRING)) AS owner_id",
            "concat('proc-', CAST(o_orderkey % 20 AS STRING)) AS process_identifier",
            "o_orderkey % 8 = 0 AS is_public",
            "CASE o_orderstatus WHEN 'O' THEN 'accepted' WHEN 'P' THEN 'running' ELSE 'successful' END AS status",
            "o_orderdate AS created_at",
            "o_orderkey AS seq",
        ],
    ),
    # Changes of processes, as they arrive on the internal channel.
    "process_events": (
        "events",
        [
            "concat('ev-', CAST(event_id AS STRING)) AS event_key",
            "concat('proc-', CAST(user_id AS STRING)) AS process_identifier",
            "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'updated' WHEN 'view' THEN 'deployed'"
            " WHEN 'purchase' THEN 'deployment_failed' ELSE 'deleted' END AS event_type",
            "ts",
            "event_id",
            "user_id",
        ],
    ),
    # Requested status changes of jobs; one job per user.
    "transitions": (
        "events",
        [
            "CAST(user_id AS STRING) AS job_identifier",
            "event_id AS seq",
            "ts",
            "CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'click' THEN 'running' WHEN 'view'"
            " THEN 'successful' WHEN 'purchase' THEN 'failed' ELSE 'dismissed' END AS to_status",
            "CAST(floor(value) AS INT) AS progress",
        ],
    ),
    # Questions of users about collections, processes and jobs; some are anonymous.
    "questions": (
        "lineitem",
        [
            "l_orderkey",
            "l_linenumber",
            "CASE WHEN l_orderkey % 11 = 0 THEN NULL"
            " ELSE concat('user-', CAST(l_partkey AS STRING)) END AS user_id",
            "concat('col-', CAST(l_suppkey AS STRING)) AS collection",
            "concat('proc-', CAST(l_partkey AS STRING)) AS process",
            "concat('job-', CAST(l_orderkey AS STRING)) AS job",
        ],
    ),
    # Boxes asked for in bulk, from one to twenty degrees wide.
    "boxes": (
        "supplier",
        [
            "s_suppkey AS request_id",
            "CAST((s_suppkey*31)%340 AS DOUBLE) - 170 AS q_xmin",
            "CAST((s_suppkey*13)%160 AS DOUBLE) - 85 AS q_ymin",
            "CAST((s_suppkey*31)%340 AS DOUBLE) - 170 + CAST(s_suppkey % 20 AS DOUBLE) + 0.5 AS q_xmax",
            "CAST((s_suppkey*13)%160 AS DOUBLE) - 85 + CAST(s_suppkey % 6 AS DOUBLE) + 0.5 AS q_ymax",
        ],
    ),
}


def with_tables(names: tuple[str, ...], body: str) -> str:
    """Put the derived tables in front of a statement as common table expressions."""
    if not names:
        return body
    tables = []
    for name in names:
        base, columns = DERIVED[name]
        tables.append(f"{name} AS (SELECT {', '.join(columns)} FROM {base})")
    body = body.strip()
    # A statement with tables of its own continues the list.
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(tables)}, {body[len('WITH RECURSIVE ') :]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(tables)}, {body[len('WITH ') :]}"
    return f"WITH {', '.join(tables)} {body}"
