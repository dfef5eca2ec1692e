"""Queries on visibility, permissions, grants and audiences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.operators import access as A
from featlake.operators import catalog as K
from featlake.plans.registry import Tables, query

_SCOPES = [f"scope_{i}" for i in range(1, 6)]

# Users and grants as SQL: one row per scope of the form type-identifier:role.
_GRANTS_SQL = f"""
scoped AS (SELECT id AS user_id, unnest([{", ".join(_SCOPES)}]) AS scope FROM accounts),
held AS (SELECT user_id, regexp_extract(scope, '^(collection|process|job)-(.+):(editor|viewer)$', 1) AS resource_type,
    regexp_extract(scope, '^(collection|process|job)-(.+):(editor|viewer)$', 2) AS resource_id,
    regexp_extract(scope, '^(collection|process|job)-(.+):(editor|viewer)$', 3) AS role
  FROM scoped WHERE regexp_matches(scope, '^(collection|process|job)-(.+):(editor|viewer)$')),
admins AS (SELECT id AS user_id FROM accounts WHERE is_admin)"""


def users(t: Tables) -> DataFrame:
    return t.accounts.withColumn("scopes", F.array(*_SCOPES)).drop(*_SCOPES, "is_admin")


@query(
    "grants",
    f"WITH {_GRANTS_SQL} SELECT user_id, resource_type, resource_id, role FROM held",
    uses=("accounts",),
)
def grants(t: Tables) -> DataFrame:
    return A.grants(users(t))


@query(
    "collections_public",
    "SELECT identifier, owner_id, created_day FROM collections WHERE is_public",
    uses=("collections",),
)
def collections_public(t: Tables) -> DataFrame:
    """What anonymous visitors see, oldest first."""
    rows = A.visible_to(t.collections, users(t), "collection", None)
    return rows.orderBy(*K.catalogue_order("created_day")).select("identifier", "owner_id", "created_day")


@query(
    "collections_all",
    "SELECT identifier, owner_id, is_public FROM collections",
    uses=("collections", "accounts"),
)
def collections_all(t: Tables) -> DataFrame:
    """An administrator sees everything."""
    rows = A.visible_to(t.collections, users(t), "collection", "user-100")
    return rows.orderBy(*K.catalogue_order("created_day")).select("identifier", "owner_id", "is_public")


@query(
    "collections_visible",
    f"""
    WITH {_GRANTS_SQL}
    SELECT identifier, owner_id, is_public FROM collections
    WHERE is_public OR owner_id = 'user-7' OR identifier IN
      (SELECT resource_id FROM held WHERE user_id = 'user-7' AND resource_type = 'collection')
    """,
    uses=("collections", "accounts"),
)
def collections_visible(t: Tables) -> DataFrame:
    rows = A.visible_to(t.collections, users(t), "collection", "user-7")
    return rows.orderBy(*K.catalogue_order("created_day")).select("identifier", "owner_id", "is_public")


@query(
    "jobs_visible",
    f"""
    WITH {_GRANTS_SQL}
    SELECT j.identifier, j.owner_id, j.process_identifier, j.status FROM jobs j
    LEFT JOIN processes p ON p.identifier = j.process_identifier
    WHERE j.is_public OR j.owner_id = 'user-27' OR p.owner_id = 'user-27'
      OR j.identifier IN (SELECT resource_id FROM held WHERE user_id = 'user-27' AND resource_type = 'job')
      OR j.process_identifier IN (SELECT resource_id FROM held WHERE user_id = 'user-27' AND resource_type = 'process')
    """,
    uses=("jobs", "processes", "accounts"),
)
def jobs_visible(t: Tables) -> DataFrame:
    rows = A.visible_jobs(t.jobs, t.processes, users(t), "user-27")
    return rows.orderBy("created_at", "seq").select("identifier", "owner_id", "process_identifier", "status")


def _permission_sql(resource: str, table: str, kind: str) -> str:
    return f"""
    WITH {_GRANTS_SQL}
    SELECT l_orderkey, l_linenumber, q.user_id, q.{resource},
      coalesce(r.is_public OR a.user_id IS NOT NULL OR r.owner_id = q.user_id OR EXISTS (SELECT 1 FROM held h
        WHERE h.user_id = q.user_id AND h.resource_type = '{kind}' AND h.resource_id = q.{resource}), FALSE)
        AND r.identifier IS NOT NULL AS can_view,
      coalesce(a.user_id IS NOT NULL OR r.owner_id = q.user_id OR EXISTS (SELECT 1 FROM held h
        WHERE h.user_id = q.user_id AND h.resource_type = '{kind}' AND h.resource_id = q.{resource}
          AND h.role = 'editor'), FALSE) AND r.identifier IS NOT NULL AS can_edit,
      coalesce(a.user_id IS NOT NULL OR r.owner_id = q.user_id, FALSE) AND r.identifier IS NOT NULL AS can_change_owner
    FROM questions q LEFT JOIN {table} r ON r.identifier = q.{resource} LEFT JOIN admins a ON a.user_id = q.user_id
    """


def _decided(t: Tables, resource: str, resources: DataFrame, kind: str) -> DataFrame:
    asked = t.questions.select("l_orderkey", "l_linenumber", "user_id", resource)
    return A.decide(asked, resources, users(t), kind, resource).drop("is_known")


@query(
    "perm_collection",
    _permission_sql("collection", "collections", "collection"),
    uses=("questions", "collections", "accounts"),
)
def perm_collection(t: Tables) -> DataFrame:
    return _decided(t, "collection", t.collections, "collection")


@query(
    "perm_process", _permission_sql("process", "processes", "process"), uses=("questions", "processes", "accounts")
)
def perm_process(t: Tables) -> DataFrame:
    return _decided(t, "process", t.processes, "process")


@query(
    "perm_job",
    f"""
    WITH {_GRANTS_SQL},
    facts AS (
      SELECT l_orderkey, l_linenumber, q.user_id, q.job, j.is_public,
        coalesce(a.user_id IS NOT NULL OR j.owner_id = q.user_id OR p.owner_id = q.user_id OR EXISTS (
          SELECT 1 FROM held h WHERE h.user_id = q.user_id AND h.role = 'editor' AND
            ((h.resource_type = 'job' AND h.resource_id = q.job)
             OR (h.resource_type = 'process' AND h.resource_id = j.process_identifier))), FALSE) AS edits,
        EXISTS (SELECT 1 FROM held h WHERE h.user_id = q.user_id AND
            ((h.resource_type = 'job' AND h.resource_id = q.job)
             OR (h.resource_type = 'process' AND h.resource_id = j.process_identifier))) AS holds
      FROM questions q JOIN jobs j ON j.identifier = q.job JOIN processes p ON p.identifier = j.process_identifier
      LEFT JOIN admins a ON a.user_id = q.user_id)
    SELECT l_orderkey, l_linenumber, user_id, job, is_public OR edits OR holds AS can_view, edits AS can_cancel,
      edits AS can_delete, FALSE AS can_update_status FROM facts
    """,
    uses=("questions", "jobs", "processes", "accounts"),
)
def perm_job(t: Tables) -> DataFrame:
    asked = t.questions.select("l_orderkey", "l_linenumber", "user_id", "job")
    return A.decide_jobs(asked, t.jobs, t.processes, users(t))


@query(
    "perm_matrix",
    """
    SELECT id AS user_id, action, is_admin OR action IN ('create_collection', 'create_process', 'view_user') AS is_allowed
    FROM accounts, (VALUES ('create_collection'), ('create_process'), ('view_user'), ('edit_server_metadata'),
      ('create_user'), ('edit_user'), ('delete_user'), ('assign_admin_scope')) v(action)
    """,
    uses=("accounts",),
)
def perm_matrix(t: Tables) -> DataFrame:
    return A.action_matrix(users(t))


@query(
    "lookup_visible",
    f"""
    WITH {_GRANTS_SQL}
    SELECT l_orderkey, l_linenumber, collection, title FROM questions q JOIN collections r ON r.identifier = q.collection
    WHERE r.is_public OR q.user_id IN (SELECT user_id FROM admins) OR r.owner_id = q.user_id
      OR EXISTS (SELECT 1 FROM held h WHERE h.user_id = q.user_id AND h.resource_type = 'collection'
        AND h.resource_id = q.collection)
    """,
    uses=("questions", "collections", "accounts"),
)
def lookup_visible(t: Tables) -> DataFrame:
    """Lookups by identifier; what a user may not view is not found."""
    asked = t.questions.select("l_orderkey", "l_linenumber", "user_id", "collection")
    found = A.lookup(asked, t.collections, users(t), "collection", "collection")
    return found.select("l_orderkey", "l_linenumber", "collection", "title")


@query(
    "owned",
    "SELECT owner_id AS user_id, identifier FROM collections WHERE owner_id IN (SELECT id FROM accounts)",
    uses=("collections", "accounts"),
)
def owned(t: Tables) -> DataFrame:
    return A.owned(t.collections, users(t))


_EDITABLE_SQL = f"""{_GRANTS_SQL},
can AS (SELECT owner_id AS user_id, identifier FROM collections WHERE owner_id IN (SELECT id FROM accounts)
  UNION SELECT user_id, resource_id FROM held WHERE resource_type = 'collection' AND role = 'editor')"""


@query(
    "editable",
    f"WITH {_EDITABLE_SQL} SELECT user_id, identifier FROM can",
    uses=("collections", "accounts"),
)
def editable(t: Tables) -> DataFrame:
    return A.editable(t.collections, users(t))


@query(
    "scope_assign",
    f"""
    WITH {_EDITABLE_SQL}
    SELECT a.id AS request_id, is_admin
      OR (is_active AND CAST(substr(a.id, 6) AS BIGINT) % 4 = 3
          AND EXISTS (SELECT 1 FROM can WHERE can.user_id = a.id AND can.identifier = substr(regexp_replace(scope_1, ':.*', ''), 12)))
      OR CAST(substr(a.id, 6) AS BIGINT) % 4 = 2 AS is_allowed
    FROM accounts a WHERE CAST(substr(a.id, 6) AS BIGINT) % 4 <> 1
    UNION ALL SELECT id, is_admin FROM accounts WHERE CAST(substr(id, 6) AS BIGINT) % 4 = 1
    """,
    uses=("collections", "accounts"),
)
def scope_assign(t: Tables) -> DataFrame:
    """Users asking to set scopes: one they edit, none at all, a process scope, a missing one."""
    number = F.substring("id", 6, 20).cast("bigint") % 4
    same = F.concat(F.regexp_extract("scope_1", "^(.*):", 1), F.lit(":viewer"))
    wished = (
        F.when(number == 3, F.when(F.col("is_active"), F.array(same)).otherwise(F.array(F.lit("admin"))))
        .when(number == 2, F.array().cast("array<string>"))
        .when(number == 1, F.array(same, F.lit("process-proc-1:viewer")))
        .otherwise(F.array(F.lit("collection-col-none:editor")))
    )
    requests = t.accounts.select(F.col("id").alias("request_id"), F.col("id").alias("user_id"), wished.alias("new_scopes"))
    return A.may_set_scopes(requests, t.collections, users(t)).select("request_id", "is_allowed")


_CHANGES = """
  SELECT o_orderkey AS seq, concat('user-', CAST(o_custkey % 60 AS STRING)) AS granted_by,
    concat('user-', CAST(o_custkey AS STRING)) AS user_id,
    concat('col-', CAST(o_custkey % 10 AS STRING)) AS resource_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'editor' WHEN 1 THEN 'viewer' END AS role FROM orders
"""


@query(
    "grant_apply",
    f"""
    WITH {_EDITABLE_SQL},
    ok AS (SELECT c.* FROM ({_CHANGES}) c JOIN collections r ON r.identifier = c.resource_id
      WHERE c.user_id IN (SELECT id FROM accounts) AND (c.granted_by IN (SELECT user_id FROM admins)
        OR EXISTS (SELECT 1 FROM can WHERE can.user_id = c.granted_by AND can.identifier = c.resource_id))),
    last AS (SELECT *, row_number() OVER (PARTITION BY user_id, resource_id ORDER BY seq DESC) AS n FROM ok)
    SELECT DISTINCT user_id, resource_type, resource_id, role FROM held h
      WHERE NOT (resource_type = 'collection' AND EXISTS (SELECT 1 FROM ok WHERE ok.user_id = h.user_id
        AND ok.resource_id = h.resource_id))
    UNION SELECT user_id, 'collection', resource_id, role FROM last WHERE n = 1 AND role IS NOT NULL
    """,
    uses=("collections", "accounts"),
)
def grant_apply(t: Tables) -> DataFrame:
    """Grants and revocations by users who may make them, applied to all grants."""
    changes = t.orders.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("user-"), (F.col("o_custkey") % 60).cast("string")).alias("granted_by"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.concat(F.lit("col-"), (F.col("o_custkey") % 10).cast("string")).alias("resource_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "editor").when(F.col("o_orderkey") % 3 == 1, "viewer").alias("role"),
    )
    return A.apply_grants(users(t), changes, t.collections, "collection")


def audience_sql(table: str, kind: str, name: str, private: bool = True) -> str:
    """(identifier, user_id) of active owners and members of a table's resources, as a CTE."""
    only = "WHERE NOT is_public" if private else ""
    return f"""{name} AS (
      SELECT identifier, user_id FROM (
        SELECT identifier, owner_id AS user_id FROM {table} {only}
        UNION SELECT resource_id, user_id FROM held WHERE resource_type = '{kind}'
          AND resource_id IN (SELECT identifier FROM {table} {only}))
      WHERE user_id IN (SELECT id FROM accounts WHERE is_active))"""


@query(
    "audience",
    f"WITH {_GRANTS_SQL}, {audience_sql('processes', 'process', 'told')} SELECT identifier, user_id FROM told",
    uses=("processes", "accounts"),
)
def audience(t: Tables) -> DataFrame:
    return A.audience(t.processes, users(t), "process")


_TASKS_SQL = """tasks AS (SELECT identifier, owner_id, is_public,
  concat('proc-', CAST(seq // 8 AS STRING)) AS process_identifier FROM jobs)"""


@query(
    "audience_job",
    f"""
    WITH {_GRANTS_SQL}, {_TASKS_SQL}, {audience_sql("tasks", "job", "direct")},
    {audience_sql("processes", "process", "side", private=False)}
    SELECT identifier, user_id FROM direct
    UNION SELECT k.identifier, s.user_id FROM tasks k JOIN side s ON s.identifier = k.process_identifier
      WHERE NOT k.is_public
    """,
    uses=("jobs", "processes", "accounts"),
)
def audience_job(t: Tables) -> DataFrame:
    """Who is told about private jobs: their own members and those of their process."""
    tasks = t.jobs.withColumn("process_identifier", F.expr("concat('proc-', CAST(seq DIV 8 AS STRING))"))
    return A.job_audience(tasks, t.processes, users(t))


@query(
    "users_filter",
    "SELECT id, username FROM accounts WHERE contains(lower(username), 'r#0000000') AND NOT is_admin",
    uses=("accounts",),
)
def users_filter(t: Tables) -> DataFrame:
    """Users by part of their name, without administrators, ordered by name."""
    return K.list_users(users(t), name_contains="R#0000000", is_admin=False).select("id", "username")


@query(
    "valid_scope",
    """
    SELECT id, CASE WHEN is_admin OR CAST(substr(id, 6) AS BIGINT) % 100 <> 50 THEN '' ELSE 'wrong:scope' END AS invalid
    FROM accounts
    """,
    uses=("accounts",),
)
def valid_scope(t: Tables) -> DataFrame:
    return users(t).select("id", F.array_join(K.invalid_scopes(F.col("scopes")), ",").alias("invalid"))
