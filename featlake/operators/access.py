"""Who may see and change what, as joins of users, resources and grants.

Permissions are answered for a table of questions (user, resource), never for all pairs. A missing
user is anonymous: only public resources. An administrator is unrestricted, which is different
from a user without grants.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.operators.catalog import SCOPE_PATTERN
from featlake.operators.skew import row_hash, split_join
from featlake.session import scratch_dir

EDITOR, VIEWER = "editor", "viewer"
# Actions that are not tied to one resource, and who may perform them.
ANY_USER_ACTIONS = ("create_collection", "create_process", "view_user")
ADMIN_ACTIONS = ("edit_server_metadata", "create_user", "edit_user", "delete_user", "assign_admin_scope")


class NotAllowed(PermissionError):
    """The caller may not ask for this listing."""


# --- grants ---------------------------------------------------------------------------------


def scope_parts(scope: Column) -> dict[str, Column]:
    return {
        name: F.regexp_extract(scope, SCOPE_PATTERN, i)
        for i, name in enumerate(("resource_type", "resource_id", "role"), 1)
    }


def grants(users: DataFrame) -> DataFrame:
    """One row per grant in the users' scopes: user, resource type, resource, role."""
    scopes = users.select(F.col("id").alias("user_id"), F.explode("scopes").alias("scope"))
    parts = scopes.where(F.col("scope").rlike(SCOPE_PATTERN)).withColumns(scope_parts(F.col("scope")))
    return parts.select("user_id", "resource_type", "resource_id", "role")


def roles(users: DataFrame, resource_type: str) -> DataFrame:
    """One row per (user, resource) with the strongest role, safe to join on."""
    return (
        grants(users)
        .where(F.col("resource_type") == resource_type)
        .groupBy("user_id", "resource_id")
        .agg(F.bool_or(F.col("role") == EDITOR).alias("is_editor"))
    )


def admins(users: DataFrame) -> DataFrame:
    return users.where(F.array_contains("scopes", "admin")).select(F.col("id").alias("user_id"))


def members(users: DataFrame, resource_type: str, role: str, caller: str | None) -> DataFrame:
    """The users with a role on resources of a type; needs an authenticated caller."""
    if caller is None:
        raise NotAllowed("listing users needs an authenticated caller")
    if resource_type not in ("collection", "process", "job"):
        raise ValueError(f"unknown resource type {resource_type!r}")
    held = grants(users).where((F.col("resource_type") == resource_type) & (F.col("role") == role))
    return held.select("resource_id", "user_id").distinct()


# --- listings of one principal --------------------------------------------------------------


def visible_to(resources: DataFrame, users: DataFrame, resource_type: str, user_id: str | None) -> DataFrame:
    """Public resources, and for a user also their own and those granted to them; all for admins."""
    if user_id is None:
        return resources.where("is_public")
    me = users.where(F.col("id") == user_id)
    granted = roles(me, resource_type).select(F.col("resource_id").alias("identifier"), F.lit(True).alias("_granted"))
    is_admin = me.agg(F.bool_or(F.array_contains("scopes", "admin"))).scalar()
    seen = F.col("is_public") | (F.col("owner_id") == user_id) | F.col("_granted").isNotNull()
    rows = resources.join(granted, "identifier", "left").withColumn("_admin", F.coalesce(is_admin, F.lit(False)))
    return rows.where(F.col("_admin") | seen).drop("_granted", "_admin")


def visible_jobs(jobs: DataFrame, processes: DataFrame, users: DataFrame, user_id: str | None) -> DataFrame:
    """Jobs inherit the sharing of their process: its owner and members see them too."""
    if user_id is None:
        return jobs.where("is_public")
    me = users.where(F.col("id") == user_id)
    own = roles(me, "job").select(F.col("resource_id").alias("identifier"), F.lit(True).alias("_granted"))
    through = roles(me, "process").select(
        F.col("resource_id").alias("process_identifier"), F.lit(True).alias("_process_granted")
    )
    parents = processes.where(F.col("owner_id") == user_id).select(
        F.col("identifier").alias("process_identifier"), F.lit(True).alias("_process_owned")
    )
    is_admin = me.agg(F.bool_or(F.array_contains("scopes", "admin"))).scalar()
    seen = (
        F.col("is_public")
        | (F.col("owner_id") == user_id)
        | F.col("_granted").isNotNull()
        | F.col("_process_granted").isNotNull()
        | F.col("_process_owned").isNotNull()
    )
    rows = (
        jobs.join(own, "identifier", "left")
        .join(through, "process_identifier", "left")
        .join(parents, "process_identifier", "left")
        .withColumn("_admin", F.coalesce(is_admin, F.lit(False)))
    )
    return rows.where(F.col("_admin") | seen).select(*jobs.columns)


# --- questions in bulk ----------------------------------------------------------------------


def _with_admin(questions: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``_admin``. Anonymous questions match nobody; their empty key is spread over many."""
    spread = F.pmod(row_hash(questions, leave_out=["user_id"]), F.lit(4096))
    nobody = F.concat(F.lit("\u0000"), spread.cast("string"))
    flags = admins(users).select(F.col("user_id").alias("_asker"), F.lit(True).alias("_is_admin"))
    rows = questions.withColumn("_asker", F.coalesce("user_id", nobody)).join(flags, "_asker", "left")
    return rows.withColumn("_admin", F.col("_is_admin").isNotNull()).drop("_asker", "_is_admin")


def _with_role(questions: DataFrame, users: DataFrame, resource_type: str, column: str, prefix: str) -> DataFrame:
    held = roles(users, resource_type).select(
        "user_id", F.col("resource_id").alias(column), F.col("is_editor").alias(f"_{prefix}_editor")
    )
    return split_join(questions, held, ["user_id", column], "left")


def decide(
    questions: DataFrame, resources: DataFrame, users: DataFrame, resource_type: str, column: str,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Add ``is_known, can_view, can_edit, can_change_owner`` to questions (user_id, column).

    Every question is joined on unique keys, so the result has the rows of the questions. Columns
    of the resource in ``carry`` come along as ``_carried_<name>``.
    """
    facts = resources.select(
        F.col("identifier").alias(column),
        F.col("owner_id").alias("_owner"),
        F.col("is_public").alias("_public"),
        F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_carried_{c}") for c in carry],
    )
    rows = _with_role(_with_admin(questions.join(facts, column, "left"), users), users, resource_type, column, "own")
    known, someone = F.col("_known").isNotNull(), F.col("user_id").isNotNull()
    owns = someone & (F.col("_admin") | F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False)))
    edits = owns | (someone & F.coalesce("_own_editor", F.lit(False)))
    views = edits | (someone & F.col("_own_editor").isNotNull()) | F.coalesce("_public", F.lit(False))
    return rows.withColumns(
        {
            "is_known": known,
            "can_view": known & views,
            "can_edit": known & edits,
            "can_change_owner": known & owns,
        }
    ).drop("_owner", "_public", "_known", "_admin", "_own_editor")


def decide_jobs(questions: DataFrame, jobs: DataFrame, processes: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``can_view, can_cancel, can_delete, can_update_status`` to questions (user_id, job)."""
    parents = processes.select(
        F.col("identifier").alias("_process"), F.col("owner_id").alias("_process_owner")
    )
    facts = jobs.select(
        F.col("identifier").alias("job"),
        F.col("owner_id").alias("_owner"),
        F.col("is_public").alias("_public"),
        F.col("process_identifier").alias("_process"),
    ).join(parents, "_process")
    rows = _with_admin(split_join(questions, facts, ["job"], "left"), users)
    rows = _with_role(rows, users, "job", "job", "job")
    rows = _with_role(rows, users, "process", "_process", "process")

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    known, someone = F.col("_process").isNotNull(), F.col("user_id").isNotNull()
    edits = someone & (
        F.col("_admin")
        | yes(F.col("_owner") == F.col("user_id"))
        | yes(F.col("_process_owner") == F.col("user_id"))
        | yes(F.col("_job_editor"))
        | yes(F.col("_process_editor"))
    )
    held = someone & (F.col("_job_editor").isNotNull() | F.col("_process_editor").isNotNull())
    return rows.withColumns(
        {
            "can_view": known & (edits | held | yes(F.col("_public"))),
            "can_cancel": known & edits,
            "can_delete": known & edits,
            # Only the system moves jobs along.
            "can_update_status": F.lit(False),
        }
    ).drop("_process", "_process_owner", "_owner", "_public", "_admin", "_job_editor", "_process_editor")


def lookup(questions: DataFrame, resources: DataFrame, users: DataFrame, resource_type: str, column: str) -> DataFrame:
    """The resources asked for by identifier; what a user may not view is not found."""
    allowed = decide(questions, resources, users, resource_type, column).where("can_view")
    asked = allowed.select(*questions.columns)
    return asked.join(resources.withColumnRenamed("identifier", column), column)


def action_matrix(users: DataFrame) -> DataFrame:
    """What every user may do apart from single resources: one row per user and action."""
    actions = F.array(
        *[F.struct(F.lit(a).alias("action"), F.lit(False).alias("admin_only")) for a in ANY_USER_ACTIONS],
        *[F.struct(F.lit(a).alias("action"), F.lit(True).alias("admin_only")) for a in ADMIN_ACTIONS],
    )
    rows = users.select(
        F.col("id").alias("user_id"), F.array_contains("scopes", "admin").alias("_admin"), F.inline(actions)
    )
    return rows.select("user_id", "action", (F.col("_admin") | ~F.col("admin_only")).alias("is_allowed"))


def owned(resources: DataFrame, users: DataFrame) -> DataFrame:
    """(user, identifier) of resources owned by a known user."""
    known = users.select(F.col("id").alias("user_id"))
    return resources.select(F.col("owner_id").alias("user_id"), "identifier").join(known, "user_id", "left_semi")


def editable(resources: DataFrame, users: DataFrame, resource_type: str = "collection") -> DataFrame:
    """(user, identifier) a user may edit by owning it or by an editor grant."""
    by_grant = grants(users).where((F.col("resource_type") == resource_type) & (F.col("role") == EDITOR))
    by_grant = by_grant.select("user_id", F.col("resource_id").alias("identifier"))
    return owned(resources, users).unionByName(by_grant).distinct()


def may_set_scopes(requests: DataFrame, collections: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (request_id, user_id, new_scopes) with ``is_allowed``.

    Administrators may set anything; others only scopes on collections they may edit.
    """
    wished = requests.select("request_id", "user_id", F.explode_outer("new_scopes").alias("scope"))
    wished = wished.withColumns(scope_parts(F.col("scope")))
    can = editable(collections, users).select(
        "user_id", F.col("identifier").alias("resource_id"), F.lit(True).alias("_editable")
    )
    checked = split_join(wished, can, ["user_id", "resource_id"], "left")
    fine = F.col("scope").isNull() | ((F.col("resource_type") == "collection") & F.col("_editable").isNotNull())
    verdicts = checked.groupBy("request_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("_fine"))
    rows = _with_admin(requests, users).join(verdicts, "request_id", "left")
    allowed = F.col("user_id").isNotNull() & (F.col("_admin") | F.col("_fine"))
    return rows.withColumn("is_allowed", allowed).drop("_admin", "_fine")


def apply_grants(users: DataFrame, changes: DataFrame, resources: DataFrame, resource_type: str) -> DataFrame:
    """All grants after a log of changes, one row per grant.

    ``changes`` has seq, granted_by, user_id, resource_id and role (null revokes). A change counts
    only if its author may edit the resource and its target exists; the last one per user and
    resource replaces whatever role the user had on it.
    """
    asked = changes.withColumnRenamed("user_id", "target").withColumnRenamed("granted_by", "user_id")
    decided = decide(asked, resources, users, resource_type, "resource_id")
    targets = users.select(F.col("id").alias("target"))
    counted = decided.where("can_edit").join(targets, "target", "left_semi")
    last = counted.groupBy(F.col("target").alias("user_id"), "resource_id").agg(
        F.max_by(F.struct("role"), F.col("seq"))["role"].alias("role")
    )
    last = last.withColumn("resource_type", F.lit(resource_type))
    kept = grants(users).join(
        last.select("user_id", "resource_type", "resource_id"),
        ["user_id", "resource_type", "resource_id"],
        "left_anti",
    )
    added = last.where(F.col("role").isNotNull()).select(*kept.columns)
    return kept.unionByName(added).distinct()


# --- audiences ------------------------------------------------------------------------------


def audience(resources: DataFrame, users: DataFrame, resource_type: str) -> DataFrame:
    """(identifier, user_id) to notify about private resources: active owners and members."""
    active = users.where("is_active").select(F.col("id").alias("user_id"))
    private = resources.where(~F.col("is_public"))
    owners = private.select("identifier", F.col("owner_id").alias("user_id"))
    held = grants(users).where(F.col("resource_type") == resource_type)
    held = held.select(F.col("resource_id").alias("identifier"), "user_id")
    held = held.join(private.select("identifier"), "identifier", "left_semi")
    return owners.unionByName(held).distinct().join(active, "user_id", "left_semi")


def job_audience(jobs: DataFrame, processes: DataFrame, users: DataFrame) -> DataFrame:
    """(identifier, user_id) to notify about private jobs: the job's side and its process's side.

    The process side repeats per job, because every job notifies on its own.
    """
    direct = audience(jobs, users, "job")
    private = jobs.where(~F.col("is_public")).select("identifier", "process_identifier")
    # Members of a process see its jobs whether or not the process is public.
    side = audience(processes.withColumn("is_public", F.lit(False)), users, "process")
    side = side.withColumnRenamed("identifier", "process_identifier")
    inherited = split_join(private, side, ["process_identifier"]).select("identifier", "user_id")
    return direct.unionByName(inherited).distinct()


def _sides(private: DataFrame, processes: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``job_audience`` in parts that grow with jobs and members, not with their product, for jobs with much in common.

    Returns jobs with one process each (identifier, ``_main``), the members of processes (``_main``,
    user_id), and the recipients of a job that are no members of its ``_main`` (identifier, user_id).
    A job's audience is the members of its ``_main`` and the recipients of its own, nobody twice.
    """
    mains = private.groupBy("identifier").agg(F.max("process_identifier").alias("_main"))
    wanted = private.select(F.col("process_identifier").alias("identifier")).distinct()
    # Members of a process see its jobs whether or not the process is public.
    wanted = processes.join(wanted, "identifier", "left_semi").withColumn("is_public", F.lit(False))
    side = audience(wanted, users, "process").select(F.col("identifier").alias("_main"), "user_id")
    # An identifier that comes with several processes is told through all of them.
    main_of = mains.select(F.col("identifier").alias("_job"), "_main")
    others = private.select("identifier", "process_identifier").distinct()
    others = others.join(main_of, F.col("identifier").eqNullSafe(F.col("_job"))).where("process_identifier <> _main")
    others = others.select("identifier", F.col("process_identifier").alias("_main"))
    inherited = split_join(others, side, ["_main"]).select("identifier", "user_id")
    told = audience(private, users, "job").select("identifier", "user_id").unionByName(inherited).distinct()
    told = told.join(main_of, F.col("identifier").eqNullSafe(F.col("_job")))
    extra = told.join(side, ["_main", "user_id"], "left_anti").select("identifier", "user_id")
    return mains, side, extra


# Messages of the members of one process that a task makes.
_TASK_MESSAGES = 1 << 30


def job_event_audience(events: DataFrame, jobs: DataFrame, processes: DataFrame, users: DataFrame) -> DataFrame:
    """Each event on a job with ``user_id``: a row per recipient, one with null for everyone.

    ``events`` has job_identifier, event_type and audience. A deletion tells the audience it carries,
    since the job is gone. Other events tell everyone of a public job, and the sides of a private
    one; who is on them is found for jobs with events only. Events on unknown jobs are dropped.

    Events meet the members of a process, not a list of members per job, so what is stored and
    shuffled grows with events, jobs and members; only the messages are their product. A process with
    very many messages is split by a hash of its events, and its members are repeated per split.
    """
    columns = events.columns
    deleted = F.col("event_type") == "deleted"
    asked = events.groupBy(F.col("job_identifier").alias("identifier")).agg(F.count_if(~deleted).alias("_asked"))
    # One row for equal ones, with how many of them there were. Stored, since all that follows starts
    # from these rows: jobs are shuffled once, and few jobs are broadcast.
    found = (
        jobs.join(asked, "identifier")
        .groupBy("identifier", "process_identifier", "owner_id", "_asked")
        .agg(F.count("*").alias("_rows"), F.count_if("is_public").alias("_public"), F.count_if(~F.col("is_public")).alias("_private"))
    )
    spark = events.sparkSession
    target = scratch_dir(spark, "asked-jobs")
    found.write.parquet(target)
    known = spark.read.schema(found.schema).parquet(target)
    private = known.where("_private > 0").withColumn("is_public", F.lit(False))
    mains, side, extra = _sides(private, processes, users)

    counts = known.groupBy("identifier", "_asked").agg(*[F.sum(c).alias(c) for c in ("_rows", "_public", "_private")])
    facts = counts.join(mains, "identifier", "left")
    messages = facts.where("_main IS NOT NULL").groupBy("_main").agg(F.sum(F.col("_asked") * F.col("_private")).alias("_n"))
    messages = messages.join(side.groupBy("_main").agg(F.count("*").alias("_members")), "_main")
    splits = messages.select(
        "_main", F.ceil(F.col("_n").cast("double") * F.col("_members") / _TASK_MESSAGES).cast("int").alias("_splits")
    ).where("_splits > 1")
    facts = split_join(facts.drop("_asked"), splits, ["_main"], "left").withColumnRenamed("identifier", "job_identifier")

    def entry(user: Column, key: Column, split: Column) -> Column:
        return F.struct(user.cast("string").alias("_user"), key.alias("_asks"), split.cast("int").alias("_split"))

    def times(entries: Column, n: Column) -> Column:
        return F.flatten(F.array_repeat(entries, n.cast("int")))

    # One pass over the events: only those on private jobs ask for members, and the keys of the
    # others, which match nothing, are spread.
    spread = F.pmod(row_hash(events), F.lit(4096))
    nobody = F.concat(F.lit("\u0000"), spread.cast("string"))
    everyone = entry(F.lit(None), nobody, F.lit(-1))
    carried = F.when(F.col("audience.is_public"), F.array(F.lit(None).cast("string"))).otherwise(F.col("audience.user_ids"))
    sides = F.array(
        entry(F.lit(None), F.concat(F.lit("process "), "_main"), F.pmod(row_hash(events), F.coalesce("_splits", F.lit(1)))),
        entry(F.lit(None), F.concat(F.lit("job "), "job_identifier"), F.lit(0)),
    )
    entries = F.when(
        deleted, times(F.transform(carried, lambda user: entry(user, nobody, F.lit(-1))), F.coalesce("_rows", F.lit(1)))
    ).when(~deleted, F.concat(F.array_repeat(everyone, F.col("_public").cast("int")), times(sides, F.col("_private"))))
    asks = split_join(events, facts, ["job_identifier"], "left").select(*columns, F.inline(entries))

    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1))
    members = split_join(side, splits, ["_main"], "left").select(
        F.concat(F.lit("process "), "_main").alias("_asks"), F.col("user_id").alias("_member"), copies.alias("_split")
    )
    own = extra.select(F.concat(F.lit("job "), "identifier").alias("_asks"), F.col("user_id").alias("_member"), F.lit(0).alias("_split"))
    told = split_join(asks, members.unionByName(own), ["_asks", "_split"], "left")
    told = told.where((F.col("_split") < 0) | F.col("_member").isNotNull())
    return told.select(*columns, F.coalesce("_member", "_user").alias("user_id"))
