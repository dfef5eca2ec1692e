"""Jobs and deployments: admission of requests and guarded status changes.

The status rules are expressed as mergeable aggregates and sliced windows, so that a job or a
process with a very large share of all changes does not end up in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.operators import access as A
from featlake.operators.skew import split_join
from featlake.operators.slices import default_slices, with_slice

# Job and deployment statuses.
ACCEPTED, RUNNING, SUCCESSFUL, FAILED, DISMISSED = "accepted", "running", "successful", "failed", "dismissed"
QUEUED, IN_PROGRESS, DEPLOYED = "queued", "in-progress", "deployed"


def admit(requests: DataFrame, processes: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (user_id, process) to job rows, or the reason why there is none.

    A process must exist, be visible to the user and be deployed. Anonymous requests belong to
    the owner of the process and are public, so that their author can see them.
    """
    rows = A.decide(requests, processes, users, "process", "process", carry=("owner_id", "deployment"))
    reason = (
        F.when(~F.col("is_known"), "not found")
        .when(~F.col("can_view"), "not permitted")
        .when(F.coalesce("_carried_deployment", F.lit(FAILED)) != DEPLOYED, "not deployed")
    )
    accepted = reason.isNull()
    return rows.withColumns(
        {
            "reason": reason,
            "status": F.when(accepted, ACCEPTED),
            "owner_id": F.when(accepted, F.coalesce("user_id", "_carried_owner_id")),
            "is_public": F.when(accepted, F.col("user_id").isNull()),
        }
    ).select(*requests.columns, "reason", "status", "owner_id", "is_public")


# What a request may ask for, its defaults, and the kind of entity that jobs are.
RESPONSES, TRANSMISSIONS, ENTITY = ("raw", "document"), ("value", "reference"), "ogc-api-processes"
_REQUEST = """
    outputs map<string, struct<format: string, format_: string, transmissionMode: string, transmission_mode: string>>, response string,
    subscriber struct<successUri: string, success_uri: string, inProgressUri: string, in_progress_uri: string, failedUri: string, failed_uri: string>
"""


def read_execute_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Execute requests given as JSON text to ``inputs, outputs, response_type, callback_uris`` and ``problem``.

    ``inputs`` stays JSON text, since its values may be anything. An output is delivered by value and
    in any format unless it says otherwise; a response is raw. A missing body asks for nothing. Both
    spellings of names are read. ``problem`` is null for a request that can be carried out.
    """
    text, r = F.col(body), F.col("_request")
    whole = F.get_json_object(text, "$")
    outputs = F.coalesce(r["outputs"], F.create_map().cast("map<string,struct<format:string,format_:string,transmissionMode:string,transmission_mode:string>>"))
    mode = lambda o: F.coalesce(o["transmissionMode"], o["transmission_mode"], F.lit(TRANSMISSIONS[0]))
    described = F.transform_values(
        outputs, lambda _, o: F.struct(F.coalesce(o["format"], o["format_"]).alias("format"), mode(o).alias("transmission_mode"))
    )
    uri = lambda camel, snake: F.coalesce(r["subscriber"][camel], r["subscriber"][snake])
    uris = F.struct(
        uri("successUri", "success_uri").alias("success_uri"), uri("inProgressUri", "in_progress_uri").alias("in_progress_uri"),
        uri("failedUri", "failed_uri").alias("failed_uri"),
    )
    subscribed = F.get_json_object(text, "$.subscriber").isNotNull()
    response = F.coalesce(r["response"], F.lit(RESPONSES[0]))
    problem = (
        F.when(text.isNull(), None)
        .when(whole.isNull() | ~F.startswith(whole, F.lit("{")), "not a request")
        .when(~response.isin(*RESPONSES), "unknown response")
        .when(F.exists(F.map_values(outputs), lambda o: ~mode(o).isin(*TRANSMISSIONS)), "unknown transmission mode")
        .when(subscribed & uris["success_uri"].isNull(), "subscriber without success uri")
    )
    parsed = requests.withColumn("_request", F.from_json(text, _REQUEST))
    return parsed.withColumns(
        {
            "inputs": F.coalesce(F.get_json_object(text, "$.inputs"), F.lit("{}")),
            "outputs": described,
            "response_type": response,
            "callback_uris": F.when(subscribed, uris),
            "problem": problem,
        }
    ).drop("_request")


def job_rows(requests: DataFrame, processes: DataFrame, users: DataFrame, body: str = "body") -> DataFrame:
    """Execute requests (user_id, process and a body) to whole job rows, or the reason why there is none."""
    read = read_execute_requests(requests, body)
    rows = admit(read.drop(body), processes, users).withColumn("reason", F.coalesce("problem", "reason")).drop("problem")
    made = F.col("reason").isNull()
    given = ("status", "owner_id", "is_public", "inputs", "outputs", "response_type", "callback_uris")
    kept = {c: F.when(made, F.col(c)) for c in given} | {"processing_entity_type": F.when(made, ENTITY)}
    return rows.withColumns(kept)


def clamp_progress(progress: Column) -> Column:
    return F.when(progress.isNotNull(), F.greatest(F.least(progress, F.lit(100)), F.lit(0)))


# --- job life cycle -------------------------------------------------------------------------

def fold_job_changes(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The steps each job has taken, given requested changes and optionally earlier steps.

    ``changes`` has job_identifier, ts, seq, to_status and progress. A job is created as accepted;
    running needs accepted, successful and failed need running, dismissed needs one of the first
    two; end states stay. So each step is the earliest fitting change after the step before it:
    three small aggregates, each reduced before its shuffle.

    Steps carry the change's ``message`` and ``exception`` where ``changes`` has those columns.

    Returns job_identifier, ``accepted``, ``running`` and ``ended`` steps (null if not taken) and
    ``n_changes`` seen so far.
    """
    step = F.struct(
        F.col("ts").alias("ts"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("to_status").alias("status"),
        F.col("progress").cast("int").alias("progress"),
        *[F.col(c) for c in ("message", "exception") if c in changes.columns],
    )
    moves = changes.select("job_identifier", step.alias("step"))

    def first(status: str | tuple[str, ...], after: Column | None = None) -> Column:
        wanted = F.col("step")["status"].isin(*([status] if isinstance(status, str) else status))
        if after is not None:
            wanted = wanted & _later(F.col("step"), after)
        return F.min(F.when(wanted, F.col("step")))

    counted = moves.groupBy("job_identifier").agg(
        first(ACCEPTED).alias("accepted"), F.count("*").alias("n_changes")
    )
    if state is not None:
        old = state.select(
            "job_identifier",
            F.col("accepted").alias("_accepted"),
            F.col("running").alias("_running"),
            F.col("ended").alias("_ended"),
            F.col("n_changes").alias("_n"),
        )
        counted = counted.join(old, "job_identifier", "full_outer").select(
            "job_identifier",
            F.coalesce("_accepted", "accepted").alias("accepted"),
            F.col("_running"),
            F.col("_ended"),
            (F.coalesce("_n", F.lit(0)) + F.coalesce("n_changes", F.lit(0))).alias("n_changes"),
        )
    else:
        none = F.lit(None).cast(moves.schema["step"].dataType)
        counted = counted.withColumns({"_running": none, "_ended": none})

    # Changes of jobs that are created and not ended, behind the creation.
    open_jobs = counted.where(F.col("accepted").isNotNull() & F.col("_ended").isNull())
    live = split_join(moves, open_jobs.select("job_identifier", "accepted", "_running"), ["job_identifier"])
    live = live.where(_later(F.col("step"), F.col("accepted")))
    second = live.groupBy("job_identifier").agg(
        F.coalesce(F.first("_running", ignorenulls=True), first(RUNNING)).alias("running"),
        first(DISMISSED).alias("dismissed"),
    )
    # Dismissed before it ran: the run does not happen.
    ran = F.when(
        F.col("dismissed").isNull() | ~_later(F.col("running"), F.col("dismissed")), F.col("running")
    )
    second = second.withColumn("running", ran)
    running = second.where(F.col("running").isNotNull()).select("job_identifier", "running")
    ended = moves.where(F.col("step")["status"].isin(SUCCESSFUL, FAILED))
    outcomes = (
        split_join(ended, running, ["job_identifier"])
        .where(_later(F.col("step"), F.col("running")))
        .groupBy("job_identifier")
        .agg(F.min("step").alias("outcome"))
    )
    ends = second.join(outcomes, "job_identifier", "left")
    ends = ends.select("job_identifier", F.col("running").alias("_ran"), _earlier("outcome", "dismissed").alias("_end"))
    return counted.join(ends, "job_identifier", "left").select(
        "job_identifier",
        "accepted",
        F.coalesce("_running", "_ran").alias("running"),
        F.coalesce("_ended", "_end").alias("ended"),
        F.col("n_changes").cast("bigint").alias("n_changes"),
    )


def _later(a: Column, b: Column) -> Column:
    return F.struct(a["ts"], a["seq"]) > F.struct(b["ts"], b["seq"])


def _earlier(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return F.when(x.isNull(), y).when(y.isNull(), x).when(_later(x, y), y).otherwise(x)


def job_status(steps: DataFrame) -> DataFrame:
    """Steps to the current row of each job; jobs never created have no status.

    A message and an exception stay until a later step brings others.
    """
    a, r, e = F.col("accepted"), F.col("running"), F.col("ended")
    taken = sum((c.isNotNull().cast("bigint") for c in (a, r, e)), F.lit(0))
    return steps.select(
        "job_identifier",
        F.coalesce(e["status"], r["status"], a["status"]).alias("status"),
        a["ts"].alias("created_at"),
        r["ts"].alias("started_at"),
        e["ts"].alias("finished_at"),
        clamp_progress(F.coalesce(e["progress"], r["progress"], a["progress"])).alias("progress"),
        (F.col("n_changes") - taken).alias("n_rejected"),
        *[F.coalesce(e[c], r[c], a[c]).alias(c) for c in steps.schema["accepted"].dataType.names if c in ("message", "exception")],
    )


def status_changes(steps: DataFrame) -> DataFrame:
    """One event per status a job really took, so repeats and refused changes are silent."""
    taken = F.filter(F.array("accepted", "running", "ended"), lambda s: s.isNotNull())
    return steps.select("job_identifier", F.inline(taken)).drop("progress", "message", "exception")


# --- deployments ----------------------------------------------------------------------------


def fold_deployments(changes: DataFrame, processes: DataFrame, slices: int | None = None) -> DataFrame:
    """Compare-and-set of deployment statuses: the current value of every process with changes.

    ``changes`` has process_identifier, ts, seq, to_value and definition_hash; ``processes`` has
    identifier, deployment and definition_hash. A claim (in-progress) needs any other status, an
    outcome needs in-progress and the hash of the current definition. Once stale outcomes are set
    aside, whether a change counts depends only on the change before it: after a claim a process
    is in progress, after an outcome it is not, whether or not either was accepted.

    "The change before" is found inside slices of time; the first change of a slice looks at the
    last change of the slice before it, taken from a table with one row per process and slice.
    """
    start = processes.select(
        F.col("identifier").alias("process_identifier"),
        F.coalesce("deployment", F.lit(FAILED)).alias("_start"),
        F.col("definition_hash").alias("_hash"),
    )
    sliced = with_slice(changes, F.unix_micros(F.col("ts").cast("timestamp")), slices or default_slices(changes))
    rows = sliced.join(start, "process_identifier")
    is_outcome = F.col("to_value").isin(DEPLOYED, FAILED)
    stale = is_outcome & ~F.col("definition_hash").eqNullSafe(F.col("_hash"))
    order = F.struct("ts", "seq")
    rows = rows.withColumn("_stale", stale).withColumn("_live", F.when(~F.col("_stale"), F.col("to_value")))
    tails = rows.groupBy("process_identifier", "_slice").agg(
        F.max_by("to_value", F.when(~F.col("_stale"), order)).alias("_tail")
    )
    before = Window.partitionBy("process_identifier").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("_tail", ignorenulls=True).over(before)
    tails = tails.select("process_identifier", "_slice", carried.alias("_carried"))
    inside = Window.partitionBy("process_identifier", "_slice").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.last("_live", ignorenulls=True).over(inside))
    rows = rows.join(tails, ["process_identifier", "_slice"])
    previous = F.coalesce("_within", "_carried", "_start")
    counts = F.when(F.col("to_value") == IN_PROGRESS, previous != IN_PROGRESS).otherwise(previous == IN_PROGRESS)
    joined = rows.withColumn("_applied", ~F.col("_stale") & counts).groupBy("process_identifier").agg(
        F.max_by(F.struct("to_value", "ts"), F.when(F.col("_applied"), order)).alias("_last"),
        F.count_if("_applied").alias("n_applied"), F.count_if("_stale").alias("n_stale"),
        F.count("*").alias("n_changes"), F.max("_start").alias("_start"),
    )
    return joined.select(
        "process_identifier",
        F.coalesce(F.col("_last")["to_value"], F.col("_start")).alias("value"),
        F.col("_last")["ts"].alias("changed_at"),
        F.coalesce("n_applied", F.lit(0)).alias("n_applied"),
        "n_stale",
        "n_changes",
    )


def reconcile(events: DataFrame, processes: DataFrame) -> DataFrame:
    """What a change event asks of the reconciler, given the process as it is now.

    ``processes`` has identifier, deployment, definition_hash (recorded) and desired_hash.
    """
    facts = processes.select(
        F.col("identifier").alias("process_identifier"),
        F.coalesce("deployment", F.lit(FAILED)).alias("_value"),
        F.col("definition_hash").eqNullSafe(F.col("desired_hash")).alias("_same"),
    )
    action = (
        F.when(F.col("_value").isNull(), "undeploy")
        .when(F.col("_same") & F.col("_value").isin(DEPLOYED, FAILED), "none")
        .when(F.col("_value") == IN_PROGRESS, "wait")
        .otherwise("deploy")
    )
    return events.join(facts, "process_identifier", "left").withColumn("action", action).drop("_value", "_same")
