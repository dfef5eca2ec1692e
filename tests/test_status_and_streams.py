"""Status rules against replays, and streams against their batch forms."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from featlake.operators import jobs as Jb
from featlake.streaming import events as E
from featlake.streaming import runs as R
from featlake.streaming.deployments import deployment_verdicts, last_verdicts
from featlake.streaming.stateful import job_steps, last_revisions

START = dt.datetime(2024, 1, 1)
CHANGE = "job_identifier string, ts timestamp_ntz, seq bigint, to_status string, progress int"


def _log(rng, n, keys, values):
    """Changes with ties in time; the first key has a third of them."""
    rows = []
    for seq in range(n):
        key = keys[0] if rng.random() < 0.34 else rng.choice(keys)
        rows.append((key, START + dt.timedelta(seconds=rng.randrange(n // 3)), seq, rng.choice(values), rng.randrange(-5, 130)))
    return rows


def _replay_jobs(rows):
    state = {}
    for key, ts, _, to, progress in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(key, {"status": None, "started": None, "finished": None, "progress": None, "rejected": 0})
        ok = {"accepted": s["status"] is None, "running": s["status"] == "accepted",
              "dismissed": s["status"] in ("accepted", "running")}.get(to, s["status"] == "running")
        if not ok:
            s["rejected"] += 1
            continue
        s["status"], s["progress"] = to, max(0, min(100, progress))
        if to == "running":
            s["started"] = ts
        elif to != "accepted":
            s["finished"] = ts
    return {k: tuple(v.values()) for k, v in state.items()}


def _got_jobs(steps):
    return {
        r.job_identifier: (r.status, r.started_at, r.finished_at, r.progress, r.n_rejected)
        for r in Jb.job_status(steps).collect()
    }


STATUSES = ["accepted", "running", "running", "successful", "failed", "dismissed"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_job_changes_equal_a_replay(spark, seed):
    rows = _log(random.Random(seed), 400, [f"j{i}" for i in range(60)], STATUSES)
    assert _got_jobs(Jb.fold_job_changes(spark.createDataFrame(rows, CHANGE))) == _replay_jobs(rows)


def test_job_changes_in_pieces_equal_one_fold(spark):
    rows = sorted(_log(random.Random(4), 500, [f"j{i}" for i in range(50)], STATUSES), key=lambda r: (r[1], r[2]))
    state = None
    for i in range(0, 500, 125):
        state = Jb.fold_job_changes(spark.createDataFrame(rows[i : i + 125], CHANGE), state)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert _got_jobs(state) == _replay_jobs(rows)


def test_stateful_steps_over_micro_batches(spark, tmp_path):
    rows = sorted(_log(random.Random(9), 240, [f"j{i}" for i in range(25)], STATUSES), key=lambda r: (r[1], r[2]))
    for i in range(0, 240, 80):
        part = spark.createDataFrame(rows[i : i + 80], CHANGE).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        time.sleep(1.1)  # files are taken in order of their modification time
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    steps = R.run_to_end(job_steps(stream), "test-steps").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    expected = Jb.status_changes(Jb.fold_job_changes(spark.createDataFrame(rows, CHANGE)))
    columns = ["job_identifier", "ts", "seq", "status"]
    assert sorted(map(tuple, steps.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


@pytest.mark.parametrize("seed", [9, 10])
def test_stateful_steps_of_files_out_of_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = sorted(_log(rng, 300, [f"j{i}" for i in range(40)], STATUSES), key=lambda r: (r[1], r[2]))
    rows = [(*r[:4], None if r[2] % 7 == 0 else r[4]) for r in rows]
    pieces = [rows[i : i + 60] for i in range(0, 300, 60)]
    # The newest file first, and one whose rows are from all times.
    mixed = [r for p in pieces for r in p[::9]]
    for piece in [[r for r in p if r not in mixed] for p in reversed(pieces)] + [mixed]:
        part = spark.createDataFrame(piece, CHANGE).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
        time.sleep(1.1)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    given = R.run_to_end(job_steps(stream), "test-steps").withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()
    assert given.where("revision > 1").count() > 0
    expected = Jb.fold_job_changes(spark.createDataFrame(rows, CHANGE))
    expected = expected.select("job_identifier", F.inline(F.array("accepted", "running", "ended"))).where("status IS NOT NULL")
    expected = expected.withColumn("progress", Jb.clamp_progress(F.col("progress")))
    order = lambda r: tuple(map(str, r))
    columns = ["job_identifier", "ts", "seq", "status", "progress"]
    assert sorted(map(tuple, last_revisions(given).select(columns).collect()), key=order) == sorted(map(tuple, expected.select(columns).collect()), key=order)


@pytest.mark.parametrize("slices", [1, 5])
def test_deployments_equal_a_replay(spark, slices):
    rng = random.Random(6)
    keys = [f"p{i}" for i in range(12)]
    start = {k: rng.choice([None, "queued", "deployed", "in-progress"]) for k in keys}
    rows = [(k, ts, s, to, rng.choice(["h", "h", "h", "old"]))
            for k, ts, s, to, _ in _log(rng, 400, keys, ["in-progress", "in-progress", "deployed", "failed"])]
    state = {}
    for key, ts, _, to, digest in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state.setdefault(key, [start[key] or "failed", None, 0, 0, 0])
        busy, stale = s[0] == "in-progress", to != "in-progress" and digest != "h"
        if (to == "in-progress" and not busy) or (to != "in-progress" and busy and not stale):
            s[0], s[1], s[2] = to, ts, s[2] + 1
        s[3], s[4] = s[3] + stale, s[4] + 1
    log = spark.createDataFrame(
        rows, "process_identifier string, ts timestamp_ntz, seq bigint, to_value string, definition_hash string"
    )
    processes = spark.createDataFrame([(k, v, "h") for k, v in start.items()],
                                      "identifier string, deployment string, definition_hash string")
    got = {r.process_identifier: [r.value, r.changed_at, r.n_applied, r.n_stale, r.n_changes]
           for r in Jb.fold_deployments(log, processes, slices).collect()}
    assert got == state


DEPLOYMENT = "process_identifier string, ts timestamp_ntz, seq bigint, to_value string, definition_hash string"


def _replay_deployments(rows, start):
    """The verdict on every change, one after another."""
    state, verdicts = dict(start), {}
    for key, ts, seq, to, digest in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in state:
            verdicts[seq] = "unknown process"
            continue
        busy = (state[key] or "failed") == "in-progress"
        if to != "in-progress" and digest != "h":
            verdicts[seq] = "stale outcome"
        elif busy == (to == "in-progress"):
            verdicts[seq] = "already in progress" if busy else "not in progress"
        else:
            verdicts[seq], state[key] = "applied", to
    return verdicts


def _deployments(rng, n):
    keys = [f"p{i}" for i in range(12)] + ["gone"]
    start = {k: rng.choice([None, "queued", "deployed", "in-progress"]) for k in keys[:-1]}
    rows = [(k, ts, s, to, rng.choice(["h", "h", "h", "old", None]))
            for k, ts, s, to, _ in _log(rng, n, keys, ["in-progress", "in-progress", "deployed", "failed"])]
    return rows, start


def _deployed(spark, start):
    return spark.createDataFrame([(k, v, "h") for k, v in start.items()], "identifier string, deployment string, definition_hash string")


def _as_files(spark, pieces, path):
    for piece in pieces:
        part = spark.createDataFrame(piece, DEPLOYMENT).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken in order of their modification time
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.mark.parametrize("seed", [21, 22])
def test_deployment_verdicts_of_files_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, start = _deployments(rng, 300)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    mixed = ordered[::7]
    rest = [r for r in ordered if r not in mixed]
    pieces = [rest[i : i + 65] for i in range(0, len(rest), 65)]
    rng.shuffle(pieces)
    stream = _as_files(spark, [*reversed(pieces), mixed], tmp_path / "changes")
    given = R.run_to_end(deployment_verdicts(stream, _deployed(spark, start)), "test-verdicts").cache()
    assert given.where("revision > 1").count() > 0
    got = {r.seq: r.verdict for r in last_verdicts(given).collect()}
    expected = _replay_deployments(rows, start)
    assert got == expected and set(expected.values()) >= {"applied", "stale outcome", "unknown process"}
    # The same outcome as that of the whole table at once.
    log = spark.createDataFrame(rows, DEPLOYMENT)
    applied = {r.process_identifier: r.n_applied for r in Jb.fold_deployments(log, _deployed(spark, start)).collect()}
    counts = {}
    for key, _, seq, *_ in rows:
        counts[key] = counts.get(key, 0) + (got[seq] == "applied")
    assert applied == {k: v for k, v in counts.items() if k in start}


def test_deployments_with_a_horizon_settle(spark, tmp_path):
    """In order, a horizon changes nothing; what comes later than it is dropped, and silent processes are settled."""
    rng = random.Random(23)
    rows, start = _deployments(rng, 240)
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    pieces = [ordered[i : i + 60] for i in range(0, 240, 60)]
    late = (ordered[0][0], ordered[0][1] - dt.timedelta(days=3), 9999, "in-progress", "h")
    far = ("gone", START + dt.timedelta(days=9), 8888, "in-progress", "h")
    last = ("gone", START + dt.timedelta(days=9), 7777, "in-progress", "h")
    stream = _as_files(spark, [*pieces, [far], [last], [late]], tmp_path / "changes")
    given = R.run_to_end(deployment_verdicts(stream, _deployed(spark, start), "1 minute"), "test-verdicts").cache()
    got = {r.seq: r.verdict for r in last_verdicts(given).collect()}
    assert 9999 not in got and got.pop(8888) == got.pop(7777) == "unknown process"
    assert got == _replay_deployments(rows, start)


def test_admission(spark):
    users = spark.createDataFrame([("ann", ["process-p2:viewer"]), ("bob", [])], "id string, scopes array<string>")
    processes = spark.createDataFrame(
        [("p1", "bob", True, "deployed"), ("p2", "bob", False, "deployed"), ("p3", "bob", True, None)],
        "identifier string, owner_id string, is_public boolean, deployment string",
    )
    asked = [(None, "p1"), (None, "p2"), ("ann", "p1"), ("ann", "p2"), ("ann", "p3"), ("ann", "p9"), ("cat", "p2")]
    requests = spark.createDataFrame(asked, "user_id string, process string")
    got = {(r.user_id, r.process): (r.reason, r.owner_id, r.is_public) for r in Jb.admit(requests, processes, users).collect()}
    no = (None, None)
    assert got == {
        (None, "p1"): (None, "bob", True), (None, "p2"): ("not permitted", *no), ("ann", "p1"): (None, "ann", False),
        ("ann", "p2"): (None, "ann", False), ("ann", "p3"): ("not deployed", *no), ("ann", "p9"): ("not found", *no),
        ("cat", "p2"): ("not permitted", *no),
    }


def test_execute_requests(spark):
    bodies = [
        None, "{}", '{"inputs": {"a": [1, {"b": null}], "c": "x"}, "response": "document"}',
        '{"outputs": {"o": {}, "p": {"format": "text/csv", "transmissionMode": "reference"}, "q": {"format_": "f", "transmission_mode": "value"}}}',
        '{"subscriber": {"successUri": "s", "failedUri": "f"}}', '{"subscriber": {"success_uri": "s", "in_progress_uri": "i"}}',
        '{"response": "html"}', '{"outputs": {"o": {"transmissionMode": "mail"}}}', '{"subscriber": {"failedUri": "f"}}', "[1]", "nonsense", '{"subscriber": null}',
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = {r.id: r for r in Jb.read_execute_requests(rows).collect()}
    assert [got[i].problem for i in range(12)] == [None] * 6 + [
        "unknown response", "unknown transmission mode", "subscriber without success uri", "not a request", "not a request", None,
    ]
    assert [got[i].inputs for i in (0, 1, 2)] == ["{}", "{}", '{"a":[1,{"b":null}],"c":"x"}']
    assert [got[i].response_type for i in (0, 2)] == ["raw", "document"]
    assert {k: tuple(v) for k, v in got[3].outputs.items()} == {"o": (None, "value"), "p": ("text/csv", "reference"), "q": ("f", "value")}
    assert tuple(got[4].callback_uris) == ("s", None, "f") and tuple(got[5].callback_uris) == ("s", "i", None)
    assert got[0].outputs == {} and got[0].callback_uris is None and got[11].callback_uris is None


def test_job_rows_are_whole_or_refused(spark):
    users = spark.createDataFrame([("ann", [])], "id string, scopes array<string>")
    processes = spark.createDataFrame([("p1", "bob", True, "deployed"), ("p2", "bob", True, None)],
                                      "identifier string, owner_id string, is_public boolean, deployment string")
    asked = [("ann", "p1", '{"inputs": {"a": 1}}'), (None, "p1", None), ("ann", "p2", "{}"), ("ann", "p1", "oops"), ("ann", "p9", "{}")]
    rows = Jb.job_rows(spark.createDataFrame(asked, "user_id string, process string, body string"), processes, users).collect()
    got = {(r.user_id, r.process, r.reason): (r.status, r.owner_id, r.inputs, r.response_type, r.processing_entity_type) for r in rows}
    none = (None,) * 5
    assert got == {
        ("ann", "p1", None): ("accepted", "ann", '{"a":1}', "raw", "ogc-api-processes"),
        (None, "p1", None): ("accepted", "bob", "{}", "raw", "ogc-api-processes"),
        ("ann", "p2", "not deployed"): none, ("ann", "p1", "not a request"): none, ("ann", "p9", "not found"): none,
    }


def test_messages_and_exceptions_of_steps(spark):
    t = lambda n: START + dt.timedelta(seconds=n)
    rows = [
        ("a", t(1), 1, "accepted", 0, "hello", None), ("a", t(2), 2, "running", 5, None, None), ("a", t(3), 3, "accepted", 9, "refused", "{}"),
        ("a", t(4), 4, "failed", 50, "it broke", '{"type":"x"}'), ("b", t(1), 5, "accepted", 0, "only", None), ("b", t(2), 6, "running", 1, None, None),
        ("c", t(1), 7, "running", 1, "never", "never"),
    ]
    log = spark.createDataFrame(rows, CHANGE + ", message string, exception string")
    got = {r.job_identifier: (r.status, r.message, r.exception) for r in Jb.job_status(Jb.fold_job_changes(log)).collect()}
    assert got == {"a": ("failed", "it broke", '{"type":"x"}'), "b": ("running", "only", None), "c": (None, None, None)}
    assert "message" not in Jb.status_changes(Jb.fold_job_changes(log)).columns


# --- events ---------------------------------------------------------------------------------


def test_recipients_of_job_events(spark):
    from featlake.operators import access as A

    users = spark.createDataFrame(
        [("ann", True, ["job-j1:viewer"]), ("bob", True, []), ("cat", True, ["process-p1:editor"]), ("dan", False, ["job-j1:viewer"])],
        "id string, is_active boolean, scopes array<string>",
    )
    processes = spark.createDataFrame([("p1", "bob", True)], "identifier string, owner_id string, is_public boolean")
    jobs = spark.createDataFrame([("j1", "p1", "ann", False), ("j2", "p1", "ann", True), ("j3", "p1", "ann", False)],
                                 "identifier string, process_identifier string, owner_id string, is_public boolean")
    rows = [("e1", "j1", "created", None), ("e2", "j2", "status_changed", None), ("e3", "gone", "created", None),
            ("e4", "gone", "deleted", (False, ["x", "y"])), ("e5", "gone", "deleted", (True, None)), ("e6", "j1", "created", None)]
    events = spark.createDataFrame(rows, "key string, job_identifier string, event_type string, audience struct<is_public:boolean,user_ids:array<string>>")
    got = sorted(((r.key, r.user_id) for r in A.job_event_audience(events, jobs, processes, users).collect()), key=str)
    expected = [(e, u) for e in ("e1", "e6") for u in ("ann", "bob", "cat")] + [("e2", None), ("e4", "x"), ("e4", "y"), ("e5", None)]
    assert got == sorted(expected, key=str)


_CARRIED = "key string, job_identifier string, event_type string, audience struct<is_public:boolean,user_ids:array<string>>"
_JOBS = "identifier string, process_identifier string, owner_id string, is_public boolean"


def _shuffled(node) -> int:
    """Rows written to shuffles below a plan that has run; those of a reused one count once."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_events_meet_members_without_a_list_per_job(spark):
    """Sixty jobs of one process with 500 members: 30,000 messages, but no list of 30,000 rows is shuffled."""
    from featlake.operators import access as A

    users = spark.range(500).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"), F.lit(True).alias("is_active"), F.array(F.lit("process-p1:viewer")).alias("scopes")
    )
    processes = spark.createDataFrame([("p1", "u1", False)], "identifier string, owner_id string, is_public boolean")
    jobs = spark.range(60).select(
        F.concat(F.lit("j"), F.col("id").cast("string")).alias("identifier"), F.lit("p1").alias("process_identifier"),
        F.lit("u2").alias("owner_id"), F.lit(False).alias("is_public"),
    )
    events = jobs.select(F.col("identifier").alias("key"), F.col("identifier").alias("job_identifier"), F.lit("created").alias("event_type"),
                         F.lit(None).cast("struct<is_public:boolean,user_ids:array<string>>").alias("audience"))
    told = A.job_event_audience(events, jobs, processes, users).select("key", "user_id")
    got = told.collect()
    assert len(got) == len(set(got)) == 30_000
    assert _shuffled(told._jdf.queryExecution().executedPlan()) < 15_000


@pytest.mark.parametrize("messages", [1, 1 << 30])
def test_recipients_of_jobs_that_come_more_than_once(spark, monkeypatch, messages):
    """Each row of a job repeats its messages; who is told is told by all private rows of the identifier."""
    from featlake.operators import access as A

    monkeypatch.setattr(A, "_TASK_MESSAGES", messages)
    users = spark.createDataFrame(
        [("ann", True, ["job-j1:viewer", "process-p1:viewer"]), ("bob", True, ["process-p2:viewer"]), ("cat", True, ["process-p1:editor"]),
         ("dan", False, ["process-p1:viewer"]), ("eve", True, ["job-j4:viewer"]), ("eve", True, [None])],
        "id string, is_active boolean, scopes array<string>",
    )
    processes = spark.createDataFrame([("p1", "bob", True), ("p2", None, False), ("p2", "eve", True)], "identifier string, owner_id string, is_public boolean")
    jobs = spark.createDataFrame(
        [("j1", "p1", "ann", False), ("j1", "p2", "dan", False), ("j1", None, None, True), ("j2", "p1", None, False), ("j2", "p1", None, False),
         ("j3", None, "cat", False), ("j4", "gone", "x", None), ("j4", "gone", "x", False), (None, "p1", "ann", False)], _JOBS)
    rows = [("e1", "j1", "created", None), ("e2", "j2", "created", None), ("e3", "j3", "created", None), ("e4", "j4", "created", None),
            ("e5", "j1", "deleted", (False, ["x", None])), ("e6", None, "created", None), ("e7", "j1", None, None), ("e3", "j3", "created", None),
            ("e8", "j1", "deleted", (False, None)), ("e9", None, "deleted", (True, []))]
    got = [(r.key, r.user_id) for r in A.job_event_audience(spark.createDataFrame(rows, _CARRIED), jobs, processes, users).collect()]
    expected = [("e1", None)] + [("e1", u) for u in ("ann", "bob", "cat", "eve")] * 2 + [("e2", u) for u in ("ann", "bob", "cat")] * 2
    expected += [("e3", "cat")] * 2 + [("e4", "eve")] + [("e5", u) for u in ("x", None)] * 3 + [("e9", None)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    told = [(r.identifier, r.user_id) for r in A.job_audience(jobs, processes, users).collect()]
    expected = [("j1", u) for u in ("ann", "bob", "cat", "eve")] + [(j, u) for j in ("j2", None) for u in ("ann", "bob", "cat")] + [("j3", "cat"), ("j4", "eve")]
    assert sorted(told, key=str) == sorted(expected, key=str)


def _event(**kw):
    base = {"event_type": "created", "process_identifier": "p1", "initiated_by": "u", "timestamp": "2024-01-01T00:00:00Z",
            "correlation_id": "c"}
    return json.dumps({k: v for k, v in {**base, **kw}.items() if v is not None})


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (_event(), None), (_event(timestamp="2024-01-01T00:00:00+02:00"), None), ("{", "not an event"),
        (_event(event_type="renamed"), "unknown event type"), (_event(process_identifier=None), "no identifier"),
        (_event(initiated_by=None), "no initiator"), (_event(timestamp="2024-01-01T00:00:00"), "bad timestamp"),
        (_event(timestamp="todayZ"), "bad timestamp"), (_event(correlation_id=None), "no correlation id"),
        (_event(event_type="deleted"), "deletion without audience"),
        (_event(event_type="deleted", audience={"is_public": False, "user_ids": ["a"]}), None),
    ],
)
def test_event_validation(spark, text, reason):
    assert E.read_events(spark.createDataFrame([(text,)], "value string")).first().reject_reason == reason


def test_job_events_may_be_anonymous(spark):
    text = _event(initiated_by=None, process_identifier=None, job_identifier="j1", event_type="status_changed")
    row = E.read_events(spark.createDataFrame([(text,)], "value string"), kind="job").first()
    assert row.reject_reason is None and row.job_identifier == "j1"


@pytest.mark.parametrize(
    ("topic", "subject", "allowed"),
    [("public/x", None, True), ("public", "a", False), ("users/a/x", "a", True), ("users/a/#", "a", True),
     ("users/ab/x", "a", False), ("users/+/x", "+", False), ("#", "a", False), ("+/a/x", "a", False), ("users//x", "", False)],
)
def test_topics(spark, topic, subject, allowed):
    row = spark.createDataFrame([(topic, subject)], "t string, s string")
    assert row.select(E.topic_allowed(F.col("t"), F.col("s"))).first()[0] is allowed


def test_fan_out_of_a_stream_equals_the_batch(spark, tmp_path):
    users = spark.createDataFrame(
        [("ann", True, ["process-p1:viewer"]), ("a/b", True, ["process-p1:viewer"]), ("cat", False, ["process-p1:viewer"]),
         ("bob", True, [])], "id string, is_active boolean, scopes array<string>")
    processes = spark.createDataFrame([("p1", "bob", False), ("p2", "bob", True)],
                                      "identifier string, owner_id string, is_public boolean")
    rows = [
        ("e1", "created", "p1", None), ("e2", "updated", "p2", None), ("e3", "deployment_failed", "p2", None),
        ("e4", "deleted", "p1", (False, ["x", "y#"])), ("e5", "deleted", "p2", (True, [])), ("e6", "created", "gone", None),
    ]
    schema = "event_key string, event_type string, process_identifier string, audience struct<is_public:boolean,user_ids:array<string>>"
    events = spark.createDataFrame(rows, schema)
    batch = E.fan_out(E.to_external(events, "http://h"), processes, users).select("event_key", "topic")
    expected = {
        ("e1", "users/ann/processes/p1/created"), ("e1", "users/bob/processes/p1/created"),
        ("e2", "public/processes/p2/updated"), ("e4", "users/x/processes/p1/deleted"), ("e5", "public/processes/p2/deleted"),
    }
    assert {tuple(r) for r in batch.collect()} == expected
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    sent = E.fan_out(E.to_external(stream, "http://h"), processes, users).select("event_key", "topic")
    assert {tuple(r) for r in R.run_to_end(sent, "test-fan-out").collect()} == expected


def test_repeats_are_dropped_and_first_deliveries_never(spark, tmp_path):
    # Four files, the newest events first, one file per micro-batch.
    rows = [(f"e{i % 40}", START - dt.timedelta(days=i % 40)) for i in range(160)]
    for i in range(4):
        df = spark.createDataFrame(rows[i * 40 : i * 40 + 40] + rows[:3], "event_key string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("old", START - dt.timedelta(days=9000))], df.schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert R.run_to_end(E.drop_repeats(stream, "event_key"), "test-repeats").count() == 41


def test_streams_read_tables_of_several_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "events_old.parquet"))
    got = R.run_to_end(R.read_table_stream(spark, str(tmp_path), "events", 1), "test-table")
    assert got.count() == events.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        R.read_table_stream(spark, str(tmp_path), "missing")
