"""Access rules, catalogue changes and imports against plain Python replays."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from featlake.operators import access as A
from featlake.operators import catalog as K
from featlake.operators import configuration as Cf
from featlake.operators import describe as D

USERS = [
    ("admin", True, ["admin"]), ("alice", True, []), ("bob", True, ["collection-private:viewer", "process-p1:viewer"]),
    ("carol", False, ["process-p1:editor"]), ("dave", True, ["collection-private:editor", "job-j1:viewer"]), ("erin", True, []),
]


@pytest.fixture(scope="module")
def users(spark):
    rows = [(i, i.title(), a, s) for i, a, s in USERS]
    return spark.createDataFrame(rows, "id string, username string, is_active boolean, scopes array<string>")


@pytest.fixture(scope="module")
def collections(spark):
    rows = [("open", "alice", True), ("private", "alice", False)]
    return spark.createDataFrame(rows, "identifier string, owner_id string, is_public boolean")


@pytest.fixture(scope="module")
def processes(spark):
    rows = [("p1", "alice", False, "deployed"), ("p2", "alice", True, None)]
    return spark.createDataFrame(rows, "identifier string, owner_id string, is_public boolean, deployment string")


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [("j1", "erin", "p1", False), ("j2", "erin", "p2", True)]
    return spark.createDataFrame(rows, "identifier string, owner_id string, process_identifier string, is_public boolean")


@pytest.mark.parametrize(
    ("user", "seen"),
    [(None, {"open"}), ("erin", {"open"}), ("bob", {"open", "private"}), ("dave", {"open", "private"}),
     ("alice", {"open", "private"}), ("admin", {"open", "private"})],
)
def test_visible_collections(collections, users, user, seen):
    assert {r.identifier for r in A.visible_to(collections, users, "collection", user).collect()} == seen


@pytest.mark.parametrize(
    ("user", "seen"),
    [(None, {"j2"}), ("erin", {"j1", "j2"}), ("bob", {"j1", "j2"}), ("dave", {"j1", "j2"}), ("alice", {"j1", "j2"}),
     ("admin", {"j1", "j2"}), ("nobody", {"j2"})],
)
def test_visible_jobs(jobs, processes, users, user, seen):
    assert {r.identifier for r in A.visible_jobs(jobs, processes, users, user).collect()} == seen


def test_decisions(spark, collections, users):
    asked = [(u, c) for u in (None, "admin", "alice", "bob", "dave", "erin") for c in ("open", "private", "gone")]
    questions = spark.createDataFrame(asked, "user_id string, collection string")
    got = {
        (r.user_id, r.collection): (r.can_view, r.can_edit, r.can_change_owner)
        for r in A.decide(questions, collections, users, "collection", "collection").collect()
    }
    no, view, edit, own = (False,) * 3, (True, False, False), (True, True, False), (True,) * 3
    expected = {(u, "gone"): no for u in (None, "admin", "alice", "bob", "dave", "erin")}
    expected |= {(None, "open"): view, ("bob", "open"): view, ("dave", "open"): view, ("erin", "open"): view}
    expected |= {("admin", "open"): own, ("alice", "open"): own, ("admin", "private"): own, ("alice", "private"): own}
    expected |= {(None, "private"): no, ("bob", "private"): view, ("dave", "private"): edit, ("erin", "private"): no}
    assert got == expected


def test_job_decisions(spark, jobs, processes, users):
    questions = spark.createDataFrame([(u, "j1") for u in (None, "erin", "bob", "carol", "dave", "alice")],
                                      "user_id string, job string")
    rows = A.decide_jobs(questions, jobs, processes, users).collect()
    got = {r.user_id: (r.can_view, r.can_cancel, r.can_update_status) for r in rows}
    assert got == {None: (False, False, False), "erin": (True, True, False), "bob": (True, False, False),
                   "carol": (True, True, False), "dave": (True, False, False), "alice": (True, True, False)}


def test_audiences(jobs, processes, users):
    # Carol edits the process but is not active.
    assert {tuple(r) for r in A.audience(processes, users, "process").select("identifier", "user_id").collect()} == {
        ("p1", "alice"), ("p1", "bob")}
    told = {r.user_id for r in A.job_audience(jobs, processes, users).where("identifier = 'j1'").collect()}
    assert told == {"erin", "dave", "alice", "bob"}
    assert A.job_audience(jobs, processes, users).where("identifier = 'j2'").count() == 0


def test_members_need_a_caller(users):
    assert [r.user_id for r in A.members(users, "collection", "editor", "erin").collect()] == ["dave"]
    with pytest.raises(A.NotAllowed):
        A.members(users, "collection", "editor", None)
    with pytest.raises(ValueError):
        A.members(users, "house", "editor", "erin")


def test_scope_assignment(spark, collections, users):
    rows = [(1, "dave", ["collection-private:viewer"]), (2, "dave", ["collection-open:viewer"]), (3, "dave", []),
            (4, "dave", ["process-p1:viewer"]), (5, "admin", ["admin"]), (6, None, []), (7, "alice", ["admin"])]
    requests = spark.createDataFrame(rows, "request_id int, user_id string, new_scopes array<string>")
    got = {r.request_id: r.is_allowed for r in A.may_set_scopes(requests, collections, users).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False}


def test_grants_and_revocations(spark, collections, users):
    rows = [(1, "alice", "erin", "private", "viewer"), (2, "alice", "erin", "private", "editor"),
            (3, "erin", "erin", "open", "editor"), (4, "dave", "bob", "private", None), (5, "alice", "ghost", "private", "editor")]
    changes = spark.createDataFrame(rows, "seq int, granted_by string, user_id string, resource_id string, role string")
    after = A.apply_grants(users, changes, collections, "collection").where("resource_type = 'collection'")
    assert {(r.user_id, r.resource_id, r.role) for r in after.collect()} == {
        ("erin", "private", "editor"), ("dave", "private", "editor")}


# --- changes --------------------------------------------------------------------------------


def _replay(snapshot, log):
    state = {k: dict(v) for k, v in snapshot.items()}
    for _, key, op, set_fields, values in log:
        if op == "delete":
            state.pop(key, None)
        elif op == "create" and key not in state:
            state[key] = dict(values)
        elif op == "update" and key in state:
            state[key].update({f: values[f] for f in set_fields})
    return state


def test_changes_equal_a_replay(spark):
    rng = random.Random(8)
    snapshot = {f"c{i}": {"title": f"t{i}", "crs": None} for i in range(0, 40, 2)}
    log = []
    for seq in range(900):
        # One key has a third of all changes.
        key = "c0" if rng.random() < 0.33 else f"c{rng.randrange(60)}"
        op = rng.choices(["create", "update", "delete"], [2, 6, 1])[0]
        fields = [f for f in ("title", "crs") if rng.random() < 0.5]
        log.append((seq, key, op, fields, {"title": f"n{seq}", "crs": rng.choice([None, f"x{seq}"])}))
    old = spark.createDataFrame([(k, v["title"], v["crs"]) for k, v in snapshot.items()],
                                "identifier string, title string, crs string")
    changes = spark.createDataFrame([(s, k, o, f, v["title"], v["crs"]) for s, k, o, f, v in log],
        "seq int, identifier string, op string, set_fields array<string>, title string, crs string")
    rng.shuffle(log)
    got = {r.identifier: {"title": r.title, "crs": r.crs} for r in K.apply_changes(old, changes, ["title", "crs"]).collect()}
    assert got == _replay(snapshot, sorted(log, key=lambda c: c[0]))


def test_import(spark):
    def doc(**kw):
        return json.dumps({"title": "T", **kw})

    box = {"spatial": {"bbox": [1, 2, 3, 4]}}
    feature = {"type": "feature", "name": "a", "data": "d", "crs": ["x"], "storage_crs": "s"}
    rows = [
        ("new", doc(extents=box, providers=[feature, {**feature, "name": "b", "crs": ["y"]}])),
        ("open", doc(providers=[{"type": "map", "name": "m", "data": "d"}])),
        ("tiles", doc(providers=[{"type": "tile", "name": "m", "data": "d"}])),
        ("solid", doc(extents={"spatial": {"bbox": [1, 2, 0, 3, 4, 9]}}, providers=[feature])),
    ]
    documents = spark.createDataFrame(rows, "identifier string, document string")
    existing = spark.createDataFrame([("open",)], "identifier string")
    got = {r.identifier: r for r in K.import_resources(documents, existing, overwrite=False).collect()}
    assert [got[k].action for k in ("new", "open", "tiles", "solid")] == ["create", "rejected", "rejected", "create"]
    assert got["new"].crs == ["http://www.opengis.net/def/crs/OGC/1.3/CRS84", "x", "y"]
    assert [p.name for p in got["new"].providers] == ["a"] and got["open"].type == "coverage" and got["open"].crs is None
    assert got["solid"].extent_crs.endswith("CRS84h") and got["solid"].ymax == 4
    again = {r.identifier: r.action for r in K.import_resources(documents, existing, overwrite=True).collect()}
    assert again["open"] == "update"


def test_names_and_scopes(spark):
    names = {"abc": True, "ab": False, "1abc": False, "a-b_c9": True, "a b c": False, "a" * 100: True, "a" * 101: False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r[1] for r in df.select("n", K.valid_identifier(F.col("n"))).collect()} == names
    scopes = ["admin", "collection:creator", "job-x:editor", "house-x:editor", "process-:viewer", "process-a:b:viewer"]
    got = spark.range(1).select(K.invalid_scopes(F.array(*[F.lit(s) for s in scopes]))).first()[0]
    assert got == ["house-x:editor", "process-:viewer"]


def test_listing_filters_take_text_literally(spark):
    df = spark.createDataFrame([("a_b", "feature"), ("axb", "record"), ("A%B", "feature")], "identifier string, type string")
    assert [r.identifier for r in K.list_catalogue(df, identifier_contains="A_B").collect()] == ["a_b"]
    assert [r.identifier for r in K.list_catalogue(df, identifier_contains="%").collect()] == ["A%B"]
    assert K.list_catalogue(df, identifiers_in=[], types_in=["record"]).count() == 1


def test_type_names(spark):
    cases = {
        "INTEGER": {"type": "integer"}, "varchar(10)": {"type": "string"}, "DECIMAL(18,3)": {"type": "number"},
        "UUID": {"type": "string", "format": "uuid"}, "TIMESTAMP_NS": {"type": "string", "format": "date-time"},
        "TIMETZ": {"type": "string", "format": "time"}, "DOUBLE PRECISION": {"type": "number"}, "JSON": {}, "ENUM": {},
        "INTEGER[]": {"type": "array", "items": {"type": "integer"}},
        "LIST(DATE)": {"type": "array", "items": {"type": "string", "format": "date"}},
        "MAP(VARCHAR, BIGINT)": {"type": "object", "additionalProperties": {"type": "integer"}},
        "STRUCT(a INTEGER)": {"type": "object"}, "BLOB": {"type": "string", "contentEncoding": "base64"},
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: json.loads(r.s) for r in df.select("t", D.type_name_schema(F.col("t")).alias("s")).collect()}
    assert got == cases
    schema = spark.sql("SELECT 1 AS a, 1.5D AS b, true AS c, 'x' AS d, DATE'2020-01-01' AS e, array(1) AS f,"
                       " map('k', 2.0D) AS g, X'00' AS h, named_struct('n', 1) AS i, CAST(1.5 AS DECIMAL(4,1)) AS j").schema  # fmt: skip
    kinds = [D.type_schema(f.dataType) for f in schema.fields]
    assert [k.get("type") for k in kinds] == ["integer", "number", "boolean", "string", "string", "array", "object",
                                             "string", "object", "number"]


def test_first_value_decides_the_type(spark):
    bags = [(1, '{"a": null, "b": 1}'), (2, '{"a": "x", "b": 2.5}'), (3, '{"a": 3, "c": true}'), (4, "broken")]
    df = spark.createDataFrame(bags, "seq int, bag string")
    got = {r.property: json.loads(r.schema)["type"] for r in D.infer_properties(df, "bag", "seq").collect()}
    assert got == {"a": "string", "b": "integer", "c": "boolean"}


def test_definition_hash_ignores_the_order_of_nested_keys(spark):
    from featlake.operators import catalog as K

    a = ['{"b": {"y": [1, {"q": 1, "p": "x,\\"y: z"}], "x": null}, "a": 1}', '{"in": {"k": 1}}', "[]"]
    b = ['{"a":1,"b":{"x":null,"y":[1,{"p":"x,\\"y: z","q":1}]}}', '{"in":{"k":1}}', "[ ]"]
    c = [a[0].replace('"a": 1', '"a": 2'), a[1], a[2]]
    rows = spark.createDataFrame([tuple(a), tuple(b), tuple(c)], "u string, i string, o string")
    x, y, z = [r.h for r in rows.select(K.definition_hash(rows.u, rows.i, rows.o).alias("h")).collect()]
    assert x == y != z
    text = rows.select(K.canonical_json(rows.u).alias("t")).first().t
    assert text == '{"a": 1, "b": {"x": null, "y": [1, {"p": "x,\\"y: z", "q": 1}]}}'


# --- configuration entries ------------------------------------------------------------------


def _entries(spark, *rows):
    texts = [r if isinstance(r, str) or r is None else json.dumps(r) for r in rows]
    return spark.createDataFrame(list(enumerate(texts)), "position int, entry string")


def test_collections_from_entries(spark, users):
    whole = {"identifier": "a", "title": "A", "owner_id": "alice", "is_public": True, "type_": "feature"}
    rows = [
        whole, whole | {"title": "again", "spatial_extent": "POLYGON ((1 2, 3 2, 3 4, 1 2))", "temporal_extent_begin": "2024-01-01T00:00:00Z"},
        whole | {"identifier": "b", "owner_id": "nobody"}, whole | {"identifier": "c", "type_": "picture"}, whole | {"identifier": "d", "spatial_extent": "POINT 1"},
        whole | {"identifier": "e", "providers": {"film": {"provider_name": "x", "config": {}}}}, whole | {"identifier": "f", "providers": {"tile": {"config": {}}}},
        {"identifier": "g", "title": "G"}, "[]", "no json", None, {},
        whole | {"identifier": "h", "providers": {"feature": {"provider_name": "x", "config": {"a": [1, {"b": 2}]}}}, "crs": ["u"], "storage_crs": "u"},
    ]
    got = {r.position: r for r in Cf.load_collections(_entries(spark, *rows), users).collect()}
    assert 0 not in got and got[1].title == "again" and (got[1].xmin, got[1].ymax) == (1.0, 4.0) and str(got[1].temporal_begin) == "2024-01-01 00:00:00"
    assert [got[i].problem for i in range(1, 13)] == [
        None, "unknown owner", "unknown type", "extent is not well-known text", "unknown kind of provider", "incomplete provider",
        "a required member is missing", "a required member is missing", "not an entry", "not an entry", "a required member is missing", None,
    ]
    assert got[1].storage_crs.endswith("CRS84") and got[12].storage_crs == "u" and got[12].crs == ["u"]
    assert json.loads(got[12].providers["feature"].config) == {"a": [1, {"b": 2}]} and got[1].providers is None


def test_processes_from_entries(spark, users):
    whole = {"identifier": "a", "title": "A", "owner_id": "alice", "is_public": True}
    rows = [
        whole, whole | {"identifier": "b", "execution_unit": {"type_": "oci", "image": "i", "bindings_inputs": {"x": {"position": 1, "shell_quote": False}}}},
        whole | {"identifier": "c", "execution_unit": {"type_": "cwl", "definition": "d"}, "deployment_status": {"value": "deployed", "definition_hash": "h"}},
        whole | {"identifier": "d", "execution_unit": {"type_": "oci"}}, whole | {"identifier": "e", "deployment_status": {"value": "odd"}},
        whole | {"identifier": "f", "execution_unit": {"image": "i"}}, whole | {"identifier": "g", "inputs": [{"name": "x", "schema": {"type": "string"}}]},
    ]
    got = {r.identifier: r for r in Cf.load_processes(_entries(spark, *rows), users).collect()}
    assert {k: r.problem for k, r in got.items() if r.problem} == {
        "d": "container without an image", "e": "unknown deployment status", "f": "execution unit without a type",
    }
    assert got["a"].deployment == "failed" and (got["c"].deployment, got["c"].definition_hash) == ("deployed", "h")
    assert json.loads(got["b"].bindings_inputs["x"]) == {"position": 1, "shell_quote": False} and got["b"].bindings_outputs == {}
    assert got["c"].bindings_inputs is None and json.loads(got["g"].inputs[0])["schema"] == {"type": "string"} and got["a"].inputs == []
