"""Snapshots in buckets and maps of files: results, and what is left alone."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from featlake.operators import catalog as K
from featlake.operators import describe as D
from featlake.operators import snapshots as Sn
from featlake.operators.zonemaps import ZoneMap
from featlake.sources import generations

CHANGE = "seq long, op string, identifier string, set_fields array<string>, title string, size int"


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def _log(rng, n, keys, first=0):
    ops = ["create", "update", "update", "update", "delete"]
    rows = []
    for seq in range(first, first + n):
        fields = rng.sample(["title", "size"], rng.randrange(3))
        rows.append((seq, rng.choice(ops), rng.choice(keys), fields, rng.choice([None, f"t{seq}"]), rng.choice([None, seq])))
    return rows


def _replay(state, rows):
    state = dict(state)
    for _, op, key, fields, title, size in rows:
        if op == "delete":
            state.pop(key, None)
        elif op == "create":
            state.setdefault(key, (title or "untitled", size))
        elif key in state:
            old = state[key]
            state[key] = (title or "untitled") if "title" in fields else old[0], size if "size" in fields else old[1]
    return state


def _rows(df):
    return {r.identifier: (r.title, r.size) for r in df.collect()}


def test_logs_applied_in_turn_equal_a_replay(spark, tmp_path):
    rng = random.Random(11)
    state = {f"k{i}": (f"old{i}", i) for i in range(300)}
    df = spark.createDataFrame([(k, *v) for k, v in state.items()], "identifier string, title string, size int")
    stored = Sn.store(df, "identifier", str(tmp_path / "s"), rows=20)
    assert stored.buckets == 16 and _rows(stored.read()) == state
    for turn in range(3):
        rows = _log(rng, 120, [f"k{i}" for i in range(330)], 1000 * turn)
        stored = stored.apply(spark.createDataFrame(rows, CHANGE), {"title": F.lit("untitled")})
        state = _replay(state, rows)
        assert _rows(stored.read()) == state
    # A reader that starts anew sees the last state; earlier files are still there for those that read them.
    assert _rows(Sn.Snapshot(spark, str(tmp_path / "s")).read()) == state and stored.generation == 4


def test_other_buckets_are_left_alone(spark, tmp_path):
    df = spark.range(500).selectExpr("concat('k', id) AS identifier", "'x' AS title", "CAST(id AS INT) AS size")
    stored = Sn.store(df, "identifier", str(tmp_path / "s"))
    before, folders = _files(tmp_path / "s"), dict(stored.folders)
    log = spark.createDataFrame([(1, "update", "k7", ["title"], "new", None), (2, "update", "nobody", ["title"], "new", None)], CHANGE)
    after = stored.apply(log)
    assert all(_files(tmp_path / "s")[f] == t for f, t in before.items())
    moved = {b for b in folders if after.folders[b] != folders[b]}
    assert 1 <= len(moved) <= 2 and len(_files(tmp_path / "s")) == len(before) + len(moved)
    assert _rows(after.read())["k7"] == ("new", 7) and after.read().count() == 500
    assert after.apply(log.limit(0)) is after


def test_a_bucket_may_become_empty_and_be_filled_again(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1)], "identifier string, title string, size int")
    stored = Sn.store(df, "identifier", str(tmp_path / "s"))
    gone = stored.apply(spark.createDataFrame([(1, "delete", "a", [], None, None)], CHANGE))
    assert gone.folders == {} and gone.read().count() == 0 and gone.read().columns == df.columns
    back = gone.apply(spark.createDataFrame([(2, "create", "a", [], "y", 2)], CHANGE))
    assert _rows(back.read()) == {"a": ("y", 2)}
    with pytest.raises(ValueError, match="no snapshot"):
        Sn.Snapshot(spark, str(tmp_path / "nowhere"))
    empty = Sn.store(df.limit(0), "identifier", str(tmp_path / "e"))
    assert empty.read().count() == 0


def test_stored_and_plain_changes_agree(spark, tmp_path):
    rng = random.Random(12)
    df = spark.range(80).selectExpr("concat('k', id) AS identifier", "'x' AS title", "CAST(id AS INT) AS size")
    log = spark.createDataFrame(_log(rng, 300, [f"k{i}" for i in range(90)]), CHANGE)
    plain = K.apply_changes(df, log, ["title", "size"])
    assert _rows(Sn.store(df, "identifier", str(tmp_path / "s")).apply(log).read()) == _rows(plain)


# --- maps of files --------------------------------------------------------------------------


def _features(spark, low, high):
    n = F.col("id")
    kind = F.when(n % 5 == 0, None).when(n % 3 == 0, F.lit("Point")).otherwise(F.lit("Polygon"))
    return spark.range(low, high, numPartitions=3).select(
        F.concat(F.lit("c"), (n % 3 * (n % 2)).cast("string")).alias("name"), *[(n * (1.5 if b.endswith("max") else 1)).alias(b) for b in ("xmin", "ymin", "xmax", "ymax")],
        F.timestamp_seconds(n * 1000).cast("timestamp_ntz").alias("begun"), F.when(n % 7 != 0, F.timestamp_seconds(n * 2000).cast("timestamp_ntz")).alias("ended"), kind.alias("kind"),
    )


def _map(spark, tmp_path):
    box = {b: F.col(b) for b in ("xmin", "ymin", "xmax", "ymax")}
    return ZoneMap(spark, str(tmp_path / "t"), str(tmp_path / "zones"), F.col("name"), box, F.col("begun"), F.col("kind"), F.col("ended"))


def _described(df):
    box = {b: F.col(b) for b in ("xmin", "ymin", "xmax", "ymax")}
    found = D.describe(df, "name", box, F.col("begun"), F.col("kind")).withColumnRenamed("name", "collection")
    ends = df.groupBy(F.col("name").alias("collection")).agg(D.temporal_extent(F.col("begun"), F.col("ended"))[1])
    return sorted(map(tuple, found.drop("temporal_end").join(ends, "collection").collect()))


def _known(zones):
    columns = ["collection", "n_features", "xmin", "ymin", "xmax", "ymax", "temporal_begin", "geometry_format", "temporal_end"]
    return sorted(map(tuple, zones.describe().select(columns).collect()))


def test_a_map_follows_its_table(spark, tmp_path):
    zones = _map(spark, tmp_path)
    with pytest.raises(ValueError, match="refresh"):
        zones.zones()
    _features(spark, 0, 300).write.parquet(str(tmp_path / "t"))
    assert zones.refresh() == 3 and zones.refresh() == 0
    assert _known(zones) == _described(spark.read.parquet(str(tmp_path / "t")))
    _features(spark, 300, 500).write.mode("append").parquet(str(tmp_path / "t"))
    assert zones.refresh() == 3
    assert _known(zones) == _described(spark.read.parquet(str(tmp_path / "t"))) and zones.total().first().total == 500
    # A file goes, a file comes in a folder below.
    os.remove(sorted(glob.glob(f"{tmp_path}/t/*.parquet"))[0])
    assert zones.refresh() == 0
    assert _known(zones) == _described(spark.read.parquet(str(tmp_path / "t")))


def test_a_map_is_read_alone_and_names_files(spark, tmp_path):
    zones = _map(spark, tmp_path)
    for low in (0, 1000, 2000):
        _features(spark, low, low + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    zones.refresh()
    assert all("/zones/" in f for f in zones.describe().inputFiles())
    assert len(zones.overlapping((1000, 1000, 1001, 1001))) == 1 and zones.overlapping((-5, -5, -1, -1)) == []
    assert len(zones.overlapping((0, 0, 5000, 5000))) == 3


def test_generations(spark, tmp_path):
    assert generations.latest(spark, str(tmp_path / "g")) == (0, None)
    for k in (1, 2, 11):
        generations.add(spark.range(k), str(tmp_path / "g"), k)
    number, rows = generations.latest(spark, str(tmp_path / "g"))
    assert number == 11 and rows.count() == 11 and rows.columns == ["id"]
