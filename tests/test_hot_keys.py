"""A key with a third or nine tenths of all rows is split over tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featlake.operators import access as A
from featlake.operators import catalog as K
from featlake.operators import jobs as Jb
from featlake.operators import spatial_join as Sj
from featlake.operators.skew import row_hash, split_join
from featlake.streaming import events as E

_SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    """Thresholds scaled down to the size of a test, and no broadcasts."""
    before = {k: spark.conf.get(k, None) for k in _SMALL}
    for k, v in _SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def _questions(spark, n):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000)
    return spark.range(n, numPartitions=16).select(
        F.col("id").alias("q"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("u"), (F.col("id") % 911).cast("string"))).alias("user_id"),
        F.concat(F.lit("p"), hot.cast("string")).alias("process"),
    )


def _processes(spark):
    return spark.range(5000, numPartitions=16).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("identifier"),
        F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("owner_id"),
        (F.col("id") % 2 == 1).alias("is_public"),
        F.lit("deployed").alias("deployment"),
    )


def _users(spark):
    return spark.range(911, numPartitions=16).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"),
        F.lit(True).alias("is_active"),
        F.array(F.lit("process-p0:viewer")).alias("scopes"),
    )


def test_permissions_on_a_hot_process(spark, small_partitions):
    asked, processes, users = _questions(spark, 60000), _processes(spark), _users(spark)
    rows, plan = _final_plan(A.decide(asked, processes, users, "process", "process"))
    assert len(rows) == 60000 and "skew=true" in plan
    assert all(r.can_view == (r.user_id is not None) for r in rows if r.process == "p0")


def test_changes_of_a_hot_job(spark, small_partitions):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000)
    kinds = F.array(*[F.lit(s) for s in ("accepted", "running", "noise")])
    changes = spark.range(60000, numPartitions=16).select(
        hot.cast("string").alias("job_identifier"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("seq"),
        F.element_at(kinds, (F.col("id") % 2 + 1).cast("int")).alias("to_status"),
        F.lit(1).alias("progress"),
    )
    rows, plan = _final_plan(Jb.job_status(Jb.fold_job_changes(changes)))
    # Joins with per-job aggregates are split, and the aggregates are reduced before the shuffle.
    assert "skew=true" in plan
    assert {r.job_identifier: r.status for r in rows}["0"] == "running"
    assert "partial_min" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_the_plain_join(spark, how):
    many = spark.range(3000).select((F.col("id") % 3 * F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    many = many.unionByName(many.where("v < 50").withColumn("k", F.lit(None).cast("bigint")))
    few = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    few = few.unionByName(few.withColumn("w", F.col("w") + 1))
    plain = many.join(few, ["k"], how)
    split = split_join(many, few, ["k"], how)
    assert split.columns == plain.columns
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))


def _most_in_a_task(df):
    """The largest share of the result's rows that one task has, and the plan that ran."""
    counted = df.groupBy(F.spark_partition_id().alias("task")).count()
    rows, plan = _final_plan(counted)
    return max(r["count"] for r in rows) / sum(r["count"] for r in rows), plan


@pytest.mark.parametrize("aggregated", [False, True])
def test_equal_rows_of_one_key_are_split(spark, small_partitions, aggregated):
    """Nine tenths of the rows are equal in all columns; the other side is plain or an aggregate.

    Spark measures compressed bytes, and equal rows are few of them.
    """
    for key in ("advisoryPartitionSizeInBytes", "skewJoin.skewedPartitionThresholdInBytes"):
        spark.conf.set(f"spark.sql.adaptive.{key}", "1000")
    many = spark.range(80000, numPartitions=16).select(
        F.when(F.col("id") % 10 != 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), F.lit(20)).alias("v")
    )
    few = many.groupBy("k").agg(F.count("*").alias("n")) if aggregated else many.select("k").distinct().withColumn("n", F.lit(1))
    share, plan = _most_in_a_task(split_join(many, few, ["k"]))
    assert "skew=true" in plan and share < 0.5
    if aggregated:
        # What the key costs without: Spark joins the aggregate as it lies.
        share, plan = _most_in_a_task(many.join(few, ["k"]))
        assert "skew=true" not in plan and share > 0.9


def test_permissions_with_one_job_in_nine_questions_of_ten(spark, small_partitions):
    n = F.col("id")
    asked = spark.range(60000, numPartitions=16).select(
        F.concat(F.lit("u"), (n % 3).cast("string")).alias("user_id"),
        F.when(n % 10 != 0, F.lit("j0")).otherwise(F.concat(F.lit("j"), (n % 5000).cast("string"))).alias("job"),
    )
    jobs = spark.range(5000, numPartitions=16).select(
        F.concat(F.lit("j"), n.cast("string")).alias("identifier"), F.lit("u1").alias("owner_id"), F.lit(False).alias("is_public"),
        F.concat(F.lit("p"), (n % 7).cast("string")).alias("process_identifier"),
    )
    rows, plan = _final_plan(A.decide_jobs(asked, jobs, _processes(spark), _users(spark)))
    assert len(rows) == 60000 and "skew=true" in plan
    assert {(r.user_id, r.can_view) for r in rows if r.job == "j0"} == {("u0", True), ("u1", True), ("u2", True)}


def test_changes_of_one_record_in_nine_of_ten(spark, small_partitions):
    n = F.col("id")
    log = spark.range(60000, numPartitions=16).select(
        n.alias("seq"), F.when(n % 10 != 0, F.lit("hot")).otherwise(n.cast("string")).alias("identifier"),
        F.when(n < 10, "create").otherwise("update").alias("op"), F.array(F.lit("title")).alias("set_fields"),
        F.concat(F.lit("t"), n.cast("string")).alias("title"),
    )
    snapshot = spark.createDataFrame([("20", "old"), ("30", "old"), ("x", "kept")], "identifier string, title string")
    rows, plan = _final_plan(K.apply_changes(snapshot, log, ["title"]))
    assert "skew=true" in plan
    assert {r.identifier: r.title for r in rows} == {"hot": "t59999", "0": "t0", "20": "t20", "30": "t30", "x": "kept"}


def test_fan_out_of_one_process(spark, small_partitions):
    n = F.col("id")
    events = spark.range(40000, numPartitions=16).select(
        n.cast("string").alias("event_key"), F.lit("updated").alias("event_type"),
        F.when(n % 10 != 0, F.lit("p0")).otherwise(F.concat(F.lit("p"), (n % 5000).cast("string"))).alias("process_identifier"),
        F.lit(None).cast("struct<is_public:boolean,user_ids:array<string>>").alias("audience"),
    )
    users = _users(spark).where("id < 'u12'")
    messages, plan = _final_plan(E.fan_out(E.to_external(events, "http://h"), _processes(spark), users))
    members = users.count()
    assert "skew=true" in plan
    assert sum(r.process_identifier == "p0" for r in messages) == members * 36008


def test_nine_tenths_of_the_points_in_one_city(spark, small_partitions):
    n = F.col("id")
    near = n % 10 != 0
    points = spark.range(60000, numPartitions=16).select(
        "id", F.when(near, 13.4 + (n % 997) / 99700).otherwise((n * 7 % 3600) / 10 - 180).alias("xmin"),
        F.when(near, 52.5 + (n % 991) / 99100).otherwise((n * 3 % 1700) / 10 - 85).alias("ymin"),
    ).select("id", "xmin", "ymin", F.col("xmin").alias("xmax"), F.col("ymin").alias("ymax"))
    # Small boxes all over the city, and a few that hold it.
    boxes = [(k, 13.4 + k / 40000, 52.5 + k / 50000, 13.4 + k / 40000 + 2e-4, 52.5 + k / 50000 + 2e-4) for k in range(300)]
    boxes += [(1000, 13.0, 52.0, 14.0, 53.0), (1001, -180.0, -90.0, 180.0, 90.0)]
    q = spark.createDataFrame(boxes, "request_id int, q_xmin double, q_ymin double, q_xmax double, q_ymax double")
    rows, plan = _final_plan(Sj.join_boxes(points, q).groupBy("request_id").count())
    assert "skew=true" in plan
    where = points.select("xmin", "ymin").toPandas()
    expected = {}
    for k, a, b, c, d in boxes:
        hits = ((where.xmin >= a) & (where.xmin <= c) & (where.ymin >= b) & (where.ymin <= d)).sum()
        if hits:
            expected[k] = int(hits)
    assert {r.request_id: r["count"] for r in rows} == expected


def test_row_hashes_spread_a_hot_key(spark):
    many = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    counts = many.groupBy(F.pmod(row_hash(many), F.lit(8))).count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 2000
