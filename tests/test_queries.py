"""Every registered query beside its SQL, and the shape of the plans."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from featlake.session import tune

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# Queries that SQL cannot state are held against plain Python in tests of their own.
@pytest.mark.parametrize("key", [k for k in QUERIES if k in ORACLES])
def test_query_equals_its_sql(spark, duck, key):
    text, _ = compare(spark, duck, FOLDER, key, QUERIES[key], ORACLES.get(key))
    assert text.startswith("ok"), text


def _plan(spark, key):
    df = QUERIES[key](tune(spark), FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that run streams or write files while they are built are left to the test above.
LAZY = [k for k in QUERIES if not k.startswith(("src_", "events_dedup", "events_streamed", "extract_"))]


@pytest.mark.parametrize("key", LAZY)
def test_no_cross_joins(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_page_is_a_bounded_top_k(spark):
    # Also with reprojection and further columns on top of the page.
    for key in ("list_features", "sort_by", "page", "geojson_page"):
        plan = _plan(spark, key)
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
        assert "tan" not in plan.lower().split("takeorderedandproject")[1]


def test_select_props_reads_only_what_it_returns(spark):
    plan = _plan(spark, "select_props")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_counts_read_no_properties(spark):
    assert "props" not in _plan(spark, "count_items").split("ReadSchema")[1]


def test_stored_bounds_reach_the_scan(spark, tmp_path):
    from featlake.operators.filters import FeatureFilter
    from featlake.plans.registry import Tables
    from featlake.plans.shapes import parcels
    from featlake.sources import readers as S
    from featlake.table import FeatureTable

    target = str(tmp_path / "stored")
    S.write_feature_parquet(parcels(Tables(spark, FOLDER)).df, target)
    table = FeatureTable(S.read_parquet(spark, target), id="id", geom="geom")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = table.select(FeatureFilter(bbox=(0, 0, 10, 10)))
    pushed = rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1].split("]")[0]
    for text in ("LessThanOrEqual(xmin,10.0)", "GreaterThanOrEqual(xmax,0.0)", "LessThanOrEqual(ymin,10.0)"):
        assert text in pushed


def test_partition_filter_prunes(spark, tmp_path):
    from featlake.plans.registry import Tables
    from featlake.sources import readers as S

    Tables(spark, FOLDER).obs.write.partitionBy("event_type").parquet(str(tmp_path / "parts"))
    rows = S.read_parquet(spark, str(tmp_path / "parts")).where("event_type = 'click'")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() >= 0
