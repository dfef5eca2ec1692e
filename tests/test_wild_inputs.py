"""Inputs that one-file fixtures do not show: odd names, deep nesting, long members, many files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracles import compare, connect
from featlake.operators import describe as D
from featlake.operators import geometry as G
from featlake.operators.projections import with_file_row_id
from featlake.plans.derived import GIVEN
from featlake.sources import readers as S

FOLDER = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
# These name the one file of the table in their result.
BY_FILE = ("surrogate_id",)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The given tables as folders of several files, rows in no order."""
    root = tmp_path_factory.mktemp("tables")
    for name in GIVEN:
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        rows.repartition(3, F.rand(7)).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("key", [k for k in SQL if k not in BY_FILE])
def test_query_over_folders_equals_its_sql(spark, many_files, key):
    text, _ = compare(spark, _duck(), many_files, key, entry.queries()[key], SQL[key])
    assert text.startswith("ok"), text


def _duck(held=[]):  # noqa: B006
    if not held:
        held.append(connect(FOLDER))
    return held[0]


def test_row_ids_are_unique_over_partition_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.read.parquet(f"{FOLDER}/events.parquet")
    rows.coalesce(1).write.partitionBy("event_type").parquet(path)
    for root in (None, path, f"file://{path}/"):
        ids = with_file_row_id(spark.read.parquet(path), root=root).select("id")
        assert ids.distinct().count() == rows.count()
    assert ids.first()[0].startswith("event_type=")


def test_geojson_keeps_property_names(spark, tmp_path):
    properties = {"OBJECTID": 7, "AVOID": "x", "a name: VOID": {"VARIANT": 1.5}, "empty": None, "mixed": [1, "a"]}
    lines = [json.dumps({"type": "Feature", "id": "1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": properties})]
    (tmp_path / "f.json").write_text("\n".join(lines))
    row = S.read_geojson(spark, str(tmp_path / "f.json")).first().asDict()
    assert (row["OBJECTID"], row["AVOID"], float(row["a name: VOID__VARIANT"]), row["empty"]) == (7, "x", 1.5, None)


def test_csv_takes_whole_names_and_numbers_first(spark, tmp_path):
    (tmp_path / "f.csv").write_text("long_name,latency_ms,longitude_text,lon,lat\na,5,b,10.5,20.5\nc,6,d,x,1\n")
    read = S.read_csv(spark, str(tmp_path / "f.csv"), schema="long_name string, latency_ms int, longitude_text string, lon double, lat double")
    assert {"long_name", "latency_ms", "longitude_text"} <= set(read.columns)
    first = read.first().geom.parts[0].rings[0][0]
    assert (first.x, first.y) == (10.5, 20.5)


def _vertices(spark, column):
    return [None if r.g is None else sum(len(x) for p in r.g.parts for x in p.rings) for r in column.collect()]


def test_collections_of_any_size_and_depth(spark):
    ring = ", ".join(f"{i} {i % 7}" for i in range(10_000)) + ", 0 0"
    texts = [
        f"GEOMETRYCOLLECTION (POLYGON (({ring})), POINT (1 2))",
        "GEOMETRYCOLLECTION (POINT (1e1 2), GEOMETRYCOLLECTION (LINESTRING (0 0, 1 1), GEOMETRYCOLLECTION (POINT Z (1 2 3))))",
        "POLYGON ((0 0,\n 1 0, 1 1,\r\n 0 0))",
        "GEOMETRYCOLLECTION (MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5))), MULTIPOINT ((1 2), (3 4)))",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert _vertices(spark, df.select(G.from_wkt(F.col("t")).alias("g"))) == [10_002, 4, 4, 10]


def test_geojson_collections_of_any_depth(spark):
    point, line = {"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}
    nest = lambda *g: {"type": "GeometryCollection", "geometries": list(g)}
    texts = [json.dumps(g) for g in (point, nest(point, line), nest(nest(nest(line), point), line), nest())]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert _vertices(spark, df.select(G.from_geojson(F.col("t")).alias("g"))) == [1, 3, 5, 0]


@pytest.mark.parametrize("name, inner", [("INTEGER[][][][]", "integer"), ("LIST(LIST(LIST(LIST(DATE))))", "string"), ("MAP(VARCHAR, INTEGER[])[][]", None)])
def test_type_names_of_any_depth(spark, name, inner):
    found = json.loads(spark.range(1).select(D.type_name_schema(F.lit(name)).alias("s")).first().s)
    depth = 0
    while "items" in found or "additionalProperties" in found:
        found, depth = found.get("items") or found["additionalProperties"], depth + 1
    assert depth == 4 and (inner is None or found["type"] == inner)


def test_a_rewritten_table_shows_its_new_columns(spark, tmp_path):
    from featlake.plans.registry import Tables

    path = str(tmp_path / "events.parquet")
    spark.range(3).write.parquet(path)
    assert Tables(spark, str(tmp_path)).events.columns == ["id"]
    spark.range(3).withColumn("more", F.lit(1)).write.mode("overwrite").parquet(path)
    assert Tables(spark, str(tmp_path)).events.columns == ["id", "more"]
    assert os.path.isdir(path)
