"""One table of three points through every kind of source, and the time and id cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from featlake.operators import geometry as G
from featlake.operators.filters import BadRequest, FeatureFilter, parse_bbox, parse_interval
from featlake.sources import readers as S
from featlake.table import FeatureTable, SchemaError

ROWS = [(1, "alpha", 1, 10.0, 20.0), (2, "beta", 2, 30.0, 40.0), (3, "gamma", 3, 50.0, 60.0)]


def _plain(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, name string, value int, x double, y double")
    return FeatureTable(df, id="id", x="x", y="y")


def _wkt(spark, tmp_path):
    rows = [(i, n, v, f"POINT ({x} {y})") for i, n, v, x, y in ROWS]
    return FeatureTable(S.inline_wkt(spark.createDataFrame(rows, "id int, name string, value int, geometry string")),
                        id="id", geom="geom")


def _csv(spark, tmp_path):
    path = tmp_path / "three.csv"
    path.write_text("id;name;value;Lon;lat\n" + "".join(f"{i};{n};{v};{x};{y}\n" for i, n, v, x, y in ROWS))
    return FeatureTable(S.read_csv(spark, str(path)), id="id", geom="geom")


def _geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "id": str(i), "properties": {"name": n, "value": v},
         "geometry": {"type": "Point", "coordinates": [x, y]}}
        for i, n, v, x, y in ROWS
    ]
    path = tmp_path / "three.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return FeatureTable(S.read_geojson(spark, str(path), lines=False), id="id", geom="geom")


def _parquet(spark, tmp_path):
    target = str(tmp_path / "three")
    S.write_feature_parquet(_wkt(spark, tmp_path).df, target)
    return FeatureTable(S.read_parquet(spark, target), id="id", geom="geom")


@pytest.fixture(params=[_plain, _wkt, _csv, _geojson, _parquet], ids=lambda f: f.__name__)
def table(request, spark, tmp_path):
    return request.param(spark, tmp_path)


def _ids(df):
    return [r["id"] for r in df.collect()]


def test_paging(table):
    assert _ids(table.list_features(FeatureFilter(limit=10))) == ["1", "2", "3"]
    assert _ids(table.list_features(FeatureFilter(limit=2))) == ["1", "2"]
    assert _ids(table.list_features(FeatureFilter(limit=10, offset=1))) == ["2", "3"]
    assert _ids(table.list_features(FeatureFilter(limit=10, offset=3))) == []


def test_box_and_counts(table):
    f = FeatureFilter(bbox=(5, 15, 35, 45))
    assert _ids(table.list_features(f)) == ["1", "2"]
    assert table.count_items(f).first().asDict() == {"matched": 2, "total": 3}
    assert table.count_items().first().asDict() == {"matched": 3, "total": 3}


def test_box_in_another_crs(table):
    f = FeatureFilter(bbox=(556597, 1689200, 3896182, 5621521), bbox_crs="http://www.opengis.net/def/crs/EPSG/0/3857")
    assert _ids(table.list_features(f)) == ["1", "2"]


def test_box_in_utm_zone_is_tested_exactly(table):
    # The zone of 9 degrees east; the box holds the first point only.
    f = FeatureFilter(bbox=(550000, 2150000, 650000, 2280000), bbox_crs="EPSG/0/32632")
    assert _ids(table.list_features(f)) == ["1"]


def test_lookup_and_injection(table):
    assert _ids(table.get_feature("2")) == ["2"]
    assert _ids(table.get_feature("9999")) == []
    assert _ids(table.get_feature("' OR '1'='1")) == []


def test_reprojection(table):
    row = table.list_features(FeatureFilter(limit=1, crs="http://www.opengis.net/def/crs/EPSG/0/3857")).first()
    vertex = row["geom"]["parts"][0]["rings"][0][0]
    assert vertex["x"] == pytest.approx(1113194.9079, rel=1e-9)
    assert vertex["y"] == pytest.approx(2273030.9270, rel=1e-9)
    assert row["crs"].endswith("/3857")


def test_extent_schema_and_queryables(table):
    box = table.get_spatial_extent().first()
    assert tuple(box[c] for c in ("west", "south", "east", "north")) == (10, 20, 50, 60)
    schema = json.loads(table.get_schema("x").first()[0])
    roles = {k: v.get("x-ogc-role") for k, v in schema["properties"].items()}
    assert roles["id"] == "id" and list(roles.values()).count("primary-geometry") == 1
    assert schema["properties"]["geom"]["format"] == "geometry-point" and schema["$id"] == "x"
    assert "geom" not in json.loads(table.get_queryables().first()[0])["properties"]


def test_unknown_columns_are_named(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, value int, x double, y double")
    with pytest.raises(SchemaError, match="available: id, name, value, x, y"):
        FeatureTable(df, id="fid", x="x", y="y")


def test_page_size_is_clamped(spark):
    df = spark.range(300).selectExpr("id", "id * 0.1 AS x", "0D AS y")
    assert FeatureTable(df, id="id", x="x", y="y").list_features().count() == 20
    assert FeatureTable(df, id="id", x="x", y="y").list_features(FeatureFilter(limit=250)).count() == 100
    custom = FeatureTable(df, id="id", x="x", y="y", page_size=5, page_size_max=7)
    assert custom.list_features().count() == 5
    assert custom.list_features(FeatureFilter(limit=50)).count() == 7


# --- time -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dated(spark):
    rows = [
        ("dt-1", "2001-01-01 00:00:00", 1.0), ("dt-2", "2002-06-15 00:00:00", 2.0),
        ("dt-3", "2003-01-01 00:00:00", 3.0), ("dt-4", None, 4.0),
    ]
    df = spark.createDataFrame(rows, "id string, at string, x double")
    df = df.selectExpr("id", "CAST(at AS TIMESTAMP_NTZ) AS observed_at", "x", "x AS y")
    return FeatureTable(df, id="id", x="x", y="y", time="observed_at")


@pytest.mark.parametrize(
    ("interval", "ids"),
    [
        ("2001-06-01T00:00:00Z/2002-12-31T23:59:59Z", ["dt-2"]),
        ("../2001-06-01T00:00:00Z", ["dt-1"]),
        ("2002-06-01T00:00:00Z/..", ["dt-2", "dt-3"]),
        ("2003-01-01T00:00:00Z", ["dt-3"]),
        ("2003-01-01T01:00:00+01:00", ["dt-3"]),
        ("../..", ["dt-1", "dt-2", "dt-3"]),
        ("/2001-06-01T00:00:00Z", ["dt-1"]),
    ],
)
def test_datetime(dated, interval, ids):
    assert _ids(dated.list_features(FeatureFilter(datetime=interval))) == ids


def test_datetime_counts_and_extent(dated):
    counts = dated.count_items(FeatureFilter(datetime="2001-06-01T00:00:00Z/2002-12-31T23:59:59Z")).first()
    assert (counts.matched, counts.total) == (1, 4)
    assert tuple(dated.get_temporal_extent().first()) == ("2001-01-01T00:00:00Z", "2003-01-01T00:00:00Z")


def test_no_time_column_means_no_time_filter(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, value int, x double, y double")
    table = FeatureTable(df, id="id", x="x", y="y")
    assert table.list_features(FeatureFilter(datetime="1990-01-01")).count() == 3
    assert table.get_temporal_extent() is None


# --- conformance ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def obs(spark):
    rows = [
        ("371", -75.0, 45.0, 35, "2001-10-30 14:24:55", 89.9), ("377", -75.0, 45.0, 35, "2002-10-30 18:31:38", 93.9),
        ("238", -79.0, 43.0, 2147, "2007-10-30 08:57:29", 103.5), ("297", -79.0, 43.0, 2147, "2003-10-30 07:37:29", 93.5),
        ("964", -122.0, 49.0, 604, "2000-10-30 18:24:39", 99.9),
    ]
    df = spark.createDataFrame(rows, "id string, x double, y double, stn_id int, t string, value double")
    df = df.withColumn("datetime", F.col("t").cast("timestamp_ntz")).drop("t")
    return FeatureTable(df, id="id", x="x", y="y", time="datetime")


@pytest.mark.parametrize(
    ("params", "ids"),
    [
        ({"bbox": "-76,44,-74,46"}, {"371", "377"}),
        ({"bbox": ["-76", "44", "-74", "46"]}, {"371", "377"}),
        ({"bbox": ["-76,44,0,-74,46,10"]}, {"371", "377"}),
        ({"datetime": "2001-01-01T00:00:00Z/2003-12-31T23:59:59Z"}, {"371", "377", "297"}),
        ({"datetime": "2007-01-01T00:00:00Z/.."}, {"238"}),
        ({"datetime": "2001-10-30T14:24:55Z"}, {"371"}),
        ({"bbox": "-80,40,-70,50", "datetime": "2007-01-01T00:00:00Z/.."}, {"238"}),
        ({"filter": '{"op": ">", "args": [{"property": "value"}, 99]}'}, {"238", "964"}),
    ],
)
def test_requests(obs, params, ids):
    assert set(_ids(obs.list_features(FeatureFilter.from_params(params)))) == ids


def test_bad_requests():
    for params in ({"bbox": "1,2,3"}, {"bbox": "1,2,3,north"}, {"zoom": "3"}, {"limit": "0"}, {"offset": "-1"},
                   {"limit": "many"}, {"filter-lang": "cql2-text", "filter": "a=1"}):
        with pytest.raises(BadRequest):
            FeatureFilter.from_params(params)
    with pytest.raises(BadRequest):
        parse_interval("soon")
    assert parse_bbox(["1", "2", "3", "4"]) == (1.0, 2.0, 3.0, 4.0)


@pytest.mark.parametrize(
    "document",
    [
        {"op": "=", "args": [{"property": "nothing"}, 1]},
        {"op": "sleep", "args": []},
        {"op": "s_intersects", "args": [{"property": "value"}, {"bbox": [0, 0, 1, 1]}]},
        {"op": "and", "args": []},
        "not json",
    ],
)
def test_bad_predicates(obs, document):
    with pytest.raises(BadRequest):
        obs.select(FeatureFilter(filter=document))


def test_registered_predicate_function(obs):
    builder = obs.predicates()
    builder.register("near_zero", lambda c: F.abs(c) < 94)
    kept = obs.df.where(builder.compile({"op": "near_zero", "args": [{"property": "value"}]}))
    assert {r.id for r in kept.collect()} == {"371", "377", "297"}


def test_sort_hits_and_projection(obs):
    assert _ids(obs.list_features(FeatureFilter(sort_by="-stn_id,+value")))[:2] == ["297", "238"]
    page = obs.list_features(FeatureFilter(returned=["value", "nothing"], skip_geometry=True))
    assert page.columns == ["id", "value"]
    with pytest.raises(ValueError):
        obs.list_features(FeatureFilter(sort_by="nothing"))


def test_antimeridian(spark):
    df = spark.createDataFrame([(1, 179.5, 0.0), (2, -179.5, 0.0), (3, 0.0, 0.0)], "id int, x double, y double")
    table = FeatureTable(df, id="id", x="x", y="y")
    assert _ids(table.list_features(FeatureFilter(bbox=(179, -1, -179, 1)))) == ["1", "2"]


def test_null_geometry(spark):
    df = spark.createDataFrame([(1, "POINT (1 1)"), (2, None), (3, "POINT (9 9)")], "id int, geometry string")
    table = FeatureTable(S.inline_wkt(df), id="id", geom="geom")
    assert _ids(table.list_features(FeatureFilter(bbox=(0, 0, 2, 2)))) == ["1"]
    assert _ids(table.list_features(FeatureFilter(bbox=(0, 0, 2, 2), keep_null_geometry=True))) == ["1", "2"]
    assert table.list_features().where(F.col("geom").isNull()).count() == 1
    assert G.BOUNDS[0] not in table.properties


def test_empty_table_has_no_extent(spark):
    table = FeatureTable(spark.createDataFrame([], "id int, x double, y double"), id="id", x="x", y="y")
    assert set(table.get_spatial_extent().first()) == {None}
    assert table.count_items(FeatureFilter(bbox=(0, 0, 1, 1))).first().asDict() == {"matched": 0, "total": 0}
