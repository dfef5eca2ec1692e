"""Files in their variants, named source types, and what a writer leaves behind."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from featlake.operators import geometry as G
from featlake.operators.filters import FeatureFilter
from featlake.sources import geojson as J
from featlake.sources import extension as X
from featlake.sources import readers as S
from featlake.table import FeatureTable


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


@pytest.mark.parametrize(("name", "sep"), [("AUTO", ","), ("AUTO", ";"), ("TAB", "\t"), ("PIPE", "|"), ("AUTO", "\t")])
def test_csv_separators(spark, tmp_path, name, sep):
    path = _write(tmp_path, "a.csv", sep.join(["id", "longitude", "Lat", "note"]) + "\n" + sep.join(["1", "2.5", "3", "x"]) + "\n")
    df = S.read_csv(spark, path, separator=name)
    assert df.columns == ["id", "note", "geom"]
    assert df.select(G.to_wkt(F.col("geom"))).first()[0] == "POINT (2.5 3)"


def test_csv_options(spark, tmp_path):
    path = _write(tmp_path, "a.csv", "id,east,north,up,wkt_geom\n1,2,3,4,LINESTRING (0 0; 1 1)\n2,5,6,7,\n")
    kept = S.read_csv(spark, path, x_names=["ea*"], y_names=["nor*"], z_names=["u*"], geom_names=None, keep_source_columns=True)
    assert {"east", "north", "up"} <= set(kept.columns)
    assert [r[0] for r in kept.select(G.to_wkt(F.col("geom"))).collect()] == ["POINT Z (2 3 4)", "POINT Z (5 6 7)"]
    text = S.read_csv(spark, path, autodetect_type=False)
    assert text.schema["id"].dataType.typeName() == "string" and "wkt_geom" not in text.columns
    assert "wkt_geom" in S.read_csv(spark, path, keep_geom_columns=True).columns
    plain = S.read_csv(spark, path, x_names=None, geom_names=None)
    assert "geom" not in plain.columns


FEATURES = [
    {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [1, 2]},
     "properties": {"n": 1, "deep": {"x": 1.5, "y": {"z": "t"}}}, "stac_version": "1.0.0", "collection": "c", "extra": 5},
    {"type": "Feature", "id": "b", "geometry": None, "properties": {"n": None, "deep": {"x": 2}}},
]


@pytest.mark.parametrize(
    ("mode", "columns"),
    [("AUTO", {"stac_version", "collection"}), ("NONE", set()), ("ALL", {"stac_version", "collection", "extra"}),
     ("STAC", {"stac_version", "collection"})],
)
def test_geojson_lines_and_foreign_members(spark, tmp_path, mode, columns):
    path = _write(tmp_path, "a.geojsonl", "\n".join(json.dumps(f) for f in FEATURES) + "\n")
    df = S.read_geojson(spark, path, foreign_members=mode)
    assert set(df.columns) == {"id", "geom", "n", "deep__x", "deep__y__z"} | columns
    rows = {r.id: r for r in df.collect()}
    assert rows["a"].deep__y__z == "t" and rows["b"].geom is None and float(rows["b"].deep__x) == 2


def test_geojson_document(spark, tmp_path):
    path = _write(tmp_path, "a.geojson", json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    df = S.read_geojson(spark, path, lines=False, separator=".", flatten=True)
    assert df.count() == 2 and "deep.y.z" in df.columns
    nested = S.read_geojson(spark, path, lines=False, flatten=False)
    assert nested.schema["deep"].dataType.typeName() == "struct"


def test_features_without_properties(spark, tmp_path):
    path = _write(tmp_path, "a.geojsonl", json.dumps({"type": "Feature", "geometry": None, "properties": None}) + "\n")
    assert S.read_geojson(spark, path).columns == ["id", "geom"]


def test_parquet_with_binary_geometry(spark, tmp_path):
    rows = [(i, bytearray(b"\x01\x01\x00\x00\x00" + struct.pack("<2d", i, -i))) for i in range(5)]
    spark.createDataFrame(rows, "id int, geometry binary").write.parquet(str(tmp_path / "p"))
    table = S.open_table(spark, "parquet", {"path": str(tmp_path / "p"), "wkb": "geometry"}, id="id", geom="geometry")
    assert [r.id for r in table.list_features(FeatureFilter(bbox=(1, -3, 3, 0))).collect()] == ["1", "2", "3"]


def _shapes(spark):
    """Points, lines, polygons with holes, collections, empty and missing geometries."""
    texts = ["POINT (1 2)", "POINT Z (3 4 5)", "LINESTRING (0 0, 8 8)", "POLYGON ((0 0, 9 0, 9 9, 0 0), (5 1, 6 1, 6 2, 5 1))", None,
             "MULTIPOINT ((1 1), (2 2))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POINT EMPTY", "POLYGON EMPTY",
             "GEOMETRYCOLLECTION (POINT (1 1), LINESTRING (2 2, 3 3))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 4, 5 5))"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts * 20)], "id int, wkt string, kind string")
    return df.withColumn("geom", G.from_wkt(F.col("wkt")))


def test_geoparquet_round_trip(spark, tmp_path):
    df = _shapes(spark)
    S.write_geoparquet(df, str(tmp_path / "g"), cell=4.0)
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.schema["geometry"].dataType.typeName() == "binary" and stored.schema["bbox"].dataType.names == list(G.BOUNDS)
    table = S.read_geoparquet(spark, str(tmp_path / "g"), "id")
    assert table.df.where("geometry_error IS NOT NULL").count() == 0
    got = {r.id: (r.w, r.xmin) for r in table.df.select("id", G.to_wkt(F.col("geometry")).alias("w"), "xmin").collect()}
    expected = {r.id: r.w for r in df.select("id", G.to_wkt(F.col("geom")).alias("w")).collect()}
    assert {i: w for i, (w, _) in got.items()} == expected
    assert got[2][1] == 0.0 and got[7][1] is None


def test_boxes_come_before_decoding(spark, tmp_path):
    S.write_geoparquet(_shapes(spark), str(tmp_path / "g"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = S.read_geoparquet(spark, str(tmp_path / "g"), "id").select(FeatureFilter(bbox=(4, 0.5, 5.5, 1.2)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for text in ("LessThanOrEqual(bbox.xmin,5.5)", "GreaterThanOrEqual(bbox.xmax,4.0)", "GreaterThanOrEqual(bbox.ymax,0.5)"):
        assert text in plan.split("PushedFilters:")[1]
    # The first thing done to the scanned rows is the filter by the cover.
    assert "Filter" in (below := plan[plan.rindex("ArrowEvalPython") :]) and "bbox" in below.split("Filter")[1]
    # The box lies in the polygon, beside its hole, and off the line.
    plain = FeatureTable(_shapes(spark), id="id", geom="geom").select(FeatureFilter(bbox=(4, 0.5, 5.5, 1.2)))
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in plain.collect()) and rows.count() == 20


def test_loose_and_missing_covers(spark, tmp_path):
    """A cover that is rounded outwards only rules out; without one, boxes are read from the blobs."""
    S.write_geoparquet(_shapes(spark), str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    loose = F.struct(*[(F.col(f"bbox.{b}") + (-2.0 if b.endswith("min") else 2.0)).cast("float").alias(b) for b in G.BOUNDS])
    stored.withColumn("bbox", loose).write.parquet(str(tmp_path / "loose"))
    stored.drop("bbox").write.parquet(str(tmp_path / "bare"))
    f = FeatureFilter(bbox=(1.5, 2.5, 2.5, 3.5))
    tables = [S.read_geoparquet(spark, str(tmp_path / n), "id") for n in ("g", "loose", "bare")]
    found = [sorted(r.id for r in t.select(f).collect()) for t in tables]
    plain = sorted(r.id for r in FeatureTable(_shapes(spark), id="id", geom="geom").select(f).collect())
    assert found[0] == found[1] == found[2] == plain and {i % 11 for i in plain} == {2, 3, 9, 10}
    extents = [t.get_spatial_extent().first() for t in tables]
    assert extents[0] == extents[1] == extents[2]


def test_bad_blobs_are_flagged(spark, tmp_path):
    good = b"\x01\x01\x00\x00\x00" + struct.pack("<2d", 1, 2)
    bad = {1: b"", 2: good[:-1], 3: good + b"x", 4: b"\x07" + good[1:], 5: b"\x01\x63\x00\x00\x00" + good[5:], 6: b"\x01\x02\x00\x00\x00\xff\xff\xff\xff"}
    deep = b"".join(b"\x01\x07\x00\x00\x00\x01\x00\x00\x00" for _ in range(100)) + good
    rows = [(0, good), *bad.items(), (7, deep), (8, None), (9, good)]
    spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "id int, geometry binary").write.parquet(str(tmp_path / "b"))
    table = S.read_geoparquet(spark, str(tmp_path / "b"), "id")
    got = {r.id: (r.geometry is None, r.geometry_error) for r in table.df.collect()}
    assert got == {
        0: (False, None), 1: (True, "truncated"), 2: (True, "truncated"), 3: (True, "bytes left over"), 4: (True, "unknown byte order"),
        5: (True, "unknown geometry type"), 6: (True, "truncated"), 7: (True, "nested too deep"), 8: (True, None), 9: (False, None),
    }
    assert sorted(r.id for r in table.select(FeatureFilter(bbox=(0, 0, 3, 3))).collect()) == [0, 9]
    with pytest.raises(S.SourceError, match="available: id, geometry"):
        S.read_geoparquet(spark, str(tmp_path / "b"), "name")


def test_named_sources(spark, tmp_path):
    with pytest.raises(S.SourceError, match="available: csv, geojson, jdbc, json, parquet, sql, tiles"):
        S.open_table(spark, "oracle", {}, id="id", x="x", y="y")
    S.register_source("grid", lambda s, n: s.range(n).selectExpr("id", "id * 1D AS x", "0D AS y"))
    assert S.open_table(spark, "grid", {"n": 7}, id="id", x="x", y="y").count_items().first().total == 7
    spark.range(3).selectExpr("id * 1D AS x", "0D AS y").coalesce(1).write.parquet(str(tmp_path / "p"))
    table = S.open_table(spark, "parquet", {"path": str(tmp_path / "p")}, x="x", y="y")
    assert {r.id.split(":")[1] for r in table.list_features().collect()} == {"0", "1", "2"}


def test_registered_sources_see_boxes(spark, tmp_path):
    points = spark.range(400).selectExpr("id", "CAST(id % 20 AS DOUBLE) + 0.5 AS x", "CAST(id DIV 20 AS DOUBLE) + 0.5 AS y")
    points = points.selectExpr("*", "CAST(floor(x / 5) AS INT) AS tile_x", "CAST(floor(y / 5) AS INT) AS tile_y")
    points.unionByName(points.where("id = 0").selectExpr("-1L AS id", "NULL AS x", "NULL AS y", "NULL AS tile_x", "NULL AS tile_y")).repartition(
        "tile_x", "tile_y").write.partitionBy("tile_x", "tile_y").parquet(str(tmp_path / "t"))
    table = S.open_table(spark, "tiles", {"path": str(tmp_path / "t"), "size": "5"}, id="id", x="x", y="y")
    assert table.df.count() == 401 and table.df.rdd.getNumPartitions() == 17
    few = table.select(FeatureFilter(bbox=(6, 6, 11, 9)))
    assert sorted(r.id for r in few.collect()) == sorted(r.id for r in points.where("x BETWEEN 6 AND 11 AND y BETWEEN 6 AND 9").collect())
    # Two tiles meet the box; the one of points without coordinates has no bounds to rule it out.
    assert few.rdd.getNumPartitions() <= 3
    with pytest.raises(Exception, match="no tiles"):
        (tmp_path / "none").mkdir()
        S.open_table(spark, "tiles", {"path": str(tmp_path / "none")}, id="id", x="x", y="y")


def test_ranges_of_filters():
    from pyspark.sql import datasource as Ds

    filters = [Ds.GreaterThan(("x",), 3), Ds.LessThanOrEqual(("x",), 9), Ds.GreaterThanOrEqual(("x",), 5), Ds.EqualTo(("k",), "a"), Ds.IsNotNull(("x",)), Ds.LessThan(("a", "b"), 1)]
    assert X.ranges_of(filters) == {"x": (5, 9), "k": ("a", "a")}
    tile = X.Tile("t", {"x": (9, 12), "y": (None, 4)})
    assert tile.may_hold({"x": (5, 9)}) and not tile.may_hold({"x": (5, 8)}) and tile.may_hold({"y": (None, None), "z": (1, 2)})
    assert not tile.may_hold({"y": (4.5, None)})


def test_json_rows(spark, tmp_path):
    path = _write(tmp_path, "a.json", '{"id": 1, "lon": 2.0, "lat": 3.0}\n{"id": 2, "lon": 9.0, "lat": 9.0}\n')
    table = S.open_table(spark, "json", {"path": path, "schema": "id int, lon double, lat double"}, id="id", x="lon", y="lat")
    assert [r.id for r in table.list_features(FeatureFilter(bbox=(0, 0, 5, 5))).collect()] == ["1"]


def test_cells_are_numbered_along_a_curve(spark):
    rows = [(float(x), float(y)) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "xmin double, ymin double")
    position = {(r.xmin, r.ymin): r[2] for r in df.select("*", S._curve_position(1.0)).collect()}
    base = position[0, 0]
    assert [position[c] - base for c in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2), (3, 3))] == [0, 1, 2, 3, 4, 8, 15]


def test_sql_sources(spark):
    spark.range(4).createOrReplaceTempView("four")
    for source in ("four", "SELECT * FROM four", "WITH a AS (SELECT * FROM four) SELECT * FROM a", " values (0), (1), (2), (3)"):
        assert S.read_sql(spark, source).count() == 4


def test_relational_source_needs_an_id(spark):
    for keys in ((), ("a", "b")):
        with pytest.raises(S.SourceError):
            S.read_jdbc(spark, "jdbc:none:", "t", key_columns=keys)


def test_extract_counts_what_it_writes(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "named_struct('xmin', id * 1D, 'ymin', 0D) AS bbox")
    kept, n = S.extract(df, (10, -1, 19.5, 1), str(tmp_path / "out"))
    assert n == 10 == kept.count() and kept.columns == ["id", "bbox"]


def test_feature_documents_are_valid_json(spark, tmp_path):
    df = spark.createDataFrame([('we"ird', 'a\\b"c', None), ("b", None, 1.5)], "id string, name string, v double")
    document = J.feature_json(F.col("id"), G.point(F.col("v"), F.col("v")), F.struct("name", "v"), F.lit("http://h/c"))
    rows = [json.loads(r[0]) for r in df.select(document).collect()]
    assert rows[0]["id"] == 'we"ird' and rows[0]["properties"] == {"name": 'a\\b"c', "v": None}
    assert rows[0]["geometry"] is None and rows[1]["geometry"] == {"type": "Point", "coordinates": [1.5, 1.5]}
    assert [x["rel"] for x in rows[1]["links"]] == ["self", "collection"]
