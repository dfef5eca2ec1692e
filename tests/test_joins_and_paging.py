"""Grid join against brute force, page numbers of whole tables, links and limits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from featlake.operators import geometry as G
from featlake.operators import paging as P
from featlake.operators import spatial_join as S
from featlake.operators.positions import write_positions
from featlake.plans.registry import Tables


def _boxes(rng, n, sizes):
    rows = []
    for i in range(n):
        x, y, s = rng.randint(-180, 170), rng.randint(-90, 80), rng.choice(sizes)
        rows.append((i, float(x), float(y), float(x + s), float(y + s * rng.choice((0, 0.5, 1)))))
    return rows


@pytest.mark.parametrize("levels", [7, 14])
def test_grid_join_equals_all_pairs(spark, levels):
    rng = random.Random(5)
    features = _boxes(rng, 400, [0, 0, 1e-7, 1e-5, 0.01, 1, 5, 45, 200])
    # A third of all features share one cell.
    features += [(1000 + i, 10.0, 10.0, 10.0, 10.0) for i in range(200)]
    boxes = _boxes(rng, 80, [0, 1e-6, 1e-3, 0.05, 2, 8, 90, 180]) + [(900, -180.0, -90.0, 180.0, 90.0), (901, 10.0, 10.0, 10.0, 10.0)]
    f = spark.createDataFrame(features, "id int, xmin double, ymin double, xmax double, ymax double")
    q = spark.createDataFrame(boxes, "request_id int, q_xmin double, q_ymin double, q_xmax double, q_ymax double")
    got = [(r.request_id, r.id) for r in S.join_boxes(f, q, levels=S.DEGREE_LEVELS[:levels]).collect()]
    expected = [
        (b[0], a[0])
        for a in features
        for b in boxes
        if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]
    ]
    assert sorted(got) == sorted(expected)


def test_grid_join_skips_missing_bounds(spark):
    f = spark.createDataFrame([(1, None), (2, 5.0)], "id int, v double")
    f = f.select("id", *[F.col("v").alias(b) for b in G.BOUNDS])
    q = spark.createDataFrame([(1, 0.0, 9.0), (2, 9.0, 0.0), (3, None, None)], "request_id int, lo double, hi double")
    q = q.selectExpr("request_id", "lo AS q_xmin", "lo AS q_ymin", "hi AS q_xmax", "hi AS q_ymax")
    assert [(r.request_id, r.id) for r in S.join_boxes(f, q).collect()] == [(1, 2)]


def test_grid_join_of_requests_over_many_cells(spark):
    """Requests of any shape, on and across cell edges, bounds the wrong way round and rows that come twice."""
    rng = random.Random(8)
    edge = 360 / 4**3
    at = lambda: rng.choice((0.0, edge, -edge, edge / 4, 3 * edge / 4)) + rng.choice((0.0, 0.0, rng.uniform(-30, 30)))
    boxes = [(i, x := at(), y := at(), x + rng.choice((0, edge / 8, edge, 4 * edge, 30)), y + rng.choice((0, edge / 64, edge, 5))) for i in range(150)]
    features = [(i, x := at(), y := at(), x + rng.choice((0, 0, edge / 2, edge, 20)), y + rng.choice((0, edge, 3))) for i in range(300)]
    features += [(1000 + i, 5.0 + i, 3.0, 5.0, 3.0 - i) for i in range(20)]
    f = spark.createDataFrame(features * 2, "id int, xmin double, ymin double, xmax double, ymax double")
    q = spark.createDataFrame(boxes, "request_id int, q_xmin double, q_ymin double, q_xmax double, q_ymax double")
    got = [(r.request_id, r.id) for r in S.join_boxes(f, q).collect()]
    meets = lambda a, b: a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]
    assert sorted(g for g in got if g[1] < 1000) == sorted((b[0], a[0]) for a in features[:300] * 2 for b in boxes if meets(a, b))
    turned = [g for g in got if g[1] >= 1000]
    assert len(turned) == 2 * len(set(turned)) and set(turned) <= {(b[0], a[0]) for a in features[300:] for b in boxes if meets(a, b)}


@pytest.mark.parametrize(("requests", "join"), [(1000, "BroadcastHashJoin"), (1_000_000, "SortMergeJoin")])
def test_requests_are_broadcast_while_their_listing_is_small(spark, requests, join):
    """A million numbers are below the size that Spark broadcasts, a million boxes in a dozen cells each are not."""
    n = F.col("id").cast("double")
    q = spark.range(requests).select(F.col("id").alias("request_id"), *[(n / 1e4 + i).alias(f"q_{b}") for i, b in enumerate(G.BOUNDS)])
    f = spark.range(10**7).select("id", *[(n / 1e5).alias(b) for b in G.BOUNDS])
    assert join in S.join_boxes(f, q)._jdf.queryExecution().executedPlan().toString()


_SHAPES = [
    "POINT (1 1)", "POINT (2 2.5)", "POLYGON ((1 1, 4 1, 4 3, 1 3, 1 1))", "LINESTRING (0 0, 4 3)", "LINESTRING (0 3, 4 0)", "LINESTRING (2 2, 2 2)",
    "LINESTRING (4 3, 0 0)", "LINESTRING (0 0, 0 3, 4 3)", "POLYGON ((0 0, 4 0, 4 4, 0 0))", "MULTIPOINT ((0 0), (4 4))", "POLYGON ((1 1, 4 1, 4 3, 1 1))",
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))", "LINESTRING (1 1, 5 1)", "POLYGON ((2 2, 2 2, 2 2, 2 2, 2 2))", "POINT EMPTY", "nothing",
]


def test_shapes_that_their_bounds_decide(spark):
    shapes = spark.createDataFrame(list(enumerate(_SHAPES)), "id int, text string").select("id", G.from_wkt(F.col("text")).alias("geom"))
    shapes = G.with_bounds(shapes)
    own, asked = ({b: F.col(f"{p}{b}") for b in G.BOUNDS} for p in ("", "q_"))
    shapes = shapes.withColumn("form", G.bounds_form(F.col("geom"), own))
    forms = {r.id: r.form for r in shapes.collect()}
    assert [forms[i] for i in range(len(_SHAPES))] == [0, 0, 0, 1, 2, 1, None, None, None, None, None, None, 1, 0, 0, None]
    sides = [(x / 2, y / 2, (x + w) / 2, (y + h) / 2) for x in range(-1, 9) for y in range(-1, 9) for w in (0, 1, 3) for h in (0, 1, 3)]
    boxes = spark.createDataFrame(sides, "q_xmin double, q_ymin double, q_xmax double, q_ymax double")
    pairs = shapes.where("form IS NOT NULL").crossJoin(boxes)
    told = pairs.select(G.bounds_meet_box(F.col("form"), own, asked).alias("quick"), G.meets_box(F.col("geom"), own, asked).alias("exact"))
    counts = {(r.quick, r.exact): r["count"] for r in told.groupBy("quick", "exact").count().collect()}
    assert set(counts) == {(True, True), (False, False), (None, None)} and counts[(None, None)] == len(sides)


def test_plain_shapes_are_joined_without_lambdas(spark, tmp_path):
    """A lambda in the condition of the join takes microseconds for each pair of a cell."""
    spark.range(300).selectExpr("id AS o_orderkey", "timestamp_ntz'2024-01-01' AS o_orderdate", "'O' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(40).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    from featlake.plans.shapes import batch_bbox_shapes, parcel_geometry

    tables = Tables(spark, str(tmp_path))
    found = batch_bbox_shapes(tables)
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and any("lambda" not in x for x in joins)
    own, asked = ({b: F.col(f"{p}{b}") for b in G.BOUNDS} for p in ("", "q_"))
    expected = tables.parcels.crossJoin(tables.boxes).where(G.meets_box(parcel_geometry(), own, asked))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select("request_id", "id").collect()))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_page_numbers_of_a_whole_table(spark, kind):
    keys = random.Random(3).sample(range(10**6), 1500)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").select(F.col("k").cast(kind))
    got = {r.k: (r.position, r.page_number) for r in P.number_pages(df, "k", 40, slices=7).collect()}
    ordered = sorted(got)
    assert len(ordered) == 1500
    assert [got[k] for k in ordered] == [(i, i // 40 + 1) for i in range(1500)]


def test_page_numbers_of_a_single_slice_need_no_join(spark):
    made = P.number_pages(spark.range(95).withColumnRenamed("id", "k"), "k", 20, slices=1)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.position, r.page_number) for r in made.orderBy("k").collect()] == [(i, i, i // 20 + 1) for i in range(95)]


def test_keyset_pages_add_up(spark):
    df = spark.range(95).withColumnRenamed("id", "k")
    last, seen = None, []
    while rows := P.page_after(df, "k", last, 20).collect():
        seen += [r.k for r in rows]
        last = rows[-1].k
    assert seen == list(range(95))
    pages = [P.page_number(df, [F.asc("k")], n, 20).collect() for n in range(1, 6)]
    assert [r.k for page in pages for r in page] == seen


@pytest.mark.parametrize(
    ("asked", "custom", "most", "expected"),
    [(None, None, None, 20), (50, None, None, 50), (500, None, None, 100), (None, 30, None, 30), (500, 30, 40, 40),
     (0, 30, 10, 10)],
)
def test_limits(spark, asked, custom, most, expected):
    assert P.clamp_limit(asked, custom, most) == expected
    row = spark.createDataFrame([(asked, custom, most)], "a int, b int, c int")
    assert row.select(P.clamp_limit_column(F.col("a"), F.col("b"), F.col("c"))).first()[0] == expected


def test_links(spark):
    rows = spark.createDataFrame([(100, 0, 20), (100, 10, 20), (100, 80, 20), (5, 0, 20)], "m int, o int, l int")
    links = P.link_columns(F.col("m"), F.col("o"), F.col("l"), F.lit("u"))
    got = [tuple(r) for r in rows.select(links["prev_href"], links["next_href"]).collect()]
    assert got == [(None, "u?offset=20"), ("u?offset=0", "u?offset=30"), ("u?offset=60", None), (None, None)]


# --- stored positions -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(None if i % 9 == 0 else f"k{i * 7919 % 1000:04}", i % 5, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "name string, group int, n int").repartition(5)
    found = write_positions(df, ["name", "n"], str(tmp_path_factory.mktemp("positions") / "t"), rows=90)
    return found, sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2]))


@pytest.mark.parametrize(("offset", "limit"), [(0, 10), (85, 20), (500, 300), (990, 50), (1000, 5), (5000, 5), (3, 1)])
def test_page_at_any_offset(stored, offset, limit):
    positions, ordered = stored
    got = [(r.name, r.group, r.n, r.position) for r in positions.page(offset, limit).collect()]
    assert got == [(*r, offset + k) for k, r in enumerate(ordered[offset : offset + limit])]


def test_a_page_reads_its_slice_alone(stored):
    positions, _ = stored
    assert positions.index.count() == 12
    assert len(positions.page(500, 10).inputFiles()) <= 2
    plan = positions.page(500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_slice" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(_rank" in plan.split("PushedFilters:")[1] or "_rank" in plan.split("PushedFilters:")[1]


def test_pages_behind_a_key(stored):
    positions, ordered = stored
    known = [r for r in ordered if r[0] is not None]
    last, pages = ordered[0], 0
    for start in range(1, len(ordered), 150):
        got = [(r.name, r.group, r.n) for r in positions.after([last[0], last[2]], 150).collect()]
        assert got == ordered[start : start + 150]
        last, pages = got[-1], pages + 1
    assert pages == 7 and positions.after([known[-1][0], known[-1][2]], 5).count() == 0


def test_positions_of_all_rows(stored, spark, tmp_path):
    positions, ordered = stored
    got = sorted((r.position, r.page_number, r.n) for r in positions.numbered(20).collect())
    assert got == [(k, k // 20 + 1, r[2]) for k, r in enumerate(ordered)]
    assert positions.total().first().total == 1000
    nothing = write_positions(spark.range(0), ["id"], str(tmp_path / "none"))
    assert nothing.page(0, 5).count() == nothing.numbered(5).count() == nothing.total().first().total == 0


def test_slices_follow_the_size(spark, monkeypatch):
    from featlake.operators import slices

    monkeypatch.setattr(slices, "ROWS", 100)
    assert [slices.default_slices(spark.range(n)) for n in (0, 1, 100, 950)] == [1, 1, 1, 10]
