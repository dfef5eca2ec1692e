"""Documents cut into byte ranges against a JSON parser."""

from __future__ import annotations

import json
import random

import pytest

from featlake.sources import documents as Dc
from featlake.sources import readers as S


def _document(rng, n):
    """A collection with strings full of brackets and quotes, nested lists, and lists of other names and depths."""
    odd = ['}', '{', '"', '\\', '\\"', '[{', '}]', '"features": [', "é", " ", "\n", "x"]

    def text():
        return "".join(rng.choice(odd) for _ in range(rng.randrange(12)))

    def value(depth=0):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind < 3:
            return [text(), rng.randrange(100), None][kind]
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["features", "a", text()]): value(depth + 1) for _ in range(rng.randrange(4))}

    features = [{"type": "Feature", "id": i, "properties": {"t": text(), "features": [{"no": text()}], "v": value()}, "geometry": None} for i in range(n)]
    document = {"type": "FeatureCollection", "links": [{"features": [{"no": 1}]}, text()], "crs": {"features": [{}]}}
    document |= {"features": features, "more": [[{"x": text()}]], "after": {"features": [{"no": 2}]}}
    return document


def _read(spark, path):
    return sorted((json.loads(r.feature) for r in Dc.split_features(spark, path).collect()), key=lambda f: f["id"])


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in before]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [61, 200, 1000, 5000, 10**6])
@pytest.mark.parametrize("spaced", [None, 2])
def test_any_cut(spark, tmp_path, small_ranges, size, spaced):
    document = _document(random.Random(size), 40 if size > 100 else 8)
    (tmp_path / "d.geojson").write_text(json.dumps(document, indent=spaced, ensure_ascii=False), encoding="utf-8")
    small_ranges(size)
    assert _read(spark, str(tmp_path / "d.geojson")) == document["features"]
    if size < 1000:
        assert Dc._pieces(spark, str(tmp_path / "d.geojson")).rdd.getNumPartitions() > 5


def test_several_documents_and_one_huge_feature(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    features = []
    for k in range(4):
        document = _document(rng, 5)
        for f in document["features"]:
            f["id"] += 100 * k
        if k == 2:
            document["features"][1]["properties"]["big"] = [{"a": ['}"{'] * 9}] * 400
        features += document["features"]
        (tmp_path / f"d{k}.geojson").write_text(json.dumps(document))
    (tmp_path / "none.geojson").write_text('{"type": "FeatureCollection", "features": []}\n')
    (tmp_path / "other.geojson").write_text('{"type": "Feature", "geometry": null}')
    small_ranges(700)
    assert _read(spark, str(tmp_path)) == features


def test_lots_of_a_range(spark, tmp_path):
    """A range that comes in many Arrow batches, with features that cross them."""
    document = _document(random.Random(5), 60)
    (tmp_path / "d.geojson").write_text(json.dumps(document))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _read(spark, str(tmp_path / "d.geojson")) == document["features"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_features_of_a_document_have_columns(spark, tmp_path):
    one = {"type": "Feature", "id": "a", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 1, "s": "}"}}
    (tmp_path / "d.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [one] * 3}))
    rows = S.read_geojson(spark, str(tmp_path / "d.geojson"), lines=False)
    assert [(r.id, r.geom.type, r.n, r.s) for r in rows.collect()] == [("a", "Point", 1, "}")] * 3


def test_escapes():
    text = b'a\\\\"b\\"c\\\\\\"\\'
    marks = Dc._escaped(__import__("numpy").frombuffer(text, "u1"))
    expected, escaped = [], False
    for c in text:
        expected.append(escaped)
        escaped = c == 0x5C and not escaped
    # Only quotes are asked about: a backslash that is itself escaped may be marked or not.
    assert [m for m, c in zip(marks, text) if c != 0x5C] == [e for e, c in zip(expected, text) if c != 0x5C]
