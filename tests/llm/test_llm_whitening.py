"""Whitening against a plain reckoning with whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from featlake.llm import queries, whitening


def brute(rows, dimensions):
    """``n``, per row the numbers and deviation, and the exact covariance times n squared."""
    kept = [(i, v) for i, v in rows if v and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - b for a, b in zip(r, s)] for r in x]
    cov = [[sum(r[i] * r[j] for r in d) for j in range(dimensions)] for i in range(dimensions)]
    return kept, n, d, cov


def check(got, rows, dimensions, most=32):
    kept, n, d, cov = brute(rows, dimensions)
    v = np.array([[c / n / n / n for c in r] for r in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    k = max((r.component for r in got), default=0)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted(
        (i is None, i or 0, c) for i, _ in kept for c in range(1, k + 1)
    )
    assert k == min(most, dimensions, int((values > whitening.LEAST * values[0]).sum()))
    assert {int(r.n) for r in got} == {n}
    exact = sorted(sum(c * c for c in r) for r in d)
    assert sorted(int(r.deviation) for r in got if r.component == 1) == exact
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-8)
        assert r.identity_error <= 1e-4
    return values


def whitened(got, k):
    out = {}
    for r in got:
        out.setdefault(r.vec_id, np.zeros(k))[r.component - 1] = r.whitened
    return out


def test_rows_that_are_dropped(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 1.0, 2.0]), (104, []), (105, [1.0, 2.0])]
    rows += [(None, [0.5, 0.25, -1.0]), (7, [0.5, 0.25, -1.0]), (7, [0.5, 0.25, -1.0])]
    df = spark.createDataFrame([(i, v, 9, 9.0) for i, v in rows], "vec_id long, embedding array<double>, n long, whitened double").repartition(3)
    got = whitening.whiten(df).collect()
    check(got, rows, 3)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitened_is_the_projection(spark, kind):
    rng = np.random.default_rng(4)
    mixing = rng.normal(size=(40, 40)) * np.linspace(0.05, 2, 40)
    made = (rng.normal(size=(500, 40)) @ mixing).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(made)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    got = whitening.whiten(df).collect()
    values = check(got, rows, 40)
    x = np.floor(made.astype(np.float64) * 64) + 1_000_000
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    expected = (x - x.mean(axis=0)) @ vectors[:, ::-1][:, :32] / np.sqrt(values[:32])
    found = whitened(got, 32)
    for k in range(32):
        own = np.array([found[i][k] for i in range(500)])
        assert min(np.abs(own - expected[:, k]).max(), np.abs(own + expected[:, k]).max()) < 1e-6
    y = np.array([found[i] for i in range(500)])
    assert np.abs(np.cov(y.T, bias=True) - np.eye(32)).max() == pytest.approx(got[0].identity_error, abs=1e-9)


def test_wide_numbers_stay_exact(spark):
    """Deviations beyond 64 bits, sums beyond 64 bits, numbers beyond a long."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) * 1e12, float(w) * 1e12]) for i, (v, w) in enumerate(rng.normal(size=(50, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows, 2)
    assert max(int(r.deviation) for r in got) > 2**64
    extreme = [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [5.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(extreme, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and all(math.isfinite(r.whitened) for r in got)


def test_constant_dimensions_and_equal_vectors(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows, 3)
    assert {r.component for r in got} == {1} and {round(r.explained, 12) for r in got} == {1.0}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0


def test_one_vector_with_a_third_of_all_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100 + i, [3.0, 3.0, -3.0, 0.0, 1.0]) for i in range(30)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect(), rows, 5)


def test_planes_count_products():
    rng = np.random.default_rng(9)
    x = rng.integers(-500, 500, (333, 6))
    low, bits = x.min(axis=0), [int(s).bit_length() for s in x.max(axis=0) - x.min(axis=0)]
    planes = whitening.Planes(low.tolist(), bits)
    for part in np.array_split(x, 4):
        planes.add(part)
    i, j, found = planes.products()
    expected = (x - low).T @ (x - low)
    assert len(i) == 21 and (expected[i, j] == found).all()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, n int")
    got = whitening.whiten(empty)
    assert got.count() == 0 and got.columns[0] == "vec_id" and len(got.columns) == 7


def test_query_on_given_rows(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = queries.op13_whitening(spark, folder)
    assert df.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(df.collect(), rows, 64)
