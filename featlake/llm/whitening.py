"""Embedding whitening with exact cross-products from bit planes.

Entries become whole numbers. Less the smallest of its dimension, each is a few bits; the bit of one
place in all rows of a batch is a plane, packed into 64-bit words. The number of rows where two
planes both have a bit is the popcount of their AND, and weighted by the powers of two of the planes
these counts add up to the cross-product of two dimensions, exactly. Tasks return one number per
pair of dimensions, whatever the number of rows; centring is done on whole numbers, and only the
centred matrix is rounded, once, for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import collected

#: Whole numbers are ``floor(SCALE * entry) + SHIFT``; products beyond ``LARGEST`` are taken as it.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**62
#: Components that are kept.
COMPONENTS = 32
#: Share of the largest eigenvalue that a component needs: below, doubles do not tell it from none.
LEAST = 1e-10
#: Dimensions a vector may have: the matrix of all pairs is on the driver.
MOST_DIMENSIONS = 8192
_LIMB = 32


@dataclass
class Whitening:
    """What the fit list gives: its size, per dimension its smallest number, spread and shifted sum, and the components."""

    n: int
    low: list[int]
    spread: list[int]
    shifted: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def narrow(self) -> bool:
        """Whether a row's squared deviation fits in 64 bits, so that no Python numbers are needed."""
        return sum((self.n * s) ** 2 for s in self.spread) < 1 << 62 and max(map(abs, self.low), default=0) < 1 << 62

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly; numbers of Python where 64 bits are too few."""
        kind = np.int64 if self.narrow else object
        return self.n * (x.astype(kind) - np.array(self.low, kind)) - np.array(self.shifted, kind)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        scaled = self.components / np.sqrt(self.eigenvalues)
        return (deviations.astype(np.float64) / self.n) @ scaled


def whole_numbers(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the usable vectors, one row each, and the places of these vectors."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = np.asarray(pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    held = np.maximum(lengths, 0)
    starts = np.cumsum(held) - held
    places = np.flatnonzero(lengths == dimensions)
    found = entries[starts[places][:, None] + np.arange(dimensions)]
    fine = np.isfinite(found).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(found[fine] * SCALE), -LARGEST, LARGEST)
    return scaled.astype(np.int64) + SHIFT, places[fine]


def usable_length(rows: DataFrame) -> int:
    """The length that most vectors without null and non-finite entries have, the longest of those; 0 without any."""
    fine = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    lengths = rows.where("_v IS NOT NULL").where(fine).groupBy(F.size("_v").alias("size")).count()
    first = lengths.where("size > 0").orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if first and first[0]["size"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} entries")
    return first[0]["size"] if first else 0


def _ranges(rows: DataFrame, dimensions: int) -> list:
    """Per dimension: rows, sum in two parts, smallest and largest number."""

    def work(batches: Iterable[pa.RecordBatch]):
        n, parts, low, high = 0, np.zeros((2, dimensions), np.int64), None, None
        for batch in batches:
            x, _ = whole_numbers(batch.column(0), dimensions)
            if not len(x):
                continue
            n += len(x)
            parts += np.stack([(x >> _LIMB).sum(axis=0), (x & ((1 << _LIMB) - 1)).sum(axis=0)])
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({
                "dim": np.arange(dimensions, dtype=np.int32), "n": np.full(dimensions, n, np.int64),
                "above": parts[0], "below": parts[1], "low": low, "high": high,
            })

    made = rows.select("_v").mapInArrow(work, "dim int, n long, above long, below long, low long, high long")
    one = made.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("above").alias("above"), F.sum("below").alias("below"), F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    return collected(one.orderBy("dim"), dimensions, "dimensions")


class Planes:
    """The bit planes of shifted numbers: ``bits[i]`` planes of dimension ``i``, lowest first."""

    def __init__(self, low: list[int], bits: list[int]):
        self.low = np.array(low, np.int64)
        self.dim = np.repeat(np.arange(len(bits)), bits)
        self.place = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if len(self.dim) else np.empty(0, np.int64)
        self.counts = np.zeros((len(self.dim), len(self.dim)), np.int64)

    def add(self, x: np.ndarray) -> None:
        """Count the rows of ``x`` in which two planes both have a bit."""
        shifted = (x - self.low).view(np.uint64)
        bits = np.zeros((len(self.dim), -(-len(x) // 64) * 64), bool)
        for k, (i, b) in enumerate(zip(self.dim.tolist(), self.place.tolist())):
            bits[k, : len(x)] = (shifted[:, i] >> np.uint64(b)) & np.uint64(1)
        words = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(len(words)):
            self.counts[k, k:] += np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)

    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of dimensions ``i <= j`` and their cross-products, as numbers of Python if 64 bits are too few."""
        wide = 2 * (int(self.place.max()) + 1) + int(self.counts.max()).bit_length() > 50
        counts = (np.triu(self.counts) + np.triu(self.counts, 1).T).astype(object if wide else np.int64)
        powers = np.array([1 << int(b) for b in self.place], object if wide else np.int64)
        weighted = counts * powers * powers[:, None]
        dims, first = np.unique(self.dim, return_index=True)
        sums = np.add.reduceat(np.add.reduceat(weighted, first, axis=0), first, axis=1)
        i, j = np.triu_indices(len(dims))
        return dims[i], dims[j], sums[i, j]


def _limbs(i: np.ndarray, j: np.ndarray, values: np.ndarray):
    """Numbers in parts of 32 bits, so that sums of parts stay within 64 bits."""
    limb = 0
    while len(values):
        part = (values & ((1 << _LIMB) - 1)).astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"i": i.astype(np.int32), "j": j.astype(np.int32), "limb": np.full(len(i), limb, np.int32), "part": part}
        )
        values = values >> _LIMB
        left = values != 0
        i, j, values, limb = i[left], j[left], values[left], limb + 1


def _cross_products(rows: DataFrame, dimensions: int, low: list[int], bits: list[int]) -> dict[tuple[int, int], int]:
    """The cross-products of the shifted numbers of all pairs of dimensions that vary."""

    def work(batches: Iterable[pa.RecordBatch]):
        planes = Planes(low, bits)
        for batch in batches:
            x, _ = whole_numbers(batch.column(0), dimensions)
            if len(x):
                planes.add(x)
        if planes.counts.any():
            yield from _limbs(*planes.products())

    made = rows.select("_v").mapInArrow(work, "i int, j int, limb int, part long")
    one = made.groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))
    sums: dict[tuple[int, int], int] = {}
    for r in collected(one, 8 * dimensions * (dimensions + 1), "cross-products"):
        sums[r["i"], r["j"]] = sums.get((r["i"], r["j"]), 0) + (r["part"] << (_LIMB * r["limb"]))
    return sums


def _named(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))


def fit(rows: DataFrame, vector_col: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None if there is none or nothing varies.

    Components are numbered by falling eigenvalue; the largest entry of each is positive.
    """
    rows = rows.select(F.col(vector_col).alias("_v"))
    dimensions = usable_length(rows)
    ranges = _ranges(rows, dimensions) if dimensions else []
    if not ranges:
        return None
    n, low = ranges[0]["n"], [r["low"] for r in ranges]
    spread = [r["high"] - r["low"] for r in ranges]
    shifted = [(r["above"] << _LIMB) + r["below"] - n * r["low"] for r in ranges]
    products = _cross_products(rows, dimensions, low, [s.bit_length() for s in spread])
    centred = np.zeros((dimensions, dimensions))
    trace = 0
    for (i, j), product in products.items():
        exact = n * product - shifted[i] * shifted[j]
        centred[i, j] = centred[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    if not trace:
        return None
    values, vectors = np.linalg.eigh(centred)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:most] > LEAST * values[0]).sum())
    values, vectors = values[:kept].copy(), vectors[:, :kept].copy()
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return Whitening(n, low, spread, shifted, vectors, values, values / (trace / (n * n)))


def identity_error(rows: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity, measured on all rows."""
    dimensions, k = model.components.shape

    def work(batches: Iterable[pa.RecordBatch]):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x, _ = whole_numbers(batch.column(0), dimensions)
            y = model.whitened(model.deviations(x))
            sums += y.sum(axis=0)
            products += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({
            "i": np.concatenate([i, np.arange(k)]).astype(np.int32), "j": np.concatenate([j, np.full(k, -1)]).astype(np.int32),
            "part": np.concatenate([products[i, j], sums]),
        })

    made = rows.select(F.col(vector_col).alias("_v")).mapInArrow(work, "i int, j int, part double")
    found = collected(made.groupBy("i", "j").agg(F.sum("part").alias("part")), k * (k + 1), "sums")
    mean, second = np.zeros(k), np.zeros((k, k))
    for r in found:
        if r["j"] < 0:
            mean[r["i"]] = r["part"] / model.n
        else:
            second[r["i"], r["j"]] = second[r["j"], r["i"]] = r["part"] / model.n
    # The numbers are centred exactly before they are projected; what rounding leaves is taken off here.
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    A vector that is null, empty or holds null or non-finite entries is dropped, and so is one of
    another length than most have. Entries become whole numbers; ``deviation`` is a row's exact sum
    of ``(n * x - S) ** 2``, null beyond 38 digits. Products of entry and scale beyond 2**62 are
    taken as 2**62. Components whose eigenvalue is no more than ``LEAST`` of the largest are left
    out, so constant dimensions give none, and equal vectors alone or an empty table give no rows.
    Repeated rows and null ids are rows like any other; other columns are not read.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, {RESULT}"
    model = fit(rows, vector_col, most)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    error = identity_error(rows, model, vector_col)
    dimensions, k = model.components.shape

    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            x, places = whole_numbers(batch.column(1), dimensions)
            if not len(x):
                continue
            d = model.deviations(x)
            exact = [Decimal(v) if abs(v) < 10**38 else None for v in (d * d).sum(axis=1).tolist()]
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(places[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n, np.int64)),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(model.whitened(d).ravel()),
                pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), error)),
            ], names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _named(rows, id_col, vector_col).mapInArrow(work, schema).withColumnRenamed("_id", id_col)
