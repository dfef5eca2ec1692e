"""Well-known binary to geometry structs and back, whole Arrow batches at a time.

Spark has no expression that reads a double out of bytes, so this is the one step that leaves the
JVM. All blobs of a batch are read in step: each step takes the next header or ring of every blob
that has one, with numpy over the bytes of the column. Vertices are gathered by their positions and
become the buffers of nested Arrow arrays; no Python object is made for a blob, ring or vertex.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.operators.geometry import BOUNDS, GEOMETRY

# The functions travel to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Geometry type names by their codes.
_NAMES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
_POINT, _LINE, _POLYGON = 1, 2, 3
#: Why a blob is no geometry.
ERRORS = ("truncated", "unknown byte order", "unknown geometry type", "nested too deep", "bytes left over")
#: Collections inside each other.
DEEPEST = 64

BOX = T.StructType([T.StructField(b, T.DoubleType()) for b in BOUNDS])
DECODED = T.StructType([T.StructField("geometry", GEOMETRY), T.StructField("error", T.StringType())])

_XYZ = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
_RING = pa.list_(pa.field("element", _XYZ))
_RINGS = pa.list_(pa.field("element", _RING))
_PART = pa.struct([("dim", pa.int32()), ("rings", _RINGS)])
_PARTS = pa.list_(pa.field("element", _PART))


def _bytes_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the place where each value starts, and where the last one ends."""
    blobs = blobs.cast(pa.large_binary())
    _, offsets, data = blobs.buffers()
    starts = np.frombuffer(offsets, np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), starts


def _at_every_byte(data: np.ndarray, kind: str) -> np.ndarray:
    """The numbers that start at each byte of ``data``, as a view."""
    size = np.dtype(kind).itemsize
    if len(data) < size:
        return np.empty(0, kind)
    return np.ndarray((len(data) - size + 1,), kind, data, strides=(1,))


class Blobs:
    """What a batch of blobs holds.

    ``error`` is per blob 0 or one more than a place in ``ERRORS``, ``kind`` its type code. Parts and
    rings are in the order of the blobs: ``part_row``, ``part_dim``, ``ring_part``, ``ring_size``;
    ``x, y, z, has_z`` are all vertices, ring by ring.
    """

    def __init__(self, blobs: pa.Array):
        data, starts = _bytes_of(blobs)
        self.n = len(blobs)
        self.missing = np.asarray(blobs.is_null().to_numpy(zero_copy_only=False), bool)
        self.error, self.kind = np.zeros(self.n, np.int8), np.zeros(self.n, np.int8)
        self._data = data
        self._words = _at_every_byte(data, "<u4"), _at_every_byte(data, ">u4")
        self._numbers = _at_every_byte(data, "<f8"), _at_every_byte(data, ">f8")
        self._read(starts[:-1].copy(), starts[1:])
        self._arrange()

    def _read(self, at: np.ndarray, end: np.ndarray) -> None:
        rings_left, depth = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        order, width, has_z = np.zeros(self.n, np.int8), np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        members = np.zeros((self.n, DEEPEST + 1), np.int64)
        members[:, 0] = ~self.missing
        parts, rings = [], []
        rows, step = np.flatnonzero(~self.missing), 0

        def fail(which: np.ndarray, reason: int) -> None:
            self.error[which] = reason + 1

        def enough(which: np.ndarray, size) -> np.ndarray:
            """Those of ``which`` that have so many bytes left; the others fail."""
            fine = at[which] + size <= end[which]
            fail(which[~fine], 0)
            return fine

        def word(which: np.ndarray) -> np.ndarray:
            """The next number of four bytes, which is passed over."""
            values = np.empty(len(which), np.int64)
            for big in (0, 1):
                own = order[which] == big
                values[own] = self._words[big][at[which[own]]]
            at[which] += 4
            return values

        def ring(which: np.ndarray, sizes: np.ndarray) -> None:
            fine = enough(which, sizes * width[which] * 8)
            which, sizes = which[fine], sizes[fine]
            rings.append((which, np.full(len(which), step), at[which], sizes, width[which], order[which], has_z[which]))
            at[which] += sizes * width[which] * 8

        def part(which: np.ndarray, dim: int) -> None:
            parts.append((which, np.full(len(which), step), np.full(len(which), dim)))

        def header(which: np.ndarray) -> None:
            which = which[enough(which, 5)]
            order[which] = 1 - self._data[at[which]].astype(np.int8)
            known = (order[which] == 0) | (order[which] == 1)
            fail(which[~known], 1)
            which = which[known]
            at[which] += 1
            flags = word(which)
            # Extended form: flag bits; ISO form: thousands.
            thousands, code = np.divmod(flags & 0x0FFFFFFF, 1000)
            z = (flags & 0x80000000 > 0) | np.isin(thousands, (1, 3))
            m = (flags & 0x40000000 > 0) | np.isin(thousands, (2, 3))
            known = (code >= 1) & (code <= len(_NAMES)) & (thousands <= 3)
            fail(which[~known], 2)
            which, code, z, m, flags = which[known], code[known], z[known], m[known], flags[known]
            has_z[which], width[which] = z, 2 + z.astype(np.int64) + m
            self.kind[which] = np.where(self.kind[which] == 0, code, self.kind[which])
            at[which] += np.where(flags & 0x20000000 > 0, 4, 0)
            members[which, depth[which]] -= 1
            points, rest = which[code == _POINT], code != _POINT
            points = points[enough(points, width[points] * 8)]
            empty = np.empty(len(points), bool)
            for big in (0, 1):
                own = order[points] == big
                empty[own] = np.isnan(self._numbers[big][at[points[own]]])
            at[points[empty]] += width[points[empty]] * 8
            part(points[~empty], 0)
            ring(points[~empty], np.ones((~empty).sum(), np.int64))
            which, code = which[rest], code[rest]
            fine = enough(which, 4)
            which, code = which[fine], code[fine]
            count = word(which)
            lines = (code == _LINE) & (count > 0)
            part(which[lines], 1)
            ring(which[lines], count[lines])
            faces = (code == _POLYGON) & (count > 0)
            part(which[faces], 2)
            rings_left[which[faces]] = count[faces]
            several = (code > _POLYGON) & (count > 0)
            deep = several & (depth[which] >= DEEPEST)
            fail(which[deep], 3)
            several &= ~deep
            depth[which[several]] += 1
            members[which[several], depth[which[several]]] = count[several]

        while len(rows):
            inside = rings_left[rows] > 0
            faces = rows[inside]
            faces = faces[enough(faces, 4)]
            rings_left[faces] -= 1
            ring(faces, word(faces))
            header(rows[~inside])
            rows = rows[self.error[rows] == 0]
            # Leave collections that are complete.
            up = rows[(rings_left[rows] == 0) & (members[rows, depth[rows]] == 0) & (depth[rows] > 0)]
            while len(up):
                depth[up] -= 1
                up = up[(members[up, depth[up]] == 0) & (depth[up] > 0)]
            done = (rings_left[rows] == 0) & (members[rows, depth[rows]] == 0)
            ended = rows[done]
            fail(ended[at[ended] < end[ended]], 4)
            rows, step = rows[~done], step + 1
        self._parts, self._rings = parts, rings

    def _arrange(self) -> None:
        """Parts, rings and vertices in the order of the blobs, without those of bad ones."""

        def ordered(records: list[tuple[np.ndarray, ...]], columns: int) -> list[np.ndarray]:
            whole = [np.concatenate([r[c] for r in records]) if records else np.empty(0, np.int64) for c in range(columns)]
            keep = np.flatnonzero(self.error[whole[0]] == 0)
            keep = keep[np.lexsort((whole[1][keep], whole[0][keep]))]
            return [w[keep] for w in whole]

        row, step, self.part_dim = ordered(self._parts, 3)
        ring_row, ring_step, start, self.ring_size, width, order, has_z = ordered(self._rings, 7)
        # A ring is of the last part of its blob that began before it or with it.
        most = int(max(step.max(initial=0), ring_step.max(initial=0))) + 1
        self.part_row = row
        self.ring_part = np.searchsorted(row * most + step, ring_row * most + ring_step, side="right") - 1
        ends = np.cumsum(self.ring_size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - self.ring_size, self.ring_size)
        at = np.repeat(start, self.ring_size) + 8 * place * np.repeat(width, self.ring_size)
        big, self.has_z = np.repeat(order, self.ring_size) == 1, np.repeat(has_z, self.ring_size).astype(bool)
        self.vertex_row = np.repeat(ring_row, self.ring_size)
        self.x, self.y = self._values(at, big), self._values(at + 8, big)
        self.z = np.zeros(len(at))
        self.z[self.has_z] = self._values(at[self.has_z] + 16, big[self.has_z])

    def _values(self, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        little, other = self._numbers
        if not big.any():
            return little[at].astype(np.float64)
        return np.where(big, other[at], little[at]).astype(np.float64)

    @property
    def good(self) -> np.ndarray:
        return ~self.missing & (self.error == 0)

    def geometries(self) -> pa.Array:
        """Geometry structs, null for missing and bad blobs."""
        z = pa.array(self.z, mask=~self.has_z) if self.has_z.any() else pa.nulls(len(self.x), pa.float64())
        vertices = pa.StructArray.from_arrays([pa.array(self.x), pa.array(self.y), z], fields=list(_XYZ))
        rings = _lists(self.ring_size, vertices, _RING)
        of_part = _lists(np.bincount(self.ring_part, minlength=len(self.part_row)), rings, _RINGS)
        parts = pa.StructArray.from_arrays([pa.array(self.part_dim.astype(np.int32)), of_part], fields=list(_PART))
        of_row = _lists(np.bincount(self.part_row, minlength=self.n), parts, _PARTS)
        names = pa.array(_NAMES).take(pa.array(np.maximum(self.kind, 1) - 1))
        fields = [pa.field("type", pa.string()), pa.field("parts", _PARTS)]
        return pa.StructArray.from_arrays([names, of_row], fields=fields, mask=pa.array(~self.good))

    def errors(self) -> pa.Array:
        """Why blobs are bad, null for others."""
        return pa.array(ERRORS).take(pa.array(np.maximum(self.error, 1) - 1, mask=self.error == 0))

    def bounds(self) -> pa.Array:
        """The box of each geometry, null without vertices."""
        out = np.full((4, self.n), np.nan)
        if len(self.x):
            first = np.flatnonzero(np.diff(self.vertex_row, prepend=-1))
            rows = self.vertex_row[first]
            for k, (least, values) in enumerate(((np.minimum, self.x), (np.minimum, self.y), (np.maximum, self.x), (np.maximum, self.y))):
                out[k, rows] = least.reduceat(values, first)
        return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in out], names=list(BOUNDS))


def _lists(sizes: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values, type=kind)


def encode(geometries: pa.Array) -> pa.Array:
    """Little-endian ISO well-known binary of geometry structs; z where any vertex of a geometry has one."""
    parts = geometries.field("parts")
    here = np.asarray(geometries.is_valid().to_numpy(zero_copy_only=False), bool)
    n_parts = np.where(here, _sizes(parts), 0)
    part = _values_of(parts, here)
    rings = part.field("rings")
    dim = part.field("dim").to_numpy(zero_copy_only=False).astype(np.int64)
    n_rings = _sizes(rings)
    ring = _values_of(rings)
    n_vertices = _sizes(ring)
    vertex = _values_of(ring)
    x, y, z = (vertex.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z"))
    part_row, ring_part = np.repeat(np.arange(len(here)), n_parts), np.repeat(np.arange(len(dim)), n_rings)
    vertex_row = part_row[ring_part][np.repeat(np.arange(len(n_vertices)), n_vertices)]
    z_row = np.zeros(len(here), bool)
    z_row[vertex_row[~np.isnan(z)]] = True
    width = np.where(z_row, 24, 16)
    kind = np.asarray(pc.index_in(geometries.field("type"), pa.array(_NAMES)).fill_null(0).to_numpy()) + 1
    several = kind > _POLYGON

    # Sizes from the inside out, then places from the outside in.
    ring_bytes = n_vertices * width[part_row[ring_part]] + np.where(dim[ring_part] == 2, 4, 0)
    head = np.where(dim == 0, 5, 9)
    part_bytes = head + np.bincount(ring_part, ring_bytes, minlength=len(dim)).astype(np.int64)
    alone_empty = here & ~several & (n_parts == 0)
    row_head = np.where(several, 9, 0) + np.where(alone_empty, np.where(kind == _POINT, 21, 9), 0)
    row_bytes = np.where(here, row_head + np.bincount(part_row, part_bytes, minlength=len(here)).astype(np.int64), 0)
    row_at = np.cumsum(row_bytes) - row_bytes
    part_at = _placed(part_bytes, n_parts, row_at + row_head)
    ring_at = _placed(ring_bytes, n_rings, part_at + head)
    first_vertex = ring_at + np.where(dim[ring_part] == 2, 4, 0)
    size = width[vertex_row]
    vertex_at = _placed(size, n_vertices, first_vertex)

    data = np.zeros(int(row_bytes.sum()) + 8, np.uint8)
    words, numbers = _at_every_byte(data, "<u4"), _at_every_byte(data, "<f8")

    def put_head(at: np.ndarray, code: np.ndarray, row: np.ndarray) -> None:
        data[at] = 1
        words[at + 1] = code + np.where(z_row[row], 1000, 0)

    outer = np.flatnonzero(here & (several | alone_empty))
    put_head(row_at[outer], kind[outer], outer)
    counted = outer[kind[outer] != _POINT]
    words[row_at[counted] + 5] = n_parts[counted]
    points = outer[kind[outer] == _POINT]
    numbers[row_at[points] + 5] = np.nan
    numbers[row_at[points] + 13] = np.nan
    put_head(part_at, dim + 1, part_row)
    faces, lines = dim == 2, dim == 1
    words[part_at[faces] + 5] = n_rings[faces]
    words[part_at[lines] + 5] = np.bincount(ring_part, n_vertices, minlength=len(dim)).astype(np.int64)[lines]
    words[ring_at[dim[ring_part] == 2]] = n_vertices[dim[ring_part] == 2]
    numbers[vertex_at], numbers[vertex_at + 8] = x, y
    numbers[vertex_at[size == 24] + 16] = z[size == 24]
    offsets = np.concatenate([row_at, [row_bytes.sum()]]).astype(np.int64)
    valid = pa.py_buffer(np.packbits(here, bitorder="little"))
    made = pa.Array.from_buffers(pa.large_binary(), len(here), [valid, pa.py_buffer(offsets), pa.py_buffer(data)])
    return made.cast(pa.binary())


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _values_of(lists: pa.Array, keep: np.ndarray | None = None) -> pa.Array:
    return (lists if keep is None else lists.filter(pa.array(keep))).flatten()


def _placed(sizes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where items start that follow each other in groups: ``counts`` items from each of ``starts`` on."""
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    some = counts > 0
    return before + np.repeat(starts[some] - before[first[some]], counts[some])


@F.arrow_udf(DECODED)
def _decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for blobs in batches:
        found = Blobs(blobs)
        made = found.geometries()
        fields = [pa.field("geometry", made.type), pa.field("error", pa.string())]
        yield pa.StructArray.from_arrays([made, found.errors()], fields=fields)


@F.arrow_udf(BOX)
def _boxes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for blobs in batches:
        yield Blobs(blobs).bounds()


@F.arrow_udf(T.BinaryType())
def _encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for geometries in batches:
        yield encode(geometries)


def decode_wkb(blob: Column) -> Column:
    """``struct(geometry, error)``: a blob that is no geometry has a null geometry and a reason."""
    return _decoded(blob)


def from_wkb(blob: Column) -> Column:
    """Well-known binary (ISO or extended) to a geometry; null for null and for bad blobs."""
    return _decoded(blob)["geometry"]


def wkb_bounds(blob: Column) -> Column:
    """``struct(xmin, ymin, xmax, ymax)`` of a blob, without making its geometry."""
    return _boxes(blob)


def to_wkb(geom: Column) -> Column:
    """A geometry as little-endian ISO well-known binary; null stays null."""
    return _encoded(geom)
