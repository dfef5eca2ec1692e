"""One feature collection: a DataFrame plus the roles of its columns."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.operators import crs as C
from featlake.operators import describe as D
from featlake.operators import filters as Fl
from featlake.operators import geometry as G
from featlake.operators import paging as P
from featlake.operators.predicates import PredicateBuilder


class SchemaError(ValueError):
    """A configured column does not exist in the source."""


@dataclasses.dataclass(frozen=True)
class FeatureTable:
    """A source of features with the nine operations of a feature collection.

    Either ``x`` and ``y`` name plain coordinate columns (a point table, whose predicates reach
    the Parquet scan) or ``geom`` names a geometry struct, with flat bounds columns beside it if
    the table stores them.
    """

    df: DataFrame
    id: str
    geom: str | None = None
    x: str | None = None
    y: str | None = None
    time: str | None = None
    time_end: str | None = None
    srid: int = 4326
    title: str = ""
    page_size: int | None = None
    page_size_max: int | None = None
    loose_bounds: bool = False

    def __post_init__(self):
        wanted = [c for c in (self.id, self.geom, self.x, self.y, self.time, self.time_end) if c]
        missing = [c for c in wanted if c not in self.df.columns]
        if missing:
            raise SchemaError(f"no column {missing[0]!r}; available: {', '.join(self.df.columns)}")
        if (self.geom is None) == (self.x is None or self.y is None):
            raise SchemaError("name either a geometry column or x and y")

    # --- columns ----------------------------------------------------------------------------

    @property
    def geometry(self) -> Column:
        return F.col(self.geom) if self.geom else G.point(F.col(self.x), F.col(self.y))

    @property
    def geometry_name(self) -> str:
        return self.geom or "geom"

    @property
    def bounds(self) -> dict[str, Column]:
        if self.geom is None:
            return {"xmin": F.col(self.x), "ymin": F.col(self.y), "xmax": F.col(self.x), "ymax": F.col(self.y)}
        if set(G.BOUNDS) <= set(self.df.columns):
            return {b: F.col(b) for b in G.BOUNDS}
        return G.bounds(self.geometry)

    @property
    def properties(self) -> list[str]:
        hidden = {self.id, self.geom, self.x, self.y}
        if self.geom:
            hidden |= set(G.BOUNDS)
        return [c for c in self.df.columns if c not in hidden]

    # --- predicates -------------------------------------------------------------------------

    def box_predicate(
        self,
        box: tuple[float, float, float, float],
        crs: str | int = 4326,
        keep_null_geometry: bool = False,
    ) -> Column:
        """Exact intersection with a request's box, given in any supported CRS."""
        source = C.parse_srid(crs)
        boxes = Fl.split_at_antimeridian(box) if source in (4326, 4258) else [box]
        test = F.lit(False)
        for one in boxes:
            test |= self._one_box(one, source)
        if keep_null_geometry:
            missing = F.col(self.geom).isNull() if self.geom else F.col(self.x).isNull() | F.col(self.y).isNull()
            test |= missing
        return test

    def _one_box(self, box: tuple[float, float, float, float], source: int) -> Column:
        native = C.transform_box(box, source, self.srid)
        own, asked = self.bounds, G.box_columns(*native)
        near = G.bounds_overlap(own, asked)
        outline = C.box_outline(box, source, self.srid)
        if outline is not None:
            ring = F.array(*[G.vertex(x, y) for x, y in outline])
            return near & G.intersects(self.geometry, G.geometry("Polygon", F.array(G.part(2, F.array(ring)))))
        if self.loose_bounds:
            return near & G.intersects_box(self.geometry, *native)
        # The bounds of a point are the point, so the cheap test is already exact.
        return near if self.geom is None else G.meets_box(self.geometry, own, asked)

    def predicate(self, f: Fl.FeatureFilter) -> Column | None:
        """The conjunction of everything a request asks for, or None for no condition."""
        terms: list[Column] = []
        if f.bbox is not None:
            terms.append(self.box_predicate(f.bbox, f.bbox_crs, f.keep_null_geometry))
        if f.datetime is not None and self.time is not None:
            terms.append(Fl.between_instants(F.col(self.time), f.datetime))
        for name, value in f.properties.items():
            if name not in self.df.columns:
                raise Fl.BadRequest(f"unknown property {name!r}")
            terms.append(F.col(name) == F.lit(value).try_cast(self.df.schema[name].dataType))
        if f.q:
            texts = [F.col(x.name) for x in self.df.schema.fields if isinstance(x.dataType, T.StringType)]
            terms.append(Fl.text_search(texts, f.q))
        if f.filter is not None:
            terms.append(self.predicates(f.filter_crs or 4326).compile(f.filter))
        if not terms:
            return None
        result = terms[0]
        for term in terms[1:]:
            result &= term
        return result

    def predicates(self, crs: str | int = 4326) -> PredicateBuilder:
        """The compiler for predicate documents over this table."""
        return PredicateBuilder(self.df.schema, lambda box: self.box_predicate(box, crs), self.geometry_name)

    def select(self, f: Fl.FeatureFilter) -> DataFrame:
        """All matching rows, unordered and unpaged."""
        condition = self.predicate(f)
        return self.df if condition is None else self.df.where(condition)

    # --- the nine operations ----------------------------------------------------------------

    def to_features(self, rows: DataFrame, f: Fl.FeatureFilter = Fl.FeatureFilter()) -> DataFrame:
        """Rows to features: id as text, geometry in the requested CRS, its CRS, properties."""
        target = self.srid if f.crs is None else C.parse_srid(f.crs)
        names = self.properties
        if f.returned is not None:
            names = [c for c in f.returned if c in names]
        columns = [F.coalesce(F.col(self.id).cast("string"), F.lit("")).alias("id")]
        if not f.skip_geometry:
            columns.append(C.reproject(self.geometry, self.srid, target).alias(self.geometry_name))
            columns.append(F.lit(C.format_srid(target)).alias("crs"))
        return rows.select(*columns, *[F.col(c) for c in names if c != "id"])

    def list_features(self, f: Fl.FeatureFilter = Fl.FeatureFilter()) -> DataFrame:
        """One page, ordered by the typed id; only the rows of the page are reprojected."""
        limit = P.clamp_limit(f.limit, self.page_size, self.page_size_max)
        order = [F.asc_nulls_last(self.id)]
        if f.sort_by:
            order = P.sort_columns(f.sort_by, self.df.columns, self.id)
        return self.to_features(P.page(self.select(f), order, limit, f.offset), f)

    def count_items(self, f: Fl.FeatureFilter = Fl.FeatureFilter()) -> DataFrame:
        return D.counts(self.df, self.predicate(f))

    def get_feature(self, feature_id: str, f: Fl.FeatureFilter = Fl.FeatureFilter(), strict: bool = False) -> DataFrame:
        """The feature with an id given as text; text that is no valid id finds nothing."""
        kind = self.df.schema[self.id].dataType
        literal = F.lit(feature_id)
        if not isinstance(kind, T.StringType):
            if strict and isinstance(kind, T.IntegralType) and not feature_id.strip().lstrip("+-").isdigit():
                raise Fl.BadRequest(f"{feature_id!r} is no valid id")
            literal = literal.try_cast(kind)
        return self.to_features(self.df.where(F.col(self.id) == literal), f)

    def get_features(self, wanted: DataFrame, column: str, f: Fl.FeatureFilter = Fl.FeatureFilter()) -> DataFrame:
        """The features for a table of ids given as text."""
        kind = self.df.schema[self.id].dataType
        keys = wanted.select(F.col(column).try_cast(kind).alias("_wanted"))
        return self.to_features(self.df.join(keys, F.col(self.id) == F.col("_wanted"), "left_semi"), f)

    def _geometry_type(self) -> DataFrame:
        kind = F.lit("Point") if self.geom is None else F.col(self.geom)["type"]
        present = self.df.where(self.geometry.isNotNull() if self.geom else F.col(self.x).isNotNull())
        return present.agg(D.single_type(kind).alias("geometry_type"))

    def get_schema(self, identifier: str | None = None) -> DataFrame:
        """The schema document, one row; only the geometry type needs a scan."""
        return self._document(self.title, identifier, with_geometry=True)

    def get_queryables(self, identifier: str | None = None) -> DataFrame:
        """The queryables document: everything but the geometry."""
        return self._document("Queryables", identifier, with_geometry=False)

    def _document(self, title: str, identifier: str | None, with_geometry: bool) -> DataFrame:
        pairs: list[Column] = []

        def add(name: str, fragment: Column) -> None:
            pairs.append(F.struct(F.lit(name).alias("property"), fragment.alias("schema")))

        for field in self.df.schema.fields:
            if field.name == self.id:
                schema = D.type_schema(field.dataType, field.metadata)
                if with_geometry:
                    schema["x-ogc-role"] = "id"
                add(field.name, F.lit(_compact(schema)))
            elif field.name in self.properties:
                add(field.name, F.lit(_compact(D.type_schema(field.dataType, field.metadata))))
        if with_geometry:
            add(self.geometry_name, D.geometry_fragment(F.col("geometry_type"), F.lit(self.srid)))
            rows = self._geometry_type()
        else:
            rows = self.df.sparkSession.range(1)
        key = None if identifier is None else F.lit(identifier)
        return rows.select(D.schema_document(F.lit(title), F.array(*pairs), key).alias("document"))

    def get_storage_crs(self) -> str:
        return C.format_srid(self.srid)

    def get_spatial_extent(self) -> DataFrame:
        """Native box and CRS84 box, one row; nulls when there are no geometries."""
        separable = self.srid in (4326, 4258, 3857)
        own = G.bounds(self.geometry) if self.loose_bounds else self.bounds
        native = self.df.agg(*D.extent(own), *([] if separable else self._degree_extent()))
        return D.extent_in_crs84(native, self.srid) if separable else native

    def _degree_extent(self) -> list[Column]:
        if self.geom is None:
            lon, lat = C.transform_xy(F.col(self.x), F.col(self.y), self.srid, 4326)
            box = {"xmin": lon, "ymin": lat, "xmax": lon, "ymax": lat}
        else:
            box = G.bounds(C.reproject(self.geometry, self.srid, 4326))
        names = dict(zip(G.BOUNDS, ("west", "south", "east", "north")))
        return [c.alias(names[b]) for b, c in zip(G.BOUNDS, D.extent(box))]

    def get_temporal_extent(self) -> DataFrame | None:
        if self.time is None:
            return None
        end = F.col(self.time_end) if self.time_end else None
        return self.df.agg(*D.temporal_extent(F.col(self.time), end))

    def get_additional_extents(self, columns: Sequence[tuple[str, str | None]]) -> DataFrame | None:
        """Ranges of further ordered columns, given as (column, unit) pairs: one row each, one scan."""
        if not columns:
            return None
        rows = [
            F.struct(
                F.lit(c).alias("name"),
                F.min(c).cast("string").alias("begin"),
                F.max(c).cast("string").alias("end"),
                F.lit(u).cast("string").alias("unit_name"),
            )
            for c, u in columns
        ]
        return self.df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _compact(value) -> str:
    return json.dumps(value, separators=(",", ":"))
