"""Pages of an ordered listing: one page, keyset pages, and page numbers for a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.operators.slices import default_slices, with_slice
from featlake.session import use_checkpoints

PAGE_SIZE, PAGE_SIZE_MAX = 20, 100


def clamp_limit(
    requested: int | None, custom: int | None = None, custom_max: int | None = None
) -> int:
    """The page size to use: the request's, else the collection's, else 20; at most the maximum."""
    return min(requested or custom or PAGE_SIZE, custom_max or PAGE_SIZE_MAX)


def clamp_limit_column(requested: Column, custom: Column, custom_max: Column) -> Column:
    """Bulk form of :func:`clamp_limit`; zero counts as not given."""

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(0))

    return F.least(
        F.coalesce(given(requested), given(custom), F.lit(PAGE_SIZE)),
        F.coalesce(given(custom_max), F.lit(PAGE_SIZE_MAX)),
    )


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order: every task keeps offset + limit rows, nothing is fully sorted."""
    rows = df.orderBy(*order).offset(max(offset, 0)).limit(limit)
    # The optimizer moves later projections below a limit, where they would run on every row and
    # turn the top-k into a full sort. It does not move them through this filter, which keeps all.
    return rows.where(F.monotonically_increasing_id() >= 0)


def page_number(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of pages with ``size`` rows."""
    return page(df, order, size, size * (number - 1))


def page_after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The page behind the row with key ``last``: a filter the scan can use, however deep."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return page(rows, [F.asc(key)], limit)


def number_pages(df: DataFrame, key: str, size: int, slices: int | None = None) -> DataFrame:
    """Add ``position`` (from 0) and ``page_number`` (from 1) to every row, ordered by a unique key.

    The key range is cut into slices of about equal size. Rows are ranked inside their slice and
    shifted by the number of rows in the slices before it, so no task sees the whole table.
    """
    slices = slices or default_slices(df)
    if isinstance(df.schema[key].dataType, T.NumericType):
        sliced = with_slice(df, F.col(key), slices)
    else:
        use_checkpoints(df.sparkSession)
        # Text keys have no percentiles: fix a range partitioning in shared storage instead.
        ranged = df.repartitionByRange(slices, key).withColumn("_slice", F.spark_partition_id())
        sliced = ranged.checkpoint()
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(key)) - 1
    placed = sliced.withColumn("_rank", rank)
    if slices < 2:
        # Nothing is before a single slice; its number is a constant, which would make the join a cross join.
        placed = placed.withColumn("_shift", F.lit(0))
    else:
        counts = sliced.groupBy("_slice").agg(F.count("*").alias("_rows"))
        # One row per slice, so this window is over a bounded table.
        before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        shifts = counts.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
        placed = placed.join(shifts, "_slice")
    return (
        placed.withColumn("position", (F.col("_rank") + F.col("_shift")).cast("bigint"))
        .withColumn("page_number", (F.floor(F.col("position") / size) + 1).cast("bigint"))
        .drop("_slice", "_rank", "_shift")
    )


def total_pages(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("bigint")


def link_columns(
    matched: Column, offset: Column, limit: Column, base: Column, extra: Column | None = None
) -> dict[str, Column]:
    """Links to the previous and next page, null where there is none."""
    tail = F.lit("") if extra is None else F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("&"), extra)).otherwise("")

    def href(target: Column) -> Column:
        return F.concat(base, F.lit("?offset="), target.cast("string"), tail)

    return {
        "prev_href": F.when(offset > 0, href(F.greatest(offset - limit, F.lit(0)))),
        "next_href": F.when(matched > offset + limit, href(offset + limit)),
    }


def sort_columns(expression: str, known: list[str], tiebreak: str) -> list[Column]:
    """``+name,-date`` to sort columns with nulls last and the id as the last key."""
    columns = []
    for piece in filter(None, (p.strip() for p in expression.split(","))):
        name = piece.lstrip("+-")
        if name not in known:
            raise ValueError(f"unknown sort property {name!r}")
        columns.append(F.desc_nulls_last(name) if piece.startswith("-") else F.asc_nulls_last(name))
    return [*columns, F.asc_nulls_last(tiebreak)]
