"""The named queries of the engine, each with the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featlake.plans import derived
from featlake.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one folder and the tables derived from them, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in derived.DERIVED:
            base, columns = derived.DERIVED[name]
            return getattr(self, base).selectExpr(*columns)
        if name in derived.GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


def query(key: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; ``uses`` names the derived tables its SQL refers to."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))

        run.__name__, run.__doc__ = key, build.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = derived.with_tables(uses, sql)
        return build

    return register
