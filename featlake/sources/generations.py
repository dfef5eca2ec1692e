"""Small tables that are replaced as a whole: each state is a generation in a folder of its own.

A generation is one file, which Spark's committer puts in its place when the job ends: a reader takes
the newest one, so a new state is there at once or not at all. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GENERATION = "_generation"


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The number and rows of the newest generation; 0 and None if there is none yet."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0, None
    newest = rows.agg(F.max(_GENERATION)).first()[0] or 0
    return newest, rows.where(F.col(_GENERATION) == newest).drop(_GENERATION)


def add(rows: DataFrame, path: str, number: int) -> None:
    rows.coalesce(1).write.parquet(f"{path}/{_GENERATION}={number}")
