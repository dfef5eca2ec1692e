"""Row shapes: features out of property bags, missing numbers, ids for rows without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def feature_of_bag(df: DataFrame, key: str, bag: str) -> DataFrame:
    """Id as text and the property bag without a property that repeats the id."""
    return df.withColumns(
        {
            "id": F.coalesce(F.col(key).cast("string"), F.lit("")),
            "properties": F.map_filter(bag, lambda k, _: k != "id"),
        }
    ).drop(key, bag)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in every floating point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def with_file_row_id(df: DataFrame, name: str = "id", root: str | None = None) -> DataFrame:
    """An id for file rows without one: the file's path and the position in it (Parquet only).

    The path is that below ``root``, the table's folder, or the file's name if the table is one file;
    without ``root``, or if it is spelled in another way, the whole path. Names alone would repeat:
    a task writes files of one name into every partition folder.
    """
    path = F.col("_metadata.file_path")
    if root is not None:
        below = F.lit("/" + root.split(":", 1)[-1].strip("/"))
        at = F.instr(path, below)
        rest = F.ltrim(F.substring(path, at + F.length(below), F.length(path)), F.lit("/"))
        path = F.when(at == 0, path).when(rest == "", F.col("_metadata.file_name")).otherwise(rest)
    return df.withColumn(name, F.concat(path, F.lit(":"), F.col("_metadata.row_index").cast("string")))
