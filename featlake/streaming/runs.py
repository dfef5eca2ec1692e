"""Running streams: file sources and finite runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.session import scratch_dir


def read_table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    """A given table, one file or a folder of files, as a stream; its time columns become UTC timestamps.

    A table that is not there, or has no files, is an error.
    """
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A stream reads folders; a table of one file is that file of its folder, and no other.
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    rows = reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    stamps = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    # Watermarks need timestamps with a zone; the session zone is UTC.
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in stamps})


def run_to_end(stream: DataFrame, purpose: str) -> DataFrame:
    """Process everything available, write it to the shared scratch folder, and read it back."""
    spark = stream.sparkSession
    target = scratch_dir(spark, purpose)
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{target}/checkpoint")
        .option("path", f"{target}/rows")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
