"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings only, so they can be applied to a session someone else started.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join keys even where that costs one more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A Python worker holds several copies of a batch; long texts would make batches of 64 MB.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings (UTC, adaptive execution with skew splitting) to a session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def use_disk_state(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, where it may outgrow memory, unless the session names another store."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("featlake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Do not record a Python stack for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="featlake-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a session without that setting (a test, a laptop) gets a local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/featlake/{purpose}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder if the session has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))
