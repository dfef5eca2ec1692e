"""What the corpus operators share: reading documents, normal forms of text, materialised steps."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.session import scratch_dir, tune

# Functions of this subpackage travel to Python workers as code, so workers need not have it installed.
register_pickle_by_value(sys.modules["featlake.llm"])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a maximal run without these white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Where every character is one byte, ``lower`` does just that, faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc32_of(column: Column) -> Column:
    """Unsigned crc32 of the text form of a column; of the empty text where it is null."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def written(df: DataFrame, purpose: str, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared scratch folder: computed once, whatever reads them later.

    With ``by``, rows of each value of that column are files of their own.
    """
    path = scratch_dir(df.sparkSession, purpose)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(df: DataFrame, most: int, what: str) -> list:
    """The rows on the driver, for tables whose size is bounded; more than ``most`` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def bounded_broadcast(table: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A stored table, marked for broadcast if it has no more rows than that; else joins shuffle as usual."""
    return F.broadcast(table) if table.count() <= most else table


def kept_by_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by the Python worker for its later tasks.

    Code that travels to workers has no module of its own there that would last from task to task.
    """
    store = sys.modules.setdefault("_featlake_worker", types.ModuleType("_featlake_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def giving_back(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: tuple | None = None):
    """``work`` for ``mapInArrow``, with the memory of the worker given back, since it stays for other tasks.

    First what it kept for other operators goes, all but ``keep``; at the end what lies free in its allocators.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = vars(sys.modules.get("_featlake_worker", types.SimpleNamespace()))
        for key in [k for k in store if isinstance(k, tuple) and k != keep]:
            del store[key]
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return run
