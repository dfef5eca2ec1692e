"""One huge GeoJSON document read by many tasks.

Spark cuts a text file into byte ranges at any separator; with ``}`` a document without line feeds is
cut too. A range cannot know by itself whether it starts inside a string, or how deep. So each range
is first summed up, for both cases: how its quotes leave the state, how its brackets move the depth.
Sums of one file are chained in order, which gives every range its true start. Then each range cuts
out its own features; of one that crosses ranges each range gives its part, and parts are joined.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featlake.session import scratch_dir

# The functions travel to the executors with the job, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Depths below the document: its members, the features in their list, a feature's own members.
_MEMBER, _LISTED = 1, 2
#: Ranges of all documents read at once; their starts are on every executor, some 100 bytes each.
MOST_RANGES = 1_000_000
_FEATURES = re.compile(rb'"features"\s*:\s*\[')
_NOTHING = 1 << 40

_SUM = "file string, start long, quoted boolean, ends_quoted boolean, delta long, lowest long, opened long, lowest_since long"
_START = "file string, start long, quoted boolean, depth long, listed boolean"


class Brackets:
    """The brackets of a text outside its strings, if it starts inside a string or not."""

    def __init__(self, text: bytes, quoted: bool):
        data = np.frombuffer(text, np.uint8)
        quotes = (data == 0x22) & ~_escaped(data)
        inside = (np.cumsum(quotes) + quoted) % 2 == 1
        self.ends_quoted = bool(inside[-1]) if len(data) else quoted
        step = np.zeros(len(data), np.int8)
        step[(data == 0x7B) | (data == 0x5B)] = 1
        step[(data == 0x7D) | (data == 0x5D)] = -1
        self.at = np.flatnonzero((step != 0) & ~inside)
        self.step, self.kind = step[self.at], data[self.at]
        #: Depth behind each bracket, from 0 at the text's start.
        self.depth = np.cumsum(self.step, dtype=np.int64)

    def openings(self, text: bytes) -> np.ndarray:
        """Which brackets open a list called features."""
        ends = np.fromiter((m.end() - 1 for m in _FEATURES.finditer(text)), np.int64)
        return np.isin(self.at, ends)


def _escaped(data: np.ndarray) -> np.ndarray:
    """Which bytes follow an odd number of backslashes."""
    out = np.zeros(len(data), bool)
    slashes = np.flatnonzero(data == 0x5C)
    if len(slashes):
        # Runs of backslashes: only what comes right behind one matters.
        last = np.append(np.diff(slashes) > 1, True)
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        ends, odd = slashes[last], (np.flatnonzero(last) - first) % 2 == 0
        behind = ends[odd] + 1
        out[behind[behind < len(data)]] = True
    return out


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, list[bytes]]]:
    """The pieces of one range after another, in lots: file, start, first row's other columns, pieces."""
    for batch in batches:
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        cuts = np.flatnonzero(np.diff(starts, prepend=-1)).tolist()
        names = [files[i].as_py() for i in cuts]
        pieces = batch.column("value").cast(pa.large_binary()).to_pylist()
        others = [c for c in batch.schema.names if c not in ("file", "start", "value")]
        for a, b, name in zip(cuts, [*cuts[1:], batch.num_rows], names):
            row = {c: batch.column(c)[a].as_py() for c in others}
            yield name, int(starts[a]), row, pieces[a:b]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "}").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _sums(pieces: DataFrame) -> DataFrame:
    """Two rows for each range: what it does to a reader that comes to it inside or outside a string."""

    def work(batches: Iterable[pa.RecordBatch]):
        key, held = None, {}

        def passed_on():
            for quoted, (end, delta, lowest, opened, since) in held.items():
                yield {"file": key[0], "start": key[1], "quoted": quoted, "ends_quoted": end, "delta": delta, "lowest": lowest,
                       "opened": opened, "lowest_since": since}

        rows: list[dict] = []
        for name, start, _, pieces in _ranges(batches):
            if key != (name, start):
                rows.extend(passed_on())
                key, held = (name, start), {q: (q, 0, 0, _NOTHING, _NOTHING) for q in (False, True)}
            text = b"}".join([*pieces, b""])
            for quoted, (now, depth, lowest, opened, since) in held.items():
                b = Brackets(text, now)
                deep = depth + b.depth
                low = int(deep.min(initial=_NOTHING))
                ours = np.flatnonzero(b.openings(text))
                # The document's own list is the one that opens at the least depth; the last of these counts.
                before = deep[ours] - 1
                best = ours[before == before.min(initial=_NOTHING)]
                since = min(since, low)
                if len(best) and deep[best[-1]] - 1 <= opened:
                    opened, since = int(deep[best[-1]] - 1), int(deep[best[-1] :].min())
                held[quoted] = (b.ends_quoted, depth + int(b.depth[-1]) if len(b.depth) else depth, min(lowest, low), opened, since)
        rows.extend(passed_on() if key else ())
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_SUM))

    return pieces.mapInArrow(work, _SUM)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in schema.split(", "))])


def _chained(sums: pd.DataFrame) -> pd.DataFrame:
    """The true start of each range of one file: in a string or not, how deep, and whether in the list of features."""
    quoted, depth, listed, out = False, 0, False, []
    by = {(s, q): rest for s, q, *rest in sums.sort_values("start")[["start", "quoted", *_SUM_COLUMNS]].itertuples(index=False)}
    for start in sorted({s for s, _ in by}):
        out.append((sums["file"].iloc[0], start, quoted, depth, listed))
        quoted_after, delta, lowest, opened, since = by[start, quoted]
        if opened < _NOTHING and depth + opened == _MEMBER:
            listed = depth + since >= _LISTED
        else:
            listed = listed and depth + lowest >= _LISTED
        quoted, depth = bool(quoted_after), depth + delta
    return pd.DataFrame(out, columns=["file", "start", "quoted", "depth", "listed"])


_SUM_COLUMNS = ["ends_quoted", "delta", "lowest", "opened", "lowest_since"]


def _cut(placed: DataFrame) -> DataFrame:
    """Whole features as ``feature``, and parts of others with ``file, start, nth`` and whether they begin one."""
    schema = "feature string, file string, start long, nth long, begins boolean"

    def work(batches: Iterable[pa.RecordBatch]):
        key, state, open_text, nth = None, None, None, 0
        begun_here = False

        def left_over():
            """The part of a feature that a later range ends."""
            if open_text is not None:
                yield ("".join(open_text), *key, nth, begun_here)

        for name, start, row, pieces in _ranges(batches):
            found = []
            if key != (name, start):
                found.extend(left_over())
                key, state = (name, start), (row["quoted"], row["depth"], row["listed"])
                inside = row["listed"] and row["depth"] > _LISTED
                open_text, nth, begun_here = ([] if inside else None), 0, False
            text = b"}".join([*pieces, b""])
            quoted, depth, listed = state
            b = Brackets(text, quoted)
            deep = depth + b.depth
            opens = b.openings(text)
            at = 0
            # Only brackets between the list and its features matter.
            near = (deep <= _LISTED) | ((deep == _LISTED + 1) & (b.step > 0))
            for i in np.flatnonzero(near).tolist():
                if b.step[i] > 0:
                    if deep[i] == _LISTED and opens[i]:
                        listed = True
                    elif deep[i] == _LISTED + 1 and listed and b.kind[i] == 0x7B:
                        open_text, at, begun_here = [], int(b.at[i]), True
                elif deep[i] == _LISTED and open_text is not None:
                    open_text.append(text[at : int(b.at[i]) + 1].decode())
                    found.append(("".join(open_text), None, None, None, None) if begun_here else ("".join(open_text), *key, nth, False))
                    nth += 0 if begun_here else 1
                    open_text = None
                elif deep[i] < _LISTED:
                    listed = False
            if open_text is not None:
                open_text.append(text[at:].decode())
            state = (b.ends_quoted, depth + int(b.depth[-1]) if len(b.depth) else depth, listed)
            if found:
                yield _batch(found, schema)
        if key and (rest := list(left_over())):
            yield _batch(rest, schema)

    return placed.mapInArrow(work, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    arrow = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def split_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of GeoJSON documents as text, one row each: ``feature``.

    A document is an object with a list ``features``; other lists and members are passed over. The
    order of rows is not that of the document. A task takes one byte range of a file at a time.
    """
    pieces = _pieces(spark, path)
    sums = _sums(pieces)
    at = scratch_dir(spark, "ranges")
    sums.groupBy("file").applyInPandas(_chained, _START).write.parquet(at)
    starts = spark.read.schema(_START).parquet(at)
    if starts.count() > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges of text; raise spark.sql.files.maxPartitionBytes")
    # Joined without a shuffle, so the pieces of a range stay together and in order.
    cut = _cut(pieces.join(F.broadcast(starts), ["file", "start"]).select("value", "file", "start", "quoted", "depth", "listed"))
    whole = cut.where("file IS NULL").select("feature")
    order = Window.partitionBy("file").orderBy("start", "nth", "begins")
    # A range has at most two parts, so this window is over a few rows for each range.
    parts = cut.where("file IS NOT NULL").withColumn("_of", F.sum(F.col("begins").cast("int")).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("start", "nth", "begins", "feature")))
    joined = parts.groupBy("file", "_of").agg(F.array_join(F.transform(ordered, lambda p: p["feature"]), "").alias("feature"))
    return whole.unionByName(joined.select("feature"))
