"""Ranked lexical search by pipelined term partitioning.

The index holds, for slices of some thousand documents, the documents and frequencies of each term.
Terms are dealt to owners by document frequency, the rarest first, and an owner's postings are
stored together. An item travels as bundles, one for each slice of documents: its terms and weights,
and the scores that documents of the slice have so far. At each owner, bundles meet the owner's
postings of their slice in a cogroup, whole-number contributions are added, and the bundles go on to
the next owner. The last owner's sums are complete, and the best documents are selected.

A document leaves a bundle when all that is still to come could not lift it over the documents that
the bundle needs: few documents travel, and none that belongs to the result is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import bounded_broadcast, whole_text, written

#: Results of an item.
TOP = 10
#: Owners by the share of documents that hold a term: up to these shares, and the rest.
SHARES = (0.005, 0.02, 0.08, 0.25)
#: No contribution of weight 1 is larger.
MOST_IMPACT = 1_000_000
#: Documents and bytes of text of a slice, items of a block.
DOCS, TEXT, ITEMS = 8192, 32 << 20, 128
#: Cells that tell which terms some item has, a fixed size: false hits are dropped later.
CELLS = 1 << 21
#: Bytes of a text that are worked on at once.
LOT = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9a-z\x80-\xff]")


def term_lots(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased from A to Z, in lots cut between terms."""
    text, start = text.lower(), 0
    while start < len(text):
        cut = _OTHER.search(text, start + LOT)
        end = cut.start() if cut else len(text)
        yield _TERM.findall(text, start, end)
        start = end


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term``, each once."""
    id_type = items.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            sets = [{t for lot in term_lots(x.as_py()) for t in lot} for x in batch.column(1).cast(pa.large_binary())]
            each = np.repeat(np.arange(len(sets)), list(map(len, sets)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array([t.decode() for s in sets for t in s], pa.string())],
                names=["item_id", "term"],
            )

    rows = items.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(work, f"item_id {id_type}, term string").distinct()


# --- The index ------------------------------------------------------------------------------------


def marked_cells(terms: DataFrame) -> bytes:
    """A byte for each cell, 1 if a term falls into it."""
    cell = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(CELLS)).cast("int")
    marks = np.zeros(CELLS, np.uint8)
    marks[terms.select(cell.alias("cell")).distinct().toArrow().column("cell").to_numpy()] = 1
    return marks.tobytes()


class Slice:
    """Postings of up to ``DOCS`` documents."""

    def __init__(self, number: int, id_type: pa.DataType):
        self.number, self.id_type = number, id_type
        self.ids, self.lengths, self.size = [], [], 0
        self.postings: dict[bytes, tuple[list[int], list[int]]] = {}

    def add(self, doc_id, text: bytes, marks: bytes) -> None:
        place, n, counts = len(self.ids), 0, Counter()
        for terms in term_lots(text):
            n += len(terms)
            counts.update(terms)
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.size += len(text)
        crc32 = zlib.crc32
        for term, tf in counts.items():
            if marks[crc32(term) % CELLS]:
                held = self.postings.get(term)
                if held is None:
                    held = self.postings[term] = ([], [])
                held[0].append(place)
                held[1].append(tf)

    def batch(self) -> pa.RecordBatch:
        """A row with the slice's documents, then a row for each term."""
        terms = list(self.postings)
        rest = [None] * len(terms)
        return pa.RecordBatch.from_arrays([
            pa.array([self.number] * (1 + len(terms)), pa.int64()),
            pa.array([None, *(t.decode() for t in terms)], pa.string()),
            pa.array([None, *(np.array(self.postings[t][0], np.uint16).tobytes() for t in terms)], pa.binary()),
            pa.array([None, *(np.array(self.postings[t][1], np.uint32).tobytes() for t in terms)], pa.binary()),
            pa.array([len(self.ids) - self.lengths.count(0), *(len(self.postings[t][0]) for t in terms)], pa.int64()),
            pa.array([sum(self.lengths), *rest], pa.int64()),
            pa.array([self.ids, *rest], pa.list_(self.id_type)),
            pa.array([np.array(self.lengths, np.int64).tobytes(), *rest], pa.binary()),
        ], names=["slice", "term", "docs", "tfs", "n_docs", "n_terms", "ids", "lengths"])


def index(docs: DataFrame, marks: bytes, id_col: str, text_col: str) -> DataFrame:
    """Slices of the documents: per slice a row without a term, and per term in a marked cell its postings."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def work(batches: Iterable[pa.RecordBatch]):
        first, number, marks = TaskContext.get().partitionId() << 32, 0, shared.value
        held = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                held = held or Slice(first + number, batch.column(0).type)
                held.add(doc_id, text.as_py(), marks)
                if len(held.ids) == DOCS or held.size > TEXT:
                    yield held.batch()
                    held, number = None, number + 1
        if held:
            yield held.batch()

    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"slice long, term string, docs binary, tfs binary, n_docs long, n_terms long, ids array<{id_type}>, lengths binary"
    return written(rows.mapInArrow(work, schema), "index")


# --- The pipeline of owners -----------------------------------------------------------------------


def impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to documents with these frequencies and length terms."""
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)


def needed(scores: np.ndarray, to_come: int, top: int) -> np.ndarray:
    """Which documents may be among the ``top`` best of a slice when at most ``to_come`` is added to each."""
    if len(scores) <= top:
        return np.ones(len(scores), bool)
    return scores + to_come >= np.partition(scores, -top)[-top]


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``top`` best documents of each item: ``item_col, rank, id_col, score``.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased from
    A to Z. A null or empty text has no term: such an item gives no rows, such a document is not
    counted. Rows that share an item id, null included, are one item with the terms of all. Rows of
    documents that repeat an id are documents of their own; equal scores go by ascending id, a null
    id last. Only documents with a score above zero are returned. Either table may be empty; other
    columns are not read.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    wanted = written(item_terms(items, item_col, item_text), "items")
    slices = index(docs, marked_cells(wanted), id_col, text_col)
    postings = slices.where("term IS NOT NULL")
    whole = slices.where("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, total = whole["n"] or 0, whole["l"] or 0

    # Weights and owners of the items' terms.
    owner = sum([F.when(F.col("df") > share * n, 1).otherwise(0) for share in SHARES], F.lit(0))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    df = postings.groupBy("term").agg(F.sum("n_docs").alias("df"))
    terms = df.join(wanted.select("term").distinct(), "term", "left_semi").select("term", owner.alias("owner"), weight.alias("w"))
    terms = written(terms, "terms")
    bundled = wanted.join(terms, "term").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("owner", "term", "w"))).alias("terms"))
    bundled = written(bundled.withColumn("item", F.monotonically_increasing_id()), "bundles")
    blocks = -(-bundled.count() // ITEMS)
    if not blocks:
        return spark.createDataFrame([], f"{item_col} {item_type}, rank int, {id_col} {id_type}, score long")

    def in_blocks(rows: DataFrame) -> DataFrame:
        """A row for each block of items; one block unless there are very many items."""
        return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    owned = postings.join(bounded_broadcast(terms.select("term", "owner")), "term")
    owned = written(owned.select("slice", "term", "docs", "tfs", "owner"), "postings", by="owner")
    lengths = slices.where("term IS NULL").select("slice", "ids", "lengths")
    of_block = bundled.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    nothing = F.lit(b"")
    bundles = in_blocks(lengths.select("slice")).join(of_block, "block").select(
        "slice", "block", "item", "item_id", "terms", nothing.alias("docs"), nothing.alias("scores")
    )

    def owner_stage(number: int, last: bool):
        def add(bundles: pa.Table, met: pa.Table) -> pa.Table:
            slice_row = met.filter(pc.is_valid(met.column("lengths")))
            n_terms = np.frombuffer(slice_row.column("lengths")[0].as_py(), np.int64)
            m = np.array([100 - 90 + 90 * x * n // max(total, 1) for x in n_terms.tolist()], np.int64)
            found = {}
            for term, at, tfs in zip(*(met.column(c).to_pylist() for c in ("term", "docs", "tfs"))):
                if term is not None:
                    places = np.frombuffer(at, np.uint16)
                    found[term] = places, impacts(np.frombuffer(tfs, np.uint32).astype(np.int64), m[places])
            out_docs, out_scores, sums = [], [], np.zeros(len(m), np.int64)
            for all_terms, at, scores in zip(*(bundles.column(c).to_pylist() for c in ("terms", "docs", "scores"))):
                sums[:] = 0
                sums[np.frombuffer(at, np.uint16)] = np.frombuffer(scores, np.int64)
                to_come = 0
                for t in all_terms:
                    if t["owner"] == number and t["term"] in found:
                        places, impact = found[t["term"]]
                        sums[places] += t["w"] * impact
                    to_come += t["w"] * MOST_IMPACT if t["owner"] > number else 0
                at = np.flatnonzero(sums)
                at = at[needed(sums[at], to_come, top)]
                out_docs.append(at.astype(np.uint16))
                out_scores.append(sums[at])
            if last:
                return best(bundles, slice_row.column("ids")[0].values, out_docs, out_scores)
            done = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (out_docs, out_scores)]
            return pa.table([*(bundles.column(c) for c in ("slice", "block", "item", "item_id", "terms")), *done], names=bundles.column_names)

        return add

    def best(bundles: pa.Table, ids: pa.Array, docs: list[np.ndarray], scores: list[np.ndarray]) -> pa.Table:
        """The best documents of each bundle."""
        picked = []
        for at, score in zip(docs, scores):
            t = pa.table({"score": score, "id": ids.take(pa.array(at))})
            picked.append(t.take(pc.sort_indices(t, [("score", "descending"), ("id", "ascending")])[:top]))
        each = pa.array(np.repeat(np.arange(len(picked)), np.array([t.num_rows for t in picked], int)))
        none = pa.table({"score": pa.array([], pa.int64()), "id": ids.slice(0, 0)})
        both = pa.concat_tables([none, *picked])
        columns = [bundles.column("item").take(each), bundles.column("item_id").take(each), both.column("id"), both.column("score")]
        return pa.table(columns, names=["item", "item_id", "_id", "score"])

    keys, last = ["slice", "block"], len(SHARES)
    columns = ["slice", "term", "docs", "tfs", "ids", "lengths"]
    for number in range(last + 1):
        here = owned.where(F.col("owner") == number).unionByName(lengths, allowMissingColumns=True).select(*columns)
        schema = f"item long, item_id {item_type}, _id {id_type}, score long" if number == last else bundles.schema
        met = bundles.groupBy(*keys).cogroup(in_blocks(here).groupBy(*keys))
        bundles = met.applyInArrow(owner_stage(number, number == last), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    ranked = bundles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
