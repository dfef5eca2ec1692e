"""Mixing sources to target weights in fixed-length blocks.

The words of a source form one stream, document after document, cut into blocks of ``BLOCK`` words;
the last block may be shorter. Output shards have equal numbers of slots for blocks. For each shard
the numbers of slots per source are drawn from a multinomial distribution whose probabilities are
what remains of the targets, so no source drifts away from its target. The slots of a source are
numbered through all shards, and a pseudorandom permutation of the source's block numbers says
which block a slot holds; a second round through the permutation repeats blocks. Slots meet blocks,
and so documents, by an equi-join on the block number.

Only one number per source passes through the driver. Offsets in a source's stream come from sums
of ``PARTS`` parts per source, so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import SPACE, WORD, collected, giving_back, whole_text, written

BLOCK, SHARDS, PARTS = 128, 64, 1024
WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
MOST_SOURCES = 100_000
#: Slots of one source in one shard are listed in runs of so many.
RUN = 1 << 14
#: Slots that one task lists.
TASK = 1 << 18


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_fill(sizes: list[int], weights: list[int], share: float = SHARE, most: float = MOST_REPEATS) -> list[float]:
    """Targets by weight that sum to ``share`` of all sizes, none above ``most`` times its size.

    The excess of a source that reaches its limit is shared by weight among the others, until none
    is above; if all reach it, the sum is smaller.
    """
    limits = [most * s for s in sizes]
    targets, free, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] >= limits[i]]
        if not full:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = float(limits[i])
            rest -= limits[i]
        free = [i for i in free if i not in set(full)]
    return targets


@dataclass(frozen=True)
class Plan:
    """Per source, in code point order with null last: its number, name, words and target, and the draws.

    ``draws[shard][source]`` is a number of slots, ``first[shard][source]`` the number of the first.
    """

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    draws: np.ndarray
    first: np.ndarray


def plan_mix(sizes: dict[str | None, int], shards: int = SHARDS, block: int = BLOCK, seed: int = 0) -> Plan:
    """Targets and draws for sources of these sizes, always the same for the same seed."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    counts = [sizes[s] for s in names]
    targets = water_fill(counts, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    blocks = np.array([-(-c // block) for c in counts], np.int64)
    # In blocks, a target may end inside one; a whole round of a short last block counts as one.
    ratio = np.divide(targets, counts, out=np.zeros(len(names)), where=np.array(counts) > 0) if names else np.zeros(0)
    left = np.minimum(np.rint(ratio * blocks).astype(np.int64), MOST_REPEATS * blocks)
    rng = np.random.Generator(np.random.Philox(seed))
    draws = np.zeros((shards, len(names)), np.int64)
    for shard in range(shards):
        slots = -(-int(left.sum()) // (shards - shard))
        while slots > 0:
            # A draw beyond what a source has left is drawn again from the others.
            drawn = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            draws[shard] += drawn
            left = left - drawn
            slots -= int(drawn.sum())
    return Plan(names, counts, targets, draws, np.cumsum(draws, axis=0) - draws)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1 per key, at these indices.

    A four-round Feistel network permutes the next power of four; indices that leave the range are
    permuted again until they are inside.
    """
    half = np.array([max(1, (int(s - 1).bit_length() + 1) // 2) for s in np.unique(size)], np.uint64)
    half = half[np.unique(size, return_inverse=True)[1]]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    limit, key = size.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for round_ in range(4):
            step = np.uint64((round_ + 1) * 0xD1B54A32D192ED03 % 2**64)
            x = (right ^ (k * np.uint64(0x9E3779B97F4A7C15))) + step
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def slots(spark, plan: Plan, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per slot: ``shard, source_no, slot`` (in its source) ``, block`` (in its source) ``, round``."""
    blocks = [-(-s // block) for s in plan.sizes]
    runs = [
        (shard, s, int(plan.first[shard, s]), int(plan.draws[shard, s]), blocks[s])
        for shard in range(plan.draws.shape[0]) for s in range(len(blocks)) if plan.draws[shard, s]
    ]
    table = spark.createDataFrame(runs, "shard int, source_no int, first long, n long, blocks long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))
    tasks = -(-int(plan.draws.sum()) // TASK) or 1
    runs_of = table.withColumn("at", F.explode(starts)).repartition(tasks)
    last = F.least(F.col("at") + RUN, F.col("n")) - 1
    listed = runs_of.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + last)))

    def work(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            source, slot, size = (b.column(c).to_numpy() for c in ("source_no", "slot", "blocks"))
            at = permuted(slot % size, size, source.astype(np.int64) * 1_000_003 + seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("shard"), b.column("source_no"), b.column("slot"), pa.array(at), pa.array((slot // size).astype(np.int32))],
                names=["shard", "source_no", "slot", "block", "round"],
            )

    return listed.select("shard", "source_no", "slot", "blocks").mapInArrow(
        giving_back(work), "shard int, source_no int, slot long, block long, round int"
    )


@dataclass(frozen=True)
class Mix:
    """A planned mix. ``rows``: ``_row, _id, _source_no, _size, _start`` per document; ``slots``: see above."""

    plan: Plan
    rows: DataFrame
    slots: DataFrame
    block: int


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    shards: int = SHARDS, block: int = BLOCK, seed: int = 0,
) -> Mix:
    """Plan the mix of all rows.

    A null text has no words; a source without words gets nothing. A null source is a source of its
    own, the last. In its source's stream a document's place follows hashes of its id and text, so
    reruns agree; rows with equal id, text and source are interchangeable. A null id is like any
    other. An empty table gives an empty mix.
    """
    text = whole_text(text_col)
    rows = written(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words_in(text).alias("_size"),
        F.xxhash64(F.col(id_col)).alias("_h"), F.xxhash64(text).alias("_t"),
    ), "words")
    sizes = dict(collected(rows.groupBy("_source").agg(F.sum("_size")), MOST_SOURCES, "sources"))
    plan = plan_mix(sizes, shards, block, seed)
    spark = docs.sparkSession
    numbers = spark.createDataFrame(list(enumerate(plan.sources)), "_source_no int, _name string")
    part = F.pmod("_h", F.lit(PARTS)).cast("int")
    placed = rows.join(F.broadcast(numbers), F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_part", part)
    totals = placed.groupBy("_source_no", "_part").agg(F.sum("_size").alias("_words"))
    upto = Window.partitionBy("_source_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_source_no", "_part", F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source_no", "_part").orderBy("_h", "_id", "_t", "_size").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offsets, ["_source_no", "_part"])
    final = started.select("_id", "_source_no", "_size", "_t", (F.col("_offset") + F.col("_inside")).alias("_start"))
    return Mix(plan, final, slots(spark, plan, block, seed), block)


def pieces(made: Mix) -> DataFrame:
    """The parts of documents in blocks: ``_id, _t, _source_no, _size, _start, block, first, words``.

    ``first`` counts the document's words from 0. A document without words has no part.
    """
    b = made.block
    covered = F.sequence(F.floor(F.col("_start") / b), F.floor((F.col("_start") + F.col("_size") - 1) / b))
    cut = made.rows.where("_size > 0").withColumn("block", F.explode(covered))
    first = F.greatest(F.col("block") * b - F.col("_start"), F.lit(0))
    last = F.least((F.col("block") + 1) * b - F.col("_start"), F.col("_size"))
    return cut.withColumn("first", first).withColumn("words", last - first)


def taken_blocks(made: Mix) -> DataFrame:
    """How often each block is taken: ``_source_no, block, times``."""
    return made.slots.groupBy(F.col("source_no").alias("_source_no"), "block").agg(F.count("*").alias("times"))


def taken_words(made: Mix, id_col: str = "doc_id") -> DataFrame:
    """Per row: ``id_col, size, source_size, target, taken``."""
    # Listed slots look small to the planner, which does not see how long the lists are: no broadcast.
    shares = pieces(made).join(taken_blocks(made).hint("merge"), ["_source_no", "block"]).select(
        "_source_no", "_start", (F.col("words") * F.col("times")).alias("taken")
    )
    # A start in its source names a document that has words.
    sums = shares.groupBy("_source_no", "_start").agg(F.sum("taken").alias("taken")).withColumn("_some", F.lit(True))
    plan = made.plan
    sources = made.rows.sparkSession.createDataFrame(
        [(i, s, float(t)) for i, (s, t) in enumerate(zip(plan.sizes, plan.targets))],
        "_source_no int, source_size long, target double",
    )
    rows = made.rows.withColumn("_some", F.col("_size") > 0)
    return rows.join(sums, ["_source_no", "_start", "_some"], "left").join(F.broadcast(sources), "_source_no").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, made: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix as documents: the columns of ``docs``, texts cut to the words that the mix takes.

    A document appears once for each round in which the mix takes words of it; its text then holds
    those words in order, each with the white space after it, and is unchanged if all are taken.
    What no slot takes is left out, and so are documents without words. A column ``n_chars`` is
    brought up to date. Rows that repeat an id, text and source all bring their words, with the
    other columns of one of them.
    """
    rounds = made.slots.select(F.col("source_no").alias("_source_no"), "block", "round")
    parts = pieces(made).join(rounds.hint("merge"), ["_source_no", "block"]).groupBy("_source_no", "_start", "_id", "_t", "round").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("_parts"),
        (F.sum("words") == F.max("_size")).alias("_all"),
    )
    spark = docs.sparkSession
    numbers = spark.createDataFrame(list(enumerate(made.plan.sources)), "_source_no int, _name string")
    parts = parts.join(F.broadcast(numbers), "_source_no").select("_id", "_t", "_name", "_parts", "_all")
    text = whole_text(text_col)
    keys = [F.col(id_col).alias("_id2"), F.xxhash64(text).alias("_t2"), F.col(source_col).alias("_name2")]
    once = docs.select(F.struct("*").alias("_doc"), *keys).dropDuplicates(["_id2", "_t2", "_name2"])
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_t") == F.col("_t2")) & F.col("_name").eqNullSafe(F.col("_name2"))
    # A text is moved once, inside its row.
    joined = once.join(parts.hint("merge"), same).withColumn("_text", F.coalesce(F.col("_doc").getField(text_col), F.lit("")))
    tokens = F.regexp_extract_all("_text", F.lit(f"{WORD}(?:{SPACE})?"), F.lit(0))
    joined = joined.withColumn("_tokens", F.when(~F.col("_all"), tokens))
    taken = F.transform("_parts", lambda p: F.array_join(F.slice("_tokens", p["first"] + 1, p["words"]), ""))
    joined = joined.withColumn("_taken", F.when(F.col("_all"), F.col("_text")).otherwise(F.array_join(taken, "")))
    new = {text_col: F.col("_taken")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_taken").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
