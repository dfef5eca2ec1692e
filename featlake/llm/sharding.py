"""Contiguous shards of about equal bytes, cut from global prefix sums.

The global order is that of a text's hash: equal texts are neighbours, and cutting the hash range
into equal steps gives partitions of about equal size without sampling. A text with more rows than
a partition should hold is spread over further partitions by its id's hash. Each partition is
summed; the few sums become offsets; inside its partition every row adds its own running sum. A
row's global byte position, divided by the target, is its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import whole_text, written

#: Equal steps of the hash range; a power of two. A partition of 100 TB then holds some million rows.
PARTITIONS = 4096
OVERHEAD = 16


def _step(hash_: Column, partitions: int) -> Column:
    """The number of the step of the signed 64-bit range that a hash lies in."""
    bits = partitions.bit_length() - 1
    return F.shiftright(hash_, 64 - bits) + F.lit(partitions // 2)


def placed(docs: DataFrame, id_col: str, text_col: str, partitions: int = PARTITIONS) -> DataFrame:
    """Rows reduced to what sharding needs, with the key (``_step, _hot, _part``) of their partition.

    A text with more rows than half a partition's share (16 at least) is hot: there are at most
    twice as many of them as partitions, so the list has a proven bound. ``_hot`` is its hash, and
    its rows have parts by their id, in proportion to their number.
    """
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
        F.xxhash64(id_col).alias("_id_hash"),
    )
    rows = written(rows, "sizes")
    counts = rows.groupBy("_hash").agg(F.count("*").alias("_rows"))
    share = F.greatest(F.lit(16.0), rows.agg(F.count("*").alias("n")).scalar() / F.lit(2.0 * partitions))
    hot = counts.where(F.col("_rows") > share).select("_hash", F.ceil(F.col("_rows") / share).alias("_parts"))
    keyed = rows.join(F.broadcast(hot), "_hash", "left")
    return keyed.select(
        "_id", "size", "text_crc32", "_hash", "_id_hash", _step(F.col("_hash"), partitions).alias("_step"),
        F.when(F.col("_parts").isNotNull(), F.col("_hash")).alias("_hot"),
        F.when(F.col("_parts").isNotNull(), F.pmod("_id_hash", "_parts")).otherwise(F.lit(0)).alias("_part"),
    )


def shard_by_bytes(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", partitions: int = PARTITIONS
) -> DataFrame:
    """Per row: ``id_col, size, text_crc32, shard, slot``.

    ``size`` is the text's bytes in UTF-8 plus 16 (null and empty texts: 16). Shards are cut at
    equal byte targets: a unit goes where its middle lies, so a shard misses its target by less
    than one unit. A unit is a row, or a group of equal texts that is not longer than a fiftieth
    of the target or than the longest row; such groups are not cut. ``slot`` counts the rows of a
    shard from 0. Rows with equal id and text are interchangeable; a null id is hashed as such. An
    empty table gives an empty result, and fewer units than shards leave some shards empty.
    """
    rows = placed(docs, id_col, text_col, partitions)
    key = ["_step", "_hot", "_part"]
    totals = rows.groupBy(*key).agg(
        F.sum("size").alias("_bytes"), F.count("*").alias("_rows"), F.max("size").alias("_longest")
    )
    # One row per partition: 4096 and the parts of hot texts (2 * 4096 texts, 4 * 4096 parts at most).
    before = Window.orderBy(F.col("_step"), F.col("_hot").asc_nulls_first(), F.col("_part")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    all_rows = Window.partitionBy()
    offsets = totals.select(
        F.col("_step").alias("_s"), F.col("_hot").alias("_h"), F.col("_part").alias("_p"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_offset"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
        F.sum("_bytes").over(all_rows).alias("_total"), F.max("_longest").over(all_rows).alias("_longest"),
    )
    same = (F.col("_step") == F.col("_s")) & F.col("_hot").eqNullSafe(F.col("_h")) & (F.col("_part") == F.col("_p"))
    inside = Window.partitionBy(*key).orderBy("_hash", "_id_hash", "_id", "size")
    until = inside.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*key, "_hash")
    running = rows.select(
        "*", F.coalesce(F.sum("size").over(until), F.lit(0)).alias("_start"),
        F.row_number().over(inside).alias("_nth"),
    ).select("*", F.sum("size").over(group).alias("_unit"), F.min("_start").over(group).alias("_unit_start"))
    target = F.col("_total") / F.lit(shards)
    whole = F.col("_hot").isNull() & (F.col("_unit") <= F.greatest(F.col("_longest"), target / 50))
    middle = F.col("_byte_offset") + F.when(whole, F.col("_unit_start") + F.col("_unit") / 2).otherwise(
        F.col("_start") + F.col("size") / 2
    )
    cut = running.join(F.broadcast(offsets), same).select(
        "_id", "size", "text_crc32", F.least(F.floor(middle / target), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("_row_offset") + F.col("_nth") - 1).alias("_row"),
    )
    # Shards are contiguous, so a shard's rows follow its first.
    first = cut.groupBy("shard").agg(F.min("_row").alias("_first"))
    return cut.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
