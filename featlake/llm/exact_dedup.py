"""Exact deduplication by content-defined chunk recipes.

A text is cut into chunks where its content says so: at the first sentence or line end after
``LEAST`` characters, or after ``MOST`` characters if there is none. A chunk is named by a 64-bit
hash, and a dictionary of the distinct chunks verifies the names: a hash that belongs to several
contents is no identifier, and the content itself stands for it. Two texts are equal exactly when
their ordered lists of identifiers, the recipes, are equal. So a long text moves once, in distinct
chunks, and documents are then grouped by their short recipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import ascii_lower, bounded_broadcast, whole_text, written

LEAST, MOST = 512, 4096
_CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?[.!?\n]|.{{1,{MOST}}}"


def chunks_of(text: Column, pattern: str = _CHUNK) -> Column:
    """The chunks of a text in order; together they are the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ambiguous_names(texts: DataFrame, chunks: str, name=F.xxhash64) -> Column:
    """The hashes that several distinct chunks share, as one array.

    Chunks are reduced to distinct ones before and after their shuffle, so copies move once. The
    array holds only accidents of a 64-bit hash: about n * n / 2**65 for n distinct chunks, which
    is 300 at 10**11 chunks (100 TB).
    """
    distinct = texts.select(F.explode(chunks).alias("chunk")).select(name("chunk").alias("id"), "chunk").distinct()
    shared = distinct.groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1")
    return shared.agg(F.collect_list("id").alias("ids")).scalar()


def with_recipe(docs: DataFrame, text_col: str = "text", name=F.xxhash64) -> DataFrame:
    """Add ``_norm`` (lower-cased A to Z, null as empty) and ``_recipe``, equal for equal ``_norm`` only."""
    # The dictionary holds the normalised text's chunks, those that the recipes refer to.
    cut = docs.withColumn("_norm", ascii_lower(whole_text(text_col))).withColumn("_chunks", chunks_of(F.col("_norm")))
    shared = ambiguous_names(cut.select("_chunks"), "_chunks", name)
    named = cut.withColumn("_shared", shared).withColumn("_ids", F.transform("_chunks", lambda c: name(c)))
    spelled = F.filter("_chunks", lambda c: F.array_contains(F.col("_shared"), name(c)))
    contents = F.when(F.size("_shared") > 0, spelled).otherwise(F.array().cast("array<string>"))
    return named.withColumn("_recipe", F.struct(F.col("_ids").alias("ids"), contents.alias("contents"))).drop(
        "_chunks", "_shared", "_ids"
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name=F.xxhash64) -> DataFrame:
    """Per row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A to Z; null counts as empty, and all empty
    texts are one group. The largest id of a group stays. A null id stays only in a group without
    ids, where ``keep_id`` is null. Rows that repeat an id and a text count as members, and all of
    them are marked as kept if that id stays; ``drop_exact_duplicates`` then returns one of them.
    An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = with_recipe(texts, "_text", name).select("_id", "_recipe", F.sha2("_norm", 256).alias("text_sha256"))
    rows = written(rows, "recipes")  # short; else every text would be cut again for the join below
    groups = rows.groupBy("_recipe").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Joined by a hash beside the recipe, so both sides are shuffled for the join and a group with
    # a third of all rows can be split; as plain keys the aggregate's partitions would be reused.
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", F.xxhash64("_recipe"))

    joined = keyed(rows).join(keyed(groups), ["_key", "_recipe"])
    return joined.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns."""
    keep = exact_duplicates(docs, id_col, text_col).where("kept").groupBy(
        F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_sha")
    ).agg(F.count("*").alias("_times"))
    # While the names of what stays are few enough, no text is shuffled.
    keep = bounded_broadcast(written(keep, "kept"), 500_000)
    sha = F.sha2(ascii_lower(whole_text(text_col)), 256)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), sha.alias("_text_sha"))
    stays = rows.join(keep, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text_sha") == F.col("_sha")))
    again = stays.where("_times > 1").dropDuplicates(["_keep", "_sha"])
    return stays.where("_times = 1").unionByName(again).select("_doc.*")
