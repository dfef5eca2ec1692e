"""From raw documents to token ids: identify languages, remove copies, mix sources, encode.

Each stage takes all documents that the one before kept and returns the columns of documents, the
last one tokens. Between stages, documents are stored as Parquet in the shared scratch folder, so a
lost executor costs no more than a stage's own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.llm import bpe, exact_dedup, language_id, mixing, ngram_join, queries
from featlake.llm.common import read_documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language is not told apart, or that have no letter; fill in missing languages.

    Two thirds of the labelled documents are learned from. Null and empty texts go.
    """
    known = language_id.learn(docs, ~language_id.held_out())
    found = language_id.identify(docs, known).where("accepted")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text, the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id."""
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources by their target weights; a document appears once for each round that takes words of it."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: ``doc_id, n_tokens, ids_sha256, decoded_sha256, ids``."""
    return bpe.round_trip(docs, bpe.public_file(queries.BYTE_VOCABULARY), with_ids=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: Compression, random draws and tokenizers are beyond SQL; a test checks each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
