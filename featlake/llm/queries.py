"""The registered queries of the corpus operators, over the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlake.llm import (
    bpe, exact_dedup, imatch, language_id, mixing, ngram_join, pii, ranked_search, records, sharding, simhash, suffix_tree, whitening,
)
from featlake.llm.common import read_documents
from featlake.session import tune

#: Files of the public tokenizers.
BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find_personal_data(read_documents(spark, folder).select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    names = [k.name for k in pii.KINDS]
    return found.select(
        "doc_id", *[count(names.index(k)).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.spelled(pii.base_spans(F.col("spans"))), 256).alias("base_sha256"),
        pii.spelled(F.col("spans")).alias("spans"),
    )


def op2_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every text by a suffix tree learned from four fifths of them."""
    return suffix_tree.score_texts(read_documents(spark, folder), ~suffix_tree.held_out())


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as ids of a byte-level vocabulary, and back."""
    return bpe.round_trip(read_documents(spark, folder), bpe.public_file(BYTE_VOCABULARY))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of texts that share three quarters of their runs of five words."""
    return ngram_join.near_duplicates(read_documents(spark, folder))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts, and the document of each that stays."""
    return exact_dedup.exact_duplicates(read_documents(spark, folder))


def op6_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written as records and read back."""
    return records.digest(records.written_and_read(read_documents(spark, folder), bpe.public_file(WORD_VOCABULARY), 1))


def op7_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text, and how they compare with an edited text's and the next one's."""
    return imatch.fingerprint_edits(read_documents(spark, folder))


def op8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.taken_words(mixing.mix(read_documents(spark, folder)))


def op9_shard(spark: SparkSession, folder: str) -> DataFrame:
    """Forty shards of about equal bytes."""
    return sharding.shard_by_bytes(read_documents(spark, folder), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every text, learned from two thirds of the labelled ones."""
    docs = read_documents(spark, folder)
    known = language_id.learn(docs, ~language_id.held_out())
    found = language_id.identify(docs.select("doc_id", "text"), known)
    return found.select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", language_id.score(F.col("margin")).alias("score")
    )


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = tune(spark).read.parquet(f"{folder}/benchmark.parquet")
    return ranked_search.search(read_documents(spark, folder), items)


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of texts whose fingerprints differ in four bits at most."""
    return simhash.near_duplicates(read_documents(spark, folder))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of all embeddings. A deviation beyond 64 bits is null, and whole in ``deviation_exact``."""
    found = whitening.whiten(tune(spark).read.parquet(f"{folder}/embeddings.parquet"))
    exact = F.col("deviation").alias("deviation_exact")
    deviation = F.expr("try_cast(deviation AS bigint)").alias("deviation")
    return found.select("vec_id", "component", "n", deviation, "whitened", "explained", "identity_error", exact)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii, op2_suffix_tree, op3_byte_bpe, op4_ngram_join, op5_exact_dedup, op6_token_records, op7_imatch, op8_mix, op9_shard,
        op10_language, op11_ranked_search, op12_simhash, op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        WITH norm AS (
          SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
          FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
          doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM norm WINDOW w AS (PARTITION BY t)
    """,
    "op4_ngram_join": """
        WITH RECURSIVE texts AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        sets AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
          FROM texts),
        one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (
          SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
          FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, w.b FROM reach r JOIN ways w ON r.y = w.a)
        SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(r.y) AS component_id
        FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id
    """,
    "op11_ranked_search": """
        WITH docs AS (
          SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
          FROM documents),
        items AS (
          SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
          FROM benchmark),
        whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
        tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY r, t),
        dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
        sums AS (
          SELECT item_id, d.doc_id, d.r, sum(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
            * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(w) * n_docs) // l)))))::BIGINT AS score
          FROM items JOIN dfs USING (t) JOIN tfs USING (t) JOIN docs d ON d.r = tfs.r CROSS JOIN whole
          GROUP BY item_id, d.doc_id, d.r),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
          FROM sums WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
