"""Language identification: held-out accuracy and its stated rules."""

from __future__ import annotations

import zlib

from featlake.llm import language_id, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op10_language(spark, folder).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out]
    assert sum(right) / len(right) > 0.98
    sure = [r for r in got if r.held_out and r.score > 0.9]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in sure) / len(sure) > 0.99


def test_predictions_use_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.learn(docs, ~language_id.held_out())
    plain = {r.doc_id: r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), known).collect()}
    mixed = docs.selectExpr("-doc_id as doc_id", "text", "'zz' as lang", "'q' as source")
    assert {-r.doc_id: r.lang_pred for r in language_id.identify(mixed, known).collect()} == plain


def test_learning_leaves_held_out_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.learn(docs, ~language_id.held_out())
    learned = docs.where(~language_id.held_out())
    assert language_id.learn(learned.repartition(7), ~language_id.held_out()) == known
    assert [lang for lang, _ in known][0] == "en" and all(len(d) <= language_id.DICTIONARY_BYTES for _, d in known)


def test_hard_rows(hard):
    known = language_id.learn(hard, ~language_id.held_out())
    got = language_id.identify(hard, known)
    assert set(hard.columns) < set(got.columns)
    for r in got.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.margin, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("en", "de") and r.accepted == (r.margin >= language_id.MARGIN)


def test_a_long_text_counts_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.learn(docs, ~language_id.held_out())
    texts = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}'").limit(60).collect()) for lang in ("en", "de")}
    mixed = texts["en"][:40_000] + " " + texts["de"][:120_000]
    rows = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    assert language_id.identify(rows, known).first().lang_pred == "de"


def test_one_language_none_and_empty(spark, empty):
    one = spark.createDataFrame([(i, "some plain words", "en") for i in range(9)], "doc_id long, text string, lang string")
    got = language_id.identify(one, language_id.learn(one, ~language_id.held_out())).collect()
    assert {(r.lang_pred, r.margin) for r in got} == {("en", 1.0)}
    assert {r.lang_pred for r in language_id.identify(one, []).collect()} == {"und"}
    assert language_id.learn(empty, ~language_id.held_out()) == []
    assert language_id.identify(empty, []).count() == 0
