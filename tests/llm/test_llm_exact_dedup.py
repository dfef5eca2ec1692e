"""Exact deduplication against grouping by the normalised text."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from featlake.llm import exact_dedup
from featlake.llm.common import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(doc_id)
    out = Counter()
    for norm, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out.update((i, keep, len(ids), i == keep, sha) for i in ids)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_hard_rows(hard):
    assert Counter(map(tuple, exact_dedup.exact_duplicates(hard).collect())) == brute(pairs(hard))


def test_ambiguous_names_are_told_apart_by_content(hard):
    # Every chunk of a length gets the same name, so only the dictionary keeps texts apart.
    got = exact_dedup.exact_duplicates(hard, name=lambda c: F.length(c).cast("long"))
    assert Counter(map(tuple, got.collect())) == brute(pairs(hard))


def test_recipes_of_long_texts_differ_in_the_changed_chunk_only(spark):
    sentence = "".join(f"Sentence number {i} of a long text. " for i in range(400))
    df = spark.createDataFrame([(1, sentence), (2, sentence.replace("number 200 of", "number two hundred of"))], "doc_id long, text string")
    a, b = [r._recipe.ids for r in exact_dedup.with_recipe(df).orderBy("doc_id").collect()]
    assert len(a) > 10 and len(set(a) ^ set(b)) <= 6


def test_chunks_are_the_text(hard):
    cut = hard.select("text", exact_dedup.chunks_of(F.coalesce("text", F.lit(""))).alias("c")).collect()
    assert all("".join(r.c) == (r.text or "") and all(len(c) <= exact_dedup.MOST for c in r.c) for r in cut)


def test_dropping_keeps_one_row_of_each_text_with_its_columns(hard):
    kept = exact_dedup.drop_exact_duplicates(hard)
    assert kept.columns == hard.columns
    expected = {(k[0], k[4]) for k in brute(pairs(hard)) if k[3]}
    got = [(i, hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()) for i, t in pairs(kept)]
    assert len(got) == len(set(got)) and set(got) == expected


def test_empty_table_and_plan(empty):
    df = exact_dedup.exact_duplicates(empty)
    assert df.count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
