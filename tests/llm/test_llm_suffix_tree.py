"""The suffix tree against a plain one, and its base scores against plain counts."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featlake.llm import queries, suffix_tree
from featlake.llm.common import LOWER, UPPER, whole_text

WORDS = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(UPPER, LOWER)


def words_of(text):
    return WORDS.findall((text or "").translate(FOLD))


def plain_tree(texts):
    """Contexts to counts of next symbols, by the rules of the module."""
    streams = [" ".join(words_of(t)).encode() + b"\n" for t in texts]
    counts = {}
    for s in streams:
        padded = b"\n" * suffix_tree.DEPTH + s
        for i in range(len(s)):
            at = i + suffix_tree.DEPTH
            for k in range(suffix_tree.DEPTH + 1):
                counts.setdefault(padded[at - k : at], Counter())[padded[at]] += 1
    size = sum(counts[b""].values()) if counts else 0
    keep = {b""}
    for ctx, nexts in counts.items():
        total, parent = sum(nexts.values()), counts[ctx[1:]]
        whole = sum(parent.values())
        gain = sum(n * math.log(n * whole / (total * parent[x])) for x, n in nexts.items())
        if ctx and total >= suffix_tree.RAREST * size and gain >= suffix_tree.DIVERGENCE:
            keep |= {ctx[j:] for j in range(len(ctx))}
    return {c: counts[c] for c in keep if c in counts}


def plain_score(tree, text):
    s = " ".join(words_of(text)).encode() + b"\n"
    padded, out = b"\n" * suffix_tree.DEPTH + s, 0.0
    for i in range(len(s)):
        at, p = i + suffix_tree.DEPTH, 1 / suffix_tree.SYMBOLS
        for k in range(suffix_tree.DEPTH + 1):
            nexts = tree.get(padded[at - k : at])
            if nexts is None:
                break
            p = (nexts[padded[at]] + len(nexts) * p) / (sum(nexts.values()) + len(nexts))
        out += math.log10(p)
    return out


def check(rows, got, is_train):
    train = [t for i, t in rows if is_train(i)]
    counts = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    tree = plain_tree(train)
    expected = []
    for i, t in rows:
        tokens = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        expected.append((i, not is_train(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, plain_score(tree, t)))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert len(got) == len(expected)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(expected, key=order)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def train_id(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1


def test_hard_rows(hard):
    short = hard.where(F.length(whole_text()) < 40_000)
    got = suffix_tree.score_texts(short, ~suffix_tree.held_out()).collect()
    check([(r.doc_id, r.text) for r in short.collect()], got, train_id)


def test_rare_words_are_joined(hard, monkeypatch):
    # With a high bar for frequent words, most counts come by the join.
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.01)
    monkeypatch.setattr(suffix_tree, "RAREST", 0.001)
    short = hard.where(F.length(whole_text()) < 5_000)
    got = suffix_tree.score_texts(short, ~suffix_tree.held_out()).collect()
    check([(r.doc_id, r.text) for r in short.collect()], got, train_id)


def test_held_out_texts_score_better_than_by_words(spark):
    got = queries.op2_suffix_tree(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(rows, queries.op2_suffix_tree(spark, folder).collect(), train_id)


def test_empty_tables(empty, hard):
    assert suffix_tree.score_texts(empty, ~suffix_tree.held_out()).count() == 0
    untrained = suffix_tree.score_texts(hard.where("doc_id < 5"), F.lit(False)).collect()
    assert {(r.base_score, r.n_known, r.train_tokens) for r in untrained} == {(0.0, 0, 0)}


def test_rare_and_long_contexts_are_retained(spark, monkeypatch):
    # The passage occurs once in over a million symbols; the digits follow from the sixth symbol before them.
    monkeypatch.setattr(suffix_tree, "TAKEN", 50)
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.01)
    passage, pairs = "xaбвгдеq", "paaaaa1 qaaaaa2 " * 20
    texts = [passage, pairs] + ["the quick brown fox jumps over the dog " * 4000] * 8
    train = list(zip([i for i in range(200) if train_id(i)], texts))
    held = list(zip([i for i in range(200) if not train_id(i)], [passage, pairs, "юю zz"]))
    docs = spark.createDataFrame(train + held, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(docs, ~suffix_tree.held_out()).collect()}
    tree = plain_tree(texts)
    size = sum(tree[b""].values())
    assert any(sum(n.values()) < 1e-6 * size for n in tree.values()) and b"paaaaa" in tree
    for i, text in held:
        assert got[i] == pytest.approx(plain_score(tree, text), rel=1e-9)


def test_blocks_of_grams_are_compact(spark, monkeypatch):
    # Lists of numbers and rows of scores took 95 MB for these texts of 25 MB, blocks 52 MB.
    made, real = {}, suffix_tree.written

    def written(df, purpose, *by):
        made[purpose] = real(df, purpose, *by)
        return made[purpose]

    monkeypatch.setattr(suffix_tree, "written", written)
    queries.op2_suffix_tree(spark, "/root/testdata/sf0.1")
    files = [f for name in ("suffix-tree", "scored") for f in made[name].inputFiles()]
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 65e6


def test_packed_columns_are_read_back():
    for codes in ([7], [0, 1, 2**63, 2**64 - 1]):
        columns = np.array([codes, [2**33 + 5 - i for i in range(len(codes))]], np.uint64)
        assert (suffix_tree.unpacked(suffix_tree.packed(*columns), 2) == columns).all()


def test_scores_of_grams_are_not_stored(spark, monkeypatch):
    # Tables for these texts took 18 MB when the tree's had the scores of frequent grams beside the counts, now 3 MB.
    made, real = {}, suffix_tree.written

    def written(df, purpose, *by):
        made[purpose] = real(df, purpose, *by)
        return made[purpose]

    monkeypatch.setattr(suffix_tree, "written", written)
    queries.op2_suffix_tree(spark, "/root/testdata/sf0.01")
    assert sum(os.path.getsize(f.removeprefix("file://")) for df in made.values() for f in df.inputFiles()) < 6e6


@pytest.mark.parametrize("most", [0, 100])
def test_what_is_not_broadcast_is_scored_in_its_bucket(spark, monkeypatch, most):
    # Few keys are broadcast, counters are passed on and pairs are scored in many parts.
    for name, value in {"MOST_GRAMS": most, "MOST_WORDS": most // 10, "HELD": 500, "GATHERED": 100, "TAKEN": 3000}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.length("text") < 3000)
    got = suffix_tree.score_texts(docs, ~suffix_tree.held_out()).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got, train_id)


def test_logs_are_found_by_key():
    keys = np.array([0, 1, 2, 2**63, 2**64 - 1, *range(1000, 3000)], np.uint64)
    logs = suffix_tree.Logs([(suffix_tree.packed(k), (-k.astype(float)).tobytes()) for k in (np.sort(keys[::2]), np.sort(keys[1::2]))])
    asked = np.concatenate([keys, np.arange(5000, 9000, dtype=np.uint64)])
    log, found = logs(asked)
    assert found.sum() == len(keys) and found[: len(keys)].all() and (log[: len(keys)] == -keys.astype(float)).all()
    assert not suffix_tree.Logs([])(asked)[1].any()


def test_symbols_of_crooked_spacing():
    words = suffix_tree.Words(pa.array(["  A\tb \n", "", " ", "c", "\n\nd  e"]))
    stream, first = suffix_tree.symbol_stream(words)
    ends = b"\n" * suffix_tree.DEPTH
    assert bytes(stream) == b"".join(ends + t for t in (b"a b\n", b"\n", b"\n", b"c\n", b"d e\n"))
    codes, own = suffix_tree.grams(stream, first)
    assert own.tolist() == [4, 1, 1, 2, 4] and codes[3] == int.from_bytes(b"\n" * 4 + b"a b\n")
