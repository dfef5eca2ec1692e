"""The similarity join against comparing all pairs of sets."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featlake.llm import ngram_join
from featlake.llm.common import LOWER, UPPER
from featlake.llm.components import connected
from featlake.llm.words import Words

WORDS = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans(UPPER, LOWER)


def shingles(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        known = [v for v in (i, least.get(find(a))) if v is not None]
        least[find(a)] = min(known, default=None)
    return Counter((i, len(s), least[find(a)] if s else i) for a, (i, s) in enumerate(sets))


def check(docs, percent=75):
    got = ngram_join.near_duplicates(docs, percent=percent)
    assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in docs.collect()], percent)


def corpus(spark, groups, seed=1):
    """Groups of texts that are a template with some words changed, and a passage that many share."""
    rng, texts = random.Random(seed), []
    passage = " ".join(f"common{i}" for i in range(60))
    for g, (copies, words, changes) in enumerate(groups):
        base = [f"g{g}w{rng.randrange(words * 3)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(changes + 1)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(own) + (" " + passage if rng.random() < 0.4 else ""))
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


GROUPS = [(60, 100, 8), (1, 100, 0), (30, 40, 4), (2, 300, 10), (40, 12, 1), (20, 5, 1)] + [(1, 30 + i, 0) for i in range(30)]


def test_hard_rows(hard):
    check(hard)


def test_groups_of_copies(spark):
    check(corpus(spark, GROUPS))


def test_large_blocks_in_parts_and_deep_trees(spark, monkeypatch):
    # Few cells and small parts make every path run: parts of blocks, pairs of parts, and trees of many levels.
    for name, value in (("PART", 8), ("LEAF", 2), ("FAN", 2), ("CELLS", 64)):
        monkeypatch.setattr(ngram_join, name, value)
    check(corpus(spark, GROUPS, seed=2))
    check(corpus(spark, GROUPS, seed=3), percent=60)


def test_pairs_to_verify_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    # Two of three members differ from one another by more than the threshold, and so do firsts of blocks from most.
    rng, texts = random.Random(4), []
    base = [f"w{i}" for i in range(200)]
    for k in range(360):
        own = list(base)
        for at in rng.sample(range(0, 200, 10), (2, 4, 4)[k % 3]):
            own[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    counts, verified = [], ngram_join.verified

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(ngram_join, "verified", counted)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sum(counts) < 20 * len(texts)


def test_given_rows(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_borders_of_the_threshold(spark):
    # 100 * 6 = 75 * 8 is a link, 100 * 5 < 75 * 7 is none.
    a = " ".join(f"w{i}" for i in range(11))  # seven shingles
    linked, apart = a + " y", " ".join(f"v{i}" for i in range(10))
    docs = spark.createDataFrame(
        [(1, a), (2, " ".join(f"w{i}" for i in range(10)) + " z"), (3, apart), (4, " ".join(f"v{i}" for i in range(9)) + " q"), (5, linked)],
        "doc_id long, text string",
    )
    check(docs)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got[2] == got[5] == 1 and got[4] == 4


def test_tree_pairs_are_all_that_the_bounds_allow(monkeypatch):
    for name, value in (("LEAF", 4), ("FAN", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(5)
    sets = [rng.choice(2**40, rng.integers(5, 60), replace=False).astype(np.uint64) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) - 1], rng.integers(0, 2**40, 1).astype(np.uint64)])) for s in sets]
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    bits = ngram_join.signatures(np.concatenate(sets), n)
    comp = rng.integers(0, 5, len(sets))
    order = np.lexsort((n, comp))
    tree = ngram_join.Tree.leaves(n[order], comp[order], bits[order]).grown()
    found = {tuple(sorted((order[x], order[y]))) for a, b in tree.pairs(75) for x, y in zip(a, b)}
    for x in range(len(sets)):
        for y in range(x):
            common = len(np.intersect1d(sets[x], sets[y]))
            if comp[x] != comp[y] and 100 * common >= 75 * (n[x] + n[y] - common):
                assert (y, x) in found
    assert len(found) < 400


def test_wide_signatures_bound_the_common_part():
    rng = np.random.default_rng(7)
    for n, m, common in ((900, 1000, 700), (5000, 4000, 30), (700, 9000, 650), (3000, 3000, 3000)):
        a = rng.choice(2**60, n + m, replace=False).astype(np.uint64)
        x, y = a[:n], np.concatenate([a[:common], a[n : n + m - common]])
        bound = ngram_join.wide_overlap(ngram_join.wide_signature(x), ngram_join.wide_signature(y), n, m)
        assert common <= bound <= common + 0.45 * min(n, m)
    assert ngram_join.wide_signature(a[:5]) == b""


def test_long_sets(spark):
    words = [f"w{i}" for i in range(3000)]
    changed = [w if i % 70 else f"x{i}" for i, w in enumerate(words)]
    other = [w if i % 9 else f"y{i}" for i, w in enumerate(words)]
    texts = [words, changed, other, words[:2500], words[:1500], [f"z{i}" for i in range(2900)] + words[:100]]
    check(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(300, 301), (301, 300), (7, 7)]
    got = connected(spark.createDataFrame(chain, "a long, b long")).collect()
    expected = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert {r.node: r.label for r in got} == expected
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words():
    texts = ["", "A b\tC", " x ", "é\x0bÉ", "  ", "a,b c."]
    words = Words(pa.array(texts))
    spelled = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert spelled == ["a", "b", "c", "x", "é", "É", "a,b", "c."] and words.count.tolist() == [0, 3, 1, 2, 0, 2]
    h = Words(pa.array(["same other same", "same"])).hashes()
    assert h[0] == h[2] == h[3] != h[1]


def test_dropping_keeps_the_smallest_of_each_component(spark):
    docs = corpus(spark, GROUPS).withColumn("extra", F.col("doc_id") * 2)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = {c for _, _, c in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(expected)


def test_dropping_rows_without_ids(spark):
    """One row of each component stays, whatever its ids: none, repeated, or one with several texts."""
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(words[::-1])
    rows = [(None, near), (None, near + " more"), (None, other), (None, None), (None, " "), (5, "five words are in this"), (5, "five words are in this")]
    third = " ".join(f"v{i}" for i in range(40))
    rows += [(6, third), (6, third + " now"), (None, third), (8, third), (7, ""), (7, "")]
    kept = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((r.doc_id, r.text) for r in kept)
    assert sum(texts[None, t] for t in (near, near + " more")) == 1 and texts[None, other] == 1
    assert texts[5, "five words are in this"] == 1 and texts[None, None] == texts[None, " "] == 1 and texts[7, ""] == 2
    assert [i for (i, t), n in texts.items() for _ in range(n) if t and t.startswith("v0")] == [6]


def test_empty_table(empty, spark):
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.drop_near_duplicates(empty).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(none).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("sizes", [(8, 8), (400, 300), (1, 1)])
def test_prefixes_meet(sizes):
    a, b = sizes
    need = ngram_join.least_overlap(a, b, 75)
    assert need <= min(a, b) or a * 4 < b * 3 or b * 4 < a * 3
    assert ngram_join.prefix_lengths(np.array([a]), 75)[0] >= a - need + 1 or need > min(a, b)
