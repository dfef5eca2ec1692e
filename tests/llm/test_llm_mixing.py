"""Mixing against its stated rules."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlake.llm import mixing, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")


def test_targets():
    assert mixing.water_fill([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.water_fill([10, 10, 1000], [3, 1, 2]) == pytest.approx([20, 20, 1490])
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [3, 1]) == [0, 0]
    assert sum(mixing.water_fill([7, 900, 13, 44], [3, 1, 2, 3])) == pytest.approx(1.5 * 964)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 63, 64, 65, 1000])
def test_permutations(size):
    one = np.arange(size)
    for key in (0, 7):
        assert sorted(mixing.permuted(one, np.full(size, size), np.full(size, key))) == one.tolist()
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).sum() > 900 and (a != np.arange(1000)).sum() > 900


def test_draws_are_multinomial_and_meet_the_targets():
    plan = mixing.plan_mix({"a": 90_000, "b": 300_000, None: 50_000, "c": 10})
    assert plan.sources == ["a", "b", "c", None]
    sums, per_shard = plan.draws.sum(axis=0) * mixing.BLOCK, plan.draws.sum(axis=1)
    assert per_shard.max() - per_shard.min() <= 1
    assert all(abs(s - t) <= 2 * mixing.BLOCK for s, t in zip(sums, plan.targets))
    assert len(set(plan.draws[:, 1].tolist())) > 5


def check(docs, got):
    texts = docs.select("doc_id", "text", "source").collect()
    sizes = Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in texts)
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    by = defaultdict(int)
    for r in texts:
        by[r.source] += len(WORDS.findall(r.text or ""))
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    targets = mixing.water_fill([by[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert {(r.source_size, pytest.approx(r.target)) == (by[n], t) for r in got for n, t in zip(names, targets) if by[n] == r.source_size} >= {True}
    for n, t in zip(names, targets):
        taken = sum(r.taken for r in got if r.source_size == by[n])
        assert abs(taken - t) <= 2 * mixing.BLOCK, (n, taken, t)
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_hard_rows(hard):
    got = mixing.taken_words(mixing.mix(hard)).collect()
    check(hard, got)
    again = mixing.taken_words(mixing.mix(hard.repartition(5))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{folder}/documents.parquet"), queries.op8_mix(spark, folder).collect())


def test_slots_fill_the_shards_and_blocks_evenly(hard):
    made = mixing.mix(hard, shards=8)
    rows = made.slots.collect()
    assert len(rows) == made.plan.draws.sum()
    times = Counter((r.source_no, r.block) for r in rows)
    for s, size in enumerate(made.plan.sizes):
        counts = [times[s, b] for b in range(-(-size // made.block))]
        assert not counts or max(counts) - min(counts) <= 1
    assert len({(r.source_no, r.slot) for r in rows}) == len(rows)


def test_documents_of_the_mix_have_the_words_taken(hard):
    docs = hard.where("text is not null")
    made = mixing.mix(docs)
    out = mixing.mixed_documents(docs, made)
    assert out.columns == docs.columns
    got, whole = Counter(), {(r.doc_id, r.source): [] for r in docs.collect()}
    for r in docs.collect():
        whole[r.doc_id, r.source].append(WORDS.findall(r.text))
    for r in out.collect():
        words = WORDS.findall(r.text)
        assert words and r.n_chars == len(r.text)
        assert any(Counter(words) <= Counter(w) for w in whole[r.doc_id, r.source])
        got[r.doc_id] += len(words)
    taken = Counter()
    for r in mixing.taken_words(made).collect():
        taken[r.doc_id] += r.taken
    assert got == +taken


def test_a_long_text_keeps_its_order(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, text, "a"), (2, "x " * 9000, "b")], "doc_id long, text string, source string")
    made = mixing.mix(docs, shards=4)
    for r in mixing.mixed_documents(docs, made).where("doc_id = 1").collect():
        numbers = [int(w[1:]) for w in r.text.split()]
        assert numbers == sorted(numbers)


def test_blocks_are_never_broadcast(hard):
    made = mixing.mix(hard)
    for df in (mixing.taken_words(made), mixing.mixed_documents(hard, made)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and all("block" not in x.split("Inner")[0] for x in plan.split("BroadcastHashJoin")[1:])


def test_empty_tables(empty, spark):
    assert mixing.taken_words(mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(empty, mixing.mix(empty)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in mixing.taken_words(mixing.mix(none)).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
