"""Byte shards against their stated rules."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from featlake.llm import sharding


def check(docs, got, shards):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in rows)
    by, groups = defaultdict(list), defaultdict(set)
    for r in got:
        by[r.shard].append(r)
        groups[r.size, r.text_crc32].add(r.shard)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    bound = 2 * max(longest, total / shards / 50)
    assert all(0 <= s < shards for s in by)
    for s in range(shards):
        assert abs(sum(r.size for r in by[s]) - total / shards) <= bound
    return groups


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_hard_rows(hard, shards):
    groups = check(hard, sharding.shard_by_bytes(hard, shards).collect(), shards)
    assert all(len(s) == 1 for s in groups.values())


def test_a_hot_text_is_cut_by_rows(spark):
    texts = ["copy of a hot text"] * 3000 + [f"text {i} " * (i % 7) for i in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 10, partitions=64).collect()
    groups = check(docs, got, 10)
    assert sum(len(s) > 1 for s in groups.values()) <= 2
    placed = sharding.placed(docs, "doc_id", "text", 64).groupBy("_step", "_hot", "_part").count().collect()
    assert max(r["count"] for r in placed) < 400
    assert sorted(got) == sorted(sharding.shard_by_bytes(docs.repartition(5), 10, partitions=64).collect())


def test_empty_table_and_plan(empty):
    df = sharding.shard_by_bytes(empty, 40)
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
