"""SimHash fingerprints and components against plain Python and all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from featlake.llm import queries, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=4):
    """Rows of (id, fingerprint, component) of all (id, text)."""
    prints = [brute_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    comp = {p: p for p in distinct}

    def top(p):
        while comp[p] != p:
            p = comp[p]
        return p

    for k, p in enumerate(distinct):
        for q in distinct[k + 1 :]:
            if (p ^ q).bit_count() <= most:
                comp[top(q)] = top(p)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return sorted(((i, f"{p:016x}", least.get(top(p))) for (i, _), p in zip(rows, prints)), key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hard_rows(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert plain(simhash.near_duplicates(hard)) == brute(rows)


def test_long_texts_in_lots(monkeypatch):
    monkeypatch.setattr(simhash, "LOT", 7)
    for text in ("a b c", "Aa bB\t c\n d  e f\x0bg " * 20, " x" * 99, "one " * 3 + "y" * 50):
        assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    for x, y in ((a, b), (a, a[::-1])):
        counts = [[[bin(int(v) >> s & 3).count("1") for s in range(0, 64, 2)] for v in w] for w in (x, y)]
        manhattan = np.abs(np.array(counts[0]) - np.array(counts[1])).sum(axis=1)
        found = np.bitwise_count(simhash.embedded(x) ^ simhash.embedded(y))
        assert (found == manhattan).all() and (manhattan <= np.bitwise_count(x ^ y)).all()


@pytest.mark.parametrize("groups", [6, 7, 8])
def test_every_link_shares_a_cell(groups):
    chosen = simhash.masks(groups, 4)
    rng = np.random.default_rng(groups)
    for _ in range(300):
        p = int(rng.integers(0, 2**64, dtype=np.uint64))
        q = p
        for bit in rng.choice(64, 4, replace=False).tolist():
            q ^= 1 << bit
        e, f = simhash.embedded(np.array([p, q], np.uint64))
        assert ((e ^ f) & chosen == 0).any()


@pytest.mark.parametrize("part", [8, 4096])
def test_dense_groups(spark, monkeypatch, part):
    """Chains, crowded balls and strays, in whole cells and in parts of cells."""
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "LOOKED_AT", 1)
    rng = np.random.default_rng(5)
    prints = set(rng.integers(0, 2**64, 300, dtype=np.uint64).tolist()) | {0, 2**64 - 1}
    for size, flips in ((250, 6), (100, 2)):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(size):
            p = centre
            for bit in rng.choice(64, flips, replace=False).tolist():
                p ^= 1 << bit
            prints.add(p)
    chain = int(rng.integers(0, 2**64, dtype=np.uint64))
    for k in range(15):
        prints.add(chain := chain ^ (0b1111 << 4 * k))
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(4)
    links = np.array([tuple(r) for r in simhash.close_links(df).collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 4).all()
    place = {int(p): k for k, p in enumerate(prints)}

    def components(pairs):
        label = np.arange(len(prints))
        for _ in range(len(prints)):
            before = label.copy()
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if (before == label).all():
                return label

    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    found = [(place[int(a)], place[int(b)]) for a, b in links]
    assert (components(near) == components(found)).all()
    assert len(near) > 3 * len(prints)


def test_a_cell_returns_fewer_links_than_rows():
    prints = np.arange(64, dtype=np.uint64)
    n = len(prints)
    a, b = simhash.forest(prints, np.full(n, n), np.zeros(n, bool), np.zeros(n, bool), 4)
    assert len(a) == n - 1
    a, b = simhash.forest(prints, np.full(n, n), np.ones(n, bool), prints % 2 == 1, 4)
    assert len(a) == n - 1 and ((prints[a] ^ prints[b]) & np.uint64(1) == 1).all()


def test_more_groups_for_more_prints():
    sizes = [simhash.groups_for(n, 4) for n in (0, 10**5, 10**7, 10**9, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 6 and sizes[-1] > 7


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "A b c d e"), (5, "p q r s t"), (5, "u v w"), (3, "P q r s t")], "doc_id long, text string")
    assert plain(simhash.near_duplicates(docs)) == brute([tuple(r) for r in docs.collect()])


def test_empty_table(empty):
    got = simhash.near_duplicates(empty)
    assert got.count() == 0 and got.columns == ["doc_id", "fingerprint", "component_id"]


def test_query_on_given_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op12_simhash(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert plain(got) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    same = docs.join(got, "doc_id").groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("component_id").alias("n"))
    assert same.where("n > 1").count() == 0
