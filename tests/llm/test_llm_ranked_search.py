"""Ranked search against a plain reckoning of all scores."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from featlake.llm import queries, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """Rows of (item, rank, doc, score) from all documents (id, text) and items (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, c in counts:
            m = 100 - 90 + 90 * c.total() * n_docs // max(total, 1)
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hard_rows(spark, hard):
    items = [(1, "the QUICK brown fox É é"), (1, "word tie"), (None, "Hund über"), (2, None), (3, " ,. "), (4, "nowhere-to-be-found"), (5, "x " * 9 + "1")]
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    assert plain(ranked_search.search(hard, rows)) == brute(docs, items)


@pytest.mark.parametrize("size", [(3, 2), (7, 1), (8192, 128)])
def test_slices_and_blocks(spark, monkeypatch, size):
    """Several slices, blocks of items, ties by the hundred; terms of all owners."""
    monkeypatch.setattr(ranked_search, "DOCS", size[0])
    monkeypatch.setattr(ranked_search, "ITEMS", size[1])
    rng = np.random.default_rng(7)
    draw = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) if x < 500)
    docs = [(int(i * 37 % 300), draw(int(rng.integers(0, 60)))) for i in range(280)] + [(1000 + i, "all alike in w1 w2 w40") for i in range(60)]
    items = [(i, draw(25) + " alike" * (i % 2)) for i in range(7)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ranked_search.search(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert plain(got) == brute(docs, items)


def test_few_marked_cells(spark, monkeypatch):
    """Terms that only share a cell with an item's term are dropped again."""
    monkeypatch.setattr(ranked_search, "CELLS", 2)
    docs, items = [(i, f"a{i} b{i % 3} c") for i in range(20)], [(0, "b1 c a7 zzz")]
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert plain(got) == brute(docs, items)


def test_text_ids_and_other_names(spark):
    docs = spark.createDataFrame([("b", "fox"), ("a", "fox"), (None, "fox"), ("é", "fox dog"), ("z", "cat")], "name string, body string")
    items = spark.createDataFrame([("q", "FOX")], "q string, words string")
    got = ranked_search.search(docs, items, 3, "name", "body", "q", "words")
    assert got.columns == ["q", "rank", "name", "score"]
    assert [r.name for r in got.orderBy("rank").collect()] == ["a", "b", None]


def test_terms_in_lots(monkeypatch):
    text = "Aé,b " * 50 + "x" * 40 + "1y.z"
    whole = [t.encode() for t in terms(text)]
    monkeypatch.setattr(ranked_search, "LOT", 3)
    assert [t for lot in ranked_search.term_lots(text.encode()) for t in lot] == whole


def test_empty_tables(spark, hard, empty):
    items = spark.createDataFrame([(1, "quick")], "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(hard, items.limit(0)).count() == 0
    assert ranked_search.search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_nothing_needed_is_dropped():
    """Whatever is still to come, the documents that end among the best are kept."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        now, later = rng.integers(0, 100, 40), rng.integers(0, 30, 40)
        best = np.argsort(-(now + later), kind="stable")[:10]
        assert ranked_search.needed(now, 30, 10)[best].all()


def test_query_on_given_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op11_ranked_search(spark, folder)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert plain(got) == brute(docs, items)
