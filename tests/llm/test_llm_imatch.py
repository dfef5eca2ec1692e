"""I-Match fingerprints against a plain reckoning of edits and the rules of comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featlake.llm import imatch, queries


def brute_edits(rows):
    """Rows of (id, text) with unique ids: id, length and hash of the edited text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for n, (i, t) in enumerate(rows):
        following, third = rows[(n + 1) % len(rows)][1], len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()))
    return out


def unique(hard):
    return hard.dropDuplicates(["doc_id"]).cache()


def test_hard_rows(hard):
    docs = unique(hard)
    got = imatch.fingerprint_edits(docs).collect()
    assert sorted(map(repr, brute_edits([(r.doc_id, r.text) for r in docs.collect()]))) == sorted(repr(tuple(r[:3])) for r in got)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_terms = {}
    for r in got:
        terms = frozenset(re.findall(r"[^\W_]+", texts[r.doc_id].lower()))
        if texts[r.doc_id].isascii():
            by_terms.setdefault(terms, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 17 + 4 * imatch.SLOTS
    assert all(len(f) == 1 for f in by_terms.values())


@pytest.mark.parametrize("rows", [1, 7, 40])
def test_order_over_many_buckets(spark, monkeypatch, rows):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 3)
    docs = spark.createDataFrame([(i * i - 50, f"text {i} " * (i % 5)) for i in range(rows)], "doc_id long, text string").repartition(4)
    got = imatch.fingerprint_edits(docs).collect()
    assert sorted(tuple(r[:3]) for r in got) == sorted(brute_edits([(r.doc_id, r.text) for r in docs.collect()]))


def test_repeated_rows_and_ids(hard):
    got = imatch.fingerprint_edits(hard)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in hard.collect())


def test_query_on_given_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = queries.op7_imatch(spark, folder).cache()
    assert sorted(tuple(r[:3]) for r in got.collect()) == sorted(brute_edits([(r.doc_id, r.text) for r in docs.collect()]))
    same = docs.join(got, "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert same.where("n > 1").count() == 0
    near = got.agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert near[0] > 0.3 and near[1] < 0.05 and near[2] > 0.9


def test_lexicon_is_the_band_of_all_documents(spark):
    docs = spark.createDataFrame([(i, f"all half{i % 2} rare{i} all") for i in range(40)], "doc_id long, text string")
    got = imatch.lexicon(docs, low=0.1, high=0.6).select("term").collect()
    expected = spark.range(1).select(F.xxhash64(F.lit("half0")), F.xxhash64(F.lit("half1"))).first()
    assert {r.term for r in got} == set(expected)


def test_fingerprints_follow_the_method(spark):
    """Every subset's digits are the hash of the document's sorted terms in it."""
    docs = spark.createDataFrame([(1, "b a c d e f g h"), (2, "h g f e d c b a a"), (3, "a b"), (4, None)], "doc_id long, text string")
    words = imatch.lexicon(docs, low=0.0, high=1.0)
    prints = {r.doc_id: r.p for r in imatch.fingerprints(docs, {"p": "text"}, ["doc_id"], words).collect()}
    assert prints[1] == prints[2] != prints[3] and set(prints[4][17:]) == {"."}
    subsets = {r.term: r.subsets for r in words.collect()}
    terms = [r[0] for r in docs.where("doc_id = 1").select(F.explode(imatch.terms_of(F.col("text"))).alias("t")).select(F.xxhash64("t")).collect()]
    for s in range(imatch.SLOTS):
        own = sorted(f"{s:02X}{t % 2**64 >> 8:014X};" for t in terms if s in subsets[t])
        digits = hashlib.md5("".join(own).encode()).hexdigest()[:4] if own else "...."
        assert prints[1][17 + 4 * s : 21 + 4 * s] == digits


def test_likeness(spark):
    def made(*slots, whole="0" * 16):
        return f"{whole}:" + "".join(dict(slots).get(i, "....") for i in range(imatch.SLOTS))

    a = made(*[(i, "aaaa") for i in range(10)])
    b = made(*[(i, "aaaa" if i < 5 else "bbbb") for i in range(10)], whole="1" * 16)
    none, other = made(), made(whole="1" * 16)
    fine = made(*[(i, "cccc") for i in range(10)], *[(75 + i, "dddd") for i in range(6)], whole="2" * 16)
    finer = made(*[(i, "eeee") for i in range(10)], *[(75 + i, "dddd") for i in range(6)], whole="3" * 16)
    cases = [(a, a, 1.0), (a, b, 0.5), (a, other, 0.0), (none, other, 0.0), (none, none, 1.0), (fine, finer, 1.0)]
    df = spark.createDataFrame(cases, "a string, b string, expected double")
    for r in imatch.with_likeness(df, "got", "a", "b").collect():
        assert r.got == pytest.approx(r.expected)


def test_large_groups_of_copies_keep_their_fingerprints(spark):
    """A third near copies, a third exact copies, short texts of rare words, and others."""
    shared, exact = " ".join(f"near{i}" for i in range(40)), " ".join(f"same{i}" for i in range(30))
    texts = [f"{shared} only{i}" for i in range(700)] + [exact] * 700 + [f"{exact} more"] + ["pqr stu vwx yza bcd efg hij klm"]
    texts += ["pqr stu vwx yza bcd efg hij"] + [" ".join(f"w{(7 * i + j * j) % 900}" for j in range(20)) for i in range(698)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprint_edits(docs).collect()}
    pairs = [(i, i + 1) for i in range(0, 600, 50)] + [(700, 1400), (1401, 1402), (0, 700), (0, 1401)]
    df = spark.createDataFrame([(i, j, prints[i], prints[j]) for i, j in pairs], "i int, j int, a string, b string")
    got = {(r.i, r.j): r.got for r in imatch.with_likeness(df, "got", "a", "b").collect()}
    assert got.pop((0, 700)) == got.pop((0, 1401)) == 0.0
    assert min(got.values()) >= 0.5, got
    counts, n = imatch.counted_terms(docs)
    df = {r.term: r.df for r in counts.collect()}
    same = spark.range(1).select(F.xxhash64(F.lit("same1")), F.xxhash64(F.lit("near1"))).first()
    assert [df[same[0]], df[same[1]], n] == [2, 700, 700 + 2 + 2 + len(set(frozenset(t.split()) for t in texts[1403:]))]


def test_near_copies_do_not_list_shared_terms(spark, monkeypatch):
    """No stored table has a row for each term of each member, and members list only their own terms."""
    sizes, own = {}, []

    def watched(df, purpose, *args):
        out = store(df, purpose, *args)
        sizes[purpose] = out.count()
        if "own" in out.columns:
            own.append(out.agg(F.max(F.size("own"))).first()[0])
        return out

    store = imatch.written
    monkeypatch.setattr(imatch, "written", watched)
    shared = " ".join(f"near{i}" for i in range(60))
    texts = [f"{shared} only{i}" for i in range(400)] + [" ".join(f"w{(7 * i + j * j) % 900}" for j in range(20)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [r.fingerprint for r in imatch.fingerprint_edits(docs).orderBy("doc_id").collect()]
    assert max(sizes.values()) <= 3 * len(texts), sizes
    assert own and max(own) < 20, own
    drawn = [[p[i : i + 4] for i in range(17, len(p), 4)] for p in prints[:400]]
    assert all(sum(d != "...." for d in some) >= imatch.ENOUGH for some in drawn)
    assert all(sum(x == y != "...." for x, y in zip(drawn[0], some)) >= imatch.ENOUGH for some in drawn)


def test_empty_table_and_plan(empty, spark):
    assert imatch.fingerprint_edits(empty).count() == 0
    df = imatch.fingerprint_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
