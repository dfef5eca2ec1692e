"""Byte-level BPE against the tiktoken library and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata

import pyarrow as pa
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from featlake.llm import bpe, queries

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def other():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_byte_table_is_that_of_the_vocabulary():
    assert sorted(bpe.byte_characters()) == sorted({c for c in bpe.byte_characters()})
    assert bpe.byte_characters()[32] == "Ġ" and bpe.byte_characters()[10] == "Ċ"


@pytest.mark.parametrize("space", [" ", "\n", "  ", "   ", " \n", "\n ", "\n\n", " \n ", "  \n", "\t", " \t ", "\xa0", " \x1c", "\r\n", "　 ", "\x85 "])
def test_cuts_never_change_the_ids(other, space):
    encode = bpe.TextEncoder(FILE)
    texts = [f"a{space}b", f"{space}b", f"a{space}", f"a.{space}É'll{space}12{space}{space}x", f"a{space}́b", f"'s{space}'s"]
    ids, counts = encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in other.encode_ordinary(t)]
    assert counts.tolist() == [len(other.encode_ordinary(t)) for t in texts]


def test_all_characters(other):
    encode = bpe.TextEncoder(FILE)
    known = [chr(c) for c in range(0x3100) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [f"x{c}y {c} {c}{c}z" for c in known]
    ids, counts = encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in other.encode_ordinary(t)]


def test_hard_rows(other, hard):
    texts = [(r.doc_id, r.text or "") for r in hard.collect()]
    expected = sorted((i or -1, len(x := other.encode_ordinary(t)), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    got = sorted((r[0] or -1, *r[1:]) for r in bpe.round_trip(hard, FILE).collect())
    assert got == expected


def test_offsets_and_decoding(hard):
    tokens = bpe.encode(hard.withColumn("ids", F.lit("clash")), FILE, offsets=True)
    assert {"size", "lang", "source"} < set(tokens.columns)
    for r in tokens.collect():
        text = r.text or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        covered = set().union(*(range(a, b) for a, b in zip(r.starts, r.ends)))
        assert covered == set(range(len(text))) and r.starts == sorted(r.starts)
    back = bpe.decode(tokens.drop("text").withColumn("original", F.col("doc_id")), FILE)
    texts = sorted(((r.doc_id or -1, r.text or "") for r in hard.collect()))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == texts


def test_a_split_character(spark):
    docs = spark.createDataFrame([(1, "a\U0001f600b")], "doc_id long, text string")
    row = bpe.encode(docs, FILE, offsets=True).collect()[0]
    assert list(zip(row.starts, row.ends))[1:-1] == [(1, 2)] * (len(row.ids) - 2) and len(row.ids) > 3
    half = spark.createDataFrame([(row.ids[:2],), (None,)], "ids array<int>")
    a, b = bpe.decode(half, FILE).collect()
    assert a.text == "a�" and bytes(a.decoded).startswith(b"a\xf0") and b.text == ""


def test_query(spark, other):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op3_byte_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(empty):
    assert bpe.round_trip(empty, FILE, with_ids=True).count() == 0
    assert bpe.decode(bpe.encode(empty, FILE, offsets=True), FILE).count() == 0
