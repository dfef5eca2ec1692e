"""Token records: the file format against its definition, and exact round trips."""

from __future__ import annotations

import glob
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from featlake.llm import queries, records

FILE = P.path("word_bpe_49k.json")


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = np.random.default_rng(1)
    data = [b"", b"a", b"123456789"] + [rng.bytes(n) for n in (2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 64, 1000, 4099)]
    crc = records.Crc32c()
    assert crc(data).tolist() == [plain_crc32c(d) for d in data]
    assert crc([b"123456789"])[0] == 0xE3069283
    c = plain_crc32c(b"abc")
    assert crc.masked([b"abc"])[0] == (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def expected_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_hard_rows(hard):
    got = records.digest(records.written_and_read(hard, FILE, 1)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_ids([(r.doc_id, r.text) for r in hard.collect()])


def test_white_space_of_all_kinds(spark):
    texts = [f"a{c}b {c} c" for c in map(chr, [*range(1, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x3000, 0xFEFF])]
    texts += ["Don't, x', ,'s 's. İx, É, <|endoftext|> <|ENDOFTEXT|>, ABC á, 3's 12, é! ×, ÷. ñ|", "DON'T ABC", "I'LL, we'll. ǅ ΑΣ, ΑΣ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = records.digest(records.written_and_read(docs, FILE, 1)).collect()
    assert sorted(map(tuple, got)) == expected_ids(list(enumerate(texts)))


def written(spark, tmp_path, n=300):
    docs = spark.createDataFrame([(i, "some words " * (i % 40)) for i in range(n)], "doc_id long, text string").repartition(4)
    return records.write_records(docs, str(tmp_path / "out"), lambda: records.WordEncoder(FILE), 1)


def test_files_hold_plain_frames_in_order(spark, tmp_path):
    index = written(spark, tmp_path)
    rows = sorted(index.collect(), key=lambda r: (r.part, r.nth))
    assert [r.doc_id for r in rows] == list(range(300))
    for name in {r.file for r in rows}:
        data, at = open(name, "rb").read(), 0
        for r in (r for r in rows if r.file == name):
            n = int.from_bytes(data[at : at + 8], "little")
            assert (r.offset, r.length) == (at, n + 16)
            at += n + 16
        assert at == len(data)


def test_shuffled_and_filtered_reads(spark, tmp_path):
    index = records.with_starts(written(spark, tmp_path))
    some = index.where("doc_id % 3 = 0").orderBy(F.rand(1))
    whole = {r.doc_id: bytes(r.ids) for r in records.read_records(index).collect()}
    got = {r.doc_id: bytes(r.ids) for r in records.read_records(some).collect()}
    assert len(whole) == 300 and got == {k: v for k, v in whole.items() if k % 3 == 0}


def test_damage_is_found(spark, tmp_path):
    index = records.with_starts(written(spark, tmp_path, 5))
    name = glob.glob(f"{tmp_path}/out/records/*")[0]
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(index).collect()


def test_query_and_empty_table(spark, empty):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_token_records(spark, folder).collect())) == expected_ids(rows)
    assert records.written_and_read(empty, FILE, 1).count() == 0
