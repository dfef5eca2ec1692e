"""Words that a weak hash takes for each other, through every operator that hashes words."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from featlake.llm import bpe, ngram_join, records, suffix_tree
from featlake.llm.words import Words, same_pieces

SIZES = [1024, 2048, 4096, 8192]


def thue_morse(size, flip=False):
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b ^ flip] for b in bits)


@pytest.fixture(scope="module")
def crafted(spark):
    """For each size a word and its complement, each in a sentence of its own."""
    rows = [(2 * k + f, f"see {thue_morse(n, f)} ok") for k, n in enumerate(SIZES) for f in (False, True)]
    return spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")


@pytest.mark.parametrize("size", SIZES)
def test_hashes_differ(size):
    h = Words(pa.array([f"{thue_morse(size)} {thue_morse(size, True)} {thue_morse(size)}"])).hashes()
    assert h[0] == h[2] != h[1]


def test_hashes_tell_places_and_lengths_apart():
    words = ["a", "aa", "a" * 8, "a" * 9, "abcdefgh12345678", "12345678abcdefgh", "abcdefgh", "abcdefgh1", "b", "é", "\x00", "\x00\x00"]
    assert len(set(Words(pa.array([" ".join(words)])).hashes().tolist())) == len(words)
    assert len(Words(pa.array([" ", ""])).hashes()) == 0


def test_same_pieces():
    data = np.frombuffer(b"abcdefghij abcdefghij abcdefghik abc", np.uint8)
    start, sizes = np.array([0, 11, 22, 33, 0]), np.array([10, 10, 10, 3, 0])
    assert same_pieces(data, start, sizes, data, np.zeros(5, int), np.array([10, 10, 10, 10, 0])).tolist() == [True, True, False, False, True]


def test_byte_ids(spark, crafted):
    import base64
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in crafted.collect()}
    for r in bpe.round_trip(crafted.coalesce(1), P.path("byte_bpe_50k.json")).collect():
        ids = np.array(other.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_word_ids(spark, crafted):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in crafted.collect()}
    for r in records.digest(records.written_and_read(crafted.coalesce(1), P.path("word_bpe_49k.json"), 1)).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_near_duplicates(crafted):
    got = ngram_join.near_duplicates(crafted).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got)


def test_words_are_counted_apart(spark, crafted):
    """A crafted word that was not learned is not known, though its complement was."""
    from pyspark.sql import functions as F

    got = {r.doc_id: r.n_known for r in suffix_tree.score_texts(crafted, F.col("doc_id") % 2 == 0).collect()}
    assert got == {i: 4 if i % 2 == 0 else 3 for i in got}


@pytest.mark.parametrize("encoder", [bpe.TextEncoder, records.WordEncoder])
def test_pieces_that_share_a_hash(monkeypatch, encoder):
    """With a hash that is the same for many words, ids are still those of each word."""
    name = "byte_bpe_50k.json" if encoder is bpe.TextEncoder else "word_bpe_49k.json"
    texts = pa.array(["some words here and there", "Other words, more words. 12 words", "", "some there here words"] * 3)
    plain = encoder(P.path(name))
    expected = [plain(texts), plain(texts)]
    monkeypatch.setattr(Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64) // 3)
    weak = encoder(P.path(name))
    for ids, counts in expected:
        found = weak(texts)
        assert found[0].tolist() == ids.tolist() and found[1].tolist() == counts.tolist()
