"""Python workers stay for later tasks; what they no longer need goes."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest

from featlake.llm import bpe, language_id, ngram_join, queries
from featlake.llm.common import giving_back, kept_by_worker


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def store():
    return {k for k in vars(sys.modules["_featlake_worker"]) if isinstance(k, tuple)}


@pytest.fixture
def works(monkeypatch):
    """What is given to mapInArrow, in order."""
    from pyspark.sql.classic.dataframe import DataFrame

    found, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, work, *a, **b: (found.append(work), real(self, work, *a, **b))[1])
    return found


def test_free_memory_is_given_back():
    last = []

    def work(batches):
        arrays = [np.ones(1250) for _ in range(20_000)]
        last.append(np.ones(1250))  # lies behind them, so they are not freed from the end
        yield from batches
        del arrays

    before = resident()
    assert list(giving_back(work)([1])) == [1]
    assert resident() - before < 60e6


def test_what_others_kept_goes():
    kept_by_worker(("other",), object)
    own = kept_by_worker(("own",), object)
    assert list(giving_back(iter, ("own",))([])) == []
    assert store() == {("own",)} and kept_by_worker(("own",), object) is own
    list(giving_back(iter)([]))
    assert not store()


def test_stages_drop_the_tokenizer_and_the_encoder_keeps_it(hard, works):
    file = bpe.public_file(queries.BYTE_VOCABULARY)
    bpe.round_trip(hard, file)
    bpe.encode(hard, file)
    language_id.identify(hard, [])
    ngram_join.near_duplicates(hard)
    assert len(works) > 5
    for n, work in enumerate(works):
        kept_by_worker(("byte", file), object)
        next(work([]), None)
        assert store() == ({("byte", file)} if n < 2 else set())
