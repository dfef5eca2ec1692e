"""Every stage of the pipeline against plain Python, on what the stage before kept."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from featlake.llm import language_id, mixing
from featlake.llm.common import LOWER, UPPER
from test_llm_ngram_join import brute as components

FOLD = str.maketrans(UPPER, LOWER)
WORDS = re.compile("[^\x20\x09-\x0d]+")


def run_stages(spark, docs, tmp_path):
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], "").write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    return kept


def check(spark, docs, tmp_path):
    raw, spoken, distinct, apart, mixed, tokens = run_stages(spark, docs, tmp_path)
    for df in (spoken, distinct, apart, mixed):
        assert df.dtypes == raw.dtypes
    rows = [df.select("doc_id", "text", "source").collect() for df in (raw, spoken, distinct, apart, mixed)]
    known = language_id.learn(raw, ~language_id.held_out())
    sizer, expected = language_id.Sizer(known), Counter()
    for r in rows[0]:
        if r.text and any(c.isalpha() for c in r.text) and known:
            best, margin = language_id.judged(sizer(language_id.normal(r.text)))
            expected[r.doc_id, r.text] += margin >= language_id.MARGIN
    assert Counter((r.doc_id, r.text) for r in rows[1]) == +expected

    groups = defaultdict(list)
    for r in rows[1]:
        groups[r.text.translate(FOLD)].append((r.doc_id is not None, r.doc_id))
    assert Counter(r.doc_id for r in rows[2]) == Counter(max(g)[1] for g in groups.values())

    found = components([(r.doc_id, r.text) for r in rows[2]])
    assert Counter(r.doc_id for r in rows[3]) == Counter({i: sum(m for (j, _, c), m in found.items() if i == j == c) for i, _, c in found if i == c})

    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r.source] += len(WORDS.findall(r.text))
    for r in rows[4]:
        taken[r.source] += len(WORDS.findall(r.text))
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    targets = mixing.water_fill([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for n, t in zip(names, targets):
        assert abs(taken[n] - t) <= 2 * mixing.BLOCK
    whole = defaultdict(list)
    for r in rows[3]:
        whole[r.doc_id].append(Counter(WORDS.findall(r.text)))
    assert all(any(Counter(WORDS.findall(r.text)) <= w for w in whole[r.doc_id]) for r in rows[4])

    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in rows[4]:
        ids = plain.encode_ordinary(r.text)
        expected[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((*r[:4], tuple(r.ids)) for r in tokens.collect()) == expected


def test_given_rows(spark, tmp_path):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), tmp_path)


def test_hard_rows(spark, hard, tmp_path):
    check(spark, hard.where(F.length(F.coalesce("text", F.lit(""))) < 30_000), tmp_path)


def test_empty_table(spark, empty, tmp_path):
    assert run_stages(spark, empty, tmp_path)[-1].count() == 0


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 100
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_the_rest_does_without(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'list_features' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)
    assert pytest
