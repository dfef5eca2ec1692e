"""Documents that are hard on every operator: nulls, empty and very long texts, ties, repeats, odd columns."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, start long, spans string, _id long"


def rows(texts, first=0):
    made = []
    for i, t in enumerate(texts, first):
        lang = (None, "en", "de")[i % 3]
        source = (None, "a", "b", "é", "")[i % 5]
        made.append((i, t, lang, source, None if t is None else len(t), 7, 8, "x", 9))
    return made


TEXTS = [
    None, "", " ", "\n\t ", "one", "One", "ONE", "one two three four", "É é İ ß", "á \U0001f600 b",
    "mail a.b@x.org, c@d, e@f.g_h@i.jk 300.1.1.1 1.2.3.4.5 +1 (555) 010-9999 +12", "4539 1488 0343 6467 and 4539148803436468",
    "pay to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432.", "SSN 123-45-6789; phone 555-123-4567 x 555-123-4567",
    "word " * 30_000, "x" * 60_000, "@." * 5_000, "1." * 5_000, "1 " * 5_000, "+1-" * 3_000, "a@b.c," * 700,
    "\x00\x0b\x0c\r\x1f\x85\xa0 ", "tie tie tie tie tie tie", "tie tie tie tie tie tie", "<|endoftext|> 'll  \n  x   y\n",
    "the quick brown fox jumps over the lazy dog. " * 20, "The quick brown fox jumps over the lazy dog. " * 20,
    "der schnelle braune fuchs springt über den faulen hund. " * 20, "%%% ### $$$", "3.14 159 26535",
]


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, one of them twice, one id with two texts, one row without an id."""
    made = rows(TEXTS)
    made += [made[10], (7, "another text of seven", "en", "a", 21, 7, 8, "x", 9), (None, "no id", "en", "a", 5, 7, 8, "x", 9)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
