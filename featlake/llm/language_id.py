"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of sample texts. A text is compressed
with every dictionary; the language whose dictionary gives the smallest size wins, and the margin
to the next one says how sure that is. Texts are compressed in pieces, so a long text does not
become its own dictionary; every piece of it counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.bpe import in_parts
from featlake.llm.common import collected, crc32_of, giving_back, whole_text

#: The sample: so many labelled texts of a language, so many characters of each, so much in all.
SAMPLE_TEXTS, SAMPLE_CHARACTERS, DICTIONARY_BYTES = 400, 1500, 160 * 1024
MOST_LANGUAGES = 1000
#: Bytes of text compressed at once, and zstandard's level.
PIECE, LEVEL = 16384, 6
#: The share of its size by which a text must be smaller in its language than in any other.
MARGIN = 0.004
#: The margin at which half of the doubt is gone.
HALF = 0.02
UNKNOWN = "und"

_BETWEEN = re.compile(r"[\W\d_]+")

Dictionaries = list[tuple[str, bytes]]


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Dictionaries:
    """Dictionary contents by language, the most frequent first, from labelled rows that ``train`` selects.

    The sample of a language are the texts with letters whose ids have the smallest hashes, at most
    ``SAMPLE_TEXTS``, of each the first ``SAMPLE_CHARACTERS``: its size is bounded by the number of
    languages alone. Each text is taken once. Without labelled rows there are no languages.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull())
    pieces = labelled.where(F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("_order"),
        F.left(text_col, F.lit(SAMPLE_CHARACTERS)).alias("piece"),
    ).withColumn("_piece", F.xxhash64("piece"))
    # A limit on a rank is applied before the shuffle too, so no task gets all rows of a language.
    first = Window.partitionBy("lang").orderBy("_order", "_piece")
    sample = pieces.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE_TEXTS)
    rows = collected(sample.select("lang", "_n", "piece"), MOST_LANGUAGES * SAMPLE_TEXTS, "language samples")
    counts = dict(collected(labelled.groupBy(lang_col).count(), MOST_LANGUAGES, "languages"))
    texts: dict[str, dict[str, None]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r._n)):
        texts.setdefault(r.lang, {})[normal(r.piece).decode()] = None
    order = sorted(texts, key=lambda lang: (-counts[lang], lang))
    return [(lang, " ".join(texts[lang]).encode()[:DICTIONARY_BYTES]) for lang in order]


class Sizer:
    """Compressed sizes of texts with each dictionary, less those of nothing."""

    def __init__(self, dictionaries: Dictionaries):
        import zstandard

        self.compress = []
        for _, content in dictionaries:
            # Contents under eight bytes are no dictionary.
            made = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            coder = zstandard.ZstdCompressor(
                dict_data=made, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.compress.append(coder.compress)

    def __call__(self, data: bytes) -> list[int]:
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(compress(p)) for p in pieces) for compress in self.compress]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def normal(text: str) -> bytes:
    """What is compressed: lower-case words of letters, and one blank for all that lies between them."""
    return _BETWEEN.sub(" ", text.lower()).strip().encode()


def judged(sizes: list[int]) -> tuple[int, float]:
    """The number of the smallest size, and its distance from the next as a share of the next.

    Of equal sizes the first, most frequent language wins, with a margin of nothing; one language alone has a margin of one.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if len(order) == 1:
        return order[0], 1.0
    best, second = sizes[order[0]], sizes[order[1]]
    return order[0], (second - best) / second


def identify(docs: DataFrame, dictionaries: Dictionaries, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``margin`` and ``accepted``; columns of those names are replaced.

    A text that is null or has no letter is ``und``, with a margin of 0 and not accepted, and so is
    every text if there are no dictionaries. A margin under ``MARGIN`` is too narrow: the prediction
    stands, but is not accepted.
    """
    new = "lang_pred string, margin double, accepted boolean"
    names = ("lang_pred", "margin", "accepted")
    kept = docs.select(whole_text(text_col).alias("_whole_text"), *[c for c in docs.columns if c not in names])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]]
    langs = [lang for lang, _ in dictionaries]

    def work(batches: Iterable[pa.RecordBatch]):
        sizer = Sizer(dictionaries)
        for part in in_parts(batches, 0):
            found = []
            for text in part.column(0).to_pylist():
                known = langs and has_letter(text)
                best, margin = judged(sizer(normal(text))) if known else (None, 0.0)
                found.append((UNKNOWN if best is None else langs[best], margin, best is not None and margin >= MARGIN))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*part.schema.names[1:], *names])

    return kept.mapInArrow(giving_back(work), ", ".join([*fields, new]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: a third of the ids."""
    return crc32_of(F.col(id_col)) % 3 == 1


def score(margin: Column) -> Column:
    """How sure a prediction is, from 0 to 1: the doubt halves with every ``HALF`` of margin."""
    return F.lit(1.0) - F.pow(F.lit(0.5), margin / HALF)
