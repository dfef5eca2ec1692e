"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the terms of a band of document frequencies: rarer terms are noise, more frequent
ones say nothing. Random subsets of it are drawn at several rates. For each subset, a document's
distinct terms in it are sorted and hashed; the hashes are the fingerprint. Documents of different
lengths have about one term per subset at different rates, so two fingerprints are compared at the
lowest rate at which enough subsets hold a term of either document.

Frequencies are counted over distinct sets of terms, so copies of a text count once. A text with few
terms of the band, as a member of a large group of near copies or a short text of rare words, is
drawn from its terms that are nearest to the band as well.

Everything is column expressions and joins. The band bounds the lexicon: a term of the band is in at
least ``LOW`` of the documents, so there are at most (mean distinct terms per document) / ``LOW``
terms, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import bounded_broadcast, whole_text, written
from featlake.operators.slices import with_slice

#: The band, as shares of all documents.
LOW, HIGH = 0.001, 0.05
#: Subsets at each rate. At the first rate they are a partition of the lexicon; each further rate is a quarter.
SUBSETS, RATES = 24, 4
SLOTS = SUBSETS * RATES
#: Subsets with a term of either document from which on a rate is used.
ENOUGH = 6
#: Terms that a text with fewer than ``ENOUGH`` of the band is drawn from, if it has as many.
FILL = SUBSETS
#: Rows of a bucket in the order of ids, and the most buckets; beyond, buckets grow and windows spill.
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16
_NONE = "...."


def terms_of(text: Column) -> Column:
    """The distinct terms: runs of letters and digits of the lower-cased text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def _subsets(term: Column) -> Column:
    """The numbers of the subsets that a term is drawn into: one at the first rate, and seldom one at others."""
    drawn = []
    for rate in range(RATES):
        at = F.pmod(F.xxhash64(term, F.lit(rate)), F.lit(SUBSETS * 4**rate))
        drawn.append(F.when(at < SUBSETS, at + rate * SUBSETS).cast("int"))
    return F.filter(F.array(*drawn), lambda s: s.isNotNull())


def counted_terms(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """``term`` (as a hash) and ``df``, the number of distinct sets of terms with it; and the number of sets."""
    terms = docs.select(terms_of(whole_text(text_col)).alias("t"))
    # The empty term stands for the set itself.
    hashed = F.transform(F.array_append("t", ""), lambda t: F.xxhash64(t))
    sets = terms.select(F.xxhash64(F.array_sort("t")).alias("whole"), hashed.alias("t")).dropDuplicates(["whole"])
    counts = written(sets.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term-counts")
    own = F.col("term") == F.xxhash64(F.lit(""))
    return counts.where(~own), counts.where(own).agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]


def _far(n: int, low: float = LOW, high: float = HIGH) -> Column:
    """How far a term is from the band, as a ratio; 0 in it. A term of no document is the farthest of the rare ones."""
    df = F.coalesce(F.col("df").cast("double"), F.lit(0.5))
    return F.when(df > n * high, df / (n * high)).when(df < n * low, n * low / df).otherwise(0.0)


def _band(counts: DataFrame, n: int, low: float = LOW, high: float = HIGH) -> DataFrame:
    return counts.where(_far(n, low, high) == 0).select("term", _subsets(F.col("term")).alias("subsets"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term`` (as a hash) and ``subsets`` of the terms in the band; counts cover all documents."""
    return _band(*counted_terms(docs, text_col), low, high)


def _versions(rows: DataFrame, texts: dict[str, str], keys: list[str], facts: Column) -> DataFrame:
    """``keys, facts, v, terms, whole``: a row for each text column with its number, terms and their hash."""
    versions = F.array(*[
        F.struct(F.lit(i).alias("v"), terms_of(whole_text(c)).alias("terms")) for i, c in enumerate(texts.values())
    ])
    return rows.select(*keys, facts.alias("facts"), F.explode(versions).alias("x")).select(
        *keys, "facts", "x.v", "x.terms", F.xxhash64(F.array_sort("x.terms")).alias("whole")
    )


def _packed(subset: Column, term: Column) -> Column:
    """A subset's number and 56 bits of a term's hash in one number: lists of numbers are small."""
    return F.shiftleft(subset.cast("long"), 56) + F.shiftrightunsigned(term, 8)


def beyond_band(few: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``whole, print`` of sets with few terms of the band, which are drawn from other terms besides.

    ``few``: ``whole, terms, l`` of each set once, see ``term_lists``. Terms beyond the upper end of
    the band are a bounded number and meet each set as one list, so the members of a large group of
    near copies do not list the terms that they share; only rarer terms, and the few of the band, do.
    """
    upper = counts.where(F.col("df") > n * HIGH).select(F.struct(_far(n).alias("far"), "term").alias("x"))
    upper = upper.agg(F.array_sort(F.collect_list("x")).alias("upper"))
    sets = few.crossJoin(F.broadcast(upper)).withColumns({"_far": F.col("upper.far"), "_term": F.col("upper.term")})
    shared = F.slice(F.array_intersect("_term", "terms"), 1, FILL)
    shared = F.transform(shared, lambda t: F.struct(F.element_at("_far", F.array_position("_term", t).cast("int")).alias("far"), t.alias("term")))
    sets = written(sets.select("whole", "l", shared.alias("shared"), F.array_except("terms", "_term").alias("own")), "few-terms")
    # Terms from the band on, which are a bounded number, by broadcast, so no key of the join is hot.
    pairs = sets.select("whole", F.explode("own").alias("term"))
    often = bounded_broadcast(written(counts.where(F.col("df").between(n * LOW, n * HIGH)), "often"))
    rare = pairs.join(often, "term", "left_anti").join(counts.where(F.col("df") < n * LOW), "term", "left")
    near = pairs.join(often, "term").unionByName(rare).groupBy("whole").agg(F.collect_list(F.struct(_far(n).alias("far"), "term")).alias("near"))
    none = F.array().cast("array<struct<far: double, term: bigint>>")
    nearest = F.slice(F.array_sort(F.concat("shared", F.coalesce("near", none))), 1, FILL)
    chosen = F.filter(nearest, lambda x: x["far"] > 0)
    more = F.flatten(F.transform(chosen, lambda x: F.transform(_subsets(x["term"]), lambda s: _packed(s, x["term"]))))
    drawn = sets.join(near, "whole", "left").select("whole", F.concat("l", more).alias("l"))
    return drawn.select("whole", _print(F.col("whole"), F.col("l")).alias("print"))


def term_lists(rows: DataFrame, texts: dict[str, str], keys: list[str], words: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each text column of each row: ``keys, v, facts, whole, terms, l``.

    ``terms`` are all terms as hashes, ``l`` the numbers of the lexicon's terms in their subsets,
    ``facts`` the columns in ``carry``, with the first text column only. If ``rows`` are partitioned
    by some of ``keys``, nothing is shuffled.
    """
    split = _versions(rows, texts, keys, F.struct(F.lit(0), *carry))
    # The empty term stands for the row itself, so texts without terms keep a row, too. Terms are
    # hashed before they are listed: what follows is compiled and copies no list for each term.
    empty = F.xxhash64(F.lit(""))
    own = F.col("term") == empty
    hashed = split.withColumn("terms", F.transform("terms", lambda t: F.xxhash64(t)))
    listed = hashed.select(*keys, "facts", "v", "whole", "terms", F.explode(F.array_append("terms", empty)).alias("term")).select(
        *keys, "v", "whole", "term", own.alias("own"), F.when(own & (F.col("v") == 0), F.col("facts")).alias("facts"),
        F.when(own, F.col("terms")).alias("terms"),
    )
    drawn = listed.join(words, "term", "left").where(F.col("own") | F.col("subsets").isNotNull())
    spread = drawn.select(*keys, "v", "whole", "facts", "terms", "term", F.explode_outer("subsets").alias("subset"))
    packed = _packed(F.col("subset"), F.col("term"))
    return spread.select(*keys, "v", "whole", "facts", "terms", packed.alias("x")).groupBy(*keys, "v", "whole").agg(
        F.first("facts", ignorenulls=True).alias("facts"), F.first("terms", ignorenulls=True).alias("terms"), F.collect_list("x").alias("l")
    )


def _print(whole: Column, numbers: Column) -> Column:
    """The fingerprint of a set of terms, from its hash and its list of numbers."""
    spelled = F.transform(F.array_sort(numbers), lambda x: F.concat(F.lpad(F.hex(x), 16, "0"), F.lit(";")))
    # Sorted, the terms of a subset follow each other: each such run is hashed.
    runs = F.regexp_extract_all(F.array_join(spelled, ""), F.lit(r"([0-9A-F]{2})[0-9A-F]+;(?:\1[0-9A-F]+;)*+"), F.lit(0))
    hashed = F.transform(runs, lambda r: F.concat(F.left(r, F.lit(2)), F.left(F.md5(r.cast("binary")), F.lit(4))))
    # Every subset once more, empty; of two entries of a subset the one with digits comes second.
    empty = F.array(*[F.lit(f"{s:02X}{_NONE}") for s in range(SLOTS)])
    full = F.array_sort(F.concat(hashed, empty))
    text = F.regexp_replace(F.array_join(full, ";"), r"([0-9A-F]{2})\.\.\.\.;\1(?=[0-9a-f]{4})", "$1")
    digits = F.regexp_replace(text, r"(?:^|;)[0-9A-F]{2}", "")
    return F.concat(F.lower(F.lpad(F.hex(whole), 16, "0")), F.lit(":"), digits)


def _side_by_side(prints: DataFrame, names: list[str], keys: list[str], carry: tuple[str, ...]) -> DataFrame:
    """``keys``, ``carry`` and the fingerprint of each text column, from ``keys, v, facts, print``."""
    one = prints.groupBy(*keys).agg(
        F.first("facts", ignorenulls=True).alias("facts"),
        *[F.max(F.when(F.col("v") == i, F.col("print"))).alias(n) for i, n in enumerate(names)],
    )
    return one.select(*keys, *[F.col("facts")[c].alias(c) for c in carry], *names)


def fingerprints(
    rows: DataFrame, texts: dict[str, str], keys: list[str], words: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``keys``, ``carry`` and a fingerprint per text column: ``texts`` maps names of fingerprints to columns.

    ``keys`` identify a row, and columns in ``carry`` come along, so the texts are read once. If
    ``rows`` are partitioned by some of them, nothing is shuffled. A fingerprint is the hash of all
    sorted terms in 16 digits, a colon, and for each subset four digits, or four dots where the text
    has no term of the subset. Null counts as empty.
    """
    prints = term_lists(rows, texts, keys, words, carry).withColumn("print", _print(F.col("whole"), F.col("l")))
    return _side_by_side(prints, list(texts), keys, carry)


def with_likeness(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Add ``name``: the likeness of two fingerprints, from 0 to 1.

    It is the share of equal subsets at the lowest rate with enough subsets, and 1 for equal terms.
    If no rate has ``ENOUGH`` subsets with a term of either text, the first rate counts with what it
    has; if it has none, texts with different terms are not alike.
    """

    def slots(p: str) -> Column:
        return F.regexp_extract_all(F.substring(p, 18, 4 * SLOTS), F.lit(".{4}"), F.lit(0))

    def mark(x: Column, y: Column) -> Column:
        return F.when(x != y, 1).when(x != _NONE, 2).otherwise(0)

    def count(rate: int) -> Column:
        some = F.slice("_marks", rate * SUBSETS + 1, SUBSETS)
        return F.struct(F.size(F.filter(some, lambda m: m > 0)).alias("used"), F.size(F.filter(some, lambda m: m > 1)).alias("same"))

    rates = F.array(*[count(r) for r in reversed(range(RATES))])
    enough = F.try_element_at(F.filter("_rates", lambda r: r["used"] >= ENOUGH), F.lit(1))
    same = F.left(F.col(a), F.lit(16)) == F.left(F.col(b), F.lit(16))
    share = F.when(F.col("_rate.used") > 0, F.col("_rate.same") / F.col("_rate.used")).otherwise(0.0)
    df = df.withColumn("_marks", F.zip_with(slots(a), slots(b), mark)).withColumn("_rates", rates)
    df = df.withColumn("_rate", F.coalesce(enough, F.element_at("_rates", -1)))
    return df.withColumn(name, F.when(same, 1.0).otherwise(share)).drop("_marks", "_rates", "_rate")


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the text that follows in descending order of ids; the first follows the last.

    Returns ``_bucket, _nth, _guest, _id, _text, _next``, partitioned by ``_bucket``. Null ids come
    last; rows of one id are in the order of their text's hash. Buckets are ranges of ids. The first
    row of the bucket below is a guest at the end of each bucket, so no row needs another bucket.
    """
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    rows = with_slice(rows, F.col("_id"), buckets, "_bucket").withColumn("_tie", F.xxhash64("_text"))
    # One row per bucket: its first, and the bucket that it is a guest of.
    heads = rows.groupBy("_bucket").agg(F.max(F.struct("_id", "_tie")).alias("head"))
    one = Window.orderBy("_bucket")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hosts = heads.select(
        F.col("_bucket").alias("_of"), F.col("head._id").alias("_head"), F.col("head._tie").alias("_head_tie"),
        F.coalesce(F.lead("_bucket").over(one), F.first("_bucket").over(whole)).alias("_host"),
    )
    same = (F.col("_bucket") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_tie") == F.col("_head_tie"))
    guests = rows.join(F.broadcast(hosts), same).dropDuplicates(["_of"]).select(
        F.col("_host").alias("_bucket"), F.lit(True).alias("_guest"), "_id", "_text", "_tie"
    )
    everyone = rows.select("_bucket", F.lit(False).alias("_guest"), "_id", "_text", "_tie").unionByName(guests)
    # A partition for each bucket, so no task holds much more than one.
    everyone = everyone.repartition(buckets, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("_id").desc_nulls_last(), F.col("_tie").desc())
    return everyone.select(
        "_bucket", "_guest", "_id", "_text", F.row_number().over(order).alias("_nth"), F.lead("_text").over(order).alias("_next")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many characters from the start of the following one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - third), F.left(following, third))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``near_edited`` is the likeness to the edited text's fingerprint, ``near_next`` that to the next
    document's; a single document is its own next. Null texts count as empty, and texts with equal
    terms have equal fingerprints. Rows that repeat are rows of their own. An empty table gives an
    empty result.
    """
    counts, n = counted_terms(docs, text_col)
    words = bounded_broadcast(written(_band(counts, n), "lexicon"))
    rows = in_id_order(docs, id_col, text_col).withColumn("_edited", edited(F.col("_text"), F.coalesce("_next", F.lit(""))))
    rows = rows.withColumns({"n_chars": F.length("_text").cast("long"), "edited_sha256": F.sha2("_edited", 256)})
    texts = {"fingerprint": "_text", "edited_fingerprint": "_edited"}
    keys = ["_bucket", "_nth"]
    carry = ("_guest", "_id", "n_chars", "edited_sha256")
    lists = term_lists(rows, texts, keys, words, carry)
    # Each term of the band is in one subset of the first rate.
    few = F.size(F.filter("l", lambda x: F.shiftrightunsigned(x, 56) < SUBSETS)) < ENOUGH
    # Texts are taken apart once: fingerprints are stored, or what those of few terms are made from.
    lists = written(lists.select(
        *keys, "v", "facts", "whole", F.when(~few, _print(F.col("whole"), F.col("l"))).alias("done"),
        F.when(few, F.col("terms")).alias("terms"), F.when(few, F.col("l")).alias("l"),
    ), "term-lists")
    beyond = lists.where("done IS NULL").select("whole", "terms", "l").dropDuplicates(["whole"])
    beyond = bounded_broadcast(written(beyond_band(beyond, counts, n), "beyond-band"))
    prints = lists.select(*keys, "v", "facts", "whole", "done").join(beyond, "whole", "left")
    prints = prints.select(*keys, "v", "facts", F.coalesce("done", "print").alias("print")).repartition("_bucket")
    prints = _side_by_side(prints, list(texts), keys, carry)
    order = Window.partitionBy("_bucket").orderBy("_nth")
    both = prints.withColumn("_next_print", F.lead("fingerprint").over(order)).where(~F.col("_guest"))
    both = both.withColumnRenamed("_id", id_col)
    both = with_likeness(both, "near_edited", "fingerprint", "edited_fingerprint")
    both = with_likeness(both, "near_next", "fingerprint", "_next_print")
    return both.select(
        id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
