"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of the lower-cased words of a text, with one blank between words and one end.
The tree's nodes are contexts of up to ``DEPTH`` symbols. A context is retained, with its suffixes,
if its next symbols diverge enough from those of the context one symbol shorter; every context that
occurs is tested. A symbol is scored in the state of the longest retained suffix of what stands
before it; the distribution of a state is smoothed with that of the next shorter one, down to the
uniform distribution.

Texts are read twice. First tasks count grams and words, and the counts are summed by a shuffle.
Contexts that share their last ``SHORT + 1`` symbols are in one bucket, so the tree grows there level
by level and never leaves the tasks; its size has no bound but the corpus. A gram's probability is
``a + b * p``, where ``p`` is that of the levels up to ``SHORT``, the only ones that are broadcast.
Then the most frequent grams and words, a bounded number of each, are scored from a broadcast; all
others of a text go to the tree's buckets, which return sums by text. Grams are stored and shuffled
in blocks: sorted, as differences, compressed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.llm.bpe import in_parts
from featlake.llm.common import crc32_of, giving_back, kept_by_worker, whole_text, written
from featlake.llm.words import Words, mixed

#: The longest context, so that a gram fits in one number, and the longest one that is broadcast.
DEPTH, SHORT = 7, 2
#: The smallest share of the corpus of a candidate (none), the least divergence (in nats, summed over its
#: occurrences), and the share of the corpus from which a word may be broadcast, and a fifth of it for a gram.
RAREST, DIVERGENCE, FREQUENT = 0.0, 5.0, 1e-7
#: The most grams and words that are broadcast.
MOST_GRAMS, MOST_WORDS = 4_000_000, 1_000_000
BLANK, END, SYMBOLS = 32, 10, 257
#: Distinct counts that a task holds before it passes them on, keys that it gathers before it sums them up or
#: passes them on, and bytes of training texts for each bucket of the tree.
HELD, GATHERED, TAKEN = 6_000_000, 4_000_000, 2_000_000
#: What a key or a block of them is: a gram or the hash of a word.
GRAM, WORD = 0, 1
_END_WORD = 2**64 - 1  # the key of the end in word counts; a word whose hash that is counts as an end


def symbol_stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each after ``DEPTH`` ends, and where each text's own symbols start."""
    last = np.ones(len(words.start), bool)
    last[:-1] = words.doc[1:] != words.doc[:-1]
    kept = words.inside.copy()
    kept[words.end[~last]] = True  # one blank between words
    upto = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
    own = np.diff(upto) + 1
    first = np.cumsum(own + DEPTH) - own
    out = np.full(int((own + DEPTH).sum()), END, np.uint8)
    inner = np.ones(len(out), bool)
    inner[(first[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    inner[first + own - 1] = False
    out[inner] = np.where(words.inside, words.data, np.uint8(BLANK))[kept]
    return out, first


def grams(stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each own symbol the gram that it ends, ``DEPTH + 1`` symbols in one number; counts per text."""
    code = np.ndarray((max(len(stream) - DEPTH, 0),), ">u8", stream if len(stream) else np.zeros(8, np.uint8), strides=(1,))
    own = np.diff(np.append(first, len(stream) + DEPTH)) - DEPTH
    # Pads are the DEPTH symbols before each text; codes start at stream position DEPTH.
    keep = np.ones(len(stream), bool)
    keep[(first[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    return code[keep[DEPTH:]].astype(np.uint64), own


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


class Counter:
    """Counts by number, in sorted arrays."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.gathered: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.gathered.append(keys)
        if sum(map(len, self.gathered)) > GATHERED:
            self.sum_up()

    def sum_up(self) -> None:
        if self.gathered:
            new, n = np.unique(np.concatenate(self.gathered), return_counts=True)
            self.gathered.clear()
            # Both are sorted: what is there is added to, the rest is put in its place, with less memory than a sort takes.
            at = np.searchsorted(self.keys, new)
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == new if len(self.keys) else np.zeros(len(new), bool)
            self.counts[at[there]] += n[there]
            at, new, n = at[~there], new[~there], n[~there]
            self.keys, self.counts = np.insert(self.keys, at, new), np.insert(self.counts, at, n)


def word_keys(words: Words) -> np.ndarray:
    """The hashes of all words, then an end for each text."""
    return np.concatenate([words.hashes(), np.full(words.n, _END_WORD, np.uint64)])


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * k)) - 1)


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of keys in a sorted array that is not empty, and whether they are there."""
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return i, sorted_keys[i] == keys


@dataclass
class Level:
    """Contexts of one length with totals, kinds of next symbols and whether retained; grams with counts. Sorted."""

    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray
    kept: np.ndarray
    grams: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray) -> "Level":
        heads = lambda x: np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        at = heads(grams)
        grams, counts = grams[at], np.add.reduceat(counts, at) if len(at) else counts
        ctx = grams >> np.uint64(8)
        at = heads(ctx)
        totals = np.add.reduceat(counts, at) if len(at) else counts
        return Level(ctx[at], totals, np.diff(np.append(at, len(ctx))), np.zeros(len(at), bool), grams, counts)

    def test(self, k: int, shorter: "Level", least: float) -> None:
        """Retain the contexts of ``k`` symbols that diverge from those one symbol shorter."""
        if not len(self.grams):
            return
        j = np.searchsorted(shorter.grams, self.grams & _mask(k))
        i = np.searchsorted(shorter.contexts, shorter.grams[j] >> np.uint64(8))
        own = np.repeat(self.totals, self.kinds)
        gain = self.counts * np.log(self.counts / own * (shorter.totals[i] / shorter.counts[j]))
        apart = np.add.reduceat(gain, np.cumsum(self.kinds) - self.kinds)
        self.kept |= (apart >= DIVERGENCE) & (self.totals >= least)

    def keep(self, contexts: np.ndarray) -> None:
        """Retain these contexts, all of which occur."""
        self.kept[np.searchsorted(self.contexts, contexts)] = True


def levels_of(grams: np.ndarray, counts: np.ndarray, first: int, last: int) -> list[Level]:
    """The levels from ``first`` to ``last`` of grams of at least ``last + 1`` symbols."""
    out = []
    for k in range(last, first - 1, -1):
        out.append(Level.of(grams & _mask(k + 1), counts))
        grams, counts = out[-1].grams, out[-1].counts
    return out[::-1]


def retain(levels: list[Level], first: int, shorter: Level | None, least: float) -> None:
    """Test the contexts of all levels; with a context come its suffixes in them."""
    for k, level in enumerate(levels, first):
        if k:
            level.test(k, levels[k - first - 1] if k > first else shorter, least)
        else:
            level.kept[:] = True
    for k in range(first + len(levels) - 1, first, -1):
        longer = levels[k - first]
        levels[k - first - 1].keep(longer.contexts[longer.kept] & _mask(k - 1))


def through(levels: list[Level], first: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a`` and ``b``: the last symbol of a gram has the probability ``a + b * p``, given ``p`` by the levels before.

    A state gives a symbol its count, and the next shorter state's probability as often as it has
    seen a new symbol.
    """
    a, b, active = np.zeros(len(codes)), np.ones(len(codes)), np.arange(len(codes))
    for k, level in enumerate(levels, first):
        if not len(level.contexts) or not len(active):
            break
        here = codes[active] & _mask(k + 1)
        i, found = _at(level.contexts, here >> np.uint64(8))
        found &= level.kept[i]
        active, here, i = active[found], here[found], i[found]
        j, seen = _at(level.grams, here)
        whole, kinds = level.totals[i] + level.kinds[i], level.kinds[i]
        a[active] = (np.where(seen, level.counts[j], 0) + kinds * a[active]) / whole
        b[active] *= kinds / whole
    return a, b


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, the first one sorted, in compressed bytes: differences, by places of value."""
    numbers = np.stack([np.diff(columns[0].astype("<u8"), prepend=np.uint64(0)), *[c.astype("<u8") for c in columns[1:]]])
    places = np.ascontiguousarray(numbers.view(np.uint8).reshape(*numbers.shape, 8).transpose(0, 2, 1))
    return numbers.shape[1].to_bytes(8, "little") + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def unpacked(block: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    raw = pa.decompress(block[8:], decompressed_size=8 * columns * n, codec="zstd", asbytes=True)
    out = np.array(np.frombuffer(raw, np.uint8).reshape(columns, 8, n).transpose(0, 2, 1), order="C").view("<u8")[..., 0]
    out[0] = np.cumsum(out[0])
    return out


def _blocks(kind: int, buckets: int, keys: np.ndarray, *others: np.ndarray) -> dict[str, pa.Array]:
    """Keys with what belongs to each, in a block for each bucket that has some: ``kind, bucket, block``."""
    order = np.argsort(keys)
    bucket = (mixed((keys >> np.uint64(8)) & _mask(SHORT + 1)) if kind == GRAM else keys)[order] % np.uint64(buckets)
    # Few buckets fit in 16 bits, which are sorted faster.
    order = order[(by := np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable"))]
    bucket, columns = bucket[by], [c[order] for c in (keys, *others)]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    ends = np.append(heads[1:], len(bucket))
    made = [packed(*[c[a:b] for c in columns]) for a, b in zip(heads, ends)]
    return {
        "kind": pa.array(np.full(len(made), kind, np.int32)), "bucket": pa.array(bucket[heads].astype(np.int32)),
        "block": pa.array(made, pa.binary()),
    }


def count_corpus(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of the grams and words of training rows, by bucket and kind, in one block each.

    ``total`` is the sum of the counts; ``low`` and ``low_n`` are the grams of ``SHORT + 1`` symbols.
    """

    def count(batches: Iterable[pa.RecordBatch]):
        counters = {GRAM: Counter(), WORD: Counter()}

        def passed_on():
            for kind, c in counters.items():
                c.sum_up()
                yield pa.RecordBatch.from_pydict(_blocks(kind, buckets, c.keys, c.counts))
                counters[kind] = Counter()

        for part in in_parts(batches, 0):
            words = Words(part.column(0))
            counters[GRAM].add(grams(*symbol_stream(words))[0])
            counters[WORD].add(word_keys(words))
            if sum(len(c.keys) for c in counters.values()) > HELD:
                yield from passed_on()
        yield from passed_on()

    def add_up(batches: Iterable[pa.RecordBatch]):
        for (bucket, kind), blocks in groupby(_listed(batches), lambda row: row[:2]):
            key, n = np.concatenate([unpacked(block, 2) for *_, block in blocks], axis=1)
            key, n = _summed(key, n.astype(np.int64))
            low, low_n = _summed(key & _mask(SHORT + 1), n) if kind == GRAM else (key[:0], n[:0])
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), "block": pa.array([packed(key, n)], pa.binary()),
                "total": [int(n.sum())], "kinds": [len(key)], "low": _one_list(low.view(np.int64)), "low_n": _one_list(low_n),
            })

    listed = rows.where("_train").select("_text").mapInArrow(giving_back(count), "kind int, bucket int, block binary")
    placed = listed.select("bucket", "kind", "block").repartition("bucket").sortWithinPartitions("bucket", "kind")
    schema = "bucket int, kind int, block binary, total long, kinds long, low array<long>, low_n array<long>"
    return written(placed.mapInArrow(giving_back(add_up), schema), "suffix-tree")


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def _grown(keys: np.ndarray, n: np.ndarray, shorter: Level, least: float) -> list[Level]:
    """The long levels of a bucket."""
    levels = levels_of(keys, n, SHORT + 1, DEPTH)
    retain(levels, SHORT + 1, shorter, least)
    return levels


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)))


@dataclass
class Tree:
    """Counts as ``count_corpus`` stores them, the number of buckets, short levels and what they are made with.

    ``least_often`` has for each kind the steps of counts from which its keys are broadcast.
    """

    table: DataFrame
    buckets: int
    short: list[Level]
    least: float
    least_often: dict[int, int]


def _step(n: np.ndarray | float) -> np.ndarray:
    """Counts in steps of a quarter of a power of two."""
    return np.floor(4 * np.log2(n)).astype(np.int64)


def grow(rows: DataFrame) -> Tree:
    """The tree of training rows."""
    spark = rows.sparkSession
    size = rows.where("_train").agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    buckets = 1 + size // TAKEN
    table = count_corpus(rows, buckets)
    low = table.where(f"kind = {GRAM}").select(F.explode(F.arrays_zip("low", "low_n")).alias("g"))
    low = low.groupBy("g.low").agg(F.sum("g.low_n").alias("n")).toArrow()
    short = levels_of(low.column("low").to_numpy().astype(np.uint64), low.column("n").to_numpy(), 0, SHORT)
    size = int(short[0].counts.sum())
    least = RAREST * size
    retain(short, 0, None, least)
    shared = spark.sparkContext.broadcast(short[SHORT])

    # The ends of retained contexts (kind -1), and how many keys of each kind there are at each step of counts.
    def survey(batches: Iterable[pa.RecordBatch]):
        for kind, block in _listed(batches):
            key, n = unpacked(block, 2)
            n = n.astype(np.int64)
            step, many = np.unique(_step(n), return_counts=True)
            below = np.empty(0, np.int64)
            if kind == GRAM:
                levels = _grown(key, n, shared.value, least)
                below = np.unique(levels[0].contexts[levels[0].kept] & _mask(SHORT)).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "kind": np.repeat(np.array([-1, kind], np.int32), [len(below), len(step)]),
                "value": np.concatenate([below, step]), "n": np.concatenate([np.zeros(len(below), np.int64), many]),
            })

    found = table.select("kind", "block").mapInArrow(giving_back(survey), "kind int, value long, n long")
    found = found.groupBy("kind", "value").agg(F.sum("n").alias("n")).toArrow()
    kind, value, n = (found.column(c).to_numpy() for c in range(3))
    # With the longer contexts come their suffixes in the short levels.
    short[SHORT].keep(value[kind == -1].astype(np.uint64))
    for k in range(SHORT, 0, -1):
        short[k - 1].keep(short[k].contexts[short[k].kept] & _mask(k - 1))
    n_all = table.where(f"kind = {WORD}").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    least_often = {}
    for a_kind, bar, most in ((GRAM, FREQUENT / 5 * size, MOST_GRAMS), (WORD, FREQUENT * n_all, MOST_WORDS)):
        steps, many = value[kind == a_kind], n[kind == a_kind]
        order = np.argsort(-steps)
        fits = steps[order][np.cumsum(many[order]) <= most]
        fits = fits[fits >= _step(max(bar, 1.0))]
        least_often[a_kind] = int(fits.min()) if len(fits) else 1 << 30
    return Tree(table, buckets, short, least, least_often)


def _logs(short: list[Level], codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = through(short, 0, codes)
    return np.log10(a + b * (p + q / SYMBOLS))


def usual_keys(tree: Tree, rest: float) -> list[tuple[int, bytes, bytes]]:
    """For each bucket the kind of its most frequent keys, these in a block, and the logarithms of their probabilities."""
    shared = tree.table.sparkSession.sparkContext.broadcast(tree.short)
    least, least_often = tree.least, tree.least_often

    def work(batches: Iterable[pa.RecordBatch]):
        for kind, block in _listed(batches):
            key, n = unpacked(block, 2)
            n = n.astype(np.int64)
            often = _step(n) >= least_often[kind]
            if not often.any():
                continue
            usual = key[often]
            if kind == GRAM:
                logs = _logs(shared.value, usual, *through(_grown(key, n, shared.value[SHORT], least), SHORT + 1, usual))
            else:
                logs = np.log10((n[often] + 0.5) / rest)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([kind], pa.int32()), "block": pa.array([packed(usual)], pa.binary()), "logs": pa.array([logs.tobytes()], pa.binary()),
            })

    made = tree.table.select("kind", "block").mapInArrow(giving_back(work), "kind int, block binary, logs binary").toArrow()
    return list(zip(*(made.column(c).to_pylist() for c in range(3))))


class Logs:
    """Logarithms by key, found by the first bits of a mixed key."""

    def __init__(self, blocks: list[tuple[bytes, bytes]]):
        keys = np.concatenate([np.empty(0, np.uint64), *[unpacked(block, 1)[0] for block, _ in blocks]])
        logs = np.concatenate([np.empty(0), *[np.frombuffer(log) for _, log in blocks]])
        bits = max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        keys = mixed(keys)
        order = np.argsort(keys)
        # One more for keys beyond the last: it equals none of them, since its first bits are others.
        order = np.append(order, order[-1:])
        self.keys, self.logs = keys[order], logs[order]
        many = np.bincount((self.keys[: len(keys)] >> self.shift).view(np.int64), minlength=1 << bits)
        self.first = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each key, zero if it has none, and whether it has one."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        keys = mixed(keys)
        slot = (keys >> self.shift).view(np.int64)
        at = self.first[slot]
        found = self.keys[at] == keys
        left = np.flatnonzero(~found)
        end = self.first[slot[left] + 1]
        while len(left):
            at[left] += 1
            found[left] = hit = (at[left] < end) & (self.keys[np.minimum(at[left], len(self.keys) - 1)] == keys[left])
            more = ~hit & (at[left] < end)
            left, end = left[more], end[more]
        # Where nothing was found, the place is past the end of the slot.
        return np.where(found, self.logs[np.minimum(at, len(self.keys) - 1)], 0.0), found


def pair_scores(tree: Tree, pairs: DataFrame, rest: float) -> DataFrame:
    """``_row, _rare, _rare_seen, _rare_score``: sums, by bucket, over the words and grams in ``bucket, kind, block`` (key, row)."""
    least = tree.least
    shared = pairs.sparkSession.sparkContext.broadcast(tree.short)

    def priced(kind: int, key: np.ndarray, n: np.ndarray, held: list[np.ndarray], levels: list[Level] | None) -> pa.RecordBatch:
        code, row = np.concatenate(held, axis=1)
        code, of_code = np.unique(code, return_inverse=True)
        seen = np.zeros(len(code), bool)
        if kind == GRAM:
            log = _logs(shared.value, code, *through(levels, SHORT + 1, code))
        else:
            times = np.zeros(len(code))
            if len(key):
                i, seen = _at(key, code)
                times[seen] = n[i[seen]]
            log = np.log10((times + 0.5) / rest)
        rows, of_row = np.unique(row, return_inverse=True)
        sums = np.bincount(of_row, weights=log[of_code], minlength=len(rows))
        return pa.RecordBatch.from_pydict({
            "_row": rows.astype(np.int64), "_rare": sums * (kind == WORD),
            "_rare_seen": np.bincount(of_row[seen[of_code]], minlength=len(rows)).astype(np.int64), "_rare_score": sums * (kind == GRAM),
        })

    def work(batches: Iterable[pa.RecordBatch]):
        for (_, kind), blocks in groupby(_listed(batches), lambda row: row[:2]):
            key, n, levels = np.empty(0, np.uint64), np.empty(0, np.int64), None
            held, many = [], 0
            for _, _, of_text, block in blocks:
                if not of_text:
                    key, n = unpacked(block, 2)
                    n = n.astype(np.int64)
                    continue
                if kind == GRAM and levels is None:
                    levels = _grown(key, n, shared.value[SHORT], least)
                held.append(unpacked(block, 2))
                many += held[-1].shape[1]
                if many > GATHERED:
                    yield priced(kind, key, n, held, levels)
                    held, many = [], 0
            if held:
                yield priced(kind, key, n, held, levels)

    both = tree.table.select("bucket", "kind", F.lit(0).alias("of_text"), "block")
    both = both.unionByName(pairs.select("bucket", "kind", F.lit(1).alias("of_text"), "block")).repartition("bucket")
    schema = "_row long, _rare double, _rare_seen long, _rare_score double"
    return both.sortWithinPartitions("bucket", "kind", "of_text").mapInArrow(giving_back(work), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return crc32_of(F.col(id_col)) % 5 == 1


def score_texts(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learned from the rows that ``train`` selects, null texts counting as empty. ``n_tokens`` are the
    words and one end. ``base_score`` is that of smoothed word counts, ``score`` that of the tree.
    Rows that repeat an id are rows of their own, also in training. Without training rows every
    word and the end have the probability one in ``base_score``, and symbols are equally likely.
    """
    rows = docs.select(whole_text(text_col).alias("_text"), F.col(id_col).alias("_id"), train.alias("_train"))
    tree = grow(rows)
    buckets = tree.buckets
    counted = tree.table.where(f"kind = {WORD}").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0)))
    n_all, vocabulary = counted.first()
    rest = n_all + 0.5 * (vocabulary + 1)
    shared = docs.sparkSession.sparkContext.broadcast(usual_keys(tree, rest))
    id_type = rows.schema["_id"].dataType.simpleString()
    kept = ("suffix-tree", uuid.uuid4().hex)

    def work(batches: Iterable[pa.RecordBatch]):
        def logs():
            return [Logs([(block, log) for k, block, log in shared.value if k == kind]) for kind in (GRAM, WORD)]

        gram_logs, word_logs = kept_by_worker(kept, logs)
        row = TaskContext.get().partitionId() << 33
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}

        def passed_on():
            for kind, some in held.items():
                if some:
                    made = _blocks(kind, buckets, *map(np.concatenate, zip(*some)))
                    made["kind"] = pa.array(np.full(len(made["block"]), 1 + kind, np.int32))
                    yield pa.RecordBatch.from_pydict({n: pa.nulls(len(made["block"]), t) for n, t in types.items()} | made)
                    some.clear()

        def scored(kind: int, usual: Logs, keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Sums and numbers, by text, of the keys that are broadcast; the others are held."""
            log, found = usual(keys)
            held[kind].append((keys[~found], (row + of[~found]).astype(np.uint64)))
            return np.bincount(of, weights=log, minlength=n).astype(float), np.bincount(of[found], minlength=n)

        for part in in_parts(batches, 0):
            words = Words(part.column(0))
            n = words.n
            codes, own = grams(*symbol_stream(words))
            score, _ = scored(GRAM, gram_logs, codes, np.repeat(np.arange(n), own))
            base, seen = scored(WORD, word_logs, word_keys(words), np.concatenate([words.doc, np.arange(n)]))
            made = pa.RecordBatch.from_pydict({
                "_row": row + np.arange(n), "_id": part.column(1), "_train": part.column(2), "n_tokens": words.count + 1,
                "_seen": seen, "_sum": base, "score": score,
                "kind": np.zeros(n, np.int32), "bucket": pa.nulls(n, pa.int32()), "block": pa.nulls(n, pa.binary()),
            })
            types = dict(zip(made.schema.names[:-3], made.schema.types))
            yield made
            row += n
            if sum(len(keys) for some in held.values() for keys, _ in some) > GATHERED:
                yield from passed_on()
        yield from passed_on()

    # Rows are of kind 0, blocks of grams and words of kinds 1 and 2.
    stored = written(rows.mapInArrow(
        giving_back(work, kept), f"_row long, _id {id_type}, _train boolean, n_tokens long, _seen long, _sum double, score double, "
        "kind int, bucket int, block binary",
    ), "scored", "kind")
    rare = pair_scores(tree, stored.where("kind > 0").select("bucket", (F.col("kind") - 1).alias("kind"), "block"), rest)
    sums = rare.groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("_rare", "_rare_seen", "_rare_score")])
    zero = F.lit(0)
    return stored.where("kind = 0").join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), "n_tokens",
        (F.col("_seen") + F.coalesce("_rare_seen", zero)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("_sum") + F.coalesce("_rare", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_rare_score", F.lit(0.0))).alias("score"),
    )
