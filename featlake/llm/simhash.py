"""SimHash near-duplicates: a grid join of segment bit counts, then an exact check.

A fingerprint's 64 bits are 32 segments of two. The number of bits set in each is its embedding, and
the Manhattan distance of two embeddings is at most the number of differing bits. Written in unary,
two bits a segment, the embedding is again a 64-bit number, and the distance is the popcount of an
XOR.

The grid: segments are dealt to ``g`` groups, and the embedding's part in a choice of ``g - most``
groups is a cell. A distance of at most ``most`` is zero in all but ``most`` groups, so linked
fingerprints share the cell of some choice. Within a cell, pairs are ruled out by the distance and
then compared bit by bit. A cell returns a spanning forest of its links, never all pairs; a crowded
cell is dealt out in parts and pairs of parts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import bounded_broadcast, whole_text, written
from featlake.llm.components import connected

#: Words of a shingle, seed of its hash, differing bits of a link.
WORDS, SEED, MOST = 4, 42, 4
#: Bits of a segment and its bits that the least of two segments' cells tell apart, on average.
SEGMENT, TOLD = 2, 0.7075
#: Fingerprints of a cell that one task takes; a larger cell is dealt out in parts.
PART = 4096
#: One in so many fingerprints is looked at to find crowded cells. It decides on parts, never on links.
LOOKED_AT = 64
#: Bytes of a text that are worked on at once.
LOT = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_lots(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lots, cut at white space, so that long texts need little memory."""
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + LOT)
        end = cut.start() if cut else len(text)
        yield text[start:end].split()  # bytes split at these six characters, and only ASCII is lower-cased
        start = end


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each run of ``WORDS`` words, joined by blanks."""
    import xxhash

    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = len(words) - WORDS + 1
    first, last = (ends - lengths)[:n].tolist(), ends[WORDS - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)


def fingerprint(text: bytes) -> int:
    """A bit is set if more than half of the shingles' hashes have it; zero without words."""
    import xxhash

    total, ones, held = 0, np.zeros(64, np.int64), []
    for words in word_lots(text.lower()):
        words = held + words
        if len(words) >= WORDS:
            hashes = shingle_hashes(words)
            total += len(hashes)
            ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        held = words[-(WORDS - 1) :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > total).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, print`` of every row: the fingerprint of its whole text as a 64-bit number."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["_id", "print"])

    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(work, f"_id {id_type}, print long")


# --- The grid -------------------------------------------------------------------------------------


def embedded(prints: np.ndarray) -> np.ndarray:
    """The bit counts of all segments, in unary: 0, 1 and 2 are 00, 01 and 11."""
    low = np.uint64(0x5555555555555555)
    next_bit = prints >> np.uint64(1)
    return ((prints | next_bit) & low) | ((prints & next_bit & low) << np.uint64(1))


def groups_for(n: int, most: int) -> int:
    """Groups of segments for so many fingerprints: cells of random ones stay under some 500."""
    groups = most + 2
    while groups < most + 6 and n > 512 * 2 ** (64 * TOLD * (groups - most) / groups):
        groups += 1
    return groups


def masks(groups: int, most: int) -> np.ndarray:
    """For each choice of ``groups - most`` groups of segments the bits of their embedding."""
    segments = 64 // SEGMENT
    cuts = [segments * g // groups * SEGMENT for g in range(groups + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return np.array([sum(choice) for choice in itertools.combinations(each, groups - most)], np.uint64)


def in_cells(prints: DataFrame, groups: int, most: int) -> DataFrame:
    """``choice, cell, print``: a row for each choice of groups."""
    chosen = masks(groups, most)

    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            p = batch.column(0).to_numpy()
            e = embedded(p.view(np.uint64))
            for k, mask in enumerate(chosen):
                yield pa.RecordBatch.from_pydict(
                    {"choice": np.full(len(p), k, np.int32), "cell": (e & mask).view(np.int64), "print": p}
                )

    return prints.select("print").mapInArrow(work, "choice int, cell long, print long")


def dealt(cells: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows of blocks ``choice, cell, i, j``: a cell, or a part (``i = j``) or pair of parts of a crowded one."""
    rows = cells.join(crowded, ["choice", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("print"), "parts").cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(
        "choice", "cell", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).alias("side"),
        "print",
    )


def forest(prints: np.ndarray, end: np.ndarray, across: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within blocks: places ``a, b``, fewer than there are rows.

    ``end`` is the place after the block of each row; where ``across``, only pairs of two sides count.
    Rows are compared with the next, the one after that and so on, unless they are connected by then.
    """
    counts, root = embedded(prints), np.arange(len(prints))
    found: list[tuple[int, int]] = []
    rows, step = np.arange(len(prints)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < end[rows]]
        use = root[rows] != root[rows + step]
        use &= ~across[rows] | (side[rows] != side[rows + step])
        a = rows[use]
        a = a[np.bitwise_count(counts[a] ^ counts[a + step]) <= most]
        a = a[np.bitwise_count(prints[a] ^ prints[a + step]) <= most]
        for x in a.tolist():
            tops = []
            for y in (x, x + step):
                while root[y] != y:
                    y = root[y]
                tops.append(y)
            if tops[0] != tops[1]:
                root[max(tops)] = min(tops)
                found.append((x, x + step))
        while len(a) and (root[root] != root).any():
            root = root[root]
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def links_in_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """Links ``a, b`` that connect the linked fingerprints of every block."""
    keys = ["choice", "cell", "i", "j"]

    def linked(t: pa.Table, starts: np.ndarray):
        sizes = np.diff(starts)
        end = np.repeat(starts[1:], sizes)
        p, i, j = (t.column(c).to_numpy()[: starts[-1]] for c in ("print", "i", "j"))
        side = t.column("side").to_numpy()[: starts[-1]]
        a, b = forest(p.view(np.uint64), end, i != j, side, most)
        yield pa.RecordBatch.from_pydict({"a": p[a], "b": p[b]})

    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        if t.num_rows:
            new[1:] = np.logical_or.reduce([(v := t.column(c).to_numpy())[1:] != v[:-1] for c in keys])
        return np.append(np.flatnonzero(new), t.num_rows)

    def work(batches: Iterable[pa.RecordBatch]):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*rest, batch])
            starts = starts_of(whole)
            if len(starts) > 2:  # the last block may go on in the next batch
                yield from linked(whole, starts[:-1])
                rest = whole.slice(int(starts[-2])).combine_chunks().to_batches()
            else:
                rest = [*rest, batch]
        if rest:
            whole = pa.Table.from_batches(rest)
            yield from linked(whole, starts_of(whole))

    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys, "side", "print")
    return ordered.mapInArrow(work, "a long, b long").distinct()


def close_links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``print``, a stored table) that connect all that are linked."""
    groups = groups_for(prints.count(), most)
    looked_at = prints.where(F.pmod(F.xxhash64(F.lit(1), "print"), F.lit(LOOKED_AT)) == 0)
    size = F.count("*") * LOOKED_AT
    crowded = in_cells(looked_at, groups, most).groupBy("choice", "cell").agg(F.ceil(size / PART).cast("int").alias("parts"))
    crowded = bounded_broadcast(written(crowded.where("parts > 1"), "crowded"))
    return written(links_in_blocks(dealt(in_cells(prints, groups, most), crowded), most), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Per row: ``id_col, fingerprint`` (16 hexadecimal digits) ``, component_id``.

    Words are lower-cased from A to Z; runs of four are hashed, repeats included, and a text with
    fewer words is one run. A null or empty text, or one of white space, has the fingerprint zero,
    which is linked like any other. Fingerprints are linked at ``most`` or fewer differing bits;
    ``component_id`` is the smallest id that links reach. A null id is not counted unless a
    component has no other. Rows that repeat an id are rows of their own; other columns are not
    read. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = written(rows.groupBy("print").agg(F.min("_id").alias("rep")), "prints")
    labels = connected(close_links(prints, most))
    whole = prints.join(labels, prints["print"] == labels["node"], "left").select(
        "print", "rep", F.coalesce("label", "print").alias("label")
    )
    smallest = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = written(whole.join(smallest, "label").select("print", "component_id"), "components")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return rows.join(found, "print", "left").select(F.col("_id").alias(id_col), digits.alias("fingerprint"), "component_id")
