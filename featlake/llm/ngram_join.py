"""Similarity join of documents by the Jaccard overlap of their word shingles, with signature trees.

Sets that are equal are one node. Nodes can be similar only if they share a token among the first of
each, in any order of all tokens; the order used puts tokens that many documents have last. So each
token is a block of the nodes that have it there, and blocks cover all links. Blocks with the same
first node are put together: copies share many tokens, and meet once.

Inside a block the nodes are the leaves of a signature tree: a tree node holds the OR-combined
bitmaps and the size range of what is below it. Two tree nodes are traversed together, from the
pair of the root with itself; a pair is left out if no set of one can overlap enough with one of the
other, by sizes or by common bits, or if everything below both is one component already. Pairs of
sets that remain are verified on their whole sets.

Before that, each node is compared with the first of its block. Groups of near copies become
components by this, so the traversal finds little left to do in them, and nothing lists all pairs
of a group. A group whose members are not similar to the first still has very many pairs; so each
member is verified with its likeliest few before the traversal is repeated, for all pairs that are
then between components. Large blocks are dealt out in parts, and pairs of parts, to further tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.bpe import in_parts
from featlake.llm.common import bounded_broadcast, giving_back, whole_text, written
from featlake.llm.components import connected
from featlake.llm.words import Words, mixed

WORDS, PERCENT = 5, 75
#: Bits of a set's signature, leaves of a tree node, children of a tree node.
BITS, LEAF, FAN = 2048, 32, 8
#: Cells that tell frequent tokens, a fixed size: errors change the order of tokens, never the result.
CELLS = 1 << 22
#: Members of a block that one task takes; a larger block is dealt out in parts.
PART = 4096
#: The likeliest pairs of a member of a block that are verified before all that are left.
FEW = 4
_HELD = 1 << 20  # tokens of a lot, or pairs of a block


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as sorted 64-bit hashes, one text after another, and their numbers."""
    words = Words(texts)
    h = words.hashes()
    n, doc = len(h), words.doc
    first = np.cumsum(words.count) - words.count
    place = np.arange(n) - first[doc]
    left = words.count[doc] - place  # words from here to the text's end
    code = np.zeros(n, np.uint64)
    for j in range(WORDS):
        step = np.zeros(n, np.uint64)
        inside = left > j
        step[inside] = h[np.flatnonzero(inside) + j]
        code = mixed(code + step + np.uint64(j + 1)) if j == 0 else np.where(inside, mixed((code ^ np.uint64(j)) + mixed(step)), code)
    # A text with fewer words is one shingle; others have those with all their words.
    use = (left >= WORDS) | ((place == 0) & (words.count[doc] < WORDS))
    code, doc = code[use], doc[use]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return code[keep], np.bincount(doc[keep], minlength=words.n)


def sums_of_sets(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell sets apart, whatever the order of their tokens."""
    upto = np.cumsum(counts)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tokens ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[upto] - sums[upto - counts]).view(np.int64))
    return out[0], out[1]


def least_overlap(a, b, percent: int):
    """The smallest common part that makes sets of these sizes similar."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_lengths(counts: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens of a set are enough to meet every similar set, whatever its size."""
    return np.where(counts > 0, counts - -(-percent * counts // 100) + 1, 0)


def signatures(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bitmap of ``BITS`` bits per set, as bytes."""
    bits = np.zeros((len(counts), BITS), bool)
    bits[np.repeat(np.arange(len(counts)), counts), (tokens >> np.uint64(20)) % np.uint64(BITS)] = True
    return np.packbits(bits, axis=1)


def wide_signature(tokens: np.ndarray) -> bytes:
    """A larger bitmap for a set that would fill one of ``BITS``, of a power of two times its size."""
    if len(tokens) <= BITS // 3:
        return b""
    width = BITS << int(np.ceil(np.log2(3 * len(tokens) / BITS)))
    bits = np.zeros(width, bool)
    bits[(tokens >> np.uint64(20)) % np.uint64(width)] = True
    return np.packbits(bits).tobytes()


def wide_overlap(a: bytes, b: bytes, n: int, m: int) -> int:
    """The largest common part of two sets by their wide signatures, compared at the smaller width."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    width = min(len(x), len(y))
    # Widths divide each other, so a wider bitmap folds onto a narrower one.
    x, y = (np.bitwise_or.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
    return int(ones(x & y)) + min(n - int(ones(x)), m - int(ones(y)))


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def ones(bits: np.ndarray) -> np.ndarray:
    """The number of set bits of each row of bytes."""
    return _ONES[np.ascontiguousarray(bits).view(np.uint16)].sum(axis=-1, dtype=np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the length of ``keys``."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


# --- What is read from the texts ------------------------------------------------------------------


def survey(rows: DataFrame) -> DataFrame:
    """One pass over all texts: per row ``_id, n, f1, f2``; and cells of frequent tokens: ``cell, hits``.

    Tokens are counted in lots of about a million, and those that a lot has more than once are reported.
    A token in more documents than there are lots is reported by some.
    """
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]):
        held: list[np.ndarray] = []

        def passed_on():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            yield pa.RecordBatch.from_pydict({
                "_id": pa.nulls(int(many.sum()), kind), "n": pa.nulls(int(many.sum()), pa.int64()),
                "f1": pa.nulls(int(many.sum()), pa.int64()), "f2": pa.nulls(int(many.sum()), pa.int64()),
                "cell": (keys[many] % np.uint64(CELLS)).astype(np.int32), "hits": n[many],
            })
            held.clear()

        for part in in_parts(batches, 0):
            kind = part.column(1).type
            tokens, counts = shingle_sets(part.column(0))
            f1, f2 = sums_of_sets(tokens, counts)
            nothing = pa.nulls(len(counts), pa.int32()), pa.nulls(len(counts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(1), *map(pa.array, (counts, f1, f2)), *nothing], names=["_id", "n", "f1", "f2", "cell", "hits"]
            )
            held.append(tokens)
            if sum(map(len, held)) > _HELD:
                yield from passed_on()
        if held:
            yield from passed_on()

    return rows.select("_text", "_id").mapInArrow(giving_back(work), f"_id {id_type}, n long, f1 long, f2 long, cell int, hits long")


def frequency_classes(surveyed: DataFrame) -> np.ndarray:
    """Per cell the binary logarithm of its hits: ``CELLS`` bytes, whatever the size of the corpus."""
    hits = surveyed.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("hits").alias("hits"))
    table = hits.select("cell", F.floor(F.log2("hits")).cast("byte").alias("class")).toArrow()
    classes = np.zeros(CELLS, np.uint8)
    classes[table.column("cell").to_numpy()] = table.column("class").to_numpy()
    return classes


def nodes_of(rows: DataFrame, classes, percent: int) -> DataFrame:
    """One row per distinct set: ``node, n, f1, f2, rep`` (smallest id) ``, prefix, bits, wide``.

    ``prefix`` are its first tokens in the order of frequency class and hash.
    """
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]):
        for part in in_parts(batches, 0):
            tokens, counts = shingle_sets(part.column(0))
            f1, f2 = sums_of_sets(tokens, counts)
            doc = np.repeat(np.arange(len(counts)), counts)
            rank = classes.value[(tokens % np.uint64(CELLS)).astype(np.int64)]
            # Tokens are sorted by hash inside a set, so a stable sort by class is enough.
            order = np.lexsort((rank, doc))
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
            lengths = prefix_lengths(counts, percent)
            some = tokens[order][place < lengths[doc]].view(np.int64)
            at = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            bits = pa.array([b.tobytes() for b in signatures(tokens, counts)], pa.binary())
            wide = [wide_signature(x) for x in np.split(tokens, np.cumsum(counts)[:-1])]
            lists = [pa.ListArray.from_arrays(at, pa.array(some)), bits, pa.array(wide, pa.binary())]
            made = [part.column(1), *map(pa.array, (counts, f1, f2)), *lists]
            batch = pa.RecordBatch.from_arrays(made, names=["_id", "n", "f1", "f2", "prefix", "bits", "wide"])
            yield batch.filter(pa.array(counts > 0))

    made = rows.select("_text", "_id").mapInArrow(giving_back(work), f"_id {id_type}, n long, f1 long, f2 long, prefix array<long>, bits binary, wide binary")
    one = made.groupBy("n", "f1", "f2").agg(
        F.min("_id").alias("rep"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"),
        F.any_value("wide").alias("wide"),
    )
    return written(one.withColumn("node", F.monotonically_increasing_id()), "nodes")


def sets_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, tokens`` for the nodes in ``wanted`` (``node``): whole sets, as sorted 64-bit numbers.

    Texts are read once more; a filter of fixed size drops most rows whose set is not wanted before
    their sets are moved, and the join drops the rest.
    """
    chosen = nodes.select("node", "n", "f1", "f2").join(wanted, "node", "left_semi")
    cells = chosen.select(F.pmod("f1", F.lit(CELLS)).cast("int").alias("cell")).distinct().toArrow()
    marks = np.zeros(CELLS, bool)
    marks[cells.column("cell").to_numpy()] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def work(batches: Iterable[pa.RecordBatch]):
        marks = np.unpackbits(shared.value).view(bool)
        for part in in_parts(batches, 0):
            tokens, counts = shingle_sets(part.column(0))
            f1, f2 = sums_of_sets(tokens, counts)
            ends = np.cumsum(counts)
            which = np.flatnonzero(marks[f1 % CELLS] & (counts > 0))
            data = [tokens[ends[i] - counts[i] : ends[i]].tobytes() for i in which.tolist()]
            yield pa.RecordBatch.from_pydict(
                {"n": counts[which], "f1": f1[which], "f2": f2[which], "tokens": pa.array(data, pa.binary())}
            )

    found = rows.select("_text", "_id").mapInArrow(giving_back(work), "n long, f1 long, f2 long, tokens binary")
    one = found.groupBy("n", "f1", "f2").agg(F.any_value("tokens").alias("tokens"))
    return written(one.join(chosen, ["n", "f1", "f2"]).select("node", "tokens"), "sets")


# --- Pairs of nodes -------------------------------------------------------------------------------


def members_of(nodes: DataFrame, classes, parted_only: bool = False) -> DataFrame:
    """One row per node and token of its prefix: ``token, part, node``.

    The rows of a frequent token are dealt out in parts, in proportion to the frequency of its cell.
    """

    def work(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            lists = b.column("prefix")
            token = lists.flatten().to_numpy()
            node = np.repeat(b.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()))
            rank = classes.value[(token.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)].astype(np.int64)
            parts = 1 << np.maximum(rank - PART.bit_length() + 1, 0)
            part = (mixed(node.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
            use = parts > 1 if parted_only else slice(None)
            yield pa.RecordBatch.from_pydict({"token": token[use], "part": part[use], "node": node[use]})

    return nodes.select("node", "prefix").mapInArrow(giving_back(work), "token long, part int, node long")


def first_of_blocks(members: DataFrame) -> DataFrame:
    """Each further member of a block with its first: ``token, a, b``. ``members``: ``token, part, node``.

    Rows of a block follow each other and only its first is remembered, so a block may have any size.
    """

    def work(batches: Iterable[pa.RecordBatch]):
        token = part = head = None
        for b in batches:
            if not b.num_rows:
                continue
            t, p, node = (b.column(c).to_numpy() for c in ("token", "part", "node"))
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
            new[0] = t[0] != token or p[0] != part
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            heads = np.where(at >= 0, node[at], -1 if head is None else head)
            token, part, head = t[-1], p[-1], heads[-1]
            yield pa.RecordBatch.from_pydict({"token": t[~new], "a": heads[~new], "b": node[~new]})

    ordered = members.repartition("token", "part").sortWithinPartitions("token", "part", "node")
    return ordered.mapInArrow(giving_back(work), "token long, a long, b long")


class Tree:
    """A signature tree over the members of a block, ordered by component and size.

    ``levels[0]`` are the members; a node of a higher level covers ``LEAF`` members or ``FAN`` nodes.
    Each level has bitmaps, the smallest and largest size, the largest number of tokens beyond the
    bits of a set, and the component, or -1 where there are several.
    """

    def __init__(self, levels: list[tuple[np.ndarray, ...]]):
        self.levels = levels

    @staticmethod
    def leaves(n: np.ndarray, comp: np.ndarray, bits: np.ndarray) -> Tree:
        return Tree([(bits, n, n, n - ones(bits), comp)])

    def grown(self) -> Tree:
        """With all levels up to a root."""
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra, comp = self.levels[-1]
            cuts = np.arange(0, len(low), step)
            one = np.minimum.reduceat(comp, cuts)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                np.maximum.reduceat(extra, cuts), np.where(one == np.maximum.reduceat(comp, cuts), one, -1),
            ))
            step = FAN
        return self

    def open_pairs(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of these node pairs may have similar sets below them that are not yet connected."""
        bits, low, high, extra, comp = self.levels[level]
        good = (comp[a] != comp[b]) | (comp[a] < 0)
        good &= (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        a, b = a[good], b[good]
        # Tokens in common are in common bits: one for each, and those beyond the bits of a set.
        most = np.empty(len(a), np.int64)
        for i in range(0, len(a), 4096):
            most[i : i + 4096] = ones(bits[a[i : i + 4096]] & bits[b[i : i + 4096]])
        most = np.minimum(most + np.minimum(extra[a], extra[b]), np.minimum(high[a], high[b]))
        good[good] = most >= least_overlap(low[a], low[b], percent)
        return good

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The share of common bits of members, from 0 to 1."""
        bits, out = self.levels[0][0], np.empty(len(a))
        for i in range(0, len(a), 4096):
            x, y = bits[a[i : i + 4096]], bits[b[i : i + 4096]]
            out[i : i + 4096] = ones(x & y) / np.maximum(ones(x | y), 1)
        return out

    def pairs(self, percent: int, across: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members that may be similar and are not connected; only pairs over ``across`` if that is given."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            good = self.open_pairs(level, a, b, percent) if level else np.ones(len(a), bool)
            a, b = a[good], b[good]
            if level == 0:
                good = (a < b) & ((a < across) & (b >= across) if across else True)
                a, b = a[good], b[good]
                good = self.open_pairs(0, a, b, percent)
                if good.any():
                    yield a[good], b[good]
                continue
            step, size = (LEAF if level == 1 else FAN), len(self.levels[level - 1][1])
            for i in range(0, len(a), 256):
                x = (a[i : i + 256, None] * step + np.arange(step))[:, :, None] + np.zeros(step, np.int64)
                y = (b[i : i + 256, None] * step + np.arange(step))[:, None, :] + np.zeros((step, 1), np.int64)
                keep = (x <= y) & (x < size) & (y < size)
                todo.append((level - 1, x[keep], y[keep]))


def likeliest(a: np.ndarray, b: np.ndarray, like: np.ndarray, few: int) -> np.ndarray:
    """Which pairs are among the ``few`` likeliest of one of their members."""
    end, pair = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((pair, -like[pair], end))
    cuts = _runs(end[order])
    nth = np.arange(len(order)) - np.repeat(cuts[:-1], np.diff(cuts))
    keep = np.zeros(len(a), bool)
    keep[pair[order[nth < few]]] = True
    return keep


def tree_pairs(members: DataFrame, percent: int, few: int = 0) -> DataFrame:
    """Pairs of a block's members that may be similar and are in different components: ``a, b``.

    ``members``: ``head, i, j, side, node, n, comp, bits``, where a block is ``head, i, j``. Blocks
    of two parts (``i < j``) look for pairs across their sides only. With ``few`` only pairs that are
    among so many likeliest of a member in a block; so every member that has a pair is in one.
    """

    def block(node, n, comp, bits, side) -> np.ndarray:
        split = int((side == 0).sum()) if len(side) and side.max() != side.min() else 0
        order = np.lexsort((n, comp, side))
        tree = Tree.leaves(n[order], comp[order], bits[order]).grown()
        a = b = np.empty(0, np.int64)
        like, held, many = np.empty(0), [], 0

        def reduced():
            x, y = (np.concatenate([v, *(h[k] for h in held)]) for k, v in enumerate((a, b)))
            z = np.concatenate([like, *(tree.likeness(*h) if few else np.zeros(len(h[0])) for h in held)])
            keep = likeliest(x, y, z, few) if few else slice(None)
            return x[keep], y[keep], z[keep]

        for found in tree.pairs(percent, split):
            held.append(found)
            many += len(found[0])
            if few and many > _HELD:
                a, b, like = reduced()
                held, many = [], 0
        a, b, _ = reduced()
        return np.stack([node[order][a], node[order][b]], axis=1)

    def work(batches: Iterable[pa.RecordBatch]):
        rest = None
        for b in batches:
            whole = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            yield from blocks(whole, last=False)
            rest = whole.slice(cut_at(whole))
        if rest is not None:
            yield from blocks(rest, last=True)

    def keys_of(t: pa.Table) -> np.ndarray:
        head, i, j = (t.column(c).to_numpy() for c in ("head", "i", "j"))
        return np.unique(np.concatenate([_runs(head), _runs(i), _runs(j)]))

    def cut_at(t: pa.Table) -> int:
        return int(keys_of(t)[-2]) if t.num_rows else 0

    def blocks(t: pa.Table, last: bool):
        cuts = keys_of(t)
        cuts = cuts if last else cuts[:-1]
        if len(cuts) < 2:
            return
        node, n, comp, side = (t.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
        raw = t.column("bits").combine_chunks()
        bits = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, BITS // 8)
        sizes, found = np.diff(cuts), []
        one_part = t.column("i").to_numpy() == t.column("j").to_numpy()
        leaf = Tree.leaves(n, comp, bits)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]).tolist():
            # Blocks of one leaf, all of the same size at once: the pairs of its members.
            starts = cuts[:-1][sizes == size]
            a, b = ((starts[:, None] + k).ravel() for k in np.triu_indices(size, 1))
            use = one_part[a] | (side[a] != side[b])
            a, b = a[use], b[use]
            good = leaf.open_pairs(0, a, b, percent)
            a, b = a[good], b[good]
            if few:
                keep = likeliest(a, b, leaf.likeness(a, b), few)
                a, b = a[keep], b[keep]
            found.append(np.stack([node[a], node[b]], axis=1))
        for k in np.flatnonzero(sizes > LEAF).tolist():
            s = slice(int(cuts[k]), int(cuts[k + 1]))
            found.append(block(node[s], n[s], comp[s], bits[s], side[s]))
        if found:
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})

    ordered = members.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "side", "node")
    return ordered.mapInArrow(giving_back(work), "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a, b``) whose whole sets are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def work(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                at = np.searchsorted(p, q)
                common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(giving_back(work), "a long, b long")


# --- The join -------------------------------------------------------------------------------------


def similar_sets(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows with their set's key, the distinct sets, and the components of what is similar.

    Returns ``_id, n, f1, f2`` per row; ``node, n, f1, f2, rep`` per set; and ``node, label`` for sets
    that are similar to another. Not all similar pairs are listed, but they are always connected.
    """
    rows = docs.select(whole_text(text_col).alias("_text"), F.col(id_col).alias("_id"))
    spark = docs.sparkSession
    surveyed = written(survey(rows), "survey")
    classes = spark.sparkContext.broadcast(frequency_classes(surveyed))
    nodes = nodes_of(rows, classes, percent)
    shape = nodes.select("node", "n", "bits", "wide")
    stars = first_of_blocks(members_of(nodes, classes)).select("a", "b").distinct()
    # The parts of a frequent token become one block again, under the first of their first members.
    parted = members_of(nodes, classes, parted_only=True)
    heads = parted.groupBy("token", "part").agg(F.min("node").alias("node")).select("token", F.lit(0).alias("part"), "node")
    tops = first_of_blocks(heads)
    under = first_of_blocks(parted).join(tops.select("token", F.col("a").alias("top"), F.col("b").alias("a")), ["token", "a"])
    stars = stars.unionByName(tops.select("a", "b")).unionByName(under.select(F.col("top").alias("a"), "b"))
    stars = written(stars.where("a <> b").distinct(), "stars")

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and signatures do not rule out."""
        x = shape.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("b1"), F.col("wide").alias("w1"))
        y = shape.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("b2"), F.col("wide").alias("w2"))

        def work(batches: Iterable[pa.RecordBatch]):
            for batch in batches:
                if not batch.num_rows:
                    continue
                b1, b2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("b1", "b2"))
                n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
                most = ones(b1 & b2) + np.minimum(n1 - ones(b1), n2 - ones(b2))
                most = np.minimum(most, np.minimum(n1, n2))
                good = most >= least_overlap(n1, n2, percent)
                w1, w2 = batch.column("w1"), batch.column("w2")
                for i in np.flatnonzero(good).tolist():
                    x, y = w1[i].as_py(), w2[i].as_py()
                    if x and y:
                        good[i] = wide_overlap(x, y, int(n1[i]), int(n2[i])) >= least_overlap(int(n1[i]), int(n2[i]), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

        return pairs.join(x, "a").join(y, "b").mapInArrow(giving_back(work), "a long, b long")

    near = written(close(stars), "pairs")
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    first = written(verified(near, sets_of(rows, nodes, ends), percent), "links")
    labels = connected(first)

    # Blocks with the same first member are one: what shares a token is there together, and once.
    # Those of one component are done; in the others, trees look for links between components.
    members = stars.select(F.col("a").alias("head"), F.col("b").alias("node")).union(stars.select("a", "a").distinct())

    def still_open(labels: DataFrame) -> DataFrame:
        """The members of blocks of several components, dealt out in parts and pairs of parts."""
        comp = members.join(labels, "node", "left").select("head", "node", F.coalesce("label", "node").alias("comp"))
        comp = written(comp, "members")
        blocks = comp.groupBy("head").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
        open_blocks = blocks.where("low < high AND size > 2").select("head", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
        # The first member has met all others already.
        open_members = comp.where("head <> node").join(open_blocks, "head").join(shape.drop("wide"), "node")
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        return open_members.withColumn("p", part).withColumn("q", other).select(
            "head", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"),
            "node", "n", "comp", "bits",
        )

    tried = written(tree_pairs(still_open(labels), percent, FEW), "tried")
    # These are all nodes of pairs that trees find, now or later: components only grow.
    ends = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    sets = sets_of(rows, nodes, ends)
    links = first
    for pairs in (lambda: tried, lambda: tree_pairs(still_open(labels), percent).join(tried, ["a", "b"], "left_anti")):
        found = written(verified(close(pairs()), sets, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = connected(links)
    return surveyed.where("cell IS NULL").select("_id", "n", "f1", "f2"), nodes, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: ``id_col, n_shingles, component_id``.

    A set holds a text's distinct runs of five words, or its whole sequence if it has fewer; words
    are lower-cased from A to Z. Two texts are linked if the common part of their sets is at least
    ``percent`` per cent of the union; ``component_id`` is the smallest id that links reach. A text
    that is null or has no word has an empty set and is its own component. Rows that repeat an id
    are rows of their own. A null id takes the smallest id of its component, null if there is none.
    """
    rows, nodes, labels = similar_sets(docs, id_col, text_col, percent)
    reps = nodes.select("node", "n", "f1", "f2", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = reps.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = written(reps.join(smallest, "label").select("n", "f1", "f2", "component_id"), "components")
    return rows.join(of_set, ["n", "f1", "f2"], "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with all their columns: of each component one with its smallest id.

    A row without an id stays only if its component has no id; of several rows with the smallest id
    the one whose text has the smallest hash stays, of equal texts any. Texts without words all stay.
    An empty table gives an empty result.
    """
    sha = F.sha2(whole_text(text_col), 256)
    key = F.struct(F.col(id_col).isNull().alias("gone"), F.col(id_col).alias("id"), sha.alias("sha"))
    found = near_duplicates(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), "_key", "_text", percent)
    stays = found.where((F.col("n_shingles") == 0) | (F.col("component_id") == F.col("_key")))
    single = (F.max("n_shingles") > 0) & (F.count("*") > 1)
    keep = stays.groupBy("_key").agg(single.alias("_single")).select("_key.id", "_key.sha", "_single")
    # Names are small: while they are few enough, no text is shuffled.
    keep = bounded_broadcast(written(keep.toDF("_keep", "_sha", "_single"), "kept"), 500_000)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), sha.alias("_text_sha"))
    kept = rows.join(keep, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text_sha") == F.col("_sha")))
    again = kept.where("_single").dropDuplicates(["_keep", "_sha"])
    return kept.where("NOT _single").unionByName(again).select("_doc.*")
