"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: The lowest 0 to 8 bytes of a 64-bit number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of ``data`` from ``start`` on as numbers of eight bytes, the last filled up with zeros.

    Returns the numbers, piece after piece, the number of each in its piece, and where pieces begin.
    """
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(data) + 1,), "<u8", whole, strides=(1,))
    n = (sizes + 7) // 8
    first = np.cumsum(n) - n
    nth = np.arange(int(n.sum())) - np.repeat(first, n)
    left = np.repeat(sizes, n) - 8 * nth
    return at_byte[np.repeat(start, n) + 8 * nth] & _LOWEST[np.minimum(left, 8)], nth, first


def same_pieces(data, start, sizes, other, other_start, other_sizes) -> np.ndarray:
    """Which pieces of ``data`` are byte by byte those of ``other``."""
    same = sizes == other_sizes
    some = np.flatnonzero(same & (sizes > 0))
    if len(some):
        x, _, first = eights(data, start[some], sizes[some])
        y, _, _ = eights(other, other_start[some], sizes[some])
        same[some] = np.logical_and.reduceat(x == y, first)
    return same


_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:|")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Words:
    """The words of the texts of a column without nulls; A to Z count as lower case if ``lower``.

    ``doc`` is the number of a word's text, ``start`` and ``end`` its place in ``data``, ``count``
    the number of words of each text. With ``marks`` a single mark at the end of a word, after a
    Latin letter, is a word of its own.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, marks: bool = False):
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        self.n, self.data = len(texts), whole[offsets[0] : offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.offsets = offsets - offsets[0]
        self.inside = ~_SPACE[self.data]
        # A word also ends where its text ends: edges[i] is true if a text starts at byte i.
        edges = np.zeros(len(self.data) + 1, bool)
        edges[self.offsets] = True
        before = np.concatenate([[False], self.inside[:-1]]) if len(self.data) else self.inside
        after = np.concatenate([self.inside[1:], [False]]) if len(self.data) else self.inside
        self.starts = self.inside & (edges[:-1] | ~before)
        self.start = np.flatnonzero(self.starts)
        self.end = np.flatnonzero(self.inside & (edges[1:] | ~after)) + 1
        if marks:
            self._split_marks()
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)

    def _split_marks(self) -> None:
        long = np.flatnonzero(self.end - self.start >= 3)
        last = self.end[long] - 1
        a, b = self.data[last - 2], self.data[last - 1]
        # A letter is one of A to Z, or of the two-byte letters from U+00C0 on but for two signs.
        letter = _LETTER[b] | ((a == 0xC3) & (b != 0x97) & (b != 0xB7))
        cut = last[_MARK[self.data[last]] & letter]
        self.start, self.end = np.sort(np.concatenate([self.start, cut])), np.sort(np.concatenate([self.end, cut]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word.

        Eight bytes at a time are mixed with their place before they are added up. (A polynomial
        modulo 2**64 is the same for a Thue-Morse word and its complement, whatever the base.)
        """
        if not len(self.start):
            return np.empty(0, np.uint64)
        sizes = self.end - self.start
        value, nth, first = eights(self.data, self.start, sizes)
        sums = np.add.reduceat(mixed(value ^ mixed((nth + 1).astype(np.uint64))), first)
        return mixed(sums + mixed(sizes.astype(np.uint64)))
