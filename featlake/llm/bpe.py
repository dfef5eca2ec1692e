"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A byte-level vocabulary spells every byte as one character. Encoding maps the bytes of a text to
those characters, splits by the vocabulary's pattern and merges; decoding reverses the table. A
token may end inside a character, so decoding works on bytes and joins split characters.

Words repeat, so texts are first cut into pieces at places where the pattern always splits, each
distinct piece is encoded once per Python worker, and the pieces' ids are gathered with numpy.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import giving_back, kept_by_worker, whole_text
from featlake.llm.words import Words, mixed, same_pieces

#: Bytes of text worked on at once in a task, and distinct pieces remembered.
AT_ONCE, REMEMBERED = 1 << 20, 600_000
#: Pieces that are given to the tokenizer at once.
TOGETHER = 512
# Before a blank or line feed that a visible character follows the pattern always splits: what
# stands before it in a run of white space is a match of its own there as well as at a text's end.
_CUT = re.compile(r"(?=[ \n][!-~\u00a1-\u167f\u3001-\ud7ff])")

_SPACES, _VISIBLE = np.zeros(256, bool), np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of characters that are no white space of any kind.
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0)]] = True


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Ragged:
    """Arrays of several lengths in one flat array, picked by number."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths, dtype=np.int64) - lengths

    def extended(self, flat: np.ndarray, lengths: np.ndarray) -> Ragged:
        """With further arrays."""
        return Ragged(np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths]))

    def pick(self, which: np.ndarray) -> np.ndarray:
        """The picked arrays, one after another."""
        lengths = self.lengths[which].astype(np.int64)
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[which] - (ends - lengths), lengths)
        return self.flat[shift + np.arange(len(shift))]


def token_bytes(tokenizer_file: str) -> Ragged:
    """The bytes of every id of a byte-level vocabulary, special tokens as their own text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_characters())}
    table = {i: bytes(map(back.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    tokens = [table.get(i, b"") for i in range(max(table) + 1)]
    return Ragged(np.frombuffer(b"".join(tokens), np.uint8), np.array(list(map(len, tokens)), np.int64))


def ids_of_each(tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces, and the number of ids of each."""
    flat, counts = [np.empty(0, np.int64)], []
    for i in range(0, len(pieces), TOGETHER):
        found = [e.ids for e in tokenizer.encode_batch_fast(pieces[i : i + TOGETHER], add_special_tokens=False)]
        flat.append(np.fromiter((x for ids in found for x in ids), np.int64))
        counts.extend(map(len, found))
    return np.concatenate(flat), np.array(counts, np.int64)


class PieceEncoder:
    """Encodes each distinct piece once and remembers its ids and bytes by the piece's 64-bit hash.

    ``encode_new`` gives the ids of new pieces and the number of ids of each. A piece is taken for
    another only if their bytes are equal; pieces that merely share a hash are encoded each.
    """

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.table = Ragged(np.empty(0, np.int32), np.empty(0, np.int32))
        self.spelled = Ragged(np.empty(0, np.uint8), np.empty(0, np.int32))

    def __call__(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of ``data``, one after another, and the number of ids of each."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        raw, sizes = data.tobytes(), stop - start
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        # The first piece of each hash stands for the others, and what is remembered for it.
        own = first[back]
        odd = ~same_pieces(data, start, sizes, data, start[own], sizes[own])
        seen, held = first[known], self.at[at[known]]
        unlike = np.zeros(len(distinct), bool)
        unlike[known] = ~same_pieces(data, start[seen], sizes[seen], self.spelled.flat, self.spelled.starts[held], self.spelled.lengths[held])
        odd |= unlike[back]
        if not known.all():
            new, pieces = distinct[~known], first[~known].tolist()
            ids, counts = self.encode_new([raw[start[i] : stop[i]].decode() for i in pieces])
            number = (len(self.table.lengths) + np.arange(len(new))).astype(np.int32)
            self.table = self.table.extended(ids.astype(np.int32), counts.astype(np.int32))
            spelled = np.frombuffer(b"".join(raw[start[i] : stop[i]] for i in pieces), np.uint8)
            self.spelled = self.spelled.extended(spelled, sizes[pieces].astype(np.int32))
            places = np.searchsorted(self.keys, new)
            self.keys, self.at = np.insert(self.keys, places, new), np.insert(self.at, places, number)
            at = np.searchsorted(self.keys, distinct)
        which, table = self.at[at][back], self.table
        if odd.any():
            ids, counts = self.encode_new([raw[start[i] : stop[i]].decode() for i in np.flatnonzero(odd).tolist()])
            which[odd] = len(table.lengths) + np.arange(len(counts))
            table = table.extended(ids.astype(np.int32), counts.astype(np.int32))
        return table.pick(which).astype(np.int64), table.lengths[which].astype(np.int64)


class TextEncoder:
    """Encodes texts with a byte-level vocabulary; special tokens spelled out in a text are ordinary text.

    A text whose words are separated by single blanks or line feeds is cut before each of those:
    there the pattern always splits, if a visible character follows. Marks at the ends of words are
    pieces of their own. Texts with other white space are encoded whole, cut by ``_CUT``.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.lengths = token_bytes(tokenizer_file).lengths
        self.pieces = PieceEncoder(self._encode_new)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Pieces that start with white space split from what stands before them: encoded in one text,
        # their ids are told apart by bytes.
        joined = [i for i, p in enumerate(pieces) if p[0] in " \n"]
        alone = [i for i, p in enumerate(pieces) if p[0] not in " \n"]
        flat, counts = [], np.zeros(len(pieces), np.int64)
        for i in range(0, len(joined), TOGETHER):
            some = [pieces[j] for j in joined[i : i + TOGETHER]]
            ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p.encode()) for p in some])) + 1
            counts[joined[i : i + TOGETHER]] = np.diff(ends, prepend=0)
            flat.append(ids)
        ids, counts[alone] = ids_of_each(self.tokenizer, [pieces[i] for i in alone])
        both = Ragged(np.concatenate([*flat, ids]), counts[joined + alone])
        order = np.empty(len(pieces), np.int64)
        order[joined + alone] = np.arange(len(pieces))
        return both.pick(order), counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        words = Words(texts, lower=False, marks=True)
        data, start, end = words.data, words.start, words.end
        # A mark that was cut off touches the word before it; other words follow one separator.
        touching = np.concatenate([[False], (start[1:] == end[:-1]) & (words.doc[1:] == words.doc[:-1])]) if len(start) else np.empty(0, bool)
        first = start == words.offsets[words.doc]
        before = data[np.maximum(start - 1, 0)]
        separated = ~touching & ~first
        visible = _VISIBLE[data[start]]
        single = np.zeros(len(start), bool)
        single[1:] = (start[1:] == end[:-1] + 1) & (words.doc[1:] == words.doc[:-1])
        fine = touching | first | (single & visible & ((before == 0x20) | (before == 0x0A)))
        # Irregular texts: other separators, white space at the start or end, or nothing but that.
        sizes = np.diff(words.offsets)
        odd = np.bincount(words.doc, weights=~fine, minlength=words.n) > 0
        last = words.offsets[1:]
        odd |= (sizes > 0) & _SPACES[data[np.maximum(last - 1, 0)]] if len(data) else odd
        use = ~odd[words.doc]
        keys = words.hashes() + np.where(separated, before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        keys, lead = mixed(keys[use]), (start - separated)[use]
        ids, n = self.pieces(keys, data, lead, end[use])
        counts = np.bincount(words.doc[use], weights=n, minlength=words.n).astype(np.int64)
        if not odd.any():
            return ids, counts
        which = np.flatnonzero(odd).tolist()
        cut = [[p for p in _CUT.split(texts[i].as_py()) if p] for i in which]
        other, m = ids_of_each(self.tokenizer, [p for ps in cut for p in ps])
        ends = np.cumsum([len(ps) for ps in cut])
        own = np.diff(np.concatenate([[0], np.cumsum(m)])[ends], prepend=0)
        both = Ragged(np.concatenate([ids, other]), np.concatenate([counts, own]))
        order = np.arange(words.n)
        order[which] = words.n + np.arange(len(which))
        counts[which] = own
        return both.pick(order), counts


def in_parts(batches: Iterable[pa.RecordBatch], text: int, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part have about ``most`` bytes; no text is cut.

    At the end the worker gives back the memory of its batches, since it stays for later tasks.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def character_offsets(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens of these byte lengths start and end in the text ``data``, in characters.

    A token that holds a part of a character covers that character.
    """
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(lengths)
    return leads[np.minimum(ends - lengths + 1, len(data))] - (lengths > 0), leads[ends]


def _kept(tokenizer_file: str) -> tuple:
    return "byte", tokenizer_file


def _encoded(batches, tokenizer_file: str):
    """Per part of the batches, whose first column is text: the part, flat ids, ids per text, token table."""
    encode = kept_by_worker(_kept(tokenizer_file), lambda: TextEncoder(tokenizer_file))
    table = token_bytes(tokenizer_file)
    for part in in_parts(batches, 0):
        yield part, *encode(part.column(0)), table


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and, on request, each token's ``starts`` and ``ends`` in characters.

    A null text is encoded as an empty one, with no ids. Columns of ``docs`` with those names are
    replaced; all others stay as they are.
    """
    new = {"ids": "array<int>"} | ({"starts": "array<int>", "ends": "array<int>"} if offsets else {})
    kept = docs.select(whole_text(text_col).alias("_whole_text"), *[c for c in docs.columns if c not in new])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]), *(f"{k} {v}" for k, v in new.items())])

    def work(batches):
        for part, ids, counts, table in _encoded(batches, tokenizer_file):
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))]
            if offsets:
                spans = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
                for text, some in zip(part.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                    data = np.frombuffer(text.encode(), np.uint8)
                    for out, found in zip(spans, character_offsets(data, table.lengths[some])):
                        out.append(found)
                columns += [pa.ListArray.from_arrays(at, pa.array(np.concatenate(s).astype(np.int32))) for s in spans]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=[*part.schema.names[1:], *new])

    return kept.mapInArrow(giving_back(work, _kept(tokenizer_file)), schema)


def decode(tokens: DataFrame, tokenizer_file: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded`` (bytes) and ``text``, whose split characters are joined again.

    Bytes that do not form a character, as where a list of ids ends inside one, become U+FFFD in
    ``text`` and stay as they are in ``decoded``. A null list counts as empty; an id that the
    vocabulary lacks is an error.
    """
    kept = tokens.select(
        F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("_ids"),
        *[c for c in tokens.columns if c not in ("decoded", "text")],
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]]

    def work(batches):
        table = token_bytes(tokenizer_file)
        for batch in batches:
            lists = batch.column(0)
            decoded = [table.pick(np.array(x, np.int64)).tobytes() for x in lists.to_pylist()]
            texts = pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(decoded, pa.binary()), texts], names=[*batch.schema.names[1:], "decoded", "text"]
            )

    return kept.mapInArrow(work, ", ".join([*fields, "decoded binary", "text string"]))


def round_trip(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per row: ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids``.

    The hashes are those of the ids as little-endian 32-bit numbers and of the bytes that the ids
    decode to. A null text counts as empty. Rows that repeat an id give a row each.
    """
    kept = docs.select(whole_text(text_col).alias("_text"), F.col(id_col).alias("_id"))
    id_type = kept.schema["_id"].dataType.simpleString()

    def work(batches):
        for part, ids, counts, table in _encoded(batches, tokenizer_file):
            data = table.pick(ids)
            id_ends = np.cumsum(counts)
            byte_ends = np.concatenate([[0], np.cumsum(table.lengths[ids])])[id_ends]
            raw = ids.astype("<u4")
            hashes = [
                [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends)]
                for flat, ends in ((raw, id_ends), (data, byte_ends))
            ]
            columns = [part.column(1), pa.array(counts), *map(pa.array, hashes)]
            if with_ids:
                at = pa.array(np.concatenate([[0], id_ends]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "i", "d", *["ids"] * with_ids])

    out = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return kept.mapInArrow(giving_back(work, _kept(tokenizer_file)), out + ", ids array<int>" * with_ids)
