"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A record is framed as eight bytes of length, four bytes of masked checksum of the length, the data,
and four bytes of masked checksum of the data, all little-endian; the checksum is CRC-32C. The data
of a record are the ids of one document as 16-bit or 32-bit numbers. Files hold only records. A
separate table lists where each record starts, so readers can take records in any order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.bpe import TOGETHER, PieceEncoder, Ragged, ids_of_each, in_parts
from featlake.llm.common import kept_by_worker, whole_text
from featlake.llm.words import Words
from featlake.session import scratch_dir

_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
_INDEX = "file string, `offset` long, `length` long, n_tokens long, part int, nth long, before long"


def _bit_steps(operator: np.ndarray) -> np.ndarray:
    """Four tables of 256 that apply a linear map of 32 bits, given by its images of single bits."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    parts = [np.bitwise_xor.reduce(np.where(bits == 1, operator[8 * k : 8 * k + 8], 0), axis=1) for k in range(4)]
    return np.stack(parts).astype(np.uint32)


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][(v >> 8) & 255] ^ tables[2][(v >> 16) & 255] ^ tables[3][v >> 24]


class Crc32c:
    """CRC-32C of many byte strings at once.

    The checksum is linear, so neighbouring words combine in pairs, then the pairs, and so on: a
    tree whose steps are numpy operations on whole arrays, instead of a loop over bytes.
    """

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLYNOMIAL), one >> 1)
        self.byte = one
        word = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
        for _ in range(4):
            word = self.byte[word & 255] ^ (word >> 8)
        #: Level k moves a checksum over 2**k words.
        self.levels = [_bit_steps(word)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            bits = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
            last = self.levels[-1]
            self.levels.append(_bit_steps(_apply(last, _apply(last, bits))))
        return self.levels[k]

    def _short(self, data: bytes) -> int:
        state = 0xFFFFFFFF
        for b in data:
            state = int(self.byte[(state ^ b) & 255]) ^ (state >> 8)
        return state ^ 0xFFFFFFFF

    def __call__(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros(len(strings), np.uint32)
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            if len(s) < 4:
                out[i] = self._short(s)
            else:
                classes.setdefault(((len(s) + 3) // 4 - 1).bit_length(), []).append(i)
        for level, members in classes.items():
            wide = 4 << level
            rows = np.zeros((len(members), wide), np.uint8)
            for row, i in zip(rows, members):
                row[wide - len(strings[i]) :] = np.frombuffer(strings[i], np.uint8)
                row[wide - len(strings[i]) :][:4] ^= 0xFF  # the start value; zeros before it change nothing
            v = _apply(self._level(0), rows.view("<u4"))
            for k in range(level):
                v = _apply(self._level(k), v[:, 0::2]) ^ v[:, 1::2]
            out[members] = v[:, 0] ^ np.uint32(0xFFFFFFFF)
        return out

    def masked(self, strings: list[bytes]) -> np.ndarray:
        crc = self(strings)
        return ((crc >> 15) | (crc << 17)) + np.uint32(_MASK)


def framed(data: list[bytes], crc: Crc32c) -> list[bytes]:
    lengths = [len(d).to_bytes(8, "little") for d in data]
    heads, tails = crc.masked(lengths).astype("<u4"), crc.masked(data).astype("<u4")
    return [n + h.tobytes() + d + t.tobytes() for n, h, d, t in zip(lengths, heads, data, tails)]


def unframed(frames: list[bytes], crc: Crc32c) -> list[bytes]:
    """The data of complete frames; a wrong length or checksum is an error."""
    lengths, data = [f[:8] for f in frames], [f[12:-4] for f in frames]
    for n, d in zip(lengths, data):
        if int.from_bytes(n, "little") != len(d):
            raise ValueError("a record's length does not match its index")
    for part, sums in ((lengths, [f[8:12] for f in frames]), (data, [f[-4:] for f in frames])):
        if crc.masked(part).astype("<u4").tobytes() != b"".join(sums):
            raise ValueError("a record's checksum does not match its data")
    return data


def open_store(uri: str):
    """The file system and path of a URI: local, or any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


class WordEncoder:
    """Encodes texts with a vocabulary of words whose last tokens are marked, word by word."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(self._encode_new)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Words of letters are encoded in one text, and their last tokens tell them apart. If that
        # does not give as many as there are words, each is encoded alone, like all other pieces.
        joined, alone = [], []
        for i, p in enumerate(pieces):
            (joined if p.isalpha() else alone).append(i)
        flat, counts, order = [], np.zeros(len(pieces), np.int64), []
        for i in range(0, len(joined), TOGETHER):
            some = joined[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(pieces[j] for j in some), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                flat.append(ids)
                counts[some] = np.diff(ends, prepend=0)
                order += some
            else:
                alone += some
        ids, counts[alone] = ids_of_each(self.tokenizer, [pieces[i] for i in alone])
        both, back = Ragged(np.concatenate([*flat, ids]), counts[order + alone]), np.empty(len(pieces), np.int64)
        back[order + alone] = np.arange(len(pieces))
        return both.pick(back), counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        words = Words(texts, lower=True, marks=True)
        raw = words.data.tobytes()
        if any(s in raw for s in self.special):  # in capitals they would not be special
            words = Words(texts, lower=False, marks=True)
        ids, n = self.pieces(words.hashes(), words.data, words.start, words.end)
        return ids, np.bincount(words.doc, weights=n, minlength=words.n).astype(np.int64)


def write_records(
    docs: DataFrame, target: str, encoder: Callable[[], Callable], end: int, dtype: str = "<u4",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the documents' ids below ``target`` in ascending order of their id; return the index.

    The index has ``id_col, file, offset, length, n_tokens, part, nth, before``: where the record
    lies, its number of ids with the end id, and the ids and rows before it in its file. It is
    stored beside the files. A null text counts as empty; rows of one id are ordered by text, and
    rows without an id come first. An empty table writes no file and gives an empty index.

    A task writes one file under a name of its own; a task that runs again writes another, and only
    the files of the attempts that count are in the index.
    """
    kept = docs.select(whole_text(text_col).alias("_text"), F.col(id_col).alias("_id"))
    kept = kept.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    id_type = kept.schema["_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]):
        encode, crc, part = encoder(), Crc32c(), TaskContext.get().partitionId()
        file = f"{target}/records/part-{part:06d}-{uuid.uuid4().hex}"
        sink, offset, before, nth = None, 0, 0, 0
        for batch in in_parts(batches, 0):
            if sink is None:
                store, path = open_store(file)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(path)
            ids, counts = encode(batch.column(0))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end).astype(dtype)
            if len(whole) and int(max(ids.max(initial=0), end)) > np.iinfo(dtype).max:
                raise ValueError(f"ids do not fit in {dtype}")
            stops = ends + np.arange(1, len(ends) + 1)
            frames = framed([whole[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops)], crc)
            sink.write(b"".join(frames))
            lengths = np.fromiter(map(len, frames), np.int64, len(frames))
            n = counts + 1
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column(1), "file": pa.array([file] * len(frames), pa.string()),
                "offset": offset + np.cumsum(lengths) - lengths, "length": lengths, "n_tokens": n,
                "part": pa.array([part] * len(frames), pa.int32()), "nth": nth + np.arange(len(frames)),
                "before": before + np.cumsum(n) - n,
            })
            offset, before, nth = offset + int(lengths.sum()), before + int(n.sum()), nth + len(frames)
        if sink is not None:
            sink.close()

    index = kept.mapInArrow(work, f"`{id_col}` {id_type}, {_INDEX}")
    index.write.parquet(f"{target}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{target}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all records before. One small row per file is summed up."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return index.join(F.broadcast(offsets), "part").withColumn("start", F.col("_offset") + F.col("before")).drop("_offset")


def read_records(index: DataFrame, dtype: str = "<u4", id_col: str = "doc_id") -> DataFrame:
    """Read the records that the index rows name, in any order: ``id_col, start, n_tokens, ids``.

    Rows may be shuffled or filtered before. Rows that follow each other in a file are read at once.
    Lengths and checksums are verified; a record that fails is an error. ``ids`` are the raw bytes
    of 32-bit little-endian numbers.
    """
    kept = index.select(F.col(id_col).alias("_id"), "start", "n_tokens", "file", "offset", "length")
    id_type = kept.schema["_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]):
        crc, opened, name = Crc32c(), None, None
        for batch in batches:
            files = batch.column("file").to_pylist()
            at, size = (batch.column(c).to_numpy() for c in ("offset", "length"))
            new = [i == 0 or files[i] != files[i - 1] or at[i] != at[i - 1] + size[i - 1] for i in range(len(files))]
            size_before = np.cumsum(size) - size
            grown = size_before // (8 << 20)
            cuts = [i for i in range(len(files)) if new[i] or grown[i] != grown[i - 1]] + [len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if files[a] != name:
                    store, path = open_store(files[a])
                    name, opened = files[a], store.open_input_file(path)
                raw = opened.read_at(int(size[a:b].sum()), int(at[a]))
                ends = np.cumsum(size[a:b])
                data = unframed([raw[x:y] for x, y in zip([0, *ends[:-1]], ends)], crc)
                ids = [np.frombuffer(d, dtype).astype("<u4").tobytes() for d in data]
                head = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*head.columns[:3], pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"]
                )

    return kept.mapInArrow(work, f"`{id_col}` {id_type}, start long, n_tokens long, ids binary")


def written_and_read(docs: DataFrame, tokenizer_file: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents with a word tokenizer and read them back: ``id_col, start, n_tokens, ids``."""
    target = scratch_dir(docs.sparkSession, "records")
    dtype = "<u2"  # the vocabulary has fewer than 65536 ids; writing checks it
    index = write_records(docs, target, lambda: kept_by_worker(("word", tokenizer_file), lambda: WordEncoder(tokenizer_file)), end, dtype, id_col, text_col)
    # Index rows are small, but what they point to is not: a task for each file.
    files = index.agg(F.max("part")).first()[0]
    ordered = with_starts(index).repartition((files or 0) + 1, "part").sortWithinPartitions("part", "nth")
    return read_records(ordered, dtype, id_col)


def digest(records: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of records that were read."""
    return records.select(id_col, "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
