"""Packing documents into sequences by the sum-of-squares rule, with exact cuts."""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import query, table

LENGTH, END = 2048, 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CACHED = 300_000
"""Words whose ids a task remembers (some 50 MB). A full table starts anew, and none outlives its task."""

STREAM_DOCUMENTS = 25_000
"""Documents of a stream at least, where the input has them: what is still open at its end is cut anew."""

LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%$&*#|]*)")


class Tokens(dict):
    """Ids of pieces between single blanks or line breaks, as bytes of 32-bit numbers.

    The tokenizer drops white space before it merges, so pieces are independent. Plain words, with signs at
    most behind them, go straight to its merge model; all others through its whole encoder.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.encoder = Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.tails: dict[str, bytes] = {}
        # The byte alphabet of byte-level models: printable bytes are themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in plain)
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        """Only words in lower case and pieces of other kinds are remembered; others are put together from these."""
        if m := LATIN.fullmatch(piece):
            word, tail = m[1].lower(), m[2]
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.merged(tail)
                return self[word] + self.tails[tail]
            if word != piece:
                return self[word]
            value = self.merged(word)
        else:
            value = np.array(self.encoder.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = value
        return value

    def merged(self, part: str) -> bytes:
        plain = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode()))
        return pack_ids(*[t.id for t in self.model.tokenize(plain)])

    def ids(self, text: str) -> bytes:
        """All ids of a text, then the end id."""
        pieces = text.replace("\n", " ").split(" ")
        return b"".join(map(self.__getitem__, filter(None, pieces))) + END_BYTES


def pack_ids(*ids: int) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


END_BYTES = np.array([END], "<u4").tobytes()


class Levels:
    """Online packing of pieces into windows of ``length`` ids.

    ``counts[h]`` is the number of open windows filled up to h. A piece of size s may go into any window of
    level h with h + s <= length, or open a new one; the place that makes the sum of squared counts least is
    taken (the fullest on a tie). Windows that fill up leave the array.
    """

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, size: int) -> int:
        """The level to use for a piece; 0 opens a window."""
        h = np.arange(self.length - size + 1)
        gain = 2 * (self.counts[h + size] - self.counts[h]) + 2
        gain[0] = 2 * self.counts[size] + 1
        if size <= self.length:
            # A window that becomes full is not counted any more.
            gain[-1] = 1 - 2 * self.counts[self.length - size] if self.length > size else 0
        gain[1:][self.counts[h[1:]] == 0] = np.iinfo(np.int64).max
        return int(len(gain) - 1 - np.argmin(gain[::-1]))

    def add(self, piece: tuple, size: int) -> list[list]:
        """Packs a piece; returns the windows (lists of pieces) that are full now."""
        level = self.place(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.length:
            return [window]
        self.counts[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return []

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        return [w for level in sorted(self.open, reverse=True) for w in self.open[level]]


def recut(windows: list[list[tuple[int, int, bytes, int]]], length: int) -> Iterator[list]:
    """Pieces of open windows, cut anew into full windows; what remains of the last goes into windows of a power of two, which need no padding."""
    stream = [piece for w in windows for piece in w]
    total = sum(len(p[2]) // 4 for p in stream)
    sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    at, used = 0, 0
    for size in sizes:
        window, room = [], size
        while room:
            doc, start, ids, whole = stream[at]
            part = ids[4 * used : 4 * (used + room)]
            window.append((doc, start + used, part, whole))
            room -= len(part) // 4
            used += len(part) // 4
            if 4 * used == len(ids):
                at, used = at + 1, 0
        yield window


PACKED = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, recut boolean"
NAMES = [part.split()[0] for part in PACKED.split(", ")]


def packed(texts: Iterator[tuple[int | None, str | None]], shard: int, length: int = LENGTH, path: str = TOKENIZER) -> Iterator[tuple]:
    """``placed`` without its last column."""
    return (row[:-1] for row in placed(texts, shard, length, path))


def placed(texts: Iterator[tuple[int | None, str | None]], shard: int, length: int = LENGTH, path: str = TOKENIZER) -> Iterator[tuple]:
    """Rows of ``PACKED`` for one stream of documents; sequences are numbered from ``shard`` * 2**32 on."""
    tokenizer, levels, sequence = Tokens(path), Levels(length), shard << 32

    def rows(window: list, anew: bool) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, whole in window:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), whole, sequence, offset, anew
            offset += n

    for doc, text in texts:
        ids = tokenizer.ids(text or "")
        whole = len(ids) // 4
        for start in range(0, whole, length):
            part = ids[4 * start : 4 * (start + length)]
            for window in levels.add((doc, start, part, whole), len(part) // 4):
                yield from rows(window, False)
                sequence += 1
    for window in recut(levels.rest(), length):
        yield from rows(window, True)
        sequence += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, path: str = TOKENIZER) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    Partitions of the scan are joined, unshuffled, to streams of about ``STREAM_DOCUMENTS`` documents; each has a level array for its
    open windows, and a task holds only those windows. Longer documents fill whole windows first and send their
    remainder through the sum-of-squares rule; windows still open at the end are cut anew (``recut``), so no sequence
    needs padding. The names of the result are fixed; extra columns are not looked at. Null and empty texts consist of the end id. Rows with null or repeated ids are documents
    like all others. Sequences are numbered by the partition of the scan, so a repeated task repeats them.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (pair for b in batches for pair in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True))
        found: list[tuple] = []
        for row in placed(stream, TaskContext.get().partitionId(), length, path):
            found.append(row)
            if len(found) >= 20_000:
                yield batch(found)
                found = []
        yield batch(found)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(NAMES)
        kinds = [pa.int64()] * (len(NAMES) - 1) + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    narrow = narrow.coalesce(max(1, docs.count() // STREAM_DOCUMENTS))
    return narrow.mapInArrow(apply, PACKED).withColumnRenamed("id", id_col)


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
