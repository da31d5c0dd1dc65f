"""How often hashes occur across all documents, told back to the batches of documents that hold them.

Documents are dealt into batches by a hash. A batch sends every distinct hash it holds once, with the number of
its documents that hold it, to the bucket of that hash; the bucket adds up and answers in the same order; the
batch reads its texts again and knows for each of its hashes in how many documents of the corpus it occurs.
A hash that a third of all documents hold is one entry per batch. Texts cross the network once, for both
readings; hashes travel sorted, as differences of few bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.common import shuffle_partitions, text_bytes

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
"""(bytes, places, ids) of a batch to (hash, document) of what is to be counted; pairs may repeat."""


def pack(sorted_values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as differences, byte by byte, without the upper bytes that all lack."""
    steps = np.diff(sorted_values, prepend=np.uint64(0)) if len(sorted_values) else sorted_values
    n = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([n]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


@dataclass(frozen=True)
class Sizes:
    """Widths of an exchange; all that tasks need to know of it."""

    n_batches: int
    bucket_bits: int
    hash_bits: int

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.hash_bits)

    def held(self, kernel: Kernel, batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of a batch, rising, and how many of its documents hold each."""
        hashes, owners = kernel(*parts(batch))
        keys = self.keys(hashes)
        order = np.lexsort((owners, keys)) if len(keys) else np.zeros(0, int)
        keys, owners = keys[order], owners[order]
        new_key = np.ones(len(keys), bool)
        new_key[1:] = keys[1:] != keys[:-1]
        new_pair = new_key.copy()
        new_pair[1:] |= owners[1:] != owners[:-1]
        first = np.flatnonzero(new_key)
        return keys[first], np.add.reduceat(new_pair.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)

    def send(self, kernel: Kernel, batch: pa.Table) -> pa.Table:
        """A row for each bucket: the batch's keys there, and their counts."""
        keys, counts = self.held(kernel, batch)
        marks = np.arange(1, 1 << self.bucket_bits, dtype=np.uint64) << np.uint64(self.hash_bits - self.bucket_bits)
        at = np.concatenate([[0], np.searchsorted(keys, marks), [len(keys)]])
        full = [b for b in range(len(at) - 1) if at[b] < at[b + 1]]
        return pa.table(
            {
                "batch": pa.array([batch.column("batch")[0].as_py()] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "keys": pa.array([pack(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
                "counts": pa.array([counts[at[b] : at[b + 1]].astype("<u4").tobytes() for b in full], pa.binary()),
            }
        )

    def classes_of(self, replies: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
        """A function from hashes that a batch holds to their classes."""
        order = np.argsort(replies.column("bucket").to_numpy()) if replies.num_rows else []
        keys = [unpack(replies.column("keys")[int(i)].as_py()) for i in order]
        known = np.concatenate([*keys, np.full(1, 2**64 - 1, np.uint64)])
        classes = np.frombuffer(b"".join([*(replies.column("classes")[int(i)].as_py() for i in order), b"\0"]), np.uint8)

        def lookup(hashes: np.ndarray) -> np.ndarray:
            asked = self.keys(hashes)
            at = np.searchsorted(known[:-1], asked)
            return np.where(known[at] == asked, classes[at], np.uint8(0))

        return lookup


def answer(sent: pa.Table) -> pa.Table:
    """Adds up a bucket's counts over all batches; tells each batch which of its keys several documents hold, and their classes."""
    rows = [unpack(x) for x in sent.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in sent.column("counts").to_pylist()]).astype(np.int64)
    keys = np.concatenate(rows)
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.add.reduceat(counts[order], first)
    classes = np.empty(len(keys), np.uint8)
    classes[order] = np.repeat(np.ceil(np.log2(total)).astype(np.uint8), np.diff(np.append(first, len(keys))))
    told_keys, told, end = [], [], 0
    for row in rows:
        own = classes[end : end + len(row)]
        end += len(row)
        told_keys.append(pack(row[own > 0]))
        told.append(own[own > 0].tobytes())
    return pa.table({"batch": sent.column("batch"), "bucket": sent.column("bucket"), "keys": pa.array(told_keys, pa.binary()), "classes": pa.array(told, pa.binary())})


class Exchange:
    """An exchange over a table of texts; its sizes follow from their bytes."""

    def __init__(self, docs: DataFrame, id_col: str, text: str, batch_bytes: int = BATCH_BYTES) -> None:
        total, least = text_bytes(docs, text), shuffle_partitions(docs.sparkSession)
        self.sizes = Sizes(
            n_batches=max(2 * least, math.ceil(total / batch_bytes)),
            bucket_bits=max(1, math.ceil(math.log2(max(least, total / BUCKET_BYTES)))),
            # So many bits that few hashes (one in some hundreds) meet another by chance.
            hash_bits=min(64, max(32, max(1, total).bit_length() + 8)),
        )
        narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        self.texts = narrow.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(self.sizes.n_batches)).cast("int"))

    def counted(self, kernel: Kernel) -> DataFrame:
        """(batch, bucket, keys, classes): the keys of the batch in that bucket that several documents hold, and for
        each the base-2 logarithm of their number, rounded up."""
        sizes = self.sizes
        sent = self.texts.groupBy("batch").applyInArrow(lambda batch: sizes.send(kernel, batch), "batch int, bucket int, keys binary, counts binary")
        return sent.groupBy("bucket").applyInArrow(answer, "batch int, bucket int, keys binary, classes binary")

    def told(self, kernel: Kernel, finish: Callable[[pa.Table, Callable], pa.Table], schema: str) -> DataFrame:
        """``finish(texts, classes)`` for every batch."""
        sizes = self.sizes
        replies = self.counted(kernel).groupBy("batch")
        return self.texts.groupBy("batch").cogroup(replies).applyInArrow(lambda batch, told: finish(batch, sizes.classes_of(told)), schema)


def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, places and ids (0 for null) of a batch."""
    raw, at = kernels.buffers(table.column("text"))
    return raw, at, table.column("id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
