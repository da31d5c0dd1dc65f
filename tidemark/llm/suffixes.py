"""Duplicate byte strings by a run-length index: run-compressed transforms, streamed matching statistics, exact marks.

A corpus has no single index: strings of ``length`` bytes are dealt by an anchor, the smallest hashed substring of
``ANCHOR`` bytes inside them. Neighbouring strings share their anchor, so they travel as one region of the text, and
equal strings meet in one bucket. Each bucket sorts its regions, a share of the anchors at a time, into a Burrows-Wheeler
transform of order ``length``, keeps it as runs with sampled run ends, and streams its regions through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.common import query, table
from tidemark.llm.exchange import Exchange, Sizes, parts

LENGTH, ANCHOR = 50, 24
HOT = 16
"""An anchor of more than 2 ** 15 documents is hot: its strings are dealt one by one, by their own hash. Others have 2.5 MB of regions at most."""

BATCH_BYTES = 8 << 20
INDEX_BYTES = 1 << 18
"""A bucket's regions are sorted in shares of about so many bytes."""

SHARES = 8
"""Bits of an anchor behind those of its bucket: anchors equal in them stay in one share."""

PACKED = pa.Codec("zstd", compression_level=1)
"""Neighbouring regions of a row have nothing in common that a faster codec finds."""

PIECE = 1 << 16
BIG = np.iinfo(np.int64).max
PLACE = (1 << 20) - 1


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all substrings of ``ANCHOR`` = 3 * 8 bytes, from words of 8 bytes at every place."""
    raw = np.ascontiguousarray(raw)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)) * kernels.BASE
    words ^= words >> np.uint64(29)
    n, factor = len(raw) - ANCHOR + 1, np.uint64(0xBF58476D1CE4E5B9)
    out = words[:n] * factor
    out += words[8 : 8 + n]
    out ^= out >> np.uint64(31)
    out *= factor
    out += words[16 : 16 + n]
    out ^= out >> np.uint64(32)
    out *= kernels.BASE
    return out


def words_of(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place as one number, without a copy."""
    raw = np.ascontiguousarray(raw)
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))


def fingerprints(words: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of 8 bytes or more. The last word of a slice ends where the slice ends."""
    out = width.astype(np.uint64)
    for k in range(0, int(width.max()) if len(width) else 0, 8):
        out ^= words[begin + np.minimum(k, width - 8)]
        out *= kernels.BASE
        out ^= out >> np.uint64(29)
    return kernels.mix(out)


def new_slices(words: np.ndarray, begin: np.ndarray, width: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of some slices in the order of their keys differ from the one before: equal keys alone do not count, all bytes are compared."""
    new = np.ones(len(key), bool)
    near = np.flatnonzero((key[1:] == key[:-1]) & (width[1:] == width[:-1]))
    a, b, size = begin[near], begin[near + 1], width[near]
    same = np.ones(len(near), bool)
    for k in range(0, int(size.max()) if len(size) else 0, 8):
        step = np.minimum(k, size - 8)
        same &= words[a + step] == words[b + step]
    new[near[same] + 1] = False
    return new


def joined(raw: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Slices end to end."""
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(ends), PIECE >> 2):
        b = min(a + (PIECE >> 2), len(ends))
        at = int(ends[a] - width[a])
        shift = begin[a:b] - (ends[a:b] - width[a:b])
        out[at : ends[b - 1]] = raw[np.repeat(shift, width[a:b]) + np.arange(at, ends[b - 1])]
    return out


def cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An array's bytes as one value for each stretch between the places ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def bytes_of(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """What ``cut`` has cut, end to end."""
    return np.frombuffer(kernels.buffers(column)[0].tobytes(), kind)


def minimum_of(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


def regions(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: first start, number of starts, anchor hash, text.

    No string crosses the end of a text. The anchor depends on the string's own bytes only.
    """
    starts = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none, none, np.zeros(0, np.uint64), none
    firsts, counts, anchors = [none], [none], [np.zeros(0, np.uint64)]
    ends = at[1:]
    for begin in range(0, starts, PIECE):
        end = min(begin + PIECE, starts)
        part = raw[begin : end + length - 1]
        hashes = anchor_hashes(part)
        packed = (hashes & np.uint64(~PLACE & (2**64 - 1))) | np.arange(len(hashes), dtype=np.uint64)
        place = (minimum_of(packed, length - ANCHOR + 1) & np.uint64(PLACE)).astype(np.int64)
        owner_end = np.full(end - begin, 0, np.int64)
        lo = int(np.searchsorted(ends, begin, "right"))
        hi = int(np.searchsorted(ends, end - 1, "right"))
        edges = np.clip(np.concatenate([[begin], ends[lo : hi + 1]]), begin, end) - begin
        owner_end[: edges[-1]] = np.repeat(ends[lo : hi + 1], np.diff(edges))
        valid = np.arange(begin, end) + length <= owner_end
        new = valid.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
        stop = valid.copy()
        stop[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
        # Texts that follow each other may lie so that both sides are valid: a text's end ends the run.
        borders = edges[(edges > 0) & (edges < end - begin)]
        new[borders] = valid[borders]
        stop[borders - 1] = valid[borders - 1]
        first = np.flatnonzero(new)
        firsts.append(first + begin)
        counts.append(np.flatnonzero(stop) - first + 1)
        # The smallest hashes crowd at the low end: mixed again, they spread over all buckets.
        anchors.append(kernels.mix(hashes[place[first]]))
    first = np.concatenate(firsts)
    return first, np.concatenate(counts), np.concatenate(anchors), np.searchsorted(at, first, "right") - 1


def anchor_kernel(length: int):
    def kernel(raw: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, anchors, owner = regions(raw, at, length)
        return anchors, ids[owner]

    return kernel


class Dealt:
    """The regions of a batch that other documents may share, and where each goes. The same for a second reading: rows are sorted first, since a shuffle delivers them in any order.

    Each distinct region of the batch is one unit, which goes once, with the smallest document that has it. Regions of
    hot anchors go as units of one string each. Units are in the order of their keys: an anchor's upper half, then a hash of the bytes.
    """

    def __init__(self, batch: pa.Table, classes: Callable[[np.ndarray], np.ndarray], length: int) -> None:
        batch = self.batch = batch.sort_by([("id", "ascending"), ("text", "ascending")])
        self.raw, self.at, self.ids = parts(batch)
        known = batch.column("id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        first, count, anchor, owner = regions(self.raw, self.at, length)
        rank = classes(anchor)
        use = (rank > 0) & known[owner]
        first, count, anchor, owner, hot = first[use], count[use], anchor[use], owner[use], rank[use] >= HOT
        words = words_of(self.raw)
        upper = np.uint64(0xFFFFFFFF00000000)
        key = (anchor & upper) | (fingerprints(words, first, count + length - 1) >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        self.first, self.count, self.own, self.hot, key = first[order], count[order], self.ids[owner[order]], hot[order], key[order]
        new = new_slices(words, self.first, self.count + length - 1, key)
        heads = np.flatnonzero(new)
        # Units of each distinct region, one or one for each string; ``unit`` has the first one's place in ``place``.
        many = np.where(self.hot[heads], self.count[heads], 1)
        base = np.cumsum(many) - many
        self.unit = base[np.cumsum(new) - 1]
        docs = np.repeat(np.minimum.reduceat(self.own, heads) if len(heads) else self.own, many)
        begin = np.repeat(self.first[heads] - base, many) + np.arange(len(docs))
        width, key = np.repeat(np.where(self.hot[heads], 1, self.count[heads]) + length - 1, many), np.repeat(key[heads], many)
        if hot.any():
            single = np.repeat(self.hot[heads], many)
            key[single] = fingerprints(words, begin[single], width[single])
            order = np.argsort(key, kind="stable")
            begin, width, docs, key = begin[order], width[order], docs[order], key[order]
            new = new_slices(words, begin, width, key)
            heads = np.flatnonzero(new)
            self.place = np.empty(len(order), np.int64)
            self.place[order] = np.cumsum(new) - 1
            begin, width, key, docs = begin[heads], width[heads], key[heads], np.minimum.reduceat(docs, heads)
        else:
            self.place = np.arange(len(docs))
        self.begin, self.width, self.docs, self.key = begin, width, docs, key


class RunLengthIndex:
    """Order-``length`` transform of a text as runs: rank by one search, and the sampled smallest document of each class.

    Rows are sorted by their first ``length`` bytes; rows equal in them form a class. Backward steps find the
    place of any string of up to ``length`` bytes; a string that has reached ``length`` is led back to the start
    of its class, so one step for each byte streams all strings of a text.
    """

    def __init__(self, text: np.ndarray, document: np.ndarray, valid: np.ndarray, length: int) -> None:
        n = len(text)
        bits = np.uint64(n.bit_length())
        places, low = np.arange(n, dtype=np.uint64), np.uint64((1 << n.bit_length()) - 1)

        def ordered(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows by key (of ``width`` bits), the dense rank of every key, and the ranks by row. Place and key share a word where both fit."""
            if width + int(bits) <= 64:
                ranked = (key << bits) | places
                ranked.sort()
                order = (ranked & low).astype(np.int64)
                ranked >>= bits
            else:
                order = np.argsort(key)
                ranked = key[order]
            by_row = np.zeros(n, np.uint64)
            np.cumsum(ranked[1:] != ranked[:-1], out=by_row[1:])
            dense = np.empty(n, np.uint64)
            dense[order] = by_row
            return order, dense, by_row

        reach = 5
        order, rank, by_row = ordered(np.ndarray((n,), ">u8", np.concatenate([text, np.resize(text, 8)]), strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * reach), 8 * reach)
        while reach < length:
            step = min(reach, length - reach)
            order, rank, by_row = ordered((rank << bits) | np.roll(rank, -step), 2 * int(bits))
            reach += step
        self.class_at = rank.astype(np.int64)  # by place: the last string of a region is a sample where its stream begins
        self.class_of = by_row.astype(np.int64)  # by row; classes are numbered in the order of rows
        self.class_start = np.flatnonzero(np.concatenate([[True], by_row[1:] != by_row[:-1]]))
        before = text[order - 1]
        # Only whole strings inside a region count as occurrences.
        self.smallest = np.minimum.reduceat(np.where(valid, document, BIG)[order], self.class_start)
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        by_head = np.argsort(before[starts], kind="stable")
        self.n = n
        self.head = before[starts][by_head].astype(np.int64)
        self.run_start, self.run_size = starts[by_head], np.diff(np.append(starts, n))[by_head]
        self.run_key = self.head * n + self.run_start
        self.run_before = np.cumsum(self.run_size) - self.run_size  # over all symbols in order, which already adds the symbols before
        self.symbol_start = np.cumsum(np.bincount(text + np.int64(1), minlength=257))

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows where the strings begin that have ``symbol`` in front of those at ``row``."""
        at = np.searchsorted(self.run_key, symbol * self.n + row, "left") - 1
        same = (at >= 0) & (self.head[at] == symbol)
        inside = np.minimum(row - self.run_start[at], self.run_size[at])
        return np.where(same, self.run_before[at] + inside, self.symbol_start[symbol])

    def stream(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
        """For each string of each region of the indexed text, laid end to end by region: the smallest document that holds it.

        All regions go backwards in lockstep from the sample of their last string, longest first, so those still running
        are always in front.
        """
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        count = size - length + 1
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        found = self.class_at[begin + count - 1]
        last, many = at + count - 1, -count
        out[last] = self.smallest[found]
        for back in range(1, int(count[0]) if len(count) else 0):
            running = int(np.searchsorted(many, -back, "left"))
            row = self.step(text[begin[:running] + count[:running] - 1 - back].astype(np.int64), self.class_start[found[:running]])
            found = self.class_of[row]
            out[last[:running] - back] = self.smallest[found]
        ranked = np.empty(len(order), np.int64)
        ranked[order] = np.arange(len(order))
        own = count[ranked]
        return out[np.repeat(at[ranked] - (np.cumsum(own) - own), own) + np.arange(len(out))]


def told_of(raw: np.ndarray, words: np.ndarray, begin: np.ndarray, width: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each region: the smallest document that holds it, and which of its strings an even smaller one holds."""
    key = fingerprints(words, begin, width)
    order = np.argsort(key)
    begin, width, key = begin[order], width[order], key[order]
    new = new_slices(words, begin, width, key)
    heads, place = np.flatnonzero(new), np.cumsum(new) - 1
    first, begin, size = np.minimum.reduceat(docs[order], heads), begin[heads], width[heads]
    text = joined(raw, begin, size + 1)
    ends = np.cumsum(size + 1) - 1
    text[ends] = 0  # a zero byte between regions
    valid = np.arange(len(text)) + length <= np.repeat(ends, size + 1)
    index = RunLengthIndex(text, np.repeat(first, size + 1), valid, length)
    found = index.stream(text, ends - size, size, length)
    count = size - length + 1
    at = np.cumsum(count) - count
    # At most length - ANCHOR + 1 strings share an anchor: they fit into 32 bits.
    offset = (np.arange(len(found)) - np.repeat(at, count)).astype(np.uint32)
    masks = np.add.reduceat(np.where(found < np.repeat(first, count), np.uint32(1) << offset, np.uint32(0)), at)
    told_first, told_masks = np.empty(len(order), np.int64), np.empty(len(order), np.uint32)
    told_first[order], told_masks[order] = first[place], masks[place]
    return told_first, told_masks


def answer(sent: pa.Table, length: int) -> pa.Table:
    """What ``told_of`` says of each row's regions, in order: a bucket's shares one after the other, small ones together."""
    widths, at = kernels.buffers(sent.column("widths"))
    sizes = np.diff(np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])[at]).tolist()
    raw = np.frombuffer(b"".join([*(PACKED.decompress(x.as_buffer(), n, asbytes=True) for x, n in zip(sent.column("data"), sizes, strict=True)), b"\0"]), np.uint8)
    width, docs, shares = widths.astype(np.int64), bytes_of(sent.column("docs"), "<i8"), bytes_of(sent.column("shares"), "u1")
    begin, words = np.cumsum(width) - width, words_of(raw)
    order = np.argsort(shares, kind="stable")
    load = np.concatenate([[0], np.cumsum(width[order])])
    ends = np.searchsorted(shares[order], np.arange(1 << SHARES), "right")
    first, masks, a = np.empty(len(order), "<i8"), np.empty(len(order), "<u4"), 0
    while a < len(order):
        # Up to the last share that ends within INDEX_BYTES, or else the next one alone.
        b = int(max(ends[max(np.searchsorted(load[ends], load[a] + INDEX_BYTES, "right") - 1, 0)], ends[np.searchsorted(ends, a, "right")]))
        some = order[a:b]
        first[some], masks[some] = told_of(raw, words, begin[some], width[some], docs[some], length)
        a = b
    return pa.table({"batch": sent.column("batch"), "bucket": sent.column("bucket"), "first": cut(first, at), "masks": cut(masks, at)})


def send(batch: pa.Table, classes: Callable, sizes: Sizes, length: int) -> pa.Table:
    """A row for each bucket: the batch's units there."""
    dealt = Dealt(batch, classes, length)
    bucket = (dealt.key >> np.uint64(64 - sizes.bucket_bits)).astype(np.int32)
    shares = (dealt.key >> np.uint64(64 - sizes.bucket_bits - SHARES)).astype(np.uint8)
    at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    data, ends = pa.py_buffer(joined(dealt.raw, dealt.begin, dealt.width)), np.concatenate([[0], np.cumsum(dealt.width)])[at].tolist()
    return pa.table(
        {
            "batch": pa.array([batch.column("batch")[0].as_py()] * (len(at) - 1), pa.int32()),
            "bucket": pa.array(bucket[at[:-1]], pa.int32()),
            "data": pa.array([PACKED.compress(data[a:b], asbytes=True) for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
            "widths": cut(dealt.width.astype(np.uint8), at),
            "docs": cut(dealt.docs.astype("<i8"), at),
            "shares": cut(shares, at),
        }
    )


def mark(batch: pa.Table, classes: Callable, replies: pa.Table, length: int) -> pa.Table:
    """Removed bytes of every document of a batch, from the answers to its units."""
    dealt = Dealt(batch, classes, length)
    batch = dealt.batch
    replies = replies.sort_by("bucket")
    first, masks = bytes_of(replies.column("first"), "<i8"), bytes_of(replies.column("masks"), "<u4")
    starts = np.zeros(len(dealt.raw) + length, np.int32)  # removed strings that start here, then those that started so far
    some = np.flatnonzero(~dealt.hot)
    unit = dealt.place[dealt.unit[some]]
    mask = np.where(dealt.own[some] > first[unit], np.uint32(0xFFFFFFFF), masks[unit])
    some, mask = some[mask > 0], mask[mask > 0]
    begin, count = dealt.first[some], dealt.count[some]
    for k in range(int(count.max()) if len(some) else 0):
        hit = (count > k) & ((mask >> np.uint32(k)) & np.uint32(1)).astype(bool)
        starts[begin[hit] + k + length] = 1  # a region's strings are nobody else's
    hot = np.flatnonzero(dealt.hot)
    for a in range(0, len(hot), PIECE):  # a unit for each string
        some = hot[a : a + PIECE]
        many = dealt.count[some]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        unit = dealt.place[np.repeat(dealt.unit[some], many) + step]
        hit = np.repeat(dealt.own[some], many) > first[unit]
        starts[(np.repeat(dealt.first[some], many) + step)[hit] + length] = 1
    np.cumsum(starts, out=starts)
    gone = starts[length:] > starts[: len(dealt.raw)]
    at, raw = dealt.at, dealt.raw
    rising = gone.copy()
    rising[1:] &= ~gone[:-1]
    borders = at[:-1][at[:-1] < len(gone)]
    rising[borders] = gone[borders]
    total = np.zeros(len(gone) + 1, np.int32)
    np.cumsum(gone, out=total[1:])
    removed = total[at[1:]] - total[at[:-1]]
    digests = []
    for i in range(len(at) - 1):
        rest = raw[at[i] : at[i + 1]]
        digests.append(hashlib.sha256((rest[~gone[at[i] : at[i + 1]]] if removed[i] else rest).tobytes()).hexdigest())
    found = np.flatnonzero(rising)
    stop = gone.copy()
    stop[:-1] &= ~gone[1:]
    last = at[1:][(at[1:] > at[:-1])] - 1
    stop[last] = gone[last]
    ends = np.flatnonzero(stop) + 1
    by_doc = np.searchsorted(at, found, "right") - 1
    n_spans = np.bincount(by_doc, minlength=len(at) - 1)
    places = np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)
    flat = np.column_stack([found - at[by_doc], ends - at[by_doc]]).reshape(-1)
    spans_array = pa.ListArray.from_arrays(pa.array(2 * places, pa.int32()), pa.array(flat, pa.int64()))
    return pa.table(
        {
            "id": batch.column("id"),
            "n_bytes": pa.array(np.diff(at), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
            "spans": spans_array,
        }
    )


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: bytes, removed bytes and spans, the digest of what stays, and the spans themselves.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. Null texts are
    empty. Rows with a null id lose nothing and are nobody's smaller document; rows that repeat an id do not count
    against each other. ``length`` may be from ``ANCHOR`` to ``ANCHOR`` + 31. Extra columns are not looked at.

    Steps: anchors that one document alone holds are found by counting (``exchange``); regions with the others go
    to their bucket, each distinct one of a batch once; buckets answer with the smallest holder; batches mark.
    """
    if not ANCHOR <= length <= ANCHOR + 31:
        raise ValueError(f"length must be from {ANCHOR} to {ANCHOR + 31}")
    exchange, kernel = Exchange(docs, id_col, text, BATCH_BYTES), anchor_kernel(length)
    sizes = exchange.sizes
    counted = exchange.counted(kernel)
    regions_sent = exchange.texts.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(
        lambda batch, told: send(batch, sizes.classes_of(told), sizes, length) if batch.num_rows else EMPTY,
        "batch int, bucket int, data binary, widths binary, docs binary, shares binary",
    )
    answers = regions_sent.groupBy("bucket").applyInArrow(lambda t: answer(t, length), "batch int, bucket int, first binary, masks binary")
    blank = F.lit(None).cast("binary")
    told = counted.select("batch", "bucket", "keys", "classes", blank.alias("first"), blank.alias("masks")).union(answers.select("batch", "bucket", blank, blank, "first", "masks"))

    def finish(batch: pa.Table, told: pa.Table) -> pa.Table:
        is_class = told.column("classes").is_valid()
        classes = sizes.classes_of(told.filter(is_class))
        return mark(batch, classes, told.filter(pa.compute.invert(is_class)), length)

    marked = exchange.texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    )
    return marked.withColumnRenamed("id", id_col)


EMPTY = pa.table({"batch": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("data", "widths", "docs", "shares")}})


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans")
