"""Cutting texts into units: lines and sentences, short ones joined and long ones cut, at places that the words around them decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from tidemark.llm import kernels

REACH = 8
"""A cut is the strongest of so many gaps between words on either side, so units inside a text have more words than that."""

# Fixed values of the strength of a gap, which SQL computes as well: rank of line and sentence ends, weights of the bytes before and behind, modulus.
LINE, SENTENCE, WITHIN = 3, 2, 1
BEFORE, BEHIND, PRIME = 402653189, 201326611, 2147483647
RANK_BITS = 40

_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True


def by_bytes(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes together, one row at least."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + size, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def strengths(low: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How much the gap before each word, and behind the last, calls for a cut: the ends of texts most, then of lines, of sentences, then any.

    Gaps of one rank are told apart by the four bytes before and behind them.
    """
    n = len(starts)
    out = np.full(n + 1, (LINE + 1) << RANK_BITS, np.int64)
    if n < 2:
        return out
    tail, head = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(4):
        there = ends - 1 - k >= starts
        tail[there] |= low[ends[there] - 1 - k].astype(np.uint64) << np.uint64(8 * k)
        there = starts + k < ends
        head[there] |= low[starts[there] + k].astype(np.uint64) << np.uint64(8 * (3 - k))
    key = ((tail[:-1] * np.uint64(BEFORE) + head[1:] * np.uint64(BEHIND)) % np.uint64(PRIME)).astype(np.int64)
    breaks = np.searchsorted(np.flatnonzero(low == 10), starts)
    rank = np.where(breaks[1:] > breaks[:-1], LINE, np.where(_END[low[ends[:-1] - 1]], SENTENCE, WITHIN)).astype(np.int64)
    owner = np.searchsorted(at, starts, "right")
    inside = owner[1:] == owner[:-1]
    out[1:-1][inside] = (rank << RANK_BITS | key)[inside]
    return out


def cuts(value: np.ndarray, reach: int) -> np.ndarray:
    """Gaps that are stronger than all ``reach`` before them and not weaker than those behind, and the ends of texts."""
    padded = np.concatenate([np.zeros(reach, np.int64), value, np.zeros(reach, np.int64)])
    n = len(value)
    good = np.ones(n, bool)
    for k in range(1, reach + 1):
        good &= (value > padded[reach - k : reach - k + n]) & (value >= padded[reach + k : reach + k + n])
    return np.flatnonzero(good | (value == (LINE + 1) << RANK_BITS))


def divided(places: np.ndarray, reach: int) -> np.ndarray:
    """The places, and in units of more than 4 ``reach`` words (where one phrase repeats, no gap is the strongest) further ones every 2 ``reach`` words."""
    size = np.diff(places)
    more = np.where(size > 4 * reach, size // (2 * reach) - 1, 0)
    if not more.any():
        return places
    base = np.repeat(places[:-1], more)
    step = np.arange(len(base)) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.sort(np.concatenate([places, base + 2 * reach * step]))


def units(texts: pa.Array, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """All units of a block of texts: their text's number, start and end (code points), and the digest of their normalised words.

    Normalised: A-Z in lower case, one blank between words. Units tile the words of a text; blanks between units belong to none.
    """
    raw, at = kernels.buffers(texts)
    low = kernels.LOWER[raw]
    full = ~kernels.BLANK[raw]
    new = np.zeros(len(raw) + 1, bool)
    new[at] = True
    edge = np.concatenate([[False], full, [False]])
    starts = np.flatnonzero(edge[1:] & (~edge[:-1] | new))
    ends = np.flatnonzero(edge[:-1] & (~edge[1:] | new))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, []
    places = divided(cuts(strengths(low, at, starts, ends), reach), reach)
    first, last = starts[places[:-1]], ends[places[1:] - 1]
    # Words with one blank behind each: what normalised units are slices of.
    blanks = ends[ends < len(raw)]
    blanks = blanks[kernels.BLANK[raw[blanks]]]
    held = full
    held[blanks] = True
    low[blanks] = 32
    squeezed = low[held].tobytes()
    at_squeezed = np.cumsum(held) - held
    stop = at_squeezed[last - 1] + 1
    digests = [hashlib.md5(squeezed[a:b], usedforsecurity=False).digest() for a, b in zip(at_squeezed[first].tolist(), stop.tolist(), strict=True)]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    owner = np.searchsorted(at, first, "right") - 1
    return owner, points[first] - points[at[owner]], points[last] - points[at[owner]], digests
