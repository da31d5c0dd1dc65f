"""Array work on blocks of texts, as Arrow delivers them: words, hashes, shingles, anchors. Nothing here knows Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPAN = 1 << 17
"""Bytes hashed at a time: the 64-bit columns of a span stay in the processor's cache."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(256, dtype=np.uint64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SPAN + 1)
        _POWERS["up"], _POWERS["down"] = _powers(BASE, size), _powers(BASE_INVERSE, size)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column end to end and the n + 1 places where texts begin; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(raw: np.ndarray, at: np.ndarray, size: int = SPAN):
    """Cuts of about ``size`` bytes that fall on a text's end or behind a blank, so no word is cut."""
    begin, n = 0, len(raw)
    while begin < n:
        end = min(begin + size, n)
        if end < n:
            last = at[np.searchsorted(at, end, "right") - 1]
            if last > begin:
                end = int(last)
            else:
                blanks = np.flatnonzero(BLANK[raw[begin:end]])
                if len(blanks):
                    end = begin + int(blanks[-1]) + 1
                else:
                    stop = int(at[np.searchsorted(at, end, "left")])
                    while end < stop and not BLANK[raw[end]]:
                        far = np.flatnonzero(BLANK[raw[end : min(stop, end + size)]])
                        end = end + int(far[0]) if len(far) else min(stop, end + size)
        yield begin, end
        begin = end


def words(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the n + 1 places where each text's words begin."""
    hashes, starts_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, end in spans(raw, at):
        part = raw[begin:end]
        full = ~BLANK[part]
        first = np.empty(len(part), bool)
        first[0] = full[0]
        np.greater(full[1:], full[:-1], out=first[1:])
        lo, hi = np.searchsorted(at, begin, "left"), np.searchsorted(at, end, "left")
        bounds = at[lo:hi] - begin
        bounds = bounds[bounds < len(part)]
        first[bounds] = full[bounds]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        last = np.empty(len(part), bool)
        last[-1] = full[-1]
        np.greater(full[:-1], full[1:], out=last[:-1])
        inner = bounds[bounds > 0] - 1
        last[inner] = full[inner]
        ends = np.flatnonzero(last) + 1
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[LOWER[part] if lower else part] * up, out=total[1:])
        value = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        hashes.append(mix(value))
        starts_at.append(starts + begin)
    where = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(where, at, "left")


def windows(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the text of each."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    first = np.arange(len(owner), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at[:-1], counts)
    value = np.zeros(len(owner), np.uint64)
    for k in range(n):
        value = value * BASE + hashes[first + k]
    return mix(value), owner


def shingles(hashes: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows``; a text with words, but fewer than n, has its whole sequence as one."""
    value, owner = windows(hashes, at, n)
    sizes = np.diff(at)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            there = sizes[short] > k
            extra[there] = extra[there] * BASE + hashes[at[:-1][short[there]] + k]
        value = np.concatenate([value, mix(extra + sizes[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    return value, owner
