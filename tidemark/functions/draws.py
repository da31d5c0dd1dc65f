"""Poisson(1) numbers of draws per run and round, from MD5 digests made for whole blocks of runs at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

from tidemark.functions import constants as K

CELLS = 32768  # digests made at once: small enough for the cache, large enough to hide numpy's calls
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _mixed(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if i < 16:
        return d ^ (b & (c ^ d))
    if i < 32:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if i < 48 else c ^ (b | ~d)


def _block(state: Sequence[np.ndarray], words: Sequence[np.ndarray]) -> list[np.ndarray]:
    """One block of MD5; what is the same for all rows or columns stays one row or column."""
    a, b, c, d = state
    for i in range(64):
        turn = TURNS[i // 16][i % 4]
        x = _mixed(i, b, c, d) + (a + (words[PLACES[i]] + np.uint32(ADDED[i])))
        a, b, c, d = d, b + ((x << np.uint32(turn)) | (x >> np.uint32(32 - turn))), b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _as_words(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view("<u4").astype(np.uint32)


def digests(prefixes: Sequence[bytes], suffixes: Sequence[bytes]) -> list[np.ndarray]:
    """The four words of the MD5 of every prefix followed by every suffix, each (prefixes, suffixes), as big-endian
    numbers: the hexadecimal text read eight digits at a time. Prefixes have one length and suffixes have one."""
    head, tail = len(prefixes[0]), len(suffixes[0])
    size = (head + tail + 8) // 64 * 64 + 64
    left = np.zeros((len(prefixes), size), np.uint8)
    left[:, :head] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(len(prefixes), head)
    right = np.zeros((len(suffixes), size), np.uint8)
    right[:, head : head + tail] = np.frombuffer(b"".join(suffixes), np.uint8).reshape(len(suffixes), tail)
    right[:, head + tail] = 0x80
    right[:, -8:] = np.frombuffer(((head + tail) * 8).to_bytes(8, "little"), np.uint8)
    rows, columns = _as_words(left), _as_words(right)
    state = [np.full((1, 1), x, np.uint32) for x in START]
    for at in range(0, size // 4, 16):
        words = []
        for w in range(at, at + 16):
            row, column = rows[:, w : w + 1], columns[None, :, w]
            words.append(column if 4 * w >= head else row if 4 * w + 4 <= head else row | column)
        state = _block(state, words)
    return [np.broadcast_to(x, (len(prefixes), len(suffixes))).byteswap() for x in state]


def _alike(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """Places of the texts of one length, per length."""
    sizes = np.array([len(t) for t in texts])
    return (np.flatnonzero(sizes == s) for s in np.unique(sizes))


def poisson_rounds(prefixes: Sequence[bytes], b: int, per_digest: int) -> np.ndarray:
    """Draws per text and round, (texts, b). A digest of ``text:i`` serves the ``per_digest`` rounds from i * per_digest on."""
    suffixes = [b":%d" % i for i in range((b - 1) // per_digest + 1)]
    drawn = np.zeros((len(prefixes), len(suffixes), per_digest), np.uint8)
    for columns in _alike(suffixes):
        ends = [suffixes[i] for i in columns]
        step = max(1, CELLS // len(ends))
        for same in _alike(prefixes):
            for at in range(0, len(same), step):
                rows = same[at : at + step]
                words = digests([prefixes[i] for i in rows], ends)
                for k in range(per_digest):
                    total, most = np.zeros(words[k].shape, np.uint8), words[k].max()
                    for cut in K.POISSON_CUTS:
                        if cut > most:
                            break
                        total += words[k] >= np.uint32(cut)
                    drawn[rows[:, None], columns[None, :], k] = total
    return drawn.reshape(len(prefixes), -1)[:, :b]
