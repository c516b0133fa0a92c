"""Word and shingle hashes of whole texts, by numpy over the bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased; runs of bytes that are not ASCII white space), and the first word of each text.

    ``raw``, ``offsets``: the bytes of the texts and their n + 1 bounds.
    """
    size = len(raw)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:size]
    ends[:-1] &= ~inside[1:] | edge[1:size]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers(1 << (size - 1).bit_length() if size > 1 else 1)
    total = np.cumsum(_LETTER[LOWER[raw]] * up[:size])
    before = np.where(begins > 0, total[begins - 1], np.uint64(0))
    return mixed((total[ends] - before) * down[begins]), np.searchsorted(begins, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``words``-word shingles; of a shorter text, of its whole word sequence."""
    hashes, first = word_hashes(raw, offsets)
    factors = mixed(np.arange(1, words + 2, dtype=np.uint64))
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k: k + n] * (factors[k] | np.uint64(1))
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            own = np.sort(rolled[a: b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            whole = hashes[a:b] * (factors[: b - a] | np.uint64(1))
            out.append(mixed(np.add.reduceat(whole, [0]) + factors[words: words + 1] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
