"""Words of many texts at once: numpy over the bytes of an Arrow column, no loop over words.

Word classes are ASCII classes plus "every byte above 127", so they can be told from UTF-8 bytes.
Words are known by a 64-bit hash of their bytes after A-Z is lower-cased.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[48:58] = LETTER_OR_DIGIT[65:91] = LETTER_OR_DIGIT[97:123] = LETTER_OR_DIGIT[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the text that holds it."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = is_word[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])  # a run that crosses from one text into the next is two words
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of each byte range, from prefix sums of byte times power of the base; bytes go through ``fold``."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((data if fold is None else fold[data]).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words (also of those that cross texts, which the caller masks)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[j : len(h) - k + 1 + j])
    return out


def first_of_text(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For texts 0 to n_docs, the number of the first word (so entry n_docs is the count of words)."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
