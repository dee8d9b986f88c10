"""Simple-8b: whole numbers packed into 64-bit words, encoded and decoded by numpy in whole blocks.

A word's highest 4 bits select how many numbers of how many bits its other 60 hold. Selector 0 is the escape: the next
word is one number of up to 64 bits. Numbers come in blocks of BLOCK; a block starts at a word, and the offsets of all
blocks stand in front, so that blocks are decoded together or one alone.

A file: 8 bytes of magic; counts of documents, ids and blocks (3 x 8 bytes); ids of the documents (8 bytes each) and
one byte each that is 1 for a null id; the documents' counts of ids (8 bytes each); the blocks' offsets in words (8
bytes each and one more for the end); the words. All little-endian.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"LODS8B01"
BLOCK = 4096
#: Selector: (numbers, bits of each). Fixed values of the code.
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
_COUNT = np.ones(16, np.int64)
for _s, (_n, _) in SELECTORS.items():
    _COUNT[_s] = _n


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    out = np.zeros(x.shape, np.uint8)
    for k in (32, 16, 8, 4, 2, 1):
        high = x >= np.uint64(1 << k)
        out[high] += k
        x = np.where(high, x >> np.uint64(k), x)
    return out + (x > 0)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offsets of the blocks in them (one more than blocks)."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    grid = np.zeros((n_blocks, BLOCK + 60), np.uint64)
    width = np.zeros(grid.shape, np.uint8)
    for to, what in ((grid, ids), (width, _WIDTH16[ids] if int(ids.max(initial=0)) < 1 << 16 else _widths(ids.astype(np.uint64)))):
        full = n // BLOCK * BLOCK
        to[: n // BLOCK, :BLOCK] = what[:full].reshape(-1, BLOCK)
        if full < n:
            to[-1, : n - full] = what[full:]
    # most[c] at i: bits of the widest of the c numbers from i on, from two shorter stretches
    most, best = {1: width}, np.where(width <= 60, 15, ESCAPE).astype(np.uint8)
    for selector, (count, bits) in sorted(SELECTORS.items(), reverse=True)[1:]:
        have = max(c for c in most if c <= count - 1)
        other = most[count - have]
        most[count] = m = most[have].copy()
        np.maximum(m[:, :-have], other[:, have:], out=m[:, :-have])
        usable = m <= bits
        if not usable.any():  # then no longer stretch has smaller numbers
            break
        np.copyto(best, np.uint8(selector), where=usable)
    # follow each block from word to word, all blocks together
    left = np.full(n_blocks, BLOCK)
    if n_blocks:
        left[-1] = n - (n_blocks - 1) * BLOCK
    lane, at = np.arange(n_blocks), np.zeros(n_blocks, np.int64)
    starts, lanes = [], []
    while len(lane):
        starts.append(at)
        lanes.append(lane)
        at = at + _COUNT[best[lane, at]]
        more = at < left[lane]
        lane, at = lane[more], at[more]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    lane, at = np.concatenate(lanes), np.concatenate(starts)
    order = np.argsort(lane, kind="stable")
    lane, at = lane[order], at[order]
    selector = best[lane, at]
    place = np.cumsum(1 + (selector == ESCAPE)) - 1 - (selector == ESCAPE)
    words = np.zeros(int(place[-1]) + 1 + int(selector[-1] == ESCAPE), np.uint64)
    flat, first = grid.ravel(), lane * (BLOCK + 60) + at
    for s, (count, bits) in SELECTORS.items():
        of = np.flatnonzero(selector == s)
        if len(of):
            word = np.full(len(of), np.uint64(s) << np.uint64(60), np.uint64)
            for j in range(count):
                word |= flat[first[of] + j] << np.uint64(j * bits)
            words[place[of]] = word
    of = np.flatnonzero(selector == ESCAPE)
    words[place[of] + 1] = flat[first[of]]
    offsets = np.append(place[np.searchsorted(lane, np.arange(n_blocks))], len(words))
    return words, offsets


_WIDTH16 = np.concatenate([np.full(max(1, (1 << k) - (1 << k >> 1)), k, np.uint8) for k in range(17)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of all blocks."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    real = np.ones(len(words), bool)  # not the number behind an escape
    if not selector.all():
        k = 0
        zero = np.flatnonzero(selector == ESCAPE)
        while k < len(zero):  # an escaped number may look like an escape itself
            real[zero[k] + 1] = False
            k += 1 + (k + 1 < len(zero) and zero[k + 1] == zero[k] + 1)
    index = np.flatnonzero(real)
    count = _COUNT[selector[index]]
    ahead = np.cumsum(count) - count
    block = np.searchsorted(offsets, index, side="right") - 1
    at = ahead - ahead[np.searchsorted(index, offsets[:-1])][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s, (c, bits) in SELECTORS.items():
        of = np.flatnonzero(selector[index] == s)
        if len(of):
            to = at[of][:, None] + np.arange(c)
            value = (words[index[of]][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            ok = to < end[of][:, None]
            out[to[ok]] = value[ok]
    of = np.flatnonzero(selector[index] == ESCAPE)
    out[at[of]] = words[index[of] + 1]
    return out


def dump(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file."""
    words, offsets = encode(ids)
    named = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ids), len(offsets) - 1], "<u8")
    return b"".join([MAGIC, head.tobytes(), named.tobytes(), null.tobytes(), np.asarray(counts, "<u8").tobytes(), np.asarray(offsets, "<u8").tobytes(), np.asarray(words, "<u8").tobytes()])


def load(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their counts, and all ids of one file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of this format")
    n_docs, n_ids, n_blocks = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    named = np.frombuffer(raw, "<i8", n_docs, at)
    null = np.frombuffer(raw, np.uint8, n_docs, at := at + 8 * n_docs)
    counts = np.frombuffer(raw, "<u8", n_docs, at := at + n_docs)
    offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at := at + 8 * n_docs).astype(np.int64)
    words = np.frombuffer(raw, "<u8", -1, at + 8 * (n_blocks + 1))
    return [None if z else d for d, z in zip(named.tolist(), null.tolist(), strict=True)], counts.astype(np.int64), decode(words, offsets, n_ids)
