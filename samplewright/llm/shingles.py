"""Hashes of words and word shingles, a batch of texts at a time.

Words are maximal runs without space and U+0009 to U+000D; A-Z count as a-z. A
word's hash is a polynomial over its bytes, read off prefix sums over the batch's
bytes, so no text or word becomes a Python object. All hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of whole texts that are hashed together, and bytes of a longer text that one pass takes.
STRETCH = 1 << 17
#: Odd multipliers, of bytes in a word and of words in a shingle.
BYTE, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ONES = 0xFFFFFFFFFFFFFFFF

_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base & ONES, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _powers:
        code = np.arange(256, dtype=np.uint16) + np.uint16(1)
        code[65:91] += 32
        code[[32, 9, 10, 11, 12, 13]] = 0
        _powers["code"] = code
    if len(_powers.get("up", ())) < n:
        size = max(n, STRETCH)
        up, down = powers(BYTE, size), powers(pow(BYTE, -1, 1 << 64), size)
        if size > STRETCH:  # for one long word; not kept
            return _powers["code"], up, down
        _powers["up"], _powers["down"] = up, down
    return _powers["code"], _powers["up"], _powers["down"]


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data and where they begin; a word also ends before each of the breaks."""
    code, up, down = _tables(len(data))
    own = code[data]
    inside = own != 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    starts[at] = inside[at]
    ends[at - 1] = inside[at - 1]
    a, z = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(own * up[: len(data)], out=sums[1:])
    return mixed((sums[z] - sums[a]) * down[a]), a


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other in data, and the place of each text's first word; a last place ends the last text."""
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + STRETCH, len(data))
        if hi < len(data):  # cut before a word or text begins
            code = _tables(1)[0]
            size, cut = STRETCH, -1
            while True:
                gaps = np.flatnonzero(code[data[lo + 1 : hi]] == 0)
                inner = offsets[(offsets > lo) & (offsets <= hi)]
                cut = max(lo + 1 + int(gaps[-1]) if len(gaps) else -1, int(inner[-1]) if len(inner) else -1)
                if cut > lo or hi == len(data):
                    break
                size *= 2
                hi = min(lo + size, len(data))
            hi = cut if cut > lo else hi
        h, a = _words(data[lo:hi], offsets - lo)
        hashes.append(h)
        starts.append(a + lo)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def batches_of_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, places of the texts' first words) for stretches of a column of texts; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRETCH, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, *word_hashes(data[own[0] : own[-1]], own - own[0])
        first = last


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15 * k & ONES, np.uint64)
    for j in range(k):
        h = h * np.uint64(WORD) + words[j : n + j]
    return mixed(h)


def sequences(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a text, hashes of its k-word shingles in order) for every text of at least k words."""
    for first, words, at in batches_of_words(column):
        h = shingled(words, k)
        for j in np.flatnonzero(np.diff(at) >= k).tolist():
            yield first + j, h[at[j] : at[j + 1] - k + 1]


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of every text, the sorted distinct hashes of its k-word shingles; the whole sequence is one if it is shorter."""
    for _, words, at in batches_of_words(column):
        h = shingled(words, k)
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(h[a : z - k + 1]) if z - a >= k else shingled(words[a:z], z - a) if z > a else np.empty(0, np.uint64)
