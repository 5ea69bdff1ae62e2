"""Word windows of whole texts as 64-bit hashes, for a batch of texts at a time.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. The shingles of a text are its windows of ``width`` words; a text with fewer words has one shingle
of all of them, a text without words (or a null) has none. Everything is computed on the bytes of an Arrow
string column at once, so no Python runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The multiplier and increment of the splitmix64 generator.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def multiple(k: int) -> np.uint64:
    """``k`` times the increment, modulo 2**64."""
    return np.uint64(k * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a permutation of 64-bit values that scatters their bits."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(12345))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# An odd base has an inverse modulo 2**64, which turns prefix sums into hashes of any span.
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(length: int) -> list[np.ndarray]:
    if len(_powers[0]) < length:
        size = max(length, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the offsets of the texts; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word in order, and the number of words of each text."""
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=sums[1:])
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), counts


def shingle_hashes(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes in the order of the texts, with repeats, and the offsets of the texts."""
    raw, offsets = text_bytes(texts)
    words, counts = word_hashes(raw, offsets)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    if not len(words):
        return np.empty(0, np.uint64), out
    # Position in the words of each shingle's first word.
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], n)
    spread = np.repeat(np.minimum(counts, width), n)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = spread.astype(np.uint64)
    for k in range(width):
        part = mix(padded[at + k] + multiple(k + 1))
        total = total * MIX_1 + np.where(spread > k, part, np.uint64(0))
    return mix(total), out
