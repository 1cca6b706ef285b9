"""Words of whole text columns as 64-bit hashes, computed on Arrow's byte buffers.

Words are maximal runs of bytes other than the six white-space characters
U+0009-U+000D and U+0020; A-Z count as a-z. Equal words have equal hashes; two
different words share one with probability 2**-64.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = 20_240_607
_SLICE = 1 << 13  # words hashed at a time
_LONG = 4096  # longer words are hashed one by one
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word, documents one after the other
    bounds: np.ndarray  # int64, words of document i: bounds[i]:bounds[i + 1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is the empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_word_byte() -> np.ndarray:
    word = np.ones(256, bool)
    word[[9, 10, 11, 12, 13, 32]] = False
    return word


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
    """Byte starts and ends of the words; no word crosses two texts."""
    inside = word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finalizer, applied to a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    values = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


def powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(column: pa.Array) -> Words:
    data, offsets = text_buffer(column)
    starts, ends, bounds = word_spans(data, offsets, is_word_byte())
    values, power = byte_values(), powers(_LONG)
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), _SLICE):
        first, lens = starts[a : a + _SLICE], ends[a : a + _SLICE] - starts[a : a + _SLICE]
        long = np.flatnonzero(lens > _LONG)
        used = np.minimum(lens, _LONG)
        at = np.cumsum(used) - used
        inner = np.arange(used.sum(), dtype=np.int64) - np.repeat(at, used)
        x = values[data[np.repeat(first, used) + inner]]
        x *= power[inner]
        h = np.add.reduceat(x, at)
        for i in long:
            text = data[first[i] : first[i] + lens[i]].tobytes().lower()
            h[i] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
        h += lens.astype(np.uint64)
        out[a : a + _SLICE] = mix(h)
    return Words(out, bounds)


def windows(words: Words, k: int) -> Words:
    """Hashes of all runs of k consecutive words; a shorter text that has words
    gives one hash, of its whole sequence."""
    h, bounds = words
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = np.diff(bounds)
    counts = np.maximum(n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(at[-1], dtype=np.int64) - np.repeat(at[:-1], counts) + np.repeat(bounds[:-1], counts)
    total = np.zeros(len(place), np.uint64)
    left = np.repeat(bounds[1:], counts) - place
    for j in range(k):
        there = left > j
        if there.all():
            total += h[place + j] * factors[j]
        else:
            total[there] += h[place[there] + j] * factors[j]
    total += np.minimum(left, k).astype(np.uint64)
    return Words(mix(total), at)


def long_windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, their word positions and the index of their
    text, from prefix sums: the cost of one does not grow with n."""
    h, bounds = words
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(counts.sum(), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    at = pos + bounds[text]
    inverse = np.full(len(h), pow(int(_ODD), -1, 1 << 64), np.uint64)
    inverse[:1] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)), dtype=np.uint64)])
    return mix((total[at + n] - total[at]) * np.multiply.accumulate(inverse)[at] + np.uint64(n)), pos, text
