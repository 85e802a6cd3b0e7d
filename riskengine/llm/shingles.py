"""Five-word shingles of UTF-8 texts as 64-bit hashes, in numpy over whole Arrow batches.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case. A
document's set is its distinct five-word shingles; with one to four words it is the
whole sequence as one; without words it is empty. Two different shingles share a
hash with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
BLOCK = 1 << 16  # bytes hashed at a time: sums of eight bytes each that stay in a core's cache

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_UP, _DOWN = powers(_BASE, BLOCK + 1), powers(_INVERSE, BLOCK + 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _LOWER) -> np.ndarray:
    """One hash per word, from running sums of byte x base^position, in blocks of bounded size. ``fold`` maps bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = (_UP, _DOWN) if hi - lo <= BLOCK else (powers(_BASE, hi - lo + 1), _DOWN)
        terms = (fold[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[:hi - lo]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def pieces(column: pa.Array, most: int = 2 * BLOCK) -> Iterator[pa.Array]:
    """Slices of a text column of bounded bytes (at least one text each)."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield column.slice(i, j - i)
        i = j


def word_places(part: pa.Array, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first word of each text and the end) of the runs of bytes marked in ``word``."""
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
    raw = part.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    cuts = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = word[data]
    opens, closes = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    # texts meet without a space: a word ends and another starts at the cut
    inner = cuts[1:-1]
    split = inner[inside[inner] & inside[inner + 1]]
    opens[split] = True
    closes[split] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    return data, starts, ends, np.searchsorted(starts, cuts, side="left")


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; NULL is the empty text."""
    for part in pieces(column.fill_null("")):
        data, starts, ends, at = word_places(part)
        words = word_hashes(data, starts, ends)
        grams = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            grams = grams * _STEP + words[k:k + len(grams)]
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= WORDS:
                yield distinct(grams[a:b - WORDS + 1])
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    with np.errstate(over="ignore"):
                        short = short * _STEP + w
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    v = np.sort(values)
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = v[1:] != v[:-1]
    return v[keep]


def signature(s: np.ndarray) -> int:
    """One signed 64-bit name for a set (0 for the empty one)."""
    if not len(s):
        return 0
    x = mix(np.array([np.sum(mix(s), dtype=np.uint64)]) + np.array([len(s)], np.uint64) * _BASE)
    return int(x.view(np.int64)[0])
