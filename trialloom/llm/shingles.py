"""Word shingles of whole texts as 64-bit hashes, computed on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPAN_BYTES = 2_000_000  # bytes of text looked at together

_u = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _LOWER.astype(np.uint64) + _u(1)  # of a byte in a word's hash
#: Bytes between words when punctuation does not count: all of ASCII but letters and digits.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = [not chr(c).isalnum() for c in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator; wraps around."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


@lru_cache(maxsize=8)
def constants(start: int, n: int) -> np.ndarray:
    """n odd 64-bit constants."""
    i = np.arange(start, start + n, dtype=np.uint64)
    return mix(i * _u(0x9E3779B97F4A7C15) + _u(1)) | _u(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^ \\t-\\r]+ after lower-casing A-Z, and the number of words of each text.

    ``space`` tells which bytes separate words, if others than white space do.

    ``data`` holds bytes, text i is data[starts[i]:ends[i]], texts in order without overlap. A word's hash
    is a sum of its bytes times a random constant of their place in the word.
    """
    if not len(starts) or starts[0] == ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    base, data = starts[0], data[starts[0]:ends[-1]]
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = (starts - base)[(starts < ends)]
    first[at] = solid[at]  # a new text starts a new word
    where = np.flatnonzero(solid).astype(np.int32)
    begin = np.flatnonzero(first[where]).astype(np.int32)  # in solid bytes
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    lengths = np.diff(np.append(begin, np.int32(len(where))))
    place = np.arange(len(where), dtype=np.int32) - np.repeat(begin, lengths)
    longest = int(lengths.max())
    factors = constants(0, 1 << (longest - 1).bit_length() if longest > 1 else 1)
    values = _VALUE[data[where]]
    values *= factors[place]
    hashes = mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64) * _u(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(where[begin], np.append(starts - base, ends[-1] - base))
    return hashes, np.diff(bounds)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words make one shingle."""
    c = constants(1 << 20, k)
    sets, at = [], 0
    n = len(hashes)
    if n >= k:
        rolled = hashes[: n - k + 1] * c[0]
        for j in range(1, k):
            rolled = rolled + hashes[j: n - k + 1 + j] * c[j]
        rolled = mix(rolled + _u(k))
    for m in counts.tolist():
        if m >= k:
            sets.append(np.unique(rolled[at: at + m - k + 1]))
        elif m:
            sets.append(mix((hashes[at: at + m] * c[:m]).sum(keepdims=True) + _u(m)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += m
    return sets


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if not pa.types.is_string(column.type) or column.null_count:
        column = pa.array([t or "" for t in column.to_pylist()], type=pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def spans(offsets: np.ndarray, most: int = SPAN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def text_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) for consecutive row ranges of an Arrow string column."""
    data, offsets = column_bytes(column)
    for a, b in spans(offsets):
        hashes, counts = word_hashes(data, offsets[a:b], offsets[a + 1:b + 1])
        yield a, shingle_sets(hashes, counts, k)


def minhashes(sets: list[np.ndarray], n: int, chunk: int = 32_768) -> np.ndarray:
    """(len(sets), n) minima under n hash functions; rows of empty sets stay at the maximum."""
    a, x = constants(1 << 21, n), constants(1 << 22, n)
    out = np.full((len(sets), n), np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(rows):
        end, total = at, 0
        while end < len(rows) and (end == at or total + len(sets[rows[end]]) <= chunk):
            total += len(sets[rows[end]])
            end += 1
        part = rows[at:end]
        flat = np.concatenate([sets[i] for i in part])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in part])[:-1]])
        for t in range(n):
            out[part, t] = np.minimum.reduceat((flat ^ x[t]) * a[t], begin)
        at = end
    return out
