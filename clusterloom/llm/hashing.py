"""Vectorised hashing of words and character grams over a whole Arrow batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and odd multipliers for places in a window. The generator is fixed.
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = _TABLE[_LOWER]
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE * 2)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE bytes; null texts are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every word: a run without ASCII white space, A-Z in lower case."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    visible = ~_SPACE[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets[:-1]] = True
    edge = visible.copy()
    edge[1:] &= ~visible[:-1] | begins[1:n]
    starts = np.flatnonzero(edge)
    last = visible.copy()
    last[:-1] &= ~visible[1:] | begins[1:n]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    letters = _LETTERS[data]
    letters *= up[:n]
    np.cumsum(letters, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * U(_BASE))
    return h, np.searchsorted(offsets, starts, "right") - 1


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every window of n neighbouring values."""
    m = len(words) - n + 1
    h = words[:m] * _PLACES[0]
    for k in range(1, n):
        h += words[k : k + m] * _PLACES[k]
    return mix(h)


def sorted_set(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; for some thousands, sorting is faster than the hash table of np.unique."""
    if not len(values):
        return values
    values = np.sort(values)
    fresh = np.empty(len(values), dtype=bool)
    fresh[0] = True
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles). Fewer words: the whole sequence as one; none: empty."""
    for first, data, offsets in slices(texts):
        words, of = word_hashes(data, offsets)
        bounds = np.searchsorted(of, np.arange(len(offsets)))
        windows = window_hashes(words, n) if len(words) >= n else words[:0]
        for i in range(len(offsets) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield first + i, sorted_set(windows[a : b - n + 1])
            elif b > a:
                yield first + i, mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64) + U(b - a))
            else:
                yield first + i, words[:0]
