"""Names for stretches of a sequence: rolling hashes to look with, digests to verify with."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: Windows worked on at a time; the scratch space is about ten arrays of so many longs.
CHUNK = 1 << 18
LOW = np.uint64((1 << 24) - 1)

_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits made to depend on all of 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(1 << (n - 1).bit_length(), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


class Prefix:
    """Rolling hashes of any stretch of a sequence of unit values. They find candidates; digests decide."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, length: int) -> np.ndarray:
        """Of all stretches of that length."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys (van Herk's two passes over blocks)."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def digests(data, starts: Iterable[int], ends: Iterable[int]) -> np.ndarray:
    """XXH3 digests of 128 bits, two longs each, of stretches of bytes."""
    from xxhash import xxh3_128_digest

    pieces = map(memoryview(data).__getitem__, map(slice, starts, ends))
    return np.frombuffer(b"".join(map(xxh3_128_digest, pieces)), dtype="<i8").reshape(-1, 2)


def minimizer_runs(values: np.ndarray, ends: np.ndarray, width: int, gram: int, table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of ``width`` units in documents laid end to end, as runs that share the occurrence of their minimizer.

    A window's minimizer is its gram of ``gram`` units with the least hash, the leftmost of equals. Yields (start, windows,
    minimizer's offset in the first window, minimizer's hash). ends: where each document ends; table: unit -> hash.
    """
    for low in range(0, len(values) - width + 1, CHUNK):
        own = values[low : low + CHUNK + width - 1]
        grams = Prefix(own if table is None else table[own]).every(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = (sliding_least((grams & ~LOW) | place, width - gram + 1) & LOW).astype(np.int64)
        # windows that end inside the document in which they start
        starts = np.arange(low, low + len(least))
        inside = np.flatnonzero(starts + width <= ends[np.searchsorted(ends, starts, side="right")])
        if not len(inside):
            continue
        anchors = least[inside]
        cut = np.flatnonzero((anchors[1:] != anchors[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1
        first, last = inside[np.r_[0, cut]], inside[np.r_[cut - 1, len(inside) - 1]]
        anchor = anchors[np.r_[0, cut]]
        yield first + low, last - first + 1, anchor - first, grams[anchor]
