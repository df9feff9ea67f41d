"""Word hashes of many texts at once, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(texts: list[bytes], size: int = 500_000) -> Iterator[list[bytes]]:
    """Runs of texts of about that many bytes in all; a longer text ends its run."""
    held: list[bytes] = []
    n = 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Words:
    """Words of several texts in order: where they lie, their hashes, and the words per text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = (~_SPACE[self.data]).view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.cumsum(lengths + 1) - (lengths + 1)
        bounds = np.searchsorted(self.starts, np.append(self.text_starts, len(self.data)))
        self.first, self.counts = bounds[:-1], np.diff(bounds)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        sizes = self.ends - self.starts
        if not len(sizes):
            return np.zeros(0, U64)
        powers = np.cumprod(np.full(int(sizes.max()), _BASE, U64))
        upto = np.cumsum(sizes)
        place = np.arange(int(upto[-1])) - np.repeat(upto - sizes, sizes)
        letters = self.data[place + np.repeat(self.starts, sizes)].astype(U64) + U64(1)
        return mix(np.add.reduceat(letters * powers[place], upto - sizes))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from every place on; the last ``length - 1`` are missing."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for k in range(length):
        h = h * U64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(h)
