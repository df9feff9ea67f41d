"""A compressed FM-index over integer texts, searched for many patterns at once.

The Burrows-Wheeler transform is held as a wavelet matrix of packed bit vectors with a rank sample
per 64 bits. Suffixes are ordered by their first 16 symbols, which is all that patterns of up to 16
symbols can tell apart; their intervals and counts are those of a full order.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask).astype(np.int64)


class _WaveletMatrix:
    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for level in range(levels - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            self.levels.append((level, _Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def places(self, symbols: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """Where each symbol's occurrences before each position end on the last level."""
        out = list(positions)
        for level, bits, zeros in self.levels:
            ones = (symbols >> level) & 1 == 1
            for k, p in enumerate(out):
                r = bits.rank(p)
                out[k] = np.where(ones, zeros + r, p - r)
        return out


class FMIndex:
    """Index of a text of symbols 0 to ``size - 1``.

    0 separates parts, ends the text and is in no pattern.
    """

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        rank = text.astype(np.int64)
        width = 1
        while width < DEPTH:
            later = np.zeros(n, np.int64)
            later[: max(n - width, 0)] = rank[width:] + 1
            _, rank = np.unique(rank * (n + size + 2) + later, return_inverse=True)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        previous = text[self.suffixes - 1].astype(np.int64)
        levels = max(1, int(size - 1).bit_length())
        self.tree = _WaveletMatrix(previous, levels)
        everything = np.arange(size)
        self.base = self.tree.places(everything, np.zeros(size, np.int64))[0]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the rows of ``patterns``, by backward search."""
        last = patterns[:, -1]
        low, high = self.before[last], self.before[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[:, k]
            a, b = self.tree.places(symbol, low, high)
            start = self.before[symbol] - self.base[symbol]
            low, high = start + a, start + b
        return low, high
