"""SHA-256 of many messages side by side, with states that can be kept and resumed.

A digest written as hex text is exactly one 64-byte block, so the state of a hash over digests after
any of them is eight words with nothing buffered. That state can be copied, stored and resumed.
"""

from __future__ import annotations

import numpy as np

U32 = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(p: int, degree: int) -> int:
    """The first 32 bits after the point of the square or cube root of ``p``."""
    whole = p << (32 * degree)
    low, high = 0, 1 << 40
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**degree <= whole else (low, mid - 1)
    return low & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], U32)
_ROUND = [U32(_root_bits(p, 3)) for p in _primes(64)]
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fresh(n: int) -> np.ndarray:
    """``n`` states before the first block, one per column."""
    return np.repeat(START[:, None], n, axis=1)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> U32(k)) | (x << U32(32 - k))


def _compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states (8, n) after one more block (16, n) each."""
    w = list(words)
    for k in range(16, 64):
        a, b = w[k - 15], w[k - 2]
        low = _turn(a, 7) ^ _turn(a, 18) ^ (a >> U32(3))
        high = _turn(b, 17) ^ _turn(b, 19) ^ (b >> U32(10))
        w.append(w[k - 16] + low + w[k - 7] + high)
    a, b, c, d, e, f, g, h = state
    for k in range(64):
        s1 = _turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)
        one = h + s1 + (g ^ (e & (f ^ g))) + _ROUND[k] + w[k]
        s0 = _turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)
        two = s0 + ((a & b) ^ (c & (a ^ b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states (8, n) after the hex text of one digest (8, n) each."""
    if not state.shape[1]:
        return state
    raw = np.ascontiguousarray(digests.T.astype(">u4")).view(np.uint8)
    text = np.empty((raw.shape[0], 64), np.uint8)
    text[:, 0::2] = _HEX[raw >> 4]
    text[:, 1::2] = _HEX[raw & 15]
    return _compress(state, text.view(">u4").astype(U32).T)


def finish(state: np.ndarray, n_digests: np.ndarray) -> np.ndarray:
    """The digests (8, n) of states that have taken so many digests."""
    if not state.shape[1]:
        return state
    last = np.zeros((16, state.shape[1]), U32)
    last[0] = 0x80000000
    bits = n_digests.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return _compress(state, last)


def to_bytes(lanes: np.ndarray) -> np.ndarray:
    """(8, n) words as n rows of 32 bytes."""
    return np.ascontiguousarray(lanes.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def from_bytes(rows: np.ndarray) -> np.ndarray:
    """n rows of 32 bytes as (8, n) words."""
    return np.ascontiguousarray(rows).view(">u4").astype(U32).reshape(-1, 8).T

