"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A block of ids is coded on its own: its models start from nothing, so any block can be decoded
without another. Three orders predict an id. The order-2 and order-1 models keep, per hashed
context, the last id seen there and how often it was right; adaptive hit probabilities, looked up
by both confidences and by whether the two agree, mix them into the mass each predicted id gets.
The order-0 model has adaptive frequencies of the high and low byte and gets the rest. The mixture
is one interval per id on a 64-bit carry-less range coder.

All arithmetic is on integers, so encoder and decoder agree on every machine. Blocks advance in
lockstep as numpy lanes: one step codes one id of every block.
"""

from __future__ import annotations

import numpy as np

#: Ids of a block and blocks that advance together.
BLOCK, LANES = 2048, 1024

U64 = np.uint64
TOTAL = 30
HALF = 11
FLOOR = np.int64(1 << 25)
_HIT_BITS = 16
_SLOT_BITS = 11
_TOP, _LOW_END = U64(1 << 48), U64(1 << 32)
_SHIFT = U64(16)
#: Steps before which the order-0 frequencies are made anew.
_RENEW = frozenset([16, 32, 64, 128, 256, 384, 512, 768, 1024, 1280, 1536, 1792])


class _Bytes:
    """Adaptive frequencies of one byte of the id, per lane; renewed now and then."""

    def __init__(self, lanes: int, decode: bool):
        self.counts = np.zeros((lanes, 256), np.int32)
        self.decode = decode
        self.at = np.arange(lanes) * 256
        self.cell = np.arange(lanes) << HALF
        self.renew()

    def renew(self) -> None:
        lanes = len(self.counts)
        weight = self.counts * 32 + 1
        total = weight.sum(1, dtype=np.int64)
        room = (1 << HALF) - 256
        freq = 1 + weight.astype(np.int64) * room // total[:, None]
        # The rounding rest goes to the most frequent byte.
        best = weight.argmax(1)
        freq[np.arange(lanes), best] += (1 << HALF) - freq.sum(1)
        self.freq = freq.ravel()
        self.start = (np.cumsum(freq, 1) - freq).ravel()
        if self.decode:
            symbols = np.tile(np.arange(256, dtype=np.uint8), lanes)
            self.symbol = np.repeat(symbols, self.freq)

    def find(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.symbol[self.cell[rows] + values].astype(np.int64)

    def add(self, symbols: np.ndarray, rows: np.ndarray) -> None:
        self.counts.ravel()[self.at[rows] + symbols] += 1


class _Models:
    """The predictions of all lanes, the same for encoder and decoder."""

    def __init__(self, lanes: int, decode: bool):
        self.rows = np.arange(lanes)
        self.slots = self.rows << _SLOT_BITS
        self.two = np.zeros(lanes << _SLOT_BITS, np.int32)
        self.one = np.zeros(lanes << _SLOT_BITS, np.int32)
        self.hit2 = np.full(lanes * 32, 1 << (_HIT_BITS - 2), np.int64)
        self.hit1 = np.full(lanes * 32, 1 << (_HIT_BITS - 2), np.int64)
        self.high = _Bytes(lanes, decode)
        self.low = _Bytes(lanes, decode)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, step: int) -> None:
        if step in _RENEW:
            self.high.renew()
            self.low.renew()
        mix = self.last * 0x9E3779B1
        self.at1 = self.slots + ((mix >> 9) & ((1 << _SLOT_BITS) - 1))
        mix = (self.last * 0x85EBCA6B) ^ (self.before * 0xC2B2AE35)
        self.at2 = self.slots + ((mix >> 13) & ((1 << _SLOT_BITS) - 1))
        held2 = self.two[self.at2].astype(np.int64)
        held1 = self.one[self.at1].astype(np.int64)
        self.guess2, self.sure2 = held2 >> 2, held2 & 3
        self.guess1, self.sure1 = held1 >> 2, held1 & 3
        same = self.guess2 == self.guess1
        self.context = self.rows * 32 + self.sure2 * 8 + self.sure1 * 2 + same
        p2 = np.maximum(self.hit2[self.context], 64)
        p1 = np.maximum(self.hit1[self.context], 64)
        free = np.int64(1 << TOTAL) - FLOOR
        self.mass2 = (free >> _HIT_BITS) * p2
        # An id that both orders name gets its mass once.
        self.mass1 = np.where(same, 0, ((free - self.mass2) >> _HIT_BITS) * p1)
        self.base = self.mass2 + self.mass1
        self.unit = ((1 << TOTAL) - self.base) >> (2 * HALF)

    def learn(self, ids: np.ndarray, rest: np.ndarray) -> None:
        """``rest``: the lanes whose id no order named."""
        right2, right1 = ids == self.guess2, ids == self.guess1
        self.hit2[self.context] += ((right2 * (1 << _HIT_BITS)) - self.hit2[self.context]) >> 5
        other = np.flatnonzero(~right2)
        at = self.context[other]
        self.hit1[at] += ((right1[other] * (1 << _HIT_BITS)) - self.hit1[at]) >> 5
        for held, where, guess, sure, right in (
            (self.two, self.at2, self.guess2, self.sure2, right2),
            (self.one, self.at1, self.guess1, self.sure1, right1),
        ):
            kept = (guess << 2) | np.where(right, np.minimum(sure + 1, 3), sure - 1)
            held[where] = np.where(right | (sure > 0), kept, ids << 2)
        lost = ids[rest]
        self.high.add(lost >> 8, rest)
        self.low.add(lost & 255, rest)
        self.before, self.last = self.last, ids


def _settled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes give up their top 16 bits, and the spans, cut where a carry could still come."""
    same = (low ^ (low + span)) < _TOP
    small = ~same & (span < _LOW_END)
    if small.any():
        span = np.where(small, (~low + U64(1)) & (_LOW_END - U64(1)), span)
    return np.flatnonzero(same | small), span


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The payload of every row of ``ids``; all are below 65536."""
    lanes, steps = ids.shape
    columns = np.ascontiguousarray(ids.T, np.uint16)
    m = _Models(lanes, False)
    low, span = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    out = np.zeros((lanes, 2 * steps + 8), "<u2")
    used = np.zeros(lanes, np.int64)
    for step in range(steps):
        m.predict(step)
        now = columns[step].astype(np.int64)
        right2 = now == m.guess2
        start = np.where(right2, 0, m.mass2)
        freq = np.where(right2, m.mass2, m.mass1)
        rest = np.flatnonzero(~right2 & (now != m.guess1))
        lost = now[rest]
        h, b = m.high.at[rest] + (lost >> 8), m.low.at[rest] + (lost & 255)
        hf, unit = m.high.freq[h], m.unit[rest]
        start[rest] = m.base[rest] + unit * ((m.high.start[h] << HALF) + hf * m.low.start[b])
        freq[rest] = unit * hf * m.low.freq[b]
        each = span >> U64(TOTAL)
        low = low + each * start.astype(U64)
        span = each * freq.astype(U64)
        at, span = _settled(low, span)
        while len(at):
            out[at, used[at]] = low[at] >> U64(48)
            used[at] += 1
            low[at] <<= _SHIFT
            span[at] <<= _SHIFT
            again, cut = _settled(low[at], span[at])
            span[at] = cut
            at = at[again]
        m.learn(now, rest)
    for k in range(4):
        out[np.arange(lanes), used + k] = (low >> U64(48 - 16 * k)) & U64(0xFFFF)
    return [out[k, : used[k] + 4].tobytes() for k in range(lanes)]


def decode_blocks(payloads: list[bytes], steps: int) -> np.ndarray:
    """The rows of ids that ``encode_blocks`` was given, each ``steps`` long."""
    lanes = len(payloads)
    m = _Models(lanes, True)
    words = np.zeros((lanes, max(map(len, payloads), default=0) // 2 + 8), "<u2")
    for k, p in enumerate(payloads):
        words[k, : len(p) // 2] = np.frombuffer(p, "<u2")
    used = np.full(lanes, 4)
    code = np.zeros(lanes, U64)
    for k in range(4):
        code = (code << _SHIFT) | words[:, k].astype(U64)
    low, span = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    columns = np.zeros((steps, lanes), np.int64)
    most = np.int64((1 << 2 * HALF) - 1)
    for step in range(steps):
        m.predict(step)
        each = span >> U64(TOTAL)
        value = ((code - low) // each).astype(np.int64)
        right2 = value < m.mass2
        now = np.where(right2, m.guess2, m.guess1)
        start = np.where(right2, 0, m.mass2)
        freq = np.where(right2, m.mass2, m.mass1)
        rest = np.flatnonzero(value >= m.base)
        unit = m.unit[rest]
        inner = np.minimum((value[rest] - m.base[rest]) // unit, most)
        high = m.high.find(inner >> HALF, rest)
        h = m.high.at[rest] + high
        hf = m.high.freq[h]
        inner -= m.high.start[h] << HALF
        byte = m.low.find(inner // hf, rest)
        b = m.low.at[rest] + byte
        now[rest] = (high << 8) | byte
        start[rest] = m.base[rest] + unit * ((m.high.start[h] << HALF) + hf * m.low.start[b])
        freq[rest] = unit * hf * m.low.freq[b]
        low = low + each * start.astype(U64)
        span = each * freq.astype(U64)
        at, span = _settled(low, span)
        while len(at):
            code[at] = (code[at] << _SHIFT) | words[at, used[at]].astype(U64)
            used[at] = np.minimum(used[at] + 1, words.shape[1] - 1)
            low[at] <<= _SHIFT
            span[at] <<= _SHIFT
            again, cut = _settled(low[at], span[at])
            span[at] = cut
            at = at[again]
        columns[step] = now
        m.learn(now, rest)
    return columns.T
