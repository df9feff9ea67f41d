"""Codecs against a plain reading and writing of the same bytes, row by row."""

from __future__ import annotations

import random
import struct

import pyarrow as pa
import pytest

from tidewire.operators import codecs

TEXTS = ["", "a", "é", "日本", "x" * 300, "end"]


def plain_wire(row):
    mid, kind, data, doubles, strings = row
    mid, data = (mid or "").encode(), data or b""
    if kind is None or not 0 <= kind <= 255 or len(mid) > 65535:
        return None
    out = struct.pack("<H", len(mid)) + mid + struct.pack("<BQ", kind, len(data)) + data
    if kind == 2:
        values, texts = doubles or [], strings or []
        if any(t is None or len(t.encode()) > 65535 for t in texts):
            return None
        texts = [t.encode() for t in texts]
        values = [float("nan") if v is None else v for v in values]
        out += struct.pack(f"<Q{len(values)}d", len(values), *values)
        out += struct.pack("<QQ", sum(map(len, texts)), len(texts))
        out += struct.pack(f"<{len(texts)}H", *map(len, texts)) + b"".join(texts)
    return out


def plain_fields(wire):
    at = 0

    def take(n):
        nonlocal at
        if n > len(wire) - at:
            raise ValueError
        at += n
        return wire[at - n : at]

    def number(n):
        return int.from_bytes(take(n), "little")

    try:
        mid = take(number(2)).decode()
        kind = number(1)
        if kind not in (0, 1, 2):
            return None
        data, doubles, strings = take(number(8)), None, None
        if kind == 2:
            n = number(8)
            doubles = list(struct.unpack(f"<{n}d", take(8 * n)))
            number(8)
            n = number(8)
            sizes = struct.unpack(f"<{n}H", take(2 * n))
            strings = [take(s).decode() for s in sizes]
        return mid, kind, data, doubles, strings
    except ValueError:
        return None


def plain_lists(doubles, strings):
    values = None
    if doubles is not None:
        n = len(doubles) // 8
        values = list(struct.unpack(f"<{n}d", doubles[: 8 * n]))
    texts = None
    if strings is not None:
        texts, at = [], 0
        while at + 2 <= len(strings):
            n = struct.unpack_from("<H", strings, at)[0]
            if at + 2 + n > len(strings):
                break
            try:
                texts.append(strings[at + 2 : at + 2 + n].decode())
            except ValueError:
                return None
            at += 2 + n
    return values, texts


def payload_rows(rnd, n):
    def some(make):
        return None if rnd.random() < 0.1 else make()

    return [
        (
            some(lambda: rnd.choice(TEXTS)),
            rnd.choice([0, 1, 2, 2, 2, 7, None]),
            some(lambda: rnd.randbytes(rnd.randrange(20))),
            some(lambda: [rnd.random() for _ in range(rnd.randrange(5))]),
            some(lambda: [rnd.choice(TEXTS) for _ in range(rnd.randrange(5))]),
        )
        for _ in range(n)
    ]


KINDS = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.string())]


def columns(rows, kinds, cut):
    """Columns of the rows as slices of longer ones, so that their offsets don't start at 0."""
    return [pa.array([r[k] for r in rows], t).slice(cut) for k, t in enumerate(kinds)]


@pytest.mark.parametrize("seed", range(8))
def test_payloads(seed):
    rnd = random.Random(seed)
    rows = payload_rows(rnd, rnd.choice([3, 60, 400]))
    rows[2] = ("id", 2, b"x", [None, 1.0], ["a", None])
    cut = rnd.randrange(3)
    (wire,), errors = codecs._pack_payloads(*columns(rows, KINDS, cut))
    want = [plain_wire(r) for r in rows[cut:]]
    assert wire.to_pylist() == want
    assert [e is None for e in errors.texts] == [w is not None for w in want]

    damaged = []
    for w in (w for w in want if w is not None):
        damaged.append(w)
        at, byte = rnd.randrange(len(w)), rnd.randrange(256)
        damaged.append(w[:at] + bytes([byte]) + w[at + 1 :])
        damaged.append(w[:at])
    damaged += [b"", None]
    fields, errors = codecs._unpack_payloads(pa.array(damaged, pa.binary()).slice(cut))
    got = list(zip(*(f.to_pylist() for f in fields)))
    for w, g, e in zip(damaged[cut:], got, errors.texts):
        expected = None if w is None else plain_fields(w)
        assert (e is not None) == (expected is None)
        assert repr(g) == repr(expected or (None,) * 5)


@pytest.mark.parametrize("seed", range(8))
def test_lists(seed):
    rnd = random.Random(seed)
    rows = [r[3:] for r in payload_rows(rnd, rnd.choice([3, 60, 400]))]
    rows.append(([2.5], ["many"] * 2000))
    cut = rnd.randrange(3)
    packed, errors = codecs._pack_lists(*columns(rows, KINDS[3:], cut))
    assert not any(errors.texts)
    back, errors = codecs._unpack_lists(*packed)
    assert list(zip(*(b.to_pylist() for b in back))) == rows[cut:]

    damaged = [(None, None), (b"", b""), (b"1234567", b"\x01"), (b"", b"\x01\x00\xff")]
    for a, b in zip(*(p.to_pylist() for p in packed)):
        a = a and a[: rnd.randrange(len(a) + 1)]
        if b:
            at = rnd.randrange(len(b))
            b = b[:at] + rnd.randbytes(1) + b[at + 1 :]
        damaged.append((a, b))
    back, errors = codecs._unpack_lists(*columns(damaged, [pa.binary(), pa.binary()], cut))
    got = list(zip(*(x.to_pylist() for x in back)))
    for d, g, e in zip(damaged[cut:], got, errors.texts):
        expected = plain_lists(*d)
        assert (e is not None) == (expected is None)
        assert repr(g) == repr(expected or (None, None))


def test_limits_and_empty_batches():
    long = [("i" * 65536, 1, b"", None, None), ("i", 2, b"", [], ["y" * 65536]), ("i" * 65535, 2, b"", [], ["y" * 65535])]
    (wire,), errors = codecs._pack_payloads(*columns(long, KINDS, 0))
    assert wire.to_pylist() == [plain_wire(r) for r in long]
    assert [bool(e) for e in errors.texts] == [True, True, False]
    assert "65535" in errors.texts[0] and "65535" in errors.texts[1]
    packed, errors = codecs._pack_lists(*columns([r[3:] for r in long], KINDS[3:], 0))
    assert [bool(e) for e in errors.texts] == [False, True, False]
    assert [p.is_valid().to_pylist() for p in packed] == [[False, False, True]] * 2
    huge = struct.pack("<H", 0) + struct.pack("<BQ", 1, 2**64 - 1)
    _, errors = codecs._unpack_payloads(pa.array([huge], pa.binary()))
    assert errors.texts[0] == "payload ends early"


def test_a_batch_is_worked_on_in_runs_of_bounded_size(monkeypatch):
    monkeypatch.setattr(codecs, "_SLICE", 4096)
    sizes = [0, 1, 300, 9000, 7, 0, 2500, 40] * 25
    rows = [(f"P0-{i}", 1 + i % 2, bytes([i % 251]) * n, [i * 1.5] * (n % 9), ["é", "x" * (n % 60)]) for i, n in enumerate(sizes)]
    names = ["message_id", "kind", "bytes", "doubles", "strings"]
    batch = pa.RecordBatch.from_arrays(columns(rows, KINDS, 0), names=names)
    seen, got = [], []

    def pack(*inputs):
        seen.append((len(inputs[0]), sum(c.get_total_buffer_size() for c in inputs)))
        return codecs._pack_payloads(*inputs)

    for part in codecs._slices(batch):
        (wire,), errors = pack(*(codecs._own(part.column(n)) for n in names))
        assert errors.ok.all()
        got += wire.to_pylist()
    assert got == [plain_wire(r) for r in rows]
    # Buffers are padded, so a run may take somewhat more; a large row stands alone.
    assert all(n == 1 or size < 3 * 4096 for n, size in seen) and len(seen) > 10
