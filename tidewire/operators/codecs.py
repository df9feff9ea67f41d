"""Binary payload codecs on Arrow buffers.

IEEE doubles have no byte form in SQL, so whole payloads are packed and unpacked in ``mapInArrow``.
Runs of rows of bounded size are worked on as a whole: fields are cut out of, or joined into, byte
buffers by arithmetic on their offsets. Rows are independent: no shuffle, and malformed input gives an error text instead
of a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.schemas import KIND_COMPLEX, KIND_NAMES

MAX_TEXT = 65535

_SHORT = "payload ends early"
_NOT_TEXT = "text is not UTF-8"
_TOO_LONG = f"text longer than {MAX_TEXT} bytes"
_NULL_TEXT = "a text in the list is null"
_HEAD = np.dtype([("kind", "u1"), ("size", "<u8")])
#: Bytes of a batch that are worked on together; a larger row stands alone.
_SLICE = 4 << 20
#: Rows below which the texts of binary lists are found row by row.
_FEW = 8


def _valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary or text column, and start and end of each value; nulls are empty."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return found, bounds[:-1], np.where(_valid(column), bounds[1:], bounds[:-1])


def _list_ranges(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of a list column, and start and end of each list; null lists are empty."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values, bounds[:-1], np.where(_valid(column), bounds[1:], bounds[:-1])


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, valid=None) -> pa.Array:
    """Intervals of ``data``, in order and apart from each other, as one binary value each."""
    bounds = np.stack([starts, starts + sizes], 1).ravel().astype(np.int32)
    # Every second value is the gap between two intervals.
    whole = pa.Array.from_buffers(
        pa.binary(),
        max(len(bounds) - 1, 0),
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))],
    )
    mask = None if valid is None else ~valid
    return whole.take(pa.array(np.arange(0, len(bounds), 2), mask=mask))


def _fixed(records: np.ndarray, wanted: np.ndarray | None = None) -> pa.Array:
    """The bytes of each record; empty where it isn't wanted."""
    width = records.dtype.itemsize * (records.shape[1] if records.ndim == 2 else 1)
    sizes = np.full(len(records), width)
    if wanted is not None:
        sizes = np.where(wanted, sizes, 0)
    flat = np.frombuffer(records.tobytes(), np.uint8)
    return _pieces(flat, np.arange(len(records)) * width, sizes)


def _content(column: pa.Array) -> np.ndarray:
    """The bytes of all values, one after another."""
    data, starts, ends = _ranges(column)
    return data[starts[0] : ends[-1]] if len(starts) else data[:0]


def _not_text(column: pa.Array) -> np.ndarray:
    """Which binary values are not UTF-8. They are looked at one by one only if there are any."""
    try:
        column.cast(pa.string())
        return np.zeros(len(column), bool)
    except pa.ArrowInvalid:
        pass

    def wrong(value: bytes | None) -> bool:
        try:
            (value or b"").decode()
            return False
        except UnicodeDecodeError:
            return True

    return np.fromiter(map(wrong, column.to_pylist()), bool, len(column))


class _Errors:
    """The first error of every row."""

    def __init__(self, n: int):
        self.texts = np.full(n, None, object)
        self.ok = np.ones(n, bool)

    def add(self, rows: np.ndarray, text: str) -> None:
        self.texts[rows & self.ok] = text
        self.ok &= ~rows

    def column(self) -> pa.Array:
        return pa.array(self.texts, pa.string())


class _Cursor:
    """A place in every row of a binary column; rows that end early get an error."""

    def __init__(self, column: pa.Array, errors: _Errors):
        self.data, self.at, self.end = _ranges(column)
        self.at, self.errors = self.at.copy(), errors

    def skip(self, counts: np.ndarray, width: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of ``counts`` items of ``width`` bytes, which are passed over."""
        left = ((self.end - self.at) // width).astype(np.uint64)
        self.errors.add(rows & (counts > left), _SHORT)
        sizes = np.where(rows & self.errors.ok, counts, np.uint64(0)).astype(np.int64) * width
        starts = self.at.copy()
        self.at += sizes
        return starts, sizes

    def number(self, width: int, rows: np.ndarray) -> np.ndarray:
        """The little-endian number at the place; 0 in other rows."""
        starts, sizes = self.skip(np.ones(len(rows), np.uint64), width, rows)
        found = np.zeros((len(rows), 8), np.uint8)
        have = np.flatnonzero(sizes)
        found[have, :width] = self.data[starts[have, None] + np.arange(width)]
        return found.view("<u8").ravel()


def _lists(sizes: np.ndarray, values: pa.Array, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, type=kind, mask=pa.array(~valid))


def _double_lists(packed: pa.Array, valid: np.ndarray) -> pa.Array:
    _, starts, ends = _ranges(packed)
    values = pa.array(np.frombuffer(_content(packed).tobytes(), "<f8"))
    return _lists((ends - starts) // 8, values, valid, pa.list_(pa.float64()))


def _double_bytes(column: pa.Array, valid: np.ndarray | None = None) -> pa.Array:
    """The little-endian doubles of each list; a null element becomes NaN."""
    values, starts, ends = _list_ranges(column)
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f8")
    return _pieces(flat.view(np.uint8), starts * 8, (ends - starts) * 8, valid)


def _check_texts(column: pa.Array, rows: np.ndarray, errors: _Errors) -> np.ndarray:
    """Sizes of the elements of a text list column; lists with unfit texts get an error."""
    values, starts, ends = _list_ranges(column)
    _, first, last = _ranges(values)
    sizes = last - first
    for unfit, text in ((~_valid(values), _NULL_TEXT), (sizes > MAX_TEXT, _TOO_LONG)):
        upto = np.concatenate([[0], np.cumsum(unfit)])
        errors.add(rows & (upto[ends] > upto[starts]), text)
    return sizes


def _pack_payloads(message_id, kind, data, doubles, strings):
    """``wire`` and errors."""
    n = len(kind)
    errors = _Errors(n)
    ids = message_id.fill_null("").cast(pa.binary())
    data = data.fill_null(b"")
    id_sizes, sizes = (pc.binary_length(c).to_numpy().astype(np.int64) for c in (ids, data))
    errors.add(id_sizes > MAX_TEXT, f"message id longer than {MAX_TEXT} bytes")
    codes = kind.cast(pa.int64()).fill_null(-1).to_numpy()
    errors.add((codes < 0) | (codes > 255), "kind is not a byte")
    complex_ = codes == KIND_COMPLEX
    head = np.zeros(n, _HEAD)
    head["kind"], head["size"] = codes & 255, sizes
    text_sizes = _check_texts(strings, complex_, errors)
    texts, first, last = _list_ranges(strings)
    text_data, starts, _ = _ranges(texts)
    bounds = np.append(starts, starts[-1] + text_sizes[-1]) if len(starts) else np.zeros(1, np.int64)
    _, some, end = _list_ranges(doubles)
    counts = np.where(complex_, last - first, 0)
    text_bytes = np.where(complex_, bounds[last] - bounds[first], 0)
    wire = pc.binary_join_element_wise(
        _fixed((id_sizes & MAX_TEXT).astype("<u2")),
        ids,
        _fixed(head),
        data,
        _fixed((end - some).astype("<u8"), complex_),
        pc.if_else(pa.array(complex_), _double_bytes(doubles), b""),
        _fixed(np.stack([text_bytes, counts], 1).astype("<u8"), complex_),
        _pieces((text_sizes & MAX_TEXT).astype("<u2").view(np.uint8), first * 2, counts * 2),
        _pieces(text_data, bounds[first], text_bytes),
        pa.scalar(b"", pa.binary()),
    )
    return [pc.if_else(pa.array(errors.ok), wire, pa.scalar(None, pa.binary()))], errors


def _unpack_payloads(wire):
    """``message_id, kind, bytes, doubles, strings`` and errors."""
    n = len(wire)
    errors = _Errors(n)
    at = _Cursor(wire, errors)
    every = np.ones(n, bool)
    ids = at.skip(at.number(2, every), 1, every)
    errors.add(_not_text(_pieces(at.data, *ids)), _NOT_TEXT)
    codes = at.number(1, every).astype(np.int64)
    for code in np.setdiff1d(codes, list(KIND_NAMES)):
        errors.add(codes == code, f"unknown kind {code}")
    data = at.skip(at.number(8, every), 1, every)
    complex_ = codes == KIND_COMPLEX
    doubles = at.skip(at.number(8, complex_), 8, complex_)
    at.number(8, complex_)
    lengths = at.skip(at.number(8, complex_), 2, complex_)
    sizes = np.frombuffer(_content(_pieces(at.data, *lengths)).tobytes(), "<u2").astype(np.int64)
    row = np.repeat(np.arange(n), lengths[1] // 2)
    totals = np.bincount(row, weights=sizes, minlength=n).astype(np.uint64)
    begin, _ = at.skip(totals, 1, complex_)
    keep = errors.ok[row]
    row, sizes = row[keep], sizes[keep]
    # A text starts where the texts of its row start, behind those before it.
    upto = np.cumsum(sizes) - sizes
    before = np.searchsorted(row, np.arange(n))
    starts = begin[row] + upto - upto[before[row]]
    texts = _pieces(at.data, starts, sizes)
    wrong = _not_text(texts)
    if wrong.any():
        errors.add(np.isin(np.arange(n), row[wrong]), _NOT_TEXT)
        texts, row = texts.filter(pa.array(errors.ok[row])), row[errors.ok[row]]
    ok = errors.ok
    listed = ok & complex_

    def field(place: tuple[np.ndarray, np.ndarray], have: np.ndarray) -> pa.Array:
        return _pieces(at.data, place[0], np.where(have, place[1], 0), have)

    return [
        field(ids, ok).cast(pa.string()),
        pa.array(codes.astype(np.uint8).view(np.int8), pa.int8(), mask=~ok),
        field(data, ok),
        _double_lists(field(doubles, listed), listed),
        _lists(np.bincount(row, minlength=n), texts.cast(pa.string()), listed, pa.list_(pa.string())),
    ], errors


def _pack_lists(doubles, strings):
    """``doubles_bin, strings_bin`` and errors."""
    errors = _Errors(len(doubles))
    sizes = _check_texts(strings, np.ones(len(strings), bool), errors)
    texts, first, last = _list_ranges(strings)
    entries = pc.binary_join_element_wise(
        _fixed((sizes & MAX_TEXT).astype("<u2")),
        texts.cast(pa.binary()).fill_null(b""),
        pa.scalar(b"", pa.binary()),
    )
    data, starts, ends = _ranges(entries)
    bounds = np.append(starts, ends[-1]) if len(ends) else np.zeros(1, np.int64)
    return [
        _double_bytes(doubles, _valid(doubles) & errors.ok),
        _pieces(data, bounds[first], bounds[last] - bounds[first], _valid(strings) & errors.ok),
    ], errors


def _entries(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start and size of the texts of binary lists. A cut tail ends its list.

    All rows take a step at a time, so rows of few texts cost no call each.
    """
    at = at.copy()
    found = [np.zeros((3, 0), np.int64)]
    active = np.flatnonzero(at + 2 <= end)
    while len(active) >= _FEW:
        here = at[active]
        sizes = data[here].astype(np.int64) | data[here + 1].astype(np.int64) << 8
        whole = here + 2 + sizes <= end[active]
        active, here, sizes = active[whole], here[whole], sizes[whole]
        found.append(np.stack([active, here + 2, sizes]))
        at[active] = here + 2 + sizes
        active = active[at[active] + 2 <= end[active]]
    view = memoryview(np.ascontiguousarray(data))
    for row in active.tolist():
        here, stop, places = int(at[row]), int(end[row]), []
        while here + 2 <= stop:
            size = view[here] | view[here + 1] << 8
            if here + 2 + size > stop:
                break
            places.append((row, here + 2, size))
            here += 2 + size
        found.append(np.array(places, np.int64).reshape(-1, 3).T)
    row, starts, sizes = np.concatenate(found, 1)
    order = np.argsort(row, kind="stable")
    return row[order], starts[order], sizes[order]


def _unpack_lists(doubles, strings):
    """``doubles, strings`` and errors."""
    n = len(doubles)
    errors = _Errors(n)
    data, starts, ends = _ranges(strings)
    row, at, sizes = _entries(data, starts, ends)
    texts = _pieces(data, at, sizes)
    wrong = _not_text(texts)
    if wrong.any():
        errors.add(np.isin(np.arange(n), row[wrong]), _NOT_TEXT)
        texts, row = texts.filter(pa.array(errors.ok[row])), row[errors.ok[row]]
    numbers, first, last = _ranges(doubles)
    whole = np.where(errors.ok, (last - first) // 8 * 8, 0)
    return [
        _double_lists(_pieces(numbers, first, whole), _valid(doubles) & errors.ok),
        _lists(
            np.bincount(row, minlength=n),
            texts.cast(pa.string()),
            _valid(strings) & errors.ok,
            pa.list_(pa.string()),
        ),
    ], errors


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of bounded size, as a batch is bounded by its rows alone."""
    if len(batch) < 2 or batch.nbytes <= _SLICE:
        yield batch
        return
    half = len(batch) // 2
    yield from _slices(batch.slice(0, half))
    yield from _slices(batch.slice(half))


def _own(column: pa.Array) -> pa.Array:
    """The values of a slice without those of the batch around it."""
    return column.take(pa.array(np.arange(len(column))))


def _batch_codec(
    df: DataFrame, inputs: list[str], outputs: list[T.StructField], fn: Callable
) -> DataFrame:
    """Add ``outputs`` and ``error``, made by ``fn`` from the input columns of a batch."""
    fields = [*outputs, T.StructField("error", T.StringType())]
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in _slices(whole)):
            if not len(batch):
                continue
            made, errors = fn(*(_own(batch.column(c)) for c in inputs))
            new = [*made, errors.column()]
            new = [c.cast(f.type) for c, f in zip(new, list(arrow)[-len(new) :])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return df.mapInArrow(run, schema)


def encode_payloads(df: DataFrame) -> DataFrame:
    """Add ``wire`` to rows with message_id, kind, bytes, doubles, strings.

    Null ids, bytes and lists count as empty. A kind that is no byte, a null text and a text or id
    that is too long give an error.
    """
    return _batch_codec(
        df,
        ["message_id", "kind", "bytes", "doubles", "strings"],
        [T.StructField("wire", T.BinaryType())],
        _pack_payloads,
    )


def decode_payloads(df: DataFrame, wire: str = "wire") -> DataFrame:
    """Add the payload fields of ``wire``; damaged and null rows carry an error text."""
    return _batch_codec(
        df,
        [wire],
        [
            T.StructField("message_id", T.StringType()),
            T.StructField("kind", T.ByteType()),
            T.StructField("bytes", T.BinaryType()),
            T.StructField("doubles", T.ArrayType(T.DoubleType())),
            T.StructField("strings", T.ArrayType(T.StringType())),
        ],
        _unpack_payloads,
    )


def encode_lists(df: DataFrame) -> DataFrame:
    """Add the binary forms of ``doubles`` and ``strings``; null lists stay null."""
    return _batch_codec(
        df,
        ["doubles", "strings"],
        [T.StructField("doubles_bin", T.BinaryType()), T.StructField("strings_bin", T.BinaryType())],
        _pack_lists,
    )


def decode_lists(df: DataFrame) -> DataFrame:
    """Add ``doubles`` and ``strings`` read from their binary forms."""
    return _batch_codec(
        df,
        ["doubles_bin", "strings_bin"],
        [
            T.StructField("doubles", T.ArrayType(T.DoubleType())),
            T.StructField("strings", T.ArrayType(T.StringType())),
        ],
        _unpack_lists,
    )
