"""Payload contents, sizes and prefix decoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.schemas import KIND_COMPLEX, KIND_TERMINATION, TERMINATION_SUFFIX

# Fixed values of the generated contents.
FLAT_PERIOD = 251
COMPLEX_PERIOD = 199
DOUBLE_STEP = 1.111
DOUBLE_SHARE = 0.6
STRING_SHARE = 0.2

# Sizes that carry their rows in record batches, and the rest.
BATCH_TRANSPORTS = ["arrowflight_p2p", "arrowflight_bin_p2p"]
TOPIC_BATCH_TRANSPORT = "grpc_p2p"
ENVELOPE_TRANSPORT = "zeromq_p2p"

MIB = 1024 * 1024


def _text_bytes(strings: Column) -> Column:
    total = F.aggregate(
        strings, F.lit(0).cast("bigint"), lambda a, s: a + F.octet_length(s).cast("bigint")
    )
    return F.coalesce(total, F.lit(0).cast("bigint"))


def _count(items: Column) -> Column:
    return F.coalesce(F.array_size(items), F.lit(0)).cast("bigint")


def logical_size(data: Column, doubles: Column, strings: Column) -> Column:
    """Content bytes: raw bytes, eight per double, text bytes."""
    return (
        F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint")
        + _count(doubles) * 8
        + _text_bytes(strings)
    )


def wire_size(message_id: Column, kind: Column, data: Column, doubles: Column, strings: Column) -> Column:
    """Encoded length: id with u16 length, kind, u64 length and bytes, nested part."""
    head = F.octet_length(message_id).cast("bigint") + 11 + F.coalesce(F.octet_length(data), F.lit(0))
    nested = _count(doubles) * 8 + _count(strings) * 2 + _text_bytes(strings) + 24
    return head + F.when(kind == KIND_COMPLEX, nested).otherwise(F.lit(0))


def restamped_size(size: Column, old_id: Column, new_id: Column) -> Column:
    """Encoded length after the same contents get another id."""
    return size + F.octet_length(new_id) - F.octet_length(old_id)


def transport_row_size(tech: Column, topic: Column, message_id: Column, logical: Column, wire: Column) -> Column:
    """Bytes a transport reports for one message."""
    bare = F.octet_length(message_id) + 1 + logical
    return (
        F.when(tech.isin(BATCH_TRANSPORTS), bare)
        .when(tech == TOPIC_BATCH_TRANSPORT, bare + F.octet_length(topic))
        .when(tech == ENVELOPE_TRANSPORT, wire + 1 + F.octet_length(topic))
        .otherwise(wire)
    )


def batch_limit(payload_size: int) -> int:
    """Bytes after which a batch is closed."""
    return 16 * MIB if payload_size >= 4 * MIB else 8 * MIB


def _text_classes() -> list[tuple[int, int, int, int]]:
    """(digits, first offset, strings, string length) of the text offsets.

    Text ``str_<offset>`` starts at the offset it names, so its length only
    depends on the digits of the offset.
    """
    out, offset = [], 0
    for digits in range(1, 16):
        length = 4 + digits
        n = -(-(10**digits - offset) // length)
        out.append((digits, offset, n, length))
        offset += n * length
    return out


def generated_strings(target: Column) -> Column:
    """Texts that fill exactly ``target`` bytes, the last one cut to fit."""
    classes = F.array(
        *[
            F.struct(
                F.lit(o).cast("bigint").alias("at"),
                F.lit(n).cast("bigint").alias("n"),
                F.lit(length).cast("bigint").alias("len"),
            )
            for _, o, n, length in _text_classes()
        ]
    )
    used = F.filter(classes, lambda c: c["at"] < target)

    def texts(c: Column) -> Column:
        n = F.least(c["n"], F.ceil((target - c["at"]) / c["len"]).cast("bigint"))
        offsets = F.sequence(c["at"], c["at"] + (n - 1) * c["len"], c["len"])
        return F.transform(
            offsets,
            lambda o: F.substr(
                F.concat(F.lit("str_"), o.cast("string")),
                F.lit(1),
                F.least(c["len"], target - o).cast("int"),
            ),
        )

    return F.flatten(F.transform(used, texts))


def _repeated(n: Column, period: int, pattern: Column) -> Column:
    """``n`` bytes of a pattern of ``period`` bytes."""
    times = F.ceil(n / period).cast("int")
    return F.substr(
        F.repeat(pattern.cast("string"), times).cast("binary"), F.lit(1), n.cast("int")
    )


def _flat_bytes(n: Column, seq: Column) -> Column:
    """Byte i is i * seq modulo the period, so seq matters modulo the period only."""
    patterns = F.array(
        *[
            F.lit(bytes(i * s % FLAT_PERIOD for i in range(FLAT_PERIOD)))
            for s in range(FLAT_PERIOD)
        ]
    )
    own = F.get(patterns, F.pmod(seq, F.lit(FLAT_PERIOD)).cast("int"))
    return _repeated(n, FLAT_PERIOD, own)


def _mixed_bytes(n: Column, seq: Column) -> Column:
    """Byte i is i + seq modulo the period: one ramp, entered at seq."""
    ramp = F.lit(bytes(i % COMPLEX_PERIOD for i in range(2 * COMPLEX_PERIOD)))
    start = F.pmod(seq, F.lit(COMPLEX_PERIOD)).cast("int") + 1
    return _repeated(n, COMPLEX_PERIOD, F.substr(ramp, start, F.lit(COMPLEX_PERIOD)))


def generated_payload(publisher: Column, seq: Column, size: Column, kind: Column) -> Column:
    """Message id, kind and contents for a publisher, number, size and kind."""
    seq = seq.cast("bigint")
    is_complex = kind == KIND_COMPLEX
    is_end = kind == KIND_TERMINATION
    n_doubles = F.floor(F.floor(size * F.lit(DOUBLE_SHARE)) / 8).cast("bigint")
    text_bytes = F.floor(size * F.lit(STRING_SHARE)).cast("bigint")
    rest = size.cast("bigint") - n_doubles * 8 - text_bytes
    flat = _flat_bytes(size.cast("bigint"), seq)
    mixed = _mixed_bytes(rest, seq)
    doubles = F.when(
        n_doubles > 0,
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), n_doubles - 1),
            lambda i: i.cast("double") * F.lit(DOUBLE_STEP),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return F.struct(
        F.when(is_end, F.concat(publisher, F.lit(TERMINATION_SUFFIX)))
        .otherwise(F.concat(publisher, F.lit("-"), seq))
        .alias("message_id"),
        kind.cast("tinyint").alias("kind"),
        F.when(is_end, F.unhex(F.lit("FF"))).when(is_complex, mixed).otherwise(flat).alias("bytes"),
        F.when(is_complex, doubles).alias("doubles"),
        F.when(is_complex, generated_strings(text_bytes)).alias("strings"),
    )


def _byte(wire: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substr(wire, at, F.lit(1))), 16, 10).cast("int")


def id_from_wire(wire: Column, start: Column | int = 1) -> Column:
    """Message id from the head of an encoded payload; the rest is not touched."""
    at = start if isinstance(start, Column) else F.lit(start)
    length = _byte(wire, at) + _byte(wire, at + 1) * 256
    text = F.substr(wire, at + 2, length).cast("string")
    return F.when(F.octet_length(wire) >= at + 1 + length, text)


def topic_from_envelope(message: Column) -> Column:
    return F.substr(message, F.lit(2), _byte(message, F.lit(1))).cast("string")


def id_from_envelope(message: Column) -> Column:
    return id_from_wire(message, _byte(message, F.lit(1)) + 2)


def envelope(topic: Column, wire: Column) -> Column:
    """Topic with a one-byte length in front of the payload."""
    head = F.unhex(F.lpad(F.hex(F.octet_length(topic)), 2, "0"))
    return F.concat(head, topic.cast("binary"), wire)


def message_key(transport_key: Column, wire: Column) -> Column:
    """The transport's key, else the id inside the payload."""
    return F.coalesce(F.nullif(transport_key, F.lit("")), id_from_wire(wire))
