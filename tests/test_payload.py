"""Payload sizes, contents and codecs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import payload as pay
from tidewire.functions.labels import kind_code
from tidewire.operators.codecs import (
    decode_lists,
    decode_payloads,
    encode_lists,
    encode_payloads,
)
from tidewire.schemas import PAYLOAD_SCHEMA


def generated(spark, specs):
    df = spark.createDataFrame(specs, "pub string, seq bigint, size bigint, kind int")
    made = df.select(
        "*", pay.generated_payload(F.col("pub"), F.col("seq"), F.col("size"), F.col("kind")).alias("m")
    )
    m = [F.col(f"m.{c}") for c in ("bytes", "doubles", "strings")]
    return made.select(
        "pub",
        "seq",
        "size",
        "m.*",
        pay.logical_size(*m).alias("logical"),
        pay.wire_size(F.col("m.message_id"), F.col("m.kind"), *m).alias("wire_bytes"),
    )


def test_golden_sizes(spark):
    rows = generated(spark, [("pub", 1, 32, 1), ("pub", 2, 128, 2), ("pub", 3, 0, 0)]).collect()
    assert [(r["message_id"], r["logical"], r["wire_bytes"]) for r in rows] == [
        ("pub-1", 32, 48),
        ("pub-2", 128, 178),
        ("pub:__END__", 1, 23),
    ]
    assert list(rows[0]["bytes"]) == [i % 251 for i in range(32)]
    assert rows[1]["strings"] == ["str_0", "str_5", "str_10", "str_16", "str"]
    assert len(rows[1]["doubles"]) == 9 and rows[1]["doubles"][8] == 8 * 1.111
    assert list(rows[1]["bytes"]) == [(i + 2) % 199 for i in range(31)]
    assert bytes(rows[2]["bytes"]) == b"\xff"


def test_generated_contents_follow_the_rule(spark):
    rnd = random.Random(7)
    specs = [("P", rnd.randrange(1000), rnd.randrange(0, 9000), rnd.choice([1, 2])) for _ in range(40)]
    for r in generated(spark, specs).collect():
        size, seq = r["size"], r["seq"]
        assert r["logical"] == size
        if r["kind"] == 1:
            assert list(r["bytes"]) == [i * seq % 251 for i in range(size)]
            continue
        texts, used, target = [], 0, int(size * 0.2)
        while used < target:
            texts.append(f"str_{used}")
            used += len(texts[-1])
        if texts and used > target:
            texts[-1] = texts[-1][: len(texts[-1]) - (used - target)]
        assert r["strings"] == texts
        n = int(size * 0.6) // 8
        assert r["doubles"] == [i * 1.111 for i in range(n)]
        assert list(r["bytes"]) == [(i + seq) % 199 for i in range(size - 8 * n - target)]


PAYLOADS = [
    ("P0-1", 1, b"abc", None, None),
    ("P0-é", 2, b"", [1.5, float("inf"), -0.0], ["", "ü", "x" * 300]),
    ("P0:__END__", 0, b"\xff", None, None),
    ("P0-4", 2, b"\x00" * 5, [], []),
]


def test_round_trip_and_sizes(spark):
    df = spark.createDataFrame(PAYLOADS, PAYLOAD_SCHEMA)
    wired = encode_payloads(df)
    parts = [F.col(c) for c in ("message_id", "kind", "bytes", "doubles", "strings")]
    for r in wired.select(F.octet_length("wire").alias("n"), pay.wire_size(*parts).alias("w"), "error").collect():
        assert r["n"] == r["w"] and r["error"] is None
    back = decode_payloads(wired.select("wire")).collect()
    got = [(r["message_id"], r["kind"], bytes(r["bytes"]), r["doubles"], r["strings"]) for r in back]
    assert got == PAYLOADS
    ids = wired.select(pay.id_from_wire(F.col("wire")).alias("i")).collect()
    assert [r["i"] for r in ids] == [p[0] for p in PAYLOADS]
    enveloped = wired.select(pay.envelope(F.lit("töpic"), F.col("wire")).alias("m")).select(
        pay.topic_from_envelope(F.col("m")).alias("t"), pay.id_from_envelope(F.col("m")).alias("i")
    )
    assert {(r["t"], r["i"]) for r in enveloped.collect()} == {("töpic", p[0]) for p in PAYLOADS}


def test_damaged_payloads_give_errors(spark):
    whole = encode_payloads(spark.createDataFrame(PAYLOADS, PAYLOAD_SCHEMA)).collect()[1]["wire"]
    broken = [(bytes(whole[:n]),) for n in range(len(whole))] + [(b"\x01\x00A\x09" + b"\0" * 8,)]
    rows = decode_payloads(spark.createDataFrame(broken, "wire binary")).collect()
    assert all(r["error"] and r["message_id"] is None for r in rows)
    long = spark.createDataFrame([("i", 2, b"", [], ["x" * 70000])], PAYLOAD_SCHEMA)
    assert "65535" in encode_payloads(long).collect()[0]["error"]


def test_binary_lists(spark):
    rows = [([1.0, 2.5], ["a", "", "é"]), (None, None), ([], [])]
    packed = encode_lists(spark.createDataFrame(rows, "doubles array<double>, strings array<string>"))
    slim = packed.select("doubles_bin", "strings_bin")
    assert [(r["doubles"], r["strings"]) for r in decode_lists(slim).collect()] == rows
    cut = slim.limit(1).select(
        F.expr("substring(doubles_bin, 1, 12)").alias("doubles_bin"),
        F.expr("substring(strings_bin, 1, 6)").alias("strings_bin"),
    )
    r = decode_lists(cut).collect()[0]
    assert (r["doubles"], r["strings"]) == ([1.0], ["a", ""])


@pytest.mark.parametrize(
    "tech,want", [("kafka_p2p", 178), ("arrowflight_p2p", 134), ("grpc_p2p", 136), ("zeromq_p2p", 181)]
)
def test_transport_row_size(spark, tech, want):
    size = pay.transport_row_size(F.lit(tech), F.lit("ab"), F.lit("pub-2"), F.lit(128), F.lit(178))
    assert spark.range(1).select(size.alias("n")).first()["n"] == want


def test_kind_of_unknown_name(spark):
    names = spark.createDataFrame([("COMPLEX",), ("",), (None,), ("complex",)], "n string")
    assert [r["k"] for r in names.select(kind_code(F.col("n")).alias("k")).collect()] == [2, 1, 1, 1]
