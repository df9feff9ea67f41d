"""Benchmark decontamination with one Aho-Corasick automaton.

Questions and answers of a benchmark are normalised to words (ASCII lower-cased, every run of
ASCII letters, digits and characters beyond ASCII is a word) and cut into windows of ten
consecutive words; an item of fewer words is one window. One automaton over all distinct windows
scans the normalised text of a document once. A hit is mapped to word numbers and to code point
positions of the original text.

Scale: the documents are read in one map without a shuffle. The benchmark is the only side that is
sent to the executors. Its size is measured first; beyond ``max_window_bytes`` its items are dealt
to several automata by hash, each below the bound, and the hits of all are united per row, so the
result does not depend on the bound.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import LOWER, as_bytes, col, free_name, text_or_empty

WINDOW = 10

# Bytes: word characters stay (A-Z lower-cased), other ASCII becomes a space. The length is kept.
_NORMAL = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

HITS = (
    "n_words bigint, items array<int>, words array<struct<first:bigint,last:bigint>>, "
    "spans array<struct<start:bigint,end:bigint>>"
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(words: list[bytes], length: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))]


def build(items: list[tuple[str | None, bytes]], length: int = WINDOW) -> tuple[bytes, list[str]]:
    """Pickled automaton input and the item names its item numbers stand for.

    An item without an id still marks words, under number -1.
    """
    names = sorted({i for i, _ in items if i is not None})
    number = {n: k for k, n in enumerate(names)}
    of: dict[tuple[bytes, ...], set[int]] = {}
    for i, text in items:
        for w in windows(normal_words(text), length):
            of.setdefault(w, set()).add(-1 if i is None else number[i])
    table = [(b" " + b" ".join(w) + b" ", len(w), sorted(k)) for w, k in of.items()]
    return pickle.dumps(table), names


_automata: dict[str, object] = {}


def automaton(table: bytes):
    """The automaton of a window table, built once per worker."""
    key = hashlib.sha256(table).hexdigest()
    if key not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, n, items in pickle.loads(table):
            a.add_word(pattern.decode("latin-1"), (n, items))
        a.make_automaton()
        _automata.clear()
        _automata[key] = a
    return _automata[key]


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals with inclusive ends, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: bytes, auto) -> tuple[int, list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """(words, item numbers, hit word intervals, hit code point spans) of one document."""
    plain = text.translate(_NORMAL)
    words = plain.split()
    if not words or not len(auto):
        return len(words), [], [], []
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(auto.iter(joined))
    if not hits:
        return len(words), [], [], []
    gaps = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    items: set[int] = set()
    found = []
    for end, (n, which) in hits:
        last = int(np.searchsorted(gaps, end)) - 1
        found.append((last - n + 1, last))
        items.update(which)
    found = merge(found)
    inside = np.frombuffer(plain, np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = [(int(points[starts[a]]), int(points[ends[b]])) for a, b in found]
    return len(words), sorted(items), found, spans


def _scanner(spark, table: bytes):
    sent = spark.sparkContext.broadcast(table)

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = automaton(sent.value)
        for texts in batches:
            rows = [scan(t or b"", auto) for t in as_bytes(texts)]
            yield pa.array(
                [
                    {
                        "n_words": n,
                        "items": items,
                        "words": [{"first": a, "last": b} for a, b in found],
                        "spans": [{"start": a, "end": b} for a, b in spans],
                    }
                    for n, items, found, spans in rows
                ],
                pa.struct(
                    [
                        ("n_words", pa.int64()),
                        ("items", pa.list_(pa.int32())),
                        ("words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ]
                ),
            )

    return hits


def _covered(words: Column) -> Column:
    """Number of words in a union of inclusive intervals."""
    return F.aggregate(
        F.array_sort(words),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(s["upto"], x["first"] - 1))).alias("n"),
            F.greatest(s["upto"], x["last"]).alias("upto"),
        ),
        lambda s: s["n"],
    )


def _named(items: Column, known: Column) -> Column:
    """Item names of item numbers, without those of items that have no id."""
    return F.transform(F.filter(items, lambda i: i >= 0), lambda i: F.get(known, i))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_window_bytes: int = 64_000_000,
) -> tuple[DataFrame, str]:
    """All columns of ``docs`` and one struct column more, whose name is the second result.

    The struct has ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``item_ids``
    (as strings, sorted) and ``spans`` (hits in the original text, code points, one list per
    automaton). Null texts and texts without words have no hits; items without words give no
    window; items without an id mark words but are not listed; equal item ids count once. Repeated
    rows each give a row. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    body = text_or_empty(col(benchmark, item_text))
    items = benchmark.select(col(benchmark, item_id).cast("string").alias("id"), body.alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total * window // max_window_bytes
    name = free_name(docs.columns, "leaks")
    out, held = docs, []
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(parts)) == k) if parts > 1 else items
        table, names = build([(r["id"], bytes(r["text"], "utf-8")) for r in mine.collect()], window)
        column = free_name(out.columns, f"hits{k}")
        out = out.withColumn(column, _scanner(spark, table)(col(docs, text).cast("string")))
        known = F.from_json(F.lit(json.dumps(names)), "array<string>")
        held.append((out[column], _named(out[column]["items"], known)))
    joined = F.struct(
        held[0][0]["n_words"].alias("n_words"),
        _covered(F.flatten(F.array(*[h["words"] for h, _ in held]))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[i for _, i in held])))).alias("item_ids"),
        F.array(*[h["spans"] for h, _ in held]).alias("spans"),
    )
    return out.withColumn(name, joined).select(*[col(docs, c) for c in docs.columns], name), name
