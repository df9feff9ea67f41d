from __future__ import annotations

import re

import pytest

from tidewire.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").translate(LOWER))
        if not w:
            continue
        n = min(len(w), 10)
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [
    (1, "Three, four FIVE six seven eight nine ten eleven twelve thirteen"),
    (2, "straße naïve"),
    (2, "x"),
    (None, "word3x3 word4x4"),
    (3, None),
    (4, "--- !"),
    (10, "zero line next"),
]


@pytest.mark.parametrize("bound", [64_000_000, 40])
def test_odd_rows(spark, table, odd_rows, bound):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found, name = D.find_leaks(table(odd_rows), items, max_window_bytes=bound)
    assert name == "leaks_"
    got = sorted(
        (r["doc_id"] or -1, r[name]["n_words"], r[name]["n_hit"], r[name]["item_ids"]) for r in found.collect()
    )
    assert got == sorted((d or -1, *brute(t, ITEMS)) for d, t, _, _ in odd_rows)


def test_spans_point_into_the_original(spark, table):
    text = "Ünlike   «Straße»,\n NAÏVE ones: straße  naïve!"
    items = spark.createDataFrame([(2, "STRASSE straße naÏve"), (3, "straße naÏve")], "item_id long, text string")
    found, name = D.find_leaks(table([(1, text, None, None)]), items)
    (spans,) = found.first()[name]["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == []
    items = spark.createDataFrame([(3, "straße  naïve")], "item_id long, text string")
    found, name = D.find_leaks(table([(1, text, None, None)]), items)
    (spans,) = found.first()[name]["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["straße  naïve"]


def test_empty_tables(spark, table, odd_rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    found, name = D.find_leaks(table(odd_rows), none)
    assert found.where(f"{name}.n_hit > 0").count() == 0
    assert D.find_leaks(table([]), none)[0].count() == 0
