from __future__ import annotations

import re

import pytest

from tidewire.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text):
    """The row's columns, each template laid at every place of the text."""
    w = words(text)
    places, base, labels, score = [], set(), set(), 0.0
    for t in L.TEMPLATES:
        want = t.words.split()
        n = len(want)
        votes = {}
        for d in range(-n, len(w)):
            hit = {p for p in range(n - 1) if 0 <= d + p < len(w) - 1 and w[d + p : d + p + 2] == want[p : p + 2]}
            if hit:
                votes[d] = hit
        for d in votes:
            if t.exact:
                if len(votes[d]) == n - 1:
                    places.append(d)
                    base.add(t.label)
                    labels.add(t.label)
                    score = 1.0
                continue
            near = set().union(*(votes.get(e, ()) for e in range(d, d + L.SLACK + 1)))
            share = len(near | {p + 1 for p in near}) / n
            if share >= L.SHARE:
                labels.add(t.label)
                score = max(score, share)
    return (
        len(w), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
    )


def compare(table, rows):
    found = L.scan(table(rows))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, *_ in rows), key=str)
    return got


TEXTS = [
    "All Rights Reserved. cc by, CC-BY and cc/by; all rights all rights reserved",
    "cc by cc by by cc",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under the really free GNU general public license in its version 3 here",
    "licensed under the general public license",
    "Released under the MIT License. Released, under THE old mit license",
    "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
    "you may not use this file save in compliance with the license " * 3,
    "cc\x00by CKC BY cc by",
    "cc",
]


def test_odd_rows(table, odd_rows):
    compare(table, odd_rows)


def test_phrases_and_altered_notices(table):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)]
    rows += [(i % 3, f"x y {t} z", None, None) for i, t in enumerate(TEXTS)] + rows[:2]
    got = compare(table, rows)
    assert any(r[6] == "apache" and 0 < r[7] < 1 for r in got)


def test_long_text_with_many_places(table):
    text = "all rights reserved " * 40_000 + "released under the mit license"
    ((_, n, base, first, last, _, labels, score),) = L.scan(table([(1, text, None, None)])).collect()
    assert (n, base, first, last, labels, score) == (120_005, 40_000, 0, 119_997, "mit,reserved", 1.0)


def test_spans(table):
    text = "a b all rights reserved x licensed under the shiny apache license version 2 0 y all rights reserved"
    got = L.find_spans(table([(1, text, None, None), (1, text, None, None), (2, None, None, None)])).collect()
    assert sorted((r["doc_id"], r["label"], r["start"], r["end"], r["coverage"]) for r in got) == [
        (1, "apache", 6, 15, 1.0),
        (1, "reserved", 2, 5, 1.0),
        (1, "reserved", 16, 19, 1.0),
    ]


def test_own_templates_and_longer_runs(table):
    mine = (L.Template("x", "one two three four", True), L.Template("y", "five six seven eight nine ten"))
    docs = table([(1, "one two three four five six seven and eight nine ten", None, None)])
    assert L.scan(docs, templates=mine, run=3).first()["labels"] == "x,y"
    with pytest.raises(ValueError):
        L.scan(docs, templates=(L.Template("z", "one two"),), run=3)


def test_no_python_and_no_rows(table):
    found = L.scan(table([]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert found.count() == 0
