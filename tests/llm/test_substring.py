from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tidewire.llm import substring_dedup as S
from tidewire.llm.fm_index import FMIndex

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    split = [(d, WORD.findall(t or "")) for d, t, _, _ in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - 12) if d is not None else ():
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12) if d is not None else ():
            if least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def compare(table, rows):
    got = S.find_repeats(table(rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == brute(rows)
    for r in got:
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def sample():
    rng = random.Random(4)

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    passages = [words(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for d in range(150):
        w = words(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            at, cut = rng.randrange(len(w) + 1), rng.randrange(0, 5)
            w[at:at] = p[cut:]
        rows.append((d * 37 % 151, " ".join(w), None, None))
    rows += [(500, "same " * 40, None, None), (501, "same " * 13, None, None), (499, "same " * 12, None, None)]
    return rows


def test_odd_rows(table, odd_rows):
    compare(table, odd_rows)


@pytest.mark.parametrize("hot", [5000, 3])
def test_passages(table, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    compare(table, sample())


def test_no_rows(table):
    assert S.find_repeats(table([])).count() == 0


def test_index_finds_all_places():
    rng = np.random.default_rng(7)
    for size, n, width in ((2, 50, 3), (5, 400, 4), (300, 3000, 2), (3, 200, 13)):
        text = rng.integers(1, size + 1, n)
        text[rng.integers(0, n, n // 20)] = 0
        text[-1] = 0
        index = FMIndex(text, size + 1)
        at = [i for i in range(n - width + 1) if text[i : i + width].all()]
        low, high = index.search(np.array([text[i : i + width] for i in at]))
        for i, a, b in zip(at, low, high):
            want = [j for j in range(n - width + 1) if (text[j : j + width] == text[i : i + width]).all()]
            assert sorted(index.suffixes[a:b].tolist()) == want
        absent = np.full((1, width), 1)
        if size > 2:
            absent[0] = rng.permutation(np.arange(1, size + 1))[:width] if width <= size else 1
        a, b = index.search(absent)
        count = sum((text[j : j + width] == absent[0]).all() for j in range(n - width + 1))
        assert int(b[0] - a[0]) == count
