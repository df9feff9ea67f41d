from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import near_dedup as N
from tidewire.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """{row number: (set size, component id)}"""
    sets = [shingles(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(i)] = root(j)
    members = {}
    for i, (d, *_) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    out = []
    for i, x in enumerate(sets):
        ids = [d for d in members[root(i)] if d is not None]
        out.append((rows[i][0], len(x), min(ids, default=None)))
    return sorted(out, key=str)


def compare(table, rows, **options):
    got = N.find_components(table(rows), **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_odd_rows(table, odd_rows):
    compare(table, odd_rows)


def test_chains_groups_and_near_misses(table):
    rng = random.Random(11)
    rows = []

    def add(w):
        rows.append((len(rows) * 7 % 1009, " ".join(w), None, None))

    drift = words(rng, 120)
    for k in range(40):  # a chain whose ends have nothing in common
        add(drift[k * 4 :] + words(rng, k * 4) if k < 30 else drift)
    base = words(rng, 150)
    for _ in range(60):  # near copies of one text, some just below the threshold to each other
        w = list(base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        add(w)
    passage = words(rng, 40)
    for _ in range(60):  # a shared passage that does not make near copies
        add(words(rng, 60) + passage)
    for _ in range(30):
        a = words(rng, 20)
        add(a)
        cut = rng.randrange(1, 5)
        add([*a[cut:], *words(rng, rng.randrange(0, 2))])
    compare(table, rows)
    # Buckets cut into many small chunks, by members and by shingles.
    compare(table, rows, block=5)
    compare(table, rows, block_set=900)


def test_white_space_of_all_kinds(table):
    text = "one\x0btwo\x0cthree\rfour five six seven eight nine ten"
    compare(table, [(1, text, None, None), (2, " ".join(text.split()), None, None), (3, "a\x0bb\rc", None, None)])


def test_alike_without_links(table):
    """Hundreds of edited copies of one text, most pairs below the threshold."""
    rng = random.Random(4)
    base = words(rng, 200)
    rows = []
    for k in range(700):
        w = list(base)
        for _ in range(rng.choice((6, 9, 12))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), None, None))
    compare(table, rows)
    compare(table, rows, block=100)


def test_no_rows(table):
    assert N.find_components(table([])).count() == 0


def test_keep_one(table, odd_rows):
    kept = N.keep_one(table(odd_rows))
    assert kept.columns == table(odd_rows).columns
    ids = sorted(r["doc_id"] or -1 for r in kept.collect())
    assert ids == [-1, 1, 4, 5, 6, 7, 8, 10, 11, 12]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, 4000).astype(np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (np.maximum(N.registers(a), N.registers(b)) == N.registers(both)).all()
    for share, expected in ((0.9, True), (0.2, False)):
        n = int(4000 * share)
        x, y = N.registers(a), N.registers(np.concatenate([a[:n], b[n:]]))
        ok = N.worth_verifying(
            np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([4000.0]), np.array([4000.0]), 0.75
        )
        assert bool(ok[0]) is expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25))
def test_components(spark, pairs):
    got = connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()
    reach = {n: {n} for p in pairs for n in p}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
            reach[b] |= reach[a]
    assert {r["node"]: r["label"] for r in got} == {n: min(v) for n, v in reach.items()}
