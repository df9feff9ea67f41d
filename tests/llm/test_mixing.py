from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from tidewire.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, weights=(1, 2, 3), cap=3):
    size = [len(WORD.findall(t or "")) for _, t, _, _ in rows]
    total = defaultdict(int)
    for n, (*_, s) in zip(size, rows):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(total, 0.0)
    free, rest = set(total), float(sum(size))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * total[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = float(cap * total[s])
            rest -= target[s]
        free -= over
    out = Counter()
    for n, (d, _, _, s) in zip(size, rows):
        rate = min(target[s] / total[s], cap) if total[s] else 0.0
        key = f"mix:{'' if d is None else d}".encode()
        u = int(hashlib.md5(key).hexdigest()[:13], 16) / 2**52
        out[d, n, s, math.floor(rate) + (u < rate - math.floor(rate))] += 1
    return out, target


def check(table, rows):
    planned, names = mixing.plan_copies(table(rows))
    got = planned.collect()
    want, target = brute(rows)
    assert Counter((r["doc_id"], r[names["size"]], r["source"], r[names["copies"]]) for r in got) == want
    for r in got:
        assert r[names["target"]] == pytest.approx(target[r["source"]])
    emitted = mixing.mix(table(rows))
    assert emitted.columns == table(rows).columns
    assert emitted.count() == sum(k[3] * n for k, n in want.items())


def test_odd_rows(table, odd_rows):
    check(table, odd_rows)


def test_caps_are_reshared(table):
    rows = [(i, "w " * (1 + i % 7), None, "big") for i in range(300)]
    rows += [(1000 + i, "w " * 3, None, s) for i, s in enumerate(["small"] * 5 + [None] * 4 + ["tiny"])]
    check(table, rows)


def test_totals_come_near_targets(table):
    rows = [(i, "w " * (1 + i % 9), None, f"s{i % 4 if i % 3 else 0}") for i in range(4000)]
    planned, names = mixing.plan_copies(table(rows))
    taken, target = defaultdict(int), {}
    for r in planned.collect():
        taken[r["source"]] += r[names["copies"]] * r[names["size"]]
        target[r["source"]] = r[names["target"]]
        assert r[names["copies"]] <= 3
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.1)


def test_no_words_and_no_rows(table):
    planned, names = mixing.plan_copies(table([(1, None, None, "a"), (2, " ", None, None)]))
    assert [(r[names["target"]], r[names["copies"]]) for r in planned.collect()] == [(0.0, 0)] * 2
    assert mixing.mix(table([])).count() == 0


def test_plan_is_native(table, odd_rows):
    plan = mixing.mix(table(odd_rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan.split("== Physical Plan ==")[-1])
