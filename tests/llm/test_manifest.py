from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import manifest as M
from tidewire.llm import sha_lanes


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """All levels of a tree, the last with its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def fold(levels, k, value):
    proof = ""
    for nodes in levels[:-1]:
        a = k - k % 3
        run = nodes[a : a + 3]
        proof += "".join(x for i, x in enumerate(run) if i != k % 3)
        run[k % 3] = value
        value, k = sha("".join(run)), k // 3
    return proof, value


def brute(rows, change):
    """rows: (doc_id, source, lang, n_chars, text)"""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = own, tree([leaf(r) for r in own])
    top = tree([trees[s][1][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        own, levels = trees[s]
        for k, r in enumerate(own):
            changed = r if r[4] is None else (*r[:4], change(r))
            lower, value = fold(levels, k, leaf(changed))
            upper, value = fold(top, i, value)
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[-1][0], root, sha(lower + upper), value, value == root))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, n int, pos string"


def compare(spark, rows, levels=M.LEVELS):
    docs = spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)
    even = F.col("doc_id") % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted((tuple(r) for r in M.build(docs, changed={"text": text}, levels=levels).collect()), key=str)
    assert got == brute(rows, lambda r: r[4].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 else r[4])


def test_lanes_match_the_library():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (50, 4, 32)).astype(np.uint8)
    count = np.arange(50) % 5
    state = sha_lanes.fresh(50)
    for k in range(4):
        has = count > k
        state[:, has] = sha_lanes.absorb(state[:, has], sha_lanes.from_bytes(rows[has, k]))
    got = sha_lanes.to_bytes(sha_lanes.finish(state, count))
    for i in range(50):
        text = "".join(rows[i, k].tobytes().hex() for k in range(count[i]))
        assert got[i].tobytes().hex() == sha(text)


def test_odd_rows(spark, odd_rows):
    compare(spark, [(d, s, lang, None if d == 8 else len(t or ""), t) for d, t, lang, s in odd_rows])


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_many_sizes(spark, levels):
    """Small blocks put several tiers on every source."""
    rng = random.Random(levels)
    rows = []
    for s, n in ((None, 1), ("", 3), ("a", 2), ("b", 9), ("c", 10), ("d", 82), ("é", 300), ("z", 27)):
        rows += [(len(rows) + k, s, "en", k, f"t{k}\n\n{'x' * (k % 7)}" if k % 5 else None) for k in range(n)]
    rng.shuffle(rows)
    compare(spark, rows, levels)


def test_one_source_and_one_row(spark):
    compare(spark, [(2, "a", None, 0, "")])
    compare(spark, [(k, "a", None, 0, "\n") for k in (1, 2, 2, 2, None)])


def test_many_small_sources(spark):
    compare(spark, [(k, f"host{k % 997}", "en", 1, "a\nb") for k in range(1500)])


def test_no_rows_and_no_changes(spark):
    assert M.build(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(k, "a", None, 0, "\n", "", 0, "") for k in range(30)], SCHEMA)
    assert M.build(docs).where("NOT verified").isEmpty()
