from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import exact_dedup as E


def test_odd_rows(table, odd_rows):
    got = E.find_copies(table(odd_rows)).collect()
    groups = defaultdict(list)
    for d, t, _, _ in odd_rows:
        groups[t or ""].append(d)
    assert len(got) == len(odd_rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    kept = defaultdict(int)
    for r in got:
        g = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(g) and r["doc_id"] in g
        assert r["keep_id"] == max((d for d in g if d is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_copies_and_edits_of_long_texts(table):
    rng = random.Random(3)
    base = " ".join(rng.choice("alpha beta gamma delta".split()) + str(i) for i in range(9000))
    edited = base[:20_000] + "!" + base[20_000:]
    rows = [(i, base if i % 3 else edited, None, None) for i in range(30)] + [(99, base[1:], None, None)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in E.find_copies(table(rows)).collect()}
    assert got[1] == (29, 20) and got[0] == (27, 10) and got[99] == (99, 1)


def test_no_rows(table):
    assert E.find_copies(table([])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=40).flatmap(lambda b: st.integers(1, 600).map(lambda n: b * n)), max_size=5))
def test_chunks_rebuild_every_text(texts):
    made = list(E.chunks(texts))
    assert [b"".join(c) for c in made] == texts
    assert all(len(p) <= E.MOST for c in made for p in c)
    # A text is cut alike whatever stands before it.
    assert made == [next(iter(E.chunks([t]))) for t in texts]


def test_an_edit_changes_few_chunks():
    rng = random.Random(5)
    base = bytes(rng.randrange(97, 123) for _ in range(200_000))
    (a,), (b,) = E.chunks([base]), E.chunks([base[:100_000] + b"?" + base[100_000:]])
    assert len(set(a) ^ set(b)) <= 6 < len(a)
