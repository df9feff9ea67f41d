from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from tidewire.llm import variants as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows):
    found = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            found[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def distance_one(a, b):
    """By the table of edit distances."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > 1000:
        return any(a[:k] + b[k : k + 1] + a[k + 1 :] == b for k in (0, len(a) - 1)) or b + "e" == a or a + "e" == b
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1] == 1


def brute(words):
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def compare(frame, words):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in frame.collect()) == brute(words)


def test_odd_rows(table, odd_rows):
    compare(V.find_variants(table(odd_rows)), count(odd_rows))


def test_counts_and_changed_runs(table):
    rng = random.Random(5)
    names = ["Straße", "colour", "COLOR", "naïve", "ÉTUDES", "études", "xylophone", "banana×split", "abcd", "abcde"]
    rows = [(k, " ".join(rng.choices(names, k=60)), None, None) for k in range(40)]
    rows += [(None, rows[0][1], None, None), rows[1], rows[1]]
    words = count(rows)
    got = {r["word"]: r["n"] for r in V.count_words(table(rows)).collect()}
    assert got == words
    assert any(w not in {n.translate(LOWER) for n in names} for w in got)
    compare(V.find_variants(table(rows)), words)


def some_words(rng, n):
    """Stems of few letters with their edits, so that ways collide and chains form."""
    words = {}
    while len(words) < n:
        w = [rng.choice("eaxzéÀ") for _ in range(rng.randrange(5, 9))]
        for _ in range(rng.randrange(1, 8)):
            words["".join(w)] = rng.choice((3, 4, 6, 9, 12, 20, 41, 100))
            k = rng.randrange(len(w))
            w = rng.choice((w[:k] + w[k + 1 :], w[:k] + [rng.choice("eaxzéÀ")] + w[k:]))
            if len(w) < 5:
                break
    return words


def test_shards_and_their_parts_do_not_change_the_links(spark):
    words = some_words(random.Random(8), 500)
    words |= {"a" * 60: 9, "a" * 61: 4, "a" * 59 + "b": 30, "e" * 100_000: 5, "e" * 99_999 + "x": 11, "e" * 100_001: 3}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    for largest in (10**6, 40, 2):
        compare(V.group_variants(table, largest=largest), words)


def test_chain_of_forms(spark):
    words = {"b" * k: 3 * 2 ** (k - 5) for k in range(5, 30)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = V.group_variants(table)
    assert {r["root"] for r in got.collect()} == {"b" * 29}
    compare(got, words)


def test_no_rows(table):
    assert V.find_variants(table([])).count() == 0
    assert V.find_variants(table([(1, "few words here", None, None)])).count() == 0


@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=30, unique=True))
def test_search_and_visits(words):
    trie = V.Trie(words)
    found = [(x, y) for pairs in trie.search(trie.counts, trie.letters, True) for x, y in zip(*map(list, pairs))]
    named = {frozenset((trie.letters.words[x], trie.letters.words[y])) for x, y in found}
    assert len(named) == len(found)
    assert named == {frozenset((a, b)) for a in words for b in words if distance_one(a, b)}
    for top in (1, 3, V.DEPTH):
        prefix = {w: tuple(V.ways([w])[0][:top].tolist()) for w in words}
        for pair in named:
            a, b = sorted(pair, key=lambda w: prefix[w])
            assert prefix[a] == prefix[b] or V.visits(prefix[b]).count(prefix[a]) == 1
            assert V.one_edit(a, b) and V.one_edit(b, a)
