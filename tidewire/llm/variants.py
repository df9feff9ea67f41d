"""Spelling variants: a trie of letter-group counts searched with a budget of one each way.

A word's letters are counted in successive groups; the counts, group by group, are its way down a
trie. One inserted, deleted or replaced letter changes at most one count up and one down, so words
at one edit from each other are found by a depth-first search that may spend a surplus of one and a
deficit of one. Words in the leaves that it reaches are verified letter by letter.

Scale: runs are cut, changed and counted on the JVM; only distinct words go on. The trie is dealt out
by the first counts of its ways: a shard holds the words below one node, and a word visits the few
other shards within its budget that precede its own in order, so every pair meets once. How many
counts name a shard follows from the largest shard (``SHARD`` words); where even whole ways are more
crowded, a shard is split by a hash of the word and visitors see all its parts. A task holds one
shard's words and streams the visitors. Links go back as pairs of words, combined before the shuffle.
Roots are found by pointer jumping, each round written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import col, text_or_empty
from tidewire.llm.licenses import lower_ascii
from tidewire.session import materialise

RUN = r"[A-Za-zÀ-ÿ]+"
#: Letters of the successive groups, common ones alone; all others are the last group.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "h", "d", "um", "gcp", "vbwf", "kjxqyz")
DEPTH = len(GROUPS) + 1
#: Words of the largest shard that is not divided further.
SHARD = 20_000
#: Counts that name a shard at first.
TOP = 3
#: Words below which a node is compared without going down.
SMALL = 8
#: Visitors searched together, and pairs verified together.
BATCH, PAIRS = 20_000, 200_000
#: Letters up to which words are compared side by side; longer ones are compared one by one.
WIDE = 48

_GROUP_OF = np.full(0x110000, len(GROUPS), np.uint8)
for _k, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP_OF[ord(_c)] = _k


def count_words(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = 5,
    least_count: int = 3,
    drop_one_in: int | None = 97,
) -> DataFrame:
    """``word, n``: the runs of letters of all texts, A-Z lower-cased.

    With ``drop_one_in`` a run whose crc32 (of doc_id, colon, run) it divides loses the letter that
    the checksum names. Words below the least length or count are left out.
    """
    body = text_or_empty(col(docs, text))
    runs = docs.select(
        F.coalesce(col(docs, doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(body, F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= least_length)
    word = F.col("run")
    runs = runs.select("id", lower_ascii(word).alias("run"))
    if drop_one_in is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.char_length("run")))
        word = F.when(F.col("h") % drop_one_in == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def ways(words: list[str]) -> np.ndarray:
    """The counts of every word's letters, a row each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(words)), lengths) * DEPTH + _GROUP_OF[letters]
    return np.bincount(of, minlength=len(words) * DEPTH).reshape(-1, DEPTH).astype(np.int32)


def _lanes(words: list[str]) -> np.ndarray:
    """The first letters of every word as a row of code points, zeros behind."""
    return np.array(words, f"U{WIDE}").view(np.uint32).reshape(len(words), WIDE)


def one_edit(a: str, b: str) -> bool:
    """One letter inserted, deleted or replaced makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Letters:
    """Words laid side by side, from the left and from the right."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.left = _lanes(words)
        self.right = _lanes([w[::-1] for w in words])

    def near(self, i: np.ndarray, other: Letters, j: np.ndarray) -> np.ndarray:
        """Which pairs ``words[i], other.words[j]`` are one edit apart."""
        n, m = self.size[i], other.size[j]
        out = np.abs(n - m) <= 1
        long = out & (np.maximum(n, m) > WIDE)
        short = np.flatnonzero(out & ~long)
        width = int(max(n[short].max(initial=1), m[short].max(initial=1)))

        def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            differ = a[i[short], :width] != b[j[short], :width]
            return np.where(differ.any(1), differ.argmax(1), width)

        before, after = common(self.left, other.left), common(self.right, other.right)
        n, m = n[short], m[short]
        out[short] = np.where(
            n == m, before + after == n - 1, (n != m) & (before + after >= np.minimum(n, m))
        )
        for k in np.flatnonzero(long):
            out[k] = one_edit(self.words[i[k]], other.words[j[k]])
        return out


class Trie:
    """The words of a shard in order of their ways; a node is a range of them."""

    def __init__(self, words: list[str]):
        counts = ways(words)
        order = np.lexsort(counts.T[::-1])
        self.order = order
        self.counts = counts[order]
        self.letters = Letters([words[k] for k in order])

    def search(
        self, queries: np.ndarray, letters: Letters, own: bool
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified pairs (query, word); with ``own`` the queries are the words, each pair once."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        none = np.zeros(len(queries), np.int8)
        stack = [(0, 0, len(self.counts), np.arange(len(queries)), none, none)]
        while stack:
            depth, low, high, q, up, down = stack.pop()
            if high - low <= SMALL or depth == DEPTH:
                # A part of the node at a time, so that a crowded leaf needs no large table.
                for a in range(low, high, step := max(1, PAIRS // len(q))):
                    b = min(a + step, high)
                    d = queries[q][:, None, depth:] - self.counts[None, a:b, depth:]
                    more = up[:, None] + np.maximum(d, 0).sum(2)
                    less = down[:, None] + np.maximum(-d, 0).sum(2)
                    x, y = np.nonzero((more <= 1) & (less <= 1))
                    x, y = q[x], y + a
                    if own:
                        x, y = x[x < y], y[x < y]
                    if len(x):
                        pairs.append((x, y))
                        held += len(x)
                    if held >= PAIRS:
                        yield self._verified(pairs, letters)
                        pairs, held = [], 0
                continue
            column = self.counts[low:high, depth]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                d = queries[q, depth] - column[a]
                fits = (up + np.maximum(d, 0) <= 1) & (down + np.maximum(-d, 0) <= 1)
                if fits.any():
                    d = d[fits]
                    stack.append(
                        (depth + 1, low + a, low + b, q[fits], up[fits] + (d > 0), down[fits] + (d < 0))
                    )
        if pairs:
            yield self._verified(pairs, letters)

    def _verified(
        self, pairs: list[tuple[np.ndarray, np.ndarray]], letters: Letters
    ) -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate(p) for p in zip(*pairs))
        ok = letters.near(x, self.letters, y)
        return x[ok], y[ok]


def visits(way: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The ways within the budget that precede ``way`` in order."""
    out = []
    for i, c in enumerate(way):
        if c:
            less = (*way[:i], c - 1, *way[i + 1 :])
            out.append(less)
            out.extend((*less[:j], less[j] + 1, *less[j + 1 :]) for j in range(i + 1, len(way)))
    return out


def _with_ways(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                way = ways(b.column(0).to_pylist())
                flat = pa.array(way.ravel(), pa.int32())
                offsets = pa.array(np.arange(0, len(flat) + 1, DEPTH), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.ListArray.from_arrays(offsets, flat)], names=["word", "n", "way"]
                )

    return words.mapInArrow(run, "word string, n bigint, way array<int>")


def _shards(words: DataFrame, largest: int) -> tuple[DataFrame, int]:
    """``shard, parts`` of all shards, and how many counts name one."""
    ways_ = materialise(words.groupBy("way").agg(F.count(F.lit(1)).alias("n")), "ways")
    top = TOP
    while True:
        shards = ways_.groupBy(F.slice("way", 1, top).alias("shard")).agg(F.sum("n").alias("n"))
        crowd = shards.agg(F.max("n")).first()[0]
        if crowd is None or crowd <= largest or top == DEPTH:
            parts = F.expr(f"(n + {largest - 1}) div {largest}").cast("int")
            return materialise(shards.select("shard", parts.alias("parts")), "shards"), top
        top += 1


def _dealt(words: DataFrame, shards: DataFrame, top: int) -> DataFrame:
    """``shard, part, visitor, word, n``: each word at home and where it visits."""
    kind = "word string, n bigint, shard array<int>, visitor boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, shard, visitor = [], [], []
            for k, way in enumerate(b.column(2).to_pylist()):
                home = tuple(way[:top])
                for s in [home, *visits(home)]:
                    at.append(k)
                    shard.append(s)
                    visitor.append(s is not home)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take),
                 pa.array(shard, pa.list_(pa.int32())), pa.array(visitor, pa.bool_())],
                names=["word", "n", "shard", "visitor"],
            )

    met = words.mapInArrow(run, kind).join(shards, "shard")
    home = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # At home a word is in one part and visits the parts before it; elsewhere it visits all.
    until = F.when(F.col("visitor"), F.col("parts") - 1).otherwise(home)
    return met.withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), until))).select(
        "shard", "part", (F.col("visitor") | (F.col("part") != F.col("home"))).alias("visitor"), "word", "n"
    )


def _links(words: DataFrame, largest: int) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of near words once."""
    shards, top = _shards(words, largest)

    def found(trie: Trie, homes: tuple, guests: tuple | None) -> Iterator[pa.RecordBatch]:
        names, counts = homes
        if guests is None:
            guest_names = trie.letters.words
            guest_counts = counts[trie.order]
            search = trie.search(trie.counts, trie.letters, True)
        else:
            guest_names, guest_counts = guests
            search = trie.search(ways(guest_names), Letters(guest_names), False)
        for x, y in search:
            home = trie.order[y]
            yield pa.RecordBatch.from_arrays(
                [pa.array([guest_names[i] for i in x], pa.string()), pa.array(guest_counts[x], pa.int64()),
                 pa.array([names[i] for i in home], pa.string()), pa.array(counts[home], pa.int64())],
                names=["a", "n_a", "b", "n_b"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        names: list[str] = []
        counts: list[int] = []
        trie: Trie | None = None
        for key, visitor, b in _pieces(batches):
            if key != at:
                if trie is None and names:
                    yield from found(Trie(names), (names, np.array(counts)), None)
                at, names, counts, trie = key, [], [], None
            word, n = b.column(3).to_pylist(), b.column(4).to_pylist()
            if not visitor:
                names += word
                counts += n
                continue
            if not names:
                continue
            if trie is None:
                trie = Trie(names)
                yield from found(trie, (names, np.array(counts)), None)
            for k in range(0, len(word), BATCH):
                guests = word[k : k + BATCH], np.array(n[k : k + BATCH])
                yield from found(trie, (names, np.array(counts)), guests)
        if trie is None and names:
            yield from found(Trie(names), (names, np.array(counts)), None)

    dealt = _dealt(words, shards, top).repartition("shard", "part")
    dealt = dealt.sortWithinPartitions("shard", "part", "visitor")
    return dealt.mapInArrow(run, "a string, n_a bigint, b string, n_b bigint")


def _pieces(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """The batches cut where shard, part or ``visitor`` changes."""
    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column(0)
        flat = shard.flatten().to_numpy().reshape(b.num_rows, -1)
        rest = [c.to_numpy(zero_copy_only=False).astype(np.int32)[:, None] for c in b.columns[1:3]]
        keys = np.hstack([flat, *rest])
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        bounds = [0, *edges.tolist(), b.num_rows]
        for low, high in zip(bounds, bounds[1:]):
            key = tuple(keys[low, :-1].tolist())
            yield key, bool(keys[low, -1]), b.slice(low, high - low)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, form`` to ``word, root``, the last form that forms lead to."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        links = materialise(
            links.join(onward, F.col("root") == F.col("via"), "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(words: DataFrame, times: int = 2, largest: int = SHARD) -> DataFrame:
    """``word, n`` to ``word, form, root, n, n_near, form_n``.

    Near words are one inserted, deleted or replaced letter apart. A word's form is its near word of
    largest ``n`` (then the smallest) if that is at least ``times`` its own, else null; the root is
    the last form that forms lead to, or the word itself. Words must be distinct and not null. An
    empty table gives no rows. Other columns are not looked at.
    """
    words = materialise(words.select("word", "n"), "words")
    links = materialise(_links(materialise(_with_ways(words), "with_ways"), largest), "links")
    either = links.select(F.col("a").alias("of"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    either = either.unionByName(
        links.select(F.col("b").alias("of"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = either.groupBy("of").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    strong = -F.col("best.less") >= times * F.col("n")
    met = words.join(materialise(best, "best"), F.col("word") == F.col("of"), "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    met = materialise(met, "met")
    roots = _roots(met.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return met.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def find_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``group_variants`` of the words of ``docs``, counted with the defaults of ``count_words``.

    Null texts have no words, a null doc_id counts as empty in the checksum, repeated rows count each
    time, other columns are not looked at, and a table without words gives no rows.
    """
    return group_variants(count_words(docs, doc_id, text), **options)
