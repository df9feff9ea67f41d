"""Substring deduplication with a compressed FM-index per shard.

A window is 13 consecutive words. A word is removed if it lies in a window whose words also start
in a document with a smaller doc_id. Windows are judged on the input.

1. Every window has an anchor, the 4-word shingle with the smallest hash in it. Consecutive windows
   with one anchor form a run, so equal windows always lie in runs of equal anchors. Anchors are
   counted by document; a window whose anchor is in one document only cannot be shared.
2. Documents with shared anchors give their runs. Equal runs are one content with its smallest
   doc_id (per slice of a task already). Contents are dealt to shards by anchor.
3. A shard builds an FM-index of its contents and searches every window of them backwards through
   the wavelet tree. The suffix interval of a window gives the smallest doc_id that has it. A content
   that is alone with its anchor has windows that no other content has, so its own smallest doc_id
   holds for all of them and it stays out of the index.
4. Runs bring those answers back to their documents, which drop the covered words.

Scale: every step is linear in the words. Anchors and contents are combined before the shuffle. An
anchor in more than HOT documents would make a large shard, so its windows stand for themselves:
they are dealt by the hash of the window, and equal windows are one content. Joins are between
plain shuffles, so adaptive execution splits skewed anchors and contents. Text is compressed when it
moves; only that of documents with shared anchors is kept for the last step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import as_bytes, col, text_or_empty
from tidewire.llm.fm_index import FMIndex
from tidewire.llm.words import U64, Words, mix, runs, slices
from tidewire.session import materialise

WINDOW = 13
ANCHOR = 4
#: Documents of an anchor beyond which its windows are dealt one by one.
HOT = 5000
#: Words of documents with shared anchors per shard.
SHARD_WORDS = 650_000

_SPAN = WINDOW - ANCHOR + 1
#: Bytes of a word's hash that travel.
_WORD_BYTES = 6
_LOW = U64(15)
_OTHER = U64(0xA0761D6478BD642F)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Runs:
    """Runs of all documents of a slice: document, first word, windows and anchor of each."""

    def __init__(self, w: Words):
        self.hashes = w.hashes
        self.text_first = w.first
        n = max(len(w.hashes) - WINDOW + 1, 0)
        grams = runs(w.hashes, ANCHOR)
        # The last four bits tell the place in the window, so the first of equal minima wins.
        least = grams[:n] & ~_LOW
        for k in range(1, _SPAN):
            np.minimum(least, (grams[k : k + n] & ~_LOW) | U64(k), out=least)
        place = np.arange(n) + (least & _LOW).astype(np.int64)
        ends = np.repeat(w.first + w.counts, w.counts)[:n]
        self.windows = np.flatnonzero(ends - np.arange(n) >= WINDOW)
        step = np.diff(self.windows, prepend=-2) != 1
        step |= np.diff(place[self.windows], prepend=-1) != 0
        self.at = np.flatnonzero(step)
        self.starts = self.windows[self.at]
        self.sizes = np.diff(np.append(self.at, len(self.windows)))
        # 48 bits: an anchor only brings candidates together, and short ones travel lighter.
        self.anchors = _signed(grams[place[self.starts]] >> U64(16))
        self.docs = np.repeat(np.arange(len(w.counts)), w.counts)[self.starts]


class Candidates:
    """The runs of a slice that may be shared, and the windows of hot anchors on their own.

    ``one`` and ``two`` are independent hashes that name a content together; ``key`` deals it.
    """

    def __init__(self, w: Words, anchors: np.ndarray, hot: np.ndarray):
        r = Runs(w)
        first = runs(w.hashes, WINDOW)
        second = runs(mix(w.hashes ^ _OTHER), WINDOW)
        alone = np.isin(r.anchors, hot)
        open_ = np.flatnonzero(np.isin(r.anchors, anchors) & ~alone)
        place = np.arange(len(r.windows)) - np.repeat(r.at, r.sizes)
        powers = np.cumprod(np.full(_SPAN + 1, _OTHER | U64(1), U64))[place]
        if len(r.at):
            one = mix(np.add.reduceat(first[r.windows] * powers, r.at))[open_]
            two = mix(np.add.reduceat(second[r.windows] * powers, r.at))[open_]
        else:
            one = two = np.zeros(0, U64)
        single = r.windows[np.repeat(alone, r.sizes)]
        docs = np.repeat(r.docs[alone], r.sizes[alone])
        self.starts = np.concatenate([r.starts[open_], single])
        self.sizes = np.concatenate([r.sizes[open_], np.ones(len(single), np.int64)])
        self.docs = np.concatenate([r.docs[open_], docs])
        self.one = _signed(np.concatenate([one, first[single]]))
        self.two = _signed(np.concatenate([two, second[single]]))
        self.key = np.concatenate([r.anchors[open_], _signed(first[single])])
        self.in_text = self.starts - w.first[self.docs]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of intervals, one after another."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return np.arange(total) + np.repeat(starts - (upto - sizes), sizes)


def _word_bytes(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The leading six bytes of the hashes of each interval, as one binary value each."""
    flat = (hashes[_spread(starts, sizes)] >> U64(64 - 8 * _WORD_BYTES)).view(np.uint8)
    data = np.ascontiguousarray(flat.reshape(-1, 8)[:, :_WORD_BYTES])
    offsets = np.concatenate([[0], np.cumsum(sizes * _WORD_BYTES)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of binary values, one after another, and how many each has."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    wide = np.zeros((len(data) // _WORD_BYTES, 8), np.uint8)
    wide[:, :_WORD_BYTES] = data.reshape(-1, _WORD_BYTES)
    return wide.view(U64).ravel(), np.diff(offsets) // _WORD_BYTES


def _anchor_rows(rows: DataFrame, counted: bool) -> DataFrame:
    """Distinct anchors per document, or their document counts per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            begin = 0
            for part in slices(as_bytes(b.column(1))):
                r = Runs(Words(part))
                order = np.lexsort((r.docs, r.anchors))
                anchors, docs = r.anchors[order], r.docs[order]
                new = (np.diff(anchors, prepend=0) != 0) | (np.diff(docs, prepend=-1) != 0)
                new[:1] = True
                anchors, docs = anchors[new], docs[new]
                if counted:
                    anchors, values = np.unique(anchors, return_counts=True)
                else:
                    values = ids[begin + docs]
                begin += len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors, pa.int64()), pa.array(values, pa.int64())],
                    names=["anchor", "value"],
                )

    named = rows.where("doc_id IS NOT NULL").select("doc_id", "text")
    return named.mapInArrow(run, "anchor bigint, value bigint")


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _packed(texts: list[bytes]) -> list[bytes]:
    pack = zstandard.ZstdCompressor(level=3).compress
    return [pack(t) for t in texts]


def _unpacked(texts: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in texts]


def _with_packed_text(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` with the text compressed, as it travels and rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array(_packed(as_bytes(b.column(1))), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), packed], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id bigint, text binary")


def _prepared(rows: DataFrame) -> DataFrame:
    """Every row with its whole digest; text stays only where anchors are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(1).to_pylist()
            words = [t.split() for t in _unpacked(packed)]
            shared = b.column(2).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([None if s else kept_digest(w) for w, s in zip(words, shared)], pa.string()),
                    pa.array([t if s else None for t, s in zip(packed, shared)], pa.binary()),
                    b.column(2),
                    b.column(3),
                ],
                names=["doc_id", "n_words", "kept_sha256", "text", "anchors", "hot"],
            )

    made = rows.mapInArrow(
        run,
        "doc_id bigint, n_words bigint, kept_sha256 string, text binary, "
        "anchors array<bigint>, hot array<bigint>",
    )
    return made.withColumn("row", F.monotonically_increasing_id())


def _candidates(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, Candidates]]:
    """Slices of a batch of ``text, anchors, hot, ...``: first row, words and candidates.

    Whether an anchor is shared or hot is the same for all documents, so the lists of a slice are
    looked up as one.
    """
    begin = 0
    for part in slices(_unpacked(batch.column(0).to_pylist())):
        anchors, hot = (
            batch.column(k).slice(begin, len(part)).flatten().to_numpy(zero_copy_only=False)
            for k in (1, 2)
        )
        w = Words(part)
        yield begin, w, Candidates(w, anchors.astype(np.int64), hot.astype(np.int64))
        begin += len(part)


def _contents(shared: DataFrame) -> DataFrame:
    """``one, two, key, words, least``: runs, each distinct one once per slice with its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3).to_numpy()
            for begin, w, c in _candidates(b):
                owners = ids[begin + c.docs]
                order = np.lexsort((owners, c.two, c.one))
                one, two = c.one[order], c.two[order]
                new = (np.diff(one, prepend=0) != 0) | (np.diff(two, prepend=0) != 0)
                new[:1] = True
                pick = order[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.one[pick]),
                        pa.array(c.two[pick]),
                        pa.array(c.key[pick]),
                        _word_bytes(w.hashes, c.starts[pick], c.sizes[pick] + WINDOW - 1),
                        pa.array(owners[pick], pa.int64()),
                    ],
                    names=["one", "two", "key", "words", "least"],
                )

    rows = shared.select("text", "anchors", "hot", "doc_id")
    return rows.mapInArrow(run, "one bigint, two bigint, key bigint, words binary, least bigint")


def _places(shared: DataFrame) -> DataFrame:
    """``one, two, row, doc_id, first``: where runs stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(3).to_numpy(), b.column(4).to_numpy()
            for begin, _, c in _candidates(b):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.one),
                        pa.array(c.two),
                        pa.array(rows[begin + c.docs], pa.int64()),
                        pa.array(ids[begin + c.docs], pa.int64()),
                        pa.array(c.in_text, pa.int64()),
                    ],
                    names=["one", "two", "row", "doc_id", "first"],
                )

    rows = shared.select("text", "anchors", "hot", "doc_id", "row")
    return rows.mapInArrow(run, "one bigint, two bigint, row bigint, doc_id bigint, first bigint")


def smallest_owners(words: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of every content, the smallest ``least`` of the contents that have it.

    Contents stand one after another in ``words``; the windows in the result, too.
    """
    known, symbols = np.unique(words, return_inverse=True)
    ends = np.cumsum(sizes)
    # A separator follows every content.
    text = np.zeros(int(ends[-1]) + len(sizes), np.int64)
    begin = ends - sizes + np.arange(len(sizes))
    text[_spread(begin, sizes)] = symbols + 1
    owner = np.repeat(least, sizes + 1)
    index = FMIndex(text, len(known) + 1)
    starts = _spread(begin, sizes - WINDOW + 1)
    low = np.zeros(len(starts), np.int64)
    high = np.zeros(len(starts), np.int64)
    for a in range(0, len(starts), 50_000):
        part = starts[a : a + 50_000]
        low[a : a + 50_000], high[a : a + 50_000] = index.search(text[part[:, None] + np.arange(WINDOW)])
    # Intervals of windows of one length are equal or disjoint.
    lows, first, which = np.unique(low, return_index=True, return_inverse=True)
    bounds = np.stack([lows, high[first]], 1).ravel()
    by_suffix = np.append(owner[index.suffixes], np.iinfo(np.int64).max)
    return np.minimum.reduceat(by_suffix, bounds)[::2][which]


def _answers(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """``one, two, owners`` of the contents of one shard."""
    t = pa.Table.from_batches(held).combine_chunks()
    tag, one, two, least = (t.column(n).to_numpy() for n in ("tag", "one", "two", "least"))
    words, sizes = _words_of(t.column("words").chunk(0))
    order = np.lexsort((least, two, one))
    new = (np.diff(one[order], prepend=0) != 0) | (np.diff(two[order], prepend=0) != 0)
    new[:1] = True
    pick = order[new]
    begin = np.cumsum(sizes) - sizes
    windows = sizes[pick] - WINDOW + 1
    found = np.repeat(least[pick], windows)
    # Equal windows have equal anchors and so equal tags; tags that meet by chance are only searched.
    _, which, times = np.unique(tag[pick], return_inverse=True, return_counts=True)
    met = times[which] > 1
    if met.any():
        index = pick[met]
        mine = words[_spread(begin[index], sizes[index])]
        found[np.repeat(met, windows)] = smallest_owners(mine, sizes[index], least[index])
    offsets = np.concatenate([[0], np.cumsum(windows)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(one[pick]),
            pa.array(two[pick]),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(found)),
        ],
        names=["one", "two", "owners"],
    )


def _searched(contents: DataFrame, shards: int) -> DataFrame:
    """``one, two, owners``: the smallest doc_id of every window. A partition is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield _answers(held)

    dealt = contents.select(F.hash("key").alias("tag"), "one", "two", "words", "least")
    return dealt.repartition(shards, "tag").mapInArrow(
        run, "one bigint, two bigint, owners array<bigint>"
    )


def _merged(docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the intervals that windows at ``at`` cover, in order."""
    order = np.lexsort((at, docs))
    docs, at = docs[order], at[order]
    new = (np.diff(docs, prepend=-1) != 0) | (np.diff(at, prepend=0) > WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first, len(at))[1:] - 1
    return docs[first], at[first], at[last] + WINDOW


def _cut(shared: DataFrame) -> DataFrame:
    """Rows with shared anchors without the words of their covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            listed = b.column(3)
            sizes = listed.value_lengths().fill_null(0).to_numpy()
            windows = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            docs, starts, ends = _merged(np.repeat(np.arange(len(b)), sizes), windows)
            upto = np.searchsorted(docs, np.arange(len(b) + 1)).tolist()
            pairs = np.stack([starts, ends], 1).tolist()
            digests, spans = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                words = unpack(t).split()
                gone = pairs[upto[k] : upto[k + 1]]
                kept, at = [], 0
                for start, end in gone:
                    kept += words[at:start]
                    at = end
                digests.append(kept_digest(kept + words[at:]))
                spans.append(gone)
            removed = np.bincount(docs, weights=ends - starts, minlength=len(b)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
            )

    return shared.select("doc_id", "n_words", "text", "windows").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>",
    )


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` of every row.

    ``spans`` are the removed word intervals, ends exclusive. doc_id is an integer. A null text has
    no words. Rows of equal doc_id do not remove each other's words, and rows with a null doc_id
    neither remove nor lose any. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        col(docs, doc_id).cast("long").alias("doc_id"), text_or_empty(col(docs, text)).alias("text")
    )
    shared = materialise(
        _anchor_rows(rows, True)
        .groupBy("anchor")
        .agg(F.sum("value").alias("n"))
        .where("n > 1")
        .select("anchor", (F.col("n") > HOT).alias("hot")),
        "anchors",
    )
    lists = (
        _anchor_rows(rows, False)
        .join(shared, "anchor")
        .groupBy(F.col("value").alias("of"))
        .agg(
            F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("anchors"),
            F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"),
        )
    )
    prepared = materialise(
        _prepared(
            _with_packed_text(rows).join(lists, F.col("doc_id") == F.col("of"), "left").select(
                "doc_id", "text", "anchors", "hot"
            )
        ),
        "prepared",
    )
    candidates = prepared.where("text IS NOT NULL")
    total = candidates.agg(F.sum("n_words")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_WORDS)
    owners = materialise(_searched(_contents(candidates), shards), "owners")
    covered = (
        _places(candidates)
        .join(owners, ["one", "two"])
        .select(
            "row",
            F.filter(
                F.transform("owners", lambda m, i: F.when(m < F.col("doc_id"), F.col("first") + i)),
                lambda w: w.isNotNull(),
            ).alias("windows"),
        )
        .where(F.size("windows") > 0)
        .groupBy("row")
        .agg(F.flatten(F.collect_list("windows")).alias("windows"))
    )
    cut = _cut(candidates.join(covered, "row", "left"))
    whole = prepared.where("text IS NULL").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_removed"),
        "kept_sha256",
        F.array().cast("array<array<bigint>>").alias("spans"),
    )
    return whole.unionByName(cut)
