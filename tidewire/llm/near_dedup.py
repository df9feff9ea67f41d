"""Near duplicates by SetSketch registers.

A document is the set of its distinct 5-word shingles. Its sketch has 160 registers: exponentially
spaced, truncated minima of as many hash functions (base 1.001), so sketches of parts merge by
maximum and equal registers are as likely as the sets are alike. Bands of four register values
bring candidates together; a likelihood ratio on the registers that are larger, smaller and equal,
given both cardinalities, discards those that cannot reach the threshold; every other candidate is
verified on the full sets. Links are joined to components.

At a similarity of 0.75 a pair misses all 40 bands with probability 3e-7, and the likelihood test
errs below 1e-6. Pairs whose sizes rule the threshold out are never formed.

Scale, step by step:

* Equal sets are one class from the start (combined before the shuffle), so copies never pair.
* A bucket is left out if another has the very same members (sizes and two fingerprints of the
  members, combined before the shuffle); most buckets of a small group go that way.
* The members of a bucket come together as a block with sketches and packed texts. A task compares a
  block in arrays: a pair is looked at in the first bucket it shares, given up by the likelihood of
  its registers, or verified on the full sets, unless the block has joined the two already. What
  leaves the task are the links that joined something, fewer than the block has members; pairs
  are never rows.
* A bucket of more than ``BLOCK`` members or ``BLOCK_SET`` shingles is cut into chunks. At first each
  chunk is compared with itself and with one of them, which joins a large group of near copies. Then
  only members outside of the bucket's largest component meet all chunks. So no link is lost, and
  a group that is linked costs a few comparisons per member; one that is alike without links costs the
  comparison of its sketches, spread over its blocks.
* Joins are between plain shuffles with tables that were aggregated and written before; adaptive
  execution splits those on a large bucket. Rows that the joins drop (most buckets, most texts) are
  held back before the shuffle by a filter of 8 MB, whatever the number of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import LOWER, as_bytes, col, free_name, give_back, give_up, in_slices, text_or_empty
from tidewire.llm.components import connected_components
from tidewire.llm.sieve import may_be_in
from tidewire.llm.words import U64, Words, mix, runs, slices
from tidewire.session import materialise

SHINGLE = 5
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Sketch parameters: base, rate of the exponential minima, largest register.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Members and shingles of a bucket that are compared as one block.
BLOCK, BLOCK_SET = 2048, 2_000_000
#: Equal registers below which a pair is not worth its likelihood: at 0.75 a pair has 120 of 160, and
#: fewer than 60 with a probability below 1e-25.
FEW_EQUAL = 60
#: Pairs of sketches compared at a time.
LANES = 60_000
#: Pairs up to which sets are intersected one by one.
SINGLE = 8
#: Documents sketched at a time.
BATCH = 1000
#: Log-likelihood by which the threshold must lose to be given up.
SURE = 12.0

with np.errstate(over="ignore"):
    _SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FACTORS = (_SEEDS[:REGISTERS] >> U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_SEEDS[REGISTERS:] >> U64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out = []
    for part in slices([t.translate(LOWER) for t in texts]):
        w = Words(part)
        shingles = runs(w.hashes, SHINGLE)
        for first, n in zip(w.first.tolist(), w.counts.tolist()):
            if n >= SHINGLE:
                out.append(np.unique(shingles[first : first + n - SHINGLE + 1]))
            elif n:
                out.append(runs(w.hashes[first : first + n], n))
            else:
                out.append(np.zeros(0, U64))
    return out


def registers(members: np.ndarray) -> np.ndarray:
    """The sketch of a set; an empty set has all registers 0."""
    if not len(members):
        return np.zeros(REGISTERS, np.uint16)
    x = (members >> U64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        part = np.multiply(_FACTORS[:, None], x[None, a : a + 1024])
        part += _SHIFTS[:, None]
        np.minimum(least, part.min(1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    level = np.floor(1 - np.log(exponential) / np.log(BASE))
    return np.clip(level, 0, LARGEST).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> list[int]:
    """A signed 64-bit key per band, of band number and register values."""
    keys = []
    for b in range(BANDS):
        keys.append(xxhash.xxh3_64_intdigest(sketch[b * ROWS : (b + 1) * ROWS].tobytes(), b))
    return np.array(keys, U64).view(np.int64).tolist()


def digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def worth_verifying(
    above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float
) -> np.ndarray:
    """Which pairs may reach the threshold, by the joint likelihood of their registers.

    ``above`` and ``below`` count the registers in which the first or second sketch is larger.
    """
    u = n_a / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    equal = REGISTERS - above - below

    def part(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = np.clip(part(u - (1 - u) * j), 1e-9, 1)
        q = np.clip(part(1 - u - u * j), 1e-9, 1)
        same = np.clip(1 - p - q, 1e-9, 1)
        return above * np.log(p) + below * np.log(q) + equal * np.log(same)

    best, at_best = np.full(len(u), -np.inf), np.zeros(len(u))
    for step in range(101):
        j = np.minimum(step / 100, most)
        value = likelihood(j)
        better = value > best
        best, at_best = np.where(better, value, best), np.where(better, j, at_best)
    close = best - likelihood(np.minimum(threshold, most)) < SURE
    return (most >= threshold) & ((at_best >= threshold) | close)


def sketch_documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, sketch``; an empty set has no last two."""
    body = text_or_empty(col(docs, text))
    rows = docs.select(
        col(docs, doc_id).alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up()
        for b in in_slices(batches, BATCH):
            sets = shingle_sets(as_bytes(b.column(2)))
            sketches = [registers(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if k is None else k.tobytes() for k in sketches], pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "node", "sketch"],
            )
        give_back()

    return rows.mapInArrow(
        run,
        f"doc_id {id_type}, text_key bigint, n_shingles bigint, node binary, sketch binary",
    )


def _buckets(classes: DataFrame) -> DataFrame:
    """``bucket, band, node, n``: every class under the keys of its bands."""

    @F.arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sketches in batches:
            made = [band_keys(np.frombuffer(k, np.uint16)) for k in as_bytes(sketches)]
            yield pa.array(made, pa.list_(pa.int64()))

    return classes.select(
        F.posexplode(keys("sketch")).alias("band", "bucket"), "node", F.col("n_shingles").alias("n")
    )


def _shared(rows: DataFrame, block: int, block_set: int) -> DataFrame:
    """``bucket, chunks`` of the buckets to compare: one of those with the same members."""
    sized = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("shingles"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    )
    sized = sized.where("members > 1").groupBy("members", "shingles", "x", "y")
    one = sized.agg(F.min("bucket").alias("bucket"))
    crowd = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / block_set))
    return one.select("bucket", crowd.cast("int").alias("chunks"))


def _members(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``nodes`` (with node, smallest, ...) with ``body``, the packed text of the row they stand for."""
    wanted = may_be_in(col(docs, doc_id), nodes, "smallest")
    rows = docs.where(wanted).select(
        col(docs, doc_id).alias("id"), text_or_empty(col(docs, text)).alias("text")
    )
    found = rows.join(nodes, F.col("id").eqNullSafe(F.col("smallest"))).drop("id", "smallest")
    at, columns = found.columns.index("text"), [c for c in found.columns if c != "text"]
    kinds = dict(found.dtypes)
    at_node = columns.index("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in in_slices(batches, BATCH):
            texts = as_bytes(b.column(at))
            rest = [c for k, c in enumerate(b.columns) if k != at]
            # Rows that share a doc_id with the representative may hold another text.
            sets = shingle_sets(texts)
            ok = [digest(s) == n for s, n in zip(sets, rest[at_node].to_pylist())]
            body = pa.array([pack(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest, body], names=[*columns, "body"]).filter(
                pa.array(ok, pa.bool_())
            )

    schema = ", ".join([f"{c} {kinds[c]}" for c in columns] + ["body binary"])
    return found.mapInArrow(run, schema).dropDuplicates(["node"])


class Block:
    """Members that are compared: which ones ask, which ones are asked, and who is joined to whom."""

    def __init__(self, band: int, asks: np.ndarray, asked: np.ndarray, sizes: np.ndarray,
                 sketches: np.ndarray, bands: np.ndarray, groups: np.ndarray, bodies: list[bytes]):
        self.band, self.asks, self.asked = band, np.flatnonzero(asks), np.flatnonzero(asked)
        self.sizes, self.sketches, self.groups, self.bodies = sizes, sketches, groups.copy(), bodies
        self.both = asks & asked
        # The earlier bands in which a pair may have met.
        self.earlier = (bands[:, None] >> np.arange(band)[None, :]) & 1 == 1
        self._sets: list[np.ndarray] | None = None
        self._postings: tuple[np.ndarray, ...] | None = None

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Links that join two groups, as places in the block."""
        out = []
        step = max(1, LANES // max(1, len(self.asked)))
        for a in range(0, len(self.asks), step):
            part = self.asks[a : a + step]
            for k, near in self._likely(part, percent):
                near = near[self.groups[near] != self.groups[k]]
                if len(near):
                    out += self._join(k, near, percent)
        return out

    def _likely(self, part: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each of ``part`` with the asked ones that its registers do not rule out."""
        asked = self.asked
        x, y = self.sketches[part][:, None, :], self.sketches[asked][None, :, :]
        same = x == y
        equal = same.sum(2, dtype=np.uint8)
        n, m = self.sizes[part][:, None], self.sizes[asked][None, :]
        ok = (equal >= FEW_EQUAL) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        ok &= self.groups[part][:, None] != self.groups[asked][None, :]
        # Two that both ask and are asked meet once.
        ok &= ~(self.both[part][:, None] & self.both[asked][None, :] & (part[:, None] > asked[None, :]))
        i, j = np.nonzero(ok)
        if not len(i):
            return
        if self.band:
            bands = same[i, j].reshape(len(i), BANDS, ROWS)[:, : self.band].all(2)
            fresh = ~(bands & self.earlier[part[i]]).any(1)
            i, j = i[fresh], j[fresh]
        above = (self.sketches[part[i]] > self.sketches[asked[j]]).sum(1)
        below = REGISTERS - above - equal[i, j]
        sizes = self.sizes.astype(float)
        good = worth_verifying(above, below, sizes[part[i]], sizes[asked[j]], percent / 100)
        i, j = i[good], j[good]
        for k in np.unique(i):
            yield int(part[k]), asked[j[i == k]]

    def _join(self, k: int, near: np.ndarray, percent: int) -> list[tuple[int, int]]:
        if len(near) <= SINGLE:
            mine = self.sets[k]
            both = np.array([len(np.intersect1d(mine, self.sets[t], assume_unique=True)) for t in near])
        else:
            both = self._counts(k)[near]
        linked = near[100 * both >= percent * (self.sizes[k] + self.sizes[near] - both)]
        out = []
        for t in linked.tolist():
            if self.groups[t] != self.groups[k]:
                self.groups[self.groups == self.groups[t]] = self.groups[k]
                out.append((k, t))
        return out

    @property
    def sets(self) -> list[np.ndarray]:
        if self._sets is None:
            unpack = zstandard.ZstdDecompressor().decompress
            self._sets = []
            for a in range(0, len(self.bodies), BATCH):
                self._sets += shingle_sets([unpack(b) for b in self.bodies[a : a + BATCH]])
        return self._sets

    def _counts(self, k: int) -> np.ndarray:
        """Shingles that the member shares with every member."""
        if self._postings is None:
            lengths = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
            ids = np.unique(np.concatenate(self.sets), return_inverse=True)[1].astype(np.int32)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            by_id = np.argsort(ids, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(ids))])
            self._postings = ids, np.concatenate([[0], np.cumsum(lengths)]), owner[by_id], starts
        ids, begins, owners, starts = self._postings
        mine = ids[begins[k] : begins[k + 1]]
        sizes = starts[mine + 1] - starts[mine]
        at = np.arange(int(sizes.sum())) + np.repeat(starts[mine] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(owners[at], minlength=len(self.sets))


_BLOCK_KEYS = ["bucket", "first", "second"]
_ASKS, _ASKED = 1, 2


def _compared(blocks: DataFrame, percent: int) -> DataFrame:
    """``a, b`` links of ``bucket, first, second, role, band, node, label`` and what members have.

    ``role`` tells whether a row asks, is asked or both; ``label`` who is joined already.
    """
    columns = [*_BLOCK_KEYS, "role", "band", "node", "label", "n", "bands", "sketch", "body"]

    def made(t: pa.Table) -> pa.RecordBatch:
        node, role, n, bands = (t.column(c).to_numpy() for c in ("node", "role", "n", "bands"))
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16)
        groups = pc.dictionary_encode(t.column("label").combine_chunks()).indices.to_numpy()
        block = Block(
            t.column("band")[0].as_py(), role & _ASKS > 0, role & _ASKED > 0, n,
            sketches.reshape(-1, REGISTERS), bands, groups.astype(np.int64), t.column("body").to_pylist(),
        )
        links = block.links(percent)
        return pa.RecordBatch.from_arrays(
            [pa.array([node[k] for k, _ in links], pa.binary()), pa.array([node[k] for _, k in links], pa.binary())],
            names=["a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None
        for b in in_slices(batches, BATCH):
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                key = tuple(keys[low].tolist())
                if key != at and held:
                    yield made(pa.Table.from_batches(held))
                    held = []
                at = key
                held.append(b.slice(low, high - low))
        if held:
            yield made(pa.Table.from_batches(held))
        held = []
        give_back()

    dealt = blocks.select(*columns).repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS)
    return dealt.mapInArrow(run, "a binary, b binary")


def _role(asks: bool, asked: bool) -> Column:
    return F.lit(_ASKS * asks + _ASKED * asked)


def _first_blocks(rows: DataFrame) -> DataFrame:
    """Every chunk with itself, and the first one with the others."""
    mine, zero = F.col("chunk"), F.lit(0)

    def block(first: Column, second: Column, role: Column) -> Column:
        return F.struct(first.alias("first"), second.alias("second"), role.alias("role"))

    others = F.when(F.col("chunks") > 1, F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    from_zero = F.transform(others, lambda k: block(zero, k, _role(True, False)))
    to_zero = F.array(block(zero, mine, _role(False, True)))
    places = F.concat(
        F.array(block(mine, mine, _role(True, True))), F.when(mine == 0, from_zero).otherwise(to_zero)
    )
    return rows.withColumn("label", F.col("node")).select("*", F.inline(places))


def _later_blocks(rows: DataFrame, labels: DataFrame | None, block: int) -> DataFrame:
    """Members outside of their bucket's largest component with every chunk of the bucket."""
    named = rows.withColumn("label", F.col("node"))
    if labels is not None:
        joined = rows.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
        named = joined.withColumn("label", F.coalesce("label", "node")).drop("of")
    named = materialise(named, "named")
    counts = named.groupBy("bucket", "label").count()
    top = counts.groupBy("bucket").agg(
        F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("members")
    )
    outside = F.col("members") - F.col("top.count")
    top = top.where("members > top.count").select(
        "bucket", F.col("top.label").alias("top"), F.ceil(outside / block).cast("int").alias("parts")
    )
    open_ = named.join(materialise(top, "open"), "bucket")
    outsider = F.col("label") != F.col("top")
    # Asked where their chunk is, by every part of the outsiders.
    asked = open_.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumns({"second": F.col("chunk"), "role": _role(False, True)})
    part = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts")).cast("int")
    asks = open_.where(outsider).withColumn("first", part)
    asks = asks.withColumn("second", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asks = asks.withColumn("role", _role(True, False))
    return asks.unionByName(asked).drop("top", "parts")


def _links(
    docs: DataFrame,
    classes: DataFrame,
    doc_id: str,
    text: str,
    percent: int,
    block: int,
    block_set: int,
) -> DataFrame | None:
    """``node, label`` of all classes that have a link, or None."""
    found = _buckets(classes)
    shared = materialise(_shared(found, block, block_set), "shared")
    rows = found.where(may_be_in(F.col("bucket"), shared, "bucket"))
    rows = rows.join(shared, "bucket").withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    rows = materialise(rows.select("bucket", "band", "node", "chunks", "chunk"), "buckets")
    bands = rows.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, band))").alias("bands"))
    nodes = bands.join(classes, "node").select(
        "node", "bands", F.col("n_shingles").alias("n"), "sketch", "smallest"
    )
    nodes = materialise(nodes, "nodes")
    members = materialise(_members(docs, nodes, doc_id, text), "members")
    links = materialise(_compared(_first_blocks(rows).join(members, "node"), percent), "links")
    if links.isEmpty():
        labels = None
    else:
        labels = connected_components(links)
    large = rows.where("chunks > 2")
    if large.isEmpty():
        return labels
    more = materialise(_compared(_later_blocks(large, labels, block).join(members, "node"), percent), "links")
    if more.isEmpty():
        return labels
    return connected_components(links.union(more))


def find_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    block: int = BLOCK,
    block_set: int = BLOCK_SET,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked where ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest doc_id that links reach, and ``kept`` marks the row that has it. Null and empty texts
    have no shingles and stay alone. A null doc_id is never the smallest unless a component has no
    other; then it is the component's id and is kept. Repeated rows each give a row. Other columns
    are not looked at. An empty table gives no rows. ``block`` and ``block_set`` bound what is
    compared at once and change no result; a text is held whole, with 30 bytes of memory a byte.
    """
    return _with_components(docs, doc_id, text, percent, block, block_set).drop("text_key")


def _with_components(
    docs: DataFrame,
    doc_id: str,
    text: str,
    percent: int,
    block: int = BLOCK,
    block_set: int = BLOCK_SET,
) -> DataFrame:
    made = materialise(sketch_documents(docs, doc_id, text), "sketches")
    classes = materialise(
        made.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("smallest"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    labels = _links(docs, classes, doc_id, text, percent, block, block_set)
    reach = classes.select("node", "smallest")
    if labels is not None:
        # Only linked classes need their component's smallest doc_id.
        linked = materialise(labels.join(reach, "node"), "linked")
        component = linked.groupBy("label").agg(F.min("smallest").alias("least"))
        component = materialise(component, "least")
        linked = linked.join(component, "label").select("node", "least")
        reach = reach.join(linked, "node", "left").select(
            "node", F.coalesce("least", "smallest").alias("smallest")
        )
    # Written, so that the join below is between plain shuffles and a hot class can be split.
    reach = materialise(reach, "reach")
    out = made.select("doc_id", "text_key", "n_shingles", "node").join(
        reach.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left"
    )
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select(
        "doc_id", "text_key", "n_shingles", component_id.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` with one document of every component; all columns stay.

    Of rows that are equal in doc_id and text one stays.
    """
    found = _with_components(docs, doc_id, text, percent)
    keep = (
        found.where("kept")
        .groupBy(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    keep = materialise(keep, "kept")
    body = F.xxhash64(text_or_empty(col(docs, text)))

    def rows_of(some: DataFrame) -> DataFrame:
        same = col(docs, doc_id).eqNullSafe(some["kept_id"]) & (body == some["kept_text"])
        return docs.join(some, same, "left_semi")

    # Only rows that have an equal need to be brought together once more.
    repeated = rows_of(keep.where("n_rows > 1"))
    copy = free_name(docs.columns, "copy_number")
    equal = Window.partitionBy(col(repeated, doc_id), F.xxhash64(text_or_empty(col(repeated, text))))
    numbered = repeated.withColumn(copy, F.row_number().over(equal.orderBy(F.lit(0))))
    once = numbered.where(F.col(copy) == 1).drop(copy)
    return rows_of(keep.where("n_rows = 1")).unionByName(once)
