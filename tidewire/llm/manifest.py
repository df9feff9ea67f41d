"""Merkle manifest of a table: SHA-256 trees with kept midstates.

Every row is a leaf, every source a tree of runs of three, and the sources' roots are the leaves of
one more tree. A parent hashes its children's digests as hex text. A digest is one 64-byte block, so
the parent keeps a copy of its hash state before each child slot (32 bytes each); folding a changed
leaf resumes the state of its slot with the replacement and the siblings to the right of it only.
The hash over a leaf's siblings (its proof) is carried as such a state as well.

Scale: text is read once, to make the leaves, and never moved. Leaves (some hundred bytes) are put in
order by ranges; their rank follows from one count per range and source, so a source with a third of
all rows is many tasks. 729 consecutive leaves (``LEVELS`` levels) are a block: blocks are folded in
parallel, each gives one node of the next tier, and tiers shrink until every source has one node. What a
leaf needs from the tiers above is one path per block, joined by block. Each step is written to the
shared folder; the driver holds one digest, the root.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import col
from tidewire.llm.sha_lanes import absorb, finish, fresh, from_bytes, to_bytes
from tidewire.session import materialise

#: Children of a node.
FAN = 3
#: Levels of a block.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a path's step: slot, children, state before the slot, the other children.
STEP = 2 + 32 + 32 * (FAN - 1)


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the values, each ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(
            F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.sha2(F.concat(*parts), 256)


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place in their tree by ``order``, and ``n``, the tree's size."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, part int, at bigint"
    at_tree = rows.columns.index(tree)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, next_at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(at_tree)
            ends = np.asarray(pc.run_end_encode(key).run_ends)
            starts = np.concatenate([[0], ends[:-1]])
            at = np.arange(b.num_rows) - np.repeat(starts, ends - starts)
            first = (key[0].as_py(),)
            if first == last:
                at[: ends[0]] += next_at
            last, next_at = (key[-1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(at, pa.int64())],
                names=[*b.schema.names, "part", "at"],
            )

    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = materialise(dealt.mapInArrow(number, schema), "placed")
    ranges = Window.partitionBy("of_tree").orderBy("of_part")
    counts = placed.groupBy(F.col(tree).alias("of_tree"), F.col("part").alias("of_part")).count()
    counts = counts.select(
        "of_tree",
        "of_part",
        F.coalesce(F.sum("count").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(Window.partitionBy("of_tree")).alias("n"),
    )
    same = (F.col("part") == F.col("of_part")) & F.col(tree).eqNullSafe(F.col("of_tree"))
    return placed.join(materialise(counts, "ranges"), same).select(
        *rows.columns, (F.col("at") + F.col("before")).alias("pos"), "n"
    )


class Block:
    """The nodes of some whole blocks, level by level, with the states kept in every parent.

    ``leaf_digests`` are (8, n) words in order of block and place, ``size`` the leaves of each one's tree.
    """

    def __init__(
        self, block: np.ndarray, place: np.ndarray, size: np.ndarray, leaf_digests: np.ndarray, levels: int
    ):
        opens = np.flatnonzero(np.diff(block, prepend=block[0] - 1 if len(block) else 0))
        self.steps: list[tuple[np.ndarray, ...]] = []
        member = np.arange(len(block))  # each leaf's node at the present level, -1 where its block is done
        at_block, at_place, digest = block.copy(), place.copy(), leaf_digests
        to_go = _levels(size, levels)
        self.roots = np.zeros((8, len(opens)), np.uint32)
        root_of = np.cumsum(np.diff(block, prepend=block[0] - 1 if len(block) else 0) != 0) - 1
        node_root, node_to_go = root_of.copy(), to_go.copy()
        while len(at_block):
            done = node_to_go == 0
            self.roots[:, node_root[done]] = digest[:, done]
            live = ~done
            place_of = np.where(live, np.cumsum(live) - 1, -1)
            member = np.where(member >= 0, place_of[member], -1)
            at_block, at_place, digest = at_block[live], at_place[live], digest[:, live]
            node_root, node_to_go = node_root[live], node_to_go[live]
            if not len(at_block):
                break
            parent = at_place // FAN
            fresh_run = np.ones(len(at_block), bool)
            fresh_run[1:] = (at_block[1:] != at_block[:-1]) | (parent[1:] != parent[:-1])
            run = np.cumsum(fresh_run) - 1
            slot = at_place % FAN
            n_runs = int(run[-1]) + 1
            count = np.bincount(run, minlength=n_runs)
            child = np.zeros((FAN, 8, n_runs), np.uint32)
            kept = np.zeros((FAN, 8, n_runs), np.uint32)
            state = fresh(n_runs)
            for s in range(FAN):
                has = np.flatnonzero(slot == s)
                child[s][:, run[has]] = digest[:, has]
                kept[s][:, run[has]] = state[:, run[has]]
                state[:, run[has]] = absorb(state[:, run[has]], digest[:, has])
            ids = np.flatnonzero(member >= 0)
            of = run[member[ids]]
            self.steps.append((ids, of, slot[member[ids]], count, child, kept))
            member[ids] = of
            first = np.flatnonzero(fresh_run)
            at_block, at_place, digest = at_block[first], parent[first], finish(state, count)
            node_root, node_to_go = node_root[first], node_to_go[first] - 1

    def fold(self, values: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block roots with each leaf replaced, the states of the proofs, and siblings in each."""
        values, proof = values.copy(), proof.copy()
        taken = np.zeros(values.shape[1], np.int64)
        for ids, of, slot, count, child, kept in self.steps:
            state = np.zeros((8, len(ids)), np.uint32)
            for s in range(FAN):
                mine, right = slot == s, (slot < s) & (s < count[of])
                state[:, mine] = absorb(kept[s][:, of[mine]], values[:, ids[mine]])
                state[:, right] = absorb(state[:, right], child[s][:, of[right]])
                other = (slot != s) & (s < count[of])
                proof[:, ids[other]] = absorb(proof[:, ids[other]], child[s][:, of[other]])
                taken[ids[other]] += 1
            values[:, ids] = finish(state, count[of])
        return values, proof, taken

    def paths(self, n: int) -> list[bytes]:
        """Each leaf's steps to its block's root."""
        out = [b""] * n
        for ids, of, slot, count, child, kept in self.steps:
            steps = np.zeros((len(ids), STEP), np.uint8)
            steps[:, 0], steps[:, 1] = slot, count[of]
            for s in range(FAN):
                mine = slot == s
                steps[mine, 2:34] = to_bytes(kept[s][:, of[mine]])
                for place, here in ((s, slot > s), (s - 1, slot < s)):
                    if 0 <= place < FAN - 1:
                        a = 34 + 32 * place
                        steps[here, a : a + 32] = to_bytes(child[s][:, of[here]])
            for i, row in zip(ids.tolist(), steps):
                out[i] += row.tobytes()
        return out


def _levels(size: np.ndarray, most: int) -> np.ndarray:
    """Levels of a tree of ``size`` leaves in one tier."""
    levels = np.zeros(len(size), np.int64)
    left = size.copy()
    for _ in range(most):
        levels[left > 1] += 1
        left = -(-left // FAN)
    return levels


def resume(values: np.ndarray, proof: np.ndarray, taken: np.ndarray, paths: list[bytes]):
    """Values and proofs carried on along paths."""
    lengths = np.fromiter((len(p) // STEP for p in paths), np.int64, len(paths))
    for k in range(int(lengths.max(initial=0))):
        ids = np.flatnonzero(lengths > k)
        steps = np.frombuffer(b"".join(paths[i][k * STEP : (k + 1) * STEP] for i in ids), np.uint8)
        steps = steps.reshape(-1, STEP)
        slot, count = steps[:, 0].astype(np.int64), steps[:, 1].astype(np.int64)
        state = absorb(from_bytes(steps[:, 2:34]), values[:, ids])
        for place in range(FAN - 1):
            sibling = from_bytes(steps[:, 34 + 32 * place : 66 + 32 * place])
            has = place < count - 1
            right = has & (place >= slot)
            state[:, right] = absorb(state[:, right], sibling[:, right])
            proof[:, ids[has]] = absorb(proof[:, ids[has]], sibling[:, has])
            taken[ids[has]] += 1
        values[:, ids] = finish(state, count)
    return values, proof, taken


def _digests(column: pa.Array) -> np.ndarray:
    return from_bytes(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _by_blocks(
    rows: DataFrame, levels: int, schema: str, work: Callable[[pa.Table, Block, np.ndarray], pa.RecordBatch]
) -> DataFrame:
    """``work`` on whole blocks of ``tree, pos, n, digest, ...`` in order; at most a block is held back."""
    span = FAN**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def made(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ends = np.asarray(pc.run_end_encode(t.column("tree").combine_chunks()).run_ends)
            tree = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            pos, n = (t.column(c).to_numpy() for c in ("pos", "n"))
            new = np.ones(len(pos), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (pos[1:] // span != pos[:-1] // span)
            block = np.cumsum(new)
            digests = _digests(t.column("digest").combine_chunks())
            return work(t, Block(block, pos % span, n, digests, levels), new)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            # Everything before the last block's first row is whole.
            pos = held.column("pos").to_numpy()
            same = np.asarray(pc.run_end_encode(held.column("tree").combine_chunks()).run_ends)
            tree_from = 0 if len(same) == 1 else int(same[-2])
            cut = max(tree_from, int(np.searchsorted(pos[tree_from:] // span, pos[-1] // span)) + tree_from)
            if cut >= span:
                yield made(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield made(held)

    dealt = rows.withColumn("block", F.expr(f"pos div {span}"))
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "pos").drop("block")
    return dealt.mapInArrow(run, schema)


def _root_column(block: Block, new: np.ndarray) -> pa.Array:
    """The block's root at its first row, null elsewhere."""
    roots = iter([r.tobytes() for r in to_bytes(block.roots)])
    return pa.array([next(roots) if x else None for x in new.tolist()], pa.binary())


def _next_tier(done: DataFrame, levels: int) -> DataFrame:
    """One node per block of a tier, as ``tree, pos, n, digest``."""
    span = FAN**levels
    return done.where("root IS NOT NULL").select(
        "tree", F.expr(f"pos div {span}").alias("pos"),
        F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest"),
    )


def _same_block(rows: DataFrame, upper: DataFrame, levels: int) -> Column:
    """Join condition of rows with what lies above their blocks."""
    return rows["tree"].eqNullSafe(upper["of_tree"]) & (F.expr(f"pos div {FAN**levels}") == F.col("of_block"))


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """``of_tree, of_block, path, top`` of every node ``tree, pos, n, digest``, up to its tree's root."""
    if nodes.where("n > 1").isEmpty():
        return nodes.select(
            F.col("tree").alias("of_tree"), F.col("pos").alias("of_block"),
            F.lit(b"").alias("path"), F.col("digest").alias("top"),
        )
    kind = nodes.schema["tree"].dataType.simpleString()

    def work(t: pa.Table, block: Block, new: np.ndarray) -> pa.RecordBatch:
        keep = [t.column(c).combine_chunks() for c in ("tree", "pos", "n")]
        return pa.RecordBatch.from_arrays(
            [*keep, pa.array(block.paths(t.num_rows), pa.binary()), _root_column(block, new)],
            names=["tree", "pos", "n", "step", "root"],
        )

    schema = f"tree {kind}, pos bigint, n bigint, step binary, root binary"
    done = materialise(_by_blocks(nodes, levels, schema, work), "tier")
    upper = _paths(materialise(_next_tier(done, levels), "nodes"), levels)
    joined = done.join(upper, _same_block(done, upper, levels)).select(
        F.col("tree").alias("of_tree"), F.col("pos").alias("of_block"),
        F.concat("step", "path").alias("path"), "top",
    )
    return materialise(joined, "paths")


def build(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    fields: tuple[str, ...] = FIELDS,
    changed: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``changed`` replaces fields in a second reading of the rows (what a later copy holds); its leaves
    are folded with the first reading's siblings, and ``verified`` tells if that gives the root.
    Without it every row verifies. Digests are lowercase hex; ``proof_sha256`` is the hash of the
    siblings, level by level, of which a lone leaf has none. ``levels`` sets the size of a block and
    changes no result.

    Rows ascend by doc_id within a source, a null doc_id first, equal doc_ids by leaf; repeated rows
    are leaves of their own. A null source is a source, the first. Null fields are ``-`` and differ
    from empty ones. Columns outside ``fields`` are not looked at. An empty table gives no rows.
    """
    values = {f: col(docs, f) for f in fields}
    other = [(changed or {}).get(f, values[f]) for f in fields]
    leaf = leaf_digest(list(values.values()))
    rows = docs.select(
        col(docs, source).alias("tree"),
        col(docs, doc_id).alias("doc_id"),
        F.unhex(leaf).alias("digest"),
        (F.unhex(leaf_digest(other)) if changed else F.lit(None).cast("binary")).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "leaves")
    ranked = _ranked(rows, "tree", ["doc_id", "digest", "row"]).drop("row")
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def work(t: pa.Table, block: Block, new: np.ndarray) -> pa.RecordBatch:
        digests = t.column("digest").combine_chunks()
        replaced = pc.coalesce(t.column("other").combine_chunks(), digests)
        values, proof, taken = block.fold(_digests(replaced), fresh(t.num_rows))
        keep = [t.column(c).combine_chunks() for c in ("tree", "doc_id", "pos", "n", "digest")]
        return pa.RecordBatch.from_arrays(
            [*keep, _binary(to_bytes(values)), _binary(to_bytes(proof)), pa.array(taken), _root_column(block, new)],
            names=["tree", "doc_id", "pos", "n", "digest", "folded", "proof", "taken", "root"],
        )

    schema = (
        f"tree {kinds['tree']}, doc_id {kinds['doc_id']}, pos bigint, n bigint, digest binary, "
        "folded binary, proof binary, taken bigint, root binary"
    )
    done = materialise(_by_blocks(ranked, levels, schema, work), "tier")
    upper = _paths(materialise(_next_tier(done, levels), "nodes"), levels)
    # The sources' roots are the leaves of the last tree.
    subroots = upper.where("of_block = 0").select(
        F.lit(0).alias("tree"), F.col("of_tree").alias("source"), F.col("top").alias("digest")
    )
    sources = materialise(_ranked(subroots, "tree", ["source"]), "sources")
    above = _paths(sources.drop("source"), levels)
    last = sources.join(above, F.col("pos") == F.col("of_block")).select(
        "source", F.col("path").alias("source_path"), F.col("top").alias("whole")
    )
    last = materialise(last, "source_paths")
    upper = materialise(
        upper.join(last, F.col("of_tree").eqNullSafe(F.col("source"))).select(
            "of_tree", "of_block", F.concat("path", "source_path").alias("path"),
            F.col("top").alias("subroot"), "whole",
        ),
        "upper",
    )
    return _finished(done.join(upper, _same_block(done, upper, levels)), kinds["doc_id"])


def _finished(rows: DataFrame, id_kind: str) -> DataFrame:
    """Folded roots and proofs at the root of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values, proof, taken = resume(
                _digests(b.column(2)), _digests(b.column(3)), b.column(4).to_numpy().copy(), b.column(5).to_pylist()
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(6), b.column(7), _binary(to_bytes(finish(proof, taken))), _binary(to_bytes(values))],
                names=["doc_id", "digest", "subroot", "whole", "proof", "folded"],
            )

    schema = f"doc_id {id_kind}, digest binary, subroot binary, whole binary, proof binary, folded binary"
    ordered = rows.select("doc_id", "digest", "folded", "proof", "taken", "path", "subroot", "whole")
    found = ordered.mapInArrow(run, schema)

    def as_hex(name: str, of: str) -> Column:
        return F.lower(F.hex(of)).alias(name)

    return found.select(
        "doc_id", as_hex("leaf", "digest"), as_hex("subroot", "subroot"), as_hex("root", "whole"),
        as_hex("proof_sha256", "proof"), as_hex("folded_root", "folded"),
        (F.col("folded") == F.col("whole")).alias("verified"),
    )
