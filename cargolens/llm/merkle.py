"""A Merkle manifest of a dataset, with a witness for every row.

Rows of a tree, in ascending key order, are the leaves; every ``ARITY`` consecutive nodes become
one node of the next level until one is left. The rows are appended to open subtrees, in blocks
aligned to ``ARITY ** LEVELS`` leaves: a row carries a partial witness, the siblings met so far,
and each time the last sibling of a run arrives, the witnesses of all rows below the run grow by
that run. A block ends as one node. These block roots are appended to blocks of the next round
in the same way, and so on up to the tree's root; the trees' roots, by tree name, are the leaves
of the last tree. A row's witness is what its own block holds for it, then what each round above
holds for its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import slices, stored, sums_before

ARITY = 8
#: Levels of a block: it has at most ``ARITY ** LEVELS`` members, whatever the data.
LEVELS = 4
DIGEST = 64  # characters of a digest in hex
_BLOCK = (
    "tree string, block long, digest string, members int, keys array<long>, leaves string, "
    "claims string, levels array<string>"
)
_WITNESS = "tree string, key long, leaf string, claim string, subroot string, root string, steps binary, siblings string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """The leaf of a row: the hash of its values, each with its length, a null as ``-``."""
    texts = [v.cast("string") for v in values]
    sized = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*sized), 256)


class Frontier:
    """The open subtrees of a block, to which nodes are appended from left to right.

    ``levels[k]`` holds the nodes of level k, run by run: the part of the witness that a completed
    run adds to all leaves below it, kept once. ``open[k]`` is the run that still waits for
    siblings.
    """

    def __init__(self) -> None:
        self.levels: list[list[str]] = []
        self.open: list[list[str]] = [[]]

    def append(self, node: str, level: int = 0) -> None:
        """Add a node; a run that it completes becomes a node of the next level at once."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        run.append(node)
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = "".join(self.open[level]), []
        while len(self.levels) <= level:
            self.levels.append([])
        # This extends the witness of every leaf below the run.
        self.levels[level].append(run)
        self.append(digest(run), level + 1)

    def close(self, height: int | None) -> str:
        """The root, after ``height`` levels, or after as many as it takes to have one node."""
        level = 0
        while True:
            done = sum(len(r) // DIGEST for r in self.levels[level]) if level < len(self.levels) else 0
            waiting = len(self.open[level])
            if level == height or (height is None and done + waiting == 1):
                return self.open[level][0]
            if waiting:
                self._complete(level)
            level += 1


def block_of(nodes: list[str], first: bool, levels: int) -> tuple[str, list[str]]:
    """Root and levels of a block. The first block of a tree ends as soon as one node is left.

    If the tree has more blocks, its first one is full and so has all its levels as well.
    """
    frontier = Frontier()
    for node in nodes:
        frontier.append(node)
    root = frontier.close(None if first else levels)
    return root, ["".join(runs) for runs in frontier.levels]


def witness(levels: list[str], at: int) -> tuple[bytes, str]:
    """Place and run size for each level, and the siblings, of member ``at`` of a block."""
    steps, siblings = bytearray(), []
    for level in levels:
        at, place = divmod(at, ARITY)
        run = level[at * ARITY * DIGEST : (at + 1) * ARITY * DIGEST]
        if not run:
            break
        steps += bytes((place, len(run) // DIGEST))
        siblings += [run[: place * DIGEST], run[(place + 1) * DIGEST :]]
    return bytes(steps), "".join(siblings)


def fold(leaf: str, steps: bytes, siblings: str) -> str:
    """The root that a leaf and its witness lead to."""
    node, at = leaf, 0
    for place, size in zip(steps[::2], steps[1::2], strict=True):
        middle, end = at + place * DIGEST, at + (size - 1) * DIGEST
        node, at = digest(siblings[at:middle] + node + siblings[middle:end]), end
    return node


def _grown(nodes: DataFrame, height: int) -> DataFrame:
    """Blocks of ``nodes`` (tree, pos, key, leaf, claim), each built in one go and bounded in size."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        nodes, block = group["leaf"].to_pylist(), group["block"][0].as_py()
        root, levels = block_of(nodes, block == 0, height)
        row = {
            "tree": group["tree"][0].as_py(), "block": block, "digest": root, "members": len(nodes),
            "keys": group["key"].to_pylist(), "leaves": "".join(nodes), "claims": "".join(group["claim"].to_pylist()),
            "levels": levels,
        }
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("digest", pa.string()), ("members", pa.int32()),
         ("keys", pa.list_(pa.int64())), ("leaves", pa.string()), ("claims", pa.string()), ("levels", pa.list_(pa.string()))]
    )
    placed = nodes.withColumn("block", F.expr(f"pos div {ARITY**height}"))
    return placed.groupBy("tree", "block").applyInArrow(run, _BLOCK)


def _placed(leaves: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``leaves`` (tree, order, key, leaf, claim) with ``pos``, their place in their tree, from 0.

    Ordered by ``order``, then leaf; null first. Rows that tie in both are alike, so any order of
    them gives the same manifest. Only counts per tree and task are summed up over all tasks.
    ``before`` holds, per tree, how many leaves stand ahead of these.
    """
    kept = stored(leaves, "leaves").withColumn("_row", F.monotonically_increasing_id())
    ordered = kept.repartitionByRange("tree", "order", "leaf", "_row").sortWithinPartitions("tree", "order", "leaf", "_row")
    ordered = ordered.drop("_row").withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    ordered = stored(ordered, "ordered-leaves")
    parts = ordered.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    # One row per task and tree that meet; stored, so that its size is known when it is joined.
    parts = stored(parts, "parts").withColumnsRenamed({"tree": "_tree", "_part": "_p"})
    bases = sums_before(parts, "_p", ("n",), ("_tree",)).withColumnsRenamed({"_tree": "_t", "_p": "_q"})
    parts = parts.join(bases, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_p") == F.col("_q")))
    parts = stored(parts.select("_tree", "_p", (F.col("base_n") - F.col("first")).alias("shift")), "shifts")
    found = ordered.join(parts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p")))
    found = found.withColumn("pos", F.col("_at") + F.col("shift")).drop("_tree", "_p", "_part", "_at", "shift")
    if before is None:
        return found
    ahead = before.select(F.col("tree").alias("_tree"), "ahead")
    found = found.join(ahead, F.col("tree").eqNullSafe(F.col("_tree")), "left")
    return found.withColumn("pos", F.col("pos") + F.coalesce("ahead", F.lit(0))).drop("_tree", "ahead")


@dataclass(frozen=True)
class Manifest:
    """Stored blocks: ``rounds[0]`` over the rows, each other over the block roots of the one before.

    ``top`` is the rounds of the tree over the trees' roots.
    """

    rounds: tuple[DataFrame, ...]
    top: tuple[DataFrame, ...]
    height: int


def _rounds(first: DataFrame, height: int) -> tuple[DataFrame, ...]:
    """The rounds above ``first``, until every tree is one block."""
    rounds = [first]
    while not rounds[-1].where("block > 0").isEmpty():
        below = rounds[-1].select(
            "tree", F.col("block").alias("pos"), F.col("block").alias("key"), F.col("digest").alias("leaf"), F.col("digest").alias("claim")
        )
        rounds.append(stored(_grown(below, height), "block-roots"))
    return tuple(rounds)


def _finished(first: DataFrame, height: int) -> Manifest:
    rounds = _rounds(first, height)
    roots = rounds[-1].select(
        F.lit("").alias("tree"), F.col("tree").alias("order"), F.lit(None).cast("long").alias("key"),
        F.col("digest").alias("leaf"), F.col("digest").alias("claim"),
    )
    # The name of a tree is found again by its place, so the places are stored.
    named = stored(_placed(roots), "tree-roots")
    top = stored(_grown(named.withColumn("key", F.col("pos")), height), "top")
    return Manifest((*rounds[:-1], _with_place(rounds[-1], named)), _rounds(top, height), height)


def _with_place(last: DataFrame, named: DataFrame) -> DataFrame:
    places = named.select(F.col("order").alias("_tree"), F.col("pos").alias("place"))
    return last.join(places, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")


def build(leaves: DataFrame, height: int = LEVELS) -> Manifest:
    """The manifest of ``leaves``: tree (string), key (long), leaf and claim (hex digests).

    ``claim`` is a leaf to be verified against the manifest, for most uses the leaf itself. Keys
    ascend with nulls first, trees as well, by their UTF-8 bytes; equal keys are ordered by leaf,
    and repeated rows are so many leaves. A block has ``height`` levels. An empty frame gives a manifest without rounds' rows.
    """
    placed = _placed(leaves.select("tree", "key", "leaf", "claim", F.col("key").alias("order")))
    return _finished(stored(_grown(placed, height), "blocks"), height)


def append(manifest: Manifest, leaves: DataFrame) -> Manifest:
    """The manifest with further ``leaves``, whose keys are not below those of their tree so far.

    Full blocks stay as they are, with the partial witnesses they hold. Only the open block at
    the end of each tree is built again, and the rounds above, whose size is that of the block
    roots. The old manifest stays valid.
    """
    first, full = manifest.rounds[0], ARITY**manifest.height
    if "place" in first.columns:
        first = first.drop("place")
    done = first.where(F.col("members") == full)
    again = unfolded(first.where(F.col("members") < full)).select("tree", "key", "leaf", "claim")
    ahead = done.groupBy("tree").agg(F.sum(F.col("members").cast("long")).alias("ahead"))
    late = again.select("tree", "key", "leaf", "claim").union(leaves.select("tree", "key", "leaf", "claim"))
    placed = _placed(late.withColumn("order", F.col("key")), stored(ahead, "ahead"))
    return _finished(stored(done.unionByName(_grown(placed, manifest.height)), "blocks"), manifest.height)


def unfolded(blocks: DataFrame) -> DataFrame:
    """One row per member of each block: its own witness, then that of the block if it has one."""
    wanted = ("tree", "block", "keys", "leaves", "claims", "levels")
    given = {c: F.col(c) if c in blocks.columns else F.lit("") for c in ("subroot", "root", "siblings")}
    given["steps"] = F.col("steps") if "steps" in blocks.columns else F.lit(b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):  # a block at a time
            for row in batch.to_pylist():
                for low in range(0, len(row["keys"]), 512):
                    yield members(row, low, min(low + 512, len(row["keys"])))

    def members(row: dict, low: int, high: int) -> pa.RecordBatch:
        own = [witness(row["levels"], at) for at in range(low, high)]
        cuts = [slice(at * DIGEST, (at + 1) * DIGEST) for at in range(low, high)]
        columns = {
            "tree": [row["tree"]] * len(own),
            "block": [row["block"]] * len(own),
            "key": row["keys"][low:high],
            "leaf": [row["leaves"][c] for c in cuts],
            "claim": [row["claims"][c] for c in cuts],
            "subroot": [row["subroot"]] * len(own),
            "root": [row["root"]] * len(own),
            "steps": [steps + row["steps"] for steps, _ in own],
            "siblings": [siblings + row["siblings"] for _, siblings in own],
        }
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], list(columns))

    schema = _WITNESS.replace("key long", "block long, key long")
    return blocks.select(*wanted, *(c.alias(n) for n, c in given.items())).mapInArrow(run, schema)


def _above(rounds: tuple[DataFrame, ...], known: DataFrame) -> DataFrame:
    """Blocks of the lowest of ``rounds`` with what stands above them; ``known`` is that per tree."""
    blocks = rounds[-1].join(known.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    for below in rounds[-2::-1]:
        upper = unfolded(blocks).select(
            F.col("tree").alias("_tree"), F.col("key").alias("_block"), "subroot", "root", "steps", "siblings"
        )
        same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
        blocks = below.join(stored(upper, "witnesses"), same).drop("_tree", "_block")
    return blocks


def witnesses(manifest: Manifest) -> DataFrame:
    """Every leaf's tree, key, leaf, claim, subroot, root and whole witness.

    ``steps`` has two bytes a level, from the leaf up: the place in the run and the run's size.
    ``siblings`` has the other members of these runs, as hex digests one after the other. A leaf
    that is alone has none. Witnesses above the blocks are joined to blocks, not to rows.
    """
    top = manifest.top
    root = top[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), F.lit(b"").alias("steps"), F.lit("").alias("siblings"))
    trees = unfolded(_above(top, root)).select(F.col("key").alias("place"), F.col("leaf").alias("subroot"), "root", "steps", "siblings")
    last = manifest.rounds[-1]
    known = last.select("tree", "place").join(stored(trees, "tree-witnesses"), "place").drop("place")
    return unfolded(_above((*manifest.rounds[:-1], last.drop("place")), stored(known, "trees"))).drop("block")


def verified(found: DataFrame) -> DataFrame:
    """``witnesses`` with ``folded_root``, the root that each claim leads to, in place of the claim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = (batch.column(c).to_pylist() for c in ("claim", "steps", "siblings"))
            roots = pa.array(map(fold, *given), pa.string())
            kept = [n for n in batch.schema.names if n != "claim"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), roots], [*kept, "folded_root"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.drop("claim").schema)
    return found.mapInArrow(run, f"{schema}, folded_root string")
