"""SimHash near-duplicates: fingerprints, vantage-point trees over them, and their components.

Two fingerprints that differ in at most 4 of 64 bits differ in at most 1 bit of one of three
blocks of 21 or 22 bits. For each block there is a vantage-point tree: a node holds a vantage
block v and a radius m, and a fingerprint goes left if its block lies within m bits of v, else
right. A near block within r bits can lie on the other side only if |d - m| is at most r
(triangle bounds), so a fingerprint also visits the sides that its ball of r bits touches. The
leaves are shards; in each, all pairs of whole fingerprints within 4 bits are linked.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, starmap

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.llm.components import components
from cargolens.llm.shared import releasing, shared_folder, slices, stored
from cargolens.llm.simple8b import opened

BITS = 64
#: Distinct fingerprints that the trees are fitted on, and members of a leaf, about.
SAMPLE = 40_000
LEAF = 1500


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of a text's word shingles, 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.lower and split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    cuts = map(joined.__getitem__, starmap(slice, zip(starts.tolist(), ends.tolist(), strict=True)))
    hashed = np.fromiter((xxhash.xxh64_intdigest(c, 42) for c in cuts), np.uint64, len(starts))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        raw = hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * votes > len(hashed)).tolist()
    return sum(1 << b for b in set_bits)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(releasing(run), "doc_id long, fp long")


def distances(values: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ one)


@dataclass(frozen=True)
class Node:
    """Blocks within ``radius`` of ``vantage`` are left; a leaf has a number instead of sides."""

    vantage: np.uint64
    radius: int
    left: Node | int
    right: Node | int


def fit(blocks: np.ndarray, leaves: int, seed: int) -> tuple[Node | int, int]:
    """A tree over sampled ``blocks`` that aims at ``leaves`` leaves, and their number."""
    rng, number = np.random.default_rng(seed), 0

    def grow(values: np.ndarray, aim: int) -> Node | int:
        nonlocal number
        if aim > 1 and len(values) > 1:
            vantage = values[rng.integers(len(values))]
            d = distances(values, vantage)
            radius = int(np.median(d))
            radius -= bool(np.all(d <= radius))
            near = d <= radius
            if near.any():
                left = max(1, round(aim * float(near.mean())))
                return Node(vantage, radius, grow(values[near], left), grow(values[~near], max(1, aim - left)))
        number += 1
        return number - 1

    return grow(np.sort(blocks), leaves), number


def route(node: Node | int, blocks: np.ndarray, home: np.ndarray, r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that is reached: its number, members' positions, and which are at home.

    ``home`` tells which of ``blocks`` are no visitors from the start.
    """

    def walk(node: Node | int, at: np.ndarray, own: np.ndarray) -> Iterator:
        if not len(at):
            return
        if isinstance(node, int):
            yield node, at, own
            return
        d = distances(blocks[at], node.vantage).astype(np.int64)
        near = d <= node.radius
        # Of a pair on two sides, the left one visits the right side. A visitor, looking for
        # members at home, goes to both sides that its ball touches.
        left, right = near | (~own & (d <= node.radius + r)), ~near | (d > node.radius - r)
        yield from walk(node.left, at[left], (own & near)[left])
        yield from walk(node.right, at[right], (own & ~near)[right])

    yield from walk(node, np.arange(len(blocks)), home)


def block_masks(max_bits: int, blocks: int) -> tuple[list[np.uint64], int]:
    """Masks that part the 64 bits, and the bits in which a near pair differs in one of them."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return masks, max_bits // blocks


def link(values: np.ndarray, max_bits: int) -> np.ndarray:
    """For each value the smallest position it is linked to, over any number of links.

    Every value is compared once, with those not yet reached, so a group of near copies costs
    few comparisons and gives one link per member and not one per pair.
    """
    root = np.arange(len(values))
    left = np.arange(len(values))
    while len(left) > 1:
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            near = distances(values[left], values[todo.pop()]) <= max_bits
            if near.any():
                reached = left[near]
                root[reached] = first
                todo += reached.tolist()
                left = left[~near]
    return root


def solve(values: np.ndarray, home: np.ndarray, mask: np.uint64, r: int, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links among the members of one shard; a shard over ``LEAF`` is parted by a tree of its own."""
    tree, _ = fit(values[home] & mask, -(-int(home.sum()) // LEAF), 7)
    for _, at, own in route(tree, values & mask, home, r):
        if own.any() and len(at) > 1:
            root = link(values[at], max_bits)
            linked = np.flatnonzero(root != np.arange(len(at)))
            yield from zip(values[at[linked]].tolist(), values[at[root[linked]]].tolist(), strict=True)


def near_pairs(distinct: DataFrame, max_bits: int = 4, blocks: int = 3) -> DataFrame:
    """Links ``src``, ``dst`` between the fingerprints ``fp`` that connect all near ones.

    Any two fingerprints within ``max_bits`` bits are joined by a path of links, and every
    link joins two such fingerprints or stands for a path of them. Trees are fitted on at most
    ``SAMPLE`` fingerprints; every fingerprint is routed and searched.
    """
    spark, (masks, r) = distinct.sparkSession, block_masks(max_bits, blocks)
    n = distinct.count()
    picked = distinct.sample(min(1.0, SAMPLE / max(1, n)), seed=11).limit(2 * SAMPLE).collect()
    sample = np.array([r["fp"] for r in picked], np.int64).view(np.uint64)
    aim = min(-(-n // LEAF), max(1, len(sample) // 8))
    trees = spark.sparkContext.broadcast([fit(sample & m, aim, 5 + k)[0] for k, m in enumerate(masks)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, mask in enumerate(masks):
                for leaf, at, home in route(trees.value[k], values & mask, np.ones(len(values), bool), r):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), k * (1 << 32) + leaf)),
                            pa.array(values[at].view(np.int64)),
                            pa.array(home),
                        ],
                        ["shard", "fp", "home"],
                    )

    def search(group: pa.Table) -> pa.Table:
        mask = masks[group["shard"][0].as_py() >> 32]
        values = group["fp"].to_numpy().view(np.uint64)
        found = list(solve(values, group["home"].to_numpy(), mask, r, max_bits))
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    sent = distinct.select("fp").mapInArrow(releasing(send), "shard long, fp long, home boolean")
    return sent.groupBy("shard").applyInArrow(search, "src long, dst long")


def smallest_linked(groups: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fp`` and ``least``, the smallest ``first`` among the fingerprints that it is linked to.

    ``groups`` has one row per fingerprint, with ``first`` of any type that can be ordered.
    """
    labels = components(stored(near_pairs(groups.select("fp"), max_bits), "links"))
    linked = groups.join(labels, groups["fp"] == labels["node"])
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    named = stored(linked.join(least, "label").select("fp", "least"), "components")
    # Fingerprints without a link keep their own.
    return groups.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's ``doc_id``, ``fp`` and ``component_id``, the smallest id that it is linked to.

    Rows of equal fingerprints are linked, and rows whose fingerprints differ in at most
    ``max_bits`` bits; null, empty and blank texts all have fingerprint 0 and are linked as any
    other. Null ids never name a component unless it has no other id. Repeated rows are in one
    component. An empty frame gives no rows. Other columns are not read, whatever their names.
    """
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    final = smallest_linked(groups, max_bits).withColumnRenamed("least", "component_id")
    return rows.join(final, "fp").select("doc_id", "fp", "component_id")


def _named_otherwise(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _with_places(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """A plain read of Parquet files with the file and the row of each row, and these columns' names."""
    file, at = (_named_otherwise(n, docs.columns) for n in ("_file", "_at"))
    place = docs.metadataColumn("_metadata")
    return docs.select(*docs.columns, place["file_path"].alias(file), place["row_index"].alias(at)), file, at


def _bitmap(folder: str, file: str) -> str:
    """Where the bits of a file's chosen rows lie. They depend on the file only, so a task that
    is run again writes the same."""
    return f"{folder}/{hashlib.sha256(file.encode()).hexdigest()}.bits"


def _keep_rows(docs: DataFrame, file: str, at: str, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place (``file``, ``at``) is in ``chosen``, without moving any row.

    The chosen places of a file become one bit per row in the shared folder, and the task that
    reads a file looks up the bits of that file only.
    """
    folder = shared_folder(docs.sparkSession, "chosen-rows")
    columns = [c for c in docs.columns if c not in (file, at)]

    def write(group: pa.Table) -> pa.Table:
        name, places = group["file"][0].as_py(), group["at"].to_numpy()
        bits = np.zeros(int(places.max()) + 1, bool)
        bits[places] = True
        system, target = opened(_bitmap(folder, name))
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        unfinished = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(unfinished) as out:
            out.write(np.packbits(bits).tobytes())
        system.move(unfinished, target)
        return pa.table({"file": [name], "rows": [len(places)]})

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = None, np.zeros(0, bool)
        for batch in slices(batches, 2000):
            files, places = batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_numpy()
            edges = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
            for low, high in pairwise(edges):
                if files[low:high] and files[low] != known:
                    known = files[low]
                    system, target = opened(_bitmap(folder, known))
                    bits = np.zeros(0, bool)
                    if system.get_file_info(target).type == fs.FileType.File:
                        with system.open_input_stream(target) as source:
                            bits = np.unpackbits(np.frombuffer(source.read(), np.uint8)).astype(bool)
                mine = places[low:high]
                inside = mine < len(bits)
                wanted = np.zeros(len(mine), bool)
                wanted[inside] = bits[mine[inside]]
                some = batch.slice(low, high - low).filter(pa.array(wanted))
                yield pa.RecordBatch.from_arrays(some.columns[: len(columns)], columns)

    stored(chosen.groupBy("file").applyInArrow(write, "file string, rows long"), "chosen-files")
    schema = T.StructType([f for f in docs.schema.fields if f.name in columns])
    return docs.mapInArrow(releasing(keep), schema)


def one_of_each(
    docs: DataFrame,
    shingle: int = 4,
    max_bits: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    in_place: bool = False,
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns as they are, whatever their names.

    Of each component of ``near_duplicates`` the row with the smallest id stays (null ids last;
    of repeated rows the first by its place of reading). Texts are read twice and never moved:
    only fingerprints and places are shuffled. ``in_place`` says that ``docs`` is a plain read of
    Parquet files; any other frame is stored first, so that its rows have a place.
    """
    placed, file, at = _with_places(docs if in_place else stored(docs, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t, shingle) for t in batch.column(3).to_pylist()]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bits], ["file", "at", "id", "fp"])

    narrow = placed.select(F.col(file).alias("file"), F.col(at).alias("at"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stored(narrow.mapInArrow(releasing(run), "file string, at long, id long, fp long"), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "file", "at")
    groups = stored(rows.groupBy("fp").agg(F.min(rank).alias("first")), "distinct")
    # The row that is smallest in its component is the smallest of its own fingerprint as well.
    final = smallest_linked(groups, max_bits).join(groups, "fp").where("first = least")
    return _keep_rows(placed, file, at, final.select("first.file", "first.at"))
