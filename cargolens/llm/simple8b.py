"""Token ids in Simple-8b files: several ids per 64-bit word, the selector in the top four bits.

A file holds a run of whole documents. Layout, all numbers little-endian:

    magic b"S8BT0001", then seven int64: documents, ids, words, blocks, block length, crc32 of
    the words, 1 if the first documents have no id (null), with their count in place of 1
    words           uint64 each
    block offsets   int64 each: index of a block's first word
    document ids    int64 each (0 for null)
    document sizes  int64 each: ids of the document

Every block but the last holds ``block length`` ids, so a block can be decoded by itself.
Selectors 1 to 14 say how many values of how many bits the other 60 bits hold. Selector 0
says that the next word is one value as it is (an escape for values of over 60 bits).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import buckets_for, shared_folder, stored, sums_before
from cargolens.llm.tokens import bounded, encoder

MAGIC = b"S8BT0001"
#: Values per word and bits per value of selectors 1 to 14 (fixed by the code).
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, exact over all 64 bits."""
    high = values >> np.uint64(32)
    wide = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.int64)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], wide) if high.any() else wide


def encode_block(values: np.ndarray) -> np.ndarray:
    """Words of one block: at each place the selector that takes most values."""
    values = values.astype(np.uint64)
    n = len(values)
    widths = _widths(values)
    chosen = np.zeros(n, np.int64)  # 0: escape
    most, places = int(widths.max(initial=0)), np.arange(n)
    for selector in range(14, 0, -1):
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        if selector > 1 and BITS[selector - 1] >= most:
            continue  # the next selector takes every value as well, and more of them
        large = np.flatnonzero(widths > bits)
        if np.diff(large, prepend=-1, append=n).max() <= count:
            continue  # nowhere so many small values in a row
        # How many values from each place on are small; a block's last word may hold fewer.
        after = np.full(n, n + count)
        after[large] = large
        free = np.minimum.accumulate(after[::-1])[::-1] - places
        chosen[free >= count] = selector
    starts, at = [], 0
    steps = np.maximum(COUNTS[chosen], 1).tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts, np.int64)
    selectors = chosen[first]
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(selectors == 0)[:-1]])
    words = np.zeros(len(first) + int((selectors == 0).sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for selector in np.flatnonzero(np.bincount(selectors)).tolist():
        mine = np.flatnonzero(selectors == selector)
        at = first[mine]
        if selector == 0:
            words[place[mine] + 1] = values[at]
            continue
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        word = np.full(len(mine), selector, np.uint64) << np.uint64(60)
        for k in range(count):
            word |= padded[at + k] << np.uint64(k * bits)
        words[place[mine]] = word
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values that the words of one block hold."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that an escape announces
    for at in np.flatnonzero(selectors == 0).tolist():
        if not raw[at]:
            raw[at + 1] = True
    selectors[raw] = 0  # whatever their bits look like
    counts = np.maximum(COUNTS[selectors], 1)
    counts[(selectors == 0) & ~raw] = 0
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(first[-1]), np.uint64)
    out[first[:-1][raw]] = words[raw]
    for selector in np.unique(selectors).tolist():
        if not selector:
            continue
        mine = np.flatnonzero(selectors == selector)
        bits = int(BITS[selector])
        mask = np.uint64((1 << bits) - 1)
        for k in range(int(COUNTS[selector])):
            out[first[mine] + k] = (words[mine] >> np.uint64(k * bits)) & mask
    if len(out) < n or len(out) - n >= 60:
        raise ValueError("block does not hold its number of values")
    return out[:n]


def dump(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A file of documents given in order, null ids first; ``ids`` as 32-bit integers."""
    values = np.frombuffer(b"".join(ids), "<u4")
    blocks = [encode_block(values[at : at + BLOCK]) for at in range(0, len(values), BLOCK)]
    words = np.concatenate(blocks).astype("<u8") if blocks else np.zeros(0, "<u8")
    data = words.tobytes()
    offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else []
    nulls = sum(d is None for d in doc_ids)
    head = [len(doc_ids), len(values), len(words), len(blocks), BLOCK, zlib.crc32(data), nulls]
    tail = (np.array(x, "<i8").tobytes() for x in (offsets, [d or 0 for d in doc_ids], [len(b) // 4 for b in ids]))
    return b"".join([MAGIC, np.array(head, "<i8").tobytes(), data, *tail])


def load(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their sizes, and all ids one after the other."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, n_words, n_blocks, block, crc, nulls = np.frombuffer(data, "<i8", 7, 8).tolist()
    at = 64
    if zlib.crc32(data[at : at + 8 * n_words]) != crc:
        raise ValueError("words differ from their checksum")
    words = np.frombuffer(data, "<u8", n_words, at)
    offsets = np.frombuffer(data, "<i8", n_blocks, at + 8 * n_words).tolist()
    at += 8 * (n_words + n_blocks)
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    sizes = np.frombuffer(data, "<i8", docs, at + 8 * docs)
    values = [
        decode_block(words[begin:end], min(block, n - k * block))
        for k, (begin, end) in enumerate(zip(offsets, [*offsets[1:], n_words], strict=True))
    ]
    ids = np.concatenate(values).astype("<u4") if values else np.zeros(0, "<u4")
    return [None] * nulls + keys[nulls:], sizes, ids


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared place, as Spark names it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_text_bytes: int = 16 << 20,
) -> DataFrame:
    """Write the ids of all documents in ascending id order; return the stored list of files.

    The list has file number, path, documents, ids and ``base_ids`` (the ids in files before).
    Files are range partitions by id, of about ``file_text_bytes`` bytes of text each. A null
    or empty text gives its end id alone; null ids come first; rows of equal id follow each
    other in the order they are read; an empty frame gives no file. A file gets a new name in
    every attempt, and only files of attempts that Spark accepts are in the list.
    """
    folder = shared_folder(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys, ids, part = encoder(tokenizer), [], [], None
        for batch in bounded(batches, 1):
            part = batch.column(2)[0].as_py() if batch.num_rows and part is None else part
            keys += batch.column(0).to_pylist()
            ids += encode.arrow(batch.column(1), end_id).to_pylist()
        if not keys:
            return
        system, place = opened(folder)
        system.create_dir(place, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.s8b"
        with system.open_output_stream(f"{place}/{name}") as out:
            out.write(dump(keys, ids))
        columns = [[part], [f"{folder}/{name}"], [len(keys)], [sum(map(len, ids)) // 4]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "path", "docs", "ids"])

    n_files = buckets_for(docs, text_col, file_text_bytes)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(text_col).alias("_text"),
        F.monotonically_increasing_id().alias("_read"),
    )
    rows = rows.repartitionByRange(n_files, "_id", "_read").sortWithinPartitions("_id", "_read")
    rows = rows.select("_id", "_text", F.spark_partition_id().alias("_part"))
    files = stored(rows.mapInArrow(run, "file long, path string, docs long, ids long"), "token-list")
    bases = sums_before(files.groupBy("file").agg(F.sum("ids").alias("ids")), "file", ("ids",))
    return files.join(bases, "file")


def read(files: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start, n_tokens and ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = opened(path)
                with system.open_input_stream(place) as source:
                    keys, sizes, ids = load(source.read())
                ends = np.cumsum(sizes)
                data = [ids[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                for at in range(0, len(keys), 1000):
                    cut = slice(at, at + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[cut], pa.int64()),
                            pa.array((base + ends - sizes)[cut], pa.int64()),
                            pa.array(sizes[cut], pa.int64()),
                            pa.array(data[cut], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    # One file per task: the list is tiny, so Spark would put many files into one.
    spread = files.select("path", "base_ids").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
