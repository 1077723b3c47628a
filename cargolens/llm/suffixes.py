"""Removal of repeated passages by sorting suffixes to the depth that counts.

A passage is repeated if a string of ``length`` bytes also starts in a document with a smaller
id. Strings that are equal choose the same anchor, the ``ANCHOR``-gram of smallest hash inside them, so they meet
in the bucket of that anchor's hash. Neighbouring strings of one anchor
travel together as one run of bytes. A bucket orders the suffixes of its runs by deep-shallow
sorting (multikey sort to a shallow depth, blind tries from there to ``length``), and equal
strings become neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.llm.shared import buckets_for, releasing

ANCHOR = 16
SHALLOW = 16
#: Text bytes whose runs are computed at once, that are packed together, and per bucket.
CHUNK, BATCH, BUCKET = 1 << 19, 4 << 20, 3 << 20
#: Strings that go into blind tries together.
AT_ONCE = 1 << 17
#: Differing runs of an anchor beyond which its strings are sent one by one.
HOT_RUNS = 4096
NO_ID = (1 << 63) - 1

_random = np.random.default_rng(20)
_BYTES, _BYTES2 = _random.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _random.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_STEPS[7])
_UNBASE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each place on (``k`` a power of two)."""
    h, size, level = _BYTES[data], 1, 0
    while size < k:
        h = h[:-size] * _STEPS[level] + h[size:]
        size, level = 2 * size, level + 1
    return _mixed(h)


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _string_hash(data: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hash of the ``size`` bytes at each of ``first``, which are in order."""
    size = np.broadcast_to(size, first.shape)
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        low = int(first[at])
        to = int(np.searchsorted(first, low + CHUNK, "left"))
        begin, end = first[at:to] - low, first[at:to] - low + size[at:to]
        cut = data[low : low + int(end.max())]
        powers = np.cumprod(np.full(len(cut), _BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES2[cut] * powers)])
        inverse = np.cumprod(np.full(len(cut), _UNBASE, np.uint64))
        out[at:to] = _mixed((sums[end] - sums[begin]) * inverse[begin])
        at = to
    return out


def runs(data: np.ndarray, valid: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with one anchor: place, bytes, anchor hash, content hash.

    ``valid`` tells where a string may start, ``begins`` where a document does; both are as
    long as there are places for a whole string.
    """
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    grams = _grams(data, ANCHOR)
    # The place is the low half, so that of equal hashes the first is the anchor.
    ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_lowest(ranked, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = begins.copy()
    head[1:] |= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    head = head[at]
    head[0] = True
    first = at[head]
    last = np.append(at[np.flatnonzero(head)[1:] - 1], at[-1])
    size = last + length - first
    return first, size, grams[anchor[first]], _string_hash(data, first, size)


def _pieces(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all runs one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``length`` bytes at ``starts``, and where a new string begins in it.

    Multikey sort by words of eight bytes down to ``SHALLOW`` bytes. What is still equal goes
    into blind tries, all groups at a time: a group's first string is a path of the trie, each
    other one hangs off it where its first differing byte stands, and those that hang off at the
    same byte are the groups of the next round.
    """
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    fresh = np.zeros(len(starts), bool)
    for depth in range(0, SHALLOW, 8):
        words = _columns(data, starts[order] + depth, 8).view(">u8")[:, 0]
        by = np.lexsort((words, group))
        order, words, group = order[by], words[by], group[by]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (words[1:] != words[:-1])
        group = np.cumsum(fresh) - 1
    slots = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
    heads = np.flatnonzero(np.diff(group[slots], prepend=-1))
    cuts = heads[np.diff(heads // AT_ONCE, prepend=0) > 0]  # whole groups, some at a time
    for some in np.split(slots, cuts):
        _blind_tries(data, starts, length, order, fresh, some, group[some])
    return order, fresh


def _columns(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each start on, one row each."""
    out = np.empty((len(starts), width), np.uint8)
    for k in range(width):
        out[:, k] = data[starts + k]
    return out


def _blind_tries(
    data: np.ndarray, starts: np.ndarray, length: int, order: np.ndarray, fresh: np.ndarray, slots: np.ndarray, group: np.ndarray
) -> None:
    """Order the members of ``slots``, group by group, by what follows their shallow bytes."""
    members = order[slots]
    tails = _columns(data, starts[members] + SHALLOW, length - SHALLOW)
    while len(slots):
        lead = np.flatnonzero(np.diff(group, prepend=-1))
        path = tails[np.repeat(lead, np.diff(np.append(lead, len(group))))]
        depth = (tails != path).argmax(axis=1)
        mine = np.take_along_axis(tails, depth[:, None], 1)[:, 0].astype(np.int16)
        side = np.sign(mine - np.take_along_axis(path, depth[:, None], 1)[:, 0])
        del path
        rank = np.where(side, -side * depth, 0)  # smaller ones leave the path early, larger late
        byte = np.where(side, mine, 0)
        by = np.lexsort((byte, rank, side, group))
        members, tails = members[by], tails[by]
        keys = [x[by] for x in (group, side, rank, byte)]
        new = np.ones(len(by), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        order[slots] = members
        fresh[slots] |= new
        group = np.cumsum(new) - 1
        stay = (keys[1] != 0) & (np.bincount(group)[group] > 1)
        slots, members, tails, group = slots[stay], members[stay], tails[stay], group[stay]


_ROW = np.dtype([("doc", "<u4"), ("start", "<u4"), ("size", "<u2")])
_CUT = np.dtype([("doc", "<u4"), ("start", "<u4"), ("stop", "<u4")])


def _string_runs(cut: np.ndarray, place: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The single strings of runs, as runs of their own."""
    many = size - length + 1
    single = np.repeat(place - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    hashes = _string_hash(cut, single, length)
    return single, np.full(len(single), length), hashes, hashes


class Runs:
    """The runs of a batch of documents, as arrays; equal runs count for the smallest id only.

    ``later`` are the runs that a smaller id of the batch has too: they are cut whole. All
    others have place, size, key, document and start in it.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None], length: int) -> None:
        data = [(t or "").encode() for t in texts]
        use = [i for i, d in enumerate(data) if len(d) >= length]
        self.length, self.doc_of = length, np.array(use, np.int64)
        self.ids = np.array([NO_ID if ids[i] is None else ids[i] for i in use], np.int64)
        self.data = np.frombuffer(b"".join(data[i] for i in use), np.uint8)
        sizes = np.array([len(data[i]) for i in use], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))]
        if use:
            places = len(self.data) - length + 1
            valid, begins = np.ones(places, bool), np.zeros(places, bool)
            for end in self.ends.tolist()[:-1]:
                valid[end - length + 1 : end] = False
            begins[self.begins] = True
            for at in range(0, places, CHUNK):
                to = min(at + CHUNK, places)
                place, *rest = runs(self.data[at : to + length - 1], valid[at:to], begins[at:to], length)
                found.append((place + at, *rest))
        self.later = np.zeros(0, _CUT)
        self._settle(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _settle(self, place: np.ndarray, size: np.ndarray, key: np.ndarray, content: np.ndarray) -> None:
        doc = np.searchsorted(self.ends, place, "right")
        ids = self.ids[doc]
        by = np.lexsort((ids, size, content, key))
        new = np.ones(len(by), bool)
        for x in (key, content, size):
            new[1:] &= x[by][1:] == x[by][:-1]
        new[1:] = ~new[1:]
        least = np.empty(len(by), np.int64)
        least[by] = ids[by][new][np.cumsum(new) - 1]
        keep = ids == least
        start = place - self.begins[doc]
        cuts = np.empty(int((~keep).sum()), _CUT)
        cuts["doc"], cuts["start"], cuts["stop"] = (x[~keep] for x in (self.doc_of[doc], start, start + size))
        self.later = joined(np.concatenate([self.later, cuts]))
        self.place, self.size, self.key, self.content = (x[keep] for x in (place, size, key, content))
        self.doc, self.start = doc[keep], start[keep]

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket that has runs, and the runs' numbers in order of key and place."""
        bucket = (self.key % np.uint64(n)).astype(np.int64)
        by = np.lexsort((self.place, self.key, bucket))
        edges = np.flatnonzero(bucket[by][1:] != bucket[by][:-1]) + 1
        for mine in np.split(by, edges) if len(by) else ():
            yield int(bucket[mine[0]]), mine

    def keep(self, mine: np.ndarray, apart: np.ndarray) -> None:
        """Go on with the runs numbered ``mine``, and with the single strings of those ``apart``."""
        whole = tuple(x[mine] for x in (self.place, self.size, self.key, self.content))
        if len(apart):
            apart = apart[np.argsort(self.place[apart])]
            single = _string_runs(self.data, self.place[apart], self.size[apart], self.length)
            whole = tuple(np.concatenate(x) for x in zip(whole, single, strict=True))
        self._settle(*whole)

    def dump(self, mine: np.ndarray) -> bytes:
        """Runs in order of place, column by column, with the documents they are from."""
        mine = np.sort(mine)
        used, doc = np.unique(self.doc[mine], return_inverse=True)
        columns = [np.array([len(mine), len(used)], "<i8"), self.ids[used], self.doc_of[used].astype("<u4")]
        for name, values in zip(_ROW.names, (doc, self.start[mine], self.size[mine]), strict=True):
            columns.append(values.astype(_ROW[name]))
        columns.append(_pieces(self.data, self.place[mine], self.size[mine]))
        return zstandard.compress(b"".join(c.tobytes() for c in columns), 3)


def _undump(blob: bytes) -> tuple[np.ndarray, ...]:
    """Id, document number, start and size of each run, and the runs' bytes."""
    data = zstandard.decompress(blob)
    n, n_docs = np.frombuffer(data, "<i8", 2).tolist()
    ids, at = np.frombuffer(data, "<i8", n_docs, 16), 16 + 8 * n_docs
    numbers, at = np.frombuffer(data, "<u4", n_docs, at), at + 4 * n_docs
    columns = []
    for name in _ROW.names:
        columns.append(np.frombuffer(data, _ROW[name], n, at).astype(np.int64))
        at += n * _ROW[name].itemsize
    doc, start, size = columns
    return ids[doc], numbers[doc], start, size, np.frombuffer(data, np.uint8, -1, at)


def joined(cuts: np.ndarray) -> np.ndarray:
    """Cuts in order, those of one document that touch made one."""
    if len(cuts) < 2:
        return cuts
    cuts = cuts[np.lexsort((cuts["start"], cuts["doc"]))]
    owner = cuts["doc"].astype(np.int64) << 32
    reach = np.maximum.accumulate(owner + cuts["stop"])
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] + cuts["start"][1:] > reach[:-1]]))
    out = cuts[heads]
    out["stop"] = np.maximum.reduceat(cuts["stop"], heads)
    return out


def flag_keys(
    batches: list[np.ndarray], counts: list[np.ndarray], shared: list[np.ndarray], hot_runs: int
) -> list[np.ndarray]:
    """Per batch and key of one bucket 0 (one id has it), 1 (more have it) or 2 (it is hot).

    Each batch names a key once, with the number of its runs and whether two ids share it.
    """
    keys, place = np.unique(np.concatenate(batches), return_inverse=True)
    many = np.bincount(place, minlength=len(keys)) > 1
    many |= np.bincount(place, np.concatenate(shared), len(keys)) > 0
    total = np.bincount(place, np.concatenate(counts), len(keys))
    flag = (many.astype(np.uint8) + (many & (total > hot_runs)))[place]
    return np.split(flag, np.cumsum([len(b) for b in batches])[:-1])


def find_cuts(blobs: list[bytes], length: int) -> list[np.ndarray]:
    """The cuts that the runs of one bucket show, for each blob."""
    opened = [_undump(b) for b in blobs]
    ids, doc, start, sizes, text = (np.concatenate(x) for x in zip(*opened, strict=True))
    source = np.repeat(np.arange(len(blobs)), [len(x[0]) for x in opened])
    del opened
    first = np.cumsum(sizes) - sizes
    # Equal runs are sorted once, for the smallest id among them.
    content = _string_hash(text, first, sizes)
    by = np.lexsort((ids, sizes, content))
    new = np.ones(len(by), bool)
    new[1:] = (content[by][1:] != content[by][:-1]) | (sizes[by][1:] != sizes[by][:-1])
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    one = by[new]
    least = ids[one]

    many = sizes[one] - length + 1
    owner = np.repeat(np.arange(len(one)), many)
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    order, fresh = sort_suffixes(text, first[one][owner] + inside, length)
    smallest = np.minimum.reduceat(least[owner[order]], np.flatnonzero(fresh))
    repeated = np.zeros(len(order), bool)
    repeated[order] = smallest[np.cumsum(fresh) - 1] < least[owner[order]]

    # Stretches of repeated strings in each kind, for the runs with its smallest id.
    hit = np.flatnonzero(repeated)
    begin = np.ones(len(hit), bool)
    begin[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    heads = np.flatnonzero(begin)
    tails = np.append(heads, len(hit))[1:] - 1
    of, low, high = owner[hit[heads]], inside[hit[heads]], inside[hit[tails]] + length
    count = np.bincount(of, minlength=len(one))
    base = np.cumsum(count) - count
    later = ids > least[kind]
    rest = np.flatnonzero(~later)
    rest = rest[count[kind[rest]] > 0]
    each = count[kind[rest]]
    row = np.repeat(rest, each)
    pick = np.repeat(base[kind[rest]] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))

    row = np.concatenate([np.flatnonzero(later), row])
    cuts = np.empty(len(row), _CUT)
    cuts["doc"] = doc[row]
    cuts["start"] = start[row] + np.concatenate([np.zeros(int(later.sum()), np.int64), low[pick]])
    cuts["stop"] = start[row] + np.concatenate([sizes[later], high[pick]])
    by = np.argsort(source[row], kind="stable")
    edges = np.searchsorted(source[row][by], np.arange(1, len(blobs)))
    return [joined(c) for c in np.split(cuts[by], edges)]


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unipc(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as source:
        return source.read_next_batch()


def in_batches(docs: DataFrame, text_col: str, batch_bytes: int) -> DataFrame:
    """Rows of ``docs`` packed into batches of about ``batch_bytes`` bytes of text: batch, rows."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number = (part << 32) + made
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_ipc(table)], pa.binary())], ["batch", "rows"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= batch_bytes:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield out()
                    made, held, size, begin = made + 1, [], 0, i + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield out()

    return docs.mapInArrow(releasing(run), "batch long, rows binary")


#: The maximal byte ranges (start, stop) to remove from one text, in order.
Ranges = list[tuple[int, int]]


def with_spans(
    docs: DataFrame, spans: str, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **limits: int
) -> DataFrame:
    """``docs`` with a column ``spans``: the maximal byte ranges (start, stop) to remove, in order.

    As ``map_spans``, which see. No column may be called ``spans``.
    """
    if spans in docs.columns:
        raise ValueError(f"there is a column {spans} already")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = [*docs.columns, spans]

    def add(rows: pa.RecordBatch, found: list[Ranges]) -> pa.RecordBatch:
        lists = pa.array([[{"start": a, "stop": b} for a, b in ranges] for ranges in found], kind)
        return pa.RecordBatch.from_arrays([*rows.columns, lists], names)

    out = T.ArrayType(T.StructType.fromDDL("start long, stop long"))
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, out)])
    return map_spans(docs, add, schema, length, id_col, text_col, **limits)


def map_spans(
    docs: DataFrame,
    finish: Callable[[pa.RecordBatch, list[Ranges]], pa.RecordBatch],
    schema: T.StructType | str,
    length: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """What ``finish`` makes of batches of ``docs`` and the ranges to remove from each text.

    Null or short texts have none. Ids are compared as numbers, a null id is larger than any,
    and rows of equal id remove nothing from each other. An empty frame gives no rows. All
    columns of ``docs`` are handed on.

    Texts move once, in packed batches. First each batch sends its anchors' hashes and learns
    which of them other ids have as well; then it sends the runs of those only. A bucket finds
    the cuts of its runs and sends them back to the batches. An anchor of over ``hot_runs``
    differing runs is sent string by string, by the hash of the whole string, so a passage in
    a third of all documents is spread over all buckets.
    """
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    n = buckets_for(docs, text_col, BUCKET)

    def opened(rows: pa.RecordBatch) -> Runs:
        return Runs(rows.column(id_at).cast(pa.int64()).to_pylist(), rows.column(text_at).to_pylist(), length)

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for incoming in batches:
            for number, data in _one_by_one(incoming):
                found, sent = opened(_unipc(data)), []
                for bucket, mine in found.buckets(n):
                    keys, first, count = np.unique(found.key[mine], return_index=True, return_counts=True)
                    ids = found.ids[found.doc[mine]]
                    shared = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
                    short = (keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    counts = np.minimum(count, 65535).astype("<u2").tobytes()
                    packed = zstandard.compress(counts + np.packbits(shared).tobytes(), 3)
                    sent.append((bucket, number, short, packed))
                yield _made(sent, ("bucket", "batch", "keys", "about"), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))

    def flag(group: pa.Table) -> pa.Table:
        keys, counts, shared = [], [], []
        for short, packed in zip(group["keys"].to_pylist(), group["about"].to_pylist(), strict=True):
            wide = np.zeros((len(short) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(short, np.uint8).reshape(-1, 6)
            about = zstandard.decompress(packed)
            keys.append(wide.view(np.uint64)[:, 0])
            counts.append(np.frombuffer(about, "<u2", len(wide)))
            shared.append(np.unpackbits(np.frombuffer(about, np.uint8, -1, 2 * len(wide)), count=len(wide)))
        flags = [zstandard.compress(f.tobytes(), 3) for f in flag_keys(keys, counts, shared, hot_runs)]
        return pa.table({"batch": group["batch"], "bucket": group["bucket"], "flags": pa.array(flags, pa.binary())})

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for incoming in batches:
            for number, data, told in _one_by_one(incoming):
                found = opened(_unipc(data))
                flags = {t["bucket"]: np.frombuffer(zstandard.decompress(t["flags"]), np.uint8) for t in told or ()}
                keep, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for bucket, mine in found.buckets(n):
                    flagged = flags[bucket][np.unique(found.key[mine], return_inverse=True)[1]]
                    keep.append(mine[flagged == 1])
                    apart.append(mine[flagged == 2])
                found.keep(np.concatenate(keep), np.concatenate(apart))
                sent = [(bucket, number, found.dump(mine), False) for bucket, mine in found.buckets(n)]
                if len(found.later):
                    sent.append((number % n, number, zstandard.compress(found.later.tobytes(), 3), True))
                del found
                for at in range(0, len(sent), 64):
                    names, types = ("bucket", "batch", "sent", "cut"), (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
                    yield _made(sent[at : at + 64], names, types)

    def search(group: pa.Table) -> pa.Table:
        done = group.filter(group["cut"])
        rest = group.filter(pc.invert(group["cut"]))
        found = find_cuts(rest["sent"].to_pylist(), length) if rest.num_rows else []
        cuts = [*done["sent"].to_pylist(), *(zstandard.compress(c.tobytes(), 3) for c in found)]
        numbers = pa.array([*done["batch"].to_pylist(), *rest["batch"].to_pylist()], pa.int64())
        return pa.table({"batch": numbers, "cuts": pa.array(cuts, pa.binary())})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for incoming in batches:
            for data, told in _one_by_one(incoming):
                rows = _unipc(data)
                parts = [np.frombuffer(zstandard.decompress(t), _CUT) for t in told or ()]
                cuts = joined(np.concatenate([np.zeros(0, _CUT), *parts]))
                found: list[Ranges] = [[] for _ in range(rows.num_rows)]
                for doc, start, stop in cuts.tolist():
                    found[doc].append((start, stop))
                yield finish(rows, found)

    packed = in_batches(docs, text_col, batch_bytes).repartition("batch")
    flags = (
        packed.mapInArrow(releasing(send_keys), "bucket long, batch long, keys binary, about binary")
        .groupBy("bucket")
        .applyInArrow(flag, "batch long, bucket long, flags binary")
        .groupBy("batch")
        .agg(F.collect_list(F.struct("bucket", "flags")).alias("told"))
    )
    cuts = (
        packed.join(flags, "batch", "left")
        .select("batch", "rows", "told")
        .mapInArrow(releasing(send_runs), "bucket long, batch long, sent binary, cut boolean")
        .groupBy("bucket")
        .applyInArrow(search, "batch long, cuts binary")
        .groupBy("batch")
        .agg(F.collect_list("cuts").alias("told"))
    )
    return packed.join(cuts, "batch", "left").select("rows", "told").mapInArrow(releasing(close), schema)


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch of large values, of which one at a time is copied."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def _made(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], list(names))


def remaining(data: bytes, ranges: Ranges) -> bytes:
    """The bytes outside the ranges."""
    places = [0, *(x for pair in ranges for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(places[::2], places[1::2], strict=True))


def digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    ``kept_text`` leaves out characters that a cut has split. Null texts count as empty.
    """

    def finish(rows: pa.RecordBatch, found: list[Ranges]) -> pa.RecordBatch:
        out = []
        for text, ranges in zip(rows.column(1).to_pylist(), found, strict=True):
            data = (text or "").encode()
            left = remaining(data, ranges)
            sha = hashlib.sha256(left).hexdigest()
            out.append((len(data), len(data) - len(left), len(ranges), sha, left.decode(errors="ignore")))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        made = _made(out, ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"), types)
        return pa.RecordBatch.from_arrays([rows.column(0), *made.columns], ["doc_id", *made.schema.names])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_spans(rows, finish, schema, length, **limits)


def without_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text, all other columns as they are.

    Characters that a cut splits go as a whole. Rows of whose text no word is left are dropped
    if anything was cut; null and empty texts stay.
    """
    at, names = docs.columns.index(text_col), docs.columns

    def finish(rows: pa.RecordBatch, found: list[Ranges]) -> pa.RecordBatch:
        texts, stay = [], []
        for text, ranges in zip(rows.column(at).to_pylist(), found, strict=True):
            if ranges:
                text = remaining(text.encode(), ranges).decode(errors="ignore")
            texts.append(text)
            stay.append(not ranges or bool(text.strip()))
        columns = rows.columns
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stay, pa.bool_()))

    return map_spans(docs, finish, docs.schema, length, id_col, text_col)
