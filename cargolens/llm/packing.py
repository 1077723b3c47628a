"""Mixture-controlled packing: windows draw from the sources' queues to target proportions.

Deficit round-robin: every window credits each queue with its target's share of the window. A
queue is served when its deficit, what it was credited with and has not given yet, is worth a
piece; the deficit that is left is carried into the next window, and so on over all windows and
over the tasks whose rows fill the queue. A queue that runs dry leaves the round; the others share
the windows by their targets from there on.

No task waits for the windows before its own, as every deficit can be told directly. Let time
pass so that a queue of target t has given t * time ids. Queues of N ids run dry at N / t, which
parts time into phases without a change of queues. In a phase the queues stand in a fixed order,
with running totals P of what they give in it and a total T, and the queues up to s have given
floor(w * length * P / T) ids after w windows: the rounded credit. Sources that are owed less than a
quantum by a window are served in turns, one piece in every 2, 4, 8, ... windows; those of one
turn length form one queue, whose rounds are dealt out among them in the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import releasing, slices, stored, sums_before
from cargolens.llm.tokens import bounded, encoder, forget

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, source string, source_share double"
)


def tokenize(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, source_col: str
) -> DataFrame:
    """Ids of every text with the place each text takes in its part's queue of its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ahead = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in bounded(batches, 2):
            ids = encode.arrow(batch.column(2), end_id)
            sizes = pc.divide(pc.binary_length(ids), 4)
            before = []
            for source, n in zip(batch.column(1).to_pylist(), sizes.to_pylist(), strict=True):
                before.append(ahead.get(source, 0))
                ahead[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(ids), pa.int32()),
                    batch.column(0),
                    batch.column(1),
                    pa.array(before, pa.int64()),
                    sizes,
                    ids.cast(pa.binary()),
                ],
                ["part", "id", "source", "before", "n", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string"), text_col)
    schema = "part int, id long, source string, before long, n long, ids binary"
    return stored(rows.mapInArrow(releasing(run), schema), "ids")


@dataclass(frozen=True)
class Queue:
    """One queue of a round: the ids of all queues before it, and of those and itself.

    ``total`` is that of all queues, ``length`` the ids of a round; the first round is short of
    ``skip`` ids.
    """

    low: int
    high: int
    total: int
    length: int
    skip: int = 0

    def _given(self, upto: int, window: int) -> int:
        return max(0, min(window * self.length - self.skip, self.total)) * upto // self.total

    def given(self, window: int) -> int:
        """Ids the queue has given before ``window``."""
        return self._given(self.high, window) - self._given(self.low, window)

    def place(self, window: int) -> int:
        """Where the queue's ids begin inside ``window``."""
        return self._given(self.low, window + 1) - self._given(self.low, window) + (0 if window else self.skip)

    def pieces(self, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """Window, offset and length of each piece of ``n`` ids that begin at ``at``."""
        window = (at * self.total // (self.high - self.low) + self.skip) // self.length
        while window and self.given(window) > at:
            window -= 1
        while n:
            begin, end = self.given(window), self.given(window + 1)
            if end > at:
                length = min(end - at, n)
                yield window, self.place(window) + at - begin, length
                at, n = at + length, n - length
            window += 1


@dataclass(frozen=True)
class Span:
    """What a source gives in one phase: its ids from ``begin`` on, by turns of a class of sources."""

    begin: int
    size: int
    turn: Queue
    round: Queue
    first: int  # window in which the phase begins

    def pieces(self, at: int, n: int) -> Iterator[tuple[int, int, int]]:
        """Sequence, offset and length of each piece of ``n`` ids from place ``at`` of the source."""
        for turn, inside, taken in self.turn.pieces(at - self.begin, n):
            for window, offset, size in self.round.pieces(turn * self.turn.length + inside, taken):
                yield self.first + window, offset, size


def phases(sizes: Mapping[str | None, int], targets: Mapping[str | None, float], rest: int) -> list[tuple[dict, int]]:
    """What each named source, and all others together, give in each phase.

    ``sizes`` has the ids of the named sources, ``rest`` those of the others, which share what the
    named targets leave of the whole. Shares of zero are served when all others are dry.
    """
    shares = {name: Fraction(targets[name]) for name in sizes}
    left = max(Fraction(0), 1 - sum(map(Fraction, targets.values())))
    queues = [((name,), sizes[name], shares[name]) for name in sizes] + [((), rest, left)]
    given = {key: 0 for key, _, _ in queues}
    out, time = [], Fraction(0)
    served = [q for q in queues if q[2] > 0]
    while any(given[key] < n for key, n, _ in queues):
        active = [(key, n, share) for key, n, share in served if given[key] < n]
        if active:
            time = min(n / share for _, n, share in active)
            gives = {key: min(n, floor(share * time)) - given[key] for key, n, share in active}
        else:  # sources that no target asks for, all at once
            gives = {key: n - given[key] for key, n, _ in queues}
        for key, n in gives.items():
            given[key] += n
        gives = {key: n for key, n in gives.items() if n}
        if gives:
            out.append((gives, sum(gives.values())))
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 1,
    least: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """One row per piece of a text, with the sequence and offset where it lies.

    ``targets`` names sources and their shares of a window; sources that it does not name share
    what is left in proportion to their ids, so without targets every source has its share of
    all ids. While a source lasts, what it has given after any window is within ``least`` ids of
    what its target asks for, or within one id if each window owes it ``least`` or more. When one
    runs dry the others fill the windows by their targets, and sources with nothing to ask for
    come last. All windows but the last are full, and every id lies in one piece.

    Texts are cut where a window's quota ends. Queues follow the order in which rows are
    read. A null or empty text gives its end id alone; null sources form a source of their
    own; repeated rows are packed each; an empty frame gives no rows. Other columns are not
    read, whatever their names. ``source`` and ``source_share`` (its share of the phase in which
    the piece lies) are returned beside the piece. The driver sees the totals of the named sources,
    and in each phase those of sources owed ``least`` ids or more and of at most 64 classes of others.
    """
    ids = tokenize(docs, tokenizer, end_id, id_col, text_col, source_col)
    parts = stored(ids.groupBy("part", "source").agg(F.sum("n").alias("n")), "totals")
    sources = stored(parts.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    targets = dict(targets or {})
    named = F.lit(False)
    for name in targets:
        named = named | F.col("source").eqNullSafe(name)
    sizes = {r["source"]: r["n"] for r in sources.where(named).collect()} if targets else {}
    rest = sources.where(~named).agg(F.sum("n")).first()[0] or 0
    plan = phases(sizes, {k: v for k, v in targets.items() if k in sizes}, rest)
    spans, rounds = _spans(sources, plan, sizes, rest, length, least)

    bases = sums_before(parts, "part", ("n",), ("source",)).withColumnRenamed("source", "_source")
    bases = bases.join(spans, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    bases = stored(bases.withColumnsRenamed({"part": "b_part", "_source": "b_source"}), "bases")
    rows = ids.join(bases, (F.col("part") == F.col("b_part")) & F.expr("source <=> b_source"))
    rows = rows.select("id", "source", "spans", (F.col("base_n") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[tuple[Span, float]]] = {}
        forget()  # ids are stored by now, and the worker may be one that made them
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(9)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, source, found, at, n, data = row
                key = tuple(tuple(f.values()) for f in found)
                if key not in known:
                    known[key] = [_span(f, rounds[f["phase"], f["class"]]) for f in found]
                start = 0
                for span, share in known[key]:
                    low, high = max(at + start, span.begin), min(at + n, span.begin + span.size)
                    if low >= high:
                        continue
                    for window, offset, size in span.pieces(low, high - low):
                        crc = zlib.crc32(data[4 * start : 4 * (start + size)])
                        piece = (doc, start, size, crc, n, window, offset, source, share)
                        for column, value in zip(out, piece, strict=True):
                            column.append(value)
                        start += size
            types = [pa.int64()] * 7 + [pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                [f.split()[0] for f in PIECES.split(", ")],
            )

    return rows.mapInArrow(releasing(run), PIECES)


def _span(found: dict, outer: tuple[Queue, int, int]) -> tuple[Span, float]:
    """A source's span, and its share of its phase."""
    queue, first, turn_length = outer
    turn = Queue(found["low"], found["low"] + found["size"], queue.high - queue.low, turn_length)
    return Span(found["begin"], found["size"], turn, queue, first), found["size"] / queue.total


def _spans(
    sources: DataFrame, plan: list[tuple[dict, int]], sizes: dict, rest: int, length: int, least: int
) -> tuple[DataFrame, dict[tuple[int, int], tuple[Queue, int, int]]]:
    """What every source gives in every phase, and the round of each phase and class of sources.

    One row per source; a round has a queue per large source and one per class of small ones, and a
    class's own rounds are as long as it takes to owe each of its sources half a quantum to a quantum.
    """
    spark = sources.sparkSession
    rows, given = [], {}
    for phase, (gives, _) in enumerate(plan):
        for key, n in gives.items():
            before = given.get(key, 0)
            rows.append((bool(key), key[0] if key else None, phase, before, before + n, sizes[key[0]] if key else rest))
            given[key] = before + n
    steps = spark.createDataFrame(rows, "named boolean, name string, phase int, low_end long, high_end long, whole long")
    is_named = F.lit(False)
    for name in sizes:
        is_named = is_named | F.col("source").eqNullSafe(name)
    marked = sources.withColumn("is_named", is_named)
    # At most one row per named source and phase, and one per phase for all others.
    split = marked.join(F.broadcast(steps), (F.col("is_named") == F.col("named")) & (~F.col("named") | F.col("source").eqNullSafe(F.col("name"))))

    exact = {c: F.expr(f"cast(cast(n as decimal(19,0)) * {c}_end div whole as long)") for c in ("low", "high")}
    split = split.select("source", "phase", exact["low"].alias("begin"), (exact["high"] - exact["low"]).alias("size")).where("size > 0")
    total = Window.partitionBy("phase")
    owed = F.col("size") * length / F.sum("size").over(total)
    turns = F.greatest(F.lit(0), F.ceil(F.log2(F.lit(least / 2) / owed))).cast("int")
    # Sources owed a quantum or more by each window, at most length / least of them, have a queue
    # each: classes below zero.
    large = split.withColumn("large", owed >= least)
    number = F.row_number().over(Window.partitionBy("phase", "large").orderBy("source"))
    classed = large.withColumn("class", F.when(F.col("large"), -number).otherwise(turns)).drop("large")
    earlier = Window.partitionBy("phase", "class").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    classed = stored(classed.withColumn("low", F.coalesce(F.sum("size").over(earlier), F.lit(0))), "spans")
    found = classed.groupBy("phase", "class").agg(F.sum("size").alias("n")).orderBy("phase", "class").collect()
    wholes: dict[int, int] = {}
    for r in found:
        wholes[r["phase"]] = wholes.get(r["phase"], 0) + r["n"]
    rounds, low, base = {}, 0, 0
    for k, r in enumerate(found):
        if k and found[k - 1]["phase"] != r["phase"]:
            low, base = 0, base + wholes[found[k - 1]["phase"]]
        queue = Queue(low, low + r["n"], wholes[r["phase"]], length, base % length)
        turn_length = max(1, -(-r["n"] * length * 2 ** max(0, r["class"]) // wholes[r["phase"]]))
        rounds[r["phase"], r["class"]] = (queue, base // length, turn_length)
        low += r["n"]
    entry = F.struct("phase", "class", "begin", "size", "low")
    return stored(classed.groupBy("source").agg(F.sort_array(F.collect_list(entry)).alias("spans")), "source-spans"), rounds
