"""Periodic runs of words: maximal stretches that repeat their first words four times or more.

The words of a text are appended one by one to a suffix automaton, whose suffix links form a
tree; the path from the newest state to the root holds all suffixes of what was read. A link-cut
tree over the links keeps that tree as paths of one colour, the colour being the place where the
path's strings ended last. Access to the newest state walks over these paths and recolours them
to the place just read. A path whose longest string has length m and that ended last d words
ago shows that the last d + m words have period d; for m >= d that is a square, d is its smallest
period, and over the following words it grows into the run.

A text is first cut down, exactly, to the stretches in which a run can lie at all: words at
which five words in a row have been seen before in the text, and as much before them as the
longest period that fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import slices

#: A run has at least this many words, and at least this many periods.
SHORTEST, PERIODS = 6, 4
#: Words in a row that a run holds twice: its length less its period is five or more.
GRAM = 5


class Run(NamedTuple):
    """Words ``start`` to ``start + length`` of a text have the smallest period ``period``."""

    start: int
    length: int
    period: int


class LastEnds:
    """A suffix automaton of the words appended so far, its links kept as a link-cut tree.

    State 0 is the empty string. Every tree of ``up``/``left``/``right`` is one path of links,
    in order of length, with one colour: where its strings ended last. The colour stands at the
    tree's root, whose ``up`` is the state above the path.
    """

    def __init__(self) -> None:
        self.size, self.link, self.next = [0], [-1], [{}]
        self.up, self.left, self.right, self.colour = [-1], [-1], [-1], [-1]
        self.newest = 0

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(edges)
        for links in (self.up, self.left, self.right, self.colour):
            links.append(-1)
        return len(self.size) - 1

    def append(self, word: int) -> int:
        """Add a word; return its state, which hangs below its link as a path of its own."""
        size, link, edges = self.size, self.link, self.next
        last, state = self.newest, self._state(self.size[self.newest] + 1, 0, {})
        while last >= 0 and word not in edges[last]:
            edges[last][word] = state
            last = link[last]
        if last >= 0:
            target = edges[last][word]
            if size[target] > size[last] + 1:
                target = self._clone(target, last, word)
            link[state] = target
        self.up[state], self.newest = link[state], state
        return state

    def _clone(self, target: int, last: int, word: int) -> int:
        """Part the shorter strings of ``target`` off; they stand above it on the same path."""
        link, edges, up, left = self.link, self.next, self.up, self.left
        clone = self._state(self.size[last] + 1, link[target], edges[target].copy())
        link[target] = clone
        while last >= 0 and edges[last].get(word) == target:
            edges[last][word] = clone
            last = link[last]
        # Both ended last at the same place, so the path keeps its colour and its order.
        self._splay(target)
        above = left[target]
        left[target], up[clone], left[clone] = clone, target, above
        if above >= 0:
            up[above] = clone
        return clone

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its path's tree; the colour goes with it."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        y = up[x]
        while y >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z >= 0 and (left[z] == y or right[z] == y)
            if inner:
                # Turn y over z, or x over y, first, as their sides agree or not.
                turns = ((y, z), (x, y)) if (left[z] == y) == (left[y] == x) else ((x, y), (x, z))
            else:
                turns = ((x, y),)
            for a, b in turns:
                above = up[b]
                if left[b] == a:
                    side = right[a]
                    left[b], right[a] = side, b
                else:
                    side = left[a]
                    right[b], left[a] = side, b
                if side >= 0:
                    up[side] = b
                up[b], up[a] = a, above
                if above >= 0:
                    if left[above] == b:
                        left[above] = a
                    elif right[above] == b:
                        right[above] = a
                    else:  # b was the root, and its colour moves on
                        colour[a] = colour[b]
                else:
                    colour[a] = colour[b]
            y = up[x]

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """Recolour the path from the root to ``state``; the colours it had, with their greatest size."""
        up, right, colour, size = self.up, self.right, self.colour, self.size
        found, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            if colour[x] >= 0:
                found.append((colour[x], size[x]))
            deeper = right[x]
            if deeper >= 0:  # strings that did not end here keep their colour
                colour[deeper] = colour[x]
            right[x] = below
            if below >= 0:
                up[below] = x
            below, x = x, up[x]
        colour[below] = place
        return found


def _stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each stretch of words at which ``GRAM`` words in a row repeat.

    Grams are compared by hash: equal ones always match, so no stretch is lost.
    """
    if len(words) < SHORTEST:
        return []
    with np.errstate(over="ignore"):
        mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        grams = np.zeros(len(words) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            grams = grams * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(grams)]
    order = np.argsort(grams, kind="stable")
    again = np.zeros(len(grams) + 2, bool)
    again[1 + order[1:]] = grams[order[1:]] == grams[order[:-1]]
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(a + GRAM - 1, b + GRAM - 2) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def runs_of(words: Sequence[bytes]) -> list[Run]:
    """All runs of a list of words, by start and then period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found: dict[tuple[int, int], int] = {}
    for first, last in _stretches(ids):
        # In a run of period q every word from q + 4 on is in the stretch, 3 q - 4 or more of them.
        begin = max(0, first - (last - first + 1 + GRAM) // (PERIODS - 1) - GRAM)
        ends = LastEnds()
        for at, word in enumerate(ids[begin : last + 1].tolist()):
            seen = ends.access(ends.append(word), at)
            if begin + at < first:  # a run that ends here belongs to an earlier stretch
                continue
            for end, size in seen:
                period = at - end
                if size >= period and (length := size + period) >= max(SHORTEST, PERIODS * period):
                    found[begin + at + 1 - length, period] = length
    return [Run(start, length, period) for (start, period), length in sorted(found.items())]


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        change[run.start + run.period] += 1
        change[run.start + run.length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def strongest(runs: Sequence[Run]) -> Run | None:
    """The run with the most periods; of equal ones that which starts first, then the shorter period."""
    return max(runs, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)


def split_words(key: int | None, text: str | None) -> list[bytes]:
    """The words of a text; bytes split at the six ASCII blanks only."""
    return (text or "").encode().split()


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_of: Callable[[int | None, str | None], list[bytes]] = split_words,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs``, ``strongest`` and ``collapsed`` of every row.

    ``runs`` is a list of structs (start, length, period) by start and period, ``strongest`` the
    one with the most periods or null, ``collapsed`` the text without the words that a run holds
    after its first period, joined by one blank. ``words_of`` turns an id and its text into words.
    A null, empty or blank text has no words, no run and an empty text. Ids may be null or repeat;
    each row is judged alone. A text is read whole by one task, and memory follows its longest
    repeated stretch, about 1 KB a word. Other columns are not read, whatever their names. An
    empty frame gives no rows.
    """
    a_run = pa.struct([(n, pa.int64()) for n in Run._fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, texts = (c.to_pylist() for c in batch.columns)
            sizes, found, best, left = [], [], [], []
            for key, text in zip(keys, texts, strict=True):
                words = words_of(key, text)
                runs = runs_of(words)
                top = strongest(runs)
                sizes.append(len(words))
                found.append([r._asdict() for r in runs])
                best.append(top and top._asdict())
                left.append(b" ".join(collapsed(words, runs)).decode())
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(found, pa.list_(a_run)),
                pa.array(best, a_run),
                pa.array(left, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    parts = "struct<start: long, length: long, period: long>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{parts}>, strongest {parts}, collapsed string")
