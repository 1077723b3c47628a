"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick.

Texts are folded first: accents and look-alike letters become plain letters, and digits that
stand for letters inside words become those letters. The lexicon holds whole words and word
beginnings with their log odds; phrases in which a term is harmless take it back. The sum of
weights, alone and per word, gives the score through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters that look like others (fixed values).
LOOKALIKES = dict(
    tuple(pair)
    for pair in (
        "аa вb еe ёe кk мm нh оo рp сc тt уy хx іi їi јj ѕs һh ԁd ԛq ԝw "
        "αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ωw"
    ).split()
)
#: Digits and signs that stand for letters inside words (fixed values).
DIGITS = str.maketrans("01345789@$!|", "oieastbgasil")
#: Length of word beginnings that are tried as terms.
STEMS = range(4, 9)


def _plain() -> dict[int, str]:
    """Letters and signs above ASCII that decompose to plain ones, and look-alikes."""
    table = {}
    for code in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        parts = unicodedata.normalize("NFKD", chr(code)).lower()
        plain = "".join(c for c in parts if not unicodedata.combining(c))
        if plain and plain.isascii():
            table[code] = plain
    table |= {c: None for c in range(0x300, 0x370)}
    for letter, plain in LOOKALIKES.items():
        table[ord(letter)] = table[ord(letter.upper())] = plain
    return table


_PLAIN = _plain()
_SIGN = re.compile(r"[0-9@$!|]")
_OTHER = re.compile(r"[\W_]+")


def _letters(word: str) -> str:
    """A word with digits, these read as letters if it has letters, signs at its end aside."""
    word = word.rstrip("!|")
    return word.translate(DIGITS) if any(c.isalpha() for c in word) else word


def fold(text: str | None) -> str:
    """The words of a text in folded form, one blank before, between and after them.

    Time follows the length of the text, however long a word is.
    """
    plain = (text or "").lower()
    if not plain.isascii():
        plain = plain.translate(_PLAIN)
    if _SIGN.search(plain):
        plain = " ".join([_letters(w) if _SIGN.search(w) else w for w in plain.split()])
    return f" {_OTHER.sub(' ', plain).strip()} "


@dataclass
class Lexicon:
    """Terms with weights, harmless phrases, and the curve from weights to scores.

    A term that ends in a blank is a whole word, any other one a word's beginning; all begin
    with a blank.
    """

    weights: dict[str, float]
    phrases: tuple[str, ...] = ()
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 1.0]))

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """An Aho-Corasick automaton over a lexicon, and the scores it gives."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.phrases:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.automaton.make_automaton()

    def measures(self, text: str | None) -> tuple[float, float]:
        """Weights of all terms outside harmless phrases: logarithms of the sum, and per 100 words."""
        folded = fold(text)
        terms: dict[int, float] = {}
        shields = []
        if self.lexicon.weights:
            for end, (length, weight) in self.automaton.iter(folded):
                begin = end - length + 1
                if weight is None:
                    shields.append((begin, end))
                else:  # of terms that begin at one word the heaviest counts
                    terms[begin] = max(weight, terms.get(begin, weight))
        if shields:
            shields.sort()
            lows, reach = [low for low, _ in shields], list(accumulate((high for _, high in shields), max))
            terms = {at: w for at, w in terms.items() if not ((k := bisect_right(lows, at)) and at < reach[k - 1])}
        total = sum(terms.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        x = float(self.lexicon.curve @ np.array([1.0, *self.measures(text)]))
        return 1 / (1 + float(np.exp(-x)))


def features(text: str | None) -> set[str]:
    """Terms that a text could teach: its words and their beginnings."""
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in STEMS if len(word) >= k)
    return out


def choose(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, support: int, odds: float) -> dict[str, float]:
    """Terms of enough toxic texts and high log odds; a longer term only if it tells more than
    the beginning that stands for it, and of beginnings that occur alike the longest."""
    known = []
    for term, t, c in counts:
        weight = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        if t >= support and weight >= odds:
            known.append((t, weight, term))
    known.sort(key=lambda x: (-x[0], -len(x[2].strip()), x[2]))
    chosen: dict[str, float] = {}
    counted: dict[str, int] = {}
    for t, weight, term in known:
        bare = term.strip()
        if any(term != other and term.startswith(other.rstrip()) and chosen[other] >= weight for other in chosen if not other.endswith(" ")):
            continue
        if any(n == t and other.strip().startswith(bare) for other, n in counted.items()):
            continue  # a shorter beginning of the same texts
        chosen[term], counted[term] = weight, t
    return chosen


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; a slight ridge keeps separable labels finite."""
    full = np.column_stack([np.ones(len(x)), x])
    curve = np.zeros(full.shape[1])
    if not len(y) or y.min() == y.max():
        return np.array([-3.0, 1.0, 1.0])
    penalty = ridge * np.eye(full.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ curve, -30, 30)))
        slope = full.T @ (p - y) + penalty @ curve
        bend = (full * (p * (1 - p))[:, None]).T @ full + penalty
        step = np.linalg.solve(bend, slope)
        curve = curve - step
        if np.abs(step).max() < 1e-6:
            break
    return curve


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 15_000,
    support: int = 4,
    share: float = 0.004,
    odds: float = 3.0,
    max_terms: int = 3000,
    phrases: Sequence[str] = (),
    max_phrases: int = 1000,
) -> Lexicon:
    """A lexicon from labelled documents for which ``usable`` (a condition on the id) holds.

    At most ``max_rows`` labelled rows, chosen by a hash of the id, are learned from; only their
    counts, two measures each, and the ``max_terms`` best terms reach the driver. A term must be in
    ``support`` toxic texts and in the ``share`` of them. Null texts,
    labels and ids teach nothing. ``phrases`` are harmless phrases known beforehand; phrases of
    a term and its neighbour that are found in clean texts only are added, the ``max_phrases`` most
    frequent ones of the learned rows.
    """
    chosen = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = chosen.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id")).limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "_id").select("_label", "_text")  # at most max_rows ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[label > 0].update(features(text))
                seen[label > 0][""] += 1
        terms = list(seen[0] | seen[1])
        arrays = [pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen)]
        yield pa.RecordBatch.from_arrays(arrays, ["term", "clean", "toxic"])

    counts = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    whole = F.col("term") == ""
    # The best terms and, in front of them, the numbers of texts.
    best = counts.where(whole | (F.col("toxic") >= support))
    best = best.orderBy(whole.desc(), (F.col("toxic") / (F.col("clean") + 1)).desc(), "term").limit(max_terms + 1).collect()
    totals = best[0] if best and best[0]["term"] == "" else None
    if totals is None:
        return Lexicon({}, tuple(fold(p) for p in phrases), np.array([-3.0, 1.0, 1.0]))
    support = max(support, round(share * totals["toxic"]))
    weights = choose(((r["term"], r["toxic"], r["clean"]) for r in best[1:]), totals["toxic"], totals["clean"], support, odds)
    lexicon = Lexicon(weights, tuple(fold(p) for p in phrases))
    harmless = _harmless(rows, lexicon, support, max_phrases)
    lexicon = Lexicon(weights, (*lexicon.phrases, *harmless))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            found = [matcher.measures(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "total", "share"])

    points = rows.mapInArrow(measure, "label int, total double, share double").collect()
    values = np.array(points, float).reshape(-1, 3)
    lexicon.curve = fit_curve(values[:, 1:], (values[:, 0] > 0).astype(float))
    return lexicon


def _harmless(rows: DataFrame, lexicon: Lexicon, support: int, most: int) -> list[str]:
    """Phrases of a term's word and one neighbour that clean texts hold and toxic ones do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = lexicon.matcher(), (Counter(), Counter())
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folded, around = fold(text), set()
                ends = matcher.automaton.iter(folded) if lexicon.weights else ()
                for end, (length, weight) in ends:
                    if weight is not None:
                        begin = end - length + 1
                        before = folded.rfind(" ", 0, begin)
                        close = folded.find(" ", begin + 1)
                        after = folded.find(" ", close + 1)
                        around |= {folded[max(before, 0) : close + 1], folded[begin : after + 1]} if after > 0 else {folded[max(before, 0) : close + 1]}
                seen[label > 0].update(p for p in around if p.count(" ") == 3)
        terms = list(seen[0] | seen[1])
        arrays = [pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen)]
        yield pa.RecordBatch.from_arrays(arrays, ["phrase", "clean", "toxic"])

    counts = rows.mapInArrow(run, "phrase string, clean long, toxic long").groupBy("phrase")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counts.where((F.col("clean") >= support) & (F.col("toxic") * 9 <= F.col("clean")))
    return [r["phrase"] for r in kept.orderBy(F.desc("clean"), "phrase").limit(most).collect()]


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row; a null or empty text has no term.

    Rows are scored alone, so repeated rows get equal scores; an empty frame gives no rows.
    Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            scores = [matcher.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double")
