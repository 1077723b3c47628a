"""Quality rules as a short-circuit cascade, the most rejecting rule per unit of cost first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """Measures of one text, each computed when first asked for. A null text has no words."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # Splitting bytes knows the six ASCII blanks only, as the word pattern does.
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a three-word window that the text holds twice or more."""
        if self.n_words < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in self.words])
        pairs = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)[1]
        _, window, times = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        covered = np.zeros(self.n_words, bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """A named test that a text of good quality passes."""

    name: str
    passes: Callable[[Text], bool]


def _enough_words(t: Text) -> bool:
    return t.n_words >= 50


def _few_repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words <= 50 * t.n_words


def _few_symbols(t: Text) -> bool:
    return 10 * t.n_symbols <= t.n_words


def _usual_words(t: Text) -> bool:
    return 5 * t.n_words <= 2 * t.word_chars and t.word_chars <= 12 * t.n_words


def _few_equal_lines(t: Text) -> bool:
    return 2 * t.n_dup_lines <= len(t.lines)


BASE = (Rule("enough_words", _enough_words), Rule("few_repeats", _few_repeats))
RULES = (
    *BASE,
    Rule("few_symbols", _few_symbols),
    Rule("usual_words", _usual_words),
    Rule("few_equal_lines", _few_equal_lines),
)


def order_rules(costs: np.ndarray, rejects: np.ndarray) -> list[int]:
    """Order of rules by rejection per cost, each judged on what the rules before it let pass.

    ``costs`` (texts x rules) in seconds, ``rejects`` (texts x rules) as booleans. Without
    texts the order is as given; ties go to the rule given first.
    """
    left, order = np.ones(len(rejects), bool), []
    rest = list(range(rejects.shape[1]))
    while rest:
        def worth(k: int) -> float:
            return float(rejects[left, k].sum()) / max(float(costs[left, k].sum()), 1e-9)

        best = max(rest, key=worth)
        order.append(best)
        rest.remove(best)
        left &= ~rejects[:, best]
    return order


def plan_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = 2000
) -> tuple[Rule, ...]:
    """Rules in the order that a sample of about ``sample_rows`` texts suggests.

    Costs and verdicts are taken where the texts lie; the driver sees two numbers per text
    and rule. The order decides how much work is done and never which texts are kept.
    """
    names = [f"c{i}" for i in range(len(rules))] + [f"r{i}" for i in range(len(rules))]
    schema = ", ".join(f"{n} double" for n in names)

    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                costs, rejects = [], []
                for rule in rules:
                    text, start = Text(value), time.perf_counter()
                    rejects.append(0.0 if rule.passes(text) else 1.0)
                    costs.append(time.perf_counter() - start)
                rows.append(costs + rejects)
            columns = np.array(rows, float).reshape(len(rows), len(names)).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    share = min(1.0, sample_rows / max(1, docs.count()))
    found = docs.select(text_col).sample(share, seed=3).mapInArrow(trial, schema).limit(2 * sample_rows).collect()
    seen = np.array(found, float).reshape(len(found), len(names))
    return tuple(rules[k] for k in order_rules(seen[:, : len(rules)], seen[:, len(rules) :] > 0))


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    measures: Sequence[str] = (),
) -> DataFrame:
    """Every row's ``keep`` columns, ``kept``, ``failed_rule`` and the measures asked for.

    Rules run in the order given and stop at the first that fails; its name is
    ``failed_rule`` (null for kept texts). Asked-for measures are computed for every text.
    A null or empty text has no words and fails ``enough_words``. Rows are judged alone, so
    repeated rows get equal verdicts; an empty frame gives no rows. Columns not named in
    ``keep`` are not read, whatever their names; one in ``keep`` must not be called like a result.
    """
    if clash := {"kept", "failed_rule", *measures} & {*keep}:
        raise ValueError(f"columns named like a result: {sorted(clash)}")
    schema = "kept boolean, failed_rule string" + "".join(f", {m} long" for m in measures)
    typed = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed: list[str | None] = []
            values: list[list[int]] = [[] for _ in measures]
            for value in batch.column(len(keep)).to_pylist():
                text = Text(value)
                failed.append(next((r.name for r in rules if not r.passes(text)), None))
                for into, measure in zip(values, measures, strict=True):
                    into.append(getattr(text, measure))
            verdict = pa.array([f is None for f in failed], pa.bool_())
            columns = [*batch.columns[: len(keep)], verdict, pa.array(failed, pa.string())]
            columns += [pa.array(v, pa.int64()) for v in values]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "kept", "failed_rule", *measures])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, typed + schema)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = map(Text, batch.column(at).to_pylist())
            yield batch.filter(pa.array([all(r.passes(t) for r in rules) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
