"""Licence notices by a trained paragraph classifier, confirmed against templates.

A softmax regression over sparse word n-grams tells licence families and ordinary prose
apart. It is trained on the templates below with words dropped, added and changed, and on
sampled paragraphs of the documents. A paragraph that is no prose but fits no family well
enough is ``unknown``; how well is enough is calibrated by leaving out each family in turn.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by family (fixed texts).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright (c) by the authors. All rights reserved. No part may be reproduced without written permission.",
    ),
}
NONE, UNKNOWN = "none", "unknown"
#: Variants of a template, prose paragraphs and documents sampled for training, at most.
VARIANTS, PROSE, SAMPLE_DOCS = 40, 1500, 400
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
#: What comments begin and end their lines with.
_BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))
_MARK = re.compile(r"(?:dnl|rem)\s|\.\\\"", re.IGNORECASE)
_BEFORE, _AFTER = f"{_BLANKS}/*#;%!<>|'\"-", f"{_BLANKS}/*#;%!<>|-"


def uncommented(line: str) -> str:
    """A line without its comment marks and outer blanks, in time that follows its length."""
    bare = line.lstrip(_BLANKS)
    if mark := _MARK.match(bare):
        bare = bare[mark.end() :]
    return bare.lstrip(_BEFORE).rstrip(_AFTER)


def grams(text: str) -> Counter:
    """Word n-grams of one to three words, numbers with their dots kept whole."""
    words = _WORD.findall(text.lower())
    return Counter(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def variants(template: str, seed: str, n: int = VARIANTS) -> list[str]:
    """A template and changed forms of it: words dropped, added, other case."""
    rng, words, out = random.Random(seed), template.split(), [template]
    while len(out) < n:
        some = [w for w in words if rng.random() > 0.08] or words
        if rng.random() < 0.3:
            some.insert(rng.randrange(len(some) + 1), rng.choice(["file", "code", "the", "project", "2024", "document"]))
        text = " ".join(some)
        out.append(text.lower() if rng.random() < 0.2 else text)
    return out


@dataclass
class Model:
    """A softmax regression over n-grams, with the temperature and threshold of its calibration."""

    classes: tuple[str, ...]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def chances(self, found: Counter) -> np.ndarray:
        z = self.bias.copy()
        norm = max(1.0, sum(c * c for c in found.values()) ** 0.5)
        for gram, count in found.items():
            row = self.weights.get(gram)
            if row is not None:
                z += row * (count / norm)
        z = z / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def train(texts: Sequence[str], labels: Sequence[str], rounds: int = 250, ridge: float = 1e-3) -> Model:
    """Full-batch gradient steps with momentum; texts without known words count as they are."""
    classes = tuple(sorted(set(labels)))
    counted = [grams(t) for t in texts]
    vocabulary = sorted({g for c, label in zip(counted, labels, strict=True) if label != NONE for g in c})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary) + 1), np.float32)
    for row, found in zip(x, counted, strict=True):
        norm = max(1.0, sum(c * c for c in found.values()) ** 0.5)
        for gram, count in found.items():
            if gram in place:
                row[place[gram]] = count / norm
        row[-1] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(label) for label in labels]]
    share = 1 / (y.sum(axis=0) * len(classes))  # classes count alike
    each = (y * share).sum(axis=1, keepdims=True)
    w, speed = np.zeros((x.shape[1], len(classes)), np.float32), 0
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 8.0 * (x.T @ ((p - y) * each) + ridge * w * 0.1)
        w = w + speed
    rows = w.astype(float)
    return Model(classes, {g: rows[i] for g, i in place.items()}, rows[-1])


def _family(model: Model, found: Counter) -> tuple[str, float, float]:
    """Best family, its share among the families, and the chance that it is a licence at all."""
    p = model.chances(found)
    none = model.classes.index(NONE)
    families = np.delete(p, none)
    names = [c for c in model.classes if c != NONE]
    best = int(families.argmax())
    licence = float(families.sum())
    return names[best], float(families[best]) / max(licence, 1e-12), licence


def calibrate(prose: Sequence[str]) -> Model:
    """The model on all families, with threshold and temperature from held-out texts.

    The threshold on a family's share parts held-out variants of known families from all
    variants of a family that the model was trained without.
    """
    known = {f: [v for t in ts for v in variants(t, f)] for f, ts in TEMPLATES.items()}
    texts, labels = list(prose), [NONE] * len(prose)
    for family, found in known.items():
        texts += found
        labels += [family] * len(found)
    model = train(texts, labels)

    right, wrong, held = [], [], []
    for family, ts in TEMPLATES.items():
        fresh = [v for t in ts for v in variants(t, f"held {family}", 8)[1:]]
        without = [i for i, label in enumerate(labels) if label != family]
        other = train([texts[i] for i in without], [labels[i] for i in without], rounds=80)
        wrong += [_family(other, grams(v))[1] for v in fresh]
        right += [_family(model, grams(v))[1] for v in fresh]
        held += [(grams(v), family) for v in fresh]
    options = sorted({*right, *wrong})
    model.threshold = max(options, key=lambda t: np.mean(np.array(right) >= t) + np.mean(np.array(wrong) < t))

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -float(np.mean([np.log(model.chances(g)[model.classes.index(f)] + 1e-12) for g, f in held]))

    model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    return model


@cache
def _template_grams(family: str) -> tuple[Counter, ...]:
    return tuple(grams(t) for t in TEMPLATES.get(family, ()))


class Bound:
    """Whether words can reach a chance of one half of being a licence, told without n-grams.

    A text is a licence by half or more only if some family's weighted sum comes within
    log(families) of that of ``none``. Each word adds at most its own largest difference and
    those of the best known n-grams that begin with it, over a norm that is no less than the root of
    the number of n-grams. So nothing that ``Model.chances`` would find is passed over.
    """

    def __init__(self, model: Model) -> None:
        none = model.classes.index(NONE)
        self._gains: dict[str, list[float]] = {}
        for gram, row in model.weights.items():
            first, *rest = gram.split(" ")
            gain = max(0.0, float(np.delete(row, none).max() - row[none]))
            best = self._gains.setdefault(first, [0.0, 0.0, 0.0])
            best[len(rest)] = max(best[len(rest)], gain)
        bias = float(np.delete(model.bias, none).max() - model.bias[none])
        self._least = -model.temperature * math.log(len(model.classes) - 1) - bias - 1e-6

    def reached(self, words: list[str]) -> bool:
        one = two = three = 0.0
        after = later = None  # gains of the next word and of the one behind it
        for gains in map(self._gains.get, reversed(words)):
            if gains is not None:
                one += gains[0]
                if after is not None:
                    two += gains[1]
                    if later is not None:
                        three += gains[2]
            after, later = gains, after
        norm = max(1.0, sum(max(0, len(words) - k) for k in range(3)) ** 0.5)
        return (one + two + three) / norm >= self._least


@dataclass(frozen=True)
class Needed:
    """The words of a template, and how many different ones a text that is ``confirm`` like it has."""

    family: str
    words: frozenset[str]
    least: int


def needed_words(confirm: float) -> list[Needed]:
    out = []
    for family in TEMPLATES:
        for own in _template_grams(family):
            single = sorted((n for g, n in own.items() if " " not in g), reverse=True)
            # Every missing word is missing as an n-gram of its own; so much may be missing.
            left, least = sum(single) - (1 - confirm) * sum(own.values()) - 1e-9, 0
            while left > 0:
                left -= single[least]
                least += 1
            out.append(Needed(family, frozenset(g for g in own if " " not in g), least))
    return out


@cache
def _template_words() -> frozenset[str]:
    return frozenset(g for f in TEMPLATES for own in _template_grams(f) for g in own if " " not in g)


def template_grams(words: list[str]) -> Counter:
    """The n-grams of ``words`` that a template could hold: those of templates' words only."""
    known, run, out = _template_words(), [], Counter()
    for word in [*words, ""]:
        if word in known:
            run.append(word)
        elif run:
            out.update(" ".join(run[i : i + n]) for n in (1, 2, 3) for i in range(len(run) - n + 1))
            run = []
    return out


def similarity(found: Counter, family: str) -> float:
    """Largest share of a family's template that the paragraph holds, by n-grams."""
    best = 0.0
    for own in _template_grams(family):
        best = max(best, sum((own & found).values()) / max(1, sum(own.values())))
    return best


def paragraphs(lines: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    """First line's number and lines of each run of non-blank lines, comment marks stripped."""
    begin, block = 0, []
    for number, line in enumerate([*lines, ""]):
        bare = uncommented(line)
        if bare:
            begin, block = (begin, block) if block else (number, [])
            block.append(bare)
        elif block:
            yield begin, block
            block = []


def narrowed(block: list[str], family: str, least: float) -> tuple[int, int]:
    """The lines of ``block``, begin and end, that still hold ``least`` of a family's template."""

    def holds(begin: int, end: int) -> bool:
        words = _WORD.findall(" ".join(block[begin:end]).lower())
        return similarity(template_grams(words), family) >= least - 1e-9

    # Fewer lines never hold more, so both ends are found by bisection.
    end = 1 + bisect_left(range(1, len(block)), True, key=lambda n: holds(0, n))
    begin = len(block) - 1 - bisect_left(range(len(block) - 1, 0, -1), True, key=lambda n: holds(n, end))
    while begin and not holds(begin, end):
        begin -= 1
    return begin, end


def fit(docs: DataFrame, text_col: str = "text", prose_chars: int = 2000) -> Model:
    """Train on the templates and on at most ``PROSE`` paragraphs of ``SAMPLE_DOCS`` documents.

    Of a paragraph that stands for prose the first ``prose_chars`` characters are learned from.
    Sampled paragraphs that hold a good part of a template are left out of the prose. Without
    documents a few plain sentences stand for prose.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    sampled = docs.sample(share, seed=4).select(F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    lines = sampled.select(F.explode(F.split("_text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    prose = [r["line"][:prose_chars] for r in lines.limit(PROSE).collect()]
    clean = [p for p in prose if max(similarity(grams(p), f) for f in TEMPLATES) < 0.5]
    return calibrate([*clean, "The weather was fine and they went to the market.", "It is a small town by the river."])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.75) -> DataFrame:
    """Every row's ``doc_id``, ``licence``, ``probability``, ``similarity`` and all ``notices``.

    Paragraphs are the lines of the whole text, each alone, and the runs of lines up to a blank
    one, comment marks stripped, of which the lines with the notice are judged. A notice that is
    confirmed over several lines takes the place of its lines' own, unless one of these is the
    same family and as like the template. A notice has its (first) line number, its family or
    ``unknown``, the calibrated chance, and the share of the family's template that it holds;
    a family stands only if the template confirms it with ``confirm`` or more. ``licence`` is
    the likeliest notice's, ``none`` without one (null and empty texts too). Very long lines and words
    are judged whole, in time that follows their length. Rows are judged
    alone; an empty frame gives no rows; other columns are not read, whatever their names.
    """
    notice = pa.struct([("line", pa.int64()), ("licence", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])
    schema = (
        "doc_id long, licence string, probability double, similarity double, "
        "notices array<struct<line: long, licence: string, probability: double, similarity: double>>"
    )
    needed, bound = needed_words(confirm), Bound(model)
    fewest = min(n.least for n in needed)

    def judge(line: str) -> dict | None:
        if not bound.reached(_WORD.findall(line.lower())):
            return None
        found = grams(line)
        family, share, licence = _family(model, found)
        if licence < 0.5:
            return None
        alike = similarity(found, family)
        name = family if share >= model.threshold and alike >= confirm else UNKNOWN
        return {"licence": name, "probability": share * licence if name != UNKNOWN else licence * (1 - share), "similarity": alike}

    def wrapped(block: list[str]) -> list[tuple[int, int, dict]]:
        """Notices over several lines of a paragraph: begin, end and notice."""
        whole = " ".join(block)
        words, found, out = _WORD.findall(whole.lower()), None, []
        present = _template_words().intersection(words)
        likely = dict.fromkeys(n.family for n in needed if len(n.words & present) >= n.least) if len(present) >= fewest else ()
        for family in likely:
            found = found or template_grams(words)
            alike = similarity(found, family)
            if alike < confirm:
                continue
            for least in (alike, confirm):
                begin, end = narrowed(block, family, least)
                notice = judge(" ".join(block[begin:end])) if end - begin > 1 else None
                if notice and notice["licence"] == family:
                    out.append((begin, end, notice))
                    break
        if not out:
            notice = judge(whole)
            out = [(0, len(block), notice)] if notice else []
        return out

    def merged(notices: list[dict], lines: list[str]) -> list[dict]:
        for first, block in paragraphs(lines):
            if len(block) == 1:
                continue
            for begin, end, notice in wrapped(block):
                inside = [n for n in notices if first + begin <= n["line"] < first + end]
                if notice["licence"] == UNKNOWN:
                    better = bool(inside)
                else:
                    better = any(n["licence"] == notice["licence"] and n["similarity"] >= notice["similarity"] for n in inside)
                if not better:
                    gone = [n for n in inside if n["licence"] in (UNKNOWN, notice["licence"])]
                    notices = [n for n in notices if n not in gone] + [{"line": first + begin, **notice}]
        return sorted(notices, key=lambda n: n["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict | None] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                notices = []
                lines = (text or "").split("\n")
                for number, line in enumerate(lines):
                    if line not in seen:
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[line] = judge(line)
                    if seen[line]:
                        notices.append({"line": number, **seen[line]})
                out.append(merged(notices, lines))
            best = [max(n, key=lambda x: (x["licence"] != UNKNOWN, x["probability"]), default=None) for n in out]
            arrays = [
                batch.column(0),
                pa.array([b["licence"] if b else NONE for b in best], pa.string()),
                pa.array([b and b["probability"] for b in best], pa.float64()),
                pa.array([b and b["similarity"] for b in best], pa.float64()),
                pa.array(out, pa.list_(notice)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "licence", "probability", "similarity", "notices"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
