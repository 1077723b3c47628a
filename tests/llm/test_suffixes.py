"""Suffix sorting and repeated passages against plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import suffixes


def covered(docs, length=50):
    """Per document the bytes to remove, by looking up every string."""
    first = {}
    texts = [((suffixes.NO_ID if i is None else i), (t or "").encode()) for i, t in docs]
    for i, data in texts:
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, data in texts:
        mask = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                mask[p : p + length] = True
        out.append(mask)
    return out


def corpus(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(30)]

    def some(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passages = [some(rng.randint(8, 40)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else some(rng.randint(1, 30)) for _ in range(rng.randint(0, 6))]
        text = "a" * rng.randint(0, 300) if rng.random() < 0.1 else " ".join(parts)
        docs.append((i, text if rng.random() < 0.95 else None))
    return docs + [docs[3], (None, docs[5][1]), (None, docs[5][1]), (n, "x" * 49), (n + 1, "")]


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh", b"a"])
@pytest.mark.parametrize("at_once", [10, 1 << 17])
def test_order_of_suffixes(monkeypatch, alphabet, at_once):
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(alphabet) for _ in range(700)), np.uint8)
    starts = np.array(rng.sample(range(651), 651))
    order, fresh = suffixes.sort_suffixes(data, starts, 50)
    strings = [data[s : s + 50].tobytes() for s in starts[order]]
    assert strings == sorted(strings)
    assert fresh.tolist() == [True, *(a != b for a, b in zip(strings, strings[1:], strict=False))]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [2, 4096])
def test_spans(spark, seed, hot):
    docs = corpus(random.Random(seed), 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("start", F.lit(7))
    found = suffixes.digests(frame, batch_bytes=2000, hot_runs=hot).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found)
    want = []
    for (i, text), mask in zip(docs, covered(docs), strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want.append((-1 if i is None else i, len(data), int(mask.sum()), starts, hashlib.sha256(data[~mask].tobytes()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("chunk", [300, 1 << 19])
def test_runs_do_not_depend_on_chunks(monkeypatch, chunk):
    docs = corpus(random.Random(8), 30)
    ids, texts = zip(*docs, strict=True)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    found = suffixes.Runs(list(ids), list(texts), 50)
    strings = set()
    for place, size in zip(found.place.tolist(), found.size.tolist(), strict=True):
        strings |= {found.data[p : p + 50].tobytes() for p in range(place, place + size - 49)}
    want = {(t or "").encode()[p : p + 50] for t in texts for p in range(len((t or "").encode()) - 49)}
    assert strings == want


def test_cut_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"{passage} end", "a"), (2, f"start {passage}", "b"), (3, passage, "c"), (4, None, None), (5, "", "e"), (6, "é" * 60, "f")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in suffixes.without_repeats(frame).collect()}
    assert rows[1]["text"] == docs[0][1] and rows[2]["text"] == "start " and rows[2]["lang"] == "b"
    assert 3 not in rows and rows[4]["text"] is None and rows[5]["text"] == "" and rows[6]["text"] == "é" * 60


def test_empty_and_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.with_spans(empty, "spans").count() == 0
    one = spark.createDataFrame([(1, "a" * 60), (2, "a" * 70)], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in suffixes.with_spans(one, "spans").collect()}
    assert rows[1] == [] and [tuple(x) for x in rows[2]] == [(0, 70)]
    with pytest.raises(ValueError):
        suffixes.with_spans(empty.withColumn("spans", F.lit(1)), "spans")
