"""Periodic runs against every period tried at every place."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cargolens.llm import runs
from cargolens.llm.queries import op13_periodic_runs


def plain_runs(words):
    """(start, length, period) of all runs, by definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            held = words[start : i + q]
            if len(held) >= max(6, 4 * q) and not any(held[r:] == held[:-r] for r in range(1, q)):
                out.append((start, len(held), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng, total = random.Random(seed), 0
    for _ in range(700):
        words = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]).encode() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(words))
            words[at:at] = words[at : at + rng.randint(1, 7)] * rng.randint(1, 6)
        want = plain_runs(words)
        assert [tuple(r) for r in runs.runs_of(words)] == want
        total += len(want)
    assert total > 300


@pytest.mark.parametrize("seed", range(3))
def test_every_word_appended(seed):
    """Without the cut to stretches: last ends of every suffix, one word after the other."""
    rng = random.Random(seed)
    words = [rng.randint(0, 2) for _ in range(120)]
    ends = runs.LastEnds()
    for at, word in enumerate(words):
        found = ends.access(ends.append(word), at)
        want = {}
        for size in range(1, at + 1):  # where the last ``size`` words ended last
            tail = words[at + 1 - size : at + 1]
            last = max((e for e in range(size - 1, at) if words[e + 1 - size : e + 1] == tail), default=None)
            if last is not None:
                want[last] = size
        assert {e: size for e, size in found if size} == want


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(key, text):
    words = planted(key, [w.decode() for w in (text or "").encode().split()])
    found = plain_runs(words)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (key, len(found), *top, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def query(spark, folder):
    return sorted((tuple(r[n] for n in NAMES) for r in op13_periodic_runs(spark, str(folder)).collect()), key=repr)


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") < 4000)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, tmp_path)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sum(r[1] > 0 for r in got) > 20


def test_edges(spark, tmp_path):
    """Nulls, empty and blank texts, other blanks, repeated rows, clashing columns."""
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "x " * 6, "x " * 5, "a b " * 4, "a b " * 3 + "a", "x x " * 7, "\x1cx " * 6, "é\u0000 " * 9]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = [(k - 5, t) for k, t in enumerate(texts)] + [(None, "a b " * 5), (None, None), (3, texts[8]), (3, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({n: F.lit(1) for n in ("runs", "start", "n_words", "collapsed", "_text")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert query(spark, tmp_path) == sorted((expected(*r) for r in rows), key=repr)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert query(spark, tmp_path / "none") == []


def test_long_texts():
    """One word of 5 MB, 300,000 equal words, and a long period, in bounded time."""
    begun = time.monotonic()
    assert runs.runs_of(["x" * 5_000_000]) == []
    assert runs.runs_of([b"x"] * 300_000) == [(0, 300_000, 1)]
    rng = random.Random(5)
    period = [str(rng.randint(0, 400)).encode() for _ in range(30_000)]
    assert runs.runs_of([b"?", *period * 5, b"!"]) == [(1, 150_000, 30_000)]
    assert time.monotonic() - begun < 60
